"""Paper catalogues behind a provider, as a Spark data source: each request is a partition, a failure is a row.

A provider is any picklable object with ``search``, ``detail`` and ``fulltext``; it runs
in tasks.  Reading all requests of a plan is one scan with as many partitions as
requests, and a filter on ``external_id`` turns the scan into a point read.
"""

import json
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from .papers import RECORD

SCHEMA = ", ".join(f"{c} {'array<string>' if c == 'authors' else 'string'}" for c in RECORD) + ", request int, message string"
#: Fixed values of a search: how results may be ordered, and the most that one request may ask for.
SORTS, ORDERS, MOST = ("relevance", "submittedDate", "publicationDate"), ("descending", "ascending"), 5


class Provider(Protocol):
    """What a catalogue offers; records are dicts with the columns of ``RECORD``, all but the first three optional."""

    def search(self, words: list, limit: int, date_from: str | None, sort: str, order: str) -> Iterable[dict]: ...

    def detail(self, external_id: str) -> dict | None: ...

    def fulltext(self, record: dict) -> dict | None: ...


def search_args(args: dict) -> dict:
    """The arguments of a search with safe values for missing and bad ones; older names count where the new ones are missing."""
    old = {"date_from": "year_from", "sort": "sort_by", "order": "sort_order"}
    given = dict(args)
    for new, name in old.items():
        if new not in given and given.get(name) is not None:
            given[new] = f"{int(given[name]):04d}0101" if name == "year_from" else given[name]
    digits = "".join(c for c in str(given.get("date_from") or "") if c in "0123456789")
    digits = digits + "0101" if len(digits) == 4 else digits
    try:
        limit = int(given.get("limit"))
    except (TypeError, ValueError):
        limit = MOST
    words = [" ".join(str(w).split()) for w in given.get("words") or []]
    sort, order = str(given.get("sort") or SORTS[0]).strip(), str(given.get("order") or ORDERS[0]).strip()
    return {
        "words": list(dict.fromkeys(w for w in words if w))[:4] or ["paper"], "limit": max(1, min(limit, MOST)), "date_from": digits if len(digits) == 8 else None,
        "sort": sort if sort in SORTS else SORTS[0], "order": order if order in ORDERS else ORDERS[0],
    }


def sort_expression(sort: str | None, order: str | None) -> str:
    """How a catalogue of works is asked to sort: by date where that is wanted, else by relevance."""
    by_date = (sort or "").strip() in ("submittedDate", "publication_date", "publicationDate")
    return f"{'publication_date' if by_date else 'relevance_score'}:{'asc' if (order or '').strip() == 'ascending' else 'desc'}"


def data_source(source: str, provider: Provider) -> type:
    """The data source class of one catalogue, to be registered with a session."""

    class Request(InputPartition):
        def __init__(self, number: int, args: dict):
            self.number, self.args = number, args

    class Reader(DataSourceReader):
        def __init__(self, requests: list):
            self.requests, self.wanted = requests, None

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, EqualTo) and f.attribute == ("external_id",):
                    self.wanted = f.value
                else:
                    yield f

        def partitions(self):
            return [Request(0, {})] if self.wanted is not None else [Request(k, r) for k, r in enumerate(self.requests)]

        def read(self, partition):
            try:
                if self.wanted is not None:
                    found = [provider.detail(self.wanted)]
                else:
                    found = list(provider.search(**partition.args))
            except Exception as error:  # noqa: BLE001  the other requests still answer
                yield (source, *(None for _ in RECORD[1:]), partition.number, str(error).splitlines()[0] if str(error) else type(error).__name__)
                return
            for r in found:
                if r is not None:
                    yield (source, *((r.get(c) or ([] if c == "authors" else "")) for c in RECORD[1:]), partition.number, None)

    class Papers(DataSource):
        @classmethod
        def name(cls):
            return f"papers_{source}"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(json.loads(self.options.get("requests", "[]")))

    return Papers


class RemoteSource:
    """One catalogue in a session."""

    def __init__(self, spark: SparkSession, source: str, provider: Provider):
        self.spark, self.source, self.provider = spark, source, provider
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(data_source(source, provider))

    def read(self, requests: list) -> DataFrame:
        return self.spark.read.format(f"papers_{self.source}").option("requests", json.dumps(requests)).load()

    def search(self, requests: list) -> DataFrame:
        """Records of all requests (dicts of ``search_args``), and rows with a message for those that failed."""
        return self.read([search_args(r) for r in requests])

    def detail(self, external_id: str) -> DataFrame:
        """The one record with this id, or a row with a message, or nothing."""
        return self.read([]).where(F.col("external_id") == external_id)

    def fulltext(self, records: DataFrame) -> DataFrame:
        """(external_id, pdf_url, download_url, landing_url, is_open_access, message) of ``records``, asked for in tasks."""
        provider = self.provider
        names = ("pdf_url", "download_url", "landing_url", "is_open_access")

        def ask(frames):
            import pandas as pd

            for frame in frames:
                rows = []
                for r in frame.to_dict("records"):
                    try:
                        found, message = provider.fulltext(r) or {}, None
                    except Exception as error:  # noqa: BLE001
                        found, message = {}, str(error)
                    rows.append((r["external_id"], *(found.get(c, False if c == "is_open_access" else "") for c in names), message))
                yield pd.DataFrame(rows, columns=["external_id", *names, "message"])

        return records.select(*RECORD).mapInPandas(ask, "external_id string, pdf_url string, download_url string, landing_url string, is_open_access boolean, message string")
