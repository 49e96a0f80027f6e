"""Named paper sources behind three calls; a source that fails gives a row with its message."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.federate import fulltext
from .papers import RECORD, empty
from .remote import RemoteSource

#: The tools by name, with what each must and may be given.
TOOLS = {
    "search_external_papers": (("query",), ("sources", "limit", "date_from", "sortby", "orderby")),
    "get_external_paper_detail": (("source", "external_id"), ()),
    "resolve_external_fulltext": (("source", "external_id"), ("title", "doi", "url", "pdf_url")),
}


class TableSource:
    """A catalogue that is a table of records; filters reach its scan."""

    def __init__(self, records: DataFrame):
        self.records = records.select(*RECORD)

    def search(self, words: list, limit: int) -> DataFrame:
        """The first ``limit`` records, by id, whose title or abstract holds all words."""
        text = F.lower(F.concat_ws(" ", "title", "abstract"))
        held = reduce(lambda a, b: a & b, (text.contains(w.lower()) for w in words), F.lit(True))
        return self.records.where(held).orderBy("external_id").limit(limit)

    def detail(self, external_id: str) -> DataFrame:
        return self.records.where(F.col("external_id") == external_id)

    def details(self, ids: DataFrame) -> DataFrame:
        """The records of many ids (external_id) at once."""
        return self.records.join(ids.select("external_id").distinct(), "external_id", "left_semi")

    def fulltext(self, records: DataFrame) -> DataFrame:
        return fulltext(records).withColumn("message", F.lit(None).cast("string"))


def plain_name(name: str) -> str:
    return (name or "").strip().lower().replace("-", "_")


class Sources:
    """Sources by name: a function of the arguments, a ``TableSource`` or a ``RemoteSource``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_name: dict[str, Callable[[dict], DataFrame] | TableSource | RemoteSource] = {}

    def add(self, name: str, source: Callable[[dict], DataFrame] | TableSource | RemoteSource) -> None:
        self.by_name[plain_name(name)] = source

    def names(self) -> list:
        return sorted(self.by_name)

    def of(self, name: str):
        if plain_name(name) not in self.by_name:
            raise ValueError(f"unknown source {name}")
        return self.by_name[plain_name(name)]

    def tools(self) -> DataFrame:
        """(tool, argument, required) of all calls."""
        rows = [(tool, name, k == 0) for tool, parts in TOOLS.items() for k, names in enumerate(parts) for name in names]
        return self.spark.createDataFrame(rows, "tool string, argument string, required boolean")

    def call(self, tool: str, args: dict) -> DataFrame:
        """A call by its tool's name: records, one record, or where the full text is."""
        if tool not in TOOLS:
            raise ValueError(f"unknown tool {tool}")
        if missing := [a for a in TOOLS[tool][0] if a not in args]:
            raise ValueError(f"{tool} needs {', '.join(missing)}")
        if tool == "search_external_papers":
            return self.search(args.get("sources") or self.names(), {"words": args["query"], "limit": args.get("limit"), "date_from": args.get("date_from"), "sort": args.get("sortby"), "order": args.get("orderby")})[0]
        if tool == "get_external_paper_detail":
            return self.of(args["source"]).detail(args["external_id"]).select(*RECORD)
        record = {c: args.get(c) or "" for c in RECORD} | {"authors": [], "source": plain_name(args["source"])}
        schema = ", ".join(f"{c} {'array<string>' if c == 'authors' else 'string'}" for c in RECORD)
        return self.of(args["source"]).fulltext(self.spark.createDataFrame([tuple(record[c] for c in RECORD)], schema))

    def search(self, names: list, args: dict | list) -> tuple:
        """Records of all sources, and (source, message) of those, or of those requests, that could not be answered.

        ``args`` is one request or a list of them; a remote source answers each request by itself.
        """
        found, failed, told = [empty(self.spark)], [], []
        requests = args if isinstance(args, list) else [args]
        for name in map(plain_name, names):
            try:
                source = self.by_name.get(name)
                if source is None:
                    failed.append((name, "unknown source"))
                elif isinstance(source, RemoteSource):
                    rows = source.search(requests)
                    found.append(rows.where("message is null").select(*RECORD))
                    told.append(rows.where("message is not null").select("source", "message"))
                elif isinstance(source, TableSource):
                    found += [source.search(r.get("words") or [], int(r.get("limit") or 5)).select(*RECORD) for r in requests]
                else:
                    found += [source(r).select(*RECORD) for r in requests]
            except Exception as error:  # noqa: BLE001  the other sources still answer
                failed.append((name, str(error).splitlines()[0] if str(error) else type(error).__name__))
        messages = self.spark.createDataFrame(failed, "source string, message string")
        return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, told, messages)
