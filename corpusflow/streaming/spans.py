"""The spans of a session in order, where some come late: over a table, and over a stream with state.

A session's spans stand in the order in which their names first appear.  Spans of the
local retrieval are often reported after the stages that rest on them; those go
before the first of these stages.  A name that is there already only changes its status.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Spans of the local retrieval, and the stages before which they belong.
RETRIEVAL = ("vector_recall", "keyword_recall", "hybrid_rrf", "local_retrieval")
STAGES, EXTERNAL = ("coverage_assessment", "search_plan_generation"), "external_search."
SPANS = "session long, version long, position long, name string, status string, closed boolean"


def rests_on_retrieval(name: Column) -> Column:
    return name.isin(*STAGES) | name.startswith(EXTERNAL)


def ordered_spans(events: DataFrame) -> DataFrame:
    """(session, position, name, status) of ``events`` (session, seq, name, status): a null status changes nothing."""
    first = events.groupBy("session", "name").agg(F.min("seq").alias("seq"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"))
    stage = first.where(rests_on_retrieval(F.col("name"))).groupBy("session").agg(F.min("seq").alias("stage"))
    late = F.col("name").isin(*RETRIEVAL) & F.coalesce(F.col("seq") > F.col("stage"), F.lit(False))
    place = F.struct(F.when(late, F.col("stage")).otherwise(F.col("seq")), ~late, "seq")
    position = F.row_number().over(Window.partitionBy("session").orderBy("place")) - 1
    placed = first.join(stage, "session", "left").withColumn("place", place)
    return placed.select("session", position.cast("long").alias("position"), "name", "status")


class SpanOrder(StatefulProcessor):
    """Keeps a session's spans, names in order and their states, as one value; ``idle`` milliseconds after its last event a session ends.

    The value is read and written once in a batch, however many events come: every call to the state is a message to the JVM.
    A session has one timer, which is set again when it runs out and the session has gone on.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "version long, ends long, names array<string>, states array<string>")

    def rows(self, session: int, names: list, states: list, version: int, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"session": session, "version": version, "position": range(len(names)), "name": names, "status": states, "closed": closed})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, ends, names, states = self.held.get() or (0, 0, [], [])
        names, known = list(names), dict(zip(names, states))
        stage = next((k for k, n in enumerate(names) if n in STAGES or n.startswith(EXTERNAL)), None)
        events, last = [], 0
        for frame in rows:
            events += zip(frame["seq"].tolist(), frame["name"].tolist(), frame["status"].tolist())
            last = max(last, int(frame["at"].max().timestamp() * 1000) + self.idle)
        for _, name, status in sorted(events, key=lambda e: e[0]):
            status = status if isinstance(status, str) else None
            if name in known:
                known[name] = known[name] if status is None else status
                continue
            known[name] = status
            if stage is not None and name in RETRIEVAL:
                names.insert(stage, name)
                stage += 1
                continue
            if stage is None and (name in STAGES or name.startswith(EXTERNAL)):
                stage = len(names)
            names.append(name)
        if not ends:
            self.handle.registerTimer(last)
        states = [known[n] for n in names]
        self.held.update((version + 1, max(last, ends), names, states))
        yield self.rows(int(key[0]), names, states, version + 1, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, ends, names, states = self.held.get()
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
            return
        self.held.clear()
        yield self.rows(int(key[0]), list(names), list(states), version + 1, True)

    def close(self) -> None:
        pass


def span_versions(events: DataFrame, idle_ms: int, delay: str = "1 hour") -> DataFrame:
    """A new version of a session's spans after each batch that brings it events (session, seq, at, name, status), and a last one when it ends.

    Events of a session come in order, a batch at a time.  State is kept in RocksDB, which
    ``spark.sql.streaming.stateStore.providerClass`` must name.
    """
    late = events.withWatermark("at", delay)
    return late.groupBy("session").transformWithStateInPandas(SpanOrder(idle_ms), SPANS, "update", "eventtime")


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each session."""
    last = versions.groupBy("session").agg(F.max("version").alias("version"))
    return versions.join(last, ["session", "version"])
