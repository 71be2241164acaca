"""Event rows by day, appended once a batch whatever is replayed, with what each file group holds, so that pages read few of them."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

DAY = 86_400_000_000  # microseconds


@dataclass(frozen=True)
class LogLayout:
    """A day's parts of about one size (a power of `fan`) are joined when there are `fan` of them; those of `large` bytes stay as they are."""

    fan: int = 8
    large: int = 1 << 30


class EventLog:
    """Rows of one schema with a timestamp column `time`, by day of UTC.

    A part is what one batch, or a merge, holds of one day: a folder of files sorted by `cluster`, time and id, whose row groups a filter on
    the cluster skips. A version names the parts with their first and last time and number of rows, and each writer's last batch, so a
    batch that comes again adds nothing, and a batch is seen whole or not at all. The list grows with days, not with batches: parts of a
    day are joined by size. Rows without a time are a day of their own, older than all others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str = "created_at", id: str = "id", cluster: tuple[str, ...] = ("workspace_id",), layout: LogLayout = LogLayout()):
        self.spark, self.path, self.schema, self.time, self.id, self.cluster, self.layout = spark, path.rstrip("/"), schema, time, id, cluster, layout
        self.versions = Versions(spark, path)
        self._fields = spark.createDataFrame([], schema).schema

    # versions

    def _state(self, version: int | None = None) -> dict:
        return {"parts": [], "writers": {}, **(self.versions.latest() if version is None else self.versions.read(version))}

    def _commit(self, state: dict) -> bool:
        return self.versions.commit({**state, "version": state["version"] + 1, "paths": [p["path"] for p in state["parts"]]})

    def version(self) -> int:
        return self.versions.latest()["version"]

    def vacuum(self, keep: int = 10) -> list[str]:
        return self.versions.vacuum(keep)

    # writing

    def _write(self, rows: DataFrame) -> list[dict]:
        """Writes rows by day and says what was written."""
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        micros = F.unix_micros(self.time)
        # a day's rows meet in as many tasks as their bytes ask for
        dealt = rows.withColumn("_day", F.floor(micros / DAY).cast("int")).hint("rebalance", "_day")
        dealt.sortWithinPartitions("_day", *self.cluster, self.time, self.id).write.partitionBy("_day").parquet(data)
        written = self.spark.read.schema(f"`{self.time}` timestamp, _day int").parquet(data)
        facts = {r["_day"]: r for r in written.groupBy("_day").agg(F.count(F.lit(1)).alias("n"), F.min(micros).alias("low"), F.max(micros).alias("high")).collect()}  # one row a day
        parts = []
        for day, r in facts.items():
            path = f"{data}/_day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"
            parts.append({"path": path, "day": day, "n": r["n"], "low": r["low"], "high": r["high"], "bytes": self.versions.size(path)})
        return parts

    def append(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Appends a batch; False where this writer's batch of that number, or a later one, is there already. Columns that the log lacks are left out."""
        done = lambda s: batch <= s["writers"].get(writer, -1)
        if done(self._state()):
            return False
        parts = self._write(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self._fields)))
        while not done(state := self._state()):
            if self._commit({**state, "parts": [*state["parts"], *parts], "writers": {**state["writers"], writer: batch}}):
                self.tidy()
                return True
        return False

    def tidy(self) -> None:
        """Joins a day's parts of one size. Gives up where another writer's merge came first; the next batch tries again."""
        state, tiers = self._state(), {}
        for p in state["parts"]:
            if p["bytes"] < self.layout.large:
                tiers.setdefault((p["day"], int(math.log(p["bytes"] + 1, self.layout.fan))), []).append(p)
        old = [p for group in tiers.values() if len(group) >= self.layout.fan for p in group]
        if not old:
            return
        new = self._write(self._rows(old))
        while all(p in (state := self._state())["parts"] for p in old):
            if self._commit({**state, "parts": [*(p for p in state["parts"] if p not in old), *new]}):
                break

    # reading

    def _rows(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(p["path"] for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def count(self, version: int | None = None) -> int:
        """The number of all rows, from the version alone."""
        return sum(p["n"] for p in self._state(version)["parts"])

    def read(self, since: str | None = None, until: str | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of since <= time < until (ISO 8601), of a version; days outside aren't opened."""
        low, high = self._micros(since), self._micros(until)
        parts = self._state(version)["parts"]
        if low is None and high is None:
            return self._rows(parts)
        timed = [p for p in parts if p["low"] is not None]
        rows = self._rows([p for p in timed if (low is None or p["high"] >= low) and (high is None or p["low"] < high)])
        if low is not None:
            rows = rows.where(F.col(self.time) >= F.timestamp_micros(F.lit(low)))
        return rows if high is None else rows.where(F.col(self.time) < F.timestamp_micros(F.lit(high)))

    def _micros(self, at: str | None) -> int | None:
        return None if at is None else self.spark.range(1).select(F.unix_micros(F.lit(at).cast("timestamp"))).first()[0]

    def newest_days(self, n: int, where: Column | None = None, until: str | None = None, version: int | None = None) -> DataFrame:
        """All rows that `where` takes of the newest days which hold n of them (of all days, if fewer), none after `until`: what a page of n
        rows, newest first, is made of. Twice as many days are tried until there are enough, so what is read is at most about twice what is
        needed, however long the log is."""
        last = self._micros(until)
        parts = [p for p in self._state(version)["parts"] if last is None or p["low"] is not None and p["low"] <= last]
        days = sorted({p["day"] for p in parts}, key=lambda d: (d is not None, d or 0), reverse=True)
        taken = 0
        while True:
            taken = max(1, 2 * taken)
            chosen = set(days[:taken])
            rows = self._rows([p for p in parts if p["day"] in chosen])
            if where is not None:
                rows = rows.where(where)
            if last is not None:
                rows = rows.where(F.col(self.time) <= F.timestamp_micros(F.lit(last)))
            if taken >= len(days) or rows.limit(n).count() == n:
                return rows
