"""Stores by key as logs of deltas over buckets (O7, O8, O59): a batch writes what it brings, reads merge, sizes decide what is merged
for good."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical
from .scratch import borrowed
from .versions import Versions


def same_key(a: DataFrame, b: DataFrame, *key: str) -> Column:
    """Whether rows of two tables have one key; nothing is a value like others."""
    each = [a[c].eqNullSafe(b[c]) for c in key]
    return reduce(Column.__and__, each)


@dataclass(frozen=True)
class Layout:
    """Deltas of about one size (a power of `fan`) are merged when there are `fan` of them; all of them go into the buckets when they hold
    `ratio` of the buckets' bytes (`least` bytes at least). A bucket of more than `bucket` bytes is split by the next bits of its hash.
    So a row is rewritten about fan * log(size) / ratio times in all, whatever the number of batches; a bucket from which nothing is taken out
    isn't rewritten, what comes stands beside it."""

    fan: int = 8
    ratio: float = 0.25
    least: int = 64 << 20
    bucket: int = 256 << 20


class KeyedStore:
    """Tables with one key and versions that they share.

    A delta is a folder of rows of each table, sorted by key, and of the keys that it takes out (all that its batch names, so nothing of
    a key's old rows stays). A row counts where no later delta takes its key out. A bucket holds the rows of a range of hashes, in files sorted
    by key, of one or more merges; batches don't touch it. Each writer's last batch is part of the version, so a replayed batch does nothing. Writers of several
    applications may meet: who finds its version's number taken tries the next one, with the same folder.

    tables: name and schema; columns of the key and its hash are the same in each.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], key: tuple[str, ...], sort: tuple[str, ...] = (), layout: Layout = Layout()):
        self.spark, self.path, self.tables, self.key, self.sort, self.layout = spark, path.rstrip("/"), tables, key, sort, layout
        self.versions = Versions(spark, path)

    # what a version consists of

    def _state(self, version: int | None = None) -> dict:
        state = self.versions.latest() if version is None else self.versions.read(version)
        state = {"deltas": [], "buckets": [{"bits": 0, "prefix": 0, "paths": {}, "bytes": 0}], "writers": {}, **state}
        # older versions name one folder of each table
        return {**state, "buckets": [{"adopted": [], **b, "paths": {n: [p] if isinstance(p, str) else p for n, p in b["paths"].items()}} for b in state["buckets"]]}

    def _commit(self, state: dict) -> bool:
        paths = [d["path"] for d in state["deltas"]] + [p for b in state["buckets"] for p in [*b["adopted"], *(p for files in b["paths"].values() for p in files)]]
        return self.versions.commit({**state, "version": state["version"] + 1, "paths": paths})

    def _new(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    # reading

    @staticmethod
    def _files(buckets: list[dict], table: str) -> list[str]:
        return [p for b in buckets for p in [*b["paths"].get(table, []), *(f"{a}/{table}" for a in b["adopted"])]]

    def _rows(self, table: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def _gone(self, deltas: list[dict]) -> DataFrame:
        """The key and _until: up to which delta, itself left out, a key's rows are taken out."""
        kind = self._rows(next(iter(self.tables)), []).select(*self.key).schema
        each = [self.spark.read.schema(kind).parquet(f"{d['path']}/gone").withColumn("_until", F.lit(d["seq"])) for d in deltas]
        every = each[0]
        for one in each[1:]:
            every = every.union(one)
        return every.groupBy(*self.key).agg(F.max("_until").alias("_until"))

    def _merged(self, table: str, buckets: list[dict], deltas: list[dict]) -> DataFrame:
        rows = self._rows(table, self._files(buckets, table))
        if not deltas:
            return rows
        every = rows.withColumn("_seq", F.lit(0))
        for d in deltas:
            every = every.union(self._rows(table, [f"{d['path']}/{table}"]).withColumn("_seq", F.lit(d["seq"])))
        gone = self._gone(deltas)
        kept = every.join(gone, same_key(every, gone, *self.key), "left").where("_until is null or _seq >= _until")
        return kept.select(*(every[c] for c in rows.columns))

    def version(self) -> int:
        """The newest version; a reader that keeps its number reads the same rows until it is vacuumed."""
        return self.versions.latest()["version"]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is named."""
        state = self._state(version)
        return self._merged(name, state["buckets"], state["deltas"])

    # writing

    def _sorted(self, df: DataFrame, *first: str) -> DataFrame:
        return df.sortWithinPartitions(*first, *self.key, *(c for c in self.sort if c in df.columns))

    def _write_delta(self, tables: dict[str, DataFrame], gone: DataFrame) -> dict:
        path = self._new()
        for name, rows in tables.items():
            self._sorted(rows).write.parquet(f"{path}/{name}", compression="zstd")
        gone.write.parquet(f"{path}/gone", compression="zstd")
        return {"path": path, "bytes": self.versions.size(path)}

    def _has(self, writer: str, batch: int, state: dict | None = None) -> bool:
        return batch <= (self._state() if state is None else state)["writers"].get(writer, -1)

    def put(self, tables: dict[str, DataFrame], gone: DataFrame, writer: str, batch: int) -> None:
        """Takes out all rows of the keys in gone, which names those of the new rows too, and puts in the rows of every table. Writes in
        proportion to the batch."""
        if self._has(writer, batch):
            return
        delta = self._write_delta({n: tables[n].select(*self._rows(n, []).columns) for n in self.tables}, gone.select(*self.key).where(F.col(self.key[0]).isNotNull()).distinct())
        while not self._has(writer, batch, state := self._state()):
            change = {"deltas": [*state["deltas"], {**delta, "seq": state["version"] + 1}], "writers": {**state["writers"], writer: batch}}
            if self._commit({**state, **change}):
                break
        self.tidy()

    # merging

    def tidy(self) -> None:
        """Merges deltas of one size, and all of them into the buckets where they have become large. Gives up where another writer's merge
        came first; the next batch tries again."""
        state = self._state()
        size = sum(d["bytes"] for d in state["deltas"])
        if size > max(self.layout.least, self.layout.ratio * sum(b["bytes"] for b in state["buckets"])):
            self._into_buckets(state)
            return
        tier = lambda d: int(math.log(d["bytes"] + 1, self.layout.fan))
        tail: list[dict] = []
        for d in reversed(state["deltas"]):
            if tail and tier(d) > max(map(tier, tail)):
                break
            tail.insert(0, d)
        if len(tail) >= self.layout.fan:
            self._join_deltas(tail)

    def _replaced(self, old: list[dict], new: list[dict], buckets: tuple[list[dict], list[dict]] | None = None) -> bool:
        """Commits a merge of `old` deltas; batches that came in the meantime stay."""
        while True:
            state = self._state()
            if any(d not in state["deltas"] for d in old) or (buckets and state["buckets"] != buckets[0]):
                return False
            rest = [d for d in state["deltas"] if d not in old]
            change = {"deltas": sorted([*new, *rest], key=lambda d: d["seq"])}
            if self._commit({**state, **change, **({"buckets": buckets[1]} if buckets else {})}):
                return True

    def _join_deltas(self, deltas: list[dict]) -> None:
        delta = self._write_delta({n: self._merged(n, [], deltas) for n in self.tables}, self._gone(deltas).select(*self.key))
        self._replaced(deltas, [{**delta, "seq": deltas[-1]["seq"]}])

    @staticmethod
    def _place(buckets: list[dict], columns: tuple[str, ...]) -> Column:
        """The number of a row's bucket: a directory over as many first bits of the hash as the smallest bucket has."""
        depth = max(b["bits"] for b in buckets)
        if depth == 0:
            return F.lit(0)
        directory = [0] * (1 << depth)
        for i, b in enumerate(buckets):
            width = depth - b["bits"]
            directory[b["prefix"] << width : (b["prefix"] + 1) << width] = [i] * (1 << width)
        return F.element_at(F.lit(directory), F.shiftrightunsigned(F.xxhash64(*columns), 64 - depth).cast("int") + 1)

    def _hit(self, buckets: list[dict], gone: DataFrame) -> set[int]:
        """Numbers of the buckets that hold a row of a key in gone."""
        hit: set[int] = set()
        for name in self.tables:
            held = self._rows(name, self._files(buckets, name)).select(*self.key)
            hit |= {r[0] for r in held.join(gone, same_key(held, gone, *self.key), "left_semi").select(self._place(buckets, self.key)).distinct().collect()}
        return hit

    def _into_buckets(self, state: dict) -> None:
        """Buckets of which rows are taken out are written anew, and split where they have become large; for others what comes is written
        beside what they have. A single delta becomes a part of a single bucket as it is."""
        old, deltas = state["buckets"], state["deltas"]
        gone = self._gone(deltas)
        coming = {r["bucket"]: r["count"] for r in gone.groupBy(self._place(old, self.key).alias("bucket")).count().collect()}
        hit = self._hit(old, gone)
        if len(old) == len(deltas) == 1 and not hit:
            self._replaced(deltas, [], (old, [{**old[0], "adopted": [*old[0]["adopted"], deltas[0]["path"]], "bytes": old[0]["bytes"] + deltas[0]["bytes"]}]))
            return
        share = sum(d["bytes"] for d in deltas) / max(1, sum(coming.values()))
        kept = [b for i, b in enumerate(old) if i not in hit and (b["bytes"] or i not in coming)]
        fresh = []
        for i, b in enumerate(old):
            if b not in kept:
                more = max(0, math.ceil(math.log2(max(1, b["bytes"] + coming.get(i, 0) * share) / self.layout.bucket)))
                fresh += [{"bits": b["bits"] + more, "prefix": (b["prefix"] << more) + j, "paths": {}, "adopted": [], "bytes": 0} for j in range(1 << more)]
        layout, data = [*({**b, "paths": {n: list(p) for n, p in b["paths"].items()}} for b in kept), *fresh], self._new()
        for name in self.tables:
            rows = self._merged(name, [b for b in old if b not in kept], deltas).withColumn("_bucket", self._place(layout, self.key))
            # a bucket is as many tasks' as its bytes ask for
            self._sorted(rows.hint("rebalance", "_bucket"), "_bucket").write.partitionBy("_bucket").parquet(f"{data}/{name}", compression="zstd")
            for file in self.versions._fs()[0].listStatus(self.versions._hadoop.Path(f"{data}/{name}")):
                if file.isDirectory():
                    n = file.getPath().getName()
                    b, path = layout[int(n.split("=")[1])], f"{data}/{name}/{n}"
                    b["paths"].setdefault(name, []).append(path)
                    b["bytes"] += self.versions.size(path)
        self._replaced(deltas, [], (old, layout))

    def vacuum(self, keep: int = 10) -> list[str]:
        return self.versions.vacuum(keep)


class ChunkStore(KeyedStore):
    """A chunk table by key (doc_id, chunk_index), replaced by document: one that has become shorter keeps no tail."""

    def __init__(self, spark: SparkSession, path: str, schema: str, layout: Layout = Layout()):
        super().__init__(spark, path, {"rows": schema}, ("doc_id",), ("chunk_index",), layout)
        self.schema = schema

    def read(self, version: int | None = None) -> DataFrame:
        return self.table("rows", version)

    def replace(self, rows: DataFrame | None, gone: DataFrame, writer: str, batch: int) -> None:
        """Takes out all chunks of the documents in gone (doc_id) and of those in rows, and puts rows in. Rows without doc_id are left out."""
        new = self._rows("rows", []) if rows is None else rows.where("doc_id is not null")
        self.put({"rows": new}, gone.select("doc_id").union(new.select("doc_id")), writer, batch)


class PostingIndex(KeyedStore):
    """The word index of all workspaces, refreshed by workspace (O59): of each chunk its postings (O54), packed, and a mark of its text.

    A refresh reads the texts of the workspaces that it names, and no others; of those it derives the postings of the documents whose
    chunks aren't those that the index has. What is read at one version is one state of the whole index, whatever is refreshed meanwhile.
    """

    TABLES = {"packed": "workspace_id string, doc_id bigint, chunk_index int, mark binary, dl int, terms array<struct<term:string,tf:bigint,first_pos:int>>"}

    def __init__(self, spark: SparkSession, path: str, kinds: dict[str, str] | None = None, layout: Layout = Layout()):
        super().__init__(spark, path, {n: (kinds or {}).get(n, s) for n, s in self.TABLES.items()}, ("workspace_id", "doc_id"), ("chunk_index",), layout)

    @staticmethod
    def _marks(rows: DataFrame) -> DataFrame:
        """The marks of each document's chunks."""
        return rows.groupBy("workspace_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("chunk_index").cast("bigint").alias("i"), "mark"))).alias("marks"))

    def refresh(self, chunks: DataFrame, changed: DataFrame, writer: str, batch: int) -> None:
        """chunks: workspace_id, doc_id, chunk_index, text; changed: workspace_id. A workspace that has no chunks any more leaves the index."""
        if self._has(writer, batch):
            return
        with borrowed(changed.select("workspace_id").where("workspace_id is not null").distinct(), "touched") as touched:
            few = [r[0] for r in touched.limit(1000).collect()]  # as a list they reach the scan; more of them are joined
            of = lambda rows: rows.where(F.col("workspace_id").isin(few)) if len(few) < 1000 else rows.join(touched, "workspace_id", "left_semi")
            texts = of(chunks).select(*lexical.CHUNK, "text").withColumn("mark", F.unhex(F.sha2("text", 256)))
            now, had = self._marks(texts), self._marks(of(self.table("packed")))
            unlike = now.join(had, same_key(now, had, *self.key), "full").where(~now["marks"].eqNullSafe(had["marks"]))
            with borrowed(unlike.select(*(F.coalesce(now[c], had[c]).alias(c) for c in self.key)), "unlike") as documents:
                anew = texts.join(documents, same_key(texts, documents, *self.key), "left_semi")
                self.put({"packed": lexical.packed_postings(anew, "mark")}, documents, writer, batch)

    def packed(self, version: int | None = None) -> DataFrame:
        """workspace_id, doc_id, chunk_index, dl, terms, as `lexical.packed_postings` gives them."""
        return self.table("packed", version).select(*lexical.CHUNK, "dl", "terms")

    def postings(self, version: int | None = None) -> DataFrame:
        """packed as rows: workspace_id, doc_id, chunk_index, term, tf, first_pos, dl."""
        return lexical.unpacked(self.packed(version)).select(*lexical.CHUNK, "term", "tf", "first_pos", "dl")

    def stats(self, version: int | None = None) -> DataFrame:
        """workspace_id, n_chunks, avgdl."""
        return self.table("packed", version).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl"))
