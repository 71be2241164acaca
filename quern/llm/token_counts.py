"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches are cut by bytes, not rows, and a long text is encoded as the units of tokens.UnitEncoder, whose cuts are safe.
The only data that leaves a task is one number a row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, frugal, whole_text


def count_tokens(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row of docs: its `keep` columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. Every row stays, repeated ids too; other columns are dropped. `tokenizer` is
    the path of the file on every executor.
    """
    rows = docs.select(*keep, whole_text(text).alias("_text")).withColumn("n_bytes", F.octet_length("_text").cast("long"))
    kept = [f for f in rows.schema if f.name != "_text"]

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        for batch in by_bytes(batches, "_text", 2 << 20):
            lengths = encoder(tokenizer).lengths(batch.column("_text"))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64())], [*(f.name for f in kept), "n_tokens"])
        encoder(tokenizer).forget()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
