"""Token ids written as ORC, and read again by stripe or by document id."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_count import SPLIT, load_ranks


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=load_ranks(path), special_tokens={})


def token_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, token_ids) for every row; a null text has null tokens, an empty one none."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [None if t is None else encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                    ["id", "n_tokens", "token_ids"],
                )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_tokens bigint, token_ids array<int>").withColumnRenamed("id", id_col)


def write_token_orc(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    stripe_bytes: int = 64 << 20, row_stride: int = 10_000, bloom_fpp: float = 0.01,
) -> None:
    """Write token ids of every row of ``docs`` to ORC files under ``path``.

    Integers are run-length encoded (version 2), each stripe has a row index every ``row_stride``
    rows and Bloom filters on the id. Stripes are the unit of parallel reads; min/max and Bloom
    filters let a lookup skip stripes and row groups. No shuffle: each task writes what it reads,
    through Spark's commit protocol, so lost executors leave no partial files.

    Null, empty and very long texts, null ids and repeated rows are written as they are; an
    empty table gives an empty data set. Other columns are not stored.
    """
    (
        token_ids(docs, vocabulary, id_col, text_col).write.mode("overwrite")
        .option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true").option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", bloom_fpp)
        .option("orc.encoding.strategy", "SPEED").orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows, or those of ``ids``: an ``IN`` that the ORC reader checks against stripe metadata."""
    df = spark.read.orc(path)
    return df if ids is None else df.filter(F.col(id_col).isin(*ids))
