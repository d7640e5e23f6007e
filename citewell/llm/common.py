"""Reading the tables and working on Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.sources.tables import bounded_batches, cut, delete

__all__ = ["column_of", "cut", "discard", "joined_evenly", "mapped", "pieces", "read", "texts_of", "utf8"]

PIECE_BYTES = 1_500_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once all that was made of them is written too."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            delete(table.sparkSession, folder)


def texts_of(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and the whole text, NULL as the empty text; other columns only if named. Batches for Python are bounded by bytes."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *others)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values of a string column one after another, and the offset of each (one more at the end)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut so that a piece holds about ``limit`` bytes of the column, or one longer value."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def mapped(df: DataFrame, on_piece: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """``on_piece`` over all rows, in pieces of bounded size."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                yield on_piece(piece)

    return df.mapInArrow(run, schema)


def column_of(text, on_array: Callable[[pa.Array], pa.Array], kind: str):
    """``on_array`` over a text column where it lies, in slices of bounded size."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], names=["text"])
        return pa.concat_arrays([on_array(piece.column(0)) for piece in pieces(batch, "text")]) if len(texts) else on_array(texts)

    return run(text)


def joined_evenly(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key, where a key may hold most rows of ``left``.

    Rows of ``left`` are dealt over parts of their key by a hash of the whole row. A row of ``right`` is repeated only for
    the parts that its key has, so it grows to no more rows than ``left``. Keys are not NULL; ``left`` is read twice.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
    wanted = dealt.select(*keys, "_part").distinct().join(right, keys)
    return dealt.join(wanted, [*keys, "_part"]).drop("_part")
