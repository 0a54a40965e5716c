"""Small helpers of the text operators: tables by folder, row keys, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text or payload after which an output batch is closed.
BATCH_BYTES = 8 << 20


_STORE: dict = {}


def kept_in_worker(key, make):
    """What a Python worker keeps between tasks under ``key``; another operator's store makes way for it."""
    if key not in _STORE:
        _STORE.clear()
        _STORE[key] = make()
    return _STORE[key]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def row_hash(*columns: str) -> Column:
    """64-bit key of the given columns; nulls count as a value of their own."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def batches(rows: Iterable[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the rows, each closed when the weights (bytes) of its rows reach BATCH_BYTES."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight >= BATCH_BYTES or len(held) >= 10_000:
            yield packed(held, schema)
            held, weight = [], 0
    if held:
        yield packed(held, schema)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def forget(stage: DataFrame) -> None:
    """Remove a table that ``write_stage`` wrote, once all that was made of it is written itself."""
    files = stage.inputFiles()
    if files:
        context = stage.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
