"""Texts to vectors that are stored beside the row, by any encoder.

An encoder is a function of rows with a ``text`` column that returns the same rows with an ``embedding`` in its place;
a service or a model of one's own can take the part. ``HashedTerms`` is the one built in: it is fitted once over a
corpus, stored as a table, and gives a text the same vector ever after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[DataFrame], DataFrame]

BUCKETS = 1 << 16   # terms are hashed to so many; also the bound on a fitted model's rows
DIMENSIONS = 64
SCALE = 1000        # weights are whole, so that sums don't depend on their order
PRIME = 2147483647
# seeds of the projection, fixed values: a bucket adds to one place per (factor, offset), with a sign
PROJECTION = ((48271, 11), (69621, 1013), (16807, 104729), (39373, 15485863))


def embed(rows: DataFrame, encoder: Encoder, text: Column, column: str) -> DataFrame:
    """``rows`` with the vector of ``text`` in ``column``, replacing one of that name; nothing is shuffled."""
    names = [c for c in rows.columns if c != column]
    packed = rows.select(F.struct(*names).alias("_row"), F.coalesce(text, F.lit("")).alias("text"))
    return encoder(packed).select("_row.*", F.col("embedding").alias(column))


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash bucket of every word of letters and digits in lower-case texts, repeats included; a null has no words.

    The bucket is the first 16 bits of the word's MD5; a word is hashed once per Arrow batch.
    """
    words = pc.split_pattern_regex(texts, r"[^\p{L}\p{N}]+")
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    found = words.flatten().dictionary_encode()
    hashes = [int.from_bytes(md5(w.encode()).digest()[:2]) if w else -1 for w in found.dictionary.to_pylist()]
    flat = np.array(hashes, dtype=np.int64)[found.indices.to_numpy(zero_copy_only=False)]
    real = flat >= 0  # before a first mark and behind a last one stands an empty word
    return np.repeat(np.arange(len(texts)), counts)[real], flat[real]


class HashedTerms:
    """Weighted term buckets under a seeded sparse projection, as unit vectors; a text without words is all zeros."""

    def __init__(self, spark: SparkSession, path: str):
        """The model stored at ``path``: at most 65,537 rows (``BUCKETS`` and one for buckets never seen)."""
        weights = {r["bucket"]: r["weight"] for r in spark.read.schema("bucket int, weight long").parquet(path).collect()}
        table = np.full(BUCKETS, weights.pop(-1), dtype=np.int64)
        table[list(weights)] = list(weights.values())
        self.weights = spark.sparkContext.broadcast(table)  # half a megabyte

    @staticmethod
    def fit(texts: DataFrame, path: str) -> None:
        """Store the inverse document frequency of every bucket over the ``text`` of all rows.

        A task counts the texts of each bucket over all of its rows and hands on 65,536 rows at most.
        """
        def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(BUCKETS, dtype=np.int64)
            for part in parts:
                row, flat = buckets(part.column(0))
                keys = np.sort(row * BUCKETS + flat)
                firsts = keys[np.diff(keys, prepend=-1) > 0]  # once per text
                seen += np.bincount(firsts % BUCKETS, minlength=BUCKETS)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bucket", "df"])

        n = texts.agg((F.count("*") + 1).alias("n"))  # one row
        seen = texts.select(F.lower("text")).mapInArrow(count, "bucket int, df long")
        counted = seen.groupBy("bucket").agg(F.sum("df").alias("df"))
        never = texts.sparkSession.createDataFrame([(-1, 0)], "bucket int, df long")
        weight = F.floor(F.ln(F.col("n").cast("double") / (F.col("df") + 1)) * F.lit(float(SCALE)))
        rows = counted.unionByName(never).join(F.broadcast(n), F.lit(True))
        rows.select("bucket", weight.cast("long").alias("weight")).coalesce(1).write.mode("overwrite").parquet(path)

    def __call__(self, rows: DataFrame) -> DataFrame:
        weights = self.weights

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def project(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            every = np.arange(BUCKETS)
            mixed = [(every * factor + offset) % PRIME for factor, offset in PROJECTION]
            tables = [(m % DIMENSIONS, weights.value * (1 - 2 * (m // DIMENSIONS % 2))) for m in mixed]
            for texts in parts:
                row, flat = buckets(texts)
                out = np.zeros(len(texts) * DIMENSIONS)
                for place, signed in tables:
                    out += np.bincount(row * DIMENSIONS + place[flat], weights=signed[flat], minlength=len(out))
                out = out.reshape(len(texts), DIMENSIONS)
                norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
                unit = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0).astype(np.float32)
                ends = np.arange(len(texts) + 1, dtype=np.int32) * DIMENSIONS
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))

        kept = [c for c in rows.columns if c != "text"]
        return rows.select(*kept, project(F.lower("text")).alias("embedding"))
