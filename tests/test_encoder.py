import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefit.functions import encoder as en

TEXTS = [(1, "Senior Java developer, java and SQL"), (2, "the cook and the baker"), (3, None), (4, " .,; "),
         (5, "développeur Java à Zürich"), (5, "the baker"), (None, "sql sql sql"), (7, "word " * 20_000 + "java")]


def plain_buckets(text):
    return [int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_vector(text, corpus):
    seen = Counter(b for t in corpus for b in set(plain_buckets(t)))
    out = np.zeros(en.DIMENSIONS)
    for bucket, tf in Counter(plain_buckets(text)).items():
        weight = tf * math.floor(math.log((len(corpus) + 1) / (seen[bucket] + 1)) * en.SCALE)
        for factor, offset in en.PROJECTION:
            h = (bucket * factor + offset) % en.PRIME
            out[h % en.DIMENSIONS] += weight * (1 if h // en.DIMENSIONS % 2 == 0 else -1)
    norm = math.sqrt((out * out).sum())
    return (out / norm if norm else out).astype(np.float32)


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("encoder") / "model")
    en.HashedTerms.fit(spark.createDataFrame(TEXTS, "id long, text string"), path)
    return path


def test_vectors_equal_a_plain_version(spark, model):
    rows = spark.createDataFrame(TEXTS + [(9, "never seen before"), (10, "")], "id long, text string").repartition(3)
    corpus = [t for _, t in TEXTS]
    got = en.embed(rows, en.HashedTerms(spark, model), F.col("text"), "embedding").collect()
    assert len(got) == 10
    for r in got:
        assert np.allclose(r["embedding"], plain_vector(r["text"], corpus), atol=1e-6), r["id"]
    assert [r["embedding"] for r in got if r["id"] == 4] == [[0.0] * en.DIMENSIONS]


def test_a_stored_model_gives_the_same_vectors_whatever_else_is_encoded(spark, model):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    first, again = en.HashedTerms(spark, model), en.HashedTerms(spark, model)
    alone = en.embed(rows.where("id = 1"), first, F.col("text"), "v").first()["v"]
    assert [r["v"] for r in en.embed(rows.coalesce(1), again, F.col("text"), "v").where("id = 1").collect()] == [alone]


def test_rows_keep_their_columns_and_order_of_names(spark, model):
    rows = spark.createDataFrame([(1, "java", [9.0], "x")], "embedding int, text string, profile_embedding array<float>, _row string")
    out = en.embed(rows, en.HashedTerms(spark, model), F.col("text"), "profile_embedding")
    assert out.columns == ["embedding", "text", "_row", "profile_embedding"]
    got = out.first()
    assert (got["embedding"], got["text"], got["_row"], len(got["profile_embedding"])) == (1, "java", "x", en.DIMENSIONS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_any_function_of_rows_is_an_encoder(spark):
    lengths = lambda rows: rows.withColumn("embedding", F.array(F.length("text").cast("float"))).drop("text")
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id long, words string")
    assert sorted(tuple(r) for r in en.embed(rows, lengths, F.col("words"), "v").collect()) == [(1, "abc", [3.0]), (2, None, [0.0])]


def test_empty_corpus_and_empty_rows(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    en.HashedTerms.fit(none, str(tmp_path / "m"))
    encoder = en.HashedTerms(spark, str(tmp_path / "m"))
    assert en.embed(none, encoder, F.col("text"), "v").collect() == []
    # without a corpus no term has weight
    one = spark.createDataFrame([(1, "java")], "id long, text string")
    assert en.embed(one, encoder, F.col("text"), "v").first()["v"] == [0.0] * en.DIMENSIONS


def test_words_are_made_and_counted_without_rows_per_word(spark, tmp_path, model):
    """6 GB of texts: no row or JVM expression per word, neither when fitting nor when encoding."""
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    plan = en.embed(rows, en.HashedTerms(spark, model), F.col("text"), "v")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "transform(" not in plan
    mapped, real = [], type(rows).mapInArrow
    type(rows).mapInArrow = lambda df, *a, **b: mapped.append(real(df, *a, **b)) or mapped[-1]
    try:
        en.HashedTerms.fit(rows.repartition(2).select("text"), str(tmp_path / "m"))
    finally:
        type(rows).mapInArrow = real
    counted = mapped[0].groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    want = Counter(b for _, t in TEXTS for b in set(plain_buckets(t)))
    assert {r["bucket"]: r["df"] for r in counted} == want
    assert mapped[0].count() <= 2 * len(want) < sum(len(plain_buckets(t)) for _, t in TEXTS)


def test_buckets_of_odd_texts():
    texts = [None, "", " .,; ", "²x_y z", "日本語 café", "a\nb\x00c", "café"]
    row, flat = en.buckets(en.pa.array(texts, en.pa.string()))
    assert [[int(b) for r, b in zip(row, flat) if r == i] for i in range(len(texts))] == [plain_buckets(t) for t in texts]
    assert [len(x) for x in en.buckets(en.pa.array([], en.pa.string()))] == [0, 0]
