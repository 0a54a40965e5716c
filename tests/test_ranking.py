import random

from pyspark.sql import functions as F

from rolefit.operators.ranking import rank_rows


def test_rank_with_a_hot_group_and_hot_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([0.0, 0.0, 0.0, 1.5, 2.5]), i) for i in rng.sample(range(10**6), 5000)]
    rows.append((9, 1.0, -1))
    df = spark.createDataFrame(rows, "g int, s double, id long").repartition(7)
    got = {r["id"]: (r["rank_position"], r["group_size"]) for r in rank_rows(df, "g", [F.desc("s"), F.asc("id")]).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        for place, (_, _, i) in enumerate(ordered, start=1):
            assert got[i] == (place, len(ordered))


def test_ranking_uses_no_window_over_whole_groups(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id"))
    plan = rank_rows(df, "g", [F.asc("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate" in plan.split("Window")[-1]
