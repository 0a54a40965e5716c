"""Steps that must not grow faster than their tables."""

import glob

from pyspark.sql import functions as F

from rolefit.functions import names as nm, vectors
from rolefit.operators import linkage, ranking, reports, rollups
from rolefit.operators.canonical import match_graph
from rolefit.operators.ranking import rank_rows
from rolefit.plans.screen import scored_pairs
from rolefit.session import passing_stages, shared_dir, write_stage

SCHEMA = "id long, name string, email string, phone string"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(spark, n, start=0):
    """Keys whose files are far smaller than their rows: every value comes many times."""
    rows = spark.range(start, start + n).select(
        "id", F.concat(F.lit("person "), (F.col("id") % 7).cast("string")).alias("name"),
        F.concat((F.col("id") % 11).cast("string"), F.lit("@x.org")).alias("email"), F.lit(None).cast("string").alias("phone"))
    return linkage.linkage_keys(rows)


def test_tables_that_grow_are_not_broadcast_for_their_small_files(spark):
    batch, stored = keyed(spark, 3000, 10_000), keyed(spark, 3000)
    assert "BroadcastHashJoin" not in executed(linkage.key_matches(batch, stored, "email_key"))
    met = linkage.spelling_pairs(linkage.distinct_names(batch), linkage.distinct_names(stored), 85)
    assert "BroadcastHashJoin [key" not in executed(met)
    links, hubs = match_graph(batch, 85)
    written = linkage.by_shuffle(write_stage(links, "links")).join(linkage.by_shuffle(write_stage(hubs, "hubs")), "node")
    assert "BroadcastHashJoin" not in executed(written)


def test_names_are_compared_only_with_enough_grams_in_common(spark):
    left = spark.createDataFrame([(1, "zqka banderol", None, None)], SCHEMA)
    right = spark.createDataFrame([(2, "zqkb horstimu", None, None), (3, "zqka bamderol", None, None)], SCHEMA)
    names = [linkage.distinct_names(linkage.linkage_keys(x)) for x in (left, right)]
    everyone = linkage.with_grams(names[0], 85).unionByName(linkage.with_grams(names[1], 85))
    counts = linkage.item_counts(everyone)
    ours, theirs = (linkage.gram_keys(linkage.rare_first(linkage.with_grams(n, 85), counts), 85) for n in names)
    assert ours.join(theirs.withColumnsRenamed({c: f"_{c}" for c in theirs.columns if c != "key"}), "key").count() >= 1
    assert {r["b"] for r in linkage._meet(ours, theirs, 85, False).collect()} == {"bamderol zqka"}


def test_marks_never_hide_a_shared_gram(spark):
    rows = spark.createDataFrame([(["ab1", "bc1", "cd1"], ["bc1", "xy1"]), ([], ["a1"]), (["q1"], ["q1"])], "a array<string>, b array<string>")
    rows = rows.withColumn("ma", nm.marks(F.col("a"))).withColumn("mb", nm.marks(F.col("b")))
    most = F.size("a") - F.bit_count(F.col("ma").bitwiseAND(F.bitwise_not(F.col("mb"))))
    assert rows.where(most < F.size(F.array_intersect("a", "b"))).count() == 0


def test_bitmaps_are_made_after_rows_have_gone_to_their_block(spark):
    rows = spark.range(0, 200_000, 7).select(F.col("id").alias("candidate_id"), F.date_add(F.lit("2024-01-02"), (F.col("id") % 2).cast("int")).alias("day"))
    plan = executed(rollups.screened_bits(rows)).split("== Initial Plan ==")[0]
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    found = rollups.screened_bits(rows.unionByName(rows)).agg(F.sum(F.bitmap_count("bits"))).first()[0]
    assert found == rows.count()


def test_pairs_are_folded_after_they_are_dealt(spark):
    rows = spark.range(500).select(
        (F.col("id") % 3).alias("job_description_id"), F.when(F.col("id") % 50 != 0, F.col("id") % 100).alias("candidate_id"),
        F.lit(1.25).alias("final_score"), F.lit(True).alias("in_longlist"), F.lit(None).cast("boolean").alias("in_shortlist"), F.lit("hired").alias("status"))
    folded = reports.distinct_pairs_first(rows, "job_description_id")
    plan = executed(folded).split("== Initial Plan ==")[0]
    assert plan.count("Exchange hash") == 1 and "REPARTITION_BY_NUM" in plan
    assert folded.count() == rows.select("job_description_id", "candidate_id").distinct().count()
    assert folded.agg(F.sum("n"), F.sum("cents"), F.sum("hired"), F.sum("shortlisted")).first()[:] == (500, 62_500, 500, 0)


def test_ranked_rows_are_not_shuffled_for_their_offsets(spark, monkeypatch):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.col("id"))
    want = {(r["g"], r["id"], r["rank_position"]) for r in rank_rows(rows, "g", [F.desc("id")]).collect()}
    assert "BroadcastHashJoin" in rank_rows(rows, "g", [F.desc("id")])._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(ranking, "FEW_RUNS", 0)
    monkeypatch.setattr(ranking, "TASK_ROWS", 700)
    assert {(r["g"], r["id"], r["rank_position"]) for r in rank_rows(rows, "g", [F.desc("id")]).collect()} == want


def test_vacancies_meet_scores_and_terms_without_a_shuffle_of_pairs(spark, monkeypatch):
    people = spark.range(40).select("id", F.concat_ws(" ", F.lit("ab"), F.col("id") % 5, F.col("id") % 7).alias("text"))
    jobs = spark.range(6).select("id", F.concat_ws(" ", F.col("id") % 5, F.lit("cd")).alias("text"))
    want = {r[:] for r in vectors.tfidf_cosines(people, jobs).collect()}
    monkeypatch.setattr(vectors, "FEW_TERMS", 0)
    assert want and {r[:] for r in vectors.tfidf_cosines(people, jobs).collect()} == want
    candidates = people.select("id", F.lit(False).alias("is_duplicate"), F.col("text").alias("text_content"), F.lit("a").alias("skills"),
                               F.lit(3).alias("experience_years"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("profile_embedding"))
    jds = jobs.unionByName(jobs.where("id = 2")).select(
        "id", F.col("text").alias("description"), F.lit("a, b").alias("required_skills"), F.lit(1).alias("required_experience_min"),
        F.lit(9).alias("required_experience_max"), F.lit("{}").alias("matching_config"), F.array(F.lit(1.0), F.lit(0.5)).alias("jd_embedding"))
    pairs = scored_pairs(candidates, jds)
    joins = [x for x in pairs._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]
    assert any("BroadcastHashJoin" in x for x in joins) and all("LeftSemi" in x for x in joins if "SortMergeJoin" in x)  # of vacancies alone
    assert pairs.count() == 40 * (5 + 4)  # a vacancy that comes twice is joined with both of its rows, as before


def test_weighted_terms_are_shuffled_once_for_norms_and_products(spark):
    people = spark.range(60).select("id", F.concat_ws(" ", F.lit("ab"), F.col("id") % 5, F.col("id") % 7).alias("text"))
    jobs = spark.range(6).select("id", F.concat_ws(" ", F.col("id") % 5, F.lit("cd")).alias("text"))
    plan = executed(vectors.tfidf_cosines(people, jobs)).split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_NUM") == 2  # the exchange and its second use


def test_tables_on_the_way_do_not_stay(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/*"))
    with passing_stages(spark):
        ranked = rank_rows(spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id")), "g", [F.desc("id")])
        stored = write_stage(ranked, "kept", keep=True)
    assert [x.rsplit("/", 1)[1].split("-")[0] for x in set(glob.glob(f"{shared_dir(spark)}/*")) - before] == ["kept"]
    assert stored.agg(F.sum("rank_position")).first()[0] == 3 * 5050
    ranked = rank_rows(spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id")), "g", [F.desc("id")])
    assert not glob.glob(f"{shared_dir(spark)}/unranked-*") and ranked.count() == 300
