"""Line deduplication over the whole corpus: the earliest of equal and of nearly equal lines stays.

A line counts as repeated if an earlier line, by (doc_id, place), equals it after runs of white space are made one
blank, or is within one edit of it (a character inserted, left out or replaced).
Earlier lines count whether or not they stay themselves, so the outcome does not depend on any order of work.

The edit bound is met by a deletion-neighbourhood join: a line emits the hash of itself and of every string that is it
less one character, with the place of that character. Lines with an equal variant and place differ by one replaced
character, and a line that is another's variant differs by one inserted; so the earliest of a key stands for all of
it, and no pairs of a key are made. Each line is then checked against the earliest it met by edit distance.
Before that, lines that can have no partner are left out exactly: with one edit either the first or the last half of
the shorter line is untouched, so a line whose halves (with the length) nobody shares has none.

All of it is DataFrame operations. Repeated keys are summed before they are shuffled; joins on line keys are plain
equi-joins that adaptive execution splits where a line is very common.

Defined results: blank lines are never removed and never compared; a null text has no lines and stays null; rows with
equal doc_id and text are one document and get the same verdict; nulls in doc_id come first; all other columns pass
through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import SPACE, WORD
from rolefit.llm.quality import let
from rolefit.session import spread, write_stage


def plain(line: Column) -> Column:
    """Runs of white space become one blank, none at the ends; single blanks, the common case, are not matched."""
    return F.trim(F.regexp_replace(line, rf"{SPACE}{{2,}}|[\x09-\x0D]", " "))


def half_keys(line: Column, length: Column) -> Column:
    """Keys of the untouched halves that a line shares with every line within one edit of it."""
    def halves(shorter: Column) -> list[Column]:
        front = F.floor(shorter / 2).cast("int")
        return [F.xxhash64(F.lit(0), shorter, F.left(line, front)), F.xxhash64(F.lit(1), shorter, F.right(line, shorter - front))]
    return F.array(*halves(length), *halves(length - 1))


def variants(line: Column, low: Column, high: Column) -> Column:
    """(place, hash) of the line itself (place -1) and of the line less the character at each place in a range."""
    return F.transform(F.array_insert(F.sequence(low, high), 1, F.lit(-1)), lambda i: F.struct(
        i.alias("place"),
        F.when(i < 0, F.xxhash64(line)).otherwise(F.xxhash64(F.concat(F.left(line, i), F.substr(line, i + 2)))).alias("variant")))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One narrow row per line that is not blank: where it is, its 128-bit key, its half keys."""
    rows = docs.select(F.col(key).alias("id"), *_row_key(key, text), F.col(text).alias("text"))
    lines = rows.select("id", "r1", "r2", F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    lines = lines.where(F.col("raw").rlike(WORD)).select("id", "r1", "r2", "place", plain(F.col("raw")).alias("line"))
    length = F.length("line")
    return lines.select(
        "id", "r1", "r2", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"),
        half_keys(F.col("line"), length).alias("halves"))


def _row_key(key: str, text: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(key), F.col(key).isNull(), F.col(text)).alias(f"r{seed}") for seed in (1, 2)]


def near_lines(lines: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(h1, h2) of the lines with an earlier line within one edit. ``lines``: h1, h2, first (id, r1, r2, place), halves."""
    halves = lines.select("h1", "h2", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    partners = halves.join(shared, "half", "left_semi").groupBy("h1", "h2").agg(
        F.max(F.col("side") % 2 == 0).alias("front"), F.max(F.col("side") % 2 == 1).alias("back"))
    where = lines.join(partners, ["h1", "h2"]).select("h1", "h2", "first", "front", "back")
    per_row = where.groupBy("first.r1", "first.r2").agg(F.collect_list(F.struct("h1", "h2", "first", "front", "back")).alias("wanted"))
    texts = docs.select(*_row_key(key, text), F.col(text).alias("text")).join(per_row, ["r1", "r2"])
    each = texts.select(F.split("text", "\n", -1).alias("all"), F.explode("wanted").alias("w"))
    found = write_stage(each.select("w.*", plain(F.get("all", F.col("w.first.place"))).alias("line")).dropDuplicates(["h1", "h2"]), "lines")

    # with a shared front the edit is in the second half, with a shared back in the first
    length = F.length("line")
    low = F.when(F.col("back"), 0).otherwise(F.floor((length - 1) / 2)).cast("int")
    high = F.when(F.col("front"), length - 1).otherwise(F.least(length - 1, F.floor(length / 2) + 1)).cast("int")
    emitted = spread(found.select("h1", "h2", "line", low.alias("low"), high.alias("high")), "h1", "h2").select(
        "h1", "h2", F.explode(variants(F.col("line"), F.col("low"), F.col("high"))).alias("v")).select("h1", "h2", "v.place", "v.variant")
    several = emitted.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("variant")
    met = write_stage(emitted.join(several, "variant", "left_semi"), "variants")
    met = met.join(found.select("h1", "h2", "first"), ["h1", "h2"]).select("variant", "place", F.struct("first", "h1", "h2").alias("who"))
    replaced = met.where("place >= 0").groupBy("variant", "place").agg(F.min("who").alias("least"), F.max("who").alias("last"))
    whole = met.where("place < 0").select("variant", F.col("who").alias("whole"))
    longer = replaced.groupBy("variant").agg(F.min("least").alias("longer"))
    same_place = met.join(replaced.where("least <> last"), ["variant", "place"]).select("who", F.col("least").alias("other"))
    one_less = met.where("place >= 0").join(whole, "variant").select("who", F.col("whole").alias("other"))
    one_more = whole.join(longer, "variant").select(F.col("whole").alias("who"), F.col("longer").alias("other"))
    pairs = same_place.unionByName(one_less).unionByName(one_more).where(F.col("other") < F.col("who")).distinct()
    named = found.select("h1", "h2", "line")
    a = named.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"))
    b = named.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"))
    checked = pairs.select(F.col("who.h1").alias("a1"), F.col("who.h2").alias("a2"), F.col("other.h1").alias("b1"), F.col("other.h2").alias("b2"))
    return (checked.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where(F.levenshtein("a", "b", 1) >= 0)
            .select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct())


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (struct of all columns, the text as it was) with ``kept`` (the text without repeated lines), ``n_lines``
    (lines that are not blank), ``n_equal`` and ``n_near`` (lines removed as equal to, or within one edit of, an earlier one).
    """
    lines = write_stage(line_table(docs, key, text), "line-table")
    where = F.struct("id", "r1", "r2", "place")
    known = write_stage(lines.groupBy("h1", "h2").agg(
        F.min(where).alias("first"), F.count(F.lit(1)).alias("n"), F.max("halves").alias("halves")), "line-first")
    near = near_lines(known, docs, key, text).withColumn("near", F.lit(True))
    touched = known.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 or near")
    gone = (
        lines.select("h1", "h2", "r1", "r2", "place", where.alias("here")).join(touched, ["h1", "h2"])
        .where(F.col("near").isNotNull() | (F.col("here") != F.col("first")))
        .groupBy("r1", "r2").agg(F.collect_set(F.struct("place", F.coalesce("near", F.lit(False)).alias("near"))).alias("gone"))
        .select("r1", "r2", F.col("gone.place").alias("gone"), F.size(F.filter("gone", lambda g: g["near"])).alias("n_near")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_row_key(key, text))
    joined = rows.join(gone, ["r1", "r2"], "left")
    every = F.split(F.col("doc")[text], "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("doc")[text]).otherwise(let(
        F.struct(every.alias("all"), left.alias("left")),
        lambda x: F.array_join(F.transform(x["left"], lambda i: F.get(x["all"], i)), "\n")))
    n_near = F.coalesce("n_near", F.lit(0)).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    filled = F.size(F.filter(F.coalesce(every, F.array().cast("array<string>")), lambda line: line.rlike(WORD)))
    return joined.select("doc", kept.alias("kept"), filled.cast("long").alias("n_lines"),
                         F.when(F.col("gone").isNull(), 0).otherwise(n_gone - n_near).cast("long").alias("n_equal"), n_near.alias("n_near"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document the numbers of lines and of removed lines, and the digest of the text that is left."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_equal", "n_near", F.sha2("kept", 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, place, lines[place] AS raw, trim(regexp_replace(lines[place], '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
d AS (SELECT line, min((doc_id, place)) AS first, length(line) AS n FROM l WHERE line <> '' GROUP BY line),
k AS (SELECT line, first, n, m, left(line, m // 2) AS front, right(line, m - m // 2) AS back
    FROM (SELECT *, unnest([n, n - 1]) AS m FROM d)),
p AS (SELECT a.line AS a, b.line AS b FROM k a JOIN k b ON a.m = b.m AND a.front = b.front AND b.first < a.first
    UNION SELECT a.line, b.line FROM k a JOIN k b ON a.m = b.m AND a.back = b.back AND b.first < a.first),
near AS (SELECT DISTINCT a AS line FROM p WHERE abs(length(a) - length(b)) <= 1 AND len(list_filter(range(0, length(a) + 1), lambda i:
    left(a, i) = left(b, i) AND (substr(a, i + 2) = substr(b, i + 2) OR substr(a, i + 1) = substr(b, i + 2) OR substr(a, i + 2) = substr(b, i + 1)))) > 0),
f AS (SELECT l.*, l.line <> '' AND near.line IS NOT NULL AS near, l.line <> '' AND near.line IS NULL AND d.first <> (l.doc_id, l.place) AS equal
    FROM l LEFT JOIN d USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE equal) AS n_equal,
    count(*) FILTER (WHERE near) AS n_near,
    sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT coalesce(near, false) AND NOT coalesce(equal, false)), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
