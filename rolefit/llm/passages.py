"""Removal of repeated passages, word by word: every word inside a window of ``span`` words that also starts in an earlier
document.

A window's minimiser is the least hash among its runs of ``GRAM`` words. Consecutive windows with one minimiser make a
super-k-mer, one string of words that holds them all; equal windows have equal minimisers, so they meet wherever
strings meet by minimiser, and a word is shipped once per string instead of once per window.

1. Each text lists its super-k-mers (minimiser, first window, number of windows; at most ``PIECE`` windows, cut at a
   fixed distance from the run's start). Minimisers of one text only can't repeat and go no further.
2. Texts with wanted super-k-mers emit them as packed strings (words joined by blanks). Strings are first brought down to
   one row each, with their least and greatest document, by partial aggregation, so copies meet as one row. If a
   minimiser has over ``CROWD`` different super-k-mers (at the edges of a passage that everybody quotes), their windows
   travel one by one, by a key of their own words, so no bucket grows with the crowd and nothing is left out.
3. In a bucket the windows of all strings are laid out as rows of word numbers and sorted, so equal windows stand
   together and each gets its least document. Words are compared as they are, not by hash.
4. Strings with a window that is in an earlier document come back as runs of windows; a join by string gives the
   ranges of words to remove.

Copies of a whole text are settled by the text's 128-bit key; only the one of least id is searched for. Documents are
ordered by doc_id, an integer; a null id comes first.

Defined results: a null text has no words; texts under ``span`` words lose nothing; documents with equal ids are not
earlier than each other; repeated rows get the same answer; what is kept is joined by single blanks; columns other than
the named ones are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rolefit.llm.common import forget
from rolefit.llm.shingles import BASE, INVERSE, mixed, powers, text_bytes, word_hashes
from rolefit.session import write_stage

#: Words of the runs whose hashes compete, and windows of one string at most.
GRAM, PIECE = 8, 48
#: Different super-k-mers of one minimiser above which its windows travel one by one, and strings meant for one bucket.
CROWD, BUCKET = 3_000, 20_000
#: Text handled at once, and windows sorted at once.
STEP_BYTES, SORTED = 4 << 20, 100_000
#: Bits of a position beside a hash when the least is sought.
PLACE = np.uint64(28)
LOWEST = -(1 << 63)


def steps(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of about ``STEP_BYTES`` of text."""
    bucket = np.cumsum(np.diff(text_bytes(part.column(column))[1])) // STEP_BYTES
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for low, high in zip(edges, edges[1:]):
        if high > low:
            yield part.slice(low, high - low)


def run_hashes(words: np.ndarray, first: np.ndarray, size) -> np.ndarray:
    """Hash of the ``size`` words from each place, of the words alone."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(BASE, len(words)))])
    return mixed((sums[first + size] - sums[first]) * powers(INVERSE, len(words) + 1)[first])


def super_kmers(words: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Minimiser, row, first window in the row, and windows of each super-k-mer. ``words``: hashes, ``counts`` by row."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(words) < span:
        return none
    gram = min(GRAM, span)
    key = run_hashes(words, np.arange(len(words) - gram + 1), gram)
    hashes = key >> PLACE << PLACE
    key = hashes | np.arange(len(key), dtype=np.uint64)
    width, wide = 1, span - gram + 1
    while width * 2 <= wide:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if wide > width:
        key = np.minimum(key[:width - wide], key[wide - width:])
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)[:len(key)]
    start = np.flatnonzero(np.arange(len(key)) + span <= ends[row])
    if not len(start):
        return none
    row, least = row[start], key[start] >> PLACE
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    since = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    first = np.flatnonzero(since % PIECE == 0)  # a long run of one minimiser in pieces
    count = np.diff(np.append(first, len(start)))
    return least[first].view(np.int64), row[first], start[first] - (ends - counts)[row[first]], count


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2")]


def listed(rows: DataFrame, span: int) -> DataFrame:
    """(r1, r2, doc, minimiser, sid, run) of all super-k-mers, a text once per step; run is first window * 64 + windows."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in steps(part, 3):
                r1, r2, doc = (step.column(c).to_numpy() for c in range(3))
                order = np.lexsort((doc, r2, r1))
                new = np.append(True, (r1[order][1:] != r1[order][:-1]) | (r2[order][1:] != r2[order][:-1]))
                once = np.sort(order[new])
                step = step.take(pa.array(once))
                words, counts = word_hashes(*text_bytes(step.column(3)))
                minimiser, row, first, count = super_kmers(words, counts, span)
                sid = string_ids(words, (np.cumsum(counts) - counts)[row] + first, count + span - 1)
                for low in range(0, len(row), 200_000):
                    some = slice(low, low + 200_000)
                    at = once[row[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r1[at], r2[at], doc[at], minimiser[some], sid[some], first[some] * 64 + count[some])],
                                                     names=["r1", "r2", "doc", "minimiser", "sid", "run"])

    return rows.select("r1", "r2", "doc", "text").mapInArrow(scan, "r1 long, r2 long, doc long, minimiser long, sid long, run long")


def string_ids(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(run_hashes(words, at, size) + size.astype(np.uint64)).view(np.int64)


def strings_in(step: pa.RecordBatch, span: int):
    """Of the wanted runs of a step (r1, r2, doc, runs, text): key, id, row, first window, windows, and the words' hashes."""
    words, counts = word_hashes(*text_bytes(step.column(4)))
    code = np.asarray(step.column(3).flatten(), np.int64)
    per_row = np.diff(np.asarray(step.column(3).offsets))
    row = np.repeat(np.arange(len(per_row)), per_row)
    crowded, first, windows = (code & 1).astype(bool), code >> 7, (code >> 1) & 63
    each = np.where(crowded, windows, 1)
    of = np.repeat(np.arange(len(code)), each)
    first = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    row, crowded, windows = row[of], crowded[of], np.where(crowded, 1, windows)[of]
    at = (np.cumsum(counts) - counts)[row] + first
    size = windows + span - 1
    return string_ids(words, at, size), row, first, windows, crowded, at, size, words


def with_minimiser(at: np.ndarray, words: np.ndarray, span: int) -> np.ndarray:
    """The minimiser of the window at each place."""
    gram = min(GRAM, span)
    reach = np.arange(span - gram + 1)
    out = np.empty(len(at), np.int64)
    grams = run_hashes(words, np.arange(max(len(words) - gram + 1, 0)), gram) >> PLACE
    for low in range(0, len(at), 20_000):
        out[low:low + 20_000] = grams[at[low:low + 20_000, None] + reach].min(1).view(np.int64)
    return out


def emitted(texts: DataFrame, span: int) -> DataFrame:
    """Key, id, text, document, first window and windows of every wanted string; its words for the first of equal ones of a step."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in steps(part, 4):
                sid, row, first, windows, crowded, at, size, words = strings_in(step, span)
                key = np.where(crowded, sid, with_minimiser(at, words, span))
                texts = [x.encode().split() for x in step.column(4).to_pylist()]
                where = np.cumsum([0, *map(len, texts)]).tolist()
                seen: set = set()
                r1, r2, doc = (step.column(c).to_numpy()[row] for c in range(3))
                for low in range(0, len(row), 20_000):
                    some = slice(low, low + 20_000)
                    strings = []
                    for k, s, r, a, n in zip(*(x[some].tolist() for x in (key, sid, row, at, size))):
                        new = (k, s) not in seen
                        seen.add((k, s))
                        a -= where[r]
                        strings.append(b" ".join(texts[r][a:a + n]) if new else None)
                    columns = [key[some], sid[some], r1[some], r2[some], doc[some], first[some], windows[some]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(strings, pa.binary())],
                                                     names=["key", "sid", "r1", "r2", "doc", "first", "windows", "words"])

    return texts.select("r1", "r2", "doc", "runs", "text").mapInArrow(
        scan, "key long, sid long, r1 long, r2 long, doc long, first long, windows long, words binary")


def sorted_windows(strings: list[bytes], low: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """Of each string, the least document of each of its windows; windows are sorted as rows of word numbers."""
    numbers: dict[bytes, int] = {}
    ids = [np.array([numbers.setdefault(w, len(numbers)) for w in s.split(b" ")], np.int32) for s in strings]
    rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, span) for x in ids])
    each = np.array([len(x) - span + 1 for x in ids])
    whole = np.ascontiguousarray(rows).view(f"V{4 * span}").ravel()
    order = np.argsort(whole, kind="stable")
    ranked = whole[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    of = np.repeat(low, each)
    least = np.minimum.reduceat(of[order], begin)
    found = np.empty(len(of), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(begin, len(of))))
    return iter(np.split(found, np.cumsum(each)[:-1]))


def repeated(strings: DataFrame, span: int) -> DataFrame:
    """(key, sid, runs): for strings of which some window is in an earlier document, runs of windows (first, stop) and
    the least document that has them. ``strings``: bucket, key, sid, low, high, words."""
    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        key, sid, low, high = (table.column(c).to_numpy() for c in ("key", "sid", "low", "high"))
        words, windows = table.column("words").to_pylist(), table.column("windows").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).tolist()
        weight = np.append(0, np.cumsum(windows))
        out: list[tuple] = []
        start = 0
        for here, nxt in zip(edges[1:], [*edges[2:], None]):  # whole keys, some at a time
            if nxt is not None and weight[nxt] - weight[start] <= SORTED:
                continue
            if here - start > 1:
                for i, found in zip(range(start, here), sorted_windows(words[start:here], low[start:here], span)):
                    if found.min() < high[i]:
                        edge = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                        stop = np.append(edge[1:], len(found))
                        out.append((key[i], sid[i], [{"first": a, "stop": b, "doc": d} for a, b, d in zip(edge.tolist(), stop.tolist(), found[edge].tolist())]))
            elif low[start] < high[start]:  # alone with its key, but in several documents
                out.append((key[start], sid[start], [{"first": 0, "stop": int(windows[start]), "doc": int(low[start])}]))
            start = here
        keys, sids, runs = zip(*out) if out else ((), (), ())
        return pa.table({"key": pa.array(keys, pa.int64()), "sid": pa.array(sids, pa.int64()), "runs": pa.array(
            runs, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("doc", pa.int64())])))})

    return strings.groupBy("bucket").applyInArrow(search, "key long, sid long, runs array<struct<first:long,stop:long,doc:long>>")


def removed_ranges(rows: DataFrame, span: int) -> DataFrame:
    """(r1, r2, doc, ranges): word ranges [from, to) to remove from the text of least id. ``rows``: r1, r2, doc, text."""
    spark = rows.sparkSession
    runs = write_stage(listed(rows, span), "super-kmers")
    # one document is the least of all texts that are equal, and copies say the same
    strings = runs.groupBy("minimiser", "sid").agg(
        F.min("r1").alias("a1"), F.max("r1").alias("b1"), F.min("r2").alias("a2"), F.max("r2").alias("b2"))
    minimisers = strings.groupBy("minimiser").agg(
        F.min("a1").alias("a1"), F.max("b1").alias("b1"), F.min("a2").alias("a2"), F.max("b2").alias("b2"), F.count(F.lit(1)).alias("n"))
    shared = minimisers.where("a1 <> b1 or a2 <> b2").select("minimiser", (F.col("n") > CROWD).cast("long").alias("crowd"))
    wanted = write_stage(runs.drop("sid").join(shared, "minimiser").groupBy("r1", "r2").agg(
        F.min("doc").alias("doc"), F.collect_set(F.col("run") * 2 + F.col("crowd")).alias("runs")), "wanted-super-kmers")
    forget(runs)
    size = wanted.agg(F.sum(F.size("runs"))).first()[0] or 0
    if not size:
        forget(wanted)
        return spark.createDataFrame([], "r1 long, r2 long, doc long, ranges array<struct<start:long,stop:long>>")
    buckets = max(-(-size // BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    strings = write_stage(emitted(rows.join(wanted, ["r1", "r2", "doc"]), span), "super-kmer-strings")
    forget(wanted)
    once = strings.groupBy("key", "sid").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("windows").alias("windows"), F.max("words").alias("words"))
    found = repeated(once.withColumn("bucket", F.pmod("key", F.lit(buckets))), span)
    hits = strings.drop("words", "windows").join(found, ["key", "sid"]).select(
        "r1", "r2", "doc", "first", F.explode("runs").alias("run")).where("run.doc < doc")
    ranges = hits.select("r1", "r2", "doc", F.struct(
        (F.col("first") + F.col("run.first")).alias("start"), (F.col("first") + F.col("run.stop") - 1 + span).alias("stop")).alias("range"))
    out = write_stage(ranges.groupBy("r1", "r2", "doc").agg(F.collect_set("range").alias("ranges")), "removed-words")
    forget(strings)
    return out


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50) -> DataFrame:
    """Per row: id, n_words, n_removed and ``kept``, the remaining words joined by single blanks."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} orders the documents and must be an integer column")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST)).alias("doc"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("*", *text_key(F.col("text")))
    ranges = removed_ranges(rows.where(F.octet_length("text") >= 2 * span - 1).select("r1", "r2", "doc", "text"), span)
    firsts = rows.groupBy("r1", "r2").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("n"))
    known = firsts.join(ranges.drop("doc"), ["r1", "r2"], "left").where("n > 1 or ranges is not null").select("r1", "r2", "lead", "ranges")
    joined = rows.join(known, ["r1", "r2"], "left").select("id", F.coalesce(F.col("doc") > F.col("lead"), F.lit(False)).alias("copy"), "ranges", "text")

    def one(copy: bool, ranges, text: str) -> tuple[int, int, bytes]:
        words = text.encode().split()
        if copy and len(words) >= span:
            return len(words), len(words), b""
        if copy or not ranges:
            return len(words), 0, b" ".join(words)
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, [r["start"] for r in ranges], 1)
        np.add.at(gone, [r["stop"] for r in ranges], -1)
        left = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
        return len(words), len(words) - len(left), b" ".join([words[i] for i in left])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in steps(part, 3):
                made = [one(*x) for x in zip(*(step.column(c).to_pylist() for c in (1, 2, 3)))]
                n, lost, kept = zip(*made)
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())],
                                                 names=["id", "n_words", "n_removed", "kept"])

    schema = joined.select("id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")
    return joined.mapInArrow(cut, schema)


def passage_report(docs: DataFrame) -> DataFrame:
    """Per document the words removed, and the digest of what is left."""
    return remove_passages(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


PASSAGES_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, row, i, array_to_string(words[i:i + 49], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM t)),
first AS (SELECT win, min(doc_id) AS least, bool_or(doc_id IS NULL) AS nulls FROM w GROUP BY win),
hit AS (SELECT row, i FROM w JOIN first USING (win) WHERE least < doc_id OR (nulls AND doc_id IS NOT NULL)),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 50)) AS i FROM hit),
per AS (SELECT row, count(*) AS n FROM gone GROUP BY row),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept
    FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t) ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN per USING (row) LEFT JOIN left_over USING (row)
"""
