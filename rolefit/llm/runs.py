"""Periodic runs of words: every stretch of a text that repeats itself with some period and can't be made longer.

A run is a stretch of words with smallest period q (words q apart are equal), of at least ``max(least, 2 * q)`` words, that
no neighbouring word extends. Texts are searched batch by batch, each on its own, by longest common extensions (LCE): how far
two places of a text go on alike, forwards and backwards.

* Harmonic grid. Two places p apart agree over at least ``g = max(p, least - p)`` places in a run of period p, so one of
  them is a multiple of g: pairs (x, x + p) for these x alone are looked at, n/1 + n/2 + ... of them. Where the words
  of a pair are equal, its extension to both sides gives the run with that period.
* Difference cover. ``COVER`` holds residues modulo ``MOD`` such that any two places reach sampled places by one shift
  of less than ``MOD``. Only suffixes that begin at sampled places are sorted, by their first ``MOD`` words and then by
  doubling. An LCE compares words up to the shift; if all are equal, the rest is the least common prefix between
  the two samples in sorted order, read off a sparse table. Texts none of whose pairs get that far are not sorted.
* The same over the reversed words gives the extension backwards.

A run of period q shows up for multiples of q too, over the same stretch; the least period of a stretch is kept.

Words are compared by number, one number per different word of a batch. Everything is bounded by a batch or one text.

Defined results: a null or empty text has no words and no runs; each row gives one row and repeated rows repeat; all
columns pass through in ``doc``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import words_of

#: A perfect difference set (fixed values): every residue but 0 is the difference of exactly one pair.
MOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words compared before the shift to a sampled place is sought.
AHEAD = 8
#: Words of texts searched at once, pairs looked at once, and words up to which the pairs of a grid are kept.
BATCH_WORDS, PAIRS, KEPT_GRID = 400_000, 2_000_000, 1 << 13

_SLOT = np.full(MOD, -1)
_SLOT[list(COVER)] = range(len(COVER))
#: Least shift that brings places of two residues to sampled places.
SHIFT = np.array([[next(s for s in range(MOD) if _SLOT[(a + s) % MOD] >= 0 and _SLOT[(b + s) % MOD] >= 0) for b in range(MOD)]
                  for a in range(MOD)])


class Extensions:
    """LCE queries over one array of word numbers in which every text ends with a number of its own."""

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        self.ids, self.text = np.append(ids, np.arange(-1, -2 * MOD - 1, -1) + min(0, int(ids.min(initial=0)))), text
        self.sorted, self.known = None, np.zeros(0, np.int64)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of equal words from places ``a < b`` of one text."""
        ids = self.ids
        out = np.full(len(a), -1)
        limit = AHEAD + SHIFT[(a + AHEAD) % MOD, (b + AHEAD) % MOD]
        live = np.arange(len(a))
        for k in range(AHEAD + MOD):
            at, bt = a[live] + k, b[live] + k
            same = (ids[at] == ids[bt]) & (k < limit[live])
            ended = live[~same]
            out[ended] = np.where(k < limit[ended], k, -1)
            live = live[same]
            if not len(live):
                break
        deep = np.flatnonzero(out < 0)
        if len(deep):
            at, bt = a[deep] + limit[deep], b[deep] + limit[deep]
            out[deep] = limit[deep] + self.sampled(np.unique(self.text[at])).lcp(at, bt)
        return out

    def sampled(self, texts: np.ndarray) -> Samples:
        """The sorted samples of these texts, with their places in this array."""
        if self.sorted is None or not np.isin(texts, self.known).all():
            self.sorted, self.known = Samples(self.ids, self.text, texts), texts
        return self.sorted


class Samples:
    """Sorted suffixes at the cover's places of some texts, common prefixes of neighbours, and a sparse table over these."""

    def __init__(self, ids: np.ndarray, text: np.ndarray, texts: np.ndarray):
        wanted = np.zeros(int(text[-1]) + 1, bool)
        wanted[texts] = True
        place = np.flatnonzero(wanted[text])
        place = place[_SLOT[place % MOD] >= 0]
        self.index = np.full((len(ids) // MOD + 2) * len(COVER), -1, np.int32)
        self.index[place // MOD * len(COVER) + _SLOT[place % MOD]] = np.arange(len(place))
        n = len(place)
        _, small = np.unique(ids, return_inverse=True)
        bits = max(int(small.max()).bit_length(), 1)
        per = max(62 // bits, 1)
        columns = []
        for low in range(0, MOD, per):
            key = np.zeros(n, np.int64)
            for j in range(low, min(low + per, MOD)):
                key = key << bits | small[np.minimum(place + j, len(ids) - 1)]
            columns.append(key)
        order = np.lexsort((*columns[::-1], text[place]))
        new = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in (*columns, text[place])], axis=0)) if n else np.zeros(0, bool)
        ranks = [np.empty(n, np.int64)]
        ranks[0][order] = np.cumsum(new) - 1
        while n and int(ranks[-1].max()) < n - 1:  # twice the words a round, for suffixes still alike
            after = self._shifted(place, MOD << len(ranks) - 1)
            second = np.where(after >= 0, ranks[-1][after], -1)
            key = ranks[-1] * (n + 1) + second + 1
            _, rank = np.unique(key, return_inverse=True)
            ranks.append(rank.astype(np.int64))
        self.rank = ranks[-1]
        order = np.argsort(self.rank)
        left, right = order[:-1], order[1:]
        common = np.zeros(len(left), np.int64)
        whole = np.ones(len(left), bool)  # neighbours that are still at sampled places
        for k in range(len(ranks) - 1, -1, -1):
            a, b = self._shifted(place[left], common), self._shifted(place[right], common)
            both = whole & (a >= 0) & (b >= 0)
            same = both & (ranks[k][a] == ranks[k][b])
            common += np.where(same, MOD << k, 0)
        live = np.arange(len(left))
        for k in range(MOD):
            at, bt = place[left[live]] + common[live], place[right[live]] + common[live]
            live = live[(ids[np.minimum(at, len(ids) - 1)] == ids[np.minimum(bt, len(ids) - 1)]) & (text[np.minimum(at, len(text) - 1)] == text[place[left[live]]])]
            common[live] += 1
            if not len(live):
                break
        self.table = [common.astype(np.int32)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _shifted(self, place: np.ndarray, by) -> np.ndarray:
        """Numbers of the samples ``by`` places (a multiple of MOD) on; -1 where there is none."""
        at = (place + by) // MOD * len(COVER) + _SLOT[place % MOD]
        return np.where(at < len(self.index), self.index[np.minimum(at, len(self.index) - 1)], -1)

    def lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at sampled places."""
        a, b = self.rank[self._shifted(a, 0)], self.rank[self._shifted(b, 0)]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


_GRIDS: dict[int, tuple] = {}


def grid(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (x, x + p) below ``KEPT_GRID`` in order of the second, and how many have a second below each number."""
    if least not in _GRIDS:
        x, y = map(np.concatenate, zip(*grid_part(KEPT_GRID, 1, KEPT_GRID, least)))
        order = np.argsort(y, kind="stable")
        x, y = x[order].astype(np.int32), y[order].astype(np.int32)
        _GRIDS[least] = x, y, np.searchsorted(y, np.arange(KEPT_GRID + 1))
    return _GRIDS[least]


def grid_part(n: int, low: int, high: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the grid for a text of n words, for periods in a range, about ``PAIRS`` at a time."""
    p = np.arange(low, min(high, n))
    gap = np.maximum(p, least - p)
    each = (n - p - 1) // gap + 1
    total = np.cumsum(each)
    for b in range(int(total[-1] // PAIRS) + 1 if len(p) else 0):
        some = slice(*np.searchsorted(total, [b * PAIRS, (b + 1) * PAIRS]))
        count = each[some]
        x = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * np.repeat(gap[some], count)
        yield x, x + np.repeat(p[some], count)


def equal_pairs(ids: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of a text's grid whose words are equal."""
    n = len(ids)
    if n <= KEPT_GRID:
        x, y, upto = grid(least)
        x, y = x[:upto[n]], y[:upto[n]]
        at = np.flatnonzero(ids[x] == ids[y])
        if len(at):
            yield x[at].astype(np.int64), y[at].astype(np.int64)
        return
    for x, y in grid_part(n, 1, n // 2 + 1, least):
        at = np.flatnonzero(ids[x] == ids[y])
        if len(at):
            yield x[at], y[at]


def runs_of(texts: list[np.ndarray], least: int) -> list[np.ndarray]:
    """Runs (start, length, period) of each text of word numbers (from 0), by start and period."""
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size + 1) - size  # a number of its own before each text and after the last
    ids = np.empty(int(size.sum()) + len(texts) + 1, np.int64)
    ids[begin - 1] = -1 - np.arange(len(texts))
    ids[-1] = -1 - len(texts)
    before, after = np.append(size + 1, 1), np.append(1, size + 1)
    for at, t in zip(begin.tolist(), texts):
        ids[at:at + len(t)] = t
    forward = Extensions(ids, np.repeat(np.arange(len(texts) + 1), after))
    backward = Extensions(ids[::-1], np.repeat(np.arange(len(texts) + 1), before[::-1]))
    found = [np.zeros((0, 4), np.int64)]
    held, weight = [], 0

    def settle() -> None:
        of, x, y = map(np.concatenate, zip(*held))
        x, y = x + begin[of], y + begin[of]
        ahead = forward.lce(x, y)
        behind = backward.lce(len(ids) - y, len(ids) - x)
        period, length = y - x, y - x + ahead + behind
        good = length >= np.maximum(least, 2 * period)
        runs = np.stack([of, x - behind - begin[of], length, period], 1)[good]
        found.append(np.unique(runs, axis=0))

    for i, t in enumerate(texts):
        if size[i] < least:
            continue
        for x, y in equal_pairs(t, least):
            held.append((np.full(len(x), i), x, y))
            weight += len(x)
            if weight >= PAIRS // 4:
                settle()
                held, weight = [], 0
    if held:
        settle()
    runs = np.unique(np.concatenate(found), axis=0)  # by text, start, length, period
    first = np.append(True, np.any(runs[1:, :3] != runs[:-1, :3], axis=1))[:len(runs)]
    runs = runs[first]  # the least period of a stretch
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return [r[:, 1:] for r in np.split(runs, np.searchsorted(runs[:, 0], np.arange(1, len(texts))))]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``doc`` (struct of all columns), ``n_words``, ``runs`` (array of start, length, period in words, by start and
    period) and ``collapsed``: the words outside the repeats, that is without those after a run's first period.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            start, words, weight = 0, [], 0
            for value in part.column(1):
                words.append(value.as_py().encode().split())
                weight += len(words[-1])
                if weight >= BATCH_WORDS:
                    yield answer(part.column(0).slice(start, len(words)), words)
                    start, words, weight = start + len(words), [], 0
            if words:
                yield answer(part.column(0).slice(start, len(words)), words)

    def answer(doc: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        number = Numbers().__getitem__
        found = runs_of([np.fromiter(map(number, w), np.int64, len(w)) for w in words], least)
        left = []
        for w, runs in zip(words, found):
            if len(runs):
                gone = np.zeros(len(w) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            left.append(b" ".join(w).decode())
        flat = np.concatenate(found)
        runs = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
            pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([doc, pa.array([len(w) for w in words], pa.int64()), runs, pa.array(left, pa.string())],
                                          names=["doc", "n_words", "runs", "collapsed"])

    kind = docs.schema.simpleString()
    return rows.mapInArrow(search, f"doc {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words of every tenth document (by crc32 of its id) go round from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10).cast("long"), words_of(F.col("text"))

    def turned(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
        again = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), turned)[0]).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest, and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_runs(docs.select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select("doc.doc_id", "runs", "collapsed", best.alias("best"), line.alias("line")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.size")).alias("length"),
        F.col("best.period").alias("period"), F.expr("-1000 * best.size div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("line", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: All pairs of equal words of a document up to half its length apart; stretches of neighbouring pairs are runs.
RUNS_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k) & 1)::BIGINT))),
        lambda crc, bit: xor(xor(crc, bit) >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295)) AS h FROM documents),
s AS (SELECT doc_id, row, len(words) AS n, words, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a, h // 10 AS g FROM t),
w0 AS (SELECT row, n, words, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(0, n)) AS i FROM s),
w AS MATERIALIZED (SELECT row, n, i, words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM w0),
pair AS (SELECT x.row, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
isle AS (SELECT row, p, min(i) AS start, count(*) + p AS length FROM (
    SELECT row, p, i, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS k FROM pair) GROUP BY row, p, k),
run AS (SELECT row, start, length, min(p) AS period FROM isle WHERE length >= greatest(12, 2 * p) GROUP BY row, start, length),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM run),
left_over AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN gone USING (row, i) GROUP BY row),
per AS (SELECT row, count(*) AS n_runs, min({'size': -length, 'start': start, 'period': period}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS line FROM run GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, -best.size AS length, best.period AS period,
    -1000 * best.size // best.period AS exponent_milli, sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM s LEFT JOIN per USING (row) LEFT JOIN left_over USING (row)
"""
