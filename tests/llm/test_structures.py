"""Periodic runs, the Merkle manifest and passages by super-k-mers against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefit.llm import merkle, passages, runs
from rolefit.llm.merkle import build_block, leaf_digest, manifest_report, place, siblings
from rolefit.llm.passages import passage_report, remove_passages, super_kmers
from rolefit.llm.runs import COVER, MOD, SHIFT, periodic_runs, run_report, runs_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, words string, runs string, grp string, key string, low string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, s, n, "a", "b", "c", "d", "e", "f") for i, t, g, s, n in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i - start + p >= max(least, 2 * p):
                found.setdefault((start, i - start + p), p)
            i += i == start
    return sorted((s, p, n) for (s, n), p in found.items())


def test_cover_meets_every_pair_of_residues():
    assert sorted((a - b) % MOD for a in COVER for b in COVER if a != b) == list(range(1, MOD))
    assert SHIFT.max() < MOD
    assert all((a + SHIFT[a, b]) % MOD in COVER and (b + SHIFT[a, b]) % MOD in COVER for a in range(MOD) for b in range(MOD))


def test_runs_of_many_texts():
    rng = random.Random(1)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.choice([0, 1, 12, 13, 40, 100, 300]), rng.choice([1, 2, 3, 10])
            text = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < .6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 9)
                text = text[:a] + [text[a + (i - a) % p] for i in range(a, n)]
            texts.append(text)
        for text, got in zip(texts, runs_of([np.array(t, np.int64) for t in texts], 12)):
            assert [(s, p, n) for s, n, p in got.tolist()] == plain_runs(text)


def test_runs_of_long_texts(monkeypatch):
    assert runs_of([np.zeros(20_000, np.int64)], 12)[0].tolist() == [[0, 20_000, 1]]
    rng = np.random.default_rng(2)
    text = np.concatenate([rng.integers(0, 50, 9_000), np.tile(rng.integers(0, 50, 1_500), 3), rng.integers(0, 50, 700)])
    whole = runs_of([text], 12)[0].tolist()
    assert any(p == 1_500 and n >= 4_500 for _, n, p in whole)
    monkeypatch.setattr(runs, "PAIRS", 20_000)
    assert runs_of([text], 12)[0].tolist() == whole
    monkeypatch.setattr(runs, "KEPT_GRID", 1 << 15)
    monkeypatch.setattr(runs, "_GRIDS", {})
    assert runs_of([text], 12)[0].tolist() == whole


def test_sorted_samples_answer_deep_queries():
    rng = np.random.default_rng(3)
    part = rng.integers(0, 4, 200)
    ids = np.concatenate([part, part[:150], part, [-1]])
    made = runs.Extensions(ids, np.zeros(len(ids), np.int64))
    a = np.append(rng.integers(0, 199, 400), np.arange(100))
    b = np.append(rng.integers(200, len(ids) - 1, 400), np.repeat([200, 350], 50) + np.arange(100))
    want = [next(k for k in range(len(ids)) if ids[x + k] != ids[y + k]) for x, y in zip(a, b)]
    assert made.lce(a, b).tolist() == want and made.sorted is not None and max(want) > 100


def planted(i, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_run_report(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij k l".split()) for _ in range(rng.choice([0, 3, 20, 60, 150])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "x " * 13), (503, "x " * 13), (None, "a b " * 8), (504, "é è " * 12), (505, "y\n" * 11)]
    got = sorted(map(tuple, run_report(table(spark, [(i, t, "x", "y", 1) for i, t in rows])).collect()), key=repr)
    want = []
    for i, text in rows:
        words = planted(i, text)
        found = plain_runs(words)
        gone = {k for s, p, n in found for k in range(s + p, s + n)}
        best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
        four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((i, len(found), *four, sha("".join(f"{s},{n},{p}\n" for s, p, n in found)),
                     sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want, key=repr)
    kept = periodic_runs(table(spark, [(7, "p q " * 9, None, None, None)])).first()
    assert kept["collapsed"] == "p q" and [tuple(r) for r in kept["runs"]] == [(0, 18, 2)] and kept["doc"]["runs"] == "c"
    assert run_report(table(spark, rows[:0])).count() == 0


# Merkle manifest


def test_layout_is_recursive_and_complete():
    def slow(levels):  # nodes (depth, index) in van Emde Boas order
        if levels == 1:
            return [(0, 0)]
        top = levels // 2
        lower = slow(levels - top)
        return slow(top) + [(top + d, (k << d) + i) for k in range(1 << top) for d, i in lower]

    for height in range(8):
        order = slow(height + 1)
        for depth in range(height + 1):
            at = place(depth, np.arange(1 << depth), height)
            assert [order[x] for x in at] == [(depth, i) for i in range(1 << depth)]


def test_block_of_any_size():
    for n in (1, 2, 3, 5, 8):
        leaves = [sha(str(i)) for i in range(n)]
        root, nodes = build_block(leaves, 3)
        for leaf, path in zip(leaves, siblings(nodes, n, 3)):
            for sibling in path:
                leaf = sha(sibling[1:] + leaf if sibling[0] == "<" else leaf + sibling[1:])
            assert leaf == root and len(path) == 3


def plain_manifest(rows):
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(i, t, g, s, n):
        return sha("".join(map(part, (i, s, g, n, t))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def way(tree, i):
        return [("" if (i >> d) ^ 1 >= len(level) else level[(i >> d) ^ 1], (i >> d) & 1) for d, level in enumerate(tree[:-1])]

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: levels([leaf(*r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (doc, t, lang, s, n) in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, k)
            tampered = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
            known = leaf(doc, t, lang, s, n + 1) if tampered else leaf(doc, t, lang, s, n)
            for sibling, right in path:
                known = sha(sibling + known if right else known + sibling)
            out.append((doc, leaf(doc, t, lang, s, n), trees[g][-1][0], top[-1][0], sha("".join(x for x, _ in path)), known, known == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_over_several_bands(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "FAN", 4)
    rng = random.Random(8)
    rows = [(i, f"text é {i}", rng.choice(["en"] * 9 + ["", "de", "ü", "zz", None]), rng.choice(["a", None, ""]), rng.choice([1, None])) for i in range(150)]
    rows += [(None, None, "en", None, None), (None, "", "en", None, 0), (3, "same id", "en", "a", 2)] + [(900, "again", "en", "a", 5)] * 7
    rows += [(1000 + k, "t", f"group {k}", "s", 3) for k in range(9)]
    got = sorted(map(tuple, manifest_report(table(spark, rows)).collect()), key=repr)
    assert got == plain_manifest(rows) and {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    one = [(4, "alone", "en", "a", 1)]
    assert sorted(map(tuple, manifest_report(table(spark, one)).collect())) == plain_manifest(one)
    assert manifest_report(table(spark, [])).count() == 0
    digest = spark.range(1).select(leaf_digest(F.lit("é"), F.lit(None).cast("string"), F.lit("")).alias("x")).first()["x"]
    assert digest == sha("2:é-0:")


# passages by words


def plain_passages(rows, span):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - span + 1):
            window = tuple(w[k:k + span])
            first[window] = min(first.get(window, (i is not None, i)), (i is not None, i), key=lambda x: (x[0], x[1] or 0))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - span + 1) if first[tuple(w[k:k + span])] != (i is not None, i) for j in range(k, k + span)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passage_rows():
    rng = random.Random(9)
    quote = [f"q{k}" for k in range(70)]
    rows = []
    for i in range(120):
        words = [rng.choice(["a", "bb", "é", "d4", "e,"]) + str(rng.randrange(40)) for _ in range(rng.choice([0, 10, 60, 200]))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words = words[:at] + quote + words[at:]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(200 + k, rows[3 * k + 3][1]) for k in range(9)] + [(6, rows[6][1]), (6, " ".join(quote[:55])), (None, " ".join(quote[5:60])), (None, None)]
    rows += [(300, "same " * 400), (301, "same " * 49), (302, "same\n" * 50), (303, "x y " * 60), (304, "y x " * 60), (305, ""), (306, " \n ")]
    return rows


@pytest.mark.parametrize("crowd", [3_000, 2])
def test_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(passages, "CROWD", crowd)
    monkeypatch.setattr(passages, "STEP_BYTES", 3_000)
    monkeypatch.setattr(passages, "SORTED", 500)
    rows = passage_rows()
    docs = table(spark, [(i, t, "l", "s", 1) for i, t in rows])
    got = sorted(map(tuple, passage_report(docs).collect()), key=repr)
    assert got == plain_passages(rows, 50)
    few = remove_passages(docs, span=5).select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, few), key=repr) == plain_passages(rows, 5)


def test_passages_defined_cases(spark):
    assert passage_report(table(spark, [])).count() == 0
    assert [r["n_removed"] for r in passage_report(table(spark, [(1, "a b", "", "", 1), (2, "a b", "", "", 1)])).collect()] == [0, 0]
    with pytest.raises(TypeError):
        remove_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_super_kmers_cover_every_window_once():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 30, 900).astype(np.uint64)
    words[300:600] = 7
    counts = np.array([0, 49, 50, 301, 500])
    minimiser, row, first, count = super_kmers(words, counts, 50)
    windows = sorted((r, w) for r, f, c in zip(row, first, count) for w in range(f, f + c))
    assert windows == [(r, w) for r, n in enumerate(counts) for w in range(n - 49)]
    assert count.max() <= passages.PIECE and len(minimiser) < len(windows) / 4
