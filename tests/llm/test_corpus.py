"""Mixing, top-k, near duplicates and repeated passages against plain versions; then the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolefit.llm import near
from rolefit.llm.graph import components
from rolefit.llm.mixing import mix, mixture, shard_slots
from rolefit.llm.near import _leaders, classes, connected, near_duplicates, prefix_length
from rolefit.llm.repeats import anchor_runs, first_documents, remove_repeats, repeat_report
from rolefit.llm.topk import best_in_block, nearest, top_k, whole_components

DOCS = "doc_id long, text string, source string, doc string, id string, t string, rank string, node string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, *"abcdef") for i, t, s in rows], DOCS)


# mixing


def plain_targets(sizes):
    """Shares by weight; what is above three times a size is shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        shares = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if shares[s] >= 3 * sizes[s]}
        if not full:
            target.update(shares)
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            rest -= 3 * sizes[s]
        open_ -= full
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    sources = ["web"] * 30 + ["b", "c", None, "é", "zz"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choice(sources)) for i in range(300)]
    rows += [(None, None, "web"), (None, "a b", "web"), (950, "same row", "b"), (950, "same row", "b"), (900, "  ", "empty")]
    docs = table(spark, rows)
    got = mixture(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = plain_targets(sizes)
    by_id = {i: s for i, t, s in rows if i is not None}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        source = by_id.get(r["doc_id"], "web")
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], target[source], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(0 <= target[s] - taken[s] < 1.001 for s in sizes)
    again = mixture(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_shards(spark):
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 3}") for i in range(400)]
    placed = mix(table(spark, rows), words_per_shard=500).collect()
    shards = defaultdict(Counter)
    for r in placed:
        assert len({c["pass"] for c in r["copies"]}) == len(r["copies"])
        for c in r["copies"]:
            shards[c["shard"]][r["doc"]["source"]] += c["words"]
    assert len(shards) > 5 and len({len(s) for s in shards.values()}) <= 3
    assert mix(table(spark, rows).limit(0)).count() == 0


def test_splitting_tree_is_exact():
    counts = np.array([50, 0, 7, 130])
    whole = list(shard_slots(counts, 11, 3, range(0, 11)))
    assert sum(have for _, _, have in whole).tolist() == counts.tolist()
    assert all((first == sum((h for _, _, h in whole[:i]), np.zeros(4, int))).all() for i, (_, first, _) in enumerate(whole))
    part = list(shard_slots(counts, 11, 3, range(4, 6)))
    assert [(s, f.tolist(), h.tolist()) for s, f, h in part] == [(s, f.tolist(), h.tolist()) for s, f, h in whole[4:6]]
    assert max(h.sum() for _, _, h in whole) - min(h.sum() for _, _, h in whole) <= 1


# top-k


def plain_nearest(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.6]) for _ in range(40)]) for i in range(230)]
    rows += [(300, None), (350, [1.0, None] * 20), (400, [float("nan")] * 40), (450, [float("inf")] * 40), (None, [0.1] * 40)]
    rows += [(500, [0.5, 0.5]), (501, [0.1, 0.2]), (1000, []), (20, rows[20][1]), (100, rows[100][1])]
    emb = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, v string, score int")
    assert sorted(map(tuple, nearest(emb).collect())) == plain_nearest(rows)
    vectors = whole_components(emb)
    small = top_k(vectors.where("vec_id % 50 = 0").distinct(), vectors, query_block=2, candidate_block=50)
    assert sorted(map(tuple, small.collect())) == plain_nearest(rows)
    assert nearest(emb.limit(0)).count() == 0


def test_bounds_drop_candidates_and_keep_the_best():
    rng = np.random.default_rng(1)
    c = rng.integers(-30, 30, (20000, 48))
    c[:, :16] *= 8  # most of the mass is in the first dimensions
    q = c[:9] + 1
    got = best_in_block(q, np.arange(9), c, np.arange(20000), 5)
    scores = q @ c.T
    for i in range(9):
        want = sorted((-s, j) for j, s in enumerate(scores[i]) if j != i)[:5]
        assert [(-s, n) for n, s in zip(got[1][got[0] == i], got[2][got[0] == i])] == want


# near duplicates


def plain_near(rows):
    sets = []
    for _, text, _ in rows:
        words = (text or "").split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])] for i in range(n)]
    seen, out = set(), []
    for i in range(n):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += links[x]
        seen |= group
        least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        out += [(rows[x][0], least, len(links[x])) for x in group]
    return sorted(out, key=repr)


def near_rows(seed=8):
    rng = random.Random(seed)
    rows, i = [], 0
    for group in (1, 1, 2, 5, 40, 3, 2, 1):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([60, 120, 200]))]
        for _ in range(group):
            some = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                some[rng.randrange(len(some))] = f"x{rng.randint(0, 99)}"
            rows.append((i, rng.choice([" ", "\n", " \t"]).join(some), "s"))
            i += 1
    rows += [(500, None, "s"), (501, "", "s"), (502, " \n", "s"), (503, "one two", "s"), (504, "one  two", "s"), (505, "two one", "s")]
    return rows + [(0, rows[0][1], "s"), (None, rows[4][1], "s"), (506, "é " * 3000, "s")]


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_rows()
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in classes(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == plain_near(rows)
    assert near_duplicates(table(spark, rows).limit(0)).count() == 0


def chained_rows(seed=4):
    """Chains in which only neighbours are near, and pairs of clusters joined by a single bridge."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        texts += [words[at:at + 90] for at in range(0, 9 * rng.choice([4, 5, 8]), 9)]
    for _ in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(220)]
        for at in (0, 9):
            texts.append(words[at:at + 90])
            for _ in range(6):  # near their own end of the bridge, too far from the other
                texts.append(words[at:at + 85] + [f"x{rng.randint(0, 10**6)}" for _ in range(5)])
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, " ".join(texts[i]), "s") for i in order]


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_of_chains_and_bridged_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_TEXTS", block)
    rows = chained_rows()
    want = plain_near(rows)
    assert len({c for _, c, _ in want}) < len(rows) / 4
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in classes(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == want


def test_links_of_a_cell_connect_what_they_reach():
    rng = np.random.default_rng(6)
    for same in (True, False):
        for n in (1, 7, 40):
            linked = rng.random((n, n)) < 1.2 / n
            if same:
                linked = (linked | linked.T) & ~np.eye(n, dtype=bool)
            rows, columns = connected(linked, same)
            reach = np.eye(n if same else 2 * n, dtype=bool)
            reach |= linked if same else np.block([[np.zeros((n, n), bool), linked], [linked.T, np.zeros((n, n), bool)]])
            for _ in range(8):
                reach = reach @ reach
            label = rows if same else np.concatenate([rows, columns])
            has = linked.any(1) if same else np.concatenate([linked.any(1), linked.any(0)])
            assert ((label >= 0) == has).all()
            assert ((label[:, None] == label)[has][:, has] == reach[has][:, has]).all()


def test_leaders_reach_every_close_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 255, 120).astype(np.uint8)
    sketches = np.array([np.where(rng.random(120) < rng.random() * 0.15, rng.integers(0, 255, 120), base) for _ in range(200)]).astype(np.uint8)
    _, label = _leaders(sketches, 0.9, 0.7 - 0.13)
    same = (sketches[:, None, :] == sketches[None]).mean(2)
    assert all(label[i] == label[j] for i, j in np.argwhere(same >= 0.8)) and prefix_length(0.8, 0.9995) == 5


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 300)]
    pairs = chain + [(1000 + rng.randint(0, 60), 1000 + rng.randint(0, 60)) for _ in range(40)] + [(5000, 5001 + i) for i in range(200)] + [(9, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in [p for p in pairs if p[0] != p[1]]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for x in parent}


# repeated passages


def plain_repeats(rows, span=50):
    low = float("-inf")
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: low if r[0] is None else r[0]):
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            first.setdefault(b[p:p + span], low if i is None else i)
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - span + 1):
            if first[b[p:p + span]] < (low if i is None else i):
                gone[p:p + span] = [True] * span
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé \n") for _ in range(n)) for n in (49, 50, 51, 60, 90, 200)] + ["aaaa" * 30, "ab" * 60]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 5):len(p) - rng.randint(0, 5)] if rng.random() < 0.5 else p)
            parts.append("".join(rng.choice("cdü ") for _ in range(rng.randint(0, 60))))
        rows.append((i, "".join(parts), "s"))
    return rows + [(200, None, "s"), (201, "", "s"), (202, rows[7][1], "s"), (7, rows[7][1], "s"), (8, rows[9][1], "s"), (None, passages[4], "s")]


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_repeated_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr("rolefit.llm.repeats.CROWD", crowd)
    rows = repeat_rows(crowd)
    got = [tuple(r) for r in repeat_report(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == plain_repeats(rows)


def test_passages_of_one_document_and_empty_table(spark):
    passage = "a passage that comes twice in a single document only. "
    row = repeat_report(table(spark, [(1, passage * 3, "s")])).first()
    assert (row["n_removed"], row["n_spans"]) == (0, 0)
    assert remove_repeats(table(spark, [(1, "x", "s")]).limit(0)).count() == 0
    assert remove_repeats(table(spark, [(1, "short", "s"), (2, "short", "s")])).where("n_removed > 0").count() == 0


# pipeline


def test_stages_against_plain_versions(spark, tmp_path):
    from tests.llm.test_cleaning import plain_dedup

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_join", "source_mix", "byte_bpe"]
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        tables.append((docs, docs := spark.read.parquet(str(tmp_path / name))))
    columns = tables[0][0].columns
    assert all(after.columns == columns for _, after in tables[:-1])
    read = [({r["doc_id"]: r for r in before.collect()}, after.collect()) for before, after in tables]

    before, after = read[0]  # whatever has words in a known language stays
    assert {r["doc_id"] for r in after} == {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}

    before, after = read[1]
    want = {i: t for i, t, _, _ in plain_dedup([(i, r["text"]) for i, r in before.items()]) if t and t.strip(" \t\n\r\x0b\x0c")}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = read[2]
    want = {c for _, c, _ in plain_near([(i, r["text"], "") for i, r in before.items()])}
    assert sorted(r["doc_id"] for r in after) == sorted(want)

    before, after = read[3]
    size, taken = Counter(), Counter()
    for r in before.values():
        size[r["source"]] += len(r["text"].split())
    for r in after:
        taken[r["source"]] += len(r["text"].split())
        assert r["text"] == before[r["doc_id"]]["text"] or r["text"].split() == before[r["doc_id"]]["text"].split()[:len(r["text"].split())]
    target = plain_targets(size)
    assert all(0 <= target[s] - taken[s] < 1.001 for s in size)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3

    _, after = read[4]
    assert len(after) == len(read[3][1]) and all(r["round_trip"] and len(r["ids"]) == 4 * r["n_tokens"] for r in after)


STAGED = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, class_id string, doc string"


def staged(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "a", "b", "c", "d") for i, t, s in rows], STAGED)


def test_near_join_goes_by_row(spark):
    a, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, a, "x"), (5, a, "x"), (9, a + " word", "x"), (9, other, "x"), (None, other, "x"), (None, None, "x"), (None, None, "x"),
            (7, "", "x"), (7, "", "x"), (8, "", "y"), (11, "alone here", "x"), (11, "alone here", "x"), (-4, "below zero", "x"), (3, "below zero", "x")]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_join(spark, staged(spark, rows), "").collect()), key=repr)
    assert got == sorted([(5, a), (9, other), (None, None), (7, ""), (8, ""), (11, "alone here"), (-4, "below zero")], key=repr)


def test_stages_with_odd_rows_and_empty_tables(spark):
    rng = random.Random(12)
    words = "the of house water running through green fields every morning and then".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + f".\nline {i} of {i * 7}", rng.choice(["web", None, "b"])) for i in range(40)]
    rows += [(None, None, None), (None, "", "web"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (3, rows[8][1] + " more", "b"),
             (None, rows[9][1], "web"), (None, rows[9][1], "web"), (50, "² ½ 12", "b"), (51, "\n \n", "web")]
    for docs in (staged(spark, rows), staged(spark, rows[:0])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, "")
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), docs.schema)
        assert all(r["round_trip"] for r in corpus_pipeline.byte_bpe(spark, docs, "").collect())
    assert corpus_pipeline.language_id(spark, staged(spark, rows), "").where("text is null or doc_id in (50, 51)").count() == 0
