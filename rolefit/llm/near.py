"""Near duplicates: all pairs of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Candidates come from a MinHash LSH forest. Each of ``TREES`` trees orders the texts by ``DEPTH`` min-hashes of its own;
texts that share a prefix of them meet. Prefixes start at full depth and are shortened level by level until a pair at the
threshold shares one in some tree with probability ``recall`` (see ``prefix_length``); pairs above it do so more surely.

Where texts meet, no pairs are made. A meeting is cut into blocks of bounded size; in a block every text is put under
a leader it nearly equals by its sketch, texts are linked to every leader that one of the leader's followers could
reach, and the leaders of different blocks are compared in a second step, in a grid of blocks (bounds by the triangle inequality of Jaccard
distance, less ``SLACK`` for the sketch). The linked texts form candidate groups in which every pair that met and can
reach the threshold lies.

Exact verification: all pairs of a candidate group are compared by whole shingle sets, in a grid of blocks of bounded
size, as products of incidence matrices; a cell gives each text its number of links and joins every linked text to the
smallest of all texts that the links of the cell connect it with. Groups of joined texts are the classes.

Texts with the same words are copies: they are one node with a weight, are not expanded, and do count as links.

Defined results: a text without words (null, empty, blank) has no links and is a class of its own; a text of one to four
words has one shingle, all its words; a class id is the smallest doc_id of the class, null only if none has an id; repeated rows are copies; other columns are not read. Texts are identified by 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rolefit.llm.graph import components
from rolefit.llm.shingles import MIX, mixed, shingle_hashes, text_bytes, text_keys, word_hashes
from rolefit.session import write_stage

TREES, DEPTH = 20, 6
#: Texts and bytes of shingles of one block, and texts of one block of a meeting.
BLOCK_TEXTS, BLOCK_BYTES, MEETING = 2048, 16 << 20, 512
#: A follower's sketch equals its leader's in this share of places at least; what a sketch may be off.
CLOSE, SLACK = 0.9, 0.13
STEP_BYTES = 4 << 20


def prefix_length(similarity: float, recall: float) -> int:
    """The longest prefix at which a pair of this similarity meets in some tree with the wanted probability."""
    for length in range(DEPTH, 1, -1):
        if 1 - (1 - similarity ** length) ** TREES >= recall:
            return length
    return 1


def sketches(words: np.ndarray, counts: np.ndarray, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows with words: keys of the prefixes in each tree, and one byte of each min-hash."""
    grams, runs = shingle_hashes(words, counts, size)
    some = runs > 0
    first = (np.cumsum(runs) - runs)[some]
    least = np.empty((int(some.sum()), TREES * DEPTH), np.uint64)
    for i in range(TREES * DEPTH):
        least[:, i] = np.minimum.reduceat(grams * (mixed(np.array([2 * i + 1], np.uint64)) | np.uint64(1)) ^ (grams >> np.uint64(29)), first)
    least = mixed(least)
    keys = np.zeros((len(least), TREES), np.uint64)
    for tree in range(TREES):
        for level in range(length):
            keys[:, tree] = mixed(keys[:, tree] * MIX[0] + least[:, tree * DEPTH + level] + np.uint64(tree + 1))
    return keys.view(np.int64), (least & np.uint64(255)).astype(np.uint8)


def _steps(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes in its last column."""
    sizes = np.diff(text_bytes(part.column(part.num_columns - 1))[1])
    bucket = np.cumsum(sizes) // STEP_BYTES
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        yield part.slice(int(at[0]), len(at))


def sketch_texts(docs: DataFrame, key: str, text: str, size: int, length: int) -> DataFrame:
    """id, node (key of the words; 0 without words), words, and for texts with words prefix keys and sketch."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    schema = rows.drop("text").schema.add("node", "long").add("words", "long").add("keys", ArrayType(LongType())).add("sketch", "binary")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in _steps(part):
                words, counts = word_hashes(*text_bytes(step.column(1)))
                keys, sketch = sketches(words, counts, size, length)
                some = np.flatnonzero(counts)
                all_keys: list = [None] * len(counts)
                all_sketches: list = [None] * len(counts)
                for i, k, s in zip(some, keys, sketch):
                    all_keys[i], all_sketches[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [step.column(0), pa.array(text_keys(words, counts).view(np.int64)), pa.array(counts),
                     pa.array(all_keys, pa.list_(pa.int64())), pa.array(all_sketches, pa.binary())],
                    names=["id", "node", "words", "keys", "sketch"])

    return rows.mapInArrow(run, schema)


def _leaders(sketch: np.ndarray, close: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaders among sketches, each followed by all within ``close``; and a label per sketch that is equal for those
    joined by links from a leader to all within ``reach``."""
    leaders, label = [], np.arange(len(sketch))
    free = np.ones(len(sketch), bool)
    while free.any():
        leader = int(np.argmax(free))
        same = (sketch == sketch[leader]).mean(1)
        free &= same < close
        free[leader] = False
        leaders.append(leader)
        joined = np.unique(label[same >= reach])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return np.array(leaders), label


def _meet(members: DataFrame, by: list[str], close: float, reach: float) -> DataFrame:
    """(key, a, b, leads): each text of a block of a meeting, the one it is joined with, and whether it is a leader."""
    def run(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        leaders, label = _leaders(sketch, close, reach)
        leads = np.zeros(len(node), bool)
        leads[leaders] = True
        some = leads | (label != np.arange(len(node)))
        return pa.table({"key": rows.column("key").filter(pa.array(some)), "a": node[some], "b": node[label[some]], "leads": leads[some]})

    return members.select(*by, "node", "sketch").groupBy(*by).applyInArrow(run, "key long, a long, b long, leads boolean")


def candidate_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links that put every two texts that meet, and may be similar, into one connected group."""
    apart = 1 - similarity
    near = 1 - CLOSE
    spread = nodes.select("node", F.explode("keys").alias("key"))
    crowds = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = write_stage(
        spread.join(crowds, "key").select("key", "m", "node")
        .join(nodes.select("node", "sketch"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / MEETING))), "meetings")
    inside = write_stage(_meet(members, ["key", "block"], CLOSE, 1 - apart - near - SLACK), "meeting-links")
    several = members.where(F.col("m") > MEETING).select("key").distinct()
    leaders = inside.where("leads").join(several, "key").select("key", F.col("a").alias("node"))
    sizes = leaders.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).cast("int").alias("blocks"))
    placed = leaders.join(sizes, "key").join(nodes.select("node", "sketch"), "node").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    across = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    linked = _meet(across, ["key", "i", "j"], 1.1, 1 - apart - 2 * near - SLACK)
    return inside.select("a", "b").unionByName(linked.select("a", "b")).where("a <> b").distinct()


def cell_links(own: list[np.ndarray], other: list[np.ndarray], weights: tuple[np.ndarray, np.ndarray], same: bool,
               percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of the texts of two blocks, and the matrix of links."""
    sizes = np.array([len(s) for s in own]), np.array([len(s) for s in other])
    flat = np.concatenate([*own, *([] if same else other)])
    vocabulary, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    shared[times == 1] = -1
    column = shared[code]
    row = np.concatenate([np.repeat(np.arange(len(own)), sizes[0]), *([] if same else [np.repeat(np.arange(len(other)), sizes[1])])])
    first = np.arange(len(row)) < sizes[0].sum()
    common = np.zeros((len(own), len(other)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column, first = row[order], column[order], first[order]
    width = 4096
    for low in range(0, int(shared.max(initial=-1)) + 1, width):
        at = slice(*np.searchsorted(column, [low, low + width]))
        r, c, f = row[at], column[at] - low, first[at]
        left = np.zeros((len(own), width), np.float32)
        left[r[f], c[f]] = 1
        if same:
            right = left
        else:
            right = np.zeros((len(other), width), np.float32)
            right[r[~f], c[~f]] = 1
        common += left @ right.T
    linked = common * (100 + percent) >= percent * (sizes[0][:, None] + sizes[1][None, :])
    if same:
        np.fill_diagonal(linked, False)
    return linked @ weights[1], linked.T @ weights[0], linked


def connected(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A label per row and per column of a matrix of links, equal for those that links connect, -1 without links.

    ``same``: rows and columns are the same texts. Every row and column is read once, however long the paths are.
    """
    rows = np.full(linked.shape[0], -1)
    columns = rows if same else np.full(linked.shape[1], -1)
    for start in np.flatnonzero(linked.any(1)):
        if rows[start] >= 0:
            continue
        fresh = np.array([start])
        rows[start] = start
        while len(fresh):
            reached = np.flatnonzero(linked[fresh].any(0) & (columns < 0))
            columns[reached] = start
            fresh = reached
            if not same:
                fresh = np.flatnonzero(linked[:, reached].any(1) & (rows < 0))
                rows[fresh] = start
    return rows, columns


def verified(groups: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, links, b): links of a node found in a cell of the grid, and the smallest node they connect it with there.

    ``groups``: text, node, copies, component, blocks (of the component), block (of this text).
    """
    rows = groups.select("component", "blocks", "block", "node", "copies", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in _steps(part):
                words, counts = word_hashes(*text_bytes(step.column(5)))
                right = text_keys(words, counts).view(np.int64) == step.column(3).to_numpy()
                grams, runs = shingle_hashes(words, counts, size)
                ends = np.cumsum(runs)
                sets = [np.unique(grams[e - n:e]).tobytes() if ok else b"" for e, n, ok in zip(ends, runs, right)]
                yield pa.RecordBatch.from_arrays(
                    [*step.columns[:5], pa.array(sets, pa.binary())], names=["component", "blocks", "block", "node", "copies", "grams"])

    sets = rows.mapInArrow(run, "component long, blocks int, block int, node long, copies long, grams binary").where(F.length("grams") > 0)
    cells = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "grams")

    def cell(table: pa.Table) -> pa.Table:
        node, place = np.unique(table.column("node").to_numpy(), return_index=True)  # a repeated row is there once
        table = table.take(pa.array(place))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(a) or not len(b):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        on_a, on_b, linked = cell_links([grams[x] for x in a], [grams[x] for x in b], (copies[a], copies[b]), i == j, percent)
        rows, columns = connected(linked, i == j)
        nodes, links, label = (node[a], on_a, rows) if i == j else map(np.concatenate, ((node[a], node[b]), (on_a, on_b), (rows, columns)))
        some = label >= 0
        nodes, links, label = nodes[some], links[some], label[some]
        least = np.full(len(a), np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        return pa.table({"node": nodes, "links": links.astype(np.int64), "b": least[label]})

    return cells.groupBy("component", "i", "j").applyInArrow(cell, "node long, links long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                    recall: float = 0.9995) -> DataFrame:
    """Per row: id, node (key of its words), class_id, n_links (other rows at or above the threshold), n_copies."""
    similarity = percent / 100
    rows = write_stage(sketch_texts(docs, key, text, size, prefix_length(similarity, recall)), "sketches")
    worded = rows.where("words > 0")
    nodes = write_stage(worded.groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words"),
        F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    found = components(candidate_links(nodes, similarity))
    measured = found.join(nodes.select("node", "id", "copies", "words"), "node")
    sizes = found.join(nodes.select("node", "words"), "node").groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("words") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    wanted = measured.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("text"))
    grouped = wanted.join(texts, F.col("id").eqNullSafe(F.col("__id")))
    checked = write_stage(verified(grouped, size, percent), "verified")
    degree = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("a"), "b"))
    named = classes.join(nodes.select("node", "id"), "node")
    names = named.groupBy("component").agg(F.min("id").alias("least"))
    by_node = classes.join(names, "component").select("node", F.col("least").alias("class_id"), F.lit(True).alias("joined"))
    result = nodes.select("node", "copies", F.col("id").alias("own")).join(degree, "node", "left").join(by_node, "node", "left").select(
        "node", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.when(F.col("joined"), F.col("class_id")).otherwise(F.col("own")).alias("class_id"), F.lit(True).alias("known"))
    return rows.select("id", "node").join(result, "node", "left").select(
        "id", "node", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"))


def classes(docs: DataFrame) -> DataFrame:
    """Per document its class and its numbers of links and copies."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT row, array_to_string(words[i:i + 4], ' ') AS g
    FROM (SELECT row, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT row, count(*) AS n FROM g GROUP BY row),
rare AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
h AS (SELECT g.* FROM g SEMI JOIN rare USING (g)),
common AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.row <> b.row GROUP BY a.row, b.row),
link AS (SELECT a, b FROM common JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE c * 180 >= 80 * (x.n + y.n)),
reach(row, other) AS (SELECT row, row FROM w UNION SELECT reach.row, link.b FROM reach JOIN link ON link.a = reach.other),
class AS (SELECT reach.row, min(w.doc_id) AS class_id FROM reach JOIN w ON w.row = reach.other GROUP BY reach.row)
SELECT w.doc_id, class_id, (SELECT count(*) FROM link WHERE link.a = w.row) AS n_links,
    CASE WHEN len(w.words) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w.words) END AS n_copies
FROM w JOIN class USING (row)
"""
