"""A Merkle manifest of a dataset: a root digest, and for every row the siblings that prove it.

Each row is a leaf; per group (a language, say) the leaves in key order form a binary tree, and the roots of the groups,
in order of the group, form another on top. A tree is cut into bands of ``HEIGHT`` levels. The part of a band above an
aligned run of 2**HEIGHT leaves is a block, one row of a table; the roots of its blocks are the leaves of the next band,
so the manifest of any number of rows takes a handful of jobs, and no task holds more than a block at a time.

Inside a block the digests stand in van Emde Boas order: the tree is split at half its height, the upper half comes
first, then each of the lower trees, and so on inside each. ``place`` computes where a node is from its depth and index;
construction writes by it and a path of siblings reads by it, touching few cache lines or pages whatever their size.

Digests are SHA-256 as lower-case hex text. A node is the digest of its children's texts, one after the other; the last
node of a level may have a single child. A level with one node ends the tree.

Defined results: a null value counts as ``-``, unlike an empty one; a null key or group comes first; rows with equal
keys are ordered by their leaves; repeated rows are leaves of their own; columns other than the named ones are not read;
an empty table has no blocks, no root and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rolefit.operators.ranking import rank_rows
from rolefit.session import write_stage

#: Levels of a block above its leaves, and the leaves of a whole block.
HEIGHT = 10
FAN = 1 << HEIGHT
DIGEST = 32


def place(depth: int, index: np.ndarray, height: int) -> np.ndarray:
    """Where the nodes of a depth stand in the van Emde Boas order of a complete tree of ``height`` levels of edges."""
    at, levels, index = np.zeros_like(index), height + 1, index.copy()
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            depth, levels = depth - top, levels - top
            at += (1 << top) - 1 + (index >> depth) * ((1 << levels) - 1)
            index &= (1 << depth) - 1
    return at


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_block(leaves: list[str], height: int) -> tuple[str, bytes]:
    """Root of a block, and its digests in layout order; places without a node stay zero."""
    nodes = np.zeros(((1 << height + 1) - 1, DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        at = place(depth, np.arange(len(level)), height)
        nodes[at] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        if depth:
            level = [_digest("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], nodes.tobytes()


def leaves_of(nodes: bytes, n: int, height: int) -> list[str]:
    return _hex(np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST), place(height, np.arange(n), height))


def _hex(nodes: np.ndarray, at: np.ndarray) -> list[str]:
    text = nodes[at].tobytes().hex()
    return [text[i:i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)]


def siblings(nodes: bytes, n: int, height: int) -> list[list[str]]:
    """Of each leaf of a block its siblings from below: ``<digest`` to the left, ``>digest`` to the right, ``=`` none."""
    rows = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    paths, index, there = [[] for _ in range(n)], np.arange(n), n
    for depth in range(height, 0, -1):
        level = _hex(rows, place(depth, np.arange(there), height))
        marked = [f"{'<' if i % 2 == 0 else '>'}{x}" for i, x in enumerate(level)]
        for path, i in zip(paths, (index ^ 1).tolist()):
            path.append(marked[i] if i < there else "=")
        index, there = index >> 1, (there + 1) >> 1
    return paths


@dataclass
class Manifest:
    """Tables of blocks, lowest band first: of the rows' trees by group, and of the tree over the groups."""

    rows: list[DataFrame]
    groups: list[DataFrame]

    def roots(self) -> DataFrame:
        """grp, digest: the root of each group."""
        return _roots(self.rows)

    def root(self) -> DataFrame:
        """digest: the root of the dataset, in at most one row."""
        return _roots(self.groups).select("digest")


def _roots(bands: list[DataFrame]) -> DataFrame:
    found = [b.where(F.col("size") <= FAN).select("grp", "digest") for b in bands]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block_table(leaves: DataFrame) -> DataFrame:
    """One row per block of ``leaves`` (grp, pos, size, digest, member), its members in order."""
    grouped = leaves.groupBy("grp", F.shiftright("pos", HEIGHT).alias("block")).agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "digest", "member"))).alias("held"))
    flat = grouped.select("grp", "block", "size", F.col("held.digest").alias("leaves"), F.col("held.member").alias("members"))

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):  # a block's row is large enough for a batch of its own
                row = part.slice(i, 1)
                leaves, size = row.column(3)[0].as_py(), row.column(2)[0].as_py()
                height = HEIGHT if size > FAN else (size - 1).bit_length()
                digest, nodes = build_block(leaves, height)
                made = [pa.array([len(leaves)], pa.int32()), pa.array([height], pa.int32()), pa.array([digest]), pa.array([nodes], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row.columns[:3], row.column(4), *made],
                                                 names=["grp", "block", "size", "members", "n", "height", "digest", "nodes"])

    members = flat.schema["members"].dataType
    schema = flat.select("grp", "block", "size").schema.add("members", members)
    for name, kind in (("n", "integer"), ("height", "integer"), ("digest", "string"), ("nodes", "binary")):
        schema = schema.add(name, kind)
    return write_stage(flat.mapInArrow(build, schema), "manifest-blocks")


def build_bands(leaves: DataFrame) -> list[DataFrame]:
    """All bands over ``leaves`` (grp, pos from 0, size of the group, digest, member)."""
    bands = [_block_table(leaves)]
    most = bands[0].agg(F.max("size")).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        up = bands[-1].where(F.col("size") > FAN).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("size") / FAN).cast("long").alias("size"), "digest", F.lit(None).cast("int").alias("member"))
        bands.append(_block_table(up))
    return bands


def _placed(leaves: DataFrame, order: list[Column]) -> DataFrame:
    ranked = rank_rows(leaves, "grp", order, rank="place", size="size")
    return ranked.select("grp", (F.col("place") - 1).alias("pos"), "size", "digest", "member")


def group_key(column: Column) -> Column:
    """A text that sorts like the group's bytes, null first."""
    return F.coalesce(F.concat(F.lit("+"), column.cast("string")), F.lit(""))


def build_manifest(leaves: DataFrame) -> Manifest:
    """``leaves``: grp (see ``group_key``), key, digest, member (any value that the proofs shall carry)."""
    # equal rows are told apart by a number, so that a great many of them are spread as well
    leaves = write_stage(leaves.withColumn("turn", F.monotonically_increasing_id()), "manifest-leaves")
    rows = build_bands(_placed(leaves, [F.col("key").asc_nulls_first(), F.col("digest"), F.col("turn")]))
    tops = _roots(rows).select(F.lit("").alias("grp"), F.col("grp").alias("member"), "digest")
    return Manifest(rows, build_bands(_placed(tops, [F.col("member")])))


def _paths(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """member, digest, path, subroot, root of every leaf of the lowest band; ``above``: grp, path, root."""
    below = None
    for blocks in reversed(bands):
        tops = blocks.where(F.col("size") <= FAN).join(above, "grp").withColumn("subroot", F.col("digest"))
        if below is not None:
            inner = blocks.where(F.col("size") > FAN).join(below.drop("member", "digest"), ["grp", "block"])
            tops = tops.unionByName(inner)
        below = _leaf_paths(tops)
    return below


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("grp", "block", "n", "height", "nodes", "members", "path", "subroot", "root")
    member = rows.schema["members"].dataType.elementType

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(len(part)):
                row = part.slice(i, 1)
                grp, block, n, height, nodes = (row.column(c)[0].as_py() for c in range(5))
                subroot, root, path = row.column(7)[0].as_py(), row.column(8)[0].as_py(), row.column(6)[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * n), pa.array([block * FAN + k for k in range(n)], pa.int64()), row.column(5).flatten(),
                     pa.array(leaves_of(nodes, n, height)), pa.array([own + path for own in siblings(nodes, n, height)], pa.list_(pa.string())),
                     pa.array([subroot] * n), pa.array([root] * n)],
                    names=["grp", "block", "member", "digest", "path", "subroot", "root"])

    schema = rows.select("grp", "block").schema.add("member", member).add("digest", "string").add("path", ArrayType(StringType()))
    return rows.mapInArrow(emit, schema.add("subroot", "string").add("root", "string"))


def proofs(manifest: Manifest) -> DataFrame:
    """grp, member, digest (the leaf), path (siblings from the leaf to the root), subroot and root, a row per leaf."""
    start = manifest.groups[0].sparkSession.createDataFrame([("", [])], "grp string, path array<string>")
    whole = F.broadcast(start.crossJoin(manifest.root().select(F.col("digest").alias("root"))))  # one row by one row
    top = _paths(manifest.groups, whole).select(F.col("member").alias("grp"), "path", "root")
    return _paths(manifest.rows, top).select("grp", "member", "digest", "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    def step(known: Column, sibling: Column) -> Column:
        text = F.substr(sibling, F.lit(2))
        return F.sha2(F.when(sibling.startswith("<"), F.concat(text, known)).otherwise(F.concat(known, text)), 256)
    return F.aggregate(path, leaf, step)


def leaf_digest(*values: Column) -> Column:
    """Digest of the values, each as its UTF-8 size, a colon and its text, or ``-`` if it is null."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Per document its leaf, roots and proof, and whether the proof still holds after n_chars of some were changed."""
    def leaf(n_chars: Column) -> Column:
        return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        group_key(F.col("lang")).alias("grp"), F.col("doc_id").alias("key"), leaf(F.col("n_chars")).alias("digest"),
        F.struct("doc_id", F.when(changed, leaf(F.try_add(F.col("n_chars"), F.lit(1)))).alias("tampered")).alias("member"))
    found = proofs(build_manifest(leaves)).withColumn(
        "folded_root", fold(F.coalesce(F.col("member.tampered"), F.col("digest")), F.col("path")))
    return found.select(
        F.col("member.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.translate(F.array_join("path", ""), "<>=", ""), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels by recursion over lists; crc32 bit by bit with its fixed polynomial.
MANIFEST_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, row_number() OVER () AS row, n_chars,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS before,
        coalesce(strlen(text) || ':' || text, '-') AS after,
        list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k) & 1)::BIGINT))),
            lambda crc, bit: xor(xor(crc, bit) >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295) AS crc
    FROM documents),
leafs AS (SELECT *, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
    sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || after) AS other FROM d),
pos AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leafs),
lv AS (SELECT lang, 0 AS l, list(leaf ORDER BY i) AS nodes FROM pos GROUP BY lang
    UNION ALL SELECT lang, l + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))
    FROM lv WHERE len(nodes) > 1),
subs AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM lv WHERE len(nodes) = 1),
up AS (SELECT 0 AS l, list(subroot ORDER BY g) AS nodes FROM subs
    UNION ALL SELECT l + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))
    FROM up WHERE len(nodes) > 1),
way AS (SELECT p.row, 0 AS tree, l, i >> l AS k, nodes FROM pos p JOIN lv ON p.lang IS NOT DISTINCT FROM lv.lang WHERE len(nodes) > 1
    UNION ALL SELECT p.row, 1, l, g >> l, nodes FROM pos p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN up WHERE len(nodes) > 1),
path AS (SELECT row, list(k ORDER BY tree, l) AS ks, list(coalesce(nodes[xor(k, 1) + 1], '') ORDER BY tree, l) AS sibs FROM way GROUP BY row),
full_path AS (SELECT p.*, s.subroot, (SELECT nodes[1] FROM up WHERE len(nodes) = 1) AS root, coalesce(ks, []) AS ks, coalesce(sibs, []) AS sibs,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS probe
    FROM pos p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN path USING (row)),
folded AS (SELECT *, list_reduce(list_transform(range(len(ks)), lambda j: CASE WHEN ks[j + 1] % 2 = 0 THEN '>' ELSE '<' END || sibs[j + 1]),
    lambda acc, s: sha256(CASE WHEN s[1] = '>' THEN acc || s[2:] ELSE s[2:] || acc END), probe) AS folded_root FROM full_path)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(sibs, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
