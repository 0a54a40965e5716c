"""Token ids in compact binary files, in document order.

A shard is one file. Ids are cut into blocks of ``BLOCK``; a block is transposed into byte planes (all lowest bytes, then
all second bytes, and so on; the high planes of small ids are zero and cost nothing) and each plane is compressed with
zstandard. Behind the blocks stand an index (of each block its place, number of ids and sizes of its planes) and the
document table (ids of documents and their numbers of tokens), then their sizes and a closing mark:

    plane plane ... | index | documents | size of index, size of documents (8 bytes each) | mark

Documents are range-partitioned by id, so a shard is a stretch of the order. A task writes its file under a name of its
own and returns one row about it; the rows that Spark commits are the manifest, so files of lost or repeated attempts
are never read. A shard is read back block by block, without any other shard.

Defined results: the string of an added token in a text is that token, as the library reads it; a null text has no ids but the end id; documents come in ascending doc_id order, nulls first, equal
ids by a digest of the text; repeated rows are written each time; an empty table gives an empty manifest; an id above
2**32 - 1 is refused.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm.bpe import LATIN, LONGEST_KEPT, Kept, chunks, cuts
from rolefit.llm.common import kept_in_worker
from rolefit.session import new_path, write_stage

BLOCK = 1 << 16
MARK = b"PLANES01"
LEVEL = 3
#: Chunks whose ids a worker keeps.
KEPT = 1_200_000
#: Bytes of text that are encoded together.
SLICE = 16 << 20
#: Bytes to a run of white space, below which a text is encoded by itself.
RUNS_APART = 100
#: Characters below this are of one kind by any version of the character tables.
LETTERS_END = "\u0250"
#: The splitting pattern of byte-level pre-tokenizers, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Byte-level vocabularies name printable bytes by themselves and the others by the letters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_NAMES = [chr(b) if b in _PRINTABLE else chr(256 + _OTHERS.index(b)) for b in range(256)]
BLANK = BYTE_NAMES[32]
_BLANK_WORD = re.compile(f" [{LATIN}]+").fullmatch
_WORD_END = re.compile(f" *[{LATIN}]*").fullmatch
#: New words that one call of the model takes.
JOINT = 50


def encoder(path: str) -> Chunks:
    """Ids of chunks by the tokenizers library; one per Python worker."""
    return kept_in_worker(("ids", path), lambda: _encoder(path))


class Chunks(Kept):
    """Ids by chunk. ``look_up`` has those of many at once and gives new words to the model together, if it keeps them apart."""

    joint = None

    def look_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.get, chunks))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        missing = dict.fromkeys([chunks[i] for i in gaps])
        if self.joint:
            new = [chunk for chunk in missing if chunk not in self.older and _BLANK_WORD(chunk)]
            for i in range(0, len(new), JOINT):
                some = new[i:i + JOINT]
                missing.update(zip(some, self.joint(some), strict=True))
                if len(self) >= self.limit // 2:
                    self.age()
                self.update([(chunk, missing[chunk]) for chunk in some if len(chunk) <= LONGEST_KEPT])
        for i in gaps:
            chunk = chunks[i]
            if missing[chunk] is None:
                missing[chunk] = self[chunk]
            found[i] = missing[chunk]
        return found


def _apart(model: dict) -> bool:
    """Whether words that begin with a blank have the same ids side by side as alone.

    They have if no merge takes in a blank behind something that such a word can end with.
    """
    number = {name: b for b, name in enumerate(BYTE_NAMES)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ends = [left for left, right in merges if right.startswith(BLANK) and left.strip(BLANK)]
    return (BLANK in model["vocab"] and all(set(left) <= number.keys() for left in ends)
            and not any(_WORD_END(bytes(map(number.__getitem__, left)).decode(errors="ignore")) for left in ends)
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")))


def _joint_ids(words: list[str], tokenize, names: dict[int, str], leads: np.ndarray) -> list[bytes]:
    """The ids of each word by one call; a token that begins with a blank begins a word."""
    ids = np.array([t.id for t in tokenize("".join(words).encode().decode("latin-1").translate(names))], "<u4")
    borders = [*(4 * np.flatnonzero(leads[ids])).tolist(), 4 * len(ids)]
    flat = ids.tobytes()
    return [flat[a:b] for a, b in pairwise(borders)]


def _encoder(path: str) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    setup = json.loads(tokenizer.to_str())
    before = setup["pre_tokenizer"] or {}
    direct = (setup["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
              and not before.get("add_prefix_space") and setup["model"]["type"] == "BPE")
    model = tokenizer.model
    if direct:
        model._resize_cache(0)  # answers are kept here, so that the library's own store is never hit
    tokenize = model.tokenize
    split = regex.compile(SPLIT).findall
    word = re.compile(f" ?[{LATIN}]+").fullmatch
    names = dict(enumerate(BYTE_NAMES))
    packed = {i: i.to_bytes(4, "little") for i in tokenizer.get_vocab().values()}
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    whole = frozenset(added)

    def piece_ids(piece: str) -> bytes:
        """One match of the splitting pattern: straight to the library's model, each byte by its name."""
        named = piece.encode().decode("latin-1").translate(names)
        return b"".join([packed[t.id] for t in tokenize(named)])

    def make(chunk: str) -> bytes:
        if not direct or chunk in whole:
            return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if word(chunk):  # the common case
            return piece_ids(chunk)
        if max(chunk) >= LETTERS_END:
            return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = split(chunk)
        return piece_ids(chunk) if len(pieces) == 1 else b"".join([kept[p] for p in pieces])  # pieces are known more often

    kept = Chunks(make, KEPT)
    if direct and _apart(setup["model"]):
        leads = np.zeros(max(packed) + 1, bool)
        leads[[i for token, i in tokenizer.get_vocab().items() if token.startswith(BLANK)]] = True
        kept.joint = lambda words: _joint_ids(words, tokenize, names, leads)
    # the library cuts a text at added tokens first, so that white space beside one ends a text of its own
    kept.parts = re.compile(f"({'|'.join(map(re.escape, added))})").split if added else lambda text: [text]
    kept.added = added
    kept.cut = cuts if direct else chunks
    return kept


def encode(text: str, path: str) -> bytes:
    return next(encode_all(pa.array([text], pa.string()), path))


def encode_all(texts: pa.Array, path: str) -> Iterator[bytes]:
    """The ids of each text; of a null none. ``SLICE`` bytes of text at a time, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield from _encode_slice(texts.slice(start, stop - start).fill_null(""), encoder(path))
        start = stop


def _encode_one(text: str, kept: Chunks) -> bytes:
    parts = kept.parts(text)  # every second one is an added token
    return b"".join([kept[part] if i % 2 else b"".join(map(kept.__getitem__, kept.cut(part))) for i, part in enumerate(parts)])


def _encode_slice(texts: pa.Array, kept: Chunks) -> Iterator[bytes]:
    """Texts are split at blanks and every different word of the slice is looked up once.

    A blank begins a chunk where it stands behind something else than white space, as in ``chunks``. A word behind any
    other blank stays with the one before it; such stretches, and the beginnings of texts, are looked up by themselves.
    Texts with added tokens or many runs of white space are encoded one by one.
    """
    runs = sum(pc.count_substring(texts, white).to_numpy() for white in ("  ", "\n ", "\t "))
    odd = RUNS_APART * runs > pc.binary_length(texts).to_numpy()
    for token in kept.added:
        odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    singly = {i: _encode_one(texts[i].as_py(), kept) for i in np.flatnonzero(odd).tolist()}
    if singly:
        texts = pc.if_else(odd, pa.scalar("", texts.type), texts)

    split = pc.split_pattern(texts, " ")
    places = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    codes = coded.indices.to_numpy().copy()
    words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", texts.type))[0].as_py().split(" ")
    loose = np.array([not word or word[-1].isspace() for word in words])

    begins = np.ones(len(codes), bool)
    begins[1:] = ~loose[codes[:-1]]
    first = np.zeros(len(codes), bool)
    first[places[:-1]] = begins[places[:-1]] = True
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], len(codes))
    alone = first[begin] | (end - begin > 1)
    usual = np.zeros(len(words), bool)
    usual[codes[begin[~alone]]] = True

    ids = kept.__getitem__
    plain, mixed, answers = [], [], [b""] * len(words)
    for n in np.flatnonzero(usual).tolist():
        word = words[n]
        if word.isalpha():
            plain.append(n)
        elif loose[n] or word[0].isspace():
            answers[n] = b"".join(map(ids, kept.cut(" " + word)))
        else:
            mixed.append(n)
    pieces = kept.cut("".join([" " + words[n] for n in mixed]))
    found = kept.look_up([" " + words[n] for n in plain] + pieces)
    for n, answer in zip(plain, found):
        answers[n] = answer
    heads = [i for i, piece in enumerate(pieces, len(plain)) if piece[0] == " "]  # each word has one blank, in front
    for n, (a, b) in zip(mixed, pairwise([*heads, len(found)]), strict=True):
        answers[n] = b"".join(found[a:b])
    stretches: dict[str, int] = {}
    for a, b in zip(begin[alone].tolist(), end[alone].tolist()):
        text = ("" if first[a] else " ") + " ".join([words[c] for c in codes[a:b].tolist()])
        if text not in stretches:
            stretches[text] = len(answers)
            answers.append(b"".join(map(ids, kept.cut(text))))
        codes[a] = stretches[text]
    codes[~begins] = len(answers)
    answers.append(b"")

    flat = pa.array(answers, pa.large_binary()).take(pa.array(codes))
    borders = np.frombuffer(flat.buffers()[1], np.int64, len(codes) + 1, 8 * flat.offset)[places].tolist()
    data = memoryview(flat.buffers()[2] or b"")
    for i, (a, b) in enumerate(pairwise(borders)):
        yield singly[i] if i in singly else bytes(data[a:b])


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The four byte planes of a block, compressed."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return [zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(rows, 1)).view("<u4").ravel()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class ShardWriter:
    """Writes one shard as documents come; holds no more than a block and the document table."""

    def __init__(self, path: str):
        files, name = _open(path)
        files.create_dir(os.path.dirname(name), recursive=True)
        self.out = files.open_output_stream(name)
        self.held: list[bytes] = []
        self.waiting = self.place = self.total = 0
        self.index: list[tuple] = []
        self.names: list = []
        self.counts: list[int] = []

    def add(self, name, ids: bytes) -> None:
        self.names.append(name)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK:
            flat = np.frombuffer(b"".join(self.held), "<u4")
            full = len(flat) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self.block(flat[i:i + BLOCK])
            self.held, self.waiting = [flat[full:].tobytes()], len(flat) - full

    def block(self, ids: np.ndarray) -> None:
        planes = to_planes(ids)
        self.index.append((self.place, len(ids), [len(p) for p in planes]))
        for plane in planes:
            self.out.write(plane)
            self.place += len(plane)
        self.total += len(ids)

    def close(self, kind: pa.DataType) -> None:
        if self.waiting:
            self.block(np.frombuffer(b"".join(self.held), "<u4"))
        places, counts, planes = zip(*self.index) if self.index else ((), (), ())
        index = _packed(pa.table({"place": pa.array(places, pa.int64()), "ids": pa.array(counts, pa.int64()),
                                  "planes": pa.array(planes, pa.list_(pa.int64()))}))
        documents = _packed(pa.table({"name": pa.array(self.names, kind), "ids": pa.array(self.counts, pa.int64())}))
        for part in (index, documents, struct.pack("<QQ", len(index), len(documents)), MARK):
            self.out.write(part)
        self.out.close()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def read_shard(path: str) -> Iterator[tuple[object, int, bytes]]:
    """(document, first id's place in the shard, ids) of each document, block by block."""
    files, name = _open(path)
    with files.open_input_file(name) as file:
        size = file.size()
        tail = file.read_at(24, size - 24)
        if tail[16:] != MARK:
            raise ValueError(f"not a complete shard: {path}")
        index_size, documents_size = struct.unpack("<QQ", tail[:16])
        start = size - 24 - documents_size - index_size
        index = pa.ipc.open_stream(file.read_at(index_size, start)).read_all().to_pylist()
        documents = pa.ipc.open_stream(file.read_at(documents_size, start + index_size)).read_all()
        held, block, place = b"", 0, 0
        for name, count in zip(documents.column("name"), documents.column("ids").to_pylist()):
            parts = [held]
            have = len(held) // 4
            while have < count:
                entry, at, planes = index[block], index[block]["place"], []
                data = file.read_at(sum(entry["planes"]), at)
                for length in entry["planes"]:
                    planes.append(data[:length])
                    data = data[length:]
                parts.append(from_planes(planes).tobytes())
                have, block = have + entry["ids"], block + 1
            joined = b"".join(parts)
            yield name.as_py(), place, joined[:4 * count]
            held, place = joined[4 * count:], place + count


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text",
                 folder: str | None = None) -> DataFrame:
    """Encodes and writes all documents; returns the manifest: path, first (of the order), documents, ids, start."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("turn", F.xxhash64("text"))
    placed = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), "turn").sortWithinPartitions(
        F.col("id").asc_nulls_first(), "turn").select("id", "turn", "text")
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, turn, name = None, None, None, f"{folder}/{uuid.uuid4().hex}.planes"
        for part in parts:
            for doc, ids in zip(part.column(0), encode_all(part.column(2), path)):
                if writer is None:
                    writer, first, turn = ShardWriter(name), part.column(0)[0], part.column(1)[0].as_py()
                writer.add(doc.as_py(), ids + end)
        if writer:
            writer.close(first.type)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([first.as_py()], first.type), pa.array([turn], pa.int64()),
                 pa.array([len(writer.counts)], pa.int64()), pa.array([writer.total], pa.int64())],
                names=["path", "first", "turn", "documents", "ids"])

    written = write_stage(placed.mapInArrow(write, f"path string, first {kind}, turn long, documents long, ids long"), "token-manifest")
    order = Window.orderBy(F.col("first").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))  # a row per shard


def read_tokens(manifest: DataFrame) -> DataFrame:
    """id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) from the files."""
    kind = manifest.schema["first"].dataType.simpleString()
    shards = manifest.count()
    rows = manifest.select("path", "start", "first").repartition(max(1, shards))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                names, places, ids, weight = [], [], [], 0
                for name, place, some in read_shard(path):
                    names.append(name)
                    places.append(start + place)
                    ids.append(some)
                    weight += len(some)
                    if weight >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(names, part.column(2).type), pa.array(places, pa.int64()), pa.array(ids, pa.binary())], names=["id", "start", "ids"])
                        names, places, ids, weight = [], [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, part.column(2).type), pa.array(places, pa.int64()), pa.array(ids, pa.binary())], names=["id", "start", "ids"])

    return rows.mapInArrow(read, f"id {kind}, start long, ids binary")


def token_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: where its ids start, how many there are, and their checksum."""
    return read_tokens(write_tokens(docs, path)).select(
        F.col("id").alias("doc_id"), "start", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
