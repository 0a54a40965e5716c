"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A piece (one match of the splitting pattern) is encoded without replaying merges. All vocabulary entries that
occur in the piece come from one pass of an Aho-Corasick automaton over its bytes, mapped to Latin-1 so that a
byte is a character. From the left the longest entry is tried first (one pass that takes the longest each time
often settles it); an entry may follow another only if the two
stay as they are when their joined bytes are encoded, a relation that follows from the last merges of both, is computed once
per pair and kept. A position from which nothing fits is marked and never tried again, so every position is visited a bounded number
of times. A sequence whose neighbours are all compatible is the one that merging in rank order gives.

Defined results: a null text has no tokens, like an empty one; rows may repeat; texts of any length are read
whole; other columns are passed on by ``keep`` only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import kept_in_worker

#: Chunks and pairs whose answer a worker keeps; of chunks the half that was not asked for lately goes when full, pairs start anew.
KEPT_CHUNKS, KEPT_PAIRS = 300_000, 300_000
LONGEST_KEPT = 48
#: Bytes of answers after which an output batch is closed.
OUT_BYTES = 2 << 20

#: White space in the sense of the splitting pattern, and the common part of it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_CHUNKS = re.compile("[ \n]*[^ \n]+|[ \n]+").findall
_ANY_CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Latin letters up to an ASCII character that is no letter, or the end.
_WORD = rf"[{LATIN}]++(?=[\x00-@\[-`{{-\x7f]|\Z)"
_CUTS = re.compile(rf"[ \n]*{_WORD}|[ \n]*[^ \n]+|[ \n]+").findall
_ANY_CUTS = re.compile(rf"[{WHITE}]*{_WORD}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall


def chunks(text: str) -> list[str]:
    """Cuts of a text that no match of the splitting pattern crosses: white space, then what follows it.

    A cut stands where white space follows something else; a match can begin with white space but never goes on
    into it, and one that ends in white space looks one character ahead, which is in the same chunk.
    """
    return (_ANY_CHUNKS if _RARE_SPACE(text) else _CHUNKS)(text)


def cuts(text: str) -> list[str]:
    """Like ``chunks``, but cut behind a chunk's first word too, where Latin letters meet what is no letter.

    No match of the splitting pattern goes from a letter to another kind of character, whatever stood before it. So words are
    the same with and without a comma behind them, and the marks stand alone.
    """
    return (_ANY_CUTS if _RARE_SPACE(text) else _CUTS)(text)


class Kept(dict):
    """Answers by chunk, made on first use; at most ``limit``, half of them in ``older``.

    When the younger half is full it becomes the older one, which is dropped. An answer found there is young again, so
    frequent chunks stay.
    """

    def __init__(self, make, limit: int = KEPT_CHUNKS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, chunk: str):
        answer = self.older.get(chunk)
        if answer is None:
            answer = self.make(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= self.limit // 2:
                self.age()
            self[chunk] = answer
        return answer

    def age(self) -> None:
        """The younger half becomes the older one."""
        self.older = {}  # gone before the other is copied
        self.older = dict(self)
        self.clear()


class RankedVocabulary:
    """Encoder and decoder over (token bytes, rank) lines in base 64."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {r: b for b, r in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.chunks = Kept(self.encode_chunk)
        self.pairs: dict[int, bool] = {}  # by left rank * 2**32 + right rank
        self.automaton = ahocorasick.Automaton()
        #: The two entries that an entry's last merge joins (of a single byte: itself twice), and the entry by the two.
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        # an entry that merging never makes can't be used
        usable = set()
        for token, rank in self.rank.items():
            left, right = (rank, rank) if len(token) == 1 else self.last_merge(token)
            if left is None:
                continue
            usable.add(token)
            self.halves[rank] = left, right
            if len(token) > 1:
                self.joined[left << 32 | right] = rank
        #: The longest entry that a longer one begins with.
        self.shorter: dict[int, int] = {}
        for token in usable:
            self.automaton.add_word(token.decode("latin-1"), self.rank[token])
            begin = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), None)
            if begin:
                self.shorter[self.rank[token]] = self.rank[begin]
        self.size = {r: len(b) for r, b in self.bytes_of.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in self.bytes_of}
        self.automaton.make_automaton()
        size = max(self.bytes_of) + 1
        self.length = np.array([len(self.bytes_of.get(r, b"")) for r in range(size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.table = np.frombuffer(b"".join(self.bytes_of.get(r, b"") for r in range(size)), np.uint8)

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """Reference merging of a few bytes: join the neighbours of lowest rank until none can be joined or ``stop`` are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def last_merge(self, token: bytes) -> tuple[int | None, int | None]:
        """The two entries that become this one; nulls if merging never makes it."""
        parts = self.merged(token, 2)
        return tuple(parts) if len(parts) == 2 else (None, None)

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 32 | right] = self.stay(left, right)
        return known

    def stay(self, left: int, right: int) -> bool:
        """Whether two entries side by side are what merging their joined bytes gives.

        Their merges are undone at the border, the latest first. A join of what then meets there would have come before
        the merge undone last (of equal ranks the left one comes first) and is what keeps the two from being made.
        """
        joined, halves, limit = self.joined.get, self.halves, 1 << 60
        while joined(left << 32 | right, limit) >= limit:
            if left > right:
                limit, left = left, halves[left][1]
                if left != limit:
                    continue  # else a single byte
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, halves[left][1]
                if left == limit:
                    return True
        return False

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        text = data.decode("latin-1")
        find, compatible, known = self.automaton.iter_long, self.compatible, self.pairs.get
        longest = [rank for _, rank in find(text)]
        last = longest[0]
        for n, token in enumerate(longest):
            if n:
                fits = known(last << 32 | token)
                if not (compatible(last, token) if fits is None else fits):
                    return self.search(text, longest[:n], token)
            last = token
        return longest

    def search(self, text: str, tokens: list[int], token: int | None) -> list[int]:
        """The entries of a text that begins with ``tokens``, as far as known; ``token`` is the longest that stands behind them."""
        find, compatible, sizes, shorter, known = self.automaton.iter_long, self.compatible, self.size, self.shorter, self.pairs.get
        size, at = len(text), sum([sizes[t] for t in tokens])
        hopeless = bytearray(size + 1)
        while at < size:
            while token is not None:
                end = at + sizes[token]
                if not hopeless[end]:
                    if not tokens:
                        break
                    fits = known(tokens[-1] << 32 | token)
                    if compatible(tokens[-1], token) if fits is None else fits:
                        break
                token = shorter.get(token)
            if token is not None:
                tokens.append(token)
                at = end
                token = next(find(text, at))[1] if at < size else None
            else:
                hopeless[at] = 1
                last = tokens.pop()
                at -= sizes[last]
                token = shorter.get(last)
        return tokens

    def encode_chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():  # one match of the pattern, the common case
            ids = self.encode_piece(chunk.encode())
        elif chunk[0] == "\n" and chunk[1:].isalpha():
            return self.chunks["\n"] + self.chunks[chunk[1:]]  # the word alone is known more often
        else:
            ids = [i for piece in self.split(chunk) for i in self.encode_piece(piece.encode())]
        return b"".join(map(self.packed.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, cuts(text)))

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        length = self.length[ids]
        ends = np.cumsum(length)
        return self.table[np.repeat(self.start[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def vocabulary(path: str, pattern: str) -> RankedVocabulary:
    """One per Python worker."""
    return kept_in_worker(("bpe", path, pattern), lambda: RankedVocabulary(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``ids``: the token ids of each whole text, as little-endian unsigned 32-bit integers."""
    return _each(docs, keep, text, "string", ("ids",), lambda value: (vocabulary(path, pattern).encode(value) if value else b"",))


def decode(tokens: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``: the bytes that the ids stand for."""
    return _each(tokens, keep, "ids", "binary", ("decoded",), lambda value: (vocabulary(path, pattern).decode(value) if value else b"",))


def encode_and_decode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``ids`` and ``decoded`` in one pass."""
    def both(value: str | None) -> tuple[bytes, bytes]:
        known = vocabulary(path, pattern)
        ids = known.encode(value) if value else b""
        return ids, known.decode(ids)

    return _each(docs, keep, text, "string", ("ids", "decoded"), both)


def _each(df: DataFrame, keep: tuple[str, ...], source: str, kind: str, targets: tuple[str, ...], make) -> DataFrame:
    rows = df.select(*keep, F.col(source).cast(kind).alias("__in"))
    schema = rows.drop("__in").schema
    for target in targets:
        schema = schema.add(target, "binary")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept = part.select(list(keep))
            start, values, weight = 0, [], 0
            for value in part.column(len(keep)):
                values.append(make(value.as_py()))
                weight += sum(map(len, values[-1]))
                if weight >= OUT_BYTES:
                    yield _with(kept.slice(start, len(values)), values, targets)
                    start, values, weight = start + len(values), [], 0
            if values:
                yield _with(kept.slice(start, len(values)), values, targets)

    return rows.mapInArrow(run, schema)


def _with(kept: pa.RecordBatch, values: list[tuple[bytes, ...]], names: tuple[str, ...]) -> pa.RecordBatch:
    made = [pa.array(column, pa.binary()) for column in zip(*values)]
    return pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *names])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, and digest of what they decode to."""
    return encode_and_decode(docs, path, pattern).select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
