"""Token counts that follow edits: only what an edit touches is encoded again.

A text is kept as a segment tree. Its leaves are pre-token groups (white space and what follows it, up to the next
white space); a node holds the numbers of characters and tokens below it. An edit is located by descending on the
character sums. The leaves it touches are joined, changed and encoded again, together with a neighbour on either side
where the border between them is no longer one that the splitting pattern can't cross; then the sums on the paths to
the root are brought up to date.

Edits of a text are given in positions of the text as it was, and applied from the last to the first.

Defined results: a null text is empty; null or no edits leave the count; positions beyond the text mean its end; an
edit that overlaps one that stands after it, or has a null position or a stop before its start, is ignored and counted
in ``n_ignored``; a null replacement is empty; repeated rows get the same answer; other columns pass by ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rolefit.llm.bpe import WHITE, Kept, chunks
from rolefit.llm.common import kept_in_worker

_WHITE = re.compile(f"[{WHITE}]").match
EDITS = "array<struct<start:int,stop:int,new:string>>"


def counter(path: str, pattern: str) -> Kept:
    """Number of tokens by chunk; one per Python worker."""
    return kept_in_worker(("counts", path, pattern), lambda: _counter(path, pattern))


def _counter(path: str, pattern: str) -> Kept:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Kept(lambda chunk: len(encode(chunk)))


class TokenTree:
    """Segment tree over the pre-token groups of a text."""

    def __init__(self, text: str, count: Kept):
        self.count = count
        self.parts = chunks(text)
        self.size = 1 << max(0, len(self.parts) - 1).bit_length()
        empty = [0] * (self.size - len(self.parts))
        self.chars = [0] * self.size + [len(p) for p in self.parts] + empty
        self.tokens = [0] * self.size + [count[p] for p in self.parts] + empty
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.encoded_again = 0

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a character, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if position - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def put(self, leaf: int, text: str) -> None:
        self.parts[leaf] = text
        pieces = chunks(text)
        self.encoded_again += len(text)
        node = leaf + self.size
        self.chars[node], self.tokens[node] = len(text), sum(map(self.count.__getitem__, pieces))
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def neighbour(self, position: int) -> tuple[int, int] | None:
        return self.find(position) if 0 <= position < self.chars[1] else None

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``stop``."""
        if not self.parts:
            self.parts = [""]
        total = self.chars[1]
        low, begin = self.find(min(start, total - 1)) if total else (0, 0)
        high, last = self.find(min(max(stop - 1, start), total - 1)) if total else (0, 0)
        end = last + len(self.parts[high])
        old = "".join(self.parts[low:high + 1])
        text = old[:start - begin] + new + old[stop - begin:]
        while True:
            before = self.neighbour(begin - 1)
            after = self.neighbour(end)
            if before and not (text and _WHITE(text) and not _WHITE(self.parts[before[0]][-1])):
                low, begin = before
                text = self.parts[low] + text
            elif after and not (text and _WHITE(self.parts[after[0]]) and not _WHITE(text[-1])):
                high, at = after
                end = at + len(self.parts[high])
                text += self.parts[high]
            else:
                break
        for leaf in range(low + 1, high + 1):
            if self.parts[leaf]:
                self.put(leaf, "")
        self.put(low, text)


def recounted(text: str, edits: list[dict], count: Kept) -> tuple[int, int, int, int, int]:
    """Tokens before, edits applied, edits ignored, tokens after, and characters encoded again."""
    tree = TokenTree(text, count)
    before, applied, limit = tree.tokens[1], 0, len(text)
    usable = [e for e in edits if e and e["start"] is not None and e["stop"] is not None and 0 <= e["start"] <= e["stop"]]
    for edit in sorted(usable, key=lambda e: (e["start"], e["stop"]), reverse=True):
        start, stop = min(edit["start"], len(text)), min(edit["stop"], len(text))
        if stop > limit:
            continue
        tree.replace(start, stop, edit["new"] or "")
        applied, limit = applied + 1, start
    return before, applied, len(edits) - applied, tree.tokens[1], tree.encoded_again


def count_tokens(docs: DataFrame, path: str, pattern: str, edits: str = "edits", keep: tuple[str, ...] = ("doc_id",),
                 text: str = "text") -> DataFrame:
    """``keep`` with n_tokens, n_edits, n_ignored, n_tokens_after and n_chars_again, given a column of edits."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"), F.col(edits).cast(EDITS).alias("__edits"))
    names = ("n_tokens", "n_edits", "n_ignored", "n_tokens_after", "n_chars_again")
    schema = rows.drop("__text", "__edits").schema
    for name in names:
        schema = schema.add(name, "long")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for part in parts:
            texts, changes = part.column(len(keep)), part.column(len(keep) + 1)
            made = [recounted(t.as_py() or "", e.as_py() or [], count) for t, e in zip(texts, changes)]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], *[pa.array(c, pa.int64()) for c in zip(*made)]], names=[*keep, *names])

    return rows.mapInArrow(run, schema)


def mask_edits(text: Column, pattern: str, new: str) -> Column:
    """Edits that put ``new`` in place of every match of a regular expression."""
    @pandas_udf(EDITS)
    def edits(texts):
        find = re.compile(pattern).finditer
        return texts.map(lambda t: [{"start": m.start(), "stop": m.end(), "new": new} for m in find(t or "")])

    return edits(text)


#: E-mail addresses, card-like numbers, phone numbers, network addresses and assigned secrets.
PERSONAL = (r"[\w.+-]+@[\w-]+\.[\w.-]+|\b\d{13,16}\b|\+\d[\d ()-]{7,}\d|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{32,}\b|\bAKIA[0-9A-Z]{16}\b")


def masked_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document its tokens before and after personal data and secrets are masked."""
    edited = docs.select("doc_id", "text", mask_edits(F.col("text"), PERSONAL, "[masked]").alias("edits"))
    return count_tokens(edited, path, pattern)
