"""Language of every text by a linear-chain conditional random field over its words.

A chain is the run of words in a line (cut after ``CHAIN`` words). A word's features are its affixes, its inner
n-grams and itself (the lexicon of words frequent in the sample); the label of a word is a language and the learned
transitions make neighbours agree, while chains in the sample that switch language keep a switch possible.
Forward-backward gives each word's probabilities; a text's language has the largest sum over its words, and the score
is the mean probability of that language.

The field is fitted on a bounded sample of labelled documents: at most ``SAMPLE_DOCS`` documents and ``SAMPLE_CHARS``
characters a language, chosen by a digest of the id. Prediction reads every whole text and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learned; null labels are not learned from; ties go to the first language by code point; repeated rows get the same
answer; a row with a null id is neither held out nor learned from.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolefit.llm.common import kept_in_worker

UNKNOWN = "und"
SAMPLE_DOCS, SAMPLE_CHARS = 200, 600_000
#: Documents over this part of the characters are taken only where the others leave room.
LONG = 20
CHAIN = 256
#: Characters of text handled at once, and words whose scores a worker keeps.
STEP_CHARS, KEPT_WORDS = 3_000_000, 400_000
MAX_LANGUAGES = 1000
ROUNDS, SWITCHED, LEAST_COUNT, PENALTY = 30, 0.15, 3, 1e-5

_RUNS = re.compile(r"[^\W\d_]+").findall


def letter_words(line: str) -> list[str]:
    """Runs of letters; the expression also lets through numbers that are no decimal digits, like a superscript two."""
    found = _RUNS(line)
    if "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def features(word: str) -> list[str]:
    """Affixes, inner n-grams, and the word itself."""
    marked = f"^{word}$"
    grams = [marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    return [*word, *grams, marked[:4], marked[-4:], marked[:5], marked[-5:], marked]


def chains(text: str) -> list[list[str]]:
    found = []
    for line in text.lower().split("\n"):
        words = letter_words(line)
        found += [words[i:i + CHAIN] for i in range(0, len(words), CHAIN)]
    return found


def posteriors(evidence: np.ndarray, switch: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected numbers of transitions; chains lie one after the other.

    All chains advance together, longest first, so that a step is one small matrix product.
    """
    total, labels = evidence.shape
    likely = np.exp(evidence - evidence.max(1, keepdims=True))
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than t
    ahead, behind = np.empty_like(likely), np.empty_like(likely)
    pair = np.zeros((labels, labels))
    transition = np.exp(switch)
    for t in range(steps):
        at = starts[:active[t]] + t
        here = likely[at] if t == 0 else (ahead[at - 1] @ transition) * likely[at]
        ahead[at] = here / here.sum(1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        at = starts[:active[t]] + t
        back = np.ones((len(at), labels))
        if t + 1 < steps and active[t + 1]:
            n = active[t + 1]
            coming = likely[at[:n] + 1] * behind[at[:n] + 1]
            back[:n] = coming @ transition.T
            both = ahead[at[:n], :, None] * transition[None] * coming[:, None, :]
            pair += (both / both.sum((1, 2), keepdims=True)).sum(0)
        behind[at] = back / back.sum(1, keepdims=True)
    found = ahead * behind
    return found / found.sum(1, keepdims=True), pair


class Field:
    """Feature weights and transitions of a fitted field."""

    def __init__(self, languages: list[str]):
        self.languages, self.name = languages, uuid.uuid4().hex
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, len(languages)))
        self.switch = np.zeros((len(languages), len(languages)))

    def fit(self, texts: list[tuple[str, int]], seed: int = 7) -> Field:
        """Gradient ascent (step sizes by past gradients) on the likelihood of the labels."""
        random = np.random.default_rng(seed)
        runs = [(words, label) for text, label in texts for words in chains(text)]
        types: dict[str, int] = {}
        coded = [np.array([types.setdefault(w, len(types)) for w in words]) for words, _ in runs]
        seen = Counter()
        for run in coded:
            seen.update(run.tolist())
        counts = Counter()
        for word, i in types.items():
            for f in set(features(word)):
                counts[f] += seen[i]
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= LEAST_COUNT))}
        rows, cols = [], []
        for word, i in types.items():
            own = [self.index[f] for f in features(word) if f in self.index]
            rows += [i] * len(own)
            cols += own
        rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
        # some chains go on in another language, as code-switched text does
        labels, parts = [], []
        for run, (_, label) in zip(coded, runs):
            parts.append(run)
            labels.append(np.full(len(run), label))
            if random.random() < SWITCHED:
                other = int(random.integers(len(coded)))
                parts[-1] = np.concatenate([run, coded[other]])
                labels[-1] = np.concatenate([labels[-1], np.full(len(coded[other]), runs[other][1])])
        lengths = np.array([len(p) for p in parts])
        word, label = np.concatenate(parts), np.concatenate(labels)
        n, size = len(self.languages), len(self.index)
        truth = np.zeros((len(word), n))
        truth[np.arange(len(word)), label] = 1
        real = np.zeros((n, n))
        ends = np.cumsum(lengths)
        inner = np.ones(len(word), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        np.add.at(real, (label[at], label[at + 1]), 1)
        weights, switch = np.zeros((size, n)), np.zeros((n, n))
        past, past_switch = np.full((size, n), 1e-8), np.full((n, n), 1e-8)
        for _ in range(ROUNDS):
            by_type = np.stack([np.bincount(rows, weights[cols, j], len(types)) for j in range(n)], 1)
            found, pair = posteriors(by_type[word], switch, lengths)
            error = truth - found
            per_type = np.stack([np.bincount(word, error[:, j], len(types)) for j in range(n)], 1)
            gradient = np.stack([np.bincount(cols, per_type[rows, j], size) for j in range(n)], 1) / len(word) - PENALTY * weights
            past += gradient ** 2
            weights += 0.3 * gradient / np.sqrt(past)
            gradient = (real - pair) / len(word)
            past_switch += gradient ** 2
            switch += 0.3 * gradient / np.sqrt(past_switch)
        self.weights, self.switch = weights, switch
        return self

    def evidence(self, word: str) -> np.ndarray:
        own = [self.index[f] for f in features(word) if f in self.index]
        return self.weights[own].sum(0)


class WordScores(dict):
    """Row of each word in a table of scores that grows as words come."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field
        self.table = np.zeros((1024, len(field.languages)))

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self.field.evidence(word)
        self[word] = row
        return row


def label_texts(field: Field, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    scores = kept_in_worker(("langid", field.name), lambda: WordScores(field))
    if len(scores) > KEPT_WORDS:
        scores.clear()
    lengths, per_text, words = [], np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        for chain in chains(text or ""):
            lengths.append(len(chain))
            per_text[i] += len(chain)
            words += chain
    rows = np.fromiter(map(scores.__getitem__, words), np.int64, len(words))
    languages, certain = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not len(rows) or not field.languages:
        return languages, certain
    found, _ = posteriors(scores.table[rows], field.switch, np.array(lengths))
    some = np.flatnonzero(per_text)
    sums = np.add.reduceat(found, (np.cumsum(per_text) - per_text)[some]) / per_text[some, None]
    best = sums.round(9).argmax(1)
    for i, b in zip(some, best):
        languages[i] = field.languages[b]
    certain[some] = sums[np.arange(len(some)), best]
    return languages, certain.clip(0, 1).round(6)


def learn(labelled: DataFrame, seed: int = 7) -> Field:
    """Field fitted on a bounded sample of (text, lang, turn); ``turn`` decides which documents are taken.

    Documents over a share of the characters come last, the shortest first: one that is left out leaves out only longer ones.
    """
    spark = labelled.sparkSession
    have = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min("turn").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(have) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in have)
    if not languages:
        return Field([])
    rates = F.broadcast(spark.createDataFrame(
        [(r["lang"], min(1.0, 2.0 * SAMPLE_DOCS / r["count"]), r["least"]) for r in have], "lang string, rate double, least long"))
    order = Window.partitionBy("lang").orderBy(F.greatest(F.length("text"), F.lit(SAMPLE_CHARS // LONG)), "turn", "text")
    some = labelled.join(rates, "lang").where(  # a language whose rows all have one turn is not drawn away as a whole
        (F.pmod("turn", F.lit(1_000_003)) < F.col("rate") * 1_000_003) | (F.col("turn") == F.col("least")))
    sample = (
        some.withColumn("place", F.row_number().over(order))
        .withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("place") <= SAMPLE_DOCS) & ((F.col("chars") <= SAMPLE_CHARS) | (F.col("place") == 1)))
        .select("lang", "turn", "text").collect())
    texts = [(r["text"], languages.index(r["lang"])) for r in sorted(sample)]
    field = Field(languages)
    return field.fit(texts, seed) if any(chains(t) for t, _ in texts) else Field([])


def predict(docs: DataFrame, field: Field, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred`` and ``lang_score`` of each row."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("lang_score", "double")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept, start, texts, chars = part.select(list(keep)), 0, [], 0
            column = part.column(len(keep))
            for i in range(len(column)):
                texts.append(column[i].as_py())
                chars += len(texts[-1] or "")
                if chars >= STEP_CHARS or i == len(column) - 1:
                    languages, scores = label_texts(field, texts)
                    some = kept.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                        names=[*keep, "lang_pred", "lang_score"])
                    start, texts, chars = i + 1, [], 0

    return rows.mapInArrow(run, schema)


def fold(key: str = "doc_id"):
    """Remainder of the digest of an id, which decides what is held out (2)."""
    return F.crc32(F.col(key).cast("string")) % 4


def learned_from(docs: DataFrame) -> Field:
    """Field fitted on the labelled documents that are not held out."""
    return learn(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 2)).select(
        "lang", "text", F.xxhash64("doc_id").alias("turn")))


def languages(docs: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its predicted language and the score."""
    found = predict(docs, learned_from(docs), ("doc_id",))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"))
