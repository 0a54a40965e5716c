"""BPE, edited counts and token files against the public libraries."""

import base64
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolefit.llm.bpe import KEPT_CHUNKS, KEPT_PAIRS, Kept, RankedVocabulary, cuts, decode, digests, encode, encode_and_decode, vocabulary
from rolefit.llm.token_counts import EDITS, count_tokens, counter, masked_counts, recounted
from rolefit.llm import token_files
from rolefit.llm.token_files import (
    BLOCK, JOINT, Chunks, _apart, encode as file_ids, encode_all, encoder, from_planes, read_tokens, to_planes, token_report, write_tokens)

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = st.text(st.one_of(st.sampled_from(" \n\t  \x1c\x1f'stre.!aé日🙂0"), st.characters(codec="utf-8")), max_size=60)
ODD = [None, "", "a" * 3000, "日本語  \n\n x", "🙂🙂", "'s't don't 're", "ab" * 2000, "zzqqxj" * 500, "a\t\n x  y", "!\x1c? \x1d a", "<|endoftext|> x"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_equal_the_library(library, text):
    vocab = vocabulary(PATH, P.PATTERN)
    ids = vocab.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library(text)
    assert vocab.decode(ids) == text.encode()


def frame(spark):
    return spark.createDataFrame([(i, t, "x", b"y") for i, t in enumerate(ODD)] + [(None, "same", "x", b"y")] * 2,
                                 "doc_id long, text string, decoded string, ids binary")


def test_encode_and_decode_tables(spark, library):
    both = decode(encode(frame(spark).drop("ids"), PATH, P.PATTERN, keep=("doc_id", "text")), PATH, P.PATTERN, keep=("doc_id", "text", "ids"))
    rows = both.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    once = encode_and_decode(frame(spark).select("doc_id", "text"), PATH, P.PATTERN, keep=("doc_id", "text")).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, rows))
    assert digests(frame(spark).limit(0), PATH, P.PATTERN).count() == 0


EDIT = st.tuples(st.integers(0, 60), st.integers(0, 8), st.one_of(st.none(), st.text(" a\n.é", max_size=4)))


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.lists(EDIT, max_size=5))
def test_counts_after_edits(library, text, edits):
    changes = [{"start": a, "stop": a + n, "new": new} for a, n, new in edits]
    before, applied, ignored, after, _ = recounted(text, changes, counter(PATH, P.PATTERN))
    limit, edited, used = len(text), text, 0
    for e in sorted(changes, key=lambda e: (e["start"], e["stop"]), reverse=True):
        start, stop = min(e["start"], len(text)), min(e["stop"], len(text))
        if stop <= limit:
            edited, limit, used = edited[:start] + (e["new"] or "") + edited[stop:], start, used + 1
    assert (before, applied, ignored, after) == (len(library(text)), used, len(changes) - used, len(library(edited)))


def test_edits_touch_a_small_part(library):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(5000))
    before, _, _, after, again = recounted(text, [{"start": 9000, "stop": 9004, "new": "xyz"}], counter(PATH, P.PATTERN))
    assert before == len(library(text)) and after == len(library(text[:9000] + "xyz" + text[9004:])) and again < 100


def test_count_tables(spark, library):
    rows = [(1, "mail a.b@c.de now", [(0, 4, "post"), (None, 1, "x"), (5, 2, "y")]), (2, None, None), (3, "x", [(0, 1, None)]), (3, "x", [(0, 1, None)])]
    got = count_tokens(spark.createDataFrame(rows, f"doc_id long, text string, edits {EDITS}"), PATH, P.PATTERN).collect()
    assert sorted(tuple(r)[:5] for r in got) == [
        (1, len(library("mail a.b@c.de now")), 1, 2, len(library("post a.b@c.de now"))), (2, 0, 0, 0, 0), (3, 1, 1, 0, 0), (3, 1, 1, 0, 0)]
    masked = masked_counts(spark.createDataFrame([(1, "mail a.b@c.de now"), (2, None)], "doc_id long, text string"), PATH, P.PATTERN).collect()
    assert {r["doc_id"]: (r["n_edits"], r["n_tokens_after"]) for r in masked} == {1: (1, len(library("mail [masked] now"))), 2: (0, 0)}


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 1 << 32, BLOCK, np.uint32)
    assert (from_planes(to_planes(ids)) == ids).all() and from_planes(to_planes(np.zeros(1, "<u4"))).tolist() == [0]


def test_token_files(spark, library):
    docs = spark.createDataFrame([(i * 7 % 101, "word " * (i * 40) + str(i), "x") for i in range(101)] + [(None, None, "x"), (500, "", "x"), (500, "", "x")],
                                 "doc_id long, text string, start string")
    json = P.path("byte_bpe_50k.json")
    manifest = write_tokens(docs, json)
    assert manifest.agg(F.sum("documents")).first()[0] == 104
    rows = sorted(((r["id"] is not None, r["id"] or 0, r["start"]), bytes(r["ids"])) for r in read_tokens(manifest).collect())
    place = 0
    want = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()])
    for (key, ids), (has, doc, text) in zip(rows, want, strict=True):
        assert key == (has, doc, place) and np.frombuffer(ids, "<u4").tolist() == library(text) + [0]
        place += len(ids) // 4
    r = token_report(docs.where("doc_id = 5"), json).first()
    text = docs.where("doc_id = 5").first()["text"]
    assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (0, len(library(text)) + 1, zlib.crc32(np.array(library(text) + [0], "<u4").tobytes()))
    assert token_report(docs.limit(0), json).count() == 0


JSON = P.path("byte_bpe_50k.json")
LOADED = Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.sampled_from(["<|endoftext|>", " <|endoftext|>", "<|endoftext", "  "])), max_size=6).map("".join))
def test_file_ids_equal_the_tokenizer_as_loaded(text):
    assert np.frombuffer(file_ids(text, JSON), "<u4").tolist() == LOADED.encode(text, add_special_tokens=False).ids


MARKED = " zuordnung zuordnung, zuordnung### zuordnung%%% zuordnung\nzuordnung. zuordnung's"


def test_a_word_is_encoded_once_whatever_stands_behind_it(library):
    vocab = RankedVocabulary(PATH, P.PATTERN)
    pieces, one = [], vocab.encode_piece
    vocab.encode_piece = lambda data: pieces.append(data) or one(data)
    assert np.frombuffer(vocab.encode(MARKED), "<u4").tolist() == library(MARKED)
    assert pieces.count(b" zuordnung") == 1


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_cuts_are_borders_of_matches(text):
    assert "".join(cuts(text)) == text
    split = regex.compile(P.PATTERN).findall
    assert [p for c in cuts(text) for p in split(c)] == split(text)


def test_frequent_answers_stay_when_the_store_is_full():
    made = []
    kept = Kept(lambda chunk: made.append(chunk) or len(chunk), 100)
    for i in range(1000):
        assert kept["often"] == 5 and kept[f"rare {i}"] == len(f"rare {i}")
        assert len(kept) + len(kept.older) <= 100
    assert made.count("often") == 1 and len(made) == 1001


def test_a_worker_keeps_no_more_than_its_memory_allows():
    # pipeline, byte_bpe: two or more workers share an executor with a heap that is full already
    assert KEPT_CHUNKS <= 300_000 and KEPT_PAIRS <= 300_000


def test_neighbours_that_stay_are_those_of_plain_merging():
    vocab, rng = vocabulary(PATH, P.PATTERN), random.Random(3)
    ranks = sorted(vocab.halves)
    pairs = [(rng.choice(ranks), rng.choice(ranks)) for _ in range(3000)]
    pairs += [(vocab.rank[b[:i]], vocab.rank[b[i:]]) for b in map(vocab.bytes_of.get, rng.sample(ranks, 1500))
              for i in range(1, len(b)) if vocab.rank.get(b[:i]) in vocab.halves and vocab.rank.get(b[i:]) in vocab.halves]
    same = [vocab.rank[b"a" * n] for n in range(1, 9) if b"a" * n in vocab.rank] + [vocab.rank[b" " * n] for n in range(1, 9) if b" " * n in vocab.rank]
    pairs += [(a, b) for a in same for b in same]
    answers = [vocab.stay(a, b) for a, b in pairs]
    assert answers == [vocab.merged(vocab.bytes_of[a] + vocab.bytes_of[b]) == [a, b] for a, b in pairs]
    assert any(answers) and not all(answers)


def test_token_files_encode_a_word_once_whatever_stands_behind_it(library):
    kept = encoder(JSON)
    assert np.frombuffer(file_ids(MARKED, JSON), "<u4").tolist() == library(MARKED)
    assert " zuordnung" in kept and " zuordnung###" not in kept and " zuordnung," not in kept


def test_output_batches_stay_small(spark):
    # pipeline, byte_bpe: ids and decoded bytes wait in a worker beside its stores
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    made, real = [], type(docs).mapInArrow
    type(docs).mapInArrow = lambda df, run, *a, **b: made.append(run) or real(df, run, *a, **b)
    try:
        encode_and_decode(docs, PATH, P.PATTERN)
    finally:
        type(docs).mapInArrow = real
    text = "word and word, " * 7000
    part = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([text] * 100)], names=["doc_id", "__in"])
    out = list(made[0](iter([part])))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(100))
    assert all(b.column(1)[0].as_py() == out[0].column(1)[0].as_py() and b.column(2)[0].as_py() == text.encode() for b in out)
    assert max(b.nbytes for b in out) < 3 << 20


BLANKS = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\xa0", "\x1c", "à", "wordà", "foo", "bar,", ".baz", "日本", "!", "\n\n x", "<|endoftext|>", "7"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, BLANKS), max_size=6))
def test_file_ids_of_many_texts_equal_the_tokenizer_as_loaded(texts):
    got = list(encode_all(pa.array(texts, pa.string()), JSON))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [LOADED.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, BLANKS), max_size=6))
def test_few_runs_of_blanks_in_long_texts(texts):
    texts = [t and "some words, that stand apart " * 40 + t + " and more" * 40 for t in texts]
    got = list(encode_all(pa.array(texts, pa.string()), JSON))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [LOADED.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_slices_and_parts_of_arrays_give_the_same_ids(monkeypatch):
    texts = [None, "", " ", "a  b", "x" * 100, "one two two", " \n", "word <|endoftext|> word", "two one "] * 3
    want = [LOADED.encode(t or "", add_special_tokens=False).ids for t in texts]
    for size, apart in ((1, 0), (12, 0), (1000, 0), (1000, token_files.RUNS_APART)):
        monkeypatch.setattr(token_files, "SLICE", size)
        monkeypatch.setattr(token_files, "RUNS_APART", apart)
        for kind in (pa.string(), pa.large_string()):
            got = encode_all(pa.array(["before", *texts], kind).slice(1), JSON)
            assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert list(encode_all(pa.array([], pa.string()), JSON)) == []


def test_token_files_look_a_word_up_once_for_many_texts(monkeypatch):
    # op4_token_files was over its CPU budget: each of the 20 million words of a worker was looked up by itself
    kept = encoder(JSON)
    asked, calls = [], []
    real, joint = type(kept).look_up, kept.joint
    monkeypatch.setattr(type(kept), "look_up", lambda self, chunks: asked.extend(chunks) or real(self, chunks))
    monkeypatch.setattr(kept, "joint", lambda words: calls.append(words) or joint(words))
    word = "".join(random.Random(8).choices("qxzjkv", k=20))
    texts = [f"first {word} {word}, neverseen{word} and {word}" for _ in range(500)]
    got = list(encode_all(pa.array(texts), JSON))
    assert got == [np.array(LOADED.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()] * 500
    assert asked.count(f" {word}") == 2 and len(asked) == 5  # alone, and with a comma
    assert [w for some in calls for w in some if word in w] == [f" {word}", f" neverseen{word}"]


def test_words_are_given_to_the_model_together_only_if_no_merge_joins_them():
    setup = json.loads(LOADED.to_str())["model"]
    assert _apart(setup)  # it has merges from a no-break space into a blank, but no word ends in one
    for end in ("e", "Ãł", "ł"):
        assert not _apart({**setup, "merges": [*setup["merges"], [end, "Ġ"]]})
    assert not _apart({**setup, "ignore_merges": True}) and not _apart({**setup, "end_of_word_suffix": "</w>"})


def test_joint_answers_leave_room_in_the_store():
    kept = Chunks(lambda chunk: b"made", 200)
    kept.joint = lambda words: [w.encode() for w in words]
    words = [f" {a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    for i in range(0, len(words), 10):
        assert kept.look_up([" often", *words[i:i + 10], "7"]) == [b" often", *[w.encode() for w in words[i:i + 10]], b"made"]
        assert len(kept) <= 100 + JOINT and len(kept.older) <= 100 + JOINT
    assert kept.look_up([" often"] * 2 + [" " + "x" * 60]) == [b" often"] * 2 + [b" " + b"x" * 60] and " " + "x" * 60 not in kept
