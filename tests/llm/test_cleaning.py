"""Line dedup, quality rules and language ID on small tables with nulls, empty texts, repeated rows and odd columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolefit.llm import langid
from rolefit.llm.langid import label_texts, languages, learn, learned_from
from rolefit.llm.lines import dedup_lines, line_report
from rolefit.llm.quality import quality_report, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, id string, line string, quality string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "q") for i, t, lang, s in rows], DOCS)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def plain_dedup(rows):
    """One line after the other, against all earlier ones."""
    seen, out = {}, []  # line: whether it was near an earlier one when it first came
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        kept, equal, near = [], 0, 0
        for raw in text.split("\n"):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            again = line in seen
            if line and not again:
                seen[line] = any(one_edit(e, line) for e in seen)
            if line and seen[line]:
                near += 1
            elif again:
                equal += 1
            else:
                kept.append(raw)
        out.append((i, "\n".join(kept), equal, near))
    return sorted(out, key=repr)


def test_lines_against_every_earlier_line(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab é") for _ in range(rng.choice([1, 2, 3, 8, 20, 21, 22, 40]))) for _ in range(25)]
    rows = [(None, base[3] + "\n\n" + base[4])]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(line) + 1)
                line = line[:at] + rng.choice(["", "c", "é"]) + line[at + rng.choice([0, 1]):]
            lines.append(rng.choice(["", "  "]) + line)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (103, base[0])]
    got = [(r["doc"]["doc_id"], r["kept"], r["n_equal"], r["n_near"]) for r in
           dedup_lines(table(spark, [(i, t, "en", "s") for i, t in rows])).collect()]
    assert sorted(got, key=repr) == plain_dedup(rows)


def test_lines_of_repeated_rows_and_empty_table(spark):
    rows = [(1, "a line of some length here\nshort", "en", "s")] * 2 + [(2, "a line of some length hare\nshort", "en", "s")]
    got = sorted(tuple(r) for r in line_report(table(spark, rows)).select("doc_id", "n_lines", "n_equal", "n_near").collect())
    assert got == [(1, 2, 0, 0), (1, 2, 0, 0), (2, 2, 1, 1)]
    ones = line_report(table(spark, [(i, c, "en", "s") for i, c in enumerate(["ab", "a", "b", "cd", "", "é", "xyz"])]))
    assert [r["n_near"] for r in ones.orderBy("doc_id").collect()] == [0, 1, 1, 0, 0, 1, 0]
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a", "a b", "a b c a b c", "x " * 200, "é\tü\x0b" * 40, "one | two | three | four\n" * 30, "A" * 100_000]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "#", "é "]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_report(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [5_000, 200_000])
def test_quality_of_one_line_of_equal_words(spark, n):
    rows = [(1, "go " * n, "en", "s"), (2, "x" * n, "en", "s"), (3, " ".join(f"w{i}" for i in range(n)), "en", "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["kept"], r["n_bad_lines"]) for r in quality_report(table(spark, rows)).collect()}
    assert got == {1: (n, n, False, 1), 2: (1, 0, False, 0), 3: (n, 0, True, 0)}


def test_quality_drops_bad_lines_and_keeps_clean_text(spark):
    prose = "\n".join(" ".join(f"word{i * 17 + j}" for j in range(12)) + "." for i in range(8))
    bad = ["Home | About | News | Contact", "WE!! SHOUT!! AT!! YOU!! NOW!!", "All rights reserved.", "go go go go go go on", "a### b$$$ c***"]
    rows = [(1, prose, "en", "s"), (2, prose + "\n" + "\n".join(bad), "en", "s"), (3, "\n".join((bad[0] + f" x{i}") for i in range(40)), "en", "s")]
    got = {r["doc"]["doc_id"]: r["quality"] for r in quality_rules(table(spark, rows)).collect()}
    assert got[1]["kept"] and got[2]["kept"] and not got[3]["kept"]
    assert got[2]["cleaned"] == prose and got[2]["n_bad_lines"] == 5
    assert "quality" in quality_rules(table(spark, rows)).select("doc.*").columns


VOCABULARY = {"en": "the of and house water running through green fields every morning".split(),
              "de": "der die und haus wasser läuft durch grüne felder jeden morgen".split(),
              "fr": "le la et maison eau coule à travers champs chaque matin".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, lang := rng.choice(list(VOCABULARY)), rng.randint(5, 60)), lang, "s") for i in range(400)]
    rows += [(1000, None, "en", "s"), (1001, "123 ... 456", "en", "s"), (1002, "", None, "s"), (None, prose(rng, "de", 30), None, "s")]
    got = {r["doc_id"]: r for r in languages(table(spark, rows)).collect()}
    held = [(r, lang) for i, t, lang, _ in rows[:400] if (r := got[i])["held_out"]]
    assert len(held) > 50 and sum(r["lang_pred"] == lang for r, lang in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "de"]
    assert got[1000]["score"] == 0 and got[None]["held_out"] is False


def test_letters_only_and_rows_of_one_turn(spark):
    assert langid.letter_words("x² ½ Ⅷ ① 3a é_b ªx") == ["x", "a", "é", "b", "ªx"] and langid.letter_words("² ½ Ⅷ") == []
    rows = [(i, prose(random.Random(i), "en", 20), "en", "s") for i in range(20)] + [(77, "² ½ Ⅷ ① 12", None, "s")]
    assert [r["lang_pred"] for r in languages(table(spark, rows)).where("doc_id = 77").collect()] == ["und"]
    same = [("der die das", "de", 999_999)] * 5000 + [("the of and", "en", 5)]
    assert set(learn(spark.createDataFrame(same, "text string, lang string, turn long")).languages) == {"de", "en"}


def test_posteriors_equal_all_label_sequences():
    rng = np.random.default_rng(11)
    for labels in (1, 2, 3):
        lengths = np.array([3, 1, 6, 2, 4])
        evidence, switch = rng.normal(size=(int(lengths.sum()), labels)) * 2, rng.normal(size=(labels, labels))
        got, pairs = langid.posteriors(evidence, switch, lengths)
        want, both = np.zeros_like(evidence), np.zeros((labels, labels))
        for start, n in zip(np.cumsum(lengths) - lengths, lengths):
            paths = list(itertools.product(range(labels), repeat=int(n)))
            weight = np.exp([sum(evidence[start + t, y] for t, y in enumerate(p)) + sum(switch[a, b] for a, b in zip(p, p[1:])) for p in paths])
            for p, w in zip(paths, weight / weight.sum()):
                for t, y in enumerate(p):
                    want[start + t, y] += w
                for a, b in zip(p, p[1:]):
                    both[a, b] += w
        assert np.allclose(got, want) and np.allclose(pairs, both)


def test_words_of_code_switched_text(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, lang := rng.choice(list(VOCABULARY)), 40), lang, "s") for i in range(200)]
    field = learned_from(table(spark, rows))
    found, scores = label_texts(field, [prose(rng, "en", 30) + " " + prose(rng, "fr", 10), prose(rng, "fr", 30) + "\n" + prose(rng, "de", 12), None])
    assert found == ["en", "fr", "und"] and 0.6 < scores[0] < 0.95 and scores[2] == 0


def test_language_without_labels_or_rows(spark):
    rows = [(1, "some words", None, "s"), (1, "some words", None, "s")]
    assert [tuple(r) for r in languages(table(spark, rows)).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
    assert languages(table(spark, rows).limit(0)).count() == 0


def test_long_documents_leave_the_sample_to_others(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 2000)
    monkeypatch.setattr(langid.Field, "fit", lambda self, texts, seed: taken.extend(texts) or self)
    short = [f"word{i} and so on" for i in range(40)]
    rows = [("first", "en", 1), ("long " * 500, "en", 2), ("less " * 100, "en", 3)] + [(t, "en", 4 + i) for i, t in enumerate(short)]
    rows += [("lang " * 900, "de", 1), ("lang " * 700, "de", 2)]
    learn(spark.createDataFrame(rows, "text string, lang string, turn long"))
    assert sorted(t for t, k in taken if k == 1) == sorted(["first", "less " * 100, *short])
    assert [t for t, k in taken if k == 0] == ["lang " * 700]
