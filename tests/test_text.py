import pytest
from pyspark.sql import functions as F

from rolefit.functions import text as tx

@pytest.mark.parametrize("raw, key", [
    ("+1-555-123-4567", "5551234567"), ("12-34", "1234"), ("abc", None), ("", None), (None, None)])
def test_normalize_phone(one, raw, key):
    assert one(tx.normalize_phone(F.col("c")), c=raw) == key


@pytest.mark.parametrize("raw, phone", [
    ("555-1234 then (499) 555-6503", "(499) 555-6503"), ("call +44 123 456 7890 now", "+44 123 456 7890"),
    ("only 555-1234", None), ("499 555 6503", "499 555 6503")])
def test_first_phone(one, raw, phone):
    assert one(tx.first_phone(F.col("c")), c=raw) == phone


def test_first_email(one):
    assert one(tx.first_email(F.col("c")), c="x a.b+c@d-e.co.uk, z@y.org") == "a.b+c@d-e.co.uk"
    assert one(tx.first_email(F.col("c")), c="nobody at home") is None


@pytest.mark.parametrize("raw, years", [
    ("3 years, 10+ years", 10), ("no years", 0), ("1 YEAR", 1), ("99999999999 years and 4 years", 4), (None, 0)])
def test_experience_years(one, raw, years):
    assert one(tx.experience_years(F.col("c")), c=raw) == years


def test_skills(one):
    assert one(tx.skill_list(F.col("c")), c=" Python,\nAWS , ,\tC++\n") == ["Python", "AWS", "C++"]
    assert one(tx.skill_list(F.col("c")), c=None) == []
    assert one(tx.keyword_skills(F.col("c")), c="JavaScript email") == ["Java", "Javascript", "Ai"]
    assert one(tx.keyword_skills(F.col("c"), word_boundary=True), c="JavaScript email, C++ and node.js") == ["Javascript", "C++", "Node.Js"]
    assert one(tx.keyword_skills(F.col("c")), c=None) == []
    found = one(tx.vacancy_skills(F.lit("AWS, sql"), F.col("c")), c="aws and CI/CD")
    assert found == ["AWS", "Aws", "Ci/Cd", "sql"]


def test_white_space_and_names(one):
    assert one(tx.strip_ws(F.col("c")), c="\n\t a b  ") == "a b"
    assert one(tx.match_key(F.col("c")), c="  Jo@X.org\n") == "jo@x.org"
    assert one(tx.title_case(F.col("c")), c="node.js ci/cd o'NEIL") == "node.js ci/cd o'neil".title()
    assert one(tx.name_from_file(F.col("c")), c="jane_doe.pdf") == "Jane Doe"
    assert one(tx.base_name(F.col("c")), c="file:/in/a b.docx") == "a b.docx"


def test_file_name_and_truncation(one):
    at = F.expr("TIMESTAMP_NTZ '2024-01-31 12:00:00'")
    assert one(tx.stored_file_name(F.col("c"), at), c="my cv!.pdf") == "my cv_20240131_120000.pdf"


def test_texts(one):
    assert one(tx.screening_text(F.lit(""), F.col("c")), c="s") == "s"
    assert one(tx.screening_text(F.lit(None).cast("string"), F.col("c")), c=None) == ""
    assert one(tx.profile_text(F.lit("a"), F.lit(""), F.col("c")), c="b") == "a b"
