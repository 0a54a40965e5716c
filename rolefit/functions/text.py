"""Text column expressions: cleaning, contact fields, skills, names, file names.

All of them are built-in JVM expressions. Patterns carry ``(?U)`` so that digits and white space
mean the same as in Unicode-aware engines (a no-break space inside a phone number, for example).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Must equal the published vocabulary and patterns for equal results.
SKILL_KEYWORDS = (
    "python", "java", "javascript", "typescript", "c++", "c#", "sql",
    "react", "angular", "vue", "node.js", "django", "flask", "fastapi",
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform",
    "machine learning", "deep learning", "data science", "ai",
    "project management", "agile", "scrum", "communication",
    "leadership", "teamwork", "problem solving",
    "excel", "tableau", "power bi", "git", "ci/cd",
)
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"(\+\d{1,3}[-.\s]?)?(\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
YEARS_PATTERN = r"(\d+)\+?\s*years?"

_NO_STRINGS = "array<string>"


def strip_ws(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def match_key(c: Column) -> Column:
    """Comparison form of an e-mail address or name; NULL when missing."""
    return F.when(c != "", strip_ws(F.lower(c)))


def normalize_phone(c: Column) -> Column:
    """Digits only, the last ten when there are at least ten; NULL without digits."""
    digits = F.regexp_replace(c, r"(?U)\D", "")
    return blank_to_null(F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits))


def first_email(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, EMAIL_PATTERN, 0))


def first_phone(text: Column) -> Column:
    """First phone-like run with at least ten digits."""
    runs = F.regexp_extract_all(text, F.lit("(?U)" + PHONE_PATTERN), F.lit(0))
    long_enough = F.filter(runs, lambda r: F.length(F.regexp_replace(r, r"(?U)\D", "")) >= 10)
    return strip_ws(F.get(long_enough, 0))


def experience_years(text: Column) -> Column:
    """Largest number of years named in the text, 0 when there is none."""
    numbers = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + YEARS_PATTERN), F.lit(1))
    return F.coalesce(F.array_max(F.transform(numbers, lambda n: n.try_cast("int"))), F.lit(0))


def skill_list(c: Column) -> Column:
    """Comma- or newline-separated text to an array of stripped, non-empty items."""
    items = F.transform(F.split(F.replace(c, F.lit("\n"), F.lit(",")), ","), strip_ws)
    return F.coalesce(F.filter(items, lambda s: s != ""), F.array().cast(_NO_STRINGS))


def skill_set(c: Column) -> Column:
    """Lower-cased distinct skills, sorted, for comparison."""
    return F.sort_array(F.array_distinct(F.transform(skill_list(c), F.lower)))


def keyword_skills(text: Column, word_boundary: bool = False) -> Column:
    """Vocabulary skills found in ``text``, in display form.

    The default is plain containment ("java" is found in "javascript"); ``word_boundary``
    asks for whole words instead. One flag per term keeps this inside generated code.
    """
    lowered = F.lower(text)

    def found(term: str) -> Column:
        if word_boundary:
            escaped = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in term)
            return lowered.rlike(rf"(?<![a-z0-9]){escaped}(?![a-z0-9])")
        return F.contains(lowered, F.lit(term))

    flags = [F.when(found(term), F.lit(term.title())) for term in SKILL_KEYWORDS]
    # array_except drops the NULLs; unlike array_compact it is no lambda, which would be interpreted
    return F.array_except(F.array(*flags), F.array(F.lit(None).cast("string")))


def vacancy_skills(required_skills: Column, description: Column) -> Column:
    """Skills a vacancy asks for: the listed ones and those its description names."""
    return F.sort_array(F.array_distinct(F.concat(skill_list(required_skills), keyword_skills(description))))


def screening_text(text_content: Column, summary: Column) -> Column:
    """Text a candidate is screened on: full text, else summary."""
    return F.coalesce(blank_to_null(text_content), blank_to_null(summary), F.lit(""))


def profile_text(*parts: Column) -> Column:
    """Non-empty parts joined by a blank."""
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts])


def with_text_flags(candidates: DataFrame) -> DataFrame:
    """``has_text`` (something to screen on) and ``has_profile`` (something to recommend by), to be stored beside
    the vector so that the texts, by far the widest columns, need not be read again."""
    of = lambda c: F.col(c) if c in candidates.columns else F.lit(None).cast("string")
    flags = {
        "has_text": screening_text(of("text_content"), of("summary")) != "",
        "has_profile": strip_ws(profile_text(*[of(c) for c in ("text_content", "summary", "experience", "skills")])) != "",
    }
    return candidates.withColumns({n: c for n, c in flags.items() if n not in candidates.columns})


def title_case(c: Column) -> Column:
    """Capitalise every run of letters ("node.js" becomes "Node.Js")."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), ""
    )


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_extension(name: Column) -> Column:
    """Last extension with its dot, empty when there is none."""
    return F.regexp_extract(name, r".(\.[^.]*)$", 1)


def name_from_file(name: Column) -> Column:
    """Readable name from a file name: "jane_doe.pdf" becomes "Jane Doe"."""
    return title_case(F.replace(file_stem(name), F.lit("_"), F.lit(" ")))


def stored_file_name(name: Column, as_of: Column, *source: Column) -> Column:
    """Letters, digits, blanks, "-" and "_" of the stem, a time stamp, and the extension.

    Files of one run share the time stamp; a short digest of ``source`` (where the file comes from) tells them apart.
    """
    mark = [F.lit("_"), F.substring(F.md5(F.concat_ws("|", *source)), 1, 8)] if source else []
    safe = strip_ws(F.regexp_replace(file_stem(name), r"[^\p{L}\p{N} _-]", ""))
    return F.concat(safe, F.lit("_"), F.date_format(as_of, "yyyyMMdd_HHmmss"), *mark, file_extension(name))


def display_list(items: Column) -> Column:
    """Array to "a, b"; NULL when empty."""
    return blank_to_null(F.array_join(items, ", "))
