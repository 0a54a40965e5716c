"""Documents, mails and replies that Spark derives from the test tables, to run the file readers on."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.catalog import sample_tables as st

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_docx(text: str) -> bytes:
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{_NS}"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


def raw_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged reply about every conversation turn."""
    words = st.first_words(F.replace("text", F.lit("\n"), F.lit(" ")))
    body = F.to_json(F.struct(
        F.concat(F.lit("  "), words, F.lit(" ")).alias("name"),
        F.lit("").alias("email"),
        F.struct(F.col("turn").alias("turn"), F.col("role").alias("role")).alias("experience"),
        F.array(F.lit("one"), F.lit("two"), F.col("role")).alias("skills"),
        F.col("conv_id").alias("projects")))
    broken = F.concat(F.lit("Answer • (cid:12): "), F.regexp_replace(body, r"\}$", " , }"), F.lit(" done –"))
    return st.table(spark, sf_dir, "conversations").select("conv_id", "turn", broken.alias("reply"))
