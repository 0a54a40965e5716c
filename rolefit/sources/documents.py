"""Documents in a folder to text, one Spark row per file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.functions import text as tx

DOCUMENT_SUFFIXES = (".pdf", ".docx", ".doc")  # fixed values: what counts as a resume file
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content")


def _paragraph(node: ElementTree.Element) -> str:
    out = []
    for part in node.iter():
        if part.tag == _W + "t":
            out.append(part.text or "")
        elif part.tag in _BREAKS:
            out.append(_BREAKS[part.tag])
    return "".join(out)


def docx_text(content: bytes) -> str:
    """Body paragraphs of a word-processing file, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
    return "\n".join(_paragraph(p) for p in body.findall(_W + "p"))


def _to_text(suffix: str, content: bytes | None) -> tuple[str, str | None]:
    if content is None:
        return "", "file not found"
    if suffix not in DOCUMENT_SUFFIXES:
        return "", f"unsupported file format: {suffix}"
    if suffix == ".pdf":
        return "", "no PDF text extractor is installed"
    try:
        return docx_text(content), None
    except Exception as error:  # noqa: BLE001 - one bad file must not fail the job
        return "", f"unreadable document: {type(error).__name__}"


def extract_text(files: DataFrame) -> DataFrame:
    """(path, source_file, text_content, error_message); unreadable and unsupported files give empty text."""
    wanted = files.select("path", F.lower(tx.file_extension(tx.base_name(F.col("path")))).alias("suffix"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [_to_text(s, c) for s, c in zip(frame["suffix"], frame["content"])]
            yield pd.DataFrame({
                "path": frame["path"], "text_content": [t for t, _ in texts], "error_message": [e for _, e in texts]})

    parsed = wanted.mapInPandas(run, "path string, text_content string, error_message string")
    return parsed.withColumn("source_file", tx.base_name(F.col("path")))
