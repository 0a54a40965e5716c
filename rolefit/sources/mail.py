"""Mail files to messages with their resume attachments, one Spark row per mail."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.header import decode_header

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rolefit.sources.documents import DOCUMENT_SUFFIXES

MAIL_SCHEMA = (
    "email_id string, subject string, sender string, "
    "attachments array<struct<filename: string, content: binary>>, error_message string"
)


def read_mails(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every ``.eml`` file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml")
    return files.load(folder).select("path", "content")


def _header(value: str | None) -> str:
    """Readable header: encoded words decoded and joined."""
    if not value:
        return ""
    return "".join(
        part.decode(charset or "utf-8", errors="ignore") if isinstance(part, bytes) else str(part)
        for part, charset in decode_header(value)
    )


def _message(path: str, content: bytes) -> tuple:
    try:
        mail = email.message_from_bytes(content)
        found = [
            {"filename": part.get_filename(), "content": part.get_payload(decode=True)}
            for part in mail.walk()
            if part.get_content_disposition() == "attachment"
            and (part.get_filename() or "").lower().endswith(DOCUMENT_SUFFIXES)
        ]
        return path, _header(mail.get("Subject")), _header(mail.get("From")), found, None
    except Exception as error:  # noqa: BLE001 - one bad mail must not fail the job
        return path, "", "", [], f"unreadable mail: {type(error).__name__}"


def parse_mails(files: DataFrame) -> DataFrame:
    """One row per mail with decoded headers and the attachments that are resume files."""
    names = ["email_id", "subject", "sender", "attachments", "error_message"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_message(p, c) for p, c in zip(frame["path"], frame["content"])], columns=names)

    return files.select("path", "content").mapInPandas(run, MAIL_SCHEMA)
