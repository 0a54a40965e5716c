"""Mail collection: attachments to store, the mail log, and its summary."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.functions import text as tx
from rolefit.sources.mail import parse_mails


class MailRun(NamedTuple):
    attachments: DataFrame
    log: DataFrame


def collect_mail(files: DataFrame, as_of: Column) -> MailRun:
    """Resume attachments with their storage names, and one log row per mail.

    Counting happens on each mail's own array, so the log needs no shuffle.
    """
    mails = parse_mails(files)
    attachments = mails.select("email_id", "subject", "sender", F.posexplode("attachments").alias("position", "file")).select(
        "email_id", "subject", "sender", "position", F.col("file.filename").alias("filename"),
        tx.stored_file_name(F.col("file.filename"), as_of, F.col("email_id"), F.col("position")).alias("stored_name"), F.col("file.content").alias("content"))
    saved = F.size(F.filter("attachments", lambda a: a["content"].isNotNull()))
    log = mails.select(
        "email_id", "subject",
        "sender",
        (F.size("attachments") > 0).alias("has_attachment"), F.size("attachments").alias("attachments_count"),
        saved.alias("resumes_extracted"),
        F.when(F.col("error_message").isNull(), "processed").otherwise("failed").alias("processing_status"),
        "error_message", as_of.alias("fetched_at"))
    return MailRun(attachments, log)
