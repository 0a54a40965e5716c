import datetime
import random
from email.message import EmailMessage

from pyspark.sql import functions as F

from rolefit.catalog.sample_files import make_docx
from rolefit.functions.replies import repaired_json, with_reply_fields
from rolefit.operators import reports
from rolefit.plans.ingest import ingest_files, parse_candidates
from rolefit.plans.mail import collect_mail
from rolefit.sources.documents import extract_text, read_documents
from rolefit.sources.mail import read_mails
from rolefit.streaming.ingest import batch_writer, start_ingest
from rolefit.streaming.trends import daily_counts, start_daily

STORED = "id long, name string, email string, phone string"


def at():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 12:00:00'")


def test_documents_and_ingest(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "jane_doe.docx").write_bytes(make_docx("jane@x.org\n12+ years & more"))
    (box / "jane_copy.docx").write_bytes(make_docx("again jane@x.org"))
    (box / "bad.docx").write_bytes(b"not a zip")
    (box / "scan.PDF").write_bytes(b"%PDF")
    (box / "note.txt").write_bytes(b"hello")
    files = read_documents(spark, str(box))
    texts = {r["source_file"]: r for r in extract_text(files).collect()}
    assert texts["jane_doe.docx"]["text_content"] == "jane@x.org\n12+ years & more"
    assert texts["bad.docx"]["error_message"].startswith("unreadable") and texts["bad.docx"]["text_content"] == ""
    assert "unsupported" in texts["note.txt"]["error_message"] and texts["scan.PDF"]["text_content"] == ""
    stored = spark.createDataFrame([(40, "Old Hand", "old@x.org", None)], STORED)
    people, failed = ingest_files(files, stored, "upload", at())
    got = {r["source_file"]: r for r in people.collect()}
    assert failed.count() == 3 and set(got) == {"jane_doe.docx", "jane_copy.docx"}
    first, second = sorted(got.values(), key=lambda r: r["id"])
    assert (first["id"], second["id"]) == (41, 42) and not first["is_duplicate"]
    assert (second["duplicate_of"], second["duplicate_confidence"]) == (41, 1.0)
    assert got["jane_doe.docx"]["name"] == "Jane Doe" and got["jane_doe.docx"]["experience_years"] == 12
    assert bytes(got["jane_doe.docx"]["resume_file"]) == (box / "jane_doe.docx").read_bytes()
    decided = people.select("is_duplicate", F.lit(None).cast("string").alias("error_message")).unionByName(
        failed.select(F.lit(None).cast("boolean").alias("is_duplicate"), "error_message"))
    assert tuple(reports.ingest_summary(decided).first()) == (2, 3, 1)


def test_mail(spark, tmp_path):
    mail = EmailMessage()
    mail["Subject"] = "Bewerbung für Köln " + "x" * 300
    mail["From"] = "a@x.org"
    mail.set_content("hello")
    for name in ("my cv!.pdf", "x.PNG", "b.DOC"):
        mail.add_attachment(b"data " + name.encode(), maintype="application", subtype="octet-stream", filename=name)
    (tmp_path / "one.eml").write_bytes(mail.as_bytes())
    (tmp_path / "two.eml").write_bytes(b"Subject: none\n\nplain")
    (tmp_path / "skip.txt").write_bytes(b"no mail")
    run = collect_mail(read_mails(spark, str(tmp_path)), at())
    got = {r["filename"]: r for r in run.attachments.collect()}
    assert set(got) == {"my cv!.pdf", "b.DOC"} and bytes(got["b.DOC"]["content"]) == b"data b.DOC"
    assert got["my cv!.pdf"]["stored_name"].startswith("my cv_20240131_120000_") and got["my cv!.pdf"]["stored_name"].endswith(".pdf")
    log = {r["email_id"].rsplit("/", 1)[-1]: r for r in run.log.collect()}
    assert (log["one.eml"]["attachments_count"], log["one.eml"]["resumes_extracted"], log["two.eml"]["has_attachment"]) == (2, 2, False)
    assert log["one.eml"]["subject"].startswith("Bewerbung für Köln x") and len(log["one.eml"]["subject"]) > 255
    assert tuple(reports.mail_summary(run.log).first()) == (2, 2, 2, 0)


def test_reply_repair_and_fields(one, spark):
    fix = lambda raw: one(repaired_json(F.col("c")), c=raw)
    assert fix('x {"a": 1, } y') == '{"a": 1}'
    assert fix("no object") is None and fix("} {") is None and fix(None) is None
    assert fix('{"a": "ﬁt – (cid:7)•\x01 \\d \\n"}') == '{"a": "fit - - \\\\d \\n"}'
    raw = ('{"name": " Jo ", "email": "", "phone": 0, "skills": ["a", 2, null, true], "experience": {"z": 1, "a": "b"}, '
           '"summary": 5, "projects": true, "others": false, "education": []}')
    fields = with_reply_fields(spark.createDataFrame([(raw,)], "c string"), "c", "f").first()["f"].asDict()
    assert fields == {"name": "Jo", "email": None, "phone": None, "summary": "5", "education": None, "experience": "z: 1\na: b",
                      "skills": "a\n2\nNone\nTrue", "projects": "True", "certifications": None, "others": None}
    texts = spark.createDataFrame([("x_y.pdf", "call (499) 555-6503", '{"name": "Unknown Candidate", "email": "m@x.org"}'),
                                   ("z.pdf", " \n", None)], "source_file string, text_content string, reply string")
    (row,) = parse_candidates(texts).collect()
    assert (row["name"], row["email"], row["phone"]) == ("X Y", "m@x.org", "(499) 555-6503")


def test_stream_ingest_resumes_and_repeats(spark, tmp_path):
    source, table, index, progress = (str(tmp_path / d) for d in ("source", "table", "index", "progress"))
    schema = "id long, source_file string, text_content string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: start_ingest(spark.readStream.schema(schema).parquet(source), table, index, progress, "email", at()).awaitTermination()
    read = lambda: {r["id"]: (r["is_duplicate"], r["duplicate_of"]) for r in spark.read.parquet(table).collect()}
    put([(1, "aa_bb.docx", "one@x.org"), (2, "cc_dd.docx", "two@x.org"), (3, "bb_aa.docx", "three@x.org")])
    run()
    put([(4, "zz_yy.docx", "two@x.org"), (5, "qq_ww.docx", "five@x.org")])
    run()
    want = {1: (False, None), 2: (False, None), 3: (True, 1), 4: (True, 2), 5: (False, None)}
    assert read() == want
    again = spark.createDataFrame([(4, "zz_yy.docx", "two@x.org"), (5, "qq_ww.docx", "five@x.org")], schema)
    batch_writer(table, index, "email", at())(again, 1)  # the batch is delivered a second time
    assert read() == want


def test_daily_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(20000)), round(rng.random(), 2)) for _ in range(300)]
    source, table = str(tmp_path / "s"), str(tmp_path / "t")
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    df.repartition(3).write.parquet(source)
    start_daily(daily_counts(spark.readStream.schema(df.schema).parquet(source), "ts", "value"), table, str(tmp_path / "p")).awaitTermination()
    got = {r["day"]: r["rows"] for r in spark.read.parquet(table).collect()}
    want = {}
    for at, _ in rows:
        want[at.date()] = want.get(at.date(), 0) + 1
    assert got == want
