"""Removal of repeated passages: every byte inside a string of ``span`` bytes that also starts in an earlier document.

Sorting all suffixes of a corpus at once is out of reach, and inserting a symbol per document and round would take as
many passes as the longest document has bytes. The collection is therefore first cut, without loss, into strings that
can only match each other:

1. Every window of ``span`` bytes has an anchor, the 16 bytes in it with the least hash (the first of them), which is a
   function of the window's bytes alone. Neighbouring windows with one anchor are a run. Runs whose anchor occurs in one
   text only can't repeat and go no further; a task settles anchors that occur in two of its own texts by itself, so a
   common passage asks once per task, not once per document.
2. The runs that are left become strings of at most 2 * span - 16 bytes around their anchor. Strings of one anchor meet
   in one task; if an anchor has very many, its windows are strings of their own, keyed by their bytes.
3. There the collection is built column by column, outwards from the anchor: each round inserts one symbol per string
   and updates the sorted order of the strings and where neighbours in that order stop having a common prefix (order and
   prefix classes, for the context to the right and, reversed, for the one to the left). Two windows are equal if
   they lie alike around the anchor and their left and right contexts fall in the same classes; the smallest document of
   each class comes back for every window.

Matches never cross documents. Copies of a text are settled by its key; only the first is searched for. Documents are
ordered by doc_id, an integer; a null id comes first. Texts are identified by 64-bit keys.

Defined results: null is an empty text; texts under ``span`` bytes lose nothing; documents with equal ids are not
earlier than each other; repeated rows get the same answer; no other columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import forget
from rolefit.llm.shingles import BASE, INVERSE, mixed, powers, text_bytes
from rolefit.session import write_stage

ANCHOR = 16
#: Bits of a position in the key that a window's least anchor is found by.
PLACE = np.uint64(28)
#: Text whose anchors a task settles at once, and text whose anchors are found at once.
SETTLED_BYTES, STEP_BYTES = 32 << 20, 4 << 20
#: Strings of one anchor above which its windows are keyed by their own bytes, and strings of one bucket.
CROWD, BUCKET = 20_000, 60_000
#: Text whose anchors are asked about in one bucket.
BUCKET_BYTES = 16 << 20
ASK, SHARED, TELL = 0, 1, 2


def gram_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])


def anchor_runs(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Anchor, row, first window, anchor's offset in it, and number of windows of each run."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < span:
        return none
    sums = gram_sums(data)
    grams = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(INVERSE, len(data) - ANCHOR + 1))
    key = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, wide = 1, span - ANCHOR + 1
    while width * 2 <= wide:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if wide > width:
        key = np.minimum(key[:width - wide], key[wide - width:])
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:len(key)]
    start = np.flatnonzero(np.arange(len(key)) + span <= ends[row + 1])
    if not len(start):
        return none
    row, at = row[start], (key[start] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return grams[at[first]].view(np.int64), row[first], start[first] - ends[row[first]], at[first] - start[first], count


def text_steps(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(text_bytes(part.column(column))[1])
    bucket = np.cumsum(sizes) // STEP_BYTES
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        yield part.slice(int(at[0]), len(at))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte planes apart so that high bytes and repeated numbers cost little."""
    parts = [struct.pack("<I", len(arrays))]
    for x in arrays:
        parts += [struct.pack("<2sI", x.dtype.str[1:].encode(), len(x)), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(value: bytes) -> list[np.ndarray]:
    data, arrays, at = zstandard.ZstdDecompressor().decompress(value), [], 4
    for _ in range(struct.unpack("<I", data[:4])[0]):
        kind, n = struct.unpack("<2sI", data[at:at + 6])
        width = int(kind[1:])
        planes = np.frombuffer(data, np.uint8, n * width, at + 6).reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).view(kind.decode()).ravel())
        at += 6 + n * width
    return arrays


def in_buckets(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The parts of the arrays by bucket, rows in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
    arrays = [x[order] for x in arrays]
    for low, high in zip(edges[:-1], edges[1:]):
        yield int(bucket[low]), [x[low:high] for x in arrays]


def shared_runs(texts: DataFrame, span: int, buckets: int) -> DataFrame:
    """(anchor, t, run) of the runs whose anchor occurs in two texts; ``texts``: t, text.

    ``run`` holds first window, offset and number of windows; ``anchor`` is a key of the anchor (two anchors may have
    one key, which lets a run through in vain but loses none). A task asks, in the bucket of the key, about the anchors
    that only one of its texts has; of anchors that more of its texts have it says so, and passes their runs on.
    """
    def settle(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, t, run = (np.concatenate(x) for x in zip(*held))
        anchor = anchor.view(np.uint64)
        bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        anchor = bucket << 32 | (anchor & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((run, t, anchor))
        anchor, t, run = anchor[order], t[order], run[order]
        new = np.ones(len(anchor), bool)  # copies of a text say the same
        new[1:] = (anchor[1:] != anchor[:-1]) | (t[1:] != t[:-1]) | (run[1:] != run[:-1])
        anchor, t, run = anchor[new], t[new], run[new]
        if not len(anchor):
            return
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(first, len(anchor)))
        several = t[first] != t[first + count - 1]
        known = np.repeat(several, count)
        told = anchor[first[several]]
        order = np.lexsort((run, t))
        anchor, t, run, known = anchor[order], t[order], run[order], known[order]
        ask = ~known
        rows = [(b, ASK, packed(*x)) for b, x in in_buckets(anchor[ask] >> 32, anchor[ask].astype(np.uint32), t[ask], run[ask])]
        rows += [(b, TELL, packed(*x)) for b, x in in_buckets(told >> 32, told.astype(np.uint32))]
        rows += [(b, SHARED, packed(*x)) for b, x in in_buckets(t[known] % buckets, anchor[known], t[known], run[known])]
        for i in range(0, len(rows), 200):
            b, kinds, values = zip(*rows[i:i + 200])
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.binary())], names=["bucket", "kind", "value"])

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for part in parts:
            for step in text_steps(part, 1):
                data, ends = text_bytes(step.column(1))
                anchor, row, start, offset, count = anchor_runs(data, ends, span)
                held.append((anchor, step.column(0).to_numpy()[row], (start << 14) | (offset << 7) | count))
                weight += len(data)
                if weight >= SETTLED_BYTES:
                    yield from settle(held)
                    held, weight = [], 0
        if held:
            yield from settle(held)

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds = table.column("kind").to_pylist()
        values = [unpacked(v) for v in table.column("value").to_pylist()]
        none = [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        anchor, t, run = (np.concatenate(x) for x in zip(none, *[v for k, v in zip(kinds, values) if k == ASK]))
        told = np.concatenate([none[0], *[v[0] for k, v in zip(kinds, values) if k == TELL]])
        passed = [np.concatenate(x) for x in zip([none[1]] * 3, *[v for k, v in zip(kinds, values) if k == SHARED])]
        passed = passed or [none[1]] * 3
        order = np.lexsort((t, anchor))
        anchor, t, run = anchor[order], t[order], run[order]
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(anchor)))
        wanted = np.repeat((t[first] != t[first + count - 1]) if len(first) else np.zeros(0, bool), count) | np.isin(anchor, told)
        found = [np.concatenate(x) for x in zip((bucket << 32 | anchor[wanted].astype(np.int64), t[wanted], run[wanted]), passed)]
        return pa.table(dict(zip(("anchor", "t", "run"), found)))

    asked = texts.mapInArrow(scan, "bucket long, kind int, value binary")
    return asked.groupBy("bucket").applyInArrow(answer, "anchor long, t long, run long")


def string_ids(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Keys of the strings at these places, with the place of the anchor in them."""
    value = (sums[at + size] - sums[at]) * inverse[at] + (offset.astype(np.uint64) << np.uint64(20)) + size.astype(np.uint64)
    return mixed(mixed(value)).view(np.int64)


def strings_in(step: pa.RecordBatch, span: int):
    """Of the wanted runs of a step (t, doc, runs, text): key, id, row, first window, offset, windows, place, size."""
    data, ends = text_bytes(step.column(3))
    code = np.asarray(step.column(2).flatten(), np.int64)
    counts = np.diff(np.asarray(step.column(2).offsets))
    row = np.repeat(np.arange(len(counts)), counts)
    crowded, run = (code & 1).astype(bool), code >> 1
    first, offset, windows = run >> 14, (run >> 7) & 127, run & 127
    each = np.where(crowded, windows, 1)  # a window of a crowded anchor is a string of its own
    of = np.repeat(np.arange(len(run)), each)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    row, crowded, first, offset = row[of], crowded[of], first[of] + shift, offset[of] - shift
    windows = np.where(crowded, 1, windows[of])
    at, size = ends[row] + first, windows + span - 1
    sums, inverse = gram_sums(data), powers(INVERSE, len(data))
    begin, length = np.where(crowded, at, at + offset), np.where(crowded, span, ANCHOR)
    key = mixed((sums[begin + length] - sums[begin]) * inverse[begin]).view(np.int64)
    return key, string_ids(sums, inverse, at, size, offset), row, first, offset, windows, at, size, data


def places_of(texts: DataFrame, span: int) -> DataFrame:
    """Where strings stand: key, sid, t, doc, first window. ``texts``: t, doc, runs (run * 2 + crowded), text."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in text_steps(part, 3):
                key, sid, row, first, *_ = strings_in(step, span)
                t, doc = step.column(0).to_numpy()[row], step.column(1).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, sid, t, doc, first)], names=["key", "sid", "t", "doc", "first"])

    return texts.select("t", "doc", "runs", "text").mapInArrow(scan, "key long, sid long, t long, doc long, first long")


def strings_of(texts: DataFrame, span: int, buckets: int) -> DataFrame:
    """The strings themselves, by bucket of their key, equal ones of a step once: keys, first and last documents,
    offsets, numbers of windows and bytes, packed."""
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for step in text_steps(part, 3):
                key, sid, row, _, offset, windows, at, size, data = strings_in(step, span)
                doc = step.column(1).to_numpy()[row]
                _, place, group = np.unique(mixed(mixed(key.view(np.uint64)) ^ sid.view(np.uint64)), return_index=True, return_inverse=True)
                low, high = doc[place], doc[place]
                np.minimum.at(low, group, doc)
                np.maximum.at(high, group, doc)
                rows = []
                for b, (k, lo, hi, o, w, a, n) in in_buckets(key[place] % buckets, key[place], low, high, offset[place].astype(np.uint8),
                                                             windows[place].astype(np.uint8), at[place], size[place]):
                    start = np.cumsum(n) - n
                    flat = data[np.repeat(a - start, n) + np.arange(int(n.sum()))]
                    rows.append((b, packed(k, lo, hi, o, w, flat)))
                for i in range(0, len(rows), 500):
                    b, values = zip(*rows[i:i + 500])
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(values, pa.binary())], names=["bucket", "value"])

    return texts.select("t", "doc", "runs", "text").mapInArrow(scan, "bucket long, value binary")


def context_classes(key: np.ndarray, rows: np.ndarray, have: np.ndarray, depth: int) -> np.ndarray:
    """Classes of equal contexts of each length, built one column of symbols a round.

    ``rows[i, c]`` is symbol c of string i, counted outwards. Between rounds the strings stand in sorted order of what
    is inserted so far; a round sorts by the new symbol inside each class and marks where neighbours differ.
    """
    classes = np.empty((depth + 1, len(key)), np.int64)
    order = np.argsort(key, kind="stable")
    begins = np.append(True, key[order][1:] != key[order][:-1])
    for length in range(depth + 1):
        if length:
            symbol = np.where(have >= length, rows[:, length - 1].astype(np.int64) + 1, 0)
            before = classes[length - 1]
            order = order[np.argsort(before[order] * 257 + symbol[order], kind="stable")]
            begins = np.append(True, (before[order][1:] != before[order][:-1]) | (symbol[order][1:] != symbol[order][:-1]))
        classes[length, order] = np.cumsum(begins) - 1
    return classes


def first_documents(key: np.ndarray, low: np.ndarray, offset: np.ndarray, windows: np.ndarray, flat: np.ndarray,
                    span: int) -> np.ndarray:
    """Smallest document that has each window: a row per string, a column per window (others are undefined)."""
    around = span - ANCHOR
    size = windows + span - 1
    flat = np.append(flat, np.uint8(0))
    start = np.cumsum(size) - size
    anchor = start + offset
    reach = np.arange(1, around + 1)
    left_have, right_have = offset, size - offset - ANCHOR
    left = flat[np.where(reach <= left_have[:, None], anchor[:, None] - reach, len(flat) - 1)]
    right = flat[np.where(reach <= right_have[:, None], anchor[:, None] + ANCHOR - 1 + reach, len(flat) - 1)]
    left_class = context_classes(key, left, left_have, around)
    right_class = context_classes(key, right, right_have, around)
    found = np.zeros((len(key), int(windows.max(initial=1))), np.int64)
    for o in range(around + 1):
        j = offset - o  # the window in which the anchor stands o bytes from the start
        some = np.flatnonzero((j >= 0) & (j < windows))
        if not len(some):
            continue
        both = left_class[o][some] * (len(key) + 1) + right_class[around - o][some]
        _, group = np.unique(both, return_inverse=True)
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, low[some])
        found[some, j[some]] = least[group]
    return found


def repeated_windows(strings: DataFrame, span: int) -> DataFrame:
    """(key, sid, lengths, documents): for strings of which some window is in an earlier document, runs of windows and
    the first document that has them."""
    def search(table: pa.Table) -> pa.Table:
        key, low, high, offset, windows, flat = (np.concatenate(x) for x in zip(*map(unpacked, table.column("value").to_pylist())))
        offset, windows = offset.astype(np.int64), windows.astype(np.int64)
        found = first_documents(key, low, offset, windows, flat, span)
        inside = np.arange(found.shape[1]) < windows[:, None]
        some = np.flatnonzero((np.where(inside, found, np.iinfo(np.int64).max).min(1) < high))
        size = windows + span - 1
        sid = string_ids(gram_sums(flat), powers(INVERSE, len(flat)), (np.cumsum(size) - size)[some], size[some], offset[some])
        lengths, documents = [], []
        for i in some:
            row = found[i, :windows[i]]
            edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lengths.append(np.diff(np.append(edge, len(row))))
            documents.append(row[edge])
        return pa.table({"key": key[some], "sid": pa.array(sid, pa.int64()),
                         "lengths": pa.array(lengths, pa.list_(pa.int64())), "documents": pa.array(documents, pa.list_(pa.int64()))})

    found = strings.groupBy("bucket").applyInArrow(search, "key long, sid long, lengths array<long>, documents array<long>")
    return found.groupBy("key", "sid").agg(F.first("lengths").alias("lengths"), F.first("documents").alias("documents"))


def removed_ranges(docs: DataFrame, span: int) -> DataFrame:
    """(t, ranges): byte ranges [from, to) to remove from the first document of each text. ``docs``: doc, t, text."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = write_stage(shared_runs(docs.select("t", "text"), span, max(-(-size // BUCKET_BYTES), 2 * partitions)), "shared-runs")
    crowded = shared.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("anchor", F.lit(1).alias("crowd"))
    runs = shared.join(crowded, "anchor", "left").groupBy("t").agg(
        F.collect_set(F.col("run") * 2 + F.coalesce("crowd", F.lit(0))).alias("runs"))  # copies of a text say the same
    firsts = docs.groupBy("t").agg(F.min("doc").alias("doc"))
    wanted = write_stage(runs.join(firsts, "t"), "wanted-runs")
    forget(shared)
    n = wanted.agg(F.sum(F.size("runs"))).first()[0] or 0
    if not n:
        return docs.sparkSession.createDataFrame([], "t long, ranges array<struct<start:long,stop:long>>")
    texts = docs.join(wanted.withColumnRenamed("t", "t2").withColumnRenamed("doc", "doc2"),
                      (F.col("doc") == F.col("doc2")) & (F.col("t") == F.col("t2")))
    buckets = max(-(-n // BUCKET), 2 * partitions)
    found = repeated_windows(strings_of(texts, span, buckets), span)
    places = places_of(texts, span)
    ends = F.transform("lengths", lambda x, i: F.aggregate(F.slice("lengths", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    hits = places.join(found, ["key", "sid"]).withColumn("ends", ends).select(
        "t", "doc", "first", F.explode(F.arrays_zip("lengths", "documents", "ends")).alias("r")).where("r.documents < doc")
    ranges = hits.select("t", F.struct(
        (F.col("first") + F.col("r.ends") - F.col("r.lengths")).alias("start"),
        (F.col("first") + F.col("r.ends") - 1 + span).alias("stop")).alias("range"))
    found = write_stage(ranges.groupBy("t").agg(F.collect_set("range").alias("ranges")), "removed-ranges")
    forget(wanted)
    return found


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 50) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and ``kept``, the remaining bytes."""
    lowest = -(1 << 63)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("doc"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    searched = rows.where(F.octet_length("text") >= span)
    ranges = removed_ranges(searched, span)
    firsts = searched.groupBy("t").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("n"))
    known = firsts.join(ranges, "t", "left").where("n > 1 or ranges is not null").select("t", "lead", "ranges")
    joined = rows.join(known, "t", "left").select("id", F.col("doc") > F.col("lead"), "ranges", "text")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(copy, ranges, data: bytes):
            gone = np.zeros(len(data) + 1, np.int32)
            for r in [{"start": 0, "stop": len(data)}] if copy else ranges or []:
                gone[r["start"]] += 1
                gone[r["stop"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            return len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()

        for part in parts:
            for step in text_steps(part, 3):
                copies, ranges, texts = step.column(1), step.column(2), step.column(3)
                made = [one(c.as_py(), r.as_py(), x.as_py().encode()) if c.as_py() or r.is_valid else (len(b := x.as_py().encode()), 0, 0, b)
                        for c, r, x in zip(copies, ranges, texts)]
                size, lost, spans, kept = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [step.column(0), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, joined.select("id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary"))


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per document the bytes removed, their runs, and the digest of what is left."""
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))
