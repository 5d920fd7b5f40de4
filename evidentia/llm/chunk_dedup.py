"""Substring dedup by content-defined chunks.

A gear rolling hash over the UTF-8 bytes cuts each text where the hash of the
last 16 bytes falls under a limit, so an insertion moves only the cuts next to
it. Chunks (32 bytes on average) are compared by digest. A chunk that occurs in
two or more documents is kept in the one with the smallest id and is a
duplicate in the others; one that occurs in a text more than once is kept where
it stands first and is a duplicate further on. Neighbouring duplicates of a document are merged, and
runs of ``MIN_WORDS`` words or more are the repeated spans.

A passage shared by two documents is cut alike but for the chunks at its two
ends, so a span is shorter than the passage by one chunk or so at either end;
``MIN_WORDS`` leaves room for that in passages of over 50 words.

The chunk list of a document is one row of a staged table; the exploded chunks
are aggregated to (digest, smallest id, largest id) with partial sums before
the shuffle. The repeated digests are staged, so that the join that finds their
occurrences reads two exchanges and a digest that a third of all documents hold
is split by adaptive execution. Repeats inside a text are found where it is cut,
without a shuffle. A document's duplicates are gathered in one
row, bounded by its own length.

Defined results: null and empty texts have no chunks; rows with equal ids are
one document (they are never duplicates of one another) but each row's spans
are its own; a row without an id is a duplicate of any document that has one, and
is not named where it keeps the first of its own repeats;
texts are chunked whole; an empty table gives an empty result. Columns other
than the two named are not read by ``repeated_spans``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import arrow_map, by_value, stage

by_value(__name__)

AVERAGE, LARGEST, MIN_WORDS = 32, 256, 16
WINDOW_STEPS = (1, 2, 4, 8)   # doubling: a hash over 16 bytes
# one pseudo-random number for each byte value
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Sum of GEAR[data[i - k]] << k over the last 16 bytes, at every byte."""
    h = GEAR[data]
    for w in WINDOW_STEPS:
        if len(h) > w:
            more = h[:-w] << np.uint32(w)
            h = h.copy()
            h[w:] += more
    return h


def chunk(text: str) -> tuple[list[int], list[int], list[int]]:
    """Per chunk its digest, its length in code points and how many words begin in it."""
    if not text:
        return [], [], []
    raw = text.encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    head = np.ones(len(data) + 1, bool)      # a byte that begins a character
    head[:-1] = (data & 0xC0) != 0x80
    cut = gear_hash(data) < np.uint32((1 << 32) // AVERAGE)
    ends = np.nonzero(cut & head[1:])[0] + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    begins = np.concatenate(([0], ends[:-1]))
    for i in np.nonzero(ends - begins > LARGEST)[0][::-1]:  # rare: no cut for long
        extra = []
        at = int(begins[i]) + LARGEST
        while at < ends[i]:
            at -= int(np.argmax(head[at::-1]))
            extra.append(at)
            at += LARGEST
        ends = np.insert(ends, i, extra)
    begins = np.concatenate(([0], ends[:-1]))
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    words = np.add.reduceat(starts, begins, dtype=np.int64)
    chars = np.add.reduceat(head[:-1], begins, dtype=np.int64)
    digests = [xxhash.xxh3_64_intdigest(raw[b:e]) - (1 << 63) for b, e in zip(begins.tolist(), ends.tolist())]
    return digests, chars.tolist(), words.tolist()


def repeats(digests: list[int]) -> list[int]:
    """Numbers of the chunks that the text has had before."""
    seen: set[int] = set()
    return [i for i, d in enumerate(digests) if d in seen or seen.add(d)]


def _chunked(docs: DataFrame) -> DataFrame:
    def run(b: pa.RecordBatch) -> list[pa.Array]:
        rows = [(*c, repeats(c[0])) for c in map(chunk, b.column("text").to_pylist())]
        return [pa.array(c, pa.list_(k)) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    return arrow_map(docs, run, "digests array<long>, chars array<int>, words array<int>, repeats array<int>",
                     keep=[c for c in docs.columns if c != "text"])


def _spans(rows: DataFrame, min_words: int) -> DataFrame:
    """row, doc_id, spans (first, last excluded, n_words, first_doc_ids) of staged chunk lists."""
    places = rows.select("row", "doc_id", F.posexplode(F.arrays_zip("digests", "chars", "words")).alias("seq", "c"),
                         "chars").select("row", "doc_id", "seq", F.col("c.digests").alias("digest"),
                                         F.col("c.chars").alias("n"), F.col("c.words").alias("words"))
    seen = rows.select("doc_id", F.explode("digests").alias("digest")).groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    shared = stage(seen.filter((F.col("first_id") < F.col("last_id")) | (F.col("unnamed") > 0)).filter(
        F.col("first_id").isNotNull()).select(F.col("digest").alias("s_digest"), "first_id"), "shared-chunks")
    again = F.coalesce(F.col("doc_id") != F.col("first_id"), F.lit(True))
    found = places.join(shared, F.col("digest") == F.col("s_digest")).filter(again)
    lists = found.groupBy("row").agg(F.collect_list(F.struct("seq", "words", "first_id")).alias("found"))
    # the words of its repeats go along with a text, so that those found in no other document have theirs
    own = F.transform("repeats", lambda i: F.struct(i.alias("seq"), F.get("words", i).alias("words")))
    whole = rows.select("row", "doc_id", "chars", own.alias("own")).join(lists, "row", "left").filter(
        F.col("found").isNotNull() | (F.size("own") > 0))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = f"spans array<struct<first: long, last: long, n_words: long, first_doc_ids: array<{id_type}>>>"

    def merge(b: pa.RecordBatch) -> list[pa.Array]:
        rows_out = []
        for doc_id, chars, found, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "chars", "found", "own"))):
            found = found or []
            shared = {f["seq"] for f in found}
            found += [{**f, "first_id": doc_id} for f in own if f["seq"] not in shared]
            ends = np.concatenate(([0], np.cumsum(chars))).tolist()
            spans, run = [], []
            for f in [*sorted(found, key=lambda f: f["seq"]), None]:
                if run and (f is None or f["seq"] != run[-1]["seq"] + 1):
                    n = sum(x["words"] for x in run)
                    if n >= min_words:
                        spans.append({"first": ends[run[0]["seq"]], "last": ends[run[-1]["seq"] + 1], "n_words": n,
                                      "first_doc_ids": sorted({x["first_id"] for x in run} - {None})})
                    run = []
                run.append(f)
            rows_out.append(spans)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("n_words", pa.int64()),
                                   ("first_doc_ids", pa.list_(b.schema.field("doc_id").type))]))
        return [pa.array(rows_out, kind)]
    return arrow_map(whole, merge, out, keep=["row", "doc_id"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (code points, end exclusive), n_words, first_doc_ids: one
    row per repeated span, with the documents that keep its chunks."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(_chunked(named).withColumn("row", F.monotonically_increasing_id()), "chunks")
    return _spans(rows, min_words).select("doc_id", F.inline("spans")).select(
        "doc_id", F.col("first").alias("start"), F.col("last").alias("end"), "n_words", "first_doc_ids")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of the text; columns unchanged."""
    whole = stage(docs.select(F.struct(*docs.columns).alias("doc")).withColumn(
        "row", F.monotonically_increasing_id()), "documents")
    named = whole.select("row", F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{text_col}").alias("text"))
    spans = _spans(stage(_chunked(named), "chunks"), min_words).filter(F.size("spans") > 0).select("row", "spans")
    text = F.col(f"doc.{text_col}")
    # what lies before each span, and after the last one
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.last"))
    end = F.concat(F.col("spans.first"), F.array(F.length(text).cast("long")))
    left = F.array_join(F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda p: F.substring(
        text, (p["b"] + 1).cast("int"), (p["e"] - p["b"]).cast("int"))), "")
    out = whole.join(spans, "row", "left")
    return out.select(*[(F.when(F.col("spans").isNotNull(), left).otherwise(text) if c == text_col
                         else F.col(f"doc.{c}")).alias(c) for c in docs.columns])
