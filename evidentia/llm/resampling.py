"""Importance resampling of documents toward a target distribution.

A text is lower-cased (A-Z), its separators are collapsed to single spaces, and
one overlapped regex scan with boundary lookarounds runs over it: each match
starts at a word and captures the spans of the runs of one, two and three words
that begin there. A span's CRC-32 modulo ``BUCKETS`` is the feature's bucket;
the longer spans go on from the checksum of the shorter ones.

The scan is done once. A document goes on as its buckets with their counts (at
most ``BUCKETS`` entries, however long its text), staged with its numbers; the
counts of all documents and of all target texts are sums over these, 10,000
numbers. Their smoothed log ratio is a bucket's gain, the sum of gains a
document's weight, and weight plus Gumbel noise from the id's hash its score:
taking the highest scores draws without replacement in proportion to exp(weight).

Ranks come from one sort of narrow rows (numbers, no texts) by ranges of score,
written with each partition's order, and the partitions' sizes: no window over
all rows, nothing of the rows on the driver.

Defined results: null, empty and word-less texts have no features, weight 0, and
are never drawn; a null id is hashed as an empty one and counts as the largest
id; rows with equal ids are rows of their own, ties of score and id are ordered
by a row number given at the scan; an empty target gives every bucket the same
smoothing; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import by_value, release, stage

by_value(__name__)

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
_HELD = 1 << 18                  # checksums of one text that are held as Python numbers

# Separators are the ASCII characters that are neither digits nor letters.
_SPACED = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))
# At the start of a word: that word, and the next ones with the space before them.
NGRAMS = regex.compile(rb"(?<![^ ])(?=([^ ]++)( [^ ]++)?+( [^ ]++)?+)")


def collapsed(text: str | None) -> bytes:
    """Lower-cased UTF-8 words with single spaces between them."""
    return b" ".join(text.encode("utf-8").lower().translate(_SPACED).split()) if text else b""


def features(text: str | None) -> tuple[int, np.ndarray]:
    """(number of words, buckets of all runs of one to three words)."""
    crc, words, held, done = zlib.crc32, 0, [], []
    for m in NGRAMS.finditer(collapsed(text), overlapped=True):
        one, two, three = m.groups()
        words += 1
        code = crc(one)
        held.append(code)
        if two:
            code = crc(two, code)
            held.append(code)
            if three:
                held.append(crc(three, code))
        if len(held) >= _HELD:
            done.append((np.array(held, np.uint32) % BUCKETS).astype(np.uint16))
            held = []
    done.append((np.array(held, np.uint32) % BUCKETS).astype(np.uint16))
    return words, np.concatenate(done)


def scan(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, n_words, n_features, and the distinct buckets (two bytes
    each) with their counts (four) of the column ``text``."""
    schema = T.StructType([*(docs.schema[k] for k in keep), *T._parse_datatype_string(
        "n_words long, n_features long, buckets binary, counts binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes, buckets, counts = [], [], [], []
            for text in b.column("text"):
                n, found = features(text.as_py())
                at, times = np.unique(found, return_counts=True)
                words.append(n)
                sizes.append(len(found))
                buckets.append(at.tobytes())
                counts.append(times.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=schema.names)
    return docs.mapInArrow(run, schema)


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def totals(scanned: DataFrame) -> np.ndarray:
    """Features of all rows in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            np.add.at(total, _joined(b.column("buckets"), np.uint16), _joined(b.column("counts"), np.uint32).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])
    got = scanned.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()                               # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to source share, per bucket."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(scanned: DataFrame, gain: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, n_words, n_features and weight: the gains of all features."""
    keep = (*keep, "n_words", "n_features")
    schema = T.StructType([*(scanned.schema[k] for k in keep), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) // 2 for x in b.column("buckets").to_pylist()], np.int64)
            parts = gain[_joined(b.column("buckets"), np.uint16)] * _joined(b.column("counts"), np.uint32).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(parts)))
            end = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(upto[end] - upto[end - sizes])],
                                             names=schema.names)
    return scanned.mapInArrow(run, schema)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): ``row`` numbers the rows as they are read."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def scored(rows: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """Staged (row, doc_id, n_words, n_features, weight, score) of (row, doc_id, text);
    ``target`` has a column text."""
    keep = ("row", "doc_id")
    scanned = stage(scan(rows, keep), "resampling-scan")
    gain = gains(totals(scanned), totals(scan(target.select("text"), ())))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    out = stage(weighed(scanned, gain, keep).withColumn("score", F.col("weight") + noise), "resampling-scored")
    release(scanned)
    return out


def drawing(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` of ``scored`` with ``rank``: 1, 2, 3 ... by falling score (ties to the
    smaller id) for the floor(percent * N / 100) best of the N documents of
    ``min_words`` words, else null."""
    fit = rows.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # monotonically_increasing_id is partition * 2**33 + place, and the ranges are in order
    placed = stage(fit.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), "resampling-sorted")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()       # a row per partition
    before, total = [], 0
    for name, n in sizes:
        before.append((name, total))
        total += n
    before = rows.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(before, "part").select(
        *rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionAll(rest)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document."""
    rows = scored(numbered(docs, id_col, text_col), target.select(F.col(target_col).alias("text")))
    return drawing(rows).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id",
         text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The drawn documents, with all their own columns unchanged."""
    whole = stage(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "resampling-docs")
    rows = whole.select("row", F.col("doc").getField(id_col).alias("doc_id"), F.col("doc").getField(text_col).alias("text"))
    ranked = drawing(scored(rows, target.select(F.col(target_col).alias("text"))), percent, min_words)
    return whole.join(ranked.filter("rank is not null").select("row"), "row", "left_semi").select("doc.*")
