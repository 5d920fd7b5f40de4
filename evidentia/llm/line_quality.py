"""Quality rules: in-document measures, then cross-document line frequency.

Lines are normalised (case, digits, punctuation and blanks folded), hashed, and
counted per host (here: ``source``) over distinct documents. Lines found in
more documents than the limit are removed, and a document that loses half its
words or more, and keeps fewer than 10 of them or 30 %, is rejected as depleted.

Copies of a document must not make its own lines look like boilerplate, so
copies count once: a document stands for the hash of its whole normalised text (its
normalised lines in order), both where a line's documents and where
the host's documents are counted. Documents that differ in any line count each,
however many lines they share, so near copies with a word of their own count
each, too: by their lines they are no different from stubs of shared lines.

The limit is ``max_docs`` distinct documents, or ``max_share`` of the host's
distinct documents where that is more. Every line that has a word is counted. Short lines
(under ``SHORT_WORDS`` words and under ``SHORT_CHARS`` code points when
normalised) repeat by chance, so for them ``SHORT_SHARE`` takes the place of
``max_share``; a paragraph in a script without spaces is one word, but not short.
A line without letters stands for itself, digits and punctuation included.

Counts are combined before each shuffle and keyed by (host, line, document
mark), so neither a hot host nor a hot line meets in one task.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; the null source is a host of its own; rows with equal ids are
judged row by row, as each row carries its own lines; texts are read whole; an
empty table gives an empty result. Only the named columns are read by
``judge``; ``clean`` keeps all columns and their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import ASCII_LOWER, WORD, arrow_map, by_value, marked, release, stage

by_value(__name__)

MAX_DOCS, MAX_SHARE = 20, 0.001
SHORT_WORDS, SHORT_CHARS, SHORT_SHARE = 4, 12, 0.01
MIN_LEFT_WORDS, MIN_LEFT_SHARE = 10, 0.3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOL = re.compile(r"[#*$%&|<>]")
_FOLD = re.compile(r"[\W\d_]+")


def repeat_words(words: list[str]) -> int:
    """Words covered by a window of five words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    # exact window numbers: pair up, renumber, pair up again (2, 4, 5 words)
    def pair(x, y):
        return np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1]
    two = pair(a[:-1], a[1:])
    if two.max() + 1 == len(two):
        return 0
    four = pair(two[:-2], two[2:])
    if four.max() + 1 == len(four):
        return 0
    five = pair(four[:-1], a[4:])
    again = np.bincount(five)[five] > 1
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.nonzero(again)[0]
    mark[at] += 1
    np.subtract.at(mark, at + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(mark)))


def line_hash(line: str) -> int:
    """Hash of the normalised line; odd if it is a short one."""
    folded = _FOLD.sub(" ", line.translate(ASCII_LOWER)).strip() or line.strip()
    short = len(folded) < SHORT_CHARS and folded.count(" ") + 1 < SHORT_WORDS
    return (xxhash.xxh3_64_intdigest(folded) - (1 << 63)) & ~1 | short


def text_mark(hashes: list[int | None]) -> int:
    """Hash of the whole normalised text, from its line hashes in order."""
    lines = np.array([h for h in hashes if h is not None], np.int64)
    return xxhash.xxh3_64_intdigest(lines.tobytes()) - (1 << 63)


def measures(text: str) -> tuple[int, int, int, int, int, list[int | None], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and for every
    line its hash (None if it has no word) and word count."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    hashes, sizes = [], []
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        if n:
            dup += line in seen
            seen.add(line)
        hashes.append(line_hash(line) if n else None)
        sizes.append(n)
    return (len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeat_words(words), hashes, sizes)


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row its base measures, line hashes and sizes, and the hash of its normalised text."""
    def run(b: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in b.column("text").to_pylist():
            m = measures(text or "")
            rows.append((*m, text_mark(m[5])))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int64()]
        return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    narrow = docs.select(*[F.col(c) for c in docs.columns if c in ("mark_1", "mark_2")], F.col(id_col).alias("doc_id"),
                         F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return arrow_map(narrow, run, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, lines array<long>, sizes array<long>, mark long",
                     keep=[c for c in narrow.columns if c != "text"])


def frequent_lines(measured: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line, n_docs of the lines above the limit; copies count once."""
    rows = measured.select("host", "mark", F.explode(F.array_distinct("lines")).alias("line")).filter(
        "line is not null")
    lines = rows.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = measured.select("host", "mark").distinct().groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs")).withColumnRenamed("host", "h")
    share = F.when(F.col("line").bitwiseAND(F.lit(1)) == 1, F.greatest(F.lit(SHORT_SHARE), F.lit(max_share))).otherwise(max_share)
    limit = F.greatest(F.lit(max_docs), share * F.col("host_docs"))
    return lines.filter(F.col("n_docs") > max_docs).join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(
        F.col("n_docs") > limit).select("host", "line", "n_docs")


def _verdicts(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each measured row with removed_words, removed_lines (hashes), base_failed, kept."""
    f = frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    lines = rows.select("row", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select(
        "row", "host", F.col("l.lines").alias("line"), F.col("l.sizes").alias("size")).filter("line is not null")
    lost = lines.join(f, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host"))).groupBy(
        "row").agg(F.sum("size").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    out = rows.join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (2 * F.col("removed_words") >= F.col("n_words")) & (F.col("removed_words") > 0) & (
        (left < MIN_LEFT_WORDS) | (left < MIN_LEFT_SHARE * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per row of ``docs``: the measures, removed_words, base_failed and kept."""
    measured = _measured(docs.select(id_col, text_col, host_col), id_col, text_col, host_col)
    # the row number is written down once, so both sides of the join below agree on it
    rows = stage(measured.withColumn("row", F.monotonically_increasing_id()), "measures")
    return _verdicts(rows, frequent_lines(rows, max_docs, max_share)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        "base_failed", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          length_col: str = "n_chars", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The kept documents without their frequent lines; columns unchanged. The
    length column follows a text that lost lines. Rows with equal id, host and
    text are kept or rejected alike."""
    whole = marked(docs, [id_col, host_col, text_col])
    measured = _measured(whole.select("mark_1", "mark_2", f"doc.{id_col}", f"doc.{text_col}", f"doc.{host_col}"),
                         id_col, text_col, host_col)
    rows = stage(measured.withColumn("row", F.monotonically_increasing_id()), "measures")
    removed = F.coalesce("removed_lines", F.array().cast("array<long>"))
    lines = F.when(F.size(removed) > 0, F.col("lines"))
    kept = stage(_verdicts(rows, frequent_lines(rows, max_docs, max_share)).filter("kept").select(
        "mark_1", "mark_2", lines.alias("lines"), removed.alias("removed")).dropDuplicates(["mark_1", "mark_2"]), "kept")
    release(rows)
    text = F.col(f"doc.{text_col}")
    goes = F.size("removed") > 0
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(
        F.array_contains("removed", F.get("lines", i)), F.lit(False))), "\n")
    out = whole.join(kept, ["mark_1", "mark_2"]).select(
        "doc", F.when(goes, left).otherwise(text).alias("new_text"), goes.alias("goes"))
    new = {text_col: F.col("new_text")}
    if length_col in docs.columns:
        old = F.col(f"doc.{length_col}")
        new[length_col] = F.when(F.col("goes"), F.length("new_text").cast(docs.schema[length_col].dataType)).otherwise(old)
    return out.select(*[new.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])
