"""URL filter: host/path rules, then a character language-model ratio.

Two smoothed variable-order Markov models over URL characters are fitted, one
on accepted and one on rejected URLs (the URLs a rule allows or blocks). A URL
that no rule fits is judged by the mean log-likelihood difference per symbol
against a threshold calibrated on labelled URLs left out of a first fit. What is
scored is the whole URL after its scheme, query string and fragment included, or
all of it if it has no scheme.

The final models' n-gram counts cover every labelled URL of the table, the
calibrating fold included. Symbols are folded to
an alphabet of 40, so a model of order 3 has at most 40**4 counts: the table
that reaches the driver and the broadcast has a bound that no input exceeds.

Defined results: a null URL, or one without ``://``, has empty host and path;
a null URL is scored as the empty string (its end symbol only); repeated rows are
judged alike; an empty table gives an empty result; without labelled URLs of a
class that class's model is uniform; with none at all every score is 0, which
is allowed. Only the id and URL columns are read, so other columns of any name
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import arrow_map, ascii_lower, by_value, stage

by_value(__name__)

A = 40                     # alphabet size, with padding and end symbols
ORDER = 3                  # longest context
FOLDS = 5                  # one fold in five of the labelled URLs calibrates
BINS, BIN_W = 4000, 0.005  # score histogram for the calibration: [-10, 10)
PAD, END, OTHER = 0, 1, 2


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    u = F.coalesce(url, F.lit(""))
    pat = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(u, pat, 1)), F.regexp_extract(u, pat, 2)


def model_text(url: Column) -> Column:
    """What the models score: the URL after its scheme (all of it without one),
    host lower-cased or not; the models fold case."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^/?#]*?://", "")


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(action, rule), else null. A rule
    ``host/path`` fits its host and all subdomains when the path starts alike."""
    out = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        rhost, slash, rest = rule.partition("/")
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(slash + rest)
        value = F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def _symbol_table() -> np.ndarray:
    """Byte -> symbol: letters fold to lower case, digits to one symbol."""
    lut = np.full(256, OTHER, dtype=np.int64)
    for i, ch in enumerate("abcdefghijklmnopqrstuvwxyz"):
        lut[ord(ch)] = lut[ord(ch.upper())] = 3 + i
    lut[ord("0"):ord("9") + 1] = 29
    for i, ch in enumerate("/.-_%=~+:@"):
        lut[ord(ch)] = 30 + i
    lut[0], lut[1] = PAD, END
    return lut


def ngram_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all (ORDER + 1)-grams of the texts, one after the other, and
    where each text's codes start. Each text ends with one end symbol."""
    clean = [t.encode("utf-8", "replace").replace(b"\0", b"\xff").replace(b"\1", b"\xff") for t in texts]
    sym = _symbol_table()[np.frombuffer(b"".join(b"\0" * ORDER + c + b"\1" for c in clean), dtype=np.uint8)]
    lens = np.fromiter((len(c) + 1 for c in clean), dtype=np.int64, count=len(clean))
    begin = np.concatenate(([0], np.cumsum(lens)))
    n = begin[-1]
    # position in the padded stream of each symbol that is predicted
    at = np.arange(n) + ORDER * (np.repeat(np.arange(len(clean)), lens) + 1)
    code = np.zeros(n, dtype=np.int64)
    for k in range(ORDER, -1, -1):
        code = code * A + sym[at - k]
    return code, begin


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell: every context of length k mixes its own counts with the
    estimate of its suffix; a context never seen leaves it to the suffix."""
    p = np.full((1, A), 1.0 / A)
    for k in range(ORDER + 1):
        c = counts.reshape(A ** (ORDER - k), A ** k, A).sum(axis=0)
        total = c.sum(axis=1, keepdims=True)
        kinds = np.count_nonzero(c, axis=1)[:, None]
        lower = np.tile(p, (A ** k // len(p), 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return p


def llr_table(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """log p(symbol | context, accepted) - log p(... , rejected) by code."""
    return (np.log(_probabilities(accepted)) - np.log(_probabilities(rejected))).reshape(-1).astype(np.float32)


def scores(texts: Sequence[str], llr: np.ndarray) -> np.ndarray:
    code, begin = ngram_codes(texts)
    if not len(texts):
        return np.zeros(0)
    return np.add.reduceat(llr[code].astype(np.float64), begin[:-1]) / np.diff(begin)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for label in (0, 1):
            code, n = np.unique(ngram_codes(pdf["lm_text"][pdf["label"] == label].tolist())[0], return_counts=True)
            yield pd.DataFrame({"label": label, "code": code, "n": n})


def fit(labelled: DataFrame) -> np.ndarray:
    """``labelled``: lm_text, label (1 accepted, 0 rejected). All rows count."""
    return llr_table(*_counts(labelled)[::-1])


def _counts(labelled: DataFrame) -> np.ndarray:
    """n-gram counts by label; counts of disjoint sets of rows add up."""
    rows = (labelled.mapInPandas(_count_batches, "label int, code long, n long")
            .groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas())  # at most 2 * 40**4 rows
    counts = np.zeros((2, A ** (ORDER + 1)))
    counts[rows["label"].to_numpy(int), rows["code"].to_numpy(int)] = rows["n"].to_numpy(float)
    return counts


def score_column(df: DataFrame, llr) -> DataFrame:
    """``df`` with a column ``score``; ``llr`` is the broadcast model."""
    def run(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(scores(b.column("lm_text").to_pylist(), llr.value))]
    return arrow_map(df, run, "score double", keep=df.columns)


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy on labelled, scored rows; of
    equally good ones the one nearest to 0. 0 if a class has no rows."""
    b = F.least(F.greatest(F.floor(F.col("score") / BIN_W) + BINS // 2, F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(b.cast("int").alias("bin"), "label").count().collect()  # at most 2 * BINS rows
    hist = np.zeros((2, BINS))
    for r in rows:
        hist[r["label"], r["bin"]] = r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(hist, axis=1)), axis=1) / hist.sum(axis=1, keepdims=True)
    gain = below[0] + 1 - below[1]
    edges = (np.arange(BINS + 1) - BINS // 2) * BIN_W
    best = edges[gain >= gain.max() - 1e-12]
    return float(best[np.argmin(np.abs(best))])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                        model_text(F.col(url_col)).alias("lm_text"))
    rows = rows.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", "lm_text", F.col("fit.rule").alias("rule"),
        F.when(F.col("fit.action") == "allow", 1).when(F.col("fit.action") == "block", 0).alias("label"))
    rows = stage(rows, "urls")
    sc = rows.sparkSession.sparkContext
    labelled = rows.filter("label is not null").select("lm_text", "label")
    held = F.pmod(F.xxhash64("lm_text"), F.lit(FOLDS)) == 0
    fitted = _counts(labelled.filter(~held))
    model = sc.broadcast(llr_table(fitted[1], fitted[0]))  # 40**4 float32, 10 MB whatever the input
    threshold = calibrate(score_column(labelled.filter(held), model))
    model.unpersist()
    every = fitted + _counts(labelled.filter(held))
    model = sc.broadcast(llr_table(every[1], every[0]))
    verdict = F.when(F.col("label") == 1, "allow").when(F.col("label") == 0, "block").when(
        F.col("score") >= threshold, "allow").otherwise("block")
    return score_column(rows, model).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score",
                                            F.lit(threshold).alias("threshold"))
