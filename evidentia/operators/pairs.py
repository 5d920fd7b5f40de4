"""Text-pair generation and scoring.

Two scorers:

* ``lexical_scores`` - greedy token matching with exact-match similarity
  (BERTScore with one-hot token vectors): P = share of candidate tokens found
  in the reference, R the other way round, F1 their harmonic mean. A
  projection over the pair row, without a shuffle.
* ``greedy_match`` - the same greedy matching over real token vectors
  (cosine similarity). Token vectors are cut into blocks of bounded size;
  each (candidate block, reference block) tile of a pair is one row, scored
  with one matrix product in ``mapInPandas``. Tiles are keyed on
  (pair, candidate block), so a pair with very many tokens is spread over
  many tasks, and no row ever holds all token pairs of a text pair.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.extract import evidence_pair, evidence_sections
from evidentia.functions.text import join_bullets, strip_ws

PAIR_KEYS = ["model", "mode", "claim_id", "prompt", "target"]

# The functions this module runs on Python workers travel by value, so the
# workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def pair_inputs(parsed: DataFrame, prompt_col: str = "prompt_text",
                evidence_col: str | None = None) -> DataFrame:
    """M9 + X12: per answer row, the (target, candidate, reference) pairs:
    bullets of an evidence prompt x each evidence and x the claim; bullets of
    the claim-only prompt x the claim. Blank texts are skipped.

    The evidence texts are cut out of the prompt (X11) unless the job still
    carries the evidence array the prompt was built from (``evidence_col``):
    then they are read from it and the long prompt is not parsed again."""
    cand = join_bullets(F.col("bullets"))
    if evidence_col:
        ev = F.col(evidence_col)
        e1, e2 = strip_ws(F.get(ev, 0)), strip_ws(F.get(ev, 1))
    else:
        e1, e2 = evidence_pair(F.col(prompt_col))
    tgt = lambda name, ref: F.struct(F.lit(name).alias("target"), ref.alias("reference"))
    with_ev = F.array(tgt("evidence_1", e1), tgt("evidence_2", e2), tgt("claim", F.col("claim")))
    claim_only = F.array(tgt("claim", F.col("claim")))
    arr = F.when(F.col("prompt") == "claim", claim_only).otherwise(with_ev)
    x = parsed.select("model", "mode", "claim_id", "prompt", cand.alias("candidate"), arr.alias("_t"))
    # The blank test runs inside the generator and only the generator's output
    # is filtered: a filter on ``candidate`` (or the size filter Spark infers
    # for a plain inline) would be pushed below the projection and evaluate
    # the whole bullet extraction a second time.
    keep = F.filter("_t", lambda s: ~_blank(F.col("candidate")) & ~_blank(s["reference"]))
    out = x.select("model", "mode", "claim_id", "prompt", "candidate",
                   F.inline_outer(keep))
    return out.filter(F.col("target").isNotNull())


def section_pairs(rows: DataFrame, keys: list[str], candidate: Column, prompt: Column) -> DataFrame:
    """M9 with any number of evidence sections: ``keys``, target (``evidence_i``),
    candidate, reference, a row for each section of the prompt (X11) that is not blank.
    A candidate that is a list is joined by spaces first (``join_bullets``)."""
    x = rows.select(*keys, candidate.alias("candidate"), evidence_sections(prompt).alias("_s"))
    keep = F.filter("_s", lambda s: ~_blank(F.col("candidate")) & ~_blank(s["text"]))
    return x.select(*keys, "candidate", F.inline_outer(keep).alias("_i", "reference")).filter(F.col("_i").isNotNull()).select(
        *keys, F.concat(F.lit("evidence_"), F.col("_i").cast("string")).alias("target"), "candidate", "reference")


def tokens(c: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)


_FEW = 32   # distinct unmatched tokens that are looked up one by one


def _matched(own: Column, other: Column, missing: Column) -> Column:
    """How many tokens of ``own`` occur in ``other``; ``missing`` are its distinct tokens
    that do not (``array_except``, a hash set). With few of them each token of
    ``own`` is looked up among them, otherwise the texts are walked."""
    few = F.size(own) - F.size(F.filter(own, lambda t: F.array_contains(missing, t)))
    return F.when(F.size(missing) == 0, F.size(own)).when(F.size(missing) <= _FEW, few).otherwise(_walked(own, other))


def _walked(own: Column, other: Column) -> Column:
    """``_matched`` in n log n steps: both are sorted together, a reference token
    before its equals, and walked once."""
    item = lambda t, g: F.struct(t.alias("t"), F.lit(g).alias("g"))
    both = F.array_sort(F.concat(F.transform(F.array_distinct(other), lambda t: item(t, 0)),
                                 F.transform(own, lambda t: item(t, 1))))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(
        F.when(x["g"] == 0, x["t"]).otherwise(s["last"]).alias("last"),
        (s["n"] + ((x["g"] == 1) & (x["t"] == s["last"])).cast("int")).alias("n"))
    return F.aggregate(both, start, step, lambda s: s["n"])


def lexical_scores(pairs: DataFrame, keys: list[str] | None = None, digits: int = 4) -> DataFrame:
    """M10 / M11 (lexical form): precision, recall, F1 of every pair row.

    All tokens of a pair are in its row, so the scores are a projection: no
    shuffle, and rows with equal keys are scored one by one."""
    keys = keys or PAIR_KEYS
    # a text without tokens has no precision (or recall); two of them no row. The
    # test runs inside a generator, and only its output is filtered: a filter on
    # the token columns would be pushed down and build them a second time
    both = F.struct(tokens(F.col("candidate")).alias("c"), tokens(F.col("reference")).alias("r"))
    some = F.filter(F.array(both), lambda s: (F.size(s["c"]) > 0) | (F.size(s["r"]) > 0))
    x = pairs.select(*keys, F.inline_outer(some)).filter(F.col("c").isNotNull())
    s = _precision_recall(x, keys, [("c", "r", "precision", "recall")])
    return s.select(*keys, F.round("precision", digits).alias("precision"),
                    F.round("recall", digits).alias("recall"),
                    F.round(f1(F.col("precision"), F.col("recall")), digits).alias("f1"))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean; 0 where both are 0, NULL where one is NULL."""
    return F.when(p + r > 0, 2 * p * r / (p + r)).when(p.isNotNull() & r.isNotNull(), F.lit(0.0))


def _precision_recall(x: DataFrame, keys: list[str], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """``keys`` and, for each (candidate tokens, reference tokens, precision, recall),
    the two named shares. The unmatched tokens are read several times, so they get a
    projection of their own."""
    arrays = list(dict.fromkeys(c for a, b, _, _ in pairs for c in (a, b)))
    missing = [F.array_except(a, b).alias(f"_{n}") for c, r, p, q in pairs for a, b, n in ((c, r, p), (r, c, q))]
    x = x.select(*keys, *arrays, *missing)
    share = lambda a, b, n: F.when(F.size(a) > 0, _matched(F.col(a), F.col(b), F.col(f"_{n}")) / F.size(a)).alias(n)
    return x.select(*keys, *[share(a, b, n) for c, r, p, q in pairs for a, b, n in ((c, r, p), (r, c, q))])


def evidence_scores(parsed: DataFrame, keys: list[str], evidence_col: str, digits: int = 4) -> DataFrame:
    """E17 input: per answer the F1 of its bullets against its first and second
    evidence (columns ``evidence_1``, ``evidence_2``), as ``lexical_scores`` gives
    them. Both stand on the answer's row: nothing is exploded, shuffled or joined."""
    text = lambda i: F.coalesce(F.get(F.col(evidence_col), i), F.lit(""))
    x = parsed.select(*keys, tokens(join_bullets(F.col("bullets"))).alias("c"), tokens(text(0)).alias("r1"), tokens(text(1)).alias("r2"))
    s = _precision_recall(x, keys, [("c", "r1", "p1", "q1"), ("c", "r2", "p2", "q2")])
    return s.select(*keys, F.round(f1(F.col("p1"), F.col("q1")), digits).alias("evidence_1"),
                    F.round(f1(F.col("p2"), F.col("q2")), digits).alias("evidence_2"))


TARGETS = ["evidence_1", "evidence_2", "claim"]


def scores_map(scores: DataFrame, keys: list[str], value: str = "f1", order: str | None = None,
               targets: list[str] | None = None) -> DataFrame:
    """Long pair scores -> MAP<target, score> per answer. Of several rows of
    one (key, target) the last in ``order`` counts (without one, the largest
    value); one conditional aggregate per target, so nothing is collected."""
    targets = targets or TARGETS
    rank = F.struct(order, value) if order else F.struct(value)
    aggs = []
    for i, t in enumerate(targets):
        here = F.col("target") == t
        aggs += [F.max(F.when(here, rank)).alias(f"_v{i}")]
    entries = F.array(*[F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.lit(t).alias("k"), F.col(f"_v{i}")[value].alias("v")))
                        for i, t in enumerate(targets)])
    return scores.groupBy(*keys).agg(*aggs).select(
        *keys, F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("scores"))


# --- M12: greedy matching over token vectors -------------------------------------
_TILE_SCHEMA = "pair_id long, side int, tok_id long, sim double"


def _score_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            c = np.vstack(row.cvecs).astype(np.float64)
            r = np.vstack(row.rvecs).astype(np.float64)
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            r /= np.linalg.norm(r, axis=1, keepdims=True)
            s = c @ r.T
            out.append(pd.DataFrame({"pair_id": row.pair_id, "side": 0,
                                     "tok_id": np.asarray(row.cids, dtype=np.int64),
                                     "sim": s.max(axis=1)}))
            out.append(pd.DataFrame({"pair_id": row.pair_id, "side": 1,
                                     "tok_id": np.asarray(row.rids, dtype=np.int64),
                                     "sim": s.max(axis=0)}))
        if out:
            yield pd.concat(out, ignore_index=True).astype({"side": "int32"})


def greedy_match(token_vecs: DataFrame, block: int = 256, digits: int = 4) -> DataFrame:
    """Per text pair, P = mean over candidate tokens (side 0) of the best
    cosine to a reference token (side 1), R the other way, F1 = 2PR/(P+R).

    ``token_vecs``: pair_id, side, tok_id, vec (array of float)."""
    n = token_vecs.groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("n"))
    nb = n.select("pair_id", "side", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    t = token_vecs.join(nb, ["pair_id", "side"]) \
        .withColumn("blk", F.pmod(F.xxhash64("tok_id"), F.col("nb")).cast("int"))
    blocks = t.groupBy("pair_id", "side", "blk").agg(
        F.collect_list(F.struct("tok_id", "vec")).alias("toks"))
    ids = F.transform("toks", lambda s: s["tok_id"])
    vecs = F.transform("toks", lambda s: s["vec"])
    cand = blocks.filter(F.col("side") == 0).select(
        "pair_id", F.col("blk").alias("cblk"), ids.alias("cids"), vecs.alias("cvecs"))
    n_cand = nb.filter(F.col("side") == 0).select("pair_id", F.col("nb").alias("nbc"))
    # each reference block is paired with every candidate block of its pair:
    # one row per tile, keyed on (pair, candidate block)
    ref = blocks.filter(F.col("side") == 1).join(n_cand, "pair_id").select(
        "pair_id", F.explode(F.sequence(F.lit(0), F.col("nbc") - 1)).alias("cblk"),
        ids.alias("rids"), vecs.alias("rvecs"))
    tiles = cand.join(ref, ["pair_id", "cblk"]).select("pair_id", "cids", "cvecs", "rids", "rvecs")
    best = tiles.mapInPandas(_score_tiles, _TILE_SCHEMA) \
        .groupBy("pair_id", "side", "tok_id").agg(F.max("sim").alias("sim"))
    pr = best.groupBy("pair_id").agg(
        F.avg(F.when(F.col("side") == 0, F.col("sim"))).alias("p"),
        F.avg(F.when(F.col("side") == 1, F.col("sim"))).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") != 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    # a pair with tokens on one side only has no tile, but keeps its row
    return n.select("pair_id").distinct().join(pr, "pair_id", "left").select(
        "pair_id", F.round("p", digits).alias("precision"),
        F.round("r", digits).alias("recall"), F.round(f1, digits).alias("f1"))
