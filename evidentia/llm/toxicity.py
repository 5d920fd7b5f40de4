"""Toxicity scores from a counterfactual-regularised classifier.

A logistic regression over the presence of hashed words and word beginnings.
Besides the labels it learns from swaps: in each training sentence that names a
group (a term of ``IDENTITY``) the term is exchanged for others of its kind,
and the squared change of the score is penalised. Terms that merely co-occur
with toxic labels then carry no weight, so neutral mentions are not flagged.

The fit is bounded: at most ``MAX_TRAIN`` labelled rows per class, the ones
with the smallest id hashes, are read (by a broadcast join of that bounded list
of ids). Class weights restore the class shares of all labelled rows. Features
live in 2**20 hash buckets, and at most ``MAX_FEATURES`` of them, chosen by
their G statistic against the label, get a weight. Equal swaps are one with a
count: what is left of a swap are the few features of two terms, so their number
is bounded by the pairs of terms, however long a text is. The intercept is moved
so that 0.5 is where ``CV_FOLDS`` cross-validated scores of the training rows have
their best F1: few toxic rows then still give a fair share of found ones. Scoring
reads every text whole.

Only rows whose crc32(doc_id) mod 5 is not 0 are used for the fit. Labels, ids
and any column but the text are no inputs of a score.

Defined results: null and empty texts get the score of a text without known
features; a null id is not held out and has no label; of contradicting labels
of one id the toxic one counts, null labels do not count; without labels of
both classes every score is the share of toxic labels (0 without labels);
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import arrow_map, by_value, stage

by_value(__name__)

FOLDS = 5
MAX_TRAIN = 12_000        # labelled rows of each class that the fit reads at most
BITS = 20
MAX_FEATURES = 4_000
MIN_G, MIN_ROWS = 20.0, 3
L2, SWAP_PENALTY = 0.1, 50.0
STEPS, RATE = 400, 0.1
CV_FOLDS = 4
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_CACHE = 500_000          # words whose features one task remembers

# Terms that name groups, by kind and language. A term is swapped
# for the others of its list.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mothers", "fathers"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "healthy"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("ausländer", "einheimische", "flüchtlinge"), ("schwule", "lesben", "heterosexuelle"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "hindous"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados", "extranjeros"),
)


def word_features(word: str) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    keys = ["w" + word] + ["p" + word[:k] for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh3_64_intdigest(k) & ((1 << BITS) - 1) for k in keys]


def features(text: str) -> set[int]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def swaps(text: str) -> Iterator[tuple[set[int], set[int]]]:
    """(features, features after the swap) of each sentence and swap."""
    kinds = {t: group for group in IDENTITY for t in group}
    for m in _SENTENCE.finditer(text.lower()):
        words = _WORD.findall(m.group())
        for term in {w for w in words if w in kinds}:
            own = features(m.group())
            for other in kinds[term]:
                if other != term:
                    yield own, features(" ".join(other if w == term else w for w in words))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _select(n1: np.ndarray, n0: np.ndarray, size1: int, size0: int) -> np.ndarray:
    """The buckets whose presence tells most about the label (largest G statistic of
    the two-by-two table), most telling first."""
    n, total = n1 + n0, size1 + size0
    g = np.zeros(len(n))
    for seen, size in ((n1, size1), (n0, size0)):
        for observed, expected in ((seen, n * size / total), (size - seen, (total - n) * size / total)):
            ok = (observed > 0) & (expected > 0)
            g[ok] += 2 * observed[ok] * np.log(observed[ok] / expected[ok])
    g[(n < MIN_ROWS) | (g < MIN_G)] = 0
    best = np.argsort(-g, kind="stable")[:MAX_FEATURES]
    return best[g[best] > 0]


def train(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, deltas: list[tuple[np.ndarray, np.ndarray]],
          n: int, penalty: float, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: feature numbers of each text; deltas: the
    numbers that a swap adds and removes, ``times`` how often. Minimises the weighted log-loss sum +
    L2/2 |w|^2 + penalty/2 * sum of squared score changes, by Adam steps."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, int)]).astype(int)
    d_row = np.concatenate([np.repeat(np.arange(len(deltas)), [len(a) + len(b) for a, b in deltas]), np.empty(0, int)]).astype(int)
    d_col = np.concatenate([*(np.concatenate(x) for x in deltas), np.empty(0, int)]).astype(int)
    d_sign = np.concatenate([*(np.repeat((1.0, -1.0), (len(a), len(b))) for a, b in deltas), np.empty(0)])
    times = np.ones(len(deltas)) if times is None else times
    w, bias = np.zeros(n), float(np.log(weight[y == 1].sum() / weight[y == 0].sum()))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    total = weight.sum()
    for step in range(1, STEPS + 1):
        s = bias + np.bincount(row, w[col], len(rows))
        err = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - y)
        change = times * np.bincount(d_row, d_sign * w[d_col], len(deltas))
        g = np.bincount(col, err[row], n) + L2 * w + penalty * np.bincount(d_col, d_sign * change[d_row], n)
        g = np.append(g, err.sum()) / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def best_cut(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which on rows are best called toxic (largest F1; of several
    the one nearest to 0)."""
    by = np.argsort(-scores, kind="stable")
    s, hit = scores[by], weight[by] * y[by]
    found, called = np.cumsum(hit), np.cumsum(weight[by])
    f1 = 2 * found / (called + hit.sum())
    last = np.append(s[1:] < s[:-1], True)      # equal scores fall on one side
    f1[~last] = -1
    ends = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    # a cut may lie anywhere between two neighbouring scores
    low = np.where(ends + 1 < len(s), s[np.minimum(ends + 1, len(s) - 1)], s[ends] - 1)
    middle = (s[ends] + low) / 2
    cuts = np.where((s[ends] >= 0) & (low < 0), 0.0, middle)
    return float(cuts[np.argmin(np.abs(cuts))])


def cut_by_folds(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, deltas, n: int, times: np.ndarray) -> float:
    """``best_cut`` of scores that each fold got from a fit to the others."""
    fold = np.arange(len(y)) % CV_FOLDS
    scores = np.zeros(len(y))
    for k in range(CV_FOLDS):
        rest = np.nonzero(fold != k)[0]
        if not 0 < y[rest].sum() < len(rest):
            return 0.0
        w, bias = train([rows[i] for i in rest], y[rest], weight[rest], deltas, n, SWAP_PENALTY, times)
        for i in np.nonzero(fold == k)[0]:
            scores[i] = bias + w[rows[i]].sum()
    return best_cut(scores, y, weight)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[dict[int, float], float]:
    """Weights by hash bucket and the intercept. docs: doc_id, text; labels: doc_id, toxic."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    labels = stage(labels, "labels")
    size = dict((r["toxic"], r["count"]) for r in labels.groupBy("toxic").count().collect())
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        share = n1 / max(n1 + n0, 1)
        return {}, float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
    chosen = None
    for kind in (1, 0):  # the bounded sample: 2 * max_train ids
        part = labels.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = stage(chosen, "train-ids").withColumnRenamed("doc_id", "l_id")
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("toxic", "text")

    def extract(b: pa.RecordBatch) -> list[pa.Array]:
        own, plus, minus = [], [], []
        for text in b.column("text").to_pylist():
            own.append(sorted(features(text or "")))
            pairs = list(swaps(text or ""))
            plus.append([sorted(after - before) for before, after in pairs])
            minus.append([sorted(before - after) for before, after in pairs])
        ints = pa.list_(pa.int32())
        return [pa.array(own, ints), pa.array(plus, pa.list_(ints)), pa.array(minus, pa.list_(ints))]
    rows = stage(arrow_map(texts, extract, "own array<int>, plus array<array<int>>, minus array<array<int>>",
                           keep=["toxic"]), "train-features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for kind, own in zip(b.column("toxic").to_pylist(), b.column("own")):
                n[kind, own.values.to_numpy()] += 1
        at = np.nonzero(n.sum(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[1, at]), pa.array(n[0, at])],
                                         names=["bucket", "n1", "n0"])
    counts = rows.select("toxic", "own").mapInArrow(count, "bucket int, n1 long, n0 long").groupBy("bucket").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter(F.col("n1") + F.col("n0") >= MIN_ROWS).toPandas()  # at most 2**BITS rows
    seen = np.zeros((2, 1 << BITS))
    seen[1, counts["bucket"]], seen[0, counts["bucket"]] = counts["n1"], counts["n0"]
    in_sample = dict((r["toxic"], r["count"]) for r in rows.groupBy("toxic").count().collect())
    if len(in_sample) < 2:
        return {}, float(np.log(n1 / n0))
    chosen_buckets = _select(seen[1], seen[0], in_sample[1], in_sample[0])
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[chosen_buckets] = np.arange(len(chosen_buckets))

    def narrow(b: pa.RecordBatch) -> list[pa.Array]:
        def own(values):
            found = number[np.asarray(values, dtype=np.int64)]
            return found[found >= 0].tolist()
        ints = pa.list_(pa.int32())
        return [pa.array([own(x) for x in b.column("own").to_pylist()], ints),
                *(pa.array([[own(x) for x in r] for r in b.column(c).to_pylist()], pa.list_(ints))
                  for c in ("plus", "minus"))]
    small = stage(arrow_map(rows, narrow, "own array<int>, plus array<array<int>>, minus array<array<int>>", keep=["toxic"]), "train-small")
    swapped = small.select(F.inline(F.arrays_zip("plus", "minus"))).filter((F.size("plus") > 0) | (F.size("minus") > 0))
    # a bounded number of different swaps, and at most 2 * max_train rows of the chosen features;
    # sorted: the same sums whatever order the rows come in
    counted = sorted(map(tuple, swapped.groupBy("plus", "minus").count().collect()))
    texts = sorted(map(tuple, small.select("toxic", "own").collect()))
    y = np.array([t for t, _ in texts])
    weight = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum()) * len(y) / (n1 + n0)
    deltas = [(np.array(a, int), np.array(b, int)) for a, b, _ in counted]
    times = np.array([k for _, _, k in counted], float)
    own = [np.array(x, int) for _, x in texts]
    w, bias = train(own, y, weight, deltas, len(chosen_buckets), SWAP_PENALTY, times)
    bias -= cut_by_folds(own, y, weight, deltas, len(chosen_buckets), times)
    return {int(b): float(x) for b, x in zip(chosen_buckets, w) if x}, float(bias)


def score_texts(texts: list[str | None], weights: dict[int, float], bias: float,
                cache: dict[str, tuple[int, ...]]) -> list[float]:
    out = []
    for text in texts:
        found: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            own = cache.get(w)
            if own is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                own = cache[w] = tuple(f for f in word_features(w) if f in weights)
            if own:
                found.update(own)
        s = bias + sum(weights[f] for f in sorted(found))
        out.append(float(1 / (1 + np.exp(-min(max(s, -40.0), 40.0)))))
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights, bias = fit(rows, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")), max_train)
    model = rows.sparkSession.sparkContext.broadcast((weights, bias))  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score_texts(b.column("text").to_pylist(), w, b0, cache), pa.float64())],
                names=["doc_id", "score"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
