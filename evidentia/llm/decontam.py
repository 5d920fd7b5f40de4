"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into shards of a bounded number of words, builds an
FM-index of each shard over word symbols (suffix sort, Burrows-Wheeler
transform, wavelet matrix for the ranks, sampled suffix positions), and searches
all test windows backwards in it. Occurrences are located by walking back to
the next sampled position; the spans they cover are merged per document.

Words that no test item has are separators: no window spans one. They, the
document ends, and stretches shorter than the shortest window need no suffixes,
so an index holds only the text that can match. Equal texts of a shard are
indexed once and their result is given to each of them.

The items arrive in blocks of ``BLOCK_WORDS`` words. A block is broadcast, its
size is bounded by that parameter, and each further block is one more map over
the documents (no shuffle), which adds its spans to those found before.

Defined results: a null or empty text has no words and is not contaminated; an
item without words has no window, one with fewer than ten words is one window;
a null item id is listed as ``null``; repeated items count once; repeated rows
are judged alike; empty tables give an empty or an uncontaminated result. Only
the named columns are read, whatever else the tables hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import arrow_map, by_value

by_value(__name__)

WINDOW = 10
SHARD_WORDS = 1_000_000   # words of a shard, at least one document
BLOCK_WORDS = 200_000     # words of the test items that are broadcast at once
SAMPLE_EVERY = 16
# UTF-8 bytes of digits, a-z and everything above ASCII, after A-Z is lower-cased
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return _WORD.findall(text.encode("utf-8").lower()) if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector per level of the alphabet."""

    def __init__(self, seq: np.ndarray, top: int):
        self.shifts = list(range(max(int(top).bit_length(), 1) - 1, -1, -1))
        self.words, self.ones, self.zeros = [], [], []
        for shift in self.shifts:
            bit = (seq >> shift) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.start = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.ones[level][word] + np.bitwise_count(
            self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, shift in enumerate(self.shifts):
            one = self._rank1(level, i)
            i = np.where((c >> shift) & 1, self.zeros[level] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs before position i[k]."""
        return self._down(c, i) - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i[k], and how often it occurs before."""
        c = np.zeros(len(i), np.int64)
        for level, shift in enumerate(self.shifts):
            bit = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            one = self._rank1(level, i)
            c |= bit.astype(np.int64) << shift
            i = np.where(bit == 1, self.zeros[level] + one, i - one)
        return c, i - self.start[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling that sorts again only what is still tied. 0 is a
    separator: each one is a symbol of its own, ordered by position, and the
    text must end with one."""
    sa = np.argsort(text, kind="stable")
    n = len(text)
    sorted_text = text[sa]
    new = np.ones(n, bool)
    new[1:] = (sorted_text[1:] != sorted_text[:-1]) | (sorted_text[1:] == 0)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    tied = ~new
    tied[:-1] |= ~new[1:]
    active, h = sa[tied], 1
    while len(active):
        key = rank[active] * (n + 1) + rank[active + h]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]
        at = np.arange(len(active))
        head = np.ones(len(active), bool)
        head[1:] = group[1:] != group[:-1]
        begin = np.maximum.accumulate(np.where(head, at, 0))
        sa[group + at - begin] = active
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        rank[active] = group + np.maximum.accumulate(np.where(new, at, 0)) - begin
        tied = ~new
        tied[:-1] |= ~new[1:]
        active, h = active[tied], 2 * h
    return sa


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        """text: symbols 1..top with 0 as separator, 0 first and last."""
        sa = suffix_array(text)
        before = text[sa - 1]
        self.wavelet = WaveletMatrix(before, top)
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        self.count = counts
        # a walk back ends at a sampled position; it cannot cross a separator
        sampled = (sa % SAMPLE_EVERY == 0) | (before == 0)
        self.sampled, self.place = sampled, np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval [low, high) of each pattern (rows are right-aligned)."""
        width = patterns.shape[1]
        last = patterns[:, -1]
        low = self.first[last]
        high = low + self.count[last]
        for back in range(2, width + 1):
            go = np.nonzero((lengths >= back) & (high > low))[0]
            if not len(go):
                break
            c = patterns[go, width - back]
            low[go] = self.first[c] + self.wavelet.rank(c, low[go])
            high[go] = self.first[c] + self.wavelet.rank(c, high[go])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.place[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                c, r = self.wavelet.access_rank(rows)
                rows = self.first[c] + r
                steps += 1
        return out


class Phrases:
    """The distinct windows of a block of test items."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(len(ids) - WINDOW, 0) + 1 if ids else 0):
                windows.setdefault(tuple(ids[i:i + WINDOW]), set()).add(number[name])
        self.patterns = np.zeros((len(windows), WINDOW), np.int64)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        for row, w in enumerate(windows):
            self.patterns[row, WINDOW - len(w):] = w
        owners = [sorted(o) for o in windows.values()]
        self.owner_begin = np.concatenate(([0], np.cumsum([len(o) for o in owners]))).astype(np.int64)
        self.owners = np.array([x for o in owners for x in o], np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + begin[of], of


def search_shard(texts: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Per text (symbols, 0 = no test word) the merged word spans [start, end) and the item names."""
    out: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
    if not texts or not len(phrases.lengths):
        return out
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size  # one separator before each text
    whole = np.zeros(int(size.sum()) + len(texts) + 1, np.int64)
    for t, b in zip(texts, begin):
        whole[b:b + len(t)] = t
    # drop stretches between separators that are too short for any window
    zero = np.nonzero(whole == 0)[0]
    gap = np.diff(zero) - 1
    long = gap >= phrases.lengths.min()
    keep, _ = _ranges(zero[:-1][long], gap[long] + 1)
    if not len(keep):
        return out
    index = FMIndex(np.concatenate((whole[keep], [0])), len(phrases.vocabulary))
    low, high = index.search(phrases.patterns, phrases.lengths)
    rows, window = _ranges(low, high - low)
    if not len(rows):
        return out
    at = keep[index.locate(rows)]
    text = np.searchsorted(begin, at, side="right") - 1
    edge = np.zeros(len(whole) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.lengths[window], -1)
    hit = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    change = np.diff(hit.astype(np.int8))
    for s, e in zip(np.nonzero(change == 1)[0], np.nonzero(change == -1)[0]):
        k = int(np.searchsorted(begin, s, side="right") - 1)
        out[k][0].append((int(s - begin[k]), int(e - begin[k])))
    pair = np.unique(text * len(phrases.lengths) + window)
    text, window = pair // len(phrases.lengths), pair % len(phrases.lengths)
    owner, of = _ranges(phrases.owner_begin[window], np.diff(phrases.owner_begin)[window])
    pair = np.unique(text[of] * len(phrases.names) + phrases.owners[owner])
    for k, name in zip(pair // len(phrases.names), pair % len(phrases.names)):
        out[int(k)][1].append(phrases.names[int(name)])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
FOUND = "n_words long, spans array<struct<first: long, last: long>>, items array<string>"


def _blocks(bench: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    block: list[tuple[str, list[bytes]]] = []
    n = 0
    for name, text in bench.toLocalIterator():
        words = words_of(text)
        block.append(("null" if name is None else name, words))
        n += len(words)
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    yield block


def _pass(docs: DataFrame, phrases, text_col: str, further: bool) -> DataFrame:
    """One block of items: adds n_words, spans (first, last excluded) and items."""
    keep = [c for c in docs.columns if not (further and c in ("n_words", "spans", "items"))]
    schema_of = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[int], list[int]]] = []
        slots: dict[bytes, int] = {}
        texts: list[np.ndarray] = []
        get, words_held = phrases.value.vocabulary.get, 0

        def flush():
            found = search_shard(texts, phrases.value)
            for b, n, slot in held:
                old = ([b.column("spans").to_pylist(), b.column("items").to_pylist()] if further
                       else [[[]] * b.num_rows] * 2)
                spans = [_merged(found[s][0] + [(x["first"], x["last"]) for x in o]) for s, o in zip(slot, old[0])]
                items = [sorted({*found[s][1], *o}) for s, o in zip(slot, old[1])]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(n, pa.int64()),
                     pa.array([[{"first": x, "last": y} for x, y in s] for s in spans], SPANS),
                     pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])
            held.clear(), slots.clear(), texts.clear()
        for b in batches:
            n, slot, start = [], [], 0
            for text in b.column(text_col).to_pylist():
                words = words_of(text)
                key = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
                if key not in slots:
                    slots[key] = len(texts)
                    texts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
                    words_held += len(words)
                n.append(len(words))
                slot.append(slots[key])
                if words_held >= SHARD_WORDS:
                    held.append((b.slice(start, len(n)), n, slot))
                    start, n, slot, words_held = start + len(n), [], [], 0
                    yield from flush()
            if n:
                held.append((b.slice(start, len(n)), n, slot))
        if held:
            yield from flush()
    return docs.mapInArrow(run, T.StructType([*schema_of.fields, *T._parse_datatype_string(FOUND).fields]))


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text") -> DataFrame:
    """``docs`` (which must not have the three names) with n_words, spans and items."""
    sc = docs.sparkSession.sparkContext
    out, further = docs, False
    for block in _blocks(benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col))):
        out, further = _pass(out, sc.broadcast(Phrases(block)), text_col, further), True
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans."""
    data = text.encode("utf-8")
    at = [m.span() for m in _WORD.finditer(data.lower())]
    out, end = [], 0
    for first, last in spans:
        out.append(data[end:at[first][0]])
        end = at[last - 1][1]
    return (b"".join(out) + data[end:]).decode("utf-8")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  length_col: str = "n_chars") -> DataFrame:
    """The documents without the words hit by a test window; columns unchanged.
    A document of which no word is left goes."""
    found = find(docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text")), benchmark)

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([cut(t, [(x["first"], x["last"]) for x in s]) if s else t
                          for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())], pa.string())]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    left = found.filter((F.size("spans") == 0) | (n_hit < F.col("n_words")))
    out = arrow_map(left.select("doc", "text", "spans"), run, "new_text string", keep=["doc", "spans"])
    new = {text_col: F.col("new_text")}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new[length_col] = F.when(F.size("spans") > 0, F.length("new_text").cast(kind)).otherwise(F.col(f"doc.{length_col}"))
    return out.select(*[new.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])
