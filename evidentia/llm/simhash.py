"""SimHash near-duplicates by a Gray-ordered hierarchical index.

A document's fingerprint has a bit set where over half of its word shingles'
64-bit hashes have it. Distinct fingerprints are sorted by their rank in the
reflected Gray code, so neighbours share long bit patterns, and cut into blocks
of ``BLOCK`` consecutive ones. A node of the index stands for a run of
neighbours: its mask has the bits that all of them share, its pattern their
values. A parent takes over what its ``FAN`` children share; of a child only the
bits beyond its parent's mask are compared, and the differences add up along
the path, so a whole group goes as soon as the sum exceeds ``RADIUS``. Leaves
are the fingerprints themselves, so what is left is exact.

The index has two parts. The roots of the blocks and the nodes above them (at
most ``MAX_BLOCKS`` roots: blocks grow beyond BLOCK * MAX_BLOCKS fingerprints)
are sent to every task; each fingerprint walks down them and goes, packed, to
the blocks after its own that may hold a neighbour. A task then builds the lower
part for its block and walks all that came down to the leaves. A block sends on
only the links of a spanning forest of what it found: no group of copies is
expanded into its pairs, and no component loses a link. Two fingerprints within
two bits are compared in the block of the later one. A fingerprint has at most
2,080 neighbours at two bits, so no walk grows with the square of a group.

Defined results: null, empty and word-less texts have fingerprint zero and are
linked like any other; texts of fewer than three words are one shingle; rows
with equal ids each get their own row; a null id never names a component that
has another id; an empty table gives an empty result. Only the two named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import by_value, release, stage
from evidentia.llm.ngram_join import components

by_value(__name__)

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCK, MAX_BLOCKS, FAN = 1_024, 65_536, 16
_HELD = 1 << 16                 # shingle hashes counted at a time
_WALK = 1 << 21                 # places of a walk held at a time
U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ---------------------------------------------------------------------

def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint. bytes.lower() changes A-Z only, and bytes.split()
    splits at space and 0x09-0x0D."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(SHINGLE, len(words))
    first = np.concatenate(([0], end[:-1] + 1))[:len(words) - width + 1]
    last = end[width - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), _HELD):
        spans = zip(first[at:at + _HELD].tolist(), last[at:at + _HELD].tolist())
        h = np.array([digest(whole[a:b], SEED) for a, b in spans], U)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column("text")], U)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of ``fp`` in the reflected Gray code, as an unsigned number whose top
    bit is flipped: signed order of the result is the order of the ranks."""
    out = fp
    for step in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, step))
    return out.bitwiseXOR(F.lit(-1 << 63))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    out = fps.copy()
    for step in (1, 2, 4, 8, 16, 32):
        out ^= out >> U(step)
    return out


# --- the index -------------------------------------------------------------------------

class Index:
    """Levels of (pattern, mask, own bits) from the top down over ``patterns`` and
    ``masks`` in Gray order; own bits are those beyond the parent's mask."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray):
        levels = [(patterns, masks)]
        while len(levels[0][0]) > FAN:
            p, m = levels[0]
            at = np.arange(0, len(p), FAN)
            # bits that all children share: in every mask, and equal in all patterns
            mask = np.bitwise_and.reduceat(m, at)
            mask &= ~(np.bitwise_or.reduceat(p, at) ^ np.bitwise_and.reduceat(p, at))
            levels.insert(0, (np.bitwise_and.reduceat(p, at) & mask, mask))
        self.levels = [levels[0]]
        for (_, above), (p, m) in zip(levels, levels[1:]):
            self.levels.append((p, m & ~above[np.arange(len(p)) // FAN]))

    def walk(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, places of leaves) at most RADIUS differing bits apart."""
        step = max(1, _WALK // max(1, len(self.levels[0][0])))
        for at in range(0, len(queries), step):
            part = queries[at:at + step]
            top = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            far = np.zeros(len(q), np.uint8)
            for k, (pattern, own) in enumerate(self.levels):
                if k:
                    width = len(pattern)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                    inside = node < width
                    q, node, far = q[inside], node[inside], far[inside]
                far = far + np.bitwise_count((part[q] ^ pattern[node]) & own[node])
                near = far <= RADIUS
                q, node, far = q[near], node[near], far[near]
            yield q + at, node


def _roots(blocks: DataFrame) -> pd.DataFrame:
    """block, pattern and mask of each block, in Gray order: at most MAX_BLOCKS + one
    per partition rows."""
    got = blocks.groupBy("block").agg(F.expr("bit_and(fp)").alias("every"), F.expr("bit_or(fp)").alias("any"),
                                      F.min("rank").alias("rank")).orderBy("rank").toPandas()
    every, some = got["every"].to_numpy(np.int64).view(U), got["any"].to_numpy(np.int64).view(U)
    return pd.DataFrame({"block": got["block"].to_numpy(np.int64), "pattern": every, "mask": ~(every ^ some)})


def _routed(blocks: DataFrame, roots: pd.DataFrame) -> DataFrame:
    """(place, mine, pack): packs of the fingerprints of each block, and of those of
    earlier blocks that may have neighbours in it."""
    index = Index(roots["pattern"].to_numpy(U), roots["mask"].to_numpy(U))
    names = roots["block"].to_numpy(np.int64)
    by = np.argsort(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(U)
            home = by[np.searchsorted(names[by], b.column("block").to_numpy())]
            where, mine, what = [home], [np.ones(len(fps), bool)], [fps]
            for q, node in index.walk(fps):
                later = node > home[q]
                where.append(node[later])
                mine.append(np.zeros(int(later.sum()), bool))
                what.append(fps[q[later]])
            place, own, fp = map(np.concatenate, (where, mine, what))
            order = np.lexsort((own, place))
            place, own, fp = place[order], own[order], fp[order]
            cut = np.concatenate(([0], np.nonzero((np.diff(place) != 0) | (own[1:] != own[:-1]))[0] + 1, [len(fp)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[cut[:-1]]), pa.array(own[cut[:-1]]),
                 pa.array([fp[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["place", "mine", "pack"])
    return blocks.select("block", "fp").mapInArrow(run, "place long, mine boolean, pack binary")


def forest(a: np.ndarray, b: np.ndarray, root: list[int]) -> list[int]:
    """Which of the links (a, b) join two trees; ``root`` keeps the trees."""
    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def block_links(own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``own`` and from ``others`` to them."""
    own = np.unique(own)
    own = own[np.argsort(gray_ranks(own), kind="stable")]
    every = np.concatenate((own, others))
    index = Index(own, np.full(len(own), ALL))
    root = list(range(len(every)))
    a, b = [], []
    for q, leaf in index.walk(every):
        new = q > leaf
        q, leaf = q[new], leaf[new]
        kept = forest(q, leaf, root)
        a.append(every[q[kept]])
        b.append(every[leaf[kept]])
    return np.concatenate([*a, np.empty(0, U)]), np.concatenate([*b, np.empty(0, U)])


def links(fps: DataFrame) -> DataFrame:
    """Staged (a, b): links of distinct fingerprints (column fp) at most RADIUS bits
    apart that join all that their links can reach."""
    n = fps.count()
    size = max(BLOCK, -(-n // MAX_BLOCKS))
    rank = gray_rank(F.col("fp"))
    ranked = fps.withColumn("rank", rank).repartitionByRange("rank").sortWithinPartitions("rank")
    at = F.monotonically_increasing_id()       # partition * 2**33 + place
    blocks = stage(ranked.withColumn("at", at).select(
        "fp", "rank", (F.shiftright("at", 33) * F.lit(1 << 33) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / size)).alias("block")),
        "simhash-blocks")
    packs = _routed(blocks, _roots(blocks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["mine"].to_numpy(bool)
        parts = [np.frombuffer(b"".join(pdf["pack"][which]), U) for which in (own, ~own)]
        a, b = block_links(*parts)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
    out = stage(packs.groupBy("place").applyInPandas(run, "a long, b long"), "simhash-links")
    release(blocks)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = stage(fingerprints(docs, id_col, text_col), "simhash-rows")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-fps")
    found = components(links(fps.select("fp")))
    members = fps.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("comp", "fp").alias("comp"))
    ids = members.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    labels = stage(members.join(ids, "comp").select(F.col("fp").alias("l_fp"), "component_id"), "simhash-labels")
    release(fps, found)
    return rows.join(labels, F.col("fp") == F.col("l_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
