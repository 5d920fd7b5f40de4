"""N-gram Jaccard join with parity sketches.

A document is its set of distinct word n-grams. Each n-gram toggles one bit of a
very wide bit sketch, so two sketches differ in at most as many bits as the
sets differ in n-grams, and in as many blocks at most.

Blocks are matched per size band. Sets of sizes a and b reach a Jaccard
similarity t only if they differ in at most d = (a + b)(1 - t)/(1 + t) n-grams.
In a sketch of K blocks they then agree on K - d blocks or more. Each set keeps
its d + 1 coldest blocks in one order that all sets share (rarest n-gram first,
empty blocks last); the coldest block of those that two similar sets agree on
is kept by both. So no pair is lost whatever the order; the order only keeps
common passages from making large buckets. It comes from the n-gram counts of a
bounded sample of documents.

A block is stored sparsely as the XOR of its set bits' 64-bit codes. The keys
travel packed, to partitions by hash (``PART_CHARS`` of text each at most). A
task sends the keys of equal sets (one node) once. Of the buckets only the
distinct lists of two members or more go on; near copies share many blocks, but
few different lists. A dense sketch of up to 4,096 bits then drops the pairs of
a list whose Hamming distance is larger than similar sets can have.

What is left is verified on whole n-gram sets, without expanding a group of
near copies into all its pairs and without a list as the work of one task. A list
of up to ``SHORT`` members gives all its candidates, or, with more than ``DENSE`` of
them a node, each node's nearest predecessor. Longer lists that share half their
members (near copies have one list for each block, less those edited there) are
united, which loses no pair. Of the united lists a node takes part
in one (the one of the smallest digest, so near copies meet in the same), cut
into slices that compare their members with ``PIVOTS`` members of the list, and these
with each other. Linked
sets are merged into components. The long and the dense lists that still hold
several components are then cut into tiles (a slice of the members outside the
list's largest component with another such slice, or with a slice of the largest).
While there are more than ``DIRECT`` pairs a member to compare, every node asks one of
its lists for its nearest node of another component, again as long as that merges
anything; at last the tiles give all candidates across the components that are
left. What is
never tested lies within one component already, so the components are exact.

The texts that need verification are picked in a second scan by a bit filter of
fixed size (2**26 bits; false hits cost time, not results). A node with many
pairs is dealt out in slices, and the keys to partitions whose number grows with
the texts.

N-grams and sets are told apart by 64-bit hashes. Defined results: null texts
and texts without words have the empty set and are linked with nothing; a text
of fewer than n words is one n-gram; equal texts share a component; rows with
equal ids are nodes by their text, each row gets its own component; a null id
never names a component that has another id; an empty table gives an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import by_value, marked, marks, release, stage, stage_split

by_value(__name__)

NGRAM, NUM, DEN = 5, 3, 4          # words, and the similarity NUM / DEN
BAND_RATIO = 1.75
SLACK = 0.25                       # blocks beyond d + 1, for hot ones to be left out
SAMPLE_DOCS, HOT_MIN, HOT_MAX = 5_000, 4, 65_536
FILTER_BITS = 26
DENSE = 8                          # candidates per node from which a list counts as dense
SLICE = 64                         # pairs of one node that are verified together
SHORT, PIVOTS, TILE = 64, 32, 2_048 # members of a short list, pivots of a long one, members of a slice
DIRECT = 16                        # pairs across components that a member of a list may cost at once
PART_CHARS = 32 << 20
_CACHE = 200_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit word hashes, remembered for up to _CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


# odd multipliers, one for each place in an n-gram
_PLACES = np.array([xxhash.xxh3_64_intdigest(bytes([k])) | 1 for k in range(NGRAM)], U)


def ngrams(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct n-gram hashes. bytes.lower() changes A-Z only, and
    bytes.split() splits at space and 0x09-0x0D."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    n = min(NGRAM, len(words))
    out = h[:len(h) - n + 1] * _PLACES[0]
    for k in range(1, n):
        out += h[k:len(h) - n + 1 + k] * _PLACES[k]
    out = mix(out + U(n))
    out.sort()
    return out if len(out) < 2 else out[np.concatenate(([True], out[1:] != out[:-1]))]


def node_of(s: np.ndarray) -> int:
    """One signed 64-bit name for a set: from the sum and the XOR of its codes."""
    if not len(s):
        return 0
    code = mix(s)
    whole = np.bitwise_xor.reduce(code, keepdims=True) * U(3) + np.add.reduce(code, keepdims=True) + U(len(s))
    return int(mix(whole).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and len(b) > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


# --- bands and blocks -------------------------------------------------------------

def band_starts(up_to: int) -> list[int]:
    out = [1]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def _differ(a: int, b: int) -> int:
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def bands(n: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
    """(band, blocks, kept blocks) that a set of size n takes part in. A pair
    belongs to the band of its smaller set."""
    smallest = -(-NUM * n // DEN)
    for j in range(len(starts) - 1):
        begin, last = starts[j], starts[j + 1] - 1
        if last < smallest or begin > n:
            continue
        most = _differ(last, DEN * last // NUM)
        differ = _differ(n, DEN * n // NUM) if n <= last else _differ(n, last)
        yield j, most + 1 + int(np.ceil(SLACK * (most + 1))), differ + 1


def block_keys(s: np.ndarray, hot: np.ndarray, hot_count: np.ndarray, starts: list[int]) -> np.ndarray:
    """Keys of the kept blocks of one set, over its bands."""
    out = []
    code = mix(s ^ U(0xD6E8FEB86659FD93))   # which bit a member toggles, as a 64-bit code
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        heat = np.where(hot[at] == s, hot_count[at], 0)
    else:
        heat = np.zeros(len(s), np.int64)
    for j, blocks, kept in bands(len(s), starts):
        block = ((s >> U(11)) % U(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        b = block[by]
        begin = np.concatenate(([0], np.nonzero(b[1:] != b[:-1])[0] + 1))
        present = b[begin]
        where = mix((np.arange(blocks).astype(U) + U(1)) * U(0x9E3779B97F4A7C15) + (U(j) << U(40)))
        keys = mix(np.bitwise_xor.reduceat(code[by], begin) ^ where[present])
        warm = np.minimum.reduceat(heat[by], begin)
        if len(keys) > kept:
            keys = keys[np.lexsort((keys, warm))[:kept]] if warm.any() else np.partition(keys, kept - 1)[:kept]
        elif len(keys) < kept:
            empty = np.ones(blocks, bool)
            empty[present] = False
            none = np.sort(mix(where[empty]))
            keys = np.concatenate((keys, none[:kept - len(keys)]))
        out.append(keys)
    return np.concatenate(out)


def sketch_bits(starts: list[int], j: int) -> int:
    """Width of the dense sketch that is compared within band j: a power of two."""
    return min(max(1 << (2 * starts[j + 1] - 1).bit_length(), 256), 4_096)


def sketch(s: np.ndarray, starts: list[int]) -> bytes:
    """Parity of the n-grams by their hash modulo the width. Folding the halves
    of a sketch with XOR gives the sketch of half the width."""
    width = sketch_bits(starts, max(j for j, _, _ in bands(len(s), starts)))
    odd = np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, all folded to the narrowest."""
    width = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, width)) for x in sketches])


# --- scan: nodes and keys -----------------------------------------------------------

def _hot_ngrams(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to HOT_MAX frequent n-grams of a sample of about SAMPLE_DOCS documents."""
    part = docs
    if n_docs > SAMPLE_DOCS:
        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < SAMPLE_DOCS * 1_000_000 // n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [ngrams(t, hashes) for t in b.column("text").to_pylist()]
            g, n = np.unique(np.concatenate([*sets, np.empty(0, U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n)], names=["gram", "n"])
    rows = part.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= HOT_MIN).orderBy(F.desc("n"), "gram").limit(HOT_MAX).toPandas()  # HOT_MAX rows at most
    g, n = rows["gram"].to_numpy(np.int64).astype(U), rows["n"].to_numpy(np.int64)
    by = np.argsort(g)
    return g[by], n[by]


def _scan(docs: DataFrame, hot, parts: int) -> DataFrame:
    """Two kinds of rows: a document (doc_id, the marks, n, node, and a handle and the
    sketch where a task meets the node first) and a pack of keys (is_pack, part,
    pack). In a pack a set is named by its handle: partition, pack round and place
    in it, of which only the place (two bytes) goes with each key."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        gram, count = hot.value
        names = ["doc_id", "mark", "mark_2", "n", "node", "handle", "sketch", "part", "pack", "is_pack"]
        task, rounds = TaskContext.get().partitionId(), 0
        starts = band_starts(64)
        for b in batches:
            ns, nodes, handles, sketches, keys = [], [], [], [], []
            held = 0

            def packs():
                all_keys = np.concatenate(keys)
                of = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(k) for k in keys])
                part = ((all_keys >> U(48)) % U(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[by], np.arange(parts + 1))
                blobs, at = [], []
                for p in range(parts):
                    i = by[bounds[p]:bounds[p + 1]]
                    if len(i):
                        k = all_keys[i]
                        at.append(p)
                        # 48 bits of the key besides those that chose the partition
                        blobs.append(np.array([task << 20 | rounds, len(i)], np.int64).tobytes()
                                     + (k & U(0xFFFFFFFF)).astype(np.uint32).tobytes()
                                     + ((k >> U(32)) & U(0xFFFF)).astype(np.uint16).tobytes() + of[i].tobytes())
                keys.clear()
                k = len(at)
                return pa.RecordBatch.from_arrays(
                    [pa.nulls(k, b.schema.field("doc_id").type), *[pa.nulls(k, pa.int64())] * 5, pa.nulls(k, pa.binary()),
                     pa.array(at, pa.int32()), pa.array(blobs, pa.binary()),
                     pa.array([True] * k, pa.bool_())], names=names)
            for text in b.column("text").to_pylist():
                s = ngrams(text, hashes)
                node = node_of(s)
                ns.append(len(s))
                nodes.append(node if len(s) else None)
                handles.append(None)
                sketches.append(None)
                if len(s) and node not in sent:
                    sent.add(node)
                    if len(s) >= starts[-1]:
                        starts = band_starts(2 * len(s))
                    sketches[-1] = sketch(s, starts)
                    handles[-1] = (task << 20 | rounds) << 16 | len(keys)
                    keys.append(block_keys(s, gram, count, starts))
                    held += len(keys[-1])
                    if held > 500_000 or len(keys) == 1 << 16:
                        yield packs()
                        held, rounds = 0, rounds + 1
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), b.column("mark_2"), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(handles, pa.int64()),
                 pa.array(sketches, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                 pa.array([False] * k, pa.bool_())], names=names)
            if keys:
                yield packs()
                rounds += 1
    return docs.mapInArrow(run, f"doc_id {id_type}, mark long, mark_2 long, n long, node long, handle long, sketch binary, part int, "
                          "pack binary, is_pack boolean")


# --- buckets --------------------------------------------------------------------------

def _unpack(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and handles of all entries."""
    keys, handles = [], []
    for p in packs:
        source, n = np.frombuffer(p, np.int64, 2)
        low = np.frombuffer(p, np.uint32, n, 16).astype(U)
        high = np.frombuffer(p, np.uint16, n, 16 + 4 * n).astype(U)
        keys.append(low | (high << U(32)))
        handles.append(np.frombuffer(p, np.uint16, n, 16 + 6 * n).astype(np.int64) | (source << 16))
    return np.concatenate(keys), np.concatenate(handles)


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct member lists (handles) of one partition's buckets with two or more;
    ``least`` is the member of the smallest hash, which lists that share most of
    their members mostly have in common."""
    key, node = _unpack(pdf["pack"].tolist())
    by = np.lexsort((node, key))
    key, node = key[by], node[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    begin = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))
    many = np.nonzero(np.diff(begin) > 1)[0]
    lists = sorted({node[begin[i]:begin[i + 1]].tobytes() for i in many})
    digest = np.array([xxhash.xxh3_64_intdigest(x) for x in lists], U).astype(np.int64)
    least = [int(x[np.argmin(mix(x.view(U)))]) for x in (np.frombuffer(y, np.int64) for y in lists)]
    return pd.DataFrame({"list": digest, "handles": lists, "least": np.array(least, np.int64)})


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists, sorted by ``least``: those with one ``least`` that share half the members of
    the shorter become their union."""
    unions: list[np.ndarray] = []
    key = None

    def done():
        blobs = [u.tobytes() for u in unions]
        yield pa.RecordBatch.from_arrays(
            [pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in blobs], pa.int64()), pa.array(blobs, pa.binary())],
            names=["list", "handles"])
    for b in batches:
        for least, blob in zip(b.column("least").to_pylist(), b.column("handles")):
            if least != key:
                yield from done()
                unions, key = [], least
            own = np.frombuffer(blob.as_py(), np.int64)
            for i, u in enumerate(unions):
                if 2 * len(np.intersect1d(u, own, assume_unique=True)) >= min(len(u), len(own)):
                    unions[i] = np.union1d(u, own)
                    break
            else:
                unions.append(own)
    yield from done()


def _exploded(lists: DataFrame) -> DataFrame:
    """(list, handle): one row per list and member."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x, np.int64) for x in b.column("handles").to_pylist()]
            if own:
                name = np.repeat(b.column("list").to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.concatenate(own))], names=["list", "handle"])
    return lists.mapInArrow(run, "list long, handle long")


def _near(words: np.ndarray, size: np.ndarray, i: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the members j may be similar to member i by size and sketch, and how far they are."""
    j = j[DEN * np.minimum(size[j], size[i]) >= NUM * np.maximum(size[j], size[i])]
    far = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
    ok = far <= _differ(size[j], size[i])
    return j[ok], far[ok]


def _lists(pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each list (or slice, or tile) of one partition."""
    # equal sets that different tasks met are one node
    pdf = pdf.sort_values([*names, "node"], ignore_index=True).drop_duplicates([*names, "node"], ignore_index=True)
    same = np.ones(max(len(pdf) - 1, 0), bool)
    for name in names:
        values = pdf[name].to_numpy()
        same &= values[1:] == values[:-1]
    begin = [0, *(np.nonzero(~same)[0] + 1).tolist(), len(pdf)] if len(pdf) else [0]
    for b, e in zip(begin[:-1], begin[1:]):
        yield int(pdf[names[0]].iat[b]), pdf.iloc[b:e]


def _pair_rows(pairs: set[tuple[int, int]]) -> pd.DataFrame:
    a, b = zip(*sorted(pairs)) if pairs else ((), ())
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs of the short lists of one partition. A list with few candidates
    gives them all. A dense one (most likely near copies) links each node to its
    nearest predecessor, and is named in a row of its own."""
    pairs: set[tuple[int, int]] = set()
    names: list[int] = []
    for name, part in _lists(pdf, ["list"]):
        node, size = part["node"].tolist(), part["n"].to_numpy(np.int64)
        words = folded(part["sketch"].tolist())
        m, total = len(node), 0
        every: list[tuple[int, int]] = []
        nearest: list[tuple[int, int]] = []
        for i in range(1, m):
            j, far = _near(words, size, i, np.arange(i))
            if len(j):
                total += len(j)
                nearest.append((node[j[np.argmin(far)]], node[i]))
                every += [(node[x], node[i]) for x in j.tolist()]
        if total <= DENSE * m:
            pairs.update(every)
        else:
            pairs.update(nearest)
            names.append(name)
    rows = [(a, b, None) for a, b in sorted(pairs)] + [(None, None, name) for name in names]
    cols = list(zip(*rows)) or [(), (), ()]
    return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in zip(("a", "b", "dense"), cols)})


def _to_pivots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each member of a slice with its nearest pivot, the pivots with all they may match."""
    pairs: set[tuple[int, int]] = set()
    pdf = pdf.sort_values("pivot", ascending=False, kind="stable")     # a pivot that is a member stays a pivot
    for _, part in _lists(pdf.drop_duplicates(["list", "slice", "node"]), ["list", "slice"]):
        node, size = part["node"].tolist(), part["n"].to_numpy(np.int64)
        words = folded(part["sketch"].tolist())
        pivots = np.nonzero(part["pivot"].to_numpy(bool))[0]
        own = set(pivots.tolist()) if part["slice"].iat[0] == 0 else set()
        for i in range(len(node)):
            j, far = _near(words, size, i, pivots[pivots != i])
            if len(j):
                j = j if i in own else j[[np.argmin(far)]]
                pairs.update((min(node[x], node[i]), max(node[x], node[i])) for x in j.tolist())
    return _pair_rows(pairs)


def _tiles(nearest: bool):
    """Candidates across components of one partition's tiles: all, or of each node that
    asks the nearest. A tile compares the nodes of its two sides; a tile of one side
    its nodes among each other."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs: set[tuple[int, int]] = set()
        for _, part in _lists(pdf, ["list", "left", "right"]):
            side, comp = part["side"].to_numpy(), part["comp"].to_numpy()
            node, size = part["node"].tolist(), part["n"].to_numpy(np.int64)
            words = folded(part["sketch"].tolist())
            both = bool((side == 1).any())
            asks = part["asks"].to_numpy(bool) if nearest else side == 0
            for i in np.nonzero(asks)[0].tolist():
                others = np.nonzero((comp != comp[i]) & ((side != side[i]) if both else True))[0]
                j, far = _near(words, size, i, others)
                if nearest and len(j):
                    j = j[[np.argmin(far)]]
                pairs.update((min(node[x], node[i]), max(node[x], node[i])) for x in j.tolist())
        return _pair_rows(pairs)
    return run


def _pivot_pairs(long: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """Candidates of the long lists: every node in one of its lists, with its nearest pivot."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x, np.int64) for x in b.column("handles").to_pylist()]
            if own:
                some = [x[np.linspace(0, len(x) - 1, PIVOTS).astype(np.int64)] for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("list").to_numpy(), PIVOTS)),
                                                  pa.array(np.concatenate(some))], names=["list", "handle"])
    chosen = _exploded(long).groupBy("handle").agg(F.min("list").alias("list"))
    chosen = stage(chosen, "chosen")
    slices = chosen.groupBy(F.col("list").alias("s_list")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("slices"))
    here = F.col("list") == F.col("s_list")
    members = chosen.join(slices, here).select("list", F.pmod(F.xxhash64("handle"), F.col("slices")).cast("int").alias("slice"),
                                               "handle", F.lit(False).alias("pivot"))
    pivots = long.mapInArrow(pick, "list long, handle long").join(slices, here).select(
        "list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "handle", F.lit(True).alias("pivot"))
    rows = members.unionAll(pivots).join(nodes, "handle").drop("handle")
    part = F.pmod(F.xxhash64("list", "slice"), F.lit(parts)).cast("int").alias("part")
    return rows.groupBy(part).applyInPandas(_to_pivots, "a long, b long")


def _mixed(members: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """Lists (members are (list, node)) of several components: staged p_list, major (the
    largest component), n_major, n_all; and how many pairs lie across components."""
    rows = members.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = rows.groupBy(F.col("list").alias("p_list"), "comp").agg(F.count(F.lit(1)).alias("n"))
    n_all = F.sum("n")
    mixed = stage(per.groupBy("p_list").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major"), n_all.alias("n_all"),
        F.count(F.lit(1)).alias("comps"), ((n_all * n_all - F.sum(F.col("n") * F.col("n"))) / 2).alias("across")).filter("comps > 1"), "mixed")
    return mixed, int(mixed.agg(F.sum("across")).first()[0] or 0)


def _tile_pairs(members: DataFrame, mixed: DataFrame, nodes: DataFrame, found: DataFrame, parts: int, turn: int | None) -> DataFrame:
    """Candidates across components of the ``mixed`` lists: all, or in a ``turn`` the
    nearest of each node in the list that it asks then."""
    rows = members.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    minors = F.ceil((F.col("n_all") - F.col("n_major")) / TILE).cast("int")
    majors = F.ceil(F.col("n_major") / TILE).cast("int")
    mixed = mixed.select("p_list", "major", minors.alias("minors"), majors.alias("majors"))
    rows = rows.join(mixed, F.col("list") == F.col("p_list"))
    asked = rows.groupBy(F.col("node").alias("a_node")).agg(
        F.min_by("list", F.xxhash64("list", F.lit(turn))).alias("a_list")) if turn is not None else None
    asks = F.lit(True) if asked is None else F.col("list") == F.col("a_list")
    rows = rows if asked is None else rows.join(asked, F.col("node") == F.col("a_node"))
    is_major = F.col("comp") == F.col("major")
    at = F.pmod(F.xxhash64("node"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))).cast("int")
    rows = rows.select("list", "node", "comp", asks.alias("asks"), is_major.alias("is_major"), "minors", "majors", at.alias("at"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    key = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), side.alias("side"))
    # slices of minors are 0, 1, ..., those of the largest component -1, -2, ...
    of_major = F.transform(upto("minors"), lambda i: key(i, -1 - F.col("at"), F.lit(1)))
    of_minor = F.concat(
        F.transform(upto("majors"), lambda k: key(F.col("at"), -1 - k, F.lit(0))),
        F.transform(upto("minors"), lambda j: key(F.greatest("at", j), F.least("at", j), (j > F.col("at")).cast("int"))))
    rows = rows.select("list", "node", "comp", "asks", F.explode(F.when(F.col("is_major"), of_major).otherwise(of_minor)).alias("key")).select(
        "list", "node", "comp", "asks", "key.*")
    known = nodes.groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    part = F.pmod(F.xxhash64("list", "left", "right"), F.lit(parts)).cast("int").alias("part")
    return rows.join(known, "node").groupBy(part).applyInPandas(_tiles(turn is not None), "a long, b long").distinct()


# --- verification and components --------------------------------------------------------

def _mark_filter(marks: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits of the text marks."""
    shift = 64 - FILTER_BITS
    rows = marks.select(F.expr(f"cast(shiftrightunsigned(mark, {shift + 6}) as int)").alias("word"),
                        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(mark, {shift}) % 64 as int))").alias("bit"))
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2**(FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return bits.view(U)


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, text of the documents with the needed marks, without a shuffle: the bit
    filter drops nearly all others, and what it lets through by chance is a text
    that no pair asks for."""
    bits = docs.sparkSession.sparkContext.broadcast(_mark_filter(needed))  # 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        for b in batches:
            at = b.column("mark").to_numpy().view(U) >> U(64 - FILTER_BITS)
            hit = (bits.value[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
            out = []
            for text in b.filter(pa.array(hit)).column("text").to_pylist():
                node = node_of(ngrams(text, hashes))
                if node not in sent:
                    sent.add(node)
                    out.append((node, text))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())],
                                             names=["node", "text"])
    return docs.select("mark", "text").filter("text is not null").mapInArrow(run, "node long, text string")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Each a meets its b's in slices; the
    texts are joined once to all that is to be delivered, then dealt by slice."""
    spread = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    own = spread.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                        F.lit(None).cast("long").alias("b"))
    other = pairs.join(spread, "a").select(
        F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"), "b")
    rows = own.unionAll(other).join(texts, "node").select("a", "slice", "b", "text").repartition(
        "a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = np.empty(0, U)
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text"))):
                s = ngrams(text, hashes)
                if b is None:
                    own = s
                elif similar(own, s):
                    out.append((a, b))
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])
    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Staged (node, comp): the smallest node reachable, for all nodes with an edge
    (a, b), from large-star and small-star steps until the edges are stars."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    last = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old, e = e, stage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionAll(
            low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(old)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    found = stage(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(roots), "components")
    release(e)
    return found


def contracted(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (staged node, comp) with the components that the links (a, b) join made one."""
    name = lambda c: found.select(F.col("node").alias(f"n_{c}"), F.col("comp").alias(f"c_{c}"))
    edges = more.join(name("a"), F.col("a") == F.col("n_a"), "left").join(name("b"), F.col("b") == F.col("n_b"), "left")
    new = components(edges.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    new = new.select(F.col("node").alias("old"), F.col("comp").alias("to"))
    moved = found.join(new, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    first = new.join(found, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("to").alias("comp"))
    out = stage(moved.unionAll(first), "components")
    release(found)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> tuple[
        DataFrame, DataFrame, list[DataFrame]]:
    """(rows, links, staged): rows has doc_id, mark and mark_2 (``marks`` of id and
    text), n_shingles, node (null for the empty set), comp and component_id of
    every row; links are the verified pairs of nodes (a, b) that make the
    components; staged are the tables that rows reads."""
    first, second = marks(docs, [id_col, text_col], whole)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), first.alias("mark"), second.alias("mark_2"))
    spark = docs.sparkSession
    n_docs, n_chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_chars // PART_CHARS))
    hot = spark.sparkContext.broadcast(_hot_ngrams(docs, n_docs))  # HOT_MAX numbers at most
    packs, rows = stage_split(_scan(docs, hot, parts), "scan", "is_pack")
    lists = stage(packs.select("part", "pack").groupBy("part").applyInPandas(
        _bucket, "list long, handles binary, least long").dropDuplicates(["list"]), "lists")
    release(packs)
    nodes = rows.filter("handle is not null").select("handle", "node", "n", "sketch")
    is_long = F.octet_length("handles") > 8 * SHORT
    short, long = lists.filter(~is_long).select("list", "handles"), lists.filter(is_long)
    long = stage(long.repartition("least").sortWithinPartitions("least").mapInArrow(_united, "list long, handles binary"), "united")
    any_long = not long.isEmpty()
    by_part = F.pmod("list", F.lit(parts)).cast("int").alias("part")
    inside = stage(_exploded(short).join(nodes, "handle").drop("handle").groupBy(by_part).applyInPandas(
        _inside, "a long, b long, dense long"), "pairs")
    first = inside.filter("a is not null").select("a", "b")
    if any_long:
        first = first.unionAll(stage(_pivot_pairs(long, nodes, parts), "pivots"))
    first = stage(first.distinct(), "candidates")
    dense = inside.filter("dense is not null").select(F.col("dense").alias("list")).distinct()
    ends = first.select(F.explode(F.array("a", "b")).alias("node"))
    members = None
    if any_long or not dense.isEmpty():
        again = long.unionAll(short.join(dense, "list", "left_semi"))
        members = stage(_exploded(again).join(nodes.select("handle", "node"), "handle").select("list", "node").distinct(), "members")
        ends = ends.unionAll(members.select("node"))
    by_node = rows.filter("handle is not null").groupBy("node").agg(F.min("mark").alias("mark"))
    ends = stage(ends.distinct().join(by_node, "node"), "ends")
    texts = stage(_texts(docs, ends), "texts")       # one scan for all that is verified below
    links = stage(_verified(first, texts), "links")
    found = components(links)
    if members is not None:
        turn, merged, n_members = 0, True, members.count()
        while True:
            mixed, pairs = _mixed(members, found)
            last = pairs <= DIRECT * n_members or not merged
            across = stage(_tile_pairs(members, mixed, nodes, found, parts, None if last else turn), "across")
            more = stage(_verified(across, texts), "links") if pairs and not across.isEmpty() else None
            release(across, mixed)
            merged = more is not None and not more.isEmpty()
            if merged:
                links, found = links.unionAll(more), contracted(found, more)
            if last:
                break
            turn += 1
        release(members)
    release(lists, long, inside, first, ends, texts)
    names = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    members = names.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = members.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    labels = stage(members.join(ids, "comp").select(F.col("node").alias("l_node"), "comp", "component_id"), "labels")
    release(found)
    out = rows.join(labels, F.col("node") == F.col("l_node"), "left").select(
        "doc_id", "mark", "mark_2", F.col("n").alias("n_shingles"), "node", "comp",
        F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links, [rows, labels]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return join(docs, id_col, text_col)[0].select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (of several rows
    with that id the one whose marks, hashes of the whole row, are smallest);
    documents without words all stay, repeated ones too. Columns unchanged."""
    rows, _, staged = join(docs, id_col, text_col, whole=True)
    best = rows.filter("node is not null").groupBy("comp").agg(
        F.min_by(F.struct("mark", "mark_2"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "mark_2")).alias("m"))
    empty = rows.filter("node is null").select("mark", "mark_2", F.lit(True).alias("every"))
    kept = stage(best.select("m.*", F.lit(False).alias("every")).unionAll(empty).select(
        F.col("mark").alias("mark_1"), "mark_2", "every").distinct(), "kept")
    release(*staged)
    # of rows that are equal in every column one is as good as another
    found = marked(docs, [id_col, text_col], whole=True).join(kept, ["mark_1", "mark_2"])
    each = F.when(F.col("every"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return found.withColumn("each", each).dropDuplicates(["mark_1", "mark_2", "each"]).select("doc.*")
