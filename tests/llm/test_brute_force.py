"""Whole results of the operators that SQL cannot express, against plain code."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from evidentia.llm import chunk_dedup as D
from evidentia.llm import line_quality as Q
from evidentia.llm import secret_scan as S

# --- chunk dedup: all spans ----------------------------------------------------------------

GEAR = [xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)]


def plain_chunks(text):
    """Byte by byte: a cut where the hash of the last 16 bytes is small, between characters."""
    raw = text.encode()
    cuts, last = [], 0
    for i in range(len(raw)):
        h = sum(GEAR[raw[i - k]] << k for k in range(min(16, i + 1))) & 0xFFFFFFFF
        boundary = i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80
        if h < (1 << 32) // D.AVERAGE and boundary or i + 1 == len(raw):
            at = last
            while i + 1 - at > D.LARGEST:      # no cut for long
                at += D.LARGEST
                while raw[at] & 0xC0 == 0x80:
                    at -= 1
                cuts.append(at)
            cuts.append(i + 1)
            last = i + 1
    out, at, chars = [], 0, 0
    for c in cuts:
        piece = raw[at:c].decode()
        words = sum(1 for k, ch in enumerate(piece) if ch not in " \t\n\x0b\x0c\r" and (
            (raw[at + len(piece[:k].encode()) - 1:][:1] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if at + k else True))
        out.append((piece, chars, chars + len(piece), words))
        at, chars = c, chars + len(piece)
    return out


def plain_spans(docs, min_words):
    rows = [(i, plain_chunks(t) if t else []) for i, t in docs]
    holders = defaultdict(list)
    for i, chunks in rows:
        for piece, *_ in chunks:
            holders[piece].append(i)
    out = []
    for i, chunks in rows:
        seen, run = set(), []
        for c in [*chunks, None]:
            if c is not None:
                ids = [h for h in holders[c[0]] if h is not None]
                keeper = min(ids) if ids and (min(ids) < max(ids) or None in holders[c[0]]) else None
                other = keeper is not None and i != keeper
                dup = other or c[0] in seen
                seen.add(c[0])
                if dup:
                    run.append((c, keeper if other else i))
                    continue
            words = sum(x[0][3] for x in run)
            if run and words >= min_words:
                out.append((i, run[0][0][1], run[-1][0][2], words, tuple(sorted({k for _, k in run if k is not None}))))
            run = []
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_repeated_spans(make_docs, seed):
    rng = random.Random(seed)
    vocabulary = ["wörd", "日本", "plain", "text", "a", "bb", "ccc-c", "d", "é", "long" * 9] + [f"v{i}" for i in range(200)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(n) for n in (20, 60, 60, 120)] + ["x" * 900 + " tail " * 20]
    docs = []
    for i in range(60):
        parts = [say(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), rng.choice("\n \t") + say(rng.randrange(0, 30))]
        docs.append((rng.choice([i, i, i, None, 7]), "".join(parts)))
    docs += [(100, None), (101, ""), (102, passages[3]), (103, passages[3])]
    got = [(r.doc_id, r.start, r.end, r.n_words, tuple(r.first_doc_ids)) for r in D.repeated_spans(make_docs(docs)).collect()]
    want = plain_spans(docs, D.MIN_WORDS)
    assert sorted(got, key=str) == want and len(want) > 20


# --- secret scan: all entropy spans ----------------------------------------------------------

def plain_entropy_spans(text, base):
    """Character by character: key characters outside base spans and allowed segments."""
    out, at = [], 0
    key = lambda c: re.fullmatch(r"[A-Za-z0-9+/_=-]", c)
    while at < len(text):
        end = at
        while end < len(text) and key(text[end]):
            end += 1
        if end - at >= S.SHORT_WINDOW:
            gone = [False] * len(text)
            for a, _, b in base:
                for k in range(max(a, at), min(b, end)):
                    gone[k] = True
            for m in S.ALLOWED.finditer(text[at:end]):
                for k in range(at + m.start(), at + m.end()):
                    gone[k] = True
            cut = any(gone[at:end])
            k = at
            while k < end:
                if gone[k]:
                    k += 1
                    continue
                stop = k
                while stop < end and not gone[stop]:
                    stop += 1
                a, b = k, stop
                if cut:
                    a += len(text[a:b]) - len(text[a:b].lstrip("/_=+-"))
                    b -= len(text[a:b]) - len(text[a:b].rstrip("/_+-"))
                if b - a >= S.SHORT_WINDOW and plain_secret(text[a:b]):
                    out.append((a, 3, b))
                k = stop
        at = max(end, at + 1)
    return out


def plain_secret(s):
    width, col = (S.WINDOW, 0) if len(s) >= S.WINDOW else (S.SHORT_WINDOW, 1)
    pairs = [a + b for a, b in zip(s.lower(), s[1:].lower()) if a.isalpha() and b.isalpha()]
    common = sum(p in S.PAIRS for p in pairs)
    if re.fullmatch(r"[0-9_=+/-]*", s):
        return False
    if (not re.search("[0-9]", s) or re.fullmatch(r"(?:[A-Za-z]{2,}[/_=+-]+)+[0-9]{1,6}", s)) and common >= S.WORDY * len(pairs):
        return False
    if col and sum(c.isalpha() for c in s) >= S.LETTERS * len(s) and common >= S.WORDY_SHORT * len(pairs):
        return False
    entropy = max(-sum(n / width * math.log2(n / width) for n in Counter(s[i:i + width]).values()) for i in range(len(s) - width + 1))
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        limit = (3.0, 2.9)[col]
    elif re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", s):
        limit = (3.6, 3.3)[col]
    else:
        limit = (3.9, 3.5)[col]
    return entropy >= limit - 1e-12


def test_all_entropy_spans(make_docs):
    rng = random.Random(9)
    classes = ["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "ab"]
    word = lambda: rng.choice(["there", "the-house/of", "an_example", "2024-05-01", "2024-05-01T10", "0123-4567", "weather", "in"])
    token = lambda: "".join(rng.choice(rng.choice(classes)) for _ in range(1)) and "".join(
        rng.choice(c) for c in [rng.choice(classes)] for _ in range(rng.choice([8, 15, 16, 19, 20, 24, 40, 90])))
    docs = []
    for i in range(400):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            parts += [rng.choice([word, token])(), rng.choice([" ", " ", "/", "-", "_", "=", ":", "é", "password=", "AKIA", "\n", ""])]
        docs.append((i, "".join(parts)))
    got = {r.doc_id: r.spans for r in S.scan(make_docs(docs)).collect()}
    found = 0
    for i, text in docs:
        base = S.base_spans(text)
        want = sorted(base + plain_entropy_spans(text, base))
        assert got[i] == ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in want), text
        found += len(want) - len(base)
    assert found > 100


# --- quality rules: removed words, verdicts, kept lines ------------------------------------------

def plain_lines(text):
    return [re.sub(r"[\W\d_]+", " ", line.lower()).strip() or line.strip() if line.split() else None for line in (text or "").split("\n")]


def plain_quality(docs, max_docs, max_share):
    marks = defaultdict(set)
    holders = defaultdict(set)
    for _, text, host in docs:
        keys = [k for k in plain_lines(text) if k is not None]
        marks[host].add(tuple(keys))
        for k in keys:
            holders[host, k].add(tuple(keys))
    out = []
    for i, text, host in docs:
        words, removed, left = len((text or "").split()), 0, []
        for line, key in zip((text or "").split("\n"), plain_lines(text)):
            short = key is not None and len(key) < Q.SHORT_CHARS and len(key.split(" ")) < Q.SHORT_WORDS
            limit = max(max_docs, (max(Q.SHORT_SHARE, max_share) if short else max_share) * len(marks[host]))
            if key is not None and len(holders[host, key]) > limit:
                removed += len(line.split())
            else:
                left.append(line)
        w = (text or "").split()
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
        failed = words < 10 or 100 * len(hit) > 20 * words
        depleted = removed > 0 and 2 * removed >= words and (words - removed < 10 or words - removed < 0.3 * words)
        out.append((i, removed, failed, not failed and not depleted, "\n".join(left)))
    return out


def test_quality_rules_against_plain_counting(make_docs):
    rng = random.Random(12)
    shared = ["Home", "All rights reserved", "read the whole story about our newest products here today", "12 34", "日本語の長い段落です"]
    docs = []
    for i in range(160):
        own = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.choice([1, 4, 9, 30]))) for _ in range(rng.randrange(4))]
        lines = own + rng.sample(shared, rng.randrange(5)) + rng.choice([[], [""], [" \t"]])
        rng.shuffle(lines)
        docs.append((rng.choice([i, 3]), "\n".join(lines).upper() if i % 9 == 0 else "\n".join(lines), rng.choice(["s", "s", "t", None])))
    docs += [(500, None, "s"), (501, "", None)] + [docs[5]] * 30
    got = Q.judge(make_docs(docs, extra=True), max_docs=6, max_share=0.1).collect()
    want = plain_quality(docs, 6, 0.1)
    assert sorted((r.doc_id, r.removed_words, r.base_failed, r.kept) for r in got) == sorted(w[:4] for w in want)
    assert 0 < sum(w[3] for w in want) < len(docs) and sum(w[1] for w in want) > 100
    kept = Q.clean(make_docs(docs, extra=True), max_docs=6, max_share=0.1).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((w[0], w[4]) for w in want if w[3])
