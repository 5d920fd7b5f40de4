"""Secret scan: fixed patterns plus sliding-window entropy.

Three patterns give the base spans (kinds assign, access, hex). The entropy
method then adds spans: base spans and the segments of the allow-list (UUIDs,
dates, placeholder words) are cut out of each long run of key characters, and
what is left of it, on either side, is a candidate. A window slides over it and
its Shannon entropy is kept from incremental character counts. Each character
class (hex digits, base-36, mixed base-64) has its own threshold, and pieces of
16 to 19 characters have a shorter window with its own thresholds. Numbers are
suppressed, and so are words: a piece whose letters are mostly in pairs that are
common in written languages, if it is short, has no digit or is a slug or path
that ends in a number.

Defined results: a null or empty text has no spans; texts are scanned whole;
spans are code points, end exclusive; equal spans of one kind cannot occur.
Repeated rows are scanned alike and an empty table gives an empty result. Only
the named columns are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import arrow_map, by_value

by_value(__name__)

# The base patterns and their shortest lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters with the prefix
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, SHORT_WINDOW = 20, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORT_WINDOW)
# class, its characters, bits of entropy that one window must reach (long, short)
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+\Z"), 3.0, 2.9),
           ("base36", re.compile(r"(?:[0-9a-z]+|[0-9A-Z]+)\Z"), 3.6, 3.3),
           ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.9, 3.5))
# segments that are cut out of a run
ALLOWED = re.compile(
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"  # UUID
    r"|(?<![0-9A-Za-z])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9]{2}(?:[_-]?[0-9]{2})*Z?)?(?![0-9A-Za-z])"  # date, time
    r"|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE(?:KEY)?"  # documented placeholders
    r"|(?i:example|placeholder|changeme|x{6,}|123456789)")
NUMBER = re.compile(r"[0-9_=+/-]*\Z")
SLUG = re.compile(r"(?:[A-Za-z]{2,}[/_=+-]+)*[A-Za-z]{2,}[/_=+-]+[0-9]{1,6}\Z")  # path or slug with a number
# the commonest letter pairs of running text (English, German, French, Spanish)
PAIRS = frozenset("""th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa
si ar ve ra ld ur ch ie ei un ic be ge di ll ss ue el ta me io li ri co ro em ma us la om ne no ce pe tr so ho ac ec
il ot wa rs ns ee ai ad id am ca ct po pr ut ig ul im mi na lo qu""".split())
WORDY, WORDY_SHORT, LETTERS = 0.4, 0.5, 0.6
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]  # for both windows


def max_window_entropy(s: str, width: int = WINDOW) -> float:
    """Highest Shannon entropy (bits) of any window. Adding and removing one
    character changes two terms of sum(c * log2 c), so a step is O(1)."""
    counts: dict[str, int] = {}
    total = 0.0
    best = 0.0
    f = _C_LOG_C if width <= WINDOW else [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    for i, ch in enumerate(s):
        if i >= width:
            old = s[i - width]
            c = counts[old]
            total += f[c - 1] - f[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += f[c + 1] - f[c]
        counts[ch] = c + 1
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
    # a maximal run that is long enough is also the leftmost match of the longer pattern
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def wordy(s: str, share: float) -> bool:
    """Whether ``share`` of the pairs of neighbouring letters are common in words."""
    pairs = [a + b for a, b in zip(s.lower(), s[1:].lower()) if a.isalpha() and b.isalpha()]
    return sum(p in PAIRS for p in pairs) >= share * len(pairs)


def pieces(start: int, end: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the cuts leave of start:end, in order."""
    for a, b in sorted(cuts):
        if b > start and a < end:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def _secret(s: str) -> bool:
    """Whether a candidate looks random."""
    digits = any("0" <= c <= "9" for c in s)
    short = len(s) < WINDOW
    if NUMBER.match(s) or (not digits or SLUG.match(s)) and wordy(s, WORDY):
        return False
    if short and sum(map(str.isalpha, s)) >= LETTERS * len(s) and wordy(s, WORDY_SHORT):
        return False
    limit = next(limits[short] for _, chars, *limits in CLASSES if chars.match(s))
    return max_window_entropy(s, SHORT_WINDOW if short else WINDOW) >= limit


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    taken = [(b[0], b[2]) for b in base]
    for m in CANDIDATE.finditer(text):
        cuts = [c for c in taken if c[0] < m.end() and m.start() < c[1]]
        cuts += [(m.start() + a.start(), m.start() + a.end()) for a in ALLOWED.finditer(m.group())]
        for start, end in pieces(m.start(), m.end(), cuts):
            if cuts:  # separators next to what was cut out
                while start < end and text[start] in "/_=+-":
                    start += 1
                while start < end and text[end - 1] in "/_+-":
                    end -= 1
            if end - start >= SHORT_WINDOW and _secret(text[start:end]):
                out.append((start, 3, end))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """Each maximal run of overlapping spans becomes ``mark``."""
    out, at, end = [], 0, -1
    for s, _, e in sorted(spans):
        if s > end:
            out += [text[at:s], mark]
            at, end = e, e
        else:
            at = end = max(end, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans; with
    ``with_text`` also ``redacted``, the text with every span replaced."""
    def run(b: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = sorted(base + entropy_spans(text, base))
            n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
                        + ((redact(text, spans),) if with_text else ()))
        types = [pa.int64()] * 4 + [pa.string()] * (3 if with_text else 2)
        return [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return arrow_map(narrow, run, out + (", redacted string" if with_text else ""), keep=["doc_id"])


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     length_col: str = "n_chars") -> DataFrame:
    """The documents with every secret replaced by a mark; columns unchanged.
    A null text stays null; the length column follows a text that changed."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            lengths = b.column(length_col).to_pylist() if length_col in schema.names else None
            for i, text in enumerate(texts):
                base = base_spans(text or "")
                spans = base + entropy_spans(text or "", base)
                if spans:
                    texts[i] = redact(text, spans)
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            for name, values in ((text_col, texts), (length_col, lengths)):
                if values is not None:
                    at = b.schema.get_field_index(name)
                    b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
            yield b
    return docs.mapInArrow(run, schema)
