"""Logit maths as Column expressions over MAP<STRING, DOUBLE> (M1-M4).

Generic over the token set: higher-order map functions, no fixed columns.
ANSI mode raises on division by zero, so every division is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candidate tokens and the evidence direction per mode (M3).
TOKENS = ["true", "false", "maybe"]
D_POSITIVE = {"2support": "true", "2refute": "false"}


def softmax(logits: Column) -> Column:
    """M1: shift by the max, exponentiate, normalise."""
    vals = F.map_values(logits)
    m = F.array_max(vals)
    s = F.aggregate(vals, F.lit(0.0), lambda a, v: a + F.exp(v - m))
    return F.transform_values(logits, lambda k, v: F.exp(v - m) / s)


def delta_p(p_with: Column, p_without: Column) -> Column:
    """M2: change of probability with evidence, scaled to [-1, 1]."""
    def d(k, pw, po):
        up = F.when(po < 1, (pw - po) / (1 - po)).otherwise(F.lit(0.0))
        down = F.when(po > 0, (pw - po) / po).otherwise(F.lit(0.0))
        return F.when(pw >= po, up).otherwise(down)
    return F.map_zip_with(p_with, p_without, d)


def d_weight(mode: Column, token: Column) -> Column:
    """M3: +1 for the token the evidence points to, -1 for the others; NULL
    for modes without a direction."""
    out = None
    for m, pos in D_POSITIVE.items():
        w = F.when(token == pos, F.lit(1.0)).otherwise(F.lit(-1.0))
        out = F.when(mode == m, w) if out is None else out.when(mode == m, w)
    return out


def acu(delta: Column, mode: Column) -> Column:
    """M4: mean over tokens of D(token) * delta-P; NULL when the mode has no
    direction (M6)."""
    entries = F.map_entries(delta)
    total = F.aggregate(entries, F.lit(0.0),
                        lambda a, e: a + d_weight(mode, e["key"]) * e["value"])
    return F.when(mode.isin(list(D_POSITIVE)), total / F.size(entries))


def argmax_token(logits: Column, order: list[str] = TOKENS) -> Column:
    """Token with the largest logit; ties go to the earlier token."""
    vals = [F.element_at(logits, F.lit(t)) for t in order]
    best = F.greatest(*vals)
    out = None
    for t, v in zip(order, vals):
        out = F.when(v == best, F.lit(t)) if out is None else out.when(v == best, F.lit(t))
    return out
