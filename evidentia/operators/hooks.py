"""Model hooks (U1-U3): the points where a user's model plugs into a job.

Each hook is a ``mapInArrow`` (the pair scorer: ``mapInPandas``) over Arrow batches. The model is built once
per task by a user factory (no model object is shipped from the driver), and
it is called in micro-batches of ``batch_size`` texts. Every output row keeps
the key columns of its input row, so responses are never matched to prompts
by list position. If a task is lost, Spark runs it again on the same rows;
a deterministic model gives the same output.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Generate = Callable[[list[str]], list[str]]

# The functions this module runs on Python workers travel by value, so the
# workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
Logits = Callable[[list[str]], list[dict[str, float]]]
Score = Callable[[list[str], list[str]], list[tuple[float, float, float]]]


def _chunks(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i:i + size]


def complete(prompts: DataFrame, factory: Callable[[], Generate], text_col: str = "prompt_text",
             out_col: str = "response", batch_size: int = 4, keep: Sequence[str] | None = None) -> DataFrame:
    """One response per prompt row, from ``factory()``'s generate call. The rows
    keep the columns ``keep`` (by default all), so long prompts need not come back."""
    keep = prompts.columns if keep is None else list(keep)
    schema = T.StructType([prompts.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = factory()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text_col).to_pylist()]
            out: list[str] = []
            for chunk in _chunks(texts, batch_size):
                out.extend(generate(chunk))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, out_col])
    return prompts.mapInArrow(run, schema)


def first_token_logits(prompts: DataFrame, factory: Callable[[], Logits],
                       text_col: str = "prompt_text", out_col: str = "logits",
                       batch_size: int = 4) -> DataFrame:
    """Candidate-token logits of the first answer token, as
    MAP<STRING, DOUBLE> (the input of ``functions.logits``)."""
    schema = T.StructType(prompts.schema.fields +
                          [T.StructField(out_col, T.MapType(T.StringType(), T.DoubleType()))])
    maps = pa.map_(pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the other columns pass as they are, the maps are built from their entries
        logits = factory()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text_col).to_pylist()]
            out: list = []
            for chunk in _chunks(texts, batch_size):
                out.extend(None if d is None else list(d.items()) for d in logits(chunk))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, maps)], names=[*batch.schema.names, out_col])
    return prompts.mapInArrow(run, schema)


def score_pairs(pairs: DataFrame, factory: Callable[[], Score],
                cols: Sequence[str] = ("candidate", "reference"), batch_size: int = 32) -> DataFrame:
    """Precision / recall / F1 per (candidate, reference) pair from a
    user scorer (e.g. a contextual-embedding model)."""
    cand, ref = cols
    extra = [T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")]
    schema = T.StructType(pairs.schema.fields + extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for pdf in batches:
            c, r = pdf[cand].fillna("").tolist(), pdf[ref].fillna("").tolist()
            out: list[tuple[float, float, float]] = []
            for i in range(0, len(c), batch_size):
                out.extend(score(c[i:i + batch_size], r[i:i + batch_size]))
            p, rc, f = zip(*out) if out else ((), (), ())
            yield pdf.assign(precision=list(p), recall=list(rc), f1=list(f))
    return pairs.mapInPandas(run, schema)
