"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import checkpoint_dir

# A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` to Python workers by value, so the
    workers need no installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, _UPPER, _LOWER)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; it is
    removed when the session's file systems close."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, hpath = _folder(spark, path)
    fs.deleteOnExit(hpath)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage with a table that survives lost executors, gives the
    planner its real size, and keeps column pruning for later reads."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_split(df: DataFrame, label: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """``stage`` for two kinds of rows in one pass: (rows where the boolean column
    ``flag`` is true, rows where it is false), each a table of its own."""
    path = shared_path(df.sparkSession, label)
    df.write.partitionBy(flag).parquet(path)
    schema = T.StructType([f for f in df.schema.fields if f.name != flag])
    out = []
    for value in ("true", "false"):
        fs, hpath = _folder(df.sparkSession, f"{path}/{flag}={value}")
        fs.mkdirs(hpath)  # there may be no such rows
        out.append(df.sparkSession.read.schema(schema).parquet(f"{path}/{flag}={value}"))
        out[-1].staged_at = f"{path}/{flag}={value}"
    return out[0], out[1]


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made of them
    has been staged itself."""
    for df in staged:
        fs, hpath = _folder(df.sparkSession, df.staged_at)
        fs.delete(hpath, True)


def marks(docs: DataFrame, columns: Sequence[str], whole: bool = False) -> tuple[Column, Column]:
    """Two 64-bit hashes by which rows are found again: both of the given columns, or
    the second of all columns if ``whole``. Rows that are equal in them have equal
    marks; a null is told from every value and place (the hash alone skips nulls)."""
    cols = [F.col(c) for c in columns]
    rest = [c for c in docs.columns if c not in columns] if whole else []
    flat = [F.to_json(F.struct(c)) if isinstance(docs.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else F.col(c)
            for c in rest]
    gaps = lambda some: [c.isNull() for c in some]
    return (F.xxhash64(*cols, *gaps(cols)).alias("mark_1"),
            F.xxhash64(F.lit(1), *reversed(cols), *flat, *gaps([*cols, *flat])).alias("mark_2"))


def marked(docs: DataFrame, columns: Sequence[str], whole: bool = False) -> DataFrame:
    """``docs`` as (doc, mark_1, mark_2): all columns in one struct, and their ``marks``."""
    return docs.select(F.struct(*docs.columns).alias("doc"), *marks(docs, columns, whole))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Sequence[pa.Array]], out: str,
              keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of ``df`` untouched (nulls and long ids stay exact)
    followed by the columns that ``fn`` makes of each Arrow batch; ``out`` is
    their DDL schema."""
    made = T._parse_datatype_string(out)
    schema = T.StructType([*(df.schema[k] for k in keep), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *fn(b)], names=schema.names)
    return df.mapInArrow(run, schema)
