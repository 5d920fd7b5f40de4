"""Stateless extraction on a Structured Streaming source.

The extraction rules are plain Column expressions, so the batch job runs
unchanged on ``readStream``: each micro-batch of new response files is
parsed and appended to the sink; no state, watermark or shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.plans.extraction import extract_answers


def parsed_stream(spark: SparkSession, source_dir: str, schema, dialect: str = "strict",
                  max_files_per_trigger: int = 64) -> DataFrame:
    """Parquet response files arriving in ``source_dir`` -> parsed rows."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    return extract_answers(src, dialect)


def start_parquet_sink(parsed: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Append parsed rows to a Parquet table; the checkpoint folder (a shared
    folder on a cluster) makes the sink exactly-once across restarts."""
    flat = parsed.withColumn("bullets_text", F.array_join("bullets", " | ")).drop("bullets")
    return (flat.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).outputMode("append").start())
