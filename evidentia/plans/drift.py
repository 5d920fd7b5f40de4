"""Statistics over result items of drifting shape (E10, E13, E15 with F13).

``drifting_items`` writes, for every item of the answers, JSON whose confidence,
score map and graded bullets take a shape by key arithmetic: numbers, numbers in
strings, 'n/a', objects, null, or no key at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources import io as IO
from evidentia.sources import surrogate as S
from evidentia.sources import variant as V

ITEMS_PER_FILE = 2_000


def _json_sql() -> str:
    k = "cast(claim_key as string)"
    conf = ("CASE claim_key % 7 "
            "WHEN 0 THEN concat(', \"confidence\": ', cast(claim_key % 110 as string)) "
            "WHEN 1 THEN concat(', \"confidence\": \" ', cast(claim_key % 110 as string), ' \"') "
            "WHEN 2 THEN ', \"confidence\": \"n/a\"' WHEN 3 THEN '' WHEN 4 THEN ', \"confidence\": null' "
            "WHEN 5 THEN concat(', \"confidence\": ', cast(claim_key % 90 as string), '.5') "
            "ELSE ', \"confidence\": {\"value\": 5}' END")
    score = ("CASE claim_key % 5 WHEN 0 THEN '' WHEN 1 THEN ', \"bert_scores\": null' WHEN 2 THEN ', \"bert_scores\": {}' "
             "WHEN 3 THEN concat(', \"bert_scores\": {\"basic\": {\"claim\": \"0.', cast(10 + claim_key % 90 as string), '\"}}') "
             "ELSE ', \"bert_scores\": {\"basic\": {\"claim\": [1]}}' END")
    grades = ("CASE claim_key % 3 WHEN 0 THEN '' WHEN 1 THEN ', \"bullets_fk\": []' "
              "ELSE concat(', \"bullets_fk\": [{\"sentence\": \"a\", \"fk_grade\": ', cast(claim_key % 12 as string), "
              "'}, {\"sentence\": \"b\", \"fk_grade\": \"x\"}, {\"fk_grade\": \"2.5\"}]') END")
    return (f"concat('{{\"model\": \"', model, '\", \"mode\": \"', mode, '\", \"claim_id\": \"', claim_id, '\", \"key\": ', {k}, "
            f"{conf}, {score}, {grades}, '}}')")


def drifting_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, written as a grid of files and read back in one scan."""
    items = S.answers(spark, sf_dir).filter(F.col("prompt") == "basic").select("claim_id", F.expr(_json_sql()).alias("json"))
    path = IO.scratch_path(spark, "drifting-items")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count() * len(S.MODELS) * 2
    V.write_items(items, path, max(2, n // ITEMS_PER_FILE), key="claim_id")
    return V.read_items(spark, path)


def typed(items: DataFrame) -> DataFrame:
    """The typed columns of each item, with their states."""
    text = lambda name: F.try_variant_get("item", f"$.{name}", "string").alias(name)
    conf, conf_state = V.getter("item", "$.confidence", "double")
    score, score_state = V.getter("item", "$.bert_scores.basic.claim", "double")
    grades = F.transform(F.try_variant_get("item", "$.bullets_fk", "array<variant>"),
                         lambda b: F.try_variant_get(b, "$.fk_grade", "double"))
    # the list is read several times below: its own projection
    rows = items.select(text("model"), text("mode"), text("claim_id"), conf.alias("confidence"), conf_state.alias("confidence_state"),
                        score.alias("score"), score_state.alias("score_state"), grades.alias("_g"))
    good = F.filter("_g", lambda g: g.isNotNull())
    rows = rows.select("*", good.alias("_good"))
    mean = F.aggregate("_good", F.lit(0.0), lambda a, g: a + g) / F.size("_good")
    return rows.select("model", "mode", "claim_id", "confidence", "confidence_state", "score", "score_state",
                       F.when(F.size("_good") > 0, F.round(mean, 6)).alias("fk_grade"),
                       F.coalesce(F.size("_g") - F.size("_good"), F.lit(0)).cast("bigint").alias("n_bad_grades"))


def stats(items: DataFrame) -> DataFrame:
    """E10, E13, E15 per mode and model: items without a value are skipped, and
    counted with the reason."""
    state = lambda c, s: F.count_if(F.col(f"{c}_state") == s).alias(f"{c}_{s}")
    return typed(items).groupBy("mode", "model").agg(
        F.count(F.lit(1)).alias("n_items"),
        *[state(c, s) for c in ("confidence", "score") for s in ("ok", "missing", "bad")],
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.stddev_samp("confidence"), 6).alias("sd_confidence"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.count("fk_grade").alias("n_graded"), F.round(F.avg("fk_grade"), 6).alias("mean_fk"))
