"""Items of drifting shape: values, reasons, and files that are no JSON."""

from pyspark.sql import functions as F

from evidentia.sources import variant as V


def test_getter_states(spark):
    cases = [('{"a": 5}', 5.0, "ok"), ('{"a": "5.5"}', 5.5, "ok"), ('{"a": " 7 "}', 7.0, "ok"), ('{"a": "n/a"}', None, "bad"),
             ('{"a": null}', None, "missing"), ("{}", None, "missing"), ('{"a": [1]}', None, "bad"), ('{"a": {"b": 1}}', None, "bad"),
             ('{"a": ""}', None, "bad"), ("[1]", None, "missing"), ("3", None, "missing")]
    df = spark.createDataFrame([(i, j) for i, (j, _, _) in enumerate(cases)], "i int, j string")
    value, state = V.getter(F.parse_json("j"), "$.a", "double")
    got = [tuple(r) for r in df.orderBy("i").select(value.alias("v"), state.alias("s")).collect()]
    assert got == [c[1:] for c in cases]


def test_files_of_every_root(spark, tmp_path):
    files = {"a": '[{"x": 1}, {"y": [2]}, null]', "b": '{"data": [{"x": "z"}], "more": 1}', "c": "[{", "d": "", "e": '{"x": 1}', "f": "[]"}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    items = V.read_items(spark, str(tmp_path))
    got = sorted((r.source_file[0], r.pos, r.x) for r in items.select(
        "source_file", F.coalesce("pos", F.lit(-1)).alias("pos"), F.to_json("item").alias("x")).collect())
    assert [(f, p) for f, p, _ in got] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", -1), ("e", -1), ("f", -1)]
    kinds = {(r.field, r.kind): r.n for r in V.kinds(items).collect()}
    assert kinds == {("x", "BIGINT"): 1, ("y", "ARRAY"): 1, ("x", "STRING"): 1}


def test_items_are_written_in_both_roots(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("string").alias("key"), F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit("}")).alias("json"))
    V.write_items(rows, str(tmp_path / "out"), 4)
    back = V.read_items(spark, str(tmp_path / "out"))
    assert sorted(r[0] for r in back.select(F.variant_get("item", "$.id", "long")).collect()) == list(range(50))
    assert back.select("source_file").distinct().count() == 4
