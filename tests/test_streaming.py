"""The extraction job on a file stream gives the batch result."""

import os
import tempfile

from evidentia.plans.extraction import extract_answers
from evidentia.sources import surrogate as S
from evidentia.streaming.extract_stream import parsed_stream, start_parquet_sink

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="evidentia-stream-")
    src = os.path.join(root, "in")
    a = S.answers(spark, SF).select("model", "mode", "claim_id", "prompt", "response")
    a.write.parquet(src)
    q = start_parquet_sink(parsed_stream(spark, src, a.schema),
                           os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(os.path.join(root, "out")).select("claim_id", "verdict", "confidence")
    want = extract_answers(a).select("claim_id", "verdict", "confidence")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
