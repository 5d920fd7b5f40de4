"""evidentia: claim / evidence / model-response analytics as Spark DataFrame jobs.

Layout
------
sources/    readers, writers and the surrogate views over the driver tables
functions/  Column builders (text extraction, readability, logits maths)
operators/  DataFrame -> DataFrame operators (grouping, prompts, joins, pairs)
plans/      the registered queries: statistics assembled from operators
streaming/  the same stateless extraction on a Structured Streaming source
"""

from evidentia.session import get_session, checkpoint_dir  # noqa: F401
