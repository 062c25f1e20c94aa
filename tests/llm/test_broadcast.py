"""Joins that must not be broadcast."""
from pyspark.sql import functions as F

from pitval.llm import simhash


def test_look_ups_of_fingerprints_are_not_broadcast(spark):
    """34 look-ups a fingerprint, which Spark sizes as one: few bytes by its reckoning."""
    prints = spark.range(200).select((F.col("id") * 3).alias("fp"), F.col("id").alias("node"))
    found = simhash.links(prints)
    want = {(a, b) for a in range(200) for b in range(200) if 3 * a < 3 * b and (3 * a ^ 3 * b).bit_count() <= 2}
    assert {(r.a, r.b) for r in found.collect()} == want and want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
