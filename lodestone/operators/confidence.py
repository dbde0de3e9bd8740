"""Claims about an architecture, with how sure they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# The confidence of the coupling and cycle claims.
COUPLING, CYCLE = 0.92, 1.0


def claims(patterns: DataFrame, coupled: DataFrame, cycles: DataFrame, n: int = 10) -> DataFrame:
    """(ord, claim, confidence, bucket, reasoning) from detected patterns, highly coupled files (file, total) and cycles (path)."""
    order = {"layered": 0, "mvc": 1, "hexagonal": 2, "event_driven": 3}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    layers = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("n1", "n2", "n3")), F.lit(0))
    total = F.col("n1") + F.col("n2") + F.col("n3")
    reasoning = (
        F.when(F.col("pattern") == "layered", F.format_string("%d layers found", layers))
        .when(F.col("pattern") == "mvc", F.when(total >= 10, "strong separation").when(total >= 5, "moderate separation").otherwise("weak separation"))
        .when(F.col("pattern") == "hexagonal", F.when((F.col("n1") >= 3) & (F.col("n2") >= 3), "clear ports and adapters").otherwise("some ports and adapters"))
        .otherwise(F.when((F.col("n1") >= 5) | (F.col("n3") >= 5), "many events or handlers").otherwise("some events or handlers"))
    )
    a = patterns.filter("detected").select(place[F.col("pattern")].alias("ord"), F.concat(F.lit("pattern "), "pattern").alias("claim"), "confidence", reasoning.alias("reasoning"))
    top = coupled.orderBy(F.desc("total"), "file").limit(1)
    b = top.select(F.lit(4).alias("ord"), F.concat(F.lit("highest coupling: "), "file").alias("claim"), F.lit(COUPLING).alias("confidence"), F.format_string("%d dependencies exceed the threshold", "total").alias("reasoning"))
    c = cycles.agg(F.min("path").alias("p")).filter("p IS NOT NULL").select(F.lit(5).alias("ord"), F.lit("circular dependencies").alias("claim"), F.lit(CYCLE).alias("confidence"), F.array_join("p", " -> ").alias("reasoning"))
    return a.unionByName(b).unionByName(c).orderBy("ord").limit(n).withColumn("bucket", rules.confidence_bucket(F.col("confidence")))


def summary(claims: DataFrame) -> DataFrame:
    """One row (total, sure, average, text)."""
    found = claims.agg(F.count("*").alias("total"), F.count_if(F.expr("confidence >= 0.8")).alias("sure"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("average"))
    return found.withColumn("text", F.format_string("%d of %d claims at high confidence (average %.2f)", "sure", "total", "average"))


#: What a claim can't see, by its place among the claims.
SCENARIOS = [
    "layers that no directory or file name shows are not seen",
    "controllers and models under other names, or in one file, are missed",
    "ports and adapters under other names are missed, and which way they depend is not proved",
    "queues and topics that no file is named after are missed",
    "imports that are made at run time are not counted, and generated files count as written ones",
    "cycles through imports at run time, or longer than those searched, are missed",
]


def explained(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with ``failure_scenario`` and, of patterns, the files in ``evidence`` (pattern, files) that speak for them."""
    scenario = F.element_at(F.array(*map(F.lit, SCENARIOS)), F.col("ord") + 1)
    found = claims.withColumn("pattern", F.when(F.col("ord") < 4, F.substring("claim", 9, 64))).join(evidence, "pattern", "left")
    return found.select(*claims.columns, scenario.alias("failure_scenario"), F.coalesce("files", F.array().cast("array<string>")).alias("evidence"))
