"""Next-token weights of a model's logits: penalties, temperature and nucleus, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import nucleus


def penalised(logits: DataFrame, generated: DataFrame, presence: float = 0.0, frequency: float = 0.0, repetition: float = 1.0) -> DataFrame:
    """Logits (step, token, logit) less the penalties of the tokens that a step has seen (step, token).

    A seen token loses ``presence`` once and ``frequency`` for each time; what is left is divided by
    ``repetition`` if positive, else multiplied. Steps that have seen nothing stay as they are."""
    times = generated.groupBy("step", "token").agg(F.count(F.lit(1)).alias("times"))
    less = F.col("logit") - F.lit(presence) - F.lit(frequency) * F.col("times")
    moved = F.when(less > 0, less / F.lit(repetition)).otherwise(less * F.lit(repetition))
    both = logits.join(times, ["step", "token"], "left")
    return both.withColumn("logit", F.when(F.col("times").isNull(), F.col("logit")).otherwise(moved)).drop("times")


def next_token(logits: DataFrame, generated: DataFrame, temperature: float = 1.0, top_p: float = 1.0, presence: float = 0.0, frequency: float = 0.0, repetition: float = 1.0) -> DataFrame:
    """(step, token, p): the tokens that a step may draw, with probabilities that add up to 1.

    Without temperature, the token of the largest logit, penalties left aside; ties go to the
    smaller token, there and at the nucleus' edge. Steps without logits give no rows."""
    if temperature <= 0:
        best = logits.groupBy("step").agg(F.min_by("token", F.struct(-F.col("logit"), F.col("token"))).alias("token"))
        return best.withColumn("p", F.lit(1.0))
    scaled = penalised(logits, generated, presence, frequency, repetition).withColumn("logit", F.col("logit") / F.lit(temperature))
    peak = scaled.groupBy("step").agg(F.max("logit").alias("peak"))
    weighed = scaled.join(peak, "step").select("step", "token", F.exp(F.col("logit") - F.col("peak")).alias("w"))
    kept = weighed if top_p >= 1 else nucleus(weighed, "step", "token", "w", top_p).select("step", "token", "w")
    total = kept.groupBy("step").agg(F.sum("w").alias("all"))
    return kept.join(total, "step").select("step", "token", (F.col("w") / F.col("all")).alias("p"))
