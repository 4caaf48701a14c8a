"""Quality scores: learned hashed word and character n-gram vectors, averaged; softmax by SGD.

Features are byte n-grams, words and pairs of words; all vectors are learned, no feature is made by hand.
Labels are 0 or 1; the score is the calibrated chance of label 1.

Defined results: empty and null texts score what the model's bias gives; without training rows
every score is 0.5; a document with several or contradicting labels trains with each of them;
labels without a document are ignored; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import subword
from .storage import Scratch

CUT = 0.3
SETTINGS = {"pairs": True, "epochs": 30, "rate": 8.0}
MOST_BROADCAST = 100_000  # rows of id and label


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = subword.SAMPLE) -> DataFrame:
    """One row for each of ``docs``: doc_id, held_out, score, predicted. learn: rows to learn from; a row
    of which that cannot be told (a null id) is not learned from, and counts as held out."""
    Scratch(spark, "quality")
    learn = F.lit(True) if learn is None else learn
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").cast("string").alias("label")).filter("label IN ('0', '1')").distinct()
    # labelled ids are chosen first, so that no text moves but theirs
    learning = rows.filter("learn").select("id", "text")
    named = learning.select("id").join(marks, "id")
    counts = {r[0]: r[1] for r in named.groupBy("label").count().collect()}
    chosen = Scratch(spark, "quality").write(named.filter(subword.marked(counts, sample)).distinct(), "chosen")
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    model, _ = subword.fit(learning.join(chosen, "id"), sample, counts, **SETTINGS)
    out = subword.predict(rows.select("id", (~F.col("learn")).alias("held_out"), "text"), model, ["id", "held_out"])
    if model.classes == ["0", "1"]:
        score = F.least(F.greatest(F.col("last"), F.lit(0.0)), F.lit(1.0))
    else:  # one label only, or none
        score = F.lit({"0": 0.0, "1": 1.0}.get(model.classes[0], 0.5) if model.classes else 0.5)
    return out.select(F.col("id").alias("doc_id"), "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
