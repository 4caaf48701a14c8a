"""Language identification: hashed subword embeddings, a linear softmax, calibrated rejection.

The model learns from text and language of the rows given for training and sees the text alone
when it predicts. A text without any letter (or null) is ``und``. A prediction is *rejected* when
it is ``und`` or its calibrated chance is below a threshold that the rows set aside for calibration
give. Below ``EVEN`` the model itself holds the answer for wrong more likely than right. Above, the
threshold is the chance that all but ``WRONG`` of the wrong answers stay below, as far as no more
than ``LOST`` of the right ones do. Wrong answers are those to rows set aside of which the model gets
the language wrong, to all of them with their own language taken from the model (a language it never
learned), and to junk, texts as long as they are of features dealt at random.

Defined results: without any training rows every text is ``und`` with score 0; empty tables give
empty results; whole texts are scored whatever their length; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import subword
from .storage import Scratch
from .text import pieces, tidied

UNKNOWN = "und"
EVEN, WRONG, LOST = 0.5, 0.05, 0.01


def threshold(model: subword.Model, sample: list) -> float:
    rng = np.random.default_rng(11)
    right, wrong = [], []
    for label, _, buckets, counts in sample[4::5]:  # those that training sets aside
        at, n = np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.float32)
        share = n / max(n.sum(), 1)
        chances = lambda at, share=share: (share @ model.table[at] + model.bias) * model.scale + model.shift
        own = model.classes.index(label)
        z = chances(at)
        (right if z.argmax() == own else wrong).append(subword.softmax(z[None]).max())
        if len(model.classes) > 2:
            wrong.append(subword.softmax(np.delete(z, own)[None]).max())
        if len(model.classes) > 1 and len(at):
            wrong.append(subword.softmax(chances(rng.integers(0, subword.BUCKETS, len(at)))[None]).max())
    found = [np.quantile(x, q, method=m) for x, q, m in ((wrong, 1 - WRONG, "higher"), (right, LOST, "lower")) if x]
    return float(max(EVEN, min(found, default=EVEN)))


def identify(spark: SparkSession, docs: DataFrame, learn: Column | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", sample: int = subword.SAMPLE) -> DataFrame:
    """One row for each of ``docs``: doc_id, held_out, lang_pred, score, rejected. learn: rows to learn from."""
    Scratch(spark, "langid")
    learn = F.lit(True) if learn is None else learn
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("label"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    model, got = subword.fit(rows.filter("learn AND label IS NOT NULL AND text IS NOT NULL"), sample)
    least = threshold(model, got)
    carry = rows.select(F.col("id"), (~F.col("learn")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    out = subword.predict(carry, model, ["id", "held_out", "letters"])
    known = F.col("letters") & F.col("best").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        F.when(known, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.least(F.greatest(F.col("chance"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("score"),
        (~known | (F.col("chance") < least)).alias("rejected"),
    )


def accepted(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns, as they are."""
    Scratch(spark, "langid")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("label"), F.col(text).alias("text"))
    model, got = subword.fit(rows.filter("label IS NOT NULL AND text IS NOT NULL"))
    least = threshold(model, got)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches):
        m = shared.value
        for batch in batches:
            for part in pieces(batch, text, subword.SLICE):
                texts = part.column(text)
                sure = m.probabilities(texts).max(axis=1) >= least if m.classes else np.zeros(part.num_rows, bool)
                yield part.filter(pa.array(sure & letters(texts)))

    return docs.mapInArrow(tidied(keep), docs.schema)


def letters(texts: pa.Array) -> np.ndarray:
    """Which texts hold a letter."""
    found = pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}")
    return np.asarray(found.fill_null(False))
