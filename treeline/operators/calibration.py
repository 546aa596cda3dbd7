"""Agreement of human and judge labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.text import strip


def normal_label(label: Column) -> Column:
    """Trimmed label with synonyms mapped; a label stored as null reads 'None', a missing one ''."""
    trimmed = strip(label)
    out = trimmed
    for word, meaning in settings.LABEL_SYNONYMS.items():
        out = F.when(trimmed == word, meaning).otherwise(out)
    return out


def agreement(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, accuracy and Cohen's kappa of columns `human` and `judge`, overall or per group.

    Labels are first condensed to a table of label pairs, so the group sizes do
    not matter to the later steps.
    """
    keys = by or []
    pairs = labels.groupBy(*keys, "human", "judge").agg(F.count(F.lit(1)).alias("c"))
    if not keys:
        keys, pairs = ["_all"], pairs.withColumn("_all", F.lit(1))
    # Both marginals of a label side by side: one row per label of a group.
    sides = pairs.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col("human").alias("label"), F.col("c").alias("h"), F.lit(0).cast("long").alias("j")),
            F.struct(F.col("judge").alias("label"), F.lit(0).cast("long").alias("h"), F.col("c").alias("j")),
        )).alias("m"),
        F.when(F.col("human") == F.col("judge"), F.col("c")).otherwise(0).alias("same"),
    ).groupBy(*keys, "m.label").agg(
        F.sum("m.h").alias("h"), F.sum("m.j").alias("j"), (F.sum("same") / 2).alias("same")
    )
    totals = sides.groupBy(*keys).agg(
        F.sum("h").alias("n"), F.sum(F.col("h").cast("double") * F.col("j")).alias("hj"), F.sum("same").alias("same")
    )
    po = F.col("same") / F.col("n")
    pe = F.col("hj") / (F.col("n").cast("double") * F.col("n"))
    kappa = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    return totals.select(*(by or []), "n", po.alias("accuracy"), kappa.alias("kappa")).withColumn(
        "usable", F.col("kappa") >= settings.KAPPA_THRESHOLD
    )


def disagreements(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("human") != F.col("judge"))


def judge_score(reply: Column) -> Column:
    """Score in 0..1 from a judge's reply: the fenced object, else the outermost braces; NULL if unusable."""
    text = strip(reply)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(outer != "", outer).otherwise(text)
    score = F.get_json_object(body, "$.score").try_cast("double")
    return F.when(score.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(0.0), score)) / 5)
