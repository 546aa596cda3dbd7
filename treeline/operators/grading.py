"""Layer, run, case and scenario scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = ("task", "evidence", "trace")


def layer_score(checks: Column, scores: Column) -> Column:
    """Mean score of the named checks (array of names, map name -> score); 1 when none is named.

    A name without a score is an unknown check, which counts as passed.
    """
    values = F.transform(F.coalesce(checks, F.array().cast("array<string>")),
                         lambda n: F.coalesce(F.try_element_at(scores, n), F.lit(1.0)))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) == 0, 1.0).otherwise(F.try_divide(total, F.size(values)))


def weighted_score(scores: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Weighted mean over the layers that have a score; NULL when none has."""
    top: Column = F.lit(0.0)
    bottom: Column = F.lit(0.0)
    for name, score in scores.items():
        top = top + F.coalesce(score * weights[name], F.lit(0.0))
        bottom = bottom + F.when(score.isNotNull(), weights[name]).otherwise(0.0)
    return F.try_divide(top, bottom)


def grade_runs(runs: DataFrame, judge: str | None = None) -> DataFrame:
    """Layer scores and `case_score` per run.

    runs: case columns, `scores` (map check -> score) and `grading` (struct of
    layers with type, checks, weight). A judged layer takes the struct column
    named by `judge` (layer -> score); without one it stays pending and its
    weight drops out.
    """
    scores = {}
    for layer in LAYERS:
        part = F.col(f"grading.{layer}")
        judged = F.col(f"{judge}.{layer}") if judge else F.lit(None).cast("double")
        scores[layer] = F.when(part["type"] == "rules", layer_score(part["checks"], F.col("scores"))).when(
            part["type"] == "llm_judge", judged
        )
    weights = {layer: F.col(f"grading.{layer}.weight") for layer in LAYERS}
    scored = runs.withColumns({f"{layer}_score": scores[layer] for layer in LAYERS})
    return scored.withColumn(
        "case_score", weighted_score({n: F.col(f"{n}_score") for n in LAYERS}, weights)
    )


def grade_cases(graded: DataFrame, keys: tuple[str, ...] = ("case_id", "scenario")) -> DataFrame:
    """Per case: n_runs, mean and population deviation of its scores, mean of every layer."""
    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("case_score").alias("case_score_mean"),
        F.when(F.count("case_score") > 1, F.stddev_pop("case_score")).alias("case_score_std"),
        *[F.avg(f"{layer}_score").alias(f"{layer}_mean") for layer in LAYERS],
    )


def scenario_means(cases: DataFrame) -> DataFrame:
    """Mean case score per scenario and overall (scenario NULL marks the overall row)."""
    return (
        cases.filter("case_score_mean IS NOT NULL")
        .withColumn("scenario", F.coalesce("scenario", F.lit("unknown")))
        .rollup("scenario")
        .agg(F.avg("case_score_mean").alias("mean"), F.count(F.lit(1)).alias("cases"))
    )
