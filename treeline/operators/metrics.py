"""Engineering metrics, failures and comparison of two reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.operators.distributed import exact_percentiles


def engineering(
    runs: DataFrame,
    price_in: float = settings.PRICE_PER_1K_INPUT,
    price_out: float = settings.PRICE_PER_1K_OUTPUT,
) -> DataFrame:
    """One row of run counts, stability, latency percentiles, token totals and cost.

    runs: status, duration_ms, input_tokens, output_tokens, llm_calls, tool_calls, llm_latency_ms.
    Missing durations are left out; a missing model latency counts as 0.
    """
    n = F.count(F.lit(1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    main = runs.agg(
        n.alias("total_runs"),
        F.count_if(F.col("status") == "completed").alias("stable_runs"),
        F.try_divide(F.count_if(F.col("status") == "completed"), n).alias("stability_rate"),
        total("input_tokens").alias("input_tokens_total"),
        total("output_tokens").alias("output_tokens_total"),
        total("llm_calls").alias("llm_calls_total"),
        total("tool_calls").alias("tool_calls_total"),
        F.try_divide(total("llm_calls"), n).alias("avg_llm_calls_per_run"),
        F.try_divide(total("tool_calls"), n).alias("avg_tool_calls_per_run"),
        (total("input_tokens") / 1000 * price_in + total("output_tokens") / 1000 * price_out).alias(
            "estimated_cost_cny"
        ),
    )
    duration = exact_percentiles(runs, "duration_ms", {"duration_p50_ms": 0.50, "duration_p95_ms": 0.95})
    latency = exact_percentiles(
        runs.select(F.coalesce("llm_latency_ms", F.lit(0.0)).alias("llm_latency_ms")),
        "llm_latency_ms", {"llm_latency_p50_ms": 0.50, "llm_latency_p95_ms": 0.95},
    )
    # Both percentiles of a column come out of one subquery.
    columns = []
    for part in (duration, latency):
        both = part.select(F.struct("*")).scalar()
        columns += [both[c].alias(c) for c in part.columns]
    return main.select("*", *columns)


def failures(runs: DataFrame) -> DataFrame:
    """Runs that did not complete, with the reason attributed to their status."""
    reason = F.lit(settings.UNKNOWN_ATTRIBUTION)
    for status, text in settings.ATTRIBUTIONS.items():
        reason = F.when(F.col("status") == status, text).otherwise(reason)
    return runs.filter(F.coalesce("status", F.lit("")) != "completed").withColumn("attribution", reason)


def compare_means(baseline: DataFrame, current: DataFrame, key: str = "scenario", value: str = "mean") -> DataFrame:
    """Union of the keys of two reports with both values and their difference (NULL if one is missing)."""
    b = baseline.select(key, F.col(value).alias("baseline"))
    c = current.select(key, F.col(value).alias("current"))
    return b.join(c, key, "full_outer").withColumn("delta", F.col("current") - F.col("baseline"))
