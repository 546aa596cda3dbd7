"""Evaluation cases: default grading, validation and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import settings
from treeline.operators.distributed import first_per_key

# Layers of a case that brings no grading of its own (type, checks, weight).
DEFAULT_GRADING = {
    "consult": {
        "task": ("llm_judge", None, 0.5),
        "evidence": ("rules", ["modules_covered", "symbols_covered", "no_hallucination"], 0.3),
        "trace": ("rules", ["used_index_tools", "no_illegal_search", "stable"], 0.2),
    },
    "retrieval": {
        "task": ("rules", ["recall", "precision"], 0.5),
        "evidence": ("rules", ["no_hallucination"], 0.2),
        "trace": ("rules", ["used_index_tools", "no_illegal_search", "stable"], 0.3),
    },
    "bug": {
        "task": ("llm_judge", None, 0.5),
        "evidence": ("rules", ["root_cause_located", "no_hallucination"], 0.3),
        "trace": ("rules", ["read_target_file", "no_illegal_search", "stable"], 0.2),
    },
    "modify": {
        "task": ("llm_judge", None, 0.5),
        "evidence": ("rules", ["key_change_present", "only_target_file_modified"], 0.3),
        "trace": ("rules", ["read_before_write", "no_claimed_without_result", "stable"], 0.2),
    },
}


def _layer(kind: str, checks: list[str] | None, weight: float) -> Column:
    listed = F.array(*[F.lit(c) for c in checks]) if checks else F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"), listed.cast("array<string>").alias("checks"),
        F.lit(None).cast("string").alias("rubric"), F.lit(weight).alias("weight"),
    )


def default_grading(scenario: Column) -> Column:
    """Grading struct by scenario; NULL for an unknown one."""
    out = F.lit(None)
    for name, layers in DEFAULT_GRADING.items():
        value = F.struct(*[_layer(*spec).alias(layer) for layer, spec in layers.items()])
        out = F.when(scenario == name, value).otherwise(out)
    return out


def with_default_grading(cases: DataFrame) -> DataFrame:
    """Cases without grading take their scenario's; given layers default to rules of weight 1."""
    def completed(layer: str) -> Column:
        part = F.col(f"grading.{layer}")
        return F.struct(
            F.coalesce(part["type"], F.lit("rules")).alias("type"), part["checks"].alias("checks"),
            part["rubric"].alias("rubric"), F.coalesce(part["weight"], F.lit(1.0)).alias("weight"),
        ).alias(layer)

    own = F.struct(*[completed(layer) for layer in ("task", "evidence", "trace")])
    given = F.col("grading.task").isNotNull() | F.col("grading.evidence").isNotNull() | F.col("grading.trace").isNotNull()
    return cases.withColumn(
        "grading", F.when(F.coalesce(given, F.lit(False)), own).otherwise(default_grading(F.col("scenario")))
    )


def violations(cases: DataFrame) -> DataFrame:
    """Every broken rule of a data set: id, rule. An empty result means the data set is valid."""
    absent = lambda name: F.coalesce(F.col(f"expected.{name}"), F.lit("")) == ""
    no_items = lambda name: F.coalesce(F.size(f"expected.{name}"), F.lit(0)) <= 0
    scenario = F.col("scenario")
    rules = {
        "unknown scenario": ~F.coalesce(scenario.isin(*settings.SCENARIOS), F.lit(False)),
        "retrieval needs gold_list": (scenario == "retrieval") & no_items("gold_list"),
        "bug needs a root cause": (scenario == "bug") & absent("root_cause_file") & absent("root_cause_symbol"),
        "modify needs target_file": (scenario == "modify")
        & ~F.coalesce("expected.any_filename", F.lit(False)) & absent("target_file"),
        "modify needs key_change_fields": (scenario == "modify") & no_items("key_change_fields"),
    }
    broken = cases.select(
        "id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))).alias("rule")
    )
    repeated = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "id", F.lit("duplicate id").alias("rule")
    )
    return broken.unionByName(repeated)


def head_sample(cases: DataFrame, per_group: int, group: str = "scenario", order: str = "ord") -> DataFrame:
    """The first cases of every group in file order."""
    return first_per_key(cases, [group], [F.col(order).asc()], per_group)


def planned_runs(cases: DataFrame, default_runs: int) -> DataFrame:
    """How often each case runs: once when it modifies files, else its own or the default count."""
    return cases.withColumn(
        "n_runs", F.when(F.col("scenario") == "modify", 1).otherwise(F.coalesce("n_runs", F.lit(default_runs)))
    )


def label_sheet(cases: DataFrame, answers: DataFrame, per_group: int) -> DataFrame:
    """Rows for human labelling: the first cases of every scenario that have a usable answer.

    answers: case_id, answer. Cases without an answer are left out, not replaced.
    """
    chosen = head_sample(cases, per_group)
    usable = answers.filter(F.coalesce("answer", F.lit("")) != "")
    return chosen.join(usable, chosen["id"] == usable["case_id"]).select(
        "case_id", "scenario", "question", "answer", F.col("expected.rubric").alias("rubric"),
        F.lit(None).cast("string").alias("human"), F.lit(None).cast("string").alias("judge"),
    )
