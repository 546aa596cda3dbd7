"""Queries over histories, results, evaluation runs and snapshots (q26-q38, q40, q41)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.jsonsize import list_size, number_size, object_size, string_size
from treeline.operators import (
    calibration, catalog, checks, compaction, datasets, editing, grading, history, metrics, report, snapshot, textsearch,
)
from treeline.operators.distributed import first_per_key, lookup_join
from treeline.plans import standins
from treeline.session import spread
from treeline.sources.tables import table


def q26_trim_history(spark: SparkSession, folder: str) -> DataFrame:
    return history.trim_history(standins.messages(spark, folder), 600).select(
        "conv_id", "turn", "role", "est_tokens", "starts_block", "kept"
    )


def q27_compact_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Size of a text-search result of every module before and after compaction."""
    query = "tion"
    hits = textsearch.line_matches(standins.files(spark, folder), query, keep=("source",))
    order = [F.lower("relative_path").asc(), F.col("relative_path").asc(), F.col("line_number").asc()]
    shown = first_per_key(hits, ["source"], order, settings.MAX_SEARCH_MATCHES)
    item = object_size({
        "relative_path": string_size(F.col("relative_path")),
        "line_number": number_size(F.col("line_number")),
        "line": string_size(F.col("line")),
    })
    place = object_size({
        "relative_path": string_size(F.col("relative_path")),
        "start_line": number_size(F.col("line_number")),
        "end_line": number_size(F.col("line_number")),
    })
    # At most 50 matches of a module reach this point.
    per_module = shown.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("size"), place.alias("place")))).alias("m"),
        F.count(F.lit(1)).alias("match_count"),
    )
    full = F.col("match_count") >= settings.MAX_SEARCH_MATCHES
    context = object_size({
        "last_search_query": string_size(F.lit(query)),
        "last_retrieve": list_size(F.slice(F.col("m")["place"], 1, settings.RETRIEVE_TOP)),
    })
    head = object_size({
        "ok": F.lit(4), "query": string_size(F.lit(query)), "matches": F.lit(2),
        "match_count": number_size(F.col("match_count")), "truncated": F.when(full, 4).otherwise(5),
        "context_updates": context,
    })
    results = per_module.select(
        F.col("source").alias("module_path"), "match_count", head.alias("head_size"),
        F.when(full, 4).otherwise(5).alias("flag_size"), F.col("m")["size"].alias("item_sizes"),
    )
    return compaction.compact_lists(results, "matches").select(
        "module_path", "match_count", "full_size", "kept", "omitted", "final_size", "outcome"
    )


def q27_compact_content(spark: SparkSession, folder: str) -> DataFrame:
    """Size of a whole-file read of every document before and after compaction."""
    head = object_size({
        "ok": F.lit(4), "path": string_size(F.col("file")), "content": F.lit(2),
        "characters_read": number_size(F.length("text")),
    })
    results = standins.files(spark, folder).select(
        "file", head.alias("head_size"), F.lit(None).cast("int").alias("flag_size"), F.col("text").alias("content")
    )
    return compaction.compact_content(results).select(
        "file", "full_size", "final_size", "outcome", F.md5("content").alias("content_md5")
    )


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark passages as evaluation cases with an answer key made of their words."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    w: list[Column] = [F.coalesce(F.get("_w", F.lit(i)), F.lit("zz")) for i in range(8)]
    home = F.concat(F.lit("src"), F.col("item_id").cast("string"))
    expected = F.struct(
        F.array(w[0], w[1], w[2], F.concat_ws("|", w[3], w[4])).alias("must_mention"),
        F.array(home, F.lit("src0")).alias("must_contain_modules"),
        F.array(w[0], w[1]).alias("must_contain_symbols"),
        F.array(w[5]).alias("must_not_contain"),
        F.array(home, w[0], w[1]).alias("gold_list"),
        F.array(F.lit("search_text"), F.lit("write_text_file")).alias("required_tools"),
        F.concat(w[0], F.lit(".h")).alias("root_cause_file"),
        F.lit(None).cast("string").alias("root_cause_symbol"),
        F.array(w[0], w[2]).alias("key_change_fields"),
        F.concat(home, F.lit("/The.h")).alias("target_file"),
        F.array(F.concat(home, F.lit("/"), w[0], F.lit(".h"))).alias("target_files"),
        F.array(F.concat(F.lit("**/"), w[1])).alias("forbidden_files"),
        (F.pmod("item_id", F.lit(3)) == 0).alias("any_filename"),
    )
    scenario = F.array(*[F.lit(s) for s in settings.SCENARIOS])[F.pmod("item_id", F.lit(4)).cast("int")]
    return table(spark, folder, "benchmark").withColumn("_w", words).select(
        F.col("item_id").alias("case_id"), scenario.alias("scenario"), expected.alias("expected")
    )


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    """documents as runs of the case numbered like their source; every line is one tool call."""
    tools = F.array(*[F.lit(t) for t in (
        "write_text_file", "search_text", "read_text_file", "find_symbol_references",
        "replace_text_in_file", "list_modules")])

    def step(line: Column, i: Column) -> Column:
        n = i + 1
        word = F.regexp_extract(line, "[A-Za-z]+", 0)
        target = F.concat(F.col("source"), F.lit("/"), word, F.lit(".h"))
        where = F.when(F.pmod(n, F.lit(4)) == 0, F.lit(".")).otherwise(F.col("source"))
        return F.struct(
            F.lit("tool_call").alias("type"),
            tools[F.pmod(n, F.lit(6))].alias("name"),
            F.concat(F.lit('{"relative_path": "'), target, F.lit('", "relative_dir": "'), where, F.lit('"}')).alias("arguments"),
            F.when(F.pmod(n, F.lit(7)) == 0, False).when(F.pmod(n, F.lit(5)) != 0, True).alias("ok"),
            F.concat(
                F.lit('{"ok": true, "created": '), F.when(F.pmod(n, F.lit(3)) == 0, "true").otherwise("false"),
                F.lit(', "modules": ["'), F.col("source"), F.lit('", {"name": "'), word, F.lit('"}]}'),
            ).alias("result"),
        )

    lines = F.split("text", "\n")
    return standins.files(spark, folder).select(
        F.col("doc_id").alias("run_id"),
        F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("case_id"),
        F.when(F.pmod("doc_id", F.lit(9)) == 4, "error").otherwise("completed").alias("status"),
        F.col("text").alias("answer"),
        F.transform(lines, step).alias("steps"),
    )


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return checks.run_checks(lookup_join(_traces(spark, folder), _cases(spark, folder), "case_id", ["run_id"]))


def q28_rule_checks(spark: SparkSession, folder: str) -> DataFrame:
    names = list(checks.CHECKS)
    return _checked(spark, folder).select("run_id", "case_id", *[F.round(n, 6).alias(n) for n in names])


def q28_check_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every check of every run with its verdict and what is missing; lists joined by commas."""
    runs = lookup_join(_traces(spark, folder), _cases(spark, folder), "case_id", ["run_id"])
    rows = checks.run_outcomes(runs)
    joined = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    shown = F.when(F.col("check_name").isin("no_hallucination", "only_target_file_modified", "no_illegal_search"), F.col("offending"))
    return rows.withColumn("offending", F.coalesce(shown, F.array().cast("array<string>"))).select(
        "run_id", "check_name", "passed", joined("missing"), joined("offending")
    )


def q28_check_means(spark: SparkSession, folder: str) -> DataFrame:
    names = list(checks.CHECKS)
    return (
        _checked(spark, folder)
        .unpivot(["scenario"], names, "check_name", "score")
        .groupBy("scenario", "check_name")
        .agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") == 1).alias("passed"))
    )


def q28_graded_cases(spark: SparkSession, folder: str) -> DataFrame:
    names = list(checks.CHECKS)
    graded = grading.grade_runs(
        _checked(spark, folder).select(
            "case_id", "scenario",
            F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("scores"),
            datasets.default_grading(F.col("scenario")).alias("grading"),
        )
    )
    return grading.grade_cases(graded).select(
        "case_id", "scenario", "n_runs",
        *[F.round(c, 6).alias(c) for c in (
            "case_score_mean", "case_score_std", "task_mean", "evidence_mean", "trace_mean")],
    )


def _scored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """events graded by layers: the judged layer is missing on every fifth value of k."""
    runs = standins.runs(spark, folder)
    layers = {
        "task": F.when(F.pmod("k", F.lit(5)) != 0, F.col("k") / 100),
        "evidence": F.try_divide(F.col("duration_ms"), F.col("duration_ms") + 50),
        "trace": F.when(F.col("status") == "completed", 1.0).otherwise(0.0),
    }
    weights = {"task": F.lit(0.5), "evidence": F.lit(0.3), "trace": F.lit(0.2)}
    scored = runs.withColumns({f"{n}_score": s for n, s in layers.items()})
    return scored.withColumn(
        "case_score", grading.weighted_score({n: F.col(f"{n}_score") for n in layers}, weights)
    )


def q29_case_scores(spark: SparkSession, folder: str) -> DataFrame:
    graded = grading.grade_cases(_scored_runs(spark, folder), ("case_id", "scenario"))
    return graded.select(
        "case_id", "scenario", "n_runs",
        *[F.round(c, 6).alias(c) for c in (
            "case_score_mean", "case_score_std", "task_mean", "evidence_mean", "trace_mean")],
    )


def q30_engineering(spark: SparkSession, folder: str) -> DataFrame:
    runs = standins.runs(spark, folder).select(
        "status", "duration_ms", F.col("k").alias("input_tokens"), F.col("k").alias("output_tokens"),
        F.lit(1).alias("llm_calls"), F.pmod("k", F.lit(3)).alias("tool_calls"),
        F.when(F.pmod("k", F.lit(7)) != 0, F.col("k") * F.lit(1.5)).alias("llm_latency_ms"),
    )
    one = metrics.engineering(runs)
    exact = ("total_runs", "stable_runs", "input_tokens_total", "output_tokens_total", "llm_calls_total", "tool_calls_total")
    return one.select(
        *[F.col(c).cast("long").alias(c) if c in exact else F.round(c, 6).alias(c) for c in one.columns]
    )


def q30_scenario_means(spark: SparkSession, folder: str) -> DataFrame:
    means = grading.scenario_means(grading.grade_cases(_scored_runs(spark, folder)))
    return means.select(F.coalesce("scenario", F.lit("overall")).alias("scenario"), F.round("mean", 6).alias("mean"), "cases")


def q31_failures(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.failures(standins.runs(spark, folder)).select("case_id", "run_id", "status", "attribution")


def q32_compare(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored_runs(spark, folder)

    def report(rest: int, keep: Column) -> DataFrame:
        side = scored.filter((F.pmod("run_id", F.lit(2)) == rest) & keep)
        return grading.scenario_means(grading.grade_cases(side)).withColumn(
            "scenario", F.coalesce("scenario", F.lit("overall"))
        )

    both = metrics.compare_means(
        report(0, F.col("scenario") != "signup"), report(1, F.col("scenario") != "click")
    )
    return both.select("scenario", *[F.round(c, 6).alias(c) for c in ("baseline", "current", "delta")])


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    name = lambda c: F.when(F.col(c) == 1, "对").otherwise("错")
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("scenario"))
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("case_id"), "scenario", name("quality").alias("human"), name("toxic").alias("judge")
    )


def q33_agreement(spark: SparkSession, folder: str) -> DataFrame:
    labels = _labels(spark, folder)
    overall = calibration.agreement(labels).withColumn("scenario", F.lit("overall"))
    return overall.unionByName(calibration.agreement(labels, ["scenario"])).select(
        "scenario", "n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"), "usable"
    )


def q33_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.disagreements(_labels(spark, folder))


def q33_normal_labels(spark: SparkSession, folder: str) -> DataFrame:
    """labels written in varying spellings, brought to the three canonical ones."""
    words = F.array(*[F.lit(w) for w in ("正确", " 对", "部分", "部分正确\t", "错误 ", "错", "None", "")])
    spelled = table(spark, folder, "labels").select(
        "doc_id", words[F.pmod(F.col("doc_id") + F.col("quality") * 3, F.lit(8)).cast("int")].alias("label")
    )
    return spelled.select(calibration.normal_label(F.col("label")).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


def q33_judge_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores out of judge replies wrapped in fences, in prose or not usable at all."""
    k = F.get_json_object("props", "$.k")
    form = F.pmod("event_id", F.lit(4))
    reply = (
        F.when(form == 0, F.concat(F.lit('```json\n{"score": '), k, F.lit("}\n```")))
        .when(form == 1, F.concat(F.lit('I think {"score": '), F.col("value").cast("string"), F.lit(', "why": "x"} fits')))
        .when(form == 2, F.concat(F.lit('{"score": "'), F.col("event_type"), F.lit('"}')))
        .otherwise(F.col("event_type"))
    )
    events = table(spark, folder, "events")
    return events.select("event_id", F.round(calibration.judge_score(reply), 6).alias("score"))


def q30_planned_runs(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "benchmark").select(
        "item_id",
        F.array(*[F.lit(s) for s in settings.SCENARIOS])[F.pmod("item_id", F.lit(4)).cast("int")].alias("scenario"),
        F.when(F.pmod("item_id", F.lit(3)) == 0, F.lit(5)).alias("n_runs"),
    )
    return datasets.planned_runs(cases, 3)


def q31_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The per-case part of a report as table lines."""
    cases = grading.grade_cases(_scored_runs(spark, folder), ("case_id",)).select(
        "case_id", "n_runs", F.round("case_score_mean", 2).alias("mean"), F.round("task_mean", 2).alias("task")
    )
    return report.markdown_rows(cases)


def q34_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    then = standins.files(spark, folder).select("file", "text", "doc_id")
    now = then.filter(F.pmod("doc_id", F.lit(17)) != 0).withColumn(
        "text", F.when(F.pmod("doc_id", F.lit(10)) == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    )
    return snapshot.verify(snapshot.hash_tree(then), snapshot.hash_tree(now)).select("path", "expected", "current", "issue")


def q35_violations(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark items and labels as cases with gaps in their answer keys."""
    def cases(df: DataFrame, key: str) -> DataFrame:
        k = F.col(key)
        scenario = F.array(*[F.lit(s) for s in (*settings.SCENARIOS, "other")])[F.pmod(k, F.lit(5)).cast("int")]
        none = F.lit(None)
        return df.select(
            k.cast("string").alias("id"), scenario.alias("scenario"),
            F.struct(
                F.when(F.pmod(k, F.lit(2)) == 0, F.array(F.lit("a"))).alias("gold_list"),
                F.when(F.pmod(k, F.lit(3)) == 0, "f.h").alias("root_cause_file"),
                F.when(F.pmod(k, F.lit(7)) == 0, "sym").otherwise("").alias("root_cause_symbol"),
                F.when(F.pmod(k, F.lit(4)) == 0, "t.h").otherwise(none).alias("target_file"),
                F.when(F.pmod(k, F.lit(6)) == 0, F.array(F.lit("k")))
                .when(F.pmod(k, F.lit(6)) == 1, F.array().cast("array<string>")).alias("key_change_fields"),
                (F.pmod(k, F.lit(9)) == 0).alias("any_filename"),
            ).alias("expected"),
        )

    both = cases(table(spark, folder, "benchmark"), "item_id").unionByName(cases(table(spark, folder, "labels"), "doc_id"))
    return datasets.violations(both)


def q36_head_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("lang").alias("scenario"), "doc_id", "source")
    return datasets.head_sample(docs, 10, order="doc_id").select("scenario", "rank", "doc_id", "source")


def q37_guarded_replace(spark: SparkSession, folder: str) -> DataFrame:
    old = F.regexp_extract("text", "[A-Za-z]+", 0)
    expected = F.pmod("doc_id", F.lit(3)).cast("int") + 1
    done = editing.guarded_replace(standins.files(spark, folder), old, F.lit("<new>"), expected)
    return done.select("file", "ok", "occurrences", F.md5("text").alias("text_md5"))


def q40_settings(spark: SparkSession, folder: str) -> DataFrame:
    form = F.pmod("p_partkey", F.lit(3))
    lines = table(spark, folder, "part").select(
        F.pmod("p_partkey", F.lit(20)).alias("file"),
        F.col("p_partkey").alias("line_no"),
        F.when(form == 0, F.concat("p_type", F.lit(' = "'), "p_brand", F.lit('",')))
        .when(form == 1, F.concat("p_type", F.lit(": "), "p_brand", F.lit(" ; "), "p_name"))
        .otherwise(F.concat(F.lit("# "), "p_name")).alias("line"),
    )
    return catalog.parse_settings(lines, ["file"])


def q41_signals(spark: SparkSession, folder: str) -> DataFrame:
    paths = standins.page_paths(spark, folder)
    modules = catalog.detect_modules(
        paths, "path", config_file="es/533", suffixes=(".example.net", ".example.org"), needed="en"
    )
    owned = catalog.module_files(paths, modules, "path")
    return catalog.module_signals(
        owned, {"has_en": "en", "has_fr": "fr"}, {"has_page": "*.html", "has_five": "5??", "has_class": "[1-4]*[!0-5]"}
    )
