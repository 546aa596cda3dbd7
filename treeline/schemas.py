"""Explicit schemas of everything read from JSON."""

from __future__ import annotations

TAG = "_type string, name string, path string, line int, kind string, signature string"

EXPECTED = (
    "struct<must_contain_modules: array<string>, must_contain_symbols: array<string>, must_mention: array<string>, "
    "required_tools: array<string>, must_not_contain: array<string>, gold_list: array<string>, "
    "root_cause_file: string, root_cause_line: int, root_cause_symbol: string, any_filename: boolean, "
    "target_file: string, target_files: array<string>, key_change_fields: array<string>, "
    "forbidden_files: array<string>, rubric: string>"
)
_LAYER = "struct<type: string, checks: array<string>, rubric: string, weight: double>"
GRADING = f"struct<task: {_LAYER}, evidence: {_LAYER}, trace: {_LAYER}>"
CASE = (
    "id string, scenario string, question string, tags array<string>, allow_modify boolean, n_runs int, "
    f"expected {EXPECTED}, grading {GRADING}"
)

STEP = (
    "struct<type: string, loop: int, name: string, arguments: string, ok: boolean, truncated: boolean, "
    "error: string, latency_ms: double, result: string, content: string, model: string, finish_reason: string, "
    "input_tokens: long, output_tokens: long, cache_hit_tokens: long, cache_miss_tokens: long>"
)
METRICS = (
    "struct<llm_calls: long, tool_calls: long, input_tokens: long, output_tokens: long, cache_hit_tokens: long, "
    "cache_miss_tokens: long, llm_latency_ms: double, tool_latency_ms: double>"
)
TRACE = (
    "run_id string, case_id string, status string, answer string, error string, started_at string, "
    f"duration_ms double, aggregates {METRICS}, steps array<{STEP}>"
)
LABEL = (
    "case_id string, scenario string, question string, answer string, rubric string, human string, judge string, "
    "judge_score double, judge_text string, judge_error string"
)
CORPUS = (
    "doc_id string, kind string, module_path string, part string, text string, has_comments boolean, "
    "metadata struct<name: string, symbol_kind: string, file: string, line: int, module_name: string, "
    "module_type: string, config_files: array<string>, doc_files: array<string>>"
)
