"""The sixteen rule checks over evaluation runs, one Column of score per check.

Input rows carry `expected` (struct of the answer key), `answer`, `status` and
`steps` (array<struct<type, name, arguments, ok, result>>; arguments and result
are JSON text). Every check is a row expression: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.text import strip, without_blanks

# Possessive and unrolled: a plain alternation recurses once a character in Java.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JSON_VALUE = _JSON_STRING + r'|-?[0-9][0-9.eE+-]*|true|false|null|\{\s*\}|\[\s*\]'
_JSON_KEY = _JSON_STRING + r'\s*:'


def flatten_json(text: Column) -> Column:
    """The values of a JSON text, at any depth, joined by spaces."""
    values = F.regexp_extract_all(F.regexp_replace(text, _JSON_KEY, " "), F.lit(f"({_JSON_VALUE})"), F.lit(1))
    plain = F.transform(
        values,
        lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]"))
        .when(v == "true", "True").when(v == "false", "False").when(v == "null", "None")
        .when(v.rlike(r"^[\[{]"), "").otherwise(v),
    )
    return F.coalesce(F.array_join(plain, " "), F.lit(""))


def _listed(name: str) -> Column:
    items = F.coalesce(F.col(f"expected.{name}"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _answer() -> Column:
    return F.coalesce("answer", F.lit(""))


def _tool_steps() -> Column:
    named = F.transform("steps", lambda s: s.withField("name", _text(s["name"])))
    return F.filter(named, lambda s: F.coalesce(s["type"] == "tool_call", F.lit(False)))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def all_text() -> Column:
    """Answer plus arguments and results of every tool call."""
    parts = F.transform(
        F.col("_tools"), lambda s: F.concat_ws("\n", _text(s["arguments"]), flatten_json(_text(s["result"])))
    )
    return F.array_join(F.concat(F.array(_answer()), parts), "\n")


def prepared(runs: DataFrame) -> DataFrame:
    """Runs with the derived columns the checks read."""
    writes = F.filter("_tools", lambda s: s["name"].isin(*settings.WRITE_TOOLS))
    touched = F.filter(
        F.transform(writes, lambda s: _text(F.get_json_object(s["arguments"], "$.relative_path"))),
        lambda p: p != "",
    )
    return runs.withColumn("_tools", _tool_steps()).withColumns({"_all": all_text(), "_touched": touched})


def _share(hit: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(hit.cast("double"), total.cast("double")), F.lit(1.0))


def _binary(ok: Column) -> Column:
    return F.when(ok, 1.0).otherwise(0.0)


def _covered(name: str) -> Column:
    wanted = _listed(name)
    return _share(F.size(F.filter(wanted, lambda n: F.col("_all").contains(n))), F.size(wanted))


def mention_pattern(needle: Column) -> Column:
    """Regular expression of a needle: blanks may stand between its characters, digits do not run on."""
    chars = F.filter(F.split(without_blanks(needle), ""), lambda c: c != "")
    body = F.array_join(F.transform(chars, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "\\s*")
    digit = lambda c: F.coalesce(c.rlike(r"(?U)^\d$"), F.lit(False))
    return F.concat(
        F.lit("(?U)"),
        F.when(digit(F.try_element_at(chars, F.lit(1))), r"(?<!\d)").otherwise(""),
        body,
        F.when(digit(F.try_element_at(chars, F.lit(-1))), r"(?!\d)").otherwise(""),
    )


def mentioned(needle: Column, answer: Column) -> Column:
    """Whether an answer mentions a needle; `a|b` lists spellings of which one suffices."""
    spellings = F.filter(F.split(needle, r"\|"), lambda part: without_blanks(part) != "")
    return F.exists(spellings, lambda part: F.rlike(answer, mention_pattern(part)))


def mentions_covered() -> Column:
    wanted = _listed("must_mention")
    return _share(F.size(F.filter(wanted, lambda n: mentioned(n, _answer()))), F.size(wanted))


def required_tools_called() -> Column:
    used = F.transform(F.filter("_tools", lambda s: F.coalesce(s["ok"], F.lit(True))), lambda s: s["name"])
    wanted = _listed("required_tools")
    return _share(F.size(F.filter(wanted, lambda t: F.array_contains(used, t))), F.size(wanted))


def no_hallucination() -> Column:
    # The grounding text holds the answer itself, so references in it are always grounded.
    return _binary(~F.exists(_listed("must_not_contain"), lambda x: _answer().contains(x)))


def root_cause_located() -> Column:
    file, symbol = _text(F.col("expected.root_cause_file")), _text(F.col("expected.root_cause_symbol"))
    found = F.exists(
        "_tools",
        lambda s: ((file != "") & _text(s["arguments"]).contains(file))
        | ((symbol != "") & _text(s["arguments"]).contains(symbol)),
    )
    return _binary(((file == "") & (symbol == "")) | found)


def key_change_present() -> Column:
    return _binary(F.forall(_listed("key_change_fields"), lambda k: F.col("_all").contains(k)))


def only_target_file_modified() -> Column:
    target, required = F.col("expected.target_file"), _listed("target_files")
    forbidden = F.transform(
        F.coalesce("expected.forbidden_files", F.array().cast("array<string>")),
        lambda f: F.replace(f, F.lit("**"), F.lit("")),
    )
    touched = F.col("_touched")
    allowed = F.concat(required, F.when(_text(target) != "", F.array(target)).otherwise(F.array().cast("array<string>")))
    banned = F.exists(touched, lambda p: F.exists(forbidden, lambda f: p.contains(f)))
    stray = F.exists(touched, lambda p: (F.size(allowed) > 0) & ~F.array_contains(allowed, p))
    done = F.size(F.filter(required, lambda t: F.array_contains(touched, t)))
    free = _binary(~banned & (F.size(touched) > 0))
    bound = (
        F.when(F.size(touched) == 0, _binary(F.size(required) == 0))
        .when(banned | stray, 0.0)
        .otherwise(_share(done, F.size(required)))
    )
    return F.when(F.coalesce("expected.any_filename", F.lit(False)), free).otherwise(bound)


def read_before_write() -> Column:
    places = F.transform("_tools", lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    reads = F.filter(places, lambda x: x["s"]["name"].isin(*settings.READ_TOOLS))
    edits = F.filter(
        places,
        lambda x: x["s"]["name"].isin(*settings.WRITE_TOOLS)
        & ~((x["s"]["name"] == "write_text_file")
            & (_text(F.get_json_object(x["s"]["result"], "$.created")) == "true")),
    )
    first_read, first_edit = F.get(reads, F.lit(0))["i"], F.get(edits, F.lit(0))["i"]
    return _binary(first_edit.isNull() | F.coalesce(first_read < first_edit, F.lit(False)))


def no_claimed_without_result() -> Column:
    claimed = F.lit(False)
    for word in settings.CLAIM_WORDS:
        claimed = claimed | _answer().contains(word)
    wrote = F.exists(
        "_tools", lambda s: s["name"].isin(*settings.WRITE_TOOLS) & F.coalesce(s["ok"], F.lit(False))
    )
    return _binary(~claimed | wrote)


def _found() -> Column:
    """Distinct names the tool results listed."""
    def of(step: Column) -> Column:
        lists = F.from_json(
            step["result"], "modules array<string>, symbols array<string>, matches array<string>, sample_refs array<string>"
        )
        items = F.flatten(F.array(*[
            F.coalesce(lists[k], F.array().cast("array<string>"))
            for k in ("modules", "symbols", "matches", "sample_refs")
        ]))
        return F.flatten(F.transform(
            items,
            lambda item: F.when(
                item.startswith("{"),
                F.array(*[F.get_json_object(item, f"$.{k}") for k in ("module_path", "name", "relative_path")]),
            ).otherwise(F.array(item)),
        ))

    return F.array_distinct(F.filter(F.flatten(F.transform("_tools", of)), lambda v: v.isNotNull()))


def precision() -> Column:
    gold = F.array_distinct(F.coalesce("expected.gold_list", F.array().cast("array<string>")))
    found = _found()
    return F.when(F.size(gold) == 0, 1.0).otherwise(
        _share(F.size(F.array_intersect(found, gold)), F.size(found))
    )


def used_index_tools() -> Column:
    return _binary(F.exists("_tools", lambda s: F.coalesce(s["name"].isin(*settings.INDEX_TOOLS), F.lit(False))))


def read_target_file() -> Column:
    target = _text(F.col("expected.root_cause_file"))
    read = F.exists(
        "_tools", lambda s: s["name"].isin(*settings.READ_TOOLS) & _text(s["arguments"]).contains(target)
    )
    return _binary((target == "") | read)


def no_illegal_search() -> Column:
    bad = F.exists(
        "_tools",
        lambda s: (s["name"] == "search_text")
        & strip(_text(F.get_json_object(s["arguments"], "$.relative_dir"))).isin("", ".", "/"),
    )
    return _binary(~bad)


CHECKS: dict[str, Callable[[], Column]] = {
    "mentions_covered": mentions_covered,
    "required_tools_called": required_tools_called,
    "modules_covered": lambda: _covered("must_contain_modules"),
    "symbols_covered": lambda: _covered("must_contain_symbols"),
    "no_hallucination": no_hallucination,
    "root_cause_located": root_cause_located,
    "key_change_present": key_change_present,
    "only_target_file_modified": only_target_file_modified,
    "read_before_write": read_before_write,
    "no_claimed_without_result": no_claimed_without_result,
    "recall": lambda: _covered("gold_list"),
    "precision": precision,
    "used_index_tools": used_index_tools,
    "read_target_file": read_target_file,
    "no_illegal_search": no_illegal_search,
    "stable": lambda: _binary(F.coalesce(F.col("status") == "completed", F.lit(False))),
}


def run_checks(runs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One double column per check next to the run's own columns; unknown checks score 1."""
    wanted = list(CHECKS) if names is None else names
    ready = prepared(runs)
    own = [c for c in runs.columns if c not in ("expected", "steps", "answer")]
    return ready.select(
        *own, *[(CHECKS[n]() if n in CHECKS else F.lit(1.0)).alias(n) for n in wanted]
    )


def _lacking(name: str) -> Callable[[], Column]:
    return lambda: F.filter(_listed(name), lambda n: ~F.col("_all").contains(n))


def _tools_lacking() -> Column:
    used = F.transform(F.filter("_tools", lambda s: F.coalesce(s["ok"], F.lit(True))), lambda s: s["name"])
    return F.filter(_listed("required_tools"), lambda t: ~F.array_contains(used, t))


def _files_lacking() -> Column:
    free = F.coalesce("expected.any_filename", F.lit(False))
    untouched = F.filter(_listed("target_files"), lambda t: ~F.array_contains(F.col("_touched"), t))
    return F.when(free, F.array().cast("array<string>")).otherwise(untouched)


def _files_astray() -> Column:
    """Files changed that are forbidden, or not among those to change."""
    target = F.col("expected.target_file")
    allowed = F.concat(
        _listed("target_files"), F.when(_text(target) != "", F.array(target)).otherwise(F.array().cast("array<string>"))
    )
    forbidden = F.transform(
        F.coalesce("expected.forbidden_files", F.array().cast("array<string>")), lambda f: F.replace(f, F.lit("**"), F.lit(""))
    )
    free = F.coalesce("expected.any_filename", F.lit(False))
    stray = lambda p: ~free & (F.size(allowed) > 0) & ~F.array_contains(allowed, p)
    return F.array_distinct(
        F.filter("_touched", lambda p: F.exists(forbidden, lambda f: p.contains(f)) | stray(p))
    )


def _beside_gold() -> Column:
    gold = F.array_distinct(F.coalesce("expected.gold_list", F.array().cast("array<string>")))
    return F.when(F.size(gold) == 0, F.array().cast("array<string>")).otherwise(F.array_except(_found(), gold))


def _wide_searches() -> Column:
    places = F.transform(
        F.filter("_tools", lambda s: s["name"] == "search_text"),
        lambda s: strip(_text(F.get_json_object(s["arguments"], "$.relative_dir"))),
    )
    return F.array_distinct(F.filter(places, lambda p: p.isin("", ".", "/")))


#: What the answer key asks for and the run lacks, and what the run holds that it must not.
MISSING: dict[str, Callable[[], Column]] = {
    "mentions_covered": lambda: F.filter(_listed("must_mention"), lambda n: ~mentioned(n, _answer())),
    "required_tools_called": _tools_lacking,
    "modules_covered": _lacking("must_contain_modules"),
    "symbols_covered": _lacking("must_contain_symbols"),
    "key_change_present": _lacking("key_change_fields"),
    "only_target_file_modified": _files_lacking,
    "recall": _lacking("gold_list"),
}
OFFENDING: dict[str, Callable[[], Column]] = {
    "no_hallucination": lambda: F.filter(_listed("must_not_contain"), lambda x: _answer().contains(x)),
    "only_target_file_modified": _files_astray,
    "precision": _beside_gold,
    "no_illegal_search": _wide_searches,
}


def run_outcomes(runs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row for each run and check: check_name, passed, score, missing, offending and detail.

    A check is passed with the full score. `missing` lists what the answer key asks for in vain,
    `offending` what the run holds against it; `detail` says both in words.
    """
    wanted = list(CHECKS) if names is None else names
    own = [c for c in runs.columns if c not in ("expected", "steps", "answer")]
    none = F.array().cast("array<string>")
    listed = lambda table, n: table[n]() if n in table else none
    rows = prepared(runs).select(
        *own,
        F.inline(F.array(*[
            F.struct(
                F.lit(n).alias("check_name"), (CHECKS[n]() if n in CHECKS else F.lit(1.0)).alias("score"),
                listed(MISSING, n).alias("missing"), listed(OFFENDING, n).alias("offending"),
            )
            for n in wanted
        ])),
    )
    said = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    detail = F.concat_ws("; ", said("missing: ", "missing"), said("not allowed: ", "offending"))
    verdict = F.when(F.col("score") == 1, "passed").otherwise("failed")
    return rows.select(
        *own, "check_name", (F.col("score") == 1).alias("passed"), "score", "missing", "offending",
        F.when(detail == "", verdict).otherwise(F.concat(verdict, F.lit("; "), detail)).alias("detail"),
    )
