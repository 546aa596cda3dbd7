"""Operators against brute force on small fixtures."""

import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from treeline import settings
from treeline.operators import (
    attribution, calibration, checks, compaction, corpus, datasets, editing, grading, history, includes,
    metrics, references, report, retrieval, searchindex, snapshot, symbols, textsearch,
)
from treeline.operators.distributed import exact_percentiles, lookup_join, salted_join
from treeline.toolbox import compact


def trim_spec(rows, budget):
    """rows: (role, calls, tokens) in order; returns the kept flags."""
    blocks = []
    for i, (role, calls, _) in enumerate(rows):
        joins = role == "tool" and blocks and rows[blocks[-1][0]][1] and rows[blocks[-1][0]][0] == "assistant"
        blocks[-1].append(i) if joins else blocks.append([i])
    kept, left = set(blocks[-1]), budget - sum(rows[i][2] for i in blocks[-1])
    for block in reversed(blocks[:-1]):
        left -= sum(rows[i][2] for i in block)
        if left < 0:
            break
        kept |= set(block)
    return [i in kept for i in range(len(rows))]


def test_trim_equals_block_walk(spark):
    rng = random.Random(11)
    data, expected = [], {}
    for conv in range(60):
        rows = []
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "tool", "tool"])
            calls = "c" if role == "assistant" and rng.random() < 0.7 else None
            content = "x" * rng.randint(0, 40)
            size = len("\n".join([role, content, calls or "", "", ""]))
            rows.append((role, calls, max(1, (size + 1) // 2) + 4))
            data.append((conv, turn, role, content, calls, None, None))
        expected[conv] = trim_spec(rows, 60)
    df = spark.createDataFrame(
        data, "conv_id long, turn long, role string, content string, tool_calls string, tool_call_id string, name string")
    for chunk in (1, 3, 1000):
        for r in history.trim_history(df, 60, chunk).collect():
            assert r.kept == expected[r.conv_id][r.turn], (chunk, r.conv_id, r.turn)


def test_compaction_agrees_with_real_json(spark):
    rng = random.Random(5)
    for cap in (150, 300, 600):
        results, rows = [], []
        for i in range(40):
            result = {"ok": True, "matches": [{"line": "x" * rng.randint(0, 60)} for _ in range(rng.randint(0, 12))]}
            if i % 2:
                result["truncated"] = bool(i % 4 == 1)
            size = lambda r: len(json.dumps(r, ensure_ascii=False))
            head = size({**result, "matches": []})
            flag = len(json.dumps(result["truncated"])) if i % 2 else None
            results.append(result)
            rows.append((i, head, flag, [size(m) for m in result["matches"]]))
        df = spark.createDataFrame(rows, "i int, head_size int, flag_size int, item_sizes array<int>")
        for r in compaction.compact_lists(df, "matches", cap).collect():
            done = compact(results[r.i], cap)
            assert r.full_size == size(results[r.i])
            if r.outcome == "stub":
                assert "matches" not in done
            else:
                assert r.final_size == size(done) and r.kept == len(done["matches"])
                assert r.omitted == done.get("matches_omitted", 0)


def test_content_compaction_agrees_with_real_json(spark):
    contents = ["", "a" * 90, "é\n" * 120, "b" * 5000, '"' * 4000]
    size = lambda r: len(json.dumps(r, ensure_ascii=False))
    rows = [(i, size({"ok": True, "content": ""}), None, c) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "i int, head_size int, flag_size int, content string")
    for cap in (120, 1000, 4000):
        for r in compaction.compact_content(df, cap).collect():
            done = compact({"ok": True, "content": contents[r.i]}, cap)
            assert (r.outcome == "stub") == ("error" in done)
            if r.outcome != "stub":
                assert r.final_size == size(done) and r.content == done["content"]


def test_exact_percentiles(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 20000):
        values = [round(rng.lognormvariate(0, 2), rng.choice([0, 3])) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        row = exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95}).head()
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            ordered, k = sorted(values), (n - 1) * p
            low, high = ordered[int(k)], ordered[min(int(k) + 1, n - 1)]
            assert row[name] == pytest.approx(low + (high - low) * (k - int(k)))
    assert exact_percentiles(df.filter("v < -1"), "v", {"p": 0.5}).head().p is None


def test_salted_join_keeps_every_pair(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(200)], "i int, k string")
    keyed = spark.createDataFrame([("hot", 1), ("hot", 2), ("none", 3)], "k string, v int")
    got = salted_join(facts, keyed, "k", ["i"]).select("i", "k", "v").collect()
    assert sorted(got) == sorted(facts.join(keyed, "k").select("i", "k", "v").collect())
    for bound in (1, 100):
        same = lookup_join(facts, keyed, "k", ["i"], bound).select("i", "k", "v")
        assert sorted(same.collect()) == sorted(got)


def test_longest_prefix_and_outermost(spark):
    cards = spark.createDataFrame([("parts/foo",), ("\\parts\\foo/bar/ ",), ("parts",), ("",), (None,)], "module_path string")
    names = ["parts/foo/a.cpp", "parts/foobar/a.cpp", "parts/foo/bar/x/y.h", "other/z.h", "parts/foo"]
    paths = spark.createDataFrame([(n,) for n in names], "file string")
    got = {r.file: r.module_path for r in attribution.with_module(paths, paths, cards).collect()}
    assert got == {
        "parts/foo/a.cpp": "parts/foo", "parts/foobar/a.cpp": "parts", "parts/foo/bar/x/y.h": "parts/foo/bar",
        "other/z.h": None, "parts/foo": "parts/foo"}
    dirs = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",), ("c/d/e",), ("c/d",)], "path string")
    assert sorted(r.path for r in attribution.outermost(dirs).collect()) == ["a", "ab", "c/d"]


def test_include_facts_lookup_and_ranking(spark):
    files = spark.createDataFrame([
        ("m/a.cpp", '#include <x/y.h>\n// #include "y.h"\n#include <x/y.h> #include <x/y.h>\n# include "sub\\z.h"'),
        ("n/b.cpp", '#include "y.h"\n#include ""\n#include "d/"'),
        ("lost/c.cpp", "#include <y.h>"),
    ], "file string, text string")
    cards = spark.createDataFrame([("m",), ("n",)], "module_path string")
    facts = includes.include_facts(files, cards).cache()
    assert facts.count() == 6
    graph = {(r.facet, r.key): r.refs for r in includes.include_graph(facts, "y.h").collect()}
    assert graph == {("module", "m"): 3, ("module", "n"): 1, ("writing", "x/y.h"): 2, ("writing", "y.h"): 2, ("total", "y.h"): 4}
    top = includes.header_ranking(facts, 1).head()
    assert (top.basename, top.refs, top.commented_refs) == ("y.h", 4, 1)


def test_references_exclude_definitions_and_count_repeats(spark):
    files = spark.createDataFrame([
        ("m/a.h", "class Foo;\nFoo a; Foo b; Foobar c;\n// Foo"), ("m/b.h", "~Foo() operator = ~Foo1 a~Foo"),
    ], "file string, text string")
    defs = spark.createDataFrame([("Foo", "m/a.h", 1)], "name string, file string, line int")
    cards = spark.createDataFrame([("m",)], "module_path string")
    facts = references.reference_facts(files, defs, cards).cache()
    assert sorted((r.file, r.line) for r in facts.collect()) == [
        ("m/a.h", 2), ("m/a.h", 2), ("m/a.h", 3), ("m/b.h", 1), ("m/b.h", 1)]
    literal = references.literal_hits(files, ["~Foo", "operator ="])
    assert sorted((r.name, r.file, r.line, r.position) for r in literal.collect()) == [
        ("operator =", "m/b.h", 1, 0), ("~Foo", "m/b.h", 1, 0)]
    names = spark.createDataFrame([("~Foo",), ("operator =",), ("Foo",), ("a\\\\E.b",)], "name string")
    both = references.symbol_hits(files, names)
    assert sorted((r.name, r.line) for r in both.filter("file = 'm/b.h'").collect()) == [
        ("Foo", 1), ("Foo", 1), ("operator =", 1), ("~Foo", 1)]
    summary = references.reference_summary(facts).head()
    assert (summary.ref_count, summary.module_count) == (5, 1)
    first = references.with_context(references.sample_references(facts, 1), files).head()
    assert (first.line, first.context) == (2, "Foo a; Foo b; Foobar c;")


def test_preferred_definition_order(spark):
    rows = [("f", "z.h", 9, "function"), ("f", "a.h", 1, "typedef"), ("f", "b.h", 5, "class"), ("f", "b.h", 2, "class"),
            ("g", "b.h", 1, None), ("g", "a.h", 3, "variable"), ("h", "", 1, "class")]
    df = spark.createDataFrame(rows, "name string, file string, line int, kind string")
    got = {r.name: (r.file, r.line) for r in symbols.preferred_definition(df).collect()}
    assert got == {"f": ("b.h", 2), "g": ("a.h", 3)}


def test_reading_windows_and_searching(spark):
    body = "\n".join(f"line {i}" for i in range(1, 301))
    files = spark.createDataFrame([("d/B.txt", body), ("d/a.txt", "line 1\nx"), ("e/e.txt", "")], "file string, text string")
    row = textsearch.read_window(files, F.lit(280), F.lit(20)).filter("file = 'd/B.txt'").head()
    assert (row.start_line, row.end_line, row.truncated) == (20, 219, True)
    row = textsearch.read_window(files, F.lit(900), F.lit(950)).filter("file = 'd/B.txt'").head()
    assert (row.start_line, row.end_line, row.content) == (300, 300, "line 300")
    row = textsearch.read_window(files, F.lit(1), F.lit(5)).filter("file = 'e/e.txt'").head()
    assert (row.start_line, row.end_line, row.content) == (1, 0, "")
    assert textsearch.read_preview(files).filter("file = 'd/B.txt'").head().end_line == settings.PREVIEW_LINES
    hits = textsearch.search_text(files, "line 1", "d").orderBy("rank").collect()
    assert (len(hits), hits[0].relative_path, hits[0].truncated) == (50, "d/a.txt", True)
    with pytest.raises(ValueError):
        textsearch.search_text(files, "x", ".")
    listing = textsearch.list_directory(files.select("file"), ".", "file").collect()
    assert sorted((r.name, r.type, r.item_count) for r in listing) == [("d", "dir", 2), ("e", "dir", 2)]


def make_run(spark, expected, answer="", steps=(), status="completed"):
    fields = {
        "must_mention": [], "must_contain_modules": [], "must_contain_symbols": [], "must_not_contain": [], "gold_list": [],
        "required_tools": [], "root_cause_file": None, "root_cause_symbol": None, "key_change_fields": [], "target_file": None,
        "target_files": [], "forbidden_files": [], "any_filename": False,
    } | expected
    kinds = {"any_filename": "boolean", "root_cause_file": "string", "root_cause_symbol": "string", "target_file": "string"}
    schema = ", ".join(f"{k}: {kinds.get(k, 'array<string>')}" for k in fields)
    rows = [(tuple(fields.values()), answer, status, [("tool_call", *s) for s in steps])]
    df = spark.createDataFrame(
        rows, f"expected struct<{schema}>, answer string, status string, "
              "steps array<struct<type: string, name: string, arguments: string, ok: boolean, result: string>>")
    return checks.run_checks(df).head()


WRITE = ("write_text_file", '{"relative_path": "a/x.h"}', True, '{"ok": true, "created": true}')
EDIT = ("replace_text_in_file", '{"relative_path": "a/y.h"}', True, '{"ok": true}')
READ = ("read_text_file", '{"relative_path": "a/y.h"}', None, '{"content": "z"}')


def test_checks_on_answers(spark):
    r = make_run(spark, {"must_mention": ["84", "rank node|排行节点", "no"]}, "共 84 个, 排 行\n节点")
    assert r.mentions_covered == pytest.approx(2 / 3)
    assert make_run(spark, {"must_mention": ["84"]}, "184 和 845").mentions_covered == 0.0
    assert make_run(spark, {"must_mention": ["a.b"]}, "axb").mentions_covered == 0.0
    assert make_run(spark, {"must_not_contain": ["bad"]}, "a bad one").no_hallucination == 0.0
    assert make_run(spark, {}, "已修改文件").no_claimed_without_result == 0.0
    assert make_run(spark, {}, "已修改文件", [EDIT]).no_claimed_without_result == 1.0
    assert make_run(spark, {}, status="error").stable == 0.0


def test_checks_on_steps(spark):
    r = make_run(spark, {"required_tools": ["read_text_file", "list_modules"]}, steps=[READ, ("list_modules", "{}", False, "{}")])
    assert r.required_tools_called == 0.5
    assert r.used_index_tools == 1.0
    assert make_run(spark, {}, steps=[EDIT, READ]).read_before_write == 0.0
    assert make_run(spark, {}, steps=[WRITE, READ, EDIT]).read_before_write == 1.0
    assert make_run(spark, {}, steps=[("search_text", '{"relative_dir": " . "}', True, "{}")]).no_illegal_search == 0.0
    assert make_run(spark, {}, steps=[("search_text", "not json", True, "{}")]).no_illegal_search == 0.0
    assert make_run(spark, {}, steps=[("search_text", '{"relative_dir": "parts/x"}', True, "{}")]).no_illegal_search == 1.0
    assert make_run(spark, {"root_cause_symbol": "y.h"}, steps=[READ]).root_cause_located == 1.0
    assert make_run(spark, {"root_cause_file": "y.h"}, steps=[EDIT]).read_target_file == 0.0


def test_checks_on_written_files(spark):
    only = lambda e, s: make_run(spark, e, steps=s).only_target_file_modified
    assert only({"target_file": "a/x.h"}, [WRITE]) == 1.0
    assert only({"target_file": "a/x.h"}, [EDIT]) == 0.0
    assert only({"target_files": ["a/x.h", "a/q.h"]}, [WRITE]) == 0.5
    assert only({"target_files": ["a/x.h"]}, []) == 0.0
    assert only({}, []) == 1.0
    assert only({"any_filename": True}, []) == 0.0
    assert only({"any_filename": True}, [WRITE]) == 1.0
    assert only({"any_filename": True, "forbidden_files": ["**/x.h"]}, [WRITE]) == 0.0
    assert only({"forbidden_files": ["**/x.h"]}, [WRITE]) == 0.0


def test_checks_on_results(spark):
    found = ("find", "{}", True, '{"modules": ["m1", {"module_path": "m2", "name": "n"}], "other": ["zz"], "n": {"a": [1, true]}}')
    r = make_run(spark, {"gold_list": ["m1", "m2", "zz"]}, steps=[found])
    assert r.precision == pytest.approx(2 / 3)
    assert r.recall == 1.0
    assert make_run(spark, {"gold_list": ["1 True"]}, steps=[found]).recall == 1.0
    assert make_run(spark, {"gold_list": ["modules"]}, steps=[found]).recall == 0.0
    assert make_run(spark, {"gold_list": ["m1"]}).precision == 1.0


def test_grading_renormalises_pending_layers(spark):
    df = spark.createDataFrame([("c", "consult"), ("r", "retrieval")], "case_id string, scenario string").select(
        "*", datasets.default_grading(F.col("scenario")).alias("grading"),
        F.create_map(F.lit("modules_covered"), F.lit(0.0), F.lit("recall"), F.lit(0.5)).alias("scores"))
    got = {r.case_id: r for r in grading.grade_runs(df).collect()}
    assert got["c"].task_score is None
    assert got["c"].case_score == pytest.approx((2 / 3 * 0.3 + 1.0 * 0.2) / 0.5)
    assert got["r"].case_score == pytest.approx(0.75 * 0.5 + 0.2 + 0.3)
    runs = spark.createDataFrame([("a", "s", 0.0), ("a", "s", 1.0), ("b", "s", 0.5), ("d", "t", None)],
                                 "case_id string, scenario string, case_score double")
    for layer in grading.LAYERS:
        runs = runs.withColumn(f"{layer}_score", F.col("case_score"))
    cases = {r.case_id: r for r in grading.grade_cases(runs).collect()}
    assert cases["a"].case_score_std == pytest.approx(statistics.pstdev([0, 1]))
    assert cases["b"].case_score_std is None and cases["d"].case_score_mean is None


def test_engineering_metrics_with_gaps(spark):
    runs = spark.createDataFrame(
        [("completed", 1.0, 1000, 0, 1, 0, None), ("error", None, None, 500, 2, 1, 8.0)],
        "status string, duration_ms double, input_tokens long, output_tokens long, llm_calls long, tool_calls long, "
        "llm_latency_ms double")
    row = metrics.engineering(runs).head()
    assert (row.total_runs, row.stable_runs, row.stability_rate) == (2, 1, 0.5)
    assert row.duration_p95_ms == 1.0 and row.llm_latency_p50_ms == 4.0
    assert row.estimated_cost_cny == pytest.approx(1.0 * 0.002 + 0.5 * 0.08)
    empty = metrics.engineering(runs.filter("status = 'x'")).head()
    assert empty.total_runs == 0 and empty.stability_rate is None and empty.duration_p50_ms is None
    unknown = metrics.failures(spark.createDataFrame([("x",), (None,), ("completed",)], "status string")).collect()
    assert [r.attribution for r in unknown] == [settings.UNKNOWN_ATTRIBUTION] * 2


def test_kappa_edges(spark):
    def kappa(pairs):
        return calibration.agreement(spark.createDataFrame(pairs, "human string, judge string")).head().kappa
    assert kappa([("a", "a"), ("a", "a")]) == 1.0
    assert kappa([("a", "b"), ("a", "b")]) == 0.0
    assert kappa([("a", "a"), ("b", "b"), ("a", "b"), ("b", "b")]) == pytest.approx((0.75 - 0.5) / 0.5)


def test_labels_and_judge_replies(evaluate):
    assert evaluate([" 正确 ", "部分", "错误", "None", ""], calibration.normal_label) == ["对", "部分对", "错", "None", ""]
    replies = ['```json\n{"score": 4}\n```', 'so {"score": 9, "why": {"a": 1}} end', '{"score": "x"}', "none", '{"score": -1}']
    assert evaluate(replies, calibration.judge_score) == [0.8, 1.0, None, None, 0.0]


def test_snapshot_reports_missing_and_changed(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("__pycache__/x", "4"), ("d.pyc", "5")], "file string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "file string, text string")
    got = snapshot.verify(snapshot.hash_tree(old), snapshot.hash_tree(new)).collect()
    assert sorted((r.path, r.issue) for r in got) == [("b", "differs"), ("c", "missing")]


def test_replace_write_and_diff(spark):
    files = spark.createDataFrame([("a", "x y x"), ("b", "x")], "file string, text string")
    done = {r.file: r for r in editing.guarded_replace(files, F.lit("x"), F.lit("z"), F.lit(2)).collect()}
    assert done["a"].ok and done["a"].text == "z y z"
    assert not done["b"].ok and done["b"].text == "x" and "actual_occurrences=1" in done["b"].error
    writes = spark.createDataFrame([("a", "12", False), ("b", "123", True), ("c", "1", False)], "file string, content string, overwrite boolean")
    plan = {r.file: r for r in editing.plan_writes(files, writes).collect()}
    assert not plan["a"].ok and plan["b"].overwritten and plan["c"].created and plan["b"].characters_written == 3
    pair = spark.createDataFrame([("f", "a\nb", "a\nc")], "file string, before string, after string")
    assert editing.unified_diffs(pair).head().diff.split("\n") == ["--- a/f", "+++ b/f", "@@ -1,2 +1,2 @@", " a", "-b", "+c"]


def small_corpus(spark):
    rows = [("module", f"m{i % 3}", f"d{i:02d}", "", t) for i, t in enumerate([
        "rank rank node", "rankNode event", "event event center", "", "alpha beta rank", "node"])]
    rows += [("module", "m9", "d90", "1", "rank"), ("module", "m9", "d90", "2", "center node")]
    return spark.createDataFrame(rows, "kind string, module_path string, doc_id string, part string, text string")


def test_stored_index_equals_direct_scoring(spark, tmp_path):
    docs = small_corpus(spark)
    tokens = retrieval.tokenize_query(spark, "rankNode rank zebra")
    assert tokens == ["rank", "node", "rank", "zebra"]
    direct = retrieval.bm25_topk(docs, tokens, vocab=retrieval.vocabulary(docs, multipart=True)).collect()
    folder = str(tmp_path / "index")
    index = searchindex.ensure_index(docs, folder)
    stored = index.bm25(tokens).collect()
    key = lambda rows: sorted((r.doc_id, r["rank"], round(r.score, 9)) for r in rows)
    assert key(direct) == key(stored) and len(direct) > 2
    assert searchindex.load_index(spark, folder, docs) is not None
    assert searchindex.load_index(spark, folder, docs.filter("doc_id <> 'd00'")) is None
    assert searchindex.load_index(spark, str(tmp_path / "none")) is None


def test_fusion_ties_keep_first_seen_order(spark):
    make = lambda ids: spark.createDataFrame([("symbol", d, i + 1) for i, d in enumerate(ids)], "kind string, doc_id string, rank int")
    fused = retrieval.fuse(make(["a", "b"]), make(["c", "a", "d"])).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == ["a", "c", "b", "d"]
    records = spark.createDataFrame([("symbol", d, None, d) for d in "abcd"], "kind string, doc_id string, module_path string, name string")
    one = retrieval.quota_merge(retrieval.fuse(make(["b", "a"])), records, 1).collect()
    assert [(r.side, r.key) for r in one] == [("symbol", "b")]


def test_module_comments_and_documents(spark):
    files = spark.createDataFrame([
        ("m/src/b.cpp", "m", "// 活动中心 排行\n"), ("m/src/a.py", "m", "# 排行 活动\n"), ("m/x.txt", "m", "// 不算"),
    ], "file string, module_path string, text string")
    commented = corpus.commented_lines(files)
    got = corpus.module_comments(files, commented).head()
    assert got.comments == "排行 活动 活动中心"
    cards = spark.createDataFrame(
        [("m", "RankServ", None, ["src/main.cpp"], ["src/main.cpp", "src/global_serv.h"], ["a.conf"], [])],
        "module_path string, module_name string, module_type string, entry_files array<string>, "
        "extra_key_files array<string>, config_files array<string>, doc_files array<string>")
    texts = spark.createDataFrame([("m", "1", "hello"), ("m", "2", "")], "module_path string, part string, text string")
    docs = corpus.module_documents(cards, corpus.module_comments(files, commented), texts).collect()
    by_id = {}
    for d in sorted(docs, key=lambda r: (r.doc_id, r.part)):
        by_id.setdefault(d.doc_id, []).append(d.text)
    assert by_id["module:m#meta"][0].split("\n")[3:5] == [
        "path_tokens: rank serv", "key_files: src/main.cpp src/global_serv.h"]
    assert by_id["module:m#docs"] == ["[module-docs] m", "hello"]
    assert corpus.corpus_stats(corpus.module_documents(cards, corpus.module_comments(files, commented), texts)).head().module_docs == 3


def test_markdown_and_violations(spark):
    df = spark.createDataFrame([("a", 0.12345, None, ["x", "y"])], "k string, v double, w double, s array<string>")
    assert report.markdown_rows(df).head().line == "| a | 0.123 | - | x, y |"
    cases = spark.createDataFrame([("1", "bug"), ("1", "consult")], "id string, scenario string").select(
        "*", F.from_json(F.lit("{}"), "gold_list array<string>, root_cause_file string, root_cause_symbol string, "
                         "target_file string, key_change_fields array<string>, any_filename boolean").alias("expected"))
    assert sorted(r.rule for r in datasets.violations(cases).collect()) == ["bug needs a root cause", "duplicate id"]


def test_snapshot_of_named_values(spark, tmp_path):
    git = tmp_path / ".git" / "refs"
    git.mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/main\n")
    (git / "main").write_text("abc123\n")
    assert snapshot.head_commit(spark, str(tmp_path)) == "abc123"
    assert snapshot.head_commit(spark, str(tmp_path / "none")) is None
    take = lambda commit: snapshot.capture({
        "git": snapshot.named_values(spark, {"commit": commit}), "tools": snapshot.named_values(spark, {"schema": [{"a": 1}]})})
    assert snapshot.verify(take("abc"), take("abc")).count() == 0
    assert [r.path for r in snapshot.verify(take("abc"), take("abd")).collect()] == ["git/commit"]


def test_label_sheet(spark):
    cases = spark.createDataFrame([("1", "bug", "q1", 0), ("2", "bug", "q2", 1), ("3", "bug", "q3", 2), ("4", "consult", "q4", 3)],
                                  "id string, scenario string, question string, ord long").withColumn(
        "expected", F.struct(F.lit("r").alias("rubric")))
    answers = spark.createDataFrame([("1", "a1"), ("2", ""), ("3", "a3"), ("4", "a4")], "case_id string, answer string")
    rows = datasets.label_sheet(cases, answers, 2).collect()
    assert sorted((r.case_id, r.answer, r.rubric) for r in rows) == [("1", "a1", "r"), ("4", "a4", "r")]


def test_long_json_strings_are_flattened(spark):
    from treeline.operators.checks import flatten_json

    long = 'a\\"b\\\\ ' * 20_000
    rows = spark.createDataFrame([('{"key": "' + long + '", "n": [1, true, null]}',)], "v string")
    got = rows.select(flatten_json(F.col("v")).alias("x")).first().x
    assert got == 'a"b\\ ' * 20_000 + " 1 True None"


def test_distance_of_1024_dimensions(spark):
    from treeline.operators.retrieval import nearest

    rows = [("module", str(i), [float(i)] * 1024) for i in range(5)]
    table = spark.createDataFrame(rows, "kind string, doc_id string, embedding array<float>")
    got = nearest(table, [2.0] * 1024, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.distance) for r in got] == [("2", 0.0), ("1", 1024.0), ("3", 1024.0)]


def test_scores_of_documents_in_parts_count_each_document_once(spark):
    from treeline.operators.retrieval import bm25_topk

    whole = [("module", "a", "red red blue"), ("module", "b", "blue green"), ("module", "c", "grey"), ("module", "d", "pink")]
    parts = [("module", "a", "red"), ("module", "a", "red"), ("module", "a", "blue"), *whole[1:]]
    score = lambda rows: [(r.doc_id, round(r.score, 9)) for r in bm25_topk(spark.createDataFrame(rows, "kind string, doc_id string, text string"), ["red"]).collect()]
    assert score(whole) == score(parts) != []


def test_percentiles_of_a_million_values_about_one_rank(spark):
    n = 1_000_000
    # Half the mass within a millionth of the median, all values distinct.
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, 1.0 + F.col("id") * 1e-12).otherwise(F.col("id").cast("double") * 3).alias("v"))
    result = exact_percentiles(df, "v", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    values = sorted([1.0 + i * 1e-12 for i in range(0, n, 2)] + [i * 3.0 for i in range(1, n, 2)])
    row = result.head()
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p99", 0.99)):
        k = (n - 1) * p
        low, high = values[int(k)], values[int(k) + 1]
        assert row[name] == pytest.approx(low + (high - low) * (k - int(k)), rel=1e-15)


def test_a_hundred_thousand_special_names_against_plain_search(spark):
    rng = random.Random(21)
    names = list({f"{rng.choice(['~', 'operator ', 'a::', 'x-', '@'])}{''.join(rng.choices('abc:-~ =', k=rng.randrange(1, 9)))}" for _ in range(260_000)})
    names = names[:100_000] + ["::", "a::b", "b::c", "~", "é-é", "--", "a"]
    lines = ["".join(rng.choices("abc:-~ =_é1", k=rng.randrange(0, 90))) for _ in range(40)] + ["a::b::c a::b", "----", "~ ~~ x~ ~x", "é-é-é", ""]
    files = spark.createDataFrame([(f"f{i}", "\n".join(lines[i::4])) for i in range(4)] + [("none", None)], "file string, text string")
    table = spark.createDataFrame([(n,) for n in names + [""]], "name string")
    got = sorted(tuple(r) for r in references.special_hits(files, table, pack_chars=200_000).collect())
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
    want = []
    for i in range(4):
        for number, line in enumerate(lines[i::4], 1):
            for name in {n for n in names if n in line}:
                at, times = 0, 0
                while (at := line.find(name, at)) >= 0:
                    end = at + len(name)
                    if (at and line[at - 1] in word) or (end < len(line) and line[end] in word):
                        at += 1
                        continue
                    want.append((name, f"f{i}", number, times))
                    at, times = end, times + 1
    assert got == sorted(want) and len(want) > 150
    plan = references.special_hits(files, table, pack_chars=200_000)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_references_shuffle_no_row_per_occurrence(spark):
    from treeline.functions.text import split_lines
    from treeline.functions.tokens import word_runs

    rows = [
        ("m/a.c", "x y x\r\nx 1 foo\ny"), ("m/b.c", "x\n\nfoo x_x"), ("m/n/c.c", "y y"), ("m/a.c", "x"), (None, "x"), ("o.c", None), ("o.c", ""),
    ]
    files = spark.createDataFrame(rows, "file string, text string")
    defs = spark.createDataFrame(
        [("x", "m/a.c", 1), ("x", "m/a.c", 1), ("x", "m/b.c", 1), ("y", "m/n/c.c", 9), ("foo", None, 1), ("no", "m/a.c", 1), (None, "m/a.c", 2), ("1", "m/a.c", None)],
        "name string, file string, line int",
    )
    cards = spark.createDataFrame([("m",), ("m/n",)], "module_path string")
    facts = references.reference_facts(files, defs, cards)
    assert sorted(tuple(r) for r in facts.filter("file IS NOT NULL").collect()) == [
        ("1", "m", "m/a.c", 2, 1), ("foo", "m", "m/a.c", 2, 2), ("foo", "m", "m/b.c", 3, 0), ("x", "m", "m/a.c", 2, 0),
        ("y", "m", "m/a.c", 1, 1), ("y", "m", "m/a.c", 3, 0), ("y", "m/n", "m/n/c.c", 1, 0), ("y", "m/n", "m/n/c.c", 1, 1)]
    assert [tuple(r) for r in facts.filter("file IS NULL").collect()] == [("x", None, None, 1, 0)]
    # The only exchange of words is that of packed rows: none lies above the explode.
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate explode")]


def test_words_packed_over_batches(spark, monkeypatch):
    monkeypatch.setattr(references, "PACK_WORDS", 3)
    files = spark.createDataFrame([(f"f{i}", "a b a\n\nb c") for i in range(5)], "file string, text string").coalesce(1)
    defs = spark.createDataFrame([("a", "f1", 1), ("b", "f3", 3), ("c", "f3", 2)], "name string, file string, line int")
    cards = spark.createDataFrame([("m",)], "module_path string")
    got = sorted((r.file, r.name, r.line, r.position) for r in references.reference_facts(files, defs, cards).collect())
    every = [("a", 1, 0), ("a", 1, 2), ("b", 1, 1), ("b", 3, 0), ("c", 3, 1)]
    gone = {("f1", "a", 1), ("f3", "b", 3)}
    assert got == sorted((f"f{i}", *e) for i in range(5) for e in every if (f"f{i}", *e[:2]) not in gone)


def test_definitions_and_first_lines_by_document(spark, tmp_path):
    from treeline.plans import facts

    rows = [
        (3, "s1", "en", "b\na b\n"), (1, "s2", "en", "x\nb\nb 1z"), (1, "s3", "de", "b x"), (None, "s4", "en", "only b"), (-2, "s1", "en", "q\nx"),
    ]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = facts.definitions(spark, str(tmp_path))
    assert sorted((r.name, r.file, r.line) for r in found.collect()) == [
        ("a", "s1/en/3.txt", 2), ("b", "s2/en/1.txt", 1), ("b", "s3/de/1.txt", 1), ("q", "s1/en/-2.txt", 1), ("x", "s1/en/-2.txt", 2),
        ("z", "s2/en/1.txt", 3), ("z", "s3/de/1.txt", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "keys=[name#" in plan and not re.search(r"hashpartitioning\(name#\d+, doc_id", plan)
    every = facts.all_definitions(spark, str(tmp_path))
    assert sorted((r.name, r.file, r.line) for r in every.filter("name in ('b', 'x')").collect()) == [
        ("b", "s1/en/3.txt", 1), ("b", "s2/en/1.txt", 1), ("b", "s3/de/1.txt", 1),
        ("x", "s1/en/-2.txt", 2), ("x", "s2/en/1.txt", 1), ("x", "s3/de/1.txt", 1)]
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(name#", plan)


def test_percentiles_take_the_value_once_a_row(spark):
    """A test on the join key below the count would work out the value anew for each edge of each row."""
    df = spark.range(100).select(F.get_json_object(F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")), "$.k").cast("long").alias("v"))
    result = exact_percentiles(df, "v", {"p50": 0.5})
    filters = [x for x in result._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter (" in x or "Filter " in x]
    assert filters and not any("lambda" in x for x in filters)
    assert result.head().p50 == 49.5
