"""Readers over real folders and files, and the catalog built from them."""

import json

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from treeline.operators import catalog, grading, references
from treeline.sources import jsonlines, repository
from treeline.streaming import steps


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    put = {
        "parts/rank_serv/conf/serv_info.conf": b"; note\n[main]\nmodule_name = \"\"\nModule_Name: 'RankServ',\nmodule_type = core ; x\n",
        "parts/rank_serv/src/main.cpp": b'#include "rank_node.h"\r\nint main;\r\n',
        "parts/rank_serv/src/core/utils/a_conf.h": "// 排行榜\n".encode("gbk"),
        "parts/rank_serv/README.md": "﻿标题\n".encode("utf-8"),
        "parts/rank_serv/doc/deep/x.txt": b"doc",
        "parts/rank_serv/other/y.txt": b"no doc",
        "parts/rank_serv/.git/src/main.cpp": b"skip",
        "parts/oak_event_serv/src/rank_node.h": b"\xff\xfe\x81",
        "parts/ash_event_serv/readme.md": b"no src directory",
    }
    for name, content in put.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def test_texts_with_encoding_fallback(spark, repo):
    texts = {r.file: r.text for r in repository.read_texts(spark, repo).collect()}
    assert texts["parts/rank_serv/src/main.cpp"] == '#include "rank_node.h"\nint main;\n'
    assert texts["parts/rank_serv/src/core/utils/a_conf.h"] == "// 排行榜\n"
    assert texts["parts/rank_serv/README.md"] == "标题\n"
    assert texts["parts/oak_event_serv/src/rank_node.h"] == b"\xff\xfe\x81".decode("latin-1")
    assert not any(".git/" in f for f in texts)
    headers = repository.read_files(spark, repo, (".h",)).select("file").collect()
    assert len(headers) == 2
    assert repository.strict_texts(repository.read_files(spark, repo, (".h",))).count() == 0


def test_module_cards(spark, repo):
    listing = repository.read_files(spark, repo, prune=False).select("file")
    config = repository.read_texts(spark, repo)
    files = listing.join(config, "file", "left")
    cards = {r.module_path: r for r in catalog.cards_of(files).collect()}
    assert set(cards) == {"parts/rank_serv", "parts/oak_event_serv"}
    card = cards["parts/rank_serv"]
    assert (card.module_name, card.module_type) == ("RankServ", "core")
    assert card.top_dirs == [".git", "conf", "doc", "other", "src"]
    assert card.config_files == ["serv_info.conf"]
    assert card.doc_files == ["README.md", "doc/deep/x.txt"]
    assert card.entry_files == ["src/main.cpp"]
    assert card.signals == {"has_src": True, "has_core_utils": True, "has_global_serv": False, "has_event_process": False,
                            "has_rank_node": False, "has_conf_loader": True}
    other = cards["parts/oak_event_serv"]
    assert other.module_name is None and other.signals["has_rank_node"]
    assert {(r.lack, r.module_path) for r in catalog.plain_modules(catalog.cards_of(files)).collect()} == {
        ("no type", "parts/oak_event_serv")}


def test_tags(spark, tmp_path):
    good = tmp_path / "good.json"
    rows = [{"_type": "tag", "name": "Foo", "path": "a\\b.h", "line": 3, "kind": "class"},
            {"_type": "ptag", "name": "x", "path": "a", "line": 1, "kind": "y"},
            {"_type": "tag", "name": "", "path": "a", "line": 1, "kind": "y"}]
    good.write_text("\n".join(json.dumps(r) for r in rows))
    got = jsonlines.read_tags(spark, str(good)).collect()
    assert [(r.name, r.file, r.line, r.kind, r.signature) for r in got] == [("Foo", "a/b.h", 3, "class", None)]
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(rows[0]) + "\n{oops\n")
    with pytest.raises(Exception):
        jsonlines.read_tags(spark, str(bad)).collect()


def test_line_numbers_of_a_file_in_many_splits(spark, tmp_path):
    made = {}
    for name, n in (("b.jsonl", 3000), ("a.jsonl", 50)):
        lines = ["" if i % 7 == 3 else "# note" if i % 11 == 5 else json.dumps({"case_id": f"{name}{i}", "human": "x" * (i % 90)}) for i in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (name == "b.jsonl"))
        made[name] = lines
    kept = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        numbered = jsonlines.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8 and numbered.select("ord").distinct().count() == 3050
        rows = [(r.file, r.line, r.value, r.ord) for r in numbered.collect()]
        assert sorted(r[:3] for r in rows) == sorted((f, i, v) for f, lines in made.items() for i, v in enumerate(lines, 1))
        assert [r[:2] for r in sorted(rows, key=lambda r: r[3])] == sorted(r[:2] for r in rows)
        (tmp_path / "b.jsonl").write_text("\n".join([*made["b.jsonl"][:2345], "{oops", "{}"]))
        with pytest.raises(Exception, match="b.jsonl:2346: not JSON"):
            jsonlines.read_labels(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cases_and_labels(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text("# note\n\n" + "\n".join(json.dumps(c) for c in [
        {"id": "1", "scenario": "retrieval", "question": "q", "expected": {"gold_list": ["a"], "unknown": 1}},
        {"id": "2", "scenario": "bug", "question": "q",
         "grading": {"task": {"type": "llm_judge", "weight": 0.5}, "evidence": {"checks": ["recall"]}}},
    ]))
    first, second = jsonlines.read_cases(spark, str(path)).orderBy("ord").collect()
    assert (first.ord, second.ord) == (3, 4)
    assert first.expected.gold_list == ["a"] and first.grading.task.checks == ["recall", "precision"]
    assert second.grading.task.type == "llm_judge"
    assert (second.grading.trace.type, second.grading.trace.weight) == ("rules", 1.0)
    bad = tmp_path / "bad.jsonl"
    bad.write_text("# x\nprose\n")
    with pytest.raises(Exception):
        jsonlines.read_cases(spark, str(bad)).collect()
    labels = tmp_path / "labels.jsonl"
    labels.write_text('{"case_id": "1", "human": null, "judge": "对"}\n')
    assert jsonlines.read_labels(spark, str(labels)).head().human is None


def test_traces_and_answers(spark, tmp_path):
    for case, runs in {"c1": [("error", "first"), ("completed", "good"), ("completed", "later")], "c2": [("error", "x")]}.items():
        (tmp_path / case).mkdir()
        for i, (status, answer) in enumerate(runs, 1):
            (tmp_path / case / f"run_{i}.json").write_text(json.dumps(
                {"case_id": case, "status": status, "answer": answer,
                 "steps": [{"type": "tool_call", "name": "t", "result": {"a": [1]}}]}, indent=1))
    (tmp_path / "c2" / "run_0.json").write_text("{broken")
    traces = jsonlines.read_traces(spark, str(tmp_path))
    assert traces.count() == 4
    assert traces.select("steps").head().steps[0].result == '{"a":[1]}'
    got = {r.case_id: r.answer for r in jsonlines.usable_answers(traces).collect()}
    assert got == {"c1": "good", "c2": "x"}


def test_step_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    event = {"run_id": "r", "ts": "2024-01-01T00:00:10", "seq": 1, "type": "tool_call", "name": "search_text", "ok": False}
    rows = [event, event, event | {"seq": 2, "ok": True}]
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for n in (2, 3):
        steps.append_log(steps.step_events(spark, str(source)), target, mark).awaitTermination(120)
        assert spark.read.parquet(target).count() == n
        (source / "b.json").write_text(json.dumps(event | {"seq": 3}))
    counts = steps.step_counts(spark.read.parquet(target)).head()
    assert (counts.steps, counts.failed) == (3, 2)


def test_layer_score_counts_unknown_checks_as_passed(spark):
    df = spark.range(1).select(
        grading.layer_score(F.array(F.lit("a"), F.lit("zzz")), F.create_map(F.lit("a"), F.lit(0.0))).alias("two"),
        grading.layer_score(F.lit(None).cast("array<string>"), F.create_map(F.lit("a"), F.lit(0.0))).alias("none"))
    row = df.head()
    assert (row.two, row.none) == (0.5, 1.0)


def test_build_and_lookups(spark, repo, tmp_path, capsys):
    from treeline import __main__ as cli
    from treeline import build
    from treeline.toolbox import Toolbox

    tags = tmp_path / "tags.json"
    tags.write_text("\n".join(json.dumps({"_type": "tag", "name": n, "path": p, "line": i, "kind": k}) for n, p, i, k in [
        ("main", "parts/rank_serv/src/main.cpp", 2, "function"), ("rank_node", "parts/oak_event_serv/src/rank_node.h", 1, "class"),
        ("helper", "parts/rank_serv/src/core/utils/a_conf.h", 1, "member")]))
    out = str(tmp_path / "tables")
    build.build_tables(spark, repo, str(tags), out)
    tables = build.load_tables(spark, out)
    docs = {(r.doc_id, r.part): r.text for r in tables.corpus.collect()}
    assert ("module:parts/rank_serv#comments", "") in docs and docs[("module:parts/rank_serv#comments", "")].endswith("排行榜")
    assert docs[("module:parts/rank_serv#docs", "0/README.md")] == "标题\n"
    assert "related_chinese:\n排行榜" in docs[("symbol:helper", "")]
    assert [(r.name, r.file, r.line) for r in tables.references.collect()] == [("rank_node", "parts/rank_serv/src/main.cpp", 1)]
    vectors = build.embed_corpus(tables.corpus, lambda texts: [[len(t), 1.0] for t in texts])
    assert vectors.count() == tables.records.count()
    box = Toolbox(spark, tables, embed=lambda q: [0.0, 1.0])
    box.tables.vectors = vectors
    answer = box.call("resolve_term", '{"query": "rank"}')
    assert {m["module_path"] for m in answer["candidates"]["modules"]} == {"parts/rank_serv", "parts/oak_event_serv"}
    assert cli.COMMANDS["header"](tables, "rank_node.h") == 0
    assert cli.COMMANDS["references"](tables, "nothing") == 1
    assert cli.COMMANDS["stats"](tables, None) == 0
    assert '"basename": "rank_node.h"' in capsys.readouterr().out


def test_tags_with_fields_of_other_types(spark, tmp_path):
    path = tmp_path / "tags.json"
    path.write_text(
        '{"_type": "tag", "name": "a", "path": "x.h", "line": 3, "kind": "macro"}\n'
        '{"_type": "tag", "name": "b", "path": "x.h", "line": true, "kind": "macro"}\n\n'
        '{"_type": "tag", "name": "c", "path": "x.h", "line": {"no": 1}, "kind": "macro"}\n'
    )
    assert [(r.name, r.line) for r in jsonlines.read_tags(spark, str(path)).collect()] == [("a", 3)]


def test_hidden_names_are_read(spark, tmp_path):
    put = ("src/__init__.py", "src/_impl.h", "src/a.h", ".env", ".ci/x.yml", "_odd/deep/b.h", "node/.git/c.h", ".git/d.h")
    for name in put:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    read = {r.file: r.text for r in repository.read_texts(spark, str(tmp_path)).collect()}
    assert read == {n: n for n in put[:6]}
    as_uri = repository.read_files(spark, f"file://{tmp_path}/", (".h",), prune=False)
    assert {r.file for r in as_uri.collect()} == {n for n in put if n.endswith(".h")}
    (tmp_path / "none").mkdir()
    assert repository.read_texts(spark, str(tmp_path / "none")).count() == 0


def test_tag_paths_become_relative(spark, tmp_path):
    path = tmp_path / "tags.json"
    paths = ["/w/repo/src/a.h", "src/a.h", "./src/./a.h", "src/x/../a.h", "src\\\\a.h", "/other/a.h", "../a.h", "/w/repository/a.h"]
    path.write_text("".join(
        '{"_type": "tag", "name": "n%d", "path": "%s", "line": 1, "kind": "macro"}\n' % p for p in enumerate(paths)))
    got = {r.name: r.file for r in jsonlines.read_tags(spark, str(path), "/w/repo/").collect()}
    assert [got[f"n{i}"] for i in range(len(paths))] == ["src/a.h"] * 5 + ["/other/a.h", "../a.h", "/w/repository/a.h"]


def test_names_without_word_characters(spark):
    files = spark.createDataFrame([("a.h", "变量 = 变量;\nx变量y\n量变 +\n"), ("b.h", None), ("c.h", "")], "file string, text string")
    names = spark.createDataFrame([("变量",), ("+",), ("",), (None,), ("变量",)], "name string")
    got = sorted(tuple(r) for r in references.special_hits(files, names).collect())
    assert got == [("+", "a.h", 3, 0), ("变量", "a.h", 1, 0), ("变量", "a.h", 1, 1)]


def test_lookups_print_every_row(spark, capsys):
    from treeline import __main__ as cli
    from treeline.toolbox import Tables

    rows = spark.range(100).select(
        F.lit("f").alias("name"), F.lit("m").alias("module_path"), F.concat(F.lit("x"), "id").alias("file"),
        F.lit(1).alias("line"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("signature"))
    assert cli._symbol(Tables(symbols=rows), "f") == 0
    assert len(capsys.readouterr().out.splitlines()) == 100


def test_only_missing_and_forbidden_files_are_dropped(tmp_path):
    class Store:
        def __init__(self, fault):
            self.fault = fault

        def open_input_file(self, path):
            raise self.fault

    (tmp_path / "a").write_bytes(b"x")
    assert repository.content_of(fs.LocalFileSystem(), str(tmp_path / "a")) == b"x"
    assert repository.content_of(fs.LocalFileSystem(), str(tmp_path / "gone")) is None
    assert repository.content_of(Store(PermissionError(13, "forbidden")), "a") is None
    with pytest.raises(OSError):
        repository.content_of(Store(OSError("connection lost")), "a")
