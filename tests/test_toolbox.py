"""The tools end to end over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from treeline.operators import includes, references, symbols
from treeline.toolbox import Tables, Toolbox


@pytest.fixture
def box(spark):
    files = spark.createDataFrame([
        ("parts/a/src/x.h", "class Foo;\nint bar;\n"), ("parts/a/src/y.cpp", '#include "x.h"\nFoo f; Foo g;\n'),
        ("parts/b/z.cpp", '// #include <a/x.h>\nFoo h;\n'),
    ], "file string, text string")
    cards = spark.createDataFrame(
        [("parts/a", "A", None), ("parts/b", None, "core")], "module_path string, module_name string, module_type string")
    tags = spark.createDataFrame([("Foo", "parts/a/src/x.h", 1, "class", None), ("bar", "parts/a/src/x.h", 2, "member", None)],
                                 "name string, file string, line int, kind string, signature string")
    facts = symbols.symbol_facts(tags, cards)
    docs = spark.createDataFrame([("module", "m1", "", "rank list"), ("module", "m2", "", "other"), ("symbol", "s1", "", "rank node")],
                                 "kind string, doc_id string, part string, text string")
    vectors = spark.createDataFrame([("module", "m1", [0.0, 1.0]), ("module", "m2", [5.0, 5.0]), ("symbol", "s1", [0.0, 0.0])],
                                    "kind string, doc_id string, embedding array<float>")
    records = spark.createDataFrame([("module", "m1", "parts/a", None, None, None), ("module", "m2", "parts/b", None, None, None),
                                     ("symbol", "s1", None, "RankNode", "n.h", "class")],
                                    "kind string, doc_id string, module_path string, name string, file string, symbol_kind string")
    return Toolbox(spark, Tables(
        files=files, cards=cards, includes=includes.include_facts(files, cards), symbols=facts,
        references=references.reference_facts(files, tags, cards), corpus=docs, records=records, vectors=vectors,
    ), embed=lambda query: [0.0, 0.0])


def ask(box, tool, **arguments):
    return box.call(tool, json.dumps(arguments))


def test_index_tools(box):
    assert [m["module_path"] for m in ask(box, "list_modules")["modules"]] == ["parts/a", "parts/b"]
    graph = ask(box, "query_include_graph", header="x.h")
    assert graph["modules"] == ["parts/a", "parts/b"] and graph["by_writing"] == {"a/x.h": 1, "x.h": 1} and graph["total_refs"] == 2
    assert ask(box, "query_include_graph", header="none.h")["total_refs"] == 0
    found = ask(box, "find_symbol_definition", symbol_name="Foo")
    assert found["definition_count"] == 1 and found["modules"] == ["parts/a"]
    assert ask(box, "list_symbols_in_module", module_path="parts/a", kind="member")["symbols"] == [
        {"name": "bar", "kind": "member", "file": "x.h", "line": 2}]
    refs = ask(box, "find_symbol_references", symbol_name="Foo")
    assert refs["ref_count"] == 3 and refs["by_module"] == {"parts/a": 2, "parts/b": 1}
    assert refs["sample_refs"][0]["context"] == "Foo f; Foo g;"
    assert ask(box, "find_symbol_references", symbol_name="Foo", scope="parts/b")["ref_count"] == 1


def test_resolve_term(box):
    answer = ask(box, "resolve_term", query="rank", top_k=4)
    assert [m["module_path"] for m in answer["candidates"]["modules"]] == ["parts/a", "parts/b"]
    assert answer["candidates"]["symbols"][0]["file"] == "n.h"
    assert answer["retrieval"]["module_candidates"] == 2


def test_file_tools(box):
    assert ask(box, "list_files", relative_dir="parts")["item_count"] == 2
    assert "hint" in ask(box, "list_files", relative_dir=".")
    assert ask(box, "list_files", relative_dir="nope")["ok"] is False
    assert ask(box, "search_files_by_name", name_query="X.", relative_dir=".")["matches"] == ["parts/a/src/x.h"]
    assert ask(box, "search_text", query="Foo", relative_dir=".")["ok"] is False
    assert ask(box, "search_text", query="Foo", relative_dir="parts/a")["match_count"] == 2
    assert ask(box, "read_text_file", relative_path="../x")["ok"] is False
    assert ask(box, "read_text_file", relative_path="parts/b/z.cpp", start_line=2, end_line=2)["content"] == "Foo h;"
    assert ask(box, "read_text_file", relative_path="parts/b/z.cpp")["preview"] is True
    assert ask(box, "read_text_file", relative_path="parts/b/z.cpp", start_line=2)["ok"] is False


def test_edits_are_visible_to_later_reads(box):
    assert ask(box, "write_text_file", relative_path="n.txt", content="abc", overwrite=False)["created"] is True
    assert ask(box, "write_text_file", relative_path="n.txt", content="x", overwrite=False)["ok"] is False
    bad = ask(box, "replace_text_in_file", relative_path="n.txt", old_text="b", new_text="Q", expected_occurrences=2)
    assert bad["ok"] is False
    assert ask(box, "replace_text_in_file", relative_path="n.txt", old_text="b", new_text="Q", expected_occurrences=1)["ok"]
    assert ask(box, "read_text_file", relative_path="n.txt")["content"] == "aQc"


def test_registry_errors_and_schema(spark, box):
    assert box.call("nope", "{}")["error"].startswith("unknown tool")
    assert box.call("list_files", "{bad")["ok"] is False
    assert box.call("list_files", '{"wrong": 1}')["ok"] is False
    assert Toolbox(spark, Tables()).call("list_modules", "{}") == {"ok": False, "error": "index not available"}
    schema = {t["function"]["name"]: t["function"]["parameters"] for t in box.registry.payload()}
    assert len(schema) == 12
    assert schema["read_text_file"] == {
        "type": "object",
        "properties": {"relative_path": {"type": "string"}, "start_line": {"type": "integer"}, "end_line": {"type": "integer"}},
        "required": ["relative_path"]}


def test_oversized_lists_become_a_stub(spark):
    many = spark.range(20000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("module_path"),
                                     F.lit(None).cast("string").alias("module_name"), F.lit(None).cast("string").alias("module_type"))
    answer = Toolbox(spark, Tables(cards=many)).call("list_modules", "{}")
    assert answer["truncated"] is True and "modules" not in answer
