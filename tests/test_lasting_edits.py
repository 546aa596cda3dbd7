"""A built repository: searches from stored indexes, and edits that other sessions see."""

import json
import shutil

import pytest

from treeline import build
from treeline.toolbox import Toolbox

FILES = {
    "parts/rank_serv/conf/serv_info.conf": "module_name = Rank\nmodule_type = serv\n",
    "parts/rank_serv/src/main.cpp": '#include "rank_node.h"\nint main() { rank_node x; }\n',
    "parts/oak_event_serv/src/rank_node.h": "class rank_node {}; // 排行榜\n",
    "parts/oak_event_serv/conf/serv_info.conf": "module_name = Oak\n",
    "parts/oak_event_serv/README.md": "oak events and ranks\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A repository, its tag file and the tables built from them."""
    home = tmp_path_factory.mktemp("built")
    for name, text in FILES.items():
        path = home / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    tag = {"_type": "tag", "name": "rank_node", "path": "parts/oak_event_serv/src/rank_node.h", "line": 1, "kind": "class"}
    (home / "tags.json").write_text(json.dumps(tag))
    embed = lambda texts: [[float(len(t)), float(t.count("rank"))] for t in texts]
    build.build_tables(spark, str(home / "repo"), str(home / "tags.json"), str(home / "tables"), embed)
    return home


@pytest.fixture
def out(built, tmp_path):
    """A copy of the tables; stores name their parts relative to their own folder."""
    return shutil.copytree(built / "tables", tmp_path / "tables").as_posix()


def box_of(spark, out, embed=lambda q: [float(len(q)), float(q.count("rank"))]):
    return Toolbox(spark, build.load_tables(spark, out), embed=embed)


def ask(box, tool, **arguments):
    return box.call(tool, json.dumps(arguments))


def test_resolve_term_after_a_build(spark, out):
    answer = ask(box_of(spark, out), "resolve_term", query="rank")
    assert answer["retrieval"]["mode"] == "hybrid" and answer["retrieval"]["bm25_symbol_hits"] >= 0
    assert {m["module_path"] for m in answer["candidates"]["modules"]} == {"parts/rank_serv", "parts/oak_event_serv"}
    alone = ask(box_of(spark, out, embed=None), "resolve_term", query="oak")
    assert alone["retrieval"]["mode"] == "bm25" and alone["retrieval"]["dense_module_hits"] == 0
    assert [m["module_path"] for m in alone["candidates"]["modules"]] == ["parts/oak_event_serv"]


def test_stored_search_reads_no_corpus_text(spark, out):
    tables = build.load_tables(spark, out)
    plan = tables.index.bm25(["rank"])._jdf.queryExecution().executedPlan().toString()
    assert "/corpus" not in plan and "text" not in plan


def test_a_second_session_sees_an_edit_and_its_facts(spark, out):
    one = box_of(spark, out)
    edit = dict(relative_path="parts/rank_serv/src/main.cpp", old_text="rank_node.h", new_text="other/tree.h", expected_occurrences=1)
    assert ask(one, "replace_text_in_file", **edit)["ok"]
    assert ask(one, "write_text_file", relative_path="parts/rank_serv/src/new.h", content='#include "tree.h"\n', overwrite=False)["created"]
    two = box_of(spark, out)
    assert "other/tree.h" in ask(two, "read_text_file", relative_path=edit["relative_path"])["content"]
    for box in (one, two):
        assert ask(box, "query_include_graph", header="tree.h")["by_writing"] == {"other/tree.h": 1, "tree.h": 1}
        assert ask(box, "query_include_graph", header="rank_node.h")["total_refs"] == 0
    assert two.tables.files.count() == len(FILES) + 1


def test_of_two_edits_from_one_version_one_is_refused(spark, out):
    one, two = box_of(spark, out), box_of(spark, out)
    path = "parts/oak_event_serv/README.md"
    assert ask(one, "write_text_file", relative_path=path, content="first", overwrite=True)["ok"]
    refused = ask(two, "write_text_file", relative_path=path, content="second", overwrite=True)
    assert refused["ok"] is False and "changed" in refused["error"]
    assert ask(two, "read_text_file", relative_path=path)["content"] == "first"
    assert ask(two, "write_text_file", relative_path=path, content="second", overwrite=True)["ok"]
    one.reload_files()
    assert ask(one, "read_text_file", relative_path=path)["content"] == "second"


def test_a_second_build_updates_the_index(spark, built, out, tmp_path):
    shutil.copytree(built / "repo", tmp_path / "repo")
    (tmp_path / "repo/parts/oak_event_serv/README.md").write_text("oak events and forests\n")
    before = build.load_tables(spark, out).index
    build.build_tables(spark, str(tmp_path / "repo"), str(built / "tags.json"), out)
    tables = build.load_tables(spark, out)
    assert len(tables.index.store.segments) == len(before.store.segments) + 1
    assert tables.files.count() == len(FILES)
    assert [r.doc_id for r in tables.index.bm25(["forests"]).collect()] == ["module:parts/oak_event_serv#docs"]
    assert tables.index.bm25(["ranks"]).collect() == []
