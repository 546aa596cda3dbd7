"""The twelve lookup, search and edit tools over a set of fact tables.

Every tool answers with a small dict. Lists are fetched with a bound that follows
from the result cap: a list too long for the bound could not fit the cap either,
so the answer is the same "too large" stub the cap would produce.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline import settings
from treeline.functions.paths import is_safe_path
from treeline.operators import editing, includes, references, retrieval, symbols, textsearch
from treeline.operators.compaction import CUT_MARKER, LEAST_CONTENT
from treeline.operators.rankedindex import RankedIndex
from treeline.operators.registry import Registry
from treeline.operators.vectorstore import VectorIndex
from treeline.session import ensure_checkpoint_dir
from treeline.sources.segments import GONE, Conflict, Segments

EDITS_PER_CHECKPOINT = 20
MISSING = {"ok": False, "error": "index not available"}


class TooLarge(Exception):
    """A list cannot fit the cap of its tool."""


@dataclass
class Tables:
    """What the tools read; a missing table makes its tools answer `index not available`."""

    files: DataFrame | None = None
    cards: DataFrame | None = None
    includes: DataFrame | None = None
    symbols: DataFrame | None = None
    module_symbols: DataFrame | None = None
    references: DataFrame | None = None
    corpus: DataFrame | None = None
    records: DataFrame | None = None
    vectors: DataFrame | None = None
    #: Stored forms that searches prefer to `corpus` and `vectors`.
    index: RankedIndex | None = None
    vector_index: VectorIndex | None = None
    #: Where edits last: the store of `files`, and what refreshes the facts of edited files.
    file_store: Segments | None = None
    refresh: Callable[[list[str]], DataFrame] | None = None


def cap_of(tool: str) -> int:
    return settings.RESULT_CHAR_LIMITS.get(tool, settings.MAX_RESULT_CHARS)


def stub(result: dict) -> dict:
    return {
        "ok": result.get("ok", True), "truncated": True, "error": "result too large; narrow the search",
        "query": result.get("query"), "match_count": result.get("match_count"), "path": result.get("path"),
    }


def compact(result: dict, cap: int) -> dict:
    """Shrink one result below its cap: halve matches, then items, then cut content, else a stub."""
    size = lambda r: len(json.dumps(r, ensure_ascii=False, default=str))
    if size(result) <= cap:
        return result
    out = {**result, "truncated": True}
    for key in ("matches", "items"):
        rows = out.get(key)
        if not isinstance(rows, list) or not rows:
            continue
        kept = len(rows)
        while kept > 1 and size({**out, key: rows[:kept]}) > cap:
            kept //= 2
        out |= {key: rows[:kept], f"{key}_omitted": len(rows) - kept}
    if isinstance(out.get("content"), str) and size(out) > cap:
        out |= {"content": out["content"][: max(LEAST_CONTENT, cap // 4)] + CUT_MARKER, "content_truncated": True}
    return out if size(out) <= cap else stub(out)


class Toolbox:
    """Tools bound to a session and its tables."""

    def __init__(self, spark: SparkSession, tables: Tables, embed=None) -> None:
        self.spark, self.tables, self.embed = spark, tables, embed
        self._edits = 0
        self.registry = Registry()
        self.registry.register(
            self.list_files, self.read_text_file, self.search_text, self.search_files_by_name,
            self.replace_text_in_file, self.write_text_file, self.list_modules, self.query_include_graph,
            self.find_symbol_definition, self.list_symbols_in_module, self.find_symbol_references, self.resolve_term,
        )

    def call(self, name: str, arguments: str) -> dict:
        """Run a tool by name with JSON arguments and keep its answer below the cap."""
        try:
            return compact(self.registry.execute(name, arguments), cap_of(name))
        except TooLarge:
            return stub({})

    def _rows(self, df: DataFrame, tool: str, limit: int | None = None) -> list[dict]:
        bound = cap_of(tool) if limit is None else limit
        rows = [r.asDict(recursive=True) for r in df.limit(bound + 1).collect()]
        if limit is None and len(rows) > bound:
            raise TooLarge
        return rows[:bound]

    def _path_problem(self, path: str) -> dict | None:
        return None if is_safe_path(path) else {"ok": False, "error": "path must stay inside the workspace", "relative_path": path}

    def _dir(self, path: str) -> str:
        return path.strip().replace("\\", "/").rstrip("/") or "."

    def _has_dir(self, directory: str) -> bool:
        return directory == "." or not self.tables.files.filter(F.col("file").startswith(directory + "/")).isEmpty()

    # --- files ---------------------------------------------------------------

    def list_files(self, relative_dir: str) -> dict:
        """List one directory level."""
        directory = self._dir(relative_dir)
        if directory != "." and (problem := self._path_problem(relative_dir)):
            return problem
        if not self._has_dir(directory):
            return {"ok": False, "error": "no such directory", "path": directory}
        rows = self._rows(
            textsearch.list_directory(self.tables.files.select("file"), directory, "file").orderBy("rank"),
            "list_files", settings.MAX_LIST_ITEMS,
        )
        count = rows[0]["item_count"] if rows else 0
        out = {
            "ok": True, "path": directory, "items": [{"name": r["name"], "type": r["type"]} for r in rows],
            "item_count": count, "truncated": count > settings.MAX_LIST_ITEMS,
        }
        return out | ({"hint": "search for a module instead of listing the root"} if directory == "." else {})

    def read_text_file(self, relative_path: str, start_line: int | None = None, end_line: int | None = None) -> dict:
        """Read a line window of a file, or a preview of its head."""
        if problem := self._path_problem(relative_path):
            return problem
        path = relative_path.strip().replace("\\", "/")
        one = self.tables.files.filter(F.col("file") == path)
        if (start_line is None) != (end_line is None):
            return {"ok": False, "error": "start_line and end_line go together", "relative_path": relative_path}
        if start_line is not None and min(start_line, end_line) < 1:
            return {"ok": False, "error": "line numbers start at 1", "relative_path": relative_path}
        preview = start_line is None
        read = textsearch.read_preview(one) if preview else textsearch.read_window(one, F.lit(start_line), F.lit(end_line))
        row = read.head()
        if row is None:
            return {"ok": False, "error": "no such file", "path": path}
        out = {"ok": True, "path": path, "preview": preview}
        out |= {k: row[k] for k in ("total_lines", "start_line", "end_line", "content", "characters_read")}
        if preview:
            return out | {"hint": "give line numbers to read further", "context_updates": {"last_read_relative_path": relative_path}}
        place = {"relative_path": relative_path, "start_line": row["start_line"], "end_line": row["end_line"]}
        return out | {"truncated": row["truncated"], "context_updates": {
            "last_read_relative_path": relative_path, "last_retrieve": [place]}}

    def search_text(self, query: str, relative_dir: str) -> dict:
        """Find lines that contain a text below a directory."""
        directory = self._dir(relative_dir)
        if directory in (".", "/"):
            return {"ok": False, "error": "name a directory; the root is not searched", "relative_dir": relative_dir}
        if problem := self._path_problem(relative_dir):
            return problem
        if not self._has_dir(directory):
            return {"ok": False, "error": "no such directory", "path": directory}
        rows = self._rows(
            textsearch.search_text(self.tables.files, query, directory).orderBy("rank"),
            "search_text", settings.MAX_SEARCH_MATCHES,
        )
        matches = [{k: r[k] for k in ("relative_path", "line_number", "line")} for r in rows]
        places = [
            {"relative_path": m["relative_path"], "start_line": m["line_number"], "end_line": m["line_number"]}
            for m in matches[: settings.RETRIEVE_TOP]
        ]
        return {
            "ok": True, "query": query, "matches": matches, "match_count": len(matches),
            "truncated": len(matches) >= settings.MAX_SEARCH_MATCHES,
            "context_updates": {"last_search_query": query, "last_retrieve": places},
        }

    def search_files_by_name(self, name_query: str, relative_dir: str) -> dict:
        """Find files by part of their name."""
        directory = self._dir(relative_dir)
        if directory != "." and (problem := self._path_problem(relative_dir)):
            return problem
        if not self._has_dir(directory):
            return {"ok": False, "error": "no such directory", "path": directory}
        rows = self._rows(
            textsearch.find_files(self.tables.files.select("file"), name_query, directory, "file").orderBy("rank"),
            "search_files_by_name", settings.MAX_FILENAME_MATCHES,
        )
        matches = [r["file"] for r in rows]
        places = [
            {"relative_path": m, "start_line": 1, "end_line": settings.PREVIEW_LINES}
            for m in matches[: settings.RETRIEVE_TOP]
        ]
        return {
            "ok": True, "name_query": name_query, "matches": matches, "match_count": len(matches),
            "truncated": len(matches) >= settings.MAX_FILENAME_MATCHES,
            "context_updates": {"last_file_search_query": name_query, "last_retrieve": places},
        }

    def _store(self, path: str, text: str) -> dict | None:
        """Put one file in place of its former version; an answer if someone else changed the files.

        With a store of files the edit is a commit that other sessions see. It is refused, and
        the present version loaded, if the files have changed since this session read them.
        """
        new = self.spark.createDataFrame([(path, text)], "file string, text string")
        store = self.tables.file_store
        if store is None:
            files = self.tables.files.select("file", "text").filter(F.col("file") != path).unionByName(new)
            self._edits += 1
            if self._edits % EDITS_PER_CHECKPOINT == 0:
                ensure_checkpoint_dir(self.spark)
                files = files.checkpoint()
            self.tables.files = files
            return None
        draft = store.draft()
        draft.put("files", new)
        draft.put(GONE, new.select("file"))
        try:
            self.tables.file_store = draft.commit()
        except Conflict:
            self.reload_files()
            return {"ok": False, "error": "the files have changed meanwhile; read again", "path": path}
        self.tables.files = self.tables.file_store.read("files")
        if self.tables.refresh is not None:
            self.tables.includes = self.tables.refresh([path])
        return None

    def reload_files(self) -> None:
        """Take up what other sessions have committed."""
        self.tables.file_store = self.tables.file_store.refreshed()
        self.tables.files = self.tables.file_store.read("files")

    def replace_text_in_file(self, relative_path: str, old_text: str, new_text: str, expected_occurrences: int) -> dict:
        """Replace an exact text when it occurs exactly as often as expected."""
        if problem := self._path_problem(relative_path):
            return problem
        path = relative_path.strip().replace("\\", "/")
        row = editing.guarded_replace(
            self.tables.files.filter(F.col("file") == path), F.lit(old_text), F.lit(new_text), F.lit(expected_occurrences)
        ).head()
        if row is None:
            return {"ok": False, "error": "no such file", "path": path}
        if not row["ok"]:
            return {"ok": False, "error": row["error"], "path": path}
        if problem := self._store(path, row["text"]):
            return problem
        return {
            "ok": True, "path": path, "replaced_occurrences": row["occurrences"],
            "context_updates": {"last_modified_relative_path": relative_path},
        }

    def write_text_file(self, relative_path: str, content: str, overwrite: bool) -> dict:
        """Write a whole file."""
        if problem := self._path_problem(relative_path):
            return problem
        path = relative_path.strip().replace("\\", "/")
        write = self.spark.createDataFrame([(path, content, overwrite)], "file string, content string, overwrite boolean")
        row = editing.plan_writes(self.tables.files.filter(F.col("file") == path), write).head()
        if not row["ok"]:
            return {"ok": False, "error": "the file exists and overwrite is false", "path": path}
        if problem := self._store(path, content):
            return problem
        return {
            "ok": True, "path": path, "created": row["created"], "overwritten": row["overwritten"],
            "characters_written": row["characters_written"],
            "context_updates": {"last_modified_relative_path": relative_path},
        }

    # --- indexes ---------------------------------------------------------------

    def list_modules(self) -> dict:
        """List all modules."""
        if self.tables.cards is None:
            return dict(MISSING)
        rows = self._rows(
            self.tables.cards.select("module_path", "module_name", "module_type").orderBy("module_path"), "list_modules")
        return {"ok": True, "modules": rows, "module_count": len(rows)}

    def query_include_graph(self, header: str) -> dict:
        """Find the modules that include a header, in every spelling."""
        if self.tables.includes is None:
            return dict(MISSING)
        rows = self._rows(includes.include_graph(self.tables.includes, header).orderBy("facet", "key"), "query_include_graph")
        modules = [r["key"] for r in rows if r["facet"] == "module"]
        return {
            "ok": True, "header": header, "modules": modules, "module_count": len(modules),
            "by_writing": {r["key"]: r["refs"] for r in rows if r["facet"] == "writing"},
            "total_refs": sum(r["refs"] for r in rows if r["facet"] == "total"),
        }

    def find_symbol_definition(self, symbol_name: str) -> dict:
        """Find the definitions of a symbol by its exact name."""
        if self.tables.symbols is None:
            return dict(MISSING)
        order = ["file", "line", "kind", F.coalesce("signature", F.lit(""))]
        found = symbols.find_definition(self.tables.symbols, symbol_name).orderBy(*order)
        rows = self._rows(found.select("module_path", "file", "line", "kind", "signature"), "find_symbol_definition")
        modules = sorted({r["module_path"] for r in rows if r["module_path"]})
        return {
            "ok": True, "symbol": symbol_name, "definitions": rows, "definition_count": len(rows),
            "modules": modules, "module_count": len(modules),
        }

    def list_symbols_in_module(self, module_path: str, kind: str | None = None) -> dict:
        """List the symbols of a module."""
        by_module = self.tables.symbols if self.tables.module_symbols is None else self.tables.module_symbols
        if by_module is None:
            return dict(MISSING)
        found = symbols.symbols_in_module(by_module, module_path, kind)
        rows = self._rows(found.orderBy("file", "line", "name", "kind"), "list_symbols_in_module")
        return {
            "ok": True, "module_path": module_path, "filter": {"kind": kind}, "symbols": rows, "symbol_count": len(rows)}

    def find_symbol_references(self, symbol_name: str, scope: str | None = None) -> dict:
        """Find where a symbol is used."""
        if self.tables.references is None:
            return dict(MISSING)
        hits = self.tables.references.filter(F.col("name") == symbol_name)
        if scope is not None:
            hits = hits.filter(F.col("module_path") == scope)
        counts = self._rows(
            references.module_counts(hits).orderBy(F.col("refs").desc(), "module_path"), "find_symbol_references")
        samples = hits.orderBy("file", "line", "position").limit(settings.SAMPLE_REFS)
        if "context" not in samples.columns:
            samples = references.with_context(samples, self.tables.files.join(
                F.broadcast(samples.select("file").distinct()), "file", "left_semi"))
        shown = self._rows(
            samples.orderBy("file", "line", "position").select("module_path", "file", "line", "context"),
            "find_symbol_references", settings.SAMPLE_REFS)
        by_module = {r["module_path"]: r["refs"] for r in counts if r["module_path"]}
        return {
            "ok": True, "symbol": symbol_name, "scope": scope, "ref_count": sum(r["refs"] for r in counts),
            "module_count": len(by_module), "modules": sorted(by_module), "by_module": by_module, "sample_refs": shown,
        }

    def resolve_term(self, query: str, top_k: int = settings.DEFAULT_TOP_K) -> dict:
        """Find candidate modules and symbols for a term."""
        t = self.tables
        if t.records is None or (t.index is None and t.corpus is None):
            return dict(MISSING)
        tokens = retrieval.tokenize_query(self.spark, query)
        sparse = t.index.bm25(tokens) if t.index is not None else retrieval.bm25_topk(t.corpus, tokens)
        # Without vectors, or a function that embeds the question, BM25 decides alone.
        dense, mode = sparse.limit(0), "bm25"
        if self.embed is not None and t.vector_index is not None:
            dense, mode = t.vector_index.nearest(self.embed(query)), "hybrid"
        elif self.embed is not None and t.vectors is not None:
            dense, mode = retrieval.nearest(t.vectors, self.embed(query)), "hybrid"
        rows = self._rows(
            retrieval.quota_merge(retrieval.fuse(sparse, dense), t.records, top_k).orderBy("side", "position"),
            "resolve_term", 2 * top_k + 2)
        hits = retrieval.hit_counts(sparse, dense).head().asDict()
        pick = lambda side: [r for r in rows if r["side"] == side]
        modules = [{"module_path": r["key"], "score": r["score"]} for r in pick("module")]
        found = [{"name": r["key"], "file": r["file"], "kind": r["symbol_kind"], "score": r["score"]} for r in pick("symbol")]
        return {
            "ok": True, "query": query, "candidates": {"modules": modules, "symbols": found},
            "retrieval": hits | {"mode": mode, "module_candidates": len(modules), "symbol_candidates": len(found)},
        }
