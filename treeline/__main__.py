"""Command line: build tables from a repository and look things up in them."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from treeline import build, settings
from treeline.operators import catalog, corpus, includes, references, symbols
from treeline.session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("build", help="write all tables of a repository")
    make.add_argument("root")
    make.add_argument("--tags", required=True, help="JSON-lines file of a tag generator")
    make.add_argument("-o", "--output", required=True)
    for name in ("stats", "header", "symbol", "references"):
        look = commands.add_parser(name)
        look.add_argument("tables")
        if name != "stats":
            look.add_argument("key")
    options = parser.parse_args(argv)
    spark = build_session()
    if options.command == "build":
        build.build_tables(spark, options.root, options.tags, options.output)
        return 0
    tables = build.load_tables(spark, options.tables)
    return COMMANDS[options.command](tables, getattr(options, "key", None))


def _show(df) -> int:
    """Print every row as a JSON line, a partition at a time; 1 when there is none."""
    code = 1
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        code = 0
    return code


def _stats(tables, _) -> int:
    _show(catalog.plain_modules(tables.cards))
    _show(includes.header_ranking(tables.includes))
    _show(symbols.kind_distribution(tables.symbols))
    _show(references.top_referenced(tables.references))
    return _show(corpus.corpus_stats(tables.corpus))


def _header(tables, key) -> int:
    graph = includes.include_graph(tables.includes, key)
    return _show(graph.orderBy("facet", F.col("refs").desc(), "key"))


def _symbol(tables, key) -> int:
    return _show(symbols.find_definition(tables.symbols, key).orderBy("file", "line"))


def _references(tables, key) -> int:
    """Counts per module, the modules unknown last, then the first references."""
    hits = tables.references.filter(F.col("name") == key)
    counts = references.module_counts(hits).orderBy(
        F.col("module_path").isNull(), F.col("refs").desc(), "module_path")
    found = _show(counts)
    _show(hits.orderBy("file", "line", "position").limit(settings.TOP_NAMES))
    return found


COMMANDS = {"stats": _stats, "header": _header, "symbol": _symbol, "references": _references}

if __name__ == "__main__":
    sys.exit(main())
