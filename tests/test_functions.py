"""Column functions against small specifications in plain Python, over random strings."""

import json
import random
import re

from pyspark.sql import functions as F

from treeline.functions import comments, jsonsize, paths, text, tokens


def strings(alphabet, n, longest, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_lines_follow_splitlines(evaluate):
    values = strings(["a", "b", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", " "], 3000, 8)
    assert evaluate(values, text.split_lines) == [v.splitlines() for v in values]


def test_newline_variant_ignores_other_breaks(evaluate):
    values = ["a\x0cb\nc", "a\r\nb\rc\n", "", "\n"]
    assert evaluate(values, lambda c: text.split_lines(c, text.RETURN_ONLY)) == [
        ["a\x0cb", "c"], ["a", "b", "c"], [], [""]]


def test_strip_and_blank_removal(evaluate):
    values = strings([" ", "\t", "　", "\xa0", "\x1f", "x", "y"], 500, 8)
    assert evaluate(values, text.strip) == [v.strip() for v in values]
    assert evaluate(values, text.without_blanks) == ["".join(v.split()) for v in values]


def test_count_of_matches_python(evaluate):
    values = strings("ab", 500, 10)
    for needle in ("a", "aa", "aba", ""):
        assert evaluate(values, lambda c, n=None: text.count_of(c, needle)) == [v.count(needle) for v in values]


#: Hand-made inputs and the tokens expected of them.
MIXED = {
    "": [], " 12 .": [], "x": ["x"], "one.two": ["one", "two"], "fooBar_baz": ["foo", "bar", "baz"],
    "MAX_SIZE": ["max", "size"], "getURL": ["get", "url"], "HTTPServer": ["http", "server"], "user2": ["user"],
    "ABC1": ["ab"], "A1": ["a1"], "A1B": ["b"], "12A3": ["a3"], "x_12A3": ["x", "12a3"], "_9ab": ["ab"],
    "éa": ["a"], "a__b": ["a", "b"], "aB aB": ["a", "b", "a", "b"], "_": [], "ABab": ["a", "bab"],
}


def test_mixed_tokens(evaluate):
    assert dict(zip(MIXED, evaluate(list(MIXED), tokens.mixed_tokens))) == MIXED


def test_cjk_runs_become_pairs_after_latin(evaluate):
    assert evaluate(["活动 rank 中心表", "中", "abc"], tokens.mixed_tokens) == [
        ["rank", "活动", "中心", "心表"], ["中"], ["abc"]]
    assert evaluate(["中 活动x心"], tokens.cjk_fragments) == [["活动"]]


NAMES = {
    "": "", "__": "", "oak_guild_feed": "oak guild feed", "HTTPServer2.h": "http server 2 h", "RankMgr": "rank mgr",
    "中心": "中心", "a-b/a.b": "a b", "ABC": "abc", "ABCd": "ab cd", "~Foo": "foo", "~": "~", "x1y22": "x 1 y 22",
    "parts/rank_serv/src": "parts rank serv src", "a_A": "a", "Zz9.Zz9": "zz 9",
}


def test_name_tokens(evaluate):
    assert dict(zip(NAMES, evaluate(list(NAMES), tokens.name_tokens))) == NAMES


def comment_spec(value):
    """(offset is comment) flags by walking over the characters."""
    flags, i, mode = [False] * len(value), 0, None
    while i < len(value):
        two = value[i:i + 2]
        if mode is None and two == "//":
            mode = "line"
        elif mode is None and two == "/*":
            mode = "block"
            flags[i] = flags[i + 1] = True
            i += 2
            continue
        if mode == "line" and value[i] == "\n":
            mode = None
        elif mode == "block" and two == "*/":
            flags[i] = flags[i + 1] = True
            mode, i = None, i + 2
            continue
        flags[i] = mode is not None
        i += 1
    return flags


def include_spec(value):
    flags, out, start = comment_spec(value), [], 0
    for number, line in enumerate(value.split("\n"), 1):
        for m in re.finditer(r'#[ \t]*include[ \t]*(?:<([^>\n]+)>|"([^"\n]+)")', line):
            out.append((number, m.group(0), m.group(1) or m.group(2), flags[start + m.start()]))
        start += len(line) + 1
    return out


def test_includes_know_their_comments(evaluate):
    pieces = ["//", "/*", "*/", "\n", "#include <a.h>", '# include "b/c.h"', '#include "a/*b.h"', " x ", "/", "*", '"']
    values = strings(pieces, 6000, 8) + ['"http://x" #include <y.h>', "/*/ #include <z.h>", ""]
    got = evaluate(values, comments.includes_of)
    assert [[tuple(h) for h in row] for row in got] == [include_spec(v) for v in values]


def test_comment_fragments_per_line(evaluate):
    value = "int a; // 活动 中心\n/* 排行\n榜单 */ x // '引号' 不要\nf(\"中文\");"
    assert evaluate([value], lambda c: comments.line_fragments(c, tokens.cjk_fragments)) == [
        [["活动", "中心"], ["排行"], ["榜单"], []]]
    python = "x = 1  # 注释\n# \"中文\"\n"
    assert evaluate([python], lambda c: comments.line_fragments(c, tokens.cjk_fragments, comments.HASH_COMMENT)) == [
        [["注释"], []]]


def test_json_size(evaluate):
    values = strings(['"', "\\", "\n", "\t", "\x01", "é", "中", "a", "/"], 2000, 10)
    assert evaluate(values, jsonsize.string_size) == [len(json.dumps(v, ensure_ascii=False)) for v in values]
    expected = [len(json.dumps({"a": v, "n": 12}, ensure_ascii=False)) for v in values]
    assert evaluate(values, lambda c: jsonsize.object_size(
        {"a": jsonsize.string_size(c), "n": jsonsize.number_size(F.lit(12))})) == expected


def test_paths(evaluate):
    assert evaluate(["a/b/c.h", "x\\y.hpp", "d/", "", "plain"], paths.base_name) == ["c.h", "y.hpp", "d", "", "plain"]
    assert evaluate(["a/b.CPP", "a.b/c", ".hidden", "x.tar.gz"], paths.suffix) == [".cpp", "", "", ".gz"]
    assert evaluate(["a/b/c"], paths.ancestors) == [["a", "a/b", "a/b/c"]]
    assert evaluate(["a", "a/b"], lambda c: paths.ancestors(c, include_self=False)) == [[], ["a"]]
    safe = ["a/b", "a/../b", "../b", "a/../../b", "/etc", "", "  ", ".", "a\\..\\..\\x"]
    assert evaluate(safe, paths.is_safe) == [True, True, False, False, False, False, False, True, False]
    assert [paths.is_safe_path(p) for p in safe] == [True, True, False, False, False, False, False, True, False]


def test_globs(evaluate):
    values = ["main.cpp", "src/main.cpp", "src/a/main.cpp", "src/xmain.cpp", "src/main.cpp/x", "mainXcpp"]
    assert evaluate(values, lambda c: paths.matches_glob(c, "**/main.cpp")) == [True, True, True, False, False, False]
    assert evaluate(["a/b.h", "b.h", "a/c/b.h"], lambda c: paths.matches_glob(c, "*/?.h")) == [True, False, False]
    assert evaluate(["x/rank_conf.h", "_conf.h", "rank_conf.hpp", "Rank_CONF.h"],
                    lambda c: paths.matches_name(c, "*_conf.h")) == [True, True, False, False]
