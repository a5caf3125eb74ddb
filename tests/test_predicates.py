"""Search modes, globs, file patterns and paging."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelode.functions import predicates as P

GLOBS = [
    ("src/api", "^src/api/"), ("src/api/", "^src/api/"), ("**/test/**", "(^|/)test/.*"), ("*.ts", r"[^/]*\.ts$"), ("src/**/*.test.ts", r"^src/.*[^/]*\.test\.ts$"), ("?", ".$"), ("**", "."), ("**/", "."),
    ("src/api.v2", r"^src/api\.v2/"), ("données/*.ts", r"^données/[^/]*\.ts$"),
]


@pytest.mark.parametrize(("glob", "regex"), GLOBS)
def test_globs(glob, regex):
    assert P.glob_to_regex(glob) == regex


@pytest.mark.parametrize("bad", ["", "  ", "../escape", "a/../b"])
def test_bad_globs(bad):
    with pytest.raises(P.BadRequest):
        P.glob_to_regex(bad)


@given(st.text("ab/*?.[{+$é", min_size=1, max_size=12))
def test_globs_always_compile(glob):
    try:
        re.compile(P.glob_to_regex(glob))
    except P.BadRequest:
        assert ".." in glob or not glob.strip()


@pytest.mark.parametrize(("text", "escaped"), [("100%", r"100\%"), ("foo_bar", r"foo\_bar"), ("a\\b", "a\\\\b"), ("%_\\", "\\%\\_\\\\")])
def test_escape_like(text, escaped):
    assert P.escape_like(text) == escaped


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.test.*", "a/b.test.ts", True), ("*.test.*", "a.test.d/b.ts", False), ("go.mod", "x/go.mod", True), ("**/__tests__/**", "a/__tests__/b.js", True), ("**/__tests__/**", "__tests__.js", False),
        ("**/tests/**/*.py", "tests/deep/er/x.py", True), ("**/tests/**/*.py", "tests/x.go", False), ("**/*Test*/**/*.cs", "src/MyTests/A.cs", True), ("**/src/test/**/*.java", "m/src/test/A.java", True), ("**/src/test/**/*.java", "src/a/test/A.java", False),
    ],
)
def test_file_patterns(pattern, path, hit):
    assert bool(re.search(P.file_pattern(pattern), path)) is hit


def test_path_filters():
    assert P.path_patterns(" a , b/** ,") == ["a", "b/**"]
    assert P.path_patterns(None) == []
    for bad in (",".join("abcdefghijk"), "/abs", "a..b", "x" * 501):
        with pytest.raises(P.BadRequest):
            P.path_patterns(bad)


def test_modes_and_pages():
    assert P.search_mode("") == P.search_mode(None) == "insensitive"
    with pytest.raises(P.BadRequest):
        P.search_mode("fuzzy")
    with pytest.raises(P.BadRequest):
        P.checked_regex("(")
    assert P.page(None, None, 20, 100) == (20, 0)
    assert P.page(0, -5, 20, 100) == (20, 0)
    assert P.page(1000, 7, 20, 100) == (100, 7)


def test_match_count(spark):
    df = spark.createDataFrame([("Hello hello HELLO world",), ("func a() func b()",), ("",)], "t string")
    count = lambda q, m: [r[0] for r in df.select(P.match_count(F.col("t"), q, m)).collect()]
    assert count("hello", "insensitive") == [3, 0, 0]
    assert count("hello", "sensitive") == [1, 0, 0]
    assert count(r"func \w+\(\)", "regex") == [0, 2, 0]
    assert count("(", "regex") == [0, 0, 0]


def test_wildcards_act_in_names_only(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a\\b",)], "t string")
    names = lambda c: [r[0] for r in df.where(c).collect()]
    assert names(P.text_matches(F.col("t"), "A_b", literal=False)) == ["a_b", "axb", "a\\b"]
    assert names(P.text_matches(F.col("t"), "A_b")) == ["a_b"]
    assert names(P.text_matches(F.col("t"), "a\\b", literal=False)) == ["a\\b"]
