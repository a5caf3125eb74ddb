"""Parsing: invariants over samples of many languages, single cases, and independence of partitioning."""

import pytest

from codelode.parse import chunks, imports
from codelode.parse.engine import explode, merge_by_line, parse, parse_file
from codelode.parse.languages import LANGUAGES, detect
from codelode.parse.source import Source

SAMPLES = {
    "src/App.tsx": "import React, { useState } from 'react';\nimport './app.css';\n\n/** Greets. */\nexport default function App({ name }: Props) {\n  const [n, setN] = useState(0);\n  const load = async () => {\n    await fetch(`/api/${n}`, { method: 'POST' });\n  };\n  return <div><Button onClick={load}>{name}</Button><></></div>;\n}\n\nexport const useThing = () => useState(1);\nexport type Props = { name: string };\nexport * from './other';\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"net/http"\n)\n\n// Server serves.\ntype Server struct {\n\tport int\n}\n\n// Run runs.\nfunc (s *Server) Run() error {\n\tresp, err := http.Get("http://x/y")\n\tfmt.Println(resp)\n\treturn err\n}\n\nfunc helper() {}\n',
    "pkg/mod.py": '"""Doc."""\nimport os\nfrom .util import go\n\nLIMIT = 3\n\n\nclass A(Base):\n    """Class doc."""\n\n    def run(self):\n        return go(os.path.join("a"))\n\n\nasync def _hidden():\n    yield 1\n',
    "src/lib.rs": "use crate::model::User;\nuse std::fmt;\nmod error;\n\n/// A thing.\npub struct Thing { a: u8 }\n\nimpl Thing {\n    pub fn new() -> Self { Thing { a: 1 } }\n    fn hidden(&self) {}\n}\n",
    "a/B.java": "package a;\n\nimport java.util.List;\nimport com.acme.User;\n\npublic class B extends Base implements Runnable {\n    private int x = 1;\n\n    public void run() {\n        restTemplate.getForObject(\"http://h\", String.class);\n    }\n}\n",
    "x.rb": "require 'json'\nrequire_relative 'lib/a'\n\nclass Foo\n  def open_it\n    bar\n  end\n\n  private\n\n  def hidden\n  end\nend\n",
    "x.sql": "-- tables\nCREATE TABLE users (id INT);\nCREATE VIEW v AS SELECT 1;\n",
    "deploy.sh": "source ./env.sh\n\nNAME=x\n\nrun() {\n  echo hi\n}\n",
    "conf.yaml": "a: 1\nb:\n  c: 2\n",
    "x.c": '#include <stdio.h>\n#include "mine.h"\n\nstatic int hidden(int a) {\n  return a;\n}\n\nint shown(void) {\n  return hidden(1);\n}\n',
}


@pytest.mark.parametrize("path", sorted(SAMPLES))
def test_invariants(path):
    r = parse_file(path, SAMPLES[path])
    ids, n = {s["symbol_id"] for s in r["symbols"]}, r["line_count"]
    assert all(s["status"] == "OK" for s in r["extractor_statuses"]) and r["language"] == detect(path)
    for table, keys in {"exports": ["symbol_id"], "chunks": ["symbol_id"], "references": ["source_symbol_id", "resolved_target_symbol_id"], "jsx_usages": ["source_symbol_id", "resolved_target_symbol_id"], "network_calls": ["source_symbol_id"], "symbols": ["parent_symbol_id"]}.items():
        assert all(row[k] in ids | {""} for row in r[table] for k in keys)
    assert all(1 <= s["start_line"] <= s["end_line"] <= n for s in [*r["symbols"], *r["chunks"]])
    assert all(c["start_line"] == 1 for c in r["chunks"] if c["chunk_type"] == "module_context")
    tier = LANGUAGES[r["language"]].tier
    if tier > 1:
        assert not r["exports"] and not r["references"] and not r["network_calls"]
    assert parse_file(path, SAMPLES[path]) == r


def test_tsx():
    r = parse_file("src/App.tsx", SAMPLES["src/App.tsx"])
    assert {(s["name"], s["kind"]) for s in r["symbols"]} >= {("App", "function"), ("useThing", "function"), ("Props", "type_alias")}
    app = next(s for s in r["symbols"] if s["name"] == "App")
    assert app["flags"]["is_default_export"] and app["flags"]["is_react_component_like"] and "Greets" in app["doc_text"] and (app["start_line"], app["end_line"]) == (5, 11)
    assert [(e["export_kind"], e["exported_name"]) for e in r["exports"]] == [("DEFAULT", "default"), ("NAMED", "useThing"), ("TYPE_ONLY", "Props"), ("EXPORT_ALL", "*")]
    assert [(u["component_name"], u["is_intrinsic"], u["is_fragment"]) for u in r["jsx_usages"]] == [("div", True, False), ("Button", False, False), ("Fragment", False, True)]
    assert [(c["client_kind"], c["method"], c["url_template"], c["is_relative"]) for c in r["network_calls"]] == [("FETCH", "POST", "/api/{*}", True)]
    assert {"HOOK_USE", "FETCH", "JSX_RENDER"} <= {x["reference_kind"] for x in r["references"]}
    assert r["facts"] == {"has_jsx": True, "has_default_export": True, "has_named_exports": True, "has_top_level_side_effects": True, "has_react_hook_calls": True, "has_fetch_calls": True, "has_class_declarations": False, "has_tests": False, "has_config_patterns": False, "jsx_runtime": "react"}
    assert [c["semantic_role"] for c in r["chunks"] if c["chunk_type"] == "function"] == ["ui_component", "hook"]


def test_other_languages():
    names = lambda p: {(s["qualified_name"], s["kind"]) for s in parse_file(p, SAMPLES[p])["symbols"]}
    assert names("cmd/main.go") == {("Server", "class"), ("Server.Run", "method"), ("helper", "function")}
    assert names("pkg/mod.py") == {("LIMIT", "variable"), ("A", "class"), ("A.run", "method"), ("_hidden", "function")}
    assert {("B", "class"), ("B.run", "method"), ("B.x", "variable")} <= names("a/B.java")
    assert names("x.sql") == {("users", "class"), ("v", "variable")}
    exports = lambda p: {e["exported_name"] for e in parse_file(p, SAMPLES[p])["exports"]}
    assert exports("cmd/main.go") == {"Server", "Run"} and exports("pkg/mod.py") == {"LIMIT", "A"} and "hidden" not in exports("x.rb") and exports("x.c") == {"shown"}
    kinds = {i["import_name"]: (i["import_type"], i["target_file_path"]) for p in SAMPLES for i in parse_file(p, SAMPLES[p])["imports"]}
    assert kinds["fmt"] == ("STDLIB", "") and kinds[".util"] == ("INTERNAL", "pkg/util") and kinds["crate::model::User"] == ("INTERNAL", "src/model/User") and kinds["error"] == ("INTERNAL", "src/error")
    assert kinds["mine.h"] == ("INTERNAL", "mine.h") and kinds["com.acme.User"] == ("EXTERNAL", "") and kinds["java.util.List"] == ("STDLIB", "") and kinds["./env.sh"] == ("INTERNAL", "env.sh")


def test_edges():
    assert parse_file("a.py", "")["line_count"] == 0 and parse_file("a.py", None)["issues"] == []
    assert parse_file("a.xyz", "data")["issues"][0]["code"] == "UNSUPPORTED_LANGUAGE"
    assert parse_file("a.py", "x = 1\r\ny = 2\r")["line_count"] == 2
    assert [s["name"] for s in parse_file("a.ts", "\ufeffclass A {}\n")["symbols"]] == ["A"]
    broken = parse_file("a.ts", "function (((\n  {{{ ]\n")
    assert {i["code"] for i in broken["issues"]} >= {"PARSE_ERROR", "NO_EXPORTS"}
    assert any(i["code"] == "LONG_FILE" for i in parse_file("a.go", "\n" * 1001)["issues"])
    deep = "export " + "function f() {" + "if (a) {" * 9 + "}" * 10
    assert parse_file("a.js", deep.replace("{", "{\n"))["issues"][0]["code"] == "DEEP_NESTING"
    assert len(parse_file("m.js", "}\n" * 200)["issues"]) == 50
    assert [i["message"] for i in merge_by_line([{"line": 1, "column": 1, "message": "a"}, {"line": 1, "column": 3, "message": "b"}, {"line": 2, "column": 1, "message": "c"}])] == ["Multiple parse errors on line 1", "c"]


def test_relative_targets():
    f = imports.relative_target
    assert f("../a", "src/x/y.ts", "typescript") == "src/a" and f("..models", "a/b/c.py", "python") == "a/models" and f(".", "a/c.py", "python") == "a"
    assert f("super::x::y", "src/h/auth.rs", "rust") == "src/h/x/y" and f("self::z", "src/h/mod.rs", "rust") == "src/h/z" and f("react", "a.ts", "typescript") == ""


def test_pieces():
    text = "é" * 4000 + "\n" + "line\n" * 3000 + "end"
    parts = chunks.pieces(text)
    assert "".join(p for p, _, _ in parts) == text and all(len(p.encode()) <= 7500 for p, _, _ in parts)
    assert parts[-1][2] == text.count("\n") + 2  # a line cut within counts once a piece
    big = [chunks.chunk("p", "function", text, 10, 3010)]
    cut = chunks.split_oversized(big)
    assert len(cut) == len(parts) and cut[0]["start_line"] == 10 and "".join(c["content"] for c in cut) == text and all(not c["chunk_id"] for c in cut)
    assert chunks.raw_chunks("p", "a\nb", 2)[0]["end_line"] == 2


def test_test_blocks_and_config():
    body = "import x\n\ndescribe('a', () => {\n  it('b', () => {});\n});\n"
    rows = parse_file("a.test.ts", body)["chunks"]
    assert [(c["chunk_type"], c["start_line"], c["end_line"]) for c in rows] == [("test", 3, 3), ("test", 4, 5)]
    assert [c["chunk_type"] for c in parse_file("x/setup.py", "a = 1\n")["chunks"]] == ["config"]
    assert [c["chunk_type"] for c in parse_file("a_test.go", "package a\n")["chunks"]] == ["test"]
    big = "class A:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(120))
    summary = next(c for c in parse_file("a.py", big)["chunks"] if c["chunk_type"] == "class")
    assert summary["content"].count("\n") == 121 and summary["content"].startswith("class A:\n  def m0(self):")


def test_source_blanks_comments_and_strings():
    s = Source("a = 'x{' # }\nb", "python")
    assert "{" not in s.code and "}" not in s.code and len(s.code) == len(s.text) and (s.line(13), s.column(13)) == (2, 1)


def test_parse_is_the_same_under_any_partitioning(spark):
    files = spark.createDataFrame(list(SAMPLES.items()), "file_path string, content string")
    tables = ("symbols", "imports", "references", "chunks")
    got = [{t: sorted(map(str, explode(parse(files.repartition(k)), t).collect())) for t in tables} for k in (1, 4)]
    assert got[0] == got[1] and all(got[0].values())


def test_extract_gives_what_parse_gives_and_runs_no_more(spark, monkeypatch):
    from codelode.parse import engine

    code = "import os\nimport requests\n\n\ndef f(a):\n    return requests.get('/x')\n\n\nclass C:\n    def m(self):\n        return f(self)\n"
    files = spark.createDataFrame([("a.py", code), ("b.ts", "import React from 'react'\nexport function g() { return fetch('/y') }\n"), ("c.tsx", "export const A = () => <B x={1} />\n"), ("d.md", "# t\n\ntext\n"), ("e.zzz", "?"), ("f.py", None)], "file_path string, content string")
    parsed = engine.parse(files).persist()
    for table in engine.MADE_FROM:
        assert sorted(map(str, engine.extract(files, table).collect())) == sorted(map(str, engine.explode(parsed, table).collect()))
    parsed.unpersist()
    for name in ("chunks", "imports"):
        monkeypatch.setattr(getattr(engine, name), "extract", lambda *a: 1 / 0)
    monkeypatch.setattr(engine, "diagnostics", lambda *a: 1 / 0)
    r = engine.parse_file("a.py", code, None, frozenset(("network_calls", "symbols")))
    assert len(r["network_calls"]) == 1 and len(r["symbols"]) == 3 and not r["issues"]
