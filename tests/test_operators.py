import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import patches, search, stores, symbols, vulnerabilities
from quarry.plans.engine import Engine
from quarry.sources import feeds, files, lockfiles
from quarry.streaming import watch


def test_fusion(spark):
    hits = spark.createDataFrame([("lexical", 1, "1", 10.0), ("lexical", 2, "2", 9.0), ("lexical", 3, "3", 8.0), ("semantic", 1, "2", 0.95), ("semantic", 2, "3", 0.8), ("semantic", 3, "1", 0.6), ("semantic", 4, "2", 0.1), ("semantic", 5, "", 0.05)], "backend string, position int, doc_id string, score double")
    got = search.reciprocal_rank_fusion(hits).orderBy(F.desc("score"), "doc_id").collect()
    assert [r.doc_id for r in got] == ["2", "1", "3"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and got[0].backend_scores == {"lexical": 9.0, "semantic": 0.95}


def test_vulnerability_join(spark):
    aff = "array<struct<ecosystem:string,name:string,introduced:string,fixed:string,last_affected:string>>"
    adv = spark.createDataFrame([("CVE-1", 4, 9.8, "t", "d", [("npm", "lodash", "", "4.17.21", "")], {"lodash": "4.17.21"}, []), ("CVE-2", 3, 8.1, "t", "d", [("npm", "express", "", "4.18.2", "")], {}, []), ("CVE-3", 0, 0.0, "t", "d", [("npm", "react", "", "", "")], {}, [])], f"id string, severity int, cvss double, title string, description string, affected {aff}, fixed_versions map<string,string>, fix_templates array<struct<package:string>>")
    deps = spark.createDataFrame([("lodash", "4.17.20", "npm", False), ("express", "4.18.2", "npm", False), ("react", "18.0.0", "npm", False), ("lodash", "1.0.0", "npm", True)], "name string, version string, ecosystem string, dev boolean")
    got = vulnerabilities.scan_dependencies(deps, adv).collect()
    assert [(r.id, r.severity, r.fixed_in, r.fixable) for r in got] == [("f-CVE-1-lodash", 4, "4.17.21", True)]


def test_lockfiles(spark):
    rows = [
        ("a/package-lock.json", json.dumps({"packages": {"": {"dependencies": {"x": "1"}}, "node_modules/x": {"version": "1.0.0", "integrity": "s"}, "node_modules/y": {"version": "2.0.0", "dev": True}}})),
        ("yarn.lock", '# c\n"@s/a@^1.0", "@s/a@^1.1":\n  version "1.2.3"\n  integrity sha\n'),
        ("pnpm-lock.yaml", "packages:\n\n  /p@1.0.0(q@2):\n    dev: true\n\nother:\n"),
        ("go.sum", "m v1.0.0 h1:a\nm v1.0.0/go.mod h1:b\n"),
        ("Cargo.lock", '[[package]]\nname = "c"\nversion = "0.1.0"\n'),
        ("requirements.txt", "# x\n-r other\na==1.0\nb>=2\n"),
        ("Gemfile.lock", "GEM\n  specs:\n    rails (7.0)\n      dep (1)\nPLATFORMS\n"),
        ("poetry.lock", '[[package]]\nname = "d"\nversion = "3"\ncategory = "dev"\n'),
        ("package-lock.json", "{"), ("main.go", "package x"), ("go.sum", None),
    ]
    got = {(r.name, r.version, r.ecosystem, r.direct, r.dev) for r in lockfiles.dependencies(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("x", "1.0.0", "npm", True, False), ("y", "2.0.0", "npm", False, True), ("@s/a", "1.2.3", "npm", False, False), ("p", "1.0.0", "npm", False, True), ("m", "v1.0.0", "go", False, False), ("c", "0.1.0", "cargo", False, False), ("a", "1.0", "pypi", False, False), ("b", ">=2", "pypi", False, False), ("rails", "7.0", "rubygems", False, False), ("d", "3", "pypi", False, True)}


def test_feeds(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),), ("nonsense",)], "value string")
    o = feeds.osv(one({"id": "O", "summary": "s", "modified": "2024-01-02T03:04:05Z", "database_specific": {"severity": "HIGH"}, "affected": [{"package": {"ecosystem": "PyPI", "name": "p"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "1"}, {"fixed": "2"}]}]}], "references": [{"url": "u"}]})).collect()
    assert len(o) == 1 and o[0].severity == 3 and o[0].affected[0].asDict() == {"ecosystem": "pypi", "name": "p", "introduced": "1", "fixed": "2", "last_affected": "", "range": ">=1, <2"} and o[0].fixed_versions == {"p": "2"} and o[0].references == ["u"]
    g = feeds.ghsa(one({"ghsaId": "G", "severity": "MODERATE", "cvss": {"score": 5.0}, "identifiers": [{"type": "GHSA", "value": "G"}, {"type": "CVE", "value": "C"}], "vulnerabilities": {"nodes": [{"package": {"ecosystem": "PIP", "name": "q"}, "vulnerableVersionRange": "< 2", "firstPatchedVersion": {"identifier": "2"}}]}})).collect()
    assert g[0].aliases == ["C"] and g[0].severity == 2 and g[0].affected[0].ecosystem == "pypi"
    n = feeds.nvd(one({"cve": {"id": "N", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "y"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.1}}]}, "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:prod:*", "versionEndExcluding": "3"}, {"vulnerable": False, "criteria": "cpe:2.3:a:v:no:*"}]}]}]}})).collect()
    assert n[0].severity == 4 and n[0].description == "y" and [(a.name, a.fixed) for a in n[0].affected] == [("prod", "3")]


SOURCES = {
    "a.py": ("class A:\n    def f(self): pass\ndef _g(): pass\nMAX = 1\n", {("A", "class"), ("f", "function"), ("_g", "function"), ("MAX", "constant")}),
    "a.go": ("package main\n\ntype S struct {\n\tName string\n}\ntype I interface {\n\tRun() error\n}\nfunc (s *S) Do() {}\nfunc main() { x := \"func no()\" }\nconst C = 1\nvar v int\n", {("main", "package"), ("S", "struct"), ("Name", "field"), ("I", "interface"), ("Run", "method"), ("Do", "method"), ("main", "function"), ("C", "constant"), ("v", "variable")}),
    "a.ts": ("export interface P { x: number }\nexport class K {\n  private n: number = 1;\n  constructor() {}\n  run(a: string): void { }\n}\nexport const f = (a: number) => a;\nconst z = 2;\ntype T = string;\nenum E { A }\n", {("P", "interface"), ("K", "class"), ("n", "field"), ("run", "method"), ("f", "function"), ("z", "constant"), ("T", "type"), ("E", "enum")}),
    "a.js": ("function g() { const hidden = 1; }\nmodule.exports = g;\nexports.h = 1;\n", {("g", "function"), ("h", "variable")}),
    "a.rs": ("pub struct S { pub a: u32, b: u8 }\nenum E { X, Y(u8) }\nimpl Foo for S { fn go(&self) {} }\npub trait T { fn t(&self); }\nmod m { fn hidden() {} }\npub fn top() {}\n", {("S", "struct"), ("a", "field"), ("b", "field"), ("E", "enum"), ("X", "enum_member"), ("Y", "enum_member"), ("go", "method"), ("T", "trait"), ("t", "method"), ("m", "module"), ("top", "function")}),
    "a.sql": ("-- create table no\nCREATE TABLE s.t (id int, name text, PRIMARY KEY (id));\ncreate view v as select 1;\n", {("t", "struct"), ("id", "field"), ("name", "field"), ("v", "type")}),
    "A.java": ("public class A {\n  private int go(int x) { return x; }\n}\n", {("A", "class"), ("go", "method")}),
    "x.txt": ("class A", set()),
}


@pytest.mark.parametrize("path", SOURCES)
def test_symbols(path):
    src, want = SOURCES[path]
    assert {(s["name"], s["kind"]) for s in symbols.extract(path, src)} == want


def test_symbol_table_and_graph(spark, tmp_path):
    df = spark.createDataFrame([(p, s) for p, (s, _) in SOURCES.items()] + [("n.py", None)], "path string, content string")
    found = symbols.extract_symbols(df)
    assert found.count() == sum(len(w) for _, w in SOURCES.values())
    # members of a trait are as visible as the trait
    assert {r.name for r in symbols.search(found, path_glob="*.rs", exported=True).collect()} == {"S", "a", "T", "t", "top"}
    assert symbols.search(found, path_glob="[").count() == 0
    stats = {r.label: r.n for r in symbols.graph_stats(symbols.index_graph(found)).collect()}
    assert stats["document"] == 7 and stats["metaData"] == stats["project"] == 1
    assert stats["range"] == stats["definitionResult"] == stats["textDocument/definition"] == stats["item"] == stats["contains"] - 7
    uses = spark.createDataFrame([("x.go", "S", 9, 3, "a.go", 3, 6), ("x.go", "S", 12, 1, "a.go", 3, 6)], "path string, name string, start_line int, start_column int, def_path string, def_line int, def_column int")
    graph = symbols.index_graph(found, uses)
    more = {r.label: r.n for r in symbols.graph_stats(graph).collect()}
    assert more["range"] == stats["range"] + 2 and more["referenceResult"] == more["textDocument/references"] == 1 and more["item"] == stats["item"] + 2
    symbols.write_graph(graph, str(tmp_path / "g"))
    ids = {json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "g" / "0-vertex")).collect()}
    edges = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "g" / "1-edge")).collect()]
    dangling = [e for e in edges if not {e["outV"], *e["inVs"]} <= ids]
    assert len(dangling) == 2 and all(e["label"] == "contains" for e in dangling)  # x.go isn't among the documents


def test_patches(spark):
    f = {"id": "f", "advisory_id": "A", "type": "dependency", "name": "lodash", "version": "1.0.0", "fixed_in": "1.0.1", "path": "package.json", "description": ""}
    p = patches.generate(f, '{\n  "lodash": "1.0.0",\n}\n')
    d = patches.format_diff(p.files[0])
    assert '-  "lodash": "1.0.0",' in d and '+  "lodash": "1.0.1",' in d and patches.parse_diff(d) == p.files[0]
    assert patches.generate({**f, "version": "9"}, '{\n  "lodash": "1.0.0"\n}') is None
    r = patches.generate({"id": "f", "advisory_id": "A", "path": "a.py", "fix_template": {"type": "api_migration", "pattern": "md5(", "replacement": "sha256("}}, "x\nmd5(\n")
    assert r.confidence == "medium" and r.files[0].hunks[0].old_start == 2
    with pytest.raises(ValueError):
        patches.parse_diff("+x")


def test_glob():
    assert stores.glob_to_regex("a/*.g?") == r"^a/[^/]*\.g[^/]$" and stores.glob_to_regex("[") is None


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "t").mkdir()
    schema = "path string, content string, change_type string, sequence bigint"
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    table = stores.Table(spark, str(tmp_path / "t"))

    def batch(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("path", "content", "change_type", "sequence"), r))) for r in rows))
        watch.watch(source, table, str(tmp_path / "cp")).awaitTermination()

    batch(1, [("a", "1", "added", 1), ("b", "1", "added", 2), ("a", "2", "modified", 3)])
    batch(2, [("b", "", "deleted", 4), ("c", "1", "added", 5)])
    assert sorted(map(tuple, table.read().collect())) == [("a", "2"), ("c", "1")]


def test_engine_and_scan(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    for name, body in (("main.go", b"package main\nconst token = 1\n"), ("module.py", b"token = 2\n"), ("b.bin", b"\0token"), ("vendor/x.go", b"token")):
        (tmp_path / name).write_bytes(body)
    docs = files.scan(spark, str(tmp_path)).withColumn("doc_id", F.col("path")).withColumn("repository_id", F.lit("r")).withColumn("branch", F.lit("main"))
    e = Engine(docs)
    assert [(r.language, r.line) for r in e.search("token").orderBy("language").collect()] == [("go", 2), ("python", 1)]
    assert [r.language for r in e.search("token", filter="language == 'go'").collect()] == ["go"]
    assert e.search("to", limit=10).count() == 2
    indexed = Engine(docs, postings=e.index())
    assert indexed.search("const tok").count() == 1 and indexed.search("absent").count() == 0
    assert [r.offset for r in e.request("token").collect()] == [19, 0]
