import http.server
import io
import json
import subprocess
import tarfile
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import embedding, fuzzy, git, regex, text
from quarry.operators import inventory, mapping, search, stores, symbols, vulnerabilities
from quarry.plans import catalogue
from quarry.plans.engine import Engine, Store
from quarry.sources import files, remote
from quarry.streaming import watch


def test_content_patterns_run_over_line_ends_and_are_quoted(spark):
    docs = spark.createDataFrame([("a.js", "one\neval(\n  x)\nlast"), ("b.txt", "a\\Eb\nfoo\nbar $1"), ("c", None), ("d", "clean")], "path string, content string")
    adv = [{"id": "A", "severity": 3, "patterns": [{"type": "regex", "query": r"eval\(\s*x"}, {"type": "trigram", "query": "foo\nbar"}, {"type": "regex", "query": "[[:word:]]+ast$"}], "iocs": [{"value": "\\E"}, {"value": "$1"}]}]
    got = {(r.path, r.type, r.line, r.snippet) for r in vulnerabilities.scan_content(docs, adv).collect()}
    assert got == {("a.js", "pattern", 2, "one\neval(\n  x)\nlast"), ("a.js", "pattern", 4, "eval(\n  x)\nlast"), ("b.txt", "pattern", 2, "a\\Eb\nfoo\nbar $1"), ("b.txt", "ioc", 1, "a\\Eb\nfoo\nbar $1"), ("b.txt", "ioc", 3, "a\\Eb\nfoo\nbar $1")}


@pytest.mark.parametrize("order", [1, -1])
def test_project_reports_the_first_version_of_a_package(spark, order):
    """Of several versions of a package in one file the first as text is kept, however lines and files are ordered."""
    held = ["2.10.0", "1.9.0", "2.9.0", "0.1.0", "1.10.0"][::order]
    rows = [(f"p{i}/requirements.txt", "\n".join(f"a=={v}" for v in held[i:] + held[:i])) for i in range(5)] + [("p/src.txt", "x\nbad\nbad")]
    adv = spark.createDataFrame([("A", 3, 5.0, "t", "d", [("pypi", "a", "1.0.0", "2.0.0", ""), ("pypi", "a", "2.0.0", "", "")], {"a": "9.0.0"}, [])], "id string, severity int, cvss double, title string, description string, affected array<struct<ecosystem:string,name:string,introduced:string,fixed:string,last_affected:string>>, fixed_versions map<string,string>, fix_templates array<struct<package:string>>")
    found = vulnerabilities.scan_project(spark.createDataFrame(rows[::order], "path string, content string"), adv, [{"id": "A", "severity": 3, "patterns": [{"type": "trigram", "query": "bad"}]}])
    got = {(r.path, r.package, r.version, r.fixed_in, r.line) for r in found.collect()}
    assert got == {(f"p{i}/requirements.txt", "a", "1.10.0", "2.0.0", 0) for i in range(5)} | {("p/src.txt", "", "", "", 2)}


def test_many_patterns_are_found_as_few_are(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "\n".join("".join(rng.choice(list("abc \\E"), rng.integers(0, 9))) for _ in range(6))) for i in range(60)] + [(99, None), (98, "")], "path int, content string")
    adv = [{"id": f"A{k}", "severity": 1 + k % 3, "patterns": [{"type": "trigram", "query": q}, {"type": "regex", "query": r}], "iocs": [{"value": v}]} for k, (q, r, v) in enumerate([("aa", "b+\\n", "c"), ("ab", "[[:alpha:]]c", "\\E"), ("a\nb", "^a|c$", "aa")])]
    few = sorted(map(tuple, vulnerabilities.scan_content(docs, adv).collect()))
    monkeypatch.setattr(vulnerabilities, "MANY", 2)
    assert few == sorted(map(tuple, vulnerabilities.scan_content(docs, adv).collect())) and len(few) > 50


def test_word_class():
    assert regex.to_java("[[:word:]-]+") == r"(?d)[\w-]+" and regex.plan("[[:word:]]abc").trigrams == (b"abc",)
    with pytest.raises(ValueError):
        regex.plan("[[:nope:]]")


def test_fuzzy_batches_equal_single_texts():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abAB_/ .1é"), rng.integers(0, 30))) for _ in range(300)]
    for p in ("a", "ab", "bA1", "é_a"):
        one = [fuzzy.match(t, p) for t in texts]
        assert fuzzy.match_many(texts, p, cells=60) == one == fuzzy.match_many(texts, p)
        assert all(bool(m) == bool(fuzzy.match_greedy(t, p)) for t, m in zip(texts, one))


def test_fuzzy_scores():
    """Exact scores: 16 a match, bonus of the place (twice for the first character), -3 and -1 for gaps."""
    assert fuzzy.match("abc", "abc").score == 16 * 3 + 10 * 2 + 10 + 10
    assert fuzzy.match("a/b", "ab").score == 16 + 20 - 3 + 16 + 9
    assert fuzzy.match("xxab", "ab").score == 16 + 16 + 4
    assert fuzzy.match("fooBar", "fb").score == 16 + 20 - 3 - 1 + 16 + 7
    assert fuzzy.match("axxxb", "ab").score == 16 + 20 - 3 - 1 - 1 + 16
    assert fuzzy.match("zb_b", "b").positions == [3]


def test_ranks_in_two_levels(spark):
    rng = np.random.default_rng(2)
    rows = [(b, int(i), float(rng.integers(0, 50))) for b in ("x", "y") for i in range(400)]
    hits = spark.createDataFrame(rows, "backend string, doc_id int, score double")
    got = {(r.backend, r.doc_id): r.position for r in search.positions(hits, buckets=7).collect()}
    for b in ("x", "y"):
        want = sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1]))
        assert [got[b, r[1]] for r in want] == list(range(1, 401))
    again = spark.createDataFrame([("x", k + 1, str(k % 30 if k % 7 else ""), 1.0) for k in range(100)], "backend string, position int, doc_id string, score double")
    ranked = sorted((r.position, r.rank) for r in search._first_per_document(again, bucket=8).collect())
    assert [r for _, r in ranked] == list(range(1, len(ranked) + 1)) and len(ranked) == 30 + 15 - 1 + (15 > 0) - 1 + 1 - sum(k % 7 == 0 and all(j % 7 == 0 for j in range(k % 30, 100, 30)) for k in range(30))


def test_line_counts(spark):
    texts = ["", "\n", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "\n\n", None, "\r"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(a == max(b, 0) for a, b in df.select(text.line_count(F.col("t")), F.size(text.source_lines(F.col("t")))).collect())


def test_search_matches_score_and_fallback(spark):
    docs = spark.createDataFrame([("1", "a.go", "go", "r", "main", "x\né token token\n"), ("2", "b/token.py", "python", "r", "main", "Token"), ("3", "c", "", "r", "main", "none")], "doc_id string, path string, language string, repository_id string, branch string, content string")
    for e in (Engine(docs), Engine(docs, postings=Engine(docs).index())):
        r = e.search("tok[e]n").collect()
        assert [(x.doc_id, x.line, x.score, [(m.start, m.end) for m in x.matches]) for x in r] == [("1", 2, 1.0, [(3, 8), (9, 14)])]
        assert [(x.doc_id, x.snippet, [(m.start, m.end) for m in x.matches]) for x in e.search("TOKEN").collect()] == [("1", "é token token", [(3, 8)]), ("2", "Token", [(0, 5)])]
        assert e.search("absent").count() == 0


def test_fallback_query_whatever_the_case_of_the_texts(spark, tmp_path):
    """The word stands in lower, upper and mixed case; the query lists all three, as its SQL does."""
    rows = [(1, "a\nx tionth", "en", "s", 10), (2, "é TIONTH", "en", "s", 8), (3, "none", "de", "s", 4), (4, "\n\nTionTH tionth", None, None, 15)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f'SELECT doc_id, line, "start" FROM ({catalogue.oracle_sql()["engine_fallback"]})').fetchall()
    got = [tuple(r) for r in catalogue.queries()["engine_fallback"](spark, str(tmp_path)).select("doc_id", "line", "start").collect()]
    assert sorted(got) == sorted(want) == [(1, 2, 2), (2, 1, 3), (4, 3, 0)]


def test_store_keeps_and_reindexes_everything(spark, tmp_path):
    schema = "doc_id string, path string, language string, repository_id string, branch string, content string, created_at int"
    row = lambda i, body, at: (i, f"{i}.py", "python", "r", "main", body, at)
    s = Store(spark, str(tmp_path), text.embed_text, buckets=4)
    s.index(spark.createDataFrame([row("a", "def old(): pass", 1), row("b", "def both(): pass", 1), row("c", "def gone(): pass", 1)], schema), created="created_at")
    s.index(spark.createDataFrame([row("a", "def fresh(): pass", 2), row("d", "nothing", 2)], schema), created="created_at")
    s.remove(spark.createDataFrame([("c",)], "doc_id string"))
    e = Store(spark, str(tmp_path), text.embed_text, buckets=4).engine()
    assert {(r.doc_id, r.created_at) for r in e.docs.collect()} == {("a", 1), ("b", 1), ("d", 2)}
    assert {r.name for r in e.symbols().collect()} == {"fresh", "both"}
    assert {r.doc_id for r in e.embeddings.collect()} == {"a", "b", "d"} and e.embeddings.count() == 3
    assert e.postings.count() == e.postings.distinct().count() == sum(len(regex.trigrams(x.encode())) for x in ("def fresh(): pass", "def both(): pass", "nothing"))
    assert [r.doc_id for r in e.search("fresh", mode="lexical").collect()] == ["a"] and e.search("old\\(", mode="lexical").count() == 0
    got = e.symbol_search("fre", spark.createDataFrame([("a.py", "fresh"), ("a.py", "fresh")], "path string, name string")).collect()
    assert [(r.name, r.rank, r.refs, r.snippet) for r in got] == [("fresh", 1, 2, "def fresh(): pass")]


def test_table_rewrites_touched_buckets_only(spark, tmp_path):
    t = stores.Table(spark, str(tmp_path / "t"), "k", buckets=8)
    assert t.read() is None
    t.put(spark.createDataFrame([(i, 0) for i in range(100)], "k int, v int"))
    before = t.state()["parts"]
    t.put(spark.createDataFrame([(3, 1), (1000, 1)], "k int, v int"))
    after = t.state()["parts"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    assert {(r.k, r.v) for r in t.read().collect()} == {(i, int(i == 3)) for i in range(100)} | {(1000, 1)}
    with pytest.raises(ValueError):
        t.put(spark.createDataFrame([(3, 1)], "k int, v int"), "v")
    t.remove(t.read().select("k"))
    assert t.read().count() == 0 and t.read().columns == ["k", "v"] and t.vacuum() >= 1


def test_a_change_writes_no_row_that_stays(spark, tmp_path):
    """Keys of every bucket change and go: what is written is the changed rows and the keys, not the buckets; nor are rows of a key worked out twice."""
    t = stores.Table(spark, str(tmp_path / "t"), "k", buckets=2)
    t.put(spark.range(1000).selectExpr("id k", "'old' v"))
    first = set((tmp_path / "t").iterdir())
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    t.put_all_of(spark.range(0, 1000, 10).selectExpr("id k", "'new' v").mapInArrow(count, "k bigint, v string"), spark.range(0, 1000, 10).selectExpr("id k"))
    t.remove(spark.range(5, 1000, 10).selectExpr("id k"))
    new = [spark.read.parquet(str(f)) for f in set((tmp_path / "t").iterdir()) - first if f.name.startswith("v-")]
    assert sum(x.count() for x in new) == 300 and sum(x.count() for x in new if "v" in x.columns) == 100 and calls.value == 100
    assert {(r.k, r.v) for r in t.read().collect()} == {(k, "old" if k % 10 else "new") for k in range(1000) if k % 10 != 5}


def test_layers_hold_what_a_plain_table_holds(spark, tmp_path, monkeypatch):
    """Random changes beyond the number of layers, with keys held in memory or joined, from a pointer of one folder a bucket on."""
    monkeypatch.setattr(stores.Table, "LAYERS", 3)
    rng = np.random.default_rng(11)
    t = stores.Table(spark, str(tmp_path / "t"), "k", buckets=2)
    schema = "k int, v int, made int, seen int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    want = {k: (0, 0, 0) for k in range(60)}
    t.put(frame([(k, *v) for k, v in want.items()]))
    pointer = json.loads((tmp_path / "t" / "CURRENT").read_text())
    old = pointer | {"parts": {b: p[0]["rows"] for b, p in pointer["parts"].items()}}
    (tmp_path / "t" / "CURRENT").write_text(json.dumps(old))
    (tmp_path / "t" / ".CURRENT.crc").unlink(missing_ok=True)
    deepest = 0
    for n in range(1, 8):
        monkeypatch.setattr(stores.Table, "HELD", 0 if n % 2 else 1 << 20)
        keys, gone = (rng.choice(80, m, replace=False).tolist() for m in (6, 3))
        rows = {k: (n, n, int(rng.integers(0, 8))) for k in keys}
        t.put(frame([(k, *v) for k, v in rows.items()]), created="made", order="seen", removed=frame([(k, 0, 0, 0) for k in gone]).select("k"))
        taken = {k: v for k, v in rows.items() if k not in want or v[2] >= want[k][2]}
        want = {k: v for k, v in want.items() if k not in gone}
        want |= {k: (v[0], want[k][1] if k in want else v[1], v[2]) for k, v in taken.items()}
        assert {r.k: (r.v, r.made, r.seen) for r in t.read().collect()} == want
        deepest = max([deepest, *map(len, t.state()["parts"].values())])
    assert t.read().count() == len(want) and deepest == 3


def test_no_task_writes_a_large_bucket_alone(spark, tmp_path):
    """However few the buckets, rows beyond the advisory partition size go to further tasks, and none is lost."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rng = np.random.default_rng(5)
    rows = [(i, f"r{i % 2}", rng.bytes(5000).hex()) for i in range(400)]  # 2 MB that don't compress
    spark.conf.set(size, "100k")
    try:
        t = stores.Table(spark, str(tmp_path / "t"), "k", buckets=1)
        t.write(spark.createDataFrame(rows, "k int, r string, v string").repartition(20), ["r"])
    finally:
        spark.conf.unset(size)
    files = list((tmp_path / "t").glob("v-*/*/r=*/*.parquet"))
    assert len(files) > 8 and max(f.stat().st_size for f in files) < 600_000
    assert sorted(map(tuple, t.read().select("k", "r", "v").collect())) == rows


def test_older_versions_and_repeated_batches_change_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = stores.Table(spark, str(tmp_path / "t"), "id")
    advisory = lambda i, day, title: json.dumps({"id": i, "modified": f"2024-01-{day:02}T00:00:00Z", "summary": title})
    from quarry.sources import feeds

    for n, rows in enumerate([[advisory("A", 5, "five"), advisory("B", 1, "one")], [advisory("A", 3, "three"), advisory("B", 2, "two")]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(rows))
        watch.poll(spark, str(tmp_path / "in"), feeds.osv, t, str(tmp_path / "cp")).awaitTermination()
    assert {(r.id, r.title) for r in t.read().collect()} == {("A", "five"), ("B", "two")}
    batch = spark.createDataFrame([("A", "x", "modified", 1)], "path string, content string, change_type string, sequence bigint")
    c = stores.Table(spark, str(tmp_path / "c"), "path")
    watch.apply_changes(c, batch, batch_id=4)
    assert c.state()["batch"] == 4 and watch._applied(c, 4) and not watch._applied(c, 5)


def test_failing_batches_go_to_the_hook(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"path": "a", "content": "1", "change_type": "added", "sequence": 1}))
    source = spark.readStream.schema("path string, content string, change_type string, sequence bigint").json(str(tmp_path / "in"))
    seen = []

    def broken(df):
        raise RuntimeError("no")

    watch.watch(source, stores.Table(spark, str(tmp_path / "t"), "path"), str(tmp_path / "cp"), transform=broken, on_error=lambda i, e: seen.append((i, str(e)))).awaitTermination()
    assert seen == [(0, "no")]


def test_index_job(spark, tmp_path):
    docs = spark.createDataFrame([("a", "xx"), ("b", None), ("bad", "y")], "path string, content string")

    class Log(mapping.Hook):
        def on_start(self):
            self.rows = None

        def on_files(self, results):
            self.rows = {(r.path, r.error is None) for r in results.where("path IS NOT NULL").collect()}

        def on_complete(self, stats):
            self.stats = stats

    def one(row):
        if row["path"] == "bad":
            raise ValueError("broken")
        return {"n": len(row["content"] or "")}

    log, out = Log(), []
    stats = mapping.run_index(docs, one, "n int", lambda df: out.extend(r.n for r in df.collect()), [log], str(tmp_path / "kept"))
    assert stats == mapping.Stats(2, 1, 2) == log.stats and sorted(out) == [0, 2] and log.rows == {("a", True), ("b", True)}
    good, errors = mapping.map_collect(docs, one, "n int")
    assert good.count() == 2 and "broken" in errors.first()[0]


def test_dependency_and_finding_stores(spark):
    schema = "project_id string, workspace_id string, repository string, ecosystem string, name string, version string, lockfile_path string, direct boolean, dev boolean, indexed_at timestamp"
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("p1", "w", "r", "npm", "lodash", "4.17.20", "l", True, False, at(1)), ("p2", "w", "r", "npm", "lodash", "4.17.21", "l", True, False, at(1)), ("p1", "w", "r", "npm", "lodash", "1.0.0", "l2", False, True, at(1))]
    records = spark.createDataFrame(rows, schema)
    newer = spark.createDataFrame([("p1", "w", "r", "npm", "lodash", "4.17.20", "moved", True, False, at(2))], schema)
    assert {r.lockfile_path for r in inventory.put_dependencies(records, newer).collect()} == {"moved", "l", "l2"}
    assert inventory.query_dependencies(records, project="p1", dev=False).count() == 1 and inventory.query_dependencies(records, fixed="x").count() == 0
    adv = spark.createDataFrame([("CVE-1", 4, 9.8, "t", "d", [("npm", "lodash", "", "4.17.21", "")], {}, [])], "id string, severity int, cvss double, title string, description string, affected array<struct<ecosystem:string,name:string,introduced:string,fixed:string,last_affected:string>>, fixed_versions map<string,string>, fix_templates array<struct<package:string>>")
    found = inventory.scan_records(records, adv)
    assert [(r.id, r.fixed_in) for r in found.collect()] == [("f-CVE-1-p1-lodash-4.17.20-l", "4.17.21")]
    assert inventory.scan_records(records, adv, project="p2").count() == 0 and inventory.scan_records(records, adv, include_dev=True).count() == 2
    assert inventory.scan_records(records, adv, advisory="other").count() == 0 and inventory.advisories_of(adv, "npm", "lodash").count() == 1
    kept = inventory.put_findings(found, found.limit(0), records)
    assert kept.count() == 0 and inventory.count_findings(found, 4).first()[0] == 1
    assert "Window" not in vulnerabilities.scan_dependencies(records, adv)._jdf.queryExecution().executedPlan().toString()


class _Service(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
        body = json.dumps({"error": "down"} if "fail" in texts else {"data": [{"embedding": [float(len(t)), float(len(texts))]} for t in texts]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_embedders(spark):
    server = http.server.HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = embedding.http(f"http://127.0.0.1:{server.server_port}/")
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)] + [(9, None)], "doc_id int, content string").coalesce(1)
    got = {r.doc_id: r["values"] for r in embedding.embed(df, ask, batch_size=4).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 0} and {v[1] for v in got.values()} == {4, 2}
    bad = df.withColumn("content", F.lit("fail"))
    assert all(r["values"] is None for r in embedding.embed(bad, ask, skip_errors=True).collect())
    with pytest.raises(Exception, match="down"):
        embedding.embed(bad, ask).collect()
    with pytest.raises(Exception, match="vectors for"):
        embedding.embed(df, lambda t: []).collect()
    assert embedding.embed(df, embedding.hashed(8)).first()["values"] == text.embed_text("", 8) and embedding.none(3)(["a"]) == [[0.0] * 3]
    server.shutdown()


def test_content_by_uri_trees_and_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.txt").write_text("hello")
    (tmp_path / "sub").mkdir()
    uris = spark.createDataFrame([(f"file://{tmp_path}/d/a%20b.txt",), (f"{tmp_path}/missing",), ("odd://x",), ("mine://y",), (None,)], "uri string")
    got = {r.uri: (r.content, r.error) for r in remote.resolve(uris, loaders={"mine": lambda u: b"own"}).collect()}
    assert got[f"file://{tmp_path}/d/a%20b.txt"] == (b"hello", None) and got["mine://y"] == (b"own", None) and "FileNotFoundError" in got[f"{tmp_path}/missing"][1] and "no loader" in got["odd://x"][1] and got[None][1]
    assert [(r.name, r.is_dir, r.size) for r in remote.list_tree(spark, str(tmp_path)).collect()] == [("d", True, 0), ("sub", True, 0)]
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name, body in (("r-1/a.py", b"x = 1"), ("r-1/b.bin", b"\0"), ("r-1/big", b"x" * 50)):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    packed = spark.createDataFrame([("u", bytearray(raw.getvalue())), ("v", None)], "uri string, content binary")
    assert [(r.uri, r.path, r.content) for r in remote.unpack(packed, max_file=40).collect()] == [("u", "a.py", "x = 1")]
    page = spark.createDataFrame([(json.dumps([{"type": "file", "path": "p", "encoding": "base64", "content": "aGk="}, {"type": "dir", "path": "q"}]),)], "value string")
    assert [(r.path, r.content) for r in remote.contents(page).collect()] == [("p", "hi")]
    assert remote.archive_uris(spark, ["o/r"], "h.example").first().uri == "https://h.example/repos/o/r/tarball/HEAD"


def test_git_facts_of_documents(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=ann@x.y", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "a.py").write_text("x")
    run("add", ".")
    run("commit", "-m", "First\n\nCo-authored-by: Bo <bo@x.y>")
    docs = spark.createDataFrame([("1", "a.py", "python", "r", "main", "x y z"), ("2", "b.py", "python", "r", "main", "x y z")], "doc_id string, path string, language string, repository_id string, branch string, content string")
    known = git.with_facts(docs, git.history(spark, str(tmp_path)))
    e = Engine(known)
    assert [r.doc_id for r in e.search("x y", filter="'bo@x.y' in commit_coauthors && commit_author_name == 'Ann'").collect()] == ["1"]
    assert e.search("x y").count() == 2


def test_file_scan_rules(spark, tmp_path):
    for name in ("a.go", "b.py", "out/c.go", "node_modules/d.go"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("package x")
    (tmp_path / "link.go").symlink_to(tmp_path / "a.go")
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    assert names(files.scan(spark, str(tmp_path), "golang, Python", output="out")) == ["a.go", "b.py"]
    assert names(files.scan(spark, str(tmp_path), "go", output="out", links=True)) == ["a.go", "link.go"]
    assert files.parse_languages("go, PY,golang,") == ["go", "python"] and len(files.LANGUAGES) > 150


def test_server_symbols(spark):
    rows = spark.createDataFrame([("a", json.dumps([{"name": "C", "kind": 5, "selectionRange": {"start": {"line": 1, "character": 6}}, "children": [{"name": "m", "kind": 6, "range": {"start": {"line": 2, "character": 0}}}]}])), ("b", "nonsense"), ("c", "[]")], "path string, json string")
    assert [tuple(r) for r in symbols.from_server(rows).collect()] == [("a", "C", "class", "", 2, 7), ("a", "m", "method", "C", 3, 1)]
