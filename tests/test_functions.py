import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quarry.functions import cel, fuzzy, git, regex, semver, text


def test_trigrams_skip_nul_and_line_ends():
    assert regex.trigrams(b"abcab") == {b"abc", b"bca", b"cab"}
    assert regex.trigrams(b"a\nbcd\0ef") == {b"bcd"}
    assert regex.trigrams(b"ab") == frozenset()


@pytest.mark.parametrize("pattern, grams", [("hello", {b"hel", b"ell", b"llo"}), ("a.*b", set()), ("abc(d|d)e", {b"abc", b"bcd", b"cde"}), ("(abcd|xbcd)", {b"bcd"}), ("(abc)+", {b"abc"}), ("(?i)hello", set()), ("ab{2}c", {b"abb", b"bbc"}), ("x*abc", {b"abc"}), ("foo[0-9]bar", {b"foo", b"bar"})])
def test_required_trigrams(pattern, grams):
    assert set(regex.plan(pattern).trigrams) == grams


@pytest.mark.parametrize("pattern", ["(", "a(?=b)", r"(a)\1"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(ValueError):
        regex.plan(pattern)


def test_posix_class_in_java(spark):
    assert spark.range(1).select(F.lit("abX").rlike(regex.to_java("^[[:alpha:]]+X$"))).first()[0]
    assert not spark.range(1).select(F.lit("1X").rlike(regex.to_java("^[[:alpha:]]+X$"))).first()[0]


def test_mode():
    assert [regex.detect_mode(q) for q in ("a.b", "Foo", "foo")] == ["regex", "symbol", "exact"]


def test_fuzzy():
    m = fuzzy.match("hello world", "hello")
    assert (m.start, m.end, m.positions) == (0, 5, [0, 1, 2, 3, 4])
    assert fuzzy.match("FooBar", "foobar") and not fuzzy.match("FooBar", "foobar", case_sensitive=True)
    assert not fuzzy.match("hello", "xyz") and fuzzy.match("x", "").score == 0
    assert fuzzy.match("foo_bar", "fb").score > fuzzy.match("fooxbar", "fb").score
    g = fuzzy.match_greedy("axbxab", "ab")
    assert (g.start, g.end) == (0, 3) and g.positions == [0, 2]
    assert not fuzzy.match_greedy("abc", "d")


def test_fuzzy_best_alignment_is_not_worse_than_greedy():
    for t in ("src/fooBar/baz.go", "handle_checkout_request", "xxaxbxxab"):
        for p in ("ab", "fb", "hcr", "bz"):
            a, b = fuzzy.match(t, p), fuzzy.match_greedy(t, p)
            assert bool(a) == bool(b) and a.score >= b.score


def test_semver(spark):
    pairs = [("1.2.3", "1.2.3", 0), ("1.2.2", "1.2.3", -1), ("1.3.0", "1.2.9", 1), ("1.2.3-beta", "1.2.3", -1), ("1.0.0-alpha", "1.0.0-beta", -1), ("v1", "1.0.0", 0), ("1.0.0-2", "1.0.0-10", -1), ("1.0.0-1", "1.0.0-a", -1), ("1.0.0-a", "1.0.0-a.1", -1), ("1.0.0+b", "1.0.0", None), ("1.2.3.4", "1", None), ("", "1", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert [r[0] for r in df.select(semver.compare(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_range(spark):
    rows = [("4.17.20", "", "4.17.21", "", True), ("4.17.21", "", "4.17.21", "", False), ("2.0.0", "1.0.0", "", "2.0.0", True), ("1.0.0", "x", "", "", False), ("bad", "", "", "", False), ("1.0.0", None, None, None, True)]
    df = spark.createDataFrame(rows, "v string, i string, f string, l string, want boolean")
    assert [r[0] for r in df.select(semver.within(F.col("v"), F.col("i"), F.col("f"), F.col("l"))).collect()] == [r[4] for r in rows]


@pytest.mark.parametrize("source, want", [("language == 'go'", True), ("language == 'go' && file_size > 10", True), ("language in ['py', 'go']", True), ("'bob' in commit_coauthors", True), ("commit_date > timestamp('2024-01-01T00:00:00Z')", True), ("file_path.startsWith('src/')", True), ("", True), ("!commit_is_agent ? size(language) == 2 : false", True), ("file_path.matches('^lib')", False), ("file_size % 7 == 0", False)])
def test_cel(spark, source, want):
    row = spark.range(1).select(F.lit("go").alias("language"), F.lit("src/a.go").alias("file_path"), F.lit(20).cast("bigint").alias("file_size"), F.array(F.lit("bob")).alias("commit_coauthors"), F.expr("timestamp'2024-06-01'").alias("commit_date"), F.lit(False).alias("commit_is_agent"))
    assert (cel.apply_filter(row, source).count() == 1) is want


@pytest.mark.parametrize("source", ["name", "name == 1", "nope == 'a'", "name ==", "line && exported", "name.foo('a')", "'a", "name in [1]"])
def test_cel_errors(source):
    assert cel.validate(source, cel.SYMBOL)


def test_trailers():
    m = "Fix it\n\nBody: not one\n\nCo-Authored-By: A B <a@b.c>\nReviewed-by: X\n"
    assert git.trailers(m) == [("Co-Authored-By", "A B <a@b.c>"), ("Reviewed-by", "X")]
    assert git.co_authors(m) == [("A B", "a@b.c")]
    assert git.trailers("no trailer here") == []


def test_repository_name(spark):
    df = spark.createDataFrame([("git@h.x:o/r.git", "o/r"), ("https://h.x/o/r.git", "o/r"), ("plain", "plain")], "u string, want string")
    assert df.where(git.repository_name(F.col("u")) != F.col("want")).count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, "\n".join("abcdefg") + "\n"), (2, ""), (3, None), (4, "x")], "id int, t string")
    got = sorted((r.id, r.start_line, r.end_line, r.chunk) for r in text.chunk_windows(df, "t", 4, 1).collect())
    assert got == [(1, 1, 4, "a\nb\nc\nd"), (1, 4, 7, "d\ne\nf\ng"), (4, 1, 1, "x")]
    with pytest.raises(ValueError):
        text.chunk_windows(df, "t", 2, 2)
    src = spark.createDataFrame([("import x\n\ndef a():\n  pass\nclass B:\n  y = 1\n",)], "t string")
    assert [(r.start_line, r.end_line) for r in text.chunk_functions(src, "t").orderBy("start_line").collect()] == [(1, 2), (3, 4), (5, 6)]


def test_occurrences_are_bytes_and_overlap(spark):
    df = spark.createDataFrame([("é aaa\naa", )], "t string")
    got = df.select(F.inline(text.occurrences(F.col("t"), "aa"))).collect()
    assert [(r.offset, r.line, r.column) for r in got] == [(3, 1, 3), (4, 1, 4), (7, 2, 0)]


def test_postings_against_brute_force(spark):
    rows = [(1, "abcabc"), (2, "añb\ncde"), (3, None), (4, "ab")]
    got = {(r.trigram, r.id) for r in text.trigram_postings(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {(g[0] << 16 | g[1] << 8 | g[2], i) for i, t in rows for g in regex.trigrams((t or "").encode())}


def test_embedding_holds_no_copy_of_its_batch(spark):
    """Texts stay in the Arrow batch: neither Spark nor the function makes Python objects of them all."""
    texts = [f"{i} " * 20_000 for i in range(100)] + [None, "", " É! "]
    batch = pa.array(texts)
    tracemalloc.start()
    got = text.embed_array(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [text.embed_text(t) for t in texts] and peak < 0.5 * batch.nbytes
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.hash_embedding(F.col("t"), 8).alias("v"))
    assert {r.i: r.v for r in df.collect()} == {i: text.embed_text(t, 8) for i, t in enumerate(texts)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan and f"], {PythonEvalType.SQL_SCALAR_PANDAS_UDF}" not in plan
