import itertools
import math
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ann, decontam, html_extract, langid, linededup, packing, quality, queries, sharding, simhash, token_output

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3000


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty and a blank text, a very long one, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None, None), (None, "hello there world", "en", "s", 1), (2, "", "en", "s", 0), (3, " \n ", None, "s", 3), (4, LONG, "en", "t", len(LONG)), (5, "same text here", "en", "s", 1), (5, "same text here", "en", "s", 1), (6, "größe über alles", "de", None, 1)]
    return docs(spark, rows).withColumn("text_hash", F.lit(1)).withColumn("line", F.lit("x")).withColumn("__clean", F.lit(2)).withColumn("node", F.lit(3)).withColumn("score", F.lit(4))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_tokens_round_trip(odd, none):
    enc, book = token_output.encode_tokens(odd)
    want = sorted((str(r.doc_id), r.text is None, [] if r.text is None else token_output.tokenize(r.text)) for r in odd.collect())
    got = sorted((str(r.doc_id), r.ids is None, list(r.ids or [])) for r in token_output.decode_tokens(enc, book).collect())
    assert got == want
    assert token_output.encode_tokens(none)[0].count() == 0 and token_output.with_codebook(*token_output.encode_tokens(none)).count() == 0
    assert all(r.verified is None if r.bits is None else r.verified for r in enc.collect())


def test_tokens_decode_from_the_stored_table_alone(spark, odd, tmp_path):
    one = docs(spark, [(2**53 + 1, "a", "en", "s", 1), (None, "a", "en", "s", 1)])  # a single id
    for d in (odd, one):
        path = f"{tmp_path}/{d is one}"
        token_output.with_codebook(*token_output.encode_tokens(d, block=7)).write.parquet(path)
        got = sorted((str(r.doc_id), list(r.ids or [])) for r in token_output.decode_stored(spark.read.parquet(path), block=7).collect())
        assert got == sorted((str(r.doc_id), [] if r.text is None else token_output.tokenize(r.text)) for r in d.collect())


def test_limited_code_lengths_are_optimal():
    """Against the least cost of any lengths up to 3 or 4 bits that satisfy Kraft's inequality."""
    rng = np.random.default_rng(12)
    for _ in range(40):
        counts, limit = np.sort(rng.integers(1, 60, rng.integers(2, 7))), int(rng.integers(3, 5))
        best = min(int((counts * np.array(x)).sum()) for x in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-k for k in x) <= 1)
        assert int((counts * token_output.code_lengths(counts, limit)).sum()) == best


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, short = token_output.code_lengths(counts, 20), token_output.code_lengths(counts, 4)
    assert sum(2.0**-free) == 1 and sum(2.0**-short) <= 1 and short.max() <= 4
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        a, b, *rest = heap
        cost += a + b
        heap = sorted([*rest, a + b])
    assert int((counts * free).sum()) == cost
    assert token_output.code_lengths(np.array([7]), 20).tolist() == [1]


def test_language_accuracy_on_held_out_rows(spark, odd, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d.where("doc_id % 2 = 0"))
    held = d.where("doc_id % 2 = 1")
    got = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0] > 0.95
    r = {str(x.doc_id): x for x in langid.identify(odd, model).collect()}
    assert not r["1"].accepted and not r["2"].accepted and not r["3"].accepted and r["4"].language == "en"
    assert langid.train(none) is None and langid.identify(none, None).count() == 0
    assert langid.keep_identified(odd, None).columns == odd.columns


def test_language_rejection_does_not_depend_on_length(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(d)
    rng = np.random.default_rng(5)
    rows = []
    for lang in model.languages:
        known = [t for (t,) in d.where(F.col("lang") == lang).select("text").collect() if t]
        for k, size in enumerate((1_000_000, 5_000_000)):
            got, n = [], 0
            while n < size:
                t = known[rng.integers(len(known))]
                got.append(t)
                n += len(t)
            rows.append((k, " ".join(got), lang, "s", 0))
    noise = ["".join(chr(c) for c in rng.integers(0x3B1, 0x3CA, n)) for n in rng.integers(3, 9, 400)]
    strange = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), n)) for n in rng.integers(3, 9, 400)]
    unseen = [" ".join(rng.choice(w, n)) for w in (noise, strange) for n in (100, 1000, 200_000)]
    rows += [(9, t, "none", "s", 0) for t in unseen]
    arr = pa.array([r[1] for r in rows])
    for m in (model, langid.train(docs(spark, [*rows[:8], *((20 + i, r.text, r.lang, "s", 0) for i, r in enumerate(d.where("doc_id < 60").collect()))]))):
        language, _, _, _, ok = langid.predict(arr, m)
        assert list(ok) == [r[2] != "none" for r in rows]
        assert all(a == r[2] for a, r in zip(language, rows) if r[2] != "none")


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    items = [(i, " ".join(rng.choice(words, 14))) for i in range(6)] + [(90, None), (91, ""), (92, " ?! ")]
    rows = []
    for k in range(60):
        t, body = items[k % 6][1], " ".join(rng.choice(words, 20))
        cut = list(t)
        for _ in range(k % 12):
            cut[rng.integers(len(cut))] = str(rng.choice(list("xyz ")))
        rows.append((k, body + ". " + ("".join(cut) if k % 5 else "") + ", " + body, "en", "s", 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_contamination(docs(spark, rows), bench).collect()}
    want = set()
    for k, t, *_ in rows:
        for i, x in items[:6]:
            a = decontam.normalize_text(x)
            d = _distance(a, decontam.normalize_text(t))
            if d <= decontam.budget(len(a), decontam.ERROR_RATE):
                want.add((k, i, d))
    assert {g[:2] for g in got} == {w[:2] for w in want} and got == want
    assert decontam.decontaminate(docs(spark, rows), bench).count() == 60 - len({w[0] for w in want})
    assert decontam.decontaminate(odd, bench).count() == odd.count()
    assert decontam.find_contamination(odd, bench.limit(0)).count() == 0 and decontam.decontaminate(none, bench).count() == 0


def test_short_items_are_found(spark):
    items = [(1, "What is the capital of France?"), (2, "Ode to a cat"), (3, "cat"), (4, "two plus three"), (None, "no id here"), (5, "a b"), (6, "cat")]
    rows = ["so, what is the capital of france", "what is teh capital of france", "concatenate", "an Ode; to a CAT", "two plsu three", "two plus threes and no id here", "x a b", "xa b", None, ""]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    d = docs(spark, [(k, t, "en", "s", 0) for k, t in enumerate(rows)])
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_contamination(d, bench).collect()}
    want = set()
    for k, t in enumerate(rows):
        for i, x in items:
            a, b = decontam.normalize_text(x), decontam.normalize_text(t)
            n = decontam.budget(len(a), decontam.ERROR_RATE)
            dist = _distance(a, b) if n else int(b" " + a + b" " not in b" " + b + b" ")
            if dist <= n:
                want.add((k, i, dist))
    assert got == want and {(0, 1, 0), (1, 1, 2), (3, 3, 0), (3, 2, 0), (6, 5, 0), (5, None, 0)} <= got and not any(g[0] in (2, 7) for g in got)
    loose = {(r.doc_id, r.item_id, r.distance) for r in decontam.find_contamination(d, bench, error_rate=0.2).collect()}
    want = set()
    for k, t in enumerate(rows):
        for i, x in items:
            a, b = decontam.normalize_text(x), decontam.normalize_text(t)
            n = decontam.budget(len(a), 0.2)
            dist = _distance(a, b) if n else int(b" " + a + b" " not in b" " + b + b" ")
            if dist <= n:
                want.add((k, i, dist))
    assert loose == want and len(loose) > len(got)
    long = "filler words " * 200_000 + "what is the capitol of france " + "more filler " * 1000
    assert decontam.find_contamination(docs(spark, [(1, long, "en", "s", 0)]), bench).collect()[0].item_id == 1


def test_myers_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (bytes(rng.choice(list(b"abc"), n).tolist()) for n in (rng.integers(1, 9), rng.integers(0, 14)))
        assert decontam.myers(a, b) == _distance(a, b)


def _walk(pos, points, owner, shards, slack):
    """Every key in ring order to its own shard while that has room; then those over, clockwise to the next point with room."""
    full = math.ceil((1 + slack) * len(pos) / shards)
    arcs, load, out, over = {}, Counter(), {}, []
    for k in sorted(pos, key=lambda k: (pos[k], k)):
        arcs.setdefault(int(np.searchsorted(points, pos[k])) % len(points), []).append(k)
    for arc in sorted(arcs):
        for k in arcs[arc]:
            if load[owner[arc]] < full:
                out[k] = owner[arc]
                load[owner[arc]] += 1
            else:
                over.append((arc, k))
    last = None
    for arc, k in over:
        at = arc if last is None or last[0] != arc else last[1]
        if last is None or last[0] != arc or load[owner[at]] >= full:
            at = (at + 1) % len(points)
            while load[owner[at]] >= full:
                at = (at + 1) % len(points)
        out[k] = owner[at]
        load[owner[at]] += 1
        last = (arc, at)
    return out


def test_sharding_against_a_plain_walk(spark, odd, none):
    d = spark.range(5000).withColumnRenamed("id", "doc_id")
    pos = {r.doc_id: r.p for r in d.select("doc_id", sharding.position(F.col("doc_id")).alias("p")).collect()}
    got = {}
    for shards in (16, 17):
        rows = {r.doc_id: r for r in sharding.assign(d, shards=shards).collect()}
        points, owner = sharding.ring(shards, sharding.VIRTUAL)
        assert {k: r.shard for k, r in rows.items()} == _walk(pos, points, owner, shards, sharding.SLACK)
        assert all(owner[int(np.searchsorted(points, pos[k])) % len(points)] == r.primary_shard for k, r in rows.items())
        load = Counter(r.shard for r in rows.values())
        assert len(rows) == 5000 and max(load.values()) <= math.ceil(1.05 * 5000 / shards)
        got[shards] = {k: r.shard for k, r in rows.items()}
    assert sum(got[16][k] != got[17][k] for k in got[16]) < 5000 * 2.5 / 17
    assert sharding.assign(odd).count() == odd.count() and sharding.assign(none).count() == 0


def test_sharding_of_hot_and_null_keys(spark):
    """A third of all rows has one key, a tenth none: the bound holds, and no row is lost."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, None).otherwise(F.col("id").cast("string"))
    d = spark.range(60_000).select(key.alias("doc_id")).withColumn("arc", F.lit(1)).withColumn("shard", F.lit("x"))
    got = Counter(r.shard for r in sharding.assign(d).collect())
    assert sum(got.values()) == 60_000 and max(got.values()) <= math.ceil(1.05 * 60_000 / sharding.SHARDS)


def test_sharding_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute("SELECT doc_id, primary_shard, shard FROM (" + queries.oracle_sql()["op4_sharding"] + ")").fetchall()
    got = queries.op4_sharding(spark, SF).select("doc_id", "primary_shard", "shard").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(a != b for _, a, b in want)


def test_html(spark):
    body = "A long enough sentence of the article that goes on for a while and says something. "
    page = "<html><head><title>No</title></head><body><nav><a>Home</a></nav><br><br><br>" + f"<p>{body * 3}</p><p>{body * 2}&amp; more</p>" + "<br><br><br><br><div>footer</div><script>var x = 'no';</script></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "<p>x < y"), (5, page), (6, "<script>" + "x" * 500)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit(0))).collect()}
    assert "long enough" in got[1] and "& more" in got[1] and "Home" not in got[1] and "footer" not in got[1] and "var x" not in got[1]
    assert got[2] is None and got[3] == "" and got[4] == "" and got[5] == got[1] and got[6] == ""


@pytest.mark.parametrize("bit", ["<script ", "<a ", "<p ", "<!-- ", "<!x ", "</script ", "<svg>", "<", "&amp", "<script></script", "<div><br>", "</head   ", "<p>x</p>\n\n"])
def test_html_time_is_linear(bit):
    page = bit * (10_000_000 // len(bit))
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 30


def test_html_hidden_parts_against_character_loop():
    def plain(page):
        out, at = "", 0
        while at < len(page):
            rest = page[at:].lower()
            name = next((n for n in ("script", "head", "svg") if rest.startswith("<" + n) and (rest + " ")[len(n) + 1] in " >\n<"), None)
            if rest.startswith("<!--"):
                end = page.find("-->", at + 4)
                at, out = (end + 3 if end >= 0 else len(page)), out + " "
            elif (rest.startswith("<!") or name) and ">" in rest:
                end = at + rest.index(">") + 1
                if name:
                    close = next((i for i in range(end, len(page)) if page[i:].lower().startswith(f"</{name}>")), -1)
                    end = close + len(name) + 3 if close >= 0 else len(page)
                at, out = end, out + " "
            else:
                out, at = out + page[at], at + 1
        return out

    rng = np.random.default_rng(8)
    parts = ["<script>", "</script>", "<HEAD>", "</head>", "<svg ", "</svg>", "<!--", "-->", "<!doc>", "<!", ">", "text", " ", "<p>", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert html_extract._without_hidden(page) == plain(page), page


def test_html_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute("SELECT page_id, text, n_chars FROM (" + queries.oracle_sql()["op5_html_extraction"] + ")").fetchall()
    assert sorted(map(tuple, queries.op5_html_extraction(spark, SF).collect())) == sorted(want)


def test_html_edges(spark):
    rows = [(k, "<p>" + "word " * 100_000 + "</p>") for k in (2**53 + 1, None)]
    d = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("n_chars", F.lit("x")).withColumn("text", F.lit(1))
    got = html_extract.extract_pages(d).collect()
    assert sorted(str(r.page_id) for r in got) == ["9007199254740993", "None"] and all(r.n_chars == 499_999 for r in got)
    assert html_extract.extract_pages(d.limit(0)).count() == 0


def test_html_blocks_against_plain_loop():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = [int(x) for x in rng.choice([0, 0, 5, 20, 60, 120], rng.integers(0, 25))]
        w = [sum(n[i : i + 3]) for i in range(len(n))]
        want, i = [], 0
        while i < len(n):
            if w[i] > 86 and not (i + 1 < len(n) and w[i + 1] == 0):
                j = i
                while j < len(n) and w[j] >= 30:
                    j += 1
                want.append((i, j))
                i = j
            else:
                i += 1
        assert html_extract.blocks(n) == want


def test_quality_on_held_out_labels(spark, odd, none):
    # some 300 labelled rows, as at sf0.01, are too few to beat the majority; the README has the figures
    d, lab = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    odd_labels = lab.where("doc_id % 4 <> 0").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 1), (16, 1, 1), (16, 1, 1)], "doc_id bigint, quality int, toxic int"))
    got = quality.classify(d, odd_labels).join(lab.where("doc_id % 4 = 0"), "doc_id").toPandas()
    for p, y in ((got.p_quality, got.quality), (got.p_toxic, got.toxic)):
        assert ((p > 0.5) == (y == 1)).mean() > max(y.mean(), 1 - y.mean()) + 0.03
    assert ((got.p_toxic > 0.5) & (got.toxic == 1)).sum() >= 0.75 * got.toxic.sum() and ((got.p_toxic > 0.5) & (got.toxic == 0)).mean() < 0.01
    r = {str(x.doc_id): x for x in quality.classify(odd, lab.limit(0)).collect()}
    assert r["1"].p_quality is None and not r["2"].keep and r["4"].p_quality == 0.5 and r["4"].keep
    assert quality.classify(none, lab.limit(0)).count() == 0


def test_quality_counts_and_pooling_against_plain_loops(spark):
    import re

    texts = ["The cat, the cats!", "cat", None, "", "  ", "über the überall ###", "the " * 3000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    v = quality.corpus_vectors(d)

    def split(t):
        return [x.encode() for x in re.findall(r"[^\W_]+|[^\w\s]+|_+", (t or "").lower())]

    def number(x, n=0):
        h = quality.C.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
        return int((quality.C.mix(h + np.uint64(n)) if n else h)[0])

    def found(t):
        words = split(t)
        return Counter([number(w) for w in words] + [number(w[:n], n) for w in words for n in quality.PREFIXES if len(w) > n]), {number(w) for w in words}

    df = np.zeros(quality.SLOTS, np.int64)
    for t in texts:
        for s in {h >> 46 for h in found(t)[0]}:
            df[s] += 1
    assert v.n == 4 and (v.df == df).all()
    index, sums = quality.context_index(), np.zeros_like(v.context, dtype=np.int64)
    for t in texts:
        slots = [number(w) >> 50 for w in split(t)]
        for i, s in enumerate(slots):
            for j in range(max(0, i - 2), min(len(slots), i + 3)):
                if i != j:
                    sums[s] += index[slots[j]]
    assert (v.context == sums).all()
    context, weight = v.ready()
    x = np.concatenate([m for _, m, _ in quality.pool(pa.array(texts), v)])
    for r, t in enumerate(texts):
        count, words = found(t)
        want = np.zeros(quality.OWN_DIM + quality.CONTEXT_DIM)
        w = {h: weight[h >> 46] * (1 + math.log(n)) for h, n in count.items()}
        norm = max(math.sqrt(sum(float(a) ** 2 for a in w.values())), 1e-9)
        for h, a in w.items():
            place, sign = quality.own_index(np.array([h], np.uint64))
            for q, g in zip(place[0], sign[0]):
                want[q] += g * a / norm
            if h in words:
                want[quality.OWN_DIM :] += a / norm * context[h >> 50]
        assert np.allclose(x[r], want, atol=1e-4)


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for g in range(40):
        base = rng.choice(words, 150)
        for c in range(1 + g % 4):
            t = base.copy()
            t[rng.integers(0, 150, c)] = rng.choice(words, c)
            rows.append((len(rows), " ".join(t), "en", "s", 0))
    fp = np.array([np.frombuffer(x, np.uint8) for x in simhash.fingerprints(pa.array([r[1] for r in rows]))])
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2, dtype=int) <= simhash.MAX_HAMMING
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    want = {(i, r) for i, r in enumerate(root) if i != r}
    got = {(r.doc_id, r.duplicate_of) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(got & want) >= 0.98 * len(want) and got <= want
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def _flipped(rng, x, d):
    bits = np.zeros((len(x), simhash.BITS), np.uint8)
    np.put_along_axis(bits, rng.random((len(x), simhash.BITS)).argsort(axis=1)[:, :d], 1, axis=1)
    return x ^ np.packbits(bits, axis=1)


def test_planted_pairs_at_every_distance(spark):
    """Recall by distance through the whole join: all pairs up to 24 bits, 0.9 of those at 33 to 40, none beyond the limit."""
    rng = np.random.default_rng(19)
    want, fps = {}, []
    for d in range(1, 49):
        x = rng.integers(0, 256, (50, simhash.BITS // 8), dtype=np.uint8)
        for a, b in zip(x, _flipped(rng, x, d)):
            want[frozenset((a.tobytes(), b.tobytes()))] = d
            fps += [a.tobytes(), b.tobytes()]
    nodes = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    for hot in (simhash.HOT, 6):
        cells = simhash._cells(nodes, *simhash.grid(len(fps)), hot)
        found = {frozenset((bytes(r.u), bytes(r.v))) for r in simhash._edges(cells, simhash.MAX_HAMMING).collect()}
        by = Counter(want[p] for p in found)
        assert found <= set(want) and all(by[d] == 50 for d in range(1, 25)) and max(by) <= simhash.MAX_HAMMING
        assert sum(by[d] for d in range(33, 41)) >= 0.9 * 8 * 50


def test_hot_cells_compare_every_pair(spark):
    ids, take = np.full(60, 5), np.arange(60)
    own = np.random.default_rng(20).integers(0, 1 << 63, 60).astype(np.uint64)
    cell, row = simhash.split_hot(np.append(ids, 9), np.append(take, 0), own, np.array([5]), np.array([4]))
    met = {frozenset((a, b)) for c in set(cell.tolist()) for a in row[cell == c] for b in row[cell == c]}
    assert len(met) == 60 * 61 // 2 and (cell == 9).sum() == 1 and 5 not in cell and max(Counter(cell.tolist()).values()) < 60


def test_grid_grows_with_the_table():
    assert simhash.grid(1000) == simhash.grid(1 << 24) == (simhash.TABLES, simhash.SEGMENTS_PER_TABLE)
    tables, per_table = simhash.grid(10**10)
    assert per_table > simhash.SEGMENTS_PER_TABLE and 10**10 * (3 / 8) ** per_table <= (1 << 24) * (3 / 8) ** simhash.SEGMENTS_PER_TABLE
    assert 1 - (1 - 0.724**per_table) ** tables >= 0.9


def test_embedding_distance_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 256, (2, 100, 32), dtype=np.uint8)
    l1 = np.abs(simhash.embed(a).astype(int) - simhash.embed(b)).sum(axis=1)
    assert (l1 <= np.bitwise_count(a ^ b).sum(axis=1, dtype=int)).all()


def test_simhash_candidates_at_the_limit():
    rng, n = np.random.default_rng(11), 4000
    x = rng.integers(0, 256, (n, simhash.BITS // 8), dtype=np.uint8)
    flips = np.zeros((n, simhash.BITS), np.uint8)
    np.put_along_axis(flips, rng.random((n, simhash.BITS)).argsort(axis=1)[:, : simhash.MAX_HAMMING], 1, axis=1)
    moved = simhash.embed(x) != simhash.embed(x ^ np.packbits(flips, axis=1))
    found = np.zeros(n, bool)
    for p in simhash.table_segments(simhash.TABLES, simhash.SEGMENTS_PER_TABLE):
        found |= ~moved[:, p].any(axis=1)
    assert found.mean() >= 0.9


def test_packing(spark, odd, none):
    p = packing.pack(odd, group_tokens=8000).toPandas()
    tokens = sum(len(token_output.tokenize(r.text)) for r in odd.collect() if r.text)
    assert p.n_tokens.sum() == tokens and p.n_tokens.max() <= packing.CAPACITY
    assert (p.groupby(["group_id", "sequence_id"]).n_tokens.sum() <= packing.CAPACITY).all()
    sizes = np.sort(np.random.default_rng(6).integers(1, 50, 60))[::-1]
    load, room, want = [0.0] * max(1, -(-int(sizes.sum()) // 100)), [100] * max(1, -(-int(sizes.sum()) // 100)), []
    for s in sizes:
        fit = [i for i in range(len(room)) if room[i] >= s]
        k = min(fit, key=lambda i: (load[i], i)) if fit else len(room)
        if k == len(room):
            load.append(0.0)
            room.append(100)
        load[k] += s + s * s / 4096
        room[k] -= s
        want.append(k)
    assert packing.place(sizes, 100).tolist() == want
    assert packing.pack(none).count() == 0


def test_packing_leaves_ids_alone_and_spreads_repeated_rows(spark):
    big = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63)]
    rows = [(None, 1, 10), *((x, 2, 10) for x in big), (7, 4, 0), *[(9, 9, 3)] * 1000]
    lengths = spark.createDataFrame(rows, "doc_id bigint, text_hash bigint, n_tokens bigint")
    one = packing.pack_lengths(lengths).collect()
    assert sorted(str(r.doc_id) for r in one) == sorted(str(r[0]) for r in rows if r[2])
    assert one[0].doc_id is None or min(r.sequence_id for r in one if r.doc_id is None) == 0
    many = packing.pack_lengths(lengths, group_tokens=300).toPandas()
    repeats = many[many.n_tokens == 3].groupby("group_id").size()
    assert repeats.sum() == 1000 and repeats.max() - repeats.min() <= 1
    names = packing.pack_lengths(lengths.select(F.col("doc_id").cast("string"), "text_hash", "n_tokens")).collect()
    assert {r.doc_id for r in names} == {None if r[0] is None else str(r[0]) for r in rows if r[2]}


def _exact(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_nearest_neighbours_odd_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 16), (900, None), (901, []), (902, [float("nan")] * 16), (0, x[0].tolist()), (903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("dim", F.lit(0)).withColumn("ask", F.lit("x"))
    for query_bytes in (1 << 20, 20_000):  # one block, and many
        p = ann.nearest(df, k=5, query_bytes=query_bytes).toPandas()
        got, best = p.groupby("vec_id").neighbor_id.apply(set), _exact(x, 5)
        assert np.mean([len(set(best[i]) & got[i]) / 5 for i in range(300)]) >= 0.9
        assert set(p.vec_id) == set(range(300)) and (p.vec_id != p.neighbor_id).all() and (p.groupby("vec_id").size() == 5).all()
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df, asks=F.lit(None).cast("boolean")).count() == 0
    few = ann.nearest(df.where("vec_id < 4"), k=10, asks=F.col("vec_id") == 2).collect()
    assert sorted(r.neighbor_id for r in few) == [0, 1, 3] and {r.vec_id for r in few} == {2}


def test_nearest_neighbours_ties_and_large_ids(spark):
    one, other = [1.0] + [0.0] * 7, [0.0] * 8
    rows = [(2**62 + i, one) for i in range(40)] + [(-1, other), (-2, other)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, k=4).collect()
    for r in got:
        want = [2**62 + i for i in range(6) if 2**62 + i != r.vec_id][:4] if r.vec_id > 0 else sorted({-1, -2, *(2**62 + i for i in range(4))} - {r.vec_id})[:4]
        assert r.neighbor_id == want[r.rank - 1] and r.similarity == (1.0 if r.vec_id > 0 else 0.0)
    assert len(got) == 42 * 4
    names = ann.nearest(df.select(F.col("vec_id").cast("string"), "embedding"), k=4)
    assert {len(v) for v in names.toPandas().groupby("vec_id").neighbor_id.apply(set)} == {4}


def test_nearest_neighbours_against_brute_force_where_most_is_never_compared(spark, monkeypatch):
    """Clusters in 30,000 points, 40 candidates: the forest looks at a small share of the table."""
    rng = np.random.default_rng(17)
    centre = rng.standard_normal((1500, 32))
    x = (centre[np.arange(30_000) % 1500] + 0.2 * rng.standard_normal((30_000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(30_000)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    p = ann.nearest(df, asks=F.col("vec_id") % 100 == 0, candidates=40).toPandas()
    q = np.arange(0, 30_000, 100)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    best = np.argsort(-s, axis=1)[:, :10]
    got = p.groupby("vec_id").neighbor_id.apply(set)
    assert set(p.vec_id) == set(q) and np.mean([len(set(best[i]) & got[v]) / 10 for i, v in enumerate(q)]) >= 0.9
    assert np.allclose(p.similarity, (x[p.vec_id] * x[p.neighbor_id]).sum(axis=1), atol=1e-5)
    code = ann.codes(x, ann.TREES)
    orders = [np.argsort(code[:, t], kind="stable") for t in range(ann.TREES)]
    level = ann.level_for(np.array([s[i, best[i, -1]] for i in range(len(q))]), ann.TREES, ann.MISS)
    compared = ann._candidates([code[o, t] for t, o in enumerate(orders)], orders, code[q], level)
    assert compared.mean() < 0.1


def test_forest_ranges_against_prefix_comparison():
    rng = np.random.default_rng(18)
    code, ask, level = rng.integers(0, 1 << ann.BITS, (200, 3)), rng.integers(0, 1 << ann.BITS, (20, 3)), rng.integers(0, 8, 20)
    orders = [np.argsort(code[:, t], kind="stable") for t in range(3)]
    got = ann._candidates([code[o, t] for t, o in enumerate(orders)], orders, ask, level)
    want = np.array([[any(c[t] >> (ann.BITS - x) == a[t] >> (ann.BITS - x) for t in range(3)) for c in code] for a, x in zip(ask, level)])
    assert (got == want).all()


def test_line_dedup(spark, odd, none):
    rows = [(i, f"own {i}\nMENU\n\n shared {i // 10} ", "en", "h", 0) for i in range(20)] + [(50, "MENU\nx", "en", "single", 0), (51, "MENU", "en", None, 0), (52, None, "en", "h", 0)]
    rows += [(60 + i, f"TOP\nbody {i}", "en", "three", 0) for i in range(3)] + [(70 + i, "all of\nthis is\nmirrored", "en", "copies", 0) for i in range(30)]
    for side in (1000, 0):  # broadcast, and joined by page
        got = {r.doc_id: r for r in linededup.drop_boilerplate(docs(spark, rows), F.col("source"), max_ratio=0.5, n_dropped="n", broadcast_rows=side).collect()}
        assert len(got) == len(rows) and got[3].text == "own 3\n\n shared 0 " and got[3].n == 1  # 'shared 0' is on half of the pages: no more than the ratio
        assert got[50].text == "MENU\nx" and got[51].text == "MENU" and got[52].text is None
        assert [got[60 + i].text for i in range(3)] == [f"body {i}" for i in range(3)]
        assert all(got[70 + i].text == "all of\nthis is\nmirrored" for i in range(30))
        clash = docs(spark, rows).withColumn("__lines", F.lit(1)).withColumn("__site", F.lit(2)).withColumn("page", F.lit(3)).withColumn("host", F.lit(4)).withColumn("line", F.lit(5))
        out = linededup.drop_boilerplate(clash, F.col("source"), max_ratio=0.5, broadcast_rows=side)
        assert out.columns == clash.columns and {r.doc_id: r.text for r in out.collect()} == {k: r.text for k, r in got.items()}
    assert linededup.drop_boilerplate(odd, F.col("source")).columns == odd.columns
    assert linededup.drop_boilerplate(none, F.col("source")).count() == 0


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute("SELECT doc_id, text, n_lines, n_dropped FROM (" + queries.oracle_sql()["op10_line_dedup"] + ")").fetchall()
    got = queries.op10_line_dedup(spark, SF).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_pipeline_keeps_one_of_a_group_of_copies(spark):
    rng = np.random.default_rng(3)
    text = lambda n: "\n".join(" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(12)) for _ in range(n))
    exact, near = text(12), text(12)
    rows = [(i, f"MENU HOME\n{text(4)}", "en", "h", 0) for i in range(60)]
    rows += [(100 + i, exact, "en", "h", 0) for i in range(12)]
    rows += [(200 + i, near.replace(near.split("\n")[i].split(" ")[0], f"edited{i}", 1), "en", "h", 0) for i in range(12)]
    d = docs(spark, rows)
    clean = corpus_pipeline.line_dedup(spark, d, SF)
    got = {r.doc_id: r.text for r in clean.collect()}
    assert len(got) == len(rows) and not any("MENU" in got[i] for i in range(60))
    assert all(got[r[0]] == r[1] for r in rows[60:])
    left = [r.doc_id for r in corpus_pipeline.near_dedup(spark, clean, SF).select("doc_id").collect()]
    assert sum(100 <= i < 200 for i in left) == 1 and sum(i >= 200 for i in left) == 1 and len(left) == 62


@pytest.fixture(scope="module")
def odd_docs(spark, odd):
    """The odd rows with two columns more than documents has, one of a name that a stage takes itself, and enough text to train on."""
    more = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__dropped", F.lit(7)).withColumn("__hash", F.lit("h"))
    return more.unionByName(odd.select(*more.columns[:5]).withColumn("__dropped", F.lit(8)).withColumn("__hash", F.lit(None).cast("string")))


def _rows(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("k", range(4))
def test_stages_carry_odd_rows(spark, odd_docs, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns
    before, after = _rows(odd_docs.where("`__dropped` = 8")), _rows(out.where("`__dropped` = 8"))
    want = dict(before)
    if name == "language_id":
        want = {r: n for r, n in want.items() if r[1].strip() and r[1] != "None"}
        assert all(r[2] != "None" for r in after)
    elif name == "near_dedup":
        want = {r: 1 for r in want}
    assert dict(after) == want
    empty = odd_docs.limit(0)
    assert stage(spark, empty, SF).columns == odd_docs.columns and stage(spark, empty, SF).count() == 0


def test_language_stage_fills_null_labels_and_rejects(spark, odd_docs):
    noise = [(900 + i, "".join(np.random.default_rng(i).choice(list("bcdfghjklmnpqrstvwxz "), 800)), None, "s", 1) for i in range(5)]
    known = spark.read.parquet(f"{SF}/documents.parquet")
    d = known.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang"))).unionByName(docs(spark, noise))
    out = corpus_pipeline.language_id(spark, d, SF).select("doc_id", F.col("lang").alias("found"))
    both = known.join(out, "doc_id").where("lang <> found")
    assert out.count() == known.count() and both.count() == 0


def test_pack_stage_places_every_token(spark, odd_docs, none):
    out = corpus_pipeline.pack(spark, odd_docs, SF)
    want = Counter()
    for r in odd_docs.collect():
        n = len(token_output.tokenize(r.text)) if r.text else 0
        want[str(r.doc_id)] += n
    got = Counter()
    for r in out.collect():
        got[str(r.doc_id)] += r.n_tokens
    assert got == +want and corpus_pipeline.pack(spark, none, SF).count() == 0


def test_pipeline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    packed = corpus_pipeline.run(spark, SF)
    left = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = d.where(F.col("doc_id").isin(list(left)))
    assert 0 < len(left) < d.count() and decontam.find_contamination(kept, bench).count() == 0
    assert set(queries.queries()) >= {"pipeline", "op1_token_huffman", "op10_line_dedup"}
