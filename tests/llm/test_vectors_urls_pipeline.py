"""Vector operators and the URL filter against brute force; the pipeline on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from posegrid.llm import caps, neighbours, simhash, url_filter
from posegrid.llm.queries import URL_RULES

BAD = [(900, None), (901, [0.0] * 16), (902, [1.0]), (903, [float("nan")] * 16), (904, [None] * 16), (None, [1.0] * 16)]


def vectors(spark, seed, n=400, groups=6, scale=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[: n // 3] = x[rng.integers(0, groups, n // 3)] + 0.1 * rng.normal(size=(n // 3, 16))
    x[n - 20 :] = x[0]
    if scale:
        x *= rng.uniform(0.2, 3, (n, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + BAD, "vec_id long, embedding array<double>")
    return x, df.withColumn("f", F.lit("clash")).withColumn("rep", F.lit(1))


@pytest.mark.parametrize("chunk", [512, 16])
def test_caps(spark, chunk):
    x, df = vectors(spark, 1)
    rows = {r["vec_id"]: r for r in caps.near_vectors(df, chunk=chunk).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    links = near.sum(axis=1) - 1
    got = np.array([rows[i]["n_links"] for i in range(len(x))])
    assert (got <= links).all() and got.sum() >= 0.98 * links.sum()
    root = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert np.mean([rows[i]["component_id"] == root[i] for i in range(len(x))]) > 0.98
    for i in (900, 901, 902, 903, 904):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (0, i, True)
    assert caps.near_vectors(df.limit(0)).count() == 0


def test_caps_of_repeated_ids_and_floats(spark):
    """Rows of one id with different vectors link by themselves; equal vectors of several ids are one node."""
    e, f, g = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(5, e), (5, f), (5, f), (7, g), (8, f), (3, [0.0, 0.0, 1.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect())
        assert got == [(3, 0, 3, True), (5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 5, False), (8, 2, 5, False)]


@pytest.mark.parametrize("n,width", [(50_000, 64), (3_000_000, 64), (15_000_000, 64), (3_000_000, 16), (500_000, 255), (50_000, 3)])
def test_caps_share_filters_at_any_size(n, width):
    """Pairs at the limit share CODES * SHARED filters on average, and hardly any pair shares none."""
    rng, m = np.random.default_rng(4), 400
    x, z = rng.normal(size=(2, m, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = caps.Code(n, width, 0.95)
    (r, f), (s, g) = code.decode(x), code.decode(0.95 * x + np.sqrt(1 - 0.95**2) * z)
    shared = np.bincount(np.intersect1d(r << 40 | f, s << 40 | g) >> 40, minlength=m)
    assert shared.mean() > 0.85 * caps.CODES * caps.SHARED and (shared > 0).mean() >= 0.98


@pytest.mark.parametrize("scale,chunk", [(False, 20_000), (True, 20_000), (False, 8), (False, 2)])
def test_neighbours(spark, scale, chunk):
    x, df = vectors(spark, 2, scale=scale)
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10, chunk=chunk).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, len(x), 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:10]
        assert len(found) == 10 and all(abs(v - s[i]) < 1e-9 for i, v in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hit += len({i for i, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(got)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, tables=1, probes=1).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in rows} == {(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


URLS = ["http://A.Example.com/en/x", "https://www.example.com/en/", "https://sub.www.example.com/en/1?q=/en/", "http://example.com", "http://example.com/EN/", "x.net/es/1", "ftp://a.net/es/1#/", "http://net/fr/", "http://notnet/fr/", "http://anet/fr/1", None, "", "://", "a://b://c.net/es/", "http://m.example.com?x=/en/", "http://b.net/es"]


def plain_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, "allow")))


def test_url_rules(spark):
    urls = [*URLS, *URLS[:3]]
    df = spark.createDataFrame(list(enumerate(urls[: len(URLS)])) + [(0, URLS[0])], "page_id long, url string").withColumn("key", F.lit(1))
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted(map(str, [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, rules).collect()]))
    assert got == sorted(map(str, [(i, *plain_rule(u, URL_RULES)) for i, u in [*enumerate(URLS), (0, URLS[0])]]))


def test_url_many_rules_and_none(spark):
    rules = [(f"h{i}.org", f"/{i % 7}", "block" if i % 2 else "allow") for i in range(300)]
    urls = [f"http://a.h{i}.org/{i % 5}x" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: plain_rule(u, rules) for i, u in enumerate(urls)}
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.url_filter(df, empty).collect()} == {"allow"}
    assert url_filter.url_filter(df.limit(0), empty).count() == 0


def test_bloom_lets_every_listed_key_through(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = url_filter.bloom_table(keys, 125)
    probe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 2000).alias("listed"))
    block, words = url_filter._probes(F.col("key"), 125)
    rows = probe.select("listed", block.alias("block"), *[w.alias(f"m{i}") for i, w in enumerate(words)]).join(bloom, "block", "left").collect()
    hit = [(r["listed"], all(r[f"w{i}"] is not None and r[f"w{i}"] & r[f"m{i}"] == r[f"m{i}"] for i in range(4))) for r in rows]
    assert all(h for own, h in hit if own) and np.mean([h for own, h in hit if not own]) < 0.02


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, at, data))
        assert out.columns == names and 0 < out.count() <= at.count()
        at = out
    assert at.where("text LIKE '%AKIA%'").count() == 0
    pieces = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, data) if none.columns == names else none
    assert none.count() == 0


@pytest.mark.parametrize("group", [simhash.GROUP, 5])
def test_near_dedup_is_exact_jaccard(spark, group):
    """Pairs on both sides of 0.8, sizes from four shingles up: the groups are those of brute force."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(240):
        n = int(rng.choice([8, 9, 12, 30, 64, 204, 404]))
        base = [f"w{w}" for w in rng.integers(0, 10**6, n)]
        texts.append(base)
        for _ in range(2):
            other = list(base)
            if n < 12 or k % 4 == 0:
                other = base[: int(n - rng.integers(1, max(2, n // 4)))]  # a beginning of it
            else:
                cut = int(n * rng.uniform(0.05, 0.2))
                other[n - cut :] = [f"v{w}" for w in rng.integers(0, 10**6, cut)]  # another end
            texts.append(other)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    root, close = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i // 3 * 3, i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            close += 0.65 <= both / all_ < 0.8
            if 5 * both >= 4 * all_:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.duplicate_groups(df, group=group).collect()}
    want = {i: r for i, r in enumerate(root) if i != r}
    assert close > 40 and len(want) > 100
    assert not [i for i in got if want.get(i) != got[i]]
    assert len(got) >= 0.99 * len(want)


def test_alike_pairs_against_brute_force():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(14, rng.integers(0, 14), replace=False).astype(np.uint64)) for _ in range(300)]
    root = list(range(len(sets)))
    for i, j in zip(*map(np.ndarray.tolist, simhash.alike_pairs(sets)), strict=True):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
        root = [root[i] if r == root[j] else r for r in root]
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert root[i] == root[j] or 5 * both < 4 * (len(sets[i]) + len(sets[j]) - both)
