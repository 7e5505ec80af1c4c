"""Language, quality, secrets, PPM, SimHash against brute force and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from posegrid.llm import lang_id, ppm, quality, secrets, simhash
from posegrid.llm.common import split_of, table

EDGES = [(900001, None), (900002, ""), (900003, "12 ## 34\n\n"), (900004, "word " * 30000), (None, "the and of")]


def with_edges(spark, data, columns="doc_id, text, lang"):
    docs = table(spark, data, "documents").selectExpr(*columns.split(", "))
    more = spark.createDataFrame(EDGES, "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True).unionByName(docs.limit(2))


def test_language(spark, data):
    docs = with_edges(spark, data).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    model = lang_id.fit(docs, split_of("id", 4) != 2)
    rows = lang_id.predict(docs, model).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, data, "documents").collect()}
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (900001, 900002, 900003):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len(set(model.labels)) == len(model.labels) and np.count_nonzero(model.table) < model.table.size


def test_language_without_labels(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang_id.fit(none, F.lit(True)) is None
    assert lang_id.predict(none, None).first()["lang_pred"] == "und"
    assert lang_id.predict(none.limit(0), None).count() == 0


def test_bounded_sample(spark):
    """The ids of least hash of each label, whether hashes are cut beforehand or not, and however often ids repeat."""
    from posegrid.llm.sampling import SPAN, bounded_sample

    rows = [(i, "a" if i % 3 else "b") for i in range(3000)] + [(7, "a")] * 5000 + [(None, "a"), (1, None), (5, "b")]
    df = spark.createDataFrame(rows, "k long, lang string").withColumn("place", F.lit(0))
    h = {r["k"]: r["h"] for r in df.where("k IS NOT NULL").select("k", F.pmod(F.xxhash64("k"), F.lit(SPAN)).alias("h")).distinct().collect()}
    for per_label in (20, 900, 5000):
        sample, counts = bounded_sample(df, "k", "lang", per_label)
        want = {}
        for label in "ba":
            own = sorted({k for k, x in rows if x == label and k is not None}, key=lambda k: (h[k], k))[:per_label]
            want |= {k: min(label, want.get(k, label)) for k in own}
        assert {r["sample_id"]: r["label"] for r in sample.collect()} == want and sample.count() == len(want)
        assert counts == {"a": 7000, "b": 1001}
    assert bounded_sample(df.limit(0), "k", "lang", 5)[0].count() == 0


def test_grams_stay_inside_their_text():
    texts = ["", "a", "ab", "abcd", "é日x", ""]
    hashed, starts, total = lang_id.grams(texts)
    for order, h in zip(lang_id.ORDERS, hashed):
        for t, s in zip(texts, starts):
            own = h[s : s + len(t)]
            assert (own[: max(0, len(t) - order + 1)] < 1 << lang_id.BITS).all() and (own[max(0, len(t) - order + 1) :] == 1 << lang_id.BITS).all()
    alone = lang_id.grams(["abcd"])[0]
    assert all((a == h[starts[3] : starts[3] + 4]).all() for a, h in zip(alone, hashed))
    assert total.tolist() == [0, 1, 3, 9, 6, 0]


def test_quality(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # the smallest tables have three bad documents in the held-out part
    docs, labels = with_edges(spark, data), table(spark, data, "labels")
    contradiction = spark.createDataFrame([(0, 0), (0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels.select("doc_id", "quality").unionByName(contradiction))
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(0 <= s <= 1 for s in rows.values()) and 900001 in rows


def test_quality_with_one_label(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs, model).collect()] == [1.0, 1.0]


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    counts, switch = np.array([3, 1, 4, 2]), rng.normal(size=(2, 2))
    emission = rng.normal(size=counts.sum())
    good, expected = quality.marginals(emission, counts, switch)
    at = 0
    for d, n in enumerate(counts):
        weight, want, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for m in range(2**n):
            y = [(m >> k) & 1 for k in range(n)]
            w = math.exp(sum(emission[at + k] * y[k] for k in range(n)) + sum(switch[y[k], y[k + 1]] for k in range(n - 1)))
            weight += w
            want += w * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w
        assert np.allclose(good[at : at + n], want / weight) and np.allclose(expected[d], pairs / weight)
        at += n


BASE = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in BASE.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


PARTS = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", '"', "'", " ", "é", "日", "0123456789abcdef", "AKIA", "ABCDEFGH01234567", "abcdef", "\n", "x9Q_z", "deadbeef" * 3, "passwd"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=5))
def test_base_spans(texts):
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = secrets.found(np.frombuffer(b"".join(raw), np.uint8), offs)
    for i, t in enumerate(texts):
        assert secrets.joined([s for s in got.get(i, []) if s[2] != "guess"]) == base_spans(t)


def test_guess_costs():
    easy = [b"password", b"Password1", b"20231231", b"aaaaaaaaaaaa", b"qwertyuiop", b"abcabcabcabc", b"letmein2024", b"12345678"]
    assert max(map(secrets.guess_cost, easy)) < secrets.MIN_COST < min(map(secrets.guess_cost, [b"tR7#kq9Lw2$x", b"zx81Kdm3Pw"]))
    assert secrets.guess_cost(b"") == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        v = bytes(rng.choice(list(b"abq1x9zZ"), rng.integers(1, 12)))
        assert secrets.guess_cost(v) <= sum(secrets._CARD[b] for b in v) + secrets.SPAN_COST + 1e-9


def plain_cost(value: bytes) -> float:
    """Least cost over all segmentations, every span priced by itself."""
    n, low = len(value), value.lower()
    card = secrets._CARD
    step = {(a, b) for row in secrets.KEY_ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}

    def price(a, b):
        v, size = value[a:b], b - a
        options = [sum(card[x] for x in v)]
        rank = secrets.RANK.get(low[a:b])
        if rank and size >= 3:
            capitals = sum(65 <= x < 91 for x in v)
            options.append(math.log10(rank + 1) + (0.3 if capitals in (1, size) else 0.3 * capitals))
        m = secrets.DATE.match(value, a)
        if m and m.end() == b:
            options.append(math.log10(119) + (math.log10(365) if size > 4 else 0))
        if size >= 3 and len(set(v)) == 1 and (not a or value[a - 1] != v[0]):
            options.append(card[v[0]] + math.log10(size))
        for p in range(2, 9):
            if size >= 2 * p and size % p == 0 and v == v[:p] * (size // p) and (a < p or value[a - p : a] != v[:p]) and value[b : b + p] != v[:p]:
                options.append(sum(card[x] for x in v[:p]) + math.log10(size / p))
        if size >= 3 and all((low[i], low[i + 1]) in step for i in range(a, b - 1)) and not (a and (low[a - 1], low[a]) in step):
            moves = [low[i + 1] - low[i] for i in range(a, b - 1)]
            options.append(math.log10(47 * size) + 0.5 * (1 + sum(x != y for x, y in zip(moves, moves[1:]))))
        return secrets.SPAN_COST + min(options)

    best = [0.0] + [math.inf] * n
    for b in range(1, n + 1):
        best[b] = min(best[a] + price(a, b) for a in range(b))
    return best[n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["pass", "Admin", "word", "1999", "2024-05", "aaa", "abab", "qwe", "asdf", "x", "9", "$", "Z", "é"]), max_size=7).map("".join))
def test_guess_cost_is_the_least_of_all_segmentations(text):
    value = text.encode()[:24]
    assert secrets.guess_cost(value) == pytest.approx(plain_cost(value))


def test_learned_words_are_cheap(spark):
    texts = [("secret: patience described", 1)] * 20 + [(None, 2), ("", 3), ("token: zq8Xw2Lp0vRt", 4)]
    df = spark.createDataFrame(texts, "text string, doc_id long").withColumn("word", F.lit("clash"))
    ranks = secrets.frequent_words(df)
    assert ranks[b"patience"] > len(secrets.WORDS) and ranks[b"password"] == 1
    assert secrets.scan(df, ranks).where("spans LIKE '%guess%'").count() == 0 < secrets.scan(df).where("spans LIKE '%guess%'").count()
    assert secrets.frequent_words(df.limit(0)) == secrets.RANK


def test_many_matches_in_a_long_text(spark):
    """Offsets are right, and work is linear, in a text of 20,000 contexts that isn't ASCII."""
    one = "é pwd: tR7#kq9Lw2$x; "
    data = np.frombuffer((one * 20_000).encode(), np.uint8)
    spans = secrets.found(data, np.array([0, len(data)]))[0]
    assert spans == [(len(one) * i + 7, len(one) * i + 19, "guess") for i in range(20_000)]


def test_scan_and_redact(spark):
    rows = [(1, "é pwd: tR7#kq9Lw2$x end"), (2, "token = abcdefghijkl"), (3, None), (4, "pwd: password1"), (None, ""), (1, "é pwd: tR7#kq9Lw2$x end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = secrets.scan(df).collect()
    assert [r["spans"] for r in got] == ["guess:7:19", "assign:0:20", "", "", "", "guess:7:19"]
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["n_assign"] == 1
    assert [r["text"] for r in secrets.redact(df).collect()] == ["é pwd: [REDACTED] end", "[REDACTED]", None, "pwd: password1", "", "é pwd: [REDACTED] end"]
    assert secrets.redact(df.limit(0)).count() == 0


def test_ppm_base_and_known(spark, data):
    docs = with_edges(spark, data, "doc_id, text")
    rows = ppm.score(docs, split_of("doc_id", 5) != 1).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b" "]) for r in docs.collect()]
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    c = Counter(w for i, t in texts if train(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for i, t in texts)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n} and all(r["score"] < 0 for r in rows)


def test_ppm_is_a_distribution_with_exclusion():
    docs = [b"abracadabra", b"abrupt", b"", b"banana band"]
    data, offs = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    order = 3
    seq, starts = ppm.symbols(data, offs, order)
    assert len(seq) == len(data) + len(docs) and starts.tolist() == [0, 12, 19, 20]
    levels = []
    for k in range(order + 1):
        c = Counter((seq & ((1 << (8 * (k + 1))) - 1)).tolist())
        u = np.array(sorted(c))
        levels.append((u >> 8, u & 255, np.array([c[x] for x in u.tolist()])))
    trie = ppm.Trie(levels)
    for context in (b"abr", b"zzz", b"\xff\xff\xff", b"xab", b"ban"):
        base = int.from_bytes(context, "big") << 8
        p = trie.probability(base + np.arange(256))
        assert p.sum() == pytest.approx(1) and (p > 0).all()
    # after "bra" only c and the end were seen; they share all but the escape
    p = trie.probability((int.from_bytes(b"bra", "big") << 8) + np.arange(256))
    assert p[ord("c")] == pytest.approx(0.25) and p[255] == pytest.approx(0.25)


def plain_ppm(train: list[bytes], texts: list[bytes], order: int) -> list[float]:
    """log10 probability of each text, symbol by symbol, from dictionaries of counts."""
    edge = b"\xff"
    counts: dict = {}
    for t in train:
        padded = edge * order + t.lower() + edge
        for at in range(order, len(padded)):
            for k in range(order + 1):
                own = counts.setdefault(padded[at - k : at], Counter())
                own[padded[at]] += 1

    def probability(context: bytes, symbol: int) -> float:
        below = (lambda s: probability(context[1:], s)) if context else (lambda s: 1 / 256)
        own = counts.get(context)
        if not own:
            return below(symbol)
        total = sum(own.values())
        if symbol in own:
            return (own[symbol] - 0.5) / total
        return 0.5 * len(own) / total * below(symbol) / (1 - sum(below(s) for s in own))

    out = []
    for t in texts:
        padded = edge * order + t.lower() + edge
        out.append(sum(math.log10(probability(padded[at - order : at], padded[at])) for at in range(order, len(padded))))
    return out


@pytest.mark.parametrize("order,block_bytes,hot", [(5, 12 << 20, 4_000_000), (5, 300, 20), (2, 300, 20), (0, 1000, 4_000_000)])
def test_ppm_equals_a_plain_one(spark, order, block_bytes, hot):
    """Small blocks split the documents, a small `hot` splits the shards."""
    rng = np.random.default_rng(1)
    words = ["the", "Then", "there", "abra", "cadabra", "é日", "x", "0", "a" * 40, "\n", "\xa0"]
    rows = [(i, None if i == 7 else " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)] + [(60, "the " * 400), (60, "the " * 400), (None, "Abra")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("block", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("train", F.lit("x"))
    own = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    texts = [(t or "").encode() for _, t in rows]
    want = plain_ppm([t for (i, _), t in zip(rows, texts) if own(i)], texts, order)
    got = ppm.score(df, split_of("doc_id", 5) != 1, order=order, block_bytes=block_bytes, hot=hot).collect()
    assert Counter((r["doc_id"], r["train"], round(r["score"], 6)) for r in got) == Counter((i, own(i), round(w, 6)) for (i, _), w in zip(rows, want))
    tokens = Counter(w for (i, _), t in zip(rows, texts) if own(i) for w in [*t.lower().split(), None])
    assert {r["train_tokens"] for r in got} == {sum(tokens.values())}
    known = Counter((i, len(t.split()) + 1, sum(tokens[w] > 0 for w in t.lower().split()) + 1) for (i, _), t in zip(rows, texts))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got) == known


def test_ppm_without_training(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ppm.score(df, F.lit(False)).collect()}
    assert rows[1]["base_score"] == 0 and rows[1]["n_known"] == 0 and rows[1]["score"] == pytest.approx(-3 * math.log10(256))
    assert rows[2]["n_tokens"] == 1
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0


def plain_components(fps, ids, budget):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= budget:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


def test_fingerprints():
    for text in ("", "One", "a b c d", "a b c d e a b c d e", "The the THE the the the"):
        w = text.encode().lower().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash.fingerprint(w) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [200_000, 3])
def test_trie_join_equals_brute_force(spark, hot):
    """With hot = 3 nearly all roots are split again."""
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for k in range(120):
        f = fps[rng.integers(0, len(fps))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    ids = list(range(10, 10 + len(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame(list(zip(signed, ids)), "fp long, rep long")
    links = simhash.near_links(reps, 4, hot)
    got = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    assert [got.get(i, i) for i in ids] == plain_components(fps, ids, 4)


def test_near_duplicates_and_nulls(spark, data):
    docs = with_edges(spark, data, "doc_id, text").withColumn("fp", F.lit("clash"))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None
    assert by[900002]["component_id"] == by[900001]["component_id"] == 900001 and by[900001]["fingerprint"] == "0" * 16
    known = [(r["doc_id"], int(r["fingerprint"], 16)) for r in rows if r["doc_id"] is not None]
    known = sorted(set(known))
    want = plain_components([f for _, f in known], [i for i, _ in known], 4)
    assert [by[i]["component_id"] for i, _ in known] == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_deduplication_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(60):  # one changed word of 120: similarity about 0.92
        w = list(base[k % 10])
        w[rng.integers(0, 120)] = "changed"
        rows.append((100 + k, " ".join(w)))
    rows += [(500, rows[20][1]), (501, None), (502, ""), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0))
    kept = [r["doc_id"] for r in simhash.deduplicated(df).collect()]
    assert sorted(i for i in kept if i is not None) == [*range(30), 501] and kept.count(None) == 2
