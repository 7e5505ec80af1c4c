"""Rankings, limits, set operations, text functions and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graphs, masks as M, retrieval
from .geometry import r6
from .registry import boxes, halves, masks, obs, pts, query, table


@query("w04_top3_per_truth", """
WITH p AS (SELECT l_partkey AS gt, l_orderkey AS pred, max(l_extendedprice) AS iou FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) AS k FROM p) SELECT gt, k, pred FROM r WHERE k <= 3""")
def top3_per_truth(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gt"), F.col("l_orderkey").alias("pred")).agg(F.max("l_extendedprice").alias("iou"))
    return p.withColumn("k", F.row_number().over(Window.partitionBy("gt").orderBy(F.desc("iou"), "pred"))).where("k <= 3").select("gt", "k", "pred")


@query("w08_exclusive_paint", """
WITH a AS (SELECT mask_id, count(*) AS area FROM masks GROUP BY 1), o AS (SELECT point_id, m.mask_id AS mask_id, row_number() OVER (PARTITION BY point_id ORDER BY area, m.mask_id DESC) AS k FROM masks m JOIN a USING (mask_id)),
w AS (SELECT mask_id, point_id FROM o WHERE k = 1), n AS (SELECT mask_id FROM w GROUP BY 1 HAVING count(*) >= 3) SELECT point_id, mask_id FROM w WHERE mask_id IN (SELECT mask_id FROM n)""", "masks")
def exclusive_paint(spark, d):
    """Large masks are painted first, so a point shows its smallest mask; slivers vanish afterwards."""
    m = masks(spark, d)
    own = M.owner(m.join(m.groupBy("mask_id").agg(F.count("*").alias("area")), "mask_id"), ["point_id"], [F.asc("area"), F.desc("mask_id")]).select("point_id", "mask_id")
    return own.join(own.groupBy("mask_id").agg(F.count("*").alias("n")).where("n >= 3"), "mask_id", "left_semi").select("point_id", "mask_id")


@query("w09_priority_ownership", """
WITH s AS (SELECT l_suppkey AS mask_id, l_partkey AS point_id, max(l_discount) AS score FROM lineitem GROUP BY 1, 2), a AS (SELECT mask_id, count(*) AS mass FROM s GROUP BY 1),
o AS (SELECT point_id, mask_id, row_number() OVER (PARTITION BY point_id ORDER BY round(score * pow(mass, 0.25), 9) DESC, mask_id) AS k FROM s JOIN a USING (mask_id)) SELECT point_id, mask_id FROM o WHERE k = 1""")
def priority_ownership(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("mask_id"), F.col("l_partkey").alias("point_id")).agg(F.max("l_discount").alias("score"))
    s = s.join(s.groupBy("mask_id").agg(F.count("*").alias("mass")), "mask_id").withColumn("v", F.round(F.col("score") * F.pow("mass", F.lit(0.25)), 9))
    return M.owner(s, ["point_id"], [F.desc("v"), F.asc("mask_id")]).select("point_id", "mask_id")


@query("w11_regular_gaps", """
WITH t AS (SELECT o_custkey AS g, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS gap FROM orders), m AS (SELECT g, quantile_cont(gap, 0.5) AS period FROM t WHERE gap IS NOT NULL GROUP BY 1)
SELECT t.g AS g, o_orderkey, round(gap, 4) AS gap, round(period, 4) AS period, round(abs(gap - period), 4) AS residual FROM t JOIN m USING (g) WHERE gap IS NOT NULL""")
def regular_gaps(spark, d):
    w = Window.partitionBy("g").orderBy("o_totalprice", "o_orderkey")
    t = table(spark, d, "orders").withColumnRenamed("o_custkey", "g").withColumn("gap", F.col("o_totalprice") - F.lag("o_totalprice").over(w)).where("gap IS NOT NULL")
    m = t.groupBy("g").agg(F.percentile("gap", F.lit(0.5)).alias("period"))
    return t.join(m, "g").select("g", "o_orderkey", F.round("gap", 4).alias("gap"), F.round("period", 4).alias("period"), F.round(F.abs(F.col("gap") - F.col("period")), 4).alias("residual"))


@query("w12_histogram_peaks", """
WITH h AS (SELECT p_brand AS g, floor((p_retailprice - 900) / 25)::BIGINT AS bin, count(*) AS n FROM part GROUP BY 1, 2),
s AS (SELECT g, bin, (0.25 * coalesce(lag(n) OVER w, 0) + 0.5 * n + 0.25 * coalesce(lead(n) OVER w, 0))::DOUBLE AS v FROM h WINDOW w AS (PARTITION BY g ORDER BY bin)),
p AS (SELECT *, coalesce(lag(v) OVER w, 0) AS before, coalesce(lead(v) OVER w, 0) AS after FROM s WINDOW w AS (PARTITION BY g ORDER BY bin)) SELECT g, bin, round(v, 6) AS v FROM p WHERE v > before AND v >= after""")
def histogram_peaks(spark, d):
    h = table(spark, d, "part").groupBy(F.col("p_brand").alias("g"), F.floor((F.col("p_retailprice") - 900) / 25).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy("bin")
    zero = F.lit(0)
    s = h.withColumn("v", 0.25 * F.coalesce(F.lag("n").over(w), zero) + 0.5 * F.col("n") + 0.25 * F.coalesce(F.lead("n").over(w), zero))
    p = s.withColumn("before", F.coalesce(F.lag("v").over(w), F.lit(0.0))).withColumn("after", F.coalesce(F.lead("v").over(w), F.lit(0.0)))
    return p.where("v > before AND v >= after").select("g", "bin", r6("v").alias("v"))


@query("w15_clear_owner", """
WITH s AS (SELECT user_id AS scene, event_type AS owner, sum(value) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS rival FROM s WINDOW w AS (PARTITION BY scene ORDER BY score DESC, owner))
SELECT scene, owner FROM r WHERE k = 1 AND score >= 1.5 * coalesce(rival, 0)""")
def clear_owner(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("scene"), F.col("event_type").alias("owner")).agg(F.sum("value").alias("score"))
    w = Window.partitionBy("scene").orderBy(F.desc("score"), "owner")
    return s.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("score").over(w)).where((F.col("k") == 1) & (F.col("score") >= 1.5 * F.coalesce("rival", F.lit(0.0)))).select("scene", "owner")


@query("w16_best_proposal", """
WITH q AS (SELECT l_suppkey AS owner, l_partkey AS proposal, count(DISTINCT l_orderkey) AS frames, max(l_quantity) AS conf FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY frames DESC, conf DESC, proposal) AS k FROM q) SELECT owner, proposal, frames, conf FROM r WHERE k = 1""")
def best_proposal(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("proposal")).agg(F.countDistinct("l_orderkey").alias("frames"), F.max("l_quantity").alias("conf"))
    w = Window.partitionBy("owner").orderBy(F.desc("frames"), F.desc("conf"), "proposal")
    return q.withColumn("k", F.row_number().over(w)).where("k = 1").select("owner", "proposal", "frames", "conf")


@query("l01_score_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def score_order(spark, d):
    """A total order by sorting: positions come from sorted partitions and their offsets, never from one task."""
    return _places(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", "place")


def _places(df, order):
    """Global row numbers: range partitions, numbered inside, shifted by the sizes of those before."""
    ranged = graphs.settled(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").count()  # one row per partition
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("place", F.col("inside") + F.col("shift"))


@query("l02_size_rank", "SELECT brand, id, row_number() OVER (PARTITION BY brand ORDER BY size DESC, id) AS place FROM boxes", "boxes")
def size_rank(spark, d):
    return boxes(spark, d).select("brand", "id", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("size"), "id")).alias("place"))


@query("l03_every_nth", """
WITH p AS (SELECT user_id AS scene, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), q AS (SELECT scene, event_id, row_number() OVER (PARTITION BY scene ORDER BY event_id) AS k FROM p WHERE event_id % 5 = 0)
SELECT 'position' AS kind, scene, event_id FROM p WHERE i % 5 = 0 AND i // 5 < 4 UNION ALL SELECT 'id', scene, event_id FROM q WHERE k <= 4""")
def every_nth(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("scene"), "event_id", "ts")
    p = e.withColumn("i", F.row_number().over(Window.partitionBy("scene").orderBy("ts", "event_id")) - 1).where("i % 5 = 0 AND i div 5 < 4")
    q = e.where("event_id % 5 = 0").withColumn("k", F.row_number().over(Window.partitionBy("scene").orderBy("event_id"))).where("k <= 4")
    return p.select(F.lit("position").alias("kind"), "scene", "event_id").unionByName(q.select(F.lit("id").alias("kind"), "scene", "event_id"))


@query("l04_top_distances", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_distances(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("l05_nearest_share", "WITH q AS (SELECT o_custkey AS g, quantile_cont(o_totalprice, 0.8) AS q FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN q ON o_custkey = g WHERE o_totalprice <= q")
def nearest_share(spark, d):
    o = table(spark, d, "orders")
    q = o.groupBy(F.col("o_custkey").alias("g")).agg(F.percentile("o_totalprice", F.lit(0.8)).alias("q"))
    return o.join(q, F.col("o_custkey") == F.col("g")).where("o_totalprice <= q").select("o_orderkey")


@query("l06_halved_clouds", """
WITH r AS (SELECT l_suppkey AS g, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT g, l_orderkey, l_linenumber, l_partkey FROM r WHERE n <= 600 OR i % 2 = 1""")
def halved_clouds(spark, d):
    w = Window.partitionBy("g")
    r = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "g").withColumn("i", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))).withColumn("n", F.count("*").over(w))
    return r.where("n <= 600 OR i % 2 = 1").select("g", "l_orderkey", "l_linenumber", "l_partkey")


@query("l07_quantile_trim", "WITH q AS (SELECT g, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM pts GROUP BY 1) SELECT pts.g AS g, id FROM pts JOIN q USING (g) WHERE x >= lo AND x <= hi", "pts")
def quantile_trim(spark, d):
    p = pts(spark, d)
    q = p.groupBy("g").agg(*[F.percentile("x", F.lit(v)).alias(n) for n, v in (("lo", 0.05), ("hi", 0.95))])
    return p.join(q, "g").where("x >= lo AND x <= hi").select("g", "id")


@query("u01_bag_union", "SELECT g, id FROM pts WHERE id % 2 = 0 UNION ALL SELECT g, id FROM pts WHERE id % 3 = 0", "pts")
def bag_union(spark, d):
    p = pts(spark, d).select("g", "id")
    return p.where("id % 2 = 0").unionByName(p.where("id % 3 = 0"))


@query("u02_frame_sets", """
WITH s AS (SELECT DISTINCT l_suppkey AS g, l_partkey % 50 AS f FROM lineitem), n AS (SELECT g, count(*) AS n FROM s GROUP BY 1), b AS (SELECT p.g AS a, q.g AS b, count(*) AS both_ FROM s p JOIN s q ON p.f = q.f AND p.g + 1 = q.g GROUP BY 1, 2)
SELECT a, b, both_, p.n + q.n - both_ AS either, true AS meet FROM b JOIN n p ON p.g = a JOIN n q ON q.g = b""")
def frame_sets(spark, d):
    """A group's set holds at most 50 values, so sets are arrays."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.collect_set(F.col("l_partkey") % 50).alias("f"))
    pairs = s.select(F.col("g").alias("a"), (F.col("g") + 1).alias("b"), F.col("f").alias("p")).join(s.select(F.col("g").alias("b"), F.col("f").alias("q")), "b")
    return pairs.where(F.arrays_overlap("p", "q")).select("a", "b", F.size(F.array_intersect("p", "q")).cast("bigint").alias("both_"), F.size(F.array_union("p", "q")).cast("bigint").alias("either"), F.lit(True).alias("meet"))


@query("u03_voxel_intersection", "SELECT floor(x / 0.1)::BIGINT AS cx FROM pts WHERE g < 5 INTERSECT SELECT floor(x / 0.1)::BIGINT FROM pts WHERE g >= 5", "pts")
def voxel_intersection(spark, d):
    p = pts(spark, d).select("g", S.cell(F.col("x"), 0.1).alias("cx"))
    return p.where("g < 5").select("cx").intersect(p.where("g >= 5").select("cx"))


@query("u04_survivors", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def survivors(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("u05_mask_repair", """
WITH a AS (SELECT * FROM masks WHERE mask_id % 2 = 0 OR point_id % 3 = 0), b AS (SELECT * FROM masks WHERE point_id % 2 = 0)
SELECT 'union' AS mode, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'supplement', (SELECT count(*) FROM a) + (SELECT count(*) FROM b WHERE mask_id NOT IN (SELECT mask_id FROM a))""", "masks")
def mask_repair(spark, d):
    m = masks(spark, d)
    a, b = m.where("mask_id % 2 = 0 OR point_id % 3 = 0"), m.where("point_id % 2 = 0")
    out = None
    for mode in ("union", "intersection", "supplement"):
        n = M.repaired(a, b, mode).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("u06_evidence_refine", "SELECT l_orderkey, l_linenumber, (l_returnflag = 'R' AND NOT l_linestatus = 'O') OR l_discount > 0.08 AS kept FROM lineitem")
def evidence_refine(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (((F.col("l_returnflag") == "R") & ~(F.col("l_linestatus") == "O")) | (F.col("l_discount") > 0.08)).alias("kept"))


@query("u07_vocabulary", "WITH v AS (SELECT lower(p_type) AS name FROM part UNION SELECT lower(p_brand) FROM part) SELECT name FROM v WHERE name NOT IN ('wall', 'floor', 'ceiling')")
def vocabulary(spark, d):
    p = table(spark, d, "part")
    v = p.select(F.lower("p_type").alias("name")).unionByName(p.select(F.lower("p_brand").alias("name"))).distinct()
    return v.where(~F.col("name").isin("wall", "floor", "ceiling"))


@query("f01_normal_names", r"SELECT p_partkey, trim(regexp_replace(lower(translate(p_name || '_' || p_type, '_', ' ')), '\s+', ' ', 'g')) AS name FROM part")
def normal_names(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normal_name(F.concat_ws("_", "p_name", "p_type")).alias("name"))


@query("f03_json_reply", r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_reply(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.from_json(S.without_fence(fenced), "k bigint", {"allowUnquotedControlChars": "true"})["k"].alias("k"))


@query("f04_reply_parse", """
SELECT conv_id, max(turn) AS turns, string_agg(text, '' ORDER BY turn) AS said FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1""")
def reply_parse(spark, d):
    """Parts of one reply, joined in order; a conversation is bounded."""
    c = table(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.max("turn").alias("turns"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("said"))


@query("f05_head_noun", "SELECT p_partkey, split_part(replace(p_type, '-', ' '), ' ', -1) AS head, split_part(replace(p_type, '-', ' '), ' ', -1) IN ('STEEL', 'BRASS') AS surface FROM part")
def head_noun(spark, d):
    head = F.element_at(F.split(F.regexp_replace("p_type", "-", " "), " "), -1)
    return table(spark, d, "part").select("p_partkey", head.alias("head"), head.isin("STEEL", "BRASS").alias("surface"))


@query("f08_fingerprints", "SELECT n_nationkey, sha256('{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}') AS print FROM nation")
def fingerprints(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))), 256).alias("print"))


@query("f10_title_tags", "SELECT DISTINCT event_type AS tag, upper(substr(trim(event_type), 1, 1)) || lower(substr(trim(event_type), 2)) AS title FROM events")
def title_tags(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("tag"), F.initcap(F.trim("event_type")).alias("title")).distinct()


@query("f11_path_ids", r"SELECT page_id, regexp_extract(url, '/(\d+)', 1) AS number, regexp_matches(url, '^https?://[^/]+/en/') AS english FROM pages")
def path_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("number"), F.col("url").rlike("^https?://[^/]+/en/").alias("english"))


@query("f13_prefix_names", "SELECT DISTINCT p_brand, split_part(p_brand, '#', 1) AS prefix, split_part(p_brand, '#', 2) AS suffix FROM part")
def prefix_names(spark, d):
    return table(spark, d, "part").select("p_brand", F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("prefix"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("suffix")).distinct()


@query("f14_token_subsets", """
WITH d AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT p_type || ' ' || p_brand FROM part), t AS (SELECT name, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '')) AS k FROM d), b AS (SELECT DISTINCT lower(p_brand) AS brand, lower(p_type) AS type FROM part)
SELECT a.name AS a, t.name AS b FROM t a JOIN t ON len(list_filter(a.k, lambda x: NOT list_contains(t.k, x))) = 0 AND len(t.k) > len(a.k)""".replace(", b AS (SELECT DISTINCT lower(p_brand) AS brand, lower(p_type) AS type FROM part)", ""))
def token_subsets(spark, d):
    """Candidates share the rarer name's first token; the strict subset test follows."""
    p = table(spark, d, "part")
    names = p.select(F.col("p_type").alias("name")).unionByName(p.select(F.concat_ws(" ", "p_type", "p_brand").alias("name"))).distinct()
    t = names.withColumn("k", S.tokens(F.col("name")))
    a = t.select(F.col("name").alias("a"), F.col("k").alias("p"), F.col("k")[0].alias("token"))
    b = t.select(F.col("name").alias("b"), F.col("k").alias("q"), F.explode("k").alias("token"))
    return a.join(b, "token").where(S.strict_subset(F.col("p"), F.col("q"))).select("a", "b")


@query("f15_keyword_family", "SELECT p_partkey, len(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x IN ('steel', 'brass', 'tin'))) > 0 AS family FROM part")
def keyword_family(spark, d):
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(S.tokens(F.col("p_type")), F.array(*[F.lit(v) for v in ("steel", "brass", "tin")])).alias("family"))


@query("f16_id_colours", "SELECT o_orderkey, (o_orderkey % 255)::INT AS r, ((o_orderkey // 255) % 255)::INT AS g, ((o_orderkey // 65025) % 255)::INT AS b, o_orderkey AS back FROM orders")
def id_colours(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for c, n in zip(S.id_colour(F.col("o_orderkey")), "rgb", strict=True)])
    return o.withColumn("back", S.colour_id(F.col("r"), F.col("g"), F.col("b")))


@query("f17_mask_bits", "SELECT o_orderkey, ((o_custkey % 256) >> (7 - o_orderkey % 8)::INT) & 1 AS bit FROM orders")
def mask_bits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.mask_bit(F.col("o_custkey") % 256, F.col("o_orderkey")).cast("bigint").alias("bit"))


@query("f18_math", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity) + sqrt(l_extendedprice) + exp(-l_tax), 6) AS v, floor(l_quantity / 7)::BIGINT AS f, greatest(least(l_discount, 0.08), 0.02) AS clipped FROM lineitem")
def math(spark, d):
    v = F.log(1 + F.col("l_quantity")) + F.sqrt("l_extendedprice") + F.exp(-F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(v).alias("v"), F.floor(F.col("l_quantity") / 7).alias("f"), F.greatest(F.least("l_discount", F.lit(0.08)), F.lit(0.02)).alias("clipped"))


@query("f20_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("c15_resolved_aliases", """
WITH RECURSIVE e AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey // 2 END AS t FROM customer WHERE c_custkey > 0), r AS (SELECT s, t FROM e UNION ALL SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)
SELECT s AS source, arg_min(t, t) AS target FROM r WHERE t = -1 OR t NOT IN (SELECT s FROM e) GROUP BY 1""")
def resolved_aliases(spark, d):
    c = F.col("c_custkey")
    return graphs.resolve(table(spark, d, "customer").where("c_custkey > 0").select(c.alias("source"), F.when(c % 7 == 0, F.lit(-1)).otherwise(F.floor(c / 2)).cast("bigint").alias("target")))


@query("c14_components", """
WITH RECURSIVE n AS (SELECT id FROM pts), e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) < 0.05),
r AS (SELECT id, id AS low FROM n UNION SELECT e.a, r.low FROM r JOIN e ON r.id = e.b WHERE r.low < e.a) SELECT id, min(low) AS component FROM r GROUP BY 1""", "pts")
def components(spark, d):
    from ..operators import spatial

    p = pts(spark, d)
    return graphs.connected(p.select("id"), spatial.near_pairs(p, 0.05, "id").select("a", "b"))


@query("c16_anchor_groups", """
WITH RECURSIVE n AS (SELECT id FROM pts), e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.z - b.z) <= 0.008 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.08),
r AS (SELECT id, id AS low FROM n UNION SELECT e.a, r.low FROM r JOIN e ON r.id = e.b WHERE r.low < e.a) SELECT id, min(low) AS component FROM r GROUP BY 1""", "pts")
def anchor_groups(spark, d):
    from ..operators import spatial

    p = pts(spark, d)
    pairs = spatial.range_join(p.select(F.col("id").alias("a"), *"xyz"), p.select(F.col("id").alias("b"), *"xyz"), 0.0805)
    flat = S.distance([F.col("x"), F.col("y")], [F.col("rx"), F.col("ry")])
    return graphs.connected(p.select("id"), pairs.where((F.col("a") < F.col("b")) & (F.abs(F.col("z") - F.col("rz")) <= 0.008) & (flat <= 0.08)).select("a", "b"))


@query("t06_confirmed_tracks", "SELECT scene, label, count(DISTINCT frame) AS frames, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(DISTINCT frame) >= 2 AND count(*) >= 3", "obs")
def confirmed_tracks(spark, d):
    return obs(spark, d).groupBy("scene", "label").agg(F.countDistinct("frame").alias("frames"), F.count("*").alias("n")).where("frames >= 2 AND n >= 3")


@query("z01_categories", """
SELECT lower(p_type) AS name, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS descriptions, arg_max(p_name, p_partkey) AS legacy FROM part WHERE lower(p_type) NOT IN ('wall', 'floor', 'ceiling') GROUP BY 1""")
def categories(spark, d):
    p = table(spark, d, "part").where(~F.lower("p_type").isin("wall", "floor", "ceiling"))
    return p.groupBy(F.lower("p_type").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "; ").alias("descriptions"), F.max_by("p_name", "p_partkey").alias("legacy"))


@query("z02_area_filter", "SELECT p_partkey FROM part WHERE p_size > 0 AND p_size < 0.8 * 50 AND isfinite(p_retailprice)")
def area_filter(spark, d):
    return table(spark, d, "part").where("p_size > 0 AND p_size < 0.8 * 50 AND NOT isnan(p_retailprice) AND abs(p_retailprice) < double('inf')").select("p_partkey")


@query("z06_mask_choice", "SELECT l_orderkey, arg_max(l_linenumber, (l_quantity - 100 * l_tax, -l_linenumber)) AS choice FROM lineitem GROUP BY 1")
def mask_choice(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(F.col("l_quantity") - 100 * F.col("l_tax"), F.negative("l_linenumber"))).alias("choice"))


@query("z07_grid_points", "WITH i AS (SELECT unnest(range(4)) AS i), j AS (SELECT unnest(range(4)) AS j) SELECT id, i, j, round(lox + (i + 0.5::DOUBLE) * (hix - lox) / 4, 6) AS u, round(loy + (j + 0.5::DOUBLE) * (hiy - loy) / 4, 6) AS v FROM boxes, i, j", "boxes")
def grid_points(spark, d):
    four = F.array(*[F.lit(k).cast("bigint") for k in range(4)])
    b = boxes(spark, d).withColumn("i", F.explode(four)).withColumn("j", F.explode(four))
    at = lambda k, a: r6(F.col(f"lo{a}") + (F.col(k) + 0.5) * (F.col(f"hi{a}") - F.col(f"lo{a}")) / 4)
    return b.select("id", "i", "j", at("i", "x").alias("u"), at("j", "y").alias("v"))


@query("z10_cross_frame_retrieval", """
WITH s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.textual, b.textual), 9) AS score FROM halves a JOIN halves b ON a.g <> b.g WHERE a.id % 25 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s) SELECT a, k, b FROM r WHERE k <= 3""", "halves")
def cross_frame_retrieval(spark, d):
    """A stated query set against all rows, in blocks that hand on their best three."""
    h = halves(spark, d).select("id", F.col("g").alias("group"), F.col("textual").alias("vector"))
    return retrieval.top_scores(h.where("id % 25 = 0"), h, 3).select("a", "k", "b")


@query("z11_pixel_boxes", "SELECT p_partkey AS id, round(p_size / 1000.0 * 640, 6) AS left_, round(p_retailprice / 3000.0 * 480, 6) AS top_ FROM part")
def pixel_boxes(spark, d):
    made = F.to_json(F.struct(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 3).alias("xy")))
    parsed = F.from_json(made, "xy array<double>")["xy"]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(parsed[0] / 1000 * 640).alias("left_"), r6(parsed[1] / 1000 * 480).alias("top_"))
