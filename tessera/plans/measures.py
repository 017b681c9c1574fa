"""Queries of census, scaling and contrast over the testbed, through operators/measures.py, with SQL written on its own."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import measures as ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name):
    return F.round(c, 6).alias(name)


def cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("sample")).agg(F.avg("value").alias("v"))


def filter_cascade(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.min("p_name").alias("name"))
    rows = table(spark, sf_dir, "lineitem").join(names, "l_partkey", "left")
    stages = [("type", F.col("l_returnflag") != "R"), ("exemplar", F.col("l_linestatus") == "O"), ("plate", None), ("activity", F.col("l_discount") >= 0.02), ("structure", ms.valued("name").isNotNull())]
    out = ms.cascade(rows, "l_partkey", stages)
    return out.select("stage_no", "stage", F.col("rows").alias("signatures"), F.col("items").alias("compounds"), "note")


def tas_sweep(spark, sf_dir):
    """The discount, 0 to 0.10, five times over, stands for an activity of 0 to 0.50."""
    rows = table(spark, sf_dir, "lineitem").withColumn("tas", F.round(F.col("l_discount") * 5, 2))
    return ms.sweep(rows, "l_partkey", "tas", [k / 20 for k in range(11)]).withColumnsRenamed({"rows": "signatures", "items": "compounds"})


def min_group_size(spark, sf_dir):
    return ms.depths(table(spark, sf_dir, "lineitem"), "l_partkey").where("n >= 30").withColumnRenamed("n", "depth")


def profile_depth_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return ms.depth_stats(ms.depths(lines, "p_partkey", table(spark, sf_dir, "part")))


def capped_depth(spark, sf_dir):
    each = ms.depths(table(spark, sf_dir, "lineitem"), "l_partkey")
    return each.agg(F.sum(F.least(F.col("n"), F.lit(30))).alias("kept"), F.sum("n").alias("total"))


def annotation_coverage(spark, sf_dir):
    got = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return ms.coverage(got, ["lang", "source", "quality", "toxic"])


def placeholder_nulling(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ms.valued(F.when(F.col("p_size") % 5 == 0, F.lit(" -666 ")).when(F.col("p_size") % 7 == 0, "NaN").otherwise(F.col("p_type"))).alias("target"))


def alias_resolution(spark, sf_dir):
    known = ms.aliases((table(spark, sf_dir, "nation"), "n_name", "n_nationkey"), (table(spark, sf_dir, "region"), "r_name", "r_regionkey"))
    asked = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.upper("n_name").alias("alias"))
    return asked.join(known, "alias").select("c_custkey", F.col("id").alias("gene"))


def dose_parse(spark, sf_dir):
    text = F.when(F.col("event_id") % 11 == 0, "none").otherwise(F.concat(F.round("value", 2).cast("string"), F.lit(" uM")))
    dose, time = ms.number(text), ms.number(F.when(F.col("event_id") % 4 > 0, F.concat((F.col("event_id") % 4 * 6).cast("string"), F.lit(" h"))))
    got = table(spark, sf_dir, "events").select("event_id", dose.alias("dose"), time.alias("time"))
    return got.select("event_id", r6(ms.log_scaled(F.col("dose"), 0), "log_dose"), r6(ms.log_scaled(F.col("time"), 24), "log_time"), F.col("dose").isNotNull().alias("has_dose"), r6(ms.unlogged(ms.log_scaled(F.col("dose"), 0)), "back"))


def log_dose_round_trip(spark, sf_dir):
    got = table(spark, sf_dir, "events").select("event_id", F.col("value").isNotNull().alias("has_dose"), ms.log_scaled(F.abs("value"), 0).alias("l"))
    return got.select("event_id", "has_dose", r6(F.col("l"), "log_dose"), F.round(ms.unlogged(F.col("l")), 4).alias("dose"))


def truthy_filter(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(x) for x in ("0", "1", "yes", "no", "True", "t")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ms.truthy(word)).alias("kept"))


def multi_value_split(spark, sf_dir):
    got = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_name", F.lit(""), "p_brand", F.lit("")).alias("targets"))
    return got.select(F.explode(ms.many("targets")).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def robust_z_pooled(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    got = rows.join(F.broadcast(ms.spread(rows, ["event_type"], "value")), "event_type")  # a row an event type
    return got.select("event_id", r6(ms.robust_z(F.col("value"), F.col("median"), F.col("mad")), "z"))


def robust_z_per_gene(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    control = ms.spread(rows.where("event_type = 'view'"), ["user_id"], "value")
    treated = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.avg("value").alias("v"))
    return treated.join(control, "user_id").select("user_id", F.round(ms.robust_z(F.col("v"), F.col("median"), F.col("mad")), 4).alias("z"))


def robust_z_rows(spark, sf_dir):
    got = ms.robust_rows(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")))
    return got.select("vec_id", F.posexplode("vec").alias("pos", "z")).select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("z"), "z"))


def genes(spark, sf_dir) -> DataFrame:
    """Every user, and ten genes that no event names."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("gene")).unionByName(spark.range(1_000_000, 1_000_010).toDF("gene"))


def reindex_fill(spark, sf_dir):
    return ms.filled(cells(spark, sf_dir), genes(spark, sf_dir)).select("gene", "sample", r6(F.col("v"), "v"))


def zscore_rows(spark, sf_dir):
    return ms.zscores(cells(spark, sf_dir), genes(spark, sf_dir)).select("gene", "sample", r6(F.col("z"), "z"))


def query_profile(spark, sf_dir):
    return ms.profile(cells(spark, sf_dir)).select("sample", *[r6(F.col(c), c) for c in ("mean", "sd", "top", "negative")], "raw", "spread_ok")


def coverage_guard(spark, sf_dir):
    got = genes(spark, sf_dir).distinct().join(ms.present(cells(spark, sf_dir)), "gene", "left")
    share = F.avg(F.coalesce("present", F.lit(False)).cast("int").cast("double"))
    return got.agg(r6(share, "present"), (share >= 0.5).alias("accepted"))


def contrast_log2(spark, sf_dir):
    t, c = (cells(spark, sf_dir).where(F.col("sample") == s).select("gene", F.log2(F.when(F.col("v") >= 0, F.col("v")) + 1).alias(n)) for s, n in (("purchase", "t"), ("view", "c")))
    return t.join(c, "gene").select("gene", r6(F.col("t") - F.col("c"), "delta"))


def spearman_by_group(spark, sf_dir):
    got = ms.spearman(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice")
    return got.select("l_suppkey", r6(F.col("rho"), "rho"))


def contrast_reliability(spark, sf_dir):
    side = F.when(F.col("event_type") == "purchase", "treated").otherwise("control")
    got = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')").groupBy(F.col("user_id").alias("gene"), side.alias("side"), (F.col("event_id") % 3).alias("rep")).agg(F.avg("value").alias("v"))
    return ms.reliability(got).select("k", "pairings", r6(F.col("single"), "single"), r6(F.col("stepped"), "spearman_brown"), "verdict")


def contrast_reliability_unequal(spark, sf_dir):
    """Four treated replicates against three controls: the first three of each side are used, genes must be in all seven."""
    treated = F.col("event_type") == "purchase"
    got = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')").groupBy((F.col("user_id") % 40).alias("gene"), F.when(treated, "treated").otherwise("control").alias("side"), F.when(treated, F.col("event_id") % 4).otherwise(F.col("event_id") % 3).alias("rep")).agg(F.avg("value").alias("v"))
    return ms.reliability(got).select("k", "pairings", r6(F.col("single"), "single"), r6(F.col("stepped"), "spearman_brown"), "verdict")


def group_statistics(spark, sf_dir):
    return ms.group_statistics(table(spark, sf_dir, "part"), "p_name")


def uncovered_compounds(spark, sf_dir):
    train = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(train, "p_partkey", "left_anti")


def standard_scaler(spark, sf_dir):
    got = ms.scaler(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], F.md5(F.col("p_partkey").cast("string")) < "c")
    return got.select("p_partkey", r6(F.col("p_size"), "size"), r6(F.col("p_retailprice"), "price"))


def annotation_pairs(spark, sf_dir):
    got = ms.later_siblings(table(spark, sf_dir, "part"), "p_partkey", [["p_brand", "p_type", "p_size"], ["p_name", "p_size"]])
    return got.select(F.col("p_partkey").alias("x"), "siblings")


def shared_targets(spark, sf_dir):
    """Nations that share a segment with at least 30 customers each: lists that overlap."""
    got = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    return ms.shared_values(got, "c_nationkey", "segments")


def eligible_intersection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, b = (ms.depths(lines.where(c), "l_partkey").where("n >= 4").select("l_partkey") for c in ("l_quantity >= 10", "l_discount >= 0.02"))
    return a.intersect(b)


def learning_rate(spark, sf_dir):
    """Every event is a step, of which the first 500 warm up."""
    got = ms.learning_rate(table(spark, sf_dir, "events").select(F.col("event_id").alias("step")), 500, 5000)
    return got.select("step", F.round("scale", 6).alias("scale"))


def size_estimate(spark, sf_dir):
    return ms.sizes(table(spark, sf_dir, "lineitem"))


def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ms.human_size((F.col("o_orderkey") * F.col("o_orderkey") * 977).cast("long")).alias("size"))


def first_seen_codes(spark, sf_dir):
    got = ms.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")
    return got


def filter_by_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("split", F.when(F.md5(F.col("l_partkey").cast("string")) < "c", "train").otherwise("test"))
    return ms.filtered_by_split(rows, "split", "l_partkey", F.col("l_quantity") > 40, only="train")[1]


def finite_vectors(spark, sf_dir):
    bad = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 9 == 0) & (i == 5), F.lit(float("nan"))).otherwise(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", bad.alias("vec")).select("vec_id", ms.finite("vec").alias("finite"))


NAMES = """filter_cascade tas_sweep min_group_size profile_depth_stats capped_depth annotation_coverage placeholder_nulling
alias_resolution dose_parse log_dose_round_trip truthy_filter multi_value_split robust_z_pooled robust_z_per_gene robust_z_rows
reindex_fill zscore_rows query_profile coverage_guard contrast_log2 spearman_by_group contrast_reliability contrast_reliability_unequal group_statistics
uncovered_compounds standard_scaler annotation_pairs shared_targets eligible_intersection learning_rate size_estimate human_sizes
first_seen_codes filter_by_split finite_vectors""".split()
QUERIES = {n: globals()[n] for n in NAMES}

# ---- SQL ----
CELL = "cell AS (SELECT user_id AS gene, event_type AS sample, avg(value) AS v FROM events GROUP BY user_id, event_type)"
GENES = "g AS (SELECT DISTINCT user_id::BIGINT AS gene FROM events UNION ALL SELECT unnest(range(1000000, 1000010)))"
GRID = f"{CELL}, {GENES}, s AS (SELECT DISTINCT event_type AS sample FROM events), full_ AS (SELECT g.gene, s.sample, coalesce(c.v, 0) AS v FROM g CROSS JOIN s LEFT JOIN cell c ON c.gene = g.gene AND c.sample = s.sample)"
VALID = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('restricted', 'nan', '', 'none', '-666') THEN {c} END"
LINES = "x AS (SELECT l_partkey AS pid, l_returnflag <> 'R' AS a, l_linestatus = 'O' AS b, l_discount >= 0.02 AS c, lower(trim(p_name)) NOT IN ('restricted', 'nan', '', 'none', '-666') AS d FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name FROM part GROUP BY p_partkey) ON l_partkey = p_partkey)"
ORACLES = {
    "filter_cascade": f"WITH {LINES} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS stage_no, '{n}' AS stage, count(*) AS signatures, count(DISTINCT pid) AS compounds, '{note}' AS note FROM x WHERE {c}" for k, (n, c, note) in enumerate((("type", "a", ""), ("exemplar", "a AND b", ""), ("plate", "a AND b", "skipped"), ("activity", "a AND b AND c", ""), ("structure", "a AND b AND c AND d", "")), 1)),
    "tas_sweep": "SELECT t / 20.0::DOUBLE AS threshold, count(*) FILTER (round(l_discount * 5, 2) >= t / 20.0::DOUBLE) AS signatures, count(DISTINCT l_partkey) FILTER (round(l_discount * 5, 2) >= t / 20.0::DOUBLE) AS compounds FROM lineitem, range(11) r(t) GROUP BY t",
    "min_group_size": "SELECT l_partkey, count(*) AS depth FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30",
    "profile_depth_stats": "WITH d AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey) SELECT " + ", ".join(f"round(quantile_cont(n, {q}), 6) AS p{round(100 * q)}" for q in ms.QUANTILES) + ", max(n) AS largest, " + ", ".join(f"count(*) FILTER (n >= {s}) AS ge{s}" for s in ms.SIZES) + " FROM d",
    "capped_depth": "SELECT CAST(sum(least(n, 30)) AS BIGINT) AS kept, CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)",
    "annotation_coverage": "WITH j AS (SELECT lang::VARCHAR AS lang, source::VARCHAR AS source, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({VALID(c)}) AS filled, round(count({VALID(c)}) / count(*)::DOUBLE, 6) AS fraction, count(DISTINCT {VALID(c)}) AS kinds FROM j""" for c in ("lang", "source", "quality", "toxic")),
    "placeholder_nulling": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN NULL ELSE p_type END AS target FROM part",
    "alias_resolution": "WITH a AS (SELECT upper(trim(n_name)) AS alias, n_nationkey AS id, 0 AS prio FROM nation UNION ALL SELECT upper(trim(r_name)), r_regionkey, 1 FROM region) SELECT c_custkey, CAST(a.id AS BIGINT) AS gene FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT * FROM a WHERE alias NOT IN ('', '-') QUALIFY row_number() OVER (PARTITION BY alias ORDER BY prio, id) = 1) a ON a.alias = upper(n_name)",
    "dose_parse": "WITH x AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN round(value, 2) END AS dose, CASE WHEN event_id % 4 > 0 THEN event_id % 4 * 6 END AS time FROM events) SELECT event_id, round(log10(coalesce(dose, 0) + 0.001), 6) AS log_dose, round(log10(coalesce(time, 24) + 0.001), 6) AS log_time, dose IS NOT NULL AS has_dose, round(coalesce(dose, 0), 6) AS back FROM x",
    "log_dose_round_trip": "SELECT event_id, value IS NOT NULL AS has_dose, round(log10(coalesce(abs(value), 0) + 0.001), 6) AS log_dose, round(coalesce(abs(value), 0), 4) AS dose FROM events",
    "truthy_filter": "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 6 IN (1, 2, 4, 5)) AS kept FROM events GROUP BY event_type",
    "multi_value_split": "SELECT target, count(*) AS n FROM (SELECT p_name AS target FROM part UNION ALL SELECT p_brand FROM part) WHERE target <> '' GROUP BY target",
    "robust_z_pooled": "WITH d AS (SELECT event_id, event_type, value - median(value) OVER (PARTITION BY event_type) AS d FROM events) SELECT event_id, round(d / greatest(1.4826 * median(abs(d)) OVER (PARTITION BY event_type), 1e-9), 6) AS z FROM d",
    "robust_z_per_gene": "WITH d AS (SELECT user_id, value, median(value) OVER (PARTITION BY user_id) AS med FROM events WHERE event_type = 'view'), s AS (SELECT user_id, any_value(med) AS med, median(abs(value - med)) AS mad FROM d GROUP BY user_id), t AS (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, round((v - med) / greatest(1.4826 * mad, 1e-9), 4) AS z FROM t JOIN s USING (user_id)",
    "robust_z_rows": "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), d AS (SELECT vec_id, pos, v - median(v) OVER (PARTITION BY vec_id) AS d FROM x) SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(d / (1.4826 * median(abs(d)) OVER (PARTITION BY vec_id) + 1e-6), 6) AS z FROM d",
    "reindex_fill": f"WITH {GRID} SELECT gene, sample, round(v, 6) AS v FROM full_",
    "zscore_rows": f"WITH {GRID} SELECT gene, sample, round((v - avg(v) OVER (PARTITION BY sample)) / greatest(stddev_pop(v) OVER (PARTITION BY sample), 1e-6), 6) AS z FROM full_",
    "query_profile": f"WITH {CELL} SELECT sample, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(max(abs(v)), 6) AS top, round(count(*) FILTER (v < 0) / count(*)::DOUBLE, 6) AS negative, count(*) FILTER (v < 0) / count(*)::DOUBLE < 0.05 AS raw, stddev_pop(v) BETWEEN 0.2 AND 12 AS spread_ok FROM cell GROUP BY sample",
    "coverage_guard": f"WITH {CELL}, {GENES}, k AS (SELECT count(DISTINCT sample) AS k FROM cell), n AS (SELECT g.gene, count(c.v) AS n FROM g LEFT JOIN cell c ON g.gene = c.gene GROUP BY g.gene) SELECT round(count(*) FILTER (n = k) / count(*)::DOUBLE, 6) AS present, count(*) FILTER (n = k) * 2 >= count(*) AS accepted FROM n, k",
    "contrast_log2": f"WITH {CELL} SELECT t.gene, round(log2(t.v + 1) - log2(c.v + 1), 6) AS delta FROM cell t JOIN cell c ON t.gene = c.gene AND t.sample = 'purchase' AND c.sample = 'view'",
    "spearman_by_group": "WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT l_suppkey, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM r GROUP BY l_suppkey",
    "contrast_reliability": """WITH g AS (SELECT user_id AS gene, event_type AS side, event_id % 3 AS rep, avg(value) AS v FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL),
x AS (SELECT * FROM g WHERE gene IN (SELECT gene FROM g GROUP BY gene HAVING count(*) = 6)),
d AS (SELECT t.gene, t.rep AS tr, c.rep AS cr, t.v - c.v AS v FROM x t JOIN x c ON t.gene = c.gene AND t.side = 'purchase' AND c.side = 'view'),
r AS (SELECT gene, tr, cr, rank() OVER (PARTITION BY tr, cr ORDER BY v) + (count(*) OVER (PARTITION BY tr, cr, v) - 1) / 2.0 AS r FROM d),
p AS (SELECT corr(a.r::DOUBLE, b.r::DOUBLE) AS rho FROM r a JOIN r b ON a.gene = b.gene AND a.tr < b.tr AND a.cr <> b.cr GROUP BY a.tr, a.cr, b.tr, b.cr), m AS (SELECT count(*) AS n, avg(rho) AS r FROM p)
SELECT 3::BIGINT AS k, n AS pairings, round(r, 6) AS single, round(3 * r / (1 + 2 * r), 6) AS spearman_brown, CASE WHEN 3 * r / (1 + 2 * r) >= 0.4 THEN 'high' WHEN 3 * r / (1 + 2 * r) >= 0.15 THEN 'moderate' ELSE 'low' END AS verdict FROM m""",
    "contrast_reliability_unequal": """WITH g AS (SELECT user_id % 40 AS gene, event_type AS side, CASE WHEN event_type = 'purchase' THEN event_id % 4 ELSE event_id % 3 END AS rep, avg(value) AS v FROM events WHERE event_type IN ('purchase', 'view') GROUP BY ALL),
x AS (SELECT * FROM g WHERE gene IN (SELECT gene FROM g GROUP BY gene HAVING count(*) = 7)),
d AS (SELECT t.gene, t.rep AS tr, c.rep AS cr, t.v - c.v AS v FROM x t JOIN x c ON t.gene = c.gene AND t.side = 'purchase' AND c.side = 'view' AND t.rep < 3),
r AS (SELECT gene, tr, cr, rank() OVER (PARTITION BY tr, cr ORDER BY v) + (count(*) OVER (PARTITION BY tr, cr, v) - 1) / 2.0 AS r FROM d),
p AS (SELECT corr(a.r::DOUBLE, b.r::DOUBLE) AS rho FROM r a JOIN r b ON a.gene = b.gene AND a.tr < b.tr AND a.cr <> b.cr GROUP BY a.tr, a.cr, b.tr, b.cr), m AS (SELECT count(*) AS n, avg(rho) AS r FROM p)
SELECT 3::BIGINT AS k, n AS pairings, round(r, 6) AS single, CASE WHEN r > -0.5 THEN round(3 * r / (1 + 2 * r), 6) END AS spearman_brown, CASE WHEN r <= -0.5 THEN NULL WHEN 3 * r / (1 + 2 * r) >= 0.4 THEN 'high' WHEN 3 * r / (1 + 2 * r) >= 0.15 THEN 'moderate' ELSE 'low' END AS verdict FROM m""",
    "group_statistics": "WITH g AS (SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name) SELECT count(*) AS groups, round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 6) AS singletons, max(n) AS largest FROM g",
    "uncovered_compounds": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "standard_scaler": "WITH t AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s, avg(p_retailprice) AS pm, stddev_pop(p_retailprice) AS ps FROM part WHERE md5(CAST(p_partkey AS VARCHAR)) < 'c') SELECT p_partkey, round(greatest(least((p_size - m) / s, 10), -10), 6) AS size, round(greatest(least((p_retailprice - pm) / ps, 10), -10), 6) AS price FROM part, t",
    "annotation_pairs": "SELECT a.p_partkey AS x, count(*) AS siblings FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_size = b.p_size AND (a.p_name = b.p_name OR (a.p_brand = b.p_brand AND a.p_type = b.p_type)) GROUP BY a.p_partkey",
    "shared_targets": "WITH s AS (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY ALL HAVING count(*) >= 2) SELECT a.c_nationkey AS x, b.c_nationkey AS y, count(*) AS shared FROM s a JOIN s b ON a.c_mktsegment = b.c_mktsegment AND a.c_nationkey < b.c_nationkey GROUP BY ALL",
    "eligible_intersection": "SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) FILTER (l_quantity >= 10) >= 4 AND count(*) FILTER (l_discount >= 0.02) >= 4",
    "learning_rate": "SELECT event_id AS step, round(CASE WHEN event_id < 500 THEN (event_id + 1) / 500.0::DOUBLE WHEN event_id < 5000 THEN (1 + cos(pi() * (event_id - 500) / 4500.0::DOUBLE)) / 2 ELSE 0 END, 6) AS scale FROM events",
    "size_estimate": "SELECT count(*) AS n, round(count(*) * 978.0::DOUBLE * 4 / 1e9, 6) AS gb FROM lineitem",
    "human_sizes": "WITH x AS (SELECT o_orderkey, o_orderkey::BIGINT * o_orderkey * 977 AS n FROM orders) SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f kB', floor(n / 1e2) / 10) WHEN n < 1000000000 THEN printf('%.1f MB', floor(n / 1e5) / 10) WHEN n < 1000000000000 THEN printf('%.1f GB', floor(n / 1e8) / 10) ELSE printf('%.1f TB', floor(n / 1e11) / 10) END AS size FROM x",
    "first_seen_codes": "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "filter_by_split": "WITH x AS (SELECT l_partkey, CASE WHEN md5(CAST(l_partkey AS VARCHAR)) < 'c' THEN 'train' ELSE 'test' END AS split, l_quantity > 40 AS big FROM lineitem) SELECT split, count(*) AS before, count(*) FILTER (big OR split = 'test') AS after, count(DISTINCT l_partkey) AS items_before, count(DISTINCT l_partkey) FILTER (big OR split = 'test') AS items_after, count(*) FILTER (big OR split = 'test') = 0 AS empty FROM x GROUP BY split",
    "finite_vectors": "SELECT vec_id, vec_id % 9 <> 0 AS finite FROM embeddings",
}
