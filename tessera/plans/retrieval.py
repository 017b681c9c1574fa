"""Queries of the retrieval engine over the testbed, through its operators, each with SQL written on its own for DuckDB.

Bindings: a vector's compound is label * 10 + vec_id mod 10. A hash of the id holds vectors out as queries; the others train
the bank. A compound's mechanism is compound mod 7 (none for 6), its target compound mod 5 (none for 4), its bits are the
signs of its first vector. A vector's dose is vec_id mod 13 (none for 0) and its time 6 to 30 hours.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import graph, hubs, metrics, scorers, signal, splits, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark, sf_dir) -> DataFrame:
    """(key, group, vec, asked, dose, time)"""
    got = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id").cast("long")
    dose = F.when(key % 13 > 0, (key % 13).cast("double"))
    return got.select(key.alias("key"), (F.col("label").cast("long") * 10 + key % 10).alias("group"), F.col("embedding").alias("vec"), (splits.hashed("vec_id", "split") < "3").alias("asked"), dose.alias("dose"), (6e0 * (key % 5 + 1)).alias("time"))


def asks(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).where("asked").select(F.col("key").alias("query"), F.col("group").alias("truth"), "vec")


def bank(spark, sf_dir) -> DataFrame:
    return scorers.cosine_consensus(rows(spark, sf_dir).where("not asked"))


def written_bank(spark, sf_dir) -> DataFrame:
    """The bank as a table, for queries that read it more than once: the training rows are scanned and summed once."""
    return storage.written(bank(spark, sf_dir), "bank")


def notes(bank_: DataFrame, divisor: int, none: int) -> DataFrame:
    return bank_.select("cand", F.when(F.col("cand") % divisor != none, (F.col("cand") % divisor).cast("string")).alias("label"))


def ranking(spark, sf_dir, k: int = 50, known: DataFrame | None = None, once: bool = True) -> vectors.Ranking:
    return vectors.ranked(asks(spark, sf_dir), known or bank(spark, sf_dir), k, once=once)


def both(spark, sf_dir, k: int = 50, known: DataFrame | None = None) -> hubs.Both:
    return hubs.ranked(asks(spark, sf_dir), known or bank(spark, sf_dir), k, 10)


def bits(spark, sf_dir) -> DataFrame:
    first = rows(spark, sf_dir).groupBy("group").agg(F.min_by("vec", "key").alias("vec"))
    return first.select("group", F.transform("vec", lambda x: (x > 0).cast("double")).alias("bits"))


def overlap(spark, sf_dir, n: int = 10, k: int = 50) -> vectors.Ranking:
    q = scorers.signed(asks(spark, sf_dir), n)
    return vectors.ranked(q, scorers.gene_set_overlap(rows(spark, sf_dir).where("not asked"), n=n), k, once=True)


def transfer(spark, sf_dir, k: int = 1) -> DataFrame:
    held = splits.hashed("group", "c") < "4"
    return scorers.nearest_transfer(rows(spark, sf_dir).where(~held), bits(spark, sf_dir).select(F.col("group").alias("cand"), F.col("bits").alias("vec")), k=k)


def consensus_topk(spark, sf_dir):
    return ranking(spark, sf_dir, 3).topk.select(F.col("query").alias("vec_id"), F.col("cand").alias("compound"), F.col("u").alias("c_micro"), F.col("r").cast("long").alias("rk"))


def true_rank(spark, sf_dir):
    return ranking(spark, sf_dir, 1).ranks.select(F.col("query").alias("vec_id"), "truth", "rank0")


def micro_metrics(spark, sf_dir):
    return metrics.recall(ranking(spark, sf_dir, 1).ranks)


def macro_metrics(spark, sf_dir):
    return metrics.macro_recall(ranking(spark, sf_dir, 1).ranks)


def per_compound_recall(spark, sf_dir):
    got = metrics.per_truth(ranking(spark, sf_dir, 1).ranks, (10,))
    return got.select(F.col("truth").alias("compound"), "depth", F.round("recall_10", 10).alias("recall_10"), F.round("mrr", 10).alias("mrr"))


def group_hit(spark, sf_dir):
    b = written_bank(spark, sf_dir)
    got = ranking(spark, sf_dir, known=b, once=False)
    return metrics.group_hit(got.topk, got.ranks, notes(b, 7, 6), prefix="moa")


def metric_bundle(spark, sf_dir):
    b = written_bank(spark, sf_dir)
    return metrics.bundle(ranking(spark, sf_dir, known=b, once=False), notes(b, 7, 6), notes(b, 5, 4), prefix="test_")


def comparison_table(spark, sf_dir):
    b = written_bank(spark, sf_dir)
    n = b.agg(F.count(F.lit(1)).alias("n"))
    wide = metrics.chance(n).agg(*[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"macro_recall_{k}") for k in metrics.KS])
    two = both(spark, sf_dir, 1, b)
    got = {"cosine consensus": two.plain, "hub penalty": two.corrected, "gene sets": overlap(spark, sf_dir, k=1)}
    return metrics.comparison({n: metrics.macro_recall(r.ranks) for n, r in got.items()} | {"chance": wide, "no macro metric": wide.select(F.lit(1).alias("recall_1"))})


def csls_rank(spark, sf_dir):
    return both(spark, sf_dir, 1).corrected.topk.select(F.col("query").alias("vec_id"), F.col("cand").alias("compound"), F.col("u").alias("csls"))


def hub_occupancy(spark, sf_dir):
    b = written_bank(spark, sf_dir)
    return metrics.hubness(ranking(spark, sf_dir, 10, b).topk, b, 10)


def hubness_report(spark, sf_dir):
    """The counts and the macro recall at 10, with the penalty and without, from one pass; and the largest difference of ranks
    counted anew."""
    out, b = None, written_bank(spark, sf_dir)
    two = both(spark, sf_dir, 10, b)
    for arm, got, penalty in (("cosine", two.plain, None), ("csls", two.corrected, two.penalty)):
        again = hubs.disagreement(asks(spark, sf_dir), b, got.ranks, penalty)
        one = metrics.hubness(got.topk, b, 10).crossJoin(metrics.macro_recall(got.ranks, (10,)).select("macro_recall_10")).crossJoin(again)  # tables of one row
        one = one.select(F.lit(arm).alias("arm"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def modal_label(spark, sf_dir):
    b = written_bank(spark, sf_dir)
    got = metrics.modal_label(ranking(spark, sf_dir, 10, b).topk, notes(b, 7, 6))
    return got.select(F.col("query").alias("vec_id"), F.col("label").alias("moa"), "n")


def ranking_beyond_truth(spark, sf_dir):
    return ranking(spark, sf_dir, 1).ranks.groupBy("rank0").agg(F.count(F.lit(1)).alias("n"))


def chance_recall(spark, sf_dir):
    return metrics.chance(bank(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))


def hit_listing(spark, sf_dir):
    b = written_bank(spark, sf_dir)
    named = notes(b, 7, 6).select("cand", F.concat(F.lit("mechanism of action number "), F.col("label"), F.lit(" of seven")).alias("moa"))
    got = ranking(spark, sf_dir, 3, b).topk.join(named, "cand", "left")
    return got.select(F.col("query").alias("vec_id"), F.col("r").cast("long").alias("rank"), F.concat(F.lit("C"), F.col("cand")).alias("compound_id"), (F.col("u") / 1e6).alias("cosine"), F.substring("moa", 1, 33).alias("moa"))


def restricted_bank(spark, sf_dir):
    """Only compounds with at least the mean number of training vectors, and only queries whose truth is among them."""
    train, q = splits.deep_bank(rows(spark, sf_dir).where("not asked"), asks(spark, sf_dir))
    got = vectors.ranked(q, scorers.cosine_consensus(train), 1, once=True)
    return got.ranks.select(F.col("query").alias("vec_id"), "truth", "rank0", F.lit(got.n_bank).cast("long").alias("bank"), F.round(F.least(F.lit(10), F.lit(got.n_bank)) / F.lit(max(1, got.n_bank)), 6).alias("chance_10"))


def gene_set_overlap(spark, sf_dir):
    got = overlap(spark, sf_dir, k=5).topk
    return got.select(F.col("query").alias("vec_id"), F.col("cand").alias("compound"), F.col("r").cast("long").alias("rk"), F.round(F.col("u") * 2 * 10 / vectors.UNIT).cast("long").alias("overlap"))


def nearest_transfer(spark, sf_dir):
    return transfer(spark, sf_dir).where("donor is not null").select(F.col("cand").alias("compound"), "donor", "similarity")


def held_asks(spark, sf_dir) -> DataFrame:
    """Vectors of compounds without training rows."""
    return rows(spark, sf_dir).where(splits.hashed("group", "c") < "4").select(F.col("key").alias("query"), F.col("group").alias("truth"), "vec")


def transfer_ranks(spark, sf_dir, lent: DataFrame | None = None):
    """Vectors of compounds without training rows, ranked against a bank that borrows their vectors."""
    return vectors.ranked(held_asks(spark, sf_dir), lent or transfer(spark, sf_dir), 1, once=True).ranks.select(F.col("query").alias("vec_id"), "truth", "rank0")


def transfer_weighted(spark, sf_dir):
    got = transfer(spark, sf_dir, 3).where("donor is not null")
    return got.select(F.col("cand").alias("compound"), "donor", F.round(F.col("vec")[0], 6).alias("first"), F.round(vectors.norm(F.col("vec")), 6).alias("norm"))


def similarity_breakdown(spark, sf_dir):
    """Recall at 10 of the hub penalty against that of plain cosines, both over borrowed vectors, by the donor's similarity."""
    lent = storage.written(transfer(spark, sf_dir), "transfer")
    two = hubs.ranked(held_asks(spark, sf_dir), lent, 10, 10)
    donors = lent.where("donor is not null").select(F.col("cand").alias("truth"), "similarity")
    return metrics.by_similarity(two.corrected.ranks, two.plain.ranks, donors)


def depth_breakdown(spark, sf_dir):
    """Recall at 10 with the hub penalty against that without it, by the compound's training vectors."""
    depth = rows(spark, sf_dir).where("not asked").groupBy(F.col("group").alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    two = both(spark, sf_dir, 1)
    return metrics.by_depth(two.corrected.ranks, two.plain.ranks, depth)


def loo_agreement(spark, sf_dir):
    return signal.quality(rows(spark, sf_dir)).select(F.col("key").alias("vec_id"), "group", "n", "loo")


def quality_filter(spark, sf_dir):
    got = signal.quality_filter(rows(spark, sf_dir), min_depth=4, min_dose=2, min_time=12, drop_outliers=0.25, restrict=~F.col("asked"))
    return got.select(F.col("key").alias("vec_id"), "keep")


def outlier_filter(spark, sf_dir):
    got = signal.quality_filter(rows(spark, sf_dir), drop_outliers=0.25)
    return got.groupBy("group").agg(F.sum(F.col("keep").cast("long")).alias("kept"))


def reliability_verdict(spark, sf_dir):
    c = F.col("self_cosine")
    return signal.self_cosines(by_label(spark, sf_dir)).select("group", F.when(c >= 0.4, "high").when(c >= 0.15, "moderate").otherwise("low").alias("verdict"))


def matched_depth_filters(spark, sf_dir):
    got = signal.filter_comparison(signal.arms(by_label(spark, sf_dir)), 4)
    return got.withColumn("arm", F.col("arm").cast("long"))


def by_label(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).withColumn("group", F.floor(F.col("group") / 10).cast("long"))


def noise_ceiling(spark, sf_dir):
    return signal.noise_ceiling(rows(spark, sf_dir), bin_least=3)


def self_cosines(spark, sf_dir):
    return signal.self_cosines(by_label(spark, sf_dir))


def random_pair_cosine(spark, sf_dir):
    return signal.random_pairs(rows(spark, sf_dir))


def pair_correlation(spark, sf_dir):
    names = ["none (baseline)", "dose >= 1 uM", "time >= 24 h"]
    by = rows(spark, sf_dir).withColumn("group", (F.floor(F.col("group") / 10) * 3 + F.col("key") % 3).cast("long"))
    first = by.groupBy("group").agg(F.min_by("vec", "key").alias("vec")).select("group", F.transform("vec", lambda x: (x > 0).cast("double")).alias("bits"))
    return signal.pair_correlation(signal.arms(by, names), first, 2).withColumn("arm", F.col("arm").cast("long"))


def annotation_similarity(spark, sf_dir):
    moa = F.when(F.col("group") % 7 != 6, (F.col("group") % 7).cast("string"))
    targets = F.filter(F.array((F.col("group") % 5).cast("string"), (F.col("group") % 11).cast("string")), lambda t: t < "4")
    return signal.annotation_similarity(rows(spark, sf_dir), bits(spark, sf_dir).select("group", moa.alias("moa"), targets.alias("targets"), "bits"), 2, least=20)


def block_correlation(spark, sf_dir):
    desc = rows(spark, sf_dir).groupBy("group").agg(F.min_by("vec", "key").alias("desc"))
    return signal.block_correlation(rows(spark, sf_dir), desc, 4, 2)


def near_duplicates(spark, sf_dir):
    got = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    return graph.near_groups(got, "key", tolerance=0.55).select(F.col("key").alias("vec_id"), "group")


def exact_duplicates(spark, sf_dir):
    return graph.equal_groups(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("group").alias("dup_group"))


def recall_ceiling(spark, sf_dir):
    text = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null"))
    return metrics.ceiling(table(spark, sf_dir, "documents").select(text.alias("group")))


def dense_codes(spark, sf_dir):
    return splits.codes(table(spark, sf_dir, "part"), "p_type")


def random_split(spark, sf_dir):
    return splits.random_split(table(spark, sf_dir, "part"), "p_partkey")


def parts(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).cast("double").alias("lines"))
    return table(spark, sf_dir, "part").join(lines, "p_partkey", "left").select("p_partkey", "p_brand", "p_type", F.coalesce("lines", F.lit(0e0)).alias("lines"))


def group_split(spark, sf_dir):
    """Parts of one brand lie in one split; the splits' shares of parts and of lines come out even."""
    return splits.split(parts(spark, sf_dir), "scaffold", "p_partkey", "p_brand", "lines").select("p_partkey", "split")


def moa_split(spark, sf_dir):
    brand = F.when(F.col("p_type") != "STANDARD", F.col("p_brand"))
    return splits.split(parts(spark, sf_dir).withColumn("p_brand", brand), "moa", "p_partkey", "p_brand", "lines").select("p_partkey", "split")


def split_leak(spark, sf_dir):
    return splits.leak(splits.random_split(parts(spark, sf_dir), "p_partkey").join(parts(spark, sf_dir), "p_partkey"), "p_brand")


def stratified_signature_split(spark, sf_dir):
    return splits.split(table(spark, sf_dir, "embeddings"), "signature", "vec_id", "label")


def new_signature_holdout(spark, sf_dir):
    return splits.holdout(table(spark, sf_dir, "embeddings"), "vec_id", "label")


def capped_sample(spark, sf_dir):
    return splits.capped(table(spark, sf_dir, "embeddings"), "vec_id", "label", 5)


def train_probe(spark, sf_dir):
    return splits.probe(rows(spark, sf_dir).where("not asked"), "key", 50).select(F.col("key").alias("vec_id"))


NAMES = """consensus_topk true_rank micro_metrics macro_metrics per_compound_recall group_hit metric_bundle comparison_table csls_rank
hub_occupancy hubness_report modal_label ranking_beyond_truth chance_recall hit_listing restricted_bank gene_set_overlap nearest_transfer
transfer_ranks transfer_weighted similarity_breakdown depth_breakdown loo_agreement quality_filter outlier_filter reliability_verdict matched_depth_filters
noise_ceiling self_cosines random_pair_cosine pair_correlation annotation_similarity block_correlation near_duplicates
exact_duplicates recall_ceiling dense_codes random_split group_split moa_split split_leak stratified_signature_split
new_signature_holdout capped_sample train_probe""".split()
QUERIES = {n: globals()[n] for n in NAMES}

# ---- SQL ----
V = """v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) * 10 + vec_id % 10 AS g, md5('split|' || vec_id) < '3' AS asked,
  generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""
CONS = V + """, cons AS (SELECT g, p, avg(x) AS m FROM v WHERE NOT asked GROUP BY g, p), cn AS (SELECT g, sqrt(sum(m * m)) + 1e-9 AS n FROM cons GROUP BY g),
q AS (SELECT vec_id, g AS truth, p, x FROM v WHERE asked), qn AS (SELECT vec_id, truth, sqrt(sum(x * x)) + 1e-9 AS n FROM q GROUP BY vec_id, truth),
cosine AS (SELECT q.vec_id, q.truth, c.g AS cand, sum(q.x / qn.n * c.m / cn.n) AS c FROM q JOIN qn ON q.vec_id = qn.vec_id JOIN cons c ON q.p = c.p JOIN cn ON c.g = cn.g GROUP BY ALL)"""
SCORE = CONS + ", s AS (SELECT vec_id, truth, cand, CAST(round(1e6 * c) AS BIGINT) AS u FROM cosine)"
PEN = CONS + """, near AS (SELECT cand, round(1e6 * c) AS u, row_number() OVER (PARTITION BY cand ORDER BY round(1e6 * c) DESC, vec_id) AS k FROM cosine),
pen AS (SELECT cand, avg(u) AS p FROM near WHERE k <= 10 GROUP BY cand),
s AS (SELECT vec_id, truth, cosine.cand, CAST(round(2e6 * c - p) AS BIGINT) AS u FROM cosine JOIN pen ON cosine.cand = pen.cand)"""
RANK = """, tu AS (SELECT vec_id, u FROM s WHERE cand = truth), ranks AS (SELECT s.vec_id, s.truth, count(*) FILTER (tu.u IS NULL OR s.u > tu.u) AS rank0
  FROM s LEFT JOIN tu ON s.vec_id = tu.vec_id GROUP BY s.vec_id, s.truth), topk AS (SELECT vec_id, truth, cand, u, row_number() OVER (PARTITION BY vec_id ORDER BY u DESC, cand) AS r FROM s)"""
KS = metrics.KS


def _macro(name: str, where: str = "ranks") -> str:
    return ", ".join(f"round(avg(h{k}), 10) AS {name}macro_recall_{k}" for k in KS) + f", round(avg(rr), 10) AS {name}macro_mrr, count(*) AS {name}n_truths FROM (SELECT truth, " + ", ".join(f"avg(CASE WHEN rank0 < {k} THEN 1.0 ELSE 0.0 END::DOUBLE) AS h{k}" for k in KS) + f", avg(1::DOUBLE / (rank0 + 1)) AS rr FROM {where} GROUP BY truth)"


def _micro(name: str) -> str:
    return ", ".join(f"round(avg(CASE WHEN rank0 < {k} THEN 1 ELSE 0 END::DOUBLE), 10) AS {name}recall_{k}" for k in KS) + f", round(avg(1::DOUBLE / (rank0 + 1)), 10) AS {name}mrr, count(*) AS {name}n_queries FROM ranks"


def _hit(name: str, divisor: int, none: int) -> str:
    each = ", ".join(f"max(CASE WHEN r <= {k} AND cand % {divisor} = truth % {divisor} THEN 1 ELSE 0 END)::DOUBLE AS h{k}" for k in KS)
    inner = f"SELECT vec_id, truth, {each} FROM topk WHERE truth % {divisor} <> {none} AND truth IN (SELECT g FROM cn) GROUP BY vec_id, truth"
    out = ", ".join(f"round(sum(t{k}) / sum(n), 10) AS {name}_hit_{k}, round(avg(t{k} / n), 10) AS {name}_macro_hit_{k}" for k in KS)
    sums = ", ".join(f"sum(h{k}) AS t{k}" for k in KS)
    return f"SELECT {out}, CAST(coalesce(sum(n), 0) AS BIGINT) AS {name}_scored, (SELECT count(*) FROM ranks) - CAST(coalesce(sum(n), 0) AS BIGINT) AS {name}_skipped FROM (SELECT truth, count(*) AS n, {sums} FROM ({inner}) GROUP BY truth)"


HUBS = """, o AS (SELECT cn.g, count(topk.cand) AS n FROM cn LEFT JOIN topk ON cn.g = topk.cand AND topk.r <= 10 GROUP BY cn.g),
hub AS (SELECT max(n) AS largest, round(quantile_cont(n, 0.99), 10) AS p99, round(median(n), 10) AS median, count(*) FILTER (n = 0) AS never,
  round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 10) AS never_fraction,
  round((SELECT sum(n) FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM o) WHERE k <= greatest(1, (SELECT count(*) // 100 FROM o)))::DOUBLE / nullif(sum(n), 0), 10) AS top_share,
  round(sum(n)::DOUBLE / count(*), 10) AS even_share FROM o)"""
SIGNED = lambda name, src, key, val: f"{name} AS (SELECT {key}, p, CASE WHEN row_number() OVER (PARTITION BY {key} ORDER BY {val}, p) <= 10 THEN -1 WHEN row_number() OVER (PARTITION BY {key} ORDER BY {val} DESC, p) <= 10 THEN 1 ELSE 0 END AS s FROM {src})"
OVER = CONS + ", " + SIGNED("sq", "q", "vec_id", "x") + ", " + SIGNED("sc", "cons", "g", "m") + """, s AS (SELECT sq.vec_id, qn.truth, sc.g AS cand, CAST(sum(sq.s * sc.s) AS BIGINT) AS u FROM sq JOIN qn ON sq.vec_id = qn.vec_id JOIN sc ON sq.p = sc.p GROUP BY ALL)"""
TRANS = V + """, own AS (SELECT g, p, avg(x) AS m FROM v WHERE md5('c|' || g) >= '4' GROUP BY g, p),
bit AS (SELECT g, p, CASE WHEN arg_min(x, vec_id) > 0 THEN 1 ELSE 0 END AS b FROM v GROUP BY g, p), nb AS (SELECT g, sum(b) AS n FROM bit GROUP BY g),
sim AS (SELECT a.g, d.g AS donor, round(1e6 * sum(a.b * d.b) / greatest(na.n + nd.n - sum(a.b * d.b), 1)::DOUBLE) / 1e6 AS s FROM bit a JOIN bit d ON a.p = d.p JOIN nb na ON a.g = na.g JOIN nb nd ON d.g = nd.g
  WHERE md5('c|' || a.g) < '4' AND md5('c|' || d.g) >= '4' GROUP BY a.g, d.g, na.n, nd.n),
best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, donor) AS k FROM sim)"""
LENT = TRANS + """, keys AS (SELECT g, p, m FROM own UNION ALL SELECT best.g, p, m FROM best JOIN own ON own.g = best.donor WHERE k = 1),
kn AS (SELECT g, sqrt(sum(m * m)) + 1e-9 AS n FROM keys GROUP BY g), q AS (SELECT vec_id, g AS truth, p, x FROM v WHERE md5('c|' || g) < '4'),
qn AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-9 AS n FROM q GROUP BY vec_id),
s AS (SELECT q.vec_id, q.truth, c.g AS cand, CAST(round(1e6 * sum(q.x / qn.n * c.m / kn.n)) AS BIGINT) AS u FROM q JOIN qn ON q.vec_id = qn.vec_id JOIN keys c ON q.p = c.p JOIN kn ON c.g = kn.g GROUP BY ALL)"""
LENT_COS = LENT[: LENT.index("s AS (SELECT q.vec_id")] + "cosine AS (SELECT q.vec_id, q.truth, c.g AS cand, sum(q.x / qn.n * c.m / kn.n) AS c FROM q JOIN qn ON q.vec_id = qn.vec_id JOIN keys c ON q.p = c.p JOIN kn ON c.g = kn.g GROUP BY ALL)"
LENT_PEN = LENT_COS + PEN[PEN.index(", near AS") :]
LOO = V + """, w AS (SELECT vec_id, g, p, x, asked, count(*) OVER (PARTITION BY g, p) AS n, sum(x) OVER (PARTITION BY g, p) - x AS rest FROM v),
l AS (SELECT vec_id, g, asked, n, round(sqrt(sum(x * x)), 6) AS norm, CASE WHEN n < 2 THEN 0 ELSE round(sum(x * rest) / greatest(sqrt(sum(x * x)) * sqrt(sum(rest * rest)), 1e-9 * (n - 1)), 6) END AS loo FROM w GROUP BY vec_id, g, asked, n)"""
HALF = lambda g: V.replace("CAST(label AS BIGINT) * 10 + vec_id % 10", g) + """, h AS (SELECT g, p, CASE WHEN md5('half' || vec_id) < '8' THEN 0 ELSE 1 END AS side, avg(x) AS m, count(*) AS n FROM v GROUP BY ALL),
hn AS (SELECT g, side, n, sqrt(sum(m * m)) + 1e-9 AS len FROM h GROUP BY g, side, n), ok AS (SELECT a.g, a.n + b.n AS n, a.len AS la, b.len AS lb FROM hn a JOIN hn b ON a.g = b.g AND a.side = 0 AND b.side = 1 WHERE a.n >= 2 AND b.n >= 2),
sc AS (SELECT ok.g, ok.n, round(sum(a.m / la * b.m / lb), 6) AS c FROM ok JOIN h a ON a.g = ok.g AND a.side = 0 JOIN h b ON b.g = ok.g AND b.side = 1 AND a.p = b.p GROUP BY ok.g, ok.n)"""  # noqa: E731
BINS = lambda edges, src, value, one: src + ", edge(bin, label, lo, hi, last) AS (VALUES " + ", ".join(f"({k}::BIGINT, '{a:g}-{b:g}', {a}::DOUBLE, {b}::DOUBLE, {str(k == len(edges) - 2).lower()})" for k, (a, b) in enumerate(zip(edges, edges[1:]))) + f") SELECT e.bin, e.label, count({value}) AS n, round(avg(model), 10) AS model, round(avg(baseline), 10) AS baseline, CASE WHEN avg(baseline) > 0 THEN round(avg(model) / avg(baseline), 10) WHEN avg(model) > 0 THEN 'inf'::DOUBLE WHEN count({value}) > 0 THEN 'nan'::DOUBLE END AS ratio FROM edge e LEFT JOIN {one} z ON z.{value} >= e.lo AND (z.{value} < e.hi OR e.last AND z.{value} <= e.hi) GROUP BY e.bin, e.label"
DOSES = "CASE WHEN vec_id % 13 > 0 THEN vec_id % 13 END AS dose, 6 * (vec_id % 5 + 1) AS time"



def _matched(g: str, arms: list[str], k: int) -> str:
    """CTEs hv (arm, g, p, a, b), fv (arm, g, p, x) and sim (arm, g, half), of groups with 2 k rows under all arms."""
    loo = LOO.replace("CAST(label AS BIGINT) * 10 + vec_id % 10", g)
    flags = " UNION ALL ".join(f"SELECT {n} AS arm, vec_id, g FROM e, qs WHERE {c}" for n, c in enumerate(arms))
    return f"""{loo}, e AS (SELECT l.*, {DOSES} FROM l), qs AS (SELECT quantile_cont(norm, 0.25) AS qn, quantile_cont(loo, 0.25) AS ql FROM e), k AS ({flags}),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, g ORDER BY md5(arm || '|' || vec_id), vec_id) AS rn FROM k), ok AS (SELECT g FROM r WHERE rn = {2 * k} GROUP BY g HAVING count(*) = {len(arms)}),
hv AS (SELECT r.arm, r.g, v.p, avg(x) FILTER (rn <= {k}) AS a, avg(x) FILTER (rn > {k}) AS b FROM r JOIN ok ON r.g = ok.g JOIN v ON v.vec_id = r.vec_id WHERE rn <= {2 * k} GROUP BY r.arm, r.g, v.p),
sim AS (SELECT arm, g, sum(a * b) / ((sqrt(sum(a * a)) + 1e-9) * (sqrt(sum(b * b)) + 1e-9)) AS half, sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS c, sqrt(sum((a + b) / 2 * (a + b) / 2)) + 1e-9 AS n FROM hv GROUP BY arm, g),
fv AS (SELECT hv.arm, hv.g, p, (a + b) / 2 / n AS x FROM hv JOIN sim ON hv.arm = sim.arm AND hv.g = sim.g),
bio AS (SELECT i.arm, i.g AS i, j.g AS j, sum(i.x * j.x) AS bio FROM fv i JOIN fv j ON i.arm = j.arm AND i.p = j.p AND i.g < j.g GROUP BY ALL),
bit AS (SELECT g, p, CASE WHEN arg_min(x, vec_id) > 0 THEN 1 ELSE 0 END AS b FROM v GROUP BY g, p), nb AS (SELECT g, sum(b) AS n FROM bit GROUP BY g),
chem AS (SELECT i.g AS i, j.g AS j, sum(i.b * j.b) / greatest(any_value(ni.n) + any_value(nj.n) - sum(i.b * j.b), 1)::DOUBLE AS chem FROM bit i JOIN bit j ON i.p = j.p AND i.g < j.g JOIN nb ni ON ni.g = i.g JOIN nb nj ON nj.g = j.g GROUP BY i.g, j.g)"""


ARMS = ["true", "dose >= 1", "dose >= 10", "time >= 24", "dose >= 1 AND time >= 24", "norm >= qn", "loo >= ql", "loo >= ql AND dose >= 1 AND time >= 24"]
BY_3 = "CAST(label AS BIGINT) * 3 + vec_id % 3"
BY_10 = "CAST(label AS BIGINT) * 10 + vec_id % 10"


def _greedy(group: str) -> str:
    """The sequential rule as a recursion over groups in order: the splits' members and weight go from row to row."""
    cost = lambda i, f: f"greatest((n{i} + o.n) / ({f} * o.all_n), (w{i} + o.w) / ({f} * o.all_w))"
    c = [cost(0, 0.8), cost(1, 0.1), cost(2, "(1.0::DOUBLE - 0.8 - 0.1)")]
    pick = f"CASE WHEN {c[0]} <= {c[1]} AND {c[0]} <= {c[2]} THEN 0 WHEN {c[1]} <= {c[2]} THEN 1 ELSE 2 END"
    return f"""WITH RECURSIVE x AS (SELECT p_partkey, {group} AS grp, coalesce(lines, 0)::DOUBLE AS w FROM part LEFT JOIN (SELECT l_partkey, count(*) AS lines FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey),
sums AS (SELECT grp, count(*)::DOUBLE AS n, sum(w) AS w, min(p_partkey) AS first FROM x WHERE grp IS NOT NULL GROUP BY grp),
o AS (SELECT *, row_number() OVER (ORDER BY w DESC, n DESC, first) AS k, sum(n) OVER () AS all_n, sum(w) OVER () AS all_w FROM sums),
walk AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS grp, -1 AS at, 0::DOUBLE AS n0, 0::DOUBLE AS n1, 0::DOUBLE AS n2, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2
  UNION ALL SELECT z.k, z.grp, z.at, n0 + CASE WHEN z.at = 0 THEN z.n ELSE 0 END, n1 + CASE WHEN z.at = 1 THEN z.n ELSE 0 END, n2 + CASE WHEN z.at = 2 THEN z.n ELSE 0 END,
    w0 + CASE WHEN z.at = 0 THEN z.w ELSE 0 END, w1 + CASE WHEN z.at = 1 THEN z.w ELSE 0 END, w2 + CASE WHEN z.at = 2 THEN z.w ELSE 0 END
  FROM (SELECT o.k, o.grp, o.n, o.w, n0, n1, n2, w0, w1, w2, {pick} AS at FROM walk JOIN o ON o.k = walk.k + 1) z)
SELECT x.p_partkey, CASE walk.at WHEN 1 THEN 'valid' WHEN 2 THEN 'test' ELSE 'train' END AS split FROM x LEFT JOIN walk ON x.grp = walk.grp"""


ORACLES = {
    "consensus_topk": f"WITH {SCORE}{RANK} SELECT vec_id, cand AS compound, u AS c_micro, r AS rk FROM topk WHERE r <= 3",
    "true_rank": f"WITH {SCORE}{RANK} SELECT vec_id, truth, rank0 FROM ranks",
    "micro_metrics": f"WITH {SCORE}{RANK} SELECT {_micro('')}",
    "macro_metrics": f"WITH {SCORE}{RANK} SELECT {_macro('')}",
    "per_compound_recall": f"WITH {SCORE}{RANK} SELECT truth AS compound, count(*) AS depth, round(avg(CASE WHEN rank0 < 10 THEN 1 ELSE 0 END::DOUBLE), 10) AS recall_10, round(avg(1::DOUBLE / (rank0 + 1)), 10) AS mrr FROM ranks GROUP BY truth",
    "group_hit": f"WITH {SCORE}{RANK} {_hit('moa', 7, 6)}",
    "metric_bundle": f"WITH {SCORE}{RANK}, a AS (SELECT {_macro('test_')}), b AS (SELECT {_micro('test_')}), c AS ({_hit('test_moa', 7, 6)}), d AS ({_hit('test_target', 5, 4)}) SELECT * FROM a, b, c, d",
    "comparison_table": " UNION ALL ".join(f"SELECT {k}::BIGINT AS place, '{n}' AS name, {', '.join(f'macro_recall_{x}' for x in KS)} FROM (WITH {cte}{RANK} SELECT {_macro('')})" for k, (n, cte) in enumerate((("cosine consensus", SCORE), ("hub penalty", PEN), ("gene sets", OVER)))) + f" UNION ALL SELECT 3, 'chance', {', '.join(f'round(least({k}, n) / n::DOUBLE, 10)' for k in KS)} FROM (WITH {V} SELECT count(DISTINCT g) AS n FROM v WHERE NOT asked)",
    "csls_rank": f"WITH {PEN}{RANK} SELECT vec_id, cand AS compound, u AS csls FROM topk WHERE r = 1",
    "hub_occupancy": f"WITH {SCORE}{RANK}{HUBS} SELECT * FROM hub",
    "hubness_report": " UNION ALL ".join(f"SELECT '{arm}' AS arm, * FROM (WITH {cte}{RANK}{HUBS} SELECT hub.*, m.macro_recall_10, 0::BIGINT AS difference FROM hub, (SELECT {_macro('')}) m)" for arm, cte in (("cosine", SCORE), ("csls", PEN))),
    "modal_label": f"WITH {SCORE}{RANK}, c AS (SELECT vec_id, cand % 7 AS moa, count(*) AS n FROM topk WHERE r <= 10 AND cand % 7 <> 6 GROUP BY ALL) SELECT vec_id, CAST(moa AS VARCHAR) AS moa, n FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, moa) = 1",
    "ranking_beyond_truth": f"WITH {SCORE}{RANK} SELECT rank0, count(*) AS n FROM ranks GROUP BY rank0",
    "chance_recall": f"WITH {V} SELECT k::BIGINT AS k, round(least(k, n) / n::DOUBLE, 10) AS recall FROM (SELECT count(DISTINCT g) AS n FROM v WHERE NOT asked), (VALUES {', '.join(f'({k})' for k in KS)}) t(k)",
    "hit_listing": f"WITH {SCORE}{RANK} SELECT vec_id, r AS rank, 'C' || cand AS compound_id, u / 1e6 AS cosine, CASE WHEN cand % 7 <> 6 THEN substr('mechanism of action number ' || cand % 7 || ' of seven', 1, 33) END AS moa FROM topk WHERE r <= 3",
    "restricted_bank": f"WITH {SCORE}, depth AS (SELECT g, count(DISTINCT vec_id) AS n FROM v WHERE NOT asked GROUP BY g), deep AS (SELECT g FROM depth WHERE n >= (SELECT avg(n) FROM depth)), z AS (SELECT * FROM s WHERE cand IN (SELECT g FROM deep) AND truth IN (SELECT g FROM deep)), b AS (SELECT count(*) AS b FROM deep) SELECT z.vec_id, z.truth, count(*) FILTER (z.u > t.u) AS rank0, any_value(b) AS bank, round(least(10, any_value(b)) / any_value(b)::DOUBLE, 6) AS chance_10 FROM z JOIN z t ON z.vec_id = t.vec_id AND t.cand = t.truth, b GROUP BY z.vec_id, z.truth",
    "gene_set_overlap": f"WITH {OVER}{RANK} SELECT vec_id, cand AS compound, r AS rk, u AS overlap FROM topk WHERE r <= 5",
    "nearest_transfer": f"WITH {TRANS} SELECT g AS compound, donor, s AS similarity FROM best WHERE k = 1",
    "transfer_ranks": f"WITH {LENT}{RANK} SELECT vec_id, truth, rank0 FROM ranks",
    "transfer_weighted": f"WITH {TRANS}, t AS (SELECT g, p, sum(s * m) / (sum(s) + 1e-9) AS m FROM best JOIN own ON own.g = best.donor WHERE k <= 3 GROUP BY best.g, p) SELECT t.g AS compound, max(b.donor) AS donor, round(max(m) FILTER (p = 1), 6) AS first, round(sqrt(sum(m * m)), 6) AS norm FROM t JOIN best b ON b.g = t.g AND b.k = 1 GROUP BY t.g".replace("SELECT g, p, sum(s * m)", "SELECT best.g, p, sum(s * m)"),
    "similarity_breakdown": BINS([0, 0.4, 0.5, 0.6, 0.7, 0.8, 1], f"WITH m AS (SELECT truth, avg(CASE WHEN rank0 < 10 THEN 1 ELSE 0 END::DOUBLE) AS model FROM (WITH {LENT_PEN}{RANK} SELECT * FROM ranks) GROUP BY truth), p AS (SELECT truth, avg(CASE WHEN rank0 < 10 THEN 1 ELSE 0 END::DOUBLE) AS baseline FROM (WITH {LENT}{RANK} SELECT * FROM ranks) GROUP BY truth), z AS (SELECT best.s AS similarity, model, baseline FROM (WITH {TRANS} SELECT * FROM best WHERE k = 1) best JOIN m ON m.truth = best.g JOIN p ON p.truth = best.g)", "similarity", "z"),
    "depth_breakdown": BINS([1, 2, 4, 8, 20, 60, 1_000_000], f"WITH m AS (SELECT truth, avg(CASE WHEN rank0 < 10 THEN 1 ELSE 0 END::DOUBLE) AS model FROM (WITH {PEN}{RANK} SELECT * FROM ranks) GROUP BY truth), b AS (SELECT truth, avg(CASE WHEN rank0 < 10 THEN 1 ELSE 0 END::DOUBLE) AS baseline FROM (WITH {SCORE}{RANK} SELECT * FROM ranks) GROUP BY truth), z AS (SELECT d.n, model, baseline FROM (WITH {V} SELECT g, count(DISTINCT vec_id) AS n FROM v WHERE NOT asked GROUP BY g) d JOIN m ON m.truth = d.g JOIN b ON b.truth = d.g)", "n", "z"),
    "loo_agreement": f"""WITH {LOO} SELECT vec_id, g AS "group", n, loo FROM l""",
    "quality_filter": f"WITH {LOO}, e AS (SELECT *, {DOSES} FROM l), cut AS (SELECT quantile_cont(loo, 0.25) AS cut FROM e WHERE NOT asked AND n >= 2) SELECT vec_id, asked OR (n >= 4 AND coalesce(dose >= 2, false) AND time >= 12 AND (n < 2 OR loo >= cut)) AS keep FROM e, cut",
    "outlier_filter": f"""WITH {LOO}, cut AS (SELECT quantile_cont(loo, 0.25) AS cut FROM l WHERE n >= 2) SELECT g AS "group", count(*) FILTER (n < 2 OR loo >= cut) AS kept FROM l, cut GROUP BY g""",
    "reliability_verdict": f"""WITH {HALF('CAST(label AS BIGINT)')} SELECT g AS "group", CASE WHEN c >= 0.4 THEN 'high' WHEN c >= 0.15 THEN 'moderate' ELSE 'low' END AS verdict FROM sc WHERE n >= 4""",
    "noise_ceiling": f"WITH {HALF('CAST(label AS BIGINT) * 10 + vec_id % 10')}, d AS (SELECT 'all' AS depth, c FROM sc WHERE n >= 4 UNION ALL SELECT CASE WHEN n < 6 THEN '4-5' WHEN n < 10 THEN '6-9' WHEN n < 20 THEN '10-19' WHEN n < 60 THEN '20-59' ELSE '>=60' END, c FROM sc WHERE n >= 4) SELECT depth, count(*) AS n, round(avg(c), 6) AS mean, round(median(c), 6) AS median FROM d GROUP BY depth HAVING depth = 'all' OR count(*) >= 3",
    "self_cosines": f"""WITH {HALF('CAST(label AS BIGINT)')} SELECT g AS "group", n, c AS self_cosine, round(2 * c / nullif(1 + c, 0), 6) AS reliability FROM sc WHERE n >= 4""",
    "random_pair_cosine": f"WITH {HALF('CAST(label AS BIGINT) * 10 + vec_id % 10')}, pick AS (SELECT g, la FROM ok ORDER BY md5(CAST(g AS VARCHAR)), g LIMIT 2000), u AS (SELECT h.g, p, m / la AS x FROM h JOIN pick ON h.g = pick.g AND side = 0), c AS (SELECT a.g, b.g AS o, sum(a.x * b.x) AS c FROM u a JOIN u b ON a.p = b.p AND a.g < b.g GROUP BY ALL) SELECT count(*) AS pairs, round(avg(c), 6) AS cosine FROM c",
    "exact_duplicates": "WITH g AS (SELECT text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text) SELECT d.doc_id, CASE WHEN g.n > 1 THEN g.first ELSE -1 END AS dup_group FROM documents d JOIN g ON d.text IS NOT DISTINCT FROM g.text",
    "recall_ceiling": f"WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text) SELECT k::BIGINT AS k, round(sum(n * least(1, k / n::DOUBLE)) / sum(n), 10) AS recall FROM g, (VALUES {', '.join(f'({k})' for k in KS)}) t(k) GROUP BY k",
    "near_duplicates": """WITH RECURSIVE x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT vec_id, p, (x - avg(x) OVER (PARTITION BY p)) / stddev_pop(x) OVER (PARTITION BY p) AS z FROM x), n AS (SELECT vec_id, sqrt(sum(z * z)) + 1e-9 AS n FROM z GROUP BY vec_id),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON a.p = b.p AND a.vec_id <> b.vec_id JOIN n na ON na.vec_id = a.vec_id JOIN n nb ON nb.vec_id = b.vec_id GROUP BY a.vec_id, b.vec_id HAVING round(1e6 * sum(a.z / na.n * b.z / nb.n)) >= 450000),
walk AS (SELECT vec_id AS a, vec_id AS b FROM n UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a)
SELECT CAST(a AS BIGINT) AS vec_id, CASE WHEN count(*) > 1 THEN CAST(min(b) AS BIGINT) END AS "group" FROM walk GROUP BY a""",
    "dense_codes": "SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)",
    "random_split": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('7|' || p_partkey), p_partkey) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN rn <= floor(0.8 * n) THEN 'train' WHEN rn <= floor(0.8 * n) + floor(0.1 * n) THEN 'valid' ELSE 'test' END AS split FROM r",
    "split_leak": "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY md5('7|' || p_partkey), p_partkey) <= floor(0.8 * count(*) OVER ()) AS train FROM part) SELECT count(*) AS leaked FROM (SELECT p_brand FROM r WHERE train INTERSECT SELECT p_brand FROM r WHERE NOT train)",
    "stratified_signature_split": "WITH r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS m, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings), e AS (SELECT *, CASE WHEN m < 2 THEN 0 ELSE least(m - 1, greatest(1, (2 * m + 5) // 10)) END AS ne FROM r) SELECT vec_id, CASE WHEN rn > ne THEN 'train' WHEN ne = 1 AND md5(CAST(label AS VARCHAR)) < '8' OR ne > 1 AND rn <= ne // 2 THEN 'test' ELSE 'valid' END AS split FROM e",
    "new_signature_holdout": "WITH r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS m, row_number() OVER (PARTITION BY label ORDER BY md5('h' || vec_id), vec_id) AS rn FROM embeddings) SELECT vec_id, m >= 2 AND rn <= least(greatest(round_even(m / 20.0, 0), 1), m - 1) AS held FROM r",
    "capped_sample": "SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('s' || vec_id), vec_id) <= 5",
    "train_probe": "SELECT CAST(vec_id AS BIGINT) AS vec_id FROM embeddings WHERE md5('split|' || vec_id) >= '3' ORDER BY md5('probe|' || vec_id), vec_id LIMIT 50",
    "matched_depth_filters": f"WITH {_matched('CAST(label AS BIGINT)', ARMS, 4)}, n(arm, name) AS (VALUES {', '.join(f'({k}, {chr(39)}{n}{chr(39)})' for k, n in enumerate(signal.ARMS))}), s AS (SELECT arm, count(*) AS kept FROM k GROUP BY arm), m AS (SELECT arm, round(avg(c), 6) AS c, count(*) AS n FROM sim GROUP BY arm) SELECT s.arm::BIGINT AS arm, n.name, round(s.kept / (SELECT kept FROM s WHERE arm = 0)::DOUBLE, 6) AS kept, m.c AS self_cosine, round(m.c - (SELECT c FROM m WHERE arm = 0), 6) AS delta, coalesce(m.n, 0) AS n_groups FROM s JOIN n ON s.arm = n.arm LEFT JOIN m ON m.arm = s.arm",
    "pair_correlation": f"WITH {_matched(BY_3, [ARMS[0], ARMS[1], ARMS[3]], 2)}, m AS (SELECT arm, avg(half) AS h, count(*) AS n FROM sim GROUP BY arm), c AS (SELECT arm, corr(chem, bio) AS r FROM bio JOIN chem ON bio.i = chem.i AND bio.j = chem.j GROUP BY arm) SELECT m.arm::BIGINT AS arm, round(2 * h / (1 + h), 6) AS reliability, round(r, 6) AS corr, round(r / sqrt(greatest(2 * h / (1 + h), 1e-9)), 6) AS disattenuated, n AS n_groups FROM m JOIN c ON m.arm = c.arm",
    "annotation_similarity": f"""WITH {_matched(BY_10, ["true"], 2).replace("GROUP BY g HAVING count(*) = 1)", "AND g % 7 <> 6 AND (g % 5 < 4 OR g % 11 < 4 OR g % 11 = 10) GROUP BY g HAVING count(*) = 1)")},
t AS (SELECT g, CAST(g % 5 AS VARCHAR) AS t FROM ok WHERE g % 5 < 4 UNION SELECT g, CAST(g % 11 AS VARCHAR) FROM ok WHERE CAST(g % 11 AS VARCHAR) < '4'),
z AS (SELECT bio, chem, bio.i % 7 = bio.j % 7 AS moa, EXISTS (SELECT 1 FROM t a JOIN t b ON a.t = b.t WHERE a.g = bio.i AND b.g = bio.j) AS target FROM bio JOIN chem ON bio.i = chem.i AND bio.j = chem.j),
kinds AS (SELECT 'unrelated (baseline)' AS name, bio FROM z WHERE NOT moa AND NOT target AND chem < 0.4 UNION ALL SELECT 'Tanimoto >= 0.7', bio FROM z WHERE chem >= 0.7 UNION ALL SELECT 'same target', bio FROM z WHERE target UNION ALL SELECT 'same MOA', bio FROM z WHERE moa UNION ALL SELECT 'same target, Tanimoto < 0.4', bio FROM z WHERE target AND chem < 0.4),
b AS (SELECT avg(bio) AS b FROM kinds WHERE name = 'unrelated (baseline)'), top AS (SELECT avg(half) AS top FROM sim)
SELECT name, count(*) AS n_pairs, round(avg(bio), 6) AS cosine, round((avg(bio) - any_value(b)) / greatest(any_value(top) - any_value(b), 1e-9), 6) AS fraction FROM kinds, b, top GROUP BY name HAVING count(*) >= 20""",
    "block_correlation": f"WITH {_matched(BY_10, ['true'], 2)}, d AS (SELECT g, (p - 1) // 16 AS block, p, arg_min(x, vec_id) AS x FROM v WHERE g IN (SELECT g FROM ok) GROUP BY g, p), dn AS (SELECT g, block, greatest(sqrt(sum(x * x)), 1e-9) AS n FROM d GROUP BY g, block), dc AS (SELECT i.block, i.g AS i, j.g AS j, sum(i.x / ni.n * j.x / nj.n) AS c FROM d i JOIN d j ON i.p = j.p AND i.g < j.g JOIN dn ni ON ni.g = i.g AND ni.block = i.block JOIN dn nj ON nj.g = j.g AND nj.block = j.block GROUP BY i.block, i.g, j.g), hh AS (SELECT avg(half) AS h FROM sim), rr AS (SELECT block, corr(c, bio) AS r, corr(c, bio) / sqrt(greatest(any_value(2 * h / (1 + h)), 1e-9)) AS dis FROM dc JOIN bio ON dc.i = bio.i AND dc.j = bio.j, hh GROUP BY block), m AS (SELECT a.block, median(abs(b.dis)) AS rest FROM rr a JOIN rr b ON a.block <> b.block GROUP BY a.block) SELECT row_number() OVER (ORDER BY abs(dis) DESC, r.block) AS place, r.block::BIGINT AS block, round(r, 6) AS corr, round(dis, 6) AS disattenuated, abs(dis) > 3 * rest AS circular FROM rr r JOIN m ON r.block = m.block",
    "group_split": _greedy("p_brand"),
    "moa_split": _greedy("CASE WHEN p_type <> 'STANDARD' THEN p_brand END"),
}
