"""Reliability of groups of vectors: agreement with replicates, split halves, filters at matched depth, and what goes with
similar responses. rows hold key, group and vec; order and halves come from hashes.

Groups too small for a measure have none (null), never an error.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import order, vectors
from tessera.operators.vectors import dot, norm

#: Depths, as first and one past the last.
DEPTHS = ((4, 6), (6, 10), (10, 20), (20, 60), (60, None))
#: The arms' names, which hold their thresholds.
ARMS = ("none (baseline)", "dose >= 1 uM", "dose >= 10 uM", "time >= 24 h", "dose>=1 & time>=24", "drop weakest 25% (L2)", "drop 25% outliers (LOO)", "LOO + dose>=1 + t>=24")
PLACES = 6


def cosine(a: Column, b: Column, least: float = 1e-9) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(least))


def quality(rows: DataFrame) -> DataFrame:
    """rows with norm, n (rows of the group) and loo, the cosine with the mean of the group's other rows, 0 where there are none."""
    mean = vectors.consensus(rows, "group").select("group", F.col("vec").alias("mean"), "n")
    full = rows.join(mean, "group")
    v = F.transform("vec", lambda x: x.cast("double"))
    rest = F.zip_with(v, "mean", lambda x, m: (m * F.col("n") - x) / F.greatest(F.col("n") - 1, F.lit(1)))
    alone = F.col("n") < 2
    return full.withColumns({"norm": F.round(norm(v), PLACES), "loo": F.when(alone, F.lit(0e0)).otherwise(F.round(cosine(v, rest), PLACES))}).drop("mean")


def quality_filter(rows: DataFrame, min_depth: int | None = None, min_dose: float | None = None, min_time: float | None = None, drop_outliers: float = 0.0, restrict: Column | None = None) -> DataFrame:
    """rows with keep. restrict says which rows may be dropped at all; rows alone in their group are no outliers.

    The outliers' threshold is a quantile over all eligible scorable rows, whatever their dose and time. A missing dose
    fails any dose; a missing time has been filled before. Columns dose and time are read where asked for.
    """
    known = storage.written(quality(rows).withColumn("eligible", restrict if restrict is not None else F.lit(True)), "quality")
    keep = F.lit(True)
    if min_depth is not None:
        keep = keep & (F.col("n") >= min_depth)
    if min_dose is not None:
        keep = keep & F.coalesce(F.col("dose") >= min_dose, F.lit(False))
    if min_time is not None:
        keep = keep & F.coalesce(F.col("time") >= min_time, F.lit(False))
    if drop_outliers > 0:
        pool = F.col("eligible") & (F.col("n") >= 2) & ~F.isnan("loo")
        cut = order.quantile(known.where(pool), [], "loo", drop_outliers, "cut")
        known = known.crossJoin(F.broadcast(cut))  # one row
        keep = keep & (~pool | F.coalesce(F.col("loo") >= F.col("cut"), F.lit(True)))
        return known.withColumn("keep", keep | ~F.col("eligible")).drop("cut")
    return known.withColumn("keep", keep | ~F.col("eligible"))


def masks() -> dict[str, Column]:
    """The named filters, as conditions on dose, time, norm, loo and the quantiles q_norm and q_loo."""
    dose, time, loo = (lambda x: F.col("dose") >= x), F.col("time") >= 24, F.col("loo") >= F.col("q_loo")
    conditions = [F.lit(True), dose(1), dose(10), time, dose(1) & time, F.col("norm") >= F.col("q_norm"), loo, loo & dose(1) & time]
    return dict(zip(ARMS, conditions))


def arms(rows: DataFrame, names: list[str] | None = None, quantile: float = 0.25) -> DataFrame:
    """(arm, name, key, group, vec): the rows that each named filter keeps. rows need dose and time."""
    known = storage.written(quality(rows), "quality")
    cuts = order.quantile(known, [], "norm", quantile, "q_norm").crossJoin(order.quantile(known.where(~F.isnan("loo")), [], "loo", quantile, "q_loo"))
    full = known.crossJoin(F.broadcast(cuts))  # one row
    kinds = [(n, c) for n, c in masks().items() if names is None or n in names]
    flags = F.array(*[F.when(c, F.struct(F.lit(k).alias("arm"), F.lit(n).alias("name"))) for k, (n, c) in enumerate(kinds)])
    return full.select("key", "group", "vec", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("a")).select("a.arm", "a.name", "key", "group", "vec")


def matched(kept: DataFrame, k: int) -> DataFrame:
    """(arm, group, a, b): means of two lots of k rows, by hash, of the groups that have 2 k under every arm."""
    order = F.row_number().over(W.partitionBy("arm", "group").orderBy(F.md5(F.concat(F.col("arm").cast("string"), F.lit("|"), F.col("key").cast("string"))), "key"))
    some = kept.withColumn("rn", order).where(F.col("rn") <= 2 * k)
    n_arms = kept.select("arm").distinct().agg(F.count(F.lit(1)).alias("arms"))
    common = some.where(F.col("rn") == 2 * k).groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n_arms)).where("n = arms").select("group")
    some = some.join(common, "group").withColumn("both", F.concat_ws("|", "arm", (F.col("rn") <= k).cast("int"), F.col("group").cast("string")))
    means = vectors.consensus(some, "both").withColumns({"arm": F.split("both", r"\|")[0].cast("int"), "first": F.split("both", r"\|")[1] == "1", "group": F.substring_index("both", "|", -1)})
    kind = kept.schema["group"].dataType
    first = lambda flag: F.max(F.when(F.col("first") == flag, F.col("vec")))
    return means.groupBy("arm", F.col("group").cast(kind).alias("group")).agg(first(True).alias("a"), first(False).alias("b"))


def filter_comparison(kept: DataFrame, k: int = 4) -> DataFrame:
    """(arm, name, kept, self_cosine, delta, n_groups): agreement of halves under each filter, groups and depth alike."""
    kept = storage.written(kept, "arms")
    c = F.when(norm(F.col("a")) * norm(F.col("b")) > 0, cosine(F.col("a"), F.col("b"), 1e-300))
    each = matched(kept, k).groupBy("arm").agg(F.round(F.avg(c), PLACES).alias("self_cosine"), F.count(F.lit(1)).alias("n_groups"))
    sizes = kept.groupBy("arm", "name").agg(F.count(F.lit(1)).alias("n"))
    full = sizes.join(each, "arm", "left")
    base = F.broadcast(full.where("arm = 0").select(F.col("n").alias("n0"), F.col("self_cosine").alias("c0")))  # one row
    full = full.crossJoin(base)
    return full.select("arm", "name", F.round(F.col("n") / F.col("n0"), PLACES).alias("kept"), "self_cosine", F.round(F.col("self_cosine") - F.col("c0"), PLACES).alias("delta"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"))


def split_half(rows: DataFrame, least: int = 4) -> DataFrame:
    """(group, n, a, b): unit means of two halves by hash, of groups with `least` rows, two of them in each half."""
    half = F.when(F.md5(F.concat(F.lit("half"), F.col("key").cast("string"))) < "8", 0).otherwise(1)
    sides = [vectors.consensus(rows.where(half == s), "group").select("group", vectors.unit("vec").alias("ab"[s]), F.col("n").alias(f"n{s}")) for s in (0, 1)]
    both = sides[0].join(sides[1], "group").withColumn("n", F.col("n0") + F.col("n1"))
    return both.where((F.col("n0") >= 2) & (F.col("n1") >= 2) & (F.col("n") >= least)).select("group", "n", "a", "b")


def self_cosines(rows: DataFrame, least: int = 4) -> DataFrame:
    """(group, n, self_cosine, reliability), the latter stepped up to both halves together."""
    c = F.round(dot(F.col("a"), F.col("b")), PLACES)
    return split_half(rows, least).select("group", "n", c.alias("self_cosine"), F.round(2 * c / F.nullif(1 + c, F.lit(0e0)), PLACES).alias("reliability"))


def noise_ceiling(rows: DataFrame, least: int = 4, bin_least: int = 21) -> DataFrame:
    """(depth, n, mean, median): over all groups, and by depth, where a depth has bin_least groups."""
    each = self_cosines(rows, least)
    label = reduce(lambda c, d: c.when((F.col("n") >= d[0]) & (F.col("n") < (d[1] or 1 << 62)), f"{d[0]}-{d[1] - 1}" if d[1] else f">={d[0]}"), DEPTHS, F.when(F.lit(False), ""))
    both = each.select(F.explode(F.array(F.lit("all"), label)).alias("depth"), "self_cosine").where("depth is not null")
    got = both.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("self_cosine"), PLACES).alias("mean"), F.round(F.median("self_cosine"), PLACES).alias("median"))
    return got.where((F.col("depth") == "all") | (F.col("n") >= bin_least))


def random_pairs(rows: DataFrame, most: int = 2000) -> DataFrame:
    """One row: pairs and their mean cosine, of the first halves of up to `most` groups by hash.

    The mean follows from the length of the sum of the unit vectors, so no pairs are formed.
    """
    some = split_half(rows, 0).select("group", "a").orderBy(F.md5(F.col("group").cast("string")), "group").limit(most)
    at = some.select(F.posexplode("a")).groupBy("pos").agg(F.sum("col").alias("t"), F.sum(F.col("col") * F.col("col")).alias("q"), F.count(F.lit(1)).alias("k"))
    one = at.agg((F.sum(F.col("t") * F.col("t")) - F.sum("q")).alias("d"), F.max("k").alias("k"))
    k = F.coalesce(F.col("k"), F.lit(0))
    return one.select((k * (k - 1) / 2).cast("long").alias("pairs"), F.round(F.col("d") / F.nullif(k * (k - 1e0), F.lit(0e0)), PLACES).alias("cosine"))


def _pairs(measure):
    """measure(query part, bank part) gives (condition or None, x, y) of all pairs by name; sums of those with a < b."""

    def work(queries, bank):
        sums: dict[str, np.ndarray] = {}
        for b in bank:
            for q in queries:
                below = np.asarray(q["id"])[:, None] < np.asarray(b["id"])[None, :]
                for name, mask, x, y in measure(q, b):
                    at = below if mask is None else below & mask
                    x, y = x[at], y[at]
                    sums[name] = sums.get(name, 0) + np.array([at.sum(), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()])
        if sums:
            yield pa.record_batch([pa.array(list(sums)), *(pa.array(c) for c in np.array(list(sums.values())).T)], names=["name", "n", "x", "y", "xx", "yy", "xy"])

    return work


def pair_sums(items: DataFrame, measure) -> DataFrame:
    """(name, n, x, y, corr) over the pairs a < b of items (id, vec, ...): tasks send sums, never pairs."""
    items = storage.written(items, "items")
    n = items.count()
    got = vectors.grid(items, items, _pairs(measure), "name string, n double, x double, y double, xx double, yy double, xy double", n, n)
    one = got.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    spread = F.sqrt(F.greatest(F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.lit(0e0))) * F.sqrt(F.greatest(F.col("n") * F.col("yy") - F.col("y") * F.col("y"), F.lit(0e0)))
    corr = F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(spread, F.lit(0e0)))
    return one.select("name", F.col("n").cast("long").alias("n"), (F.col("x") / F.nullif(F.col("n"), F.lit(0e0))).alias("x"), (F.col("y") / F.nullif(F.col("n"), F.lit(0e0))).alias("y"), corr.alias("corr"))


def _matrix(part, name):
    return vectors.matrix(part[name])


def _tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = a @ b.T
    return both / np.maximum(a.sum(1)[:, None] + b.sum(1) - both, 1)


def halves_of(rows: DataFrame, k: int) -> DataFrame:
    """(group, a, b) of groups with 2 k rows."""
    return matched(rows.select(F.lit(0).alias("arm"), "key", "group", "vec"), k).select("group", "a", "b")


def _full(halves: DataFrame) -> DataFrame:
    both = halves.withColumn("vec", F.zip_with("a", "b", lambda x, y: (x + y) / 2))
    return both.withColumns({"vec": vectors.unit("vec"), "half": dot(vectors.unit("a"), vectors.unit("b"))})


def reliability(half: Column) -> Column:
    return 2 * half / F.nullif(1 + half, F.lit(0e0))


def disattenuated(r: Column, rel: Column) -> Column:
    return r / F.sqrt(F.greatest(rel, F.lit(1e-9)))


def pair_correlation(kept: DataFrame, bits: DataFrame, k: int = 6) -> DataFrame:
    """(arm, reliability, corr, disattenuated, n_groups): bits' Tanimoto against the cosine of responses, for each filter.

    bits (group, bits of 0 and 1); groups are those with 2 k rows under every filter.
    """
    halves = storage.written(matched(kept, k).join(bits, "group"), "halves")
    full = storage.written(_full(halves), "full")
    stats = full.groupBy("arm").agg(reliability(F.avg("half")).alias("rel"), F.count(F.lit(1)).alias("n_groups"))

    def measure(q, b):
        arms_q, arms_b = np.asarray(q["arm"]), np.asarray(b["arm"])
        chem, bio = _tanimoto(_matrix(q, "bits"), _matrix(b, "bits")), q["vec"] @ b["vec"].T
        for arm in np.intersect1d(arms_q, arms_b).tolist():
            yield str(arm), (arms_q == arm)[:, None] & (arms_b == arm)[None, :], chem, bio

    got = pair_sums(full.select(F.col("group").alias("id"), "arm", "bits", "vec"), measure)
    both = stats.join(got.withColumn("arm", F.col("name").cast("int")), "arm")
    return both.select("arm", F.round("rel", PLACES).alias("reliability"), F.round("corr", PLACES).alias("corr"), F.round(disattenuated(F.col("corr"), F.col("rel")), PLACES).alias("disattenuated"), "n_groups")


def annotation_similarity(rows: DataFrame, notes: DataFrame, k: int = 6, least: int = 50, pairs_least: int = 20) -> DataFrame:
    """(name, n_pairs, cosine, fraction): mean cosine of responses of pairs alike in label, target or bits.

    notes (group, moa, targets, bits): groups need both annotations. fraction is the way from the unrelated pairs' mean to
    the halves' own. Under `least` groups there is one row, a note; kinds with under pairs_least pairs are left out.
    """
    usable = notes.where("moa is not null and moa <> '' and size(targets) > 0")
    full = storage.written(_full(halves_of(rows, k).join(usable, "group")), "full")
    n, top = full.agg(F.count(F.lit(1)), F.avg("half")).first()
    if n < least:
        return rows.sparkSession.createDataFrame([("too few annotated groups", n, None, None)], "name string, n_pairs long, cosine double, fraction double")

    def measure(q, b):
        chem, bio = _tanimoto(_matrix(q, "bits"), _matrix(b, "bits")), q["vec"] @ b["vec"].T
        moa = np.array(q["moa"].to_pylist(), object)[:, None] == np.array(b["moa"].to_pylist(), object)[None, :]
        mine, theirs = q["targets"].to_pylist(), b["targets"].to_pylist()
        known = {t: k for k, t in enumerate(sorted({t for ts in mine + theirs for t in ts}))}
        has = lambda lists: np.array([[t in ts for t in known] for ts in map(set, lists)], float)
        target = has(mine) @ has(theirs).T > 0
        # The kinds' names and bounds.
        kinds = {"unrelated (baseline)": ~moa & ~target & (chem < 0.4), "Tanimoto >= 0.7": chem >= 0.7, "same target": target, "same MOA": moa, "same target, Tanimoto < 0.4": target & (chem < 0.4)}
        for name, mask in kinds.items():
            yield name, mask, chem, bio

    got = storage.written(pair_sums(full.select(F.col("group").alias("id"), "moa", "targets", "bits", "vec"), measure), "kinds")
    base = F.broadcast(got.where("name = 'unrelated (baseline)'").select(F.col("y").alias("base")))  # one row
    both = got.where(F.col("n") >= pairs_least).crossJoin(base)
    return both.select("name", F.col("n").alias("n_pairs"), F.round("y", PLACES).alias("cosine"), F.round((F.col("y") - F.col("base")) / F.greatest(F.lit(top) - F.col("base"), F.lit(1e-9)), PLACES).alias("fraction"))


def block_correlation(rows: DataFrame, descriptors: DataFrame, blocks: int, k: int = 6, most: int = 1200) -> DataFrame:
    """(place, block, corr, disattenuated, circular): cosine of each of `blocks` equal blocks of descriptors (group, desc)
    against that of the responses, strongest first. A block over three times the median of the others is suspected of being
    made from the responses themselves. Up to `most` groups, by hash."""
    some = halves_of(rows, k).join(descriptors, "group").orderBy(F.md5(F.col("group").cast("string")), "group").limit(most)
    full = storage.written(_full(some), "full")

    def measure(q, b):
        bio, x, y = q["vec"] @ b["vec"].T, _matrix(q, "desc"), _matrix(b, "desc")
        for i, (s, t) in enumerate(zip(np.array_split(x, blocks, 1), np.array_split(y, blocks, 1))):
            s, t = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) for m in (s, t))
            yield str(i), None, s @ t.T, bio

    got = pair_sums(full.select(F.col("group").alias("id"), "desc", "vec"), measure)
    rel = F.broadcast(full.agg(reliability(F.avg("half")).alias("rel")))  # one row
    each = storage.written(got.crossJoin(rel).select(F.col("name").cast("long").alias("block"), "corr", disattenuated(F.col("corr"), F.col("rel")).alias("dis")), "blocks")
    others = each.alias("a").join(each.alias("b"), F.col("a.block") != F.col("b.block")).groupBy("a.block").agg(F.median(F.abs(F.col("b.dis"))).alias("rest"))  # a row a pair of blocks
    place = F.row_number().over(W.orderBy(F.desc(F.abs("dis")), "block"))
    full = each.join(others, "block", "left")
    return full.select(place.cast("long").alias("place"), "block", F.round("corr", PLACES).alias("corr"), F.round("dis", PLACES).alias("disattenuated"), F.coalesce(F.abs("dis") > 3 * F.col("rest"), F.lit(False)).alias("circular"))
