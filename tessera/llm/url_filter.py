"""URL filters from dated lists: a temporal join in DataFrame functions only.

A list is a log of dated entries (list, key, action, day). Each entry is in force from its day until the next entry of
the same list and key, so the log becomes validity intervals; an `add` interval lists the key, a `remove` interval
doesn't. A capture is looked up under its URL's host and every parent domain, as of the day it was fetched.

Nothing is broadcast by hand. Captures are counted by (host, day) first, so a host's pages meet its entries once a day,
not once a page. Of a host's parent domains only those that some list names go on; that look-up, the join with the
intervals and the way back to the captures are salted, SALT parts a key, so neither a domain that most hosts share nor a
host with most of the pages falls to one task.

Defined cases: null or unreadable URLs and days match nothing; of entries of one list, key and day the last action in
alphabetical order holds (`remove` over `add`); keys compare in lower case; repeated captures are judged alike; an empty
table of captures or entries gives no hits; all columns of the captures stay, whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.storage import boxed, unboxed

SALT = 16


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def suffixes(name: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.slice(parts, k, F.size(parts) - k + 1)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) of the entries that add; until is null while nothing follows."""
    log = entries.select("list", F.lower("key").alias("key"), "action", "day").where("list is not null and key is not null and day is not null")
    log = log.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(W.partitionBy("list", "key").orderBy("day"))
    return log.withColumn("until", until).where("action = 'add'").select("list", "key", F.col("day").alias("since"), "until")


def salted(rows: DataFrame) -> DataFrame:
    """Every row SALT times, once a salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """captures with lists, the sorted names of the lists in force for them on their day.

    Where the captures have a column of that name, the new one has as many underscores behind it as make it new.
    """
    into = "lists"
    while into in captures.columns:
        into += "_"
    rows = captures.select(boxed(captures), host(F.col(url)).alias("host"), F.col(day).alias("day"), F.pmod(F.spark_partition_id(), F.lit(SALT)).alias("salt"))
    known = F.col("host").isNotNull() & F.col("day").isNotNull()
    asked = rows.where(known).select("host", "day").distinct()
    log = intervals(entries)
    part = F.pmod(F.xxhash64("host"), F.lit(SALT)).cast("int").alias("salt")
    pairs = asked.select("host").distinct().select("host", part, F.explode(suffixes(F.col("host"))).alias("key"))
    pairs = pairs.join(salted(log.select("key").distinct()), ["key", "salt"], "left_semi")
    keys = asked.join(pairs, "host").select("host", "day", "key", F.pmod(F.xxhash64("host", "day"), F.lit(SALT)).cast("int").alias("salt"))
    hit = keys.join(salted(log), ["key", "salt"]).where("day >= since and (until is null or day < until)")
    lists = hit.groupBy("host", "day").agg(F.sort_array(F.collect_set("list")).alias("found"))
    none = F.array().cast("array<string>")
    full = rows.where(known).join(salted(lists), ["host", "day", "salt"], "left").select("row", F.coalesce("found", none).alias("found"))
    full = full.unionByName(rows.where(~known).select("row", none.alias("found")))
    return full.select(*unboxed(captures), F.col("found").alias(into))
