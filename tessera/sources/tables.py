"""Readers and writers of the engine's files: delimited metadata, query tables, keyed vectors, hit lists and reports.

Metadata is read as strings and cast with try_cast, so odd values become null instead of ending the read. "First row
wins" means first in the file: rows are ordered by file, by the split's start and by their place in the split.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage

SIGNATURE_COLUMNS = {
    "sig_id": ["sig_id"],
    "pert_id": ["pert_id"],
    "pert_type": ["pert_type"],
    "tas": ["tas"],
    "is_exemplar": ["is_exemplar_sig", "is_exemplar"],
    "cell": ["cell_iname", "cell_id"],
    "dose": ["pert_dose", "pert_idose"],
    "time": ["pert_time", "pert_itime"],
}
NUMBERS = {"tas": None, "dose": r"([\d.]+)", "time": r"([\d.]+)"}
COMPOUND_COLUMNS = {"pert_id": ["pert_id"], "smiles": ["canonical_smiles"], "moa": ["moa"], "target": ["target"]}


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header and string columns: tabs in .tsv and .txt files, else commas."""
    tabs = path.lower().removesuffix(".gz").endswith((".tsv", ".txt"))
    return spark.read.option("header", True).option("sep", "\t" if tabs else ",").option("quote", "" if tabs else '"').csv(path)


def place() -> Column:
    """A row's place in its file, for reads of which the first row of a key wins."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))


def aliased(table: DataFrame, columns: dict[str, list[str]]) -> list[Column]:
    """Each column under its first name that the table has, or null."""
    return [next((F.col(f"`{a}`") for a in names if a in table.columns), F.lit(None).cast("string")).alias(c) for c, names in columns.items()]


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signature metadata: tas, dose and time as numbers, of which dose and time are the first in their text."""
    table = delimited(spark, path)
    out = table.select(*aliased(table, SIGNATURE_COLUMNS))
    return out.withColumns({c: (F.regexp_extract(c, p, 1) if p else F.col(c)).try_cast("double") for c, p in NUMBERS.items()})


def compounds(spark: SparkSession, path: str) -> DataFrame:
    """Compound metadata, one row an id: the first of the file."""
    table = delimited(spark, path)
    rows = table.select(*aliased(table, COMPOUND_COLUMNS), place().alias("_at"))
    first = rows.groupBy("pert_id").agg(F.min_by(F.struct("smiles", "moa", "target"), "_at").alias("one"))
    return first.select("pert_id", "one.*")


def genes(spark: SparkSession, path: str, landmark: bool = True) -> DataFrame:
    """Genes with their place in the file as ord; of the landmark space only, if asked."""
    table = delimited(spark, path)
    if landmark:
        mark = F.col("feature_space") == "landmark" if "feature_space" in table.columns else F.col("pr_is_lm") == "1"
        table = table.where(mark)
    columns = {c: [c] for c in ("gene_id", "gene_symbol", "ensembl_id")}
    return table.select(*aliased(table, columns), place().alias("ord"))


def gene_aliases(table: DataFrame) -> DataFrame:
    """(alias, gene_id): symbols before Ensembl ids, upper case and trimmed; an alias of several genes is the first's."""
    kinds = [table.select(F.upper(F.trim(c)).alias("alias"), F.struct(F.lit(k).alias("p"), "ord").alias("at"), "gene_id") for k, c in enumerate(("gene_symbol", "ensembl_id"))]
    both = kinds[0].unionByName(kinds[1]).where("alias not in ('', '-')")
    return both.groupBy("alias").agg(F.min_by("gene_id", "at").alias("gene_id"))


def query_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, sample, value) of a wide table whose first column names genes; what is no number is null."""
    wide = delimited(spark, path)
    if len(wide.columns) < 2:
        raise ValueError(f"{path}: a column of genes and one of values at least are needed")
    key, *samples = wide.columns
    long = wide.unpivot([F.col(f"`{key}`").alias("key")], [F.col(f"`{c}`") for c in samples], "sample", "value")
    return long.toDF("key", "sample", "value").withColumn("value", F.col("value").try_cast("double"))


def resolved(query: DataFrame, known: DataFrame) -> DataFrame:
    """(gene_id, sample, value): keys that are gene ids as they stand, else by alias, else dropped; the mean of repeats."""
    exact = known.select(F.col("gene_id").alias("exact")).distinct()
    alias = gene_aliases(known).withColumnRenamed("gene_id", "aliased")
    keyed = query.withColumn("key", F.trim("key")).join(exact, F.col("key") == F.col("exact"), "left")
    found = keyed.join(alias, F.upper("key") == F.col("alias"), "left").withColumn("gene_id", F.coalesce("exact", "aliased"))
    return found.where("gene_id is not null").groupBy("gene_id", "sample").agg(F.avg("value").alias("value"))


def save_vectors(table: DataFrame, path: str, blocks: list[str] | None = None) -> None:
    """table (id, embedding), and the names of its equally wide blocks, if it has such."""
    table.select("id", "embedding").write.mode("overwrite").parquet(path)
    storage.write_text(table.sparkSession, f"{path}/_blocks", json.dumps(blocks or []))


def block_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the blocks of stored vectors, in their order; none for vectors that were stored without."""
    return json.loads(storage.read_text(spark, f"{path}/_blocks") or "[]")


def load_vectors(spark: SparkSession, path: str, bank: DataFrame, order: str | None = None) -> DataFrame:
    """bank (with a column id) and its vectors, in the order of one of its columns, if asked; an id without a vector is an
    error, and so is one with several."""
    stored = spark.read.parquet(path)
    lost = bank.select("id").join(stored, "id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"no vector for {', '.join(str(r.id) for r in lost)}")
    many = bank.select("id").join(stored, "id").groupBy("id").count().join(bank.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "id").where("count > own").limit(3).collect()
    if many:
        raise ValueError(f"several vectors for {', '.join(str(r.id) for r in many)}")
    full = bank.join(stored, "id")
    return full.orderBy(order) if order else full


def load_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Stored vectors that stand for the rows 0 to n - 1 of something, by their id as a number; others are an error."""
    stored = spark.read.parquet(path).withColumn("id", F.col("id").try_cast("long"))
    one = stored.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("id").alias("kinds"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if (one["all"], one.kinds) != (n, n) or n and (one.a, one.b) != (0, n - 1):
        raise ValueError(f"{path}: not the vectors of {n} rows")
    return stored


def select_blocks(table: DataFrame, names: list[str], wanted: list[str]) -> DataFrame:
    """table with the wanted ones of equally wide named blocks of embedding, in that order."""
    if unknown := [w for w in wanted if w not in names]:
        raise ValueError(f"unknown blocks: {', '.join(unknown)}")
    width = F.floor(F.size("embedding") / len(names)).cast("int")
    return table.withColumn("embedding", F.concat(*[F.slice("embedding", width * names.index(w) + 1, width) for w in wanted]))


def save_hits(hits: DataFrame, path: str) -> None:
    """Ranked hits as CSV with a header, cosine to six places; one folder of part files, in order of query and rank."""
    out = hits.select("query", "rank", "compound_id", F.when(F.col("cosine").isNotNull(), F.format_string("%.6f", "cosine")).alias("cosine"), "moa", "target", "smiles")
    out.repartitionByRange("query").sortWithinPartitions("query", "rank").write.mode("overwrite").option("header", True).csv(path)


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
