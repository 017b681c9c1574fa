"""Tables in the folder that driver and executors share, and columns of any name carried through an operator."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_tables: list[str] = []


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tessera-{os.getuid()}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _files(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors.

    The table goes when it is released or the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A mark for release: tables written from now on."""
    return len(_tables)


def release(spark, since: int, keep: int = 0) -> None:
    """Deletes the tables written since the mark, but for the newest ones to keep."""
    gone = _tables[since : len(_tables) - keep]
    del _tables[since : len(_tables) - keep]
    for path in gone:
        delete(spark, path)


def write_text(spark, path: str, text: str) -> None:
    """A small file, which is there whole or not at all: written beside its place and renamed over what is there."""
    at, files = _files(spark, path)
    beside = at.suffix(f".{uuid.uuid4().hex}")
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(beside), files.makeQualified(at), how)


def read_text(spark, path: str) -> str | None:
    """A small file's text, None if it isn't there."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return None
    found = files.open(at)
    try:
        return bytes(found.readAllBytes()).decode()
    finally:
        found.close()


def names(spark, path: str) -> list[str]:
    at, files = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def delete(spark, path: str) -> None:
    at, files = _files(spark, path)
    files.delete(at, True)


def named(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame) -> Column:
    """All columns of docs as one, `row`, so that none can clash with those an operator adds."""
    return F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row")


def unboxed(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of docs, out of `row`, some of them replaced."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def partitions(spark, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
