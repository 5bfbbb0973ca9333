"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one ranking bucket should hold, and the most buckets made.
BUCKET_ROWS = 256
MAX_BUCKETS = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares; a local one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="octetloom-")
    return f"file://{_local}"


_local: str | None = None


#: Rows that Python workers get at once where rows hold whole texts.
TEXT_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    so a lost executor costs no more than the tasks it was running. Python
    workers get ``batch_rows`` rows at once at most, if given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    if batch_rows and not 0 < int(before) <= batch_rows:
        spark.conf.set(BATCH, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote for ``df`` and nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def buckets_for(n: int) -> int:
    b = 1
    while b < MAX_BUCKETS and b * BUCKET_ROWS < n:
        b *= 2
    return b


def with_rank(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the row's exact 0-based rank within ``groups`` by
    (bucket, *order), with ``out_total``, the group's row count.

    No task ever holds a whole group: rows are dealt by (groups, bucket), each
    bucket is numbered alone, and a small table of bucket counts (one row per
    group and bucket) gives the offsets. ``groups`` must not be null;
    ``bucket`` must never decrease along ``order``.
    """
    keys = [*groups, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(f"{out}_total"),
    )
    within = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        within.join(offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_before")
    )


def boxed(df: DataFrame, drop: list[str]) -> tuple[DataFrame, list[Column]]:
    """(``df`` with all columns but ``drop`` in one struct ``row``, so that no
    name clashes with an operator's own; the columns that can order ties)."""
    kept = unclashing(df, drop)
    ties = [F.col("row").getField(c) for c, kind in kept.dtypes if not kind.startswith(("map", "variant"))]
    return kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")), ties


def shuffled_key(doc_id: Column, seed: int) -> Column:
    """A seeded order of documents that any SQL engine can repeat: MD5 of
    ``seed:doc_id`` (a null id counts as the empty string)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def hash_bucket(md5: Column, buckets: int) -> Column:
    """``buckets`` (a power of two, 65,536 at most) ranges of an MD5 string."""
    return (F.conv(F.substring(md5, 1, 4), 16, 10).cast("long") * buckets / 65536).cast("long")


def unclashing(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns whose names an operator is about to add."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])
