"""Session-level helpers: shared scratch tables, size-checked joins, row identity.

Everything here is about *where* data goes, never about what an operator
computes: operators stay pure DataFrame transformations and call these helpers
when a plan has to be cut or when a join side may be small enough to broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only after its rows and bytes were measured and found to be no more.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
ARROW_BATCH = "4m"
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What rows of a Parquet file may take in memory for each byte stored; short strings such as names and ids are packed so well.
PACKED = "16.0"
_PACKED = "spark.sql.sources.fileCompressionFactor"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay below ARROW_BATCH, unless the session sets a size of its own."""
    if spark.conf.get("spark.gleaner.arrowBatch", None) is None:
        spark.conf.set("spark.gleaner.arrowBatch", ARROW_BATCH)
        if spark.conf.get(_ARROW, None) in (None, "67108864b"):
            spark.conf.set(_ARROW, ARROW_BATCH)


def bound_broadcasts(spark: SparkSession) -> None:
    """The planner takes a file for as large as its rows may be in memory, unless the session says how large.

    By bytes stored it would send a million packed names through the driver; what proves small is still broadcast, by AQE.
    """
    if spark.conf.get("spark.gleaner.packed", None) is None:
        spark.conf.set("spark.gleaner.packed", PACKED)
        if float(spark.conf.get(_PACKED, "1.0")) == 1.0:
            spark.conf.set(_PACKED, PACKED)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table `table` below `sf_dir`, on any file system Spark reads."""
    bound_batches(spark)
    bound_broadcasts(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores where it has fewer partitions than there are; a large input is left as it is.

    For row functions that cost far more than moving their rows, such as chunking and tokenising.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where the setting is absent the session must be local; a temporary folder
    is then made once, remembered in the session and removed at exit. On a
    cluster an absent setting is an error, since a machine-local folder would
    lose files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gleaner.scratch.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="gleaner-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("gleaner.scratch.dir", f"file://{folder}")
    return f"file://{folder}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder, in a folder of this application."""
    return f"{scratch_root(spark)}/gleaner-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; call it once every result that was asked for has been read."""
    _remove(spark, f"{scratch_root(spark)}/gleaner-{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in shared scratch and read it back.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the
    upstream plan, and later plans see the true file size of the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of `materialise` whose every consumer has itself been written; others are left alone."""
    for table in tables:
        if table is not None and (path := getattr(table, "scratch", None)):
            _remove(table.sparkSession, path)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """The size of a value in memory, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        size = F.size(c) * 8
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        size = F.octet_length(F.to_json(c))
    else:
        return F.lit(8)
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)) + 16


def measured(df: DataFrame) -> tuple[int, int]:
    """The rows of `df` and their bytes in memory, about; one distributed aggregate."""
    size = F.lit(16)
    for field in df.schema.fields:
        size = size + _bytes(F.col(f"`{field.name}`"), field.dataType)
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return rows, total or 0


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most `limit` rows of at most `most_bytes` in all."""
    rows, total = measured(df)
    return rows <= limit and total <= most_bytes


def private(df: DataFrame, *names: str) -> list[str]:
    """`names` with more leading underscores than any column of `df` has, so that they clash with none."""
    depth = 1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)
    return ["_" * depth + n for n in names]


def checked_join(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts `right` only if its rows and bytes were measured to be few.

    `right` is read twice, so it should be a table of `materialise` or a cheap
    scan. Beyond the limits the join is left to the planner (sort-merge, split
    by AQE where a key is skewed).
    """
    return left.join(F.broadcast(right) if is_small(right, limit) else right, on, how)


def with_row_ids(df: DataFrame, id_col: str, uid: str) -> DataFrame:
    """`df` with a unique, non-null long `uid` for each row.

    Where `id_col` is an integer key without nulls or repeats, it serves itself.
    Else the rows are written out once with generated ids, so that every later
    scan sees the same ones.
    """
    integral = dict(df.dtypes).get(id_col) in ("bigint", "int", "smallint", "tinyint")
    if integral:
        n, ids = df.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col))).first()
        if n == ids:
            return df.withColumn(uid, F.col(id_col).cast("long"))
    return materialise(df.withColumn(uid, F.monotonically_increasing_id()), "rows")
