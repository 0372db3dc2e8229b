"""Shared pieces of the corpus operators: shared-folder tables, ranks, size-checked joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as every operator here reads it.
SPACES = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only when it was counted and is no larger than this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may do without: a temporary folder is used then. Anywhere else a folder of
    one machine would lose rows, so a cluster that names none is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evispark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Written tables that are still there, in the order of writing.
_tables: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage: a lost executor costs its own tasks, not the plan above. The files go when the
    operator is done with them (see ``settled``), at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written; every other table that was written on the way is deleted."""
    before = len(_tables)
    out = materialise(make())
    _delete(_tables[before:-1])
    del _tables[before:-1]
    return out


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


atexit.register(_delete, _tables)


def _plain(df: DataFrame) -> bool:
    """Whether ``df`` is columns and rows of Parquet files, chosen by fixed expressions only."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:  # files of another kind, or no files
        return False
    return True


def stable(docs: DataFrame) -> DataFrame:
    """``docs``, written first unless it is a scan of Parquet files: so that each scan of it has the same rows."""
    return docs if _plain(docs) else materialise(docs)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or the like if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _dealt(docs: DataFrame, n_parts: int) -> DataFrame:
    """``docs`` over all cores if it comes in so few partitions that half of them would idle: a small table, then."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 0 < 2 * n_parts <= cores else docs


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out over the cores if its rows are in few partitions (one file of one row group, say)."""
    part = F.spark_partition_id()
    return _dealt(docs, docs.groupBy(part).agg(F.count(F.lit(1))).count())


def numbered(docs: DataFrame, *columns: Column, name: str = "row_no") -> DataFrame:
    """``columns`` of ``docs`` (all, if none is given) and ``name``: a whole number that is the row's own.

    It is made of the place of the row's file among the files and the row's place in its file, so it is the
    same for each scan, however Spark cuts the files up and however many executors there are. Rows that come
    from anything but Parquet files are written first; pass ``stable(docs)`` to number the same rows twice.
    """
    docs = stable(docs)
    meta = docs.metadataColumn("_metadata")
    file, index, at, part = (fresh(docs, x) for x in ("__file", "__index", "__at", "__part"))
    scanned = docs.select(meta["file_path"].alias(file), F.spark_partition_id().alias(part)).groupBy(file, part).agg(F.count(F.lit(1)))
    scanned = materialise(scanned.select(file, part))  # reads no column
    n_files, n_parts = scanned.agg(F.countDistinct(file), F.countDistinct(part)).first()
    files = scanned.select(file).distinct().withColumn(at, (F.row_number().over(Window.orderBy(file)) - 1).cast("long"))
    rows = _dealt(docs.select("*", meta["file_path"].alias(file), meta["row_index"].alias(index)), n_parts)
    chosen = [*columns] or [F.col(f"`{c}`") for c in docs.columns]
    rows = rows.select(*chosen, F.col(file), F.col(index)).join(F.broadcast(files) if n_files <= BROADCAST_ROWS else files, file)
    own = F.shiftleft(F.col(at), 36) + F.col(index)
    return rows.select(own.alias(name), *(F.col(f"`{c}`") for c in rows.columns if c not in (file, index, at)))


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows. Of a written table this reads the files' footers only."""
    return df.count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is small enough, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if small_enough(df, limit) else df


#: Keys with more than one in so many rows of a table are joined by broadcast: there can't be more than that of them.
HOT = 10_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, times: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has each ``key`` once and in ``times`` how often ``rows`` has it.

    A key may hold any share of the rows: those with more than n_rows / HOT of them, HOT keys at most, are
    broadcast, so their rows stay where they are; the others shuffle.
    """
    hot = F.col(times) > n_rows / HOT
    often = table.where(hot)
    if not often.take(1):
        return rows.join(table, key)
    often = F.broadcast(often)  # fewer than HOT rows
    usual = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot), key)
    return rows.join(often, key).unionByName(usual)


def without(docs: DataFrame, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` less the rows whose numbers ``gone(docs)`` lists as ``row_no``; all columns stay."""
    docs = stable(docs)
    found, mine = settled(lambda: gone(docs).select("row_no")), fresh(docs, "__row_no")
    rows = numbered(docs, name=mine)
    found = checked_broadcast(found.withColumnRenamed("row_no", mine), 1_000_000)
    return rows.join(found, mine, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def buckets_for(n_rows: int, rows_per_bucket: int = 200, most: int = 100_000) -> int:
    """Into how many buckets a key's rows are dealt, so that no group of one key and bucket is large."""
    return max(1, min(most, -(-n_rows // rows_per_bucket)))


def rank_within(df: DataFrame, keys: list[str], order: list[str], n_rows: int, rank: str) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each key, without gaps.

    A key may hold any share of the rows: its rows are dealt by a hash of ``order`` into buckets, ranked
    inside each, and shifted by the sizes of the buckets before. Ranks follow (bucket, order), so they are
    the same whatever the partitioning.
    """
    b, n, base, local = (f"__rank_{x}" for x in ("b", "n", "base", "local"))
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets_for(n_rows))).cast("int"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(*keys, b)
        .agg(F.count(F.lit(1)).alias(n))
        .select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    )
    within = Window.partitionBy(*keys, b).orderBy(*order)
    return (
        dealt.withColumn(local, F.row_number().over(within) - 1)
        .join(bases, [*keys, b])
        .withColumn(rank, (F.col(base) + F.col(local)).cast("long"))
        .drop(b, base, local)
    )
