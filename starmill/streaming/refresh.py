"""Refresh sets applied from a folder that numbered files arrive in.

``orders.tbl.uN`` and ``lineitem.tbl.uN`` hold new rows of set N and ``delete.N`` the
order keys to delete. A streaming query reads each file once and files its rows in a
change log, one folder per micro-batch and set; a replayed batch overwrites its own folder.
A lost executor or a restart from the checkpoint cannot apply a set twice, and a set may be
spread over batches.

Sets that are finished are folded, once, into a snapshot of both tables; what a call returns
is the last snapshot with newer sets applied, so it reads no older part of the log. The last
``open_sets`` sets may still grow; older ones are finished. A snapshot counts once both its
tables are written, so one that was broken off is made again. What arrives for a set that is
already folded is filed like the rest but no longer applied: ``late_sets`` names such sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.sources.files import schema

_FILES = {"orders": r"^orders\.tbl\.u(\d+)", "lineitem": r"^lineitem\.tbl\.u(\d+)",
          "delete": r"^delete\.(\d+)"}


def collect_changes(spark: SparkSession, incoming: str, work: str) -> None:
    """File all lines that have arrived into the change log and stop."""
    # Every line asks for its file's name, so that is cut out by splitting, not by search patterns.
    path, name, folder = F.col("path"), F.col("name"), F.col("folder")
    kind, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    lines = spark.readStream.format("text").option("recursiveFileLookup", True).load(incoming)
    # A set written by several tasks is a folder named like the single file.
    lines = lines.select("value", F.col("_metadata.file_path").alias("path")).withColumn(
        "name", F.substring_index("path", "/", -1)).withColumn(
        "folder", F.substring_index(F.substring_index("path", "/", -2), "/", 1))
    whole_folder = F.substr(path, F.lit(1), F.length(path) - F.length(name) - 1)
    delivery = path
    for table, pattern in _FILES.items():
        for source in (folder, name):
            matches = source.rlike(pattern)
            kind = F.when(matches, table).otherwise(kind)
            number = F.when(matches, F.regexp_extract(source, pattern, 1).cast("bigint")).otherwise(number)
        delivery = F.when(folder.rlike(pattern), whole_folder).otherwise(delivery)
    changes = lines.select(
        "value", kind.alias("kind"), number.alias("set_number"), delivery.alias("delivery")
    ).filter("kind is not null")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("set_number").parquet(f"{work}/log/batch={batch_id}")

    query = (
        changes.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _rows(log: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind, each as often as the delivery of its set that has it most.

    A delivery is a file, or a folder named like one. So parts of a set add up whenever
    they arrive, and a set that is delivered again counts once.
    """
    times = log.filter(F.col("kind") == kind).groupBy("set_number", "value", "delivery").agg(
        F.count(F.lit(1)).alias("n"))
    own = times.groupBy("set_number", "value").agg(F.max("n").alias("n")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    columns = schema(kind)
    cells = F.split("value", r"\|")
    return own.select(
        "set_number",
        *[F.get(cells, i).cast(f.dataType).alias(f.name) for i, f in enumerate(columns.fields)])


def _apply(base: DataFrame, inserted: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Base and inserted rows without those deleted in the same set or a later one."""
    last = deleted.groupBy(F.col("o_orderkey").alias("_gone")).agg(
        F.max("set_number").alias("_last"))
    rows = base.withColumn("set_number", F.lit(0).cast("bigint")).unionByName(
        inserted.select(*base.columns, "set_number"))
    return rows.join(
        last, (F.col(key) == F.col("_gone")) & (F.col("set_number") <= F.col("_last")), "left_anti"
    ).drop("set_number")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return [f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()]


def _written(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def snapshot(spark: SparkSession, work: str) -> int:
    """The last set of the newest whole snapshot; -1 if there is none."""
    found = [int(name.partition("=")[2]) for name in _folders(spark, f"{work}/snapshots")]
    return max((n for n in found if _written(spark, f"{work}/snapshots/through={n}/orders")
                and _written(spark, f"{work}/snapshots/through={n}/lineitem")), default=-1)


def _sets(spark: SparkSession, work: str) -> dict[int, list[str]]:
    """Folders of the log per set, from their names alone."""
    made: dict[int, list[str]] = {}
    for batch in _folders(spark, f"{work}/log"):
        for name in _folders(spark, f"{work}/log/{batch}"):
            made.setdefault(int(name.partition("=")[2]), []).append(f"{work}/log/{batch}/{name}")
    return made


def late_sets(spark: SparkSession, work: str) -> list[int]:
    """Sets with lines that were filed after the set was folded."""
    last, folded = snapshot(spark, work), set()
    for name in _folders(spark, f"{work}/snapshots"):
        if int(name.partition("=")[2]) <= last:
            folded |= {r["folder"] for r in spark.read.parquet(f"{work}/snapshots/{name}/folded").collect()}  # one row per batch and set
    return sorted(n for n, folders in _sets(spark, work).items() if n <= last and set(folders) - folded)


def _tables(spark: SparkSession, work: str, orders: DataFrame, lines: DataFrame, after: int,
            through: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The snapshot of set ``after`` (-1: the given tables) with later sets applied, up to ``through``."""
    if after >= 0:
        orders, lines = (
            spark.read.schema(base.schema).parquet(f"{work}/snapshots/through={after}/{name}")
            for name, base in (("orders", orders), ("lineitem", lines)))
    wanted = {n: folders for n, folders in _sets(spark, work).items()
              if n > after and (through is None or n <= through)}
    log = None
    for number, folders in sorted(wanted.items()):
        part = spark.read.schema("value string, kind string, delivery string").parquet(*folders).withColumn(
            "set_number", F.lit(number).cast("bigint"))
        log = part if log is None else log.unionByName(part)
    if log is None:
        return orders, lines
    new_orders, new_lines, deleted = (_rows(log, kind) for kind in ("orders", "lineitem", "delete"))
    return (_apply(orders, new_orders, deleted, "o_orderkey"),
            _apply(lines, new_lines, deleted, "l_orderkey"))


def fold(spark: SparkSession, work: str, orders: DataFrame, lines: DataFrame, through: int) -> None:
    """Write the snapshot of all sets up to ``through``, from the one before it."""
    after = snapshot(spark, work)
    made = _tables(spark, work, orders, lines, after, through)
    target = f"{work}/snapshots/through={through}"
    used = [(f,) for n, folders in _sets(spark, work).items() if after < n <= through for f in folders]
    spark.createDataFrame(used, "folder string").coalesce(1).write.mode("overwrite").parquet(f"{target}/folded")
    for name, df in zip(("orders", "lineitem"), made):
        df.write.mode("overwrite").parquet(f"{target}/{name}")


def apply_arrived(spark: SparkSession, incoming: str, work: str, orders: DataFrame,
                  lines: DataFrame, open_sets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Take in what has arrived and return orders and lines with all sets applied.

    Once ``open_sets`` sets beyond the open ones are finished, they are folded first.
    """
    collect_changes(spark, incoming, work)
    finished = max(_sets(spark, work), default=0) - open_sets
    if finished - max(snapshot(spark, work), 0) >= open_sets:
        fold(spark, work, orders, lines, finished)
    return _tables(spark, work, orders, lines, snapshot(spark, work))
