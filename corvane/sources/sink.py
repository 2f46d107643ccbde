"""Writers, resume and result logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.ranking import best_per_group
from corvane.plans.runtime import new_path, shared_dir


def write_parquet(df: DataFrame, path: str, files: int | None = None,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrite ``path`` and read it back."""
    out = df.repartition(files) if files else df
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_partitioned_csv(df: DataFrame, path: str, by: str, quote_all: bool = False) -> None:
    """One folder per value. Rows are not gathered by value first, so a value holding much of the table is
    written by many tasks."""
    (df.write.mode("overwrite").partitionBy(by).option("header", True)
     .option("quoteAll", quote_all).option("escape", '"').csv(path))


def write_single_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """One file with a header, for reports of bounded size such as top lists."""
    (df.repartition(1).write.mode("overwrite").option("header", True)
     .option("quoteAll", quote_all).option("escape", '"').csv(path))


def key_values(one_row: DataFrame) -> DataFrame:
    """(key, value) rows of a one-row summary."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
                      for c in one_row.columns])
    return one_row.select(F.explode(pairs).alias("kv")).select("kv.*")


def write_key_values(summary: DataFrame, path: str) -> None:
    """The same (key, value) rows as JSON lines and as CSV."""
    flat = summary.withColumn("value", F.regexp_replace("value", r"[\r\n]", " "))
    summary.repartition(1).write.mode("overwrite").json(f"{path}/json")
    write_single_csv(flat, f"{path}/csv", quote_all=True)


# ---- commit protocol -----------------------------------------------------------------------------------------

MARKER = "_COMMITTED"  # readers of a folder skip names that start with an underscore
SEQUENCE = "__sequence"


def marker_of(spark: SparkSession, path: str):
    """The marker's file system and path."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKER}")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()), marker


def commit(spark: SparkSession, path: str) -> None:
    """Marks a folder as complete. The marker is written last, so a folder without it is a write that did not end."""
    fs, marker = marker_of(spark, path)
    fs.create(marker, True).close()


def committed(spark: SparkSession, path: str) -> bool:
    fs, marker = marker_of(spark, path)
    return fs.exists(marker)


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` when a write of it was completed, else build, write and read it. What a killed write left is
    overwritten."""
    if not committed(spark, path):
        write_parquet(build(), path)
        commit(spark, path)
    return spark.read.parquet(path)


def source_key(spark: SparkSession, paths: Sequence[str]) -> str:
    """A name for the present content of some folders: from the path, length and time of every file, by listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    told = files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("k"), F.count("*").alias("n")).first()
    return f"{(told['k'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}{told['n']:x}"


def kept_once(spark: SparkSession, name: str, paths: Sequence[str], build: Callable[[str], None]) -> str:
    """The folder of a derived table, built by ``build(folder)`` unless a complete one for the same files is in the shared
    folder. Every attempt writes to a folder of its own, whose name the commit publishes: attempts never mix."""
    pointer = f"{shared_dir(spark).rstrip('/')}/{name}-{source_key(spark, paths)}"
    if not committed(spark, pointer):
        target = new_path(spark, name)
        build(target)
        spark.createDataFrame([(target,)], "folder string").repartition(1).write.mode("overwrite").parquet(pointer)
        commit(spark, pointer)
    return spark.read.parquet(pointer).first()["folder"]


def append_log(spark: SparkSession, path: str | None, new: DataFrame, key: str) -> str:
    """Add result rows to the log at ``path`` (a fresh one if None) and return it. Only the new rows are written, as parts
    of their own with the number of the append; Spark's committer shows them all or not at all."""
    target = path or new_path(spark, "log")
    numbers = spark.read.parquet(target).agg(F.max(SEQUENCE)).first()[0] if path else None
    new.withColumn(SEQUENCE, F.lit(0 if numbers is None else numbers + 1)).write.mode("append").parquet(target)
    return target


def read_log(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of a log, of several for a key those appended last; columns of any append."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return best_per_group(rows, [key], [F.col(SEQUENCE)]).drop(SEQUENCE)
