"""Shared folder tables and distributed connected components."""
import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset in local mode."""
    sc = spark.sparkContext
    if d := sc.getConf().get("spark.checkpoint.dir"):
        return d.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[sc.applicationId] = "file://" + own
    return _own[sc.applicationId]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spare(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, in a table, so that every use sees the same keys; and the key's name."""
    key = spare(docs, "_row")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def trim() -> None:
    """Give back the memory that this Python process holds but does not use; its worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    if back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        back(0)


def lower_az(c):
    """Lower-case A-Z only; pure ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, AZ, AZ.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long links -> (node, root): smallest node reachable, by large-star and small-star rounds until nothing changes.

    Each round is a written table, which replaces that of the round before. Nodes without links are not returned.
    """
    spark = edges.sparkSession
    top = f"{work_dir(spark)}/components-{uuid.uuid4().hex}"

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{top}-{k}")
        return spark.read.schema("u long, v long").parquet(f"{top}-{k}")

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0)
    before, k = None, 0
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        k += 1
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), k)
        discard(spark, f"{top}-{k - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def chunked(df: DataFrame, keys: list[str], salt: str, size: int, counts: DataFrame | None = None) -> DataFrame:
    """Deal groups of over `size` rows to pairs of chunks (ci <= cj), so that each task holds two chunks at most.

    Groups of one row, or not in `counts` (keys, _n), are left out. Every pair of a group meets in exactly one (ci, cj).
    """
    n = counts if counts is not None else df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    x = df.join(n, keys).withColumn("_k", F.ceil(F.col("_n") / size).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(salt), F.col("_k")).cast("int"))
    return x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("ci", F.least("chunk", "_o")).withColumn("cj", F.greatest("chunk", "_o")).drop("_n", "_k", "_o")
