"""Change feed as a stream: each batch is folded into a versioned table of posts' last states.

The state is written anew for each batch under the batch's number, so a repeated batch replaces its own version: delivery is at
least once, the effect is once. One query writes a table; runs never overlap, since a run ends when all that is there is read.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE = "key long, updated_at timestamp_ntz, arrival long, content string"


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """key, updated_at, arrival, content after a batch (key, arrival, updated_at, kind, content).

    Of a key's entries since its last withdrawal the newest counts, of equally new ones the last. MALFORMED entries do not count.
    """
    rows = state.withColumn("kind", F.lit("AVAILABLE")).unionByName(batch.where("kind <> 'MALFORMED'"))
    gone = rows.groupBy("key").agg(F.max(F.when(F.col("kind") == "NOT_PUBLIC", F.col("arrival"))).alias("gone"))
    live = rows.join(gone, "key").where("kind = 'AVAILABLE' and (gone is null or arrival > gone)")
    last = F.max(F.struct("updated_at", "arrival", "content")).alias("m")
    return live.groupBy("key").agg(last).select("key", "m.updated_at", "m.arrival", "m.content")


def version(top: str, batch_id: int) -> str:
    return f"{top}/state-{batch_id:09d}"


def writer(top: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(version(top, batch_id - 1)) if batch_id else spark.createDataFrame([], STATE)
        upsert(before, batch).write.mode("overwrite").parquet(version(top, batch_id))

    return write


def run(feed: DataFrame, top: str) -> DataFrame:
    """Read all that is there, in as many batches as the source makes, and return the last state."""
    q = feed.writeStream.foreachBatch(writer(top)).option("checkpointLocation", f"{top}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = feed.sparkSession
    done = q.lastProgress["batchId"] if q.lastProgress else -1
    while done >= 0:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(version(top, done))
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(STATE).parquet(version(top, done))
        done -= 1
    return spark.createDataFrame([], STATE)


def cycle(steps: list[tuple[str, Callable[[], object]]]) -> dict[str, str]:
    """Run steps in order, each apart: what fails is noted, and the next one runs. At the start: reconcile, sync, reconcile."""
    out = {}
    for k, (name, step) in enumerate(steps):
        try:
            step()
            out[f"{k}:{name}"] = "done"
        except Exception as e:  # noqa: BLE001
            out[f"{k}:{name}"] = f"failed: {e}"
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of feed entries, whether it is one file or a folder of files."""
    name = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    s = r.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else r.parquet(name)
    return entries(s)


def entries(rows: DataFrame) -> DataFrame:
    """Feed entries of events: errors are malformed, sign-ups not public."""
    kind = F.when(F.col("event_type") == "error", "MALFORMED").when(F.col("event_type") == "signup", "NOT_PUBLIC").otherwise("AVAILABLE")
    content = F.concat_ws("|", "event_type", F.round("value", 6).cast("string"))
    return rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("arrival"), F.col("ts").alias("updated_at"), kind.alias("kind"), content.alias("content"))
