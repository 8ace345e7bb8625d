"""Exact dedup with a log-structured merge index, DataFrame functions only.

A memtable is a write task: it flushes one run sorted by digest (level 0). Compaction merges FANOUT runs of a level into one
of the next, by digest, and keeps the smallest identifier (or the largest) and the number of rows, until one run is left. Each
run has a filter: four bytes of every digest. A later batch asks the filters of the runs first, and only what they let through
meets whole digests. Texts are compared byte by byte for hits only, that is for digests with more than one row.

Null text counts as empty, and empty texts are equal. Repeated rows, rows without doc_id included, count one by one. A null
doc_id is never kept where another is there. Long texts are hashed whole; an empty table gives no rows; other columns are not
read by `classes` and kept by `keep_one`.
"""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm.common import lower_az, materialise, numbered, work_dir

HOT, FANOUT, SENT = 1000, 16, 200_000  # bound of broadcast hot digests; runs a merge; most digests with copies that are broadcast


def _norm():
    return lower_az(F.coalesce("text", F.lit("")))


def _best(keep: str):
    return F.min("keep_id") if keep == "min" else F.max("keep_id")


class Index:
    """Runs (run, digest, keep_id, n) by level, each level a table in the shared folder, and their filters (run, short)."""

    def __init__(self, spark: SparkSession, keep: str = "min"):
        self.spark, self.keep, self.levels, self.flushed, self.filters = spark, keep, [], 0, {}
        self.top = f"{work_dir(spark)}/lsm-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        # no Parquet Bloom filters: they take 1 MB a file, however few its rows, and joins don't read them; `_filter` does that work
        df.write.parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def flush(self, docs: DataFrame) -> DataFrame:
        """Memtables of (doc_id, text) as sorted runs of level 0; returns (doc_id, digest) of the batch's rows."""
        self.flushed += 1
        rows = docs.select(F.spark_partition_id().alias("run"), "doc_id", F.unhex(F.sha2(_norm(), 256)).alias("digest"))
        batch = self._write(rows.sortWithinPartitions("digest", "doc_id"), f"rows-{self.flushed}")
        self._add(0, batch.select("run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
        return batch.select("doc_id", "digest")

    def _add(self, level: int, runs: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(runs)

    def _filter(self, runs: DataFrame) -> DataFrame:
        """Four bytes of each digest of a table of runs, written when first asked."""
        if id(runs) not in self.filters:
            short = runs.select(F.substring("digest", 1, 4).alias("short")).distinct().sortWithinPartitions("short")
            self.filters[id(runs)] = self._write(short, f"filter-{uuid.uuid4().hex}")
        return self.filters[id(runs)]

    def compact(self) -> DataFrame:
        """Merge level after level, FANOUT runs at a time, until one run holds one entry a digest; returns it."""
        name, runs, many = 0, None, None
        for level in self.levels:
            for more in level:
                # runs of different batches get numbers of their own
                many_more = (more.agg(F.max("run")).first()[0] or 0) + 1
                more = more.select((F.col("run") + F.lit(many or 0).cast("int")).alias("run"), "digest", "keep_id", "n")
                runs, many = (more, many_more) if runs is None else (runs.unionByName(more), many + many_more)
        while True:
            many = -(-many // FANOUT)
            merged = runs.groupBy(F.floor(F.col("run") / FANOUT).cast("int").alias("run"), "digest").agg(_best(self.keep).alias("keep_id"), F.sum("n").alias("n"))
            runs = self._write(merged.sortWithinPartitions("run", "digest"), f"level-{self.flushed}-{(name := name + 1)}")
            if many == 1:
                break
        self.levels = [[] for _ in range(name)] + [[runs]]
        return runs

    def probe(self, docs: DataFrame, stored: DataFrame) -> DataFrame:
        """doc_id of a new batch's rows, and the keep_id and n of the equal text of `stored` (doc_id, text), null where none is.

        No run is rewritten. A filter's four bytes decide which digests are looked up; every hit's text is then compared.
        """
        rows = docs.select("doc_id", _norm().alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256))).withColumn("short", F.substring("digest", 1, 4))
        new = materialise(rows, "batch")
        asked, hits = new.select("digest", "short").distinct(), None
        for runs in (r for level in self.levels for r in level):
            passed = asked.join(self._filter(runs), "short", "left_semi")
            found = passed.select("digest").join(runs, "digest").select("digest", "keep_id", "n")
            hits = found if hits is None else hits.unionByName(found)
        if hits is None:
            return new.select("doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"))
        kept = hits.groupBy("digest").agg(_best(self.keep).alias("keep_id"), F.sum("n").alias("n"))
        old = stored.select(_norm().alias("old")).withColumn("digest", F.unhex(F.sha2("old", 256))).join(kept.select("digest"), "digest", "left_semi").distinct()
        same = new.select("digest", "norm").distinct().join(old, "digest").where(F.col("norm") == F.col("old")).select("digest", "norm")
        return new.join(same.join(kept, "digest"), ["digest", "norm"], "left").select("doc_id", "keep_id", "n")


def _look_up(rows: DataFrame, entries: DataFrame, total: int) -> DataFrame:
    """Each row with its entry (digest, keep_id, n). At most HOT digests can hold over 1/HOT of the rows each: these are broadcast."""
    big = F.col("n") > total / HOT
    hot = F.broadcast(entries.where(big))
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(entries.where(~big), "digest")
    return rows.join(hot, "digest").unionByName(rest)


def classes(docs: DataFrame, keep: str = "min") -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row; a digest shared by different texts is resolved by its texts."""
    index = Index(docs.sparkSession, keep)
    rows = index.flush(docs)
    entries = index.compact().select("digest", "keep_id", "n")
    total = rows.count()
    hits = entries.where("n > 1")
    # byte check: the texts of hits, equal ones merged in each map task, so that a large group of copies stays spread. Up to
    # SENT digests go to the texts; beyond that the merged texts go to the digests
    few = hits.limit(SENT + 1).count() <= SENT
    texts = docs.select("doc_id", _norm().alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    pick = F.min("doc_id") if keep == "min" else F.max("doc_id")
    asked = texts.join(F.broadcast(hits.select("digest")), "digest", "left_semi") if few else texts
    verified = asked.groupBy("digest", "norm").agg(pick.alias("keep_id"), F.count("*").alias("n"))
    verified = verified if few else verified.join(hits.select("digest"), "digest", "left_semi")
    clash = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    out = ["doc_id", "digest", "keep_id", F.col("n").alias("group_size")]
    if clash.isEmpty():
        return _look_up(rows, entries, total).select(*out)
    clash = materialise(clash, "clash")
    split = texts.join(clash, "digest", "left_semi").join(verified, ["digest", "norm"]).select(*out)
    return _look_up(rows.join(clash, "digest", "left_anti"), entries, total).select(*out).unionByName(split)


def keep_one(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row of each text stays: the one with the kept doc_id, null last, the first of equal ones.

    Classes are found on row keys, so that null and repeated doc_ids count as rows.
    """
    rows, row = numbered(docs)
    groups = classes(rows.select(F.col(row).alias("doc_id"), "text"), keep).where("group_size > 1")
    named = groups.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("class")).join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    pick = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row")).alias("at"))) if keep == "max" else F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.col("row").alias("at")))
    named = materialise(named, "copies")
    kept = named.groupBy("class").agg(F.abs(pick["at"]).alias("kept"))
    gone = named.join(kept, "class").where("row <> kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return classes(docs, "max").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
