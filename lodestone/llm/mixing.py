"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame functions only.

A document's key is -ln(u) / weight: u from its doc_id, weight from its quality, by default lower for marks and repeated lines.
Complete epochs come first; the rest of a source's target goes to its smallest keys. Keys fall in buckets, whose sums
decide whole buckets; the boundary bucket is cut in buckets again, and only the boundary's boundary is sorted, so that no task
gets a whole source. A row is taken if its middle lies within the rest, so a source misses its target by half a row at most.

Null text has size 0; null source is a source of its own, last. Rows with equal keys, as repeated doc_ids and null ones have,
go by doc_id, text hash and size; fully equal rows are interchangeable. Empty documents take 0 words, and are copied as often
as their key says, `cap` times at most. An empty table gives no rows; other columns are kept by `apply`.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.llm.common import materialise, numbered, spare

SEED, CAP, BUCKETS = "mix-1", 3, 1024
# Marks that lower a document's weight.
MARKS = "#$%&*|!{}<>"


def words_of(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long")


def quality(t: Column) -> Column:
    """Weight in 0.25 to 1: share of characters that are no marks (four times over), times the share of different lines."""
    marks = (F.length(t) - F.length(F.translate(t, MARKS, ""))) / F.greatest(F.length(t), F.lit(1))
    lines = F.split(t, "\n")
    return F.lit(0.25) + F.lit(0.75) * F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(4.0) * marks) * (F.size(F.array_distinct(lines)) / F.size(lines))


def targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target by water filling over a row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", level.cast("double"))
    return s.withColumn("fill", F.max("level").over(every)).select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.col("fill") * F.col("w")).alias("target"))


def _decided(rows: DataFrame, cells: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets that lie on one side of the rest, with `more`; and the rows of boundary buckets, with `before`."""
    c = cells.withColumnsRenamed({"source": "s", key: "cell"})
    x = rows.join(c, rows.source.eqNullSafe(c.s) & (rows[key] == c.cell)).drop("s", "cell")
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))
    whole = x.where(~edge).withColumn("more", (F.col("before") + F.col("sum") <= F.col("rest")).cast("int"))
    return whole.drop("before", "sum"), x.where(edge).drop("sum")


def mix(docs: DataFrame, cap: int = CAP, buckets: int = BUCKETS, carry: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """The columns `carry` of docs, doc_id, source, size, source_size, target, copies, taken; `weight` > 0 over docs' columns."""
    t = F.coalesce("text", F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED))), 1, 13), 16, 10).cast("double") + 1) / F.lit(2.0**52 + 1)
    key = -F.log(u) / (quality(t) if weight is None else weight)
    base = docs.select(*carry, "doc_id", "source", words_of(t).alias("size"), key.alias("key"), F.xxhash64(t).alias("h"))
    fine = F.least(F.lit(buckets * buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets * buckets))
    d = materialise(base.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / buckets)), "mix")
    plan = targets(d, cap)
    upto = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy("source", "coarse").agg(F.sum("size").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(upto("source").orderBy("coarse")), F.lit(0)))
    cells = sums.join(plan.withColumnRenamed("source", "ps"), F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    cells = cells.withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    whole, edge = _decided(d, cells, "coarse")
    sums = edge.groupBy("source", "fine").agg(F.sum("size").alias("sum"), F.min("before").alias("first"))
    sums = sums.withColumn("before", F.col("first") + F.coalesce(F.sum("sum").over(upto("source").orderBy("fine")), F.lit(0))).drop("first")
    inner, last = _decided(edge.drop("before"), sums, "fine")
    order = W.partitionBy("source", "fine").orderBy("key", "doc_id", "h", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    last = last.withColumn("more", (middle <= F.col("rest")).cast("int")).drop("before")
    out = whole.unionByName(inner).unionByName(last).withColumn("copies", F.least(F.lit(cap), F.col("epochs") + F.col("more")).cast("int"))
    return out.select(*carry, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows, key = numbered(docs)
    copies, one = spare(rows, "_copies"), spare(rows, "_one")
    n = mix(rows.select(F.col(key).alias("_key"), "doc_id", "source", "text"), carry=("_key",)).where("copies > 0").select(F.col("_key").alias(key), F.col("copies").alias(copies))
    return rows.join(n, key).withColumn(one, F.explode(F.array_repeat(F.lit(0), F.col(copies)))).select(docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = """WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix-1'), 1, 13))::BIGINT::DOUBLE + 1) / (pow(2, 52) + 1))
      / (0.25 + 0.75::DOUBLE * greatest(0.0::DOUBLE, 1 - 4 * ((length(t) - length(translate(t, '#$%&*|!{}<>', '')))::DOUBLE / greatest(length(t), 1)))
        * (len(list_distinct(lines))::DOUBLE / len(lines))) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * w) AS target FROM l),
r AS (SELECT k.*, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * least(3, epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""
