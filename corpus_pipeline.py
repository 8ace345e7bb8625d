"""documents -> toxicity, exact dedup, SimHash near-dedup, source mix, packing; part of lodestone.llm."""
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, mixing, packing, simhash, toxicity
from lodestone.llm.common import documents, work_dir


def _toxicity(spark, docs, sf_dir):
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.keep_one(docs)),
    ("simhash", lambda spark, docs, sf_dir: simhash.keep_one(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.apply(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.query(docs)),
]
ORACLE_SQL = None  # toxicity and SimHash are not expressible in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{work_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
