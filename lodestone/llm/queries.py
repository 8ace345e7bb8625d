"""Queries of the training-data operators, and their SQL where it exists."""
from lodestone.llm import embed_dedup, exact_dedup, langid, license_scan, mixing, packing, quality, records, simhash, toxicity
from lodestone.llm.common import documents as docs


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": lambda s, d: quality.score(docs(s, d), _table(s, d, "labels")),
    "op2_license_scan": lambda s, d: license_scan.query(docs(s, d)),
    "op3_packing": lambda s, d: packing.query(docs(s, d)),
    "op4_toxicity": lambda s, d: toxicity.query(docs(s, d), _table(s, d, "labels")),
    "op5_language_id": lambda s, d: langid.query(docs(s, d)),
    "op6_records": lambda s, d: records.query(docs(s, d)),
    "op7_mixing": lambda s, d: mixing.query(docs(s, d)),
    "op8_exact_dedup": lambda s, d: exact_dedup.query(docs(s, d)),
    "op9_embedding_dedup": lambda s, d: embed_dedup.query(_table(s, d, "embeddings")),
    "op10_simhash": lambda s, d: simhash.query(docs(s, d)),
    "pipeline": _pipeline,
}
SQL = {"op7_mixing": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL}
