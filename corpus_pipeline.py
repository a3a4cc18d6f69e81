"""From raw documents to token ids: the stages that a training corpus goes through.

Each stage takes what its predecessor kept, as it was written and read again, and returns documents with the
same columns; the last returns the digests of what it encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.frames import cut_lineage
from lodestone.llm import bpe_codec, line_dedup, mixing, near_dedup, quality_rules
from lodestone.llm.queries import codec_digests

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality(docs).filter("kept").select(*docs.columns)

def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them share; the largest ``doc_id`` keeps them."""
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least=20, min_docs=3))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)

def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, size=5)

def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times."""
    return mixing.repeated(docs, mixing.mix(docs))

def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's token ids and decoded text."""
    return codec_digests(bpe_codec.encode_decode(docs))

STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("source mix", mixture), ("bpe codec", tokens)]

#: zstandard's ratios and the tokenizer can't be expressed in SQL: `tests/llm/test_pipeline.py` has a brute-force version.
ORACLE_SQL = None

def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
