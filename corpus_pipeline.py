"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents. A written table lies between
two stages, so an executor lost in one costs nothing of those before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock.llm import decontaminate, line_dedup, packing, quality, simhash
from tideblock.llm.common import table, written


def _wrapped(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text, so that no added column can clash with its own."""
    return docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.7 or more), learnt from labels outside the held-out quarter."""
    held_out = F.coalesce(quality.remainder("doc_id") == 2, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score_quality(_wrapped(docs), model, id_col="doc").filter("predicted = 1").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines, n_chars counted anew; a document of which every line goes, goes."""
    left = line_dedup.dedup_lines(docs).filter("n_lines = 0 OR n_deleted < n_lines")
    return left.select(*(F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies are at most 3 bits of SimHash apart or have a Jaccard similarity of 5-word shingles of 0.8 or more. Of each group of them one row stays: that of the smallest doc_id, null before all, and of those with one id the first."""
    rows = written(docs.select(F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("row")).alias("place"), F.struct(*docs.columns).alias("doc"), F.col("text").alias("text")), "rows")
    firsts = simhash.near_groups(rows, id_col="place", least=0.8).filter("place = component_id").select(F.col("place.row").alias("row"))
    return rows.withColumn("row", F.col("place.row")).join(firsts, "row", "left_semi").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of two benchmark items, or of one that 8 words of theirs lie in: a whole leaked item is enough to go, one of a few common words is not."""
    judged = decontaminate.contamination(_wrapped(docs), table(spark, sf_dir, "benchmark"), id_col="doc")
    return judged.filter("NOT contaminated AND (n_items = 0 OR n_hit < 8)").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: A fitted model, winnowing and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
