"""A corpus pipeline over documents: STAGES in order, each one of the training-data operators over all that is left.

Every stage but the last returns the columns of documents. Documents that quality rules reject go; repeated runs of lines
are deleted; of near duplicates (operator 9 on five-word shingles, confirmed at a Jaccard similarity of 0.8 or more) the one
with the smallest doc_id stays; words in windows that repeat an earlier document are deleted; what is left is packed into
sequences. Texts that lose something stay as documents, even if empty.

Every row has its own verdict, also where rows share a doc_id or have none: rows are told apart by doc_id and text, and of
rows that are equal in both, which are near copies, one stays. Extra columns are carried along, and n_chars follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import LAST_ID, rest_of, with_text
from skein.llm.line_dedup import remove_repeated_lines
from skein.llm.near_copies import first_copies
from skein.llm.packing import pack_documents
from skein.llm.quality import judge_quality
from skein.llm.suffix_tree import remove_repeated_windows
from skein.llm.tables import cut


def _keyed(docs: DataFrame) -> DataFrame:
    """With what tells rows apart: the id (null: last) and a hash of the text."""
    return docs.withColumns({"_row_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "_row_t": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    kept = judge_quality(docs).where("kept").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_row_d"), F.col("text_hash").alias("_row_t"), F.col("lang").alias("_row_lang"))
    return _keyed(docs).withColumn("_row_lang", lang).join(kept, ["_row_d", "_row_t", "_row_lang"], "left_semi").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(remove_repeated_lines(docs, rest=rest_of(docs)), docs, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = first_copies(docs).select(F.col("d").alias("_row_d"), F.col("t").alias("_row_t"))
    own = _keyed(docs).join(first, ["_row_d", "_row_t"], "left_semi")
    equal = Window.partitionBy("_row_d", "_row_t").orderBy("_row_t")
    return own.withColumn("_row_n", F.row_number().over(equal)).where("_row_n = 1").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(remove_repeated_windows(docs, rest=rest_of(docs)), docs, "kept")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]
#: Perplexity, SimHash and tokenizers have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
