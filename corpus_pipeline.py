"""Training-data pipeline over documents: each stage works on all rows that the one before it kept.

The stages drop what the quality rules reject, then what the quality classifier rejects, keep one document of each
group of near copies (five-word shingles, similarity 0.8 or more), cut out passages of 35 words or more that occur
elsewhere too, and pack what is left. A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.

Edge cases: each operator's docstring states them; a table without rows passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.llm import cotrain, decision_list, ngram_join, packing, substring_dedup
from assetlens.llm._shared import table
from assetlens.scratch import new_folder, remove, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages learn from labels and hash words; SQL can't express them, so tests hold each against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned decision list rejects."""
    return decision_list.keep_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    return cotrain.keep_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked ones."""
    return ngram_join.keep_one_per_component(docs.select(*COLUMNS), words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words that a repeated window of 35 words covers; n_chars follows the text."""
    return substring_dedup.remove_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2048 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of a folder; each stage is written and read again, and its input removed then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        docs = written(stage(spark, docs, sf_dir), name, folder)
        if before is not None:
            remove(spark, before)
        before = folder
    return docs
