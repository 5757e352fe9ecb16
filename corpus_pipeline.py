"""A corpus pipeline: documents in, clean and encoded documents out.

Every stage takes the documents that the one before it kept, and all but the last return rows with the columns of
documents (further columns too, whatever their names). Stages work on a struct of the whole row, so that none of a
row's own columns can clash with theirs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.llm import bag_minhash, decontaminate, prefix_bpe, quality, repeats
from pitlane.llm.common import materialise, table
from pitlane.llm.libraries import vocabulary

#: Documents that the classifier finds less likely to be good than bad are rejected.
LEAST_SCORE = 0.5
#: Passages of so many bytes, or of so many words, are removed where a document with a smaller id has them; strings of
#: STRING_BYTES tell passages, the least that so many words can have.
PASSAGE_BYTES, PASSAGE_WORDS, STRING_BYTES = 200, 50, 99
#: Benchmark windows are this many words; a document that lies inside them by more than this share goes altogether.
WINDOW, MOST_COVERED = 10, 0.8


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def with_text(kept: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The rows in column kept with a new text (and its length in n_chars, where the row has one) in their columns' order."""
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select(*((new[c] if c in new else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is LEAST_SCORE or more. Learnt from the labels of the documents at hand outside the
    held-out fold; null and empty texts are scored like others. An empty table stays empty."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(whole_row(docs).alias("kept"), F.col("text").alias("text"))
    return quality.score(rows, model, "kept").where(F.col("score") >= LEAST_SCORE).select("kept.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id (null ids last; of repeated rows one).
    Documents with a null text are no duplicates of anything and all stay."""
    return bag_minhash.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE_BYTES or PASSAGE_WORDS that a document with a smaller id has; a character of which a part
    goes does so altogether. Null texts stay null; a document of which nothing is left stays, with an empty text."""
    cut = repeats.without_repeats(docs, STRING_BYTES, least_bytes=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    changed = F.size("removed") > 0
    text = F.when(changed, repeats.valid_text(F.col("kept_bytes"))).otherwise(F.col("kept.text"))
    return with_text(cut, docs, text)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word ranges that benchmark windows cover; documents covered beyond MOST_COVERED go. Others keep
    their text as it is."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    share = decontaminate.covered() / F.greatest(F.col("n_words"), F.lit(1))
    left = found.where(share <= MOST_COVERED)
    text = F.when(F.size("hits") > 0, decontaminate.cut_words(F.col("text"), F.col("hits"))).otherwise(F.col("text"))
    return with_text(left, docs, text)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and text of every document: encoded, and decoded from its ids."""
    back = prefix_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return prefix_bpe.digests(back, decoded_text=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("benchmark", benchmark_stage),
    ("encode", encode_stage),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
