"""From raw documents to token ids: language, lines, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the
shared folder and hands it to the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import bpe
from tidewatch.llm.common import stage, table
from tidewatch.llm.language import fit_language_model, keep_known_languages
from tidewatch.llm.line_dedup import without_repeated_lines
from tidewatch.llm.minhash import near_duplicates
from tidewatch.llm.mixing import repeated

# A text is rejected whose words' languages are less sure than this; a mixture of clear ones is not.
LEAST_SCORE = 0.4
RANKS = "byte_bpe_multi_50k.tiktoken"
# What a worker of the last stage keeps of words: it is the same process that served the earlier stages.
WORD_BYTES = 80_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of known languages, one or several; texts without letters or in doubt go."""
    return keep_known_languages(docs, fit_language_model(docs, F.lit(True)), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; those with nothing left go."""
    return without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies; rows without a doc_id all stay."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    names = docs.columns
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.struct(*names).alias("row"))
    found = named.join(kept.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row")))
    one = found.withColumn("turn", turn).where("turn = 1").select("row.*")
    return one.union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text): the ids of each text, and the text decoded from them."""
    path = public_tokenizers.path(RANKS)
    kept = ("doc_id", "lang", "source")
    coded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, kept, decode=True, kept_bytes=WORD_BYTES)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]
# Classifier, sampling and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
