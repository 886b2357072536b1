"""One query per operator over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, spotsigs
from tidewatch.llm.common import arrow_map, stage, table
from tidewatch.llm.conversations import plan_repairs, repaired_digests
from tidewatch.llm.embeddings import linked_vectors
from tidewatch.llm.language import fit_language_model, predict_language
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.minhash import near_duplicates
from tidewatch.llm.mixing import mix_sources
from tidewatch.llm.quality import fit_quality_model, score_quality
from tidewatch.llm.sharding import shard_documents
from tidewatch.llm.token_alignment import align_tokenizers
from tidewatch.llm.url_filter import judge_urls
from tidewatch.llm.warc import archive_round_trip

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines")
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), removed)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN, decode=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256")
    text = F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest, text)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def _fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    scored = score_quality(docs, fit_quality_model(docs, labels, _fold(5) != 0))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of the text edited with the next one, and how alike they are."""

    def work(batch: pa.RecordBatch) -> dict:
        code = lambda t: t.encode("utf-8", "surrogatepass")
        out: dict = {name: [] for name in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for text, following in zip(batch.column("text").to_pylist(), batch.column("next_text").to_pylist(), strict=True):
            text, following = text or "", following or ""
            changed = code(spotsigs.edited(text, following))
            own, other = spotsigs.signatures(code(text)), spotsigs.signatures(changed)
            out["n_chars"].append(len(text))
            out["edited_sha256"].append(hashlib.sha256(changed).hexdigest())
            out["fingerprint"].append(spotsigs.fingerprint(own))
            out["edited_fingerprint"].append(spotsigs.fingerprint(other))
            out["near_edited"].append(spotsigs.pruned_jaccard(own, other))
            out["near_next"].append(spotsigs.pruned_jaccard(own, spotsigs.signatures(code(following))))
        return {"doc_id": batch.column("doc_id")} | out

    paired = spotsigs.with_next(table(spark, sf_dir, "documents", "doc_id", "text"))
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return arrow_map(paired, "text", schema, work)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    predicted = predict_language(docs, fit_language_model(docs, _fold(4) != 2))
    held_out = F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out")
    return predicted.select("doc_id", held_out, "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)
    data = F.coalesce("row.text", F.lit("")).cast("binary")
    size = (F.octet_length(data) + 16).cast("long").alias("size")
    grown = F.lit(None).cast("int").alias("grown_shard")
    crc = F.crc32(data).alias("text_crc32")
    return sharded.select("row.doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", grown)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows damaged, and every conversation repaired."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    damaged = rows.select(
        "conv_id", "turn", fate.alias("fate"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(True), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    )
    present = F.col("fate") != 0
    plans = stage(plan_repairs(damaged, present), "repairs")
    digests = repaired_digests(damaged, plans, present).withColumnRenamed("conv_id", "id")
    joined = plans.join(digests, F.col("conv_id").eqNullSafe(F.col("id")))
    return joined.select(*plans.columns, F.col("digest").alias("repaired_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokenizers(docs, *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package, and it imports the operators

    return corpus_pipeline.run(spark, sf_dir)


REGISTERED = (
    op1_url_filter, op2_minhash_near_dedup, op3_line_dedup, op4_bpe, op5_mixing, op6_quality, op7_fingerprints,
    op8_language, op9_warc, op10_embedding_near_dedup,
    op11_sharding, op12_conversation_repair, op13_token_alignment, pipeline,
)


def queries() -> dict:
    return {query.__name__: query for query in REGISTERED}


def oracle_sql() -> dict[str, str]:
    from tidewatch.llm.oracles import ORACLES

    return ORACLES
