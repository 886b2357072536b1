"""Registered queries against their SQL, and the pipeline's stages on a small table."""

from __future__ import annotations

import corpus_pipeline
import pytest
from check_oracles import compare, open_tables

from tidewatch.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, open_tables(FOLDER), FOLDER, name) == ""


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in queries() and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, babble, edit):
    import public_tokenizers
    import tiktoken

    from tidewatch.llm import bpe

    base = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*COLUMNS)
    odd = [(9000, None, None, None, None), (9001, "", "en", None, 0), (9002, "1 2 3", "en", "src0", 5), (None, "the of and to in the", "en", None, 9)]
    docs = base.union(base.limit(5)).union(spark.createDataFrame(odd, base.schema))
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        from tidewatch.llm.common import stage

        docs = stage(step(spark, docs, FOLDER), name)
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == COLUMNS
    ids = {name: [r.doc_id for r in rows] for name, rows in seen.items()}
    assert not {9000, 9001, 9002} & {*ids["language"]} and None in ids["language"] and len(ids["language"]) == base.count() + 6
    assert len(ids["near_copies"]) == len({*ids["near_copies"]})
    ranks = bpe.load_ranks(public_tokenizers.path(corpus_pipeline.RANKS))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed = sorted((str(r.doc_id), r.text) for r in seen["mix"])
    assert mixed == sorted((str(r.doc_id), r.text) for r in seen["tokens"])
    assert all(r.ids == coder.encode_ordinary(r.text) and r.n_tokens == len(r.ids) for r in seen["tokens"])


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, FOLDER).count() == 0
