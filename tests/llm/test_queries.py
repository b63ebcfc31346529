"""Every corpus query on the smallest tables: columns, types, whole tables, folds."""

import glob
import os
import zlib

import duckdb
import pytest

from ratecraft.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FORMS = {
    "op1_kneser_ney": "doc_id bigint, lang string, n_ngrams bigint, perplexity double, threshold double, kept boolean",
    "op3_pii": "doc_id bigint, text string, n_entities bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, text string",
    "op7_bpe_encode": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean",
}


@pytest.fixture(scope="module")
def ids():
    return [r[0] for r in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()]


@pytest.mark.parametrize("name", FORMS)
def test_whole_tables_in_form(spark, ids, name):
    got = queries.queries()[name](spark, SF)
    kinds = dict(got.dtypes)
    want = dict(x.split() for x in FORMS[name].split(", "))
    assert {c: kinds.get(c) for c in want} == want
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name in ("op4_toxicity", "op10_language_id"):
        n, left = (5, 0) if name == "op4_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == left) and 0 <= r.score <= 1 for r in rows)


def test_line_dedup_equals_its_sql(spark):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = sorted(duck.execute(queries.oracle_sql()["op6_line_dedup"]).fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in queries.op6_line_dedup(spark, SF).collect())
    assert got == want and any(r[2] for r in want)


def test_neighbours_in_form(spark):
    got = queries.op2_learned_partitions(spark, SF)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = got.collect()
    n, asked = duckdb.sql(f"select count(*), count(*) filter (where vec_id % 20 = 0) from '{SF}/embeddings.parquet'").fetchall()[0]
    assert len(rows) == asked * min(20, n - 1) and all(r.query_id % 20 == 0 and r.query_id != r.vec_id for r in rows)


def test_pieces_in_form(spark, ids):
    rows = queries.op9_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(ids)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_doc.values():
        at = 0
        for start, length, total in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == total
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats and an empty table go through every stage but the quality rules' verdict."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    prose = " ".join(f"word{i} and" for i in range(120)) + "."
    rows = [(1, prose, "en", "a", 1), (2, prose, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, long, "en", "c", 9), (6, prose + " Mr. Karl Meier 4111 1111 1111 1111", "de", "a", 3), (6, prose + " Mr. Karl Meier 4111 1111 1111 1111", "de", "a", 3), (None, prose + " tail", "en", "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, SF)
            if name != "packing":
                assert got.columns == list(corpus_pipeline.COLUMNS), name
            out = got.collect()
            if name in ("line dedup", "pii"):
                assert len(out) == given.count()
            if name == "near duplicates" and out:
                # One of the exact and near copies stays, the least id (a null id is none); texts without words stay.
                assert sorted(str(r.doc_id) for r in out) == ["1", "3", "4", "5", "None"]
            if name == "quality rules" and out:
                assert {r.doc_id for r in out} <= {1, 2, 5, 6, None}
            if name == "packing" and out:
                assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, None}
