"""The registered queries on the smallest tables: contracts, SQL beside them, and the pipeline end to end."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from symbolgrid.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "labels", "conversations"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_inverted_multi_index": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_chat_round_trip": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3_raked_mixing": "doc_id bigint, source string, lang string, topic string, tokens bigint, probability double, selected boolean, rate double, copies bigint",
    "op4_suffix_automata": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op5_histogram_gbt": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_viterbi_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_robust_outliers": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_minhash_bayes": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_secret_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_segment_tree_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}
BY_DOCUMENT = [n for n, c in COLUMNS.items() if c.startswith("doc_id")]


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def results(spark):
    done = {}

    def of(name):
        if name not in done:
            df = queries.queries()[name](spark, SF)
            done[name] = df.dtypes, df.collect()
        return done[name]

    return of


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(results, documents, name):
    dtypes, rows = results(name)
    assert ", ".join(f"{c} {t}" for c, t in dtypes) == COLUMNS[name]
    if name in BY_DOCUMENT:
        assert sorted(r.doc_id for r in rows) == sorted(documents)
        for r in rows if "held_out" in dict(dtypes) else []:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(results, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted([tuple(zip(columns, row, strict=True)) for row in cursor.fetchall()], key=str)
    dtypes, rows = results(name)
    assert sorted([tuple((c, r[c]) for c in columns) for r in rows], key=str) == want
    assert sorted(columns) == sorted(c for c, _ in dtypes)


def test_digests(results, documents):
    for r in results("op4_suffix_automata")[1]:
        words = WORD.findall(documents[r.doc_id])
        assert r.n_words == len(words)
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()
    for r in results("op10_segment_tree_bpe")[1]:
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_pipeline_end_to_end(spark):
    """run() over the registered table: every stage's decisions hold in what comes out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in queries.op7_robust_outliers(spark, SF).filter("kept").collect()}
    assert out and {r.doc_id for r in out} <= kept
    again = corpus_pipeline.near_duplicates(spark, docs.join(spark.createDataFrame([(i,) for i in kept], "doc_id long"), "doc_id").select(*docs.columns), SF)
    assert {r.doc_id for r in out} <= {r.doc_id for r in again.select("doc_id").collect()}
    share = sum(r.n_tokens for r in out)
    assert share > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null columns, empty texts, repeated rows and a text of very many words pass through every stage."""
    prose = " ".join(f"word{k * k % 7919} and" for k in range(15_000))
    fine = [(k, " ".join(f"Plain words number {k * j % 101} of text {j}" for j in range(12)), "en", "s", 10) for k in range(30)]
    rows = [*fine, fine[0], fine[0], (100, prose, "en", "s", 1), (101, None, None, None, None), (102, "", "en", "s", 0), (None, fine[5][1] + " tail", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("label", F.lit("extra"))
    df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows}
    assert all(r.n_tokens > 0 for r in out)
