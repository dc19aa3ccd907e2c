"""Queries over small tables with what larger ones have, held against their SQL."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import oracle
from lorekeep.functions import text as T
from lorekeep.lineage import save
from lorekeep.operators import answer_review, canonical, evaluate, part_trees
from lorekeep.plans import catalog
from lorekeep.sources import search_index


def held(spark, folder, name, **tables):
    """``name`` over ``tables``, each given as a SQL query, agrees with its own SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    oracle.assert_same(con, df, catalog.ORACLE_SQL[name])
    return df


def test_census_with_order_zero(spark, tmp_path):
    held(spark, tmp_path, "census_round_trip", lineitem="select range AS l_orderkey, 46.0 AS l_quantity from range(30)")


def test_deletions_beyond_one_batch(spark, tmp_path):
    assert held(spark, tmp_path, "deletion_feed", supplier="select range AS s_suppkey from range(10001)").count() == 10_001


def test_generations_of_many_files(spark, tmp_path):
    held(spark, tmp_path, "generation_faults", orders="select range AS o_orderkey, 1 AS o_custkey, timestamp '1998-08-01' + to_years((range % 2)::int) AS o_orderdate from range(21000)")


def test_titles_that_begin_with_sharp_s(spark, tmp_path):
    words = "('ßheit x'), ('ẞheit x'), ('ß'), ('über_all y'), ('ss'), ('SS'), ('')"
    held(spark, tmp_path, "title_lookup", documents=f"select row_number() over () AS doc_id, 'de' AS lang, w AS text from (values {words}) v(w)")


def test_counts_of_tokens(spark):
    words = ["b a b", "", None, "重要 x 重要", "É é_2 ٣"]
    got = spark.createDataFrame(list(enumerate(words)), "k int, t string").select("k", T.index_tokens("t").alias("w"), T.has_tokens("t").alias("any"))
    rows = {r.k: (r.any, [tuple(c) for c in r.c or []]) for r in got.select("k", "any", T.counts(F.col("w")).alias("c")).collect()}
    assert rows[0] == (True, [("a", 1), ("b", 2)]) and rows[1] == rows[2] == (False, [])
    assert rows[3] == (True, [("x", 1), ("要", 2), ("重", 2), ("重要", 2)]) and rows[4] == (True, [("2", 1), ("é", 2), ("٣", 1)])


def test_index_counts_within_rows(spark, tmp_path):
    """Postings are shuffled once, as counted: no aggregate over all tokens stands before."""
    articles = spark.createDataFrame([("enwiki", 1, "Pear", "apple pear pear"), ("enwiki", 2, "Fig", "重要 fig")], "project string, page_id long, title string, text string")
    search_index.build(articles, str(tmp_path / "index"))
    got = {(r.page_id, r.term): (r.tf, r.length) for r in spark.read.parquet(str(tmp_path / "index" / "postings")).collect()}
    assert got == {(1, "apple"): (1, 4), (1, "pear"): (10, 4), (2, "fig"): (9, 5), (2, "重"): (1, 5), (2, "要"): (1, 5), (2, "重要"): (1, 5)}


def test_reviews_write_no_answers(spark, tmp_path, monkeypatch):
    """Suites, answers and their pieces are not written: one table is, with the claims of good cases."""
    written = []
    monkeypatch.setattr(answer_review, "save", lambda df, label: written.append((label, set(df.columns))) or save(df, label))
    long = "repeat('word ', 9000) || chr(10) || repeat('other ', 9000)"
    documents = f"select range AS doc_id, 'en' AS lang, CASE range % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'a' || chr(10) || 'b c' || chr(10) || 'a' ELSE {long} END AS text from range(12)"
    for name in ("review_scores", "review_faults"):
        held(spark, tmp_path, name, documents=documents)
    assert [label for label, _ in written] == ["reviewed-cases"] * 2 and not written[0][1] & {"body", "answer", "raw", "pieces"}


def test_bodies_leave_a_task_together(spark):
    """Many small bodies make few batches, and one with a field of another type spoils no other."""
    bodies = ['{"parts":[{"type":"paragraph","value":"x"}]}'] * 50 + ['{"parts":[{"type":"paragraph","value":7}]}', None]
    rows = pa.RecordBatch.from_pydict({"body": [str(k) for k in range(52)], "value": bodies}, schema=pa.schema([("body", pa.string()), ("value", pa.string())]))
    assert len(list(part_trees._listed(iter([rows.slice(0, 50)])))) == 1
    got = [(r["body"], r["kind"]) for b in part_trees._listed(iter([rows])) for r in b.to_pylist()]
    assert got == [(str(k), "paragraph" if k < 50 else "malformed") for k in range(52)]


def test_corpus_digests_articles_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(canonical, "save", lambda df, label: written.append(label) or save(df, label))
    one = spark.createDataFrame([("enwiki", 1, 2, "a" * 64)], "project string, page_id long, revision_id long, content_sha256 string")
    assert canonical.corpus_digest(one).head()["articles"] == 1 and written == ["article-digests"]


def test_hits_multiply_no_blocks_by_cases(spark):
    """Stop words of all cases: what leaves a task is k rows a case; ties go by project, page and block."""
    blocks = spark.range(1, 3001).coalesce(1).selectExpr("'p' AS project", "3001 - id AS page_id", "concat('b', id) AS block_id", "if(id % 1000 = 0, 'the of x7', 'The of') AS text", "if(id = 5, 'x7', null) AS heading")
    cases = spark.createDataFrame([(k, f"the of x{k}") for k in range(40)] + [(99, "")], "case_id int, query string")
    hits = evaluate.case_hits(blocks, cases, 3)
    got = {}
    for r in hits.orderBy("case_id", "rank").collect():
        got.setdefault(r.case_id, []).append((r.page_id, r.score))
    assert got == {k: [(2996, 6), (1, 3), (1001, 3)] if k == 7 else [(1, 2), (2, 2), (3, 2)] for k in range(40)}
    assert "Join" not in hits._jdf.queryExecution().toString()
