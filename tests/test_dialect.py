"""CSV dialect (B1, K2), strict JSON (N4), exact ids (S4), file names."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import reports, retrieval
from shopmetrics.operators.silver import tolerant_bigint
from shopmetrics.sources import csv_io


def test_reads_what_duckdb_writes(spark, tmp_path):
    names = ['5" pipe, long', " outer blanks ", "line\nbreak", "plain", 'a "quoted" b']
    con = duckdb.connect()
    con.execute("CREATE TABLE p (product_id VARCHAR, product_name VARCHAR, category VARCHAR, base_price DOUBLE, margin_rate DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, 'home', 10.0, 0.2)", [[i, n] for i, n in zip(["1", "2.0", "3", "12.5", "9007199254740993"], names)])
    con.execute(f"COPY p TO '{tmp_path}/raw_products.csv' (HEADER)")
    got = {r.product_name: (r.product_id, r.category, r.base_price, r.margin_rate) for r in csv_io.ingest_csv(spark, str(tmp_path), "raw_products").collect()}
    assert got == {n: (i, "home", 10.0, 0.2) for n, i in zip(names, [1, 2, 3, 13, 9007199254740993])}


def test_duckdb_reads_what_we_write(spark, tmp_path):
    rows = [(1, ' lead "q" x '), (2, "a,b"), (3, "line\nbreak")]
    csv_io.write_csv(spark.createDataFrame(rows, "id long, name string"), str(tmp_path / "out"), single_file=True)
    got = duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/out/*.csv', header=true, quote='\"', escape='\"') ORDER BY 1").fetchall()
    assert got == rows


@pytest.mark.parametrize("text", ["3 segments are weak", "true story", "[1,2] trailing", '{"a":1} and {"b":2}', '{"a":1,"a":2}', '1,"x":2', "1,2",
                                  '{"a":{"b":[1,null,"\\"x"]}}', "null", "", "  ", "-1.5e3", '"text"', "{", '{"a":1}]', '[1],"', "true"])
def test_json_is_strict(spark, text):
    r = reports.parse_json_column(spark.createDataFrame([(text,)], "response string")).first()
    try:
        want = json.loads(text.strip())
        assert r.is_json and json.loads(r.parsed) == want
    except ValueError:
        start, end = text.find("{"), text.rfind("}")
        try:
            inner = json.loads(text[start:end + 1]) if 0 <= start < end else ValueError
        except ValueError:
            inner = ValueError
        assert r.is_json is (inner is not ValueError)


def test_exact_ids(spark):
    vals = ["9007199254740993", "12.5", "-12.5", "12.4", "", "x", None, "1e3", "99999999999999999999"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(tolerant_bigint(F.col("v"))).collect()]
    assert got == [9007199254740993, 13, -13, 12, None, None, None, 1000, None]


def test_document_names_are_decoded(spark, tmp_path):
    for name in ("my guide.md", "é+1.md", "100%.md"):
        (tmp_path / name).write_text("body " + name)
    got = {r.source: r.text for r in retrieval.load_documents(spark, str(tmp_path)).collect()}
    assert got == {n: "body " + n for n in ("my guide.md", "é+1.md", "100%.md")}


def test_empty_term_counts_everywhere(spark):
    docs = spark.createDataFrame([(1, "a", "alpha beta"), (2, "b", "gamma")], "doc_id long, source string, text string")
    q = spark.createDataFrame([("1:1", "????"), ("1:2", "alpha ????")], "question_id string, question string")
    got = {(r.doc_id, r.term): r["count"] for r in retrieval.keyword_scores(docs, q).collect()}
    assert got == {(1, "alpha"): 1, (1, ""): 11, (2, ""): 6}
