"""B1 rejects and line breaks, K2 files."""

import duckdb
import pytest

from shopmetrics.sources import csv_io

HEADER = ",".join(f.name for f in csv_io.RAW_SCHEMAS["raw_products"].fields)


def test_rejects_and_rows(spark, tmp_path):
    (tmp_path / "raw_products.csv").write_text(HEADER + "\n" + "\n".join([
        '1,"a, b",c,1.5,0.1', "2.0,plain,c,2,", "x,bad id,c,1,1", "3,few", "4,many,c,1,1,1,1", "5,bad price,c,one,two", '6,"say ""hi""",c,,'])
        + "\n", encoding="utf-8")
    good, rejects = csv_io.read_raw(spark, str(tmp_path), "raw_products")
    assert sorted(map(tuple, good.collect())) == [(1, "a, b", "c", 1.5, 0.1), (2, "plain", "c", 2.0, None), (6, 'say "hi"', "c", None, None)]
    got = sorted((r.entity, r.file, r.reason, r.record.split(",")[0]) for r in rejects.collect())
    of = "raw_products", "raw_products.csv"
    assert got == [(*of, "not of the column's type: base_price, margin_rate", "5"), (*of, "not of the column's type: product_id", "x"),
                   (*of, "wrong number of fields", "3"), (*of, "wrong number of fields", "4")]
    assert good.count() + rejects.count() == 7 and rejects.where("reason like 'wrong%'").count() == 2  # whatever is selected


def test_only_files_with_quoted_line_breaks_are_read_whole(spark, tmp_path):
    folder = tmp_path / "raw_products.csv"
    folder.mkdir()
    (folder / "a b.csv").write_text(HEADER + "\n" + "\n".join(f'{i},"quoted ""{i}""",c,1,1' for i in range(20000)) + "\n")
    (folder / "broken.csv").write_text(HEADER + '\n1,"two\nlines",c,1,1\n2,"""\n""",c,1,1\n')
    plain, broken = csv_io.quoted_line_breaks(spark, str(folder))
    assert [p.rsplit("/", 1)[1] for p in plain] == ["a b.csv"] and [p.rsplit("/", 1)[1] for p in broken] == ["broken.csv"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        good, rejects = csv_io.read_raw(spark, str(tmp_path), "raw_products")
        assert good.rdd.getNumPartitions() > 3  # the clean file is split
        names = {r.product_name for r in good.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(names) == 20002 and {"two\nlines", '"\n"', 'quoted "7"'} <= names and rejects.isEmpty()


def test_marts_are_single_files_that_are_replaced(spark, tmp_path):
    mart = spark.createDataFrame([(1, "a, b"), (2, None)], "n long, s string")
    paths = csv_io.export_marts({"m": mart}, str(tmp_path), ["m"])
    assert (tmp_path / "m.csv").is_file() and paths == {"m": f"{tmp_path}/m.csv"}
    assert duckdb.sql(f"SELECT * FROM read_csv('{tmp_path}/m.csv') ORDER BY n").fetchall() == [(1, "a, b"), (2, None)]
    csv_io.export_marts({"m": mart.where("n = 2")}, str(tmp_path), ["m"])
    assert duckdb.sql(f"SELECT count(*) FROM read_csv('{tmp_path}/m.csv', header = true)").fetchall() == [(1,)]
    broken = spark.createDataFrame([(0,)], "n long").selectExpr("1 / n AS x")
    with pytest.raises(Exception):
        csv_io.export_marts({"m": broken}, str(tmp_path), ["m"])
    assert duckdb.sql(f"SELECT count(*) FROM read_csv('{tmp_path}/m.csv', header = true)").fetchall() == [(1,)]
