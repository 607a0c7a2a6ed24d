"""Registered queries against their SQL, on the smallest tables."""

import collections
import math

import duckdb
import pytest

from quirework import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return str(v) if isinstance(v, (list, dict)) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    told = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    expected = collections.Counter(tuple(plain(v) for v in row) for row in told.fetchall())
    assert collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_bounded_text(spark, tmp_path):
    def expected(text):
        return None if text is None else text.encode()[:65_536].decode("utf-8", "ignore").strip()

    made = [(-1, None), (-2, ""), *[(k, "x" * (k % 4) + "aé漢😀"[k // 4] * 70_000) for k in range(16)]]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for folder, rows in ((tmp_path, made), (SF, stored)):
        heads = collections.Counter((r["doc_id"], r["head"]) for r in plans.QUERIES["bounded_text"](spark, str(folder)).collect())
        assert all("<" not in (t or "") for _, t in rows)
        assert heads == collections.Counter((i, expected(t)) for i, t in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "most"), [("export_plain", 6), ("restyled", 15)])
def test_rows_are_dealt_once(spark, name, most):
    """Shuffles where no table is small enough to be broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") <= most


def shuffles(spark, df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_first_duplicates_are_dealt_as_citations_are(spark):
    """Keys of one table are made once, and their windows need no shuffle beside those of the citations."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffles(spark, plans.QUERIES["dedupe_first"](spark, SF)) <= 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_records_are_indented_after_they_are_collected(spark):
    """What the aggregation holds, and spills, are short records: no text is indented below it or in what it collects."""
    plan = plans.QUERIES["export_csl_json_pretty"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "regexp_extract_all" not in plan


def test_cite_apart_beyond_702_alike(spark, duck, tmp_path):
    """Six thousand works of one editor and year in one bibliography: the letters are those of the SQL."""
    where = {t: f"{tmp_path}/{t}.parquet" for t in ("lineitem", "orders", "part", "supplier")}
    keys = "REPLACE (l_orderkey * 50 AS l_orderkey, 22 AS l_partkey)", "REPLACE (o_orderkey * 50 AS o_orderkey, DATE '1995-03-01' AS o_orderdate)"
    for t, some in zip(where, (*keys, "", ""), strict=True):
        duck.execute(f"COPY (SELECT * {some} FROM '{SF}/{t}.parquet') TO '{where[t]}'")
    con = duckdb.connect()
    for t, path in where.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    told = con.execute(f"SELECT bibliography_id, pos, year_suffix, label, text FROM ({plans.ORACLES['cite_apart']})").fetchall()
    assert len(told) == len(set(told)) > 5000 and {len(r[2]) for r in told} == {1, 2}
    rows = plans.QUERIES["cite_apart"](spark, str(tmp_path)).select("bibliography_id", "pos", "year_suffix", "label", "text")
    assert {tuple(r) for r in rows.collect()} == set(told)


def test_no_record_is_parted_into_tokens_to_be_indented(spark):
    """Lines are marked where a record is written, so its text is not read again sign by sign."""
    plan = plans.QUERIES["export_csl_json_pretty"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "regexp_extract_all" not in plan
