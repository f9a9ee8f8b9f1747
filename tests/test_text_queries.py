"""Scores and lookups whose work follows the input, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from lodestore.plans import analytics_queries as A
from lodestore.plans import text_queries as T


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(spark, tmp_path, query, sql, **tables):
    c = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    out = query(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, c.sql(sql).fetchall()))
    return out


def test_vqa_of_null_texts_and_texts_stay_out_of_joins(spark, tmp_path):
    texts = ["The cat.", "a cat", "cat", None, "dog!  an\tapple..", "DOG apple", "", "...", "Ünï the"]
    out = same(spark, tmp_path, T.vqa, T.ORACLE["vqa_accuracy"], documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert "regexp_replace" not in plan(out)


def test_anls_is_dealt_by_shuffle_partitions(spark, tmp_path):
    rows = [(k, t, r, x) for k in range(6) for t, (r, x) in enumerate([("user", "Kitten é" * k), ("assistant", " sitting" * (k + 1)), ("user", ""), ("assistant", "abba")])]
    out = same(spark, tmp_path, T.anls, T.ORACLE["anls"], conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert "RepartitionByExpression" in plan(out) and out.select(F.col("anls") >= 0).distinct().count() == 1


def test_lookups_group_orders_once(spark, tmp_path):
    items = [(o, p % 5, p % 3, n) for o in range(4) for n, p in enumerate(range(o, o + 6), 1)] + [(0, 1, 1, 2), (0, 0, 1, 2), (9, 77, 1, 2)]
    out = same(
        spark, tmp_path, A.dimension_lookups, A.ORACLE["dimension_lookups"],
        lineitem=(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        part=([(0, "p0"), (1, "p1"), (2, None), (3, "p3")], "p_partkey long, p_name string"),
        supplier=([(0, "s0"), (1, None)], "s_suppkey long, s_name string"),
    )
    assert plan(out).count("Aggregate") == 1 and "Generate" not in plan(out)
