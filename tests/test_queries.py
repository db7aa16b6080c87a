"""Registered queries against their SQL in DuckDB, and traversal and metrics against plain Python."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftspark.operators import graph, metrics

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    table = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert table(got) == table(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_keeps_long_pages(spark):
    pages = entry.plans._page_text(spark, DIR)
    long = pages.where(entry.plans.T.word_count(F.col("body")) > 600).count()
    chunks, words = entry.entry(spark).agg(F.sum("chunks"), F.sum("words")).first()
    kept = pages.select(entry.plans.T.word_count(F.col("body")).alias("n")).where("n >= 20").agg(F.count("*"), F.sum("n")).first()
    assert long > 0 and chunks > kept[0] and words >= kept[1]


def test_the_rest_works_without_the_training_package():
    code = "import sys\nfor m in ('corpus_pipeline', 'siftspark.llm'): sys.modules[m] = None\nimport __spark_entry__ as e\nassert e.queries() and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_traversal(spark):
    links = [("s", 0, "b"), ("s", 1, "a"), ("b", 0, "a"), ("b", 1, "c"), ("a", 0, "s"), ("a", 1, "d"), ("d", 0, "e"), ("z", 0, "y")]
    edges = spark.createDataFrame([("g", *x) for x in links], "g string, src string, pos int, dst string")
    seeds = spark.createDataFrame([("s",)], "node string")
    rows = graph.bfs(edges, seeds, 10).orderBy("disc_order").collect()
    assert [(r["node"], r["depth"], r["parent"]) for r in rows] == [("s", 0, None), ("b", 1, "s"), ("a", 1, "s"), ("c", 2, "b"), ("d", 2, "a"), ("e", 3, "d")]
    assert [r["node"] for r in graph.bfs(edges, seeds, 10, max_pages=4).orderBy("disc_order").collect()] == ["s", "b", "a", "c"]
    assert {r["node"]: r["depth"] for r in graph.bfs_depths(edges, seeds, 2).collect()} == {"s": 0, "b": 1, "a": 1, "c": 2, "d": 2}
    walk = graph.dfs_order(edges.where("src <> 'z'").replace("s", "S"), "g", 10).orderBy("visit").collect()
    assert [(r["node"], r["depth"]) for r in walk] == [("S", 0), ("b", 1), ("c", 2), ("a", 1), ("d", 2), ("e", 3)]


def test_metrics(spark):
    rows = [(i, "ok" if i else "failed", float(i), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id int, status string, total_ms double, k int")
    assert metrics.p95(df).first()["p95_ms"] == 19.0 and metrics.p95(df.limit(0)).first()["p95_ms"] == 0.0
    snap = metrics.snapshot(df).first()
    assert (snap["pages_ok"], snap["pages_failed"], snap["avg_ms"]) == (19, 1, 10.0) and metrics.snapshot(df.limit(0)).first()["avg_ms"] == 0.0
    times = spark.createDataFrame([(i, t, 1) for i, t in enumerate((0, 30, 31, 100))], "event_id int, s int, k int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["in_window"] for r in metrics.rolling_rate(times, "k").orderBy("event_id").collect()] == [1, 2, 2, 1]
    assert [r["wait_us"] for r in metrics.token_bucket(times, "k", 0.1).orderBy("event_id").collect()] == [0, 0, 9_000_000, 0]
    source, crawl = (spark.createDataFrame([(u,) for u in us], "url string") for us in (["h/a/1", "h/a/2", "h/a/2"], ["h/a/2", "h/b"]))
    report = metrics.coverage(source, crawl).first()
    assert (report["matched"], report["missed"], report["extra"], report["coverage_pct"], report["verdict"]) == (1, 1, 1, 50.0, "moderate")
