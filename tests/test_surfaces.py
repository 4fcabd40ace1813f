"""Databases in files, and table functions in SQL."""

import sqlite3

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.sources import database, panels
from seamline.streaming import functions, stateful
from test_dynamic import panel_of


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    rows = [(k, None if k % 7 == 0 else k / 2, f"name {k % 5}", f"2020-01-{k % 28 + 1:02d}") for k in range(-20, 180)] + [(None, 1.0, None, None)]
    with sqlite3.connect(f"{at}/x.sqlite") as db:
        db.execute("create table t (k integer, v real, name text, day date)")
        db.executemany("insert into t values (?, ?, ?, ?)", rows)
    with duckdb.connect(f"{at}/x.duckdb") as db:
        db.execute("create table t (k bigint, v double, name varchar, day date)")
        db.executemany("insert into t values (?, ?, ?, ?)", rows)
    return at, rows


@pytest.mark.parametrize("name", ["x.sqlite", "x.duckdb"])
def test_a_file_is_read_in_ranges_under_filters(spark, files, name):
    at, rows = files
    df = database.scan(spark, f"{at}/{name}", dates=["day"], table="t", key="k", partitions=5)
    assert dict(df.dtypes) == {"k": "bigint", "v": "double", "name": "string", "day": "date"} and df.rdd.getNumPartitions() == 5
    got = [(r["k"], r["v"], r["name"], None if r["day"] is None else r["day"].isoformat()) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert df.where("k >= 10 and k < 40").count() == 30 and df.count() == len(rows)  # one query leaves nothing behind for the next
    some = database.scan(spark, f"{at}/{name}", columns=["name", "k"], table="t", key="k", where="k >= 10 and k < 40 and v is not null and name in ('name 1', 'name 3')")
    assert some.columns == ["name", "k"] and sorted(r["k"] for r in some.collect()) == [k for k, v, n, _ in rows if k is not None and 10 <= k < 40 and v is not None and n in ("name 1", "name 3")]
    assert df.where(F.col("k").isNull()).count() == 1
    by = database.scan(spark, f"{at}/{name}", query="select name, count(*) as n from t group by name")
    assert {r["name"]: r["n"] for r in by.collect()} == {**{f"name {i}": 40 for i in range(5)}, None: 1}


def test_what_a_file_needs(spark, files):
    with pytest.raises(Exception, match="table or a query"):
        database.scan(spark, f"{files[0]}/x.sqlite")
    with pytest.raises(Exception, match="no columns"):
        database.scan(spark, f"{files[0]}/x.sqlite", table="t", columns=["other"])
    panel = panels.read(spark, "database", f"{files[0]}/x.duckdb", table="t", date_column="day", start="2020-01-10", columns=["v"])
    assert panel.columns == ["date", "v"] and panel.count() == sum(r[3] is not None and r[3] >= "2020-01-10" for r in files[1])


def test_breakpoints_in_sql(spark):
    rng = np.random.default_rng(6)
    x = {s: np.concatenate([rng.normal(m, 0.1, 40) for m in means]) for s, means in {"a": (2, -0.4), "b": (-1, 1.5)}.items()}
    panel_of(spark, x).select(F.col("series").alias("who"), "t", "value", F.lit("k").alias("other")).createOrReplaceTempView("panel_rows")
    functions.register(spark)
    got = spark.sql("select * from detect_breakpoints(table(panel_rows), series => 'who', threshold => 0.4)")
    assert got.columns == ["who", "t", "value", "other", "row_number", "probability"]
    want = []
    for s, v in x.items():
        runs, last = stateful.RunLengths(1), -10
        for t, row in enumerate(v):
            p = runs.update(np.array([row]))
            if t >= 10 and p >= 0.4 and t - last >= 10:
                want.append((s, t, pytest.approx(p)))
                last = t
    assert sorted((r["who"], r["t"], r["probability"]) for r in got.collect()) == sorted(want, key=lambda w: w[:2]) and len(want) >= 2
    with pytest.raises(Exception, match="lacks"):
        spark.sql("select * from detect_breakpoints(table(panel_rows))").collect()
