"""Queries against their SQL on small tables that the given ones don't hold: large keys, ties, repeats, bounds."""

import datetime

import duckdb
import pytest

from strandline.plans.registry import ORACLES, QUERIES

DAY = datetime.datetime(1998, 1, 1)


@pytest.fixture
def agree(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        for table, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        return got

    return run


def cohort(values):
    """One patient's visits ten years apart, with one fact a value on line 1 of the last visit, whose key is large."""
    big = 60_000_000_000
    orders = [(k, 1, "F", 100.0, day, "1-URGENT") for k, day in ((1, DAY.replace(year=1988)), (big, DAY))]
    lines = [(1, 1, 1, 1, values[0], 1.0, "N", "F", DAY), *[(big, 1, 1, 1, v, 1.0, "N", "F", DAY) for v in values[1:]]]
    return {
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", orders),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp", lines),
    }


def test_first_values_of_large_keys(agree):
    tables = cohort([10.0, 10.1, 9.9])
    schema, lines = tables["lineitem"]
    assert agree("a10_pivot", **tables | {"lineitem": (schema, lines[1:])}) == [(1, 9.9, None)]


def test_courses_of_large_keys(agree):
    # as doubles months * 1e15 + vid * 1e6 + line * 1e4 + value * 10 of the last two values are one number
    assert agree("q4_3_biomarker_courses", **cohort([10.0, 9.9, 10.1])) == [("TAU", "rising", 1)]


def test_processed_files_come_again(agree):
    # page 3 is page 2 once more, 5 is 1 once more; a null url is a file of its own
    rows = [(1, "u://a", "x"), (2, "u://b", "x"), (3, "u://b", "y"), (4, "u://c", "x"), (5, "u://a", "z"), (7, None, "x")]
    assert len(agree("u05_skip_processed", pages=("page_id long, url string, html string", rows))) == 3


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def patients(values):
    return CUSTOMER, [(6 * i + 1, "n", 1, v, "s") for i, v in enumerate(values)]


def test_pairs_whose_difference_rounds(agree):
    # cents whose difference and whose bound round to different sides of the width
    values = [round(1000.01 * i / 7 + d, 2) for i in range(60) for d in (0, 50, -50.01, 50.01)] + [0.01, 50.01, -0.01, 49.99, -1e-300, 50.0, 100.0, 4.4, 54.4]
    assert agree("q12_1_similarity_network", customer=patients(values))[0][0] == "E3/E4"


def test_classes_and_links_of_a_band(agree):
    values = [0.0, 25.0, 50.0, 75.01, 75.01, 100.01, 125.02, -1e-300, 9999.0, None, float("nan"), 1000.1, 1025.1, 975.1]
    got = agree("j11_similarity_band", customer=(CUSTOMER, patients(values)[1] + [(5, "n", 1, 0.0, "s"), (11, "n", 1, 0.0, "s")]))
    assert {r[0]: r[1:] for r in got}[1 + 6 * 7] == (1, 2) and (5, 5, 0) in got and len(got) == 16


def test_pairs_of_a_band(agree):
    # values on bounds of the buckets, differences that round to the width, copies, and values that pair with nothing
    values = [0.0, 25.0, 50.0, 75.01, 75.01, 100.01, 125.02, -1e-300, -25.0, 9999.0, None, float("nan"), float("nan"), 1000.1, 1025.1, 975.1, 1e20, 1e20, -1e300, 6.25, 18.75, 31.25]
    rows = patients(values)[1] + [(5, "n", 1, 0.0, "s"), (11, "n", 1, 0.0, "s"), (2, "n", 1, 0.0, "s"), (None, "n", 1, 0.0, "s")]
    got = agree("j11_similarity_band", customer=(CUSTOMER, rows))
    pid = lambda i: 6 * i + 1
    assert {(pid(0), pid(1)), (pid(1), pid(7)), (pid(3), pid(4)), (pid(13), pid(14)), (pid(13), pid(15)), (pid(16), pid(17))} <= set(got)
    assert not {2, 5, 11, pid(9), pid(10), pid(11), pid(12), pid(18)} & {i for r in got for i in r}


def test_pairs_of_a_band_in_parts(spark, monkeypatch):
    from strandline.operators import relational

    monkeypatch.setattr(relational, "PART_ROWS", 3)
    monkeypatch.setattr(relational, "TASK_MEETINGS", 500)
    rows = [(i, i % 2, float(v)) for i, v in enumerate([7] * 40 + [k / 4 for k in range(80)] + [-1.0] * 5)]
    df = spark.createDataFrame(rows, "id int, k int, v double")
    want = sorted((i, j) for i, m, v in rows for j, n, w in rows if i < j and m == n and abs(v - w) <= 2.0)
    assert sorted(map(tuple, relational.similarity_band(df, "k", "v", "id", 2.0).collect())) == want
    assert relational.similarity_band(df.limit(0), "k", "v", "id", 2.0).count() == 0


def test_classes_and_links_beside_the_pairs(agree):
    values = [0.0, 25.0, 50.0, 75.01, 75.01, 100.01, 125.02, -1e-300, 9999.0, None, float("nan"), 1000.1, 1025.1, 975.1]
    got = agree("j11_similarity_classes", customer=(CUSTOMER, patients(values)[1] + [(5, "n", 1, 0.0, "s"), (11, "n", 1, 0.0, "s")]))
    assert {r[0]: r[1:] for r in got}[1 + 6 * 7] == (1, 2) and (5, 5, 0) in got and len(got) == 16
