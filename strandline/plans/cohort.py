"""The driver's tables as a cohort: patients, visits, facts and a property graph.

Each adapter is one SQL text that Spark and the oracle both read, so that a query and its oracle start
from the same rows. ``query`` registers a function of the adapters with its oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "patients": """SELECT c_custkey AS pid, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, cast(50 + c_custkey % 45 AS int) AS age,
        cast(8 + c_custkey % 13 AS int) AS edu, CASE c_custkey % 6 WHEN 0 THEN 'E3/E3' WHEN 1 THEN 'E3/E4' WHEN 2 THEN 'E4/E4' WHEN 3 THEN 'E2/E3' WHEN 4 THEN 'E2/E4' END AS genotype,
        c_mktsegment AS segment, c_acctbal AS acctbal, c_nationkey AS nation FROM {customer}""",
    "visits": """SELECT o_orderkey AS vid, o_custkey AS pid, cast(o_orderdate AS date) AS vdate,
        cast(year(o_orderdate) * 12 + month(o_orderdate) - min(year(o_orderdate) * 12 + month(o_orderdate)) OVER (PARTITION BY o_custkey) AS int) AS months,
        CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'AD' WHEN '2' THEN 'AD' WHEN '3' THEN 'MCI' WHEN '4' THEN 'SMC' ELSE 'CN' END AS dx,
        cast(cast(floor(o_totalprice / 100) AS bigint) % 31 AS int) AS mmse, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status FROM {orders}""",
    "facts": """SELECT l_orderkey * 10 + l_linenumber AS fid, l_orderkey AS vid, v.pid, v.months, l_linenumber AS line,
        CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'ABETA42' WHEN 'AO' THEN 'ABETA40' WHEN 'NF' THEN 'TAU' WHEN 'NO' THEN 'PTAU' WHEN 'RF' THEN 'NFL' ELSE 'GFAP' END AS analyte,
        l_quantity AS value, l_extendedprice AS price, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS abnormal, l_partkey AS part, l_suppkey AS supp, cast(l_shipdate AS date) AS fdate
        FROM {lineitem} JOIN {visits} v ON l_orderkey = v.vid""",
    "nodes": """SELECT concat('P:', c_custkey) AS id, 'Patient' AS label, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('cohort:', c_custkey) END AS uri FROM {customer}
        UNION ALL SELECT concat('V:', o_orderkey), 'Visit', o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN concat('cohort:v', o_orderkey) END FROM {orders}
        UNION ALL SELECT concat('S:', s_suppkey), 'Supplier', s_name, NULL FROM {supplier}
        UNION ALL SELECT concat('N:', n_nationkey), 'Nation', n_name, concat('http://purl.obolibrary.org/obo/N_', n_nationkey) FROM {nation}
        UNION ALL SELECT concat('R:', r_regionkey), 'Region', r_name, concat('http://purl.obolibrary.org/obo/R_', r_regionkey) FROM {region}""",
    "edges": """SELECT concat('P:', o_custkey) AS src, 'HAS_VISIT' AS type, concat('V:', o_orderkey) AS dst, CASE WHEN o_orderstatus <> 'O' THEN 'http://purl.obolibrary.org/obo/RO_0000056' END AS uri FROM {orders}
        UNION ALL SELECT concat('P:', c_custkey), 'LIVES_IN', concat('N:', c_nationkey), 'https://w3id.org/biolink/vocab/located_in' FROM {customer} WHERE c_custkey % 10 <> 9
        UNION ALL SELECT concat('S:', s_suppkey), 'BASED_IN', concat('N:', s_nationkey), 'https://w3id.org/biolink/vocab/located_in' FROM {supplier}
        UNION ALL SELECT concat('N:', n_nationkey), 'IS_A', concat('R:', n_regionkey), 'http://www.w3.org/2000/01/rdf-schema#subClassOf' FROM {nation}""",
}

#: Partitions for each that is read, where rows are dealt by visit.
PIECES = 8


class Cohort:
    """Lazy DataFrames of one data folder: the raw tables and the adapters, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in RAW and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._known:
            if name in RAW:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._known[name] = self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in re.findall(r"{(\w+)}", VIEWS[name])})
        return self._known[name]

    @cached_property
    def facts_by_visit(self) -> DataFrame:
        """The facts, dealt by visit over PIECES partitions for each that is read: a task's rows don't grow with the table."""
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), PIECES * self.lineitem.rdd.getNumPartitions())
        return self.spark.sql(VIEWS["facts"], lineitem=self.lineitem.repartition(parts, "l_orderkey"), visits=self.visits)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small rule table."""
    return spark.createDataFrame(rows, schema)


def with_views(sql: str) -> str:
    """The oracle text with the adapters that it names in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    views = ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in need)
    if not views:
        return sql
    return f"WITH {views}, {sql.strip()[5:]}" if sql.strip()[:5].upper() == "WITH " else f"WITH {views} {sql}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function Cohort -> DataFrame as a query, with the oracle's SQL."""

    def put(f: Callable[[Cohort], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: f(Cohort(spark, folder))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put
