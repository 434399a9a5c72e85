"""Allow and block rules for URLs by a sort-merge range join over reversed hosts.

A host is written with its labels reversed (``www.example.com`` -> ``com.example.www.``), so that a host
and all its subdomains are one interval of keys. URLs are dealt to ranges of the key order, each range
gets the rules whose interval meets it, and one sorted sweep of a range keeps the stack of the nested
rules that are active.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a range, about; the boundaries come from SAMPLES sampled keys a range and change only the balance.
RANGE_ROWS, SAMPLES = 250_000, 40
#: Ranges at most, so that boundaries and sample have a bound (a range of a larger table has more rows and may spill), and characters of a boundary.
MOST_RANGES, BOUND_CHARS = 8192, 200
#: Sampled keys at most, about (a quarter as many again by chance; four times as many are never passed).
MOST_SAMPLED = 65_536


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot after it; keys of a host and its subdomains begin with the host's key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _after(prefix: str) -> str:
    """The least string above all that begin with the key ``prefix``, which ends in a dot."""
    return prefix[:-1] + "/"


def _ranges_of_rules(bounds: list[tuple[str, int]]):
    keys = [b[0] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, at = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                # range p holds (key, tie) from bounds[p - 1] on, below bounds[p]
                first, last = bisect_left(keys, key), bisect_left(keys, _after(key))
                for p in range(first, last + 1):
                    take.append(i)
                    at.append(p)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *out.columns], names=["range", *out.schema.names])

    return run


def _range_of_rows(bounds: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(bounds, x) for x in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    return run


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []  # of (key, {path: (rule, verdict)}, path lengths, longest first)
        for batch in batches:
            ranges, keys, kinds, paths, texts, verdicts = (batch.column(c).to_pylist() for c in ("range", "key", "kind", "path", "rule", "verdict"))
            keep, rule, verdict = [], [], []
            for i, key in enumerate(keys):
                if ranges[i] != now:
                    now, stack = ranges[i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kinds[i]:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, known, sizes = stack[-1]
                    old = known.get(paths[i])
                    if old is None or (verdicts[i] == "block" and old[1] != "block"):
                        known[paths[i]] = (texts[i], verdicts[i])
                    if len(paths[i]) not in sizes:
                        sizes.append(len(paths[i]))
                        sizes.sort(reverse=True)
                    continue
                best = None
                for _, known, sizes in reversed(stack):
                    for n in sizes:
                        if (hit := known.get(paths[i][:n])) and n <= len(paths[i]):
                            best = max(best, hit, key=lambda x: len(x[0])) if best else hit
                            break
                keep.append(i)
                rule.append(best and best[0])
                verdict.append(best[1] if best else default)
            rows = batch.select(["id", "host", "path"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages.

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains if the
    URL's path begins with the rule's; of the rules that fit, the one whose text host + path is longest
    wins (of equally long ones the more specific host's, of equal ones block). Without one rule is null
    and the verdict ``default``. Null URLs and such without :// have an empty host and path and fit no
    rule; rules with a null or empty host are ignored. Rows repeat as they come; long URLs are judged whole;
    an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("id", "host", "path"))
    n = rows.count()
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    wanted = min(parts * SAMPLES, MOST_SAMPLED)
    step = max(1, n // wanted)
    picked = rows.where(F.pmod("tie", F.lit(step)) == 0).select("key", "tie").orderBy("key", "tie").limit(4 * wanted)
    # at most 4 * MOST_SAMPLED keys, cut; a boundary may be any string
    sample = sorted((r.key, r.tie) for r in picked.select(F.substring("key", 1, BOUND_CHARS).alias("key"), "tie").collect())
    bounds = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    lower = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.where("host is not null and host <> ''").select(host_key(lower).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.concat(lower, F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
    kind = pages.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    left = known.distinct().mapInArrow(_ranges_of_rules(bounds), "range int, key string, path string, rule string, verdict string").withColumns({"kind": F.lit(0), "id": F.lit(None).cast(kind), "host": F.lit(None).cast("string"), "tie": F.lit(None).cast("long")})
    right = rows.mapInArrow(_range_of_rows(bounds), f"range int, id {kind}, host string, path string, key string, tie long").withColumns({"kind": F.lit(1), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    both = left.unionByName(right).repartitionById(parts, F.col("range")).sortWithinPartitions("range", "key", "kind", "tie", "path", "rule")
    out = both.select("range", "key", "kind", "id", "host", "path", "rule", "verdict").mapInArrow(_sweep(default), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


#: The rules of the query (fixed values): host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP1_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)
"""
