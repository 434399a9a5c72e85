"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every text, hashed, and the hashes counted by distinct repositories and
owners. A value that several owners have, or several repositories of one owner, is a copied example
(documentation, templates); one that a single owner has in few repositories, and that looks random, is
taken for live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import free_name
from strandline.llm.skew import join_counted, split_rows
from strandline.operators.components import cut_lineage

#: Patterns of the base kinds, in order, and of the method's own kind (fixed values).
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BLOB = r"[A-Za-z0-9+/_-]{32,}"
KINDS = ("assign", "access", "hex", "blob")
MIN_ASSIGN = 6
#: A value is an example from this many owners or repositories on, and live-looking from so many different characters on.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_CHARACTERS = 2, 3, 8
#: Elements of an array that are folded together; work on an array is its size times this.
CHUNK = 64


def _chunks(items: Column) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def _running(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each item the merged integer values of all items before it, folded chunk by chunk, as one growing array would be copied for each item."""
    chunks = _chunks(items)
    before = lambda xs, start, of: F.aggregate(
        xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct(merge(s["at"], of(x)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
    )["all"]
    totals = F.transform(chunks, lambda xs: F.aggregate(xs, F.lit(zero), lambda s, x: merge(s, value(x))))
    return F.flatten(F.zip_with(chunks, before(totals, F.lit(zero), lambda x: x), lambda xs, start: before(xs, start, value)))


def _hits(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: the code points before each (since the last), its own, and it."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("size"), hit.alias("hit")))
    return F.when(text.rlike(pattern), F.filter(parts, lambda p: p["hit"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,size:int,hit:string>>"))


def _placed(hits: Column, kind: int) -> Column:
    """(start, kind, stop, value) of the hits that the kind takes."""
    at = _running(hits, lambda p: p["gap"] + p["size"], lambda a, b: a + b, 0)
    value = lambda p: F.regexp_extract(p["hit"], ASSIGN, 2) if kind == 0 else p["hit"]
    found = F.zip_with(hits, at, lambda p, a: F.struct((a + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (a + p["gap"] + p["size"]).alias("stop"), value(p).alias("value")))
    if kind == 0:
        return F.filter(found, lambda x: F.char_length(x["value"]) >= MIN_ASSIGN)
    if kind == 3:
        return F.filter(found, lambda x: x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]"))
    return found


def secret_candidates(docs: DataFrame, text_col: str = "text", out: str = "candidates") -> DataFrame:
    """docs with the column ``out``: the spans (start, kind, stop, hash_a, hash_b, characters) of each whole text, by start and kind; null texts have none.

    Base kinds: assign, access, hex. The method's kind, blob, takes runs of 32 and more base64-like
    characters that hold lower case, upper case and digits and overlap no base span. hash_a and hash_b
    name the value, characters the number of different ones. A column of docs with the name of ``out`` is
    replaced; all others stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, BLOB)
    hits, spans = ([free_name(docs, f"_{kind}_{what}") for kind in KINDS] for what in ("hits", "spans"))
    every, earlier, later = (free_name(docs, n) for n in ("_every", "_earlier", "_later"))
    df = docs.withColumns({h: _hits(text, p) for h, p in zip(hits, patterns, strict=True)})
    for kind, (h, s) in enumerate(zip(hits, spans, strict=True)):
        df = df.withColumn(s, F.when(F.size(h) > 0, _placed(F.col(h), kind)).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")))
    df = df.withColumn(every, F.array_sort(F.concat(*spans)))
    # a blob stays if all base spans that begin before it end before it, and the next one begins after it
    none, far, is_base = F.array().cast("array<int>"), 2**31 - 1, lambda x: x["kind"] < 3
    many = F.size(spans[3]) > 0
    df = df.withColumn(earlier, F.when(many, _running(F.col(every), lambda x: F.when(is_base(x), x["stop"]).otherwise(0), F.greatest, 0)).otherwise(none))
    df = df.withColumn(later, F.when(many, F.reverse(_running(F.reverse(every), lambda x: F.when(is_base(x), x["start"]).otherwise(far), F.least, far))).otherwise(none))
    judged = F.zip_with(F.zip_with(every, earlier, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), later, lambda p, n: F.struct(p["x"].alias("x"), p["e"].alias("e"), n.alias("n")))
    free = F.transform(F.filter(judged, lambda p: is_base(p["x"]) | ((p["e"] <= p["x"]["start"]) & (p["n"] >= p["x"]["stop"]))), lambda p: p["x"])
    told = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), F.xxhash64(x["value"]).alias("hash_a"), F.xxhash64(x["value"], x["value"]).alias("hash_b"), F.size(F.array_distinct(F.split(x["value"], ""))).alias("characters"))
    return df.withColumn(out, F.transform(F.when(many, free).otherwise(F.col(every)), told)).drop(*hits, *spans, every, earlier, later)


def ownership(candidates: DataFrame, owner: str, repository: str) -> DataFrame:
    """(hash_a, hash_b, owners, repositories, n) of candidate hashes, n being their rows.

    Rows are counted by hash, owner and repository before the shuffle by hash, so a hash that a third of
    all rows hold arrives once for each owner and repository. Null owners and repositories count as none.
    """
    seen = candidates.groupBy("hash_a", "hash_b", F.col(owner).alias("o"), F.col(repository).alias("r")).agg(F.count("*").alias("n"))
    return seen.groupBy("hash_a", "hash_b").agg(F.count_distinct("o").alias("owners"), F.count_distinct("r").alias("repositories"), F.sum("n").alias("n"))


def _spans(c: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def text_keys(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text."""
    return F.xxhash64(id_col, text_col), F.xxhash64(text_col, id_col)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """One row per row of docs: id, key_a, key_b, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, found.

    spans joins kind:start:end (code points, end exclusive) by start, then kind as listed; base_sha256
    is that of the base kinds alone. found has (start, kind, stop, owners, repositories, live) of each
    span; owners and repositories are those of its value in the whole table. live are values with fewer
    than EXAMPLE_OWNERS owners and EXAMPLE_REPOSITORIES repositories and at least LIVE_CHARACTERS
    different characters; n_example counts the spans of values with as many owners or repositories.
    repository defaults to owner and language; null owners count as none. key_a and key_b are
    ``text_keys``. Null and empty texts have no spans; empty tables give no rows; repeated rows repeat.
    Other columns are ignored.
    """
    repo = F.col(repository) if repository else F.concat_ws("/", *[c for c in (owner, "lang") if c in docs.columns])
    key_a, key_b = text_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), key_a.alias("key_a"), key_b.alias("key_b"), F.col(owner).cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).cast("string").alias("text"))
    light = cut_lineage(secret_candidates(rows).select("id", "key_a", "key_b", "owner", "repo", "candidates"))
    holding = light.where(F.size("candidates") > 0)
    each = holding.select("key_a", "key_b", "owner", "repo", F.explode("candidates").alias("s")).distinct().withColumns({h: F.col(f"s.{h}") for h in ("hash_a", "hash_b")})
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    span = F.struct("s.start", "s.kind", "s.stop", "owners", "repositories", (~copied & (F.col("s.characters") >= LIVE_CHARACTERS)).alias("live"))
    # one owner and repository a row of docs: where copies of a row have several, each span still is one
    judged = join_counted(each, ownership(each, "owner", "repo"), ["hash_a", "hash_b"], "n").groupBy("key_a", "key_b").agg(F.array_sort(F.collect_set(span)).alias("found"))
    n = lambda k: F.size(F.filter("candidates", lambda s: s["kind"] == k)).cast("long")
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,owners:bigint,repositories:bigint,live:boolean>>")
    both = holding.join(judged, ["key_a", "key_b"]).unionByName(light.where(F.size("candidates") == 0).withColumn("found", none))
    is_copied = lambda f: (f["owners"] >= EXAMPLE_OWNERS) | (f["repositories"] >= EXAMPLE_REPOSITORIES)
    return both.select(
        F.col("id").alias(id_col), "key_a", "key_b", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_spans(F.filter("candidates", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _spans(F.col("candidates")).alias("spans"), count(lambda f: f["live"]).alias("n_live"), count(is_copied).alias("n_example"), "found",
    )


def mask_live_secrets(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", owner: str = "source") -> DataFrame:
    """docs with each live-looking secret replaced by ``mask``; copied examples and all other rows and columns stay as they are.

    Overlapping secrets become one mask. Null and empty texts stay; columns of any name pass through; an
    empty table stays empty. Rows without a live-looking secret are not shuffled, but for those few that
    pass a filter of the others' keys.
    """
    a, b, spans, at, leads = (free_name(docs, n) for n in ("_key_a", "_key_b", "_spans", "_at", "_leads"))
    found = scan_secrets(docs, id_col, text_col, owner).where("n_live > 0").select(F.col("key_a").alias(a), F.col("key_b").alias(b), F.filter("found", lambda f: f["live"]).alias(spans)).distinct()
    key_a, key_b = text_keys(id_col, text_col)
    touched, others = split_rows(docs.withColumn(a, key_a).withColumn(b, key_b), cut_lineage(found), [a, b])
    touched = touched.withColumn(at, _running(F.col(spans), lambda s: s["stop"], F.greatest, 0))
    # where unmasked text ends at a secret: from the end of all secrets before it
    lead = F.filter(F.zip_with(spans, at, lambda s, x: F.struct(x.alias("low"), s["start"].alias("high"))), lambda p: p["low"] <= p["high"])
    touched = touched.withColumn(leads, lead)
    # a chunk's stretch of the text is cut out once, and its pieces from that
    body = lambda c: F.substring(F.col(text_col), F.get(c, F.lit(0))["low"] + 1, F.element_at(c, -1)["high"] - F.get(c, F.lit(0))["low"])
    piece = lambda c, t: F.array_join(F.transform(c, lambda p: F.concat(F.substring(t, p["low"] - F.get(c, F.lit(0))["low"] + 1, p["high"] - p["low"]), F.lit(mask))), "")
    pieces = F.flatten(F.transform(_chunks(F.col(leads)), lambda c: F.transform(F.array(body(c)), lambda t: piece(c, t))))
    rest = F.substring(F.col(text_col), F.array_max(F.transform(spans, lambda s: s["stop"])) + 1, F.char_length(text_col))
    masked = touched.withColumn(text_col, F.concat(F.array_join(pieces, ""), rest))
    return masked.select(docs.columns).unionByName(others.select(docs.columns))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owned: for each span owners/repositories of its value, comma-joined."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    owned = F.array_join(F.transform("found", lambda f: F.concat_ws("/", f["owners"].cast("string"), f["repositories"].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example", owned.alias("owned"))
