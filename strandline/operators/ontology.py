"""Concepts, gene layer and external bridge as edge tables; causal edges in an ontology; keys and codes of a validity gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.clean import cases

# Uri and predicate of the edge types that are made here.
EDGE_URIS = {
    "PARTICIPATES_IN": ("ro:RO_0000056", "biolink:participates_in"), "ENCODES": ("ro:RO_0002205", "biolink:encodes"), "SAME_AS": ("skos:exactMatch", "biolink:same_as"), "MAPS_TO": ("skos:closeMatch", "biolink:close_match"),
}
RELATION_URIS = (("TREATS", "ro:RO_0002606"), ("ASSOCIATED_WITH", "ro:RO_0002451"), ("EXPRESSED_IN", "ro:RO_0002206"), ("PRESENTS", "ro:RO_0002200"))


def merge_concepts(known: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, code, label, source_ontology, purl, created): all concepts by uri; what is known stays, new values fill nulls, and only new uris are created.

    Several new rows of a uri give of each column the least text. Null uris are left out.
    """
    columns = ["code", "label", "source_ontology", "purl"]
    one = new.where("uri is not null").groupBy("uri").agg(*[F.min(c).alias(c) for c in columns])
    both = known.where("uri is not null").withColumn("_known", F.lit(True)).alias("k").join(one.alias("n"), "uri", "full_outer")
    return both.select("uri", *[F.coalesce(f"k.{c}", f"n.{c}").alias(c) for c in columns], F.col("_known").isNull().alias("created"))


def _edges(rows: DataFrame, kind: str, source: str) -> DataFrame:
    uri, predicate = EDGE_URIS[kind]
    return rows.where("src is not null and dst is not null").distinct().select("src", F.lit(kind).alias("type"), "dst", F.lit(uri).alias("uri"), F.lit(predicate).alias("predicate"), F.lit(source).alias("source"))


def gene_layer(genes: DataFrame, annotations: DataFrame, markers: DataFrame, external: DataFrame) -> DataFrame:
    """(src, type, dst, uri, predicate, source) edges of genes (symbol, id).

    PARTICIPATES_IN: gene to term, for annotations (symbol, term); ENCODES: marker to gene, for markers
    (id, gene); SAME_AS: external concept to gene, for external (id, kind, label) of kind Gene whose label
    is the symbol. Rows whose gene isn't known give no edge; repeats give one. genes is a catalogue and is
    broadcast where Spark finds it small.
    """
    known = genes.where("symbol is not null").groupBy("symbol").agg(F.min("id").alias("gene_id"))
    to = lambda rows, c: rows.join(known, F.col(c) == known["symbol"])
    return reduce(DataFrame.unionByName, [
        _edges(to(annotations.withColumnRenamed("symbol", "_symbol"), "_symbol").select(F.col("gene_id").alias("src"), F.col("term").alias("dst")), "PARTICIPATES_IN", "annotation"),
        _edges(to(markers, "gene").select(F.col("id").alias("src"), F.col("gene_id").alias("dst")), "ENCODES", "marker"),
        _edges(to(external.where("kind = 'Gene'"), "label").select(F.col("id").alias("src"), F.col("gene_id").alias("dst")), "SAME_AS", "symbol"),
    ])


def external_bridge(external: DataFrame, concepts: DataFrame, rules: DataFrame) -> DataFrame:
    """(src, dst, method): SAME_AS edges from external concepts (id, label) to concepts (uri, label).

    First by rules (id, uri, method), where both ends are there. External concepts that no rule names are
    matched by label, in any case, with method label; a label that several concepts have links to each.
    """
    known = concepts.select("uri", F.lower("label").alias("_label"))
    by_rule = rules.join(external.select("id"), "id", "left_semi").join(concepts.select("uri"), "uri", "left_semi").select(F.col("id").alias("src"), F.col("uri").alias("dst"), "method").distinct()
    rest = external.join(rules.select("id").distinct(), "id", "left_anti").select("id", F.lower("label").alias("_label"))
    return by_rule.unionByName(rest.join(known, "_label").select(F.col("id").alias("src"), F.col("uri").alias("dst"), F.lit("label").alias("method")).distinct())


def typed_relations(relations: DataFrame) -> DataFrame:
    """(src, kind, dst, uri): relations between external concepts with the uri of their kind, in any case; skos:related for others. A uri that is there stays."""
    kind = F.upper("kind")
    found = cases([(kind == k, F.lit(u)) for k, u in RELATION_URIS], F.lit("skos:related"))
    return relations.select("src", "kind", "dst", F.coalesce("uri", found).alias("uri") if "uri" in relations.columns else found.alias("uri"))


def embed_causes(found: DataFrame, concepts: dict[str, tuple[str, str, str]], known: DataFrame, prefix: str = "cohort:") -> DataFrame:
    """(src, type, dst, confidence, algorithms): CAUSES edges between variables' uris, and MAPS_TO edges from variables to their concepts.

    found: (source, target, algorithms, confidence); concepts: variable -> (uri, label, ontology). A
    variable without concept has the uri prefix + name and maps to nothing; one whose concept isn't
    among known (uri) doesn't either. Each variable maps once; MAPS_TO has no confidence.
    """
    rule = found.sparkSession.createDataFrame([(k, v[0]) for k, v in concepts.items()] or [("", "")], "_variable string, _uri string")

    def uri(rows: DataFrame, column: str, out: str) -> DataFrame:
        return rows.join(F.broadcast(rule), F.col(column) == F.col("_variable"), "left").withColumn(out, F.coalesce("_uri", F.concat(F.lit(prefix), F.col(column)))).drop("_variable", "_uri")

    causes = uri(uri(found, "source", "src"), "target", "dst").select("src", F.lit("CAUSES").alias("type"), "dst", "confidence", "algorithms")
    names = found.select(F.explode(F.array("source", "target")).alias("variable")).distinct().join(F.broadcast(rule), F.col("variable") == F.col("_variable"))
    maps = names.join(known.select(F.col("uri").alias("_uri")).distinct(), "_uri", "left_semi").select(F.concat(F.lit("variable:"), "variable").alias("src"), F.lit("MAPS_TO").alias("type"), F.col("_uri").alias("dst"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("algorithms"))
    return causes.unionByName(maps)


def causal_totals(edges: DataFrame) -> DataFrame:
    """One row (total, validated, validation_rate): edges (validated boolean) and the percentage that is validated, 0 without edges."""
    v = F.count_if("validated")
    return edges.agg(F.count("*").alias("total"), v.alias("validated"), F.round(F.coalesce(100 * v / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("validation_rate"))


def edges_by_algorithm(edges: DataFrame) -> DataFrame:
    """(algorithm, n): edges (algorithms array) that each algorithm found; an edge counts once an algorithm."""
    return edges.select(F.explode(F.array_distinct("algorithms")).alias("algorithm")).groupBy("algorithm").agg(F.count("*").alias("n"))


def keys_hold(keys: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(key, n, nulls, repeated, holds) of each key (rows, columns): rows with a null part, rows beyond the first of a value, and whether there are none of either.

    One aggregate by key columns a table, combined before the shuffle.
    """
    parts = []
    for name, (rows, columns) in keys.items():
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        counted = rows.select(*columns).withColumn("_full", full).groupBy("_full", *columns).agg(F.count("*").alias("_n"))
        parts.append(counted.agg(F.lit(name).alias("key"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_n"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(F.col("_full"), F.col("_n") - 1)), F.lit(0)).alias("repeated")))
    return reduce(DataFrame.unionByName, parts).withColumn("holds", F.expr("nulls = 0 and repeated = 0"))


def codes_by_label(nodes: DataFrame, rules: list[tuple[str, str, float, str | None]]) -> DataFrame:
    """(label, total, with_code, coverage, passed, hard_fail) of each rule (label, code column, least coverage, condition or None) over nodes, by one aggregate.

    A label without nodes (that meet the condition) has coverage 0 and is a hard fail.
    """
    own = [(F.col("label") == label) & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)) for label, _, _, where in rules]
    one = nodes.agg(*[c for i, (hit, (_, column, _, _)) in enumerate(zip(own, rules, strict=True)) for c in (F.count_if(hit).alias(f"t{i}"), F.count_if(hit & F.col(column).isNotNull()).alias(f"w{i}"))])
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"t{i}").alias("total"), F.col(f"w{i}").alias("with_code"), F.lit(float(least)).alias("least")) for i, (label, _, least, _) in enumerate(rules)])
    rows = one.select(F.explode(each).alias("e")).select("e.*").withColumn("coverage", F.round(F.coalesce(F.col("with_code") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6))
    return rows.select("label", "total", "with_code", "coverage", F.expr("total > 0 and with_code >= least * total").alias("passed"), (F.col("total") == 0).alias("hard_fail"))


def forbidden_prefix(rows: DataFrame, column: str, prefix: str, samples: int = 10) -> DataFrame:
    """One row (violations, sample): rows whose id begins with the prefix, and the least of the distinct ids among them."""
    hit = rows.where(F.col(column).startswith(prefix)).select(column)
    least = hit.distinct().orderBy(column).limit(samples).agg(F.array_sort(F.collect_list(column)).alias("sample"))
    return hit.agg(F.count("*").alias("violations")).crossJoin(least)
