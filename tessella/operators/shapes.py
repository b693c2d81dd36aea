"""Constraints on the derived records, each a query for its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T

PERCENT_VECTOR = r"^[0-9]+(\.[0-9]+)?(,[0-9]+(\.[0-9]+)?){7}$"


def _found(rows: DataFrame, focus: Column, shape: str, component: str, path: str, value: Column | None, severity: str) -> DataFrame:
    return rows.select(
        "doc_id", focus.alias("focus_node"), F.lit(shape).alias("source_shape"), F.lit(component).alias("component"), F.lit(path).alias("path"),
        (value if value is not None else F.lit(None)).cast("string").alias("value"), F.lit(severity).alias("severity"),
    )


def fragment_violations(fragments: DataFrame, elements: DataFrame, acts: DataFrame) -> DataFrame:
    """Fragments with neither element nor activation, with more than one primary activation, or of no document."""
    uri = F.col("frag_uri")
    # one after the other: a union that is joined in place loses its partitioning when adaptive execution merges partitions of one side, and the join then ends in an error
    bare = fragments.join(elements.select("doc_id", "k"), ["doc_id", "k"], "left_anti").join(acts.select("doc_id", "k"), ["doc_id", "k"], "left_anti")
    many = acts.where("is_primary_link").groupBy("doc_id", "k").agg(F.count("*").alias("n")).where("n > 1").join(fragments.select("doc_id", "k", "frag_uri"), ["doc_id", "k"])
    loose = fragments.where("doc_id IS NULL OR trim(doc_id) = ''")
    return (
        _found(bare, uri, "Fragment", "Or", "usesElement|hasActivation", None, "Violation")
        .unionByName(_found(many, uri, "Fragment", "MaxCount", "hasPrimaryActivation", F.col("n"), "Violation"))
        .unionByName(_found(loose, uri, "FragmentDocument", "MinCount", "isPartOf", None, "Violation"))
    )


def backlink_violations(parts: DataFrame, back: DataFrame) -> DataFrame:
    """Documents that list a fragment ((doc_id, frag_uri) of ``parts``) which doesn't name them (``back``)."""
    lost = parts.join(back.select("doc_id", "frag_uri").distinct(), ["doc_id", "frag_uri"], "left_anti")
    return _found(lost, F.col("doc_id"), "Backlink", "Sparql", "hasPart", F.col("frag_uri"), "Warning")


def activation_violations(acts: DataFrame) -> DataFrame:
    """Activations about no category, of no valid type, with a score outside 0 to 1, or linked against their type."""
    uri, kind = F.col("act_uri"), F.coalesce("atype", F.lit(""))
    about = acts.where(F.col("category").isNull() | ~F.col("category").isin(dims.NAMES))
    typed = acts.where(~kind.isin("Primary", "Secondary"))
    score = acts.where(F.col("share").isNotNull() & ((F.col("share") < 0) | (F.col("share") > 1)))
    first = acts.where(F.coalesce("is_primary_link", F.lit(False)) & (kind != "Primary"))
    second = acts.where(F.coalesce("is_secondary_link", F.lit(False)) & (kind != "Secondary"))
    return reduce(
        DataFrame.unionByName,
        [
            _found(about, uri, "Activation", "Sparql", "isAbout", F.col("category"), "Violation"),
            _found(typed, uri, "Activation", "In", "hasActivationType", F.col("atype"), "Violation"),
            _found(score, uri, "Activation", "Range", "hasActivationScore", F.col("share"), "Violation"),
            _found(first, uri, "Activation", "Sparql", "hasPrimaryActivation", F.col("atype"), "Violation"),
            _found(second, uri, "Activation", "Sparql", "hasSecondaryActivation", F.col("atype"), "Violation"),
        ],
    )


def vector_violations(vectors: DataFrame) -> DataFrame:
    """Vectors with neither a percent text nor all eight numbers in 0 to 1, and percent texts of another form (a warning)."""
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.col(s).between(0, 1), F.lit(False)) for s in dims.SHORT])
    bad = vectors.where(F.col("mi_vector").isNull() & ~whole)
    odd = vectors.where(F.col("mi_vector").isNotNull() & ~F.col("mi_vector").rlike(PERCENT_VECTOR))
    return _found(bad, F.col("vec_uri"), "Vector", "Or", "miVector|scores", None, "Violation").unionByName(_found(odd, F.col("vec_uri"), "Vector", "Pattern", "miVector", F.col("mi_vector"), "Warning"))


def document_violations(docs: DataFrame, fragments: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """Documents without fragments, or without exactly one vector."""
    uri = F.col("doc_id")
    empty = docs.join(fragments.select("doc_id").distinct(), "doc_id", "left_anti")
    counts = docs.join(doc_vectors.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return (
        _found(empty, uri, "Document", "MinCount", "hasPart", None, "Violation")
        .unionByName(_found(counts.where("n < 1"), uri, "Document", "MinCount", "hasProfileVector", F.col("n"), "Violation"))
        .unionByName(_found(counts.where("n > 1"), uri, "Document", "MaxCount", "hasProfileVector", F.col("n"), "Violation"))
    )


def report(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """Per document whether it conforms (warnings allowed) and the number of results."""
    per = violations.groupBy("doc_id").agg(F.count("*").alias("results"), F.count_if(F.col("severity") == "Violation").alias("violations"))
    joined = docs.join(per, "doc_id", "left")
    return joined.select("doc_id", (F.coalesce("violations", F.lit(0)) == 0).alias("conforms"), F.coalesce("results", F.lit(0)).alias("results"))


SH = "http://www.w3.org/ns/shacl#"
# The constraint components of the standard for the kinds of rules here.
COMPONENTS = {
    "Or": "OrConstraintComponent", "MinCount": "MinCountConstraintComponent", "MaxCount": "MaxCountConstraintComponent", "Sparql": "SPARQLConstraintComponent", "In": "InConstraintComponent",
    "Range": "MaxInclusiveConstraintComponent", "Pattern": "PatternConstraintComponent",
}


def _component(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in COMPONENTS.items() for x in pair]), c), F.concat(c, F.lit("ConstraintComponent")))


def report_lines(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """The validation report of each document as text, (doc_id, place, line) in the order of ``place``: whether it conforms, how many results, then six lines for each result. Equal results are one."""
    found = violations.distinct()
    summary = report(docs, found)
    heads = summary.select("doc_id", F.inline(F.array(
        F.struct(F.lit("0").alias("place"), F.lit("Validation Report").alias("line")),
        F.struct(F.lit("1").alias("place"), F.concat(F.lit("Conforms: "), F.when(F.col("conforms"), "True").otherwise("False")).alias("line")),
        F.struct(F.lit("2").alias("place"), F.when(F.col("results") > 0, F.format_string("Results (%d):", "results")).alias("line")),
    ))).where("line IS NOT NULL")
    component = _component(F.col("component"))
    at = F.concat_ws("\u0001", F.lit("3"), "focus_node", "source_shape", "component", "path", F.coalesce("value", F.lit("")))
    texts = [
        F.concat(F.lit("Constraint Violation in "), component, F.lit(f" ({SH}"), component, F.lit("):")),
        F.concat(F.lit("\tSeverity: sh:"), "severity"),
        F.concat(F.lit("\tSource Shape: onto:"), "source_shape", F.lit("Shape")),
        F.concat(F.lit("\tFocus Node: <"), "focus_node", F.lit(">")),
        F.concat(F.lit("\tValue Node: "), F.coalesce("value", F.concat(F.lit("<"), "focus_node", F.lit(">")))),
        F.concat(F.lit("\tPath: "), "path"),
    ]
    each = found.select("doc_id", F.inline(F.array(*[F.struct(F.concat(at, F.lit(f"\u0001{n}")).alias("place"), t.alias("line")) for n, t in enumerate(texts)])))
    return heads.unionByName(each)


def report_triples(docs: DataFrame, violations: DataFrame) -> DataFrame:
    """The validation report of each document as triples in the standard's vocabulary: a report node per document and a node for each distinct result, both blank, named by hashes."""
    from .triples import NS, _inlined, _literal, _uri

    found = violations.distinct()
    node = F.concat(F.lit("_:report"), F.sha2("doc_id", 256).substr(1, 16))
    whole = report(docs, found).withColumn("node", node)
    heads = _inlined(whole, [_uri(F.col("node"), dims.RDF_TYPE, F.lit(SH + "ValidationReport")), _literal(F.col("node"), SH + "conforms", F.col("conforms").cast("string"), "boolean")])
    name = F.concat(F.lit("_:result"), F.sha2(F.concat_ws("\u0001", "doc_id", "focus_node", "source_shape", "component", "path", F.coalesce("value", F.lit(""))), 256).substr(1, 24))
    r = F.col("name")
    each = _inlined(
        found.withColumn("node", node).withColumn("name", name),
        [
            _uri(F.col("node"), SH + "result", r), _uri(r, dims.RDF_TYPE, F.lit(SH + "ValidationResult")), _uri(r, SH + "focusNode", F.col("focus_node")),
            _uri(r, SH + "resultSeverity", F.concat(F.lit(SH), "severity")), _uri(r, SH + "sourceConstraintComponent", F.concat(F.lit(SH), _component(F.col("component")))),
            _uri(r, SH + "sourceShape", F.concat(F.lit(NS), "source_shape", F.lit("Shape"))), _literal(r, SH + "value", F.col("value")),
        ],
    )
    return heads.unionByName(each)


# --- entailment -----------------------------------------------------------------------------------------


def entailed(triples: DataFrame) -> DataFrame:
    """Triples with what subclass, subproperty, domain and range entail (distinct). Closures are small constants, so one pass of joins suffices."""
    from .questions import closure

    spark = triples.sparkSession
    ns = dims.BASE
    props = closure(spark, dims.PROPERTY_EDGES).select(F.concat(F.lit(ns), "sub").alias("p"), F.concat(F.lit(ns), "sup").alias("sup"))
    classes = closure(spark).select(F.concat(F.lit(ns), "sub").alias("o"), F.concat(F.lit(ns), "sup").alias("sup"))
    domains = dims.constant(spark, "p, dom, rng", [(ns + p, ns + d, ns + r) for p, d, r in dims.PROPERTY_DOMAINS])
    more = triples.unionByName(triples.join(props, "p").select("doc_id", "s", F.col("sup").alias("p"), "o", "o_kind", "o_datatype", "o_lang"))
    typed = more.join(domains, "p")

    def types(of: DataFrame, s: str, cls: str) -> DataFrame:
        return of.select("doc_id", F.col(s).alias("s"), F.lit(dims.RDF_TYPE).alias("p"), F.col(cls).alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))

    more = more.unionByName(types(typed, "s", "dom")).unionByName(types(typed.where("o_kind = 'uri'"), "o", "rng"))
    up = more.where(F.col("p") == dims.RDF_TYPE).join(classes, "o")
    return more.unionByName(types(up, "s", "sup")).distinct()


def fragment_document(row_uri: Column) -> Column:
    """The document of a fragment's URI."""
    return F.regexp_replace(T.base_of(row_uri), "#$", "")
