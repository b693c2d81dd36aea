"""The records as triples: (doc_id, s, p, o, o_kind, o_datatype, o_lang)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T

NS = dims.BASE


def _uri(s: Column, p: str, o: Column) -> Column:
    return _triple(s, p, o, "uri", None, None)


def _literal(s: Column, p: str, o: Column, datatype: str | None = None, lang: Column | None = None) -> Column:
    return _triple(s, p, o, "literal", dims.XSD + datatype if datatype else None, lang)


def _triple(s: Column, p: str, o: Column, kind: str, datatype: str | None, lang: Column | None) -> Column:
    return F.struct(
        s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"),
        F.lit(datatype).cast("string").alias("o_datatype"), (lang if lang is not None else F.lit(None)).cast("string").alias("o_lang"),
    )


def _inlined(df: DataFrame, parts: list[Column]) -> DataFrame:
    """One scan gives all triples of a row; those without an object are dropped, repeats collapse as in a set."""
    return df.select("doc_id", F.inline(F.filter(F.array(*parts), lambda t: t["o"].isNotNull() & t["s"].isNotNull()))).distinct()


def of_fragments(fragments: DataFrame) -> DataFrame:
    f, d = F.col("frag_uri"), F.col("doc_id")
    return _inlined(
        fragments,
        [
            _uri(f, dims.RDF_TYPE, F.lit(NS + "ExplanationFragment")),
            _uri(d, dims.RDF_TYPE, F.lit(NS + "ExplanationDocument")),
            _literal(f, dims.RDFS + "label", F.col("text"), lang=F.col("lang")),
            _uri(d, dims.DCT + "hasPart", f),
            _uri(f, dims.DCT + "isPartOf", d),
            _literal(f, dims.DCT + "identifier", F.col("k"), "integer"),
            _literal(f, dims.DCT + "type", F.when(F.col("is_title"), "title_or_abstract").otherwise("body")),
        ],
    )


def of_evidences(rows: DataFrame, fragments: DataFrame) -> DataFrame:
    """Triples of resolved, usable evidence; the link to a category only where it is known."""
    joined = rows.select("doc_id", "k", "i", "role_name", F.col("text").alias("e_text"), F.col("lang").alias("e_lang"), "category").join(fragments.select("doc_id", "k", "frag_uri"), ["doc_id", "k"])
    e = F.concat(T.base_of(F.col("doc_id")), F.format_string("evid-%03d-%02d-", F.col("k"), F.col("i")), T.short_slug(F.col("e_text")))
    return _inlined(
        joined,
        [
            _uri(e, dims.RDF_TYPE, F.concat(F.lit(NS), "role_name")),
            _literal(e, dims.RDFS + "label", T.preview(F.col("e_text")), lang=F.col("e_lang")),
            _uri(F.col("frag_uri"), NS + "usesElement", e),
            _uri(e, NS + "evokesIntelligence", F.concat(F.lit(NS), "category")),
        ],
    )


def of_activations(acts: DataFrame, fragments: DataFrame, link_fragment: bool = True) -> DataFrame:
    joined = acts.join(fragments.select("doc_id", "k", "frag_uri"), ["doc_id", "k"])
    a, f = F.col("act_uri"), F.col("frag_uri")
    parts = [
        _uri(a, dims.RDF_TYPE, F.lit(NS + "IntelligenceActivation")),
        _literal(a, NS + "hasActivationScore", F.col("share").cast("decimal(10,4)"), "decimal"),
        _literal(a, NS + "hasActivationWeight", F.col("weight").cast("decimal(18,4)"), "decimal"),
        _uri(a, dims.IS_ABOUT, F.concat(F.lit(NS), "category")),
        _uri(a, NS + "isAboutFragment", f if link_fragment else F.lit(None)),
        _uri(f, NS + "hasActivation", a),
        _uri(a, NS + "hasActivationType", F.concat(F.lit(NS), "atype")),
        _uri(f, NS + "hasPrimaryActivation", F.when(F.col("is_primary_link"), a)),
        _uri(f, NS + "hasSecondaryActivation", F.when(F.col("is_secondary_link"), a)),
    ]
    return _inlined(joined, parts)


def of_vectors(vectors: DataFrame, percent_text: bool = True) -> DataFrame:
    v = F.col("vec_uri")
    owner = F.when(F.col("scope") == "document", F.col("doc_id")).otherwise(F.concat(T.base_of(F.col("doc_id")), F.format_string("frag-%03d", F.col("k"))))
    parts = [_uri(v, dims.RDF_TYPE, F.lit(NS + "MIProfileVector")), _uri(owner, NS + "hasProfileVector", v)]
    parts += [_literal(v, NS + p, F.col(s).cast("decimal(10,4)"), "decimal") for p, s in zip(dims.SCORE_PROPERTIES, dims.SHORT, strict=True)]
    if percent_text:
        parts.append(_literal(v, NS + "miVector", F.col("mi_vector")))
    return _inlined(vectors, parts)


def ontology(spark: SparkSession) -> DataFrame:
    """The class and property tree with labels."""
    rows = [(NS + a, dims.RDFS + "subClassOf", NS + b, "uri", None) for a, b in dims.CLASS_EDGES]
    rows += [(NS + a, dims.RDFS + "subPropertyOf", NS + b, "uri", None) for a, b in dims.PROPERTY_EDGES]
    rows += [(f"{NS}{s}Intelligence", dims.RDFS + "label", label, "literal", lang) for s, en, pt, *_ in dims.CATEGORIES for lang, label in (("en", en), ("pt", pt))]
    return dims.constant(spark, "s, p, o, o_kind, o_lang", rows).select(F.lit(None).cast("string").alias("doc_id"), "s", "p", "o", "o_kind", F.lit(None).cast("string").alias("o_datatype"), F.col("o_lang").cast("string").alias("o_lang"))


def in_mode(instances: DataFrame, mode: str = "instances") -> DataFrame:
    """Instances alone, with the ontology (``full``), or with one import statement per document."""
    if mode == "instances":
        return instances.distinct()
    if mode == "full":
        return instances.unionByName(ontology(instances.sparkSession)).distinct()
    if mode == "instances+imports":
        docs = instances.select("doc_id").where("doc_id IS NOT NULL").distinct()
        return instances.unionByName(_inlined(docs, [_uri(F.col("doc_id"), dims.OWL + "imports", F.lit(NS.rstrip("#")))])).distinct()
    raise ValueError(f"unknown graph mode {mode}")


def unknown_classes(triples: DataFrame) -> DataFrame:
    """Classes of the engine's name space that triples use but the class tree lacks, with how often: a warning, no failure."""
    known = sorted({NS + c for edge in dims.CLASS_EDGES for c in edge})
    used = triples.where((F.col("p") == dims.RDF_TYPE) & F.col("o").startswith(NS) & ~F.col("o").isin(known))
    return used.groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))


def without(triples: DataFrame, patterns: DataFrame) -> DataFrame:
    """Triples whose subject and property are not among (s, p) of ``patterns``."""
    return triples.join(patterns.select("s", "p").distinct(), ["s", "p"], "left_anti")


def upserted(triples: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of all triples of the same subject and property."""
    return without(triples, new).unionByName(new)
