"""Reading texts, JSON documents, payloads, pages and profile files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import turtle

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("paragraphs", T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("is_title_or_abstract", T.BooleanType())]))),
    ]
)
EVIDENCE = "struct<role:string,text:string,lang:string,intelligence:string,confidence:string,relevance:string>"


def text_files(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(doc_id, path, text): a row per file of a folder, the id made of its name."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    name = F.regexp_replace(F.substring_index(F.url_decode("path"), "/", -1), r"\.[^.]*$", "")
    return rows.select(F.concat(F.lit("urn:doc:"), X.slug(name)).alias("doc_id"), "path", F.col("value").alias("text"))


def from_literal(spark: SparkSession, text: str, doc_id: str | None = None) -> DataFrame:
    """One document of a given text; without an id one made of the text's digest, the same in every run."""
    row = spark.range(1).select(F.lit(text).alias("text"))
    return row.select((F.lit(doc_id) if doc_id else F.concat(F.lit("urn:doc:"), F.substring(F.md5("text"), 1, 16))).alias("doc_id"), "text")


def source(spark: SparkSession, what: str) -> DataFrame:
    """Documents of a path or of a literal text; network addresses are refused, as nothing here reads them."""
    import os

    if what.lower().startswith(("http://", "https://")):
        raise ValueError("addresses are read elsewhere; pass the page's content to ingest.from_html")
    if os.path.exists(what) or "://" in what:
        return text_files(spark, what, "" if os.path.isfile(what) else ".txt").select("doc_id", "text")
    return from_literal(spark, what)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph rows of documents {doc_id, paragraphs}; those without doc_id, paragraph number or text are left out."""
    rows = spark.read.schema(DOCUMENT).option("recursiveFileLookup", True).json(path, multiLine=True)
    p = rows.where("doc_id IS NOT NULL").select("doc_id", F.inline("paragraphs"))
    return p.where("k IS NOT NULL AND text IS NOT NULL")


def payload(rows: DataFrame, json_col: str) -> DataFrame:
    """Evidence rows of {"k": [evidence, ...]}; keys that are no numbers are left out, numbers that are none are null."""
    mapped = rows.withColumn("_m", F.from_json(F.col(json_col), f"map<string,array<{EVIDENCE}>>"))
    each = mapped.select(*[c for c in rows.columns if c != json_col], F.explode("_m").alias("_k", "_list")).select("*", F.posexplode("_list").alias("i", "_e"))
    keep = [c for c in rows.columns if c != json_col]
    return each.withColumn("k", F.col("_k").try_cast("int")).where("k IS NOT NULL").select(*keep, "k", "i", "_e.role", "_e.text", "_e.lang", "_e.intelligence", F.col("_e.confidence").try_cast("double").alias("confidence"), F.col("_e.relevance").try_cast("double").alias("relevance"))


def payload_json(rows: DataFrame) -> DataFrame:
    """(doc_id, k, payload): each fragment's evidence as {"k": [evidence, ...]}, in the order of ``i``.

    A payload holds one fragment, as one document may hold a large share of all evidence; ``payload`` reads several of a document alike.
    """
    lists = rows.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "lang", "intelligence", "confidence", "relevance"))).alias("l"))
    plain = F.transform("l", lambda e: F.struct(*[e[f].alias(f) for f in ("role", "text", "lang", "intelligence", "confidence", "relevance")]))
    return lists.select("doc_id", "k", F.to_json(F.create_map(F.col("k").cast("string"), plain)).alias("payload"))


def turtle_files(spark: SparkSession, folder: str, pattern: str = "*.ttl") -> DataFrame:
    """Triples of Turtle files of a folder and those below it, parsed in Arrow batches."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return turtle.parsed(files.select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def loaded_documents(triples: DataFrame, document_scope: bool = True) -> DataFrame:
    """(doc_id, vector, source_path): profile vectors of triples, from their percent text or else their eight score properties.

    ``document_scope`` leaves out vectors of fragments. Of several percent texts of a vector the smallest counts.
    """
    from .. import dims
    from ..functions import numbers as N

    local = X.local_name(F.col("p"))
    kinds = triples.where((F.col("p") == dims.RDF_TYPE) & X.local_name(F.col("o")).isin("MIProfileVector", "MIProfile")).select("path", "s").distinct()
    if document_scope:
        kinds = kinds.where(~F.col("s").rlike("vec-frag-"))
    rows = triples.join(kinds, ["path", "s"], "left_semi").where(F.col("o_kind") == "literal")
    per = rows.groupBy("path", "s").agg(
        F.min(F.when(local.isin("miVector", "hasMIVector", "hasProfileVector"), F.col("o"))).alias("percent"),
        *[F.min(F.when(local == p, F.col("o"))).try_cast("double").alias(f"v{i}") for i, p in enumerate(dims.SCORE_PROPERTIES)],
    )
    props: Column = F.array(*[F.col(f"v{i}") for i in range(8)])
    vector = F.coalesce(N.parsed_vector(F.col("percent")), F.when(F.forall(props, lambda x: x.isNotNull()), props))
    return per.select(F.col("s").alias("doc_id"), vector.alias("vector"), F.col("path").alias("source_path")).where("vector IS NOT NULL")
