"""Competency questions: which categories fragments evoke, by which elements and activations, and which stand out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from . import profile


def labels(spark: SparkSession) -> DataFrame:
    """(category, lang, label) in both languages."""
    rows = [(f"{s}Intelligence", lang, label) for s, en, pt, *_ in dims.CATEGORIES for lang, label in (("en", en), ("pt", pt))]
    return dims.constant(spark, "category, label_lang, label", rows)


def closure(spark: SparkSession, edges: list[tuple[str, str]] | None = None) -> DataFrame:
    """(sub, sup) of all classes below others, any number of steps, by a recursive query. The edges form no circle."""
    return spark.sql(
        """WITH RECURSIVE up(sub, sup) AS (
             SELECT sub, sup FROM {edges}
             UNION ALL SELECT up.sub, e.sup FROM up JOIN {edges} e ON up.sup = e.sub)
           SELECT DISTINCT sub, sup FROM up""",
        edges=dims.constant(spark, "sub, sup", edges or dims.CLASS_EDGES),
    )


def categories_below(spark: SparkSession, top: str = "IntelligenceDisposition") -> DataFrame:
    return closure(spark).where(F.col("sup") == top).select(F.col("sub").alias("category"))


def evoked(acts: DataFrame, elements: DataFrame, fragments: DataFrame, language: str | None = None) -> DataFrame:
    """Question 1: categories evoked per fragment by an activation or an element, a row for each label; ``language`` keeps one.

    Fragments that have neither give no rows.
    """
    spark = acts.sparkSession
    below = categories_below(spark)
    by_act = acts.select("doc_id", "k", "category", F.lit("activation").alias("source"), F.col("share").cast("double").alias("score"))
    by_element = elements.select("doc_id", "k", "category", F.lit("element").alias("source"), F.lit(None).cast("double").alias("score")).distinct()
    names = labels(spark)
    names = names.where(F.col("label_lang") == language) if language else names
    found = by_act.unionByName(by_element).join(below, "category", "left_semi").join(names, "category", "left")
    return found.join(fragments.select("doc_id", "k", "frag_uri"), ["doc_id", "k"], "left").select("doc_id", "k", "frag_uri", "category", "label", "label_lang", "source", "score").distinct()


def elements_and_activations(acts: DataFrame, elements: DataFrame) -> DataFrame:
    """Question 2: elements and activations per fragment and category, with both labels."""
    spark = acts.sparkSession
    below = categories_below(spark)
    el = elements.select("doc_id", "k", "category", F.coalesce("role_name", F.lit("ExplanationElement")).alias("evidence_type"), F.col("text").alias("element"), F.lit(None).cast("string").alias("act_uri"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("atype"))
    ac = acts.select("doc_id", "k", "category", F.lit("IntelligenceActivation").alias("evidence_type"), F.lit(None).cast("string").alias("element"), "act_uri", F.col("share").cast("double").alias("score"), "atype")
    wide = labels(spark).groupBy("category").agg(F.max(F.when(F.col("label_lang") == "pt", F.col("label"))).alias("label_pt"), F.max(F.when(F.col("label_lang") == "en", F.col("label"))).alias("label_en"))
    return el.unionByName(ac).join(below, "category", "left_semi").join(wide, "category", "left").distinct()


def summary(acts: DataFrame) -> DataFrame:
    """Question 2's figures per fragment and category, and per document and category (k null), by grouping sets."""
    return acts.sparkSession.sql(
        """SELECT doc_id, k, category, grouping(k) AS whole_document, count(*) AS n, count_if(lower(atype) = 'primary') AS primaries,
                  count_if(lower(atype) = 'secondary') AS secondaries, cast(max(share) AS double) AS top_score
           FROM {acts} GROUP BY GROUPING SETS ((doc_id, k, category), (doc_id, category))""",
        acts=acts,
    )


def standouts(acts: DataFrame) -> DataFrame:
    """Question 3: the activations within 1e-9 of a fragment's highest score; if a primary one is among them, only primaries; one per
    category, primary first."""
    per = Window.partitionBy("doc_id", "k")
    score = F.col("share").cast("double")
    ties = acts.withColumn("top", F.max(score).over(per)).where(F.abs(score - F.col("top")) <= 1e-9)
    primary = F.lower("atype") == "primary"
    kept = ties.withColumn("has_primary", F.max(primary).over(per)).where(~F.col("has_primary") | primary)
    first = Window.partitionBy("doc_id", "k", "category").orderBy(F.desc(primary), "act_uri")
    one = kept.withColumn("r", F.row_number().over(first)).where("r = 1")
    return one.select("doc_id", "k", "category", score.alias("score"), "atype", (F.count("*").over(per) > 1).alias("tied"))


def leading(vectors: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` highest categories of each document's vector, ties in the order of summaries."""
    place = F.create_map(*[F.lit(x) for s, _, _, _, cq, _ in dims.CATEGORIES for x in (f"{s}Intelligence", cq)])
    long = profile.long_form(vectors, ["doc_id"])
    per = Window.partitionBy("doc_id").orderBy(F.desc("value"), place[F.col("category")])
    return long.withColumn("place", F.row_number().over(per)).where(F.col("place") <= n).select("doc_id", "place", "category", "value")


def _names(spark_map: list[tuple[str, str]], column: str):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in spark_map for x in pair]), F.col(column)), F.col(column))


ENGLISH = [(f"{s}Intelligence", en) for s, en, *_ in dims.CATEGORIES]
PORTUGUESE = [(f"{s}Intelligence", pt) for s, _, pt, *_ in dims.CATEGORIES]


def report_lines(acts: DataFrame, vectors: DataFrame, fragments: DataFrame) -> DataFrame:
    """Question 3 as text, (doc_id, part, k, n, line): the document's vector, leading category and first three, then each
    fragment with what stands out, ties listed by name. Lines stand in the order of part, k and n; no task numbers
    a whole document's lines, as one document may hold a large share of them."""
    top = leading(vectors).withColumn("name", _names(ENGLISH, "category"))
    shown = F.format_string("%.4f", F.col("value"))
    place = lambda *n: F.array(*[F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in n])
    docs = vectors.select("doc_id", F.explode(F.array(
        F.struct(place(0, 0, 0).alias("place"), F.concat(F.lit("[Documento] "), "doc_id").alias("line")),
        F.struct(place(0, 1, 0).alias("place"), F.concat(F.lit("  - miVector: "), "mi_vector").alias("line")),
        F.struct(place(0, 3, 0).alias("place"), F.lit("  - Ranking (top 3):").alias("line")),
        F.struct(place(0, 5, 0).alias("place"), F.lit("").alias("line")),
        F.struct(place(0, 6, 0).alias("place"), F.lit("").alias("line")),
        F.struct(place(0, 7, 0).alias("place"), F.concat(F.lit("[Documento — Fragmentos] "), "doc_id").alias("line")),
        F.struct(place(0, 8, 0).alias("place"), F.lit("").alias("line")),
    )).alias("x")).select("doc_id", "x.place", "x.line")
    first = top.where("place = 1").select("doc_id", place(0, 2, 0).alias("place"), F.concat(F.lit("  - TOP (documento): "), "name", F.lit(" (score="), shown, F.lit(")")).alias("line"))
    three = top.select("doc_id", F.array(F.lit(0), F.lit(4), F.col("place").cast("int")).alias("place"), F.concat(F.lit("      • "), "name", F.lit(": "), shown).alias("line"))
    found = standouts(acts).withColumn("name", _names(PORTUGUESE, "category"))
    scored = F.concat("name", F.format_string(" (score=%.4f", F.col("score")), F.when(F.coalesce("atype", F.lit("")) != "", F.concat(F.lit(", tipo="), "atype")).otherwise(""), F.lit(")"))
    per = Window.partitionBy("doc_id", "k").orderBy(F.lower("name"))
    each = found.withColumn("n", F.row_number().over(per)).select("doc_id", F.array(F.lit(1), F.col("k"), F.lit(10) + F.col("n")).alias("place"), F.concat(F.when(F.col("tied"), "    - ").otherwise("  > TOP: "), scored).alias("line"))
    heads = found.select("doc_id", "k", "tied").distinct().join(fragments.select("doc_id", "k", F.col("text").alias("label"), "frag_uri"), ["doc_id", "k"], "left")
    head = heads.select("doc_id", F.array(F.lit(1), F.col("k"), F.lit(0)).alias("place"), F.concat(F.lit("[Fragmento] "), F.coalesce(F.nullif("label", F.lit("")), "frag_uri")).alias("line"))
    tie = heads.where("tied").select("doc_id", F.array(F.lit(1), F.col("k"), F.lit(1)).alias("place"), F.lit("  > TOP (empate):").alias("line"))
    blank = heads.select("doc_id", F.array(F.lit(1), F.col("k"), F.lit(10**9)).alias("place"), F.lit("").alias("line"))
    out = docs
    for part in (first, three, head, tie, each, blank):
        out = out.unionByName(part)
    return out.select("doc_id", F.col("place")[0].alias("part"), F.col("place")[1].alias("k"), F.col("place")[2].alias("n"), "line")


def _lines(rows: DataFrame, part: int, keys: list, line, k="k") -> DataFrame:
    """Report lines (doc_id, part, k, place, line): ``place`` orders the lines of one part and fragment, so no task has to number a document's lines."""
    at = F.concat_ws("\u0001", *[F.coalesce(x, F.lit("")) if not isinstance(x, str) else F.lit(x) for x in keys])
    return rows.select("doc_id", F.lit(part).alias("part"), (F.col(k) if k else F.lit(-1)).cast("int").alias("k"), at.alias("place"), line.alias("line"))


def _heading(fragments: DataFrame):
    return F.concat(F.lit("[Fragmento] "), F.coalesce(F.nullif("text", F.lit("")), "frag_uri"))


def evoked_lines(acts: DataFrame, elements: DataFrame, fragments: DataFrame, language: str | None = None) -> DataFrame:
    """Question 1 as text, (doc_id, part, k, place, line), in the order of part, k and place: a line for the document, then per fragment its heading and what it evokes,
    activations first, by label. A score of 0 is not shown. Fragments that evoke nothing have no lines."""
    rows = evoked(acts, elements, fragments, language)
    name = F.coalesce("label", "category")
    via = F.when((F.col("source") == "activation") & (F.coalesce("score", F.lit(0.0)) != 0), F.format_string(" (via activation, score=%.4f)", "score")).otherwise(F.concat(F.lit(" (via "), "source", F.lit(")")))
    met = rows.select("doc_id", "k").distinct().join(fragments.select("doc_id", "k", "text", "frag_uri"), ["doc_id", "k"])
    docs = met.select("doc_id").distinct()
    out = _lines(docs, 0, ["0"], F.concat(F.lit("[Documento] "), "doc_id"), None).unionByName(_lines(docs, 0, ["1"], F.lit(""), None))
    out = out.unionByName(_lines(met, 1, ["0"], _heading(fragments))).unionByName(_lines(met, 1, ["2"], F.lit("")))
    return out.unionByName(_lines(rows, 1, ["1", F.col("source"), name, F.col("category")], F.concat(F.lit("  - "), name, via)))


def elements_lines(acts: DataFrame, elements: DataFrame, fragments: DataFrame) -> DataFrame:
    """Question 2 as text, (doc_id, part, k, place, line), in the order of part, k and place: per document its categories by name with their elements (each once, by type and
    name) and a summary of activations; then the same per fragment, each activation on a line of its own."""
    rows = elements_and_activations(acts, elements).withColumn("name", F.coalesce("label_pt", "label_en", "category")).withColumn("low", F.lower("name"))
    is_act = F.col("evidence_type") == "IntelligenceActivation"
    each, fired = rows.where(~is_act), rows.where(is_act)
    bullet = F.concat(F.lit("        • "), "evidence_type", F.lit(": "), "element")
    by_name = [F.col("evidence_type"), F.lower("element"), F.col("element")]
    docs = rows.select("doc_id").distinct()
    out = _lines(docs, 0, ["0"], F.concat(F.lit("[Documento] "), "doc_id"), None)
    out = out.unionByName(_lines(docs, 2, ["0"], F.concat(F.lit("[Documento — Fragmentos] "), "doc_id"), None))
    whole = ["doc_id", "name", "low"]
    out = out.unionByName(_lines(rows.select(*whole).distinct(), 1, [F.col("low"), "0"], F.concat(F.lit("  > Inteligência (doc): "), "name"), None))
    out = out.unionByName(_lines(each.select(*whole).distinct(), 1, [F.col("low"), "1"], F.lit("    - Elementos (agregado no doc):"), None))
    out = out.unionByName(_lines(each.select(*whole, "evidence_type", "element").distinct(), 1, [F.col("low"), "2", *by_name], bullet, None))
    totals = fired.groupBy(*whole).agg(F.count("*").alias("n"), F.count_if(F.lower("atype") == "primary").alias("first"), F.count_if(F.lower("atype") == "secondary").alias("second"), F.max("score").alias("top"))
    told = F.concat(F.format_string("    - Ativações (doc): n=%d, primárias=%d, secundárias=%d", "n", "first", "second"), F.when(F.col("top").isNotNull(), F.format_string(", max=%.4f", "top")).otherwise(""))
    out = out.unionByName(_lines(totals, 1, [F.col("low"), "3"], told, None))
    met = rows.select("doc_id", "k").distinct().join(fragments.select("doc_id", "k", "text", "frag_uri"), ["doc_id", "k"])
    part = [*whole, "k"]
    out = out.unionByName(_lines(met, 3, [""], _heading(fragments)))
    out = out.unionByName(_lines(rows.select(*part).distinct(), 3, [F.col("low"), "0"], F.concat(F.lit("  > Inteligência: "), "name")))
    out = out.unionByName(_lines(each.select(*part).distinct(), 3, [F.col("low"), "1"], F.lit("    - Elementos:")))
    out = out.unionByName(_lines(each.select(*part, "evidence_type", "element").distinct(), 3, [F.col("low"), "2", *by_name], bullet))
    out = out.unionByName(_lines(fired.select(*part).distinct(), 3, [F.col("low"), "3"], F.lit("    - Ativações:")))
    parts = F.concat_ws(", ", F.when(F.col("score").isNotNull(), F.format_string("score=%.4f", "score")), F.when(F.col("atype").isNotNull(), F.concat(F.lit("tipo="), "atype")))
    one = F.concat(F.lit("        • "), F.when(parts == "", "(sem score/tipo)").otherwise(parts))
    return out.unionByName(_lines(fired, 3, [F.col("low"), "4", F.col("act_uri")], one))


def metrics(rows: DataFrame) -> DataFrame:
    """Rows, documents and fragments of a question's answer."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("doc_id", "k").alias("fragments"))


def elements_by_category(elements: DataFrame) -> DataFrame:
    """Per fragment and category the set of its elements, (type, text) in order of type and name."""
    pairs = F.collect_set(F.struct(F.coalesce("role_name", F.lit("ExplanationElement")).alias("type"), F.lower("text").alias("low"), F.col("text").alias("name")))
    shown = F.transform(F.array_sort(pairs), lambda x: F.concat(x["type"], F.lit(":"), x["name"]))
    return elements.where("category IS NOT NULL").groupBy("doc_id", "k", "category").agg(F.array_join(shown, "|").alias("elements"))


def document_label(labels_of: list, uri) -> object:
    """The first of a document's labels that is not blank (Portuguese and English label, then title, then any), else its URI."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in labels_of], uri)
