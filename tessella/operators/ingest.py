"""From texts and paragraphs to fragments: one row per document and position, with title and abstract flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: that of the highest ``order`` columns; remaining ties go to the greatest other values. A partial
    aggregate, so repeats are merged before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*ranked)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def fragment_uri(doc: Column, k: Column) -> Column:
    return F.concat(T.base_of(doc), F.format_string("frag-%03d", k))


def fragments(paragraphs: DataFrame) -> DataFrame:
    """Fragments of stored paragraphs: the latest run of each (doc_id, k), its URI made where it is missing, language 'und' where it is.

    Rows without doc_id or k are no fragments; null texts stay as empty ones.
    """
    rows = paragraphs.where("doc_id IS NOT NULL AND k IS NOT NULL").select("doc_id", "k", "run_no", "ingested_at", "frag_uri", "text", "lang", "is_title_or_abstract")
    one = latest(rows, ["doc_id", "k"], "run_no", "ingested_at")
    return one.select(
        "doc_id",
        "k",
        F.coalesce("frag_uri", fragment_uri(F.col("doc_id"), F.col("k"))).alias("frag_uri"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang"),
        F.coalesce("is_title_or_abstract", F.lit(False)).alias("is_title"),
    )


def from_text(df: DataFrame, id_col: str, text_col: str, lang: Column | None = None) -> DataFrame:
    """(doc_id, paragraphs) of whole texts: paragraphs are parted by blank lines and cleaned; empty ones are dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n[ \t]*\n\s*"), T.cleaned), lambda p: p != "")
    language = F.coalesce(lang if lang is not None else F.lit(None).cast("string"), F.lit("und"))
    return df.select(F.col(id_col).cast("string").alias("doc_id"), F.transform(parts, lambda p: F.struct(p.alias("text"), language.alias("lang"))).alias("paragraphs"))


def from_html(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``from_text`` of pages."""
    return from_text(df.withColumn("_text", T.without_tags(F.col(html_col))), id_col, "_text")


def resegmented(docs: DataFrame, max_chars: int = 900, min_chars: int = 120) -> DataFrame:
    """Paragraphs longer than ``max_chars`` cut into chunks (a document's only paragraph always); the language is inherited."""

    def cut(p: Column) -> Column:
        whole = F.array(p)
        parts = F.transform(T.chunks(p["text"], max_chars, min_chars), lambda t: F.struct(t.alias("text"), p["lang"].alias("lang")))
        return F.when((F.size("paragraphs") == 1) | (F.length(p["text"]) > max_chars), parts).otherwise(whole)

    return docs.withColumn("paragraphs", F.flatten(F.transform("paragraphs", cut)))


def exploded(docs: DataFrame) -> DataFrame:
    """One row per paragraph, numbered from 0."""
    return docs.select("doc_id", F.posexplode("paragraphs").alias("k", "p")).select("doc_id", "k", F.col("p.text").alias("text"), F.col("p.lang").alias("lang"))


def with_titles(rows: DataFrame, scan: int = 3, max_chars: int = 160, force: bool = True) -> DataFrame:
    """Flags of titles and abstracts (column ``is_title``).

    Abstracts are flagged among the first max(5, ``scan``) paragraphs. The title is the first of ``scan`` paragraphs that looks like one and has
    at most ``max_chars`` characters, else the first of them that is not blank and short enough, else paragraph 0 if ``force``. The choice is an aggregate per
    document that is joined back by key, so no window holds a document's rows.
    """
    t = T.stripped(F.coalesce("text", F.lit("")))
    early = F.col("k") < scan
    short = (t != "") & (F.length(t) <= max_chars)
    picks = rows.groupBy("doc_id").agg(F.min(F.when(early & short & T.looks_like_title(F.col("text")), F.col("k"))).alias("by_look"), F.min(F.when(early & short, F.col("k"))).alias("by_size"))
    chosen = F.coalesce("by_look", "by_size", F.lit(0) if force else F.lit(None).cast("int"))
    abstract = (F.col("k") < max(5, scan)) & T.is_abstract(F.col("text"))
    return rows.join(picks, "doc_id").withColumn("is_title", F.coalesce(abstract | (F.col("k") == chosen), F.lit(False))).drop("by_look", "by_size")


def unseen(new: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents not ingested yet."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def limited_language(rows: DataFrame, hint: str | None) -> DataFrame:
    """Languages other than a supported hint become the hint; without one, those that are not supported become Portuguese."""
    known = ["pt", "en", "es"]
    if hint in known:
        return rows.withColumn("lang", F.lit(hint))
    low = F.lower(F.trim("lang"))
    return rows.withColumn("lang", F.when(low.isin(known), low).otherwise("pt"))


def projected(paragraphs: Column) -> Column:
    """Paragraphs of an outer cleaner: the cleaned text, else the raw one, else nothing; the language or 'und'."""
    blank = F.lit("")
    return F.transform(
        paragraphs,
        lambda p: F.struct(F.coalesce(F.nullif(p["cleaned"], blank), F.nullif(p["raw"], blank), blank).alias("text"), F.coalesce(F.nullif(p["language"], blank), F.lit("und")).alias("lang")),
    )
