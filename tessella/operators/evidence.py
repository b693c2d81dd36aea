"""Evidence of categories in fragments: resolution of roles and names, triggers, keywords, merging."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from math import log
from statistics import mean, median, pstdev

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import numbers as N
from ..functions import text as T


def role_key(c: Column) -> Column:
    """A role's key: lower case, without blanks around it, underscores and hyphens."""
    return F.lower(F.translate(F.trim(c), "_-", ""))


def name_keys(c: Column) -> list[Column]:
    """The keys under which a category's name is looked up, in turn: as it stands, with blanks for hyphens and underscores, with double blanks made single."""
    key = F.lower(F.trim(c))
    return [key, F.translate(key, "-_", "  "), F.replace(key, F.lit("  "), F.lit(" "))]


def category_of(c: Column) -> Column:
    """The category's name that a label stands for, or null."""
    index = F.create_map(*[F.lit(x) for pair in dims.name_index() for x in pair])
    return F.coalesce(*[F.try_element_at(index, k) for k in name_keys(c)])


def resolved(evidences: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Evidence with ``role_name``, ``weight`` and ``category`` (each null if unknown), exact repeats merged, keys required."""
    # by fragment, so that repeats meet and all later aggregates and joins on a fragment find their rows in place
    rows = evidences.where("doc_id IS NOT NULL AND k IS NOT NULL").repartition("doc_id", "k").distinct()
    pairs = [(r.lower(), r, float((weights or {}).get(r, w))) for r, w in dims.ROLES]
    names = F.create_map(*[F.lit(x) for key, name, _ in pairs for x in (key, name)])
    values = F.create_map(*[F.lit(x) for key, _, w in pairs for x in (key, w)])
    key = role_key(F.col("role"))
    return rows.select("*", F.try_element_at(names, key).alias("role_name"), F.try_element_at(values, key).alias("weight"), category_of(F.col("intelligence")).alias("category"))


def usable(rows: DataFrame) -> DataFrame:
    """Resolved evidence with a known role and a text."""
    return rows.where(F.col("role_name").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def quarantine(rows: DataFrame) -> DataFrame:
    """Resolved evidence that can't be used, with the reason."""
    reason = (
        F.when(F.trim(F.coalesce("role", F.lit(""))) == "", "no role")
        .when(F.col("role_name").isNull(), "unknown role")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def merged(rows: DataFrame) -> DataFrame:
    """Per fragment, role, text (case aside) and category: the best confidence and relevance, the first text and language."""
    low = F.lower(F.col("text"))
    return rows.groupBy("doc_id", "k", F.coalesce("role_name", F.col("role")).alias("role_name"), low.alias("text_key"), "category").agg(
        F.max(N.clip01(F.col("confidence"))).alias("confidence"),
        F.max(N.clip01(F.col("relevance"))).alias("relevance"),
        F.min_by("text", F.struct("i", "text")).alias("text"),
        F.min_by("lang", F.struct("i", "text", "lang")).alias("lang"),
        F.count("*").alias("n"),
    )


def trigger_table(triggers: list[tuple[str, str, str]] | None = None) -> dict[str, list[str]]:
    """Folded terms per category, all languages together."""
    out: dict[str, set[str]] = {name: set() for name in dims.BY_INDEX}
    fold = str.maketrans(T.ACCENTED, T.FOLDED)
    for name, _, term in triggers or dims.triggers():
        t = term.strip().lower().translate(fold)
        for a, b in T.PAIRED:
            t = t.replace(a, b)
        if t:
            out[name].add(t)
    return {name: sorted(terms) for name, terms in out.items()}


def triggered(text: Column, triggers: list[tuple[str, str, str]] | None = None) -> Column:
    """The categories whose terms a text holds, in index order. The folded text is bound once, for all terms of all categories."""
    table = trigger_table(triggers)

    def names(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(T.is_triggered(low, terms), name) for name, terms in table.items()]))

    return F.flatten(F.transform(F.array(T.folded(text)), names))


def trigger_hits(rows: DataFrame, triggers: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(doc_id, k, category) of all triggers."""
    return rows.select("doc_id", "k", F.explode(triggered(F.col("text"), triggers)).alias("category"))


def valid_indexes(c: Column) -> Column:
    """Of a list of values the whole numbers from 0 to 7, each once, in order."""
    numbers = F.transform(c, lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 0) & (x <= 7)))


def names_of(indexes: Column) -> Column:
    """The category names of a list of indexes."""
    names = F.array(*[F.lit(n) for n in dims.BY_INDEX])
    return F.transform(indexes, lambda i: F.get(names, i))


def triggers_from(table: DataFrame, at_most: int = 100_000) -> list[tuple[str, str, str]]:
    """A trigger dictionary from a table (``intelligence``, ``lang``, ``term``), terms of several words included, for the parameter ``triggers``.

    A dictionary becomes part of the plan, so one of more than ``at_most`` terms is refused; terms of unknown categories are an error, null and blank ones are left out.
    """
    rows = table.select(category_of(F.col("intelligence")).alias("category"), "intelligence", "lang", F.trim("term").alias("term")).where("term <> ''").distinct().limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} trigger terms")
    if unknown := sorted({str(r["intelligence"]) for r in rows if r["category"] is None}):
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return sorted({(r["category"], r["lang"] or "", r["term"]) for r in rows})


def labelled(items: DataFrame, triggers: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per category of each item: its label is, in turn, what ``mi_idx`` lists and ``intelligence`` names, what its text triggers, what the last resort says; without any it is dropped.

    ``items`` holds doc_id, k, role, text, lang, mi_idx (array of strings), intelligence, confidence and relevance; items without role or text are dropped, missing
    numbers count as 0.75. The confidence is multiplied by that of the label's source. Items that agree in role, text (case aside) and label are one, with the highest numbers.
    """
    named = category_of(F.col("intelligence"))
    listed = F.coalesce(names_of(valid_indexes(F.col("mi_idx"))), F.array().cast("array<string>"))
    given = F.array_distinct(F.concat(listed, F.when(named.isNotNull(), F.array(named)).otherwise(F.array().cast("array<string>"))))
    rows = items.where((F.trim(F.coalesce("role", F.lit(""))) != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    rows = rows.select("*", given.alias("_given"), triggered(F.col("text"), triggers).alias("_hit"), T.last_resort(F.col("text")).alias("_last"))
    labels = F.when(F.size("_given") > 0, F.col("_given")).when(F.size("_hit") > 0, F.col("_hit")).when(F.col("_last").isNotNull(), F.array("_last"))
    source = F.when(F.size("_given") > 0, "llm").when(F.size("_hit") > 0, "trigger").otherwise("forced")
    base = lambda c: N.clip01(F.coalesce(F.col(c), F.lit(0.75)))
    each = rows.select("doc_id", "k", F.trim("role").alias("role"), F.trim("text").alias("text"), F.coalesce("lang", F.lit("pt")).alias("lang"), F.explode(labels).alias("intelligence"), N.clip01(base("confidence") * N.source_confidence(source)).alias("confidence"), base("relevance").alias("relevance"))
    return each.groupBy("doc_id", "k", "role", F.lower("text").alias("text_key"), "intelligence").agg(
        F.max("confidence").alias("confidence"), F.max("relevance").alias("relevance"), F.min("text").alias("text"), F.min("lang").alias("lang")
    )


# --- keywords ----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*|[^\w\s]")
STOPS = frozenset(dims.STOP_WORDS)


def keyword_scores(text: str, top_n: int = 3) -> dict[tuple[str, int], float]:
    """Published statistics of single-document keyword extraction: casing, position, frequency, spread over sentences and
    relatedness to neighbours score words; n-grams multiply their words' scores. Lower is better.

    A phrase starts and ends with no stop word and crosses no mark. Its sentence is where an end mark and a blank part the text.
    """
    parts = [WORD.findall(s) for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
    tf: Counter[str] = Counter()
    upper: Counter[str] = Counter()
    acronym: Counter[str] = Counter()
    where: dict[str, list[int]] = defaultdict(list)
    left: dict[str, Counter[str]] = defaultdict(Counter)
    right: dict[str, Counter[str]] = defaultdict(Counter)
    for i, words in enumerate(parts):
        before = None
        for j, w in enumerate(words):
            if not w[0].isalnum():
                before = None
                continue
            low = w.lower()
            tf[low] += 1
            where[low].append(i)
            if len(w) > 1 and w.isupper():
                acronym[low] += 1
            elif w[0].isupper() and j > 0:
                upper[low] += 1
            if before is not None:
                left[low][before] += 1
                right[before][low] += 1
            before = low
    kept = [w for w in tf if w not in STOPS and not w[0].isdigit() and len(w) > 2]
    if not kept:
        return {}
    counts = [tf[w] for w in kept]
    usual, most = mean(counts) + (pstdev(counts) if len(counts) > 1 else 0.0), max(tf.values())
    score: dict[str, float] = {}
    for w in tf:
        casing = max(upper[w], acronym[w]) / (1 + log(tf[w]))
        position = log(log(3 + median(where[w])))
        frequency = tf[w] / usual
        ways = [len(c) / max(1, sum(c.values())) for c in (left[w], right[w])]
        related = 1 + sum(ways) * tf[w] / most
        spread = len(set(where[w])) / len(parts)
        score[w] = position * related / (casing + frequency / related + spread / related)
    out: dict[tuple[str, int], float] = {}
    seen: Counter[tuple[str, ...]] = Counter()
    for words in parts:
        for j in range(len(words)):
            phrase: list[str] = []
            for w in words[j : j + top_n]:
                if not w[0].isalnum():
                    break
                phrase.append(w.lower())
                if phrase[0] not in STOPS and phrase[-1] not in STOPS and all(not p[0].isdigit() for p in phrase) and len(phrase[-1]) > 2 and len(phrase[0]) > 2:
                    seen[tuple(phrase)] += 1
    for phrase, n in seen.items():
        product = total = None
        for w in phrase:
            if w in STOPS:
                continue
            product = score[w] if product is None else product * score[w]
            total = score[w] if total is None else total + score[w]
        out[" ".join(phrase), len(phrase)] = product / (n * (1 + total))
    return out


def keywords(rows: DataFrame, top_n: int = 3) -> DataFrame:
    """(doc_id, k, term, n, score) of all keyword candidates of the cleaned texts; a term's best score over its lengths."""

    def extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, k, term, n, s) for d, k, t in zip(b["doc_id"], b["k"], b["t"], strict=True) for (term, n), s in keyword_scores(t, top_n).items()]
            yield pd.DataFrame(out, columns=["doc_id", "k", "term", "n", "score"])

    return rows.select("doc_id", "k", T.cleaned(F.col("text")).alias("t")).mapInPandas(extract, "doc_id string, k int, term string, n int, score double")


def limited(candidates: DataFrame, at_most: int = 160, good: float = 0.6, enough: int = 10) -> DataFrame:
    """Per fragment the best ``at_most`` candidates; of these only those up to ``good``, unless fewer than ``enough`` remain."""
    from pyspark.sql import Window

    per = Window.partitionBy("doc_id", "k")
    ranked = candidates.withColumn("r", F.row_number().over(per.orderBy("score", "term"))).where(F.col("r") <= at_most)
    kept = F.count_if(F.col("score") <= good).over(per)
    return ranked.withColumn("kept", kept).where((F.col("score") <= good) | (F.col("kept") < enough)).drop("r", "kept")


def reduced(candidates: DataFrame, at_most: int = 40) -> DataFrame:
    """Keywords without overlap: terms in canonical form (folded, no stop words), the best score of each, and none that a better one contains.

    The fold runs over a fragment's sorted candidates, of which ``limited`` leaves at most 160.
    """
    canon = candidates.withColumn("canon", F.array_join(T.tokens(F.col("term")), " ")).where("canon <> ''")
    best = canon.groupBy("doc_id", "k", "canon").agg(F.min(F.struct("score", "n")).alias("b"))
    lists = best.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct(F.col("b.score").alias("score"), F.col("canon"), F.col("b.n").alias("n")))).alias("items"))
    empty = F.array().cast("array<struct<score:double,canon:string,n:int>>")

    def keep(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda y: F.contains(F.concat(F.lit(" "), y["canon"], F.lit(" ")), F.concat(F.lit(" "), x["canon"], F.lit(" "))))
        return F.when(inside | (F.size(kept) >= at_most), kept).otherwise(F.concat(kept, F.array(x)))

    folded = F.aggregate("items", empty, keep)
    return lists.select("doc_id", "k", F.posexplode(folded).alias("i", "x")).select("doc_id", "k", "i", F.col("x.canon").alias("term"), F.col("x.score").alias("score"), F.col("x.n").alias("n"))


def annotated(rows: DataFrame, annotator: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, double_discount: bool = True, triggers: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Keyword evidence of fragments without a model service: keywords, triggers of their terms, confidence and relevance.

    A term that triggers Naturalist counts as recognised by a model; others by triggers. ``annotator`` is the seam for a model: batches of (doc_id, k, text)
    to batches of evidence (doc_id, k, role, text, category, confidence, relevance), which are added if their text stands in the fragment's.
    """
    terms = reduced(limited(keywords(rows)))
    hit = terms.join(rows.select("doc_id", "k", "text", "lang"), ["doc_id", "k"]).withColumn("names", triggered(F.col("term"), triggers))
    strong = F.array_contains("names", "NaturalistIntelligence")
    source = F.when(strong, "llm").otherwise("trigger")
    base = N.keyword_confidence(F.col("score")) * N.source_confidence(source)
    confidence = N.clip01(base * 0.9 if double_discount else base)
    out = hit.select("doc_id", "k", "i", F.lit("Keyword").alias("role"), F.col("term").alias("text"), "lang", F.explode(F.when(strong, F.array(F.lit("NaturalistIntelligence"))).otherwise(F.col("names"))).alias("intelligence"), F.round(confidence, 6).alias("confidence"), F.round(N.position_relevance(F.col("text"), F.col("term")), 6).alias("relevance"))
    if annotator is not None:
        more = rows.select("doc_id", "k", "text").mapInPandas(annotator, "doc_id string, k int, role string, text string, intelligence string, confidence double, relevance double")
        guarded = more.join(rows.select("doc_id", "k", F.col("text").alias("_whole"), "lang"), ["doc_id", "k"]).where(F.contains(F.lower("_whole"), F.lower("text")) & role_key(F.col("role")).isin([r.lower() for r, _ in dims.ROLES]))
        out = out.unionByName(guarded.select("doc_id", "k", F.lit(1000).alias("i"), "role", "text", "lang", "intelligence", "confidence", "relevance"))
    return out


# --- replies of models -------------------------------------------------------------------------------


def first_object(text: str) -> str | None:
    """The first balanced {...} of a text, braces in strings counted like others."""
    at, depth = text.find("{"), 0
    if at < 0:
        return None
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at : i + 1]
    return None


def repaired_json(text: str | None) -> str | None:
    """A reply's JSON: out of a code fence, its first object, commas before closing marks dropped; null if it still is none."""
    if text is None:
        return None
    fence = re.search(r"```(?:json)?(.*?)```", text, re.S)
    body = (fence[1] if fence else text.partition("```")[0]).strip()
    body = re.sub(r",\s*([}\]])", r"\1", first_object(body) or body)
    try:
        json.loads(body)
    except ValueError:
        return None
    return body


def repaired(replies: Column) -> Column:
    """``repaired_json`` of a column, in Arrow batches."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(repaired_json)

    return F.pandas_udf(each, "string")(replies)
