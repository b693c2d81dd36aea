"""Texts cut off by field limits or mid-transfer, and how often each source cuts.

Per source the hazard of every length (distinct texts that end there among those that reach it) is tested
against the hazards of neighbouring lengths, in characters, in bytes and in bands, by window functions. The null
hypothesis is a hazard of up to ``RATIO`` times the neighbours', so that a slope of the length density is never a
limit, however many texts show it; the tests are held to a false-discovery rate. Incomplete endings at significant lengths are flagged:
inside a sentence, with an ellipsis, or after words that may close a sentence or not. Exception: as texts are also cut at no fixed
length (mid-transfer), one that plainly stops inside a sentence is flagged at any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled
from . import sentences

# Notes put in place of the rest of a text, a choice of ours.
REST_NOTE = re.compile(
    r"\s*(?:\[\s*(?:\.{2,}|…|\+)\s*\]|\(\s*(?:\.{3}|…|continua|continúa|continuará|continued|continues|cont\.?|suite|à suivre|segue|fortsetzung folgt|more|mais|más|leia mais|ver mais|read more|продолжение следует|продолжение)\s*\)|<[^<>]{0,12}|&\w{0,6};?|\x00+)\s*$",
    re.IGNORECASE,
)
ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…+)$")
# What may follow a finished text: numbers and ornaments, a reference in brackets, a list's item, a dated signature.
APPENDED = re.compile(
    r"(?:[\W\d_]+|[(\[（][^()\[\]（）\n]*[)\]）]\.?|(?:[-–—•*·]|\d{1,3}[.)º])[ \t]+[^\n]*|(?:[-–—][ \t]*)?(?:\w[\w.'’-]*[ \t]+){0,5}\w[\w.'’-]*,?[ \t]+\(?\d{4}\)?)$"
)
SIGNED = re.compile(r"^(?:[-–—][ \t]*)?[^a-zà-öø-ÿа-яα-ω\s]\S*(?:[ \t]+(?:de|da|do|dos|das|e|y|von|van|di|del|la|le|[^a-zà-öø-ÿа-яα-ω\s]\S*))*[ \t,]+\(?\d{4}\)?$")
LAST_WORDS = re.compile(r"[\w’'-]+")
#: Neighbouring lengths on each side; a band is as wide as the scatter that cuts at word ends and notes in place of the rest leave.
HALF = 25
BAND = 16
HALF_BANDS = 4
#: A length is a limit only if its hazard is more than so many times its neighbours'.
RATIO = 2.0


def natural_key(before: str) -> str:
    """The words before an ellipsis by which a habitual ending is known."""
    return " ".join(LAST_WORDS.findall(before.lower())[-2:]) or before[-6:]


def without_appendix(text: str) -> str:
    """The text without what may follow its last sentence on lines of its own."""
    text = text.rstrip()
    while "\n" in text:
        head, _, line = text.rpartition("\n")
        line = line.strip()
        if not head.strip():
            break
        if not line or (APPENDED.match(line) and (not line[-4:].strip(")").isdigit() or not line[0].isalpha() or SIGNED.match(line))):
            text = head.rstrip()
        else:
            break
    return re.sub(r"(?<=[.!?…。！？।؟”»\")])\s+[-–—]?\s*\d{1,4}\s*[-–—]?$", "", text)


def unclosed(unit: str) -> bool:
    """Whether a quotation or bracket is open at the end of a unit."""
    awaited: list[str] = []
    for c in unit:
        if awaited and c in awaited[-1]:
            awaited.pop()
        elif c in sentences.PAIRS:
            awaited.append(sentences.PAIRS[c])
    return bool(awaited)


def ending(text: str | None, weights: dict[str, float]) -> tuple[str, str]:
    """How a text ends: *whole*, *cut*, *open* (either) or *ellipsis* with the words before it."""
    if not text or not text.strip():
        return "whole", ""
    if "฀" <= last_letter(text) <= "๿":
        return "whole", ""
    body, noted = text.rstrip("\r\n\t "), False
    while m := REST_NOTE.search(body):
        body, noted = body[: m.start()], True
    if not noted:
        body = without_appendix(body)
    letter = last_letter(body)
    if not letter or "฀" <= letter <= "๿":
        return "whole", ""
    found = sentences.places(body)
    tags = sentences.decoded(found, weights)
    ends = [e for (e, _, _), tag in zip(found, tags, strict=True) if tag and e < len(body.rstrip())]
    unit = body[ends[-1] if ends else 0 :].strip()
    stem = unit.rstrip("\"'”’“»)]」』）  ")
    if not stem or stem[-1] not in sentences.END_MARKS + ";" or (stem[-1] == ";" and not "Ͱ" <= stem[-2:-1] <= "῿"):
        return "cut", ""
    if unclosed(unit):
        return "cut", ""
    if m := ELLIPSIS.search(stem):
        return "ellipsis", natural_key(stem[: m.start()])
    last = found[-1][1] if found and found[-1][0] >= len(body.rstrip()) else ()
    if len(last) > 7:
        term, before, _, _, shut, _ = last[7].split("|")
        if before in ("lead", "initial", "none") and term == ".":
            return "cut", ""
        if before in ("may", "inner", "letter") or shut in ("q0", "b0"):
            return "open", ""
    return "whole", ""


def last_letter(text: str) -> str:
    """The last letter of a text, or nothing."""
    return next((c for c in reversed(text) if c.isalpha()), "")


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1.0)), tiny)
    h = d
    for m in range(1, 10000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-12:
            break
    return h


def binomial_tail(n: int, trials: int, share: float) -> float:
    """The probability of ``n`` or more hits in so many trials of the given chance."""
    if n <= 0:
        return 1.0
    if n > trials or share <= 0:
        return 0.0
    if share >= 1:
        return 1.0
    a, b = float(n), float(trials - n + 1)  # the incomplete beta function of the chance
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(share) + b * math.log1p(-share))
    if share < (a + 1) / (a + b + 2):
        return min(1.0, front * beta_fraction(a, b, share) / a)
    return min(1.0, max(0.0, 1.0 - front * beta_fraction(b, a, 1.0 - share) / b))


def significant_lengths(rows: DataFrame, rate: float = 0.01, least: int = 4, ratio: float = RATIO, rounds: int = 2) -> DataFrame:
    """Lengths at which a source ends texts far more often than at neighbouring ones.

    ``rows`` holds ``source``, ``measure`` and ``length``, one row for each distinct text and measure. Result: source, measure, length, n, at_risk,
    around, risk_around, p_value. Given all ends at a length and around it, those at the length are binomial; tested is whether its
    hazard exceeds ``ratio`` times that around it, Benjamini-Hochberg at ``rate`` for each source and measure. A second round leaves limits
    already found out of the neighbourhoods. Only counts per length are windowed, so no window holds more rows than there are lengths.
    """
    counts = rows.groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    per = Window.partitionBy("source", "measure")
    counts = settled(counts.withColumn("at_risk", F.sum("n").over(per.orderBy(F.desc("length")))).withColumn("found", F.lit(False)))

    def tails(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = ratio * b["risk_here"] / (ratio * b["risk_here"] + b["risk_around"])
            yield b.assign(p_value=[binomial_tail(int(n), int(n + a), float(x)) for n, a, x in zip(b["n"], b["around"], share, strict=True)])

    schema = "source string, measure string, length int, n long, at_risk long, found boolean, around long, risk_around double, risk_here double, p_value double"
    is_band = F.col("measure").startswith("band")

    def within(half: int, value: Column, how=F.sum) -> Column:
        return how(value).over(per.orderBy("length").rangeBetween(-half, half))

    def either(value: Column, how=F.sum) -> Column:
        return F.when(is_band, within(HALF_BANDS, value, how)).otherwise(within(HALF, value, how))

    for _ in range(rounds):
        kept = F.when(~F.col("found"), F.col("n")).otherwise(0)
        half = F.when(is_band, HALF_BANDS).otherwise(HALF)
        taken = either(F.col("found").cast("int")) - F.col("found").cast("int")
        # lengths without ends have no row: the texts at risk there lie between those at the window's sides and in its middle
        below = F.least(half, F.col("length")) * (either(F.col("at_risk"), F.max) + F.col("at_risk")) / 2
        above = half * (F.col("at_risk") + either(F.col("at_risk"), F.min)) / 2
        places = half + F.least(half, F.col("length"))
        hazards = counts.withColumn("around", either(kept) - kept).withColumn("risk_around", F.greatest(F.lit(1.0), (below + above) * (places - taken) / places))
        # where few texts reach further, every hazard nears one: there the ends themselves are compared
        hazards = hazards.withColumn("risk_here", F.greatest(F.col("at_risk").cast("double"), (below + above) / places))
        tested = hazards.mapInPandas(tails, schema)
        ranked = tested.withColumn("rank", F.row_number().over(per.orderBy("p_value", "length"))).withColumn("tests", F.count("*").over(per))
        passed = F.max(F.when(F.col("p_value") <= rate * F.col("rank") / F.col("tests"), F.col("rank"))).over(per)
        counts = settled(ranked.withColumn("last", passed).withColumn("found", F.coalesce((F.col("rank") <= F.col("last")) & (F.col("n") >= least), F.lit(False))))
        result, counts = counts, counts.select("source", "measure", "length", "n", "at_risk", "found")
    return result.where("found").select("source", "measure", "length", "n", "at_risk", "around", "risk_around", "p_value")


def judged_texts(df: DataFrame, id_col: str, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every text's ending: id, ``source`` (blanks and capitals set aside), ``chars``, ``bytes``, ``ending``, ``words`` before an ellipsis."""
    weights = sentences.trained()
    source = F.coalesce(F.lower(F.trim(F.col(source_col))), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), source.alias("source"), F.col(text_col).alias("_text"))

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [ending(t, weights) for t in b["_text"]]
            yield pd.DataFrame(
                {
                    "_id": b["_id"],
                    "source": b["source"],
                    "chars": [len(t) if t else 0 for t in b["_text"]],
                    "bytes": [len(t.encode("utf-8", "replace")) if t else 0 for t in b["_text"]],
                    "ending": [e for e, _ in found],
                    "words": [w for _, w in found],
                    "digest": [hashlib.md5((t or "").encode("utf-8", "replace")).hexdigest() for t in b["_text"]],
                }
            )

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(judge, f"_id {kind}, source string, chars int, bytes int, ending string, words string, digest string")


MEASURES = ["chars", "bytes", "band", "band_between"]


def truncated_texts(df: DataFrame, id_col: str, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every text with ``source`` and ``cut``: whether it was cut before its end.

    Null and blank texts are whole; a null source is the source ''. Lengths are tested in characters, in bytes and in two rows of bands
    of ``BAND`` characters (the second shifted by half a band), as cuts at word ends and notes in place of the rest scatter the length. Each distinct
    text counts once. An ellipsis is a habitual end if the words before it end at least two distinct texts away from significant lengths and as many as at them;
    other ellipses stand for a rest. A copy of a cut text is cut, whatever its source. Rows that repeat an id stay.
    """
    judged = judged_texts(df, id_col, text_col, source_col)
    judged = judged.withColumn("band", F.floor(F.col("chars") / BAND).cast("int")).withColumn("band_between", F.floor((F.col("chars") + BAND // 2) / BAND).cast("int"))
    judged = settled(judged)
    texts = judged.groupBy("source", "digest").agg(*[F.first(m).alias(m) for m in ("ending", "words", *MEASURES)])  # copies agree in all of these
    measures = F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.col(m))])
    spikes = settled(significant_lengths(texts.where("chars > 0").select("source", F.explode(measures).alias("measure", "length"))).select("source", "measure", "length"))
    for measure in MEASURES:
        of = spikes.where(F.col("measure") == measure).select("source", F.col("length").alias(measure), F.lit(True).alias(f"at_{measure}"))
        texts = texts.join(of, ["source", measure], "left")
    exact = F.coalesce("at_chars", "at_bytes", F.lit(False))
    near = F.coalesce("at_chars", "at_bytes", "at_band", "at_band_between", F.lit(False))
    texts = texts.select("source", "digest", "ending", "words", exact.alias("exact"), near.alias("at_limit"))
    # a text that several sources hold is at a limit if it is at one in any of them
    every = settled(texts.groupBy("digest").agg(F.first("ending").alias("ending"), F.first("words").alias("words"), F.max("exact").alias("exact"), F.max("at_limit").alias("at_any")))
    habits = every.where("ending = 'ellipsis'").groupBy("words").agg(F.count_if(~F.col("at_any")).alias("away"), F.count_if("at_any").alias("at"))
    habits = habits.where("away >= 2 and away >= at").select("words", F.lit(True).alias("natural"))
    cut = (
        F.when(F.col("ending") == "cut", True)
        .when(F.col("ending") == "ellipsis", F.col("natural").isNull())
        .when(F.col("ending") == "open", F.col("exact"))
        .otherwise(False)
    )
    cuts = every.join(habits, "words", "left").where(cut).select("digest", F.lit(True).alias("cut"))
    limits = texts.where("at_limit").select("source", "digest", F.lit(True).alias("at_limit"))
    met = judged.join(limits, ["source", "digest"], "left").join(cuts, "digest", "left")
    no = F.lit(False)
    return met.select(F.col("_id").alias(id_col), "source", "chars", "bytes", "ending", "words", F.coalesce("at_limit", no).alias("at_limit"), F.coalesce("cut", no).alias("cut"))


def truncation_rates(flags: DataFrame) -> DataFrame:
    """Per source: texts, cut ones, their share, and how many of them end at a significant length."""
    return flags.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if("cut").alias("cut_texts"),
        F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_share"),
        F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"),
    )
