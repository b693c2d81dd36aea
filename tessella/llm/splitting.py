"""Cutting oversized texts at natural boundaries, with overlap, in SQL expressions.

A *shadow* of the text holds one letter per character: P blank-line white space, B other white
space, S the end of a sentence unit, x anything else. One regular expression with bounded
quantifiers, its alternatives ordered from the strongest boundary to the single character,
consumes the shadow; piece lengths give offsets into the text, and each piece after the first
looks back by the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sentences


def shadow(text: Column, ends: Column) -> Column:
    """One of P, B, S, x for each character of the text."""
    plain = F.regexp_replace(text, r"[^ \t\r\n]", "x")
    blank_lines = F.regexp_replace(plain, r"(?:\G(?!^)|(?=\n[ \t\r]*\n))[ \t\r\n]", "P")
    marked = F.translate(blank_lines, " \t\r\n", "BBBB")
    before = F.concat(F.array(F.lit(0)), ends)
    parts = F.transform(ends, lambda e, i: F.concat(F.substring(marked, before[i] + 1, e - before[i] - 1), F.lit("S")))
    rest = F.substring(marked, F.coalesce(F.element_at(ends, -1), F.lit(0)) + 1, F.length(marked))
    return F.when(F.size(ends) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(marked)


def piece_pattern(limit: int, overlap: int) -> str:
    """The alternatives, strongest boundary first: the whole rest, before blank lines, after a sentence,
    before a blank, anywhere. The first piece may fill the limit, later ones leave room for the overlap."""

    def choices(n: int) -> str:
        return rf".{{1,{n}}}\z|.{{0,{n - 1}}}[^P](?=P)|.{{0,{n - 1}}}S|.{{0,{n - 1}}}[xS](?=[BP])|.{{1,{n}}}"

    return rf"\A(?:{choices(limit)})|(?:{choices(limit - overlap)})"


def boundary_pattern(limit: int, finest: int) -> str:
    """The extraction with the alternatives up to a boundary's strength alone (1 blank lines, 2 sentence ends too, 3 any white space), overlap left aside.
    White space before a piece takes no room; what no alternative can cut within the limit falls back to characters, captured as a group."""
    most = limit - 1
    blank_line, anywhere = rf".{{0,{most}}}[^BP](?=B*P|[BP]*\z)", rf".{{0,{most}}}[^BP](?=[BP]|\z)"
    alternatives = {1: blank_line, 2: rf".{{0,{most}}}S|{blank_line}", 3: anywhere}[finest]
    return rf"[BP]*+(?:{alternatives}|\z|(.{{1,{limit}}}))"


def finest_needed(shade: Column, limit: int) -> Column:
    """Which boundaries the extraction needs to stay within the limit: 1 blank lines, 2 sentence units, 3 blanks, 4 characters.

    As pieces end at boundaries only, a stretch that doesn't fit is met at its beginning; so characters are taken if and only if one doesn't fit.
    """
    found = F.lit(4)
    for finest in (3, 2, 1):
        taken = F.regexp_extract_all(shade, F.lit(boundary_pattern(limit, finest)), F.lit(1))
        found = F.when(F.forall(taken, lambda x: x == ""), finest).otherwise(found)
    return found


def shaded(df: DataFrame, text_col: str, longer_than: int, sent=None) -> DataFrame:
    """Texts longer than a length with their shadow in column ``_shade``."""
    rows = df.where(F.length(text_col) > longer_than)
    return sentences.with_unit_ends(rows, text_col, sent).withColumn("_shade", shadow(F.col(text_col), F.col("ends"))).drop("ends")


def split_texts(df: DataFrame, keys: list[str], limits: list[tuple[str, int, int]], text_col: str = "text", sent=None) -> DataFrame:
    """Every text longer than a limit in pieces within it.

    ``limits`` holds (name, most characters, overlap); the overlap must be smaller than the limit. Result: the keys,
    ``limit_name``, ``piece_no`` from 0, ``start_pos``, ``piece``, ``finest``. The pieces cover the text; each after the first
    repeats the last ``overlap`` characters before it. Null texts and texts within the limit give no rows;
    repeated keys count once.
    """
    for name, most, overlap in limits:
        if not 0 <= overlap < most:
            raise ValueError(f"limit {name}: the overlap must lie within 0 and the limit")
    least = min(most for _, most, _ in limits)
    rows = shaded(df.select(*keys, F.col(text_col).alias("_text")), "_text", least, sent)
    out = None
    for name, most, overlap in limits:
        cut = F.regexp_extract_all("_shade", F.lit(piece_pattern(most, overlap)), F.lit(0))
        sizes = F.transform(cut, F.length)
        structs = _pieces(sizes, F.col("_text"), overlap)
        one = (
            rows.where(F.length("_text") > most)
            .withColumn("_n", structs)
            .withColumn("finest", finest_needed(F.col("_shade"), most))
            .groupBy(*keys)
            .agg(F.min(F.struct("finest", "_n")).alias("r"))
            .select(*keys, F.lit(name).alias("limit_name"), F.col("r.finest").alias("finest"), F.inline("r._n"))
        )
        out = one if out is None else out.unionByName(one)
    return out


def _pieces(sizes: Column, text: Column, overlap: int) -> Column:
    """From the sizes of the parts that cover a text: each piece's number, start, and text with the overlap before it."""

    def start(i: Column) -> Column:
        return F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)

    def piece(n: Column, i: Column) -> Column:
        back = F.when(i > 0, F.lit(overlap)).otherwise(F.lit(0))
        return F.struct(i.cast("int").alias("piece_no"), (start(i) - back).cast("int").alias("start_pos"), F.substring(text, start(i) - back + 1, n + back).alias("piece"))

    return F.transform(sizes, piece)


def finest_boundaries(df: DataFrame, keys: list[str], limit: int, text_col: str = "text", sent=None) -> DataFrame:
    """For every text longer than the limit, the finest boundary that its cutting needs (see ``finest_needed``)."""
    rows = shaded(df.select(*keys, F.col(text_col).alias("_text")), "_text", limit, sent)
    return rows.select(*keys, finest_needed(F.col("_shade"), limit).alias("finest")).groupBy(*keys).agg(F.min("finest").alias("finest"))
