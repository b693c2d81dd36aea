"""Number and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(c: Column) -> Column:
    """Within 0 and 1; null, and what is no number, is 0."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def half_up(c: Column, places: int = 4) -> Column:
    """Rounded half up as a decimal; a hair below a half counts as the half, as float noise leaves it there."""
    scale = 10**places
    return (F.floor(c * scale + F.lit(0.5) + F.lit(1e-9)) / scale).cast(f"decimal(18,{places})")


def half_even(c: Column) -> Column:
    """The whole number nearest, a half (within float noise) to the even one."""
    low = F.floor(c + F.lit(1e-9))
    rest = c - low
    tie = F.abs(rest - F.lit(0.5)) < 1e-7
    return F.when(tie, F.when(F.pmod(low, F.lit(2)) == 0, low).otherwise(low + 1)).otherwise(F.floor(c + F.lit(0.5))).cast("long")


def percent_text(share: Column) -> Column:
    """A share in percent with two places, halves to even."""
    n = half_even(share * 10000)
    return F.concat((F.floor(n / 100)).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def keyword_confidence(score: Column) -> Column:
    """The lower a keyword's score, the surer: 1/(1+score); what is no number is 0.5."""
    s = score.try_cast("double")
    return F.when(s.isNull(), 0.5).otherwise(clip01(F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), s))))


def source_confidence(source: Column) -> Column:
    """The confidence that a label's source earns."""
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(s == "llm", 0.90).when(s == "trigger", 0.65).when(s == "forced", 0.50).otherwise(0.60)


def position_relevance(text: Column, term: Column, floor: float = 0.5) -> Column:
    """The earlier a term stands in a text, the more relevant; 0.75 if either is blank or the term is absent."""
    p, t = F.coalesce(text, F.lit("")), F.coalesce(term, F.lit(""))
    at = F.instr(F.lower(p), F.lower(t))
    r = F.lit(1.0) - F.lit(0.5) * (at - 1) / F.greatest(F.lit(1), F.length(p))
    return F.when((F.trim(p) == "") | (F.trim(t) == "") | (at == 0), 0.75).otherwise(clip01(F.greatest(F.lit(floor), r)))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Cosine of two vectors given by their numbers, unrolled so that code is generated for it; 0 if either has no length."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    na = F.sqrt(sum((x * x for x in a[1:]), a[0] * a[0]))
    nb = F.sqrt(sum((y * y for y in b[1:]), b[0] * b[0]))
    return F.when((na <= 0) | (nb <= 0), 0.0).otherwise(dot / (na * nb))


def at(array: Column, n: int = 8) -> list[Column]:
    """The numbers of an array."""
    return [F.get(array, F.lit(i)) for i in range(n)]


def parsed_vector(c: Column) -> Column:
    """Eight numbers of a text that separates them by commas, semicolons or blanks, in brackets or not, with percent signs or not; null otherwise."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[\[\]()]+|[\[\]()]+$", ""), "[;%]| +", ",")
    parts = F.filter(F.split(raw, ","), lambda p: F.trim(p) != "")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(numbers) == 8) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def normalised(values: list[Column], norm: str, tau: float = 1.0) -> list[Column]:
    """Vector components by L1, L2 or softmax over all of them; a vector of zeros stays so."""
    total = sum(values[1:], values[0])
    zero = F.greatest(*[F.abs(v) for v in values]) == 0
    if norm == "l1":
        out = [v / total for v in values]
    elif norm == "l2":
        length = F.sqrt(sum((v * v for v in values[1:]), values[0] * values[0]))
        out = [v / length for v in values]
    elif norm == "softmax":
        t = tau if tau > 0 else 1.0
        top = F.greatest(*values)
        powers = [F.exp((v - top) / F.lit(t)) for v in values]
        whole = sum(powers[1:], powers[0])
        out = [p / whole for p in powers]
    else:
        raise ValueError(f"unknown norm {norm}")
    return [F.when(zero, 0.0).otherwise(v) for v in out]
