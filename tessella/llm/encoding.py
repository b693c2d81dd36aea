"""Garbled text from wrong character encoding: find it, learn the ciphers, restore it.

A wrong decoding is a substitution cipher whose key is a pair of code pages. Damage by pairs of known pages is found by the gain in plausibility that undoing
them brings, judged by character n-grams of the corpus itself; expectation-maximisation over all suspect texts learns how often each pair occurs. Keys of
pages that are on no list are learnt, too: per source, expectation-maximisation finds the letter behind each symbol, from any key at first (letter frequencies; the known
pages where they know the symbol, weighed by their shares), with the n-grams around each occurrence as the language's evidence. The learnt key is applied by
translation. UTF-8 that was misread isn't letter to letter; it is decoded by its form.

Null and blank texts are undamaged and give no row. A text with replacement characters
(U+FFFD) has lost what stood there: it is reported with no restored text.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settled
from . import charlm

# Code pages by which UTF-8 is commonly misread, a choice of ours.
UTF8_MISREAD_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15", "iso8859-2", "koi8-r", "cp866", "cp1253", "cp1254"]

# Other common pairs of true and wrong code page, a choice of ours.
PAGE_PAIRS = [
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp1253"),
    ("cp1252", "koi8-r"), ("cp1252", "iso8859-2"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "latin-1"), ("cp437", "latin-1"),
    ("mac_roman", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"),
    ("cp1251", "iso8859-5"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1252"), ("cp866", "latin-1"),
    ("cp866", "cp437"), ("iso8859-5", "latin-1"), ("mac_cyrillic", "mac_roman"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"), ("cp1256", "cp1252"), ("cp1256", "latin-1"),
    ("iso8859-6", "latin-1"), ("cp874", "cp1252"), ("cp874", "latin-1"), ("gbk", "cp1252"), ("gbk", "latin-1"), ("big5", "cp1252"), ("shift_jis", "cp1252"), ("shift_jis", "latin-1"),
    ("euc_jp", "cp1252"), ("euc_jp", "latin-1"),
]
SWAPS = [("utf-8", wrong) for wrong in UTF8_MISREAD_AS] + PAGE_PAIRS
# Bytes that lead and end the two-byte characters of a code page (first, last).
MULTI_BYTE = {
    "gbk": ([(0x81, 0xFE)], [(0x40, 0x7E), (0x80, 0xFE)]),
    "big5": ([(0x81, 0xFE)], [(0x40, 0x7E), (0xA1, 0xFE)]),
    "shift_jis": ([(0x81, 0x9F), (0xE0, 0xFC)], [(0x40, 0x7E), (0x80, 0xFC)]),
    "euc_jp": ([(0xA1, 0xFE)], [(0xA1, 0xFE)]),
}

LOST = "�"
#: Gain in plausibility from which a text counts as damaged.
LEAST_GAIN = 4.0
ROUNDS = 3
#: A trigram whose log share is below this is implausible.
ODD = 0.7
#: Up to a place where a capital letter is due.
SENTENCE_START = re.compile(r"(?:^|[.!?…»”’\")\]]\s*|\n)$")


def page_letters(page: str) -> list[str]:
    """The character of each byte; a byte without one gives the control character of its number."""
    return [codecs.decode(bytes([b]), page, "ignore") or chr(b) for b in range(256)]


class Swap:
    """One cipher: text in the code page ``true`` that was read by the code page ``wrong``."""

    def __init__(self, true: str, wrong: str):
        self.true, self.wrong = true, wrong
        letters = page_letters(wrong)
        self.byte_of = {c: b for b, c in enumerate(letters) if b >= 0x80}
        high = {b: re.escape(letters[b]) for b in range(0x80, 0x100)}
        if true == "utf-8":
            tail = "[" + "".join(high[b] for b in range(0x80, 0xC0)) + "]"
            # Two-byte sequences of Armenian and Hebrew are left out: in the Macintosh page they are an apostrophe and a letter.
            skip = range(0xD4, 0xD8) if wrong == "mac_roman" else ()
            heads = [("".join(high[b] for b in range(lo, hi) if b not in skip), n) for lo, hi, n in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3))]
            self.pattern = re.compile("(?:" + "|".join(f"[{h}]{tail}{{{n}}}" for h, n in heads) + ")+")
        elif true in MULTI_BYTE:
            self.byte_of |= {chr(b): b for b in range(0x40, 0x80)}
            lead, end = ("".join(re.escape(letters[b]) for lo, hi in spans for b in range(lo, hi + 1)) for spans in MULTI_BYTE[true])
            self.pattern = re.compile(f"(?:[{lead}][{end}])+")
        else:
            self.pattern = re.compile("[" + "".join(high.values()) + "]+")
        self.letters_swap = not (true == "utf-8" or true in MULTI_BYTE)
        self.table = {} if true == "utf-8" or true in MULTI_BYTE else {c: x for c, b in self.byte_of.items() if (x := codecs.decode(bytes([b]), true, "ignore")) and x != c}

        self.translation = str.maketrans(self.table)

    def decoded(self, run: str) -> str | None:
        """What a garbled run reads in the true code page, or None if it can't have been that."""
        if self.table:
            return "".join(self.table.get(c, c) for c in run)
        try:
            return bytes(self.byte_of[c] for c in run).decode(self.true)
        except (UnicodeDecodeError, KeyError):
            return None

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for m in self.pattern.finditer(text):
            new = self.decoded(m[0])
            if new is None or new == m[0]:
                continue
            if self.true == "utf-8":  # text misread several times is judged by what it read at first
                for _ in range(ROUNDS):
                    again = self.pattern.sub(lambda x: self.decoded(x[0]) or x[0], new)
                    if again == new:
                        break
                    new = again
            # control characters are no text, but may be the trace of UTF-8 that was misread before
            if not any("\x80" <= c <= "\x9f" for c in new) or (self.true == "utf-8" and utf8_traces().search(new)):
                out.append((m.start(), m.end(), new))
        return out


@lru_cache(maxsize=1)
def swaps() -> list[Swap]:
    return [Swap(true, wrong) for true, wrong in SWAPS]


TRACED = [w for w in UTF8_MISREAD_AS if w not in ("koi8-r", "cp866", "cp1253")]


@lru_cache(maxsize=1)
def utf8_traces() -> re.Pattern:
    """Any sequence that UTF-8 leaves in one of the wrong code pages other than Cyrillic and Greek ones."""
    return re.compile("|".join(s.pattern.pattern for s in swaps() if s.true == "utf-8" and s.wrong in TRACED))


@lru_cache(maxsize=1)
def _trace_starts() -> re.Pattern:
    """Where a trace may begin: a first byte's letter before a later byte's, each in any of the code pages."""
    letters = [page_letters(w) for w in TRACED]
    heads, tails = ("".join(sorted({re.escape(x[b]) for x in letters for b in span})) for span in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{heads}](?=[{tails}])")


def has_trace(text: str) -> bool:
    """Whether ``utf8_traces`` are in a text; one class of letters finds the few places worth the full pattern."""
    full = utf8_traces().match
    return any(full(text, m.start()) for m in _trace_starts().finditer(text))


def edit_gains(text: str, edits: list[tuple[int, int, str]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each edit adds to the plausibility of its surroundings, and the least plausible
    trigram that it does away with. All edits are scored in one pass over a joined string."""
    parts, cuts, at = [], [], 0
    for a, b, new in edits:
        left, right = text[max(0, a - 2) : a], text[b : b + 2]
        for part in (f" {left}{new}{right} ", f" {left}{text[a:b]}{right} "):
            parts.append(part)
            cuts.append((at, at + len(part) - 2))
            at += len(part)
    values = table[charlm.trigram_cells(charlm.code_points("".join(parts)))]
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    bounds = np.array(cuts)
    scores = sums[bounds[:, 1]] - sums[bounds[:, 0]]
    low = np.array([values[s:e].min() for s, e in cuts[1::2]])
    return scores[0::2] - scores[1::2], low


def swap_gain(text: str, swap: Swap, table: np.ndarray, common: bool = False) -> tuple[float, list[tuple[int, int, str]]]:
    """The gain by one swap and the edits worth making. A valid UTF-8 sequence is evidence by
    its form and needs little gain of its own; other letters must be implausible as they stand, unless ``common``: damage may then be
    frequent, so that what surrounds an edit may be damaged by the same swap."""
    edits = swap.edits(text)
    if not edits:
        return 0.0, []
    gains, low = edit_gains(text, edits, table)
    if swap.true == "utf-8":
        gains = gains + np.array([2.0 * (b - a) for a, b, _ in edits])
        kept = gains > -12.0
    else:
        lowers = [new[0].islower() and text[a].isupper() and SENTENCE_START.search(text, max(0, a - 6), a) is not None for a, _, new in edits]
        if common:
            around = text.translate(swap.translation)  # letter by letter, so places stay
            scores = table[charlm.trigram_cells(charlm.code_points(f" {around} "))] - table[charlm.trigram_cells(charlm.code_points(f" {text} "))]
            both = np.array([scores[max(0, a - 1) : b + 1].sum() for a, b, _ in edits])
            close = (both[1:] > 1.0) & (both[:-1] > 1.0) & np.array([edits[i + 1][0] - edits[i][1] < 40 for i in range(len(edits) - 1)], dtype=bool)
            gains = np.where(np.append(close, False) | np.append(False, close), np.maximum(gains, both), gains)  # a lone edit has sound surroundings
        kept = (gains > 1.0) & (common | (low < ODD)) & ~np.array(lowers)
        sure = kept.copy()  # damage comes in stretches: what lies between two sure runs is damaged too
        for i in range(len(edits)):
            before = i > 0 and sure[i - 1] and edits[i][0] - edits[i - 1][1] < 40
            after = i + 1 < len(edits) and sure[i + 1] and edits[i + 1][0] - edits[i][1] < 40
            kept[i] |= (before and after and gains[i] > -6) or ((before or after) and gains[i] > 1.0)
    return float(gains[kept].sum()), [e for e, k in zip(edits, kept, strict=True) if k]


def is_suspect(text: str | None, table: np.ndarray) -> bool:
    """Whether a text needs a closer look: a trace of UTF-8, or a rare trigram with a letter beyond ASCII."""
    if not text or text.isascii():
        return False
    if has_trace(text):
        return True
    codes = charlm.code_points(f" {text} ")
    rare = table[charlm.trigram_cells(codes)] < ODD
    wide = codes > 127
    return bool((rare & (wide[:-2] | wide[1:-1] | wide[2:])).any())


def applied(text: str, edits: list[tuple[int, int, str]], ends: list[int] | None = None) -> tuple[str, list[int] | None]:
    """The text with edits made; ``ends`` (for each character, where it ends in the stored text) follows."""
    parts, at, new_ends = [], 0, [] if ends is not None else None
    for a, b, new in edits:
        parts += (text[at:a], new)
        if new_ends is not None:
            new_ends += ends[at:a]
            n = len(new)
            new_ends += [ends[a + (b - a) * (i + 1) // n - 1] for i in range(n)]
        at = b
    parts.append(text[at:])
    if new_ends is not None:
        new_ends += ends[at:]
    return "".join(parts), new_ends


def restored(text: str, table: np.ndarray, prior: list[float] | None = None, ends: list[int] | None = None) -> tuple[str, list[str], list[int] | None]:
    """The restored text, the names of the swaps undone in turn, and where each character ends in the stored text.

    ``prior`` holds the learnt log shares of the swaps.
    """
    names: list[str] = []
    for _ in range(ROUNDS):
        best, best_edits, best_key = LEAST_GAIN, None, None
        for i in possible_swaps(text, table):
            gain, edits = swap_gain(text, swaps()[i], table)
            valued = gain + (prior[i] if prior else 0.0)
            if gain > LEAST_GAIN and (best_edits is None or valued > best):
                best, best_edits, best_key = valued, edits, i
        if not best_edits:
            break
        swap = swaps()[best_key]
        text, ends = applied(text, best_edits, ends)
        names.append(f"{swap.true}>{swap.wrong}")
    return text, names, ends


def possible_swaps(text: str, table: np.ndarray) -> list[int]:
    """The swaps worth trying: those of several characters whose trace is in the text, and of the letter swaps
    those that make an implausible trigram of the text plausible. All trigrams under all swaps are looked up at once."""
    out = [i for i, s in enumerate(swaps()) if not s.letters_swap and s.pattern.search(text)]
    padded = f" {text} "
    codes = charlm.code_points(padded)
    rare = table[charlm.trigram_cells(codes)] < ODD
    wide = codes > 127
    odd = "".join({padded[i : i + 3] for i in np.flatnonzero(rare & (wide[:-2] | wide[1:-1] | wide[2:]))})
    if odd:
        ids = [i for i, s in enumerate(swaps()) if s.letters_swap]
        joined = "".join(odd.translate(swaps()[i].translation) for i in ids)
        scores = table[charlm.trigram_cells(charlm.code_points(joined))[::3]].reshape(len(ids), -1)
        out += [i for i, ok in zip(ids, (scores >= ODD).any(axis=1), strict=True) if ok]
    return sorted(out)


class LetterGains:
    """What each letter swap could add to a text at most, however common its trigrams are: the gains of a trigram are reckoned once."""

    def __init__(self, table: np.ndarray, most: int = 1 << 17):
        self.table, self.most = table, most
        self.ids = [i for i, s in enumerate(swaps()) if s.letters_swap]
        self.symbols = re.compile("[" + "".join(sorted({re.escape(c) for i in self.ids for c in swaps()[i].table})) + "]")
        self.known: dict[str, np.ndarray] = {}

    def hopeful(self, text: str) -> list[int]:
        """The letter swaps by which the trigrams around their symbols could gain enough."""
        padded = f" {text} "
        grams = [padded[i : i + 3] for m in self.symbols.finditer(padded) for i in range(max(0, m.start() - 2), m.start() + 1) if i + 3 <= len(padded)]
        if not grams:
            return []
        if len(self.known) > self.most:
            self.known.clear()
        if new := sorted({g for g in grams if g not in self.known}):
            codes = charlm.code_points("".join("".join(new).translate(t) for t in ({}, *(swaps()[i].translation for i in self.ids))))
            scores = self.table[charlm.trigram_cells(codes)[::3]].reshape(len(self.ids) + 1, -1)
            self.known |= dict(zip(new, np.maximum(scores[1:] - scores[0], 0.0).T, strict=True))
        most = np.sum([self.known[g] for g in grams], axis=0)
        return [i for i, m in zip(self.ids, most, strict=True) if m > 1.0]

    def best(self, text: str) -> float:
        """The greatest gain by a letter swap, common trigrams too."""
        return max((swap_gain(text, swaps()[i], self.table, common=True)[0] for i in self.hopeful(text)), default=0.0)


def sound_table(rows: DataFrame, text_col: str, rounds: int = ROUNDS) -> np.ndarray:
    """Trigram scores that neither copies nor frequent damage raise.

    Each distinct text counts once, and texts that a letter swap makes more plausible are taken out of the counts; what is
    left judges them anew. Damage that fewer texts hold than their sound letters is so taken out, however frequent it is.
    """
    texts = settled(rows.select(F.col(text_col).alias("t")).where(F.col("t") != "").distinct())
    counts = charlm.corpus_counts(texts, "t")

    def gaining(df: DataFrame, table: np.ndarray, least: float) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gains = LetterGains(sent.value)
            for b in batches:
                yield b[np.array([not t.isascii() and LOST not in t and gains.best(t) > least for t in b["t"]], dtype=bool)]

        return df.mapInPandas(run, "t string")

    table = charlm.log_scores(counts)
    near = settled(gaining(texts, table, 0.0))
    for _ in range(rounds):
        table = charlm.log_scores(np.maximum(counts - charlm.corpus_counts(gaining(near, table, LEAST_GAIN), "t"), 0))  # trigrams across two texts may differ
    return table


def candidate_swaps(text: str, table: np.ndarray) -> list[tuple[int, float]]:
    """The swaps that could explain a text, with their gains."""
    found = [(i, swap_gain(text, swaps()[i], table)[0]) for i in possible_swaps(text, table)]
    return [(i, g) for i, g in found if g > LEAST_GAIN]


def posterior(found: list[tuple[int, float]], prior: list[float]) -> list[tuple[int, float]]:
    """The probability of each candidate swap."""
    values = [g + prior[i] for i, g in found]
    weights = [math.exp(v - max(values)) for v in values]
    return [(i, w / sum(weights)) for (i, _), w in zip(found, weights, strict=True)]


#: Letters that a symbol may stand for: the corpus's letters beyond ASCII, the most frequent ones of alphabets (no syllables or Han, which no one-byte page holds).
ALPHABET = 320
#: What a learnt key must gain: in all over its source, and per symbol replaced.
KEY_GAIN, SYMBOL_GAIN = 25.0, 2.0
#: Symbols in rare trigrams that a source must show.
LEAST_SEEN = 6
#: Contexts that are scored with one copy of the key.
TOGETHER = 500
#: Share of a source's letters beyond ASCII that a key must change.
MOST = 0.5
#: Prior weight of a symbol standing for itself, of the letters by frequency, and of what known pages make of it.
ITSELF, ANY_LETTER, KNOWN_PAGES = 0.2, 0.4, 0.4
NEAR = 2


def is_letter_of_alphabet(c: str) -> bool:
    return c > "\x7f" and c.isalpha() and c < "\u2000"


def alphabet_of(df: DataFrame, text_col: str, most: int = ALPHABET) -> dict[str, float]:
    """The most frequent letters beyond ASCII of all texts with their shares."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for b in batches:
            found.update(re.sub(r"[\x00-\x7f]+", "", "".join(t for t in b.iloc[:, 0] if t)))
        kept = [(c, n) for c, n in found.items() if is_letter_of_alphabet(c)]
        yield pd.DataFrame(kept, columns=["c", "n"]).astype({"n": "int64"})

    summed = df.select(F.col(text_col)).mapInPandas(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    rows = summed.orderBy(F.desc("n"), "c").limit(most).collect()
    total = sum(r["n"] for r in rows) or 1
    return {r["c"]: r["n"] / total for r in rows}


class Key:
    """The learning of one source's cipher: for each symbol, what it may stand for, before and after the evidence."""

    def __init__(self, alphabet: dict[str, float], shares: list[float], table: np.ndarray):
        self.letters = sorted(alphabet)
        self.index = {c: i for i, c in enumerate(self.letters)}
        self.by_frequency = np.array([alphabet[c] for c in self.letters])
        self.table = table
        self.pages: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, s in enumerate(swaps()):
            for c, x in s.table.items():
                if x in self.index:
                    self.pages[c].append((self.index[x], shares[i]))

    def prior(self, symbol: str) -> np.ndarray:
        """Probabilities of the alphabet's letters and, last, of the symbol itself."""
        p = np.append(ANY_LETTER * self.by_frequency, ITSELF)
        known = self.pages.get(symbol)
        if known:
            total = sum(w for _, w in known)
            for i, w in known:
                p[i] += KNOWN_PAGES * w / total
        if symbol in self.index:
            p[self.index[symbol]] = 0.0
        return p / p.sum()

    def expected(self, contexts: list[str], known: dict[str, dict[str, float]]) -> Iterator[tuple[int, str, float, float]]:
        """For the symbol in the middle of each context: (context, letter, probability, gain over the symbol as it stands) of the likeliest letters. Symbols
        beside it are read as the key ``known`` so far reads them. All letters of a few hundred contexts are scored at once."""
        width, many = 2 * NEAR + 1, len(self.letters)
        alphabet = np.array([ord(c) for c in self.letters], dtype=np.uint64)
        best = {c: max(of, key=of.get) for c, of in known.items() if of}
        for at in range(0, len(contexts), 256):
            part = contexts[at : at + 256]
            sides, priors = [], np.zeros((len(part), many + 1))
            for i, context in enumerate(part):
                symbol = context[NEAR]
                sides.append("".join(c if j == NEAR else best.get(c, c) for j, c in enumerate(context)))
                prior = self.prior(symbol)
                if symbol in known:
                    prior = 0.02 * prior
                    for x, p in known[symbol].items():
                        prior[many if x == symbol else self.index[x]] += 0.98 * p
                priors[i] = prior
            codes = np.repeat(charlm.code_points("".join(sides)).reshape(len(part), 1, width), many + 1, axis=1)
            codes[:, :many, NEAR] = alphabet
            cells = charlm.trigram_cells(codes.ravel())
            starts = (np.arange(len(part) * (many + 1)) * width).reshape(len(part), many + 1)
            # trigrams with another letter beyond ASCII that the key doesn't change say nothing: damage in many texts reads well where all of it stands
            before = charlm.code_points("".join(part)).reshape(len(part), width)
            wide = (before > 127) & (before == codes[:, many, :])
            wide[:, NEAR] = False
            told = [~wide[:, i : i + 3].any(axis=1, keepdims=True) for i in range(width - 2)]
            scores = sum(self.table[cells[starts + i]] * told[i] for i in range(width - 2)).astype(np.float64)
            logs = scores + np.log(priors + 1e-12)
            shares = np.exp(logs - logs.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            top = np.argsort(-shares, axis=1)[:, :4]
            for i, picks in enumerate(top):
                for x in picks:
                    yield at + i, self.letters[x] if x < many else part[i][NEAR], float(shares[i, x]), float(scores[i, x] - scores[i, many])


def high_letters(text: str, table: np.ndarray) -> tuple[str, list[int], int]:
    """A text with blanks at both ends, where its letters beyond ASCII stand (of alphabets, or symbols that a page gives), and how many of them are of a kind
    that stands in a rare trigram somewhere in the text."""
    padded = f"  {text}  "
    codes = charlm.code_points(padded)
    rare = table[charlm.trigram_cells(codes)] < ODD
    at = [int(i) for i in np.flatnonzero(codes > 127) if NEAR <= i < len(padded) - NEAR and padded[i] < "\u2600" and padded[i] not in "“”‘’„«»…–—\u00a0"]
    odd = {padded[i] for i in at if rare[i - 2 : i + 1].any()}
    return padded, at, sum(padded[i] in odd for i in at)


def learnt_keys(rows: DataFrame, alphabet: dict[str, float], shares: list[float], sent, rounds: int = 4) -> DataFrame:
    """(source, key): per source the letters that its symbols stand for, where the evidence is enough; by expectation-maximisation.

    ``rows`` holds ``_source`` and ``_text`` of suspect texts. Contexts are counted first, so equal ones are looked at once; expectations
    are summed per source, symbol and letter, so no group of a source's rows is ever gathered: a source's key holds a few letters for each symbol of a page.
    """

    def weigh(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for s, t in zip(b["_source"], b["_text"], strict=True):
                if not has_trace(t):  # else no letter for a letter
                    _, at, odd = high_letters(t, sent.value)
                    out[s][0] += odd
                    out[s][1] += len(at)
            yield pd.DataFrame([(s, *n) for s, n in out.items()], columns=["_source", "seen", "letters"]).astype({"seen": "int64", "letters": "int64"})

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: Counter[tuple[str, str]] = Counter()
            for s, t in zip(b["_source"], b["_text"], strict=True):
                if not has_trace(t):
                    padded, at, _ = high_letters(t, sent.value)
                    out.update((s, padded[i - NEAR : i + NEAR + 1]) for i in at)
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["source", "context", "n"]).astype({"n": "int64"})

    # a wrong page changes all letters beyond ASCII, not a few; where most read well, or too few are odd to gain enough, there is no key to learn
    weighed = rows.mapInPandas(weigh, "_source string, seen long, letters long").groupBy("_source").agg(F.sum("seen").alias("seen"), F.sum("letters").alias("whole"))
    enough = settled(weighed.where((F.col("seen") >= LEAST_SEEN) & (F.col("seen") >= MOST * F.col("whole"))))
    met = rows.join(enough.select("_source"), "_source", "left_semi").mapInPandas(cut, "source string, context string, n long").groupBy("source", "context").agg(F.sum("n").alias("n"))
    met = settled(met)
    parts = met.groupBy("source").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    enough = parts.join(enough.select(F.col("_source").alias("source"), "whole"), "source")
    # contexts in lists of about ``TOGETHER``, so that a source's key travels once with each list
    listed = met.join(enough, "source").withColumn("part", F.pmod(F.xxhash64("context"), F.col("parts")))
    met = settled(listed.groupBy("source", "part").agg(F.first("whole").alias("whole"), F.collect_list(F.struct("context", "n")).alias("contexts")))
    kind = "map<string,map<string,double>>"
    keys = None
    for _ in range(rounds):
        at = met.withColumn("key", F.lit(None).cast(kind)) if keys is None else met.join(keys.select("source", "key"), "source", "left")

        def expect(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            learner = Key(alphabet, shares, sent.value)
            for b in batches:
                for source, contexts, key in zip(b["source"], b["contexts"], b["key"], strict=True):
                    known = {c: dict(of) for c, of in dict(key).items()} if key is not None else {}
                    texts, counts = [c["context"] for c in contexts], [c["n"] for c in contexts]
                    out: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
                    for i, x, p, g in learner.expected(texts, known):
                        sums = out[texts[i][NEAR], x]
                        sums[0] += p * counts[i]
                        sums[1] += g * p * counts[i]
                    yield pd.DataFrame([(source, c, x, n, g) for (c, x), (n, g) in out.items()], columns=["source", "symbol", "letter", "n", "gain"])

        summed = at.mapInPandas(expect, "source string, symbol string, letter string, n double, gain double").groupBy("source", "symbol", "letter").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
        per = summed.groupBy("source", "symbol").agg(F.sum("n").alias("all"), F.collect_list(F.struct("letter", "n", "gain")).alias("of"))  # at most the alphabet's letters
        best = F.array_max(F.transform("of", lambda x: F.struct(x["n"], x["letter"], x["gain"])))
        shares_of = F.map_from_entries(F.transform(F.filter("of", lambda x: x["n"] >= 0.02 * F.col("all")), lambda x: F.struct(x["letter"], x["n"] / F.col("all"))))
        shared = per.select("source", "symbol", "all", shares_of.alias("p"), best.alias("best"))
        sure = (F.col("best.letter") != F.col("symbol")) & (F.col("best.n") >= 0.7 * F.col("all")) & (F.col("best.gain") >= SYMBOL_GAIN * F.col("best.n"))
        keys = settled(
            shared.groupBy("source").agg(
                F.map_from_entries(F.collect_list(F.struct("symbol", "p"))).alias("key"),
                F.map_from_entries(F.collect_list(F.when(sure, F.struct("symbol", F.col("best.letter"))))).alias("letters"),
                F.sum(F.when(sure, F.col("best.gain"))).alias("gain"),
                F.sum(F.when(sure, F.col("all"))).alias("changed"),
            )
        )
    keys = keys.join(met.select("source", "whole").distinct(), "source").where(F.col("changed") >= MOST * F.col("whole"))
    return keys.where((F.col("gain") >= KEY_GAIN) & (F.size("letters") >= 2)).select(F.col("source").alias("_source"), "letters")


def by_key(text: str, letters: dict[str, str], table: np.ndarray) -> str | None:
    """The text with a learnt key applied to each word that it doesn't make far less plausible (what damage left in many texts reads well), or None if all
    in all it makes the text no more plausible."""
    translation = str.maketrans(letters)
    parts = re.split(r"(\s+)", text)
    changed = 0.0
    for i, part in enumerate(parts):
        new = part.translate(translation)
        if new != part:
            left, right = (parts[i - 1][-1:] if i else " "), (parts[i + 1][:1] if i + 1 < len(parts) else " ")
            gain = charlm.score(f"{left}{new}{right}", table) - charlm.score(f"{left}{part}{right}", table)
            if gain > -4.0:
                parts[i] = new
                changed += gain
    return "".join(parts) if changed > LEAST_GAIN else None


def damaged_texts(df: DataFrame, keys: list[str], text_col: str = "text", source_col: str | None = None, em_rounds: int = 3) -> DataFrame:
    """Every damaged text of ``df`` with its restored form.

    Result: the key columns, ``swap`` (the pairs undone, in turn; ``learnt`` for a key of the source that is of no known pair), ``fixed`` (the whole restored text, null if
    characters are lost). Rows that repeat a key count once: the smallest stored text stands.
    ``source_col`` names the column whose values share a key; without it all rows are one source.
    The character statistics are sums over all distinct texts, those that a letter swap betters left out; the expectations are sums over all rows. What comes to the driver
    is one fixed-size table, a number for each known pair and a bounded alphabet.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    rows = df.select(*keys, F.col(text_col).alias("_text"), source.alias("_source")).where(F.col("_text").isNotNull())
    table = sound_table(rows, "_text")
    sent = df.sparkSession.sparkContext.broadcast(table)
    n = len(swaps())

    def suspects(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odd = [LOST not in t and is_suspect(t, sent.value) for t in batch["_text"]]
            found = [candidate_swaps(t, sent.value) if o else [] for o, t in zip(odd, batch["_text"], strict=True)]
            mask = [bool(f) or LOST in t or (o and high_letters(t, sent.value)[2] > 1) for o, f, t in zip(odd, found, batch["_text"], strict=True)]
            batch = batch.assign(_swaps=[[i for i, _ in f] for f in found], _gains=[[g for _, g in f] for f in found])
            yield batch[np.array(mask, dtype=bool)]

    by_row = [c for c in rows.columns if c not in keys]
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    looked = rows.mapInPandas(suspects, base + ", _swaps array<int>, _gains array<double>")
    looked = settled(looked.groupBy(*keys).agg(F.min(F.struct(*by_row, "_swaps", "_gains")).alias("r")).select(*keys, "r.*"))

    whole = [0.0] * n
    shares = [1.0 / n] * n
    for _ in range(em_rounds):

        def expect(batches, whole=list(whole)):
            for batch in batches:
                out: dict[int, float] = defaultdict(float)
                for ids, gains in zip(batch["_swaps"], batch["_gains"], strict=True):
                    if len(ids):
                        for i, w in posterior(list(zip(ids, gains, strict=True)), whole):
                            out[int(i)] += w
                yield pd.DataFrame(list(out.items()), columns=["swap", "n"])

        summed = looked.select("_swaps", "_gains").mapInPandas(expect, "swap int, n double").groupBy("swap").agg(F.sum("n").alias("n")).collect()
        total = np.full(n, 0.5)
        for r in summed:
            total[r["swap"]] += r["n"]
        shares = list(total / total.sum())
        whole = list(np.log(shares))

    def restore(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for t, ids, letters in zip(batch["_text"], batch["_swaps"], batch["letters"], strict=True):
                if LOST in t:
                    done.append((None, "lost"))
                    continue
                fixed, names = restored(t, sent.value, whole)[:2] if len(ids) else (t, [])
                name = ",".join(names)
                if letters is not None and (own := by_key(t, dict(letters), sent.value)) is not None and own != fixed:
                    if charlm.score(own, sent.value) > charlm.score(fixed, sent.value) + LEAST_GAIN:
                        fixed, name = own, "learnt"
                done.append((fixed, name))
            out = batch[keys].assign(swap=[name for _, name in done], fixed=[f for f, _ in done])
            yield out[out["swap"] != ""]

    out_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", swap string, fixed string"
    found = learnt_keys(looked.where(~F.col("_text").contains(LOST)).select("_source", "_text"), alphabet_of(rows, "_text"), shares, sent)
    return looked.join(found, "_source", "left").mapInPandas(restore, out_schema)


def md5_of(text: str | None) -> str:
    return hashlib.md5(text.encode()).hexdigest() if text is not None else ""
