"""Sentence units in any language and script, by a linear-chain tagger with Viterbi decoding.

Every character is tagged *boundary* (a unit ends with it) or *inside*. Only places of a few kinds
can end a unit: a run of end marks with its closing quotes and brackets, a blank line, and in scripts that are also written without
marks or blanks between words (Thai, Han, kana) a blank. All other characters are inside by constraint, so decoding looks
at the places alone and its cost follows their number, not that of the characters.

Weights of observations and of tag pairs are trained by the averaged structured perceptron. Training texts are built sentence by
sentence, of random words of cased and caseless scripts with what makes boundaries ambiguous (abbreviations, initials, ordinals, numbers, file names,
quotations, brackets, ellipses, headings, steps, missing blanks), and where each sentence ends is kept while it is built: these offsets are the labels.
Texts of scripts without marks are stripped of all punctuation. Word lists are observations only. Training needs no table and gives the same weights everywhere.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charlm, encoding

# Abbreviations that are mostly followed by the rest of their sentence (observations; a choice of ours, as are the lists below).
LEADING_ABBREVIATIONS = frozenset(
    """sr sra srs sras srta prof profa profs dr dra drs dras d dª dom exmo av r pç lg al eng arq fr frei st sto sta ste mr mrs ms messrs rev hon gen col capt lt sgt
    jr fig figs cap chap vol vols no nos nº n núm nr pág págs pag pagg pg pp p ex j ed eds op cit vgl s.o z b bzw ca abb hr hrn fr frl bspw evtl ggf inkl max min
    m mm mme mlle mgr cf c.-à-d i.e e.g viz vs approx aprox al. art arts inc § sig sigg sigra dott dott.ssa ing avv es cfr ss tel
    г гг ул им см рис стр т тт гл др. напр св акад д-р κ κα κκ σ σελ π.χ βλ εικ κεφ αρ δρ डॉ श्री पं सं प्रो د أ م ص ج ف""".split()
)
# Those that are words as well and abbreviate only before a number.
BEFORE_NUMBERS = frozenset("no al art arts max min col gen ed eds op cap vol st inc tel hon ex jr m p".split())
# Abbreviations that may also close a sentence.
CLOSING_ABBREVIATIONS = frozenset("etc ecc usw uvm usf et al p.m a.m pm am h hs kg g km cm mm ml l min seg sec u.a z.t d д п пр др κ.λπ κλπ κ.ά ltda ltd inc co a.c d.c n.chr v.chr u.s e.u.a".split())
# Words before a numeral that make "5." an ordinal in German.
ORDINAL_CUES = frozenset("am vom zum im der die das den dem des beim bis ab seit ein eine".split())
# Marks.
END_MARKS = ".!?…。！？।॥؟"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "{": "}"}
BRACKETS = "([（【{"
#: Farthest distance, in characters, at which a closing mark belongs to an opening one.
REACH = 400

PLACE = re.compile(rf"\n[ \t\r 　]*\n\s*|(?<=[฀-๿])[ \t ]+(?=\S)|(?<=[぀-鿿])[ \t　 ]+(?=\S)|[{re.escape(END_MARKS)}]+|(?<=[Ͱ-Ͽἀ-῿]);|[{re.escape(''.join(PAIRS))}]|[{re.escape(''.join(sorted(set(''.join(PAIRS.values())))))}]|\"|�")
LOST_QUOTATION = re.compile(rf"�(?=\w)[^\n]{{0,150}}?[{re.escape(END_MARKS)}]�(?=[\s,.;:]|$)")
ENDED = re.compile(rf"[{re.escape(END_MARKS.replace('.', ''))}]|\.(?!\d)")
WORD_BEFORE = re.compile(r"[^\s“”„«»(\[（「『\"/]*$")
CUE_BEFORE = re.compile(r"(\w+)[  ]+\d+$")
NEXT_WORD = re.compile(r"[\w’'-]+")


def letter_kind(c: str) -> str:
    """Case of a letter, or the kind of another character."""
    if c.isalpha():
        if c.islower():
            return "l"
        if c.isupper() or c.istitle():
            return "U"
        return "k" if "぀" <= c <= "ゟ" else "c"
    if c.isdigit():
        return "d"
    if "ऀ" <= c <= "෿" or "฀" <= c <= "໿":
        return "c"
    return "p" if c in ",;:،、，；：)]%" else "s"


def next_kind(text: str, at: int) -> str:
    """The kind of what follows: E nothing, l lower case, U capital, c caseless letter, k kana, d digit, p punctuation that goes on, o… opened quote or bracket before it, s symbol."""
    n, start = len(text), at
    while at < n and text[at].isspace():
        at += 1
    if at >= n:
        return "E"
    if text[at] in "-–•*" and "\n" in text[start:at] and at + 1 < n and text[at + 1] in " \t":
        return "oU"  # a list's item
    if text[at] == "�" and at > start:
        return "U"  # a lost letter after a blank: a capital, where a sentence may begin
    opened = ""
    while at < n and (text[at] in "¿¡\"'‘“„«‹「『([（【{–—-•*_#" or text[at] == "�"):
        if text[at] != "-":
            opened = "o"
        at += 1
        while at < n and text[at] in "  ":
            at += 1
    if at >= n:
        return "oE"
    kind = letter_kind(text[at])
    if kind == "l":  # capital and small letters swapped, as wrong Cyrillic code pages leave them
        word = NEXT_WORD.match(text, at)[0]
        if len(word) > 3 and word[1:].isupper():
            kind = "U"
    return opened + kind


def places(text: str) -> list[tuple[int, tuple[str, ...], bool]]:
    """All places where a unit could end: the end offset, what is observed there, and whether only a
    number stands between it and the place before (then the tags of both are bound to each other)."""
    out: list[tuple[int, tuple[str, ...], bool]] = []
    stack: list[tuple[str, int, bool, int]] = []  # closing marks awaited, where opened, whether at a unit's start, the only place to close or -1
    skip_to, last = 0, 0
    n = len(text)
    marked: bool | None = None  # whether the text has end marks, looked for where it matters
    for m in PLACE.finditer(text):
        s, e = m.span()
        if s < skip_to:
            continue
        mark = text[s]
        if mark == "\n":
            stack.clear()
            visible = len(text[:s].rstrip())
            if out and out[-1][0] == visible:  # whatever follows, a blank line ends the unit
                out.pop()
                last = 0
            if visible > last:
                out.append((visible, ("para",), False))
                last = visible
            skip_to = e
            continue
        if mark in " \t 　":
            script = "thai" if "฀" <= text[s - 1] <= "๿" else "han"
            if script == "han":
                marked = ENDED.search(text) is not None if marked is None else marked
            if not stack and s > last and not (script == "han" and marked):  # where sentences carry marks, a blank between Han or kana is layout
                out.append((s, (script, f"{script}|{next_kind(text, e)}"), False))
                last = s
            continue
        if stack and mark in stack[-1][0] and stack[-1][3] in (-1, s):
            stack.pop()
            continue
        if mark in PAIRS or mark in '"�':
            wanted = PAIRS.get(mark, mark)
            if mark == "�":  # a lost letter, unless a quotation with an end mark follows whose closing mark is lost, too
                shut = LOST_QUOTATION.match(text, s) if s == 0 or text[s - 1].isspace() else None
                if shut:
                    stack.append((mark, s, not text[last:s].strip(), shut.end() - 1))
                continue
            far = text.find("\n\n", e, e + REACH)
            limit = far if far >= 0 else min(n, e + REACH)
            if any(text.find(c, e, limit) >= 0 for c in wanted):
                stack.append((wanted, s, not text[last:s].strip(), -1))
            continue
        if mark not in END_MARKS and mark != ";":
            continue
        # a run of end marks; closing marks after it belong to it
        closed, opened_first = "", False
        while e < n and stack:
            at = e
            while at < n and text[at] in "  " and at + 1 < n and text[at + 1] in "»›":
                at += 1
            if at < n and text[at] in stack[-1][0] and stack[-1][3] in (-1, at):
                _, where, opened_first, _ = stack.pop()
                closed = "b" if text[where] in BRACKETS else "q"
                e = at + 1
            else:
                break
        while e < n and not stack and text[e] in "”’»」』":
            e += 1
            closed = closed or "x"
        skip_to = e
        run = m[0]
        if run == "." or mark == ";":
            term = run
        elif set(run) <= {"."} or "…" in run:
            term = "..."
        elif run[0] in "。！？।॥":
            term = "full"
        else:
            term = "!"
        gap = "0" if e < n and not text[e].isspace() else "1"
        nxt = next_kind(text, e)
        before = ""
        number_only = False
        if term == "." and not closed:
            word = WORD_BEFORE.search(text, max(0, s - 40), s)[0]
            low = word.lower().lstrip("¿¡-–'‘’")
            if "." in low and low not in LEADING_ABBREVIATIONS and low not in CLOSING_ABBREVIATIONS and not re.search(r"[\d_/]", low):
                head, _, tail = low.rpartition(".")  # a blank is missing before an abbreviation
                if len(head) > 2 and (tail in LEADING_ABBREVIATIONS or tail in CLOSING_ABBREVIATIONS):
                    low, word = tail, word[-len(tail) :]
            number_only = word.isdigit() and not text[last : s - len(word)].strip()
            if word.isdigit():
                cue = CUE_BEFORE.search(text, max(0, s - 20), s)
                before = "ordinal" if cue and cue[1].lower() in ORDINAL_CUES and len(word) <= 2 else "num"
            elif low in CLOSING_ABBREVIATIONS and not (low in ("d", "д", "п", "l", "g") and not re.search(r"[тtv]\.\s*$", text[max(0, s - 8) : s - len(word)])):
                before = "may"
            elif low in BEFORE_NUMBERS and low not in ("p", "m", "st", "ex") and nxt != "d":
                before = "word"
            elif low in LEADING_ABBREVIATIONS or low.rpartition("’")[2] in LEADING_ABBREVIATIONS:
                before = "lead"
            elif "." in low:
                before = "inner"
            elif len(low) == 1 and low.isalpha():
                before = "initial" if word.isupper() else "letter"
            elif not word:
                before = "none"
            else:
                before = "wordU" if word[-1:].isupper() else "word"
        depth = "in" if stack else "out"
        shut = closed + ("1" if opened_first else "0") if closed in ("q", "b") else closed
        seen = (f"{term}|{gap}|{nxt}|{depth}", f"{term}|{before}|{gap}|{nxt}", f"shut={shut}|{nxt}|{depth}", f"before={before}|{nxt}", f"depth={depth}", f"next={nxt}|{gap}", f"term={term}", f"{term}|{before}|{gap}|{nxt}|{shut}|{depth}")
        if e > last:
            out.append((e, seen, number_only))
            last = e if gap == "1" or nxt != "l" else last
    return out


CASED = ["abcdeiorstu", "áéíoçãnrs", "абвгдеио", "αβγδεηικ"]
CASELESS = ["ابتثجحد", "अबकगचतन"]
JOINED = ["的一是在人有", "のはをにがた"]
THAI = "กขคงจชนม"


class Builder:
    """Texts of random words whose sentences' ends are known because they are put together one by one."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.lead, self.may, self.numbered = (sorted(x) for x in (LEADING_ABBREVIATIONS - BEFORE_NUMBERS, CLOSING_ABBREVIATIONS, (BEFORE_NUMBERS & LEADING_ABBREVIATIONS) - CLOSING_ABBREVIATIONS))

    def word(self, a: str, capital: bool = False) -> str:
        w = "".join(self.rng.choice(a) for _ in range(self.rng.randint(2, 7)))
        return w.capitalize() if capital else w

    def words(self, a: str, least: int, most: int) -> list[str]:
        return [self.word(a) for _ in range(self.rng.randint(least, most))]

    def quotes(self) -> tuple[str, str]:
        return self.rng.choice([("“", "”"), ("«", "»"), ("„", "“"), ("« ", " »")])

    def aside(self, a: str) -> list[str]:
        """Something with marks in it that does not end its sentence; words follow it."""
        rng, cased = self.rng, a in CASED
        mark, (left, right) = rng.choice("!?"), self.quotes()
        name = self.word(a, cased)
        kinds = [
            lambda: [rng.choice([str.lower, str.capitalize])(rng.choice(self.lead)) + ".", rng.choice([name, name, self.word(a)])],
            lambda: [rng.choice(self.numbered) + ".", str(rng.randint(1, 99))],
            lambda: [rng.choice(self.may) + rng.choice([".", ".,"]), self.word(a)],
            lambda: [rng.choice("ABJKR") + ".", *([rng.choice("CPS") + "."] if rng.random() < 0.4 else []), self.word(CASED[0], True)],
            lambda: [rng.choice("zu") + ".", rng.choice(["B.", "a."]), self.word(CASED[0], rng.random() < 0.5)],
            lambda: ["p.", "ex.", self.word(a)],
            lambda: [rng.choice(sorted(ORDINAL_CUES)), f"{rng.randint(1, 31)}.", self.word(CASED[0], rng.random() < 0.8)],
            lambda: [f"{rng.randint(1, 99)}.{rng.randint(0, 999)}", self.word(a)],
            lambda: [f"fi_{rng.randint(1, 9)}.pdf", self.word(a), "www.abc.example"],
            lambda: [rng.choice(["i.e.", "e.g.", "a.c.", "s.o."]), self.word(a)],
            lambda: [self.word(a) + rng.choice(["...", "…"]), self.word(a)],
            lambda: [f"{left}{name} {self.word(a)}{mark} {self.word(a, cased)}{rng.choice('!?.')}{right}", self.word(a)],
            lambda: [f"{left}{self.word(a)}{mark}{right},", f"{left}{self.word(a)}{mark}{right}", self.word(a)],
            lambda: [f"{left}{' '.join(self.words(a, 1, 3))}{right}", self.word(a, rng.random() < 0.2)],
            lambda: [f"({rng.choice(self.lead)}. {self.word(a)}{rng.choice('!?.')})", self.word(a, cased and rng.random() < 0.2)],
            lambda: [f"({name}{mark} {self.word(a)}{mark})", self.word(a, cased and rng.random() < 0.2)],
            lambda: [f"�{self.word(a)}{mark}�, �{self.word(a)}{mark}�", self.word(a)],
            lambda: [self.word(a) + mark + ",", self.word(a)],
        ]
        if not cased:  # in scripts without case nothing tells these from a sentence's end, as which they are far more frequent
            for one in (2, 10):
                kinds[one] = kinds[0]
        return rng.choice(kinds)()

    def close(self, a: str) -> str:
        """How a sentence ends: what comes after its last word."""
        rng = self.rng
        if a in JOINED:
            return rng.choice("。。！？")
        if a == CASELESS[0]:
            return rng.choice([".", ".", "؟", "!", "..."])
        if a == CASELESS[1]:
            return rng.choice(["।", "।", "?", "!", "..."])
        if a == CASED[3] and rng.random() < 0.2:
            return ";"
        return rng.choice([".", ".", ".", "!", "?", "...", "…", "?!"])

    def sentence(self, a: str) -> str:
        """One sentence, without the blank that follows it."""
        rng, cased = self.rng, a in CASED
        if a in JOINED:
            body = "".join(self.words(a, 2, 5))
            if rng.random() < 0.3:
                left, right = rng.choice(["「」", "“”", "（）"])
                inner = f"{left}{self.word(a)}{rng.choice('？！')}{self.word(a)}{rng.choice('？！')}{right}"
                body += inner + ("と" if a == JOINED[1] else "") + "".join(self.words(a, 1, 3))
            if rng.random() < 0.2:
                body += f"{rng.randint(1, 30)}.{rng.randint(0, 9)}{self.word(a)}"
            if rng.random() < 0.1:
                body = f"{self.word(a)}：" + body
            done = body + self.close(a)
            return f"「{done}」" if rng.random() < 0.12 and a == JOINED[1] else f"“{done}”" if rng.random() < 0.12 else done
        body = self.words(a, 2, 6)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randint(1, len(body))
            body[at:at] = self.aside(a)
        body[0] = str(rng.randint(2, 99)) if rng.random() < 0.05 else body[0].capitalize()
        if rng.random() < 0.05:
            body.insert(0, self.word(a, cased) + ":")
        left, right = self.quotes()
        end = self.close(a)
        form = rng.random()
        if form < 0.08:
            done = f"{left}{' '.join(body)}{end}{right}"
        elif form < 0.13:
            done = f"({' '.join(body)}{end})"
        elif form < 0.18 and cased:  # a quotation ends the sentence
            done = f"{' '.join(body)}: {left}{self.word(a, True)} {self.word(a)}{end}{right}"
        elif form < 0.24:
            done = f"{' '.join(body)} {rng.choice(self.may)}."
        elif form < 0.29:
            done = f"{' '.join(body)} {rng.randint(3, 2100)}."
        elif form < 0.31 and cased:
            done = f"¿{' '.join(body)}?"
        else:
            done = " ".join(body) + end
        if rng.random() < 0.12 and not set(done) & set("_“„«("):
            done = done.upper()
        return done.replace(" ", "\n", 1) if rng.random() < 0.05 and "« " not in done else done

    def text(self) -> tuple[str, set[int]]:
        """A text and the offsets at which its sentences end."""
        rng = self.rng
        out, ends = "", set()
        script = rng.choice(CASED * 2 + CASELESS + JOINED)
        for _ in range(rng.randint(1, 7)):
            if rng.random() < 0.15:
                script = rng.choice(CASED * 2 + CASELESS + JOINED)
            if rng.random() < 0.08 and (not out or out[-1].isspace()):
                out += f"{rng.randint(1, 12)}. "  # a step's number belongs to the sentence after it
            elif rng.random() < 0.04 and (not out or out.endswith("\n")):
                out += rng.choice("-–•") + " "
            if rng.random() < 0.06:  # a heading
                out += self.word(script, True) + " " + self.word(script)
                ends.add(len(out))
                out += "\n\n"
            out += self.sentence(script)
            ends.add(len(out))
            glued = script in JOINED and rng.random() < 0.8
            out += "" if glued else rng.choice([" "] * 9 + ["", "  ", "\n", "\n\n"])
            if rng.random() < 0.04 and out[-1:].isspace():
                out += rng.choice(["", "", "± ", "£ "]) + str(rng.randint(1, 99))  # a number of its own, no sentence
                if rng.random() < 0.5:
                    ends.add(len(out))
                    out += "\n\n"
                else:
                    break
        return out, ends

    def stripped(self) -> tuple[str, set[int]]:
        """A text without punctuation: blanks divide its sentences, and may stand about numbers and foreign words inside them."""
        rng, out, ends = self.rng, "", set()
        a = rng.choice([THAI, *JOINED])
        for _ in range(rng.randint(2, 6)):
            body = "".join(self.words(a, 2, 5))
            if rng.random() < 0.4:
                body += rng.choice([f" {rng.randint(1, 50)} ", f" {rng.randint(1, 50)}", f"{rng.randint(1, 50)}.{rng.randint(0, 9)}", f" {self.word(CASED[0])} "]) + self.word(a)
            out += body
            ends.add(len(out))
            out += rng.choice([" ", " ", " ", "  ", "\n\n"])
            if a == THAI and rng.random() < 0.25:  # a sentence in another script between them
                other = rng.choice([CASED[0], CASED[2], *JOINED])
                out += self.word(other, True) + ("" if other in JOINED else " ") + self.word(other)
                ends.add(len(out))
                out += " "
        return re.sub(r"[^\w\s.]", "", out), ends


def training_texts(n: int = 9000, seed: int = 11) -> Iterator[tuple[str, set[int]]]:
    """Built texts with the ends of their sentences; every fourth is of a script without marks."""
    build = Builder(random.Random(seed))
    for i in range(n):
        yield build.stripped() if i % 4 == 0 else build.text()


def known_tags(text: str, ends: set[int], found: list[tuple[int, tuple[str, ...], bool]]) -> list[int]:
    """The tag of each place by the ends known from building the text."""
    return [int(end in ends) for end, _, _ in found]


def decoded(found: list[tuple[int, tuple[str, ...], bool]], weights: dict[str, float]) -> list[int]:
    """The best tags by Viterbi's algorithm over two tags, with a weight for each pair of tags."""
    get = weights.get
    scores, back = (0.0, -1e9), []  # as after a boundary (0), after an inside place (1)
    for _, seen, bound in found:
        own = 0.0
        for f in seen:
            own += get(f, 0.0)
        pair = "num" if bound else "any"
        stop = (scores[0] + get(pair + "11", 0.0), scores[1] + get(pair + "01", 0.0))
        go = (scores[0] + get(pair + "10", 0.0), scores[1] + get(pair + "00", 0.0))
        back.append((0 if stop[0] >= stop[1] else 1, 0 if go[0] >= go[1] else 1))
        scores = (max(stop) + own, max(go))
    tags, state = [], 0 if scores[0] >= scores[1] else 1
    for b in reversed(back):
        tags.append(1 - state)
        state = b[state]
    return tags[::-1]


@lru_cache(maxsize=1)
def trained(epochs: int = 6) -> dict[str, float]:
    """Weights of the tagger: the averaged structured perceptron over the built texts."""
    data = [(f, known_tags(t, ends, f)) for t, ends in training_texts() if (f := places(t))]
    weights: dict[str, float] = defaultdict(float)
    sums: dict[str, float] = defaultdict(float)
    step = 1

    def count(found, tags) -> dict[str, int]:
        c: dict[str, int] = defaultdict(int)
        before = 1
        for (_, seen, bound), tag in zip(found, tags, strict=True):
            c[("num" if bound else "any") + f"{before}{tag}"] += 1
            if tag:
                for f in seen:
                    c[f] += 1
            before = tag
        return c

    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(data)
        for found, gold in data:
            guess = decoded(found, weights)
            if guess != gold:
                right, wrong = count(found, gold), count(found, guess)
                for f in right.keys() | wrong.keys():
                    if d := right.get(f, 0) - wrong.get(f, 0):
                        weights[f] += d
                        sums[f] += d * step
            step += 1
    return {f: w - sums[f] / step for f, w in weights.items()}


def unit_ends(text: str | None, weights: dict[str, float]) -> list[int]:
    """The end offset of every unit of a text; what is left after the last mark is a unit of its own.
    Null and blank texts have none."""
    if not text or not text.strip():
        return []
    found = places(text)
    ends = [end for (end, _, _), tag in zip(found, decoded(found, weights), strict=True) if tag]
    last = len(text.rstrip())
    if not ends or ends[-1] < last:
        ends.append(last)
    return ends


def unit_ends_as_stored(text: str | None, weights: dict[str, float], table: np.ndarray | None) -> list[int]:
    """Unit ends of a text that may be garbled by a wrong encoding: found in the restored text, given in the stored one."""
    if table is not None and text and encoding.LOST not in text and encoding.is_suspect(text, table):
        fixed, names, where = encoding.restored(text, table, ends=list(range(1, len(text) + 1)))
        if names:
            return sorted({where[e - 1] for e in unit_ends(fixed, weights)})
    return unit_ends(text, weights)


def corpus_table(df: DataFrame, text_col: str = "text"):
    """A broadcast of the corpus's trigram scores, a table of fixed size, by which garbled texts are recognised."""
    counts = charlm.corpus_counts(df.where(F.col(text_col).isNotNull()), text_col)
    return df.sparkSession.sparkContext.broadcast(charlm.log_scores(counts))


def with_unit_ends(df: DataFrame, text_col: str = "text", sent=None) -> DataFrame:
    """``df`` with a column ``ends`` (in place of one of that name): the offset after the last visible character of each unit of its text."""
    weights = trained()

    def tag(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value if sent is not None else None
        for batch in batches:
            yield batch.assign(ends=[unit_ends_as_stored(t, weights, table) for t in batch[text_col]])

    df = df.drop("ends")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", ends array<int>"
    return df.mapInPandas(tag, schema)


def sentence_units(df: DataFrame, keys: list[str], text_col: str = "text", garbled: bool = True) -> DataFrame:
    """The units of every text: the key columns and ``ends``, the offset after each unit's last visible character.

    Null and blank texts give an empty array. Rows that repeat a key count once (of differing texts the
    smallest result stands). ``garbled`` looks through wrong encodings, for which the corpus is read once more.
    The texts themselves are not shuffled: only their offsets are grouped by key.
    """
    rows = df.select(*keys, F.col(text_col).alias("_text"))
    tagged = with_unit_ends(rows, "_text", corpus_table(rows, "_text") if garbled else None)
    return tagged.groupBy(*keys).agg(F.min("ends").alias("ends"))


def inner_ends(units: DataFrame, keys: list[str]) -> DataFrame:
    """One row per unit end except each text's last."""
    return units.where(F.size("ends") > 1).select(*keys, F.explode(F.slice("ends", 1, F.size("ends") - 1)).alias("end_pos"))
