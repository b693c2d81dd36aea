"""The language of each text and of each stretch of a mixed text, with a calibrated confidence.

The classifier averages embeddings of hashed character n-grams and words and puts a linear softmax
on the mean; both layers are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (``train_rows``), twice: first on each half, then on all units but those whose label the model of the other half
firmly denies, as labels may be wrong. On a held-out part a temperature is fitted and a
confidence below which a unit is rejected; a rejected unit takes its neighbour's language.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding, sentences

# ISO 639-1 codes with their three-letter forms.
CODES = dict(
    pair.split("=")
    for pair in """por=pt eng=en spa=es ita=it fra=fr fre=fr deu=de ger=de rus=ru zho=zh chi=zh jpn=ja hin=hi ara=ar ell=el gre=el tha=th glg=gl cat=ca eus=eu baq=eu
    ron=ro rum=ro nld=nl dut=nl swe=sv dan=da nor=no nob=nb nno=nn fin=fi isl=is ice=is pol=pl ces=cs cze=cs slk=sk slo=sk hun=hu ukr=uk bel=be bul=bg srp=sr hrv=hr bos=bs slv=sl
    mkd=mk mac=mk sqi=sq alb=sq lit=lt lav=lv est=et tur=tr aze=az kaz=kk uzb=uz fas=fa per=fa heb=he urd=ur ben=bn tam=ta tel=te mar=mr guj=gu kan=kn mal=ml pan=pa nep=ne sin=si
    kor=ko vie=vi ind=id msa=ms may=ms fil=tl tgl=tl mya=my bur=my khm=km lao=lo mon=mn kat=ka geo=ka hye=hy arm=hy swa=sw afr=af zul=zu xho=xh amh=am hau=ha yor=yo ibo=ig som=so
    lat=la gle=ga cym=cy wel=cy gla=gd bre=br oci=oc cos=co ltz=lb mlt=mt fao=fo epo=eo""".split()
)
KNOWN = frozenset(CODES.values())

BITS = 16
BUCKETS = 1 << BITS
WIDTH = 24
#: Steps of gradient descent at least.
LEAST_STEPS = 100
LETTER = re.compile(r"[^\W\d_]")
THREE = re.compile(r"(?:[^\W\d_][\W\d_]*){3}")
SIX = re.compile(r"(?:[^\W\d_][\W\d_]*){6}")
FOLD = re.compile(r"[\W\d_]+")
#: Keys, links and the like: no words of any language.
JUNK = re.compile(r"\S*[A-Za-z0-9_/=+-]{28,}\S*|\b(?:https?://|www\.)\S+")


def named_language(code: str | None) -> str | None:
    """The two-letter code that a label names in any usual notation; None if it names no language."""
    if not code:
        return None
    base = re.split(r"[-_.@ ]", code.strip().lower())[0]
    base = CODES.get(base, base)
    return base if base in KNOWN else None


def named_language_sql(column):
    """``named_language`` as a column expression."""
    base = F.element_at(F.split(F.lower(F.trim(column)), r"[-_.@ ]"), 1)
    long = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[base]
    return F.coalesce(long, F.when(base.isin(sorted(KNOWN)), base))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of character 1- to 4-grams and words of all texts, and where each text's begin."""
    cleaned = [" " + FOLD.sub(" ", JUNK.sub(" ", t).lower()).strip() + " " for t in texts]
    joined = "".join(cleaned)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(c) for c in cleaned])
    owner = np.repeat(np.arange(len(texts)), lengths)
    cells, owners = [], []
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, 5):
        m = len(codes) - n + 1
        if m <= 0:
            break
        mixed = mixed[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 : n - 1 + m] + np.uint64(n)
        h = mixed ^ (mixed >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        inside = owner[:m] == owner[n - 1 :]
        if n == 1:
            inside &= codes != 32
        cells.append((h >> np.uint64(64 - BITS)).astype(np.int64)[inside])
        owners.append(owner[:m][inside])
    gaps = np.flatnonzero(codes == 32)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * codes * np.uint64(0xD6E8FEB86659FD93) + (codes << np.uint64(7)), dtype=np.uint64)))
    same = owner[gaps[:-1]] == owner[gaps[1:]] if len(gaps) > 1 else np.zeros(0, bool)
    starts, stops = gaps[:-1][same], gaps[1:][same]
    h = (sums[stops] - sums[starts]) * np.uint64(0xA0761D6478BD642F)
    cells.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    owners.append(owner[starts])
    cell, own = np.concatenate(cells), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    cell, own = cell[order], own[order]
    return cell, np.searchsorted(own, np.arange(len(texts) + 1))


# Scripts by their letters; kana stands before Han, as Japanese mixes both.
SCRIPTS = [
    ("Kana", re.compile("[\u3041-\u30ff]")), ("Hani", re.compile("[\u3400-\u9fff]")), ("Cyrl", re.compile("[\u0400-\u052f]")), ("Grek", re.compile("[\u0370-\u03ff\u1f00-\u1fff]")),
    ("Arab", re.compile("[\u0600-\u06ff\u0750-\u077f]")), ("Deva", re.compile("[\u0900-\u097f]")), ("Thai", re.compile("[\u0e00-\u0e7f]")), ("Latn", re.compile("[A-Za-z\u00c0-\u024f]")),
    ("Hang", re.compile("[\uac00-\ud7af]")), ("Hebr", re.compile("[\u0590-\u05ff]")),
]


#: Any letter of a script other than Latin.
BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\uffdc]")


def script_of(text: str) -> str:
    """The script of most letters, Latin where there are none of another; any share of kana above a tenth makes Han Japanese."""
    if not BEYOND_LATIN.search(text):
        return "Latn"
    counts = {name: len(pattern.findall(text)) for name, pattern in SCRIPTS}
    if counts["Kana"] and counts["Kana"] >= 0.1 * counts["Hani"]:
        counts["Kana"] += counts["Hani"]
    return max(counts, key=counts.get) if any(counts.values()) else ""


@dataclass
class Classifier:
    languages: list[str]
    logits: np.ndarray  # embeddings times output weights, per bucket
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.5
    writes: dict[str, np.ndarray] | None = None  # per script, which languages were seen to be written in it

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of the languages, a row per text; texts without letters get equal ones."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        for start in range(0, len(texts), 4000):
            part = texts[start : start + 4000]
            cell, at = features(part)
            n = np.diff(at)
            if len(cell):
                some = np.flatnonzero(n)
                out[start + some] = np.add.reduceat(self.logits[cell], at[some], axis=0) / n[some, None] + self.bias
        out /= self.temperature
        if self.writes:
            for i, text in enumerate(texts):
                if (can := self.writes.get(script_of(text))) is not None:
                    out[i, ~can] = -1e4
        out = np.exp(out - out.max(axis=1, keepdims=True)) if len(out) else out
        return out / out.sum(axis=1, keepdims=True) if len(out) else out


def fitted(texts: list[str], labels: list[str], epochs: int = 4, seed: int = 3, rate: float = 4.0) -> Classifier:
    """Embeddings and softmax by stochastic gradient descent over minibatches."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    cell, at = features(texts)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    full = np.flatnonzero(np.diff(at))
    epochs = max(epochs, -(-LEAST_STEPS // (len(full) // 32 + 1)))  # few units are gone through more often
    steps, step = max(1, epochs * (len(full) // 32 + 1)), 0
    for _ in range(epochs):
        rng.shuffle(full)
        for start in range(0, len(full), 32):
            batch = full[start : start + 32]
            sizes = at[batch + 1] - at[batch]
            where = np.concatenate([np.arange(at[i], at[i + 1]) for i in batch])
            own = np.repeat(np.arange(len(batch)), sizes)
            mean = np.add.reduceat(embed[cell[where]], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0) / sizes[:, None]
            z = mean @ weight + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            now = rate * (1 - step / steps)
            grad = (p @ weight.T) / sizes[:, None]
            used = cell[where]
            order = np.argsort(used, kind="stable")
            used = used[order]
            first = np.flatnonzero(np.concatenate(([True], used[1:] != used[:-1])))
            embed[used[first]] -= now * np.add.reduceat(grad[own[order]], first, axis=0)
            weight -= now / 32 * (mean.T @ p)
            bias -= now / 32 * p.sum(axis=0)
            step += 1
    return Classifier(languages, embed @ weight, bias)


def scripts_seen(texts: list[str], labels: list[str], languages: list[str], least: float = 0.3) -> dict[str, np.ndarray]:
    """Per script the languages of whose units at least a share ``least`` is written in it."""
    table = pd.crosstab(pd.Series(labels), pd.Series([script_of(t) for t in texts])) if texts else pd.DataFrame()
    shares = table.div(table.sum(axis=1), axis=0)
    found = {}
    for script in shares.columns:
        can = np.array([bool(shares.loc[lang, script] >= least) for lang in languages])
        if script and can.any():
            found[script] = can
    return found


def trained(texts: list[str], labels: list[str]) -> Classifier:
    """The classifier after cleaning and calibration on a held-out tenth."""
    rng = np.random.default_rng(1)
    keep = np.ones(len(texts), dtype=bool)
    half = rng.random(len(texts)) < 0.5
    for mine in (half, ~half):  # a label is judged by a model that hasn't seen it
        rest, judged = np.flatnonzero(~mine), np.flatnonzero(mine)
        if not len(judged) or len({labels[i] for i in rest}) < 2:
            continue
        first = fitted([texts[i] for i in rest], [labels[i] for i in rest], epochs=3)
        p = first.scores([texts[i] for i in judged])
        place = {x: n for n, x in enumerate(first.languages)}
        for i, row in zip(judged, p, strict=True):
            given = place.get(labels[i])
            if given is not None and row.argmax() != given and row[given] < 0.2:
                keep[i] = False
    held = rng.random(len(texts)) < 0.1
    train = np.flatnonzero(keep & ~held)
    model = fitted([texts[i] for i in train], [labels[i] for i in train])
    model.writes = scripts_seen([texts[i] for i in train], [labels[i] for i in train], model.languages)
    check = np.flatnonzero(keep & held & np.isin(labels, model.languages))
    if len(check):
        want = np.array([model.languages.index(labels[i]) for i in check])
        plain = np.log(model.scores([texts[i] for i in check]) + 1e-30)

        def loss(t: float) -> float:
            z = plain / t
            z -= np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + z.max(axis=1, keepdims=True)
            return -float(z[np.arange(len(want)), want].mean())

        model.temperature = min(np.geomspace(0.2, 5, 40), key=loss)
        sure = model.scores([texts[i] for i in check])
        wrong = sure.max(axis=1)[sure.argmax(axis=1) != want]
        model.reject = float(min(0.8, max(0.4, np.quantile(wrong, 0.5)))) if len(wrong) else 0.4
    return model


def labelled_sample(df: DataFrame, text_col: str, lang_col: str, rows: int, least: int = 100) -> pd.DataFrame:
    """About ``rows`` labelled rows, and at least ``least`` of each language that has so many, drawn per language by a hash of the text, the same in every run.

    Copies of a text are drawn together and count once, so a text that fills a third of the table doesn't crowd out others. Only a count per language, of which
    there are as many as ISO 639-1 has codes, decides the shares.
    """
    good = df.select(F.col(text_col).alias("text"), named_language_sql(F.col(lang_col)).alias("lang")).where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 15))
    counts = {r["lang"]: r["n"] for r in good.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    whole = sum(counts.values())
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, max(rows / whole, least / n)) * (1 << 20)))])
    order = F.xxhash64("text")
    drawn = good.where(F.pmod(order, F.lit(1 << 20)) < shares[F.col("lang")]).distinct()
    per = Window.partitionBy("lang").orderBy(order, "text")  # of a draw that is bounded but for copies, which are gone
    most = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 2 * max(int(rows * n / whole), least))])
    return drawn.withColumn("r", F.row_number().over(per)).where(F.col("r") <= most[F.col("lang")]).select("text", "lang").orderBy("text", "lang").toPandas()


def fit_on(df: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = 6000) -> Classifier | None:
    """A classifier fitted on a sample of the table's labelled rows; None if there are too few."""
    sample = labelled_sample(df, text_col, lang_col, train_rows)
    weights = sentences.trained()
    texts, labels = [], []
    for t, lang in zip(sample["text"], sample["lang"], strict=True):
        at = 0
        for end in sentences.unit_ends(t, weights):
            if SIX.search(t, at, end):
                texts.append(t[at:end]), labels.append(lang)
            at = end
    counts = pd.Series(labels).value_counts() if labels else pd.Series(dtype=int)
    common = set(counts[counts >= 5].index)
    keep = [i for i, x in enumerate(labels) if x in common]
    if len(common) < 2:
        return None
    return trained([texts[i] for i in keep], [labels[i] for i in keep])


#: A unit with an end mark.
FINISHED = re.compile(r"[" + re.escape(sentences.END_MARKS) + r";][\"'”“’»)\]」』）\s]*$")


def segments_of(fixed: str, ends: list[int], scores: np.ndarray, model: Classifier) -> list[tuple[int, int, str, float]]:
    """Maximal runs of units in one language: first unit, last unit, language, mean confidence."""
    labels: list[tuple[str | None, float]] = []
    at = 0
    for i, end in enumerate(ends):
        best = int(scores[i].argmax())
        sure = float(scores[i, best])
        labels.append((model.languages[best], sure) if sure >= model.reject and THREE.search(fixed, at, end) else (None, sure))
        at = end
    if not any(lang for lang, _ in labels):  # all rejected: the text as a whole, by its units' joint probability
        worded = [i for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if THREE.search(fixed, a, b)]
        if not worded:
            return []
        joint = np.log(scores[worded] + 1e-9).mean(axis=0)
        best = int(joint.argmax())
        return [(0, len(ends) - 1, model.languages[best], float(np.exp(joint[best])))]
    known = [lang for lang, _ in labels]
    for i in range(1, len(known)):
        known[i] = known[i] or known[i - 1]
    for i in range(len(known) - 2, -1, -1):
        known[i] = known[i] or known[i + 1]
    runs: list[list] = []
    for i, lang in enumerate(known):
        sure = labels[i][1]
        if runs and runs[-1][2] == lang:
            runs[-1][1] = i
            runs[-1][3].append(sure)
        else:
            runs.append([i, i, lang, [sure]])
    return [(a, b, lang, float(np.mean(s))) for a, b, lang, s in runs]


def language_segments(df: DataFrame, keys: list[str], text_col: str = "text", lang_col: str = "lang", train_rows: int = 6000) -> DataFrame:
    """Per text: ``named`` (the language its label names, or null), ``finished`` (whether it has a finished
    sentence) and ``segments``, an array of (``seg_no``, ``seg_lang``, ``start_pos``, ``end_pos``, ``confidence``).

    Null texts and texts without words give an empty array, as do all texts of a table with too few labels
    to fit on. Texts garbled by a wrong encoding are judged by their restored form. Repeated keys count once.
    """
    spark = df.sparkSession
    rows = df.select(*keys, F.col(text_col).alias("_text"), named_language_sql(F.col(lang_col)).alias("named"))
    model = fit_on(df, text_col, lang_col, train_rows)
    sent_model = spark.sparkContext.broadcast(model)
    sent = sentences.corpus_table(rows, "_text")
    weights = sentences.trained()

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, table = sent_model.value, sent.value
        for batch in batches:
            work, units = [], []
            for t in batch["_text"]:
                if not t or model is None or not LETTER.search(t):
                    work.append(None)
                    continue
                fixed, where = t, None
                if encoding.LOST not in t and encoding.is_suspect(t, table):
                    new, names, ends = encoding.restored(t, table, ends=list(range(1, len(t) + 1)))
                    if names:
                        fixed, where = new, ends
                ends = sentences.unit_ends(fixed, weights)
                work.append((fixed, where, ends))
                at = 0
                for e in ends:
                    units.append(fixed[at:e])
                    at = e
            scores = model.scores(units) if units else None
            at, found, finished = 0, [], []
            for w in work:
                if w is None:
                    found.append([]), finished.append(False)
                    continue
                fixed, where, ends = w
                runs = segments_of(fixed, ends, scores[at : at + len(ends)], model)
                at += len(ends)
                starts = [0, *ends[:-1]]
                finished.append(any(FINISHED.search(fixed[a:b]) for a, b in zip(starts, ends, strict=True)) or bool(re.search("[฀-๿]", fixed)))
                to = (lambda p, where=where: where[p - 1] if where and p else p)
                found.append([{"seg_no": n, "seg_lang": lang, "start_pos": to(starts[a]), "end_pos": to(ends[b]), "confidence": sure} for n, (a, b, lang, sure) in enumerate(runs)])
            yield batch[[*keys, "named"]].assign(finished=finished, segments=found)

    kind = "array<struct<seg_no:int,seg_lang:string,start_pos:int,end_pos:int,confidence:double>>"
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", named string, finished boolean, segments {kind}"
    judged = rows.mapInPandas(judge, schema)
    return judged.groupBy(*keys).agg(F.min(F.struct("named", "finished", "segments")).alias("r")).select(*keys, "r.*")


def missing_or_wrong(judged: DataFrame, keys: list[str]) -> DataFrame:
    """The segments of texts whose label names no language or another one, or that have several."""
    first = F.col("segments")[0]["seg_lang"]
    case = F.col("finished") & (F.size("segments") > 0) & (F.col("named").isNull() | (F.size("segments") > 1) | (F.col("named") != first))
    return judged.where(case).select(*keys, F.inline("segments"))
