import math
import random
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessella.llm import encoding, language, sentences, splitting, truncation

W = sentences.trained()


def units(text):
    out, at = [], 0
    for e in sentences.unit_ends(text, W):
        out.append(text[at:e].strip())
        at = e
    return out


# Divided by hand, a bar for each boundary.
DIVIDED = [
    "O Sr. Silva e a Profa. Ana chegaram.|Depois, saíram às 7.30 h.|Fim!",
    "Conforme a fig. 3 do cap. 12, p. ex. aqui.|A Av. Lima, n.º 4, fica longe.",
    "O guia pergunta: “Quem começa? É você?” e todos riem.|“Agora é a nossa vez!”|(Ver também a ficha 2.)|12",
    "A peça (aprox. o dobro!) fica aqui.|Acabou... e voltou?|Sim...",
    "Am 7. Mai kommen Hr. Vogel und Dr. Ott.|Die 5. Klasse spielt, z. B. Holz sammeln.|„Jetzt sind wir dran!“",
    "« Qui commence ? C’est toi ? » dit-il.|Il part !|2. Le jeu continue.",
    "先生が「だれから？きみかな？」と聞く。|始めよう！|「さあ、行こう！」",
    "老师问：“谁先来？是你吗？”于是开始。|最后比较结果！",
    "डॉ. निहारी आते हैं।|क्या खेल है?|हाँ।",
    "Нужно взять нитки, т. е. ленты, и т. д.|Потом спеть!",
    "Ο κ. Λάμπρου δείχνει.|Μπορούν να παίξουν;|Ναι.",
    "ครูแจกไหมพรม|เด็กๆวาดภาพ|แต่งนิทาน",
    "Texto colado.Outra frase.|Baixar ficha_3.pdf em www.x.example agora.",
    "Um título\n\n|Uma frase\nquebrada aqui.|1. Primeiro passo.|2. Segundo passo.",
    "يسأل د. سامور: «من يبدأ؟ أنت؟» ثم يلعب.|لكل فريق 4 دقائق.",
    "Traz palitos, cola etc.|- massinha",
    "在学校花园画画|然后用 30 分钟唱歌",
    "ครูแจกไหมพรมใช้เวลา 30 นาที|เด็กๆวาดภาพ",
]


@pytest.mark.parametrize("marked", DIVIDED)
def test_divided_by_hand(marked):
    if "colado.Outra" in marked:
        marked = marked.replace("colado.Outra", "colado.|Outra")
    want = [p.strip() for p in marked.split("|")]
    text = ""
    for part in marked.split("|"):
        glue = "" if not text or text.endswith("\n") or part == "Outra frase." or (text[-1] in "。！？」" and part[0] > "⺀") else " "
        text += glue + part
    if "- massinha" in text:
        text = text.replace(" - massinha", "\n- massinha")
    assert units(text) == want


def test_tagger_on_unseen_texts():
    """The ends kept while building texts of another seed are found; nearly all of them are places at all."""
    wrong = total = missed = known = 0
    for t, ends in sentences.training_texts(600, seed=99):
        found = sentences.places(t)
        gold = sentences.known_tags(t, ends, found)
        wrong += sum(a != b for a, b in zip(gold, sentences.decoded(found, W), strict=True))
        total += len(gold)
        inner = {e for e in ends if e < len(t.rstrip())}
        missed += len(inner - {e for e, _, _ in found})
        known += len(inner)
    assert wrong / total < 0.03 and missed / known < 0.04


def test_stripped_texts_hold_both_decisions():
    """Texts without marks have places of both kinds in Thai, Han and kana."""
    tags = {}
    for i, (t, ends) in enumerate(sentences.training_texts(400, seed=5)):
        if i % 4 == 0:
            found = sentences.places(t)
            for (_, seen, _), tag in zip(found, sentences.known_tags(t, ends, found), strict=True):
                tags.setdefault((seen[0], "kana" if any("ぁ" <= c <= "ん" for c in t) else "other"), set()).add(tag)
    assert tags["thai", "other"] == tags["han", "other"] == tags["han", "kana"] == {0, 1}


def frame(spark, texts):
    return spark.createDataFrame([("d", i, t, "pt") for i, t in enumerate(texts)], "doc_id string, k int, text string, lang string")


def test_units_table(spark):
    df = frame(spark, ["Uma. Duas.", "", None, "  \n ", "Sem fim", "a" * 200000 + ". B.", "Uma. Duas."]).withColumn("ends", F.lit("clash"))
    got = sentences.sentence_units(df.drop("ends"), ["doc_id", "k"])
    assert rows(sentences.inner_ends(got, ["doc_id", "k"])) == [("d", 0, 4), ("d", 5, 200001), ("d", 6, 4)]
    twice = df.drop("ends").unionAll(df.drop("ends"))
    assert sentences.sentence_units(twice, ["doc_id", "k"]).count() == 7
    assert sentences.sentence_units(df.drop("ends").limit(0), ["doc_id", "k"]).count() == 0


def test_pieces_cover_and_overlap(spark):
    rng = random.Random(1)
    texts = ["palavra " * 60, "x" * 500, "Uma frase curta. " * 30, "a b\n\n" * 80, None, "", "curto", "日本語。" * 100, "😀" * 301]
    texts += ["".join(rng.choice(["ab ", "c. ", "\n\n", "d! ", "efg", "\n", "é"]) for _ in range(300)) for _ in range(10)]
    df = frame(spark, texts).withColumn("piece", F.lit(1))
    most, back = 100, 20
    got = splitting.split_texts(df, ["doc_id", "k"], [("s", most, back)])
    by = {}
    for r in got.orderBy("k", "piece_no").collect():
        by.setdefault(r["k"], []).append(r)
    assert set(by) == {i for i, t in enumerate(texts) if t and len(t) > most}
    for i, pieces in by.items():
        whole = pieces[0]["piece"]
        assert all(len(p["piece"]) <= most for p in pieces)
        for a, b in zip(pieces, pieces[1:]):
            assert b["start_pos"] == a["start_pos"] + len(a["piece"]) - back and a["piece"][-back:] == b["piece"][:back]
            whole += b["piece"][back:]
        assert whole == texts[i]
    with pytest.raises(ValueError):
        splitting.split_texts(df, ["doc_id", "k"], [("s", 10, 10)])


def test_finest_boundary(spark):
    texts = [("Um. " * 20 + "\n\n") * 3, "Frase média aqui. " * 10, "palavra " * 30, "x" * 150, "ok", "日本語。" * 40 + " palavra" * 20, " \n\n" + "y" * 100 + "  \n \n  " + "z" * 100 + " \n"]
    got = splitting.finest_boundaries(frame(spark, texts), ["doc_id", "k"], 100)
    assert rows(got, "k", "finest") == [(0, 1), (1, 2), (2, 3), (3, 4), (5, 4), (6, 1)]


def test_finest_boundary_as_measured(spark):
    """The extraction asks for characters exactly where a stretch is too long, by plain measuring."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab ", "c. ", "\n\n", "D! ", "efg", "\n", "é", "Hij.", " ", "日本。"]) for _ in range(rng.randint(20, 60))) for _ in range(300)]
    limit = 12
    def measured(t):
        ends = sentences.unit_ends(t, W)
        units = [t[a:b].strip() for a, b in zip([0, *ends], ends)]
        blocks = re.split(r"\n[ \t\r]*\n", t)
        fits = lambda parts: max((len(p.strip(" \t\r\n")) for p in parts), default=0) <= limit
        return 1 if fits(blocks) else 2 if fits(units) else 3 if fits(t.split()) else 4
    got = {r["k"]: r["finest"] for r in splitting.finest_boundaries(frame(spark, texts), ["doc_id", "k"], limit).collect()}
    want = {i: measured(t) for i, t in enumerate(texts) if len(t) > limit}
    assert got == want and set(want.values()) == {1, 2, 3, 4}


TRAIN = {
    "pt": ["Os meninos não fazem canções na praça.", "A professora distribui as folhas às crianças.", "Você já ouviu o som da rua?", "Eles vão contar até vinte e cinco."],
    "en": ["The children sing songs in the square.", "The teacher hands out the leaves to them.", "Have you heard the sound of the street?", "They will count up to twenty five."],
    "ru": ["Дети поют песни на площади.", "Учитель раздаёт листья детям.", "Вы слышали звук улицы?", "Они считают до двадцати пяти."],
}


def test_languages(spark):
    data = [("d", i * 100 + j, s * (1 + j % 2), lang) for i, (lang, ss) in enumerate(TRAIN.items()) for j, s in enumerate(ss * 6)]
    data += [("x", 0, "The teacher sings in the square. Os meninos não vão à praça.", "en"), ("x", 1, "Учитель поёт песни.", "pt-BR"), ("x", 2, "The children count up to five.", "und"), ("x", 3, "12 34", "xx"), ("x", 4, None, None), ("x", 5, "The children sing songs.", "eng")]
    df = spark.createDataFrame(data, "doc_id string, k int, text string, lang string").withColumn("segments", F.lit(0))
    judged = language.language_segments(df.drop("segments"), ["doc_id", "k"])
    got = rows(language.missing_or_wrong(judged, ["doc_id", "k"]).where("doc_id = 'x'"), "k", "seg_no", "seg_lang")
    assert got == [(0, 0, "en"), (0, 1, "pt"), (1, 0, "ru"), (2, 0, "en")]
    assert language.language_segments(df.limit(0).drop("segments"), ["doc_id", "k"]).count() == 0


def test_named_languages(spark):
    codes = {"pt-BR": "pt", "por": "pt", "PT": "pt", "pt_BR": "pt", "und": None, "": None, None: None, "??": None, "xx": None, "zho": "zh", " EN ": "en", "n/a": None}
    assert {c: language.named_language(c) for c in codes} == codes
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r["c"]: r["n"] for r in df.select("c", language.named_language_sql(F.col("c")).alias("n")).collect()} == codes


CLEAN = ["Não é possível ouvir a canção das crianças à sombra da árvore.", "O maestro respondeu “sim!”, e a peça começou às nove.", "ATENÇÃO: É PROIBIDO CORRER NO PÁTIO. São £20 ± 3, © coleção.", "Дети поют песни на площадке и снова считают шаги."]


def test_encoding_round_trip(spark):
    rng = random.Random(4)
    base = [(f"c{i}", 0, " ".join(rng.sample(CLEAN, 3))) for i in range(400)]
    damaged = []
    for i, (true, wrong) in enumerate([("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp1250")]):
        letters = encoding.page_letters(wrong)
        for j, t in enumerate(CLEAN[:2]):
            g = "".join(letters[b] for b in t.encode(true))
            damaged += [(f"w{i}", j, g, t), (f"p{i}", j, CLEAN[1 - j] + " " + g, CLEAN[1 - j] + " " + t)]
    lost = [("l", 0, "N�o � poss�vel.")]
    plain = [("a", 0, "Nao e possivel ouvir a cancao."), ("a", 1, None), ("a", 2, ""), ("a", 3, "ç" * 100)]
    df = spark.createDataFrame(base + [d[:3] for d in damaged] + lost + plain[:3], "doc_id string, k int, text string")
    got = {(r["doc_id"], r["k"]): r["fixed"] for r in encoding.damaged_texts(df.unionAll(df.limit(5)), ["doc_id", "k"]).collect()}
    assert got.pop(("l", 0)) is None
    assert got == {d[:2]: d[3] for d in damaged}
    assert encoding.damaged_texts(df.limit(0), ["doc_id", "k"]).count() == 0


@pytest.mark.parametrize("true,wrong", [("cp1252", "cp1250"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("koi8-r", "cp1251")])
@pytest.mark.parametrize("copies", [False, True])
def test_frequent_damage(spark, true, wrong, copies):
    """A third of the rows damaged alike, by distinct texts or by copies of one."""
    rng = random.Random(5)
    words = "as crianças não são à mão ação lições corações põem João irmãs manhã então está você três árvore música pátio lá".split()
    if true == "koi8-r":
        words = "дети поют песни на площадке снова считают шаги учитель раздаёт листья звук улицы сегодня вместе".split()
    letters = encoding.page_letters(wrong)
    sound = [" ".join(rng.choices(words, k=20)) + "." for _ in range(300)]
    garbled = {i: "".join(letters[b] for b in sound[0 if copies else i].encode(true)) for i in range(100)}
    df = frame(spark, [garbled.get(i, t) for i, t in enumerate(sound)])
    got = {r["k"]: r["fixed"] for r in encoding.damaged_texts(df, ["doc_id", "k"]).collect()}
    assert got == {i: sound[0 if copies else i] for i in garbled}


@pytest.mark.parametrize("seed", [1, 2])
def test_key_of_no_known_page(spark, seed):
    """A source whose letters beyond ASCII were swapped by a permutation that is no code page is restored by a learnt key; others stay as they are."""
    rng = random.Random(seed)
    words = "as crianças não são à mão ação lições corações põem João irmãs manhã então está você três árvore música pátio lá avó ninguém só açúcar".split()
    text = lambda n: " ".join(rng.choices(words + ["a", "professora", "canta", "na", "praça", "com", "os", "meninos", "de", "casa"], k=n)) + "."
    sound = {("s%d" % (i % 20), i): text(30) for i in range(600)}
    letters = sorted({c for t in sound.values() for c in t if c > "\x7f"})
    garbage = rng.sample("ðþýœßæøåłżśńőűřůěčžšđ", len(letters))
    cipher = str.maketrans(dict(zip(letters, garbage)))
    damaged = {(i, k): t for (i, k), t in sound.items() if i == "s3"}
    df = spark.createDataFrame([(i, k, t.translate(cipher) if (i, k) in damaged else t) for (i, k), t in sound.items()] + [("n", 0, None), ("n", 1, "")], "doc_id string, k int, text string")
    got = {(r["doc_id"], r["k"]): r["fixed"] for r in encoding.damaged_texts(df, ["doc_id", "k"], source_col="doc_id").collect()}
    assert len(got) >= 0.95 * len(damaged)  # texts with none but frequent trigrams aren't suspected
    assert got == {i: damaged[i] for i in got}


def test_endings():
    whole = ["Acabou.", "Acabou.\n\nAna Lima, 2011", "Acabou.\n\n* * *", "Acabou. 12", "Acabou.\n(Lima, p. 3)", "Acabou.\n- cola\n- papel", "“Vamos!”", "(Ver a ficha 3.)", "เด็กๆวาดภาพ", None, ""]
    cut = ["Acabou. Depois os meni", "Acabou. Depois [...]", "Acabou. Depois (continua)", "A guia pergunta: “Quem começa?", "Acabou. O Sr.", "Acabou. E então <b", "Acabou. E en&nbs", "最后比较结果！老师问", "Acabou. E depois\x00"]
    assert [truncation.ending(t, W)[0] for t in whole] == ["whole"] * len(whole)
    assert [truncation.ending(t, W)[0] for t in cut] == ["cut"] * len(cut)
    assert truncation.ending("Acabou. E segue...", W) == ("ellipsis", "e segue")
    assert truncation.ending("Termina em 2.5 kg.\n\n213", W)[0] == "open"


def test_truncation_table(spark):
    rng = random.Random(2)
    data, n = [], 0
    for i in range(600):
        t = " ".join(rng.choice(["Uma frase curta aqui.", "Os meninos cantam na praça todos os dias.", "A turma ouve."]) for _ in range(rng.randint(3, 12)))
        data.append((n, t, " A " if i % 2 else "a"))
        n += 1
    for i in range(60):
        t = ("Os meninos cantam na praça todos os dias e a turma ouve " * 9)[: 297 if i % 3 else 300]
        data.append((n, t[:297] + "..." if i % 3 else t, "a"))
        n += 1
    data += [(n + i, "Curta. " * (i + 1) + "E assim continua a nossa roda...", "b") for i in range(4)] + [(n + 4, None, None), (n + 5, "", "b")]
    df = spark.createDataFrame(data, "id long, text string, source string")
    flags = {r["id"]: r["cut"] for r in truncation.truncated_texts(df, "id").collect()}
    assert {i for i, c in flags.items() if c} == set(range(600, 660)) and len(flags) == len(data)
    rates = {r["source"]: (r["texts"], r["cut_texts"]) for r in truncation.truncation_rates(truncation.truncated_texts(df, "id")).collect()}
    assert rates == {"a": (660, 60), "b": (5, 0), "": (1, 0)}


@pytest.mark.parametrize("n,trials,share", [(0, 5, 0.3), (4, 4, 0.05), (3, 20, 0.1), (60, 100, 0.5), (900, 1000, 0.85), (5, 4, 0.5), (7000, 200000, 0.03)])
def test_binomial_tail(n, trials, share):
    logs = [math.lgamma(trials + 1) - math.lgamma(i + 1) - math.lgamma(trials - i + 1) + i * math.log(share) + (trials - i) * math.log(1 - share) for i in range(n, trials + 1)]
    assert truncation.binomial_tail(n, trials, share) == pytest.approx(math.fsum(map(math.exp, logs)), rel=1e-6, abs=1e-12)


@pytest.mark.parametrize("times", [1, 100])
def test_slopes_are_no_limits(spark, times):
    """A density that rises and falls has no limit at any size; one length with many more ends has."""
    smooth = {n: times * max(1, int(40 * math.exp(-(((n - 300) / 60) ** 2)))) for n in range(100, 700)}
    counted = spark.createDataFrame(list(smooth.items()), "length int, c int")
    rows_of = lambda c: c.select(F.lit("a").alias("source"), F.lit("chars").alias("measure"), "length", F.explode(F.sequence(F.lit(1), "c")).alias("i")).drop("i")
    assert truncation.significant_lengths(rows_of(counted)).count() == 0
    spiked = counted.withColumn("c", F.when(F.col("length").isin(310, 312), F.col("c") * 5).otherwise(F.col("c")))
    assert rows(truncation.significant_lengths(rows_of(spiked)), "length") == [(310,), (312,)]


def limited(seed=3, n=900):
    """Whole texts of all lengths, some with a habitual ellipsis, and texts cut at 300 characters, half of them with an ellipsis."""
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(["Uma frase curta aqui.", "Os meninos cantam na praça todos os dias.", "A turma ouve.", "Depois todos contam até vinte e cinco."]) for _ in range(k))
    data = [(i, some(rng.randint(2, 14)), "a") for i in range(n)]
    data += [(n + i, some(rng.randint(2, 14)) + " E assim continua a nossa roda...", "a") for i in range(40)]
    for i in range(80):
        t = some(30)
        while not t[:300].rstrip()[-1].isalpha() or t[295:300].find(".") >= 0:
            t = "Ora " + t
        data.append((n + 40 + i, t[:300] + "..." if i % 2 else t[:300], "a"))
    return data


@pytest.mark.parametrize("kind", ["copied", "lengthened"])
def test_truncation_does_not_depend_on_size(spark, kind):
    """Ten times the rows, copied or with a sentence of varied length put before those that were not cut, give the same flags."""
    data = limited()
    flags = lambda d: {r["id"]: r["cut"] for r in truncation.truncated_texts(spark.createDataFrame(d, "id long, text string, source string"), "id").collect()}
    once = flags(data)
    assert {i for i, c in once.items() if c} == set(range(940, 1020))
    rng = random.Random(8)
    more = list(data)
    for j in range(1, 10):
        for i, t, source in data:
            varied = "Uma " + "a" * rng.randint(1, 90) + ". " + t if i < 940 else "".join(rng.choices("BCDFG", k=3)) + t[3:]  # cut texts keep their length
            more.append((i + 10000 * j, t if kind == "copied" else varied, source))
    assert {i: c for i, c in flags(more).items()} == {i + 10000 * j: c for i, c in once.items() for j in range(10)}
