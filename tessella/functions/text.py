"""Text functions as column expressions. White space means ASCII white space and the no-break space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

SPACE = "[ \\t\\n\\r\\f\\u000B\\u00A0]"
# Letters with marks and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
FOLDED = "aaaaaaeeeeiiiiooooouuuucnyy"
PAIRED = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o")]
# How abstracts begin.
ABSTRACTS = ["resumo:", "abstract:", "sumário:", "summary:"]
# Patterns of the last-resort cascade, in their order; the first that matches the folded text names the category.
CASCADE = [
    ("NaturalistIntelligence", r"animais?|planta(s)?|flora|fauna|ser(es)? vivo(s)?|organism|especi|taxonom|biolog|ecossistem|bioma|habitat|naturez|ambient|ecolog|biodivers|conserv|preserv|sustent|poluic|recicl|naturalist(a|ic)(s)?|produt(o|os) natural(is)?|solo|rocha(s)?|mineral|minerai(s)?|concha(s)?|cogumelo(s)?|folha(s)?|rio(s)?|riach(o|os)?|oceano|mar|florest|mata|cerrad|pantanal|amazoni|geolog"),
    ("LogicalMathematicalIntelligence", r"calcul|equac|inequ|estat|probab|media|median|moda|desvio|amostr|frequenc|porcent|percent|propor|razao|frac|regra de tres|medid|unidade de medida|tabel|graf|compar|orden|seriac|sequenc|padrao|classific|categori|agrupar|criteri|conjunt|algoritm|proced|passo a passo|condic|se entao|if then"),
    ("LinguisticIntelligence", r"ler|leitur|escrev|redac|reescrit|relat|descrev|explic|justific|argument|apresent|seminar|dialog|entrevist|questionari|nome(a|ar|ando|ie|iem)|verbaliz(a|ar|ando)|pronunc(i|ia|iar|iando)|dizer|responder|indag|pergunt"),
    ("SpatialIntelligence", r"mapa|cartograf|planta baixa|croqui|diagram|fluxogram|organogram|esquem|ilustr|infograf|desenh|esboc|projec|geometr|poligon|coordenad|eixo|plano cartesian|escala|orientacao espacial|direita|esquerda|acima|abaixo|frente|atras|norte|sul|leste|oeste|simetri|perspect|profund|visualiz|representacao visual|imagem mental|rotacion|girar|virar|dobrar|espelhar|reflexa|puzzle|quebra[- ]cabec|labirint"),
    ("MusicalIntelligence", r"music|melod|ritm|harmon|cantar|cancao|cantig|instrument|percuss|batid|compass|andament|pulso|som\b|sons\b|auditiv|ouvir|escut|audi(c|)a(o|)|timbre|altura|intensidad|volume|grave|agud|padrao sonor|palmas|bater palmas|eco musical|imitar sons|paisagem sonor"),
    ("BodilyKinestheticIntelligence", r"coordenacao motora|motric|psicomotric|moviment|corpo|manipul|manuse|pegar|segur|apert|puxar|recort|colar|dobr|rasg|pintar|modelar|moldar|esculp|montar|desmont|encaix|empilh|constru|dramatiz|teatr|encen|mimic|gest|expressao corporal|dancar|pular|correr|equilibr|mao na massa|hands[- ]on|atividade pratica|experimento pratic|jogo fisic|brincadeir"),
    ("InterpersonalIntelligence", r"em grupo|trabalho em grupo|em dupla|duplas\b|colabor|cooper|ajuda mutua|negoci|consens|mediac|lider|debate|discussa(o|) em grupo|roda de conversa|atividade coletiva|interacao social|ouvir o colega|feedback|peer feedback|avaliar pares|peer assessment|papel no grupo|responsabilidade compartilh"),
    ("IntrapersonalIntelligence", r"reflexa(o|) pessoal|reflet|autoavali|autoconhec|autorregul|metacogn|diario|diario de bordo|portfolio|metas pessoais|objetivos pessoais|monitorar progresso|emoc(a|)o|sentiment|motivac|valores|tomada de decisao|escolha pessoal|autonom|mindful|atencao plena|conscienc|identidad"),
]


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def folded(c: Column) -> Column:
    """Stripped, lower case, Latin letters without their marks."""
    out = F.translate(F.lower(stripped(F.coalesce(c, F.lit("")))), ACCENTED, FOLDED)
    for a, b in PAIRED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cleaned(c: Column) -> Column:
    """Text for extraction: frequent labels removed, hyphenation joined, blank, page-number and separator lines dropped, white space single."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iu)(^|[^\p{{L}}\p{{N}}_])(?:preparação|preparacao|utilização|utilizacao){SPACE}*:{SPACE}*", "$1 ")
    t = F.regexp_replace(t, rf"([\p{{L}}\p{{N}}_])-{SPACE}+([\p{{L}}\p{{N}}_])", "$1$2")

    def keeps(line: Column) -> Column:
        return (stripped(line) != "") & ~line.rlike(rf"^{SPACE}*[0-9]{{1,4}}{SPACE}*$") & ~line.rlike(r"^[ \t\n\r\f\u000B \-_=*•·.,:;]{4,}$")

    kept = F.filter(F.split(t, "\\r?\\n"), keeps)
    return stripped(F.regexp_replace(F.array_join(kept, "\n"), f"{SPACE}+", " "))


def looks_like_title(c: Column) -> Column:
    """Not blank, at most 200 characters, no abstract's beginning, no end mark, at most two of comma, semicolon, colon."""
    t = stripped(F.coalesce(c, F.lit("")))
    starts = F.lit(False)
    for a in ABSTRACTS:
        starts = starts | F.lower(t).startswith(a)
    return (t != "") & (F.length(t) <= 200) & ~starts & ~t.rlike(r"[.!?]$") & (F.length(t) - F.length(F.translate(t, ",;:", "")) <= 2)


def is_abstract(c: Column) -> Column:
    """Whether a text begins as an abstract."""
    t = F.lower(stripped(F.coalesce(c, F.lit(""))))
    out = F.lit(False)
    for a in ABSTRACTS:
        out = out | t.startswith(a)
    return out


def sentences(c: Column) -> Column:
    """Parts between white space that follows an end mark."""
    marked = F.regexp_replace(c, f"([.!?]){SPACE}+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: stripped(s) != "")


def chunks(c: Column, max_chars: int, min_chars: int) -> Column:
    """A long text in chunks: whole if it fits; cut every ``max_chars`` if it has one sentence; else sentences are packed greedily
    and each chunk below ``min_chars`` takes its successor in (one step; the last stays).

    The first chunk's budget is one character less, as it counts a blank before its first sentence. Null and blank texts give no chunk.
    """
    t = stripped(F.coalesce(c, F.lit("")))
    parts = F.transform(sentences(t), stripped)
    hard = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / max_chars)).cast("int")), lambda i: stripped(F.substring(t, i * max_chars + 1, F.lit(max_chars)))), lambda s: s != "")
    state = "struct<out:array<string>,buf:string,len:int>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"), F.lit(0).alias("len")).cast(state)

    def step(a: Column, s: Column) -> Column:
        over = (a["buf"] != "") & (a["len"] + F.length(s) + F.lit(1) > max_chars)
        return F.struct(
            F.when(over, F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]).alias("out"),
            F.when(over | (a["buf"] == ""), s).otherwise(F.concat_ws(" ", a["buf"], s)).alias("buf"),
            F.when(over, F.length(s)).otherwise(a["len"] + F.length(s) + F.lit(1)).cast("int").alias("len"),
        ).cast(state)

    packed = F.aggregate(parts, start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))
    mstate = "struct<out:array<string>,small:string>"
    mstart = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("small")).cast(mstate)

    def merge(a: Column, s: Column) -> Column:
        joined = F.concat_ws(" ", a["small"], s)
        return (
            F.when(a["small"].isNotNull(), F.struct(F.concat(a["out"], F.array(joined)).alias("out"), F.lit(None).cast("string").alias("small")).cast(mstate))
            .when(F.length(s) < min_chars, F.struct(a["out"].alias("out"), s.alias("small")).cast(mstate))
            .otherwise(F.struct(F.concat(a["out"], F.array(s)).alias("out"), F.lit(None).cast("string").alias("small")).cast(mstate))
        )

    merged = F.aggregate(packed, mstart, merge, lambda a: F.when(a["small"].isNotNull(), F.concat(a["out"], F.array(a["small"]))).otherwise(a["out"]))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= max_chars, F.array(t)).when(F.size(parts) <= 1, hard).otherwise(merged)


def slug(c: Column) -> Column:
    """A file-like name: word characters, blanks, dots and hyphens kept, blanks to underscores, at most 120 characters."""
    return F.substring(F.replace(F.regexp_replace(stripped(c), r"[^\p{L}\p{N}_\-. ]+", ""), F.lit(" "), F.lit("_")), 1, 120)


def short_slug(c: Column) -> Column:
    """An identifier part: lower case, blanks to hyphens, other than a-z, 0-9 and hyphen dropped, at most 32 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), f"{SPACE}+", "-"), "[^a-z0-9-]", ""), 1, 32)


def preview(c: Column) -> Column:
    """One line of at most 160 characters."""
    t = stripped(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) > 160, F.concat(F.substring(t, 1, 157), F.lit("…"))).otherwise(t)


def base_of(uri: Column) -> Column:
    """The name space of a URI: up to its first '#', else the URI without a slash at its end; then '#'."""
    return F.when(F.instr(uri, "#") > 0, F.concat(F.substring_index(uri, "#", 1), F.lit("#"))).otherwise(F.concat(F.regexp_replace(uri, "/+$", ""), F.lit("#")))


def local_name(uri: Column) -> Column:
    """What follows the last '#', else the last '/'."""
    return F.when(F.instr(uri, "#") > 0, F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def document_slug(uri: Column) -> Column:
    """A document's short name: its URI without the prefix ``urn:doc:``, else what follows the last slash."""
    return F.when(uri.startswith("urn:doc:"), F.substring(uri, 9, 2**31 - 9)).otherwise(F.substring_index(uri, "/", -1))


def fragment_number(uri: Column) -> Column:
    """The number of a fragment's URI, or null."""
    return F.nullif(F.regexp_extract(uri, "frag-([0-9]+)", 1), F.lit("")).try_cast("int")


def tokens(c: Column) -> Column:
    """Words of the folded text that are longer than two letters and no stop words."""
    words = F.regexp_extract_all(folded(c), F.lit("[a-zA-ZÀ-ÖØ-öø-ÿ]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(sorted(set(dims.STOP_WORDS))))


def last_resort(c: Column) -> Column:
    """The category of strong signs in a text, or null."""
    t = folded(c)
    out = None
    for name, pattern in CASCADE:
        hit = t.rlike(rf"\b({pattern})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def is_triggered(folded_text: Column, terms: list[str]) -> Column:
    """Whether a folded text holds a term: terms of five characters or more anywhere, shorter ones as whole words."""
    long, short = [t for t in terms if len(t) >= 5], [t for t in terms if len(t) < 5]
    out = F.lit(False)
    if long:
        out = out | F.exists(F.array(*[F.lit(t) for t in long]), lambda t: F.contains(folded_text, t))
    if short:
        out = out | F.arrays_overlap(F.split(folded_text, r"[^\p{L}\p{N}_]+"), F.array(*[F.lit(t) for t in short]))
    return out


def without_tags(c: Column) -> Column:
    """The text of a page: scripts, styles and tags removed, common entities resolved, white space single."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return stripped(F.regexp_replace(t, f"{SPACE}+", " "))
