"""The core's queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import numbers as N
from ..functions import text as T
from ..operators import activation, batch, evidence, export, ingest, profile, questions, ranking, shapes, triples
from ..shared import settled, table
from ..sources import files, sinks
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL pieces ------------------------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


SP = r"[ \t\n\r\f\v\x{00A0}]"


def s_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def s_fold(c: str) -> str:
    out = f"translate(lower({s_strip(f'coalesce({c}, chr(0)[:0])')}), '{T.ACCENTED}', '{T.FOLDED}')".replace("chr(0)[:0]", "''")
    for a, b in T.PAIRED:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def s_clean(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '(^|[^\\p{{L}}\\p{{N}}_])(?:preparação|preparacao|utilização|utilizacao){SP}*:{SP}*', '\\1 ', 'gi')"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])-{SP}+([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    keep = f"{s_strip('x')} <> '' AND NOT regexp_matches(x, '^{SP}*[0-9]{{1,4}}{SP}*$') AND NOT regexp_matches(x, '^[ \\t\\n\\r\\f\\v\\-_=*•·.,:;]{{4,}}$')"
    t = f"array_to_string(list_filter(string_split_regex({t}, '\\r?\\n'), lambda x: {keep}), chr(10))"
    return s_strip(f"regexp_replace({t}, '{SP}+', ' ', 'g')")


def s_half_up(x: str, places: int = 4) -> str:
    return f"CAST(floor(({x}) * {10**places} + 0.5 + 1e-9) / {10**places} AS DECIMAL(18,{places}))"


def s_percent(x: str) -> str:
    r = f"(({x}) * 10000)"
    low = f"floor({r} + 1e-9)"
    n = f"CAST(CASE WHEN abs({r} - {low} - 0.5) < 1e-7 THEN CASE WHEN CAST({low} AS BIGINT) % 2 = 0 THEN {low} ELSE {low} + 1 END ELSE floor({r} + 0.5) END AS BIGINT)"
    return f"(CAST({n} // 100 AS VARCHAR) || '.' || lpad(CAST({n} % 100 AS VARCHAR), 2, '0'))"


def s_clip(x: str) -> str:
    return f"(CASE WHEN isnan(coalesce({x}, 0.0)) THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce({x}, 0.0))) END)"


FRAGMENTS = """fragments AS (
  SELECT doc_id, k, coalesce(frag_uri, base || 'frag-' || printf('%03d', k)) AS frag_uri, coalesce(text, '') AS text,
         coalesce(nullif(trim(lang), ''), 'und') AS lang, coalesce(is_title_or_abstract, false) AS is_title
  FROM (SELECT *, CASE WHEN contains(doc_id, '#') THEN split_part(doc_id, '#', 1) || '#' ELSE regexp_replace(doc_id, '/+$', '') || '#' END AS base,
               row_number() OVER (PARTITION BY doc_id, k ORDER BY run_no DESC NULLS LAST, ingested_at DESC NULLS LAST) AS rn
        FROM s1_output WHERE doc_id IS NOT NULL AND k IS NOT NULL) WHERE rn = 1)"""

_ROLE_KEY = "lower(translate(trim(role), '_-', ''))"
_NAME_KEY = "lower(trim(intelligence))"
EVIDENCES = f"""name_index(nkey, nname) AS ({_values(dims.name_index())}), role_index(rkey, rname, rweight) AS ({_values([(r.lower(), r, w) for r, w in dims.ROLES])}),
resolved AS (
  SELECT e.*, r.rname AS role_name, r.rweight AS weight, coalesce(a.nname, b.nname, c.nname) AS category
  FROM (SELECT DISTINCT * FROM evidences WHERE doc_id IS NOT NULL AND k IS NOT NULL) e
  LEFT JOIN role_index r ON r.rkey = {_ROLE_KEY} LEFT JOIN name_index a ON a.nkey = {_NAME_KEY}
  LEFT JOIN name_index b ON b.nkey = translate({_NAME_KEY}, '-_', '  ') LEFT JOIN name_index c ON c.nkey = replace({_NAME_KEY}, '  ', ' ')),
usable AS (SELECT * FROM resolved WHERE role_name IS NOT NULL AND trim(coalesce(text, '')) <> '')"""

SCORED = "scored AS (SELECT doc_id, k, category, round(sum(weight * coalesce(relevance, 1.0) * coalesce(confidence, 1.0)), 9) AS score FROM usable WHERE category IS NOT NULL GROUP BY ALL)"


def s_acts(source: str = "scored") -> str:
    return f"""acts AS (
  SELECT doc_id, k, CASE WHEN contains(doc_id, '#') THEN split_part(doc_id, '#', 1) || '#' ELSE regexp_replace(doc_id, '/+$', '') || '#' END || 'act-' || printf('%03d', k) || '-' || category AS act_uri,
         category, {s_half_up("score / whole")} AS share, {s_half_up("score")} AS weight, CASE WHEN rank = 1 THEN 'Primary' ELSE 'Secondary' END AS atype,
         rank = 1 AS is_primary_link, rank > 1 AND score >= 0.75 * top - 1e-12 AS is_secondary_link
  FROM (SELECT *, max(score) OVER w AS top, round(sum(score) OVER w, 9) AS whole, row_number() OVER (PARTITION BY doc_id, k ORDER BY score DESC, category) AS rank
        FROM (SELECT doc_id, k, category, round(sum(score), 9) AS score FROM {source} WHERE score IS NOT NULL AND category IS NOT NULL GROUP BY ALL) WHERE score > 0
        WINDOW w AS (PARTITION BY doc_id, k)))"""


def s_vector(norm: str, keys: str, source: str, value: str, tau: float = 1.0) -> str:
    sums = ", ".join(f"CAST(coalesce(sum({value}) FILTER (WHERE category = '{n}'), 0) AS DOUBLE) AS {s}" for n, s in zip(dims.NAMES, dims.SHORT, strict=True))
    names = dims.SHORT
    if norm == "l1":
        by = "(" + " + ".join(names) + ")"
        vals = {s: f"{s} / {by}" for s in names}
    elif norm == "l2":
        by = "sqrt(" + " + ".join(f"{s} * {s}" for s in names) + ")"
        vals = {s: f"{s} / {by}" for s in names}
    else:
        top = f"greatest({', '.join(names)})"
        by = "(" + " + ".join(f"exp(({s} - {top}) / {tau})" for s in names) + ")"
        vals = {s: f"exp(({s} - {top}) / {tau}) / {by}" for s in names}
    zero = f"greatest({', '.join(f'abs({s})' for s in names)}) = 0"
    inner = ", ".join(f"CASE WHEN {zero} THEN 0.0 ELSE {vals[s]} END AS n_{s}" for s in names)
    outer = ", ".join(f"{s_half_up(f'n_{s}')} AS {s}" for s in names)
    text = " || ',' || ".join(s_percent(f"n_{s}") for s in names)
    return f"SELECT {keys}, {outer}, {text} AS mi_vector FROM (SELECT {keys}, {inner} FROM (SELECT {keys}, {sums} FROM {source} GROUP BY {keys}))"


BASE = f"WITH {FRAGMENTS}, {EVIDENCES}, {SCORED}, {s_acts()}"
WEIGHTED = "weighted AS (SELECT a.*, CAST(a.share * (CASE WHEN coalesce(f.is_title, false) THEN 1.3 ELSE 1.0 END)::DECIMAL(6,2) AS DECIMAL(18,6)) AS w FROM acts a LEFT JOIN fragments f USING (doc_id, k))"
DOC_VECTORS = f"{WEIGHTED}, dv AS ({s_vector('l1', 'doc_id', 'weighted', 'w')})"
FRAG_VECTORS = f"fv AS ({s_vector('l1', 'doc_id, k', 'acts', 'share')})"


# --- stages as frames --------------------------------------------------------------------------------------


def _fragments(spark, d):
    return ingest.fragments(table(spark, d, "s1_output"))


def _resolved(spark, d):
    return evidence.resolved(table(spark, d, "evidences"))


def _usable(spark, d):
    return evidence.usable(_resolved(spark, d))


def _acts(spark, d):
    return activation.activations(activation.scores(_usable(spark, d)))


def _doc_vectors(spark, d, **options):
    return profile.document_vectors(_acts(spark, d), _fragments(spark, d), **options)


# --- texts and fragments -----------------------------------------------------------------------------------


@query(f"WITH {FRAGMENTS} SELECT doc_id, k, frag_uri, md5(text) AS text_md5, lang, is_title FROM fragments")
def q_fragments(spark, d):
    return _fragments(spark, d).select("doc_id", "k", "frag_uri", F.md5("text").alias("text_md5"), "lang", "is_title")


@query(f"WITH {FRAGMENTS} SELECT doc_id, k, CAST(length(c) AS INT) AS n_chars, md5(c) AS clean_md5 FROM (SELECT doc_id, k, {s_clean('text')} AS c FROM fragments)")
def q_clean_text(spark, d):
    rows = _fragments(spark, d).select("doc_id", "k", T.cleaned(F.col("text")).alias("c"))
    return rows.select("doc_id", "k", F.length("c").alias("n_chars"), F.md5("c").alias("clean_md5"))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(dims.STOP_WORDS)))


@query(
    f"""WITH {FRAGMENTS}, t AS (SELECT lang, unnest(list_filter(regexp_extract_all({s_fold("text")}, '[a-zA-ZÀ-ÖØ-öø-ÿ]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP_SQL}))) AS w FROM fragments)
    SELECT lang, w AS word, count(*) AS n FROM t GROUP BY ALL"""
)
def q_norm_tokens(spark, d):
    return _fragments(spark, d).select("lang", F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FRAGMENTS} SELECT doc_id, k, CAST(len(l) AS INT) AS n, md5(array_to_string(l, '|')) AS parts_md5
    FROM (SELECT doc_id, k, list_filter(string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {s_strip("s")} <> '') AS l FROM fragments)"""
)
def q_sentence_split(spark, d):
    rows = _fragments(spark, d).select("doc_id", "k", T.sentences(F.col("text")).alias("l"))
    return rows.select("doc_id", "k", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("parts_md5"))


@query()
def q_chunk_pack(spark, d):
    rows = _fragments(spark, d).select("doc_id", "k", F.posexplode(T.chunks(F.col("text"), 300, 80)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "k", "chunk_no", F.length("chunk").alias("n_chars"), "chunk")


_T = s_strip("text")
_NO_ABSTRACT = " AND ".join(f"NOT starts_with(lower({_T}), '{a}')" for a in T.ABSTRACTS)
_ABSTRACT = " OR ".join(f"starts_with(lower({_T}), '{a}')" for a in T.ABSTRACTS)
_LOOKS = f"({_T} <> '' AND length({_T}) <= 200 AND {_NO_ABSTRACT} AND NOT regexp_matches({_T}, '[.!?]$') AND length({_T}) - length(translate({_T}, ',;:', '')) <= 2)"


@query(
    f"""WITH {FRAGMENTS}, m AS (SELECT doc_id, k, {_LOOKS} AS looks, {_T} <> '' AND length({_T}) <= 160 AS short, ({_ABSTRACT}) AND k < 5 AS abstract FROM fragments),
    p AS (SELECT doc_id, coalesce(min(k) FILTER (WHERE k < 3 AND short AND looks), min(k) FILTER (WHERE k < 3 AND short), 0) AS chosen FROM m GROUP BY doc_id)
    SELECT doc_id, k, abstract OR k = chosen AS is_title FROM m JOIN p USING (doc_id)"""
)
def q_title_mark(spark, d):
    return ingest.with_titles(_fragments(spark, d).drop("is_title")).select("doc_id", "k", "is_title")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n - 1 AS INT) AS k FROM (SELECT doc_id, unnest(range(1, len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n\\s*'), lambda p: " + s_clean("p") + "), lambda p: p <> '')) + 1)) AS n FROM documents)")
def q_ingest_documents(spark, d):
    rows = ingest.exploded(ingest.from_text(table(spark, d, "documents"), "doc_id", "text", F.col("lang")))
    return rows.select("doc_id", "k")


@query()
def q_resegment(spark, d):
    docs = ingest.resegmented(ingest.from_text(table(spark, d, "documents"), "doc_id", "text", F.col("lang")))
    return ingest.exploded(docs).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@query(
    """SELECT DISTINCT doc_id, 'urn:doc:' || substr(replace(regexp_replace(trim(replace(doc_id, 'urn:doc:', '')), '[^\\p{L}\\p{N}_\\-. ]+', '', 'g'), ' ', '_'), 1, 120) AS slugged,
    doc_id || '#' AS base, CASE WHEN contains(frag_uri, '#') THEN split_part(frag_uri, '#', -1) END AS local, coalesce(TRY_CAST(nullif(regexp_extract(frag_uri, 'frag-([0-9]+)', 1), '') AS INT), -1) AS number
    FROM s1_output"""
)
def q_identifiers(spark, d):
    rows = table(spark, d, "s1_output")
    return rows.select(
        "doc_id",
        F.concat(F.lit("urn:doc:"), T.slug(F.replace("doc_id", F.lit("urn:doc:"), F.lit("")))).alias("slugged"),
        T.base_of(F.col("doc_id")).alias("base"),
        F.when(F.col("frag_uri").isNotNull(), T.local_name(F.col("frag_uri"))).alias("local"),
        F.coalesce(T.fragment_number(F.col("frag_uri")), F.lit(-1)).alias("number"),
    ).distinct()


@query("SELECT run_no, count(*) AS paragraphs, count(DISTINCT doc_id) AS documents FROM s1_output s WHERE NOT EXISTS (SELECT 1 FROM scores c WHERE c.doc_id = s.doc_id) GROUP BY run_no")
def q_incremental_antijoin(spark, d):
    new = ingest.unseen(table(spark, d, "s1_output"), table(spark, d, "scores"))
    return new.groupBy("run_no").agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT CAST(date_trunc('day', ingested_at) AS TIMESTAMP) AS day, run_no, count(*) AS n FROM s1_output WHERE ingested_at IS NOT NULL GROUP BY ALL")
def q_daily_arrivals(spark, d):
    return incremental.daily_arrivals(table(spark, d, "s1_output").where("ingested_at IS NOT NULL"), "ingested_at", ["run_no"])


_TRIG = evidence.trigger_table()


def _s_trigger(terms: list[str]) -> str:
    long, short = [t for t in terms if len(t) >= 5], [t for t in terms if len(t) < 5]
    parts = [f"contains(f, '{t}')" for t in long]
    if short:
        parts.append(f"list_has_any(string_split_regex(f, '[^\\p{{L}}\\p{{N}}_]+'), [{', '.join(repr(t) for t in short)}])")
    return "(" + " OR ".join(parts) + ")"


_HITS = f"folded AS (SELECT doc_id, k, {s_fold('text')} AS f FROM fragments), hits AS (" + " UNION ALL ".join(f"SELECT doc_id, k, '{n}' AS category FROM folded WHERE {_s_trigger(t)}" for n, t in _TRIG.items()) + ")"


@query(f"WITH {FRAGMENTS}, {_HITS} SELECT * FROM hits")
def q_trigger_hits(spark, d):
    return evidence.trigger_hits(_fragments(spark, d))


@query(f"WITH {FRAGMENTS}, {_HITS} SELECT category, count(*) AS fragments, count(DISTINCT doc_id) AS documents FROM hits GROUP BY category")
def q_mi_sets(spark, d):
    return evidence.trigger_hits(_fragments(spark, d)).groupBy("category").agg(F.count("*").alias("fragments"), F.count_distinct("doc_id").alias("documents"))


_CASCADE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(f, '\\b({p})\\b') THEN '{n}'" for n, p in T.CASCADE) + " END"


@query(f"WITH {FRAGMENTS} SELECT doc_id, k, {_CASCADE_SQL} AS category FROM (SELECT doc_id, k, {s_fold('text')} AS f FROM fragments)")
def q_forced_mi(spark, d):
    return _fragments(spark, d).select("doc_id", "k", T.last_resort(F.col("text")).alias("category"))


_HIT_LIST = "list_filter([" + ", ".join(f"CASE WHEN {_s_trigger(t)} THEN '{n}' END" for n, t in _TRIG.items()) + "], lambda z: z IS NOT NULL)"


@query(
    f"""WITH {EVIDENCES}, x AS (SELECT *, {s_fold('text')} AS f FROM resolved WHERE trim(coalesce(role, '')) <> '' AND trim(coalesce(text, '')) <> ''),
    y AS (SELECT doc_id, k, trim(role) AS role, lower(trim(text)) AS text_key, category, {_HIT_LIST} AS hit, {_CASCADE_SQL} AS forced, greatest(0.0, least(1.0, coalesce(confidence, 0.75))) AS c, greatest(0.0, least(1.0, coalesce(relevance, 0.75))) AS r FROM x),
    z AS (SELECT doc_id, k, role, text_key, unnest(CASE WHEN category IS NOT NULL THEN [category] WHEN len(hit) > 0 THEN hit WHEN forced IS NOT NULL THEN [forced] ELSE [] END) AS intelligence,
          c * CASE WHEN category IS NOT NULL THEN 0.9 WHEN len(hit) > 0 THEN 0.65 ELSE 0.5 END AS confidence, r AS relevance FROM y)
    SELECT doc_id, k, role, text_key, intelligence, round(max(confidence), 6) AS confidence, round(max(relevance), 6) AS relevance FROM z GROUP BY ALL"""
)
def q_labelled_evidence(spark, d):
    rows = table(spark, d, "evidences").where("doc_id IS NOT NULL AND k IS NOT NULL").withColumn("mi_idx", F.lit(None).cast("array<string>"))
    found = evidence.labelled(rows)
    return found.select("doc_id", "k", "role", "text_key", "intelligence", F.round("confidence", 6).alias("confidence"), F.round("relevance", 6).alias("relevance"))


@query(
    f"""WITH {FRAGMENTS} SELECT doc_id, k, CASE WHEN lower(trim(lang)) IN ('pt', 'en', 'es') THEN lower(trim(lang)) ELSE 'pt' END AS lang FROM fragments"""
)
def q_language_whitelist(spark, d):
    return ingest.limited_language(_fragments(spark, d), None).select("doc_id", "k", "lang")


# --- evidence ------------------------------------------------------------------------------------------------


@query(f"WITH {EVIDENCES} SELECT role_name, category, count(*) AS n FROM resolved GROUP BY ALL")
def q_evidence_resolved(spark, d):
    return _resolved(spark, d).groupBy("role_name", "category").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EVIDENCES} SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT *, CASE WHEN trim(coalesce(role, '')) = '' THEN 'no role' WHEN role_name IS NULL THEN 'unknown role'
    WHEN trim(coalesce(text, '')) = '' THEN 'no text' END AS reason FROM resolved) WHERE reason IS NOT NULL GROUP BY reason"""
)
def q_quarantine(spark, d):
    return evidence.quarantine(_resolved(spark, d)).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(f"WITH {EVIDENCES} SELECT role_name, count(*) AS n, count(DISTINCT (doc_id, k)) AS fragments FROM usable GROUP BY role_name")
def q_role_counts(spark, d):
    return _usable(spark, d).groupBy("role_name").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "k").alias("fragments"))


@query(
    f"""WITH {EVIDENCES} SELECT doc_id, k, role_name, lower(text) AS text_key, category, max({s_clip("confidence")}) AS confidence, max({s_clip("relevance")}) AS relevance, count(*) AS n FROM usable GROUP BY doc_id, k, role_name, lower(text), category"""
)
def q_evidence_merge(spark, d):
    return evidence.merged(_usable(spark, d)).select("doc_id", "k", "role_name", "text_key", "category", "confidence", "relevance", "n")


_REL = "CASE WHEN trim(coalesce(f.text, '')) = '' OR trim(coalesce(u.text, '')) = '' OR instr(lower(f.text), lower(u.text)) = 0 THEN 0.75 ELSE greatest(0.5, least(1.0, 1.0 - 0.5 * (instr(lower(f.text), lower(u.text)) - 1) / greatest(1, length(f.text)))) END"


@query(
    f"""WITH {FRAGMENTS}, {EVIDENCES} SELECT u.doc_id, u.k, u.i, round({_REL}, 6) AS place_relevance, round({s_clip("1.0 / (1.0 + greatest(0.0, u.confidence))")}, 6) AS score_confidence, contains(lower(f.text), lower(u.text)) AS verbatim
    FROM usable u JOIN fragments f USING (doc_id, k)"""
)
def q_evidence_measures(spark, d):
    rows = _usable(spark, d).withColumnRenamed("text", "e_text").join(_fragments(spark, d).select("doc_id", "k", F.col("text").alias("f_text")), ["doc_id", "k"])
    confidence = F.when(F.col("confidence").isNull(), 1.0).otherwise(N.keyword_confidence(F.col("confidence")))
    return rows.select("doc_id", "k", "i", F.round(N.position_relevance(F.col("f_text"), F.col("e_text")), 6).alias("place_relevance"), F.round(confidence, 6).alias("score_confidence"), F.contains(F.lower("f_text"), F.lower("e_text")).alias("verbatim"))


@query()
def q_keywords(spark, d):
    return evidence.limited(evidence.keywords(_fragments(spark, d))).withColumn("score", F.round("score", 9))


@query()
def q_keyword_overlap(spark, d):
    return evidence.reduced(evidence.limited(evidence.keywords(_fragments(spark, d)))).withColumn("score", F.round("score", 9))


@query()
def q_annotated_evidence(spark, d):
    return evidence.annotated(_fragments(spark, d))


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY ALL")
def q_payload_json(spark, d):
    return table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT doc_id, k, count(*) AS n, round(sum(confidence), 6) AS confidence FROM (SELECT DISTINCT * FROM evidences WHERE doc_id IS NOT NULL AND k IS NOT NULL) GROUP BY doc_id, k")
def q_payload_round_trip(spark, d):
    rows = table(spark, d, "evidences").where("doc_id IS NOT NULL AND k IS NOT NULL").distinct()
    back = files.payload(files.payload_json(rows).drop("k"), "payload")
    return back.groupBy("doc_id", "k").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


# --- activations and vectors ----------------------------------------------------------------------------------


@query(f"WITH {EVIDENCES}, {SCORED} SELECT * FROM scored")
def q_scores(spark, d):
    return activation.scores(_usable(spark, d))


@query(f"WITH {EVIDENCES} SELECT doc_id, k, category, round(sum(weight), 9) AS score FROM usable WHERE category IS NOT NULL GROUP BY ALL")
def q_scores_unweighted(spark, d):
    return activation.scores(_usable(spark, d), weighted=False)


_A = "doc_id, k, act_uri, category, CAST(share AS DOUBLE) AS share, CAST(weight AS DOUBLE) AS weight, atype, is_primary_link, is_secondary_link"


def _plain_acts(acts):
    return acts.withColumn("share", F.col("share").cast("double")).withColumn("weight", F.col("weight").cast("double"))


@query(f"{BASE} SELECT {_A} FROM acts")
def q_activations(spark, d):
    return _plain_acts(_acts(spark, d))


_STORED = "stored AS (SELECT doc_id, k, intelligence AS category, score FROM scores)"


@query(f"WITH {_STORED}, {s_acts('stored')} SELECT {_A} FROM acts")
def q_activations_of_scores(spark, d):
    return _plain_acts(activation.activations(table(spark, d, "scores").withColumnRenamed("intelligence", "category")))


@query(f"{BASE} SELECT count(*) AS activations, count(*) FILTER (WHERE is_primary_link) AS primaries, greatest(0, count(*) - count(*) FILTER (WHERE is_primary_link)) AS secondaries, count(*) FILTER (WHERE is_secondary_link) AS linked_secondaries FROM acts")
def q_activation_metrics(spark, d):
    return activation.metrics(_acts(spark, d))


_V = ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in dims.SHORT)


def _plain_vectors(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in dims.SHORT else F.col(c) for c in df.columns])


def _vector_query(norm: str):
    tau = 0.5 if norm == "softmax" else 1.0
    sql = f"{BASE}, {WEIGHTED} SELECT doc_id, {_V}, mi_vector FROM ({s_vector(norm, 'doc_id', 'weighted', 'w', tau)})"
    QUERIES[f"q_doc_vector_{norm}"] = lambda spark, d: _plain_vectors(_doc_vectors(spark, d, norm=norm, tau=tau))
    SQL[f"q_doc_vector_{norm}"] = sql
    QUERIES[f"q_frag_vector_{norm}"] = lambda spark, d: _plain_vectors(profile.fragment_vectors(_acts(spark, d), norm, tau))
    SQL[f"q_frag_vector_{norm}"] = f"{BASE} SELECT doc_id, k, {_V}, mi_vector FROM ({s_vector(norm, 'doc_id, k', 'acts', 'share', tau)})"


for _norm in ("l1", "l2", "softmax"):
    _vector_query(_norm)


@query(f"{BASE}, {DOC_VECTORS}, l AS (UNPIVOT (SELECT doc_id, {_V} FROM dv) ON {', '.join(dims.SHORT)} INTO NAME category VALUE value) SELECT doc_id, category || 'Intelligence' AS category, value FROM l")
def q_vector_long(spark, d):
    return profile.long_form(_doc_vectors(spark, d), ["doc_id"])


_GOOD = "good AS (SELECT doc_id, vector FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC, vector DESC) AS rn FROM loaded_doc WHERE len(vector) = 8 AND len(list_filter(vector, lambda x: x IS NOT NULL AND NOT isnan(x))) = 8) WHERE rn = 1)"


@query(f"WITH {_GOOD} SELECT doc_id, " + ", ".join(f"vector[{i + 1}] AS v{i}" for i in range(8)) + " FROM good")
def q_vector_parse(spark, d):
    rows = ranking.latest_vectors(table(spark, d, "loaded_doc"))
    text = F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: F.concat(x.cast("string"), F.lit("%"))), "; "), F.lit("]"))
    parsed = rows.select("doc_id", N.parsed_vector(text).alias("v"))
    return parsed.select("doc_id", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(8)])


# --- competency questions ----------------------------------------------------------------------------------------

_LABELS = "labels(category, label_lang, label) AS (" + _values([(f"{s}Intelligence", lang, lab) for s, en, pt, *_ in dims.CATEGORIES for lang, lab in (("en", en), ("pt", pt))]) + ")"


@query(
    f"""{BASE}, {_LABELS}, x AS (SELECT doc_id, k, category, 'activation' AS source, CAST(share AS DOUBLE) AS score FROM acts UNION ALL SELECT DISTINCT doc_id, k, category, 'element', CAST(NULL AS DOUBLE) FROM usable WHERE category IS NOT NULL)
    SELECT DISTINCT doc_id, k, frag_uri, category, label, label_lang, source, score FROM x LEFT JOIN labels USING (category) LEFT JOIN fragments USING (doc_id, k)"""
)
def q_cq1(spark, d):
    return questions.evoked(_acts(spark, d), _usable(spark, d), _fragments(spark, d))


@query(
    f"""{BASE}, {_LABELS}, wide AS (SELECT category, max(label) FILTER (WHERE label_lang = 'pt') AS label_pt, max(label) FILTER (WHERE label_lang = 'en') AS label_en FROM labels GROUP BY category),
    x AS (SELECT doc_id, k, category, role_name AS evidence_type, text AS element, NULL AS act_uri, CAST(NULL AS DOUBLE) AS score, NULL AS atype FROM usable WHERE category IS NOT NULL
          UNION ALL SELECT doc_id, k, category, 'IntelligenceActivation', NULL, act_uri, CAST(share AS DOUBLE), atype FROM acts)
    SELECT DISTINCT doc_id, k, category, evidence_type, element, act_uri, score, atype, label_pt, label_en FROM x LEFT JOIN wide USING (category)"""
)
def q_cq2(spark, d):
    return questions.elements_and_activations(_acts(spark, d), _usable(spark, d))


@query(
    f"""{BASE} SELECT doc_id, coalesce(k, -1) AS k, category, CAST(grouping(k) AS INT) AS whole_document, count(*) AS n, count(*) FILTER (WHERE atype = 'Primary') AS primaries, count(*) FILTER (WHERE atype = 'Secondary') AS secondaries, CAST(max(share) AS DOUBLE) AS top_score
    FROM acts GROUP BY GROUPING SETS ((doc_id, k, category), (doc_id, category))"""
)
def q_cq2_rollup(spark, d):
    return questions.summary(_acts(spark, d)).withColumn("whole_document", F.col("whole_document").cast("int")).withColumn("k", F.coalesce("k", F.lit(-1)))


@query(
    f"""{BASE}, {_LABELS}, x AS (SELECT doc_id, k, category, 'activation' AS source, CAST(share AS DOUBLE) AS score FROM acts UNION ALL SELECT DISTINCT doc_id, k, category, 'element', CAST(NULL AS DOUBLE) FROM usable WHERE category IS NOT NULL),
    r AS (SELECT DISTINCT doc_id, k, category, label, label_lang, source, score FROM x LEFT JOIN labels USING (category)), f AS (SELECT DISTINCT doc_id, k FROM r)
    SELECT doc_id, 0 AS part, -1 AS k, '[Documento] ' || doc_id AS line FROM (SELECT DISTINCT doc_id FROM f JOIN fragments USING (doc_id, k)) UNION ALL SELECT doc_id, 0, -1, '' FROM (SELECT DISTINCT doc_id FROM f JOIN fragments USING (doc_id, k))
    UNION ALL SELECT doc_id, 1, k, '[Fragmento] ' || coalesce(nullif(text, ''), frag_uri) FROM f JOIN fragments USING (doc_id, k) UNION ALL SELECT doc_id, 1, k, '' FROM f JOIN fragments USING (doc_id, k)
    UNION ALL SELECT doc_id, 1, k, '  - ' || coalesce(label, category) || CASE WHEN source = 'activation' AND coalesce(score, 0) <> 0 THEN printf(' (via activation, score=%.4f)', score) ELSE ' (via ' || source || ')' END FROM r"""
)
def q_cq1_lines(spark, d):
    return questions.evoked_lines(_acts(spark, d), _usable(spark, d), _fragments(spark, d)).drop("place")


@query(
    f"""{BASE}, {_LABELS}, names AS (SELECT category, max(label) FILTER (WHERE label_lang = 'pt') AS name FROM labels GROUP BY category),
    e AS (SELECT DISTINCT doc_id, k, category, name, role_name AS t, text AS el FROM usable JOIN names USING (category)), a AS (SELECT doc_id, k, category, name, CAST(share AS DOUBLE) AS score, atype, act_uri FROM acts JOIN names USING (category)),
    r AS (SELECT DISTINCT doc_id, k, name FROM (SELECT doc_id, k, name FROM e UNION ALL SELECT doc_id, k, name FROM a))
    SELECT doc_id, 0 AS part, -1 AS k, '[Documento] ' || doc_id AS line FROM (SELECT DISTINCT doc_id FROM r) UNION ALL SELECT doc_id, 2, -1, '[Documento — Fragmentos] ' || doc_id FROM (SELECT DISTINCT doc_id FROM r)
    UNION ALL SELECT doc_id, 1, -1, '  > Inteligência (doc): ' || name FROM (SELECT DISTINCT doc_id, name FROM r) UNION ALL SELECT doc_id, 1, -1, '    - Elementos (agregado no doc):' FROM (SELECT DISTINCT doc_id, name FROM e)
    UNION ALL SELECT doc_id, 1, -1, '        • ' || t || ': ' || el FROM (SELECT DISTINCT doc_id, name, t, el FROM e)
    UNION ALL SELECT doc_id, 1, -1, printf('    - Ativações (doc): n=%d, primárias=%d, secundárias=%d, max=%.4f', count(*), count(*) FILTER (WHERE atype = 'Primary'), count(*) FILTER (WHERE atype = 'Secondary'), max(score)) FROM a GROUP BY doc_id, name
    UNION ALL SELECT doc_id, 3, k, '[Fragmento] ' || coalesce(nullif(text, ''), frag_uri) FROM (SELECT DISTINCT doc_id, k FROM r) JOIN fragments USING (doc_id, k) UNION ALL SELECT doc_id, 3, k, '  > Inteligência: ' || name FROM r
    UNION ALL SELECT doc_id, 3, k, '    - Elementos:' FROM (SELECT DISTINCT doc_id, k, name FROM e) UNION ALL SELECT doc_id, 3, k, '        • ' || t || ': ' || el FROM e
    UNION ALL SELECT doc_id, 3, k, '    - Ativações:' FROM (SELECT DISTINCT doc_id, k, name FROM a) UNION ALL SELECT doc_id, 3, k, '        • ' || printf('score=%.4f', score) || coalesce(', tipo=' || atype, '') FROM a"""
)
def q_cq2_lines(spark, d):
    return questions.elements_lines(_acts(spark, d), _usable(spark, d), _fragments(spark, d)).drop("place")


_CQ3 = """ties AS (SELECT *, max(share) OVER (PARTITION BY doc_id, k) AS top FROM acts), kept AS (SELECT *, max(atype = 'Primary') OVER (PARTITION BY doc_id, k) AS has_primary FROM ties WHERE abs(CAST(share - top AS DOUBLE)) <= 1e-9),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, category ORDER BY (atype = 'Primary') DESC, act_uri) AS rn FROM kept WHERE NOT has_primary OR atype = 'Primary')"""


@query(f"{BASE}, {_CQ3} SELECT doc_id, k, category, CAST(share AS DOUBLE) AS score, atype, count(*) OVER (PARTITION BY doc_id, k) > 1 AS tied FROM one WHERE rn = 1")
def q_cq3(spark, d):
    return questions.standouts(_acts(spark, d))


@query(f"{BASE}, {_CQ3} SELECT count(*) AS rows, count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, k)) AS fragments FROM one WHERE rn = 1")
def q_cq3_metrics(spark, d):
    return questions.metrics(questions.standouts(_acts(spark, d)))


@query(
    f"""WITH {EVIDENCES}, e AS (SELECT DISTINCT doc_id, k, category, role_name AS type, lower(text) AS low, text AS name FROM usable WHERE category IS NOT NULL)
    SELECT doc_id, k, category, string_agg(type || ':' || name, '|' ORDER BY type, low, name) AS elements FROM e GROUP BY ALL"""
)
def q_elements_by_category(spark, d):
    return questions.elements_by_category(_usable(spark, d))


_PLACES = "CASE category " + " ".join(f"WHEN '{s}' THEN {cq}" for s, _, _, _, cq, _ in dims.CATEGORIES) + " END"


_NAMED = f"""{_LABELS}, en AS (SELECT category, label AS name FROM labels WHERE label_lang = 'en'), pt AS (SELECT category, label AS name FROM labels WHERE label_lang = 'pt')"""
_VEC_LINES = " UNION ALL ".join(
    f"SELECT doc_id, 0 AS part, {place} AS k, 0 AS n, {line} AS line FROM dv"
    for place, line in ((0, "'[Documento] ' || doc_id"), (1, "'  - miVector: ' || mi_vector"), (3, "'  - Ranking (top 3):'"), (5, "''"), (6, "''"), (7, "'[Documento — Fragmentos] ' || doc_id"), (8, "''"))
)


@query(
    f"""{BASE}, {DOC_VECTORS}, {_CQ3}, {_NAMED}, l AS (UNPIVOT (SELECT doc_id, {_V} FROM dv) ON {", ".join(dims.SHORT)} INTO NAME category VALUE value),
    top AS (SELECT doc_id, name, value, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, {_PLACES}) AS place FROM l) AS x JOIN en ON en.category = x.category || 'Intelligence' WHERE place <= 3),
    found AS (SELECT doc_id, k, name, CAST(share AS DOUBLE) AS score, atype, count(*) OVER (PARTITION BY doc_id, k) > 1 AS tied, row_number() OVER (PARTITION BY doc_id, k ORDER BY lower(name)) AS n FROM one JOIN pt USING (category) WHERE rn = 1),
    heads AS (SELECT doc_id, k, tied, coalesce(nullif(f.text, ''), f.frag_uri) AS label FROM (SELECT DISTINCT doc_id, k, tied FROM found) LEFT JOIN fragments f USING (doc_id, k))
    {_VEC_LINES} UNION ALL SELECT doc_id, 0, 2, 0, printf('  - TOP (documento): %s (score=%.4f)', name, value) FROM top WHERE place = 1 UNION ALL SELECT doc_id, 0, 4, place, printf('      • %s: %.4f', name, value) FROM top
    UNION ALL SELECT doc_id, 1, k, 0, '[Fragmento] ' || label FROM heads UNION ALL SELECT doc_id, 1, k, 1, '  > TOP (empate):' FROM heads WHERE tied UNION ALL SELECT doc_id, 1, k, 1000000000, '' FROM heads
    UNION ALL SELECT doc_id, 1, k, CAST(10 + n AS INT), CASE WHEN tied THEN '    - ' ELSE '  > TOP: ' END || name || printf(' (score=%.4f', score) || coalesce(', tipo=' || nullif(atype, ''), '') || ')' FROM found"""
)
def q_cq3_lines(spark, d):
    acts, frags = _acts(spark, d), _fragments(spark, d)
    return questions.report_lines(acts, profile.document_vectors(acts, frags), frags)


@query(
    f"""{BASE}, {DOC_VECTORS}, l AS (UNPIVOT (SELECT doc_id, {_V} FROM dv) ON {", ".join(dims.SHORT)} INTO NAME category VALUE value)
    SELECT doc_id, CAST(place AS INT) AS place, category || 'Intelligence' AS category, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, {_PLACES}) AS place FROM l) WHERE place <= 3"""
)
def q_doc_top3(spark, d):
    return questions.leading(_doc_vectors(spark, d))


@query("WITH RECURSIVE edges(sub, sup) AS (" + _values(dims.CLASS_EDGES) + "), up(sub, sup) AS (SELECT sub, sup FROM edges UNION SELECT up.sub, e.sup FROM up JOIN edges e ON up.sup = e.sub) SELECT DISTINCT sub, sup FROM up")
def q_subclass_closure(spark, d):
    return questions.closure(spark)


# --- constraints -----------------------------------------------------------------------------------------------------

_SHAPE = "doc_id, focus_node, source_shape, component, path, value, severity"


def _row(focus: str, shape: str, component: str, path: str, value: str, severity: str = "Violation") -> str:
    return f"doc_id, {focus} AS focus_node, '{shape}' AS source_shape, '{component}' AS component, '{path}' AS path, CAST({value} AS VARCHAR) AS value, '{severity}' AS severity"


_FRAG_V = f"""SELECT {_row("frag_uri", "Fragment", "Or", "usesElement|hasActivation", "NULL")} FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.doc_id = f.doc_id AND u.k = f.k) AND NOT EXISTS (SELECT 1 FROM acts a WHERE a.doc_id = f.doc_id AND a.k = f.k)"""


@query(f"{BASE} {_FRAG_V}")
def q_shacl_fragment(spark, d):
    return shapes.fragment_violations(_fragments(spark, d), _usable(spark, d), _acts(spark, d))


def _raw_acts(spark, d):
    """The stored scores as if they were finished activations, so that constraints meet dirty rows."""
    rows = table(spark, d, "scores")
    return rows.select(
        "doc_id", "k", F.concat("doc_id", F.lit("#raw-"), F.col("k").cast("string"), F.lit("-"), F.coalesce("intelligence", F.lit(""))).alias("act_uri"), F.col("intelligence").alias("category"), F.col("score").alias("share"),
        F.when(F.col("score") > 1, "Primary").when(F.col("score") > 0, "Secondary").alias("atype"), (F.col("score") > 0.9).alias("is_primary_link"), F.col("score").isNull().alias("is_secondary_link"),
    )


_RAW = "raw AS (SELECT doc_id, k, doc_id || '#raw-' || CAST(k AS VARCHAR) || '-' || coalesce(intelligence, '') AS act_uri, intelligence AS category, score AS share, CASE WHEN score > 1 THEN 'Primary' WHEN score > 0 THEN 'Secondary' END AS atype, score > 0.9 AS is_primary_link, score IS NULL AS is_secondary_link FROM scores)"
_ACT_V = " UNION ALL ".join(
    [
        f"SELECT {_row('act_uri', 'Activation', 'In', 'hasActivationType', 'atype')} FROM raw WHERE coalesce(atype, '') NOT IN ('Primary', 'Secondary')",
        f"SELECT {_row('act_uri', 'Activation', 'Range', 'hasActivationScore', 'NULL')} FROM raw WHERE share < 0 OR share > 1",
        f"SELECT {_row('act_uri', 'Activation', 'Sparql', 'hasPrimaryActivation', 'atype')} FROM raw WHERE coalesce(is_primary_link, false) AND coalesce(atype, '') <> 'Primary'",
        f"SELECT {_row('act_uri', 'Activation', 'Sparql', 'hasSecondaryActivation', 'atype')} FROM raw WHERE coalesce(is_secondary_link, false) AND coalesce(atype, '') <> 'Secondary'",
        f"SELECT {_row('act_uri', 'Activation', 'Sparql', 'isAbout', 'category')} FROM raw WHERE category IS NULL OR category NOT IN ({', '.join(repr(n) for n in dims.NAMES)})",
    ]
)


@query(f"WITH {_RAW} {_ACT_V}")
def q_shacl_activation(spark, d):
    found = shapes.activation_violations(_raw_acts(spark, d))
    return found.withColumn("value", F.when(F.col("component") != "Range", F.col("value")))


_LOADED_TEXT = "SELECT doc_id, doc_id AS vec_uri, array_to_string(list_transform(vector, lambda x: coalesce(CAST(x AS VARCHAR), '')), ',') AS mi_vector FROM loaded_doc"


@query("SELECT doc_id, doc_id AS focus_node, 'Vector' AS source_shape, 'Or' AS component, 'miVector|scores' AS path, CAST(NULL AS VARCHAR) AS value, 'Violation' AS severity FROM loaded_doc WHERE NOT coalesce(len(vector) = 8 AND len(list_filter(vector, lambda x: x BETWEEN 0 AND 1)) = 8, false)")
def q_shacl_vector(spark, d):
    rows = table(spark, d, "loaded_doc")
    whole = F.col("vector").isNotNull() & (F.size("vector") == 8)
    return shapes.vector_violations(rows.select("doc_id", F.col("doc_id").alias("vec_uri"), F.lit(None).cast("string").alias("mi_vector"), *[F.when(whole, F.get("vector", F.lit(i))).alias(s) for i, s in enumerate(dims.SHORT)]))


_DOC_V = f"""docs AS (SELECT DISTINCT doc_id FROM fragments) SELECT {_row("doc_id", "Document", "MinCount", "hasProfileVector", "0")} FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM dv)"""


@query(f"{BASE}, {DOC_VECTORS}, {_DOC_V}")
def q_shacl_doc(spark, d):
    f = _fragments(spark, d)
    return shapes.document_violations(f.select("doc_id").distinct(), f, _doc_vectors(spark, d).select("doc_id"))


@query(
    f"""{BASE}, v AS ({_FRAG_V}), docs AS (SELECT DISTINCT doc_id FROM fragments), per AS (SELECT doc_id, count(*) AS results, count(*) FILTER (WHERE severity = 'Violation') AS bad FROM v GROUP BY doc_id)
    SELECT doc_id, coalesce(bad, 0) = 0 AS conforms, coalesce(results, 0) AS results FROM docs LEFT JOIN per USING (doc_id)"""
)
def q_shacl_report(spark, d):
    f = _fragments(spark, d)
    return shapes.report(f.select("doc_id").distinct(), shapes.fragment_violations(f, _usable(spark, d), _acts(spark, d)))


_COMPONENT_OF = "CASE component " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in shapes.COMPONENTS.items()) + " END"


@query(
    f"""{BASE}, v AS (SELECT DISTINCT *, {_COMPONENT_OF} AS c FROM ({_FRAG_V})), docs AS (SELECT DISTINCT doc_id FROM fragments), per AS (SELECT doc_id, count(*) AS results, count(*) FILTER (WHERE severity = 'Violation') AS bad FROM v GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(bad, 0) = 0 AS conforms, coalesce(results, 0) AS results FROM docs LEFT JOIN per USING (doc_id))
    SELECT doc_id, 'Validation Report' AS line FROM d UNION ALL SELECT doc_id, CASE WHEN conforms THEN 'Conforms: True' ELSE 'Conforms: False' END FROM d UNION ALL SELECT doc_id, printf('Results (%d):', results) FROM d WHERE results > 0
    UNION ALL SELECT doc_id, 'Constraint Violation in ' || c || ' ({shapes.SH}' || c || '):' FROM v UNION ALL SELECT doc_id, chr(9) || 'Severity: sh:' || severity FROM v UNION ALL SELECT doc_id, chr(9) || 'Source Shape: onto:' || source_shape || 'Shape' FROM v
    UNION ALL SELECT doc_id, chr(9) || 'Focus Node: <' || focus_node || '>' FROM v UNION ALL SELECT doc_id, chr(9) || 'Value Node: ' || coalesce(value, '<' || focus_node || '>') FROM v UNION ALL SELECT doc_id, chr(9) || 'Path: ' || path FROM v"""
)
def q_shacl_lines(spark, d):
    f = _fragments(spark, d)
    return shapes.report_lines(f.select("doc_id").distinct(), shapes.fragment_violations(f, _usable(spark, d), _acts(spark, d))).drop("place")


@query("SELECT DISTINCT doc_id, CASE WHEN starts_with(doc_id, 'urn:doc:') THEN substr(doc_id, 9) ELSE regexp_extract(doc_id, '[^/]*$') END AS slug FROM s1_output WHERE doc_id IS NOT NULL")
def q_document_slugs(spark, d):
    rows = table(spark, d, "s1_output").where("doc_id IS NOT NULL").select("doc_id").distinct()
    return rows.select("doc_id", T.document_slug(F.col("doc_id")).alias("slug"))


@query("SELECT key, round(vector[1] / list_sum(vector), 9) AS first, round(list_max(vector) / list_sum(vector), 9) AS most FROM profiles")
def q_valid_profiles(spark, d):
    rows = ranking.valid_profiles(table(spark, d, "profiles"))
    return rows.select("key", F.round(F.get("vector", F.lit(0)), 9).alias("first"), F.round(F.array_max("vector"), 9).alias("most"))


# --- ranking ---------------------------------------------------------------------------------------------------------------


def _s_cos(a: str, b: str, places=range(1, 9)) -> str:
    dot = " + ".join(f"{a}[{i}] * {b}[{i}]" for i in places)
    na, nb = ("sqrt(" + " + ".join(f"{x}[{i}] * {x}[{i}]" for i in places) + ")" for x in (a, b))
    return f"round(CASE WHEN {na} <= 0 OR {nb} <= 0 THEN 0.0 ELSE ({dot}) / ({na} * {nb}) END, 9)"


def _s_ranked(places=range(1, 9), k: int = 10) -> str:
    return f"""SELECT key, doc_id, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id) AS place FROM (SELECT p.key, g.doc_id, {_s_cos("g.vector", "p.vector", places)} AS score FROM good g CROSS JOIN profiles p)) WHERE place <= {k}"""


@query(f"WITH {_GOOD} {_s_ranked()}")
def q_rank_profiles(spark, d):
    return ranking.ranked(ranking.scored(ranking.latest_vectors(table(spark, d, "loaded_doc")), table(spark, d, "profiles")))


@query(f"WITH {_GOOD} {_s_ranked((1, 2, 3), 5)}")
def q_rank_focus(spark, d):
    return ranking.ranked(ranking.scored(ranking.latest_vectors(table(spark, d, "loaded_doc")), table(spark, d, "profiles"), dims.SHORT[:3]), 5)


@query(f"WITH {_GOOD}, q AS (SELECT doc_id AS key, vector FROM good ORDER BY doc_id LIMIT 1) SELECT key, doc_id, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT q.key, g.doc_id, {_s_cos('g.vector', 'q.vector')} AS score FROM good g CROSS JOIN q)) WHERE place <= 10")
def q_rank_query_doc(spark, d):
    return ranking.like_document(ranking.latest_vectors(table(spark, d, "loaded_doc")))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE vector IS NULL OR len(vector) <> 8) AS wrong_size, count(*) FILTER (WHERE vector IS NULL OR coalesce(list_sum(vector), 0) <= 0) AS no_sum FROM loaded_doc")
def q_profile_sanity(spark, d):
    return ranking.sanity(table(spark, d, "loaded_doc"))


@query(
    f"""WITH {_GOOD}, s AS (SELECT p.key, g.doc_id, {_s_cos("g.vector", "p.vector")} AS a, {_s_cos("g.vector", "p.vector", (1, 2, 3, 4))} AS b FROM good g CROSS JOIN profiles p),
    r AS (SELECT key, rank() OVER (PARTITION BY key ORDER BY a DESC) + (count(*) OVER (PARTITION BY key, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY key ORDER BY b DESC) + (count(*) OVER (PARTITION BY key, b) - 1) / 2.0 AS rb FROM s)
    SELECT key, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r GROUP BY key"""
)
def q_rank_stability(spark, d):
    vectors, profiles = settled(ranking.latest_vectors(table(spark, d, "loaded_doc"))), table(spark, d, "profiles")
    return ranking.rank_correlation(settled(ranking.scored_by(vectors, profiles, whole=None, part=dims.SHORT[:4])), "whole", "part")


@query(f"{BASE}, {_STORED}, {s_acts('stored').replace('acts AS', 'other AS')}, j AS (SELECT a.category AS p, o.category AS q FROM acts a JOIN other o USING (doc_id, k) WHERE a.is_primary_link AND o.is_primary_link) SELECT round(count(*) FILTER (WHERE p = q) / count(*), 6) AS f1_micro, count(*) AS n FROM j")
def q_f1_micro(spark, d):
    one = _acts(spark, d).where("is_primary_link").select("doc_id", "k", F.col("category").alias("p"))
    two = activation.activations(table(spark, d, "scores").withColumnRenamed("intelligence", "category")).where("is_primary_link").select("doc_id", "k", F.col("category").alias("q"))
    return one.join(two, ["doc_id", "k"]).agg(ranking.f1_micro(F.col("p"), F.col("q")).alias("f1_micro"), F.count("*").alias("n"))


_ARR = "[" + ", ".join(f"CAST({s} AS DOUBLE)" for s in dims.SHORT) + "]"
_GAP = "sqrt(" + " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, 9)) + ")"


@query(f"{BASE}, {WEIGHTED}, one AS (SELECT doc_id, {_ARR} AS v FROM ({s_vector('l1', 'doc_id', 'weighted', 'w')})), two AS (SELECT doc_id, {_ARR} AS v FROM ({s_vector('l2', 'doc_id', 'weighted', 'w')})) SELECT doc_id, {_s_cos('a.v', 'b.v')} AS cosine, round({_GAP}, 9) AS distance FROM one a JOIN two b USING (doc_id)")
def q_vector_l2(spark, d):
    def arrays(df):
        return df.select("doc_id", F.array(*[F.col(s).cast("double") for s in dims.SHORT]).alias("vector"))

    return ranking.vector_shift(arrays(_doc_vectors(spark, d)), arrays(_doc_vectors(spark, d, norm="l2")))


# --- exports, triples, batch ---------------------------------------------------------------------------------------------------

_BY_PLACE = export._by_place()


def _s_top(order: int) -> str:
    ranked = [c[0] for c in sorted(dims.CATEGORIES, key=lambda c: c[order])]
    most = f"greatest({', '.join(dims.SHORT)})"
    return f"CASE WHEN {most} <= 0 THEN NULL " + " ".join(f"WHEN {s} = {most} THEN '{s}Intelligence'" for s in ranked) + " END"


_PRIMARY = "prim AS (SELECT *, CASE WHEN max(is_primary_link) OVER (PARTITION BY doc_id, k) THEN is_primary_link ELSE atype = 'Primary' END AS is_primary FROM acts)"


@query(
    f"{BASE}, {DOC_VECTORS}, {_PRIMARY}, c AS (SELECT doc_id, "
    + ", ".join(f"count(DISTINCT k) FILTER (WHERE category = '{n}' AND is_primary) AS {s}_primary, count(DISTINCT k) FILTER (WHERE category = '{n}' AND is_secondary_link) AS {s}_secondary" for n, s in _BY_PLACE)
    + f" FROM prim GROUP BY doc_id) SELECT doc_id, {_s_top(5)} AS leading, {_V}, c.* EXCLUDE (doc_id) FROM dv LEFT JOIN c USING (doc_id)"
)
def q_export_docs(spark, d):
    acts = _acts(spark, d)
    return export.document_sheet(acts, profile.document_vectors(acts, _fragments(spark, d)))


@query(
    f"{BASE}, {_PRIMARY} SELECT doc_id, k, "
    + ", ".join(f"max(CAST(share AS DOUBLE)) FILTER (WHERE category = '{n}' AND is_primary) AS {s}_primary, max(CAST(share AS DOUBLE)) FILTER (WHERE category = '{n}' AND is_secondary_link) AS {s}_secondary" for n, s in _BY_PLACE)
    + " FROM prim GROUP BY doc_id, k"
)
def q_export_fragments(spark, d):
    return export.fragment_sheet(_acts(spark, d))


@query(f"{BASE}, {DOC_VECTORS} SELECT doc_id, {_s_top(3)} AS leading, " + ", ".join(f"{s} > 0 AS {s}_active" for s in dims.SHORT) + " FROM dv")
def q_batch_rows(spark, d):
    return export.batch_rows(_doc_vectors(spark, d))


@query(
    f"""WITH {FRAGMENTS}, {EVIDENCES}, bad AS (SELECT doc_id FROM resolved WHERE role_name IS NULL OR trim(coalesce(text, '')) = ''), docs AS (SELECT DISTINCT doc_id FROM fragments)
    SELECT count(*) AS documents, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM bad)) AS successes, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM bad)) AS failures FROM docs"""
)
def q_batch_report(spark, d):
    return batch.report(batch.run_log(_fragments(spark, d).select("doc_id").distinct(), evidence.quarantine(_resolved(spark, d))))


_NS = dims.BASE
_TF = f"""SELECT DISTINCT doc_id, unnest([
 {{'s': frag_uri, 'p': '{dims.RDF_TYPE}', 'o': '{_NS}ExplanationFragment'}}, {{'s': doc_id, 'p': '{dims.RDF_TYPE}', 'o': '{_NS}ExplanationDocument'}}, {{'s': frag_uri, 'p': '{dims.RDFS}label', 'o': text}},
 {{'s': doc_id, 'p': '{dims.DCT}hasPart', 'o': frag_uri}}, {{'s': frag_uri, 'p': '{dims.DCT}isPartOf', 'o': doc_id}}, {{'s': frag_uri, 'p': '{dims.DCT}identifier', 'o': CAST(k AS VARCHAR)}},
 {{'s': frag_uri, 'p': '{dims.DCT}type', 'o': CASE WHEN is_title THEN 'title_or_abstract' ELSE 'body' END}}]) AS t FROM fragments"""


@query(f"WITH {FRAGMENTS} SELECT doc_id, t.s AS s, t.p AS p, md5(t.o) AS o_md5 FROM ({_TF})")
def q_triples_fragments(spark, d):
    return triples.of_fragments(_fragments(spark, d)).select("doc_id", "s", "p", F.md5("o").alias("o_md5"))


_LABEL = s_strip("replace(coalesce(text, ''), chr(10), ' ')")
_SLUG = "substr(regexp_replace(regexp_replace(lower(" + s_strip("u.text") + f"), '{SP}+', '-', 'g'), '[^a-z0-9-]', '', 'g'), 1, 32)"


@query(
    f"""{BASE}, e AS (SELECT u.doc_id, f.frag_uri, u.role_name, u.category, u.text, u.doc_id || '#evid-' || printf('%03d', u.k) || '-' || printf('%02d', u.i) || '-' || {_SLUG} AS uri FROM usable u JOIN fragments f USING (doc_id, k)),
    l AS (SELECT doc_id, uri, {_LABEL} AS label FROM e),
    t AS (SELECT DISTINCT doc_id, uri AS s, '{dims.RDF_TYPE}' AS p, '{_NS}' || role_name AS o FROM e UNION SELECT doc_id, uri, '{dims.RDFS}label', CASE WHEN length(label) > 160 THEN substr(label, 1, 157) || '…' ELSE label END FROM l UNION SELECT doc_id, frag_uri, '{_NS}usesElement', uri FROM e UNION SELECT doc_id, uri, '{_NS}evokesIntelligence', '{_NS}' || category FROM e WHERE category IS NOT NULL)
    SELECT doc_id, s, p, o FROM t"""
)
def q_triples_evidences(spark, d):
    rows = triples.of_evidences(_usable(spark, d), _fragments(spark, d))
    return rows.select("doc_id", "s", "p", "o").distinct()


def _s_tri(p: str, s: str, o: str, where: str = "true") -> str:
    return f"SELECT doc_id, {s} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o FROM j WHERE {where}"


@query(
    f"{BASE}, j AS (SELECT a.*, f.frag_uri FROM acts a JOIN fragments f USING (doc_id, k)) "
    + " UNION ".join(
        [
            _s_tri(dims.RDF_TYPE, "act_uri", f"'{_NS}IntelligenceActivation'"),
            _s_tri(_NS + "hasActivationScore", "act_uri", "CAST(share AS DECIMAL(10,4))"),
            _s_tri(_NS + "hasActivationWeight", "act_uri", "weight"),
            _s_tri(dims.IS_ABOUT, "act_uri", f"'{_NS}' || category"),
            _s_tri(_NS + "isAboutFragment", "act_uri", "frag_uri"),
            _s_tri(_NS + "hasActivation", "frag_uri", "act_uri"),
            _s_tri(_NS + "hasActivationType", "act_uri", f"'{_NS}' || atype"),
            _s_tri(_NS + "hasPrimaryActivation", "frag_uri", "act_uri", "is_primary_link"),
            _s_tri(_NS + "hasSecondaryActivation", "frag_uri", "act_uri", "is_secondary_link"),
        ]
    )
)
def q_triples_activations(spark, d):
    return triples.of_activations(_acts(spark, d), _fragments(spark, d)).select("doc_id", "s", "p", "o")


_BASE_OF = "CASE WHEN contains(doc_id, '#') THEN split_part(doc_id, '#', 1) || '#' ELSE regexp_replace(doc_id, '/+$', '') || '#' END"


def _s_vec(p: str, s: str, o: str, kind: str = "literal", datatype: str | None = None) -> str:
    data = f"'{dims.XSD}{datatype}'" if datatype else "CAST(NULL AS VARCHAR)"
    return f"SELECT doc_id, {s} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS o_kind, {data} AS o_datatype, CAST(NULL AS VARCHAR) AS o_lang FROM v WHERE {o} IS NOT NULL"


@query(
    f"""{BASE}, {DOC_VECTORS}, {FRAG_VECTORS}, v AS (SELECT doc_id, {_BASE_OF} || 'vec-doc' AS uri, doc_id AS owner, {", ".join(dims.SHORT)}, mi_vector FROM dv
    UNION ALL SELECT doc_id, {_BASE_OF} || 'vec-frag-' || printf('%03d', k), {_BASE_OF} || 'frag-' || printf('%03d', k), {", ".join(dims.SHORT)}, mi_vector FROM fv) """
    + " UNION ".join(
        [_s_vec(dims.RDF_TYPE, "uri", f"'{_NS}MIProfileVector'", "uri"), _s_vec(_NS + "hasProfileVector", "owner", "uri", "uri"), _s_vec(_NS + "miVector", "uri", "mi_vector")]
        + [_s_vec(_NS + p, "uri", f"CAST({c} AS DECIMAL(10,4))", datatype="decimal") for p, c in zip(dims.SCORE_PROPERTIES, dims.SHORT, strict=True)]
    )
)
def q_triples_vectors(spark, d):
    acts = _acts(spark, d)
    return triples.of_vectors(profile.profile_vectors(acts, _fragments(spark, d)))


@query(f"WITH {FRAGMENTS}, t AS (SELECT doc_id, t.s AS s, t.p AS p, t.o AS o FROM ({_TF})) SELECT p, count(*) AS n FROM (SELECT p FROM t UNION ALL SELECT '{dims.OWL}imports' FROM (SELECT DISTINCT doc_id FROM t)) GROUP BY p")
def q_triples_mode_imports(spark, d):
    return triples.in_mode(triples.of_fragments(_fragments(spark, d)), "instances+imports").groupBy("p").agg(F.count("*").alias("n"))


@query()
def q_entailed(spark, d):
    acts = _acts(spark, d)
    return shapes.entailed(triples.of_activations(acts, _fragments(spark, d))).groupBy("p", F.when(F.col("p") == dims.RDF_TYPE, F.col("o")).alias("cls")).agg(F.count("*").alias("n"))


@query(f"WITH {FRAGMENTS}, t AS (SELECT DISTINCT doc_id, t.s AS s, t.p AS p, t.o AS o FROM ({_TF})) SELECT doc_id, count(*) AS lines FROM t GROUP BY doc_id")
def q_ntriples_lines(spark, d):
    rows = triples.of_fragments(_fragments(spark, d))
    line = sinks.ntriples_line(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")])
    return rows.select("doc_id", line.alias("line")).distinct().groupBy("doc_id").agg(F.count("line").alias("lines"))
