import datetime
import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessella import dims
from tessella.config import PipelineConfig
from tessella.operators import activation, batch, evidence, export, ingest, profile, questions, ranking, shapes, triples
from tessella.plans import pipeline

DAY = datetime.datetime(2024, 1, 1)
P = "doc_id string, k int, frag_uri string, text string, lang string, is_title_or_abstract boolean, run_no int, ingested_at timestamp"
E = "doc_id string, k int, i int, role string, text string, lang string, intelligence string, confidence double, relevance double"


def paragraphs(spark, data):
    return spark.createDataFrame([(d, k, None, t, lang, title, run, DAY) for d, k, t, lang, title, run in data], P)


def test_fragments_keep_the_latest_run(spark):
    df = paragraphs(spark, [("urn:doc:a", 0, "old", "pt", None, 1), ("urn:doc:a", 0, "new", None, True, 2), ("urn:doc:a", 1000, None, " ", None, 1), (None, 1, "x", "pt", None, 1)])
    got = rows(ingest.fragments(df.withColumn("extra", F.lit(1))))
    assert got == [("urn:doc:a", 0, "urn:doc:a#frag-000", "new", "und", True), ("urn:doc:a", 1000, "urn:doc:a#frag-1000", "", "und", False)]
    assert ingest.fragments(df.limit(0)).count() == 0


def test_titles(spark):
    def flags(texts, **options):
        df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, k int, text string")
        return [r["k"] for r in ingest.with_titles(df, **options).where("is_title").orderBy("k").collect()]

    assert flags(["Uma frase.", "Um título", "Outro"]) == [1]
    assert flags(["Uma frase.", "Outra frase."]) == [0]
    assert flags(["x" * 161, "y" * 161]) == [0]
    assert flags(["x" * 161, "y" * 161], force=False) == []
    assert flags(["", "x" * 160, "Resumo: a", "b.", "Abstract: c", "Summary: d"]) == [1, 2, 4]


def test_documents_to_fragments(spark):
    df = spark.createDataFrame([(1, "Título\n\nUma frase. " + "Outra frase longa. " * 10), (2, None), (3, " ")], "id long, text string")
    got = ingest.exploded(ingest.resegmented(ingest.from_text(df, "id", "text"), 80, 20))
    assert {r["doc_id"] for r in got.collect()} == {"1"} and got.count() > 2
    assert rows(ingest.unseen(df, df.where("id = 1"), "id"), "id") == [(2,), (3,)]


def test_resolution_and_scores(spark):
    data = [
        ("d", 0, 0, "Keyword", "a", "pt", "LinguisticIntelligence", 0.5, 0.5), ("d", 0, 0, "Keyword", "a", "pt", "LinguisticIntelligence", 0.5, 0.5),
        ("d", 0, 1, "context-object", "b", "pt", "Espacial-visual", None, 0.5), ("d", 0, 2, "DISCURSIVE_strategy", "c", "pt", "linguística ", 1.0, None),
        ("d", 0, 3, "Marker", "d", "pt", "Linguistic", 1.0, 1.0), ("d", 0, 4, None, "d", "pt", "Linguistic", 1.0, 1.0), ("d", 0, 5, "Keyword", " ", "pt", "Linguistic", 1.0, 1.0),
        ("d", 0, 6, "Keyword", "e", "pt", "linguistic intelligence", 1.0, 1.0), (None, 0, 7, "Keyword", "e", "pt", "Linguistic", 1.0, 1.0),
    ]
    df = spark.createDataFrame(data, E)
    resolved = evidence.resolved(df)
    assert rows(activation.scores(evidence.usable(resolved))) == [("d", 0, "LinguisticIntelligence", 1.35), ("d", 0, "SpatialIntelligence", 0.625)]
    assert rows(activation.scores(evidence.usable(resolved), weighted=False), "score") == [(1.25,), (2.1,)]
    assert rows(evidence.quarantine(resolved), "i", "reason") == [(3, "unknown role"), (4, "no role"), (5, "no text")]
    assert activation.scores(evidence.usable(evidence.resolved(df.limit(0)))).count() == 0


def scored(spark, values):
    return spark.createDataFrame([("d", 0, n, s) for n, s in values], "doc_id string, k int, category string, score double")


def test_activations(spark):
    acts = activation.activations(scored(spark, [("SpatialIntelligence", 3.0), ("MusicalIntelligence", 4.0), ("LinguisticIntelligence", 4.0), ("NaturalistIntelligence", 0.0), (None, 1.0), ("InterpersonalIntelligence", None), ("IntrapersonalIntelligence", -1.0)]))
    got = [(r["category"][:3], str(r["share"]), r["atype"], r["is_primary_link"], r["is_secondary_link"]) for r in acts.orderBy("category").collect()]
    assert got == [("Lin", "0.3636", "Primary", True, False), ("Mus", "0.3636", "Secondary", False, True), ("Spa", "0.2727", "Secondary", False, True)]
    assert acts.first()["act_uri"].startswith("d#act-000-")
    assert rows(activation.metrics(acts)) == [(3, 1, 2, 2)]
    with pytest.raises(ValueError):
        activation.activations(acts, 0.0)


def pair(spark):
    acts = activation.activations(spark.createDataFrame([("d", 0, "LinguisticIntelligence", 1.0), ("d", 1, "SpatialIntelligence", 3.0), ("d", 1, "MusicalIntelligence", 1.0)], "doc_id string, k int, category string, score double"))
    frags = spark.createDataFrame([("d", 0, "d#frag-000", "t", "pt", True), ("d", 1, "d#frag-001", "u", "pt", False), ("d", 2, "d#frag-002", "v", "pt", False), ("e", 0, "e#frag-000", "", "pt", False)], "doc_id string, k int, frag_uri string, text string, lang string, is_title boolean")
    return acts, frags


def test_vectors(spark):
    acts, frags = pair(spark)
    doc = profile.document_vectors(acts, frags).first()
    assert doc["mi_vector"] == "56.52,0.00,32.61,10.87,0.00,0.00,0.00,0.00" and str(doc["Spatial"]) == "0.3261"
    assert [r["mi_vector"] for r in profile.fragment_vectors(acts).orderBy("k").collect()] == ["100.00" + ",0.00" * 7, "0.00,0.00,75.00,25.00" + ",0.00" * 4]
    both = profile.profile_vectors(acts, frags)
    assert sorted(r["vec_uri"] for r in both.collect()) == ["d#vec-doc", "d#vec-frag-000", "d#vec-frag-001"]
    filled = profile.completed(both.select("doc_id", "mi_vector", *[F.lit(None).cast("double").alias(s) for s in dims.SHORT])).where("Spatial > 0.5").first()
    assert filled["Spatial"] == 0.75 and filled["Musical"] == 0.25
    assert profile.top_category(both) is not None and rows(both.select("vec_uri", profile.top_category(both).alias("t")))[0] == ("d#vec-doc", "LinguisticIntelligence")


def test_questions(spark):
    acts, frags = pair(spark)
    els = spark.createDataFrame([("d", 2, 0, "Keyword", "x", "NaturalistIntelligence")], "doc_id string, k int, i int, role_name string, text string, category string")
    assert questions.evoked(acts, els, frags).count() == 8 and questions.evoked(acts, els, frags, "pt").count() == 4
    assert questions.elements_and_activations(acts, els).count() == 4
    assert rows(questions.summary(acts).where("whole_document = 1"), "category", "n") == [("LinguisticIntelligence", 1), ("MusicalIntelligence", 1), ("SpatialIntelligence", 1)]
    assert rows(questions.standouts(acts), "k", "category", "tied") == [(0, "LinguisticIntelligence", False), (1, "SpatialIntelligence", False)]
    tied = spark.createDataFrame([("d", 0, f"a{i}", n, 0.5, "Secondary") for i, n in enumerate(["SpatialIntelligence", "MusicalIntelligence"])], "doc_id string, k int, act_uri string, category string, share double, atype string")
    lines = [r["line"] for r in questions.report_lines(tied, profile.document_vectors(acts, frags), frags).orderBy("part", "k", "n").collect()]
    assert lines[9:15] == ["[Documento — Fragmentos] d", "", "[Fragmento] t", "  > TOP (empate):", "    - Espacial-visual (score=0.5000, tipo=Secondary)", "    - Musical (score=0.5000, tipo=Secondary)"]
    assert rows(questions.metrics(tied)) == [(2, 1, 1)]
    assert rows(questions.elements_by_category(els), "elements") == [("Keyword:x",)]
    named = spark.createDataFrame([(" ", "b", "u"), (None, None, "u")], "a string, b string, u string")
    assert [r[0] for r in named.select(questions.document_label([F.col("a"), F.col("b")], F.col("u"))).collect()] == ["b", "u"]
    assert rows(questions.leading(profile.document_vectors(acts, frags)), "place", "category")[:2] == [(1, "LinguisticIntelligence"), (2, "SpatialIntelligence")]
    assert questions.categories_below(spark).count() == 8


def test_constraints(spark):
    acts, frags = pair(spark)
    els = spark.createDataFrame([], "doc_id string, k int, i int, role_name string, text string, category string")
    assert rows(shapes.fragment_violations(frags, els, acts), "focus_node", "component") == [("d#frag-002", "Or"), ("e#frag-000", "Or")]
    twice = acts.withColumn("is_primary_link", F.lit(True))
    assert ("d#frag-001", "MaxCount") in rows(shapes.fragment_violations(frags, els, twice), "focus_node", "component")
    bad = spark.createDataFrame([("d", "a", "Nothing", 2.0, "Other", True, True)], "doc_id string, act_uri string, category string, share double, atype string, is_primary_link boolean, is_secondary_link boolean")
    assert shapes.activation_violations(bad).count() == 5 and shapes.activation_violations(acts).count() == 0
    vec = profile.profile_vectors(acts, frags)
    assert shapes.vector_violations(vec).count() == 0
    assert rows(shapes.vector_violations(vec.limit(1).withColumn("mi_vector", F.lit("1,2"))), "severity") == [("Warning",)]
    assert shapes.vector_violations(vec.limit(1).withColumn("mi_vector", F.lit(None).cast("string")).withColumn("Spatial", F.lit(2))).count() == 1
    docs = frags.select("doc_id").distinct()
    assert rows(shapes.document_violations(docs, frags, vec.where("scope = 'document'")), "focus_node", "path") == [("e", "hasProfileVector")]
    lone = spark.createDataFrame([("z",)], "doc_id string")
    assert shapes.document_violations(lone, frags, vec).count() == 2
    assert shapes.backlink_violations(frags, frags.where("k = 0")).count() == 2
    warned = shapes.vector_violations(vec.where("scope = 'document'").withColumn("mi_vector", F.lit("1")))
    assert rows(shapes.report(docs, warned)) == [("d", True, 1), ("e", True, 0)]


def test_entailment(spark):
    acts, frags = pair(spark)
    out = shapes.entailed(triples.of_activations(acts, frags))
    types = {r["o"].rpartition("#")[2] for r in out.where(F.col("p") == dims.RDF_TYPE).select("o").distinct().collect()}
    assert types == {"IntelligenceActivation", "ExplanationFragment", "InformationContentEntity"} or "IntelligenceActivation" in types


def test_triples(spark):
    acts, frags = pair(spark)
    t = triples.of_fragments(frags)
    assert t.count() == 4 * 6 + 2 and triples.in_mode(t, "instances+imports").count() == t.count() + 2
    assert triples.in_mode(t, "full").count() > t.count()
    with pytest.raises(ValueError):
        triples.in_mode(t, "other")
    a = triples.of_activations(acts, frags)
    assert a.where(F.col("p").endswith("hasPrimaryActivation")).count() == 2 and a.where(F.col("p").endswith("hasSecondaryActivation")).count() == 0
    assert triples.unknown_classes(a).count() == 0
    odd = a.where(F.col("p") == dims.RDF_TYPE).withColumn("o", F.lit(dims.BASE + "Nothing"))
    assert rows(triples.unknown_classes(odd)) == [(dims.BASE + "Nothing", 3)]
    assert triples.upserted(a, odd).where(F.col("o").endswith("Nothing")).count() == 3
    assert triples.without(a, a.limit(1)).count() < a.count()
    assert triples.of_vectors(profile.profile_vectors(acts, frags)).count() == 3 * 11


def test_ranking(spark):
    df = spark.createDataFrame([("b", [1.0] * 8), ("a", [2.0] * 8), ("z", [0.0] * 8), ("s", [1.0] + [0.0] * 7)], "doc_id string, vector array<double>")
    prof = dims.profiles(spark)
    top = ranking.ranked(ranking.scored(df, prof.where("key = 'P11-GLOB'")), 0)
    assert rows(top, "doc_id", "score") == [("a", 1.0)]
    assert ranking.ranked(ranking.scored(df, prof), 99).count() == 44
    assert rows(ranking.scored(df, prof.where("key = 'P1-LING'"), ["Spatial"]).where("doc_id = 's'"), "score") == [(0.0,)]
    assert rows(ranking.like_document(df, "s", 1), "doc_id") == [("s",)] and rows(ranking.like_document(df, "none", 1), "key") == [("a",)]
    with pytest.raises(KeyError):
        ranking.chosen_profiles(prof, ["P0"])
    assert ranking.chosen_profiles(prof, ["all"]).count() == 11 and ranking.chosen_profiles(prof, [" ", "P8-NAT"]).count() == 1
    scores = spark.createDataFrame([("k", str(i), float(i // 2)) for i in range(10)], "key string, doc_id string, score double")
    assert rows(ranking.rank_correlation(scores.withColumn("again", F.col("score")), "score", "again")) == [("k", 1.0, 10)]
    assert rows(ranking.rank_correlation(scores.withColumn("down", -F.col("score")), "score", "down"), "spearman") == [(-1.0,)]
    assert rows(ranking.sanity(df)) == [(4, 0, 1)]


def test_exports_and_batch(spark):
    acts, frags = pair(spark)
    sheet = export.document_sheet(acts, profile.document_vectors(acts, frags)).first()
    assert sheet["leading"] == "LinguisticIntelligence" and sheet["Spatial_primary"] == 1 and sheet["Musical_primary"] == 0
    assert rows(export.fragment_sheet(acts), "k", "Spatial_primary", "Linguistic_primary") == [(0, None, 1.0), (1, 0.75, None)]
    assert export.batch_rows(profile.document_vectors(acts, frags)).first()["Musical_active"] is True
    log = batch.run_log(frags.select("doc_id").distinct(), spark.createDataFrame([("e",)], "doc_id string"))
    assert rows(batch.report(log)) == [(2, 1, 1)] and batch.exit_code(log) == 2


def test_keywords_and_merge(spark):
    text = "A professora mostra formigas. As formigas vermelhas andam na horta. Crianças observam formigas vermelhas."
    frags = spark.createDataFrame([("d", 0, text, "pt"), ("d", 1, "", "pt"), ("d", 2, None, "pt")], "doc_id string, k int, text string, lang string")
    found = {r["term"]: r["score"] for r in evidence.keywords(frags).collect()}
    assert found["formigas vermelhas"] < found["andam"] and all(s > 0 for s in found.values())
    kept = [r["term"] for r in evidence.reduced(evidence.limited(evidence.keywords(frags))).orderBy("i").collect()]
    assert all(f" {a} " not in f" {b} " for n, a in enumerate(kept) for b in kept[:n])
    noted = evidence.annotated(frags)
    assert "NaturalistIntelligence" in {r["intelligence"] for r in noted.collect()} and noted.where("confidence > 0.81 or confidence <= 0").count() == 0
    data = [("d", 0, 1, "Keyword", "Mar", "pt", "Musical", 0.2, 0.9), ("d", 0, 0, "keyword", "mar", "en", "Musical", 0.7, 2.0)]
    one = evidence.merged(evidence.usable(evidence.resolved(spark.createDataFrame(data, E)))).first()
    assert (one["text"], one["lang"], one["confidence"], one["relevance"], one["n"]) == ("mar", "en", 0.7, 1.0, 2)


def test_annotator_is_guarded(spark):
    frags = spark.createDataFrame([("d", 0, "O mar azul", "pt")], "doc_id string, k int, text string, lang string")

    def model(batches):
        import pandas as pd

        for b in batches:
            for d, k, _ in b.itertuples(index=False):
                yield pd.DataFrame([(d, k, role, t, "NaturalistIntelligence", 0.9, 0.8) for role, t in (("context_object", "MAR"), ("Keyword", "lua"), ("Other", "mar"))], columns=["doc_id", "k", "role", "text", "intelligence", "confidence", "relevance"])

    assert rows(evidence.annotated(frags, model).where("i = 1000"), "role", "text") == [("context_object", "MAR")]


def test_lists_and_replies(spark):
    df = spark.createDataFrame([(["3", "x", "9", "3", "0", None],)], "a array<string>")
    assert df.select(evidence.names_of(evidence.valid_indexes(F.col("a")))).first()[0] == ["BodilyKinestheticIntelligence", "LinguisticIntelligence"]
    replies = ['```json\n{"a": [1, 2,],}\n``` bye', 'so {"b": {"c": 1}} x', "none", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in replies], "r string").select(evidence.repaired(F.col("r"))).collect()]
    assert [g and json.loads(g) for g in got] == [{"a": [1, 2]}, {"b": {"c": 1}}, None, None]


def test_whole_pipeline(spark):
    data = paragraphs(spark, [("urn:doc:a", 0, "Observar formigas na horta", "pt", True, 1), ("urn:doc:a", 1, "As crianças observam formigas e folhas secas. Depois contam os passos.", "pt", False, 1)])
    out = pipeline.run(data)
    assert out.activations.count() > 0 and out.vectors.where("scope = 'document'").count() == 1 and out.violations is not None
    part = pipeline.run(data, config=PipelineConfig(stages=("s1", "s2", "s4")))
    assert part.fragments is not None and part.activations is None
    for bad in ({"theta": 2}, {"norm": "x"}, {"scope": "x"}, {"graph_mode": "x"}, {"inference": "owl"}):
        with pytest.raises(ValueError):
            PipelineConfig(**bad)


# Two documents with known results: raw scores per fragment, title flags, then shares, vectors and report lines.
KNOWN = {
    "urn:doc:10": (
        [
            {"Linguistic": 0.4313986477746436, "BodilyKinesthetic": 0.8088677458949873, "Naturalist": 0.40443387294749367, "Interpersonal": 0.624425109932994, "LogicalMathematical": 0.33710401776836085},
            {"Linguistic": 2.610496543921958, "LogicalMathematical": 0.2790749355398803, "BodilyKinesthetic": 0.2790749355398803, "Musical": 0.4859391630901288},
            {"Interpersonal": 1.7731432763807145, "BodilyKinesthetic": 0.7149796400883357, "Linguistic": 0.5729631362351731},
        ],
        2,
        ["16.55,12.93,0.00,0.00,31.04,23.96,0.00,15.52", "71.42,7.64,0.00,13.30,7.64,0.00,0.00,0.00", "18.72,0.00,0.00,0.00,23.36,57.92,0.00,0.00"],
        "34.03,6.23,0.00,4.03,20.92,30.08,0.00,4.70",
        {(0, "Interpersonal")},
    ),
    "urn:doc:107": (
        [{"Naturalist": 1.4133001334610946, "Spatial": 1.9591295425855202}, {"Naturalist": 2.545474408046264, "BodilyKinesthetic": 1.8735704516848815}],
        0,
        ["0.00,0.00,58.09,0.00,0.00,0.00,0.00,41.91", "0.00,0.00,0.00,0.00,42.40,0.00,0.00,57.60"],
        "0.00,0.00,32.83,0.00,18.43,0.00,0.00,48.73",
        set(),
    ),
}


@pytest.mark.parametrize("doc", sorted(KNOWN))
def test_known_documents(spark, doc):
    per_fragment, title, frag_texts, doc_text, linked = KNOWN[doc]
    acts = activation.activations(spark.createDataFrame([(doc, k, f"{n}Intelligence", s) for k, by in enumerate(per_fragment) for n, s in by.items()], "doc_id string, k int, category string, score double"))
    frags = spark.createDataFrame([(doc, k, f"{doc}#frag-{k:03d}", f"texto {k}", "pt", k == title) for k in range(len(per_fragment))], "doc_id string, k int, frag_uri string, text string, lang string, is_title boolean")
    assert [r["mi_vector"] for r in profile.fragment_vectors(acts).orderBy("k").collect()] == frag_texts
    vectors = profile.document_vectors(acts, frags)
    assert vectors.first()["mi_vector"] == doc_text
    assert {(r["k"], r["category"].removesuffix("Intelligence")) for r in acts.where("is_secondary_link").collect()} == linked
    if doc == "urn:doc:107":
        lines = [r["line"] for r in questions.report_lines(acts, vectors, frags).orderBy("part", "k", "n").collect()]
        assert lines == [
            "[Documento] urn:doc:107", "  - miVector: 0.00,0.00,32.83,0.00,18.43,0.00,0.00,48.73", "  - TOP (documento): Naturalist (score=0.4873)", "  - Ranking (top 3):",
            "      • Naturalist: 0.4873", "      • Spatial: 0.3283", "      • Bodily-Kinesthetic: 0.1843", "", "", "[Documento — Fragmentos] urn:doc:107", "",
            "[Fragmento] texto 0", "  > TOP: Espacial-visual (score=0.5809, tipo=Primary)", "", "[Fragmento] texto 1", "  > TOP: Naturalista (score=0.5760, tipo=Primary)", "",
        ]


def test_valid_profiles(spark):
    good = spark.createDataFrame([("a", [1.0] * 8), ("b", [0.0] * 7 + [4.0])], "key string, vector array<double>")
    assert [r["vector"] for r in ranking.valid_profiles(good).orderBy("key").collect()] == [[0.125] * 8, [0.0] * 7 + [1.0]]
    for bad in ([1.0] * 7, [-1.0] + [1.0] * 7, [0.0] * 8, None, [float("nan")] + [1.0] * 7):
        with pytest.raises(Exception, match="no valid profile: x"):
            ranking.valid_profiles(spark.createDataFrame([("x", bad)], "key string, vector array<double>")).collect()


def test_question_lines(spark):
    """The reports of questions 1 and 2 in their order, of one fragment with an element and two activations, one of them without a score."""
    acts = spark.createDataFrame([("d", 1, "d#a1", "MusicalIntelligence", 0.75, "Primary"), ("d", 1, "d#a2", "LinguisticIntelligence", 0.0, "Secondary")], "doc_id string, k int, act_uri string, category string, share double, atype string")
    elements = spark.createDataFrame([("d", 1, "MusicalIntelligence", "Keyword", "som")], "doc_id string, k int, category string, role_name string, text string")
    frags = spark.createDataFrame([("d", 1, "d#frag-001", "Um texto"), ("d", 2, "d#frag-002", "Nada")], "doc_id string, k int, frag_uri string, text string")
    order = lambda df: [r["line"] for r in df.orderBy("part", "k", "place").collect()]
    names = {r["category"]: r["label"] for r in questions.labels(spark).where("label_lang = 'pt'").collect()}
    musical, linguistic = names["MusicalIntelligence"], names["LinguisticIntelligence"]
    assert order(questions.evoked_lines(acts, elements, frags, "pt")) == [
        "[Documento] d", "", "[Fragmento] Um texto", *sorted([f"  - {linguistic} (via activation)", f"  - {musical} (via activation, score=0.7500)"]), f"  - {musical} (via element)", "",
    ]
    got = order(questions.elements_lines(acts, elements, frags))
    assert got[0] == "[Documento] d" and got.index(f"  > Inteligência (doc): {musical}") > got.index(f"  > Inteligência (doc): {linguistic}")
    assert "    - Ativações (doc): n=1, primárias=1, secundárias=0, max=0.7500" in got and got[got.index("    - Elementos:") + 1] == "        • Keyword: som"
    assert got[-1] == "        • score=0.7500, tipo=Primary" and questions.evoked_lines(acts.limit(0), elements.limit(0), frags).count() == 0


def test_labels_in_turn(spark):
    """Listed indexes and names come first, then triggers (of several words, too), then the last resort; what has none is dropped."""
    own = spark.createDataFrame([("Musical", "pt", " canto coral "), ("MusicalIntelligence", "pt", "canto coral"), ("Espacial", "pt", None)], "intelligence string, lang string, term string")
    triggers = evidence.triggers_from(own)
    assert triggers == [("MusicalIntelligence", "pt", "canto coral")]
    with pytest.raises(ValueError, match="unknown categories: x"):
        evidence.triggers_from(spark.createDataFrame([("x", "pt", "y")], "intelligence string, lang string, term string"))
    schema = "doc_id string, k int, role string, text string, lang string, mi_idx array<string>, intelligence string, confidence double, relevance double, category string"
    items = [
        ("d", 1, "Keyword", "um Canto Coral", None, None, None, 1.0, 2.0, "x"), ("d", 1, "Keyword", "UM canto coral", "es", None, None, 0.5, None, "x"),
        ("d", 1, "Keyword", "canto coral", "pt", ["0", "9", "x"], "Musical", None, 0.1, "x"), ("d", 2, "Keyword", "a flora", "pt", None, "??", 1.0, 1.0, "x"),
        ("d", 2, "Keyword", "nada", "pt", [], None, 1.0, 1.0, "x"), ("d", 2, " ", "flora", "pt", None, None, 1.0, 1.0, "x"), ("d", 2, "Keyword", None, "pt", None, "Musical", 1.0, 1.0, "x"),
    ]
    got = {(r["k"], r["text_key"], r["intelligence"]): (round(r["confidence"], 6), r["relevance"], r["lang"]) for r in evidence.labelled(spark.createDataFrame(items, schema), triggers).collect()}
    assert got == {
        (1, "um canto coral", "MusicalIntelligence"): (0.65, 1.0, "es"), (1, "canto coral", dims.BY_INDEX[0]): (0.675, 0.1, "pt"), (1, "canto coral", "MusicalIntelligence"): (0.675, 0.1, "pt"),
        (2, "a flora", "NaturalistIntelligence"): (0.5, 1.0, "pt"),
    }
    assert evidence.labelled(spark.createDataFrame([], schema)).count() == 0


def test_report_of_violations(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    bad = spark.createDataFrame([("a", "a#f", "Fragment", "Or", "usesElement", None, "Violation")] * 2, "doc_id string, focus_node string, source_shape string, component string, path string, value string, severity string")
    lines = {d: [r["line"] for r in shapes.report_lines(docs, bad).where(F.col("doc_id") == d).orderBy("place").collect()] for d in "ab"}
    assert lines["b"] == ["Validation Report", "Conforms: True"]
    assert lines["a"][:4] == ["Validation Report", "Conforms: False", "Results (1):", f"Constraint Violation in OrConstraintComponent ({shapes.SH}OrConstraintComponent):"]
    assert lines["a"][4:] == ["\tSeverity: sh:Violation", "\tSource Shape: onto:FragmentShape", "\tFocus Node: <a#f>", "\tValue Node: <a#f>", "\tPath: usesElement"]
    got = shapes.report_triples(docs, bad)
    assert got.where(F.col("p") == shapes.SH + "result").count() == 1 and got.where(F.col("p") == shapes.SH + "conforms").count() == 2
    assert shapes.report_triples(docs.limit(0), bad.limit(0)).count() == 0
