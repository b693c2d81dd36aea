import json
import zipfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessella.sources import files, sinks, turtle
from tessella.streaming import incremental


def test_texts(spark, tmp_path):
    (tmp_path / "b ç.txt").write_text("dois\nlinhas", encoding="utf-8")
    (tmp_path / "a.txt").write_text("um", encoding="utf-8")
    (tmp_path / "c.md").write_text("não", encoding="utf-8")
    assert rows(files.text_files(spark, str(tmp_path)), "doc_id", "text") == [("urn:doc:a", "um"), ("urn:doc:b_ç", "dois\nlinhas")]
    assert files.source(spark, "só um texto").first()["text"] == "só um texto"
    assert files.source(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):
        files.source(spark, "https://x.example")


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"doc_id": "d", "paragraphs": [{"k": 0, "text": "a", "lang": "pt"}, {"text": "no k"}]}), encoding="utf-8")
    (tmp_path / "e.json").write_text(json.dumps({"paragraphs": [{"k": 0, "text": "a"}]}), encoding="utf-8")
    assert rows(files.json_documents(spark, str(tmp_path)), "doc_id", "k", "text") == [("d", 0, "a")]
    df = spark.createDataFrame([("d", '{"0": [{"role": "Keyword", "text": "a", "confidence": "0.5"}, {"role": "x", "relevance": 1}], "y": [{"role": "z"}]}'), ("e", "no json"), ("f", None)], "doc_id string, p string")
    assert rows(files.payload(df, "p"), "doc_id", "k", "i", "role", "confidence", "relevance") == [("d", 0, 0, "Keyword", 0.5, None), ("d", 0, 1, "x", None, 1.0)]


TTL = '''@prefix onto: <urn:tessella:profile#> . @prefix x: <urn:x#> .
# a comment
x:vec-doc a onto:MIProfileVector ; onto:miVector "10.00,20.00,30.00,40.00,0.00,0.00,0.00,0.00"@pt , "z" ; onto:n 3 , 4.5 , 1e3 ; .
x:vec-frag-001 a onto:MIProfileVector ; onto:miVector "1,1,1,1,1,1,1,1" .
<urn:y#v> a onto:MIProfile ; onto:hasLinguisticScore 0.1 ; onto:hasLogicalMathematicalScore 0.2 ; onto:hasSpatialScore 0.1 ; onto:hasMusicalScore 0.1 ;
  onto:hasBodilyKinestheticScore 0.1 ; onto:hasInterpersonalScore 0.1 ; onto:hasIntrapersonalScore 0.1 ; onto:hasNaturalistScore "0.2"^^<http://www.w3.org/2001/XMLSchema#decimal> .
[] onto:p ( x:a "b" ) ; onto:q [ onto:r true ] . x:s onto:t """long "quoted"
text""" , "tab\\t\\u00e9" .
'''


def test_turtle(spark, tmp_path):
    found = turtle.Document(TTL).triples()
    assert ("urn:x#s", "urn:tessella:profile#t", 'long "quoted"\ntext', "literal", None, None) in found
    assert ("urn:x#s", "urn:tessella:profile#t", "tab\té", "literal", None, None) in found
    assert sum(t[1].endswith("#first") for t in found) == 2 and any(t[2] == "4.5" and t[4].endswith("decimal") for t in found)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.ttl").write_text(TTL.replace(' , "z"', ""), encoding="utf-8")
    (tmp_path / "bad.ttl").write_text("x:no prefix here", encoding="utf-8")
    triples = files.turtle_files(spark, str(tmp_path))
    assert triples.where("error IS NOT NULL").count() == 1
    docs = {r["doc_id"]: r["vector"] for r in files.loaded_documents(triples).collect()}
    assert docs == {"urn:x#vec-doc": [10, 20, 30, 40, 0, 0, 0, 0], "urn:y#v": [0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.2]}
    assert len(files.loaded_documents(triples, document_scope=False).collect()) == 3


def test_ntriples_round_trip(spark, tmp_path):
    data = [("d", "urn:s", "urn:p", 'a "b"\n\\c', "literal", None, "pt"), ("d", "urn:s", "urn:p", "urn:o", "uri", None, None), ("d", "urn:s", "urn:q", "1", "literal", "http://www.w3.org/2001/XMLSchema#integer", None)]
    df = spark.createDataFrame(data, "doc_id string, s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    sinks.write_ntriples(df, str(tmp_path / "out"))
    back = files.turtle_files(spark, str(tmp_path / "out"), "*.txt")
    assert rows(back, "s", "p", "o", "o_kind", "o_datatype", "o_lang") == rows(df, "s", "p", "o", "o_kind", "o_datatype", "o_lang")


def test_workbook_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 1, 0.5, None, True)], "t string, n int, x double, z string, b boolean")
    sinks.write_workbook({"documents": df, "fragments": df}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
    assert "a &amp; b" in sheet and 'ySplit="1"' in sheet and "autoFilter" in sheet
    with pytest.raises(ValueError):
        sinks.write_workbook({"s": df}, str(tmp_path / "w.xlsx"), most_rows=0)
    lines = spark.createDataFrame([("d", 1, 0, 2, "b"), ("d", 0, 5, 1, "a")], "doc_id string, part int, k int, n int, line string")
    sinks.write_lines(lines, str(tmp_path / "lines"))
    parts = sorted((tmp_path / "lines" / "doc_id=d").glob("*.txt"))
    assert "".join(p.read_text() for p in parts) == "a\nb\n"
    sinks.write_lines(lines.drop("n").withColumn("place", F.lit("x")), str(tmp_path / "ranges"), folders=False)
    assert "".join(p.read_text() for p in sorted((tmp_path / "ranges").glob("*.txt"))) == "a\nb\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Um parágrafo.\n\nOutro.", encoding="utf-8")
    got = []
    stream = incremental.fragment_stream(incremental.text_stream(spark, str(tmp_path / "in")))
    for _ in range(2):
        incremental.run_once(stream, str(tmp_path / "cp"), lambda df, n: got.extend(r["text"] for r in df.collect()))
    assert sorted(got) == ["Outro.", "Um parágrafo."]
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t, 1 AS r UNION ALL SELECT timestamp'2024-01-01 23:00:00', 1")
    assert incremental.daily_arrivals(df, "t", ["r"]).select(F.sum("n")).first()[0] == 2
