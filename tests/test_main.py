from tessella.__main__ import main


def test_run_over_texts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "jogo 1.txt").write_text("Observar formigas\n\nAs crianças observam formigas e folhas secas na horta. Depois contam os passos.", encoding="utf-8")
    out = tmp_path / "out"
    assert main(["--texts", str(folder), "--out", str(out), "--theta", "0.5"]) == 0
    assert spark.read.parquet(str(out / "vectors")).where("scope = 'document'").count() == 1
    assert spark.read.parquet(str(out / "conformance")).count() == 1
    assert "[Documento] urn:doc:jogo_1" in spark.read.text(str(out / "report"), wholetext=True).first()["value"]
    known = str(tmp_path / "known")
    spark.read.parquet(str(out / "fragments")).select("doc_id").write.parquet(known)
    assert main(["--texts", str(folder), "--out", str(tmp_path / "again"), "--known", known, "--stages", "s1,s2"]) == 0
    assert spark.read.parquet(str(tmp_path / "again" / "fragments")).count() == 0
