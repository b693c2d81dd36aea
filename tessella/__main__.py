"""Run the pipeline over tables or text files: ``python -m tessella --paragraphs DIR --out DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import STAGES, PipelineConfig
from .operators import batch, export, ingest, profile, questions, shapes, triples
from .plans import pipeline
from .shared import ship
from .sources import files, sinks


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="tessella")
    given = a.add_mutually_exclusive_group(required=True)
    given.add_argument("--paragraphs", help="Parquet of paragraphs (doc_id, k, frag_uri, text, lang, is_title_or_abstract, run_no, ingested_at)")
    given.add_argument("--texts", help="folder of text files")
    a.add_argument("--evidences", help="Parquet of evidence; without it the texts are annotated")
    a.add_argument("--out", required=True)
    a.add_argument("--known", help="Parquet of documents already ingested (doc_id); they are skipped")
    a.add_argument("--stages", default=",".join(STAGES))
    for name, kind in (("theta", float), ("alpha-title", float), ("alpha-body", float), ("norm", str), ("tau", float), ("scope", str), ("graph-mode", str), ("inference", str), ("w-keyword", float), ("w-context-object", float), ("w-discursive-strategy", float), ("split-max-chars", int), ("split-min-chars", int), ("title-scan-k", int), ("title-max-chars", int), ("lang-hint", str)):
        a.add_argument(f"--{name}", type=kind)
    args = a.parse_args(argv)
    options = {k: v for k, v in vars(args).items() if v is not None and k in PipelineConfig.__dataclass_fields__ and k != "stages"}
    config = PipelineConfig(**options, stages=tuple(s.strip() for s in args.stages.split(",") if s.strip()))
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args.texts:
        rows = ingest.exploded(ingest.resegmented(ingest.from_text(files.text_files(spark, args.texts), "doc_id", "text"), config.split_max_chars, config.split_min_chars))
        rows = ingest.with_titles(ingest.limited_language(rows, config.lang_hint), config.title_scan_k, config.title_max_chars, config.force_title)
        paragraphs = rows.select("doc_id", "k", F.lit(None).cast("string").alias("frag_uri"), "text", "lang", F.col("is_title").alias("is_title_or_abstract"), F.lit(0).alias("run_no"), F.lit(None).cast("timestamp").alias("ingested_at"))
    else:
        paragraphs = spark.read.parquet(args.paragraphs)
    if args.known:
        paragraphs = ingest.unseen(paragraphs, spark.read.parquet(args.known))
    out = pipeline.run(paragraphs, spark.read.parquet(args.evidences) if args.evidences else None, config)

    def save(df, name: str):
        """Written, and read back, so that later stages don't compute it again."""
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        return spark.read.parquet(f"{args.out}/{name}")

    if out.fragments is not None:
        out.fragments = save(out.fragments, "fragments")
    if out.fragment_triples is not None:
        sinks.write_ntriples(out.fragment_triples, f"{args.out}/fragment_triples")
    log = None
    if out.evidences is not None:
        save(out.evidences, "evidences")
        log = save(batch.run_log(out.fragments.select("doc_id").distinct(), save(out.quarantine, "quarantine")), "run_log")
        sinks.write_json(batch.report(log), f"{args.out}/batch_report")
    if out.activations is not None:
        acts = save(out.activations, "activations")
        graph = triples.of_activations(acts, out.fragments)
        sinks.write_ntriples(shapes.entailed(graph) if config.inference == "rdfs" else graph, f"{args.out}/activation_triples")
        sinks.write_sheet(export.fragment_sheet(acts), f"{args.out}/fragment_sheet")
    if out.vectors is not None:
        vectors = save(out.vectors, "vectors")
        sinks.write_ntriples(triples.of_vectors(vectors), f"{args.out}/vector_triples")
        docs = profile.document_vectors(acts, out.fragments, config.norm, config.tau, config.alpha_title, config.alpha_body)
        sinks.write_sheet(export.document_sheet(acts, docs), f"{args.out}/document_sheet")
        if out.standouts is not None:
            sinks.write_lines(questions.report_lines(acts, docs, out.fragments), f"{args.out}/report")
            elements = spark.read.parquet(f"{args.out}/evidences")
            sinks.write_lines(questions.evoked_lines(acts, elements, out.fragments), f"{args.out}/report_evoked", folders=False)
            sinks.write_lines(questions.elements_lines(acts, elements, out.fragments), f"{args.out}/report_elements", folders=False)
    if out.violations is not None:
        found = save(out.violations, "violations")
        docs = out.fragments.select("doc_id").distinct()
        save(shapes.report(docs, found), "conformance")
        sinks.write_lines(shapes.report_lines(docs, found), f"{args.out}/report_validation", folders=False)
        sinks.write_ntriples(shapes.report_triples(docs, found), f"{args.out}/validation_triples")
    return batch.exit_code(log) if log is not None else 0


if __name__ == "__main__":
    raise SystemExit(main())
