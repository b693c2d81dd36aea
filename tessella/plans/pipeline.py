"""All stages as one lazy plan over the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..operators import activation, evidence, ingest, profile, questions, shapes, triples


@dataclass
class Stages:
    """What each stage yields; a stage that doesn't run has None."""

    fragments: DataFrame | None = None
    fragment_triples: DataFrame | None = None
    evidences: DataFrame | None = None
    quarantine: DataFrame | None = None
    activations: DataFrame | None = None
    vectors: DataFrame | None = None
    standouts: DataFrame | None = None
    violations: DataFrame | None = None


def weights(config: PipelineConfig) -> dict[str, float]:
    return {"Keyword": config.w_keyword, "ContextObject": config.w_context_object, "DiscursiveStrategy": config.w_discursive_strategy}


def run(paragraphs: DataFrame, evidences: DataFrame | None = None, config: PipelineConfig | None = None) -> Stages:
    """The stages over stored paragraphs and evidence; without evidence it is annotated from the texts."""
    config = config or PipelineConfig()
    on, out = config.enabled(), Stages()
    if "s1" in on:
        out.fragments = ingest.fragments(paragraphs)
    if "s2" in on:
        out.fragment_triples = triples.in_mode(triples.of_fragments(out.fragments), config.graph_mode)
    if "s3" in on:
        found = evidences if evidences is not None else evidence.annotated(out.fragments, double_discount=config.double_discount)
        resolved = evidence.resolved(found, weights(config))
        out.evidences, out.quarantine = evidence.usable(resolved), evidence.quarantine(resolved)
    if "s4" in on:
        known = out.evidences.join(out.fragments.select("doc_id", "k"), ["doc_id", "k"], "left_semi")
        out.activations = activation.activations(activation.scores(known), config.theta)
    if "s5" in on:
        out.vectors = profile.profile_vectors(out.activations, out.fragments, config.scope, norm=config.norm, tau=config.tau, alpha_title=config.alpha_title, alpha_body=config.alpha_body)
    if "s6" in on:
        out.standouts = questions.standouts(out.activations)
    if "s7" in on:
        docs = out.fragments.select("doc_id").distinct()
        found = shapes.fragment_violations(out.fragments, out.evidences, out.activations).unionByName(shapes.activation_violations(out.activations)).unionByName(shapes.vector_violations(out.vectors))
        out.violations = found.unionByName(shapes.document_violations(docs, out.fragments, out.vectors.where(F.col("scope") == "document")))
    return out
