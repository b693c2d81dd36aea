"""Settings of the pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stages in their order; a stage runs only if all before it do.
STAGES = ("s1", "s2", "s3", "s4", "s5", "s6", "s7")


@dataclass(frozen=True)
class PipelineConfig:
    split_long: bool = True
    split_max_chars: int = 900
    split_min_chars: int = 120
    force_title: bool = True
    title_scan_k: int = 3
    title_max_chars: int = 160
    lang_hint: str | None = None
    w_keyword: float = 1.0
    w_context_object: float = 1.25
    w_discursive_strategy: float = 1.1
    theta: float = 0.75
    alpha_title: float = 1.3
    alpha_body: float = 1.0
    norm: str = "l1"
    tau: float = 1.0
    scope: str = "both"
    graph_mode: str = "instances"
    inference: str = "rdfs"
    double_discount: bool = True
    stages: tuple[str, ...] = field(default=STAGES)

    def __post_init__(self) -> None:
        if not 0 < self.theta <= 1:
            raise ValueError("theta must be above 0 and at most 1")
        if self.norm not in ("l1", "l2", "softmax"):
            raise ValueError(f"unknown norm {self.norm}")
        if self.scope not in ("document", "fragment", "both"):
            raise ValueError(f"unknown scope {self.scope}")
        if self.graph_mode not in ("full", "instances", "instances+imports"):
            raise ValueError(f"unknown graph mode {self.graph_mode}")
        if self.inference not in ("none", "rdfs"):
            raise ValueError(f"unknown inference {self.inference}")
        if self.split_max_chars < 1 or self.split_min_chars < 0:
            raise ValueError("chunk sizes must be positive")

    def enabled(self) -> list[str]:
        """The stages that run: the longest prefix of all stages that are wanted."""
        out = []
        for stage in STAGES:
            if stage not in self.stages:
                break
            out.append(stage)
        return out
