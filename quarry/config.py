"""Settings of the dataflows, passed explicitly. Defaults are those of the published experiments."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 600
    overlap: int = 50
    least: int = 10
    by_article: bool = True
    separators: tuple[str, ...] = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")


@dataclass(frozen=True)
class RetrievalConfig:
    bm25_k: int = 10
    dense_k: int = 10
    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    rrf_top: int = 20
    rerank_top: int = 10
    context_top: int = 5
    dedup: bool = True


@dataclass(frozen=True)
class SampleConfig:
    seed: int = 42
    val_ratio: float = 0.1
    strata: dict = field(default_factory=lambda: {"法律类": 1200, "违规类": 400, "闲聊类": 400})


@dataclass(frozen=True)
class Workspace:
    """Experiment folders below one root; nothing is read from the environment."""

    root: str
    experiment: str

    def data(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), "data", "experiments", self.experiment, *parts])

    def prompts(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), "prompts", "experiments", self.experiment, *parts])

    def results(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), "output", "experiments", self.experiment, *parts])
