"""Parameters of the three query families, with their defaults, clamps and text forms."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

ALGORITHMS = ("distance", "hdbscan", "dbscan", "cc_graph", "mutual_graph", "snn", "rank_mutual", "adaptive_graph", "agglomerative", "agglomerative_complete", "optics")
ALIASES = {"graph": "cc_graph"}
TRUE, FALSE = {"1", "true", "yes", "on", "y"}, {"0", "false", "no", "off", "n"}


@dataclass(frozen=True)
class Sorting:
    strategy: str = "farthest_insertion"
    optimizer: str = "2opt"
    lookahead: int = 100
    two_opt_block_size: int = 100
    two_opt_shift: int = 90
    neighbors_k_limit: int = 1024

    def neighbors(self, n: int) -> int:
        return max(0, min(self.neighbors_k_limit, n - 1))


@dataclass(frozen=True)
class Clustering:
    algorithm: str = "distance"
    threshold: float = 0.35
    similarity_percent: float = 50.0
    min_size: int = 2
    naming: str = "default"
    save_mode: str = "default"
    save_discarded: bool = True
    group_filling_size: int = 10
    group_filling_split: str = "recluster"
    similar_fill: bool = False
    pca: bool = False
    pca_components: int = 256
    pairwise_limit: int = 1200
    enable_refine: bool = False

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        algorithm = ALIASES.get(self.algorithm, self.algorithm)
        put("algorithm", algorithm if algorithm in ALGORITHMS else "distance")
        put("threshold", max(0.0, self.threshold))
        put("similarity_percent", min(100.0, max(0.0, self.similarity_percent)))
        put("min_size", max(1, self.min_size))
        put("group_filling_size", max(1, self.group_filling_size))
        put("naming", self.naming if self.naming in ("default", "distance", "distance_plus") else "default")
        put("save_mode", self.save_mode if self.save_mode in ("default", "json", "print", "group_filling", "cluster_sort") else "default")
        put("group_filling_split", self.group_filling_split if self.group_filling_split in ("recluster", "fi") else "recluster")


@dataclass(frozen=True)
class Search:
    neighbors: int = 5
    batch_size: int = 2048
    tsv_neighbors: int = 5
    result: str = "both"
    mode: str = "image"
    fusion: str = "simple"
    image_weight: float = 0.5
    text_weight: float = 0.5
    alpha: float = 0.7
    base_prompt: str = "a photo"

    def __post_init__(self) -> None:
        object.__setattr__(self, "neighbors", max(1, self.neighbors))
        if self.result not in ("both", "indexed", "paths"):
            object.__setattr__(self, "result", "both")
        if self.fusion not in ("simple", "directional"):
            object.__setattr__(self, "fusion", "simple")


def coerced(text: str, kind: type) -> object:
    """A value of ``kind`` from its text; raises ValueError if it is none."""
    if kind is bool:
        if text.strip().lower() in TRUE:
            return True
        if text.strip().lower() in FALSE:
            return False
        raise ValueError(f"not a truth value: {text!r}")
    return kind(text.strip())


def with_values(config, values: dict[str, str]):
    """``config`` with named fields from text; unknown names raise."""
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(config)}
    unknown = set(values) - set(kinds)
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return replace(config, **{k: coerced(v, kinds[k]) for k, v in values.items()})
