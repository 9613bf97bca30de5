"""Run profiles: sizes, grids and switches of the modelling pipeline, validated before anything runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Subset:
    """A sample of the corpus; size None: all of it."""

    name: str
    size: int | None
    min_category_count: int = 10
    min_per_category: int = 3

    def __post_init__(self):
        if self.size is not None and self.size < 1:
            raise ValueError(f"subset {self.name}: size {self.size}")


@dataclass(frozen=True)
class Profile:
    name: str
    tfidf_rows: int | None = 40_000
    dense_rows: int | None = 12_000
    density_rows: int = 8_000
    ward_rows: int = 2_500
    train_fraction: float = 0.7
    val_fraction: float = 0.1
    test_fraction: float = 0.2
    max_features: int = 50_000
    min_df: int = 5
    svd_components: int = 100
    k_grid: tuple[int, ...] = (50, 100, 172)
    min_cluster_sizes: tuple[int, ...] = (30, 50, 100)
    silhouette_sample: int = 5_000
    npmi_sample: int = 25_000
    bypass_rows: int = 200_000
    mini_batch_rows: int = 100_000
    clustering: bool = True
    tfidf: bool = True
    dense: bool = True
    retrieval: bool = True
    seed: int = 42

    def __post_init__(self):
        if abs(self.train_fraction + self.val_fraction + self.test_fraction - 1) > 1e-6:
            raise ValueError("split fractions must sum to 1")
        self.subsets()

    def subsets(self) -> dict[str, Subset]:
        """Subsets by name; one name can't stand for two definitions."""
        out: dict[str, Subset] = {}
        for rows, stem, used in ((self.tfidf_rows, "sparse", self.tfidf), (self.dense_rows, "dense", self.dense)):
            if used:
                s = Subset(f"{stem}_{rows or 'full'}", rows, 10 if rows else 1)
                if out.setdefault(s.name, s) != s:
                    raise ValueError(f"subset {s.name} has two definitions")
        return out

    def key(self) -> str:
        """Hash of all settings; artifacts are kept under it, so another setting never reads them."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


PROFILES = {
    p.name: p
    for p in (
        Profile("local"),
        Profile("full", 120_000, 30_000, 20_000, 5_000, svd_components=150, silhouette_sample=10_000, bypass_rows=120_000),
        Profile("large", 200_000, 80_000, 30_000, 10_000, max_features=100_000, svd_components=200, silhouette_sample=15_000),
        Profile("whole", None, None, 50_000, 10_000, max_features=250_000, min_df=10, svd_components=256, silhouette_sample=20_000, npmi_sample=50_000, bypass_rows=120_000),
        Profile("retrieval", None, None, clustering=False, tfidf=False, bypass_rows=120_000),
        Profile("retrieval_sample", None, 120_000, clustering=False, tfidf=False, bypass_rows=50_000),
    )
}


def profile(name: str, **changes) -> Profile:
    if name not in PROFILES:
        raise KeyError(f"no profile {name!r}; there are {sorted(PROFILES)}")
    return replace(PROFILES[name], **{k: v for k, v in changes.items() if v is not None})
