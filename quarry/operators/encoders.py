"""Reducers and encoders as registries of functions; models that are not installed are named, never imitated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.functions import text as t

REDUCERS: dict[str, Callable[[DataFrame], DataFrame]] = {"identity": lambda df: df}


def device() -> str:
    """cuda, mps or cpu, as far as a tensor library is installed."""
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "mps" if torch.backends.mps.is_available() else "cpu"


def encode(records: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64, unit: bool = True) -> DataFrame:
    """id, embedding of text. load() runs once a worker and returns texts -> vectors; unit: to unit length."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            out: list[list[float]] = []
            for k in range(0, len(f), batch):
                out += model(f["text"].iloc[k : k + batch].tolist())
            yield pd.DataFrame({"id": f["id"], "embedding": out})

    kind = records.schema["id"].dataType.simpleString()
    made = records.select("id", t.dense_clean("text").alias("text")).mapInPandas(work, f"id {kind}, embedding array<double>")
    if not unit:
        return made
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return made.select("id", F.when(norm > 0, F.transform("embedding", lambda x: x / norm)).otherwise(F.col("embedding")).alias("embedding"))


def first_token_model(name: str, max_length: int = 512, to: str | None = None) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A loader for encode(): a transformer of that name, whose first token's last hidden state is the vector of a text, padded and cut to max_length; half precision where the device is cuda. Needs transformers and torch, which are not part of this library."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        import torch
        from transformers import AutoModel, AutoTokenizer

        where = to or device()
        tokenizer, model = AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).to(where).eval()

        def vectors(texts: list[str]) -> list[list[float]]:
            given = tokenizer(texts, padding=True, truncation=True, max_length=max_length, return_tensors="pt").to(where)
            with torch.no_grad(), torch.autocast(where, enabled=where == "cuda"):
                return model(**given).last_hidden_state[:, 0].float().cpu().tolist()

        return vectors

    return load


def sentence_model(name: str, to: str | None = None) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A loader for encode(): a sentence encoder of that name. Needs sentence_transformers."""

    def load() -> Callable[[list[str]], list[list[float]]]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, device=to or device())
        return lambda texts: model.encode(texts, show_progress_bar=False).tolist()

    return load


def umap_reducer(neighbors: int, min_dist: float, components: int) -> Callable[[DataFrame], DataFrame]:
    """A reducer by umap-learn on the driver, for what reduce_vectors() lets through. Needs umap."""

    def reduce(df: DataFrame) -> DataFrame:
        import umap

        rows = df.toPandas()
        made = umap.UMAP(n_neighbors=neighbors, min_dist=min_dist, n_components=components, metric="cosine", random_state=42).fit_transform(rows["embedding"].tolist())
        return df.sparkSession.createDataFrame(pd.DataFrame({"id": rows["id"], "embedding": made.astype(float).tolist()}), f"id {df.schema['id'].dataType.simpleString()}, embedding array<double>")

    return reduce


def search_reducers(vectors: DataFrame, score: Callable[[DataFrame], float | None], grid: dict[tuple, Callable[[DataFrame], DataFrame]], threshold: int = 200_000) -> tuple[list[dict], DataFrame]:
    """Search rows (setting, silhouette, best) and the vectors of the best reducer of a grid by score (silhouette of proxy clusters on validation rows); above the threshold one row, identity, and the vectors unchanged."""
    if vectors.count() > threshold or not grid:
        return [{"setting": "identity", "silhouette": None, "best": True}], vectors
    tried = [(setting, made := make(vectors), score(made)) for setting, make in grid.items()]
    best = max((x for x in tried if x[2] is not None), key=lambda x: x[2], default=tried[0])
    return [{"setting": str(s), "silhouette": v, "best": s == best[0]} for s, _, v in tried], best[1]


def reduce_vectors(vectors: DataFrame, method: str, threshold: int = 200_000) -> DataFrame:
    """Above the threshold vectors pass unchanged; below it by the reducer of that name."""
    if method not in REDUCERS:
        raise KeyError(f"no reducer {method!r} is registered; there are {sorted(REDUCERS)}")
    return vectors if vectors.count() > threshold else REDUCERS[method](vectors)
