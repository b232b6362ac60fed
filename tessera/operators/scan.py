"""Running a caller's model over all images."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Models that this worker process has loaded, the last few calls' only.
MODELS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}
MOST_MODELS = 2


def loaded(name: str, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """This process's model of that name, loaded at its first use."""
    if name not in MODELS:
        while len(MODELS) >= MOST_MODELS:
            MODELS.pop(next(iter(MODELS)))
        MODELS[name] = load_model()
    return MODELS[name]


def score_images(images: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch_rows: int = 1024) -> DataFrame:
    """schema's columns of every row of images, by the model that load_model() gives, in batches of up to batch_rows rows.

    A model is loaded once a worker process and not once a task: Spark uses its
    Python workers again. Batches are bounded, as a model's memory grows with them.
    """
    name = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tessera.operators import scan  # the worker's module, not a copy of it

        for frame in frames:
            for a in range(0, len(frame), batch_rows):
                yield scan.loaded(name, load_model)(frame.iloc[a : a + batch_rows].reset_index(drop=True))

    return images.mapInPandas(run, schema)
