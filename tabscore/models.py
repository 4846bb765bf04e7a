"""The interface of models that make synthetic tables. Training language models is left to a caller's own class."""

from __future__ import annotations

import abc

from pyspark.sql import DataFrame


class BaseTabularModel(abc.ABC):
    """fit(table) learns, sample(n) gives n synthetic rows; a model that can be kept overrides save and load."""

    @abc.abstractmethod
    def fit(self, train_df: DataFrame) -> BaseTabularModel:
        """Learn from train_df; returns the model itself."""

    @abc.abstractmethod
    def sample(self, n_samples: int) -> DataFrame:
        """n_samples synthetic rows; RuntimeError before fit."""

    def fit_sample(self, train_df: DataFrame, n_samples: int) -> DataFrame:
        return self.fit(train_df).sample(n_samples)

    def save(self, path: str) -> None:
        raise NotImplementedError(f"{type(self).__name__} can't be saved")

    @classmethod
    def load(cls, path: str) -> BaseTabularModel:
        raise NotImplementedError(f"{cls.__name__} can't be loaded")
