"""Exponential families: links, variances, deviances and likelihoods, for arrays and for columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.tables import LINKS

#: Largest linear predictor, either way, while fitting; scoring has no such limit.
ETA_LIMIT = 500.0


@dataclass(frozen=True)
class Family:
    name: str
    power: float = 1.5

    def __post_init__(self) -> None:
        if self.name not in LINKS:
            raise ValueError(f"unknown family {self.name}; it may be {', '.join(LINKS)}")
        if self.name == "tweedie" and not 1 <= self.power <= 2:
            raise ValueError("tweedie_power must be from 1 to 2")

    @property
    def link(self) -> str:
        return LINKS[self.name]

    @property
    def p(self) -> float:
        """Power of the variance function; of no meaning for binomial."""
        return {"gaussian": 0.0, "poisson": 1.0, "gamma": 2.0, "tweedie": self.power}.get(self.name, math.nan)

    @property
    def fixed_scale(self) -> bool:
        return self.name in ("poisson", "binomial")

    def mean(self, eta: np.ndarray) -> np.ndarray:
        if self.link == "identity":
            return eta
        eta = np.clip(eta, -ETA_LIMIT, ETA_LIMIT)
        return np.maximum(np.exp(eta), 1e-300) if self.link == "log" else 1 / (1 + np.exp(-eta))

    def domain_error(self, low: float, high: float) -> str | None:
        """What is wrong with a target that spans low to high."""
        if self.name in ("poisson", "tweedie") and low < 0:
            return f"a {self.name} target must not be negative"
        if self.name == "gamma" and low <= 0:
            return "a gamma target must be positive"
        if self.name == "binomial" and (low < 0 or high > 1):
            return "a binomial target must be from 0 to 1"
        return None

    # Columns: y, mu and eta are doubles without nulls.

    def mean_column(self, eta: Column) -> Column:
        return eta if self.link == "identity" else F.exp(eta) if self.link == "log" else 1 / (1 + F.exp(-eta))

    def variance_column(self, mu: Column) -> Column:
        if self.name == "binomial":
            return mu * (1 - mu)
        return F.lit(1.0) if self.p == 0 else mu if self.p == 1 else F.pow(mu, self.p)

    def deviance_column(self, y: Column, mu: Column) -> Column:
        """Unit deviance."""
        xlogy = lambda a, b: F.when(a > 0, a * F.ln(F.when(a > 0, a / b).otherwise(1.0))).otherwise(0.0)
        if self.name == "gaussian":
            return (y - mu) * (y - mu)
        if self.name == "binomial":
            return 2 * (xlogy(y, mu) + xlogy(1 - y, 1 - mu))
        if self.p == 1:
            return 2 * (xlogy(y, mu) - (y - mu))
        if self.p == 2:
            return 2 * ((y - mu) / mu - F.ln(F.when(y > 0, y / mu).otherwise(1e-300)))
        p = self.p
        return 2 * (F.pow(y, 2 - p) / ((1 - p) * (2 - p)) - y * F.pow(mu, 1 - p) / (1 - p) + F.pow(mu, 2 - p) / (2 - p))

    def null_mean(self, wy: float, w: float) -> float:
        return wy / w if w else math.nan
