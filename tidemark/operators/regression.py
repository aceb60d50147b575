"""Column formulas of the count model: mean, occurrence, deviance, residual."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_mean(score: Column, exposure: Column, scale: float = 0.1, max_z: float = 10.0, min_exposure: float = 1e-12) -> Column:
    z = scale * score + F.log(F.greatest(exposure, F.lit(min_exposure)))
    return F.exp(F.greatest(F.lit(-max_z), F.least(F.lit(max_z), z)))


def occurrence(mu: Column) -> Column:
    return 1.0 - F.exp(-mu)


def poisson_deviance(y: Column, mu: Column, least: float = 1e-12) -> Column:
    m = F.greatest(mu, F.lit(least))
    return F.when(y == 0, 2.0 * m).otherwise(2.0 * (y * F.log(y / m) - (y - m)))


def negative_binomial_residual(y: Column, mu: Column, k: float = 2.0) -> Column:
    return (y - mu) / (1.0 + mu / F.lit(k))
