"""Clip-and-noise release of payload features.

This is the plain mechanism, not a calibrated guarantee: there is no epsilon or delta, labels and
groups leave as they are, and a constant intercept feature is clipped and noised like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evenhand.functions.draws import draw_hash, gaussian

VARIANTS = ("none", "pre_server", "post_server", "both")


@dataclass(frozen=True)
class NoiseConfig:
    variant: str = "post_server"
    sigma: float = 1.0
    low: float = -1.0
    high: float = 1.0

    def __post_init__(self) -> None:
        if self.variant not in VARIANTS:
            raise ValueError(f"variant {self.variant!r} is not one of {', '.join(VARIANTS)}")

    @property
    def before_union(self) -> bool:
        return self.sigma > 0 and self.variant in ("pre_server", "both")

    @property
    def after_union(self) -> bool:
        return self.sigma > 0 and self.variant in ("post_server", "both")


def noise_config(enabled: bool, sigma: float, variant: str) -> NoiseConfig:
    """Check the variant even where noise is switched off."""
    chosen = NoiseConfig(str(variant).strip().lower(), float(sigma))
    return chosen if enabled else NoiseConfig("none", float(sigma))


def noisy_features(
    df: DataFrame, config: NoiseConfig, seed: int, salt: str, keys: Sequence[str] = ("round", "client_id", "pt_id")
) -> DataFrame:
    """Clip every feature and add N(0, sigma^2); ``a`` and ``y`` stay."""
    cells = [F.col(k) for k in keys]
    x = F.transform(
        "x",
        lambda v, j: F.greatest(F.lit(config.low), F.least(F.lit(config.high), v))
        + F.lit(config.sigma) * gaussian(draw_hash(seed, salt, *cells, j)),
    )
    return df.withColumn("x", x)


def noise_before_union(df: DataFrame, config: NoiseConfig, seed: int) -> DataFrame:
    """What each client does to its own payload."""
    return noisy_features(df, config, seed, "pre") if config.before_union else df


def noise_after_union(df: DataFrame, config: NoiseConfig, seed: int) -> DataFrame:
    """What happens to the union; after the other stage it clips a second time."""
    return noisy_features(df, config, seed, "post") if config.after_union else df


def release(payload: DataFrame, config: NoiseConfig, seed: int) -> DataFrame:
    return noise_after_union(noise_before_union(payload, config, seed), config, seed)
