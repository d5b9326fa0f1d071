"""Queries for synthetic rows, pseudo-positives, the payload and its noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.operators import noise, sampling as s, synthesis as e
from evenhand.operators.sizes import cut_lineage
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.catalog.sampling import batch_of
from evenhand.plans.views import SEED, WIDTH

DIGITS = 4  # Prices are of the order of 1e5, so six digits would compare summation noise.
SIGMA = 0.5


def parts_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Minibatch (a bounded sample, written once for all that follows), its statistics and quotas."""
    batch = cut_lineage(batch_of(spark, sf_dir))
    stats = s.minibatch_stats(batch)
    return batch, stats, e.synthetic_quotas(stats)


def synthetic_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, _, quotas = parts_of(spark, sf_dir)
    return e.synthetic_rows(quotas, e.stratum_moments(batch), SEED)


def universum_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, stats, quotas = parts_of(spark, sf_dir)
    return e.universum_rows(e.universum_slots(quotas, stats), batch, SEED, WIDTH)


def payload_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_from(*parts_of(spark, sf_dir))


def payload_from(batch: DataFrame, stats: DataFrame, quotas: DataFrame) -> DataFrame:
    synthetic = e.synthetic_rows(quotas, e.stratum_moments(batch), SEED)
    universum = e.universum_rows(e.universum_slots(quotas, stats), batch, SEED, WIDTH)
    return e.build_payload(synthetic, universum)


def _long(points: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row per point and feature, as the SQL side has them."""
    cells = points.select("round", "client_id", "kind", "pt_id", "a", "y", F.posexplode("x").alias("j", "v"))
    return cells.withColumn("v", F.round("v", digits))


_QUOTAS = [f"q_a{a}y{y}" for a, y in s.STRATA]
_POINT = "round, client_id, kind, pt_id, a, y, j"


@register(
    "e1_synthetic_quotas",
    o.query(
        f"SELECT round, client_id, {', '.join(f'{o.big(c)} AS {c}' for c in (*_QUOTAS, 'ds_target', 'ds_size', 'delta_s'))} FROM syn_quotas",
        "syn_quotas",
    ),
)
def synthetic_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_of(spark, sf_dir)[2].select("round", "client_id", *_QUOTAS, "ds_target", "ds_size", "delta_s")


@register(
    "e2_stratum_moments",
    o.query(
        "SELECT 'lines' AS source, round, CAST(client_id AS VARCHAR) AS client_id, a, y, j, "
        f"{o.rnd('mean', DIGITS)} AS mean, {o.rnd('std', DIGITS)} AS std FROM moments "
        f"UNION ALL SELECT 'documents', round, client_id, a, y, j, {o.rnd('mean', DIGITS)}, {o.rnd('std', DIGITS)} FROM doc_moments",
        "moments",
        "docs",
        p=o.profile_body("docs", "client_id"),
        q=o.quota_body("p", "client_id"),
        doc_batch=o.batch_body("docs", "q", 1),
        doc_moments=o.moment_body("doc_batch", 2),
    ),
)
def stratum_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines fill every stratum; documents have empty and single-row ones, which fall back."""

    def of(batch: DataFrame, source: str) -> DataFrame:
        return e.stratum_moments(batch).select(
            F.lit(source).alias("source"), "round", F.col("client_id").cast("string").alias("client_id"), "a", "y", "j",
            F.round("mean", DIGITS).alias("mean"), F.round("std", DIGITS).alias("std"),
        )

    documents = s.draw_minibatch(views.labelled_documents(spark, sf_dir), SEED)
    return of(batch_of(spark, sf_dir), "lines").unionByName(of(documents, "documents"))


@register("e3_synthetic_rows", o.query(f"SELECT {_POINT}, {o.rnd('v', DIGITS)} AS v FROM syn", "syn"))
def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(synthetic_of(spark, sf_dir))


_SIZE = "CAST(greatest(0, least(q.delta_s, q.ds_size, s.delta)) AS BIGINT)"


@register(
    "e4_universum_size",
    o.query(
        f"SELECT round, client_id, CAST(q.delta_s AS BIGINT) AS delta_s, CAST(q.ds_size AS BIGINT) AS ds_size, CAST(s.delta AS BIGINT) AS delta, {_SIZE} AS u_size FROM stats s JOIN syn_quotas q USING (round, client_id)",
        "stats",
        "syn_quotas",
    ),
)
def universum_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats, quotas = parts_of(spark, sf_dir)
    joined = quotas.select("round", "client_id", "delta_s", "ds_size").join(
        stats.select("round", "client_id", "delta"), ["round", "client_id"]
    )
    return joined.withColumn("u_size", e.universum_size(F.col("delta_s"), F.col("ds_size"), F.col("delta")))


@register("e5_balanced_slots", o.query("SELECT round, client_id, slot, a FROM slots", "slots"))
def balanced_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stats, quotas = parts_of(spark, sf_dir)
    return e.universum_slots(quotas, stats).select("round", "client_id", "slot", "a")


@register("e6_midpoints", o.query(f"SELECT {_POINT}, {o.rnd('v', DIGITS)} AS v FROM uni", "uni"))
def midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(universum_of(spark, sf_dir))


@register("e7_payload", o.query(f"SELECT {_POINT}, {o.rnd('v', DIGITS)} AS v FROM payload", "payload"))
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(payload_of(spark, sf_dir))


def _noised(source: str, salt: str) -> str:
    return (
        f"SELECT {_POINT}, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v)) + {o.dbl(SIGMA)} * {o.gauss(o.draw(salt, 'round', 'client_id', 'pt_id', 'j'))} AS v FROM {source}"
    )


def _config(variant: str) -> noise.NoiseConfig:
    return noise.noise_config(True, SIGMA, variant)


@register(
    "e9_clip_and_noise",
    o.query(f"SELECT {_POINT}, {o.rnd('v')} AS v FROM released", "syn", released=_noised("syn", "alone")),
)
def clip_and_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(noise.noisy_features(synthetic_of(spark, sf_dir), _config("post_server"), SEED, "alone"), 6)


@register(
    "e10_noise_before_union",
    o.query(f"SELECT {_POINT}, {o.rnd('v')} AS v FROM released", "payload", released=_noised("payload", "pre")),
)
def noise_before_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(noise.noise_before_union(payload_of(spark, sf_dir), _config("pre_server"), SEED), 6)


@register(
    "e11_noise_both_stages",
    o.query(
        f"SELECT {_POINT}, {o.rnd('v')} AS v FROM released",
        "payload",
        first=_noised("payload", "pre"),
        released=_noised("first", "post"),
    ),
)
def noise_both_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(noise.release(payload_of(spark, sf_dir), _config("both"), SEED), 6)
