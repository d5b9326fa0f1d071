"""Schemas of the supported raw tables and of a run result."""

from __future__ import annotations

# Fixed column names and orders of the public tables.
ADULT = (
    "age INT, workclass STRING, fnlwgt INT, education STRING, `education-num` INT, `marital-status` STRING, "
    "occupation STRING, relationship STRING, race STRING, sex STRING, `capital-gain` INT, `capital-loss` INT, "
    "`hours-per-week` INT, `native-country` STRING, income STRING"
)
LAW_FEATURES = (
    "decile1b", "decile3", "lsat", "ugpa", "zfygpa", "zgpa", "fulltime", "fam_inc", "male", "tier",
)
LAW = ", ".join(f"{c} STRING" for c in (*LAW_FEATURES, "race", "pass_bar"))
COMPAS_FEATURES = (
    "sex", "age", "age_cat", "priors_count", "c_charge_degree", "juv_fel_count", "juv_misd_count", "juv_other_count",
)
COMPAS_CATEGORIES = ("sex", "age_cat", "c_charge_degree")
COMPAS_GROUPS = ("African-American", "Caucasian")
TWO_D = "x1 DOUBLE, x2 DOUBLE, s INT, y DOUBLE, client STRING"

_EXTENDED = "STRUCT<PR_AUC: DOUBLE, ROC_AUC: DOUBLE, macro_F1: DOUBLE, balanced_accuracy: DOUBLE, DP_gap: DOUBLE, EOD_gap: DOUBLE>"
_MODEL = "accuracy: DOUBLE, F1_score: DOUBLE, EO_gap: DOUBLE, TPR_group0: DOUBLE, TPR_group1: DOUBLE"
_SETTINGS = (
    "num_clients: INT, rounds: INT, use_tpr_gap: BOOLEAN, tpr_alpha: DOUBLE, tpr_tau: DOUBLE, ema_beta: DOUBLE, "
    "use_importance_weighting: BOOLEAN, use_rolling_buffer: BOOLEAN, dp_enabled: BOOLEAN, dp_sigma: DOUBLE, "
    "dp_variant: STRING, stop_criterion: STRING, outer_tol_xhat: DOUBLE, partition: STRING, dirichlet_alpha: DOUBLE, "
    "add_intercept: BOOLEAN, tune_threshold: BOOLEAN, threshold_pipeline: DOUBLE, threshold_baseline: DOUBLE"
)
ROUND_LOG = (
    "STRUCT<round: INT, val_accuracy: DOUBLE, val_EO_gap: DOUBLE, val_TPR_group0: DOUBLE, "
    "val_TPR_group1: DOUBLE, val_F1: DOUBLE>"
)
RUN = (
    f"baseline STRUCT<{_MODEL}, extended_metrics: {_EXTENDED}>, "
    f"pipeline STRUCT<{_MODEL}, {_SETTINGS}, extended_metrics: {_EXTENDED}>, "
    f"dataset STRING, round_logs ARRAY<{ROUND_LOG}>"
)
