"""Queries for value recodes, imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions import values, vectors
from evenhand.operators import metrics, prepare, ranks, runs, sparse, splits
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.catalog.experiments import nested_results
from evenhand.plans.views import SEED, table
from evenhand.sources import quarantine
from evenhand.sources.schemas import COMPAS_GROUPS, LAW_FEATURES

# Lines of CSV with a defect here and there: too short, text for numbers, a quoted comma, too long.
_LINE = "l_orderkey * 8 + l_linenumber"
_CSV_LINE = f"""CASE WHEN ({_LINE}) % 97 = 0 THEN concat(l_orderkey, ',', l_linenumber)
 WHEN ({_LINE}) % 89 = 0 THEN concat(l_orderkey, ',x', l_linenumber, ',n/a,', l_returnflag)
 WHEN ({_LINE}) % 83 = 0 THEN concat(l_orderkey, ',', l_linenumber, ',', l_suppkey, ',"', l_returnflag, ',F"')
 WHEN ({_LINE}) % 79 = 0 THEN concat(l_orderkey, ',', l_linenumber, ',,', l_returnflag, ',9')
 ELSE concat(l_orderkey, ',', l_linenumber, ',', l_suppkey, ',', l_returnflag) END"""
_CSV_SCHEMA = "order_no BIGINT, line_no INT, supplier INT, flag STRING"


def _checked_lines(spark: SparkSession, sf_dir: str) -> quarantine.Checked:
    lines = table(spark, sf_dir, "lineitem").selectExpr("'lineitem' AS file", f"{_LINE} AS record", f"{_CSV_LINE} AS value")
    return quarantine.checked_lines(lines, _CSV_SCHEMA)


@register(
    "a1_rejected_lines",
    f"""SELECT 'lineitem' AS file, {_LINE} AS record, CASE WHEN ({_LINE}) % 97 = 0 THEN 'width: 2 of 4'
 WHEN ({_LINE}) % 89 = 0 THEN 'type: line_no, supplier' ELSE 'width: 5 of 4' END AS reason, {_CSV_LINE} AS content
 FROM lineitem WHERE ({_LINE}) % 97 = 0 OR ({_LINE}) % 89 = 0 OR (({_LINE}) % 79 = 0 AND ({_LINE}) % 83 <> 0)""",
)
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_lines(spark, sf_dir).rejected


@register(
    "a1_kept_lines",
    f"""SELECT CAST(l_orderkey AS BIGINT) AS order_no, CAST(l_linenumber AS INT) AS line_no, CAST(l_suppkey AS INT) AS supplier,
 CASE WHEN ({_LINE}) % 83 = 0 THEN concat(l_returnflag, ',F') ELSE l_returnflag END AS flag
 FROM lineitem WHERE ({_LINE}) % 97 <> 0 AND ({_LINE}) % 89 <> 0 AND (({_LINE}) % 79 <> 0 OR ({_LINE}) % 83 = 0)""",
)
def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_lines(spark, sf_dir).rows


_RAW_LABEL = """CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_totalprice > 200000 AND o_orderkey % 2 = 0 THEN ' >50K. '
 WHEN o_totalprice > 200000 THEN '> 50K' ELSE ' <=50K.' END"""


@register(
    "b2_text_label",
    f"SELECT o_orderkey, CAST(coalesce(replace(rtrim(trim({_RAW_LABEL}), '.'), ' ', '') = '>50K', false) AS INT) AS y FROM orders",
)
def text_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").withColumn("raw", F.expr(_RAW_LABEL))
    return raw.select("o_orderkey", values.text_label("raw", ">50K").alias("y"))


_RAW_GROUP = "CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN concat('  ', lower(c_mktsegment), ' ') WHEN 2 THEN NULL ELSE c_mktsegment END"


@register(
    "b3_group_match",
    f"SELECT c_custkey, CAST(coalesce(lower(trim({_RAW_GROUP})) = 'building', false) AS INT) AS a FROM customer",
)
def group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").withColumn("raw", F.expr(_RAW_GROUP))
    return raw.select("c_custkey", values.matches("raw", "Building").alias("a"))


@register(
    "b4_median_group",
    "SELECT c_custkey, CAST(c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.5) FROM customer) AS INT) AS a FROM customer",
)
def median_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.at_least_median(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "a")


_RAW_NUMBER = """CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN concat(' ', CAST(o_custkey AS STRING), ' ')
 WHEN 3 THEN '1,5' ELSE CAST(o_custkey AS STRING) END"""


@register("b5_numeric", f"SELECT o_orderkey, TRY_CAST({_RAW_NUMBER} AS DOUBLE) AS v FROM orders")
def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").withColumn("raw", F.expr(_RAW_NUMBER))
    return raw.select("o_orderkey", values.numeric("raw").alias("v"))


@register(
    "b6_recode",
    """SELECT c_custkey, CAST(s = 1 AS INT) AS y, CASE WHEN y0 = 1 THEN 1 ELSE -1 END AS signed FROM
 (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE -1.0 END AS s, CAST(c_acctbal > 5000 AS INT) AS y0 FROM customer)""",
)
def recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").withColumn("s", F.when(F.col("c_acctbal") > 5000, 1.0).otherwise(-1.0))
    zero_one = raw.withColumn("y", values.to_zero_one("s"))
    return zero_one.select("c_custkey", "y", values.to_minus_one_one("y").alias("signed"))


_CASES = """o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 71 - 35 AS DOUBLE) END AS days,
 CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 5 AS INT) - 1 END AS is_recid,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'O' WHEN o_orderkey % 17 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS degree,
 CASE o_orderkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL ELSE 'Low' END AS score,
 CASE o_orderstatus WHEN 'O' THEN 'African-American' WHEN 'F' THEN 'Caucasian' ELSE 'Other' END AS race"""
_SCREEN = """days BETWEEN -30 AND 30 AND (is_recid IS NULL OR is_recid <> -1) AND (degree IS NULL OR degree <> 'O')
 AND race IN ('African-American', 'Caucasian')"""


@register(
    "b7_screening",
    f"""WITH cases AS (SELECT {_CASES} FROM orders)
 SELECT id, 'intended' AS reading FROM cases WHERE {_SCREEN} AND score IS NOT NULL AND score <> 'N/A'
 UNION ALL SELECT id, 'as_published' AS reading FROM cases WHERE {_SCREEN}""",
)
def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(*[F.expr(e) for e in _split_select(_CASES)])

    def kept(reading: str) -> DataFrame:
        out = prepare.screened(cases, "days", "is_recid", "degree", "score", "race", COMPAS_GROUPS, reading == "as_published")
        return out.select("id", F.lit(reading).alias("reading"))

    return kept("intended").unionByName(kept("as_published"))


def _split_select(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


@register("b8_features", "SELECT p_brand, p_type, p_size, p_retailprice FROM part")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(*prepare.feature_columns(part, "P_PARTKEY", "p_name"))


@register("b9_log1p", f"SELECT o_orderkey, {o.rnd('ln(1.0::DOUBLE + o_totalprice)')} AS log_price FROM orders")
def log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice"), 6).alias("log_price"))


@register(
    "b10_signed_log",
    f"SELECT c_custkey, {o.rnd('sign(b) * ln(1.0::DOUBLE + abs(b))')} AS c_acctbal FROM (SELECT c_custkey, c_acctbal - 5000.0::DOUBLE AS b FROM customer)",
)
def signed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") - 5000.0).alias("c_acctbal"))
    return prepare.signed_log_prefixed(shifted, "c_acct").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@register(
    "b11_positional",
    "SELECT p_type, p_size, p_retailprice AS price, p_brand, p_name AS target FROM part",
)
def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.positional(
        table(spark, sf_dir, "part"), "p_brand", "target", drop=["p_partkey"],
        rename={"p_retailprice": "price", "p_name": "target"},
    )


@register(
    "b12_widened",
    o.query(
        "SELECT l_discount AS decile1b, l_tax AS decile3, "
        + ", ".join(f"0.0::DOUBLE AS {c}" for c in LAW_FEATURES[2:])
        + ", a::DOUBLE AS race, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pass_bar, "
        "CASE WHEN rn <= greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM ranked",
        "lines",
        ranked=f"SELECT *, row_number() OVER (ORDER BY {o.draw('split', 'row_id')}) AS rn, count(*) OVER () AS n FROM lines",
    ),
)
def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.split_by_count(views.line_columns(spark, sf_dir), "row_id", SEED, 0.8, ("train", "test"), at_least=1)
    last = {"race": F.col("a").cast("double"), "pass_bar": values.to_minus_one_one("y").cast("double"), "split": F.col("split")}
    return prepare.widened(rows, LAW_FEATURES, [F.col("l_discount"), F.col("l_tax")], last)


_BROKEN = """CASE o_orderkey % 9 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE)
 WHEN 3 THEN NULL ELSE o_totalprice END"""


@register(
    "b13_finite",
    f"SELECT o_orderkey, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0::DOUBLE ELSE v END AS v FROM (SELECT o_orderkey, {_BROKEN} AS v FROM orders)",
)
def finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = table(spark, sf_dir, "orders").withColumn("v", F.expr(_BROKEN))
    return broken.select("o_orderkey", values.finite_or_zero("v").alias("v"))


_LINE_MOMENTS = "SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in views.LINE_FEATURES
) + " FROM lines"


@register(
    "b14_assembly",
    o.query(
        "SELECT row_id, "
        + ", ".join(f"{o.rnd(f'({c} - m_{c}) / s_{c}')} AS z{i}" for i, c in enumerate(views.LINE_FEATURES))
        + ", 1.0::DOUBLE AS z4, a::DOUBLE AS z5 FROM lines, moments_row",
        "lines",
        moments_row=_LINE_MOMENTS,
    ),
)
def assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = prepare.standardize(views.line_columns(spark, sf_dir), views.LINE_FEATURES)
    packed = scaled.withColumn("z", vectors.pack(vectors.assemble(views.LINE_FEATURES, intercept=True), F.col("a")))
    return packed.select("row_id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(views.WIDTH + 2)])


@register(
    "b15_linear_score",
    o.query(f"SELECT row_id, {o.rnd('f', 9)} AS f, CAST(f > 0.5::DOUBLE AS INT) AS pred FROM scored", "scored"),
)
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.labelled_lines(spark, sf_dir).withColumn("f", vectors.score("x", "a", views.THETA))
    return rows.select("row_id", F.round("f", 9).alias("f"), vectors.predict(F.col("f"), 0.5).alias("pred"))


@register(
    "b16_probability",
    o.query(
        f"SELECT row_id, {o.rnd('1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(100.0::DOUBLE * f, 50.0::DOUBLE), -50.0::DOUBLE)))', 9)} AS p FROM scored",
        "scored",
    ),
)
def probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.scored_lines(spark, sf_dir)
    return scored.select("row_id", F.round(vectors.sigmoid(F.lit(100.0) * F.col("f")), 9).alias("p"))


@register(
    "b17_clip",
    """SELECT vec_id, j, greatest(-0.1::DOUBLE, least(0.1::DOUBLE, v)) AS v FROM
 (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)""",
)
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_table = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    return vectors_table.select("vec_id", F.posexplode(vectors.clip(F.col("x"), -0.1, 0.1)).alias("j", "v"))


@register(
    "b19_mean_spread",
    o.query(
        "SELECT client_id, printf('%.4f +/- %.4f', avg(l_discount), stddev_pop(l_discount)) AS discount, "
        "printf('%.4f +/- %.4f', avg(l_tax), stddev_pop(l_tax)) AS tax FROM lines GROUP BY client_id",
        "lines",
    ),
)
def mean_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = runs.seed_summary(views.line_columns(spark, sf_dir), ["client_id"], ["l_discount", "l_tax"])
    return summary.select(
        "client_id",
        values.mean_and_spread(F.col("l_discount_mean"), F.col("l_discount_std")).alias("discount"),
        values.mean_and_spread(F.col("l_tax_mean"), F.col("l_tax_std")).alias("tax"),
    )


@register(
    "b20_nan_audit",
    o.query(
        """SELECT dataset, universum_off, rho, CAST(3 + 2 * count(*) AS BIGINT) AS n_values,
 CAST(sum(CASE WHEN seed = 3 THEN 1 ELSE 0 END) AS BIGINT) + CAST(max(CASE WHEN rho > 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS n_nan
 FROM points GROUP BY ALL""",
        "points",
    ),
)
def nan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = nested_results(spark, sf_dir)
    nan = F.lit(float("nan"))
    broken = results.withColumn(
        "round_logs",
        F.transform(
            "round_logs",
            lambda log: log.withField("val_accuracy", F.when(log["round"] == 3, nan).otherwise(log["val_accuracy"])),
        ),
    ).withColumn(
        "pipeline", F.col("pipeline").withField("EO_gap", F.when(F.col("rho") > 0.4, nan).otherwise(F.col("pipeline.EO_gap")))
    )
    doubles = [
        F.array("pipeline.accuracy", "pipeline.EO_gap", "rho"),
        F.transform("round_logs", lambda log: log["val_accuracy"]),
        F.transform("round_logs", lambda log: log["val_EO_gap"]),
    ]
    return runs.nan_counts(broken, ["dataset", "universum_off", "rho"], doubles)


_HOLED = "CASE WHEN o_orderkey % 7 = 0 THEN '?' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END"
_HOLED_STATUS = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END"


# Rows before this day are the training rows of the imputation.
_TRAIN_UNTIL = "1996-01-01"


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM holed WHERE {column} IS NOT NULL AND {column} <> '?' AND o_orderdate < TIMESTAMP '{_TRAIN_UNTIL}' "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@register(
    "c1_mode_imputation",
    f"""WITH holed AS (SELECT o_orderkey, o_orderdate, {_HOLED} AS priority, {_HOLED_STATUS} AS status FROM orders)
 SELECT o_orderkey, coalesce(nullif(priority, '?'), {_mode('priority')}) AS priority, coalesce(status, {_mode('status')}) AS status FROM holed""",
)
def mode_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.expr(_HOLED).alias("priority"), F.expr(_HOLED_STATUS).alias("status")
    )
    train = holed.filter(F.col("o_orderdate") < F.lit(_TRAIN_UNTIL).cast("timestamp"))
    return prepare.impute_modes(holed, ["priority", "status"], fit_on=train, missing="?").drop("o_orderdate")


_GAPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_custkey::DOUBLE END AS customer FROM orders"


@register(
    "c2_median_imputation",
    f"""WITH gaps AS ({_GAPS}), m AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(customer, 0.5) AS mc FROM gaps)
 SELECT o_orderkey, {o.rnd('coalesce(price, mp)')} AS price, {o.rnd('coalesce(customer, mc)')} AS customer FROM gaps, m""",
)
def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 4 != 1, F.col("o_custkey").cast("double")).alias("customer"),
    )
    filled = prepare.impute_medians(gaps, ["price", "customer"])
    return filled.select("o_orderkey", F.round("price", 6).alias("price"), F.round("customer", 6).alias("customer"))


@register(
    "c3_one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CAST(coalesce(s = '{c}', false) AS DOUBLE) AS segment_{c}" for c in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment")
    )
    train, test = rows.filter("c_acctbal >= 5000"), rows.filter("c_acctbal < 5000")
    known = prepare.categories_of("segment", train, test)
    both = prepare.one_hot(train, "segment", known).unionByName(prepare.one_hot(test, "segment", known))
    return both.drop("c_acctbal")


def _shares(column: str) -> str:
    return f"SELECT {column}, count(*)::DOUBLE / (SELECT count(*) FROM part) AS share, row_number() OVER (ORDER BY {column}) - 1 AS code FROM part GROUP BY {column}"


@register(
    "c3_sparse_rows",
    f"WITH brands AS ({_shares('p_brand')}), names AS ({_shares('p_name')}), cells AS ("
    "SELECT p_partkey, 0 AS place, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS value FROM part "
    "UNION ALL SELECT p_partkey, code AS place, 1.0::DOUBLE / sqrt(share * (1 - share)) AS value FROM part JOIN brands USING (p_brand) WHERE code > 0 "
    "UNION ALL SELECT p_partkey, code + (SELECT count(*) FROM brands) - 1 AS place, 1.0::DOUBLE / sqrt(share * (1 - share)) AS value FROM part JOIN names USING (p_name) WHERE code > 0) "
    f"SELECT p_partkey, CAST(place AS INT) AS place, {o.rnd('value')} AS value FROM cells WHERE value <> 0",
)
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number and two category columns, one of them with a category for almost every row, as the places that are not 0."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand", "p_name")
    rows = sparse.sparse_rows(part, sparse.encoding(part, ["p_retailprice"], ["p_brand", "p_name"]))
    cells = rows.select("p_partkey", F.inline(F.arrays_zip("x.idx", "x.val")))
    return cells.select("p_partkey", F.col("idx").alias("place"), F.round("val", 6).alias("value"))


@register(
    "c4_label_codes",
    "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS name_code, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS brand_code FROM part",
)
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    names = ranks.dense_codes(part, "p_name").withColumnRenamed("code", "name_code")
    brands = ranks.dense_codes(part, "p_brand").withColumnRenamed("code", "brand_code")
    return part.join(names, "p_name").join(brands, "p_brand").select("p_partkey", "name_code", "brand_code")


@register(
    "c5_standardized",
    o.query(
        "SELECT row_id, split, " + ", ".join(f"{o.rnd(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in views.LINE_FEATURES)
        + ", (flat - 3.0::DOUBLE) / 1.0::DOUBLE AS flat FROM parts, moments_row",
        "lines",
        parts=f"SELECT *, 3.0::DOUBLE AS flat, CASE WHEN row_number() OVER (ORDER BY {o.draw('split', 'row_id')}) <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM lines",
        moments_row=_LINE_MOMENTS.replace("FROM lines", "FROM parts WHERE split = 'train'"),
    ),
)
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.line_columns(spark, sf_dir).withColumn("flat", F.lit(3.0))
    # A split is a projection over a few cuts, so the fit and the transform can both read the table itself.
    parts = splits.split_by_count(rows, "row_id", SEED, 0.2)
    columns = [*views.LINE_FEATURES, "flat"]
    scaled = prepare.standardize(parts, columns, fit_on=parts.filter("split = 'train'"))
    return scaled.select("row_id", "split", *[F.round(c, 6).alias(c) for c in columns])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How accurate and how fair is a fixed scorer on standardised features, per client?"""
    scaled = prepare.standardize(views.line_columns(spark, sf_dir), views.LINE_FEATURES)
    predicted = scaled.withColumn(
        "pred", vectors.predict(vectors.score_columns(views.LINE_FEATURES, "a", views.THETA_SCALED))
    )
    report = metrics.evaluate(metrics.outcome_counts(predicted, ["client_id"]), ["client_id"])
    return report.select("client_id", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "eo_gap", "dp_gap", "eod_gap")])


register(
    "a0_client_report",
    o.query(
        f"SELECT client_id, {o.metrics('n', 'accuracy', 'f1', 'eo_gap', 'dp_gap', 'eod_gap')} FROM (SELECT client_id, {o.outcome_cells()} FROM scaled GROUP BY client_id)",
        "lines",
        moments_row=_LINE_MOMENTS,
        scaled="SELECT client_id, a, y, CAST("
        + o.dot(views.THETA_SCALED, [f"(({c} - m_{c}) / s_{c})" for c in views.LINE_FEATURES] + ["a"])
        + " > 0 AS INT) AS pred FROM lines, moments_row",
    ),
)(flagship)
