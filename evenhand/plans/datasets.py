"""Raw tables to ``(train, test)`` frames with named features, ``a``, ``y`` and ``row_id``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenhand.functions import values
from evenhand.operators import prepare, sparse, splits
from evenhand.operators.ranks import dense_codes
from evenhand.operators.sizes import cut_lineage, small_side
from evenhand.sources import quarantine, readers, schemas, writers

ADULT_CATEGORIES = (
    "workclass", "education", "marital-status", "occupation", "relationship", "native-country",
)


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]


def with_row_id(df: DataFrame) -> DataFrame:
    """Give file rows an id that depends on their content alone, and keep the numbered table.

    Equal rows are told apart by a number; they can stand for each other, so it does not matter which gets which.
    Ids, and with them splits and samples, are the same however the files are cut, ordered or scanned.
    """
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    # Equal rows are numbered where they lie, on top of those in the parts before: a row that fills a third of the table
    # is numbered in as many tasks as the table has parts.
    staged = cut_lineage(df.withColumns({"_content": content, "_part": F.spark_partition_id()}))
    place = ["_content", "_part"]
    sizes = staged.groupBy(*place).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").drop("_n")
    numbered = staged.withColumn("_again", F.row_number().over(Window.partitionBy(*place).orderBy("_content")))
    again = F.col("_again") + F.coalesce("_before", F.lit(0))
    keyed = numbered.join(offsets, place, "left").withColumn("row_id", F.concat_ws(":", "_content", again.cast("string")))
    return cut_lineage(keyed.select(*[F.col(f"`{c}`") for c in df.columns], "row_id"))


def _kept(rejects: str, *scans: quarantine.Checked) -> list[DataFrame]:
    """The rows that fit; the others become the table at ``rejects``."""
    rejected = scans[0].rejected
    for scan in scans[1:]:
        rejected = rejected.unionByName(scan.rejected)
    writers.write_rejected(rejected, rejects)
    return [scan.rows for scan in scans]


def _scanned(spark: SparkSession, name: str, rejects: str | None, *arguments: str) -> DataFrame:
    """The rows of the reader ``name``; with ``rejects`` those that do not fit go there instead of turning to null."""
    if rejects is None:
        return getattr(readers, name)(spark, *arguments)
    return _kept(rejects, getattr(quarantine, name)(spark, *arguments))[0]


def _parted(df: DataFrame, features: list[str], seed: int, test_share: float) -> Prepared:
    split = splits.stratified_split(df, "row_id", seed, test_share=test_share)
    return Prepared(split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split"), features)


CENSUS_GROUPS = {"sex": "male", "race": "white"}


def census(spark: SparkSession, folder: str, sensitive: str = "sex", seed: int = 42) -> Prepared:
    """Census income from what the folder has: the two headerless files, else a headered train and test file,
    else one headered file that is split."""
    return readers.first_source(
        spark,
        [
            ((f"{folder}/adult.data", f"{folder}/adult.test"), lambda s, train, test: adult(s, folder, sensitive)),
            ((f"{folder}/adult_train.csv", f"{folder}/adult_test.csv"), lambda s, train, test: adult_csv(s, train, test, sensitive)),
            ((f"{folder}/adult*.csv",), lambda s, path: adult_frame(s, path, sensitive, seed)),
        ],
    )


def _census_rows(both: DataFrame, sensitive: str) -> DataFrame:
    """Headered census text with ``split``: label, group, numbers as such, '?' and blanks as null."""
    if sensitive not in CENSUS_GROUPS:
        raise ValueError("sensitive is sex or race")
    both = with_row_id(both)
    names = prepare.feature_columns(both, "income", "target", "sex", "race", "row_id", "split")

    def cell(c: str) -> Column:
        text = F.trim(F.col(f"`{c}`"))
        known = F.when((text != "?") & (text != ""), text)
        return (known if c.replace("_", "-") in ADULT_CATEGORIES else values.numeric(known)).alias(c.replace("-", "_"))

    return both.select(
        "row_id",
        "split",
        values.text_label("income", ">50K").alias("y"),
        values.matches(sensitive, CENSUS_GROUPS[sensitive]).alias("a"),
        *[cell(c) for c in names],
    )


def _census_features(labelled: DataFrame, fit: dict[str, DataFrame]) -> Prepared:
    """Fill the modes of ``fit[split]`` into each split, encode over the categories of both, make numbers finite."""
    text = [c.replace("-", "_") for c in ADULT_CATEGORIES if c.replace("-", "_") in labelled.columns]
    filled = [prepare.impute_modes(labelled.filter(F.col("split") == name), text, fit_on=rows) for name, rows in fit.items()]
    both = filled[0].unionByName(filled[1])
    for c in text:
        both = prepare.one_hot(both, c, prepare.categories_of(c, labelled))
    return _finite(both)


def adult_csv(spark: SparkSession, train_path: str, test_path: str, sensitive: str = "sex") -> Prepared:
    """Census income from two headered files; each is filled with the modes of its own rows.

    Dummies cover the categories of both files, so that both have the same columns.
    """
    both = splits.given_split(readers.text_columns(spark, train_path), readers.text_columns(spark, test_path))
    labelled = _census_rows(both, sensitive)
    return _census_features(labelled, {name: labelled.filter(F.col("split") == name) for name in ("train", "test")})


@dataclass(frozen=True)
class SparsePrepared:
    """Rows ``(row_id, a, y, x)`` with sparse ``x`` of ``width`` places."""

    train: DataFrame
    test: DataFrame
    width: int


def adult_csv_sparse(spark: SparkSession, train_path: str, test_path: str, sensitive: str = "sex") -> SparsePrepared:
    """``adult_csv`` for any number of categories: none comes to the driver, and rows hold only what is not 0.

    Both files are scaled by the training file's moments and shares.
    """
    both = splits.given_split(readers.text_columns(spark, train_path), readers.text_columns(spark, test_path))
    labelled = _census_rows(both, sensitive)
    features = prepare.feature_columns(labelled, "row_id", "split", "a", "y")
    text = [c for c in features if c.replace("_", "-") in ADULT_CATEGORIES]
    numbers = [c for c in features if c not in text]
    parts = [labelled.filter(F.col("split") == name) for name in ("train", "test")]
    filled = [prepare.impute_modes(part, text, fit_on=part) for part in parts]
    whole = cut_lineage(filled[0].unionByName(filled[1]).withColumns({c: values.finite_or_zero(F.col(c)) for c in numbers}))
    coding = sparse.encoding(whole, numbers, text, fit_on=whole.filter("split = 'train'"))
    rows = sparse.sparse_rows(whole, coding).select("row_id", "split", "a", "y", "x")
    return SparsePrepared(rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split"), coding.width)


def adult_frame(spark: SparkSession, path: str, sensitive: str = "sex", seed: int = 42, test_share: float = 0.2) -> Prepared:
    """Census income from one headered file: a random split, modes of the training rows for both."""
    rows = _census_rows(readers.text_columns(spark, path).withColumn("split", F.lit("all")), sensitive).drop("split")
    labelled = splits.split_by_count(rows, "row_id", seed, 1 - test_share, ("train", "test"))
    train = labelled.filter("split = 'train'")
    return _census_features(labelled, {"train": train, "test": train})


def adult(spark: SparkSession, folder: str, sensitive: str = "sex", as_published: bool = False, rejects: str | None = None) -> Prepared:
    """Census income from its two files, which keep their own split; lines that do not fit go to the table ``rejects``, if one is named.

    ``as_published`` leaves nulls unfilled, as they are in effect when '?' was already read as null:
    they get no dummy. Otherwise they take the mode of the training rows.
    """
    if sensitive not in CENSUS_GROUPS:
        raise ValueError("sensitive is sex or race")
    train, test = readers.adult_files(spark, folder) if rejects is None else _kept(rejects, *quarantine.adult_files(spark, folder))
    both = with_row_id(splits.given_split(train, test))
    labelled = both.select(
        "row_id",
        "split",
        values.text_label("income", ">50K").alias("y"),
        values.matches(sensitive, CENSUS_GROUPS[sensitive]).alias("a"),
        *[F.col(f"`{c}`") for c in prepare.feature_columns(both, "income", "target", "sex", "race", "row_id", "split")],
    )
    labelled = labelled.withColumnsRenamed({c: c.replace("-", "_") for c in labelled.columns})
    text = [c.replace("-", "_") for c in ADULT_CATEGORIES]
    if not as_published:
        labelled = prepare.impute_modes(labelled, text, fit_on=labelled.filter("split = 'train'"))
    for c in text:
        labelled = prepare.one_hot(labelled, c, prepare.categories_of(c, labelled))
    return _finite(labelled)


def _finite(labelled: DataFrame) -> Prepared:
    # Dummy columns carry their category in the name; plain names make them easy to refer to.
    features = prepare.feature_columns(labelled, "row_id", "split", "a", "y")
    named = labelled.select(
        "row_id", "split", "a", "y",
        *[values.finite_or_zero(F.col(f"`{c}`").cast("double")).alias(f"f{i}") for i, c in enumerate(features)],
    )
    plain = [f"f{i}" for i in range(len(features))]
    return Prepared(named.filter("split = 'train'").drop("split"), named.filter("split = 'test'").drop("split"), plain)


def credit_folder(spark: SparkSession, folder: str, sensitive: str = "sex", seed: int = 42) -> Prepared:
    """Card defaults from the first CSV file of a folder."""
    return readers.first_source(spark, [((f"{folder}/*.csv",), lambda s, path: credit(s, path, sensitive, seed))])


def credit(
    spark: SparkSession, path: str, sensitive: str = "sex", seed: int = 42, test_share: float = 0.2, rejects: str | None = None
) -> Prepared:
    """Card defaults; the group is male, or an age at or above the median. ``rejects`` as in ``adult``."""
    raw = with_row_id(_scanned(spark, "described_csv", rejects, path))
    target = prepare.resolve_column(
        raw, "default payment next month", "default.payment.next.month", "Y", "default"
    )
    sex = prepare.resolve_column(raw, "SEX")
    age = prepare.resolve_column(raw, "AGE")
    features = prepare.feature_columns(raw, target, sex, "id", "unnamed: 0", "row_id")
    typed = raw.select(
        "row_id",
        values.coded(F.col(f"`{target}`")).alias("y"),
        values.coded(F.col(f"`{sex}`")).alias("a"),
        *[values.numeric(F.col(f"`{c}`")).alias(c) for c in features],
    )
    if sensitive != "sex":
        typed = prepare.at_least_median(typed, age)
    return _parted(prepare.impute_medians(typed, features), features, seed, test_share)


def law(spark: SparkSession, path: str, seed: int = 42, test_share: float = 0.2, rejects: str | None = None) -> Prepared:
    """Bar passage; the group is white. ``rejects`` as in ``adult``."""
    raw = with_row_id(_scanned(spark, "text_columns", rejects, path))
    features = prepare.feature_columns(raw, "race", "pass_bar", "row_id")
    typed = raw.select(
        "row_id",
        values.coded("pass_bar").alias("y"),
        values.matches("race", "white").alias("a"),
        *[values.numeric(c).alias(c) for c in features],
    )
    return _parted(prepare.impute_medians(typed, features), features, seed, test_share)


def law_sample(spark: SparkSession, train_path: str, test_path: str) -> Prepared:
    """The small law sample: numeric race, -1/1 labels, already split."""
    both = with_row_id(
        splits.given_split(readers.text_columns(spark, train_path), readers.text_columns(spark, test_path))
    )
    features = prepare.feature_columns(both, "race", "pass_bar", "row_id", "split")
    typed = both.select(
        "row_id",
        "split",
        values.coded("pass_bar").alias("y"),
        values.numeric("race").cast("int").alias("a"),
        *[values.numeric(c).alias(c) for c in features],
    )
    return Prepared(typed.filter("split = 'train'").drop("split"), typed.filter("split = 'test'").drop("split"), features)


def compas(
    spark: SparkSession, path: str, seed: int = 42, test_share: float = 0.2, as_published: bool = False, rejects: str | None = None
) -> Prepared:
    """Two-year recidivism after the standard screening; the group is Caucasian. ``rejects`` as in ``adult``."""
    raw = with_row_id(_scanned(spark, "text_columns", rejects, path))
    kept = prepare.screened(
        raw, "days_b_screening_arrest", "is_recid", "c_charge_degree", "score_text", "race",
        schemas.COMPAS_GROUPS, as_published,
    )
    numeric = [c for c in schemas.COMPAS_FEATURES if c not in schemas.COMPAS_CATEGORIES]
    typed = kept.select(
        "row_id",
        values.coded("two_year_recid").alias("y"),
        values.matches("race", "Caucasian").alias("a"),
        *[values.numeric(c).alias(c) for c in numeric],
        *schemas.COMPAS_CATEGORIES,
    )
    for c in schemas.COMPAS_CATEGORIES:
        typed = prepare.one_hot(typed, c, prepare.categories_of(c, typed))
    features = prepare.feature_columns(typed, "row_id", "y", "a")
    plain = {c: f"f{i}" for i, c in enumerate(features)}
    named = typed.withColumnsRenamed(plain)
    filled = prepare.impute_medians(named, list(plain.values()))
    return _parted(filled, list(plain.values()), seed, test_share)


def two_d(spark: SparkSession, path: str, seed: int = 42, train_share: float = 0.8, rejects: str | None = None) -> Prepared:
    """The two-feature example; its own client column is kept as ``client``. ``rejects`` as in ``adult``."""
    raw = with_row_id(_scanned(spark, "header_csv", rejects, path, schemas.TWO_D))
    typed = raw.select("row_id", "client", F.col("s").alias("a"), values.to_zero_one("y").alias("y"), "x1", "x2")
    split = splits.split_by_count(typed, "row_id", seed, train_share, ("train", "test"), at_least=1)
    return Prepared(
        split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split"), ["x1", "x2"]
    )


def two_d_as_law(df: DataFrame) -> DataFrame:
    """The two-feature table in the law layout: two features, eight zero ones, group and -1/1 label."""
    return prepare.widened(
        df,
        schemas.LAW_FEATURES,
        [F.col("x1"), F.col("x2")],
        {"race": F.col("s").cast("double"), "pass_bar": F.col("y").cast("double")},
    )


def census_table(spark: SparkSession, folder: str) -> DataFrame:
    """Both census files as one table: mode-filled label codes, log gains, group and label last."""
    train, test = readers.adult_files(spark, folder)
    both = train.unionByName(test).drop("race")
    cleaned = both.withColumns(
        {
            "income": F.replace(F.rtrim(F.trim("income"), F.lit(".")), F.lit(" "), F.lit("")),
            "sex": F.trim("sex"),
            "capital-gain": F.log1p("`capital-gain`"),
            "capital-loss": F.log1p("`capital-loss`"),
        }
    ).withColumnsRenamed({c: c.replace("-", "_") for c in both.columns})
    text = [c.replace("-", "_") for c in ADULT_CATEGORIES]
    filled = prepare.impute_modes(cleaned, text)
    for c in text:
        codes = small_side(dense_codes(filled, c))
        filled = filled.join(codes, c).drop(c).withColumnRenamed("code", c)
    return prepare.positional(filled, "sex", "income")


def credit_table(spark: SparkSession, path: str) -> DataFrame:
    """The card table with signed-log amounts, without ids, group and label last."""
    raw = readers.described_csv(spark, path)
    target = prepare.resolve_column(raw, "default payment next month", "default")
    ids = [c for c in raw.columns if c.lower() in ("id", "unnamed: 0")]
    features = [c for c in raw.columns if c not in (*ids, target)]
    typed = raw.select(*ids, *[values.numeric(F.col(f"`{c}`")).alias(c) for c in features], values.numeric(F.col(f"`{target}`")).alias(target))
    logged = prepare.signed_log_prefixed(typed, "BILL_AMT", "PAY_AMT")
    return prepare.positional(logged, "SEX", "default", drop=ids, rename={target: "default"})
