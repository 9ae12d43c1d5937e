"""One query per operator, over the whole star-schema tables of a folder."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketwise.functions import dates, labels, text
from basketwise.models import store, training
from basketwise.operators import baskets, columns, customers, dashboard, metrics, prepare, profile, ranking, sketches
from basketwise.plans import ingest, jobs
from basketwise.schema import CSV_NAMES
from basketwise.session import ensure_checkpoint_dir, stage, stage_alone
from basketwise.sinks import to_json_records, write_by_household, write_by_month, write_csv
from basketwise.sources import star, tables
from basketwise.sources.csv_files import read_csv_text

REGISTERED = {}

VALUE = "clv_12_month"
CORRELATED = [
    "purchase_count",
    "total_spend",
    "total_units",
    "avg_basket_value",
    "unique_products",
    "tenure",
    "spend_per_visit",
    "product_diversity_ratio",
    "hshd_size",
    "children",
]
SCALED = ["total_spend", "purchase_count", "tenure"]


def query(function):
    REGISTERED[function.__name__] = function
    return function


# Columns of the transactions that a group of queries reads.
KEYS = ["hshd_num", "basket_num", "product_num"]
HISTORY = ["hshd_num", "purchase_date"]
FEATURES = [*KEYS, "purchase_date", "spend", "units", "store_region"]
DEPARTMENT_SPEND = ["hshd_num", "purchase_date", "product_num", "spend"]
SALES = [*KEYS, "spend", "units"]


def _lines(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """The wanted transaction columns, for a query that reads them once."""
    return star.transactions(spark, folder, names)


def _stored_lines(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """The same, joined once and stored, for a query that reads them several times."""
    return stage(star.transactions(spark, folder, names, even=True))


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return star.transactions(spark, folder), star.households(spark, folder), star.products(spark, folder)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; adding 0 drops a minus sign of zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def _digits(name: str, digits: int):
    """A number's first digits: its last bits depend on the order of a sum."""
    number = F.col(name)
    unit = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(number))))
    return F.when(number == 0, F.lit(0.0)).otherwise(F.round(F.round(number * unit) / unit, 6))


# --- scans, projections and profiles ------------------------------------------------


@query
def scan_transactions(spark, folder):
    return star.transactions(spark, folder)


@query
def scan_households(spark, folder):
    return star.households(spark, folder)


@query
def scan_products(spark, folder):
    return star.products(spark, folder)


@query
def prefixed_products(spark, folder):
    return columns.prefix_columns(star.products(spark, folder), "p1_", "product_num")


@query
def renamed_products(spark, folder):
    frame = columns.rename(star.products(spark, folder), {"department": "dept", "commodity": "comm"})
    return frame.drop("brand_type", "natural_organic_flag")


@query
def aligned_households(spark, folder):
    frame = star.households(spark, folder)
    partial = frame.withColumn("children", F.when(F.col("hshd_size") > 3, F.col("children")))
    return columns.align_features(partial, ["children", "hshd_size", "tenure"], keys=["hshd_num"])


@query
def department_names(spark, folder):
    products = star.products(spark, folder)
    mixed = F.concat(F.initcap("department"), F.lit(" "), F.col("commodity"))
    return products.select("product_num", columns.dept_column(mixed).alias("feature"))


@query
def transaction_profile(spark, folder):
    return profile.profile(star.transactions(spark, folder))


@query
def null_report(spark, folder):
    _, households, _ = _tables(spark, folder)
    known = households.withColumn("marital_status", F.nullif(F.col("marital_status"), F.lit("null")))
    return profile.null_columns(known)


@query
def table_row_counts(spark, folder):
    transactions, households, products = _tables(spark, folder)
    return profile.row_counts(transactions=transactions, households=households, products=products)


@query
def product_json(spark, folder):
    return to_json_records(star.products(spark, folder))


# --- text cleaning ------------------------------------------------------------------


def _padded(spark, folder):
    """Customer text with padding, and null words and nulls in place of a segment."""
    key = F.col("c_custkey")
    segment = (
        F.when(key % 7 == 0, F.lit(" NULL  "))
        .when(key % 7 == 1, F.lit("Null"))
        .when(key % 7 == 2, F.lit(None).cast("string"))
        .when(key % 7 == 3, F.lit("   "))
        .otherwise(F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.lit("  ")))
    )
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        key.alias("hshd_num"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"), segment.alias("segment")
    )


@query
def trimmed_text(spark, folder):
    return columns.trim_strings(_padded(spark, folder))


@query
def right_trimmed_text(spark, folder):
    return columns.trim_strings_right(_padded(spark, folder))


@query
def standard_nulls(spark, folder):
    return columns.standardize_nulls(columns.trim_strings(_padded(spark, folder)))


def _number_text(spark, folder):
    """Customer balances as the number texts an extract may hold."""
    key, amount = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    value = (
        F.when(key % 8 == 0, F.concat(F.lit("  "), key.cast("string"), F.lit(" ")))
        .when(key % 8 == 1, amount)
        .when(key % 8 == 2, F.lit("null"))
        .when(key % 8 == 3, F.concat(key.cast("string"), F.lit("+")))
        .when(key % 8 == 4, F.concat(F.lit("-"), key.cast("string"), F.lit(".0")))
        .when(key % 8 == 5, F.lit("inf"))
        .when(key % 8 == 6, F.concat(key.cast("string"), F.lit("d")))
    )
    return spark.read.parquet(f"{folder}/customer.parquet").select(key.alias("hshd_num"), value.alias("value"))


@query
def parsed_numbers(spark, folder):
    value = F.col("value")
    return _number_text(spark, folder).select(
        "hshd_num",
        text.to_int_or_null(value).alias("int_or_null"),
        text.to_int_or_zero(value).alias("int_or_zero"),
        text.to_number_or_zero(value).alias("number_or_zero"),
    )


@query
def parsed_dates(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    written = F.when(F.col("o_orderkey") % 10 == 0, F.lit("no date")).otherwise(F.date_format(day, "dd-MMM-yy"))
    return orders.select(
        F.col("o_orderkey").alias("basket_num"), dates.parse_purchase_date(written).alias("purchase_date")
    )


# --- rejects ------------------------------------------------------------------------


def _raw_lines(spark, folder):
    """Transactions as text, with some broken keys, dates and amounts."""
    lines = star.transactions(spark, folder, even=True)
    as_text = lines.select(*[F.col(c).cast("string").alias(c) for c in lines.columns])
    basket = F.col("basket_num").cast("bigint")
    return as_text.withColumns(
        {
            "product_num": F.when(basket % 11 == 0, F.lit("?")).otherwise(F.col("product_num")),
            "purchase_date": F.when(basket % 13 == 0, F.lit("soon")).otherwise(F.col("purchase_date")),
            "spend": F.when(basket % 17 == 0, F.lit("n/a")).otherwise(F.col("spend")),
            "units": F.when(basket % 19 == 0, F.lit("99999999999")).otherwise(F.col("units")),
        }
    )


def _typed(spark, folder):
    return ingest.type_rows(_raw_lines(spark, folder), "transactions")


@query
def loaded_lines(spark, folder):
    good, _ = ingest.split_valid(_typed(spark, folder))
    return good


@query
def rejected_lines(spark, folder):
    _, rejects = ingest.split_valid(_typed(spark, folder))
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query
def ingest_counts(spark, folder):
    return ingest.load_counts({"transactions": _typed(spark, folder)})


def _raw_extract(spark, folder):
    """The raw lines under the extract's padded headers."""
    raw = _raw_lines(spark, folder)
    padded = [F.concat(F.lit(" "), F.col(c), F.lit("  ")).alias(f" {h} ") for h, c in CSV_NAMES["transactions"].items()]
    day = F.date_format(F.col("purchase_date").try_cast("date"), "dd-MMM-yy")
    return raw.withColumn("purchase_date", day).select(*padded)


@query
def cleaned_extract(spark, folder):
    """The raw lines cleaned as one file."""
    return ingest.clean_transactions(_raw_extract(spark, folder))


@query
def cleaning_steps(spark, folder):
    """What every cleaning step makes of every column, counted while the cleaned file is written."""
    return ingest.store_cleaned(_raw_extract(spark, folder), f"{ensure_checkpoint_dir(spark)}/cleaned-{uuid.uuid4().hex}")


def _padded_extract(frame, kind):
    """A table as an extract: padded headers and values, all text."""
    names = CSV_NAMES[kind].items()
    return frame.select(*[F.concat(F.lit(" "), F.col(c).cast("string"), F.lit("   ")).alias(f" {h}  ") for h, c in names])


def _ingested(spark, folder):
    """The whole tables written as padded CSV extracts and loaded again."""
    place = f"{ensure_checkpoint_dir(spark)}/extracts-{uuid.uuid4().hex}"
    for kind, frame in star.load_tables(spark, folder).items():
        write_csv(_padded_extract(frame, kind), f"{place}/{kind}.csv")
    ingest.ingest(spark, {kind: f"{place}/{kind}.csv" for kind in CSV_NAMES}, f"{place}/tables")
    return tables.load_tables(spark, f"{place}/tables")


@query
def quoted_products(spark, folder):
    """Products whose departments hold commas, quotes and blanks, written and read as CSV."""
    quoted = F.concat(F.lit('" '), F.col("department"), F.lit(', "A"" '))
    frame = star.products(spark, folder).withColumn("department", quoted)
    place = f"{ensure_checkpoint_dir(spark)}/extracts-{uuid.uuid4().hex}"
    write_csv(frame, place)
    return read_csv_text(spark, place)


@query
def repeated_load_counts(spark, folder):
    """Two loads of the same extracts, households and products once per key: the counts of both."""
    place = f"{ensure_checkpoint_dir(spark)}/extracts-{uuid.uuid4().hex}"
    for kind, frame in star.load_tables(spark, folder).items():
        # Every product occurs twice, under two brands; every fifth number cannot be read and becomes 0.
        if kind == "products":
            frame = frame.unionByName(frame.withColumn("brand_type", F.lit("OTHER")))
            number = F.when(F.col("product_num") % 5 == 0, F.lit("?")).otherwise(F.col("product_num").cast("string"))
            frame = frame.withColumn("product_num", number)
        write_csv(_padded_extract(frame, kind), f"{place}/{kind}.csv")
    keys = {"households": ["hshd_num"], "products": ["product_num"]}
    files = {kind: f"{place}/{kind}.csv" for kind in CSV_NAMES}
    loads = [ingest.ingest(spark, files, f"{place}/tables", keys).withColumn("load", F.lit(n)) for n in (1, 2)]
    return loads[0].unionByName(loads[1])


class _Stopped(Exception):
    """Ends a load between two tables."""


@query
def interrupted_load(spark, folder):
    """Rows of each table after a load that ends between two tables, after its repetition and after another one."""
    place = f"{ensure_checkpoint_dir(spark)}/extracts-{uuid.uuid4().hex}"
    files = {kind: f"{place}/{kind}.csv" for kind in CSV_NAMES}
    for kind, frame in star.load_tables(spark, folder).items():
        write_csv(_padded_extract(frame, kind), files[kind])

    def stop(kind):
        if kind == "households":
            raise _Stopped

    with contextlib.suppress(_Stopped):
        ingest.ingest(spark, files, f"{place}/tables", batch="one day", on_stored=stop)
    found = []
    for phase in ("interrupted", "repeated", "repeated again"):
        if phase != "interrupted":
            ingest.ingest(spark, files, f"{place}/tables", batch="one day")
        counts = profile.row_counts(**tables.load_tables(spark, f"{place}/tables"))
        found.append(stage(counts.select(F.lit(phase).alias("phase"), F.col("name").alias("table_name"), "rows")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def missing_file_refused(spark, folder):
    """Whether a load without one of the files is refused, and what it left: S5."""
    place = f"{ensure_checkpoint_dir(spark)}/extracts-{uuid.uuid4().hex}"
    lines = star.transactions(spark, folder)
    write_csv(_padded_extract(lines, "transactions"), f"{place}/transactions.csv")
    refused = []
    for left_out in ("households", "products"):
        files = {kind: f"{place}/{kind}.csv" for kind in CSV_NAMES if kind != left_out}
        try:
            ingest.ingest(spark, files, f"{place}/tables")
        except ValueError:
            refused.append(left_out)
    stored = tables.load_table(spark, f"{place}/tables", "transactions").count()
    given = F.count("*").alias("rows_given")
    return lines.agg(given, F.lit(",".join(refused)).alias("refused"), F.lit(stored).cast("long").alias("rows_stored"))


@query
def ingested_transactions(spark, folder):
    return _ingested(spark, folder)["transactions"]


@query
def ingested_households(spark, folder):
    return _ingested(spark, folder)["households"]


@query
def ingested_products(spark, folder):
    return _ingested(spark, folder)["products"]


# --- household lookup and dashboard -------------------------------------------------


@query
def household_lines(spark, folder):
    transactions, _, products = _tables(spark, folder)
    return dashboard.household_lines(transactions, products, 10)


@query
def demographics_engagement(spark, folder):
    lines = _lines(spark, folder, "hshd_num", "store_region", "spend", "units")
    return dashboard.demographics_engagement(lines, star.households(spark, folder))


@query
def spend_over_time(spark, folder):
    return dashboard.spend_over_time(_lines(spark, folder, "year", "purchase_date", "spend"))


@query
def top_commodities(spark, folder):
    return dashboard.top_commodities(_lines(spark, folder, "product_num"), star.products(spark, folder))


@query
def seasonal_spend(spark, folder):
    return dashboard.seasonal_spend(_lines(spark, folder, "purchase_date", "spend"))


@query
def loyalty_mix(spark, folder):
    return dashboard.loyalty_mix(_lines(spark, folder, "hshd_num"), star.households(spark, folder))


@query
def commodity_units_spend(spark, folder):
    lines = _lines(spark, folder, "product_num", "units", "spend")
    return dashboard.commodity_units_spend(lines, star.products(spark, folder))


@query
def enriched_lines(spark, folder):
    transactions, _, products = _tables(spark, folder)
    return baskets.enrich_lines(transactions, products)


# --- customers ----------------------------------------------------------------------


@query
def cutoff(spark, folder):
    return customers.cutoff(_lines(spark, folder, "purchase_date"))


@query
def training_lines(spark, folder):
    return customers.split_period(_lines(spark, folder, *star.ALL_COLUMNS))[0]


@query
def evaluation_lines(spark, folder):
    return customers.split_period(_lines(spark, folder, *star.ALL_COLUMNS))[1]


@query
def favourite_region(spark, folder):
    return customers.favourite_region(_lines(spark, folder, "hshd_num", "store_region"))


@query
def customer_features(spark, folder):
    return customers.customer_features(_stored_lines(spark, folder, *FEATURES))


@query
def bucketed_customer_features(spark, folder):
    """The same features from lines stored by household."""
    place = uuid.uuid4().hex
    lines = star.transactions(spark, folder, FEATURES, even=True)
    full = lines.withColumns({"week_num": F.lit(None).cast("int"), "year": F.lit(None).cast("int")})
    return customers.customer_features(write_by_household(full, f"lines_{place}", f"{ensure_checkpoint_dir(spark)}/{place}", 16))


def _by_month(spark, folder):
    place = f"{ensure_checkpoint_dir(spark)}/months-{uuid.uuid4().hex}"
    write_by_month(_lines(spark, folder, *star.ALL_COLUMNS), place)
    return tables.read_by_month(spark, place)


@query
def training_lines_by_month(spark, folder):
    return customers.split_period(_by_month(spark, folder))[0]


@query
def evaluation_lines_by_month(spark, folder):
    return customers.split_period(_by_month(spark, folder))[1]


@query
def loose_baskets(spark, folder):
    """Baskets of households when some lines have no basket number."""
    lines = star.transactions(spark, folder, FEATURES, even=True)
    loose = lines.withColumn("basket_num", F.when(F.col("basket_num") % 5 != 0, F.col("basket_num")))
    return _rounded(customers.customer_features(stage(loose)).select("hshd_num", "purchase_count", "avg_basket_value"), 6, "avg_basket_value")


@query
def merged_distinct_counts(spark, folder):
    """Households whose baskets or products, counted by monthly sketches, are off by more than one and five percent."""
    lines = _stored_lines(spark, folder, *KEYS, "purchase_date")
    counts = sketches.merged_counts(stage(sketches.monthly_sketches(lines)))
    exact = lines.groupBy("hshd_num").agg(
        F.countDistinct("basket_num").alias("true_baskets"), F.countDistinct("product_num").alias("true_products")
    )

    def off(name):
        apart = F.abs(F.col(name) - F.col(f"true_{name}"))
        return F.count_if((apart > 1) & (apart > 0.05 * F.col(f"true_{name}"))).alias(f"{name}_off")

    both = counts.join(exact, "hshd_num", "full")
    return both.agg(F.count("lines").alias("households"), F.sum("lines").alias("lines"), off("baskets"), off("products"))


@query
def churned_households(spark, folder):
    return customers.churned_households(_lines(spark, folder, *HISTORY))


@query
def retained_households(spark, folder):
    return customers.retained_households(_lines(spark, folder, *HISTORY))


@query
def churn_label(spark, folder):
    return customers.churn_label(_lines(spark, folder, *HISTORY))


@query
def churn_features(spark, folder):
    return customers.churn_features(_stored_lines(spark, folder, *FEATURES), star.households(spark, folder))


@query
def churn_rate(spark, folder):
    return customers.churn_rate(customers.churn_label(_lines(spark, folder, *HISTORY)))


@query
def category_spend(spark, folder):
    training_part, _ = customers.split_period(_lines(spark, folder, *DEPARTMENT_SPEND))
    return customers.category_spend(training_part, star.products(spark, folder))


@query
def category_pivot(spark, folder):
    training_part, _ = customers.split_period(_lines(spark, folder, *DEPARTMENT_SPEND))
    return customers.category_pivot(training_part, star.products(spark, folder))


@query
def category_maps(spark, folder):
    """The entries of the maps of department spend."""
    training_part, _ = customers.split_period(_lines(spark, folder, *DEPARTMENT_SPEND))
    maps = customers.category_map(training_part, star.products(spark, folder))
    return maps.select("hshd_num", F.explode("department_spend").alias("feature", "spend"))


@query
def future_spend(spark, folder):
    return customers.future_spend(_lines(spark, folder, "hshd_num", "purchase_date", "spend"))


@query
def clv_features(spark, folder):
    lines = _stored_lines(spark, folder, *FEATURES)
    return customers.clv_features(lines, star.products(spark, folder), star.households(spark, folder))


def _clv(spark, folder):
    return stage(clv_features(spark, folder))


def _churn(spark, folder):
    return stage(churn_features(spark, folder))


@query
def clv_summary(spark, folder):
    return _rounded(customers.clv_summary(_clv(spark, folder)), 4, "mean_clv", "median_clv", "max_clv")


@query
def clv_quartiles(spark, folder):
    return _rounded(ranking.quantile_frame(_clv(spark, folder), VALUE, [0.25, 0.5, 0.75]), 4, "quantile")


@query
def churn_correlations(spark, folder):
    return _rounded(metrics.churn_correlations(churn_features(spark, folder), CORRELATED), 6, "correlation")


@query
def clv_histogram(spark, folder):
    return _rounded(metrics.clv_histogram(_clv(spark, folder), VALUE), 4, "low", "high")


@query
def clv_tiers(spark, folder):
    return metrics.clv_tiers(_clv(spark, folder), VALUE).select("hshd_num", VALUE, "clv_tier", "clv_tier_rank")


@query
def tier_summary(spark, folder):
    tiers = metrics.clv_tiers(_clv(spark, folder), VALUE)
    return _rounded(metrics.tier_summary(tiers, VALUE), 4, "avg_clv")


# --- preparation --------------------------------------------------------------------


@query
def one_hot_households(spark, folder):
    households = star.households(spark, folder)
    known = households.withColumn("marital_status", F.nullif(F.col("marital_status"), F.lit("null")))
    return prepare.one_hot(
        known.select("hshd_num", "marital_status", "homeowner_desc", "hshd_size"),
        ["marital_status", "homeowner_desc", "hshd_size"],
    )


@query
def one_hot_with_missing(spark, folder):
    households = star.households(spark, folder)
    known = households.withColumn("marital_status", F.nullif(F.col("marital_status"), F.lit("null")))
    status = known.select("hshd_num", "marital_status")
    return prepare.one_hot(status, ["marital_status"], drop_first=False, dummy_na=True)


@query
def one_hot_entries(spark, folder):
    """The entries of the sparse vectors of some text columns that are 1, by name."""
    households = star.households(spark, folder)
    known = households.withColumn("marital_status", F.nullif(F.col("marital_status"), F.lit("null")))
    text_columns = ["marital_status", "hshd_composition"]
    encoded, model = prepare.one_hot_vector(known.select("hshd_num", *text_columns), text_columns, dummy_na=True)
    names = F.array(*[F.lit(name) for name in prepare.vector_names(model)])
    entries = F.arrays_zip(names.alias("name"), vector_to_array("encoded").alias("value"))
    held = F.transform(F.filter(entries, lambda e: e["value"] == 1), lambda e: e["name"])
    return encoded.select("hshd_num", F.array_join(F.sort_array(held), ",").alias("entries"))


@query
def imputed_products(spark, folder):
    parts = spark.read.parquet(f"{folder}/part.parquet").select(
        F.col("p_partkey").alias("product_num"),
        F.when(F.col("p_size") <= 25, F.col("p_size").cast("double")).alias("size"),
        F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"),
    )
    return _rounded(prepare.impute_mean(parts, ["size", "price"]), 6, "size", "price")


@query
def cleaned_ratios(spark, folder):
    households = star.households(spark, folder)
    children = F.col("children")
    odd = (
        F.when(children == 0, F.lit(float("inf")))
        .when(children == 1, F.lit(float("-inf")))
        .when(children == 2, F.lit(float("nan")))
        .otherwise(F.col("hshd_size").cast("double"))
    )
    frame = households.select("hshd_num", odd.alias("ratio"), odd.alias("ratio_or_zero"))
    return prepare.clean_features(
        prepare.clean_features(frame, ["ratio"]), ["ratio_or_zero"], fill_zero=True
    )


@query
def household_split(spark, folder):
    return prepare.mark_split(star.households(spark, folder).select("hshd_num"), "hshd_num")


@query
def stratified_split(spark, folder):
    return prepare.mark_split(stage(churn_label(spark, folder)), "hshd_num", "churned")


@query
def standardized_features(spark, folder):
    marked = stage(prepare.mark_split(stage(customer_features(spark, folder)), "hshd_num"))
    scaled = prepare.standardize(marked, SCALED, fit_on=marked.where(F.col("is_test") == 0))
    return _rounded(scaled.select("hshd_num", *SCALED), 6, *SCALED)


# --- evaluation ---------------------------------------------------------------------


def _judged(spark, folder):
    """A simple rule in place of a model: few purchases mean churn."""
    features = customers.churn_features(_stored_lines(spark, folder, *FEATURES))
    guess = (F.col("purchase_count") < 10).cast("int").alias("prediction")
    return features.select("hshd_num", "purchase_count", "churned", guess)


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_judged(spark, folder), "churned", "prediction")


@query
def classification_report(spark, folder):
    return _rounded(
        metrics.classification_report(_judged(spark, folder), "churned", "prediction"), 9, "precision", "recall", "f1"
    )


@query
def roc_auc(spark, folder):
    return _rounded(metrics.roc_auc(_judged(spark, folder), "churned", "purchase_count"), 9, "auc")


@query
def roc_auc_binned(spark, folder):
    """The area from a few counters, how far it may be off, and whether the exact one is within that."""
    judged = stage(_judged(spark, folder))
    exact = metrics.roc_auc(judged, "churned", "purchase_count").first()["auc"]
    binned = metrics.roc_auc_binned(judged, "churned", "purchase_count", 8)
    within = (F.abs(F.col("auc") - F.lit(exact)) <= F.col("bound") + 1e-12).alias("within")
    return binned.select(F.round("auc", 9).alias("auc"), F.round("bound", 9).alias("bound"), within)


@query
def regression_metrics(spark, folder):
    lines = _stored_lines(spark, folder, *FEATURES)
    features = customers.clv_features(lines, star.products(spark, folder), departments=[])
    result = metrics.regression_metrics(features, VALUE, "annual_clv")
    return result.select(
        _digits("mse", 9).alias("mse"),
        F.round("rmse", 3).alias("rmse"),
        F.round("mae", 3).alias("mae"),
        F.round("r2", 6).alias("r2"),
    )


# --- baskets ------------------------------------------------------------------------


@query
def multi_item_baskets(spark, folder):
    return baskets.multi_item_baskets(_lines(spark, folder, *KEYS))


@query
def basket_items(spark, folder):
    return baskets.basket_items(_lines(spark, folder, *KEYS))


@query
def basket_count(spark, folder):
    return baskets.basket_count(_lines(spark, folder, "hshd_num", "basket_num"))


@query
def basket_pairs(spark, folder):
    return baskets.basket_pairs(star.transactions(spark, folder, KEYS, even=True))


@query
def top_pairs(spark, folder):
    return baskets.top_pairs(star.transactions(spark, folder, KEYS, even=True))


@query
def product_metadata(spark, folder):
    return baskets.product_metadata(star.products(spark, folder))


@query
def product_stats(spark, folder):
    return baskets.product_stats(_stored_lines(spark, folder, *SALES), star.products(spark, folder))


@query
def loyalty_ratio(spark, folder):
    return baskets.loyalty_ratio(_lines(spark, folder, "hshd_num", "product_num"), star.households(spark, folder))


@query
def product_stats_with_loyalty(spark, folder):
    return baskets.product_stats(_stored_lines(spark, folder, *SALES), star.products(spark, folder), star.households(spark, folder))


def _pair_frame(spark, folder):
    lines = _stored_lines(spark, folder, *SALES)
    pairs = stage(baskets.basket_pairs(lines))
    return baskets.pair_features(pairs, stage(baskets.product_stats(lines, star.products(spark, folder))))


@query
def pair_features(spark, folder):
    return _pair_frame(spark, folder)


@query
def pair_model_data(spark, folder):
    frame = stage(_pair_frame(spark, folder))
    encoded = ["p1_department", "p2_department", "p1_commodity", "p2_commodity"]
    return prepare.one_hot(frame, encoded, drop_first=False, dummy_na=True)


@query
def pair_lookup(spark, folder):
    """The strength of the top pairs, looked up by their reversed order."""
    pairs = stage(basket_pairs(spark, folder))
    best = baskets.rank_pairs(pairs, baskets.TOP_PAIRS)
    reversed_ = best.select(F.col("product2").alias("product1"), F.col("product1").alias("product2"))
    return baskets.pair_strengths(pairs, reversed_)


def _top(spark, folder):
    return stage(top_pairs(spark, folder))


@query
def top_pair_products(spark, folder):
    return baskets.top_pair_products(_top(spark, folder))


@query
def pair_edges(spark, folder):
    return baskets.pair_edges(_top(spark, folder))


@query
def recommendations(spark, folder):
    """The partners of every product that has any, ranked."""
    return baskets.recommendations(basket_pairs(spark, folder))


def _top_and_details(spark, folder):
    """The top pairs and their products' details, from lines joined once."""
    lines = _stored_lines(spark, folder, *KEYS)
    pairs = stage(baskets.top_pairs(lines))
    return pairs, baskets.product_details(pairs, lines, star.products(spark, folder))


@query
def product_details(spark, folder):
    return _top_and_details(spark, folder)[1]


@query
def product_catalog(spark, folder):
    return baskets.product_catalog(_top_and_details(spark, folder)[1])


@query
def top_product_pairs(spark, folder):
    pairs, details = _top_and_details(spark, folder)
    return baskets.top_product_pairs(baskets.recommendations(pairs), stage(details))


@query
def top_pair_labels(spark, folder):
    return baskets.top_pair_labels(top_product_pairs(spark, folder))


def _shared_numbers(lines):
    """Basket numbers that several households use, and some lines without one."""
    number = F.when(F.col("basket_num") % 29 != 0, F.col("basket_num") % 5)
    return lines.withColumn("basket_num", number)


def _recommended(spark, folder, exclude_owned):
    pairs, details = _top_and_details(spark, folder)
    bought = _shared_numbers(_lines(spark, folder, *KEYS))
    return baskets.recommend(bought, baskets.recommendations(pairs), details, exclude_owned, baskets.BASKET)


@query
def recommend(spark, folder):
    return baskets.ordered_recommendations(_recommended(spark, folder, False), baskets.BASKET)


@query
def recommend_new_products(spark, folder):
    return _recommended(spark, folder, True)


@query
def recommended_from_stored_tables(spark, folder):
    """The recommendation job on the artefacts that the basket job stored."""
    place = f"{ensure_checkpoint_dir(spark)}/artefacts-{uuid.uuid4().hex}"
    source = star.load_tables(spark, folder)
    jobs.basket_tables(source, place)
    return jobs.recommend_job(source, place)


@query
def formatted_values(spark, folder):
    """Household balances as money and the share of loyal ones by age as a percentage."""
    homes = star.households(spark, folder)
    loyal = F.avg(F.when(F.col("loyalty_flag") == "Y", 1.0).otherwise(0.0))
    amount = labels.money(F.sum("hshd_size").cast("double") / 4)
    return homes.groupBy("age_range").agg(amount.alias("amount"), labels.percent(loyal).alias("share"))


@query
def strict_dates(spark, folder):
    """Purchase dates as ISO text, read back strictly."""
    text_day = F.date_format("purchase_date", "yyyy-MM-dd")
    lines = _lines(spark, folder, "basket_num", "purchase_date").select("basket_num", text_day.alias("day"))
    return lines.select("basket_num", dates.to_date_strict(F.col("day")).alias("day")).distinct()


@query
def pairs_of_no_lines(spark, folder):
    """Empty input gives empty pairs, details and recommendations."""
    lines = _lines(spark, folder, *KEYS).where("basket_num < 0")
    pairs = baskets.basket_pairs(lines)
    details = baskets.product_details(pairs, lines, star.products(spark, folder))
    recs = baskets.recommend(lines, baskets.recommendations(pairs), details, keys=baskets.BASKET)
    return spark.range(1).select(
        *[F.lit(frame.count()).cast("long").alias(name) for name, frame in (("pairs", pairs), ("details", details), ("recommended", recs))]
    )


@query
def household_labels(spark, folder):
    return star.households(spark, folder).select(
        "hshd_num",
        labels.loyalty(F.col("loyalty_flag")).alias("loyalty"),
        labels.region_age(F.col("homeowner_desc"), F.col("age_range")).alias("segment"),
    )


# --- models -------------------------------------------------------------------------


def _model(spark, kind, frame):
    """The model of a frame, fitted by the first query that needs it and loaded by the others."""
    return store.fitted(f"{ensure_checkpoint_dir(spark)}/models", kind, frame)


def _churn_model(spark, folder):
    return _model(spark, "churn", _churn(spark, folder))


def _clv_model(spark, folder):
    return _model(spark, "clv", _clv(spark, folder))


def _pair_model(spark, folder):
    # The model reads no text; the lines, pairs and products the frame is made of go when it is stored.
    text_names = [f"{side}_{name}" for side in ("p1", "p2") for name in ("department", "commodity")]
    return _model(spark, "pair", stage_alone(spark, lambda: _pair_frame(spark, folder).drop(*text_names)))


def _probability_facts(scored, score):
    """Rows, keys and scores outside 0 to 1 of a scored frame."""
    outside = F.col(score).isNull() | (F.col(score) < 0) | (F.col(score) > 1)
    return scored.agg(
        F.count("*").alias("rows"), F.countDistinct("hshd_num").alias("households"), F.count_if(outside).alias("outside")
    )


def _order_facts(ranked, value):
    """Rows of a ranking, and how many do not follow on the one before."""
    # A ranking of households is checked in the order it is returned in, part by part.
    place = F.monotonically_increasing_id().alias("place")
    marked = stage(ranked.select("hshd_num", value, place))
    before = Window.partitionBy(F.shiftright("place", 33)).orderBy("place")
    wrong = (F.lag(value).over(before) < F.col(value)) | (
        (F.lag(value).over(before) == F.col(value)) & (F.lag("hshd_num").over(before) > F.col("hshd_num"))
    )
    return marked.select("hshd_num", wrong.alias("wrong")).agg(
        F.countDistinct("hshd_num").alias("households"), F.count_if("wrong").alias("out_of_order")
    )


def _importance_facts(trained):
    """The importances of all features add up to 1, none is negative and the list falls."""
    ranked = training.feature_importance(trained.model, None, trained.data.sparkSession)
    behind = F.lag("importance").over(Window.orderBy(F.desc("importance"), "feature")) < F.col("importance")
    return ranked.select("feature", "importance", behind.alias("behind")).agg(
        F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("importance") < 0).alias("negative"),
        F.count_if("behind").alias("out_of_order"),
        (F.count("*") - F.countDistinct("feature")).alias("repeated"),
    )


@query
def churn_score_facts(spark, folder):
    trained = _churn_model(spark, folder)
    scored = training.score_churn(trained.model, trained.data)
    wrong_label = F.count_if((F.col("churn_prob") > 0.5) != (F.col("prediction") == 1.0)).alias("wrong_class")
    facts = _probability_facts(scored, "churn_prob").withColumn("one", F.lit(1))
    sums = scored.agg(F.sum(F.col("churned").cast("long")).alias("churned"), wrong_label).withColumn("one", F.lit(1))
    return facts.join(sums, "one").drop("one")


@query
def churn_risk_facts(spark, folder):
    trained = _churn_model(spark, folder)
    return _order_facts(training.churn_risk(training.score_churn(trained.model, trained.data)), "churn_prob")


@query
def churn_test_facts(spark, folder):
    """The four cells of the test set add up to its rows, by label."""
    trained = _churn_model(spark, folder)
    cells = metrics.confusion_matrix(training.score_churn(trained.model, trained.test), "churned", "prediction")
    return cells.groupBy("label").agg(F.sum("count").alias("rows"))


@query
def churn_skill_facts(spark, folder):
    """Whether the scores order all households better than their number of purchases does, and how well that does."""
    trained = _churn_model(spark, folder)
    scored = stage(training.score_churn(trained.model, trained.data).select("churned", "churn_prob", (-F.col("purchase_count")).alias("fewer")))
    own, column = (metrics.roc_auc(scored, "churned", name).first()["auc"] for name in ("churn_prob", "fewer"))
    return scored.agg(
        F.count("*").alias("households"), F.round(F.lit(column), 9).alias("column_auc"), F.lit(own > column).alias("better_than_purchases")
    )


@query
def clv_skill_facts(spark, folder):
    """Whether held-out values are explained by more than half."""
    trained = _clv_model(spark, folder)
    scored = trained.model.transform(trained.test)
    r2 = metrics.regression_metrics(scored, VALUE, "prediction").first()["r2"]
    return scored.agg(F.count("*").alias("rows"), F.lit(r2 > 0.5).alias("explains_half"))


@query
def pair_skill_facts(spark, folder):
    """Whether the counts of all pairs are met better than by their mean."""
    trained = _pair_model(spark, folder)
    scored = stage(training.score_pairs(trained.model, trained.data).select("normalized_count", "prediction"))
    r2 = metrics.regression_metrics(scored, "normalized_count", "prediction").first()["r2"]
    return scored.agg(F.count("*").alias("rows"), F.lit(r2 > 0.001).alias("better_than_mean"))


@query
def churn_importance_facts(spark, folder):
    return _importance_facts(_churn_model(spark, folder))


@query
def clv_score_facts(spark, folder):
    """Households per tier of the predicted value; ties aside, quarters."""
    trained = _clv_model(spark, folder)
    scored = training.score_clv(trained.model, trained.data)
    return scored.agg(
        F.count("*").alias("rows"),
        F.countDistinct("hshd_num").alias("households"),
        F.count_if(F.col("predicted_clv").isNull() | (F.col("predicted_clv") < 0)).alias("outside"),
        F.countDistinct("clv_tier").alias("tiers"),
        F.round(F.sum("clv_12_month"), 2).alias("true_total"),
    )


@query
def clv_ranking_facts(spark, folder):
    trained = _clv_model(spark, folder)
    return _order_facts(training.clv_ranking(training.score_clv(trained.model, trained.data)), "predicted_clv")


@query
def clv_importance_facts(spark, folder):
    return _importance_facts(_clv_model(spark, folder))


@query
def pair_score_facts(spark, folder):
    trained = _pair_model(spark, folder)
    scored = training.score_pairs(trained.model, trained.data)
    return scored.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("missing"),
        F.round(F.sum("normalized_count"), 6).alias("true_total"),
    )


@query
def pair_importance_facts(spark, folder):
    return _importance_facts(_pair_model(spark, folder))


@query
def stored_model_facts(spark, folder):
    """Households whose churn score differs after the model was stored and loaded again."""
    trained = _churn_model(spark, folder)
    place = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    training.save_model(trained.model, place)
    first, again = (
        training.score_churn(model, trained.data).select("hshd_num", F.col("churn_prob").alias(name))
        for model, name in ((trained.model, "first"), (training.load_model(place), "again"))
    )
    both = first.join(again, "hshd_num")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("first") != F.col("again")).alias("different"))


@query
def churn_scores(spark, folder):
    trained = _churn_model(spark, folder)
    return training.score_churn(trained.model, trained.data).select("hshd_num", "churn_prob", "churned")


@query
def churn_risk(spark, folder):
    trained = _churn_model(spark, folder)
    return training.churn_risk(training.score_churn(trained.model, trained.data), 20)


@query
def churn_model_report(spark, folder):
    trained = _churn_model(spark, folder)
    return metrics.classification_report(training.score_churn(trained.model, trained.test), "churned", "prediction")


@query
def churn_model_confusion(spark, folder):
    trained = _churn_model(spark, folder)
    return metrics.confusion_matrix(training.score_churn(trained.model, trained.test), "churned", "prediction")


@query
def churn_model_auc(spark, folder):
    trained = _churn_model(spark, folder)
    return metrics.roc_auc(training.score_churn(trained.model, trained.test), "churned", "churn_prob")


@query
def churn_importance(spark, folder):
    return training.feature_importance(_churn_model(spark, folder).model, 10, spark)


@query
def clv_scores(spark, folder):
    trained = _clv_model(spark, folder)
    return training.score_clv(trained.model, trained.data).select("hshd_num", "predicted_clv", "clv_tier")


@query
def clv_ranking(spark, folder):
    trained = _clv_model(spark, folder)
    return training.clv_ranking(training.score_clv(trained.model, trained.data))


@query
def clv_model_tiers(spark, folder):
    trained = _clv_model(spark, folder)
    return metrics.tier_summary(training.score_clv(trained.model, trained.data), "predicted_clv")


@query
def clv_model_histogram(spark, folder):
    trained = _clv_model(spark, folder)
    return metrics.clv_histogram(training.score_clv(trained.model, trained.data), "predicted_clv")


@query
def clv_model_metrics(spark, folder):
    trained = _clv_model(spark, folder)
    return metrics.regression_metrics(trained.model.transform(trained.test), VALUE, "prediction")


@query
def clv_importance(spark, folder):
    return training.feature_importance(_clv_model(spark, folder).model, 10, spark)


@query
def pair_model_metrics(spark, folder):
    trained = _pair_model(spark, folder)
    scored = training.score_pairs(trained.model, trained.test)
    return metrics.regression_metrics(scored, "normalized_count", "prediction").select("rmse", "r2")


@query
def pair_model_scores(spark, folder):
    trained = _pair_model(spark, folder)
    return training.score_pairs(trained.model, trained.data).select("product1", "product2", "prediction")


@query
def pair_importance(spark, folder):
    return training.feature_importance(_pair_model(spark, folder).model, 10, spark)


