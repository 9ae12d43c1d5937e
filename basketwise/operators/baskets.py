"""Product pairs in baskets, product and pair features, and recommendations.

A basket is a (household, basket number). Pairs are unordered and keep the product
whose number comes first as text in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketwise.functions import labels, ratios
from basketwise.operators.columns import has_columns, prefix_columns
from basketwise.operators.dimension import sum_by_dimension
from basketwise.operators.skew import heavy_keys_and_rows, join_spread
from basketwise.schema import MONEY_TOTAL
from basketwise.session import BROADCAST_ROWS, dealt_by_rows, fits_broadcast, stage

BASKET = ["hshd_num", "basket_num"]
TOP_PAIRS = 200
PER_PRODUCT = 5

# Products of a basket that are paired within one task.
BLOCK_PRODUCTS = 4_096

# Products whose pairs are counted first, to learn what a top pair must reach.
SEED_PRODUCTS = 256

# Up to so many lines all pairs are counted; beyond, pairs that cannot be top ones are left out first.
DIRECT_LINES = 5_000_000
# Counters that pairs are counted in by their hash.
PAIR_COUNTERS = 1 << 22


def enrich_lines(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their product's attributes; lines of unknown products are kept.

    Products are sent to the lines if their size allows it, or else those of the products
    with most lines (`join_spread`).
    """
    return join_spread(transactions, products, ["product_num"])


def basket_items(transactions: DataFrame) -> DataFrame:
    """Distinct products of each basket; lines that lack a part of the key are left out."""
    known = F.lit(True)
    for name in [*BASKET, "product_num"]:
        known = known & F.col(name).isNotNull()
    items = transactions.where(known).select(*BASKET, "product_num")
    # Dealt out before they are made distinct, as a task that does so for a large part of the lines holds them.
    return dealt_by_rows(items, items.count(), *BASKET, "product_num").distinct()


def multi_item_baskets(transactions: DataFrame) -> DataFrame:
    """Baskets of at least two distinct products, with the number of products."""
    sizes = basket_items(transactions).groupBy(*BASKET).agg(F.count(F.lit(1)).alias("products"))
    return sizes.where(F.col("products") >= 2)


def _known_items(transactions: DataFrame) -> DataFrame:
    return transactions.dropna(subset=[*BASKET, "product_num"]).select(*BASKET, "product_num")


def _paired(lines: DataFrame, block_products: int) -> DataFrame:
    """(low, high): one row for each basket and pair of its products.

    Lines are shuffled once, by basket. Their distinct products, the size of the basket and
    the products before each of them all need that one order. Baskets of more than `block_products`
    products go another way, and so do the few that hold a large share of all lines.
    """
    items = _known_items(lines)
    heavy, rows = heavy_keys_and_rows(items, BASKET)
    normal = items if heavy is None else items.join(F.broadcast(heavy), BASKET, "left_anti")
    own = dealt_by_rows(normal, rows, *BASKET).distinct()
    ordered = Window.partitionBy(*BASKET).orderBy("product_num")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("products", F.count(F.lit(1)).over(whole))
    narrow = own.where((F.col("products") >= 2) & (F.col("products") <= block_products))
    lows = F.collect_list("product_num").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    pairs = narrow.select(lows.alias("lows"), F.col("product_num").alias("high")).select(F.explode("lows").alias("low"), "high")
    blocks = F.ceil(F.col("products") / F.lit(block_products)).cast("int")
    if _may_be_wide(normal, rows, block_products):
        wide = own.where(F.col("products") > block_products).withColumn("blocks", blocks)
        pairs = pairs.unionByName(_paired_in_blocks(wide))
    if heavy is not None:
        most = items.join(F.broadcast(heavy), BASKET, "left_semi").distinct()
        sizes = most.groupBy(*BASKET).agg(F.count(F.lit(1)).alias("products")).withColumn("blocks", blocks)
        # As many rows as there are heavy baskets.
        pairs = pairs.unionByName(_paired_in_blocks(most.join(F.broadcast(sizes), BASKET)))
    return pairs


def _may_be_wide(items: DataFrame, rows: int, block_products: int) -> bool:
    """Whether a basket may have more than `block_products` products.

    Rows are counted by the hash of their basket, a quarter of `block_products` in a counter
    on average. A counter holds at least the rows of each of its baskets.
    """
    if rows <= block_products:
        return False
    counters = min(PAIR_COUNTERS, -(-4 * rows // block_products))
    sums = items.groupBy(F.pmod(F.xxhash64(*BASKET), F.lit(counters)).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return not sums.where(F.col("n") > F.lit(block_products)).isEmpty()


def _paired_in_blocks(items: DataFrame) -> DataFrame:
    """The pairs of baskets of any size, from their distinct products and numbers of blocks.

    A basket is cut into blocks, and every pair of blocks is joined under a key of its
    own. No task then pairs more than about two blocks, however large the basket, and
    each pair is met exactly once.
    """
    placed = items.withColumn("block", F.pmod(F.xxhash64("product_num"), F.col("blocks")).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    lows = placed.select(*BASKET, F.col("product_num").alias("low"), F.col("block").alias("low_block"), every_block.alias("high_block"))
    highs = placed.select(*BASKET, F.col("product_num").alias("high"), every_block.alias("low_block"), F.col("block").alias("high_block"))
    return lows.join(highs, [*BASKET, "low_block", "high_block"]).where(F.col("low") < F.col("high")).select("low", "high")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("low", "high").agg(F.count(F.lit(1)).alias("count"))


def _possible_pairs(pairs: DataFrame, floor: int, counters: int = PAIR_COUNTERS) -> DataFrame:
    """Those pairs that may be in `floor` baskets.

    All pairs are first counted by their hash in a fixed number of counters, which tasks
    combine before they send them on. A counter holds at least the count of each of its
    pairs, so the pairs of a smaller one are left out where they arise, unshuffled.
    """
    place = F.pmod(F.xxhash64("low", "high"), F.lit(counters))
    sums = pairs.groupBy(place.alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    large = stage(sums.where(F.col("n") >= F.lit(floor)).select(F.col("counter").cast("int").alias("counter")))
    # At most `counters` numbers of four bytes.
    kept = pairs.withColumn("counter", place.cast("int")).join(F.broadcast(large), "counter", "left_semi")
    return kept.select("low", "high")


def _in_text_order(pairs: DataFrame) -> DataFrame:
    low_first = F.col("low").cast("string") < F.col("high").cast("string")
    return pairs.select(
        F.when(low_first, F.col("low")).otherwise(F.col("high")).alias("product1"),
        F.when(low_first, F.col("high")).otherwise(F.col("low")).alias("product2"),
        "count",
    )


def basket_pairs(transactions: DataFrame, block_products: int = BLOCK_PRODUCTS) -> DataFrame:
    """All pairs of products bought in one basket, with the number of such baskets."""
    return _in_text_order(_counted(_paired(transactions, block_products)))


def rank_pairs(pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Pairs by falling count, ties by product numbers; the first `n` if given."""
    ranked = pairs.orderBy(F.desc("count"), "product1", "product2")
    return ranked if n is None else ranked.limit(n)


def top_pairs(
    transactions: DataFrame,
    n: int = TOP_PAIRS,
    seed_products: int = SEED_PRODUCTS,
    block_products: int = BLOCK_PRODUCTS,
    direct_lines: int = DIRECT_LINES,
) -> DataFrame:
    """The `n` most frequent pairs, the same as ranking all pairs.

    With more than `direct_lines` lines, most pairs are never counted. The n-th count among
    the pairs of the most frequent products is a floor for the n-th count of all. A pair is
    in no more baskets than either of its products, so products in fewer baskets are not
    paired, and a pair is in no more baskets than its counter says (`_possible_pairs`).
    """
    if transactions.count() <= direct_lines:
        return rank_pairs(basket_pairs(transactions, block_products), n)
    items = stage(basket_items(transactions))
    support = items.groupBy("product_num").agg(F.count(F.lit(1)).alias("baskets"))
    seeds = support.orderBy(F.desc("baskets"), "product_num").limit(seed_products).select("product_num")
    seed_pairs = _counted(_paired(items.join(F.broadcast(seeds), "product_num", "left_semi"), block_products))
    floor = (
        seed_pairs.orderBy(F.desc("count")).limit(n).agg(
            F.when(F.count(F.lit(1)) >= n, F.min("count")).otherwise(F.lit(1)).alias("floor")
        )
    ).first()["floor"]
    if floor > 1:
        frequent = support.where(F.col("baskets") >= F.lit(floor)).select("product_num")
        items = stage(join_spread(items, frequent, ["product_num"], "left_semi").select(*BASKET, "product_num"))
    pairs = _paired(items, block_products)
    if floor > 1:
        pairs = _possible_pairs(pairs, floor)
    return rank_pairs(_in_text_order(_counted(pairs).where(F.col("count") >= F.lit(floor))), n)


def basket_count(transactions: DataFrame) -> DataFrame:
    """One row: the number of distinct (household, basket)."""
    return transactions.select(*BASKET).distinct().agg(F.count(F.lit(1)).alias("total_baskets"))


def product_metadata(products: DataFrame) -> DataFrame:
    """Distinct department and commodity per product, as far as the table has them."""
    names = [c for c in ("department", "commodity") if has_columns(products, [c])]
    return products.select("product_num", *names).distinct()


def product_stats(transactions: DataFrame, products: DataFrame, households: DataFrame | None = None) -> DataFrame:
    """Spend, units, line count, metadata and purchase frequency of each sold product.

    The frequency is the product's lines over all baskets. With households, the
    share of lines bought by loyal ones is added.
    """
    baskets = basket_count(transactions).scalar()
    stats = (
        transactions.where(F.col("product_num").isNotNull())
        .groupBy("product_num")
        .agg(
            F.try_divide(F.sum("spend").cast("double"), F.count("spend").cast("double")).alias("avg_spend"),
            F.coalesce(F.sum("spend"), F.lit(0)).cast(MONEY_TOTAL).alias("total_spend"),
            F.count("basket_num").alias("purchase_count"),
            F.try_divide(F.sum("units").cast("double"), F.count("units").cast("double")).alias("avg_units"),
            F.coalesce(F.sum(F.col("units").cast("bigint")), F.lit(0)).alias("total_units"),
        )
        .join(product_metadata(products), "product_num", "left")
        .withColumn("purchase_frequency", ratios.real(F.col("purchase_count")) / ratios.real(baskets))
    )
    if households is not None:
        stats = stats.join(loyalty_ratio(transactions, households), "product_num", "left")
    return stats.withColumnRenamed("product_num", "product_id")


def loyalty_ratio(transactions: DataFrame, households: DataFrame, **options) -> DataFrame:
    """Share of each product's lines that loyal households bought."""
    lines = transactions.where(F.col("product_num").isNotNull())
    counts = sum_by_dimension(
        lines,
        households,
        "hshd_num",
        ["product_num", "loyalty_flag"],
        {"lines": F.lit(1).cast("bigint")},
        **options,
    )
    loyal = F.sum(F.when(F.col("loyalty_flag") == "Y", F.col("lines")).otherwise(F.lit(0)))
    return counts.groupBy("product_num").agg(
        (loyal.cast("double") / F.sum("lines").cast("double")).alias("loyalty_ratio")
    )


def pair_features(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs with the stats of both products and the combined features.

    `pairs` is read twice, once for the largest count, and more often if there are more
    products than can be sent to the pairs: then a product in very many pairs has its stats
    sent to them, and only the others are shuffled (`join_spread`).
    """
    largest = pairs.agg(F.max("count").alias("largest")).scalar()
    stats = stats.withColumns({c: F.col(c).cast("double") for c in ("total_spend",)})
    first = prefix_columns(stats, "p1_", "product_id").withColumnRenamed("product_id", "product1")
    second = prefix_columns(stats, "p2_", "product_id").withColumnRenamed("product_id", "product2")
    joined = join_spread(join_spread(pairs, first, ["product1"]), second, ["product2"])
    department = has_columns(joined, ["p1_department", "p2_department"])
    return joined.select(
        "product1",
        "product2",
        "count",
        *[c for c in joined.columns if c.startswith(("p1_", "p2_"))],
        (F.col("p1_purchase_frequency") + F.col("p2_purchase_frequency")).alias("total_frequency"),
        ratios.price_similarity(F.col("p1_avg_spend"), F.col("p2_avg_spend")).alias("price_similarity"),
        (ratios.same(F.col("p1_department"), F.col("p2_department")) if department else F.lit(0)).alias(
            "same_department"
        ),
        (ratios.real(F.col("count")) / ratios.real(largest)).alias("normalized_count"),
    )


def pair_lookup(model_data: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the pair frame for the wanted (product1, product2), in either order."""
    swapped = wanted.select(F.col("product2").alias("product1"), F.col("product1").alias("product2"))
    either = wanted.select("product1", "product2").unionByName(swapped).distinct()
    return model_data.join(either, ["product1", "product2"], "left_semi")


def pair_strengths(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The normalized count of the wanted pairs, in either order, from the counts alone.

    `pairs` is read twice, once for the largest count.
    """
    largest = pairs.agg(F.max("count").alias("largest")).scalar()
    normalized = (ratios.real(F.col("count")) / ratios.real(largest)).alias("normalized_count")
    return pair_lookup(pairs, wanted).select("product1", "product2", normalized)


def top_pair_products(pairs: DataFrame) -> DataFrame:
    """Distinct products on either side of some pairs."""
    second = pairs.select(F.col("product2").alias("product_num"))
    return pairs.select(F.col("product1").alias("product_num")).union(second).distinct()


def pair_edges(pairs: DataFrame) -> DataFrame:
    """Each pair as two directed edges (src, dst, count); `pairs` is read once."""
    ways = (("product1", "product2"), ("product2", "product1"))
    edges = [F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col("count").alias("count")) for src, dst in ways]
    return pairs.select(F.inline(F.array(*edges)))


def recommendations(pairs: DataFrame) -> DataFrame:
    """Edges with their rank among the edges of their source, the largest count first."""
    order = Window.partitionBy("src").orderBy(F.desc("count"), "dst")
    return pair_edges(pairs).withColumn("rank", F.row_number().over(order))


def product_details(pairs: DataFrame, transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Catalog of the products in some top pairs.

    Frequency is null for a product without lines. Only the lines of the products
    asked for are aggregated.
    """
    wanted = _small(top_pair_products(pairs))
    lines = transactions.join(wanted, "product_num", "left_semi")
    baskets = basket_count(transactions).scalar()
    counts = lines.groupBy("product_num").agg(F.count("basket_num").alias("purchase_count"))
    return (
        top_pair_products(pairs)
        .join(counts, "product_num", "left")
        .join(product_metadata(products.join(wanted, "product_num", "left_semi")), "product_num", "left")
        .select(
            "product_num",
            (ratios.real(F.col("purchase_count")) / ratios.real(baskets)).alias("frequency"),
            "department",
            "commodity",
        )
    )


def _small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if its size allows it, else left to a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def product_catalog(details: DataFrame) -> DataFrame:
    """Listing of the catalog for a product picker."""
    return details.select(
        F.col("product_num").alias("id"),
        "department",
        "commodity",
        labels.product(F.col("department"), F.col("commodity")).alias("label"),
    )


def top_product_pairs(recs: DataFrame, details: DataFrame, k: int = PER_PRODUCT) -> DataFrame:
    """The first `k` recommendations of each product whose both sides have details."""

    def side(n: int) -> DataFrame:
        return details.select(
            F.col("product_num").alias(f"product{n}_num"),
            F.col("department").alias(f"product{n}_dept"),
            F.col("commodity").alias(f"product{n}_comm"),
        )

    best = recs.where(F.col("rank") <= k).select(
        F.col("src").alias("product1_num"),
        F.col("dst").alias("product2_num"),
        F.col("count").alias("co_occurrence_count"),
    )
    return (
        best.join(side(1), "product1_num")
        .join(side(2), "product2_num")
        .select(
            "product1_num",
            "product1_dept",
            "product1_comm",
            "product2_num",
            "product2_dept",
            "product2_comm",
            "co_occurrence_count",
        )
        .distinct()
    )


def top_pair_labels(top: DataFrame) -> DataFrame:
    """Listing of the top pairs: a label and the count."""
    sides = [F.col(f"product{n}_{part}") for n in (1, 2) for part in ("dept", "comm")]
    return top.select(labels.product_pair(*sides).alias("pair"), F.col("co_occurrence_count").alias("count"))


def recommend(
    baskets: DataFrame,
    recs: DataFrame,
    details: DataFrame,
    exclude_owned: bool = False,
    keys: Sequence[str] = ("basket_id",),
) -> DataFrame:
    """Products recommended for every basket of rows (keys, product_num).

    A basket is what its key columns together name; rows with a null key belong to none.

    A product's weight is the sum of its counts over the items of the basket, an
    item listed twice counting twice; the score is the weight over the largest
    weight of the basket. Baskets without any recommendation give no rows.
    """
    # Repeated items are merged before the join and weighted afterwards.
    named = baskets.dropna(subset=list(keys))
    items = named.groupBy(*keys, "product_num").agg(F.count(F.lit(1)).alias("times"))
    edges = _small(recs.select("src", "dst", "count"))
    weights = (
        items.join(edges, F.col("product_num") == F.col("src"))
        .groupBy(*keys, "dst")
        .agg(F.sum(F.col("count") * F.col("times")).alias("weight"))
    )
    if exclude_owned:
        owned = items.select(*keys, F.col("product_num").alias("dst"))
        weights = weights.join(owned, [*keys, "dst"], "left_anti")
    best = F.max("weight").over(Window.partitionBy(*keys))
    scored = weights.withColumn("score", ratios.real(F.col("weight")) / ratios.real(best))
    names = details.select(F.col("product_num").alias("dst"), "department", "commodity")
    return scored.join(names, "dst", "left").select(
        *keys,
        F.col("dst").alias("product_num"),
        F.coalesce("department", F.lit(labels.UNKNOWN)).alias("department"),
        F.coalesce("commodity", F.lit(labels.UNKNOWN)).alias("commodity"),
        "score",
    )


def ordered_recommendations(recommended: DataFrame, keys: Sequence[str] = ("basket_id",)) -> DataFrame:
    """Recommendations by basket, the best score first, ties by product number."""
    return recommended.orderBy(*keys, F.desc("score"), "product_num")
