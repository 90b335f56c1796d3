"""Reads of the source table and its change log (backfill pages, change pages,
point lookups), written so that filters reach the scan and nothing is paged
by a global row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ms(window_ms: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_ms / 1000.0))


def scan_keyset_page(products: DataFrame, after_id, target_id, limit: int, key: str = "id") -> DataFrame:
    """Next page strictly after the cursor and not beyond the snapshot target.
    orderBy+limit plans as TakeOrderedAndProject (per-partition top-k)."""
    k = F.col(key)
    return products.where((k > after_id) & (k <= target_id)).orderBy(key).limit(limit)


def snapshot_high_water(products: DataFrame, key: str = "id") -> DataFrame:
    """Target of a backfill, fixed when it starts: max key, 0 for an empty table."""
    return products.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("target_max_id"))


def key_ranges(after_id: int, target_id: int, width: int) -> list[tuple[int, int]]:
    """Split ``(after_id, target_id]`` into half-open key ranges of ``width`` keys.
    Pure arithmetic on two numbers; no data goes through the driver."""
    out = []
    lo = after_id
    while lo < target_id:
        hi = min(lo + width, target_id)
        out.append((lo, hi))
        lo = hi
    return out


def range_column(key: Column, after_id: int, width: int) -> Column:
    """Index of the key range ``(after + i*w, after + (i+1)*w]`` a key falls in."""
    return F.floor((key - F.lit(after_id) - 1) / F.lit(width)).cast("long")


def scan_backfill_range(products: DataFrame, after_id, target_id, key: str = "id",
                        range_width: int = 500, after_lit: int = 0) -> DataFrame:
    """The whole bounded pass ``(after, target]``: one parallel read (pushed
    range filter), each row tagged with its key range so ranges can be written
    and recorded independently. Not one page at a time."""
    k = F.col(key)
    return (products.where((k > after_id) & (k <= target_id))
            .withColumn("range_id", range_column(k, after_lit, range_width)))


def scan_changes(change_log: DataFrame, cursor, as_of, window_ms: int, limit: int | None) -> DataFrame:
    """Changes after the cursor that are older than the safety window at
    ``as_of`` (an argument, never now()), in seq order, at most ``limit``."""
    page = change_log.where((F.col("seq") > cursor) & (F.col("changed_at") <= as_of - _ms(window_ms)))
    # a page (limit) is a top-k in seq order; the whole safe prefix is left
    # unordered (its consumers aggregate), so no global sort is planned
    return page.orderBy("seq").limit(limit) if limit else page


def scan_changes_prefix_safe(change_log: DataFrame, cursor, as_of, window_ms: int,
                             limit: int | None) -> DataFrame:
    """Like ``scan_changes`` but prefix-closed: stop before the first change
    still inside the window, so the cursor can never step over a young low
    seq. The stop position is a scalar subquery (one value), no cross join."""
    after = change_log.where(F.col("seq") > cursor)
    young = after.where(F.col("changed_at") > as_of - _ms(window_ms)).agg(F.min("seq")).scalar()
    page = after.where(F.coalesce(F.col("seq") < young, F.lit(True)))  # none young: all
    return page.orderBy("seq").limit(limit) if limit else page


def lookup_by_ids(products: DataFrame, ids: DataFrame, key: str = "id", id_col: str | None = None) -> DataFrame:
    """Rows whose key is in ``ids`` (a DataFrame, never a collected list).
    AQE picks the join from the sizes at runtime."""
    id_col = id_col or key
    return products.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_semi")


def source_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count(F.lit(1)).alias("n"))


# Fixed values of the row generator (categories, brands, colors of the seed).
CATEGORIES = ["electronics", "books", "garden", "toys", "sports", "kitchen", "fashion", "auto",
              "beauty", "office", "pets", "music"]
BRANDS = ["acme", "globex", "initech", "umbrella", "stark", "wayne", "hooli", "vandelay"]
COLORS = ["red", "blue", "green", "black", "white", "silver", "gold"]


def product_rows(keys: DataFrame, seed: int = 42, as_of=None) -> DataFrame:
    """Source rows for a DataFrame of keys (column ``id``): deterministic
    columns follow the seed rules, price/stock/weight use ``rand(seed)``."""
    g = F.col("id")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    brands = F.array(*[F.lit(b) for b in BRANDS])
    colors = F.array(*[F.lit(c) for c in COLORS])
    cat = F.element_at(cats, (g % 12 + 1).cast("int"))
    brand = F.element_at(brands, (g % 8 + 1).cast("int"))
    attrs = F.to_json(F.struct(
        brand.alias("brand"),
        F.element_at(colors, ((g * 7) % 7 + 1).cast("int")).alias("color"),
        F.round(F.rand(seed + 2) * 50, 3).alias("weight_kg"),
        F.array(cat, F.element_at(colors, (g % 7 + 1).cast("int"))).alias("tags"),
        F.repeat(F.md5(g.cast("string")), 4).alias("description"),
    ))
    ts = as_of if as_of is not None else F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return keys.select(
        g.alias("id"),
        F.concat(F.lit("SKU-"), F.lpad(g.cast("string"), 9, "0")).alias("sku"),
        F.concat(F.initcap(brand), F.lit(" "), cat, F.lit(" item "), g.cast("string")).alias("name"),
        cat.alias("category"),
        F.round(F.rand(seed) * 990 + 10, 2).alias("price"),
        F.round(F.rand(seed + 1) * 1000).cast("long").alias("stock"),
        attrs.alias("attributes"),
        F.lit(1).cast("long").alias("version"),
        ts.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


def generate_rows(spark: SparkSession, n: int, seed: int = 42, start: int = 1,
                  num_partitions: int | None = None, as_of=None) -> DataFrame:
    """Distributed row generator: ``spark.range`` split over partitions, each
    task builds its rows from column expressions; no driver-side data."""
    return product_rows(spark.range(start, start + n, numPartitions=num_partitions), seed, as_of)
