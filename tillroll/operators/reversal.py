"""Matching sales to the cancellations that reverse them.

A sale is *reversed* when a cancellation exists for the same customer,
product and unit price, with the opposite (negative) quantity of the same
size, dated at or after the sale.  "Exists a cancel at or after t" equals
"the latest such cancel is at or after t", so the cancellations are first
reduced to one row per match key (``max`` of the date, partially aggregated),
written once and counted.  How sales meet this index goes by that count:

* up to ``BROADCAST_KEYS`` keys the index itself is broadcast: no sale moves;
* up to ``MOST_BUCKETS`` buckets of keys, a *key sketch* is broadcast: a Bloom
  filter whose ``BITS_SET`` bits of a key all lie in one bucket of 4 KB.  Sales
  whose key it excludes can't be reversed and pass on where they are; only the
  few candidates are shuffled to the index;
* beyond, sales join the index by key (adaptive execution splits skewed keys).

The sketch never excludes a key of the index, so all three give the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.storage import written

MATCH_KEYS = ["customer_id", "stock_code", "unit_price", "quantity"]
#: Broadcast bounds: an index of so many short rows, or so many buckets of 4 KB (32 MB).
BROADCAST_KEYS = 100_000
MOST_BUCKETS = 8192
BUCKET_BITS, WORD_BITS = 32_768, 64
BITS_PER_KEY, BITS_SET = 16, 3


def reversal_index(cancels: DataFrame) -> DataFrame:
    """One row per match key with the latest reversal time."""
    return (
        cancels.where((F.col("quantity") < 0) & F.col("customer_id").isNotNull())
        .select(
            "customer_id",
            "stock_code",
            "unit_price",
            F.abs("quantity").alias("quantity"),
            "invoice_date",
        )
        .groupBy(*MATCH_KEYS)
        .agg(F.max("invoice_date").alias("last_reversal_at"))
    )


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _bits(keys: list[str]) -> list[Column]:
    """The places of a key's bits in its bucket."""
    h = F.xxhash64(*keys, F.lit(1))
    width = BUCKET_BITS.bit_length() - 1
    return [F.shiftright(h, i * width).bitwiseAND(F.lit(BUCKET_BITS - 1)).cast("int") for i in range(BITS_SET)]


def key_sketch(index: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """(bucket, words): the bits of all keys, at most ``buckets`` rows of ``BUCKET_BITS`` bits."""
    marks = index.select(_bucket(keys, buckets).alias("bucket"), F.explode(F.array(*_bits(keys))).alias("bit"))
    words = marks.groupBy("bucket", F.call_function("div", F.col("bit"), F.lit(WORD_BITS)).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, bit % {WORD_BITS})")).alias("mask")
    )
    held = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(BUCKET_BITS // WORD_BITS - 1))
    return held.select("bucket", F.transform(every, lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias("words"))


def may_hold(df: DataFrame, sketch: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """``df`` with a boolean: false if the sketch excludes the key of a row."""
    looked = df.withColumn("__bucket", _bucket(keys, buckets)).join(
        F.broadcast(sketch.withColumnsRenamed({"bucket": "__b", "words": "__words"})), F.col("__bucket") == F.col("__b"), "left"
    )
    held = F.col("__words").isNotNull()
    for bit in _bits(keys):
        word = F.get(F.col("__words"), F.shiftright(bit, WORD_BITS.bit_length() - 1))
        held = held & (F.getbit(word, bit.bitwiseAND(F.lit(WORD_BITS - 1))) == 1)
    return looked.withColumn(name, F.coalesce(held, F.lit(False))).drop("__bucket", "__b", "__words")


class Reversals:
    """The reversal index of a basis' cancellations, written once, and the way sales meet it."""

    def __init__(
        self, cancels: DataFrame | None, broadcast_keys: int | None = None, most_buckets: int | None = None,
        index: DataFrame | None = None,
    ):
        """``index``: a stored reversal index, instead of the cancellations."""
        self.index = written(reversal_index(cancels), "reversals") if index is None else index
        self.keys = self.index.count()
        needed = max(1, -(-self.keys * BITS_PER_KEY // BUCKET_BITS))
        self.buckets = 1 << (needed - 1).bit_length()
        if self.keys <= (BROADCAST_KEYS if broadcast_keys is None else broadcast_keys):
            self.way = "broadcast"
        elif self.buckets <= (MOST_BUCKETS if most_buckets is None else most_buckets):
            self.way = "sketch"
        else:
            self.way = "join"

    @cached_property
    def sketch(self) -> DataFrame:
        return written(key_sketch(self.index, MATCH_KEYS, self.buckets), "key-sketch")

    def may_meet(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with a boolean: false if the index can't hold the key of a row."""
        if self.way == "sketch":
            return may_hold(rows, self.sketch, MATCH_KEYS, self.buckets, name)
        if self.way == "join":
            return rows.withColumn(name, F.lit(True))
        keys = F.broadcast(self.index.select(*MATCH_KEYS, F.lit(True).alias(name)))
        return rows.join(keys, MATCH_KEYS, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def _matched(self, sales: DataFrame) -> DataFrame:
        index = F.broadcast(self.index) if self.way == "broadcast" else self.index
        return sales.join(index, MATCH_KEYS, "left").withColumn(
            "is_reversed", F.coalesce(F.col("last_reversal_at") >= F.col("invoice_date"), F.lit(False))
        ).drop("last_reversal_at")

    def flag(self, sales: DataFrame) -> DataFrame:
        """Sales with a boolean ``is_reversed`` column."""
        if self.way != "sketch":
            return self._matched(sales)
        tested = may_hold(sales, self.sketch, MATCH_KEYS, self.buckets, "__maybe")
        clear = tested.where(~F.col("__maybe")).withColumn("is_reversed", F.lit(False))
        return clear.unionByName(self._matched(tested.where("__maybe"))).drop("__maybe")

    def net_grain(self, sales: DataFrame) -> DataFrame:
        """The (customer, day, invoice) grain of the sales that are not reversed.

        With a sketch, candidates keep their match key in the first aggregate and the other lines
        are summed there; both parts read its one exchange, so lines are scanned and shuffled once.
        The parts are told apart by an aggregate, which the optimiser can't push below the exchange.
        """
        from tillroll.operators.grain import invoice_grain

        if self.way != "sketch":
            return invoice_grain(self._matched(sales).where(~F.col("is_reversed")))
        line = F.struct("stock_code", "unit_price", "quantity", "invoice_date")
        tested = may_hold(sales, self.sketch, MATCH_KEYS, self.buckets, "__maybe")
        first = tested.groupBy(
            "customer_id", "order_date", "invoice_no", F.when(F.col("__maybe"), line).alias("__line")
        ).agg(
            F.sum("quantity").cast("bigint").alias("items"), F.sum("sales_value").alias("value"),
            F.max("__maybe").alias("__maybe"),
        )
        clear = first.where(~F.col("__maybe")).select("customer_id", "order_date", "invoice_no", "items", "value")
        doubtful = first.where("__maybe").select("customer_id", "order_date", "invoice_no", "items", "value", "__line.*")
        kept = self._matched(doubtful).where(~F.col("is_reversed")).select(*clear.columns)
        return clear.unionByName(kept).groupBy("customer_id", "order_date", "invoice_no").agg(
            F.sum("items").cast("bigint").alias("items"), F.sum("value").alias("value")
        )


def _reversals(cancels: DataFrame | Reversals) -> Reversals:
    return cancels if isinstance(cancels, Reversals) else Reversals(cancels)


def flag_reversed(sales: DataFrame, cancels: DataFrame | Reversals) -> DataFrame:
    """Sales with a boolean ``is_reversed`` column; ``cancels`` are lines, or their index."""
    return _reversals(cancels).flag(sales)


def valid_sales_net(sales: DataFrame, cancels: DataFrame | Reversals) -> DataFrame:
    """Sales that no cancellation reverses (the corrected basis)."""
    cols = sales.columns
    return flag_reversed(sales, cancels).where(~F.col("is_reversed")).select(*cols)


def reversed_sales(sales: DataFrame, cancels: DataFrame | Reversals) -> DataFrame:
    """Sales that some cancellation reverses (each counted once)."""
    cols = sales.columns
    return flag_reversed(sales, cancels).where(F.col("is_reversed")).select(*cols)


def unmatched_cancellations(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """Cancellation lines of identified customers that reverse no sale (no
    sale of the same key at or before them): the other direction of the rule.

    Sales are reduced to the earliest sale time per key, so the check is again
    one lookup per cancellation.
    """
    first_sale = sales.groupBy(*MATCH_KEYS).agg(F.min("invoice_date").alias("first_sale_at"))
    # A cancellation can only match with a negative quantity; others never match.
    c = cancels.where(F.col("customer_id").isNotNull()).withColumn(
        "__abs_q", F.when(F.col("quantity") < 0, -F.col("quantity"))
    )
    joined = c.join(
        first_sale.withColumnRenamed("quantity", "__abs_q"),
        ["customer_id", "stock_code", "unit_price", "__abs_q"],
        "left",
    )
    return joined.where(
        F.col("first_sale_at").isNull() | (F.col("first_sale_at") > F.col("invoice_date"))
    ).drop("__abs_q", "first_sale_at")


def matched_both_ways(lines: DataFrame, reversals: Reversals) -> DataFrame:
    """Values of ``trade_lines`` with the latest reversal and the earliest sale of their match key, for both directions of the rule.

    (cancelled, identified, at, value, last_reversal_at, first_sale_at): lines of equal key and time are one row.  Lines
    that can't meet the other side -- sales of a key outside the index, cancellations without a whole key -- are summed
    where they are and come with neither.  A window holds at most two rows per point of time of one key.
    """
    keyed = F.lit(True)
    for k in MATCH_KEYS:
        keyed = keyed & F.col(k).isNotNull()
    size = F.when(F.col("cancelled"), -F.col("quantity")).otherwise(F.col("quantity"))
    rows = lines.select("cancelled", F.col("customer_id").isNotNull().alias("identified"), "value", "customer_id", "stock_code", "unit_price", size.alias("quantity"), "invoice_date")
    tested = reversals.may_meet(rows, "__maybe")
    meets = keyed & F.when(F.col("cancelled"), F.col("quantity") > 0).otherwise(F.col("__maybe"))
    point = F.struct(*MATCH_KEYS, F.col("invoice_date").alias("at"))
    points = tested.groupBy("cancelled", "identified", F.when(meets, point).alias("point")).agg(F.sum("value").alias("value"))
    # Sums of lines that meet nothing are one row of each kind, so they can share a window.
    key = Window.partitionBy(*[F.col("point")[k] for k in MATCH_KEYS])
    at = F.col("point")["at"]
    return points.select(
        "cancelled", "identified", at.alias("at"), "value",
        F.max(F.when(F.col("cancelled"), at)).over(key).alias("last_reversal_at"),
        F.min(F.when(~F.col("cancelled"), at)).over(key).alias("first_sale_at"),
    )


def next_reversal_grid(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """For each (match key, day, sale time): the number of sale lines and the
    first reversal at or after that time (an as-of lookup).

    Split in two so that no window ever holds more than one calendar's worth
    of rows, even when one match key carries a third of all lines:

    * same day: per (key, day), the distinct sale and reversal *timestamps*
      (bounded by the clock), scanned from the latest backwards with a
      running ``min``; a reversal at the same instant counts;
    * later days: per key, one row per day with sales and per day with
      reversals (bounded by the calendar), again a backwards running ``min``
      giving the first reversal on any later day.

    The answer is the earlier of the two.  Sale lines are counted per time
    point first, so the windows never see individual lines.
    """
    keys = list(MATCH_KEYS)
    # Only lines that some reversal follows: one lookup, before any window.
    s = reversed_sales(sales, cancels).select(*keys, F.col("invoice_date").alias("t")).withColumn("day", F.to_date("t"))
    c = (
        cancels.where((F.col("quantity") < 0) & F.col("customer_id").isNotNull())
        .select("customer_id", "stock_code", "unit_price", F.abs("quantity").alias("quantity"),
                F.col("invoice_date").alias("t"))
        .withColumn("day", F.to_date("t"))
    )
    running = Window.unboundedPreceding, Window.currentRow

    sale_points = s.groupBy(*keys, "day", "t").agg(F.count(F.lit(1)).alias("lines"))
    same = sale_points.withColumn("kind", F.lit(0)).unionByName(
        c.select(*keys, "day", "t").distinct().withColumn("lines", F.lit(None).cast("bigint")).withColumn("kind", F.lit(1))
    )
    w_same = Window.partitionBy(*keys, "day").orderBy(F.col("t").desc(), F.col("kind").desc()).rowsBetween(*running)
    same = same.withColumn("same_day_next", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(w_same)).where(
        F.col("kind") == 0
    ).drop("kind")

    days = (
        sale_points.select(*keys, "day").distinct()
        .withColumn("first_t", F.lit(None).cast("timestamp_ntz")).withColumn("kind", F.lit(0))
        .unionByName(c.groupBy(*keys, "day").agg(F.min("t").alias("first_t")).withColumn("kind", F.lit(1)))
    )
    w_days = Window.partitionBy(*keys).orderBy(F.col("day").desc(), F.col("kind").asc()).rowsBetween(*running)
    later = days.withColumn("later_day_next", F.min("first_t").over(w_days)).where(F.col("kind") == 0).select(
        *keys, "day", "later_day_next"
    )
    return (
        same.join(later, keys + ["day"])
        .withColumn("next_reversal_at", F.least("same_day_next", "later_day_next"))
        .where(F.col("next_reversal_at").isNotNull())
        .select(
            *keys,
            "day",
            "t",
            "lines",
            "next_reversal_at",
            # Whole minutes between two zone-less times: no session zone (and
            # so no daylight-saving shift) takes part.
            F.timestamp_diff("MINUTE", F.col("t"), F.col("next_reversal_at")).cast("bigint").alias("minutes_to_reversal"),
        )
    )


def reversal_delay(sales: DataFrame, cancels: DataFrame) -> DataFrame:
    """For each reversed sale line, minutes until its earliest matching reversal.

    The as-of answer is computed on the (key, day, time) grid
    (``next_reversal_grid``); an equi-join carries it back to the sale lines
    (adaptive execution splits skewed join partitions).
    """
    keys = list(MATCH_KEYS)
    lines = sales.select(*keys, "invoice_no", F.col("invoice_date").alias("t")).withColumn("day", F.to_date("t"))
    grid = next_reversal_grid(sales, cancels).drop("lines")
    return lines.join(grid, keys + ["day", "t"]).select(
        *keys, "invoice_no", F.col("t").alias("sale_at"), "next_reversal_at", "minutes_to_reversal"
    )
