"""Window operators over events and sorted heights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sessions(df: DataFrame, stamp: str, order: str, by: str) -> DataFrame:
    """``session_id``: counts up where the stamp goes back."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("__back", F.coalesce((F.col(stamp) < F.lag(stamp).over(w)).cast("int"), F.lit(0))).withColumn("session_id",
        F.sum("__back").over(w)).drop("__back")


def confirmed(df: DataFrame, seen: str, order: str, by: str, need: int = 2, of: int = 3) -> DataFrame:
    """Whether ``need`` of the last ``of`` rows were seen."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(of - 1), 0)
    return df.withColumn("confirmed", F.sum(F.col(seen).cast("int")).over(w) >= need)


def rates(df: DataFrame, ts: str, by: str, seconds: int = 5) -> DataFrame:
    """(n - 1) / span of the rows in the last seconds; zero where they have no span."""
    t = F.col(ts).cast("timestamp").cast("double")  # a stamp without a zone is read in the session's
    w = Window.partitionBy(by).orderBy(t).rangeBetween(-seconds, 0)
    span = F.max(t).over(w) - F.min(t).over(w)
    return df.withColumn("rate_hz", F.when(span > 0, (F.count("*").over(w) - 1) / span).otherwise(0.0))


def level_gap(df: DataFrame, by: list[str], h: str = "h", gap_m: float = 0.08, side: int = 6) -> DataFrame:
    """Whether sorted heights have a gap with enough rows on both sides."""
    w = Window.partitionBy(*by).orderBy(h)
    rows = df.select(*by, F.col(h).alias("__h")).withColumnRenamed("__h",
        h).withColumns({"step": F.col(h) - F.lag(h).over(w), "below": F.row_number().over(w) - 1,
            "n": F.count("*").over(Window.partitionBy(*by))})
    return rows.groupBy(*by).agg(F.coalesce(F.bool_or((F.col("step") > gap_m) & (F.col("below") >= side) & (F.col("n") - F.col("below") >= side)),
        F.lit(False)).alias("several_levels"))


def lower_support(df: DataFrame, by: list[str], h: str = "h", fraction: float = 0.40) -> DataFrame:
    """Rows at or below a quantile of their group's heights."""
    w = Window.partitionBy(*by)
    return df.withColumn("__q", F.percentile(h, F.lit(fraction)).over(w)).where(F.col(h) <= F.col("__q")).drop("__q")


def alternate(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Every second row of a group, in an order, is held out."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("held_out", n % 2 == 0)


def tail_median(df: DataFrame, value: str, order: str, by: str, rows: int = 9) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(rows - 1), 0)
    # a median has no sliding frame; the frame is a few rows, so it is sorted as an array
    return df.withColumn("__last", F.sort_array(F.collect_list(value).over(w))).withColumn(
        "tail_median", (F.element_at("__last", F.floor((F.size("__last") + 1) / 2).cast("int")) + F.element_at("__last",
                    F.ceil((F.size("__last") + 1) / 2).cast("int"))) / 2
    ).drop("__last")


def keep_latest(df: DataFrame, slot: str | tuple[str, ...], order: str) -> DataFrame:
    """One row for each slot, the last one, and how many were dropped for it."""
    w = Window.partitionBy(*([slot] if isinstance(slot, str) else slot))
    return df.withColumns({"__n": F.row_number().over(w.orderBy(F.desc(order))), "dropped": F.count("*").over(w) - 1}).where("__n = 1").drop("__n")


def pair_fifo(left: DataFrame, right: DataFrame, order: str, by: str) -> DataFrame:
    """The n-th row of one queue with the n-th of the other; equal stamps are no identity."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return left.withColumn("n", n).join(right.withColumn("n", n).withColumnsRenamed({c: f"r_{c}" for c in right.columns if c != by}), [by, "n"])
