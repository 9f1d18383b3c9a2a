"""Dashboard aggregates: headline summary (A1-A9), breakdowns (B1-B14) and
rule-based insights (I1-I3).

All of them aggregate with map-side partial aggregation, so a hot key (one
location or one user holding a large share of the rows) is collapsed inside
each task before the shuffle. Un-partitioned windows are used only on
post-aggregate frames with one row per label / period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.labels import weekday_label_of, weekday_no
from ledgerlens.functions.money import money, trunc_to_long
from ledgerlens.schema import (
    AMOUNT, CATEGORY, FLOW_MIN_SHARE, FRAUD, FUNNEL_LABELS, GROWTH_BASE, GROWTH_FLOOR,
    GROWTH_NO_FRAUD, INSIGHT_NO_DATA, INSIGHT_PEAK_HOUR, INSIGHT_WEEKEND, LOCATION, PAYMENT,
    TS, TX_ID, USER_ID,
)


def _top_label(label: Column, measure: Column, cond: Column) -> Column:
    """Label with the largest measure among rows where ``cond``; ties → smallest label."""
    return F.min_by(label, F.when(cond, F.struct((-measure).alias("m"), label.alias("l"))))


# ---------------------------------------------------------------------------
# A1-A9 headline summary
# ---------------------------------------------------------------------------
# grouping_id bit patterns over (loc, cat, hr, day, mon, uid); a 1 bit = not grouped
_GID_ALL, _GID_LOC, _GID_CAT, _GID_HR, _GID_DAY_USER, _GID_MON_USER = 63, 31, 47, 55, 58, 60


def summary(df: DataFrame, approx_users: bool = False, rsd: float = 0.02) -> DataFrame:
    """One row: total_gmv, total_transactions, fraud_rate, top_city, top_category,
    peak_hour, active_users_daily_avg, active_users_monthly_avg.

    One scan: a grouping-sets aggregate over ``(), (location), (category),
    (hour), (day, user), (month, user)`` — every set partially aggregated in
    each task. A second aggregate turns the ``(day, user)`` / ``(month, user)``
    rows into distinct-user counts, and a global fold picks the totals and the
    top labels; the global fold also makes an empty input give the zero row (A9).

    ``approx_users=True`` counts daily / monthly users with HyperLogLog sketches
    (relative error ``rsd``) inside the same single-scan aggregate, so no
    per-(day, user) rows are shuffled at all.
    """
    d = df.select(money(AMOUNT).alias("amt"), F.col(FRAUD).alias("fraud"),
                  F.col(LOCATION).cast("string").alias("loc"),
                  F.col(CATEGORY).cast("string").alias("cat"),
                  F.hour(TS).alias("hr"), F.to_date(TS).alias("day"),
                  F.date_format(TS, "yyyy-MM").alias("mon"), F.col(USER_ID).alias("uid"))
    if approx_users:
        return _summary_approx(d, rsd)
    g = (d.groupingSets([[], ["loc"], ["cat"], ["hr"], ["day", "uid"], ["mon", "uid"]],
                        "loc", "cat", "hr", "day", "mon", "uid")
         .agg(F.grouping_id().alias("gid"), F.sum("amt").alias("amt"),
              F.count(F.lit(1)).alias("n"), F.sum("fraud").alias("fraud")))
    gid = F.col("gid")
    kind = (F.when(gid == _GID_ALL, "all").when(gid == _GID_LOC, "loc").when(gid == _GID_CAT, "cat")
            .when(gid == _GID_HR, "hr").when(gid == _GID_DAY_USER, "day").otherwise("mon"))
    key = F.coalesce("loc", "cat", F.col("hr").cast("string"), F.col("day").cast("string"), "mon")
    u = (g.groupBy(kind.alias("kind"), key.alias("key"))
         .agg(F.sum("amt").alias("amt"), F.sum("n").alias("n"), F.sum("fraud").alias("fraud"),
              # a day whose rows all lack a user id still counts, with 0 users
              F.count("uid").alias("users")))
    return _fold_summary(u)


def _summary_approx(d: DataFrame, rsd: float) -> DataFrame:
    g = (d.groupingSets([[], ["loc"], ["cat"], ["hr"], ["day"], ["mon"]], "loc", "cat", "hr", "day", "mon")
         .agg(F.grouping_id().alias("gid"), F.sum("amt").alias("amt"), F.count(F.lit(1)).alias("n"),
              F.sum("fraud").alias("fraud"), F.approx_count_distinct("uid", rsd).alias("users")))
    gid = F.col("gid")  # bits over (loc, cat, hr, day, mon)
    kind = (F.when(gid == 31, "all").when(gid == 15, "loc").when(gid == 23, "cat")
            .when(gid == 27, "hr").when(gid == 29, "day").otherwise("mon"))
    key = F.coalesce("loc", "cat", F.col("hr").cast("string"), F.col("day").cast("string"), "mon")
    return _fold_summary(g.select(kind.alias("kind"), key.alias("key"), "amt", "n", "fraud", "users"))


def _fold_summary(u: DataFrame) -> DataFrame:
    """(kind, key, amt, n, fraud, users) rows → the one summary row."""
    kind, key = F.col("kind"), F.col("key")
    total_n = F.sum(F.when(kind == "all", F.col("n")))
    total_f = F.sum(F.when(kind == "all", F.col("fraud")))
    return u.agg(
        # 0 without amounts; NULL where the total does not fit a bigint
        F.when(F.sum(F.when(kind == "all", F.col("amt"))).isNull(), F.lit(0).cast("bigint"))
         .otherwise(trunc_to_long(F.sum(F.when(kind == "all", F.col("amt"))))).alias("total_gmv"),
        F.coalesce(total_n, F.lit(0).cast("bigint")).alias("total_transactions"),
        F.coalesce(F.try_divide(total_f, total_n) * 100, F.lit(0.0)).alias("fraud_rate"),
        _top_label(key, F.col("amt"), (kind == "loc") & key.isNotNull()).alias("top_city"),
        _top_label(key, F.col("amt"), (kind == "cat") & key.isNotNull()).alias("top_category"),
        F.min_by(key.cast("int"), F.when((kind == "hr") & key.isNotNull(),
                                         F.struct((-F.col("n")).alias("m"), key.cast("int").alias("h"))))
         .alias("peak_hour"),
        F.coalesce(F.avg(F.when((kind == "day") & key.isNotNull(), F.col("users"))), F.lit(0.0))
         .alias("active_users_daily_avg"),
        F.coalesce(F.avg(F.when((kind == "mon") & key.isNotNull(), F.col("users"))), F.lit(0.0))
         .alias("active_users_monthly_avg"),
    )


def growth_display(summary_df: DataFrame) -> DataFrame:
    """The dashboard "growth" tile — a display formula over the fraud rate,
    ``max(1, 8 - fraud_rate/2)`` or 8.2 when there is no fraud. Not a growth rate."""
    fr = F.col("fraud_rate")
    return summary_df.select(
        fr, F.when(fr > 0, F.greatest(F.lit(GROWTH_FLOOR), F.lit(GROWTH_BASE) - fr / 2))
             .otherwise(F.lit(GROWTH_NO_FRAUD)).alias("growth_display"))


# ---------------------------------------------------------------------------
# B1-B4 breakdowns
# ---------------------------------------------------------------------------
def _ranked(df: DataFrame, part: list[str] | None = None) -> DataFrame:
    w = Window.orderBy(F.col("value").desc(), F.col("label").asc())
    if part:
        w = Window.partitionBy(*part).orderBy(F.col("value").desc(), F.col("label").asc())
    return df.withColumn("rank", F.row_number().over(w))


def breakdown(df: DataFrame, col: str) -> DataFrame:
    """Amount by one column, NULL group dropped; ``rank`` 1 = largest."""
    g = (df.where(F.col(col).isNotNull())
         .groupBy(F.col(col).cast("string").alias("label"))
         .agg(F.sum(money(AMOUNT)).cast("double").alias("value")))
    return _ranked(g)


def payment_share(df: DataFrame) -> DataFrame:
    return breakdown(df, PAYMENT)


def category_spend(df: DataFrame) -> DataFrame:
    return breakdown(df, CATEGORY)


def location_sales(df: DataFrame) -> DataFrame:
    return breakdown(df, LOCATION)


BREAKDOWN_NAMES = {PAYMENT: "payment_method_share", CATEGORY: "merchant_category_spend",
                   LOCATION: "location_sales"}


def distributions(df: DataFrame) -> DataFrame:
    """All three breakdowns from one scan (grouping sets), long form
    ``(breakdown, label, value, rank)``."""
    return distribution_rows(df.select(money(AMOUNT).alias("amt"), PAYMENT, CATEGORY, LOCATION))


def distribution_rows(amounts: DataFrame) -> DataFrame:
    """B4 of rows (or of merged partial sums) with a column ``amt``."""
    d = amounts.select("amt", *[F.col(c).cast("string").alias(c) for c in (PAYMENT, CATEGORY, LOCATION)])
    g = (d.groupingSets([[PAYMENT], [CATEGORY], [LOCATION]], PAYMENT, CATEGORY, LOCATION)
         .agg(F.grouping_id().alias("gid"), F.sum("amt").cast("double").alias("value")))
    gid = F.col("gid")  # bits follow (payment, category, location)
    g = g.select(
        F.when(gid == 3, BREAKDOWN_NAMES[PAYMENT]).when(gid == 5, BREAKDOWN_NAMES[CATEGORY])
         .otherwise(BREAKDOWN_NAMES[LOCATION]).alias("breakdown"),
        F.when(gid == 3, F.col(PAYMENT)).when(gid == 5, F.col(CATEGORY))
         .otherwise(F.col(LOCATION)).alias("label"),
        "value")
    return _ranked(g.where(F.col("label").isNotNull()), ["breakdown"])


# ---------------------------------------------------------------------------
# B5-B9 time breakdowns
# ---------------------------------------------------------------------------
def period_label(ts: Column, granularity: str = "month") -> Column:
    """``YYYY-MM`` or ``YYYYQn``; unknown granularity falls back to month."""
    if (granularity or "month").lower() == "quarter":
        return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, "yyyy-MM")


def trend(df: DataFrame, granularity: str = "month") -> DataFrame:
    """Amount per period present in the data; ``period`` sorts in time order."""
    return (df.groupBy(period_label(F.col(TS), granularity).alias("period"))
            .agg(F.sum(money(AMOUNT)).cast("double").alias("value")))


def amount_by_hour(df: DataFrame) -> DataFrame:
    """Amount per hour of day (``label`` = hour)."""
    return df.groupBy(F.hour(TS).alias("label")).agg(F.sum(money(AMOUNT)).cast("double").alias("value"))


def count_by_hour(df: DataFrame) -> DataFrame:
    """Transactions (non-null ids) per hour of day."""
    return df.groupBy(F.hour(TS).alias("label")).agg(F.count(TX_ID).alias("value"))


def count_by_weekday(df: DataFrame) -> DataFrame:
    """Transactions per weekday with Vietnamese labels; ``weekday_no`` 0 = Monday."""
    return weekday_rows(df.groupBy(weekday_no(TS).alias("weekday_no")).agg(F.count(TX_ID).alias("value")))


def weekday_rows(counts: DataFrame) -> DataFrame:
    return counts.select("weekday_no", weekday_label_of("weekday_no").alias("label"), "value")


# ---------------------------------------------------------------------------
# B10-B13
# ---------------------------------------------------------------------------
def category_flows(df: DataFrame, min_share: float = FLOW_MIN_SHARE) -> DataFrame:
    """Payment → category amounts, keeping flows ≥ ``min_share`` of the total.

    One scan: the total is a window sum over the grouped flows — one row per
    (payment, category) pair, a dimension-sized frame — so the table is not
    read a second time for it.
    """
    g = (df.where(F.col(PAYMENT).isNotNull() & F.col(CATEGORY).isNotNull())
         .groupBy(F.col(PAYMENT).cast("string").alias("from"), F.col(CATEGORY).cast("string").alias("to"))
         .agg(F.sum(money(AMOUNT)).alias("v")))
    return large_flows(g, min_share)


def large_flows(g: DataFrame, min_share: float) -> DataFrame:
    """B10 of the summed flows ``from, to, v``."""
    total = F.sum("v").over(Window.partitionBy())
    return (g.withColumn("total", total)
            .where(F.col("v").cast("double") >= F.col("total").cast("double") * F.lit(float(min_share)))
            .select("from", "to", F.col("v").cast("double").alias("value")))


def user_funnel(df: DataFrame, steps: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """Users with ≥ 1 / ≥ 2 / ≥ 5 transactions → rows ``(step, label, value)``;
    no row for an empty frame."""
    return funnel_rows(df.groupBy(USER_ID).agg(F.count(TX_ID).alias("n")), steps)


def funnel_rows(per_user: DataFrame, steps: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """B11 of one row per user with its transactions ``n``."""
    known = F.col(USER_ID).isNotNull()
    counts = per_user.agg(F.count(F.lit(1)).alias("groups"), *[
        F.count_if(known if s <= 1 else known & (F.col("n") >= s)).alias(f"s{i}") for i, s in enumerate(steps)])
    counts = counts.where("groups > 0")
    labels = list(FUNNEL_LABELS) + [f">= {s}" for s in steps[len(FUNNEL_LABELS):]]
    pairs = ", ".join(f"{i + 1}, '{labels[i]}', s{i}" for i in range(len(steps)))
    return counts.select(F.expr(f"stack({len(steps)}, {pairs}) as (step, label, value)"))


def top_categories(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest categories by amount (``rank`` 1..n)."""
    return category_spend(df).where(F.col("rank") <= n)


def location_codes(df: DataFrame) -> DataFrame:
    """Location sales with display codes ``L1 … Ln`` in descending order."""
    return location_sales(df).withColumn("code", F.concat(F.lit("L"), F.col("rank").cast("string")))


# ---------------------------------------------------------------------------
# I1-I3 insights
# ---------------------------------------------------------------------------
def insights(df: DataFrame) -> DataFrame:
    """I1-I3 as rows ``(seq, text)``.

    One scan grouped by hour (24 rows out), then one global fold: total rows,
    weekend vs weekday amount, most frequent hour (ties → earliest).
    """
    wk = weekday_no(TS) >= 5
    by_hour = df.groupBy(F.hour(TS).alias("hr")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(wk, money(AMOUNT))).alias("weekend"),
        F.sum(F.when(~wk, money(AMOUNT))).alias("weekday"))
    return insight_rows(by_hour)


def insight_rows(by_hour: DataFrame) -> DataFrame:
    """I1-I3 of one row per hour: rows ``n`` and the amounts ``weekend``, ``weekday``."""
    one = by_hour.agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum("weekend"), F.lit(0)).alias("weekend"),
        F.coalesce(F.sum("weekday"), F.lit(0)).alias("weekday"),
        F.min_by("hr", F.struct((-F.col("n")).alias("m"), F.col("hr").alias("h"))).alias("peak"))
    n, peak = F.coalesce(F.col("n"), F.lit(0)), F.col("peak")
    msgs = F.array(
        F.when(n == 0, F.lit(INSIGHT_NO_DATA)),
        F.when((n > 0) & (F.col("weekend") > F.col("weekday") * F.lit(0.5)), F.lit(INSIGHT_WEEKEND)),
        F.when(n > 0, F.format_string(INSIGHT_PEAK_HOUR, peak, peak + 1)))
    return (one.select(F.posexplode(F.array_compact(msgs)).alias("pos", "text"))
            .select((F.col("pos") + 1).alias("seq"), "text"))


def peak_hour_insight(df: DataFrame) -> DataFrame:
    """I2 alone: the peak-hour message (no row for empty input)."""
    return insights(df).where(F.col("text").startswith(INSIGHT_PEAK_HOUR.split("%")[0]))
