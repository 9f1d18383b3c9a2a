"""Roll-up of a cleaned transaction table: dashboards without reading a fact row.

Four tables hold what the dashboards add up, all of them mergeable:

* ``cells`` — per (month, location, category, payment, hour, weekday): rows, ids, fraud and
  the exact amount. Sums of cells are sums of rows (A1-A6, B1-B10, B12-B14, I1-I3).
* ``codes`` — a number for every user id, dense from 0. Added users go on behind the last.
* ``days`` — per (day, location, category, payment, bucket of 32,768 codes) a bitmap of the
  users seen. Bitmaps merge by OR, so daily and monthly users (A7, A8) are exact for any
  of the filters without a row per (day, user).
* ``users`` — per (user, month, payment): last time, ids, rows and the exact amount. Folding
  them gives RFM, the funnel and the usual payment method (U1, U2, U7, B11).

``Rollup.add`` puts the partial rows of more transactions beside the earlier ones and
commits them as one version (see ``sources.versions``), so a reader sees all or none of an
addition; queries merge partial rows as they aggregate. ``compact`` merges them for good.

``Router`` answers a dashboard request from the roll-up where it can prove that the
answer is the same, else from the rows: the measure must be one of those above, every filter
one of the cells' dimensions, and a time range must begin and end with a month (``users`` has
no location or category, so its measures need an unfiltered request). Sums are decimals, so
both ways give equal results to the last digit.

Nulls are values of their own in every dimension. Rows without a user id count everywhere but
in user numbers. An empty table gives the answers of an empty table.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.money import money
from ledgerlens.operators import customers as U
from ledgerlens.operators import filters as FL
from ledgerlens.operators import metrics as M
from ledgerlens.operators.rank import numbered
from ledgerlens.schema import AMOUNT, CATEGORY, FRAUD, LOCATION, PAYMENT, TS, TX_ID, USER_ID, FilterParams
from ledgerlens.session import written
from ledgerlens.sources.versions import VersionLog

MONTH = "month"
DIMENSIONS = [MONTH, LOCATION, CATEGORY, PAYMENT, "hr", "weekday"]
CELL_SUMS = ("amt", "n", "n_ids", "fraud")
PLACES = [MONTH, "day", LOCATION, CATEGORY, PAYMENT, "bucket"]
USER_KEYS = [USER_ID, MONTH, PAYMENT]
COLUMNS = [TX_ID, USER_ID, AMOUNT, TS, PAYMENT, CATEGORY, LOCATION, FRAUD]      # read of a transaction
TABLES = ("cells", "codes", "days", "users")


def _month() -> Column:
    return F.date_format(TS, "yyyy-MM")


def cells_of(df: DataFrame) -> DataFrame:
    return (df.groupBy(_month().alias(MONTH), LOCATION, CATEGORY, PAYMENT, F.hour(TS).alias("hr"), F.weekday(TS).alias("weekday"))
            .agg(F.sum(money(AMOUNT)).alias("amt"), F.count(F.lit(1)).alias("n"), F.count(TX_ID).alias("n_ids"),
                 F.sum(F.col(FRAUD).cast("long")).alias("fraud")))


def days_of(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Bitmaps of user codes. Rows of users are first reduced to distinct (place, user), then
    coded; a day whose rows all lack a user keeps a row without a bitmap. Codes grow with the
    users, so they are merged, never broadcast; and coded rows meet in one task by day and
    2 million codes before their bitmaps are made, so no bitmap (4 KB each) is exchanged."""
    seen = df.select(_month().alias(MONTH), F.to_date(TS).alias("day"), LOCATION, CATEGORY, PAYMENT, USER_ID).distinct()
    coded = seen.join(codes.hint("merge"), USER_ID, "left").withColumn("bucket", F.expr("bitmap_bucket_number(code)"))
    near = coded.withColumn("buckets", F.shiftright("bucket", 6)).repartition(MONTH, "day", "buckets")
    return (near.groupBy(*PLACES, "buckets")
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(code)) filter (where code is not null)").alias("users")).drop("buckets"))


def users_of(df: DataFrame) -> DataFrame:
    return (df.groupBy(USER_ID, _month().alias(MONTH), PAYMENT)
            .agg(F.max(TS).alias("last"), F.count(TX_ID).alias("n_ids"), F.count(F.lit(1)).alias("n"), F.sum(money(AMOUNT)).alias("amt")))


class Rollup:
    """The tables' parts as the last committed version lists them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.log = VersionLog(spark, root)
        self.version, content = self.log.latest()
        self.parts: dict[str, list[str]] = content.get("parts", {t: [] for t in TABLES})
        self.schemas: dict[str, str] = content.get("schemas", {})
        self.n_users: int = content.get("n_users", 0)

    # -- writing ------------------------------------------------------------
    def add(self, df: DataFrame) -> None:
        """Adds the rows of ``df`` (cleaned transactions not added before). They are computed once:
        all four tables are made from a written copy of their columns, outside the roll-up."""
        df = written(df.select(*COLUMNS), "rollup-rows")
        known = self.table("codes") if self.parts["codes"] else None
        fresh = df.where(F.col(USER_ID).isNotNull()).select(USER_ID).distinct()
        if known is not None:
            fresh = fresh.join(known.hint("merge"), USER_ID, "left_anti")
        ranked = numbered(fresh, self.log.fresh("code-order"), F.col(USER_ID), name="code")
        part = {"codes": self._write(ranked.select(USER_ID, (F.col("code") + F.lit(self.n_users - 1)).cast("long").alias("code")), "codes")}
        codes = self.spark.read.parquet(part["codes"])
        added = codes.count()
        if known is not None:
            codes = codes.unionByName(known)
        part["cells"] = self._write(cells_of(df), "cells")
        part["days"] = self._write(days_of(df, codes), "days", by_day=True)
        part["users"] = self._write(users_of(df), "users")
        self._commit({t: [*self.parts[t], part[t]] for t in TABLES}, self.n_users + added)

    def compact(self) -> None:
        """Merges the parts of every table into one. The old parts stay for their readers."""
        merged = {"cells": self.cells(), "codes": self.table("codes"), "days": self.days(), "users": self.users()}
        self._commit({t: [self._write(merged[t], t)] for t in TABLES}, self.n_users)

    def _write(self, df: DataFrame, name: str, by_day: bool = False) -> str:
        path = self.log.fresh(name)
        if name in ("cells", "days"):       # months are folders, so a time range reads its own
            # rows that already lie together by day make few files a month as they are
            (df if by_day else df.hint("rebalance", MONTH)).write.partitionBy(MONTH).parquet(path)
        else:
            df.write.parquet(path)
        self.schemas[name] = df.schema.json()
        return path

    def _commit(self, parts: dict[str, list[str]], n_users: int) -> None:
        self.version = self.log.commit({"parts": parts, "schemas": self.schemas, "n_users": n_users}, self.version)
        self.parts, self.n_users = parts, n_users

    # -- merged tables ------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        """All partial rows of a table."""
        if not self.parts[name]:
            raise ValueError("the roll-up holds nothing yet")
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        # each part has its own root, so month folders are found per part
        frames = [self.spark.read.schema(schema).parquet(p) for p in self.parts[name]]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def cells(self) -> DataFrame:
        return self.table("cells").groupBy(*DIMENSIONS).agg(*[F.sum(c).alias(c) for c in CELL_SUMS])

    def days(self) -> DataFrame:
        return self.table("days").groupBy(*PLACES).agg(F.expr("bitmap_or_agg(users)").alias("users"))

    def users(self) -> DataFrame:
        return self.table("users").groupBy(*USER_KEYS).agg(F.max("last").alias("last"), *[F.sum(c).alias(c) for c in ("n_ids", "n", "amt")])

    # -- answers ------------------------------------------------------------
    def _cells(self, where: Column) -> DataFrame:
        return self.table("cells").where(where)

    def summary(self, where: Column) -> DataFrame:
        """A1-A9 from cells and bitmaps: one row, as ``metrics.summary``."""
        c = self._cells(where).select(F.col(LOCATION).cast("string").alias("loc"), F.col(CATEGORY).cast("string").alias("cat"), "hr",
                                      "amt", "n", "fraud")
        g = c.groupingSets([[], ["loc"], ["cat"], ["hr"]], "loc", "cat", "hr").agg(
            F.grouping_id().alias("gid"), *[F.sum(x).alias(x) for x in ("amt", "n", "fraud")])
        gid = F.col("gid")
        kind = F.when(gid == 7, "all").when(gid == 3, "loc").when(gid == 5, "cat").otherwise("hr")
        rows = g.select(kind.alias("kind"), F.coalesce("loc", "cat", F.col("hr").cast("string")).alias("key"), "amt", "n", "fraud",
                        F.lit(0).cast("long").alias("users"))
        for name, users in (("day", self.active_users(where, "day")), ("mon", self.active_users(where, MONTH))):
            none = F.lit(None)
            rows = rows.unionByName(users.select(F.lit(name).alias("kind"), F.col("period").cast("string").alias("key"),
                                                 none.cast("decimal(38,6)").alias("amt"), none.cast("long").alias("n"),
                                                 none.cast("long").alias("fraud"), "users"))
        return M._fold_summary(rows)

    def active_users(self, where: Column, period: str) -> DataFrame:
        """Distinct users per ``period`` (``day`` or ``month``): ``period, users``."""
        merged = self.table("days").where(where).groupBy(F.col(period).alias("period"), "bucket").agg(
            F.expr("bitmap_count(bitmap_or_agg(users))").alias("users"))
        return merged.groupBy("period").agg(F.sum("users").alias("users"))

    def breakdown(self, where: Column, col: str) -> DataFrame:
        g = (self._cells(where).where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("label"))
             .agg(F.sum("amt").cast("double").alias("value")))
        return M._ranked(g)

    def distributions(self, where: Column) -> DataFrame:
        return M.distribution_rows(self._cells(where))

    def trend(self, where: Column, granularity: str = "month") -> DataFrame:
        period = F.col(MONTH)
        if (granularity or "month").lower() == "quarter":
            quarter = F.floor((F.substring(MONTH, 6, 2).cast("int") + 2) / 3).cast("string")
            period = F.concat(F.substring(MONTH, 1, 4).cast("int").cast("string"), F.lit("Q"), quarter)
        return self._cells(where).groupBy(period.alias("period")).agg(F.sum("amt").cast("double").alias("value"))

    def amount_by_hour(self, where: Column) -> DataFrame:
        return self._cells(where).groupBy(F.col("hr").alias("label")).agg(F.sum("amt").cast("double").alias("value"))

    def count_by_hour(self, where: Column) -> DataFrame:
        return self._cells(where).groupBy(F.col("hr").alias("label")).agg(F.sum("n_ids").alias("value"))

    def count_by_weekday(self, where: Column) -> DataFrame:
        return M.weekday_rows(self._cells(where).groupBy(F.col("weekday").alias("weekday_no")).agg(F.sum("n_ids").alias("value")))

    def flows(self, where: Column, min_share: float) -> DataFrame:
        g = (self._cells(where).where(F.col(PAYMENT).isNotNull() & F.col(CATEGORY).isNotNull())
             .groupBy(F.col(PAYMENT).cast("string").alias("from"), F.col(CATEGORY).cast("string").alias("to")).agg(F.sum("amt").alias("v")))
        return M.large_flows(g, min_share)

    def insights(self, where: Column) -> DataFrame:
        late = F.col("weekday") >= 5
        return M.insight_rows(self._cells(where).groupBy("hr").agg(
            F.sum("n").alias("n"), F.sum(F.when(late, F.col("amt"))).alias("weekend"), F.sum(F.when(~late, F.col("amt"))).alias("weekday")))

    # per-user state
    def rfm(self) -> DataFrame:
        """U1 from the users' partial rows (no fact row is folded again)."""
        rows = self.table("users").where(F.col(USER_ID).isNotNull())
        # the reference time is that of all rows, users or not
        ref = self.table("users").agg(F.max("last")).scalar() + F.expr("INTERVAL 1 DAY")
        g = rows.groupBy(USER_ID).agg(F.max("last").alias("last"), F.sum("n_ids").alias("Frequency"), F.sum("amt").cast("double").alias("Monetary"))
        return g.select(USER_ID, F.extract(F.lit("DAY"), ref - F.col("last")).cast("bigint").alias("Recency"), "Frequency", "Monetary")

    def preferred_payment(self) -> DataFrame:
        c = self.table("users").where(F.col(USER_ID).isNotNull() & F.col(PAYMENT).isNotNull()).groupBy(USER_ID, PAYMENT).agg(F.sum("n").alias("n"))
        return U.most_used(c)

    def funnel(self, steps: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
        return M.funnel_rows(self.table("users").groupBy(USER_ID).agg(F.sum("n_ids").alias("n")), steps)


class Router:
    """Dashboard requests from the roll-up where that is provably the same, else from rows."""

    USER_MEASURES = ("rfm", "preferred_payment", "funnel")

    def __init__(self, rows: DataFrame, rollup: Rollup | None):
        self.rows = rows
        self.rollup = rollup
        self._by_cells: dict[str, tuple[Callable, Callable]] = {
            "summary": (lambda w, **a: rollup.summary(w), lambda d, **a: M.summary(d)),
            "growth": (lambda w, **a: M.growth_display(rollup.summary(w)), lambda d, **a: M.growth_display(M.summary(d))),
            "distributions": (lambda w, **a: rollup.distributions(w), lambda d, **a: M.distributions(d)),
            "breakdown": (lambda w, col, **a: rollup.breakdown(w, col), lambda d, col, **a: M.breakdown(d, col)),
            "trend": (lambda w, granularity="month", **a: rollup.trend(w, granularity),
                      lambda d, granularity="month", **a: M.trend(d, granularity)),
            "amount_by_hour": (lambda w, **a: rollup.amount_by_hour(w), lambda d, **a: M.amount_by_hour(d)),
            "count_by_hour": (lambda w, **a: rollup.count_by_hour(w), lambda d, **a: M.count_by_hour(d)),
            "count_by_weekday": (lambda w, **a: rollup.count_by_weekday(w), lambda d, **a: M.count_by_weekday(d)),
            "flows": (lambda w, min_share=M.FLOW_MIN_SHARE, **a: rollup.flows(w, min_share),
                      lambda d, min_share=M.FLOW_MIN_SHARE, **a: M.category_flows(d, min_share)),
            "insights": (lambda w, **a: rollup.insights(w), lambda d, **a: M.insights(d)),
        }
        self._by_users: dict[str, tuple[Callable, Callable]] = {
            "rfm": (lambda **a: rollup.rfm(), lambda d, **a: U.rfm(d)),
            "preferred_payment": (lambda **a: rollup.preferred_payment(), lambda d, **a: U.preferred_payment(d)),
            "funnel": (lambda steps=(1, 2, 5), **a: rollup.funnel(steps), lambda d, steps=(1, 2, 5), **a: M.user_funnel(d, steps)),
        }

    def source(self, measure: str, params: FilterParams | None = None, start: dt.datetime | None = None,
               stop: dt.datetime | None = None, search: str = "", **args) -> str:
        """``"rollup"`` or ``"rows"``, and so the proof: every condition of the request is one
        on the roll-up's own columns."""
        if self.rollup is None or not self.rollup.version or search:
            return "rows"
        if measure in self._by_users:
            return "rows" if start or stop or (params and params != FilterParams()) else "rollup"
        if measure not in self._by_cells or (measure == "breakdown" and args.get("col") not in (LOCATION, CATEGORY, PAYMENT)):
            return "rows"
        whole = all(t is None or t == t.replace(day=1, hour=0, minute=0, second=0, microsecond=0) for t in (start, stop))
        return "rollup" if whole else "rows"

    def answer(self, measure: str, params: FilterParams | None = None, start: dt.datetime | None = None,
               stop: dt.datetime | None = None, search: str = "", **args) -> DataFrame:
        if measure not in self._by_cells and measure not in self._by_users:
            raise ValueError(f"unknown measure {measure!r}")
        from_cells, from_rows = (self._by_cells | self._by_users)[measure]
        if self.source(measure, params, start, stop, search, **args) == "rollup":
            if measure in self._by_users:
                return from_cells(**args)
            where = FL.filter_predicate(params)
            if start is not None:
                where = where & (F.col(MONTH) >= f"{start:%Y-%m}")
            if stop is not None:
                where = where & (F.col(MONTH) < f"{stop:%Y-%m}")
            return from_cells(where, **args)
        df = FL.search(FL.apply_filters(self.rows, params), search)
        if start is not None:
            df = df.where(F.col(TS) >= F.lit(start).cast("timestamp_ntz"))
        if stop is not None:
            df = df.where(F.col(TS) < F.lit(stop).cast("timestamp_ntz"))
        return from_rows(df, **args)
