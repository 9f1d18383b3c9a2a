"""Service facade: the reference's dashboard and fraud calls as lazy DataFrames.

One method per request the reference serves, so a caller can switch over call
by call. Every method returns DataFrames; nothing is collected here, except
that the fit steps (K-Means, model training) run their jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators import customers as U
from ledgerlens.operators import filters as FL
from ledgerlens.operators import fraud as FR
from ledgerlens.operators import listing as P
from ledgerlens.operators import metrics as M
from ledgerlens.operators.clean import clean_fraud_input
from ledgerlens.operators.forecast import baseline_forecast
from ledgerlens.operators.treerules import explain
from ledgerlens.plans.registry import ModelRegistry
from ledgerlens.plans.rollup import Router
from ledgerlens.schema import TS, FilterParams
from ledgerlens.sources.dataset import Dataset, open_dataset


class AnalyticsService:
    """Dashboard, listing, segmentation and fraud requests over one dataset."""

    def __init__(self, spark: SparkSession, path: str, materialize: bool = False, ts_format: str | None = None):
        """``ts_format`` is the pattern of the file's timestamps (default: taken from its
        first values). ``materialize=True`` parses the source once into month-partitioned
        parquet under the shared checkpoint folder and builds its roll-up; later requests read the
        roll-up where it answers them, else only the columns and months they need."""
        self.spark = spark
        self.materialize = materialize
        self.dataset: Dataset = open_dataset(spark, path, ts_format=ts_format)
        self._open()
        self.registry = ModelRegistry(spark, self.dataset.registry_path())
        self._clusters: DataFrame | None = None
        self._segments: DataFrame | None = None

    # -- dataset ------------------------------------------------------------
    def change_dataset(self, path: str, ts_format: str | None = None) -> None:
        """Switch files: cached data, fitted segments and trained models are dropped."""
        self.dataset = open_dataset(self.spark, path, previous=self.dataset, ts_format=ts_format)
        self._open()
        self.registry = ModelRegistry(self.spark, self.dataset.registry_path())
        self._release_segments()

    def _open(self) -> None:
        if self.materialize:
            self.dataset.materialize()
        self.router = Router(self.dataset.cleaned(), self.dataset.rollup() if self.materialize else None)

    def _release_segments(self) -> None:
        for frame in (self._clusters, self._segments):
            if frame is not None:
                frame.unpersist()
        self._clusters = self._segments = None

    def _df(self, params: FilterParams | None = None) -> DataFrame:
        return FL.apply_filters(self.dataset.cleaned(), params)

    # -- dashboard ----------------------------------------------------------
    def filter_values(self) -> DataFrame:
        return FL.filter_values(self.dataset.cleaned())

    def summary(self, params: FilterParams | None = None, approx_users: bool = False) -> DataFrame:
        if approx_users:
            return M.summary(self._df(params), approx_users=True)
        return self.router.answer("summary", params)

    def distributions(self, params: FilterParams | None = None) -> DataFrame:
        return self.router.answer("distributions", params)

    def trend(self, params: FilterParams | None = None, granularity: str = "month") -> DataFrame:
        return self.router.answer("trend", params, granularity=granularity)

    def forecast(self, params: FilterParams | None = None) -> DataFrame:
        return baseline_forecast(self.trend(params))

    def hourly(self, params: FilterParams | None = None) -> DataFrame:
        return self.router.answer("amount_by_hour", params)

    def insights(self, params: FilterParams | None = None) -> DataFrame:
        return self.router.answer("insights", params)

    def flows(self, params: FilterParams | None = None) -> DataFrame:
        return self.router.answer("flows", params)

    def funnel(self, params: FilterParams | None = None) -> DataFrame:
        return self.router.answer("funnel", params)

    def transactions(self, params: FilterParams | None = None, search: str = "", sort_by: str = TS,
                     sort_order: str = "desc", page: int = 1, page_size: int = 20) -> dict[str, DataFrame]:
        f = FL.search(self._df(params), search)
        return {"total": P.page_total(f),
                "rows": P.project_rows(P.page(f, sort_by, sort_order, page, page_size))}

    def transactions_after(self, last_value, last_id: str | None, params: FilterParams | None = None, search: str = "",
                           sort_by: str = TS, sort_order: str = "desc", page_size: int = 20) -> DataFrame:
        """The page behind a row, at the cost of the first page (see ``listing.page_after``)."""
        f = FL.search(self._df(params), search)
        return P.project_rows(P.page_after(f, last_value, last_id, sort_by, sort_order, page_size))

    # -- customers ----------------------------------------------------------
    def user_analytics(self, params: FilterParams | None = None) -> dict[str, DataFrame]:
        """Segments are fitted on the filtered rows, as in the reference; without a filter
        they are those of ``segmentation``."""
        if params is None or params == FilterParams():
            if not self._df().head(1):
                return U.user_analytics(self._df())
            self.segmentation()
            return U.user_analytics(self._df(), self._segments)
        return U.user_analytics(self._df(params))

    def segmentation(self) -> dict[str, DataFrame]:
        """Segments of the whole table: fitted once per dataset, then reused."""
        if self._segments is None:
            _, self._clusters = U.fit_segments(U.rfm(self.dataset.cleaned()), keep=True)
            self._segments = U.name_segments(self._clusters).persist()
        return {"segments": self._segments, "summary": U.segment_profile(self._segments)}

    # -- fraud --------------------------------------------------------------
    def _fraud_input(self) -> DataFrame:
        return clean_fraud_input(self.dataset.raw())

    def train(self, kind: str = "decision_tree") -> DataFrame:
        return self.registry.train(self._fraud_input(), kind)

    def model_status(self, kind: str) -> DataFrame:
        return self.registry.metrics(kind)

    def status(self) -> DataFrame:
        """Both models' state, metrics and matrix in one call."""
        return self.registry.status_rows()

    def confusion(self, kind: str) -> DataFrame:
        return self.registry.confusion(kind)

    def select_model(self, kind: str) -> None:
        """The model that ``predict`` uses when none is named."""
        self.registry.set_active(kind)

    def compare(self) -> DataFrame:
        rows = [self.registry.metrics(k) for k in FR.KINDS]
        return FR.compare_models(rows[0].unionByName(rows[1]))

    def predict(self, requests: DataFrame, kind: str | None = None, null_is_absent: bool = True) -> DataFrame:
        """Score a table of requests (amount, hour, is_weekend, payment, category,
        location); missing inputs take the form defaults. Adds the rule list. For stored
        transactions, whose missing categories are values, pass ``null_is_absent=False``."""
        model = self.registry.model(kind)
        scored = FR.score(model, requests, null_is_absent)
        return explain(model, scored)
