"""Feature engineering (E1-E4): time features, scaling, one-hot, whole pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.clean import clip_amount, drop_incomplete, fill_unknown, iqr_upper_bound
from ledgerlens.operators.filters import distinct_values
from ledgerlens.schema import AMOUNT, CATEGORY, PAYMENT, TS

MAX_CATEGORIES = 10_000      # one-hot columns of one fit


def time_features(df: DataFrame, ts_col: str = TS) -> DataFrame:
    """Hour, day_of_week (0 = Monday), month, is_weekend."""
    dow = F.weekday(ts_col)
    return df.withColumns({
        "hour": F.hour(ts_col), "day_of_week": dow, "month": F.month(ts_col),
        "is_weekend": (dow >= 5).cast("int"),
    })


def fit_scaler(df: DataFrame, col: str = AMOUNT) -> tuple[float, float]:
    """E2 fit: mean and population std (one global aggregate, partial per task)."""
    r = df.agg(F.avg(col).alias("m"), F.stddev_pop(col).alias("s")).first()
    return (float(r["m"]) if r["m"] is not None else 0.0,
            float(r["s"]) if r["s"] is not None else 0.0)


def apply_scaler(df: DataFrame, mean: float, std: float, col: str = AMOUNT,
                 out: str = "amount_scaled") -> DataFrame:
    """E2 apply: ``(x - mean) / std``; a zero std scales by 1 (value - mean)."""
    s = std if std else 1.0
    return df.withColumn(out, (F.col(col) - F.lit(mean)) / F.lit(s))


def scaled_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """E2 in one plan: the statistics come from a scalar subquery (no driver round-trip)."""
    st = df.agg(F.struct(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))).scalar()
    s = F.when(st["s"] == 0, F.lit(1.0)).otherwise(st["s"])
    return df.withColumn(out or f"{col}_scaled", (F.col(col) - st["m"]) / s)


def fit_categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """E3 fit: sorted distinct non-null values per categorical column. The distinct is
    distributed and each value becomes a column, so more than ``MAX_CATEGORIES`` in all are
    an error: at most that many rows and one reach the driver."""
    rows = distinct_values(df, [(c, c) for c in cols]).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"over {MAX_CATEGORIES} distinct values in {', '.join(cols)}: too many for a column each")
    vocab: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        vocab[r.field].append(r.value)
    return {c: sorted(v) for c, v in vocab.items()}


def one_hot(df: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """E3 apply: ``<col>_<value>`` 0/1 double columns in sorted order; unseen → all zero."""
    new = {}
    for c, values in vocab.items():
        for v in values:
            new[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
    return df.withColumns(new) if new else df


@dataclass
class Preprocessor:
    """C9-C11, E1, E2 and E3 with the statistics fitted once and reused."""

    exact_quantiles: bool = True
    upper: float | None = None
    mean: float = 0.0
    std: float = 0.0
    vocab: dict[str, list[str]] = field(default_factory=dict)
    fitted: bool = False

    def _clean(self, df: DataFrame) -> DataFrame:
        return fill_unknown(drop_incomplete(df))

    def fit(self, df: DataFrame) -> "Preprocessor":
        base = self._clean(df)
        self.upper = iqr_upper_bound(base, exact=self.exact_quantiles)
        clipped = clip_amount(base, self.upper)
        self.mean, self.std = fit_scaler(clipped)
        self.vocab = fit_categories(base, [PAYMENT, CATEGORY])
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("Preprocessor.fit must run before transform")
        out = clip_amount(self._clean(df), self.upper)
        out = time_features(out)
        out = apply_scaler(out, self.mean, self.std)
        return one_hot(out, self.vocab)

    def process(self, df: DataFrame, training: bool = True) -> DataFrame:
        if training:
            self.fit(df)
        return self.transform(df)
