"""K-Means with all restarts fitted together: one aggregate per step.

Ten restarts fitted one by one cost ten jobs per iteration over the same small vectors.
Here a step assigns every row to the nearest centre of *each* restart and sums up
``(restart, cluster)``, so a task sends ``restarts * k`` partial rows and a step is one job
whatever the number of restarts. A restart whose centres have settled drops out of the next
steps. Starting centres come from k-means++ over all rows: the next centre of a restart is
drawn with probability proportional to the squared distance from those it has, as the least
of ``-ln(u) / distance`` (an exponential race), again for all restarts in one aggregate. ``u``
is a hash of (seed, step, row key), so the draw does not depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centres = list[list[float]]


@dataclass
class Clustering:
    """The best restart's centres, its cost, and the costs and iterations of all restarts."""
    columns: list[str]
    centres: Centres
    cost: float
    costs: list[float]
    iterations: list[int]

    def cluster(self) -> Column:
        """The nearest centre's number; ties go to the smaller number."""
        x = [F.col(c).cast("double") for c in self.columns]
        return _nearest([_squared(x, [F.lit(v) for v in c]) for c in self.centres])[1]


def _squared(x: list[Column], centre: list[Column]) -> Column:
    total = (x[0] - centre[0]) * (x[0] - centre[0])
    for a, b in zip(x[1:], centre[1:]):
        total = total + (a - b) * (a - b)
    return total


def _nearest(distances: list[Column]) -> tuple[Column, Column]:
    """The least distance and its number."""
    least = F.least(*distances) if len(distances) > 1 else distances[0]
    number = F.lit(len(distances) - 1)
    for j in reversed(range(len(distances) - 1)):
        number = F.when(distances[j] == least, j).otherwise(number)
    return least, number


def _squared_text(j: int, k: int, dims: int) -> str:
    """The squared distance of ``x`` to centre ``j`` of set ``r`` in the flat array ``c``."""
    apart = [f"(x{i} - c[r * {k * dims} + {j * dims + i}])" for i in range(dims)]
    return " + ".join(f"{d} * {d}" for d in apart)


def _with_distances(rows: DataFrame, sets: list[Centres], dims: int) -> DataFrame:
    """The rows once per centre set ``r`` with ``x0, x1, ...`` and the squared distances ``d0,
    d1, ...`` to that set's centres.

    The centres are a scalar subquery over one literal row, bound once per row: the plan is
    a few expressions whatever the number of sets."""
    numbers = ", ".join(f"{v!r}D" for centres in sets for c in centres for v in c)
    k = len(sets[0])
    bound = rows.selectExpr("*", f"(SELECT c FROM VALUES (array({numbers})) AS t(c)) AS c",
                            f"explode(sequence(0, {len(sets) - 1})) AS r")
    return bound.selectExpr("key", "r", *[f"x{i}" for i in range(dims)],
                            *[f"{_squared_text(j, k, dims)} AS d{j}" for j in range(k)])


def starting_centres(rows: DataFrame, k: int, seeds: list[int], dims: int) -> list[Centres]:
    """k-means++ centres of every seed: ``k`` aggregates over ``key, x0, x1, ...``."""
    sets: list[Centres] = [[] for _ in seeds]
    for step in range(k):
        if step:
            spread = _with_distances(rows, sets, dims)
            least = _nearest([F.col(f"d{j}") for j in range(step)])[0]
        else:
            spread, least = rows.selectExpr("*", f"explode(sequence(0, {len(seeds) - 1})) AS r"), F.lit(1.0)
        bits = F.expr(f"shiftrightunsigned(xxhash64(array({', '.join(map(str, seeds))})[r], {step}, key), 11)")
        race = -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))      # of a uniform number in (0, 1)
        drawn = spread.select("r", *[f"x{i}" for i in range(dims)], F.when(least > 0, race / least).alias("race"))
        got = drawn.groupBy("r").agg(*[F.min_by(f"x{i}", "race").alias(f"x{i}") for i in range(dims)]).collect()
        for g in got:
            pick = [g[f"x{i}"] for i in range(dims)]
            # fewer distinct rows than centres (no row off the centres): one is doubled
            sets[g.r].append(pick if pick[0] is not None else list(sets[g.r][0]))
    return sets


def lloyd_step(rows: DataFrame, sets: list[Centres], dims: int) -> list[tuple[float, dict[int, tuple[int, list[float]]]]]:
    """Per centre set its cost and, per non-empty cluster, the rows and their sums: one job."""
    named = _with_distances(rows, sets, dims)
    least, number = _nearest([F.col(f"d{j}") for j in range(len(sets[0]))])
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(dims)]
    got = (named.groupBy("r", number.alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum(least).alias("cost"), *sums).collect())
    out: list[tuple[float, dict]] = [(0.0, {}) for _ in sets]
    for g in sorted(got, key=lambda g: (g.r, g.j)):
        cost, clusters = out[g.r]
        clusters[g.j] = (g.n, [g[f"s{i}"] for i in range(dims)])
        out[g.r] = (cost + g.cost, clusters)
    return out


def fit_restarts(data: DataFrame, columns: list[str], key: str, k: int, seeds: list[int],
                 max_iter: int = 300, tol: float = 1e-4) -> Clustering:
    """Fits ``len(seeds)`` restarts together; a restart has settled when the summed squared
    shift of its centres is at most ``tol``. An empty cluster keeps its centre. ``data`` is read
    once per step: hand in a persisted or written frame. Jobs: ``k``, plus the slowest
    restart's iterations, plus one for the costs."""
    dims = len(columns)
    rows = data.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    sets = starting_centres(rows, k, seeds, dims)
    iterations, open_ = [0] * len(sets), list(range(len(sets)))
    while open_:
        settled = []
        for i, (_, clusters) in zip(open_, lloyd_step(rows, [sets[i] for i in open_], dims)):
            new = [[s / clusters[j][0] for s in clusters[j][1]] if j in clusters else c for j, c in enumerate(sets[i])]
            shift = sum((a - b) ** 2 for p, q in zip(new, sets[i]) for a, b in zip(p, q))
            sets[i], iterations[i] = new, iterations[i] + 1
            if shift <= tol or iterations[i] >= max_iter:
                settled.append(i)
        open_ = [i for i in open_ if i not in settled]
    costs = [cost for cost, _ in lloyd_step(rows, sets, dims)]
    best = min(range(len(sets)), key=lambda i: (costs[i], i))
    return Clustering(columns, sets[best], costs[best], costs, iterations)
