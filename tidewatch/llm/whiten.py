"""Whitened principal components of embeddings.

Entries become whole numbers, `floor(scale * c)`. The components are fitted to the list of different vectors,
each once however often it occurs. Sums are exact; the covariance is of centred entries. Both are added up in
each task and then by dimension. `feast` extracts the components: its shifted solves run as tasks, one for
each node of a contour, over the covariance, which is as large as the dimension and broadcast.

The last pass projects every row. The covariance of the whitened fit list is measured on its rows, and its
largest distance from the identity is returned with every row.

Edge cases: rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, and so are
those that do not have the dimension that most different vectors have (of equally many, the greatest).
Rows with null or repeated ids stay. A component without variance, as by rounding, has no rows, since it
cannot be whitened; so one vector alone gives no rows, and neither does an empty table. Entries beyond the
range of a long are taken as its ends. A deviation beyond it is null.
"""

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import feast
from tidewatch.plans.durable import written

SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")
_LIMIT = 2 ** 63
_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Fit:
    """`sums` of the `n` different vectors by dimension; `vectors` (as columns) and `values` of the
    components; `total` is the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def turn(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """`vec_id, x` of the rows whose vector has finite entries alone."""
    vector = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    return (rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
            .select("vec_id", F.transform("v", lambda c: F.floor(scale * c)).alias("x")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Of the columns; entries that might overflow in a sum are added as Python's numbers."""
    if len(x) and int(np.abs(x.astype(float)).max()) < _LIMIT // (2 * len(x)):
        return [int(v) for v in x.sum(axis=0)]
    return [sum(map(int, column)) for column in x.T]


def sums_of(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and their sums by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            x = _matrix(batch["x"], size)
            n, sums = n + len(x), [a + b for a, b in zip(sums, _exact_sums(x))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, size), pa.int32()),
             pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))], names=["cell", "v"])

    rows = fit.mapInArrow(run, "cell int, v decimal(38,0)").groupBy("cell").agg(
        F.sum("v").cast("decimal(38,0)").alias("v"))
    found = {r["cell"]: int(r["v"]) for r in rows.collect()}  # one for each dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def products_of(fit: DataFrame, mean: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """The sum over the vectors of the products of their centred entries, or of `turn` of them."""
    size = len(mean)
    wide = size if turn is None else turn.shape[1]
    upper = np.triu_indices(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            y = _matrix(batch["x"], size) - mean
            y = y if turn is None else y @ turn
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(upper[0])), pa.int32()),
                                          pa.array(total[upper])], names=["cell", "v"])

    rows = fit.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros((wide, wide))
    for row in rows.collect():  # half the square of the dimension
        i, j = upper[0][row["cell"]], upper[1][row["cell"]]
        out[i, j] = out[j, i] = row["v"]
    return out


def solver(spark: SparkSession, matrix: np.ndarray) -> feast.Solve:
    """Solves each node in a task of its own. The matrix and the blocks have the vectors' dimension."""
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                block = np.frombuffer(row["block"]).reshape(len(sent.value), -1)
                node = feast.Node(row["interval"], row["place"], complex(*row["shift"]),
                                  complex(*row["weight"]), block)
                out.append(feast.term(sent.value, node).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["interval"], batch["place"], pa.array(out, pa.binary())],
                names=["interval", "place", "part"])

    def solve(nodes: list[feast.Node]) -> dict[int, np.ndarray]:
        rows = [(x.interval, x.place, [x.shift.real, x.shift.imag], [x.weight.real, x.weight.imag],
                 bytearray(np.ascontiguousarray(x.block).tobytes())) for x in nodes]
        parts = (spark.createDataFrame(rows, "interval int, place int, shift array<double>, "
                                             "weight array<double>, block binary")
                 .repartition(len(rows)).mapInArrow(run, "interval int, place int, part binary"))
        sums: dict[int, np.ndarray] = defaultdict(float)
        for row in sorted(parts.collect()):  # in the same order each time
            sums[row["interval"]] += np.frombuffer(row["part"]).reshape(len(matrix), -1)
        return dict(sums)

    return solve


def fitted(rows: DataFrame, components: int) -> tuple[int, Fit | None]:
    """The dimension and the fit to the different vectors of `rows(vec_id, x)`."""
    spark = rows.sparkSession
    fit = written(rows.select("x").distinct(), "fit-vectors")
    sizes = fit.groupBy(F.size("x").alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not first:
        return 0, None
    size = first[0]["size"]
    fit = fit.filter(F.size("x") == size)
    n, sums = sums_of(fit, size)
    mean = np.array([s / n for s in sums])
    covariance = products_of(fit, mean) / n
    values, vectors = feast.greatest(covariance, components, solver(spark, covariance))
    total = float(np.trace(covariance))
    real = values > size * _EPS * total
    if not real.any():
        return size, None
    found = Fit(n, sums, values[real], vectors[:, real], total, 0.0)
    # Whitened entries are centred already, but for rounding.
    off = products_of(fit, mean, found.turn) / n - np.eye(int(real.sum()))
    return size, Fit(n, sums, found.values, found.vectors, total, float(np.abs(off).max()))


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """The sum of `(n * x - sum) ** 2` of each row, exactly."""
    largest = max([abs(fit.n * int(v) - s) for v, s in zip(x.max(axis=0), fit.sums)]
                  + [abs(fit.n * int(v) - s) for v, s in zip(x.min(axis=0), fit.sums)])
    if largest ** 2 * len(fit.sums) < _LIMIT:
        away = fit.n * x - np.array(fit.sums, dtype=np.int64)
        return (away * away).sum(axis=1).tolist()
    away = fit.n * x.astype(object) - np.array(fit.sums, dtype=object)
    return [v if v < _LIMIT else None for v in (away * away).sum(axis=1)]


def whitened(df: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """`SCHEMA`: a row for each row of `df` with a usable vector and each component."""
    rows = whole(df, id_col, vector_col, scale)
    size, fit = fitted(rows, components)
    if fit is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    sent = df.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value
        wide = len(fit.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"], size)
            n = len(x) * wide
            places = pa.array(np.repeat(np.arange(len(x)), wide))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(places),
                 pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(n, fit.n)), pa.array(_deviations(x, fit), pa.int64()).take(places),
                 pa.array(((x - fit.mean) @ fit.turn).ravel()),
                 pa.array(np.tile(fit.values / fit.total, len(x))),
                 pa.array(np.full(n, fit.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return rows.filter(F.size("x") == size).mapInArrow(run, SCHEMA)
