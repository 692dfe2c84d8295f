"""Empirical orthogonal functions over time, from the Gram matrix of the time steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.cube import Cube

#: Up to so many time steps the matrix of their products is decomposed on the driver; beyond, a few of its vectors are iterated.
MAX_STEPS = 4000
#: Vectors iterated beyond those asked for, the change at which they have settled, and the most rounds.
SPARE, SETTLED, ROUNDS = 8, 1e-12, 500


@dataclass
class Eof:
    maps: DataFrame  # variable, the cube's dimensions but t, m, value
    pcs: DataFrame  # t, m, value
    fractions: list[float]  # shares of variance, by mode


def _summed(rows: DataFrame) -> dict[int, np.ndarray]:
    """Rows (i, packed doubles) of many tasks added up by i: a row an i reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(v)
                sums[i] = sums[i] + own if i in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["i", "v"])

    return {r["i"]: np.frombuffer(r["v"]) for r in rows.repartition("i").mapInArrow(add, "i int, v binary").collect()}


def _matrix(series: DataFrame, n: int) -> np.ndarray:
    """The products of time steps, summed over the series: a task sends a packed row a step."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            a = np.array(batch.column(0).flatten()).reshape(-1, n)
            total += a.T @ a
        for at in range(0, n, 256):
            part = range(at, min(n, at + 256))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[i, i:].tobytes() for i in part], pa.binary())], names=["i", "v"])

    g = np.zeros((n, n))
    for i, v in _summed(series.select("s").mapInArrow(gram, "i int, v binary")).items():
        g[i, i:] = g[i:, i] = v
    return g


def _leading(series: DataFrame, n: int, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and vectors of that matrix, which is not made: some vectors, iterated until they settle.

    A round is a job in which tasks multiply their series by the vectors and
    back; n times a few values come to the driver, whatever the grid.
    """

    def times(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                a = np.array(batch.column(0).flatten()).reshape(-1, n)
                total += a.T @ (a @ q)
            for at in range(0, n, 256):
                part = range(at, min(n, at + 256))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[i].tobytes() for i in part], pa.binary())], names=["i", "v"])

        found = _summed(series.select("s").mapInArrow(run, "i int, v binary"))
        return np.array([found[i] for i in range(n)]) if found else np.zeros(q.shape)

    q = np.linalg.qr(np.random.default_rng(7).normal(size=(n, min(n, modes + SPARE))))[0]
    before = np.zeros(q.shape[1])
    for _ in range(ROUNDS):
        product = times(q)
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        order = np.argsort(values)[::-1]
        values, ritz = values[order], q @ turn[:, order]
        if np.abs(values - before)[:modes].max(initial=0.0) <= SETTLED * max(values.max(initial=0.0), 1e-300):
            return values, ritz
        before, q = values, np.linalg.qr(product)[0]
    raise ValueError(f"the modes did not settle in {ROUNDS} rounds: ask for fewer, or resample")


def eof(cube: Cube, modes: int = 16, center: bool = True) -> Eof:
    """Modes of variability of all variables together.

    The series of each cell and variable is gathered into one array, as long
    as the time axis. Tasks add up the products of time steps over their
    cells; up to ``MAX_STEPS`` steps that matrix, whose size does not depend
    on the grid, is decomposed on the driver, beyond that its leading vectors
    are found by iteration. Cells that miss a step are left out. Maps have
    unit norm; the sign makes the loading of largest size positive. Without data there are no modes.
    """
    spark = cube.df.sparkSession
    steps = cube.coordinates("t")["t"]
    n, keep = len(steps), cube.others(["t"])
    stacked = F.explode(F.create_map(*[x for v in cube.variables for x in (F.lit(v), cube.value(v))])).alias("variable", "v")
    long = cube.df.select("t", *keep, stacked).where("v is not null")
    series = long.groupBy("variable", *keep).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))  # as many values as steps
    series = series.where(F.size("s") == n).withColumn("s", F.transform("s", lambda p: p["v"]))
    if center:
        mean = F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.lit(float(max(1, n)))
        series = series.withColumn("_mean", mean).withColumn("s", F.transform("s", lambda v: v - F.col("_mean"))).drop("_mean")
    series = series.persist()
    if n > MAX_STEPS:
        values, vectors = _leading(series, n, modes)
        squares = F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v)
        total = series.agg(F.coalesce(F.sum(squares), F.lit(0.0))).first()[0]
    else:
        values, vectors = np.linalg.eigh(_matrix(series, n)) if n else (np.zeros(0), np.zeros((0, 0)))
        total = np.maximum(values, 0).sum()
    order = np.argsort(values)[::-1][:modes]
    values = np.maximum(values, 0)
    order = [k for k in order if values[k] > 1e-12 * max(total, 1e-300)]
    scale = np.sqrt(values[order])
    u = vectors[:, order]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.array(batch.column(batch.num_columns - 1).flatten()).reshape(-1, n)
            loads = (a @ u) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(loads), pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "loads"])

    kinds = dict(cube.df.dtypes)
    shape = ", ".join(["variable string", *[f"`{k}` {kinds[k]}" for k in keep]])
    if not order:
        series.unpersist()
        maps = spark.createDataFrame([], f"{shape}, m int, value double")
        return Eof(maps, spark.createDataFrame([], f"t {kinds['t']}, m int, value double"), [])
    loads = series.select("variable", *keep, "s").mapInArrow(project, f"{shape}, loads array<double>").persist()
    # the extreme loading of each mode: one row
    ends = loads.agg(*[F.max_by(F.col("loads")[k], F.abs(F.round(F.col("loads")[k], 9))).alias(f"k{k}") for k in range(len(order))]).first()
    series.unpersist()  # the maps are in storage, and Spark can make them again
    sign = np.where(np.array(ends, float) < 0, -1.0, 1.0)
    maps = loads.select("variable", *keep, F.posexplode("loads").alias("m", "value")).withColumn("value", F.col("value") * F.element_at(F.lit(sign.tolist()), F.col("m") + 1))
    pcs = [(steps[i], k, float(u[i, k] * scale[k] * sign[k])) for i in range(n) for k in range(len(order))]
    return Eof(maps, spark.createDataFrame(pcs, f"t {kinds['t']}, m int, value double"), [float(values[k] / total) for k in order])


def by_mode(cube: Cube) -> dict[int, Cube]:
    """A cube with modes, apart: without the dimension ``m``."""
    modes = cube.coordinates("m")["m"]  # as many as were asked for
    return {m: cube.with_df(cube.df.where(F.col("m") == m).drop("m"), dims=cube.others(["m"])) for m in modes}


def maps_and_components(cubes: list[Cube]) -> tuple[list[Cube], list[Cube]]:
    """Results of ``eof`` in two kinds: those over space, and those over time."""
    return [c for c in cubes if "t" not in c.dims], [c for c in cubes if "t" in c.dims]
