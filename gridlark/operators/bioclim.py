"""The 19 bioclimatic indices of temperature and moisture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.cube import Cube
from gridlark.functions.calendar import bin_label
from gridlark.operators.rolling import densify

INDICES = [f"bio{k}" for k in range(1, 20)]
#: Quarters need so many steps, unless months wrap around.
STEPS = 14


def celsius(cube: Cube, variable: str, units: str | None = None) -> Cube:
    """Kelvin to Celsius: by units, or without them if the first value is above 150."""
    if units is None:
        first = cube.df.where(cube.value(variable).isNotNull()).select(cube.value(variable)).limit(1).collect()
        kelvin = bool(first) and first[0][0] > 150
    else:
        kelvin = units.lower().startswith("k")
    if not kelvin:
        return cube
    return cube.with_df(cube.df.withColumn(variable, cube.value(variable) - 273.15))


def monthly_extremes(cube: Cube, temp: str, moist: str) -> Cube:
    """From values under a day: means over the years of each month's highest and lowest daily extremes, and of moisture."""
    keep = cube.others(["t"])
    daily = cube.df.groupBy(*keep, bin_label(F.col("t"), "1D").alias("t")).agg(F.max(cube.value(temp)).alias("hi"), F.min(cube.value(temp)).alias("lo"), F.avg(cube.value(moist)).alias("wet"))
    months = daily.groupBy(*keep, F.month("t").alias("m")).agg(F.max("hi").alias("tmax"), F.min("lo").alias("tmin"), F.avg("wet").alias("moist"))
    rows = months.withColumn("t", F.make_date(F.lit(2000), F.col("m"), F.lit(1))).select("t", *keep, "tmax", "tmin", "moist")
    return cube.with_df(rows, dims=["t", *keep], variables=["tmax", "tmin", "moist"])


def world_clim(cube: Cube, tmin: str = "tmin", tmax: str = "tmax", moist: str = "pr", hscale: float = 1.0, tscale: float = 1.0, wrap: bool = False) -> DataFrame:
    """The indices of each cell, from monthly extremes of temperature and monthly moisture.

    A quarter is a step with its two neighbours; the first extreme of equals
    counts. One exchange by cell serves the moving averages and all extremes;
    a second aggregation makes all indices. ``wrap`` joins December and January of a single
    year, which has no quarters otherwise.
    """
    keep = cube.others(["t"])
    base = cube.select(tmin, tmax, moist)
    steps = base.axis_length("t")
    if steps < STEPS and not wrap:
        raise ValueError(f"quarters need {STEPS} steps; there are {steps}")
    dense = densify(base).df
    lo, hi, wet = (F.col(f"`{c}`") for c in (tmin, tmax, moist))
    rows = dense.select(*keep, "t", (lo * tscale).alias("lo"), (hi * tscale).alias("hi"), (wet * hscale).alias("wet"))
    rows = rows.withColumns({"ave": (F.col("hi") + F.col("lo")) / 2, "range": (F.col("hi") - F.col("lo")) * 2.0})
    series = Window.partitionBy(*keep).orderBy("t")
    rows = rows.withColumn("i", F.row_number().over(series))
    if wrap:
        before = rows.where(F.col("i") == steps).withColumn("i", F.lit(0))
        after = rows.where(F.col("i") == 1).withColumn("i", F.lit(steps + 1))
        rows = rows.unionByName(before).unionByName(after)
        series = Window.partitionBy(*keep).orderBy("i")
    three = series.rowsBetween(-1, 1)

    def moving(name: str):
        return F.when(F.count(name).over(three) == 3, F.avg(name).over(three))

    rows = rows.withColumns({"q_wet": moving("wet"), "q_ave": moving("ave")})
    cell = Window.partitionBy(*keep)

    def position(name: str, largest: bool):
        v = F.col(name) if largest else -F.col(name)
        return F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("i")).alias("i")))).over(cell)["i"] * -1

    rows = rows.withColumns({"i_wet": position("q_wet", True), "i_dry": position("q_wet", False), "i_warm": position("q_ave", True), "i_cold": position("q_ave", False)})

    def quarter(kind: str, value: str, total: bool):
        inside = F.when(F.abs(F.col("i") - F.col(f"i_{kind}")) < 2, F.col(value))
        return F.coalesce(F.sum(inside), F.lit(0.0)) if total else F.avg(inside)

    year = (lambda c: F.when(F.col("i").between(1, steps), c)) if wrap else (lambda c: c)
    means = {
        "bio1": F.avg(year(F.col("ave"))),
        "bio2": F.avg(year(F.col("range"))),
        "bio4": F.stddev_pop(year(F.col("ave"))),
        "bio5": F.max("hi"),
        "bio6": F.min("lo"),
        "bio8": quarter("wet", "ave", False),
        "bio9": quarter("dry", "ave", False),
        "bio10": quarter("warm", "ave", False),
        "bio11": quarter("cold", "ave", False),
        "bio12": F.coalesce(F.sum(year(F.col("wet"))), F.lit(0.0)),
        "bio13": F.max("wet"),
        "bio14": F.min("wet"),
        "_spread": F.stddev_pop(year(F.col("wet"))),
        "bio16": quarter("wet", "wet", True),
        "bio17": quarter("dry", "wet", True),
        "bio18": quarter("warm", "wet", True),
        "bio19": quarter("cold", "wet", True),
    }
    out = rows.groupBy(*keep).agg(*[c.alias(n) for n, c in means.items()])
    out = out.withColumn("bio7", F.col("bio5") - F.col("bio6"))
    out = out.withColumn("bio3", F.when(F.col("bio7") != 0, F.col("bio2") * 100 / F.col("bio7")))
    out = out.withColumn("bio15", F.col("_spread") * 100 / (F.col("bio12") / 12 + 1))
    return out.select(*keep, *INDICES)
