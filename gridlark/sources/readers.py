"""Where cubes come from and go to: addresses, catalogues, archives and fixed-width text."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.cube import Cube

#: Schemes of addresses and the kinds of source they stand for.
KINDS = {"collection": "collection", "file": "file", "archive": "archive", "view": "view", "http": "dap", "https": "dap", "dap": "dap"}


@dataclass(frozen=True)
class Policy:
    """Which kinds of source may be opened, and which remote servers are trusted."""

    allowed: tuple[str, ...] = ("collection", "file", "archive", "view")
    trusted: tuple[str, ...] = ()


@dataclass(frozen=True)
class Address:
    kind: str
    path: str
    auth: str | None = None

    @staticmethod
    def parse(uri: str, policy: Policy | None = None) -> Address:
        """``[auth@]scheme:path``; the kind must be allowed, a remote server trusted."""
        policy = policy or Policy()
        m = re.fullmatch(r"(?:([A-Za-z0-9]+)@)?([a-z]+):(.+)", uri, re.S)
        if not m or m[2] not in KINDS:
            raise ValueError(f"not a source: {uri!r}")
        kind = KINDS[m[2]]
        if kind not in policy.allowed:
            raise PermissionError(f"sources of kind {kind} are not allowed")
        path = m[3] if kind != "dap" else f"{m[2]}:{m[3]}"
        if kind == "dap" and not any(re.match(rf"https?://{re.escape(s)}(/|:|$)", path) for s in policy.trusted):
            raise PermissionError(f"not a trusted server: {path}")
        return Address(kind, path if kind == "dap" or not path.startswith("///") else path[2:], m[1])


def parse_variables(names: str | list[str]) -> list[tuple[str, str]]:
    """``name:id`` (or ``name|id``) entries as (name, id); without an id it is the name."""
    entries = names.split(",") if isinstance(names, str) else names
    out = []
    for entry in filter(None, (e.strip() for e in entries)):
        name, _, own = entry.replace("|", ":").partition(":")
        out.append((name.strip(), own.strip() or name.strip()))
    return out


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share (``spark.checkpoint.dir``); a local master may go without that setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="gridlark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or JSON by the ending of a path, a folder or a glob."""
    low = path.rstrip("/*").lower()
    if low.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)


@dataclass
class Catalogue:
    """Collections: which aggregation a variable is in, and the files of each aggregation."""

    folder: str
    options: dict[str, str] = field(default_factory=dict)
    remap: dict[str, str] = field(default_factory=dict)  # how paths begin in the records, and here
    most_partitions: int | None = None  # of a read; by default as many as the files' sizes ask for

    def collection(self, spark: SparkSession, name: str) -> dict[str, str]:
        """Variable -> aggregation, from ``<name>.csv``: ``#key,value`` lines and ``variable,aggregation`` rows."""
        rows = [r["value"] for r in spark.read.text(f"{self.folder}/{name}.csv").collect()]  # metadata: a line per variable
        out = {}
        for row in rows:
            parts = [p.strip() for p in row.split(",")]
            if len(parts) >= 2 and parts[0].startswith("#"):
                self.options[parts[0][1:].strip()] = parts[1]
            elif len(parts) >= 2 and parts[0]:
                out[parts[0]] = parts[1]
        return out

    def aggregation(self, spark: SparkSession, name: str) -> dict[str, list[list[str]]]:
        """Records of ``<name>.ag1`` by kind: P parameters, A axes, C dimensions, V variables, F files."""
        rows = [r["value"] for r in spark.read.text(f"{self.folder}/{name}.ag1").collect()]
        out: dict[str, list[list[str]]] = {k: [] for k in "PACVF"}
        for row in rows:
            kind, *values = [p.strip() for p in row.split(";")]
            if kind in out:
                out[kind].append(values)
        return out

    def files(self, spark: SparkSession, name: str, start_minutes: float | None = None, end_minutes: float | None = None) -> list[str]:
        """Files (start in minutes since 1970; size; path) whose time can meet a range.

        A file lasts until the next one begins, so the one that begins last
        before the range counts too. A single file is always read.
        """
        records = self.aggregation(spark, name)
        base = next((p[1] for p in records["P"] if p and p[0] == "base.path"), self.folder)
        files = sorted((float(f[0]), f[2]) for f in records["F"] if len(f) >= 3)
        if len(files) > 1:
            begins = [s for s, _ in files]
            lo = 0 if start_minutes is None else max([0, *(k for k, s in enumerate(begins) if s <= start_minutes)])
            hi = len(files) if end_minutes is None else sum(s <= end_minutes for s in begins)
            files = files[lo:hi]
        paths = [p if re.match(r"[a-z]+:|/", p) else f"{base}/{p}" for _, p in files]
        return [next((self.remap[k] + p[len(k) :] for k in sorted(self.remap, key=len, reverse=True) if p.startswith(k)), p) for p in paths]

    def open(self, spark: SparkSession, name: str, variables: list[str], start_minutes: float | None = None, end_minutes: float | None = None) -> dict[str, DataFrame]:
        """One read per aggregation, of the files that can meet the range; columns are pruned by use."""
        where = self.collection(spark, name)
        if missing := [v for v in variables if v not in where]:
            raise KeyError(f"not in collection {name}: {missing}")
        out = {}
        for aggregation in dict.fromkeys(where[v] for v in variables):
            paths = self.files(spark, aggregation, start_minutes, end_minutes)
            read = spark.read.parquet(*paths)
            out[aggregation] = read.coalesce(self.most_partitions) if self.most_partitions else read
        return out

    def listing(self, spark: SparkSession, name: str) -> DataFrame:
        """A row per variable of a collection: its aggregation, number of files and total size, axes and what its record says."""
        rows, seen = [], {}
        for variable, aggregation in self.collection(spark, name).items():
            if aggregation not in seen:
                seen[aggregation] = self.aggregation(spark, aggregation)
            records = seen[aggregation]
            files = [f for f in records["F"] if len(f) >= 3]
            axes = " ".join(f"{a[0]}:{a[-1]}" for a in records["A"] if a)
            says = next((" ".join(v[1:]) for v in records["V"] if v and v[0] == variable), None)
            rows.append((variable, aggregation, len(files), sum(int(float(f[1])) for f in files), axes, says))
        return spark.createDataFrame(rows, "variable string, aggregation string, n_files int, n_bytes long, axes string, shape string")

    def write(self, spark: SparkSession, name: str, variables: dict[str, str], options: dict[str, str] | None = None) -> None:
        lines = [f"#{k},{v}" for k, v in (options or {}).items()] + [f"{v},{a}" for v, a in variables.items()]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}.csv")


@dataclass
class Archive:
    """Results kept as Parquet under ``<base>/<project>/<experiment>/<id>``."""

    base: str
    project: str = "default"
    experiment: str = "default"

    def path(self, result: str) -> str:
        """Of an id that may name its experiment, and its project: ``[[proj/]exp/]id``."""
        parts = result.split("/")
        if len(parts) > 3 or not all(re.fullmatch(r"[\w.\-\[\]]+", p) and p not in (".", "..") for p in parts):
            raise ValueError(f"not a result id: {result!r}")
        return "/".join([self.base.rstrip("/"), *[self.project, self.experiment][: 3 - len(parts)], *parts])

    def save(self, cube: Cube, result: str) -> str:
        """Write a cube with its dimensions, variables and attributes; one with a time axis is partitioned by year, so that ranges prune files."""
        df, path = cube.df.select(*cube.dims, *[cube.value(v) for v in cube.variables]), self.path(result)
        if "t" in cube.dims:
            df.withColumn("_year", F.year("t")).write.mode("overwrite").partitionBy("_year").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        meta = json.dumps({"dims": cube.dims, "variables": cube.variables, "attrs": cube.attrs})
        cube.df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/_meta")
        return path

    def open(self, spark: SparkSession, result: str, variables: list[str] | None = None, years: tuple[int | None, int | None] = (None, None)) -> Cube:
        """A saved cube as it was; ``years`` read the partitions of a range only. Other Parquet is read by its columns' names."""
        path = self.path(result)
        df = spark.read.parquet(path)
        if "_year" in df.columns:
            for year, keep in zip(years, (lambda y: F.col("_year") >= y, lambda y: F.col("_year") <= y), strict=True):
                df = df if year is None else df.where(keep(year))
            df = df.drop("_year")
        try:
            meta = json.loads(spark.read.text(f"{path}/_meta/part-*").first()["value"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return Cube.of(df, variables=variables)
        cube = Cube(df.select(*[f"`{c}`" for c in (*meta["dims"], *meta["variables"])]), tuple(meta["dims"]), tuple(meta["variables"]), meta["attrs"])
        return cube.select(*variables) if variables else cube


#: Seasonal columns of the rainfall tables with the month they are stamped at.
SEASONS = {"ANN": 6, "JF": 2, "MAM": 4, "JJAS": 8, "OND": 11}


def parse_rainfall(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fixed-width rainfall text as (t, series, value).

    A line has the year in four characters, then 17 fields of seven: twelve
    months (series ``month``, stamped at their day 15), then the year and four
    seasons (stamped at day 15 of a month of theirs). Lines without a year
    from 1701 to 2999 are skipped; blank fields are missing.
    """
    year = F.expr(f"try_cast(trim(substring(`{column}`, 1, 4)) as int)")
    rows = lines.select(year.alias("year"), F.col(column).alias("line")).where("year > 1700 and year < 3000")
    names = [("month", m) for m in range(1, 13)] + list(SEASONS.items())
    cells = [F.struct(F.lit(n).alias("series"), F.lit(m).alias("month"), F.expr(f"try_cast(nullif(trim(substring(line, {5 + 7 * k}, 7)), '') as double)").alias("value")) for k, (n, m) in enumerate(names)]
    out = rows.select("year", F.explode(F.array(*cells)).alias("c"))
    return out.select(F.make_date("year", "c.month", F.lit(15)).alias("t"), "c.series", "c.value")
