"""Mixing sources to target weights by capped water-filling and seeded sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import table, word_count

#: A source's documents are sampled by size class, the largest first, so that
#: later classes make up for what the earlier ones missed. Bounds of the classes.
CLASS_BOUNDS = [64, 512, 4096, 32768]
#: A hash of this many bits places a document within its class.
HASH_BITS = 16


def place(doc_id: Column, seed: int) -> Column:
    """A seeded place from 0 to 65535, the same in every run."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("int")


def size_class(size: Column) -> Column:
    out = F.lit(0)
    for k, bound in enumerate(CLASS_BOUNDS, 1):
        out = F.when(size >= bound, k).otherwise(out)
    return out


def water_level(sources: DataFrame, total: float) -> float:
    """The level up to which weights are filled: target = min(cap, level * weight).

    ``sources`` has weight and cap. Each round clamps the sources above their
    cap and shares the rest by weight among the others, until none is above.
    A round is one aggregation; only two sums reach the driver. If all sources
    are full (or have no weight), the level is infinite.
    """
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            return float("inf")
        # the full ones stay full as the level only rises
        new = max(0.0, total - (row["full"] or 0.0)) / row["free"]
        if new <= level:
            return level
        level = new


def _cuts(group: pd.DataFrame) -> pd.DataFrame:
    """For one source: the first hash place of each size class that gets no extra copy.

    The group has at most classes * 2 ** HASH_BITS rows, whatever the corpus.
    """
    group = group.sort_values(["class", "place"], ascending=[False, True])
    size = float(group["source_size"].iloc[0])
    share = float(group["extra"].iloc[0]) / size if size else 0.0
    carry, cuts = 0.0, []
    for cls, part in group.groupby("class", sort=False):
        sums = part["words"].to_numpy(float)
        ends = np.cumsum(sums)
        owed = share * float(ends[-1]) + carry
        n = int(np.searchsorted(ends - sums / 2, owed, side="right"))  # whole places while half of the next is still owed
        cuts.append((int(cls), int(part["place"].iloc[n]) if n < len(part) else 1 << HASH_BITS))
        carry = owed - (float(ends[n - 1]) if n else 0.0)
    out = pd.DataFrame(cuts, columns=["class", "cut"])
    for c in ("source_key", "source_size", "target", "whole"):
        out[c] = group[c].iloc[0]
    return out


def mix_sources(
    docs: DataFrame,
    weights: list[float],
    share: float,
    max_epochs: float = 2.0,
    size: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = 17,
) -> DataFrame:
    """Decide how many copies of each document a mix takes.

    Sources in code-point order, null last, get ``weights`` in turn, repeating.
    The mix is ``share`` times the size of all documents. A source's target is
    at most ``max_epochs`` times its size; the excess goes to the others by
    weight (``water_level``). The target's whole epochs take every document;
    the rest takes one more copy of that share of each size class, in the
    order of a seeded hash; what a class is over or under goes to the next
    smaller one, so that what is taken ends near half a small document of the target.

    Returns all columns of ``docs`` in a struct ``doc``, and size, source_size, target,
    copies. Nulls: a null source is a source; a null text has size 0; a null
    doc_id is hashed as an empty one. Repeated rows are taken or left
    together. Documents of size 0 follow their place in the hash as well. An empty input gives an
    empty result.
    """
    size = word_count(F.col("text")) if size is None else size
    base = docs.select(F.struct(*docs.columns).alias("doc"), size.alias("size"), docs[source].cast("string").alias("_source"), docs[doc_id].alias("_id"))
    base = base.withColumns({"class": size_class(F.col("size")), "place": place(F.col("_id"), seed)})
    # null has a key of its own; a real source never starts with "0"
    key = F.when(F.col("_source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("_source")))
    base = base.withColumn("source_key", key)
    hist = table(base.groupBy("source_key", "class", "place").agg(F.sum("size").alias("words")), "mix-hist")
    sources = hist.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    # one row per source, not per document
    order = Window.orderBy((F.col("source_key") == "0").asc(), F.col("source_key").asc())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.lit([float(w) for w in weights]), turn + 1)
    sources = table(sources.withColumns({"weight": weight, "cap": max_epochs * F.col("source_size").cast("double")}), "mix-sources")
    total = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total)
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    target = F.when(F.col("weight") > 0, target).otherwise(0.0)
    sources = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    planned = hist.join(sources, "source_key").groupBy("source_key")
    cuts = planned.applyInPandas(_cuts, "class int, cut int, source_key string, source_size long, target double, whole long")
    cuts = table(cuts, "mix-cuts")  # at most one row per source and class
    out = base.join(cuts, ["source_key", "class"])
    copies = F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0)
    return out.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


WEIGHTS = [5.0, 2.0, 1.0]
SHARE = 1.5


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 5, 2, 1, 150 % of all words, two epochs at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix_sources(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), WEIGHTS, SHARE, 2.0, size=F.col("words"))
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _oracle() -> str:
    """The same decisions in SQL; the level is found by sorting instead of rounds."""
    cls = "CASE " + " ".join(f"WHEN size >= {b} THEN {k}" for k, b in sorted(enumerate(CLASS_BOUNDS, 1), reverse=True)) + " ELSE 0 END"
    sql = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, {HASH_BITS // 4}))::int AS place
  FROM documents
), b AS (SELECT *, {cls} AS class, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k FROM d),
h AS (SELECT k, class, place, sum(size)::double AS words FROM b GROUP BY ALL),
s0 AS (SELECT k, sum(words)::bigint AS source_size FROM h GROUP BY k),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k = '0', k) - 1) % 3 + 1)::int]::double AS weight, 2.0::double * source_size AS cap FROM s0),
s2 AS (SELECT *, 1.5::double * sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_caps,
  sum(weight) OVER (ORDER BY cap / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s1),
lv AS (SELECT max((total - full_caps) / free) FILTER ((total - full_caps) / free < cap / weight) AS level FROM s2),
s3 AS (SELECT k, source_size, least(cap, coalesce(level, 'inf'::double) * weight) AS target FROM s2, lv),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS extra FROM s3),
r AS (SELECT *, sum(words) OVER (PARTITION BY k, class ORDER BY place) AS ends FROM h),
o{len(CLASS_BOUNDS) + 1} AS (SELECT k, CASE WHEN source_size > 0 THEN extra / source_size ELSE 0 END AS share, 0.0::double AS carry FROM s)"""
    for c in range(len(CLASS_BOUNDS), -1, -1):
        sql += f""",
w{c} AS (SELECT o.k, o.share, o.share * coalesce(m.total, 0) + o.carry AS owed FROM o{c + 1} o LEFT JOIN (SELECT k, sum(words) AS total FROM h WHERE class = {c} GROUP BY k) m USING (k)),
t{c} AS (SELECT w.k, w.share, w.owed, max(r.place) AS last, coalesce(max(r.ends), 0) AS got FROM w{c} w LEFT JOIN r ON r.k = w.k AND r.class = {c} AND r.ends - r.words / 2 <= w.owed GROUP BY w.k, w.share, w.owed),
o{c} AS (SELECT k, share, owed - got AS carry FROM t{c})"""
    cuts = " UNION ALL ".join(f"SELECT k, {c} AS class, coalesce(last, -1) AS last FROM t{c}" for c in range(len(CLASS_BOUNDS) + 1))
    return (
        sql
        + f""",
cuts AS ({cuts})
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN place <= last THEN 1 ELSE 0 END))::bigint AS taken
FROM b JOIN s USING (k) JOIN cuts USING (k, class)"""
    )


ORACLE = {"op6_mixing": _oracle()}
