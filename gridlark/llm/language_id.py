"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import carried, slices, texts

#: n-grams of one to three characters share 2 ** BITS places.
BITS, ORDERS = 15, (1, 2, 3)
#: A longer text is hashed in pieces of so many characters; n-grams across their edges are counted too.
PIECE = 1 << 18
#: How the sample's places and counts are packed.
PACKED = (np.uint16, np.int32)
#: A training sample has about this many documents of each language.
SAMPLE = 1500
#: Documents of the sample a task trains on, at most about so many.
SHARD = 3000
#: The language of a text without letters.
UNKNOWN = "und"


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text, everything but letters read as one space; None without a letter."""
    total, any_letter, tail = np.zeros(1 << BITS, np.int64), False, " "
    for start in range(0, len(text), PIECE):
        part = re.sub(r"[\W\d_]+", " ", text[start : start + PIECE].lower())
        any_letter = any_letter or any(map(str.isalpha, part))
        if tail.endswith(" "):
            part = part.lstrip(" ")
        last = start + PIECE >= len(text)
        part = tail + part + (" " if last else "")
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            n = len(codes) - order + 1
            if n < 1:
                break
            h = (h[:n] + codes[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            if order in ORDERS:
                # after the first piece, grams that end in the tail were counted before
                skip = max(0, len(tail) - order + 1) if start else 0
                total += np.bincount((h[skip:] >> np.uint64(7)).astype(np.int64) & ((1 << BITS) - 1), minlength=1 << BITS)
        tail = part[-(max(ORDERS) - 1) :]
    return total if any_letter else None


def sparse(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The places a text has n-grams at, and their counts."""
    counts = gram_counts(text)
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    return at, counts[at]


def unpacked(places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(places, PACKED[0]).astype(np.int64), np.frombuffer(counts, PACKED[1])


@dataclass
class Model:
    """Bounded: 2 ** BITS weights for each of ``langs``."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places x langs
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The TF-IDF values, of unit length, at the places that have counts."""
        x = (1 + np.log(counts)) * self.idf[at]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: Callable[[], Iterable[tuple[int, np.ndarray, np.ndarray]]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, per coordinate, with elastic-net penalties; ``rows`` gives the rows anew for each epoch."""
    places = (1 << BITS) + 1  # the last one is the bias, which has no penalty
    z, n = np.zeros((places, classes)), np.zeros((places, classes))

    def weights(at):
        za, na = z[at], n[at]
        free = (at == places - 1)[:, None]
        small = np.where(free, 0.0, l1)
        w = -(za - np.sign(za) * small) / ((beta + np.sqrt(na)) / alpha + np.where(free, 0.0, l2))
        return np.where(np.abs(za) <= small, 0.0, w)

    for _ in range(epochs):
        for label, at, x in rows():
            at, x = np.append(at, places - 1), np.append(x, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(places))
    return w[:-1], w[-1]


def _unit(*parts: Column) -> Column:
    """A seeded number in [0, 1) that the same values always get."""
    return F.pmod(F.xxhash64(F.lit("language-id"), *parts), F.lit(1 << 30)) / float(1 << 30)


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """Learn from rows with text and lang.

    Document frequencies are counted over all rows, in the tasks that read
    them. The regression is fitted on a seeded sample of about ``sample`` rows a
    language (each row by its own chance, so no sort and no hot language), of
    which every fifth is kept for the temperature. Sampled texts become counts
    of n-grams, at most one a place, before they are dealt into
    shards of about ``SHARD`` rows: a very long text is not held by a shard. Each shard trains for itself, and the mean of
    their weights is the model. What reaches the driver is the counts,
    weights and losses, bounded by places and languages. Null texts, texts without a letter and null
    languages teach nothing; no rows give a model of no language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    empty = Model(langs, np.ones(1 << BITS), np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)))
    if not langs:
        return empty

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                if (c := sparse(t)) is not None:
                    df[c[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *df[at].tolist()], pa.int64())], names=["place", "n"])

    seen = texts(rows.select("text")).mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    n_docs = int(seen.loc[seen["place"] == -1, "n"].sum())
    seen = seen[seen["place"] >= 0]
    df[seen["place"].to_numpy()] = seen["n"].to_numpy()
    base = replace(empty, idf=np.log((1 + n_docs) / (1 + df)) + 1)

    chance = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / counts[k]))]), F.col("lang"))
    chosen = rows.where(_unit(F.col("id"), F.col("lang")) < chance)
    chosen = chosen.withColumn("held", _unit(F.lit("held"), F.col("id")) < 0.2).withColumn("order", F.xxhash64(F.lit("order"), "id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sparse(t) for t in batch.column(3).to_pylist()]
            at = np.flatnonzero([c is not None for c in found])
            part = batch.select(range(3)).take(pa.array(at)).columns
            packed = [pa.array([found[i][k].astype(t).tobytes() for i in at], pa.binary()) for k, t in enumerate(PACKED)]
            yield pa.RecordBatch.from_arrays([*part, *packed], names=["order", "id", "lang", "places", "counts"])

    held = chosen.where("held").select("lang", "text")
    kind = chosen.schema["id"].dataType.simpleString()
    chosen = chosen.where("not held").select("order", "id", "lang", "text").mapInArrow(counted, f"order long, id {kind}, lang string, places binary, counts binary")
    size = sum(min(sample, c) for c in counts.values())
    shards = max(1, round(size / SHARD))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(group.sort_values(["order", "id", "lang"])[["lang", "places", "counts"]].itertuples(index=False, name=None))

        def data() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for g, *packed in rows:  # unpacked a row at a time, in each epoch
                at, n = unpacked(*packed)
                yield langs.index(g), at, base.vector(at, n)

        w, b = ftrl(data, len(langs), epochs, alpha, beta, l1, l2)
        at, k = np.nonzero(w)
        return pd.DataFrame({"place": [*at.tolist(), *[-1] * len(langs)], "k": [*k.tolist(), *range(len(langs))], "w": [*w[at, k].tolist(), *b.tolist()]})

    parts = chosen.withColumn("shard", F.pmod(F.col("order"), F.lit(shards))).groupBy("shard").applyInPandas(fit, "place int, k int, w double")
    found = parts.groupBy("place", "k").agg(F.sum("w").alias("w")).toPandas()
    weights, bias = np.zeros((1 << BITS, len(langs))), np.zeros(len(langs))
    is_bias = (found["place"] == -1).to_numpy()
    inner, outer = found[~is_bias], found[is_bias]
    weights[inner["place"].to_numpy(), inner["k"].to_numpy()] = np.round(inner["w"].to_numpy() / shards, 9)
    bias[outer["k"].to_numpy()] = np.round(outer["w"].to_numpy() / shards, 9)
    model = replace(base, weights=weights, bias=bias)
    return replace(model, temperature=_temperature(held, model))


def _temperature(held: DataFrame, model: Model) -> float:
    """The temperature of a grid with the least loss on rows the fit did not see."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 61))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(grid))
        for batch in slices(batches):
            for g, t in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if (c := sparse(t)) is not None:
                    z = model.logits(*c)[None, :] / grid[:, None]
                    z = z - z.max(axis=1, keepdims=True)
                    sums += np.log(np.exp(z).sum(axis=1)) - z[:, model.langs.index(g)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(sums, pa.float64())], names=["k", "loss"])

    found = held.mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).toPandas()
    if not len(found) or not found["loss"].sum():
        return 1.0
    return float(grid[int(found.sort_values(["loss", "k"])["k"].iloc[0])])


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default doc_id), lang_pred and score of each whole text.

    score is the calibrated probability of lang_pred. A null text, or one
    without a letter, is ``und`` with score 0; so is every text if the model
    has no language. Of equal scores the first language in code-point order wins. Repeated rows
    give repeated results.
    """
    carry = carried(docs, ["doc_id"] if carry is None else carry, ["lang_pred", "score"])
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["lang_pred string, score double"])
    at = len(carry)
    # 2 ** BITS weights a language; plain values, as executors may lack this package
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in slices(batches):
            out, scores = [], []
            for t in batch.column(at).to_pylist():
                c = sparse(t) if t and m.langs else None
                p = None if c is None else softmax(m.logits(*c) / m.temperature)
                out.append(UNKNOWN if p is None else m.langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    return texts(docs.select(*carry, docs[text].alias("_text"))).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from; a null doc_id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three folds of four."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
