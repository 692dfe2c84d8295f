"""Benchmark decontamination: block-max WAND over a BM25 index of test items, then an overlap check."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.common import carried, slices, table, texts

#: A token is a longest run of letters, digits and underscores, in lower case.
TOKEN = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Neighbouring items, in order of length, that share a block: a term has a maximum in each.
BLOCK = 4
#: Most postings of the indexes in one pass; a larger benchmark is searched pass by pass.
SHARD_POSTINGS = 2_000_000
#: Items up to so many tokens share an index, those up to 4 times as many the next, and so on:
#: passages are as long as the items of an index ask for.
SHORT_ITEM = 64
#: Most words of the n-grams by which overlap is verified; shorter parts have shorter ones.
GRAM = 5

HITS = "array<struct<item_id: bigint, start: int, score: double, question_overlap: double, answer_overlap: double>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence, the question what comes before; one sentence is halved."""
    ends = [m.end() for m in re.finditer(r"[.!?:\n]+\s+(?=\S)", text.strip())]
    if ends:
        question, answer = tokens(text.strip()[: ends[-1]]), tokens(text.strip()[ends[-1] :])
        if question and answer:
            return question, answer
    both = tokens(text)
    half = (len(both) + 1) // 2
    return both[:half], both[half:]


def part_overlap(part: np.ndarray, passage: list[int]) -> float:
    """The share of a question or answer that a passage holds; 1 if it is empty.

    Parts are compared by n-grams so short that one changed word leaves 0.8 of
    them; parts of up to ten words, for which these would be single words, by
    the longest run of words in order, with others between allowed.
    """
    n, size = min(GRAM, (len(part) + 1) // 6), len(part)
    if not size:
        return 1.0
    if n > 1:
        own = {tuple(part[i : i + n]) for i in range(size - n + 1)}
        return len(own & set(zip(*(passage[i:] for i in range(n)), strict=False))) / len(own)
    longest = [0] * (size + 1)  # of the part's first words, with the passage so far
    for word in passage:
        before = 0
        for i, own_word in enumerate(part, 1):
            before, longest[i] = longest[i], before + 1 if word == own_word else max(longest[i], longest[i - 1])
    return longest[size] / size


@dataclass
class Index:
    """An inverted index of some items; its size is bounded by ``SHARD_POSTINGS``."""

    terms: dict[str, int]  # from 1; 0 stands for all other words
    items: list[np.ndarray]  # ordinals of the items of a term, ascending
    impacts: list[np.ndarray]
    blocks: list[np.ndarray]  # the blocks of those items
    tops: list[np.ndarray]  # the largest impact of each of those blocks
    bounds: np.ndarray  # the largest impact of each term
    item_ids: list[int]
    parts: list[tuple[np.ndarray, np.ndarray]]  # terms of question and answer, in order
    widest: int  # tokens of the longest item

    def wand(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over the query's terms sum to the threshold.

        Cursors run through the lists in item order. A pivot is the first item
        that the terms' bounds let reach the threshold; the maxima of its
        block then decide whether it is scored or the block is passed over.
        """
        lists = [[t, 0] for t in query]
        out: list[tuple[int, float]] = []
        end = len(self.item_ids)

        def item(cursor) -> int:
            t, at = cursor
            return int(self.items[t][at]) if at < len(self.items[t]) else end

        def skip(cursor, to: int) -> None:
            cursor[1] += int(np.searchsorted(self.items[cursor[0]][cursor[1] :], to))

        def top(t: int, block: int) -> float:
            k = int(np.searchsorted(self.blocks[t], block))
            return float(self.tops[t][k]) if k < len(self.blocks[t]) and self.blocks[t][k] == block else 0.0

        while True:
            lists = sorted((c for c in lists if item(c) < end), key=item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += self.bounds[c[0]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            at = item(lists[pivot])
            near = [c for c in lists if item(c) <= at]
            if sum(top(c[0], at // BLOCK) for c in near) < threshold:
                # nothing before the block's end, or before the next list begins, can reach it
                after = item(lists[len(near)]) if len(near) < len(lists) else end
                for c in near:
                    skip(c, max(at + 1, min((at // BLOCK + 1) * BLOCK, after)))
            elif item(lists[0]) == at:
                score = float(sum(self.impacts[c[0]][c[1]] for c in near))
                if score >= threshold:
                    out.append((at, score))
                for c in near:
                    c[1] += 1
            else:
                for c in near:
                    skip(c, at)


class Sieve:
    """Which passages of a text can reach a threshold, by block maxima, for all passages at once.

    The commonest terms are set apart, as many as together weigh at most half
    the threshold in any item. A passage needs the rest from the maxima that
    the other terms have in one block; sums over those few postings find the
    passages (as in MaxScore), and only these are queried.
    """

    def __init__(self, index: Index, threshold: float) -> None:
        self.index, self.threshold = index, threshold
        self.n_blocks = -(-len(index.item_ids) // BLOCK)
        common = np.zeros(len(index.item_ids))
        essential = np.ones(len(index.items), bool)
        essential[0] = False
        for t in sorted(range(1, len(index.items)), key=lambda t: (-len(index.items[t]), t)):
            more = common.copy()
            more[index.items[t]] += index.impacts[t]
            if more.max() > threshold / 2:
                break
            common, essential[t] = more, False
        self.essential = essential
        self.need = threshold - np.maximum.reduceat(common, np.arange(0, len(common), BLOCK))
        self.count = np.array([len(b) for b in index.blocks])
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.block, self.top = np.concatenate(index.blocks), np.concatenate(index.tops)

    def passages(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Numbers of passages, of n, that pass; passage k begins at k times the longest item's length."""
        at = np.flatnonzero(self.essential[ids])
        half = at // self.index.widest
        window = np.concatenate([half, half - 1])  # a token is in two passages
        term = np.concatenate([ids[at], ids[at]])
        here = (window >= 0) & (window < n)
        pairs = np.unique(window[here] * len(self.count) + term[here])
        window, term = pairs // len(self.count), pairs % len(self.count)
        count = self.count[term]
        place = np.arange(count.sum()) + np.repeat(self.first[term] - np.cumsum(count) + count, count)
        key, back = np.unique(np.repeat(window, count) * self.n_blocks + self.block[place], return_inverse=True)
        sums = np.bincount(back, weights=self.top[place], minlength=len(key))
        return np.unique(key[sums >= self.need[key % self.n_blocks] - 1e-9] // self.n_blocks)


def build_indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes that together hold all items, each of bounded size, made one at a time: items of like length, dealt by hash.

    Term statistics are counted by Spark over all items. An impact is the BM25
    weight of a term in an item, divided by the sum over the item's terms, so
    that a passage with all of an item's terms scores 1 whatever its length.
    Items with a null id, or without words, are left out; of several rows with one id each is an item.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [tokens(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], names=["item_id", "text", "words"])

    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    items = items.mapInArrow(split, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    items = table(items.withColumn("row", F.monotonically_increasing_id()), "bench-items")
    stats = items.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("length"), F.sum(F.size("words")).alias("postings")).first()
    if not stats["n"]:
        return
    postings = items.select("row", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("row", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / stats["length"]))
    weighted = postings.join(df, "term").withColumn("weight", weight)
    own = Window.partitionBy("row")  # the terms of one item
    weighted = table(weighted.withColumn("impact", F.col("weight") / F.sum("weight").over(own)).select("row", "term", "impact"), "bench-postings")
    kind = F.greatest(F.ceil(F.log(4.0, F.size("words") / SHORT_ITEM) - 1e-9), F.lit(0))
    kinds = table(items.select("row", kind.alias("kind"), F.size("words").alias("n")), "bench-kinds")
    for r in sorted(kinds.groupBy("kind").agg(F.sum("n").alias("n")).collect()):  # a row per power of 4
        mine = kinds.where(F.col("kind") == r["kind"]).select("row")
        shards = -(-r["n"] // SHARD_POSTINGS)
        for k in range(shards):
            part = mine.where(F.pmod(F.xxhash64("row"), F.lit(shards)) == k)
            yield _index(items.join(part, "row", "left_semi"), weighted.join(part, "row", "left_semi"))


def _index(items: DataFrame, weighted: DataFrame) -> Index:
    """The index of a shard of items: what it gathers is of bounded size."""
    rows = items.orderBy(F.size("words"), "item_id", "text").select("row", "item_id", "text", F.size("words").alias("n")).collect()
    ordinal = {r["row"]: k for k, r in enumerate(rows)}
    found = weighted.toPandas()
    found["item"] = found["row"].map(ordinal)
    none, zero = np.zeros(0, np.int64), np.zeros(0)
    terms, lists, impacts, blocks, tops = {}, [none], [zero], [none], [zero]
    for term, part in found.sort_values(["term", "item"]).groupby("term", sort=True):
        terms[term] = len(lists)
        lists.append(part["item"].to_numpy(np.int64))
        impacts.append(part["impact"].to_numpy())
        own, first = np.unique(lists[-1] // BLOCK, return_index=True)
        blocks.append(own)
        tops.append(np.maximum.reduceat(impacts[-1], first))
    bounds = np.array([x.max() if len(x) else 0.0 for x in impacts])
    parts = [tuple(np.array([terms[w] for w in p], np.int32) for p in question_answer(r["text"])) for r in rows]
    return Index(terms, lists, impacts, blocks, tops, bounds, [r["item_id"] for r in rows], parts, max((r["n"] for r in rows), default=1))


def passes(indexes: Iterator[Index]) -> Iterator[list[Index]]:
    """Indexes that fit in one pass together."""
    group, size = [], 0
    for index in indexes:
        own = sum(map(len, index.items))
        if group and size + own > SHARD_POSTINGS:
            yield group
            group, size = [], 0
        group, size = [*group, index], size + own
    if group:
        yield group


def search(sieve: Sieve, words: list[str], overlap: float) -> list[tuple]:
    """Verified (item_id, start, score, question overlap, answer overlap) of a text's words, the best passage of each item.

    Passages are windows twice as long as the longest item, each beginning in
    the middle of the one before, so that any run as long as an item lies
    within one.
    """
    index, threshold = sieve.index, sieve.threshold
    if not words:
        return []
    half = index.widest
    ids = np.fromiter(map(index.terms.get, words, repeat(0)), np.int64, len(words))
    n = max(1, -(-(len(words) - half) // half))
    best: dict[int, tuple] = {}
    for start in (sieve.passages(ids, n) * half).tolist():
        end = min(start + 2 * half, len(words))
        query = [t for t in np.unique(ids[start:end]).tolist() if t]
        for ordinal, score in index.wand(query, threshold - 1e-9):
            passage = ids[start:end].tolist()
            q, a = (part_overlap(p, passage) for p in index.parts[ordinal])
            if q >= overlap and a >= overlap:
                hit = (index.item_ids[ordinal], start, score, q, a)
                if ordinal not in best or (score, q + a, -start) > (best[ordinal][2], best[ordinal][3] + best[ordinal][4], -best[ordinal][1]):
                    best[ordinal] = hit
    return sorted(best.values())


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = 0.7, overlap: float = 0.8) -> DataFrame:
    """The carried columns (default doc_id) and ``hits``, the benchmark items each whole text contains.

    An item is hit if a passage scores at least ``threshold`` of its BM25
    weight and has at least ``overlap`` of its question and of its answer
    (``part_overlap``; one changed word in parts of five words or more does
    not hide an item). A benchmark too large for one pass is searched in several, one
    after another over the same rows, without a join: one pass's indexes are on
    the driver and in the workers at a time. A null or empty
    text has no hits, nor has any text if the benchmark is empty; repeated
    rows give repeated results; ``hits`` is in order of item ids. Texts are
    read whole, however long, one at a time.
    """
    carry = carried(docs, ["doc_id"] if carry is None else carry, ["hits"])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = [f.split(":")[0].strip() for f in HITS[len("array<struct<") : -2].split(", ")]
    kind = pa.list_(pa.struct(list(zip(names, [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()], strict=True))))
    out = docs.select(*carry, docs[text].alias("_text"), F.array().cast(HITS).alias("hits"))
    at = len(carry)

    def passed(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sieves = [Sieve(Index(*values), threshold) for values in sent.value]

            def found(text: str | None, old: list | None) -> list:
                words = tokens(text)
                return [*(old or []), *(dict(zip(names, h, strict=True)) for sieve in sieves for h in search(sieve, words, overlap))]

            for batch in slices(batches):
                hits = list(map(found, batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pa.array(hits, kind)], names=[*carry, "_text", "hits"])

        return run

    sent = None
    for group in passes(build_indexes(benchmark)):
        if sent is not None:  # one more: the rows so far are written, and the indexes before are let go
            out = table(out, "leaks-pass")
            sent.destroy()
        # of bounded size; plain values, as executors may lack this package
        sent = docs.sparkSession.sparkContext.broadcast([tuple(vars(index).values()) for index in group])
        out = texts(out).mapInArrow(passed(sent), f"{kinds}, _text string, hits {HITS}")
    return out.select(*carry, F.array_sort("hits").alias("hits"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain items of ``benchmark``, a row per document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
