"""Near-duplicates by bottom-k sketches of one hash function, with exact Jaccard at the end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import Scratch, bit_filter, slices, table, texts, with_mark
from gridlark.llm.components import connected_components

#: Hash values a sketch retains.
K = 64
#: A pair is verified if the estimate is at most this below the threshold.
MARGIN = 0.25
#: The smallest threshold for which that margin and K are meant.
LEAST_PERCENT = 60
#: Most members and bytes of hashes in a block of a group.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Distinct words whose hashes a task remembers.
WORDS_KEPT = 1 << 18


class Shingler:
    """64-bit hashes of word n-grams; one per task, as it remembers words."""

    def __init__(self, words: int) -> None:
        import xxhash

        self.words, self.known, self.hash = words, {}, xxhash.xxh3_64_intdigest
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 63, size=words, dtype=np.uint64) | np.uint64(1)

    def values(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes (int64) of a whole text; empty without words."""
        # bytes: lower() changes A-Z only, split() cuts at space and TAB..CR
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        v = self.values(words)
        n = max(1, len(v) - self.words + 1)
        width = min(self.words, len(v))
        h = np.full(n, width, np.uint64)
        for i in range(width):  # order counts: multiply, then mix
            h = (h ^ v[i : i + n]) * self.factors[i]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        return np.unique(h.view(np.int64))


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), and its K smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in slices(batches):
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            digests = [set_digest(s) if len(s) else None for s in sets]
            lows = pa.array([s[:K] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), lows], names=["doc_id", "n_shingles", "digest", "sketch"])

    return texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def list_members(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(hub, member, n_shingles): who meets in the inverted lists of retained values.

    Every retained value has a list of the classes that retain it. Two classes
    over the threshold have at least ``least`` of the larger sketch in common
    (margin included), so that, each sketch in order of the lists' lengths, the
    first of their common values is among the ``kept - least * kept + 1``
    rarest of both: only these lists need to be walked. A passage that many
    texts share has long lists, which the rarer values go before; a class
    walks them only if they make up more than the rest of its sketch. No list
    is dropped or cut: hot ones are dealt in blocks by ``group_edges``.

    Lists with one smallest class, the hub, are walked as one group, as the
    lists of near copies hold the same classes.
    """
    kept, least = F.size("sketch"), percent / 100 - MARGIN
    postings = classes.select("cls", "n_shingles", kept.alias("kept"), F.explode("sketch").alias("value"))
    lists = postings.groupBy("value").agg(F.count(F.lit(1)).alias("length"), F.min("cls").alias("hub")).where("length > 1")
    lists = scratch.table(lists, "lists")  # a join of plain reads, which adaptive execution splits at a hot value
    # most values are in no list: a filter spares them the join
    postings = with_mark(postings, "value", bit_filter(lists, "value", scratch)).where("_mark").drop("_mark")
    shared = postings.join(lists, "value").groupBy("cls", "n_shingles", "kept").agg(F.sort_array(F.collect_list(F.struct("length", "value", "hub"))).alias("found"))  # at most K
    walked = F.col("kept") - F.ceil(F.col("kept") * least - 1e-9) + 1
    unshared = F.col("kept") - F.size("found")  # lists of one, before all others
    rarest = F.slice("found", 1, F.greatest(walked - unshared, F.lit(0)).cast("int"))
    return shared.select(F.col("cls").alias("member"), "n_shingles", F.explode(F.array_distinct(F.transform(rarest, lambda x: x["hub"]))).alias("hub"))


def full_sets(docs: DataFrame, doc_id: str, text: str, words: int, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(member, hashes) of the wanted (member, rep, digest); each text is read again, only theirs are hashed.

    A filter of fixed size tells most unwanted texts before anything is
    shuffled; a join keeps just the wanted ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in slices(batches):
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "digest", "hashes"])

    read = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    read = with_mark(read, "rep", bit_filter(wanted, "rep", scratch)).where("_mark").drop("_mark")
    sets = texts(read).mapInArrow(run, "rep long, digest binary, hashes binary")
    # repeated rows give a set once; the grouping keeps the join's partitioning
    return wanted.join(sets, ["rep", "digest"]).groupBy("rep", "digest").agg(F.first("member").alias("member"), F.first("hashes").alias("hashes")).select("member", "hashes")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets of a block share, summed over the inverted lists of the values.

    The list of a value adds 1 to all pairs it holds; slices of 4,096 lists are added by a product.
    """
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values = np.concatenate(sets) if n else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count[column] > 1  # a list of one holds no pair
    column, rows = column[common], rows[common]
    _, column = np.unique(column, return_inverse=True)
    width = 4096
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        x = np.zeros((n, width), np.float32)
        x[rows[part], column[part] - k * width] = 1
        out += x @ x.T
    return out


def likely(lows: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray | None, least: float) -> np.ndarray:
    """Which two sets of a block are worth a comparison: the estimate over the union of their sketches reaches ``least``.

    ``lows`` are the retained values. The sketch of a union is whole up to the
    smaller of the two ends; a sketch that holds its whole set has no end.
    Sets with one label are linked already.
    """
    ends = np.array([s[-1] if n > len(s) else np.iinfo(np.int64).max for s, n in zip(lows, sizes, strict=True)], np.int64)
    kept = np.array([np.searchsorted(s, ends, side="right") for s in lows], np.float32)
    common = overlaps(lows)
    out = common >= least * (kept + kept.T - common) - 1e-6
    np.fill_diagonal(out, False)
    return out if labels is None else out & (labels[:, None] != labels[None, :])


def links(sets: list[np.ndarray], labels: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links of a block that connect what its other links and the labels leave apart.

    The estimate from the sketches picks the sets to compare; links are exact.
    """
    sizes = np.array([len(s) for s in sets])
    wanted = likely([s[:K] for s in sets], sizes, labels, num / den - MARGIN)
    at = np.flatnonzero(wanted.any(axis=1))
    if len(at) == 0:
        return []
    both = overlaps([sets[i] for i in at]).astype(np.float64)
    union = sizes[at][:, None] + sizes[at][None, :] - both
    linked = (den * both >= num * union) & wanted[np.ix_(at, at)]
    out, left = [], np.ones(len(at), bool)
    for start in range(len(at)):
        if not left[start]:
            continue
        left[start], ahead = False, [start]
        while ahead:
            i = ahead.pop()
            for j in np.flatnonzero(linked[i] & left):
                left[j] = False
                ahead.append(j)
                out.append((int(at[i]), int(at[j])))
    return out


def _block_edges(num: int, den: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("member")
        ids = group["member"].to_numpy()
        sets = [np.frombuffer(x, np.int64) for x in group["hashes"]]
        labels = group["label"].to_numpy() if "label" in group else None
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links(sets, labels, num, den)], columns=["a", "b"], dtype="int64")

    return run


def _block_open(num: int, den: int):
    """Members of a pair of blocks that have a likely partner of another label."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lows = [np.asarray(s, np.int64) for s in group["sketch"]]
        found = likely(lows, group["n_shingles"].to_numpy(), group["label"].to_numpy(), num / den - MARGIN).any(axis=1)
        return group.loc[found, ["hub", "member"]]

    return run


def _blocks() -> Column:
    """Into how many blocks so many members with so many hashes go."""
    return F.greatest(F.ceil(F.col("_n") / BLOCK_ROWS), F.ceil(F.col("_w") * 8 / BLOCK_BYTES)).cast("int")


def pairs_of_blocks(many: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, lo, hi, member, label): members in the pairs of blocks that compare the rest with all others.

    ``many`` has hub, member, n_shingles, label and core. Blocks 0 .. rest-1 hold the rest, the others the core.
    """
    counts = many.groupBy("hub", "core").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_w")).withColumn("n", _blocks())
    counts = counts.groupBy("hub").agg(F.coalesce(F.max(F.when(~F.col("core"), F.col("n"))), F.lit(0)).alias("rest"), F.coalesce(F.max(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("cores"))
    many = many.join(scratch.table(counts, "counts"), "hub").where("rest > 0")
    block = F.when(F.col("core"), F.col("rest") + F.pmod(F.xxhash64("member"), F.col("cores"))).otherwise(F.pmod(F.xxhash64("member"), F.col("rest"))).cast("int")
    others = F.when(F.col("core"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("cores") - 1))
    many = many.withColumn("block", block).withColumn("other", F.explode(others))
    return many.select("hub", "member", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _marked(rows: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose member a filter marks as wanted; those that a join with ``wanted`` keeps are all among them."""
    return with_mark(rows, "member", bit_filter(wanted, "member", scratch)).where("_mark").drop("_mark")


def group_edges(members: DataFrame, sketched: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges with the same components as all links between members of a group.

    Groups are cut into blocks of bounded size. First each block is compared
    within itself, together with the group's first member. Then, in groups of
    several blocks, the members outside the group's largest component so far
    are compared with all others, block against block; nothing else can still
    connect. That goes over the sketches first, and over full sets only for
    members that the sketches leave with a likely partner. Each task gives at
    most a spanning forest, so no task lists the pairs of a group.
    """
    groups = members.groupBy("hub").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_shingles").alias("_w"), F.min("member").alias("first"))
    groups = scratch.table(groups.where("_n > 1").select("hub", "first", _blocks().alias("n_blocks")), "groups")  # so that the join with members is split at a hot hub
    placed = members.join(groups, "hub").withColumn("block", F.pmod(F.xxhash64("member"), F.col("n_blocks")).cast("int"))
    placed = scratch.table(placed, "placed")
    firsts = placed.where("member = first").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = placed.where("member <> first").unionByName(firsts).select("hub", "member", "block")
    edge = "a long, b long"
    first = scratch.table(rows.join(sets, "member").groupBy("hub", "block").applyInPandas(_block_edges(num, den), edge).distinct(), "edges")
    many = placed.where("n_blocks > 1").select("hub", "member", "n_shingles")
    if not many.limit(1).count():
        return first
    labels = connected_components(first, scratch=scratch)
    many = many.join(labels.withColumnRenamed("v", "member"), "member", "left").select("hub", "member", "n_shingles", F.coalesce("c", "member").alias("label"))
    many = scratch.table(many, "many")
    tops = many.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    many = scratch.table(many.join(scratch.table(tops, "tops"), "hub").withColumn("core", F.col("label") == F.col("top")), "cores")
    # what remains is few rows beside all sketches and sets: filters spare the others an exchange
    many = scratch.table(many.join(many.where("not core").select("hub").distinct(), "hub", "left_semi"), "loose")
    if not many.limit(1).count():
        return first
    pairs = pairs_of_blocks(many, scratch).join(_marked(sketched, many, scratch), "member")
    ahead = pairs.groupBy("hub", "lo", "hi").applyInPandas(_block_open(num, den), "hub long, member long").distinct()
    ahead = scratch.table(ahead, "open")
    if not ahead.limit(1).count():
        return first
    many = scratch.table(many.join(ahead, ["hub", "member"], "left_semi"), "still")
    second = pairs_of_blocks(many, scratch).join(_marked(sets, many, scratch), "member").groupBy("hub", "lo", "hi").applyInPandas(_block_edges(num, den), edge)
    return scratch.table(first.unionByName(second).distinct(), "edges")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The component of each document under links of at least ``percent`` Jaccard.

    Sets are the distinct ``words``-word shingles of the whole text with A-Z
    lower-cased. Equal sets are one class, found by digest. Classes retain
    the K smallest values of one hash function; inverted lists of the retained
    values, walked from the rarest, say who meets and how many values two
    share. The overlap over the sketch of their union, up to the hash where the
    first of the two ends, must come within ``MARGIN`` of the threshold; full
    sets verify. Only that margin can miss a link: a pair just at the threshold
    with a chance of about 4e-6 at 80 %, 6e-7 at 85 % (binomial, 64 values),
    for cut-off or extended copies as for others.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and
    kept (doc_id = component_id), a row per input row. A text without words,
    or null, has no shingles and no links. Rows with one doc_id are one
    document, whatever their texts; a null doc_id has no links, a null
    component_id, and is kept. Ties cannot occur as the smallest id names a
    component. Other columns are not read. An empty table gives no rows; very
    long texts are read whole, one at a time.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the margin is chosen for thresholds from {LEAST_PERCENT} to 100 %")
    with Scratch(docs.sparkSession) as scratch:
        features = scratch.table(sketches(docs, doc_id, text, words), "sketches")
        named = features.where("digest is not null and doc_id is not null")
        classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
        # a class has a number of its own: one doc_id may be the smallest of several
        classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
        members = scratch.table(list_members(classes, percent, scratch), "members")
        wanted = classes.select(F.col("cls").alias("member"), "rep", "digest").join(members.select("member").distinct(), "member", "left_semi")
        sets = scratch.table(full_sets(docs, doc_id, text, words, wanted, scratch), "sets")
        sketched = classes.select(F.col("cls").alias("member"), "n_shingles", "sketch")
        edges = group_edges(members, sketched, sets, percent, 100, scratch)
        # the classes of a document whose rows have several sets are joined
        several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id", F.col("lo").alias("_lo"))
        also = named.join(several, "doc_id").where("digest <> _lo").select("digest", "_lo").distinct()
        also = also.join(classes.select("digest", F.col("cls").alias("a")), "digest").join(classes.select(F.col("digest").alias("_lo"), F.col("cls").alias("b")), "_lo")
        labels = connected_components(edges.unionByName(also.select("a", "b")), scratch=scratch)
        found = classes.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("digest", "rep", F.coalesce("c", "cls").alias("c"))
        found = scratch.table(found, "found")
        least = scratch.table(found.groupBy("c").agg(F.min("rep").alias("_component")), "components")
        found = scratch.table(found.join(least, "c").select("digest", "_component"), "component-of")
        out = features.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        return table(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 85 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)


#: All pairs of documents that share a shingle, then closure: for tables of test size.
ORACLE = {
    "op10_near_dup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r(v, c) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(c) AS c FROM r GROUP BY v) USING (doc_id)"""
}
