import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from gridlark.llm import language_id
from tests.llm.test_language_id import naive_model
from tests.llm.test_mixing_sharding import fill, smallest
from tests.llm.test_near_dup import brute

SF = "/root/testdata/sf0.001"


def most_of(item, text):
    """Whether most words of an item follow each other in a text."""
    words, item = set(zip(*(text.lower().split()[i:] for i in range(2)), strict=False)), item.lower().split()
    pairs = set(zip(item, item[1:], strict=False))
    return 2 * len(pairs & words) > len(pairs)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    away = {r["doc_id"] for r in docs.where(language_id.held_out(docs["doc_id"])).select("doc_id").collect()}
    judge = naive_model(spark, [(i, r["text"], r["lang"]) for i, r in rows.items() if i not in away])
    first = cp.language(spark, docs, SF)
    assert first.columns == docs.columns
    kept = {i for i, r in rows.items() for lang, score in [judge(r["text"])] if lang != language_id.UNKNOWN and score >= cp.MIN_SCORE}
    assert {r["doc_id"] for r in first.collect()} == kept

    second = cp.near_dedup(spark, first, SF)
    kept = {i for i, (_, _, stays) in brute([(i, rows[i]["text"]) for i in kept], 5, 80).items() if stays}
    assert {r["doc_id"] for r in second.collect()} == kept

    third = cp.decontaminate(spark, second, SF)
    items = [t["text"] for t in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i in kept if any(x in rows[i]["text"] for x in items)}
    left = {r["doc_id"] for r in third.collect()}
    # one more document goes, which holds an item but for a word or two
    near = {i for i in kept - leaks if any(most_of(x, rows[i]["text"]) for x in items)}
    assert kept - leaks - near <= left <= kept - leaks

    fourth = cp.mix(spark, third, SF)
    copies = Counter(r["doc_id"] for r in fourth.collect())
    assert set(copies) <= left and max(copies.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i]["text"] or "")) for i in left}
    own, taken = defaultdict(int), defaultdict(int)
    for i in left:
        own[rows[i]["source"]] += size[i]
        taken[rows[i]["source"]] += copies[i] * size[i]
    order = sorted(own, key=lambda s: (s is None, s))
    target = fill({s: own[s] for s in order}, [cp.WEIGHTS[k % 3] for k in range(len(order))], cp.SHARE * sum(own.values()), cp.MAX_EPOCHS)
    assert all(abs(taken[s] - target[s]) <= 0.02 * own[s] + max(size.values()) for s in order)

    last = cp.shard(spark, fourth, SF).collect()
    assert Counter(r["doc_id"] for r in last) == copies
    groups, place, full = defaultdict(int), defaultdict(set), defaultdict(int)
    for r in last:
        text = (rows[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(text) + 16
        groups[hashlib.sha256(text).digest()] += r["size"]
        place[hashlib.sha256(text).digest()].add(r["shard"])
        full[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in place.values())
    assert max(full.values()) == smallest([groups[g] for g in sorted(groups)], cp.SHARDS)
    slots = {}
    for r in last:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_run_and_an_empty_table(spark, tmp_path):
    assert cp.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_other_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", None, None, None), (None, "the and of the " * 20, "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars int")
    odd = odd.select(*[odd[c].cast(docs.schema[c].dataType) for c in docs.columns])
    table = some.unionByName(docs.orderBy("doc_id").limit(20)).unionByName(odd)
    for c in ("kept", "hits", "copies", "slot", "size"):
        table = table.withColumn(c, table["doc_id"])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = cp.language(spark, read, str(tmp_path))
    assert first.columns == cp.COLUMNS
    second = cp.near_dedup(spark, first, str(tmp_path))
    ids = [r["doc_id"] for r in second.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 900 not in ids and 901 not in ids
    got = cp.run(spark, str(tmp_path))
    assert got.count() > 0 and {r["doc_id"] for r in got.collect()} <= {*ids, None}
