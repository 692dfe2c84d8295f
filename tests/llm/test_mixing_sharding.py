import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridlark.llm import mixing, sharding
from gridlark.llm.common import positions, running_totals, word_count


def test_word_count_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", " a b ", "\u00a0 x\x1f\n", "é\t\tü", "😀 x"] + ["".join(rng.choice("ab \n\t\x0b\u00a0") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", word_count(F.col("text")).alias("n")).collect():
        assert r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["i"]] or "")), repr(texts[r["i"]])


def fill(sizes, weights, total, epochs):
    target, free = {}, dict(zip(sizes, weights, strict=False))
    while free:
        level = (total - sum(target.values())) / sum(free.values())
        over = [s for s in free if level * free[s] >= epochs * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in free.items()}
        for s in over:
            target[s] = epochs * sizes[s]
            del free[s]
    return target


@pytest.mark.parametrize("share", [0.3, 1.5, 3.0])
def test_mix_nears_targets(spark, share):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "c", "d", None, "é"]), min(9000, int(rng.paretovariate(0.8) * 20))) for i in range(3000)]
    rows += [(i, "a", 30) for i in range(5000, 7000)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, source string, n long, size string, target double")
    out = mixing.mix_sources(df, [5.0, 2.0, 1.0], share, 2.0, size=F.col("n")).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weights = [[5.0, 2.0, 1.0][k % 3] for k in range(len(order))]
    target = fill({s: sizes[s] for s in order}, weights, share * sum(sizes.values()), 2.0)
    taken = defaultdict(int)
    for r in out:
        s = r["doc"]["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) < 0.01 * sizes[s] + 64
    again = mixing.mix_sources(df.repartition(7), [5.0, 2.0, 1.0], share, 2.0, size=F.col("n")).collect()
    assert sorted((r["doc"]["doc_id"], r["copies"]) for r in again) == sorted((r["doc"]["doc_id"], r["copies"]) for r in out)


def test_mix_at_the_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df, [1.0], 1.5).count() == 0
    df = spark.createDataFrame([(1, None, None), (None, "", "s"), (2, "a b", "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    out = mixing.mix_sources(df, [5.0, 2.0, 1.0], 1.5).collect()
    assert len(out) == 4 and {r["size"] for r in out} == {0, 2}


def smallest(groups, shards):
    def fits(c):
        used, at = 1, 0
        for g in groups:
            if g > c:
                return False
            if at + g > c:
                used, at = used + 1, 0
            at += g
        return used <= shards

    c = 0
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("seed,shards,cells", [(1, 5, 1 << 16), (2, 12, 16), (3, 40, 8), (4, 7, 4)])
def test_shards_are_minimax_and_whole(spark, monkeypatch, seed, shards, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    rng = random.Random(seed)
    rows = [(i, f"g{rng.randrange(30):02d}", rng.choice([1, 2, 3, 50, 0])) for i in range(120)] + [(None, "g99", 4), (7, "g99", 4), (7, "g99", 4)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, g string, n long, shard string, slot string")
    out = sharding.shard_groups(df, shards, F.col("n"), F.col("g"), ["doc_id", "g"]).collect()
    assert len(out) == len(rows)
    sizes, place, slots, full = defaultdict(int), defaultdict(set), defaultdict(list), defaultdict(int)
    for r in out:
        sizes[r["g"]] += max(1, r["size"])
        place[r["g"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        full[r["shard"]] += max(1, r["size"])
    assert all(len(x) == 1 for x in place.values())
    order = sorted(sizes)
    at = [min(place[g]) for g in order]
    assert at == sorted(at) and 0 <= min(slots) and max(slots) < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(full.values()) == smallest([sizes[g] for g in order], shards)


def test_op8_over_texts(spark, tmp_path):
    rows = [(1, "é"), (2, "é"), (3, None), (4, ""), (5, "x" * 100_000), (6, "b"), (6, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op8_sharding(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in out}
    for i, t in rows:
        raw = (t or "").encode()
        assert (by[i]["size"], by[i]["text_crc32"], by[i]["law"]) == (len(raw) + 16, zlib.crc32(raw), "bytes")
    assert by[1]["shard"] == by[2]["shard"] and by[3]["shard"] != by[5]["shard"]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op8_sharding(spark, f"{tmp_path}/none").count() == 0


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    total, want = 0, []
    for n, (k, i, v) in enumerate(sorted(rows)):
        total += v
        want.append((k, i, v, total, n))
    assert sorted(map(tuple, running_totals(df, ["k", "i"], {"s": "v"}).collect())) == want


def test_positions_are_gapless_in_each_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(20)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = defaultdict(list)
    for r in positions(df, "k", ["i"], "at").collect():
        got[r["k"]].append((r["at"], r["i"]))
    for k, found in got.items():
        assert sorted(found) == list(enumerate(sorted(i for kk, i in rows if kk == k)))


def test_columns_called_like_results(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "doc_id long, g string, slot int")
    assert sorted(map(tuple, sharding.shard_groups(df, 2, F.lit(1), F.col("g"), ["doc_id"]).collect())) == [(1, 1, 0, 0), (2, 1, 1, 0)]
    with pytest.raises(ValueError, match="clash"):
        sharding.shard_groups(df, 2, F.lit(1), F.col("g"), ["slot"])
