import random
import re

import pytest

from gridlark.llm import near_dup


def brute(rows, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, n_base, copies, vocabulary=500):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    out, i = [], 0
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 30, 200]))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
            out.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
            i += 1
    rng.shuffle(out)
    return out


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    rows = [*corpus(1, 30, 8), (9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "one TWO")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dup.near_duplicates(df, percent=percent)) == brute(rows, 5, percent)


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_dup.near_duplicates(df, percent=85)) == brute(rows, 5, 85)


def test_empty_table_null_ids_and_other_columns(spark):
    schema = "doc_id long, text string, kept string, n_shingles string, rep int, digest int"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"a{k}" for k in range(40))
    rows = [(1, text, "x", "y", 1, 2), (1, text, "x", "y", 1, 2), (None, text, None, None, None, None), (3, text, "", "", 0, 0)]
    got = sorted(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 36, 1, True), (1, 36, 1, True), (3, 36, 1, False), (None, 36, None, True)]


def test_repeated_ids_with_several_texts_are_one_document(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (6, a), (7, b)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {5}


def test_very_long_text(spark):
    text = " ".join(f"w{k % 7919}" for k in range(300_000))
    got = near_dup.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize("percent", [80, 85])
def test_truncated_and_appended_copies_at_the_threshold(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(1000):  # whole texts have 1,200 shingles, their parts just the percentage of these
        words = [f"w{rng.randrange(100_000)}" for _ in range(1204)]
        part = words[: 12 * percent + 4] if i % 2 else words[-12 * percent - 4 :]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(part))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = result(near_dup.near_duplicates(df, percent=percent))
    assert {i: got[i][0] for i in (0, 1)} == {0: 1200, 1: 12 * percent}
    assert [i for i, (_, component, _) in got.items() if component != i - i % 2] == []


def test_one_id_that_names_several_classes(spark):
    """Rows 1 have two unlike texts, and are the first of both: near copies of either are theirs."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:59], "new"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "c d e")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("percent", [80, 85])
def test_cut_extended_and_changed_copies_beside_a_common_passage(spark, monkeypatch, percent):
    """Recall is whole where every text shares a passage that makes up most of some texts, in blocks of a few rows."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)
    rng = random.Random(percent)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for _ in range(120):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([10, 25, 60, 300]))]
        base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        cut = base[: -(-len(base) * percent // 100) + rng.randrange(-3, 4)]
        extended = base + [f"x{rng.randrange(99)}" for _ in range(len(base) * (100 - percent) // percent + rng.randrange(-2, 3))]
        changed = list(base)
        for _ in range(rng.randrange(4)):
            changed[rng.randrange(len(base))] = f"y{rng.randrange(99)}"
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((base, cut, extended, changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(near_dup.near_duplicates(df, percent=percent)) == brute(rows, 5, percent)


def test_scratch_tables_are_removed(spark):
    import os

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = {f for f in os.listdir(folder) if f.startswith("scratch-")}
    near_dup.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).count()
    assert {f for f in os.listdir(folder) if f.startswith("scratch-")} <= before


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_comparing_the_rest_of_a_large_group_exchanges_no_other_documents(spark, monkeypatch):
    """Sketches and sets of small groups stay where they are, also where no table is small enough for a broadcast."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 7)
    rng = random.Random(7)
    texts = []
    base = [f"w{k}" for k in range(120)]
    for _ in range(24):  # one group of several blocks, not all linked
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(120)] = f"x{rng.randrange(50)}"
        texts.append(text)
    for k in range(1500):  # groups of two
        pair = [f"p{k}-{n}" for n in range(40)]
        texts += [pair, [*pair, "end"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    moved, write = {}, near_dup.Scratch.table

    def counted(self, df, name):
        before = shuffled(spark)
        out = write(self, df, name)
        moved.setdefault(name, []).append(shuffled(spark) - before)
        return out

    monkeypatch.setattr(near_dup.Scratch, "table", counted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = result(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {i: got[i] for i in range(24)} == brute(rows[:24], 5, 85)
    assert all(got[i][1] == i - i % 2 for i in range(24, len(rows)))
    assert len(moved["edges"]) == 2  # the second comparison took place
    assert max(moved["open"][0], moved["edges"][1]) < 3000  # fewer than the members of groups of two; 1,500 first edges are exchanged
