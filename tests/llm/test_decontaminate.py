import random

import numpy as np

from gridlark.llm import decontaminate as dc


def exhaustive(index, query, threshold):
    scores = np.zeros(len(index.item_ids))
    for t in query:
        scores[index.items[t]] += index.impacts[t]
    return {i: s for i, s in enumerate(scores) if s >= threshold}


def bench(rng, n, vocabulary):
    return [(i, ". ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 15))) for _ in range(rng.randrange(1, 4))) + ".") for i in range(n)]


def test_wand_equals_exhaustive_scoring(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 4)
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(300)]
    (index,) = dc.build_indexes(spark.createDataFrame(bench(rng, 150, vocabulary), "item_id long, text string"))
    for _ in range(300):
        query = sorted(rng.sample(range(1, len(index.items)), rng.randrange(1, 25)))
        for threshold in (0.1, 0.3, 0.6):
            want = exhaustive(index, query, threshold)
            got = dict(index.wand(query, threshold))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_sieve_passes_all_that_wand_finds(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 4)
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 200}" for _ in range(300)]
    (index,) = dc.build_indexes(spark.createDataFrame(bench(rng, 80, vocabulary), "item_id long, text string"))
    for threshold in (0.3, 0.6):
        sieve = dc.Sieve(index, threshold)
        for _ in range(100):
            ids = np.array([rng.randrange(len(index.items)) for _ in range(rng.randrange(1, 12 * index.widest))])
            n = max(1, -(-(len(ids) - index.widest) // index.widest))
            passed = set(sieve.passages(ids, n).tolist())
            for k in range(n):
                window = ids[k * index.widest : (k + 2) * index.widest]
                if exhaustive(index, [t for t in np.unique(window) if t], threshold):
                    assert k in passed


def test_planted_items_are_found_in_shards_too(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(900)]
    items = bench(rng, 60, vocabulary)
    planted, rows = set(), []
    for d in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(400))]
        if d % 3 == 0:
            i = rng.randrange(60)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [items[i][1].upper().replace(" ", " \n")]
            planted.add((d, i))
        rows.append((d, " ".join(body)))
    rows += [(500, None), (501, ""), (502, items[3][1].split(".")[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([*items, (None, "a b c"), (77, None), (78, " .")], "item_id long, text string")
    # an item of few words may be met by chance, but what is planted is always found
    long_enough = {i for i, t in items if len(dc.tokens(t)) >= 8}
    for postings in (2_000_000, 200):
        monkeypatch.setattr(dc, "SHARD_POSTINGS", postings)
        out = dc.find_leaks(docs, benchmark)
        assert out.count() == len(rows)
        got = {(r["doc_id"], h["item_id"]) for r in out.collect() for h in r["hits"]}
        assert planted <= got
        assert {x for x in got if x[1] in long_enough and x[0] < 500} == {x for x in planted if x[1] in long_enough}
        assert all([h["item_id"] for h in r["hits"]] == sorted(h["item_id"] for h in r["hits"]) for r in out.collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["hits"] for r in dc.find_leaks(docs, none).collect()] == [[], []]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.find_leaks(docs.where("doc_id is null"), some).count() == 0


def test_only_question_or_answer_is_no_leak(spark):
    item = "what is the colour of the wide northern river at dawn. it is a deep and quiet green as moss."
    question, answer = item.split(". ")
    docs = spark.createDataFrame([(1, "x y z " + item), (2, question + " and so on"), (3, "they say " + answer), (4, question + " . " + answer)], "doc_id long, text string")
    got = dc.find_leaks(docs, spark.createDataFrame([(5, item), (6, "other words here entirely. yes.")], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect() if r["hits"]} == {1, 4}


def test_items_with_a_changed_word_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(21)
    vocabulary = [f"v{k}" for k in range(600)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 45))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 12))) + ".") for i in range(80)]
    rows, planted = [], set()
    for d in range(240):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(50, 300))]
        if d % 2:
            i = d % 80
            words = items[i][1].split()
            words[rng.randrange(len(words))] = "changed" + rng.choice(["", "."])
            at = rng.randrange(len(body))
            body[at:at] = words
            planted.add((d, i))
        rows.append((d, " ".join(body)))
    out = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], h["item_id"]) for r in out.collect() for h in r["hits"]}
    assert not got - planted
    assert len(got) >= 0.95 * len(planted)  # a changed word may weigh more than the score allows to miss


def test_repeated_rows_long_texts_long_items_and_clashing_columns(spark):
    item = "one two three four five six seven eight nine ten. eleven twelve thirteen"
    long_item = " ".join(f"t{k}" for k in range(400)) + ". " + " ".join(f"a{k}" for k in range(9))
    text = " ".join(f"w{k % 997}" for k in range(200_000)) + " " + item + " " + long_item
    docs = spark.createDataFrame([(1, text, 5), (2, item, 6), (2, item, 6)], "doc_id long, text string, hits int")
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, long_item)], "item_id long, text string")
    assert sorted(len(list(dc.passes(dc.build_indexes(benchmark)))[0][k].item_ids) for k in (0, 1)) == [1, 2]
    got = sorted((r["doc_id"], [h["item_id"] for h in r["hits"]]) for r in dc.find_leaks(docs, benchmark).collect())
    assert got == [(1, [1, 1, 2]), (2, [1, 1]), (2, [1, 1])]
    try:
        dc.find_leaks(docs, benchmark, carry=["doc_id", "hits"])
    except ValueError as e:
        assert "clash" in str(e)
    else:
        raise AssertionError


def test_overlap_of_parts():
    part = np.arange(10)
    assert dc.part_overlap(part[:0], [1]) == 1.0
    assert dc.part_overlap(part[:8], [9, 0, 1, 9, 2, 3, 4, 5, 6, 9]) == 7 / 8
    assert dc.part_overlap(part[:2], [1, 0]) == 0.5
    whole = np.arange(29)
    assert dc.part_overlap(whole, [x if x != 14 else 99 for x in range(29)]) == 0.8
