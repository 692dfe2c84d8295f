import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridlark.llm import language_id as li

DATA = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet(DATA)
    got = li.op7_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all()
    away = got[got["held_out"] & (got["n_chars"] >= 50)]
    assert (away["lang_pred"] == away["lang"]).mean() > 0.95


def test_texts_at_the_edges(spark):
    rows = [(1, "the and of the and", "aa"), (2, "der und die der und", "bb"), (3, None, "aa"), (4, "", "aa"), (5, "12 !? _", "bb"), (6, "the the of", None), (None, "und der", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df)
    got = sorted(map(tuple, li.predict(df.withColumn("score_", F.lit(1)), model).collect()), key=str)
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert by[1][0] == by[6][0] == "aa" and by[2][0] == by[None][0] == "bb"
    assert by[3] == by[4] == by[5] == ("und", 0.0)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in li.predict(df, li.train(df)).collect()] == [(1, "und", 0.0)]
    none = df.where("doc_id is null")
    assert li.predict(none, li.train(none)).count() == 0


def test_pieces_count_what_the_whole_counts(monkeypatch):
    text = "Étion dans, çouelle 12 un éonierç -- le ch trement. " * 40
    whole = li.gram_counts(text)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(li, "PIECE", piece)
        assert (li.gram_counts(text) == whole).all()


def test_ftrl_separates_and_l1_makes_zeros():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(300):
        at = np.array(sorted({int(rng.integers(10)) + 10 * (k % 3), 40 + int(rng.integers(20))}))
        rows.append((k % 3, at, np.ones(len(at))))
    w, b = li.ftrl(lambda: rows, 3, 5, 0.5, 1.0, 0.01, 0.001)
    assert all(int((x @ w[at] + b).argmax()) == y for y, at, x in rows)
    dense = np.count_nonzero(w)
    assert np.count_nonzero(li.ftrl(lambda: rows, 3, 5, 0.5, 1.0, 2.0, 0.001)[0]) < dense


def naive_counts(text):
    """Places of the n-grams of a text, gram by gram."""
    plain = re.sub(r"[\W\d_]+", " ", text.lower()).strip(" ")
    if not any(c.isalpha() for c in plain):
        return None
    plain, out = f" {plain} ", Counter()
    for n in li.ORDERS:
        for i in range(len(plain) - n + 1):
            h = 0
            for c in plain[i : i + n]:
                h = (h + ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 32
            out[(h >> 7) % (1 << li.BITS)] += 1
    return out


def naive_vector(counts, idf):
    x = {p: (1 + math.log(n)) * idf(p) for p, n in counts.items()}
    size = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {p: v / size for p, v in x.items()}


def naive_softmax(z):
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def naive_fit(data, classes, epochs, alpha, beta, l1, l2):
    """FTRL with dictionaries, a coordinate at a time."""
    z, n = {}, {}

    def weight(p, k):
        value, penalty, ridge = z.get((p, k), 0.0), (0.0 if p == "bias" else l1), (0.0 if p == "bias" else l2)
        if abs(value) <= penalty:
            return 0.0
        return -(value - math.copysign(penalty, value)) / ((beta + math.sqrt(n.get((p, k), 0.0))) / alpha + ridge)

    for _ in range(epochs):
        for label, x in data:
            x = {**x, "bias": 1.0}
            w = {(p, k): weight(p, k) for p in x for k in range(classes)}
            error = naive_softmax([sum(v * w[p, k] for p, v in x.items()) for k in range(classes)])
            error[label] -= 1
            for p, v in x.items():
                for k in range(classes):
                    g, old = v * error[k], n.get((p, k), 0.0)
                    z[p, k] = z.get((p, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[p, k]
                    n[p, k] = old + g * g
    return {key: weight(*key) for key in z}


def naive_model(spark, rows):
    """(text -> (language, probability)) learned from (id, text, lang) as ``train`` says, with one shard."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    langs = sorted({r[2] for r in rows})
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    marks = df.select("id", "text", "lang", (li._unit(F.lit("held"), F.col("id")) < 0.2).alias("held"), F.xxhash64(F.lit("order"), "id").alias("order")).collect()
    marks = [(r, c) for r in marks if (c := naive_counts(r["text"])) is not None]
    df_of = Counter(p for _, c in marks for p in c)
    idf = lambda p: math.log((1 + len(marks)) / (1 + df_of[p])) + 1
    ordered = sorted((m for m in marks if not m[0]["held"]), key=lambda m: (m[0]["order"], m[0]["id"], m[0]["lang"]))
    w = naive_fit([(langs.index(r["lang"]), naive_vector(c, idf)) for r, c in ordered], len(langs), 3, 0.5, 1.0, 1e-4, 1e-3)

    def logits(counts):
        x = {**naive_vector(counts, idf), "bias": 1.0}
        return [sum(v * w.get((p, k), 0.0) for p, v in x.items()) for k in range(len(langs))]

    held = [(langs.index(r["lang"]), logits(c)) for r, c in marks if r["held"]]
    grid = [math.exp(math.log(0.02) + (math.log(20) - math.log(0.02)) * i / 60) for i in range(61)]
    loss = [sum(-math.log(max(naive_softmax([v / t for v in z])[k], 1e-300)) for k, z in held) for t in grid]
    temperature = grid[loss.index(min(loss))] if held else 1.0

    def judge(text):
        counts = naive_counts(text or "")
        if counts is None:
            return li.UNKNOWN, 0.0
        p = naive_softmax([v / temperature for v in logits(counts)])
        return langs[p.index(max(p))], max(p)

    return judge


def test_whole_operator_equals_a_naive_one(spark):
    rng = random.Random(31)
    alphabets = {"aa": "abcd é", "bb": "cdef ", "cc": "efgh 1"}
    rows = [(i, "".join(rng.choice(alphabets[g]) for _ in range(rng.randrange(60))), g) for i in range(120) for g in [rng.choice(["aa", "aa", "bb", "cc"])]]
    judge = naive_model(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in li.predict(df, li.train(df), carry=["doc_id", "text"]).collect():
        lang, score = judge(r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, r


def test_repeated_rows_and_very_long_texts(spark):
    long = "der die das und " * 200_000
    rows = [(1, long, "de"), (1, long, "de"), (2, "the of and " * 30, "en"), (2, "the of and " * 30, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = li.predict(df, li.train(df)).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == [(1, "de"), (1, "de"), (2, "en"), (2, "en")]
