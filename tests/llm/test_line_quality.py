import random
import re

from gridlark.llm import line_quality
from gridlark.llm.line_quality import base_counts, clean_lines, phrases


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "a", "é", "\u00a0", "#|", " ", " ", "\n", "\t", "\x0b", "\x1c"]) for _ in range(rng.randrange(60)))
        assert base_counts(text) == brute(text), repr(text)
    assert base_counts(None) == (0, 0, 0, 0, 0)


def failed_rule(line):
    return line_quality.failed_rule(line, phrases(line_quality.BOILERPLATE), set(phrases(line_quality.NAVIGATION)))


def test_rules():
    assert failed_rule("Alle Rechte vorbehalten.") == failed_rule("Mentions légales.") == "boilerplate"
    assert failed_rule("Página siguiente »") == "navigation"
    assert failed_rule("Odd~~ words// end<< so.") == "punctuation"
    assert failed_rule("Home | About | Contact us |") == "navigation"
    assert failed_rule("Read more »") == "navigation"
    assert failed_rule("All rights reserved.") == "boilerplate"
    assert failed_rule("a line that just stops") == "punctuation"
    assert failed_rule("WOW!! BUY!! NOW!! YES!!") == "punctuation"
    assert failed_rule("one%%% two### three*** four.") == "punctuation"
    for good in ["A sentence.", 'She said "yes."', "Is it? Yes!", "中文。", " ".join(["word"] * 40), "Use a | b or a > b in code, as one may."]:
        assert failed_rule(good) is None, good


def test_documents(spark):
    good = "\n".join(f"Line w{k} says x{k} and y{k} to z{k}." for k in range(12))
    rows = [
        (1, good, True),
        (2, good + "\nHome | About | Help |", True),
        (3, "\n".join(f"Home | Item{k} | Help | More |" for k in range(20)), False),
        (4, None, False),
        (5, "", False),
        (6, "too short.", False),
        (7, "same words here. " * 40, False),
        (8, " ".join(f"w{k}" for k in range(200_000)), True),
    ]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t, _ in rows] * 2, "doc_id long, text string, kept string, n_words int")
    out = clean_lines(df).collect()
    assert len(out) == 2 * len(rows)
    want = {i: k for i, _, k in rows}
    for r in out:
        assert r["kept"] == want[r["doc_id"]], r["doc_id"]
        if r["doc_id"] == 2:
            assert r["clean_text"] == good and r["n_navigation"] == 1
        if r["doc_id"] == 4:
            assert r["clean_text"] is None and r["base_failed"]
    assert clean_lines(df.where("doc_id < 0")).count() == 0


def test_own_tables_of_phrases(spark):
    text = "\n".join(f"Line w{k} says x{k} and y{k} to z{k}." for k in range(12)) + "\nTutti i diritti riservati.\nPagina iniziale"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    own = clean_lines(df, boilerplate={"it": ["tutti i diritti riservati"]}, navigation={"it": ["Pagina iniziale"]}).first()
    assert (own["n_boilerplate"], own["n_navigation"], own["n_punctuation"]) == (1, 1, 0)
    assert clean_lines(df).first()["n_boilerplate"] == 0
