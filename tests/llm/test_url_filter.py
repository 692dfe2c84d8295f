import pytest

from gridlark.llm.url_filter import _matcher, judge_urls

CASES = [
    ("https://a.b.net/x?q#f", "a.b.net", "/x", "net/", "block"),
    ("https://WWW.Example.NET/en/5", "www.example.net", "/en/5", "example.net/en/", "allow"),
    ("http://notexample.net/en/5", "notexample.net", "/en/5", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/de", "example.com", "/de", None, "allow"),
    ("http://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"),
    ("http://x.org/en/casino", "x.org", "/en/casino", None, "block"),
    ("http://x.org/casinos", "x.org", "/casinos", None, "allow"),
    ("http://cheap-cheap.org/", "cheap-cheap.org", "/", None, "allow"),
    ("http://cheap.org/Free", "cheap.org", "/Free", None, "block"),
    ("http://net", "net", "", None, "allow"),
    ("x://a?b://c/", "a", "", None, "allow"),
    ("casino", "", "", None, "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://é.org/ß#/", "é.org", "/ß", None, "allow"),
]


def test_cases_repeated_rows_and_clashing_columns(spark):
    rows = [(k, u, "h", 1, "v") for k, (u, *_) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, n_soft int, verdict string")
    out = judge_urls(df)
    assert out.count() == len(rows)
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1:], CASES[r["page_id"]]
    assert judge_urls(df.where("page_id < 0")).count() == 0


def test_very_long_url(spark):
    df = spark.createDataFrame([(1, "x" * 200_000), (2, "http://" + "a/" * 100_000 + "casino")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in judge_urls(df).collect()} == {1: "allow", 2: "block"}


@pytest.mark.parametrize("text", ["a-win/win.win", "winwin", "1win win1", "win", "éwiné", "ads_win"])
def test_boundaries_equal_a_pattern(text):
    import re

    want = {t for t in ("win", "ads") if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", text)}
    assert set(_matcher({"win": 1, "ads": 1})(text)) == want


def test_own_table_of_weighted_terms(spark):
    df = spark.createDataFrame([(1, "http://x.org/foo"), (2, "http://x.org/bar-baz"), (3, "http://x.org/bar"), (4, "http://x.org/bar-bar")], "page_id long, url string")
    out = judge_urls(df, terms=[("foo", 1.0), ("FOO", 3.0), ("bar", 1.5), ("baz", 1.5)], limit=3.0)
    assert {r["page_id"]: (r["verdict"], r["n_strict"], r["n_soft"]) for r in out.collect()} == {1: ("block", 1, 0), 2: ("block", 0, 2), 3: ("allow", 0, 1), 4: ("allow", 0, 1)}
    assert {r["verdict"] for r in judge_urls(df, terms=[]).collect()} == {"allow"}
