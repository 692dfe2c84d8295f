"""URL filters: a weighted vocabulary matched by Aho-Corasick, after host and path rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.common import lower_ascii

#: A term of this weight is strict: it blocks alone.
STRICT_WEIGHT = 2.0
#: The default vocabulary, terms by weight; strict ones first, then soft ones, of which several block.
VOCABULARY = {
    2.0: ["adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "porno", "sex", "spam", "torrent", "viagra", "warez", "xxx"],
    1.0: ["ads", "apuestas", "bets", "bonus", "cheap", "deals", "farm", "free", "gratis", "gratuit", "kredit", "loan", "lotto", "pari", "pills", "poker", "prix", "prize", "promo", "track", "win", "wetten"],
}
#: host/path rules of the registered query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

HOST_PATH = r"\A([^/?#]*)([^?#]*)"


def vocabulary() -> list[tuple[str, float]]:
    return [(term, weight) for weight, terms in VOCABULARY.items() for term in terms]


def _matcher(weights: dict[str, float]):
    import ahocorasick

    if not weights:  # an automaton of no words cannot run
        return lambda text: {}
    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(term, (term, weight))
    found.make_automaton()

    def hits(text: str) -> dict[str, float]:
        """Terms that stand between boundaries (no ASCII letter or digit next to them)."""
        out: dict[str, float] = {}
        for end, (term, weight) in found.iter(text):
            start = end - len(term) + 1
            before = text[start - 1] if start else "/"
            after = text[end + 1] if end + 1 < len(text) else "/"
            if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
                out[term] = weight
        return out

    return hits


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    carry: list[str] | None = None,
    rules: dict[str, str] | None = None,
    terms: list[tuple[str, float]] | None = None,
    limit: float = STRICT_WEIGHT,
) -> DataFrame:
    """Judge each url: the longest fitting rule decides, else the vocabulary.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``; a rule fits its host
    and all subdomains if the url's path starts with the rule's path (among
    rules of one length the last in code-point order wins). ``terms`` is a
    table of (term, weight), by default ``VOCABULARY``; of several weights of a
    term the largest counts. A term of at least ``limit`` is strict, others are
    soft; each counts once however often it occurs, and a sum of weights of ``limit``
    blocks. Terms match the whole url in ASCII lower case.

    Returns the carried columns (default ``page_id``) and host, path, rule,
    n_strict, n_soft, terms (sorted), verdict; one row per input row.
    A null url, or one without ``://``, has empty host and path; a null or
    empty url has no terms and is allowed.
    Rows are judged one by one, so repeated rows give repeated results.
    """
    rules = RULES if rules is None else rules
    weights = dict(sorted((t.lower(), float(w)) for t, w in (vocabulary() if terms is None else terms) if t))
    carry = ["page_id"] if carry is None else carry

    @F.pandas_udf("array<string>")
    def terms_of(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits = _matcher(weights)
        for batch in urls:
            yield batch.map(lambda u: sorted(hits(u)) if u else [])

    # the struct keeps the caller's columns apart from those made here
    df = pages.select(F.struct(*[F.col(c) for c in carry]).alias("_in"), F.col(url).alias("_url"))
    rest = F.when(F.col("_url").contains("://"), F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")  # null: empty too
    df = df.withColumn("host", lower_ascii(F.regexp_extract(rest, HOST_PATH, 1))).withColumn("path", F.regexp_extract(rest, HOST_PATH, 2))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # the longest comes last and wins
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, decided = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(decided)
    df = df.withColumns({"rule": rule, "_decided": decided, "terms": terms_of(lower_ascii(F.coalesce(F.col("_url"), F.lit(""))))})
    n_strict = F.size(F.array_intersect("terms", F.lit([t for t, w in weights.items() if w >= limit]).cast("array<string>")))
    df = df.withColumns({"n_strict": n_strict, "n_soft": F.size("terms") - n_strict})
    weight = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w)]) if weights else F.create_map().cast("map<string,double>")
    score = F.aggregate("terms", F.lit(0.0), lambda sum_, t: sum_ + F.element_at(weight, t))
    verdict = F.coalesce("_decided", F.when(score >= limit, "block").otherwise("allow"))
    return df.select("_in.*", "host", "path", "rule", "n_strict", "n_soft", "terms", verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules and the vocabulary over every url of ``pages``."""
    out = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _oracle() -> str:
    strict, soft = VOCABULARY[2.0], VOCABULARY[1.0]
    one = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int"
    rule, decided = "NULL", "NULL"
    for text in sorted(RULES, key=lambda r: (len(r), r)):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rule, decided = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{RULES[text]}' ELSE {decided} END"
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{low}') AS u, strpos(coalesce(url, ''), '://') AS p, coalesce(url, '') AS raw FROM pages
), b AS (
  SELECT page_id, u,
    CASE WHEN p = 0 THEN '' ELSE translate(regexp_extract(substr(raw, p + 3), '^[^/?#]*'), '{upper}', '{low}') END AS host,
    CASE WHEN p = 0 THEN '' ELSE regexp_extract(substr(raw, p + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM a
), c AS (
  SELECT *, {' + '.join(map(one, strict))} AS n_strict, {' + '.join(map(one, soft))} AS n_soft, {rule} AS rule, {decided} AS decided FROM b
)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN 2 * n_strict + n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict::int AS n_strict, n_soft::int AS n_soft
FROM c"""


ORACLE = {"op9_url_filter": _oracle()}
