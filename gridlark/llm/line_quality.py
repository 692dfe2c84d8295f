"""Quality rules, line first: drop lines that fail, then documents that lose too much."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridlark.llm.common import WORD, carried, slices, texts

#: Phrases of boilerplate by language, in lower case; a line with one of them fails.
BOILERPLATE = {
    "en": ["all rights reserved", "licensed under the", "released under the", "permission is hereby granted", "privacy policy", "terms of use", "terms of service", "terms and conditions", "cookie policy", "we use cookies", "accept cookies", "enable javascript", "lorem ipsum"],
    "de": ["alle rechte vorbehalten", "lizenziert unter", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "wir verwenden cookies", "cookies akzeptieren", "javascript aktivieren"],
    "fr": ["tous droits réservés", "sous licence", "politique de confidentialité", "conditions d'utilisation", "conditions générales", "mentions légales", "nous utilisons des cookies", "accepter les cookies", "activer javascript"],
    "es": ["todos los derechos reservados", "bajo la licencia", "política de privacidad", "términos de uso", "términos y condiciones", "aviso legal", "utilizamos cookies", "aceptar cookies", "activar javascript"],
}
#: Whole lines of navigation by language, in lower case, without punctuation around them.
NAVIGATION = {
    "en": ["home", "menu", "search", "login", "log in", "sign in", "sign up", "subscribe", "read more", "next page", "previous page", "back to top", "skip to content", "share this", "click here", "contact us", "about us"],
    "de": ["startseite", "menü", "suche", "anmelden", "registrieren", "abonnieren", "weiterlesen", "mehr lesen", "nächste seite", "vorherige seite", "nach oben", "zum inhalt springen", "teilen", "kontakt", "über uns", "impressum"],
    "fr": ["accueil", "menu", "recherche", "rechercher", "se connecter", "s'inscrire", "s'abonner", "lire la suite", "page suivante", "page précédente", "haut de page", "aller au contenu", "partager", "contactez-nous", "à propos"],
    "es": ["inicio", "menú", "buscar", "iniciar sesión", "registrarse", "suscribirse", "leer más", "página siguiente", "página anterior", "volver arriba", "saltar al contenido", "compartir", "contacto", "sobre nosotros"],
}
#: Marks that neither end nor join words of prose; a word that ends in two of them is junk.
MARKS = "!#$%&*+/<=>?@\\^_`|~"
#: What a sentence may end with, closing quotes and brackets aside.
TERMINAL = ".!?…:;。！？"
CLOSING = "\"'”’»)]}"
SYMBOLS = "#*$%&|<>"

MADE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, lost double, clean_text string"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = re.findall(WORD, text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif re.search(WORD, line):
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        count = Counter(grams)
        if len(count) < len(grams):
            done = 0  # words before this place are counted or passed
            for i, gram in enumerate(grams):
                if count[gram] > 1:
                    repeated += i + 3 - max(i, done)
                    done = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated


def phrases(table: dict[str, list[str]]) -> list[str]:
    """The phrases of all languages: a line's own language is not known."""
    return sorted({x.lower() for own in table.values() for x in own})


def failed_rule(line: str, boilerplate: list[str], navigation: set[str], long_line: int = 30) -> str | None:
    """The rule by which a line that has words fails: punctuation, navigation or boilerplate."""
    words = re.findall(WORD, line)
    low = line.lower()
    if any(x in low for x in boilerplate):
        return "boilerplate"
    bars = sum(w in ("|", "»", ">", "/", "·", "•") for w in words)
    if bars >= 2 and 4 * bars >= len(words) or low.strip(" \t\r\n.,:;!?|»>-•·") in navigation:
        return "navigation"
    if 5 * sum(len(w) - len(w.rstrip(MARKS)) > 1 for w in words) > len(words):
        return "punctuation"
    if 10 * sum(map(line.count, SYMBOLS)) > sum(map(len, words)):
        return "punctuation"
    if line.strip().rstrip(CLOSING)[-1:] not in TERMINAL and len(words) < long_line:
        return "punctuation"
    return None


def clean_lines(
    docs: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost: float = 0.3,
    long_line: int = 30,
    boilerplate: dict[str, list[str]] | None = None,
    navigation: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Remove lines that fail a rule, then reject documents that lose too much.

    A line that has a word fails by boilerplate (a phrase of that table, by
    default ``BOILERPLATE``), navigation (separators between short items, or a
    phrase of that table, by default ``NAVIGATION``, alone) or punctuation
    (more than a fifth of its words end in two or more ``MARKS``, more than a
    tenth of its characters are symbols, or it has under ``long_line`` words and does
    not end as a sentence); the first of them counts. The tables hold phrases by language; those of all languages count. Lines without words are kept as they are.
    ``lost`` is the share of word characters in removed lines. A document is
    kept if it has ``min_words`` words, at most ``max_repeat_percent`` of them
    in repeated 3-word windows, and lost at most ``max_lost``.

    Returns the carried columns (default ``doc_id``) and the columns of
    ``MADE``, a row per input row; repeated rows give repeated results. Null
    and empty texts have no words: base_failed, not kept, lost 0; the cleaned
    text of null is null. Texts are read whole, whatever their length.
    """
    carry = carried(docs, ["doc_id"] if carry is None else carry, [c.split()[0] for c in MADE.split(", ")])
    fields = [docs.schema[c] for c in carry]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [MADE])
    names = [c.split()[0] for c in MADE.split(", ")]
    at = len(carry)
    plates = phrases(BOILERPLATE if boilerplate is None else boilerplate)
    ways = set(phrases(NAVIGATION if navigation is None else navigation))

    def judge(t: str | None) -> tuple:
        n_words, chars, symbols, dup, repeat = base_counts(t)
        failed = n_words < min_words or 100 * repeat > max_repeat_percent * n_words
        n_lines, fails, lost, kept_lines = 0, Counter(), 0, []
        for line in [] if t is None else t.split("\n"):
            own = sum(map(len, re.findall(WORD, line)))
            n_lines += bool(own)
            if own and (rule := failed_rule(line, plates, ways, long_line)):
                fails[rule] += 1
                lost += own
            else:
                kept_lines.append(line)
        share = lost / chars if chars else 0.0
        clean = None if t is None else "\n".join(kept_lines)
        return n_words, chars, symbols, dup, repeat, failed, not failed and share <= max_lost, n_lines, fails["punctuation"], fails["navigation"], fails["boilerplate"], share, clean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 4 + [pa.float64(), pa.string()]
        for batch in slices(batches):
            made = list(zip(*map(judge, batch.column(at).to_pylist()), strict=True)) or [()] * len(names)
            columns = [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=[*carry, *names])

    return texts(docs.select(*carry, docs[text].alias("_text"))).mapInArrow(run, schema)


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole text of ``documents``."""
    out = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_punctuation", "n_navigation", "n_boilerplate")


def _oracle() -> str:
    """The same counts and rules over lines and windows of words."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    one_of = lambda xs: "(" + ", ".join(map(quote, xs)) + ")"
    words = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
    boilerplate = " OR ".join(f"contains(low, {quote(x)})" for x in phrases(BOILERPLATE))
    bare = "' .,:;!?|»>-•·' || chr(9) || chr(10) || chr(13)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)
), c AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1) GROUP BY rid
), l AS (
  SELECT rid, line, lower(line) AS low, {words.format("line")} AS lw, nth FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth FROM d)
), m AS (
  SELECT *, len(array_to_string(lw, '')) AS own, row_number() OVER (PARTITION BY rid, line ORDER BY nth) AS again,
    len(list_filter(lw, lambda x: x IN ('|', '»', '>', '/', '·', '•'))) AS bars,
    len(list_filter(lw, lambda x: len(x) - len(rtrim(x, {quote(MARKS)})) > 1)) AS odd,
    len(line) - len(translate(line, '{SYMBOLS}', '')) AS symbols,
    right(rtrim(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {quote(CLOSING)}), 1) AS last
  FROM l WHERE len(lw) > 0
), r AS (
  SELECT *, CASE WHEN {boilerplate} THEN 'boilerplate'
    WHEN bars >= 2 AND 4 * bars >= len(lw) OR trim(low, {bare}) IN {one_of(phrases(NAVIGATION))} THEN 'navigation'
    WHEN 5 * odd > len(lw) OR 10 * symbols > own OR NOT contains({quote(TERMINAL)}, last) AND len(lw) < 30 THEN 'punctuation' END AS rule
  FROM m
), s AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (again > 1) AS dup, sum(own) FILTER (rule IS NOT NULL) AS lost, count(*) FILTER (rule = 'punctuation') AS p, count(*) FILTER (rule = 'navigation') AS n, count(*) FILTER (rule = 'boilerplate') AS b FROM r GROUP BY rid
), a AS (
  SELECT doc_id, len(w)::bigint AS n_words, len(array_to_string(w, ''))::bigint AS word_chars, (len(text) - len(translate(text, '{SYMBOLS}', '')))::bigint AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(n_lines, 0) AS n_lines, coalesce(p, 0) AS n_punctuation, coalesce(s.n, 0) AS n_navigation, coalesce(b, 0) AS n_boilerplate
  FROM d LEFT JOIN c USING (rid) LEFT JOIN s USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost::double / word_chars <= 0.3::double AS kept, n_lines, n_punctuation, n_navigation, n_boilerplate FROM f"""


ORACLE = {"op3_line_quality": _oracle()}
