from collections import Counter

from gridlark.llm import token_counts as tc

SHAPE = "doc_id long, source string, lang string, version string, op string, n_tokens long"


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_signed_batches_equal_a_recount(spark):
    rollup = tc.TokenRollup(spark)
    batches = {
        "a": [(1, "s", "en", "v1", "upsert", 10), (2, "s", None, "v1", "upsert", 5), (3, None, "de", "v1", "upsert", 7), (1, "s", "en", "v2", "upsert", 12)],
        "b": [(1, "s", "en", "v1", "upsert", 11), (2, None, None, "v1", "delete", 0), (9, "s", "en", "v1", "delete", None), (4, "t", "fr", "v1", "upsert", None)],
        "c": [(1, "t", "en", "v1", "upsert", 11), (1, "t", "en", "v1", "upsert", 11), (None, "t", "en", "v1", "upsert", 11), (5, "t", "en", None, "upsert", 1), (5, "t", "en", "v1", "other", 1)],
        "d": [(2, "s", "es", "v1", "upsert", 3), (2, "s", "es", "v1", "delete", 3), (3, None, "de", "v1", "upsert", 8)],
    }
    state = {}
    for name, rows in batches.items():
        assert rollup.apply(spark.createDataFrame(rows, SHAPE), name)
        before = totals(rollup)
        assert not rollup.apply(spark.createDataFrame(rows, SHAPE), name)  # once more: nothing changes
        assert totals(rollup) == before
        for i, s, g, v, op, n in sorted(rows, key=lambda r: r[4] == "delete"):
            if i is None or v is None or op not in ("upsert", "delete"):
                continue
            if op == "delete":
                state.pop((i, v), None)
            else:
                state[i, v] = (s, g, n or 0)
        docs, tokens = Counter(), Counter()
        for (_, v), (s, g, n) in state.items():
            docs[s, g, v] += 1
            tokens[s, g, v] += n
        assert before == {k: (docs[k], tokens[k]) for k in docs}
        assert {(r["doc_id"], r["version"]): (r["source"], r["lang"], r["n_tokens"]) for r in rollup.ledger().collect()} == state
        if name == "b":
            rollup.compact()
            assert totals(rollup) == before


def test_uncommitted_files_are_not_read_and_state_is_found_again(spark):
    rollup = tc.TokenRollup(spark)
    rows = spark.createDataFrame([(1, "s", "en", "v", "upsert", 4)], SHAPE)
    rollup.apply(rows, "x")
    spark.createDataFrame([("s", "en", "v", 1, 99)], "source string, lang string, version string, n_docs long, n_tokens long").write.parquet(f"{rollup.path}/deltas/lost")
    again = tc.TokenRollup(spark, rollup.path)
    assert totals(again) == {("s", "en", "v"): (1, 4)}
    assert not again.apply(rows, "x")


def test_empty_batches_and_empty_tables(spark):
    rollup = tc.TokenRollup(spark)
    assert rollup.totals().count() == 0
    assert rollup.apply(spark.createDataFrame([], SHAPE), "none")
    assert rollup.totals().count() == 0


def test_counts_equal_the_encoder_and_decode(spark):
    texts = [None, "", "Hello there, <|endoftext|> it's 42!\n\n  x", "é" * 1000, "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(df).collect()}
    encoder = tc._encoder(tc.VOCABULARY)
    for i, text in enumerate(texts):
        ids = encoder.encode_ordinary(text or "")
        assert got[i] == len(ids) and encoder.decode(ids) == (text or "")


def test_query_equals_recount(spark, tmp_path):
    rows = [(1, "a b c", "en", "s"), (2, "a b c", "en", "s"), (3, None, "en", None), (4, "", None, "s"), (5, None, "en", None), (6, "x", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, tokens = Counter(), Counter()
    for version, path in tc.VERSIONS.items():
        encoder, seen = tc._encoder(path), set()
        for _, text, lang, source in rows:
            if version == "byte_bpe_50k" or text is None or text not in seen:
                docs[source, lang, version] += 1
                tokens[source, lang, version] += len(encoder.encode_ordinary(text or ""))
            seen.add(text)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in tc.op2_token_counts(spark, str(tmp_path)).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_after_compaction_old_logs_are_not_read_and_old_batches_known(spark):
    rollup = tc.TokenRollup(spark)
    rows = spark.createDataFrame([(1, "s", "en", "v", "upsert", 4), (2, "s", "en", "v", "upsert", 5)], SHAPE)
    rollup.apply(rows, "x")
    rollup.compact()
    assert len(rollup.commits()) == 1 and not rollup.apply(rows, "x")
    rollup.apply(spark.createDataFrame([(2, None, None, "v", "delete", 0)], SHAPE), "y")
    assert totals(rollup) == {("s", "en", "v"): (1, 4)} and len(rollup.commits()) == 2


def test_columns_called_like_results(spark):
    df = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, n_tokens int")
    assert tc.count_tokens(df).columns == ["doc_id", "version", "n_tokens"]
    try:
        tc.count_tokens(df, carry=["doc_id", "n_tokens"])
    except ValueError as e:
        assert "clash" in str(e)
    else:
        raise AssertionError
