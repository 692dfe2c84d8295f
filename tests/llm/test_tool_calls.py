import json
import random
from collections import Counter

from gridlark.llm import tool_calls as tc

CALLS = "conv_id long, id string, parent string, name string, arguments string, level int"
RESULTS = "conv_id long, call_id string, output string, status string"


def link(spark, calls, results, schemas=tc.SCHEMAS):
    c = spark.createDataFrame([(*r, 7) for r in calls], CALLS)
    r = spark.createDataFrame([(*x, "s") for x in results], RESULTS)
    return tc.link_tool_calls(c, r, schemas).collect()


def test_levels_equal_walks_up_the_parents(spark):
    rng = random.Random(4)
    calls, parents = [], {}
    for conv in range(6):
        for i in range(40):
            parent = rng.choice([None, rng.randrange(40), i - 1, i - 1, 99])
            parents[conv, str(i)] = None if parent is None else str(parent)
            calls.append((conv, str(i), parents[conv, str(i)], "reply", "{}"))
    calls += [(7, str(i), str(i - 1), "reply", "{}") for i in range(300)]
    parents |= {(7, str(i)): str(i - 1) for i in range(300)}
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in link(spark, calls, [])}
    for conv, i in parents:
        seen, at, depth = {i}, parents[conv, i], 0
        while at is not None and (conv, at) in parents:
            depth += 1
            if at in seen:
                depth = None
                break
            seen.add(at)
            at = parents[conv, at]
        assert got[conv, i] == depth


def test_link_validate_serialise(spark):
    calls = [
        (1, "a", None, "reply", '{"turn":1,"prompt":"é\\n\\"x"}'),
        (1, "a", None, "reply", '{"turn":1,"prompt":"é\\n\\"x"}'),
        (1, "b", "a", "reply", '{"turn":"1"}'),
        (1, "c", "b", "nope", "[1"),
        (1, "d", "c", "reply", '{"prompt":"y","turn":2,"zz":{"k":[1,2.5]}, "style": null}'),
        (None, "a", None, "reply", None),
        (1, None, None, "reply", "[]"),
    ]
    results = [(1, "a", "out"), (1, "a", "out"), (1, "a", "second"), (1, "q", None), (2, "a", "x"), (None, None, None)]
    rows = link(spark, calls, results)
    got = [(r["conv_id"], r["call_id"], r["level"], r["status"], r["errors"]) for r in rows if r["conv_id"] is not None and r["call_id"] is not None]
    assert sorted(got, key=str) == sorted(
        [
            (1, "a", 0, "linked", []),
            (1, "a", 0, "linked", []),
            (1, "b", 1, "unanswered", ["missing prompt", "turn is not integer"]),
            (1, "c", 2, "unanswered", ["unknown tool"]),
            (1, "d", 3, "unanswered", ["unexpected zz"]),
            (1, "q", None, "orphan", None),
            (2, "a", None, "orphan", None),
        ],
        key=str,
    )
    assert len(rows) == 10
    places = {}
    for r in rows:
        places.setdefault(r["conv_id"], []).append((r["position"], r["level"] if r["level"] is not None else 99, r["call_id"] or ""))
    for found in places.values():
        assert [p for p, *_ in sorted(found)] == list(range(len(found)))
        assert [x[1:] for x in sorted(found)] == sorted(x[1:] for x in found)
    for r in rows:
        value = json.loads(r["json"])
        assert r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if r["status"] != "orphan" and value["call_id"] == "d":
            assert value["arguments"]["zz"] == {"k": [1, 2.5]}


def test_empty_tables_and_long_texts(spark):
    assert link(spark, [], []) == []
    long = "x" * 300_000
    (row,) = link(spark, [(1, "a", None, "reply", json.dumps({"prompt": long, "turn": 3}))], [(1, "a", long)])
    assert json.loads(row["json"])["arguments"]["prompt"] == long and row["errors"] == []


def test_every_turn_is_carried(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", None), (1, 4, "assistant", None)]
    rows += [(1, 1, "user", "a2"), (1, 1, "user", "a2"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "b2"), (1, 7, "user", "alone")]
    rows += [(2, None, "user", "x"), (2, 1, None, "y"), (2, 1, "tool", "z"), (2, 1, "tool", "z"), (2, 9, "assistant", "orphan"), (2, None, None, None)]
    rows += [(None, 1, "user", "n"), (None, 2, "assistant", "n"), (None, 2, "assistant", "n"), (None, 0, "system", "n")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    linked, others = set(), Counter()
    for r in tc.op4_tool_calls(spark, str(tmp_path)).collect():
        v = json.loads(r["json"])
        if r["status"] in ("other", "repeated"):
            assert r["level"] == 0 and r["n_errors"] is None and r["call_id"] == (None if v["turn"] is None else str(v["turn"]))
            others[v["conv_id"], v["turn"], v["role"], v["text"]] += r["n_rows"]
            continue
        if r["status"] != "orphan":
            linked.add((v["conv_id"], int(v["call_id"]), "user", v["arguments"]["prompt"]))
        if r["status"] != "unanswered":
            linked.add((v["conv_id"], int(v["call_id"]) + 1, "assistant", v["output"]))
    assert Counter(linked) + others == Counter(rows)


def plain_number(text):
    """The canonical form by decimal arithmetic."""
    from decimal import Decimal

    sign, digits, power = Decimal(text).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    kept = digits.rstrip("0")
    if not kept:
        return "0"
    point = len(digits) + power
    if 0 < point <= 21:
        out = kept + "0" * (point - len(kept)) if point >= len(kept) else kept[:point] + "." + kept[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + kept
    else:
        out = kept[0] + ("." + kept[1:] if len(kept) > 1 else "") + "e" + ("+" if point > 1 else "") + str(point - 1)
    return "-" * sign + out


def test_numbers_have_one_form(spark):
    from pyspark.sql import functions as F

    texts = ["0", "-0", "0.0", "-0.00e5", "1e2", "100", "100.0", "1.50", "1E400", "1e-400", "12345678901234567890123", "0.1", "1e-6", "1e-7", "0.000001", "1e20", "1e21", "1e22", "123e-3", "-5.0E+0", "9" * 60 + ".5", "1e99999999999999999999"]
    rng = random.Random(8)
    texts += [("-" if rng.random() < 0.3 else "") + str(rng.randrange(10 ** rng.randrange(1, 25))) + rng.choice(["", f".{rng.randrange(10**9):09d}"]) + rng.choice(["", f"e{rng.randrange(-30, 30)}", "E+3"]) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tc.canonical(F.col("t")).alias("c"), tc.canonical(F.concat(F.lit('{"b":['), "t", F.lit(',{"x":'), "t", F.lit('}],"a":"'), "t", F.lit('"}'))).alias("d")).collect():
        want = plain_number(r["t"]) if "e9999" not in r["t"] else r["t"]
        assert r["c"] == want and r["d"] == '{"a":"' + r["t"] + '","b":[' + want + ',{"x":' + want + "}]}"


def test_strings_keep_what_looks_like_marks(spark):
    from pyspark.sql import functions as F

    values = ["\ue000", "\ue0005", "\ue001\ue002", '\\"5', "\\\\", '\\ue000"7', "1", '",1,"', "a\\", "\n\t\x01", "\ue000\ue0003", 'q"\ue0001"']
    rows = [(json.dumps({"z": v, v: [v, 1.0]}, ensure_ascii=e),) for v in values for e in (True, False)]
    for r in spark.createDataFrame(rows, "t string").select("t", tc.canonical(F.col("t")).alias("c")).collect():
        assert json.loads(r["c"]) == json.loads(r["t"]), r["t"]


def test_what_is_no_json_or_repeats_a_key(spark):
    from pyspark.sql import functions as F

    bad = ["01", "1.", "+1", "{'a':1}", "[1", "nul", "", '{"a":1}x', "NaN"]
    twice = ['{"a":1,"a":2}', '{"b":{"a":1,"a":1}}']
    df = spark.createDataFrame([(t,) for t in [*bad, *twice, '{"a":1}']], "t string")
    for r in df.select("t", tc.canonical(F.col("t")).alias("c"), tc.repeats_a_key(F.col("t")).alias("r")).collect():
        assert (r["c"] is None) == (r["t"] != '{"a":1}') and r["r"] == (r["t"] in twice), r["t"]
    rows = link(spark, [(1, "a", None, "reply", twice[0]), (1, "b", None, "reply", "[1"), (1, "c", None, "reply", None)], [])
    assert {(r["call_id"], r["errors"][0], json.dumps(json.loads(r["json"])["arguments"])) for r in rows} == {("a", "a key is repeated", json.dumps(twice[0])), ("b", "arguments are no object", '"[1"'), ("c", "arguments are no object", "null")}
