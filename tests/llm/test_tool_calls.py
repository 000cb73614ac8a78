import json

from pyspark.sql import functions as F

from hawser.llm import tool_calls as C

SCHEMAS = [("add", "x", "integer", True), ("add", "y", "number", True), ("say", "text", "string", True), ("say", "tags", "array", False)]


def call(id_, name, args, after=None):
    c = {"id": id_, "name": name, "arguments": args}
    return c | ({"after": after} if after is not None else {})


def messages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, status string")


def test_calls(spark):
    rows = [
        (1, 0, "system", "Be brief"),
        (1, 1, "assistant", json.dumps({"tool_calls": [call("c", "say", {"text": "é\n", "tags": [1]}, ["b"]), call("b", "add", {"y": 2.5, "x": 1}, ["a"]), call("a", "add", {"x": 1, "y": 2})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "3.5"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": "?"})),
        (1, 5, "assistant", json.dumps({"tool_calls": [call("d", "add", {"x": "one", "q": 1}), call("e", "fly", {}), call("f", "add", {"x": 1, "y": 1}, ["g"]), call("g", "add", {"x": 1, "y": 1}, ["f"]), call("h", "add", {"x": 1, "y": 1}, ["g"])]})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("a", "say", {"text": "other conversation"})]})),
        (2, 2, "tool", json.dumps({"tool_call_id": "a", "content": None})),
        (2, 3, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
    ]
    got = {(r.conv_id, r.call_id): r for r in C.link(messages(spark, rows), SCHEMAS).collect()}
    level = lambda k: got[1, k].level
    assert (level("a"), level("b"), level("c")) == (0, 1, 2)
    assert {k: got[1, k].status for k in "abcdefgh"} == {"a": "ok", "b": "ok", "c": "unanswered", "d": "invalid", "e": "invalid", "f": "cyclic", "g": "cyclic", "h": "cyclic"}
    assert got[1, "d"].problems == "x is no integer; y is missing; q is unknown" and got[1, "e"].problems == "unknown tool"
    assert got[1, "nobody"].status == "orphan" and got[1, None].status == "message"
    assert got[2, "a"].status == "ok" and got[2, "a"].repeated == 1
    for r in got.values():
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, "a"].json) == {"arguments": {"x": 1, "y": 2}, "id": "a", "level": 0, "name": "add", "result": {"b": 2, "z": 1}, "status": "ok"}


def test_plain_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(7)] + [(2, 0, "assistant", "nobody asked"), (3, 0, "user", None), (None, 0, "user", "hi"), (4, None, None, None), (3, 0, "user", None)]
    got = C.link(messages(spark, rows)).collect()
    by = {(r.conv_id, r.turn): r for r in got if r.conv_id is not None}
    assert [by[1, t].level for t in (0, 2, 4, 6)] == [0, 1, 2, 3] and [by[1, t].status for t in (0, 6)] == ["ok", "unanswered"]
    assert by[2, 0].status == "orphan" and by[3, 0].status == "invalid" and by[3, 0].problems == "prompt is missing" and by[3, 0].repeated == 1
    assert by[4, None].status == "message"
    assert C.link(messages(spark, rows).limit(0)).count() == 0


def test_levels_of_a_long_chain_and_a_lattice(spark):
    chain = [(f"c{i:04d}", [f"c{i - 1:04d}"] if i else []) for i in range(500)]
    lattice = [("l0", []), ("l1", ["l0", "x"]), ("l2", ["l0", "l1", "l2"]), ("l3", ["l1", "l2"]), ("l4", ["l0", "l3"])]
    got = {r.key: r.level for r in C.levels(spark.createDataFrame(chain + lattice, "key string, after array<string>")).collect()}
    assert all(got[f"c{i:04d}"] == i for i in range(500))
    assert [got[f"l{i}"] for i in range(5)] == [0, 1, 2, 3, 4]


def test_query_against_plain_linking(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    at = {(r.conv_id, r.turn): r for r in rows}
    got = {(r.conv_id, r.turn): r for r in C.op5_tool_call_linking(spark, small).collect() if r.status != "message"}
    asked = {k: r for k, r in at.items() if r.role == "user"}
    level = lambda k: 0 if (k[0], k[1] - 2) not in asked else 1 + level((k[0], k[1] - 2))
    for k, r in asked.items():
        answer = at.get((k[0], k[1] + 1))
        answered = answer is not None and answer.role == "assistant"
        assert got[k].level == level(k) and got[k].status == ("ok" if answered else "unanswered")
        if answered:
            want = {"arguments": {"prompt": r.text, "turn": r.turn}, "id": f"{r.conv_id}:{r.turn}", "level": level(k), "name": "reply", "result": {"text": answer.text}, "status": "ok"}
            assert got[k].json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_no_message_is_lost(spark):
    two = {"tool_calls": [call("k", "say", {"text": "one"}), call("k", "say", {"text": "two"}), call(None, "say", {"text": "three"}), call(None, "say", {"text": "four"})]}
    rows = [
        (1, 0, "user", "first asks"), (1, 0, "user", "second asks"), (1, 1, "assistant", "answer"), (1, 1, "assistant", "better answer"),
        (None, 0, "user", "somebody"), (None, 0, "user", "somebody else"), (None, 0, "user", "somebody else"), (None, 1, "assistant", "to whom"),
        (2, 1, "assistant", json.dumps(two | {"content": "let me see"})), (2, 2, "tool", json.dumps({"tool_call_id": "k", "content": "r1"})), (2, 3, "tool", json.dumps({"tool_call_id": "k", "content": "r2", "note": "late"})),
        (3, 1, "assistant", json.dumps({"tool_calls": []})), (3, 2, "assistant", json.dumps({"tool_calls": [], "content": "nothing to call"})),
        (5, None, "user", "no turn"), (5, None, "user", "no turn either"), (5, None, "assistant", "none here"),
    ]
    got = C.link(messages(spark, rows), SCHEMAS + C.SCHEMAS).collect()
    of = lambda conv, status: sorted(json.dumps(json.loads(r.json), sort_keys=True) for r in got if r.conv_id == conv and r.status == status)
    for _, _, _, text in rows:
        if not text.startswith("{"):
            assert sum(f'"{text}"' in r.json for r in got) == sum(x[3] == text for x in rows), text
    assert len(of(1, "ok")) == 1 and len(of(1, "duplicate")) == 2
    assert len([r for r in got if r.conv_id is None and r.status == "orphan"]) == 1 and len([r for r in got if r.conv_id is None and r.status == "unanswered"]) == 3
    assert of(2, "duplicate") == ['{"arguments": {"text": "two"}, "id": "k", "name": "say", "status": "duplicate"}', '{"id": "k", "result": "r2", "status": "duplicate"}']
    assert [json.loads(x)["result"] for x in of(2, "ok")] == ["r1"] and sorted(json.loads(x)["arguments"]["text"] for x in of(2, "unanswered")) == ["four", "three"]
    assert of(2, "message") == ['{"content": "let me see", "role": "assistant"}', '{"content": {"note": "late"}, "role": "tool"}']
    assert of(3, "message") == ['{"content": {"content": "nothing to call", "tool_calls": []}, "role": "assistant"}', '{"content": {"tool_calls": []}, "role": "assistant"}']
    assert len(of(5, "invalid")) == 2 and len(of(5, "orphan")) == 1  # a missing turn is a missing argument


def plain_levels(after):
    """Kahn's order; None for calls on a cycle or below one."""
    after = {k: {d for d in deps if d in after and d != k} for k, deps in after.items()}
    level, left = {}, dict(after)
    while True:
        free = [k for k, deps in left.items() if all(d in level for d in deps)]
        if not free:
            return level | dict.fromkeys(left)
        level |= {k: max((level[d] + 1 for d in after[k]), default=0) for k in free}
        for k in free:
            del left[k]


def test_levels_of_random_graphs_and_cycles(spark):
    import random

    rng, after = random.Random(5), {}
    for g in range(40):
        n = rng.randint(1, 14)
        for i in range(n):  # every fourth graph may have cycles
            after[f"{g}:{i}"] = [f"{g}:{rng.randrange(n if g % 4 == 0 else max(i, 1))}" for _ in range(rng.randint(0, 3))]
    after |= {"z": [], "a": ["b", "z"], "b": ["a", "z"], "below": ["z", "a"], "last": ["below", "z"]}
    got = {r.key: r.level for r in C.levels(spark.createDataFrame(list(after.items()), "key string, after array<string>")).collect()}
    assert got == plain_levels(after)
    assert got["a"] is got["b"] is got["below"] is got["last"] is None and got["z"] == 0


def test_a_cycle_among_ten_thousand_calls_takes_few_rounds(spark, monkeypatch):
    ladder = [(f"l{i}", [f"l{j}" for j in range(max(0, i - 3), i)]) for i in range(3000)]
    rows = ladder + [(f"c{i}", [f"c{i - 1}"] if i % 50 else []) for i in range(7000)] + [("z", []), ("a", ["b", "z"]), ("b", ["a", "z"]), ("null", [None])]
    rounds, real = [], C.written
    monkeypatch.setattr(C, "written", lambda df: rounds.append(1) or real(df))
    got = {r.key: r.level for r in C.levels(spark.createDataFrame(rows, "key string, after array<string>")).collect()}
    assert all(got[f"l{i}"] == i for i in range(3000)) and all(got[f"c{i}"] == i % 50 for i in range(7000))
    assert got["a"] is got["b"] is None and got["z"] == got["null"] == 0
    assert len(rounds) < 60


def test_long_texts_and_clashing_names(spark):
    long = "word " * 400_000
    rows = [(1, 0, "user", long, "k"), (1, 1, "assistant", json.dumps({"tool_calls": [call("x", "say", {"text": long})]}), "k"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").withColumns({"level": F.lit("l"), "json": F.lit("j"), "_row": F.lit("r"), "scope": F.lit("s")})
    got = {r.status: r for r in C.link(df, SCHEMAS + C.SCHEMAS).collect()}
    assert len(got) == 2 and set(got) == {"unanswered", "message"} and len(got["unanswered"].json) > len(long)
