import hashlib

from pyspark.sql import functions as F

from statera.llm import chat, queries_text


def test_conversations_equal_hand_made_digests(spark, monkeypatch):
    rows = [(1, 0, "user", "a <s> \\ </s> <\\/s> [INST][/INST]"), (1, 1, "assistant", "<</s>"), (1, 1, "assistant", "<</s>"), (2, None, None, None), (2, 0, "tool[TEXT]", "x"), (None, 0, "assistant", "é𝔘")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    monkeypatch.setattr(queries_text, "read_table", lambda *a: df.select("conv_id", "turn", "role", "text"))
    got = {r.conv_id: r for r in queries_text.op8_chat_formatting(spark, "").collect()}
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    for c, turns in by.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-1].n_turns == 2
    formatted = {r.conv_id: r.formatted for r in chat.format_chats(df).collect()}
    assert all(f.count("[TURN]") == len(by[c]) == f.count("</s>") for c, f in formatted.items())
    spans = chat.loss_spans(chat.format_chats(df)).collect()
    assert all(formatted[r.conv_id][r.start : r.start + r.length] for r in spans)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_layouts(spark):
    one = spark.sql("SELECT 1 AS id, array(named_struct('role', 'user', 'content', 'a'), named_struct('role', 'assistant', 'content', 'b')) AS messages, 2 AS extra")
    two = spark.sql("SELECT 1 AS id, array(named_struct('from', 'human', 'value', 'a'), named_struct('from', 'gpt', 'value', 'b')) AS conversations")
    three = spark.sql("SELECT 1 AS id, 'a' AS prompt, 'b' AS response")
    four = spark.sql("SELECT 1 AS id, 'a' AS instruction, '' AS input, 'b' AS output")
    for df in (one, two, three, four):
        assert [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]


MIXED = (
    "id string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, response string, completion string, "
    "instruction string, input string, output string, system string, conv_id long, turn long, role string, text string, note string"
)


def mixed(spark, *rows):
    names = [f.name for f in spark.createDataFrame([], MIXED).schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MIXED)


def turns(df):
    out = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn", "role", "text").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    return out


def test_every_row_goes_by_its_own_layout(spark):
    long = "very long </s> text " * 40_000
    df = mixed(
        spark,
        {"id": "a", "messages": [("user", "q"), ("assistant", long)]},
        {"id": "b", "conversations": [("human", "q"), ("gpt", "r")]},
        {"id": "c", "prompt": "q", "response": "r"},
        {"id": "d", "prompt": "q", "completion": "r"},
        {"id": "e", "instruction": "q", "input": "i", "output": "r"},
        {"id": "f", "instruction": "q", "output": "r", "system": "s"},
        {"id": "g", "instruction": "q", "input": "i", "output": "r", "system": "s"},
        {"conv_id": 7, "turn": 0, "role": "human", "text": "q"},
        {"id": "h", "prompt": "no answer", "note": "n"},
        {"id": "i", "messages": [], "note": "n"},
    )
    assert turns(df) == {
        "a": [("user", "q"), ("assistant", long)], "b": [("user", "q"), ("assistant", "r")], "c": [("user", "q"), ("assistant", "r")], "d": [("user", "q"), ("assistant", "r")],
        "e": [("user", "q\ni"), ("assistant", "r")], "f": [("system", "s"), ("user", "q"), ("assistant", "r")], "g": [("system", "s"), ("user", "q\ni"), ("assistant", "r")],
        "7": [("human", "q")], "h": [("user", "no answer"), ("assistant", "")],
    }
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(df)).collect()}
    assert back == turns(df)


def test_status_of_rows(spark):
    two = mixed(spark, {"id": "a", "messages": [("user", "q")], "prompt": "p"}, {"id": "b", "prompt": "p", "response": "r"}).drop("conv_id", "turn", "role", "text")
    assert {r.id: (r._layout, r._status) for r in chat.routed(two).collect()} == {"a": ("messages", "several"), "b": ("prompt and response", "mapped")}
    odd = mixed(spark, {"id": "a", "note": "only this"}, {"id": "b"}, {"id": None, "prompt": None, "response": "r"}).select("id", "prompt", "response", "messages", "note")
    assert {r.id: r._status for r in chat.routed(odd).collect()} == {"a": "unknown", "b": "mapped", None: "mapped"}
    assert ["only this" in r.row for r in chat.unmapped(odd).collect()] == [True]
    assert turns(odd)[None] == [("user", ""), ("assistant", "r")] and "a" not in turns(odd)
    assert chat.canonical_turns(odd.limit(0)).count() == 0


def test_other_layouts(spark):
    five = spark.sql("SELECT 1 AS id, 'a' AS prompt, 'b' AS completion")
    six = spark.sql("SELECT 1 AS id, 's' AS system, 'a' AS instruction, 'b' AS output")
    assert turns(five) == {1: [("user", "a"), ("assistant", "b")]} and turns(six) == {1: [("system", "s"), ("user", "a"), ("assistant", "b")]}
