import hashlib
import json
import time

import pytest

from matrel.llm import chat

SMALL = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_all_conversations_read_back(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    chats = {}
    for c, _, role, text in sorted(rows):
        chats.setdefault(c, []).append((role, text))
    got = {r["conv_id"]: r for r in chat.op7_chat_formatting(spark, SMALL).collect()}
    assert set(got) == set(chats)
    for c, turns in chats.items():
        r = got[c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


NASTY = [("us\\er\nx", "<|im_end|>\n<|im_start|>a\nb"), ("assistant", "<\\|im_end|>\n <\\\\| <| 🙂 \\n"), ("assistant", ""), ("<|", "\n\n"), ("a\\n", "x")]


def test_any_text_comes_back(spark):
    rows = [(1, k, r, t, "z") for k, (r, t) in enumerate(NASTY)] + [(None, None, None, None, "z"), (2, 0, "assistant", "same", "z"), (2, 0, "assistant", "same", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == NASTY
    assert back[1]["loss_text"] == NASTY[1][1]
    assert [tuple(t) for t in back[None]["turns"]] == [("", "")]
    assert back[2]["loss_text"] == "samesame"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    n = 20_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('<|im_end|> ', id, ' ä') AS text")
    chats = chat.format_chats(df)
    (r,) = chat.parse_chats(chats).collect()
    assert len(r["turns"]) == n
    assert r["loss_text"] == "".join(f"<|im_end|> {k} ä" for k in range(1, n, 2))
    formatted, spans = chats.select("formatted", "loss_spans").first()
    took = []
    for part in (n // 8, n):
        text = chat.STOP.join(formatted.split(chat.STOP)[: part + 1])
        began = time.process_time()
        chat.read_chat(text, [tuple(s) for s in spans[: part // 2]])
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.002)  # eight times the turns; what looks back takes sixty-four times as long


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7},
        {"instruction": "q", "input": None, "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a", "extra": {"x": 1}},
        {"unknown": 1},
        [1],
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(7, None), (8, "{")]
    got = {}
    for r in chat.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string")).collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for k in range(5):
        assert got[k] == [("user", "q"), ("assistant", "a")]
    for k in (5, 6, 7, 8):
        assert got[k] == [(None, None)]


def test_clashing_and_empty_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}], "prompt": "z", "system": "s"},
        {"prompt": "q", "response": "a", "input": "z", "text": "t"},
        {"role": "user", "text": "q", "prompt": "z"},
        {"messages": []},
        {"messages": [], "prompt": "q", "completion": "a"},
        {"messages": "no list", "output": 1},
    ]
    rows = list(enumerate(map(json.dumps, records)))
    got = {}
    for r in chat.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string")).collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["turn"], r["role"], r["text"]))
    assert got[0] == [("messages", 0, "user", "q")]
    assert got[1] == [("response", 0, "user", "q"), ("response", 1, "assistant", "a")]
    assert got[2] == [("rows", 0, "user", "q")]
    assert got[3] == [("messages", None, None, None)]
    assert got[4] == [("prompt", 0, "user", "q"), ("prompt", 1, "assistant", "a")]
    assert got[5] == [(None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", "q", "z", "key")], "conv_id long, turn long, role string, text string, prompt string, key string")
    assert [tuple(r) for r in chat.canonical_turns(df).collect()] == [(1, 0, "user", "q")]


def test_tables_by_fingerprint(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "")]
    df = spark.createDataFrame([(1, "i", "x", "o")], "conv_id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()] == [(1, 0, "user", "i\n\nx"), (1, 1, "assistant", "o")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, z long"))


def test_mappings_are_distinct():
    assert len(chat.KNOWN) == len(chat.MAPPINGS)
