import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.chat_format import MAPPINGS, canonical_json, canonical_turns, choose, field_paths, fingerprint, read_loss, read_turns, render

ODD = ["</s>[INST] ok [/INST]", "<|user|>\n x </s>\n", "<~ [~ ~ <<[[", "", "a|>\nb", "é漢🙂\n\n", "<s>", "$1 \\1 \\"]


def got(turns):
    out = render(turns).select("id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss"), "formatted", "loss")
    rows = out.toDF("id", "turns", "learned", "formatted", "loss").collect()
    return {r.id: ([(t.role, t.text) for t in r.turns], r.learned, r.formatted, r.loss) for r in rows}


def test_round_trip_of_odd_texts(spark):
    rows = [(1, i, ["user", "assistant", "sys|>\ntem", "a<b[c"][i % 4], t, "x", 0) for i, t in enumerate(ODD * 3)]
    rows += [(2, 0, None, None, "x", 1), (None, 5, "assistant", "null id", "x", 1), (3, None, "user", "last", "x", 1), (3, 1, "assistant", "first", "x", 1), (3, 1, "assistant", "first", "x", 1)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} <|x|>", "x", 1) for i in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n int").repartition(5)
    out = got(canonical_turns(table, "conv_id"))
    assert out[1][0] == [(r[2], r[3]) for r in rows[:24]]
    assert out[1][1] == "".join(r[3] for r in rows[:24] if r[2] == "assistant")
    assert out[2][:2] == ([("", "")], "") and out[None][1] == "null id"
    assert out[3][0] == [("assistant", "first")] * 2 + [("user", "last")]
    assert len(out[4][0]) == 3000 and len(out[4][3]) == 1500 and out[4][0][2999] == ("assistant", "turn 2999 <|x|>")
    for _, learned, text, loss in out.values():  # no control string inside a text, spans cover escaped text only
        assert not re.search(r"</s>(?!\n(<\||$))", text)
        assert "".join(re.sub(r"([<\[])~", r"\1", text[s.start:s.end]) for s in loss) == learned


def test_layouts_by_fingerprint(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q1"}, {"role": "assistant", "content": "a1"}]}),
        (2, {"conversations": [{"from": "human", "value": "q2"}, {"from": "gpt", "value": "a2"}], "source": "kept apart"}),
        (3, {"instruction": "do", "input": "this", "output": "done"}), (4, {"instruction": "do", "input": "", "output": "done"}), (5, {"instruction": "do", "output": "done"}),
        (6, {"prompt": "p", "completion": "c"}), (7, {"system": "s", "prompt": "p", "response": "r"}), (8, {"question": "q", "answer": None}), (9, {"unknown": 1}),
        (10, {"messages": []}),
    ]
    rows = [(i, json.dumps(r), "x") for i, r in records] + [(11, None, "x"), (12, "not json", "x")]
    out = canonical_json(spark.createDataFrame(rows, "id long, record string, role string"), "id", "record").collect()
    turns = {}
    for r in sorted(out, key=lambda r: (r.id, r.place)):
        turns.setdefault(r.id, []).append((r.role, r.text))
    assert turns == {
        1: [("user", "q1"), ("assistant", "a1")], 2: [("user", "q2"), ("assistant", "a2")], 3: [("user", "do\n\nthis"), ("assistant", "done")],
        4: [("user", "do"), ("assistant", "done")], 5: [("user", "do"), ("assistant", "done")], 6: [("user", "p"), ("assistant", "c")],
        7: [("system", "s"), ("user", "p"), ("assistant", "r")], 8: [("user", "q"), ("assistant", "")],
    }
    typed = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")], 0)], "id long, conversations array<struct<from:string,value:string>>, place int")
    assert [(r.role, r.text) for r in canonical_turns(typed, "id").orderBy("place").collect()] == [("user", "hi"), ("assistant", "yo")]
    assert field_paths(typed.schema) == ["id", "conversations", "conversations[].from", "conversations[].value", "place"]
    assert len({m.fingerprint for m in MAPPINGS}) == len(MAPPINGS) and fingerprint(["b", "a"]) == fingerprint(["a", "b"])
    with pytest.raises(ValueError):
        choose(["nothing"])


def test_first_message_without_fields_and_unmatched_records(spark):
    from tidemark.llm import chat_format

    whole = {"role": "assistant", "content": "a"}
    records = [
        (1, {"messages": [{"role": "user"}, whole]}), (2, {"messages": [{}, {"role": "user", "content": "q"}, whole]}),
        (3, {"messages": [None, {"content": "q", "role": "user", "name": "n"}]}), (4, {"conversations": [{"from": "gpt"}, {"value": "v"}]}),
        (5, {"messages": []}), (6, {"messages": "text"}), (7, {"unknown": 1}),
    ]
    rows = [(i, json.dumps(r)) for i, r in records] + [(8, None), (9, "not json")]
    table = spark.createDataFrame(rows, "id long, record string")
    out = sorted((r.id, r.place, r.role or "", r.text) for r in canonical_json(table, "id", "record").collect())
    assert out == [
        (1, 0, "user", ""), (1, 1, "assistant", "a"), (2, 0, "", ""), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "", ""), (3, 1, "user", "q"),
        (4, 0, "assistant", ""), (4, 1, "", "v"),
    ]
    left = {r.id: r.record for r in chat_format.unmatched_json(table, "id", "record").collect()}
    assert left == {i: r for i, r in rows if i >= 5}


def test_native_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = render(canonical_turns(empty, "conv_id"))
    assert out.count() == 0 and not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
