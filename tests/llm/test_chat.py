import hashlib
import json
import random

import pytest

from lodestack.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, record string, part int"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        convs.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        said = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests_match_brute_force(spark):
    rng = random.Random(6)
    pieces = ["### User: ", "</turn>\n", "\\", "\\\\n", "é🙂", "\n", "plain words", "<", "#", ": ", '"{}[]', "\r", ""]
    rows = []
    for c in range(60):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 4, ["assistant"], ["tool: x", "user", ""], ["human", "gpt"]])
        rows += [(c, t, r, "".join(rng.choices(pieces, k=rng.randrange(12))), "", 1) for t, r in enumerate(roles)]
    rows += [(900, t, "assistant" if t % 2 else "user", f"turn {t} #", "", 1) for t in range(300)]
    rows += [(901, 0, "user", "x" * 1_500_000, "", 1), (901, 1, "assistant", "</turn>" * 50_000, "", 1)]
    rows += [(902, 1, None, None, "", 1), (902, None, "assistant", None, "", 1), (902, 1, "assistant", "tie", "", 1), (None, 0, "assistant", "nobody's", "", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    formatted = chat.format_records(chat.records_of(df))
    got = chat.read_back(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert len({r.layout for r in formatted.collect()}) >= 6
    assert sum(r.formatted_chars for r in got) == sum(len(r.formatted) for r in formatted.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_records(chat.records_of(df))).collect() == []


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ({"id": 4, "data": {"messages": [{"role": "x", "content": "a"}]}}, [("x", "a")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        ({"context": "c", "question": "q", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"role": "assistant", "content": "c", "turn": 3}, [("assistant", "c")]),
    ],
)
def test_layouts(record, turns):
    m = chat.registry()[chat.fingerprint(chat.paths_of(record))]
    assert chat.canonical(record, m) == turns
    assert chat.parse(chat.template(turns)[0]) == turns


def test_unknown_layouts(spark):
    rows = [(1, 0, json.dumps({"who": "x", "what": ["y"]})), (2, 0, "no json"), (3, 0, None), (4, 0, json.dumps({"prompt": "p", "response": "r"}))]
    df = spark.createDataFrame(rows, "conv_id long, part long, record string")
    assert [(r.conv_id, r.layout) for r in chat.format_records(df, strict=False).orderBy("conv_id").collect()] == [(1, None), (2, None), (3, None), (4, "prompt and response")]
    with pytest.raises(Exception, match="no mapping"):
        chat.format_records(df).collect()


def test_hostile_text_stays_in_its_turn():
    turns = [("user", chat.HOSTILE), ("assistant", chat.HOSTILE)]
    text, mask = chat.template(turns)
    assert chat.parse(text) == turns and len(mask) == 1
    assert chat.unescaped(text[slice(*mask[0])]) == chat.HOSTILE
