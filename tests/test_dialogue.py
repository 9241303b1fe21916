"""Pairing and records against the state machine in plain Python and the hand-written cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from dialoom import schemas
from dialoom.functions import PY_WHITESPACE, py_strip
from dialoom.operators import dialogue

T0 = datetime.datetime(2024, 1, 1)

CASES = {
    1: [("user", "Q1"), ("assistant", "A1"), ("user", "Q2"), ("assistant", "A2")],
    2: [("user", "Q1"), ("user", "Q2"), ("assistant", "A1")],
    3: [("user", "Q1"), ("assistant", "A1"), ("assistant", "A2")],
    4: [("assistant", "A0"), ("user", "Q1")],
    5: [("system", "S"), ("user", "Q1"), ("system", "S"), ("assistant", "A1")],
    6: [("user", ""), ("assistant", "A1")],
    7: [("user", None), ("assistant", "A1")],
    8: [("user", "Q1"), ("assistant", None)],
    10: [("human", "Q1"), ("gpt", "A1")],
    11: [("user", "Q1"), ("user", ""), ("assistant", "A1")],
    12: [("user", None), ("assistant", "A1"), ("assistant", "A2")],
}


def state_machine(turns, keep_empty=True):
    question, out = None, []
    for n, (role, content) in enumerate(turns):
        if role in ("user", "human"):
            question = content
        elif role in ("assistant", "gpt") and question is not None and (keep_empty or question != ""):
            out.append((n, question, content))
            question = None
    return out


def table(spark, dialogues, repeat=False):
    rows, k = [], 0
    for c, turns in dialogues.items():
        for n, (role, content) in enumerate(turns):
            rows.append((k, c, n, role, content, 1, T0, T0 + datetime.timedelta(seconds=k)))
            k += 1
    if repeat:
        late = T0 + datetime.timedelta(days=9)
        rows += [(k + i, *r[1:7], late) for i, r in enumerate(rows[::3])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schemas.CONVERSATIONS)


def pairs(df):
    return sorted((r.conv_id, r.turn, r.question, r.answer is None, r.answer or "") for r in df.collect())


def expected(dialogues, keep=True):
    return sorted((c, n, q, a is None, a or "") for c, ts in dialogues.items() for n, q, a in state_machine(ts, keep))


@pytest.mark.parametrize("keep", [True, False])
def test_cases(spark, keep):
    assert pairs(dialogue.qa_turns(table(spark, CASES, repeat=True), keep)) == expected(CASES, keep)


def test_sample_ids(spark):
    ids = {r.id for r in dialogue.with_sample_id(dialogue.qa_turns(table(spark, CASES))).select("id").collect()}
    assert ids == {"1_0", "1_1", "2_2", "3_3", "5_4", "6_5", "8_6", "10_7", "11_8"}


@pytest.mark.parametrize("block", [5, 65_536])
def test_samples_need_no_texts_for_their_ids(spark, monkeypatch, block):
    monkeypatch.setattr(dialogue, "BLOCK", block)
    r = random.Random(5)
    dialogues = {c: [(r.choice(["user", "gpt", "system", None]), r.choice(["x", "", None])) for _ in range(r.randint(1, 40))] for c in range(-20, 60)}
    flat = table(spark, dialogues, repeat=True)
    for keep in (True, False):
        want = {(x.conv_id, x.turn): x.id for x in dialogue.with_sample_id(dialogue.qa_turns(flat, keep)).collect()}
        assert {(x.conv_id, x.turn): x.id for x in dialogue.samples(flat, keep, texts=False).collect()} == want
        rows = dialogue.samples(flat, keep).collect()
        assert {(x.conv_id, x.turn): x.id for x in rows} == want
        assert pairs(dialogue.samples(flat, keep)) == pairs(dialogue.qa_turns(flat, keep))
        assert [int(want[k].rpartition("_")[2]) for k in sorted(want)] == list(range(len(want)))


@pytest.mark.parametrize("keep", [True, False])
def test_random_dialogues(spark, keep):
    r = random.Random(7)
    dialogues = {c: [(r.choice(["user", "human", "assistant", "gpt", "system", "tool", None]), r.choice(["x", "", None, "y"])) for _ in range(r.randint(1, 12))] for c in range(400)}
    flat = table(spark, dialogues, repeat=True)
    assert pairs(dialogue.qa_turns(flat, keep)) == expected(dialogues, keep)
    nested = spark.createDataFrame([(c, [{"role": x, "content": y} for x, y in ts]) for c, ts in dialogues.items()], "id bigint, conversations array<struct<role:string,content:string>>")
    assert pairs(dialogue.qa_pairs_nested(nested, keep_empty_question=keep)) == expected(dialogues, keep)


def test_long_dialogues_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "BLOCK", 5)
    r = random.Random(3)
    dialogues = {c: [(r.choice(["user", "assistant", "system", None]), r.choice(["x", "", None])) for _ in range(r.randint(1, 60))] for c in range(60)}
    assert pairs(dialogue.qa_turns(table(spark, dialogues, repeat=True))) == expected(dialogues)


def test_empty_and_null_keys(spark):
    empty = spark.createDataFrame([], schemas.CONVERSATIONS)
    assert dialogue.qa_turns(empty).count() == 0
    rows = [(1, None, 0, "user", "q", 1, T0, T0), (2, 1, None, "gpt", "a", 1, T0, T0)]
    assert dialogue.qa_turns(spark.createDataFrame(rows, schemas.CONVERSATIONS)).count() == 0


def test_both_dialects_nested(spark):
    df = spark.createDataFrame([(1, [("user", "q", None, None), (None, None, "gpt", "a")])], "id bigint, conversations array<struct<role:string,content:string,`from`:string,value:string>>")
    assert pairs(dialogue.qa_pairs_nested(df)) == [(1, 1, "q", False, "a")]


def test_message_form_round_trip(spark):
    samples = dialogue.with_sample_id(dialogue.qa_turns(table(spark, CASES)))
    via = dialogue.messages_to_records(dialogue.message_records(samples))
    direct = dialogue.training_records(samples)
    assert sorted(map(str, via.collect())) == sorted(map(str, direct.collect()))


def test_strip_like_python(spark):
    texts = [f"{c}x y{c}" for c in PY_WHITESPACE] + [PY_WHITESPACE, "", "x"]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", py_strip("t").alias("s")).orderBy("i").collect()]
    assert len(PY_WHITESPACE) == 29 and got == [t.strip() for t in texts]


def test_first_of_and_empty_records(spark):
    df = spark.createDataFrame([(1, [("gpt", "a")]), (2, []), (3, None)], "id int, conversations array<struct<`from`:string,value:string>>")
    got = {r.id: (r.q, r.a) for r in df.select("id", dialogue.first_of("human").alias("q"), dialogue.first_of("gpt").alias("a")).collect()}
    assert got == {1: ("", "a"), 2: ("", ""), 3: ("", "")}
    assert dialogue.with_dialogue(df).count() == 1
    assert dialogue.with_image(df.withColumn("image_ok", F.col("id") == 2)).count() == 1
