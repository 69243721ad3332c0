import hashlib
import random

from pyspark.sql import functions as F

from boxmill.llm.chat_format import TEMPLATE, escape, format_conversations, read_back, unescape

PIECES = ["<", "[", "\\", "s>", "/s>", "</s>", "[INST]", "[/INST]", "INST]", "[SYS]", "[ROLE]", "x", "\n", " ", "é", "[\\INST]", "<s>"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_escapes_are_reversible_and_leave_no_mark(spark):
    df = spark.createDataFrame([(t,) for t in texts(3000, 9)], "t string").withColumn("e", escape(F.col("t"))).withColumn("u", unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not any(m in r.e for m in TEMPLATE.marks)


def plain_state(roles):
    state = "start"
    for role in roles:
        state = TEMPLATE.turns.get(state, {}).get(role, "broken")
    return state in TEMPLATE.ends


def test_read_back_and_loss(spark):
    rnd = random.Random(10)
    roles = ["user", "assistant", "system", "tool", "", "[/ROLE]", None]
    rows, pool = [], texts(2000, 11)
    for conv in range(150):
        usual = rnd.random() < 0.5
        for turn in range(rnd.randint(1, 8)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2] if usual else rnd.choice(roles), rnd.choice([*pool, None])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = format_conversations(df).withColumn("back", read_back(F.col("formatted"))).collect()
    assert len(got) == 150
    for r in got:
        own = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(b) for b in r.back] == own
        assert "".join(s.text for s in r.segments) == r.formatted
        assert len([s for s in r.segments if s.loss]) == sum(role == "assistant" for role, _ in own)
        assert r.valid == plain_state([role for role, _ in own])


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, rows int"
    rows = [(1, 2, "user", "b", 0), (1, None, "user", "a", 0), (1, 2, "user", "b", 0), (None, 0, "user", "c", 0), (2, 0, "assistant", "y" * 100_000, 0)]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].formatted == "[INST]a</s>[INST]b</s>[INST]b</s>" and not got[1].valid
    assert got[None].formatted == "[INST]c</s>" and len(got[2].formatted) == 100_000 + 11
    assert format_conversations(spark.createDataFrame([], schema)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
