import itertools
import random
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from boxmill.llm import turn_repair
from boxmill.llm.turn_repair import cheapest_edits, damaged, repair_turns

SPACES = " \t\n\x0b\x0c\r"


def plain_edits(initials, faults):
    """All repairs, each target length on its own, without tables or bands: the least (cost, audit)."""
    n = len(initials)
    fixed = {f: c for f, c in (("t", 5), (".", 0))}

    def aligned(target):
        @lru_cache(None)
        def rest(i, j):
            if i == n and j == len(target):
                return 0, ""
            out = []
            if i < n:
                c, a = rest(i + 1, j)
                out.append((c + 2, "D" + a))
            if j < len(target) and target[j] != "s":
                c, a = rest(i, j + 1)
                out.append((c + 5, "I" + a))
            if i < n and j < len(target) and faults[i] in fixed:
                c, a = rest(i + 1, j + 1)
                if initials[i] == target[j]:
                    out.append((c + fixed[faults[i]], "K" + a))
                elif target[j] != "s":
                    out.append((c + 1 + fixed[faults[i]], "R" + a))
            return min(out, default=(10**9, ""))

        return rest(0, 0)

    return min(aligned("s" * (m & 1) + "ua" * (m // 2)) for m in range(n + n // 2 + 3) if m != 1)


def test_all_short_conversations():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("b.t", repeat=n):
                assert cheapest_edits("".join(initials), "".join(faults)) == plain_edits(initials, faults), (initials, faults)


@pytest.mark.parametrize("cells", [1 << 20, 0])
def test_longer_conversations(monkeypatch, cells):
    """Also with rows of the table worked out anew on the way back."""
    monkeypatch.setattr(turn_repair, "_CELLS", cells)
    rnd = random.Random(12)
    for k in range(200):
        n = rnd.randint(5, 24)
        initials = "".join(rnd.choices("suax", (1, 6, 6, 1), k=n)) if k % 2 else ("s" + "ua" * n)[:n]
        faults = "".join(rnd.choices("bd.t", (1, 1, 12, rnd.choice([0, 2, 9])), k=n))
        if k % 2 == 0:
            at = rnd.randrange(n)
            initials = (initials[:at] + initials[at + rnd.randint(1, 2) :] + "uaua")[:n]
        assert cheapest_edits(initials, faults) == plain_edits(initials, faults), (initials, faults)


def test_a_very_long_conversation():
    n = 30_000
    initials = ("s" + "ua" * n)[:n]
    initials = initials[:5_000] + initials[5_001:20_000] + "a" + initials[20_000:]
    cost, audit = cheapest_edits(initials, "." * len(initials))
    # One of the two neighbours without a turn between them goes, one of the doubled answers, and the last turn, which has no answer.
    assert cost == 6 and audit.count("D") == 3 and audit.count("K") == n - 3 and len(audit) == n


def plain(rows):
    """rows of one conversation, after damage: everything that the query returns of it."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), ""
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = plain_edits(tuple(initials), faults)
    out, i, m = [], 0, sum(e != "D" for e in audit)
    target = "s" * (m & 1) + "ua" * (m // 2)
    for edit in audit:
        role = {"u": "user", "a": "assistant"}.get(target[len(out)] if edit in "RI" else "")
        if edit == "K":
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif edit == "R":
            out.append(f"{role}:{rows[i][2]}")
        elif edit == "I":
            out.append(f"{role}:")
        i += edit != "I"
    numbers = {r[0] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, "\n".join(out)


def plain_damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 1:
        text = ""
    if kind == 2:
        text = text.translate(dict.fromkeys(map(ord, ".!?")))
    if kind == 4:
        role = "user"
    return [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def found(df):
    return {r.conv_id: (*r[1:8], "\n".join(f"{t.role}:{t.text}" for t in r.repaired)) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(13)
    texts = ["Yes.", "No!", "what?  \n", "cut off", "", " \t", "\xa0", None, "Yes.", "é!"]
    rows = []
    for conv in [None, *range(250)]:
        for turn in rnd.sample([None, *range(12)], rnd.randint(1, 9)):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]), rnd.choice(texts)))
    rows += rnd.sample(rows, 40)
    df = spark.createDataFrame([(*r, 1, "rows") for r in rows], "conv_id long, turn long, role string, text string, rows int, times string").repartition(5)
    want, as_is = {}, {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).extend(plain_damage(conv, turn, role, text))
        as_is.setdefault(conv, []).append((turn, role, text))
    assert found(repair_turns(damaged(df), "times")) == {c: plain(r) for c, r in want.items()}
    assert found(repair_turns(df)) == {c: plain(r) for c, r in as_is.items()}
    assert any(not r for r in want.values())


def test_empty_tables_and_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair_turns(spark.createDataFrame([], schema)).count() == 0
    assert damaged(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y." * 10)]
    (row,) = repair_turns(spark.createDataFrame(rows, schema)).collect()
    assert row.audit == "KK" and len(row.repaired[0].text) == 3_000_001
    assert sha256(b"").hexdigest()[:4] == "e3b0"
