import random
import re
from functools import lru_cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from boxmill.llm import secret_scan
from boxmill.llm.secret_scan import GuessCosts, base_spans, context_values, dictionary, op13_secret_scan, scan_secrets, secret_spans, without_secrets

WORDS = {"correct": 9.0, "horse": 8.0, "battery": 10.0, "staple": 11.0, "the": 2.0, "and": 3.0, "été": 6.0}
COSTS = GuessCosts(WORDS)


def segment_bits(s):
    """The least cost of s as one segment, each kind tried on the whole of it."""
    out = [sum(map(secret_scan.char_bits, s))]
    word = COSTS.word_bits(s, secret_scan._low(s)) if 3 <= len(s) <= 24 else None
    out += [word] if word is not None else []
    out += [bits for form, lengths, bits in secret_scan._DATES if len(s) in lengths and form.fullmatch(s)]
    steps = [secret_scan.key_step(a, b) for a, b in zip(s, s[1:])]
    if len(s) > 2 and all(steps):
        out.append(secret_scan.WALK + secret_scan.TURN * sum(a != b for a, b in zip(steps, steps[1:])))
    for p in range(1, min(16, len(s) // 2) + 1):
        if len(s) % p == 0 and s == s[:p] * (len(s) // p):
            out.append(plain_bits(s[:p]) + secret_scan.REPEAT)
    return min(out)


def plain_bits(value):
    @lru_cache(None)
    def best(i):
        return min((best(j) + segment_bits(value[j:i]) + secret_scan.SEGMENT for j in range(i)), default=0.0)

    return best(len(value))


@pytest.mark.parametrize("pieces", [["correct", "Horse", "b4ttery", "the", "x", "Q", "9", "-", "é", "ÉTÉ"], ["qwerty", "asdf", "1qaz", "zxcv", "!@#", "a"], ["1999", "2024-05-17", "17.5.24", "0517", "12", "/"], ["ab", "abc", "a", "1", "aa", "correct"]])
def test_least_cost_of_all_segmentations(pieces):
    rnd = random.Random(len(pieces))
    for _ in range(150):
        value = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 5)))[:18]
        assert COSTS.cost(value) == pytest.approx(plain_bits(value)), value


def test_costs_of_usual_values():
    costs = {v: COSTS.cost(v) for v in ["password", "P4ssword1", "changeme123", "qwertyuiop", "1q2w3e4r", "2024-05-17", "aaaaaaaaaaaaaaaaaaaaaaaa", "your-api-key-here", "CorrectHorse!", "x" * 5000]}
    assert all(c < secret_scan.GUESS_BITS for c in costs.values()), costs
    hard = {v: COSTS.cost(v) for v in ["tQ7#vLp2!xZ", "f3b1c09a77", "kR9vPw2mXs", "hvs.Zk3Lq8Wn"]}
    assert all(c >= secret_scan.GUESS_BITS for c in hard.values()), hard


def plain_base(text):
    """The fixed patterns by hand: the first place at which a kind's form can start, as far as it goes, then on from its end."""
    found, low = [], text.translate({c: c + 32 for c in range(65, 91)})
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(i, allowed):
        while i < len(text) and text[i] in allowed:
            i += 1
        return i

    i = 0
    while i < len(text):
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(w, i)), None)
        if word:
            j = i + len(word)
            j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
            j = run(j, " ")
            if text[j : j + 1] in (":", "=") and j < len(text):
                # A quote, spaces and a value; the value can't begin with a space or quote.
                j = run(j + 1, " ")
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                end = run(j, value)
                if end > j:
                    if end - j >= 12:
                        found.append((i, 0, end))
                    i = end
                    continue
        i += 1
    for kind, head, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), (2, "", "0123456789abcdef", 16)):
        i = 0
        while i < len(text):
            end = run(i + len(head), allowed)
            if text.startswith(head, i) and end > i + len(head):
                if end - i >= least:
                    found.append((i, kind, end))
                i = end
            else:
                i += 1
    return sorted(found)


PIECES = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "AKIAABCDEFGHIJ", "0123456789abcdef", "deadbeef", "A1b2", "x.y/z", "\n", "é🙂", "ſecret", "toKen", "is", "correct"]


def test_base_spans_by_hand():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14)))
        assert base_spans(text) == plain_base(text), text


def test_base_spans_stay_and_values_are_not_covered_twice():
    rnd = random.Random(4)
    for _ in range(2000):
        text = "".join(rnd.choice([*PIECES, "pwd", "kR9vPw2mXs!", "tQ7#vLp2!xZ"]) for _ in range(rnd.randint(0, 14)))
        spans = secret_spans(text, COSTS)
        base = base_spans(text)
        assert [s[:3] for s in spans if s[1] < 3] == base
        want = {(a, b) for a, b in context_values(text) if not any(x <= a and b <= y for x, _, y in base) and COSTS.cost(text[a:b]) >= secret_scan.GUESS_BITS}
        assert {(s[0], s[2]) for s in spans if s[1] == 3} == want


#: Lines written by hand, with the value that is a secret, if there is one.
LINES = [
    ("db.password: kR9vPw2mXs", "kR9vPw2mXs"),
    ("The wifi password is tQ7#vLp2!xZ.", "tQ7#vLp2!xZ"),
    ('DB_PWD="s8#Lk!02x"', "s8#Lk!02x"),
    ("Authorization: Bearer 8fKq2.Zx9Lw~1", "8fKq2.Zx9Lw~1"),
    ("access key = 'Qm7Zp4Xk9B'", "Qm7Zp4Xk9B"),
    ("passphrase: `zebra9#Kfw-ostrich7%Lq`", "zebra9#Kfw-ostrich7%Lq"),
    ("private-key=>9xQ2mLp0Vz", "9xQ2mLp0Vz"),
    ("The password is the correct one.", None),
    ("token: correct", None),
    ("password = changeme", None),
    ('"secret": "your-secret-here"', None),
    ("tokens: 512", None),
    ("pass: 1999-12-31", None),
    ("a compass: N47 and a bypass is there", None),
    ("pwd=qwertyuiop", None),
    ("password: ********************", None),
    ("author: kR9vPw2mXs", None),
]


def test_lines_by_hand():
    for line, secret in LINES:
        got = [line[a:b] for a, k, b, _ in secret_spans(line, COSTS) if k == 3]
        assert got == ([secret] if secret else []), line


def test_dictionary_holds_frequent_words_and_no_secrets(spark):
    texts = ["the horse and the battery"] * 50 + ["password: zqxjkvbw the end"] * 500 + ["Été und été"] * 20 + [f"rare{chr(97 + k)} x" for k in range(20)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    words = dictionary(docs)
    assert "zqxjkvbw" not in words and {"the", "horse", "été", "end", "rareb"} <= set(words) and "x" not in words
    assert words["the"] <= words["end"] <= words["horse"] <= words["rareb"]
    assert set(dictionary(docs, words=4)) <= {"the", "end", "and", "horse", "battery"} and len(dictionary(docs, words=4)) <= 4
    assert dictionary(spark.createDataFrame([], "text string")) == {} and dictionary(docs, words=0) == {}


def test_spans_and_redaction(spark):
    rows = [(i, f"é🙂 {line}\n{line} tail") for i, (line, _) in enumerate(LINES)] + [(None, "token=0123456789abcdef0123"), (50, None), (51, ""), (52, "AKIA" + "Q" * 16), (52, "AKIA" + "Q" * 16)]
    docs = spark.createDataFrame([(*r, "spans", 0) for r in rows], "doc_id long, text string, spans string, start int").repartition(3)
    got = scan_secrets(docs, WORDS).collect()
    want = sorted((str(i), [(secret_scan.KINDS[k], a, b) for a, k, b, _ in secret_spans(t or "", COSTS)]) for i, t in rows)
    assert sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in got) == want
    assert scan_secrets(docs.limit(0), WORDS).count() == 0
    clean = docs.join(scan_secrets(docs, WORDS).toDF("id", "found"), F.col("doc_id") == F.col("id")).select("doc_id", without_secrets(F.col("text"), F.col("found")).alias("c"))
    texts = {r.doc_id: r.c for r in clean.collect()}
    assert texts[0] == "é🙂 db.[secret]\ndb.[secret] tail" or texts[0] == "é🙂 db.password: [secret]\ndb.password: [secret] tail"
    assert texts[7] == rows[7][1] and texts[52] == "[secret]"


def test_very_long_values_and_texts():
    rnd = random.Random(5)
    value = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz#!", k=200_000))
    assert [s[1:3] for s in secret_spans(f"pwd: {value}", COSTS)] == [(3, 200_005)]
    assert len(base_spans("password " * 100_000 + "=" + "a1" * 100)) == 2
    assert secret_spans("pass" * 100_000, COSTS) == [] and secret_spans('token="' * 50_000, COSTS) is not None


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice([*PIECES, *(x for x, _ in LINES)]) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(80, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    costs = GuessCosts(dictionary(docs))
    for r in op13_secret_scan(spark, str(tmp_path)).collect():
        text = rows[r.doc_id][1] or ""
        base = plain_base(text)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in range(3))
        assert r.base_sha256 == sha256(shown.encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert ",".join(":".join(s) for s in spans if s[0] != "value") == shown
        values = [(int(a), int(b)) for k, a, b in spans if k == "value"]
        assert values == [(a, b) for a, k, b, _ in secret_spans(text, costs) if k == 3]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), ("assign", "access", "hex", "value").index(s[0])))
    assert re.fullmatch("[0-9a-f]{64}", r.base_sha256)
