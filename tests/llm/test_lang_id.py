import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxmill.llm import lang_id
from boxmill.llm.arrow_text import mix
from boxmill.llm.lang_id import UNKNOWN, held_out, identify, known_languages, train, viterbi


def words(rnd, syllables, n):
    return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))


LANGS = {"aa": ["ba", "ko", "ti", "re"], "bb": ["sch", "ung", "ei", "ß"], "cc": ["при", "вет", "ми", "ро"]}


def corpus(n, seed):
    rnd = random.Random(seed)
    return [(i, words(rnd, LANGS[lang], rnd.choice([3, 30, 200])), lang) for i in range(n) for lang in [rnd.choice(list(LANGS))]]


def plain_viterbi(emit, penalty):
    n, k = emit.shape
    best, back = emit[0].copy(), []
    for t in range(1, n):
        way = best[None, :] - penalty * (1 - np.eye(k))
        back.append(way.argmax(axis=1))
        best = way.max(axis=1) + emit[t]
    score, path = best.max(), [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return score, path[::-1]


def test_viterbi_against_a_loop():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 30, 50)
    first = np.concatenate([[0], np.cumsum(lengths)])
    emit = -rng.exponential(3, (first[-1], 4)).astype(np.float32)
    labels = viterbi(emit, first, 4.0)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            score, _ = plain_viterbi(emit[a:b].astype(float), 4.0)
            path = labels[a:b]
            own = emit[np.arange(a, b), path].astype(float).sum() - 4.0 * (np.diff(path) != 0).sum()
            assert abs(own - score) < 1e-3


def test_held_out_accuracy_and_spans(spark):
    docs = spark.createDataFrame(corpus(400, 2), "doc_id long, text string, lang string")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model).join(docs, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(found) > 40 and np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    rnd = random.Random(3)
    a, b = words(rnd, LANGS["aa"], 12), words(rnd, LANGS["bb"], 20)
    (r,) = identify(spark.createDataFrame([(1, f"{a}. {b}!")], "doc_id long, text string"), model).collect()
    assert [(s.start, s.end, s.lang) for s in r.spans] == [(0, len(a), "aa"), (len(a) + 2, len(a) + 2 + len(b), "bb")]
    assert r.lang_pred == "bb" and 0.5 < r.score < 1


def test_odd_rows(spark):
    model = train(spark.createDataFrame(corpus(60, 4), "doc_id long, text string, lang string"))
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !? \n", "x"), (4, "שלום", "x"), (5, "прив" * 100_000, "x"), (None, "baba koko", "x"), (5, "baba", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 3), r.n_spans) for r in identify(docs, model).collect())
    assert got == [(0, "aa", 1.0, 1), (1, UNKNOWN, 0.0, 0), (2, UNKNOWN, 0.0, 0), (3, UNKNOWN, 0.0, 0), (4, "aa", 0.0, 1), (5, "aa", 1.0, 1), (5, "cc", 1.0, 1)]
    assert sorted(r.doc_id or 0 for r in known_languages(docs, model, 0.5).collect()) == [0, 5, 5]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(empty, train(empty)).count() == 0
    assert {r.lang_pred for r in identify(docs, train(empty)).collect()} == {UNKNOWN}
    assert known_languages(docs, train(empty), 0.5).count() == len(rows)


def test_too_many_values_of_lang(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="4 values of lang"):
        train(docs)


def plain_model(rows):
    """Trigrams and scripts by dictionaries: {lang: ({bucket: n}, {script: letters})}."""
    _, script_of = lang_id._tables()
    sums = {}
    for _, text, lang in rows:
        grams, scripts = sums.setdefault(lang, (Counter(), Counter()))
        for word in plain_words(text):
            padded = [0, *word, 0]
            for a, b, c in zip(padded, word, padded[2:]):
                grams[bucket(a, b, c)] += 1
            scripts[int(script_of[word[0]])] += len(word)
    return sums


def plain_words(text):
    letter_of, _ = lang_id._tables()
    words, own = [], []
    for c in [*text, " "]:
        if low := int(letter_of[ord(c)]):
            own.append(low)
        elif own:
            words.append(own)
            own = []
    return words


def bucket(a, b, c):
    return int(mix(np.array([a << 42 | b << 21 | c], np.uint64))[0] >> np.uint64(48))


def test_scores_scripts_and_shares_against_a_loop(spark):
    """Trigram counts, the scripts that narrow candidates, word scores and the shares of letters, each by plain loops."""
    rows = [(i, text.lower(), lang) for i, text, lang in corpus(40, 6)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    sums = plain_model(rows)
    assert model.langs == sorted(sums)
    for k, lang in enumerate(model.langs):
        grams, scripts = sums[lang]
        total = sum(grams.values()) + lang_id.ALPHA * lang_id.BUCKETS
        some = list(grams)[:50] + [1, 2, 3]
        assert np.allclose(model.log_p[some, k], [math.log((grams[b] + lang_id.ALPHA) / total) for b in some], atol=1e-5)
        letters = sum(scripts.values())
        assert [bool(x) for x in model.uses[:, k]] == [scripts[s] >= lang_id.SCRIPT_SHARE * letters for s in range(lang_id.N_SCRIPTS)]
    texts = ["bako tire", "schung ei привет ba", "привет миро 12 baba", "שלום ko"]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    _, script_of = lang_id._tables()
    for i, text in enumerate(texts):
        words, emit, usable = plain_words(text), [], []
        for word in words:
            padded, may = [0, *word, 0], [bool(model.uses[int(script_of[word[0]]), k]) for k in range(len(model.langs))]
            score = [sum(float(model.log_p[bucket(a, b, c), k]) for a, b, c in zip(padded, word, padded[2:])) if may[k] else -1e30 for k in range(len(model.langs))]
            emit.append([x - max(score) for x in score] if any(may) else [0.0] * len(score))
            usable.append(any(may))
        _, path = plain_viterbi(np.array(emit), lang_id.SWITCH)
        share = [sum(len(w) for w, k, u in zip(words, path, usable, strict=True) if k == lang and u) / sum(map(len, words)) for lang in range(len(model.langs))]
        assert got[i].lang_pred == model.langs[int(np.argmax(share))] and abs(got[i].score - max(share)) < 1e-6


def test_as_many_languages_as_there_may_be(spark, monkeypatch):
    """A row of each of 256 languages: the driver gets 256 KB for each, and blocks of letters give the same scores."""
    rnd = random.Random(40)
    rows = [(k, words(rnd, [f"{a}{chr(97 + k % 26)}" for a in rnd.sample("bcdfghklmnprstvw", 4)], 60), f"l{k:03d}") for k in range(lang_id.MOST_LANGUAGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = train(docs)
    assert model.langs == [r[2] for r in rows] and model.log_p.nbytes == 256 * lang_id.BUCKETS * 4
    assert np.allclose(np.exp(model.log_p.astype(float)).sum(axis=0), 1, atol=1e-3)
    w = lang_id.split_words(pa.array([r[1] for r in rows[:50]]))
    whole = lang_id.scores(w, model)
    monkeypatch.setattr(lang_id, "CELLS", 256 * 40)
    assert (lang_id.scores(w, model) == whole).all()
    assert lang_id.group_bytes(model) == lang_id.GROUP_BYTES * lang_id.FEW // 256
    found = identify(docs, model, spans=False).join(docs, "doc_id").select((F.col("lang_pred") == F.col("lang")).alias("right")).collect()
    assert sum(r.right for r in found) > 240
