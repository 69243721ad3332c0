import random

import numpy as np

import corpus_pipeline
from boxmill.llm.token_packing import END_ID, _encoder
from tests.llm import plain


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    rnd = random.Random(13)
    syllables = {"aa": ["ba", "ko", "ti", "re"], "bb": ["sch", "ung", "ei", "ro"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(syllables[lang], k=rnd.randint(2, 6))) for _ in range(n))
    rows = [(i, text(lang, rnd.choice([30, 80, 150])), lang, f"s{i % 3}") for i in range(90) for lang in [["aa", "bb"][i % 2]]]
    item = text("aa", 20)
    rows += [(100, rows[4][1], "aa", "s1"), (101, rows[4][1] + " end", "aa", "s1"), (102, text("aa", 40) + " " + item, "aa", "s0"), (103, "123 456", "aa", "s0"), (104, None, None, None)]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    gone = {"language_id": {103, 104}, "minhash_near_dedup": {100, 101}, "decontaminate": {102}}
    before = {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        if name in gone:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            before -= gone[name]
            assert {r.doc_id for r in docs.collect()} == before
        if name == "mix_sources":
            mix = [(r.doc_id, r.text) for r in docs.collect()]
            assert {i for i, _ in mix} <= before and max(mix.count(x) for x in mix) <= 2
    encoder, tokens = _encoder("byte_bpe_50k.tiktoken"), []
    for r in docs.collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        tokens += [ids[a:b].tolist() for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])]
    assert sorted(encoder.decode(t[:-1]) for t in tokens) == sorted(t for _, t in mix) and all(t[-1] == END_ID for t in tokens)
    assert plain.shingles(rows[4][1])
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == docs.columns


def test_near_copies_from_four_fifths_on(spark):
    """Copies that differ in their last words: similarities 0.80, 0.82 and 0.78."""
    base = [f"w{i}" for i in range(104)]
    pairs = []
    for g, k in enumerate([11, 9, 13]):
        own = [f"g{g}{w}" for w in base]
        pairs += [(10 * g, " ".join(own)), (10 * g + 1, " ".join(own[: 104 - k] + [f"n{g}x{i}" for i in range(k)]))]
    a, b = (plain.shingles(t) for _, t in pairs[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, "").collect()) == [0, 10, 20, 21]


def test_missing_and_repeated_ids(spark, tmp_path):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (6, text(5)), (7, text(5)), (None, text(3)), (8, "the item of four words " + text(6)), (8, text(7)), (None, "the item of four words " + text(8))]
    spark.createDataFrame([(0, "the item of four words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    kept = sorted(((r.doc_id or 0), r.text) for r in once.collect())
    assert once.columns == ["doc_id", "text"]
    assert kept == sorted([(0, text(0)), (0, text(1)), (0, text(2)), (5, text(3)), (5, text(4)), (6, text(5)), (8, text(7)), (8, rows[10][1]), (0, rows[12][1])])
    clean = corpus_pipeline.decontaminate(spark, once, str(tmp_path))
    assert sorted(((r.doc_id or 0), r.text) for r in clean.collect()) == [x for x in kept if "item" not in x[1]]


def test_text_in_several_languages_stays(spark):
    rnd = random.Random(14)
    syllables = {"aa": ["ba", "ko", "ti", "re"], "bb": ["sch", "ung", "ei", "ro"], "cc": ["xy", "zu", "qo", "vam"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(syllables[lang], k=rnd.randint(2, 6))) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i in range(60) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(100, " ".join(text(lang, 40) for lang in syllables), "aa"), (101, "\u10d0\u10d1\u10d2\u10d3 " * 30 + "bako", "aa"), (102, "123", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = corpus_pipeline.lang_id.train(docs.where("doc_id < 100"))
    kept = corpus_pipeline.lang_id.known_languages(docs, model, corpus_pipeline.LEAST_SCORE)
    assert {r.doc_id for r in kept.collect()} == {*range(60), 100}


def test_names_that_clash_and_other_columns_of_repeats(spark, tmp_path):
    spark.createDataFrame([(0, "the item of four words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"w{i}" for i in range(30))
    names = ["row", "row_", "others", "gone", "_row", "_gone", "_repeat", "leaked"]
    rows = [(1, long, *"abcdefgh"), (1, long, *"zbcdefgh"), (2, long + " end", *"abcdefgh"), (None, "the item of four words", *"abcdefgh"), (4, "x y", *"abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    once = corpus_pipeline.minhash_near_dedup(spark, docs, "")
    assert once.columns == docs.columns
    assert sorted((r.doc_id or 0, r.row) for r in once.collect()) == [(0, "a"), (1, "a"), (4, "a")]
    clean = corpus_pipeline.decontaminate(spark, once, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 4]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "the item of four words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3m")
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        assert spark.conf.get(name) == "3m"
    finally:
        spark.conf.set(name, before)


def test_letters_at_random_go(spark):
    """In a script that languages use: what decides is whether words are a language's."""
    rnd = random.Random(15)
    syllables = {"aa": ["ba", "ko", "ti", "re"], "bb": ["sch", "ung", "ei", "ro"]}
    text = lambda lang, n: " ".join("".join(rnd.choices(syllables[lang], k=rnd.randint(2, 6))) for _ in range(n))
    noise = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(4, 12))) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i in range(40) for lang in [["aa", "bb"][i % 2]]]
    rows += [(100, noise(40), None), (101, text("aa", 20) + " " + noise(40), None), (102, text("bb", 60) + " " + noise(20), None), (103, text("aa", 1), None), (104, text("aa", 30) + " " + text("bb", 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {*range(40), 102, 103, 104}
