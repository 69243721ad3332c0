import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boxmill.llm.token_count import PieceCounter, count_tokens, counter

ODD = "ab  \n\t\x0b\x1c\x1f\x85\xa0é½²ⅷ中文🙂'sll<|endoftext|>_-.!0٣́​　"


def test_equals_the_library():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|><|endoftext|> x", "a" * 3000, "", "don't we'll I'd", " \n\n  x", "word " * 500]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [counter("byte_bpe_50k.json").count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_cache_starts_anew_when_full():
    model = {"vocab": {**{c: i for i, c in enumerate(map(chr, range(0x21, 0x200)))}}, "merges": []}
    pieces = PieceCounter(model, limit=3 * 160)
    assert [pieces[x] for x in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1]
    assert len(pieces) <= 3
    assert pieces["x" * 1000] == 1000 and "x" * 1000 not in pieces


def test_one_piece_of_megabytes():
    """Base64 without spaces: letters only, so one piece. The library's count of it, in time."""
    text = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=1_500_000))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter("byte_bpe_50k.json").count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_files_that_ask_for_more_are_refused():
    with pytest.raises(ValueError, match="end_of_word_suffix"):
        counter("word_bpe_49k.json")


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "é x", 7), (3, "é x", 7), (None, "a", 7)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 4, 2), (3, 4, 2)]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
