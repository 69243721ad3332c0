import random

import numpy as np

from boxmill.llm.token_packing import END_ID, CapacityTree, _encoder, best_fit_decreasing, pack, write_packed


def plain_packing(lengths, capacity):
    """Scans all rows for the fullest one that takes each item; of equally full ones the latest put there."""
    rows, free, stamp = [], [], []
    for clock, i in enumerate(sorted(range(len(lengths)), key=lambda k: -lengths[k])):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: (free[r], -stamp[r]))
        else:
            r = len(rows)
            rows.append([])
            free.append(capacity)
            stamp.append(0)
        rows[r].append(i)
        free[r] -= lengths[i]
        stamp[r] = clock
    return rows


def test_best_fit_decreasing_against_a_scan():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.randint(1, 70)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))]
        assert best_fit_decreasing(lengths, capacity) == plain_packing(lengths, capacity)


def test_tree_finds_the_smallest_capacity():
    tree = CapacityTree(100)
    for capacity, row in ((40, 0), (7, 1), (100, 2)):
        tree.push(capacity, row)
    assert [tree.smallest(n) for n in (1, 7, 8, 41, 100)] == [7, 7, 40, 100, 100]
    assert tree.pop(7) == 1 and tree.smallest(1) == 40


def unpacked(rows, seq_len):
    docs = {}
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == seq_len and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert len(r.doc_ids) == len(r.doc_offsets) == len(r.cu_seqlens) - 1
        for a, b, doc, offset in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_offsets):
            assert list(positions[a:b]) == list(range(b - a))
            docs.setdefault(doc, []).append((offset, ids[a:b].tolist()))
        assert (ids[r.n_tokens :] == END_ID).all() and list(positions[r.n_tokens :]) == list(range(seq_len - r.n_tokens))
    return docs


def test_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice(["the", "Ärger", "<|endoftext|>", "x1", "\n"]) for _ in range(rnd.choice([0, 1, 5, 60, 900]))) for i in range(80)}
    texts |= {90: None, 91: "", 92: "🙂" * 700}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, n_tokens string")
    write_packed(pack(df, seq_len=64, block_rows=20), str(tmp_path / "packed"))
    docs = unpacked(spark.read.parquet(str(tmp_path / "packed")).collect(), 64)
    encoder = _encoder("byte_bpe_50k.tiktoken")
    assert docs.keys() == texts.keys()
    for i, parts in docs.items():
        parts.sort()
        assert [o for o, _ in parts] == list(range(0, 64 * len(parts), 64))
        tokens = [t for _, p in parts for t in p]
        assert tokens[-1] == END_ID and END_ID not in tokens[:-1]
        assert encoder.decode(tokens[:-1]) == (texts[i] or "")


def test_rows_are_full_and_empty_tables_give_none(spark):
    df = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(2000)], "doc_id long, text string").coalesce(1)
    rows = pack(df, seq_len=128).collect()
    assert sum(r.n_tokens for r in rows) / (128 * len(rows)) > 0.97
    assert pack(df.limit(0)).count() == 0
    assert sorted(pack(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string").coalesce(1), seq_len=8).collect()[0].doc_ids) == [1, 1]
