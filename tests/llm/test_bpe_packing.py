import random

import pytest

from evigraph.llm import bpe, packing


def _reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), {v: k for k, v in ranks.items()}


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(5000))
    assert all(h.keys[h.find(k)] == k for k in keys)
    assert all(h.find(f"x{i}".encode()) == -1 for i in range(2000))
    assert bpe.PerfectHash([]).find(b"a") == -1


def test_encoding_equals_a_public_encoder_and_round_trips():
    own, (ref, back) = bpe.encoder(), _reference()
    rnd = random.Random(7)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 20000, "日本語のテスト。" * 300, "naïve café\n\n\t x", "👩‍👩‍👧 é"]
    texts += ["".join(rnd.choice("abc dé\n　中😀'sll\t0129.,") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    for t in texts:
        ids = own.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert b"".join(back[i] for i in ids).decode() == t


def test_encode_table_with_nulls_empties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "gel gel", "x", 1), (3, "gel gel", "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df).collect()]
    assert sorted(got) == [(1, []), (2, []), (3, bpe.encoder().encode("gel gel")), (3, bpe.encoder().encode("gel gel"))]
    assert bpe.encode(df.where("false")).count() == 0
    assert dict(map(tuple, bpe.token_counts(df).collect())) == {1: 0, 2: 0, 3: len(got[-1][1])}


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_every_window_within_capacity(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 37, 100])
    hist = {k: rnd.randint(1, 400) for k in rnd.sample(range(1, cap + 1), min(cap, 12))}
    slots, windows = packing.plan(hist, cap)
    used = {}
    for length, runs in slots.items():
        for rank in range(hist[length]):
            k = max(i for i in range(len(runs)) if runs[i][0] <= rank)
            w = int(runs[k][1] + (rank - runs[k][0]) // runs[k][2])
            used[w] = used.get(w, 0) + length
    assert max(used.values()) <= cap and set(used) == set(range(1, windows + 1))
    total = sum(k * n for k, n in hist.items())
    assert windows <= 11 / 9 * -(-total // cap) + 1 + sum(hist[k] for k in hist if 2 * k > cap)


def test_pack_keeps_every_token_once(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([0, 5, 5, 5, 7, 12, 20, 33, 61])) for i in range(300)] + [(0, 5)] + [(900, None)]
    sizes = [(i, n) for i, n in sizes if not (i == 0 and n != 5)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens int"), {1: 20, 2: 64}).toPandas()
    want = {i: n or 0 for i, n in sizes}
    for w, cap in ((1, 20), (2, 64)):
        g = got[got.window_id == w]
        assert g.groupby("window_no").n_tokens.sum().max() <= cap
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == want
        for i, part in g.groupby("doc_id"):
            at = 0
            for r in part.sort_values("piece_no").itertuples():
                assert r.first_token == at
                at += r.n_tokens
            assert len(part) == max(1, -(-want[i] // cap))
        assert sorted(g.window_no.unique()) == list(range(1, g.window_no.max() + 1))
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], "doc_id long, n_tokens int"), {1: 0})
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), {1: 8}).count() == 0
