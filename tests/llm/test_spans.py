import random
from collections import defaultdict

import pytest

from evigraph.llm.spans import shared_chars, shared_spans


def brute(rows, k):
    seen = defaultdict(set)
    for i, t in rows:
        for j in range(len(t or "") - k + 1):
            seen[t[j : j + k]].add(i)
    out = {}
    for i, t in rows:
        c = bytearray(len(t or ""))
        for j in range(len(t or "") - k + 1):
            if len(seen[t[j : j + k]]) > 1:
                c[j : j + k] = b"\1" * k
        if sum(c):
            out[i] = sum(c)
    return out


@pytest.mark.parametrize("bucket", [4096, 2, 1])
def test_equals_brute_force_at_every_bucket_size(spark, bucket):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abc d😀é") for _ in range(rnd.randint(0, 90))) for _ in range(30)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randint(0, 5) :] for _ in range(rnd.randint(0, 4)))) for i in range(80)]
    rows += [(200, "x" * 100), (201, "x" * 70 + "y"), (202, "x" * 19), (203, None), (204, ""), (205, "   ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, shared_chars(df, k=20, m=6, bucket_strings=bucket).collect())) == brute(rows, 20)


def test_repeats_within_one_document_and_repeated_rows_do_not_count(spark):
    t = "abcdefghij" * 5
    one = spark.createDataFrame([(1, t), (1, t), (2, "unlike" * 9)], "doc_id long, text string")
    assert shared_chars(one, k=20, m=6).count() == 0
    many = spark.createDataFrame([(i, t) for i in range(40)] + [(50, "zz" + t[:25] + "zz")], "doc_id long, text string")  # a hot group of copies
    got = dict(map(tuple, shared_chars(many, k=20, m=6).collect()))
    assert got == {i: 50 for i in range(40)} | {50: 25}
    assert {tuple(r)[1:] for r in shared_spans(many, k=20, m=6).where("doc_id = 50").collect()} == {(2, 27)}


def test_empty_table_extra_columns_string_keys_and_bounds(spark):
    df = spark.createDataFrame([("a", "q" * 30, 1, 2), ("b", "q" * 30, 1, 2)], "doc string, text string, start int, n int")
    assert dict(map(tuple, shared_chars(df, "doc", "text", k=20, m=6).collect())) == {"a": 30, "b": 30}
    assert shared_chars(df.where("false"), "doc", "text", k=20, m=6).count() == 0
    with pytest.raises(ValueError):
        shared_chars(df, "doc", "text", k=20, m=21)
