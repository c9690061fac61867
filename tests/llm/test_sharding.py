import zlib
from collections import defaultdict

import pytest
from auxograph.llm.sharding import ROUND_KEYS, PRIME, halves, permuted, shards
from pyspark.sql import functions as F


def brute_permutation(i, n, keys=ROUND_KEYS):
    a, b = halves(n)

    def mixed(v, key, size):
        y = (v + key) % PRIME
        y = (y * y + key) % PRIME
        return y * (key % 65_521 + 1) % PRIME % size

    while True:
        left, right = i % a, i // a
        for even, odd in zip(keys[::2], keys[1::2]):
            left = (left + mixed(right, even, a)) % a
            right = (right + mixed(left, odd, b)) % b
        i = right * a + left
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select("id", permuted(F.col("id"), n).alias("p")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert got == [brute_permutation(i, n) for i in range(n)]


def test_large_numbers_stay_inside(spark):
    n = 60_000_000_003
    some = [0, 1, 12_345_678_901, n - 1]
    rows = spark.createDataFrame([(x,) for x in some], "id long").select(permuted(F.col("id"), n).alias("p")).collect()
    assert [r.p for r in rows] == [brute_permutation(x, n) for x in some]


def test_shards(documents):
    rows = [(i * 3 % 401, f"text {i}") for i in range(401)]
    got = shards(documents(rows), 8).collect()
    texts = dict(rows)
    slots = defaultdict(list)
    for r in got:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
        place = brute_permutation(sorted(texts).index(r.doc_id), 401)
        assert (r.shard, r.slot) == (place % 8, place // 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    again = shards(documents(rows[::-1]).repartition(5), 8).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


def test_awkward_rows(awkward, documents):
    got = shards(awkward).collect()
    assert sorted(r.row_number for r in got) == list(range(awkward.count()))
    assert all(r.size == 1 for r in got if r.doc_id in (2, 3))
    assert shards(documents([])).count() == 0


def test_no_python_in_the_plan(documents):
    plan = shards(documents([(1, "a b"), (2, None)]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "BatchEval", "ExternalRDD"))
