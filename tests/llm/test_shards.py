"""Longest processing time against a heap over single groups, and the contract of the query."""

import heapq
import random
import zlib
from collections import defaultdict

from rfmlens.llm import shards as S


def slow(sizes, n):
    heap, out = [(0, j) for j in range(n)], defaultdict(lambda: [0] * n)
    for size, count in sizes:
        for _ in range(count):
            load, j = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, j))
            out[size][j] += 1
    return {k: v for k, v in out.items()}


def test_schedule_equals_the_heap_one_by_one():
    rng = random.Random(5)
    for n in (1, 2, 5, 24):
        for _ in range(30):
            sizes = sorted({rng.randint(8, 400): rng.choice([1, 1, 2, 3, 50, 700]) for _ in range(rng.randint(0, 30))}.items(), reverse=True)
            sizes = ([(5000, 1)] if rng.random() < 0.5 else []) + sizes
            got = {}
            for size, count, ends, which in S.schedule(sizes, n):
                per = [0] * n
                for a, b, j in zip([0, *ends], ends, which):
                    per[j] = b - a
                assert sum(per) == count
                got[size] = per
            assert got == slow(sizes, n)


def test_sizes_of_zero():
    assert S.schedule([(5, 1), (0, 1000)], 2) == [(5, 1, [1], [0]), (0, 1000, [1000], [1])]


def check(rows, got, n):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (d is None, d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    groups = defaultdict(int)
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    loads, slots = [0] * n, defaultdict(list)
    home = defaultdict(set)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        home[r.size, r.text_crc32].add(r.shard)
    counts = defaultdict(int)
    for b in groups.values():
        counts[b] += 1
    best = [0] * n
    for size, per in slow(sorted(counts.items(), reverse=True), n).items():
        best = [x + size * y for x, y in zip(best, per)]
    assert loads == best
    assert all(len(v) == 1 for v in home.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark, tmp_path):
    rng = random.Random(2)
    texts = ["", None, "same size a", "same size b", "é" * 300, *["copy"] * 300, *["x" * rng.randint(0, 90) + str(i % 50) for i in range(500)]]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "same size b"), (3, "same size b")]
    df = spark.createDataFrame([(d, t, 9, "n") for d, t in rows], "doc_id long, text string, shard int, bytes string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op11_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(got.dtypes)["slot"] == "bigint" and dict(got.dtypes)["shard"] == "int"
    check(rows, got.collect(), 24)
    check(rows, S.place(df, 3).collect(), 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.place(df).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 7}" if i else None, i) for i in range(60)], "doc_id long, text string, n int")
    S.write_shards(df, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text, r.n) for r in back if r.doc_id) == sorted((i, f"text {i % 7}", i) for i in range(1, 60)) and len(back) == 60
    assert len({(r.text, r.shard) for r in back}) == 8
