"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rfmlens.llm import tries as T


def rebuilt(turns):
    own = defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + v[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def told(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*T.OUT).collect())


def conversations(n, seed, words=3, most=6):
    rng = random.Random(seed)
    return [(c, i, rng.choice(["user", "assistant"]), rng.choice("abcdefg"[:words]) * rng.randint(1, 2)) for c in range(n) for i in range(rng.randint(1, most))]


def frame(spark, turns):
    return spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, depth int, key string")


@pytest.mark.parametrize("block,ranges", [(T.BLOCK, 1), (T.BLOCK, 7), (1, 3), (5, 11), (40, 2)])
def test_against_all_prefixes(spark, block, ranges):
    turns = conversations(120, block)
    assert told(T.trie(T.sequences(frame(spark, turns)), block, ranges)) == brute(rebuilt(turns))


def test_copies_across_blocks_and_ranges(spark):
    turns = [(c, i, "user", "same") for c in range(0, 400) for i in range(3)] + [(c, 0, "user", "same") for c in range(400, 440)]
    want = brute(rebuilt(turns))
    for block, ranges in ((7, 5), (50, 1), (T.BLOCK, 13)):
        assert told(T.trie(T.sequences(frame(spark, turns)), block, ranges)) == want


def test_nulls_ties_and_missing_conversations(spark):
    turns = [(5, None, None, "é"), (5, 2, "user", None), (6, 0, "user", "x"), (6, 1, "a", "x"), (12, 0, "user", "y"), (None, 0, "user", "lost"),
             (21, 0, "user", "z"), (20, 0, "ab", "c"), (22, 0, "a", "bc"), (22, 1, "user", "q"), (22, 1, "user", "q")]
    assert told(T.trie(T.sequences(frame(spark, turns)), 2, 3)) == brute(rebuilt(turns))


def test_empty_table_and_turnless(spark):
    assert T.trie(T.sequences(frame(spark, []))).count() == 0
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert told(T.trie(T.sequences(frame(spark, [(c, 0, "user", "gone")])))) == [
        (c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_conversation(spark):
    turns = [(0, i, "user", f"turn {i}") for i in range(5000)] + [(1, i, "user", f"turn {i}") for i in range(4000)]
    assert told(T.trie(T.sequences(frame(spark, turns)), 100)) == brute(rebuilt(turns))


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = T.op13_prefix_trie(spark, "/root/testdata/sf0.001")
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert told(got) == brute(rebuilt(rows))
