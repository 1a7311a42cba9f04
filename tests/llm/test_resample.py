"""Resampling against a plain re-implementation, and the interning table against dictionaries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from rfmlens.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n=2):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (Counter(bucket(g) for text in texts for g in grams(text)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for d, text in docs:
        w, g = grams(text)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(able[:25 * len(able) // 100])}
    return sorted((*r[:4], rank.get(id(r))) for r in rows)


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "ABC", "x" * 40, "naïve", "日本語", "a1b2"]
    seps = [" ", ", ", "-", "\n", "  ", "\x00", "'"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice(seps) for _ in range(n))
    docs = [(int(i), say(int(rng.integers(0, 80)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, say(5000)), (1004, docs[7][1]), (1005, "x" * 100)]
    target = [say(30) for _ in range(20)] + [None, ""]
    spark.createDataFrame([(d, t, 1, "b") for d, t in docs], "doc_id long, text string, weight int, bucket string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = R.op12_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, target)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    got = R.resample(docs, none, percent=67).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 4
    assert R.resample(none, docs).count() == 0


def test_interned_pieces():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc é"), 400)) + " " + "long" * 30 for _ in range(20)]
    buffer, start, length, of, words = R.features(texts, 3)
    pieces = [bytes(buffer[a:a + n]) for a, n in zip(start, length)]
    assert (R.xxhash64(buffer, start, length) == np.array([xxhash.xxh64_intdigest(p) for p in pieces], np.uint64)).all()
    for keys in (None, np.zeros(len(start), np.uint64)):  # the bytes decide where all keys agree
        some = slice(0, None if keys is None else 300)
        found = R.Interned(buffer, start[some], length[some], 97, None if keys is None else keys[some])
        slots = {}
        for p, s in zip(pieces[some], found.slot):
            assert slots.setdefault(p, s) == s
        assert len(set(slots.values())) == len(slots)
        assert {p: found.count[s] for p, s in slots.items()} == Counter(pieces[some])
        assert all(found.bucket[s] == zlib.crc32(p) % 97 for p, s in slots.items())
    assert sorted(Counter(of.tolist()).items()) == [(i, len(grams(t, 3)[1])) for i, t in enumerate(texts)]
    assert words.tolist() == [len(grams(t)[0]) for t in texts]
