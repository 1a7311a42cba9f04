"""Containment search against brute force and SQL."""

import re
from collections import defaultdict

import numpy as np

from rfmlens.llm import decontam as D


def words(t):
    return [w for w in re.split("[\x20\x09-\x0D]+", (t or "").lower()) if w]


def brute(docs, items, size=5, threshold=0.8):
    out = set()
    for i, it in items:
        w = words(it)
        k = min(size, len(w))
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, t in docs:
            v = words(t)
            n = len(s & {tuple(v[j:j + k]) for j in range(len(v) - k + 1)}) if s else 0
            if s and n >= threshold * len(s) - 1e-9:
                out.add((d, i, len(s), n))
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, n string"),
            spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, version string"))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: rng.choice(vocab, n).tolist()
    items = [(i, " ".join(say(int(rng.integers(6, 60))))) for i in range(40)]
    items += [(100, "only three words"), (101, ""), (102, None), (103, "Single"), (None, "a null id has words too you see"), (0, "second text under id zero here")]
    docs = [(d, " ".join(say(int(rng.integers(0, 200))))) for d in range(30)]
    for d in range(30, 150):  # passages with a few words changed, around the threshold
        w = words(items[int(rng.integers(0, 40))][1])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = "changed"
        docs.append((d, "\n".join([" ".join(say(30)), " ".join(w).upper(), " ".join(say(int(rng.integers(0, 2000))))])))
    docs += [(150, None), (151, ""), (152, " \t\n"), (None, "so A null ID has words too you see"), (153, "he said only three words then"), (154, "a single one"),
             (155, docs[40][1]), (40, docs[40][1]), (40, docs[40][1]), (41, "second text under id zero here")]
    a, b = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 60
    for few in (10, D.BROADCAST_ROWS):
        D.BROADCAST_ROWS, keep = few, D.BROADCAST_ROWS
        try:
            got = D.find_leaks(a, b).collect()
        finally:
            D.BROADCAST_ROWS = keep
        assert sorted(map(str, ((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got))) == sorted(map(str, want))
    left = D.drop_leaks(a, b)
    bad = {(d, t) for d, t in docs if any(d == x[0] for x in brute([(d, t)], items))}
    assert left.columns == a.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(str(x) for x in docs if x not in bad)


def test_sketches_grow_with_size_and_are_lossless(spark):
    rows = D.item_shingles(spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (5, 9, 20, 60, 300)], "item_id long, text string")).collect()
    kept, size = defaultdict(int), {}
    for r in rows:
        kept[r.item_id] += r.minimum
        size[r.item_id] = r.n
    assert all(kept[i] > (1 - D.THRESHOLD) * size[i] - 1e-9 for i in size) and kept[5] == 1 and kept[300] < 100


def test_empty_tables(spark):
    a, b = frames(spark, [(1, "a b c d e f")], [(1, "a b c d e f")])
    assert D.find_leaks(a, b).count() == 1
    assert D.find_leaks(a.where("false"), b).count() == 0 and D.find_leaks(a, b.where("false")).count() == 0
    assert D.drop_leaks(a, b.where("false")).count() == 1 and D.drop_leaks(a.where("false"), b).count() == 0


def test_main_path_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leaks = D.find_leaks(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    assert not re.search("Python|Pandas|Arrow", leaks._jdf.queryExecution().executedPlan().toString())


def test_query_against_sql(spark):
    from tools.compare_oracle import compare
    assert compare(spark, "/root/testdata/sf0.001", ["op10_decontamination"]) == {"op10_decontamination": "ok"}


def test_sql_knows_short_items(spark, tmp_path):
    import duckdb
    docs = [(1, "we saw only three words here"), (2, "single and more"), (3, "a b c d e f g"), (3, "a b c d e f z"), (4, None), (5, ""), (None, "x y z a b c d e f")]
    items = [(1, "only three words"), (2, "Single"), (3, "a b c d e f g"), (4, ""), (5, None), (3, "a b c d e f g")]
    a, b = frames(spark, docs, items)
    a.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = D.op10_decontamination(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(D.OP10_SQL).project(", ".join(got.columns)).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and {r[1] for r in want} == {1, 2, 3}


def test_columns_with_names_of_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6), (2, "clean text", 7, 8)], "doc_id long, text string, leak_id int, __id int")
    kept = D.drop_leaks(docs, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", 7, 8)]
