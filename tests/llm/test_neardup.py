"""Near-duplicate components against brute force."""

from itertools import combinations

import numpy as np
import pytest

from rfmlens.llm import neardup as N


def set_of(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(size, len(w))
    return frozenset((k, *w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, size, percent=80):
    """Expected (doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = [set_of(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i)), d == low.get(root(i))) for i, (d, _) in enumerate(rows)]


def run(spark, rows, size, **how):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, node string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.groups(df, size, **how).collect()), key=str)


def family(rng, vocab, kind, n):
    """Variants of one text: of a base, or a chain in which each is changed a little more."""
    base = rng.choice(vocab, 60).tolist()
    out, last = [" ".join(base)], base
    for _ in range(n):
        w = list(last if kind == "chain" else base)
        for _ in range(int(rng.integers(1, 5))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
        out.append(" ".join(w))
        last = w
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size, monkeypatch):
    if size == 5:
        monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(N, "BLOCK", 3)
        monkeypatch.setattr(N, "BLOCK_SHINGLES", 150)
    rng = np.random.default_rng(size)
    vocab = np.array([f"w{i}" for i in range(200)])
    texts = [t for i in range(12) for t in family(rng, vocab, "chain" if i % 2 else "star", 14)]
    texts += [" ".join(rng.choice(vocab, 50)) for _ in range(40)] + ["one"] * 3 + ["ONE", "two", "", None, " \n ", "one two", "two one"]
    texts += texts[:10] + ["é a b c d e f g"] * 2 + ["É a b c d e f g"]
    ids = rng.permutation(len(texts) * 3)[:len(texts)].tolist()
    rows = list(zip(ids, texts, strict=True))
    rows += [(None, texts[3]), (None, "a text of its own that nobody else has"), rows[0], rows[0]]
    want = brute(rows, size)
    assert len({c for _, _, c, _ in want}) < len(rows) - 60
    assert run(spark, rows, size) == sorted(want, key=str)


def test_star_without_its_centre_as_smallest(spark):
    """Copies that reach each other through their base only."""
    base = [f"b{i}" for i in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(25):
        w = list(base)
        for j in range(13):
            w[(i * 12 + j * 23) % 300] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 2)
    assert {c for _, _, c, _ in want} == {0}
    a, b = set_of(rows[1][1], 2), set_of(rows[2][1], 2)
    assert len(a & b) < 0.8 * len(a | b)
    assert run(spark, rows, 2) == sorted(want, key=str)


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [tuple(map(int, rng.integers(300, 420, 2))) for _ in range(90)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.label for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_what_the_hub_left_open(spark, monkeypatch):
    """Nodes outside of a bucket's largest component meet it and each other, whatever the blocks."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(int(rng.integers(1, 14))):
            w[int(rng.integers(0, 200))] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [N.shingles(t, 2) for _, t in rows]
    ids = [N.name_of(s) for s in sets]
    first = ids[0]
    # of one bucket: the first ten are its largest component, the others are alone
    members = spark.createDataFrame([(7, x, 40, first) for x in ids], "h long, node long, size long, hub long")
    labels = spark.createDataFrame([(x, first) for x in ids[:10]], "node long, label long")
    nodes = N.sketch(docs, 2).select("node", "doc_id", "version", "n")
    up = {x: first if k < 10 else x for k, x in enumerate(ids)}

    def root(up, x):
        while up[x] != x:
            x = up[x]
        return x

    want = dict(up)
    for i, j in combinations(range(40), 2):
        if N.similar(sets[i], sets[j], 80):
            want[root(want, ids[i])] = root(want, ids[j])
    for block in (512, 6):
        monkeypatch.setattr(N, "BLOCK", block)
        open_rows = N.open_rows(members, labels)
        assert {r.unit for r in open_rows.collect()} == {first} and open_rows.where("open").count() == 30
        links = N.confirm_open(open_rows, nodes, docs, 2, 80, "doc_id", "text").collect()
        got = dict(up)
        for a, b in links:
            assert N.similar(sets[ids.index(a)], sets[ids.index(b)], 80)
            got[root(got, a)] = root(got, b)
        part = lambda u: {frozenset(x for x in ids if root(u, x) == root(u, y)) for y in ids}
        assert part(got) == part(want) and len(part(want)) < 30


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = N.minima(np.concatenate((both, a))), N.minima(np.concatenate((both, b)))
    assert abs((x == y).mean() - 0.8) < 0.09
    assert (1 - 0.8**N.ROWS) ** N.BANDS < 1e-6


def test_long_texts_and_empty_table(spark):
    long = "word " * 100 + " ".join(f"w{i}" for i in range(60_000))
    assert run(spark, [(2, long), (1, long + " more")], 2) == [(1, 60_002, 1, True), (2, 60_001, 1, False)]
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").where("false")
    assert N.groups(df).count() == 0


def test_columns_with_names_of_its_own(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(2, text, 5, 6, "x"), (1, text, 7, 8, "y")], "doc_id long, text string, near_id int, __id int, __version string")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, 7, 8, "y")]
