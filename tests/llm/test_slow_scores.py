"""op5_quality and op6_langid row by row against slow re-implementations that share no code with them."""

import math
import string
import zlib
from collections import Counter

import numpy as np

from rfmlens.llm import langid, quality

SF = "/root/testdata/sf0.001"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def shape(text):
    """The features of a text, character by character."""
    data = (text or "").encode()
    upper, digit, space, feed, stop, other = (set(string.ascii_uppercase.encode()), set(b"0123456789"), set(b"\t\v\f\r "), set(b"\n"), set(b".,;:?'\"-()"), set())
    other = set(range(33, 127)) - upper - digit - stop - set(string.ascii_lowercase.encode())
    share = [sum(c in kind for c in data) / max(1, len(data)) for kind in (upper, digit, space, feed, stop, other)]
    words = data.lower().split()
    n = max(1, len(words))
    often = sorted(Counter(words).values(), reverse=True)[:3]
    pairs = len({(words[k], words[k + 1]) for k in range(len(words) - 1)}) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / n
    odd = sum(w[-1] in other for w in words) / n
    size = sum(len(w) for w in words) / n
    different = len(set(words)) / n
    first = [*share, different, often[0] / n if often else 0, sum(often) / n, pairs, again, len(set(lines)) / max(1, len(lines)), odd,
             sum(len(w) <= 3 for w in words) / n, size / 10, math.log(1 + size)]
    return first + [math.log(x + 0.01) for x in (share[0], share[5], share[4], odd, again, 1 - different, 1 - pairs)] + [float(not words)]


def slow_ranking(texts, labels):
    """The score of a text, learned from (id, quality) of ``labels`` and the texts of these ids, pair by pair."""
    rows = np.array([shape(texts[i]) for i, _ in labels])
    mean = rows.sum(axis=0) / len(rows)
    scale = np.sqrt(((rows - mean) ** 2).sum(axis=0) / len(rows)) + 1e-6
    z = np.minimum(np.maximum((rows - mean) / scale, -10), 10)
    good, bad = ([k for k, (_, q) in enumerate(labels) if q == x] for x in (1, 0))
    assert 0 < len(good) * len(bad) <= 100_000
    w, m, v = (np.zeros(rows.shape[1]) for _ in range(3))
    for t in range(1, 401):
        slope = np.zeros(len(w))
        for i in good:
            margin = (z[i] - z[bad]) @ w
            slope -= ((z[i] - z[bad]) / (1 + np.exp(margin))[:, None]).sum(axis=0)
        slope = slope / (len(good) * len(bad)) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    strengths = sorted(z @ w)
    cut = min(max(round(len(bad) / len(labels) * len(labels)), 1), len(labels) - 1)
    at = (strengths[cut - 1] + strengths[cut]) / 2
    return lambda t: 1 / (1 + math.exp(-((np.array(shape(t)) - mean) / scale @ w - at + math.log(0.7 / 0.3))))


def test_quality_against_slow_ranking(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = sorted({(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if crc(r.doc_id, 4) != 2 and r.doc_id in docs})
    want = slow_ranking(docs, labels)
    got = {r.doc_id: r for r in quality.op5_quality(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert abs(r.score - want(docs[i])) < 1e-6 and r.held_out == (crc(i, 4) == 2) and r.predicted == (r.score >= 0.7)


def trigrams(text):
    letters = bytes(c if c > 127 or chr(c) in string.ascii_lowercase else 32 for c in text.lower().encode())
    b = b" " + b" ".join(letters.split()) + b" "
    return Counter((((b[k] | b[k + 1] << 8 | b[k + 2] << 16) * 2654435761 % 2**32) >> 15) % 4096 for k in range(len(b) - 2))


def alpha(t):
    return t is not None and any(c.isalpha() for c in t)


def slow_mixture(known):
    """Language and score of a text, learned from (lang, text) pairs, trigram by trigram."""
    count = {}
    for lang, text in known:
        if lang is not None and alpha(text):
            count.setdefault(lang, Counter()).update(trigrams(text))
    names = sorted(count)
    total = {x: sum(c.values()) + 0.5 * 4096 for x, c in count.items()}
    chance = lambda x, g: (count[x][g] + 0.5) / total[x]

    def mixture(seen, start):
        share, n = dict(start), sum(seen.values())
        moved = 1.0
        while moved >= 1e-4:
            new = dict.fromkeys(names, 0.0)
            for g, k in seen.items():
                whole = sum(share[x] * chance(x, g) for x in names)
                for x in names:
                    new[x] += k * share[x] * chance(x, g) / whole
            new = {x: y / n for x, y in new.items()}
            moved = max(abs(new[x] - share[x]) for x in names)
            share = new
        return share

    worth = lambda seen, share: sum(k * math.log(sum(share[x] * chance(x, g) for x in names)) for g, k in seen.items())

    def told(text):
        if not alpha(text):
            return "und", 0.0
        seen = trigrams(text)
        cost = 4 * math.log(max(2, sum(seen.values())))
        best = max(({x: float(x == y) for x in names} for y in names), key=lambda s: worth(seen, s))
        top = worth(seen, best)
        full = mixture(seen, {x: 1 / len(names) for x in names})
        if worth(seen, full) - cost > top:  # else no further language pays
            order = sorted(names, key=lambda x: -full[x])
            for k in range(2, len(names) + 1):
                part = {x: full[x] if x in order[:k] else 0.0 for x in names}
                s = mixture(seen, {x: y / sum(part.values()) for x, y in part.items()}) if k < len(names) else full
                if worth(seen, s) - (k - 1) * cost > top:
                    best, top = s, worth(seen, s) - (k - 1) * cost
        return max(names, key=lambda x: best[x]), max(best.values())

    return told


def test_language_against_slow_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    told = slow_mixture([(d.lang, d.text) for d in docs if crc(d.doc_id, 5)])
    got = {r.doc_id: r for r in langid.op6_langid(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, (lang, score) = got[d.doc_id], told(d.text)
        assert r.held_out == (crc(d.doc_id, 5) == 0) and r.lang_pred == lang and abs(r.score - score) < 0.01
