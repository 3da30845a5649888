"""The toxicity classifier against brute force: neighbours, votes and whole scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru") for b in ("na", "po", "si", "du") for c in ("", "fe", "ga")]


@pytest.mark.parametrize("terms,block", [(60, 128), (60, 16), (2000, 32), (9, 16)])
def test_nearest_is_exact(terms, block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(terms + block)
    rows = [Counter(rng.integers(0, terms, 12).tolist()) for _ in range(700)]
    number = {t: i for i, t in enumerate(sorted({t for r in rows for t in r}))}
    weights = rng.random(len(number)) ** 6 * 10 + 1e-3
    cols, at, counts = map(np.array, zip(*sorted((number[t], i, n) for i, r in enumerate(rows) for t, n in r.items()), strict=True))
    index = toxicity.BlockMaxIndex(np.arange(700), np.zeros(700, int), weights, at, cols, counts)
    dense = np.zeros((700, len(number)))
    dense[at, cols] = (1 + np.log(counts)) * weights[cols]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for k in range(80):
        t = np.array(sorted(number[x] for x in rows[k]))
        n = np.array([rows[k][x] for x in sorted(rows[k], key=number.get)])
        all_ = np.round(dense @ dense[k], 6)
        all_[k] = 0
        want = np.sort(all_)[::-1][:20]
        s, at_ = index.nearest(t, index.unit(t, n), 20, without=slice(k, k + 1))
        assert s.tolist() == pytest.approx(want[want > 0].tolist(), abs=2e-6)
        assert set(at_[s > want[-1] + 3e-6]) == set(np.nonzero(all_ > want[-1] + 3e-6)[0])


def test_terms_of_texts():
    texts = ["Kanalo kan, KANALO! 12 x_y", None, "", "ñandú\u0301 ²a", "kan " * 70_000, "z" * 400]
    got = list(toxicity.Terms().counts(texts))
    want = [words(t) for t in texts]
    assert [sorted(n.tolist()) for _, n in got] == [sorted(c.values()) for c in want]
    keys = np.unique(np.concatenate([k for k, _ in got]))
    assert len(keys) == len(set().union(*want))
    numbered = list(toxicity.Terms(keys).counts(texts))
    assert all((keys[i] == k).all() and (a == b).all() for (i, a), (k, b) in zip(numbered, got, strict=True))
    assert not len(next(toxicity.Terms(np.empty(0, np.uint64)).counts(["kana"]))[0])


def words(t):
    """The terms of a text, spelled out."""
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
        out[w] += 1
        for k in toxicity.PREFIX:
            if len(w) > k:
                out[w[:k] + "*"] += 1
    return out


def test_scores_brute_force(spark):
    """Terms, weights, cosines, votes and calibration computed again over dictionaries."""
    rng = random.Random(7)
    bad = ("vilemus", "scumbag", "idiotic")
    texts = [" ".join(rng.choice(WORDS) for _ in range(40)) + (" " + " ".join(rng.sample(bad, 2)) if i % 6 == 0 else "") for i in range(240)]
    texts += [None, "", "1234", texts[0]]
    labels = {i: int(i % 6 == 0) for i in range(150)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}

    counts = [words(t) for t in texts]
    df = Counter(t for c in counts for t in c)
    have, toxic = Counter(t for i in labels for t in counts[i]), Counter(t for i, y in labels.items() if y for t in counts[i])
    share = (sum(labels.values()) + 0.5) / (len(labels) + 1)
    weight = {t: (math.log((1 + len(texts)) / (1 + df[t])) + 1) * math.log((toxic[t] / share + 10) / (n + 10)) ** 2 for t, n in have.items()}

    def vector(c):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / n for t, x in v.items()}

    vectors = [vector(c) for c in counts]

    def vote(i, without=None):
        near = sorted(((-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 6), j) for j in labels if j != without))[:20]
        w = [(s * s, labels[j]) for s, j in near if s < 0]
        return (sum(s * y for s, y in w) + 1e-3 * share) / (sum(s for s, _ in w) + 1e-3)

    x, y = toxicity.isotonic(np.array([vote(i, i) for i in labels]), np.array(list(labels.values()), float))
    for i in range(len(texts)):
        assert got[i]["score"] == pytest.approx(float(np.interp(vote(i), x, y)), abs=0.02)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert [got[i]["predicted"] for i in range(240)] == [int(i % 6 == 0) for i in range(240)]
    assert {got[i]["score"] for i in (240, 241, 242)} == {got[240]["score"]} and got[240]["evidence"] == []


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + (" vilemus scumbag" if i % 5 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(5, 0)], "doc_id long, toxic int")
    train = spark.createDataFrame(rows, "doc_id long, text string")
    docs = spark.createDataFrame([(1, rows[0][1], 1), (1, rows[1][1], 2), (None, rows[5][1], 3), (None, rows[6][1], 4), (7, None, 5), (7, "", 6)], "doc_id long, text string, row int")
    assert sorted(r["row"] for r in toxicity.keep_clean(docs, labels, train).collect()) == [2, 4, 5, 6]
    assert toxicity.keep_clean(docs, labels, train).columns == docs.columns
    assert toxicity.score(docs.limit(0), labels, train_docs=train).count() == 0
    assert toxicity.score(docs, labels.limit(0)).count() == 6 and toxicity.keep_clean(docs.limit(0), labels).count() == 0
