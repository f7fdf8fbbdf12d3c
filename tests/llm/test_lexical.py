import math
import re
from collections import Counter

import numpy as np
import pytest

from featshare.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return [w.translate(LOW) for w in TERM.findall(t or "")]


def brute(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in tf]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        scores = []
        for (d, c), n in zip(tf, sizes):
            if n:
                m = 75 + 25 * n * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                        for w in terms(text))
                if s > 0:
                    scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


DOCS = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 23))) for i in range(1, 60)] + [
    (60, None), (61, ""), (62, "... !?"), (None, "W1 w2 w3"), (None, "w1 W2 w3"), (63, "w1 w2 w3"), (63, "w1 w2 w3"), (64, "Éa éa w1"),
    (65, "w5 " * 50_000), (66, "rare_WORD rare-word")]
ITEMS = [(1, "w1 w2 w3"), (2, "w1 W1 w1, éa"), (3, None), (4, ""), (5, "absent"), (6, "rare word"), (6, "w16"), (None, "w4"),
         (7, " ".join(f"w{i % 17}" for i in range(400)))]


def got(out):
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in out.collect()], key=repr)


@pytest.mark.parametrize("block_words, k, tile", [(200_000, 20, 1024), (20, 3, 7), (200_000, 1, 1)])
def test_brute_force(spark, monkeypatch, block_words, k, tile):
    monkeypatch.setattr(L, "TILE_DOCS", tile)
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, score string").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id int, text string, rank int")
    assert got(L.lexical_search(docs, items, k=k, block_words=block_words)) == brute(DOCS, ITEMS, k)


def test_small_tiles(spark, monkeypatch):
    """Term tiles of two, item tiles of three: partial products add up."""
    monkeypatch.setattr(L, "TILE_ITEMS", 3)
    monkeypatch.setattr(L.term_tiles, "__defaults__", (L.EXACT, 2))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert got(L.lexical_search(docs, items, k=5)) == brute(DOCS, ITEMS, 5)


def test_term_tiles_bound_partial_sums():
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 30_000, (9, 200)) * rng.integers(1, 5, (9, 200))
    weights[3, 7] = 10 ** 9
    for limit, most in ((1 << 38, 4096), (1 << 53, 16), (1 << 34, 64)):
        total = np.zeros_like(weights)
        for terms_, q in L.term_tiles(weights, limit, most):
            assert len(terms_) <= most and (np.diff(terms_) > 0).all()
            assert q.sum(axis=0).max() * L.IMPACT < limit
            total[:, terms_] += q.T.astype(np.int64)
        assert (total == weights).all()


def test_impact_bound():
    tf, m = np.array([1, 10, 10**9]), np.array([75, 75, 75])
    assert (L.impacts(tf, m) < L.IMPACT).all()


def test_ties_keep_the_smallest_keys(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, "other") for i in range(500)],
                                 "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same here")], "item_id int, text string")
    assert [r.doc_id for r in L.lexical_search(docs, items).orderBy("rank").collect()] == list(range(1, 21))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:3], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id int, text string")
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    for d, i in ((docs, none[1]), (none[0], items), none, (docs.selectExpr("doc_id", "'' as text"), items)):
        assert got(L.lexical_search(d, i)) == []


def test_string_keys(spark):
    docs = spark.createDataFrame([("b", "w1"), ("a", "w1"), ("c", "w2")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "w1")], "item_id string, text string")
    assert [r.doc_id for r in L.lexical_search(docs, items).orderBy("rank").collect()] == ["a", "b"]
