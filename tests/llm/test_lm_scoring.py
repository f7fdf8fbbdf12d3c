import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from featshare.llm import lm_scoring as L


def brute(rows, order, alpha=0.4):
    texts = [re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    own = [Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    every = sum(own, Counter())
    total = sum(map(len, texts))
    out = []
    for (k, _), w, mine in zip(rows, texts, own):
        def c(g):
            return every[g] - mine[g]
        score = 0.0
        for i in range(len(w)):
            give = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if n == 1:
                    rest = total - len(w)
                    s = c(g) / rest if c(g) else 1 / (rest + 1)
                elif c(g):
                    s = c(g) / c(g[:-1])
                else:
                    give *= alpha
                    continue
                score += math.log(give * s)
                break
        out.append((k, len(w), round(score, 6)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("the of a Tree house é x1".split(), k=rng.randint(0, 40)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "unseen"), (104, "the"), (5, rows[5][1]), (5, "again"),
                   (None, rows[7][1]), (105, "never ever seen words"), (106, "the " * 300)]


@pytest.mark.parametrize("how", [{}, {"order": 1}, {"order": 2, "block_bytes": 64}, {"order": 4, "part_keys": 20},
                                 {"block_bytes": 200, "part_keys": 50}])
def test_brute_force(spark, how):
    rows = cases()
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, block int").repartition(4)
    got = L.lm_scores(docs, **how).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=repr) == brute(rows, how.get("order", 3))
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_empty(spark):
    assert L.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_key_packing():
    rng = np.random.default_rng(0)
    for keys in (np.arange(300, dtype=np.uint64), np.array([2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * 2)):
        assert (L.unpack_keys(L.pack_keys(keys)) == keys).all()
    for counts in ([], [0, 255], [1, 70000], [2**40]):
        assert L._counts(L._small(np.array(counts, np.int64))).tolist() == counts
