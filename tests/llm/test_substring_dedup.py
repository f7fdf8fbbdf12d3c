import hashlib
import random
import re
from collections import Counter

import pytest

from featshare.llm import substring_dedup as S


def brute(rows, window):
    texts = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, texts):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(9)
    word = [f"w{i}" for i in range(500)]
    passage = [rng.choices(word, k=n) for n in (35, 36, 60, 120)]
    rows = []
    for i in range(60):
        parts = rng.choices(word, k=rng.randint(0, 80))
        for p in rng.sample(passage, rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts = parts[:at] + p + parts[at:]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(100, None), (101, ""), (102, "a " * 34), (103, "b " * 35), (104, "c " * 36), (105, "d e " * 400),
             (106, " ".join(passage[0])), (107, " ".join(passage[0][1:])), (None, rows[3][1]), (3, rows[3][1]),
             (7, "other text of seven"), (108, "É é " * 18 + "x"), (109, "É é " * 18 + "y")]
    return rows


@pytest.mark.parametrize("how", [{}, {"crowd": 1}, {"shard_words": 200}, {"crowd": 3, "gram": 4}])
def test_brute_force(spark, how):
    rows = cases()
    docs = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, seg int").repartition(5)
    got = S.substring_dedup(docs, **how).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 35)
    for r in got:  # the spans are what is removed
        assert len({i for s in r.spans for i in range(s.a, s.b)}) == r.n_removed


def test_other_window_and_empty(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.substring_dedup(docs, window=10, gram=8).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 10)
    assert S.substring_dedup(docs.limit(0)).count() == 0
