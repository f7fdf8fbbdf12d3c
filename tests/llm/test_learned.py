"""Quality and toxicity: held-out accuracy, the Bayes arithmetic, and edge rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featshare.llm import quality as Q
from featshare.llm import toxicity as T
from featshare.llm.common import table
from featshare.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    rows = QUERIES[name](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out")
    return rows.select("doc_id", F.col("predicted" if label == "toxic" else "kept").cast("int").alias("p"), label).collect()


def test_quality_held_out(spark):
    rows = held_out(spark, "op4_quality_classifier", "quality")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows) and len(rows) > 1000
    good, bad = [r.p for r in rows if r.quality == 1], [r.p for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.02


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op9_toxicity", "toxic")
    toxic, clean = [r.p for r in rows if r.toxic == 1], [r.p for r in rows if r.toxic == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.005


def test_toxicity_finds_words_at_the_end_of_long_texts(spark, sf_small):
    model = T.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    clean = "the heron and thesh of erat to onor is that "
    docs = spark.createDataFrame(
        [(1, clean * 500), (2, clean * 500 + "worthless pathetic idiot stupid moron disgusting scum trash " * 3),
         (3, None), (4, ""), (4, ""), (None, clean)], "doc_id long, text string").withColumn("score", F.lit(9))
    got = sorted(((r.doc_id or 0, r.predicted, r.score) for r in T.toxicity(docs, model).collect()))
    assert [g[:2] for g in got] == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0), (4, 0)]
    assert all(0 <= g[2] <= 1 for g in got)
    assert T.toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 0)], [(1, None), (2, 7), (None, 1)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "doc_id long, text string").withColumns(
        {"source": F.lit(None).cast("string"), "lang": F.lit("x")})
    table_ = spark.createDataFrame([(*r, r[1]) for r in labels], "doc_id long, toxic int, quality int")
    assert T.toxicity(docs, T.train(docs, table_)).count() == 3
    got = Q.quality(docs, Q.train(docs, table_)).collect()
    assert len(got) == 3 and all(0 <= r.posterior <= 1 for r in got)


def test_saved_bytes_tell_the_classes_apart(spark):
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("nd", "rt", "lm", "st")]
    rng = random.Random(0)
    rows = [(" ".join(rng.choices(words, k=60)), 0) for _ in range(200)]
    rows += [(" ".join(rng.choices(words, k=50) + rng.choices(["zyxquack", "vilewort"], k=6)), 1) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, y int")
    labels = docs.selectExpr("doc_id", "y as toxic").unionAll(spark.createDataFrame([(1, 0), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    model = T.train(docs, labels)
    assert model.distance("zyxquack") > 2 and model.distance("band") <= 0
    again = T.Model.__new__(T.Model)
    again.__setstate__(model.__getstate__())
    texts = [" ".join(words[:60]), " ".join(words[:54]) + " vilewort zyxquack vilewort" * 2]
    assert np.allclose(again.score(texts), model.score(texts)) and again.score(texts)[1] > 0.7 > again.score(texts)[0]


def test_quality_posterior_by_hand(spark):
    """The shrunk rates and the posterior against plain Python, own evidence taken out."""
    rng = random.Random(7)
    sites = {"good": 0.95, "bad": 0.1, "mixed": 0.5, None: 0.7}
    rows = []
    for i in range(800):
        host = rng.choice(list(sites)) if i < 790 else f"tiny{i}"
        junk = rng.random() > sites.get(host, 0.5)
        text = " ".join(rng.choice(["the", "of", "house", "tree,", "green."]) + ("###" if junk else "") for _ in range(30))
        rows.append((i, text, host, rng.choice(["a", "b"]), int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int")
    model = Q.train(docs, docs.select("doc_id", F.col("n").alias("quality")))
    got = {r.doc_id: r for r in Q.quality(docs, model).collect()}
    ev = dict(zip((r[0] for r in rows), model.evidence([r[1].encode() for r in rows])))
    prior = math.log(model.rate / (1 - model.rate))
    p = {i: 1 / (1 + math.exp(-e - prior)) for i, e in ev.items()}
    rate = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(sums):
        s = [(a, n, m) for a, n, m in sums if n >= 2]
        spread = sum(n * (a / n - m) ** 2 for a, n, m in s)
        chance = sum(m * (1 - m) for _, _, m in s)
        weight = sum(n * m * (1 - m) for _, n, m in s)
        x = (spread - chance) / (weight - chance)
        return min(max(1 / x - 1, Q.STRENGTH[0]), Q.STRENGTH[1]) if x > 0 else Q.STRENGTH[1]

    def sums(names):
        out = {}
        for r in rows:
            a, n = out.get(names(r), (0.0, 0))
            out[names(r)] = (a + p[r[0]], n + 1)
        return out

    hosts, paths = sums(lambda r: r[2] or ""), sums(lambda r: (r[2] or "", r[3]))
    kh = strength([(a, n, rate) for a, n in hosts.values()])
    above = {h: (a + kh * rate) / (n + kh) for h, (a, n) in hosts.items()}
    kp = strength([(a, n, above[h]) for (h, _), (a, n) in paths.items()])
    for i, _, host, lang, _ in rows:
        h, pa = hosts[host or ""], paths[host or "", lang]
        hr = (h[0] - p[i] + kh * rate) / (h[1] - 1 + kh)
        pr = (pa[0] - p[i] + kp * hr) / (pa[1] - 1 + kp)
        odds = math.log(pr / (1 - pr)) + ev[i]
        assert got[i].path_rate == pytest.approx(pr, abs=1e-6)
        assert got[i].posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        if str(host).startswith("tiny"):  # alone on its site: the global prior
            assert pr == pytest.approx(rate, abs=1e-6)


def test_quality_edges(spark):
    assert all(map(math.isfinite, Q.features(b"") + Q.features(b"\xff\x00") + Q.features("é" .encode() * 9999)))
    docs = spark.createDataFrame([(1, None, None, None), (1, "x", "s", "l"), (None, "", "s", None)],
                                 "doc_id long, text string, source string, lang string").withColumn("p", F.lit(3))
    model = Q.Model([(Q.features(b"the house is green."), 1), (Q.features(b"### ### |||"), 0)] * 5)
    assert Q.quality(docs, model).count() == 3 and Q.quality(docs.limit(0), model).count() == 0
    assert Q.keep_good(docs, model).columns == docs.columns
