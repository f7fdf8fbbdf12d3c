import hashlib
import random

import pytest
from pyspark.sql import functions as F

from featshare.llm import exact_dedup as X
from featshare.llm.common import ascii_lower, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(LOW)


def brute(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(low(t), []).append(k)
    out = []
    for k, t in rows:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((k, keep, len(own), k == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


ROWS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (None, "abc"), (5, "É"), (6, "é"), (7, "x" * 30000), (8, "X" * 30000),
        (9, "a b " * 3000), (10, "a b " * 3000 + "c"), (7, "x" * 30000), (None, "only null"), (11, "\n \t"), (12, "😀 A" * 900)]


@pytest.mark.parametrize("bits", [64, 1])
def test_brute_force(spark, bits):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in ROWS], "doc_id long, text string, recipe string")
    assert got(X.exact_dedup(docs, bits=bits)) == brute(ROWS)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_dedup(docs).count() == 0 and X.drop_exact_copies(docs).count() == 0


def test_chunks_concatenate_and_resynchronise(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(2, 8))) for _ in range(20000))
    rows = spark.createDataFrame([(text,), ("inserted here, " + text,), ("q" * 20000,)], "t string")
    lists = [r[0] for r in rows.select(X.chunk_list(F.col("t"))).collect()]
    assert ["".join(x) for x in lists] == [text, "inserted here, " + text, "q" * 20000]
    assert len(set(lists[0]) & set(lists[1])) >= 0.9 * len(lists[0])
    assert max(len(c) for x in lists for c in x) <= X.MAX_CHUNK


def test_ascii_lower(spark):
    rows = spark.createDataFrame([("AbÉİſ\u212a",), ("ABC xyz",), (None,)], "t string")
    assert [r[0] for r in rows.select(ascii_lower(F.col("t"))).collect()] == ["abÉİſ\u212a", "abc xyz", None]


def test_drop(spark, sf_small):
    docs = table(spark, sf_small, "documents").withColumn("__sha2", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = X.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, _, _, kept, _ in brute(rows) if kept)


def test_native_plan(spark, sf_small):
    plan = X.exact_dedup(table(spark, sf_small, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
