import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featshare.llm import simhash as S
from featshare.llm.common import components, table


def slow_fingerprint(text, shingle=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, fps, bits=4):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).append(k)
    return {k: min((x for x in g if x is not None), default=None) for g in groups.values() for k in g}


@pytest.mark.parametrize("text", ["", " \t\n", None, "one", "A b C", "a b c d", "É  x\x0by z w\xa0v", "w " * 300])
def test_fingerprint(text):
    assert S.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_triples_cover_every_four_positions():
    from itertools import combinations
    assert len(S.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in S.TRIPLES) for q in combinations(range(8), 4))


@pytest.mark.parametrize("block", [S.BLOCK, 4])
def test_links_keep_components(spark, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):  # crowds around centres, chains, and loners
        at = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                at ^= 1 << b
            fps.add(at)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = S.links(frame, block=block)
    found = {r.node: r.root for r in components(edges).collect()}
    mine = {}
    for f, s in zip(fps, signed):
        mine.setdefault(found.get(s, s), set()).add(f)
    want = {}
    for f, c in classes(fps, fps).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    pairs = edges.collect()
    assert all((np.int64(p.a) ^ np.int64(p.b)).view(np.uint64).item().bit_count() <= 4 for p in pairs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199), (200, 199)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, sf_small):
    docs = table(spark, sf_small, "documents").select("doc_id", "text").union(
        spark.createDataFrame([(90001, None), (90002, ""), (None, " "), (90003, "zz"), (90003, "zz")], "doc_id long, text string"))
    docs = docs.withColumn("fp", F.lit("clash"))
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = classes([r.doc_id for r in rows], fps)
    got = S.simhash_groups(docs).collect()
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=repr) == sorted(
        ((r.doc_id, int(np.uint64(f).astype(np.int64)), want[r.doc_id]) for r, f in zip(rows, fps)), key=repr)
    left = S.keep_one_per_group(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted(
        (r.doc_id for r in rows if r.doc_id is not None and want[r.doc_id] == r.doc_id), key=repr)
    assert S.simhash_groups(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    """Documents are keys with texts: a repeated key loses no text of its own."""
    one, two, three = ("alpha beta gamma delta " * 9, "one two three four five " * 9, "left right up down " * 9)
    rows = [(3, one), (5, one), (5, two), (None, three), (None, three + "down"), (7, None), (6, ""), (None, " "), (8, two), (8, two), (9, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__key", F.lit(1)).withColumn("fp", F.lit("x"))
    left = S.keep_one_per_group(docs)
    assert left.columns == docs.columns
    near = S.fingerprint(three.encode()) ^ S.fingerprint((three + "down").encode())
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(3, one), (5, two), (6, ""), (9, three)] + ([] if near.bit_count() <= 4 else [(None, three + "down")]), key=repr)
    same = spark.createDataFrame([(4, one), (4, one), (4, one + "x")], "doc_id long, text string")
    kept = [r.text for r in S.keep_one_per_group(same).collect()]
    assert len(set(kept)) == (1 if (S.fingerprint(one.encode()) ^ S.fingerprint((one + "x").encode())).bit_count() <= 4 else 2)
    assert S.keep_one_per_group(docs.limit(0)).count() == 0
