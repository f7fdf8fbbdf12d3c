import random
import re
import zlib
from collections import Counter

import pytest

from featshare.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows, damage=199, count=5):
    seen = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 6 and n >= count}
    forms, out = {}, []
    for w, n in words.items():
        by = [v for v in words if near(v, w)]
        best = min(by, key=lambda v: (-words[v], v)) if by else None
        forms[w] = (best if best and words[best] >= 5 * n else None, len(by))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, forms[w][1], words.get(forms[w][0])))
    return sorted(out)


def corpus(seed=5):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeéß", k=rng.randint(5, 9))) for _ in range(25)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(150):
            w = rng.choices(stems, weights=[2 ** (i % 9) for i in range(25)])[0]
            if rng.random() < 0.25:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1:]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((k, rng.choice([" ", "-", "1", "\n"]).join(words)))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (None, None), (61, ""), (62, "ÀÀÀÀÀÀ " * 6 + "ààÀÀÀÀ " * 40 + "aaaaaa " * 200),
                   (63, "aaaaaaa " * 30 + "aaaaaaaa " * 5 + "straße× " * 9 + "Ÿaaaaab " * 9)]


ROWS = corpus()


def got(out):
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("damage, limit, bits", [(199, 1 << 21, 16), (3, 1500, 16), (199, 1 << 21, 1)])
def test_brute_force(spark, monkeypatch, damage, limit, bits):
    monkeypatch.setattr(S, "LEAST_BLOCKS", 1024 if bits > 1 else 1)  # few bits: most guesses are false
    docs = spark.createDataFrame([(k, t, 1) for k, t in ROWS], "doc_id int, text string, n int")
    want = brute(ROWS, damage)
    assert got(S.spelling_variants(docs, damage=damage, filter_limit=limit, bits=bits)) == want
    assert any(r[1] for r in want)


def test_very_long_words_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "PROBES", 5000)
    rng = random.Random(2)
    long = "".join(rng.choices("abcdef", k=5000))
    rows = [(1, " ".join([long] * 30 + [long[:-1]] * 6 + [long[:99] + "z" + long[100:]] * 5 + [long + "q"] * 4))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert got(S.spelling_variants(docs)) == brute(rows)


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdhg"] * 125 + ["abcihg"] * 625))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = brute(rows)
    assert got(S.spelling_variants(docs)) == want and {r[2] for r in want} == {"abcihg"}


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, "short words only")]):
        assert got(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == []


def test_one_word(spark):
    docs = spark.createDataFrame([(1, "single " * 7)], "doc_id long, text string")
    assert got(S.spelling_variants(docs, damage=10**9)) == [("single", None, "single", 7, 0, None)]
