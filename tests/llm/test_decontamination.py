import random
import re

import pytest

from featshare.llm import decontamination as D


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, bench, window=10):
    out = []
    for k, t in docs:
        w, hit, items = words(t), set(), set()
        for i, b in bench:
            bw = words(b)
            for s in range(max(1, len(bw) - window + 1) if bw else 0):
                win = bw[s:s + window]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        items.add("" if i is None else str(i))
        out.append((k, len(w), tuple(sorted(hit)), tuple(sorted(items))))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.a, s.b)), tuple(r.items))
                   for r in rows), key=repr)


def cases():
    rng = random.Random(2)
    vocab = "a b c d e f g h i j é 7".split()
    bench = [(i, " ".join(rng.choices(vocab, k=rng.randint(9, 25)))) for i in range(12)]
    bench += [(100, "short one"), (101, ""), (102, None), (None, "lone"), (100, "again, HERE"), (103, "9-9")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(20)]
    docs += [(30 + i, "x " + b[1].upper().replace(" ", ", ") + " y") for i, b in enumerate(bench[:12])]
    docs += [(60, None), (61, ""), (62, "Short-one; lone again here 9 9"), (62, "lone"), (None, bench[0][1]),
             (63, "z " * 5000 + bench[1][1] + " " + bench[1][1])]
    return docs, bench


@pytest.mark.parametrize("block_words, group", [(D.BLOCK_WORDS, 16), (30, 16), (30, 2)])
def test_brute_force(spark, monkeypatch, block_words, group):
    """One block, several blocks in one pass, several passes."""
    monkeypatch.setattr(D, "GROUP", group)
    docs, bench = cases()
    docs += [(31, "clean text of a repeated key"), (60, "clean")]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert got(D.contaminated_spans(d, b, block_words=block_words).collect()) == brute(docs, bench)
    left = D.drop_contaminated(d, b, block_words=block_words)
    clean = [x for x in docs if not brute([x], bench)[0][2]]
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    docs, bench = cases()
    d, b = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (bench, "item_id")))
    assert D.contaminated_spans(d.limit(0), b).count() == 0
    assert all(not r.spans and not r.items for r in D.contaminated_spans(d, b.limit(0)).collect())
