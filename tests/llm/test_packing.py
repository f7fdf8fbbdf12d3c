import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from featshare.llm import packing as P
from featshare.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokenizer_equals_whole_text():
    tok = Tokenizer.from_file(PATH)
    texts = ["", " ", "Hello, World!", "don't we're I'LL 'S x's.", "a0b 0 00 10 ½ ٣", "İstanbul ΣΑΣ ς ß ẞ é é Å",
             "<|endoftext|> a<|endoftext|>b <|startoftext|>", "x\x1cy\x1dz a\x85b\xa0c d​e", "日本語 テスト。emoji 😀!!",
             "a...b!!?? ...", "\x00\x01 _a_ __ a_b", "ABC123def's 'tis 't's", "x" * 300, "\xa0a\x85 \u3000b\u2028c  ", "﻿bom"]
    w = P.WordTokenizer(open(PATH, encoding="utf-8").read(), room=5)
    for _ in range(2):
        flat, ends = w.ids(pa.array(["sliced off", *texts]).slice(1))
        for t, a, b in zip(texts, [0, *ends], ends):
            assert flat[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_symbols_before_punctuation_stay_joined():
    tok = Tokenizer.from_file(PATH)
    words = ["hallo».", "5°,", "abc®,", "a·)", "±.", "«l'été».", "§§.", "İ.", "x\x1c.", "\x00.", "a\x85.", "b\xa0»,"]
    symbols = [c for c in map(chr, range(0x250)) if not c.isalnum()]
    words += [a + c + b for c in symbols for a in ("hallo", "", "C²") for b in (".", ",)", f".{c}", "'s", "")]
    w = P.WordTokenizer(open(PATH, encoding="utf-8").read())
    flat, ends = w.ids(pa.array([" ".join(words), *words]))
    for t, a, b in zip([" ".join(words), *words], [0, *ends], ends):
        assert flat[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_and_crossover_are_packings():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 90, 400)
    pop = P.start_population(sizes, 100, rng)
    for p in pop + [P.crossover(sizes, pop[0], pop[1], 100, rng) for _ in range(5)] + P.evolve(sizes, pop, 100, rng):
        assert len(p) == 400 and p.min() == 0 and set(p) == set(range(p.max() + 1))
        assert np.bincount(p, sizes).max() <= 100


def test_evolution_beats_best_fit():
    # triplets that fill bins exactly: best-fit decreasing wastes bins, the islands mend some
    rng = np.random.default_rng(3)
    a = rng.integers(26, 40, 60)
    b = rng.integers(26, 37, 60)
    sizes = np.concatenate((a, b, 100 - a - b))
    pop = P.start_population(sizes, 100, rng)
    start = P.fitness(sizes, pop[0], 100)
    assert P.fitness(sizes, P.evolve(sizes, pop, 100, rng, 60)[0], 100) > start


def check(rows, texts, capacity):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = tok.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        for r in own:
            part = ids[r.start:r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("shard", [P.SHARD, 200])
def test_pack_documents(spark, sf_small, shard, monkeypatch):
    monkeypatch.setattr(P, "SHARD", shard)
    docs = table(spark, sf_small, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    cut = P.written(P.pieces(docs, PATH), "t")
    place = P.pack(cut.select("part", "idx", "length"), shard=shard)
    rows = cut.join(place, ["part", "idx"]).collect()
    n = check(rows, texts, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hi " * 50, 5), (4, "hi", 5)],
                                 "doc_id long, text string, tokens int")
    rows = P.pack_documents(docs, PATH, capacity=16, tokens=True).collect()
    assert check(rows, {1: None, 2: "", 3: "hi " * 50, 4: "hi"}, 16) == 4
    assert all(len(r.tokens) == r.length for r in rows)
    assert P.pack_documents(docs.limit(0), PATH).count() == 0
