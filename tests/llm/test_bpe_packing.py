import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing

ODD = ["", " ", "\n\n  x", "<|endoftext|>", "a" * 700, "ab" * 400, "中文，测试。" * 60, "\x1c a\x85b\xa0c　d", "naïve café ﬁ", "😀👍🏽 it's we'll", "int main(){}\r\n\treturn 0;", "​﻿x", "0" * 300, "=" * 5000]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def model():
    return bpe.BytePairEncoder(bpe.vocabulary_path())


def ids_of(model, texts):
    ids, ends = model.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_equals_the_public_tokenizer(model, public):
    assert ids_of(model, ODD) == public(ODD)
    every = [f"{chr(c)}a {chr(c)} 1{chr(c)}" for c in range(1, 0x3000, 7)]
    assert ids_of(model, every) == public(every)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=8))
def test_equals_it_on_any_text(model, public, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(model, texts) == public(texts)


def test_long_words_have_the_same_tree(model):
    words = [bytes(random.Random(k).choice(b"abc ") for _ in range(255)) for k in range(5)]
    assert [a.tolist() for a in model.encode_words(words)] == [model._scalar(w).tolist() for w in words]


def test_forgetting_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(bpe, "_MOST_WORDS", 3)
    model = bpe.BytePairEncoder(bpe.vocabulary_path())
    for _ in range(3):
        assert ids_of(model, ODD[:8]) == public(ODD[:8])


def test_query_on_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, "u", 7), (2, "", "v", 8), (3, "int x;", None, None), (3, "int x;", "w", 1)], "doc_id bigint, text string, i string, ids int")
    got = {(r.doc_id, tuple(r.ids)) for r in bpe.token_ids(rows, "doc_id", "text").collect()}
    assert {(1, ()), (2, ())} < got and len(got) == 3
    counts = sorted((r.doc_id, r.n_tokens) for r in bpe.token_counts(rows, "doc_id", "text").collect())
    assert counts[:2] == [(1, 0), (2, 0)] and counts[2] == counts[3]
    assert bpe.token_ids(rows.limit(0), "doc_id", "text").count() == 0


def _brute_sum_of_squares(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        best = None
        for level in [0, *sorted({b for b in bins if 0 < b < capacity})]:
            if level + s > capacity:
                continue
            trial = [b for b in bins]
            if level:
                trial[trial.index(level)] = level + s
            else:
                trial.append(s)
            cost = sum(sum(b == h for b in trial) ** 2 for h in set(trial) if h < capacity)
            if best is None or cost <= best[0]:
                best = (cost, level)
        level = best[1]
        out.append(level)
        if level:
            bins[bins.index(level)] = level + s
        else:
            bins.append(s)
    return out, len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=40))
def test_sum_of_squares_takes_the_least(sizes):
    _, bins = _brute_sum_of_squares(sizes, 12)
    got = packing.sum_of_squares(np.array(sizes), 12)
    assert got.max() + 1 == bins
    assert np.bincount(got, weights=sizes).max() <= 12


def test_packing_keeps_every_token_once(spark):
    sizes = {i: s for i, s in enumerate([0, 1, 7, 10, 11, 20, 25, 33, 3, 3, 3, 9, 9, None])}
    df = spark.createDataFrame([(i, s, "x") for i, s in sizes.items()], "id bigint, size int, piece string")
    rows = packing.pack(df, "id", "size", 10, 4).collect()
    for i, s in sizes.items():
        pieces = sorted((r.piece, r.token_start, r.n_tokens) for r in rows if r.id == i)
        assert sum(p[2] for p in pieces) == (s or 0)
        assert [p[1] for p in pieces] == [10 * k for k in range(len(pieces))]
        assert len(pieces) == (0 if not s else -(-s // 10))
    fill = {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 10
    report = packing.fill(packing.pack(df, "id", "size", 10, 4), 10).first()
    assert (report.containers, report.tokens) == (len(fill), sum(fill.values()))
    assert packing.pack(df.limit(0), "id", "size", 10, 4).count() == 0


def test_packing_wastes_little(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(rng.lognormal(6, 1, 3000) + 1)], "id bigint, size bigint")
    report = packing.fill(packing.pack(df, "id", "size")).first()
    assert report.unused / (report.containers * packing.CAPACITY) < 0.01
    assert df.agg(F.sum("size")).first()[0] == report.tokens
