import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import fmindex, leaks, spans

LENGTH = 30


def documents():
    rng = random.Random(7)
    alphabet = "abcd \n水火"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(n) for n in (29, 30, 45, 80)]
    docs = []
    for i in range(40):
        text = word(rng.randrange(0, 120))
        for s in shared:
            if rng.random() < 0.25:
                text += s + word(rng.randrange(0, 10))
        docs.append(text)
    docs += [docs[3], docs[3], None, "", "x" * 29, "x" * 30, "x" * 200, "y" + "x" * 60, "ab" * 100, "😀" * 40, "z😀" + "😀" * 35]
    return docs


def windows(text):
    return {text[i : i + LENGTH] for i in range(len(text or "") - LENGTH + 1)}


@pytest.mark.parametrize("part", [10_000, 2])
def test_shared_spans_equal_brute_force(spark, part):
    docs = documents()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, id int")
    classes, shared, members = spans.shared_spans(df, "doc_id", "text", LENGTH, 12, part)
    got = [tuple(r) for r in spans.expand(classes, members, df, "doc_id", "text", LENGTH).collect()]
    w = [windows(t) for t in docs]
    expected = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if w[i] & w[j]}
    assert set(got) == expected and len(got) == len(expected)
    cover = {r.doc_id: r for r in spans.coverage(shared, members, df, "doc_id", "text", LENGTH).collect()}
    for i, t in enumerate(docs):
        if t is None:
            assert i not in cover
            continue
        others = set().union(*(w[j] for j in range(len(docs)) if j != i))
        on = np.zeros(len(t), bool)
        for k in range(len(t) - LENGTH + 1):
            if t[k : k + LENGTH] in others:
                on[k : k + LENGTH] = True
        assert (cover[i].n_chars, cover[i].shared_chars) == (len(t), on.sum()), i


def test_a_boilerplate_in_many_documents(spark):
    """One stretch in 1,500 documents is dealt to many parts, and its class comes out once with every member."""
    rng = random.Random(3)
    boilerplate = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = [(i, f"{rng.random()}{boilerplate}{rng.random()}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes, shared, members = spans.shared_spans(df, "doc_id", "text", LENGTH, 12, 50)
    sizes = [r["count"] for r in classes.groupBy("s0", "s1").count().collect()]
    assert max(sizes) == 1500 and len(sizes) < 1500
    assert spans.expand(classes, members, df, "doc_id", "text", LENGTH).count() == 1500 * 1499 // 2
    cover = spans.coverage(shared, members, df, "doc_id", "text", LENGTH).collect()
    assert len(cover) == 1500 and all(r.shared_chars >= 60 for r in cover)


def test_equal_hashes_of_different_windows(monkeypatch):
    monkeypatch.setattr(spans, "rolling", lambda points, *widths: [np.zeros(len(points) - w + 1, np.uint64) for w in widths])
    got = list(spans._shared_windows(np.array([1, 2, 3, 4]), np.zeros(4, np.int64), np.zeros(4, bool), ["abcde", "abcdf", "xxabc", "zzzzz"], 4))
    members = [sorted(b.column("id").to_pylist()) for b in got if b.column("kind")[0].as_py() == spans._MEMBER]
    assert members == [[1, 2]]


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "doc_id bigint, text string")
    for rows in (df, df.limit(0)):
        classes, _, members = spans.shared_spans(rows, "doc_id", "text")
        assert spans.expand(classes, members, rows, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        spans.shared_spans(df, "doc_id", "text", 10, 20)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 20))
def test_super_kmers_cover_every_window(values, length):
    points = np.array(values, np.uint32)
    minimiser = max(1, length // 2)
    least, first, last = spans.super_kmers(points, length, minimiser)
    hashes = spans.rolling(points, minimiser)[0]
    covered = [k for a, b in zip(first, last) for k in range(a, b + 1)]
    assert covered == list(range(max(0, len(points) - length + 1)))
    for m, a, b in zip(least, first, last):
        assert all(hashes[k : k + length - minimiser + 1].min() == m for k in range(a, b + 1))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 4))
def test_fm_index_finds_all(text, phrase, length):
    t, p = np.array(text, np.int64), np.array(phrase, np.int64)
    assert fmindex.suffix_array(t).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    index = fmindex.FMIndex(t, 4)
    end, low, high = index.matches(p, length)
    got = {(int(e), int(x)) for e, a, b in zip(end, low, high) for x in index.locate(np.arange(a, b))}
    expected = {(e, x) for e in range(length - 1, len(phrase)) for x in range(len(text) - length + 1) if 0 not in phrase[e - length + 1 : e + 1] and text[x : x + length] == phrase[e - length + 1 : e + 1]}
    assert got == expected


def test_wavelet_ranks():
    values = np.random.default_rng(0).integers(0, 11, 300)
    tree = fmindex.WaveletMatrix(values, 11)
    for s in range(11):
        at = np.arange(301)
        assert tree.rank(np.full(301, s), at).tolist() == [int((values[:k] == s).sum()) for k in at]


def items():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + list("你好世界")
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [(f"P{i}", text(rng.randrange(4, 60)), text(rng.randrange(4, 60)) if i % 3 else None) for i in range(12)] + [("Pe", "", None), ("Ptwin", None, None), (None, "w1 " * 50, None)]


@pytest.mark.parametrize(("block", "shard"), [(10**6, 10**6), (60, 50)])
def test_leaks_equal_brute_force(spark, block, shard):
    its = items()
    its[13] = ("Ptwin", its[1][1], None)
    rng = random.Random(2)
    rows = []
    for i in range(80):
        source = rng.choice(its[:12])[1].split()
        a = rng.randrange(len(source))
        piece = " ".join(source[a : a + rng.randrange(1, 40)])
        rows.append((i, f"Intro {piece.upper()}, end" if i % 2 else None, piece.replace(" ", "\n-") + " zz " + piece, "clash"))
    rows += [(80, None, None, None), (81, "", " ", None), (82, *rows[4][1:]), (None, its[0][1], None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, a string, b string, item string")
    item_df = spark.createDataFrame(its, "pid string, s string, c string")
    found = leaks.leaked_spans(df, "row_id", ["a", "b"], item_df, "pid", ["s", "c"], 8, block, shard)
    got = {(r.row_id, r.field, r["item"], r.word_begin, r.word_end) for r in found.collect()}
    expected = set()
    for rid, a, b, _ in rows:
        for name, text in (("a", a), ("b", b)):
            w = leaks.words(text)
            for pid, *texts in its:
                on = np.zeros(len(w) + 1, bool)
                starts = set()
                for t in texts:
                    v = leaks.words(t)
                    grams = {tuple(v[k : k + 8]) for k in range(len(v) - 7)}
                    starts |= {k for k in range(len(w) - 7) if tuple(w[k : k + 8]) in grams}
                begin = None
                for k in sorted(starts):
                    if begin is None or k > end:
                        if begin is not None:
                            expected.add((rid, name, pid, begin, end))
                        begin = k
                    end = k + 8
                if begin is not None:
                    expected.add((rid, name, pid, begin, end))
    expected = {e for e in expected if e[0] is not None and e[2] is not None}
    assert got == expected and got
    pairs = {(r.row_id, r["item"]) for r in leaks.leaked_items(found, "row_id").collect()}
    assert pairs == {(e[0], e[2]) for e in expected}
    assert leaks.leak_report(found, "row_id").count() == len({e[2] for e in expected})


def test_leaks_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")], "row_id bigint, a string")
    none = spark.createDataFrame([], "pid string, s string")
    assert leaks.leaked_items(leaks.leaked_spans(df, "row_id", ["a"], none, "pid", ["s"]), "row_id").count() == 0
    one = spark.createDataFrame([("p", "a b c " * 30)], "pid string, s string")
    assert leaks.leaked_spans(df.limit(0), "row_id", ["a"], one, "pid", ["s"]).count() == 0
