import random

import numpy as np
import pytest

from corpusloom.functions.tokens import code_token_hashes, shingle_set
from corpusloom.llm import copies, neardup, overlap

NAMES = [f"v{i}" for i in range(400)]


def program(rng, lines):
    return "#include <iostream>\nusing namespace std;\n" + "\n".join(f"int {rng.choice(NAMES)} = {rng.choice(NAMES)} + {rng.randrange(9999)};" for _ in range(lines))


def edited(rng, text, edits):
    lines = text.split("\n")
    for _ in range(edits):
        k = rng.randrange(2, len(lines))
        lines[k] = rng.choice([f"x = {rng.randrange(9999)};", "", lines[rng.randrange(2, len(lines))]])
    return "\n".join(lines)


def corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = program(rng, rng.choice([3, 12, 40, 90]))
        texts += [base] + [edited(rng, base, rng.randrange(1, 6)) for _ in range(3)]
    texts += [texts[0], texts[0].replace("\n", "\r\n"), None, "", "  \n", "a b c d", "int main(){}", "int main(){}", "x = 1; " * 3000]
    return texts


def similarity(a, b):
    x, y = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_near_duplicates_equal_brute_force(spark, texts):
    rows = [(k % 2, i, t, "clash") for k in range(2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "t int, id bigint, x string, rep string")
    pairs, members = neardup.near_duplicates(df)
    got = {tuple(r) for r in neardup.expand(pairs, members).collect()}
    expected = {(k, i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.8 for k in range(2)}
    assert got == expected
    groups = {(r.t, r.id): (r.group, r.links) for r in neardup.groups(pairs, members).collect()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, i, j in expected:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {k[1]: v[0] for k, v in groups.items() if k[0] == 0} == {i: root(i) for i, t in enumerate(texts) if len(shingle_set(t))}


def test_shared_counts_equal_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    left, right = np.sort(rng.integers(0, 30, 900)), rng.integers(0, 30, 900)
    assert neardup._shared_counts(sets, left, right).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(left, right)]


@pytest.mark.parametrize(("block", "compared"), [(7, 5), (2000, 256)])
def test_versions_of_one_template_equal_brute_force(spark, monkeypatch, block, compared):
    """Many versions share their keys; in blocks of any size every pair is found, and once."""
    rng = random.Random(17)
    base = program(rng, 60)
    texts = [edited(rng, base, rng.randrange(0, 14)) for _ in range(120)]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "t int, id bigint, x string")
    signed = neardup.signatures(df)
    classes = signed.selectExpr("t", "id as rep", *[f"s{j}" for j in range(8)])
    met = neardup.candidates(classes, block)
    rows = met.collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows)
    prints = {r.rep: [(r[f"s{j}"] >> (10 * i)) & 1023 for j in range(8) for i in range(6)] for r in classes.collect()}
    near = set()
    for a in range(120):
        for b in range(a + 1, 120):
            same = [x == y for x, y in zip(prints[a], prints[b])]
            if any(sum(same[k : k + 6]) >= 5 for k in range(0, 48, 6)) and 48 - sum(same) <= neardup.FARTHEST:
                near.add((a, b))
    assert {(r.a, r.b) for r in rows} == near and len(near) > 1000
    got = [(r.a, r.b) for r in neardup.compared(met, df, block=compared).collect()]
    assert sorted(got) == sorted(p for p in near if similarity(texts[p[0]], texts[p[1]]) >= 0.8)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(0, 1, None), (0, 2, "a b")], "t int, id bigint, x string")
    pairs, members = neardup.near_duplicates(df)
    assert neardup.expand(pairs, members).count() == 0
    assert neardup.groups(pairs, members).count() == 0
    assert neardup.expand(*neardup.near_duplicates(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(df, 0.5)


def test_fingerprint_distance_follows_similarity():
    rng = np.random.default_rng(1)
    far = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 900, dtype=np.uint64)
        b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
        x, y = neardup.fingerprints([a, b])
        symbols = [[(int(v) >> (10 * i)) & 1023 for v in f for i in range(6)] for f in (x, y)]
        far.append(sum(p != q for p, q in zip(*symbols)))
    # Similarity 0.8: 9.6 of 48 symbols differ on average.
    assert 8.5 < np.mean(far) < 10.7 and max(far) <= neardup.FARTHEST


def test_many_copies_cost_one_class(spark):
    df = spark.createDataFrame([(0, i, "int a = b + 1; return a;") for i in range(60)], "t int, id bigint, x string")
    pairs, members = neardup.near_duplicates(df)
    assert pairs.count() == 0 and members.select("rep").distinct().count() == 1
    assert neardup.expand(pairs, members).count() == 60 * 59 // 2


def test_overlaps_equal_brute_force(spark, texts):
    rng = random.Random(9)
    train = [t for t in texts]
    held = [t and edited(rng, t, rng.randrange(0, 3)) for t in texts[:120:2] if t and t.count("\n") > 3]
    held += [texts[0], "int main(){}", None, "", "a b", "x = 1; " * 2000]
    train += ["int q;\n" + held[1] + "\n" + program(rng, 50), "\n".join(reversed(held[2].split("\n")))]
    rows = [(0, i, t) for i, t in enumerate(train)] + [(1, 1000 + i, t) for i, t in enumerate(held)] + [(None, 5000, texts[0])]
    pairs, members = overlap.split_overlaps(spark.createDataFrame(rows, "t int, id bigint, x string"))
    got = {(r.held, r.train): r for r in overlap.expand(pairs, members).collect()}
    expected = set()
    for i, h in enumerate(held):
        x = set(shingle_set(h).tolist())
        expected |= {(1000 + i, j) for j, t in enumerate(train) if x and len(x & set(shingle_set(t).tolist())) >= 0.85 * len(x) - 1e-9}
    assert set(got) == expected
    same = [(i, j) for i, h in enumerate(held) for j, t in enumerate(train) if h and h == t and (1000 + i, j) in got]
    assert same and all(got[1000 + i, j].edits == 0 for i, j in same)


def test_shared_shingles_need_not_be_consecutive(spark):
    held = ["a b c d e f a b c d e f", " ".join(f"w{i}" for i in range(60))]
    scattered = " ; ".join(" ".join(f"w{j}" for j in range(i, i + 5)) for i in range(56))
    rows = [(1, 1, held[0]), (1, 2, held[1]), (0, 3, "d e f a b c d e f a"), (0, 4, scattered), (0, 5, "d e f a b c")]
    found = overlap.expand(*overlap.split_overlaps(spark.createDataFrame(rows, "t int, id bigint, x string"))).collect()
    assert {(r.held, r.train, r.shared, r.d) for r in found} == {(1, 3, 6, 6), (2, 4, 56, 56)}


def test_scattered_and_repeated_shingles_equal_brute_force(spark):
    rng = random.Random(21)
    held, train = [], []
    for _ in range(30):
        words = [rng.choice("abcdefgh") if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 80))]
        held.append(" ".join(words))
        runs = [words[i : i + 5] for i in range(len(words) - 4)]
        rng.shuffle(runs)
        train.append(" ; ".join(" ".join(r) for r in runs[: max(1, int(len(runs) * rng.choice([0.8, 0.86, 1.0])))]))
        half = len(words) // 2
        train.append(" ".join(words[half:] + words[:half] + words[half:]))
    rows = [(1, i, t) for i, t in enumerate(held)] + [(0, 100 + i, t) for i, t in enumerate(train)]
    got = {(r.held, r.train) for r in overlap.expand(*overlap.split_overlaps(spark.createDataFrame(rows, "t int, id bigint, x string"))).collect()}
    expected = set()
    for i, h in enumerate(held):
        x = set(shingle_set(h).tolist())
        expected |= {(i, 100 + j) for j, t in enumerate(train) if x and len(x & set(shingle_set(t).tolist())) >= 0.85 * len(x) - 1e-9}
    assert got == expected and len(got) > 20


def test_edits_settle_only_what_holds(texts):
    rng = random.Random(12)
    settled = 0
    for text in [t for t in texts if t and len(shingle_set(t)) > 30]:
        a, other = code_token_hashes(text), code_token_hashes("int q; " * rng.randrange(9) + edited(rng, text, rng.randrange(0, 4)))
        mine = shingle_set(text)
        band = overlap.allowed_missing(len(mine)) // 5
        shift = int(np.flatnonzero(np.isin(overlap.window_hashes(other), overlap.window_hashes(a)[:1]))[0])
        (edits,) = overlap.aligned([(a, other, shift, band)])
        if edits is not None:
            settled += 1
            assert np.isin(mine, overlap.window_hashes(other)).mean() >= 0.85
    assert settled > 50
    assert overlap.aligned([]) == []


def test_tables_have_a_bound(monkeypatch):
    a = np.arange(1, 2001, dtype=np.uint64)
    assert overlap.aligned([(a, a, 0, 60), (a[:9], a, 0, 1)]) == [0, 0]
    monkeypatch.setattr(overlap, "CELLS", 100_000)
    assert overlap.aligned([(a, a, 0, 60), (a[:9], a, 0, 1)]) == [None, 0]


def test_report_counts_copies_after_quotations(spark, tmp_path):
    from corpusloom.llm.queries import CATALOG

    rng = random.Random(3)
    held = [program(rng, n) for n in (4, 12, 30)]
    quoted = [h.rsplit(" ", 1)[0] + "\n" + "z = 0;\n" * 40 + h for h in held]
    spoiled = [h.replace("using", "no") for h in held]
    rows = [(i, "test", "a/x.cpp", h) for i, h in enumerate(held)] + [(10 + i, "train", "b/x.cpp", t) for i, t in enumerate(quoted[:2] + spoiled)]
    spark.createDataFrame(rows, "record_id bigint, split string, path string, text string").write.parquet(str(tmp_path / "style_v3.parquet"))
    tokens = [code_token_hashes(r[3]).tolist() for r in rows]
    pairs = {(i, j): any(tokens[j][k : k + len(tokens[i])] == tokens[i] for k in range(len(tokens[j]))) for i in range(3) for j in range(3, len(rows)) if np.isin(shingle_set(rows[i][3]), shingle_set(rows[j][3])).mean() >= 0.85}
    expected = ("test", "a", len(pairs), len({i for i, _ in pairs}), len({i for (i, _), exact in pairs.items() if exact}))
    assert expected[4] == 2
    assert [(r.split, r.directory, r.pairs, r.records, r.exact_records) for r in CATALOG.queries["p3_report"](spark, str(tmp_path)).collect()] == [expected]


def test_tokens_within_tokens():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(2) * 257 for _ in range(n)] for n in (rng.randrange(1, 5), rng.randrange(1, 12)))
        assert overlap.within(np.array(a, np.uint64), np.array(b, np.uint64)) == any(b[k : k + len(a)] == a for k in range(len(b)))


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([(0, 1, "int a = b;"), (1, 2, None)], "t int, id bigint, x string")
    assert overlap.expand(*overlap.split_overlaps(df)).count() == 0
    assert overlap.expand(*overlap.split_overlaps(df.limit(0))).count() == 0


def _edits(a, b, shift, band):
    """Least edits from a to a substring of b over cells within the band."""
    big = 10**6
    row = {o: 0 for o in range(-band, band + 1)}
    for i, x in enumerate(a):
        new = {}
        for o in range(-band, band + 1):
            j = i + shift + o
            best = row.get(o, big) + (0 if 0 <= j < len(b) and b[j] == x else 1)
            best = min(best, row.get(o + 1, big) + 1, new.get(o - 1, big) + 1)
            new[o] = best
        row = new
    least = min(row.values())
    return least if least <= band else None


def test_banded_edits_equal_the_table():
    rng = random.Random(2)
    a = [[rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(80)]
    b = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(80)]
    shift = [rng.randrange(-5, 12) for _ in a]
    band = [rng.randrange(1, 6) for _ in a]
    got = overlap.banded_edits([np.array(x, np.uint64) for x in a], [np.array(x, np.uint64) for x in b], shift, band)
    assert got == [_edits(*z) for z in zip(a, b, shift, band)]


def test_segments_share_no_shingle():
    rng = random.Random(4)
    for text in [program(rng, 30), "x = 1; " * 400, "int main(){}", "a b c d e f g h i j k l"]:
        tokens = code_token_hashes(text)
        length, distinct, starts = overlap.segments(tokens)
        assert len(starts) >= overlap.allowed_missing(distinct) + 1
        shingles = overlap.window_hashes(tokens)
        owned = [h for s in starts for h in set(shingles[s : s + length].tolist())]
        assert len(owned) == len(set(owned))


def test_filter_size_has_bounds():
    assert [copies.filter_bits(n) for n in (0, 1, 2**21, 2**21 + 1, 2**60)] == [2**25, 2**25, 2**25, 2**26, 2**30]


def test_filter_loses_nothing(spark):
    values = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    words = copies.hash_filter(spark.createDataFrame([(int(v),) for v in values], "h bigint"), "h", 1 << 12)
    assert copies.passes(words, values.view(np.uint64)).all()
    assert len(words) == 64
    assert copies.passes(copies.hash_filter(spark.createDataFrame([], "h bigint"), "h"), values.view(np.uint64)).sum() == 0
