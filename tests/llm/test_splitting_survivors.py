import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.tokens import CODE_TOKEN
from corpusloom.llm import splitting, survivors


def source(rng, blocks):
    return "\n\n".join("// 说明，第一句。Second sentence.\nint f" + str(i) + "(int a) {\n" + "\n".join(f"    a += {rng.randrange(99)};" for _ in range(rng.randrange(1, 12))) + "\n}" for i in range(blocks))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 40))
def test_range_maximum(values, widest):
    table = splitting.RangeMax(np.array(values), widest)
    for a in range(len(values)):
        for b in range(a, min(len(values), a + widest)):
            best = max(values[a : b + 1])
            assert table.argmax(a, b) == max(k for k in range(a, b + 1) if values[k] == best)


@pytest.mark.parametrize("text", [source(random.Random(1), 40), "x " * 500, "a;" * 700, "\r\n".join("y = 1;" for _ in range(400)), "汉字" * 400, "word" + "\n" * 50 + "z " * 300])
def test_pieces_join_to_the_text(spark, text):
    limit, overlap = 100, 10
    rows = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "short", "c"), (1, text, "c")], "record_id bigint, text string, piece string")
    pieces = splitting.split_texts(rows, "record_id", "text", limit, overlap).collect()
    assert {p.record_id for p in pieces} == {1}
    one = sorted({tuple(p) for p in pieces}, key=lambda p: p[1])
    assert len(pieces) == 2 * len(one)
    tokens = CODE_TOKEN.findall(text)
    spans = [m.span() for m in CODE_TOKEN.finditer(text)]
    joined, upto = "", 0
    for k, (_, piece, a, b, ca, cb, repeated, body) in enumerate(one):
        assert piece == k and body == text[ca:cb] and CODE_TOKEN.findall(body) == tokens[a:b] and b - a <= limit
        assert repeated == (overlap if k else 0) and (k == 0 or a == one[k - 1][3] - overlap)
        joined += text[max(ca, upto) : cb]
        upto = cb
    assert joined == text and one[0][2] == 0 and one[-1][3] == len(tokens)
    assert spans


def test_cuts_are_the_strongest_and_rightmost():
    text = source(random.Random(3), 60)
    at = np.array([m.span() for m in CODE_TOKEN.finditer(text)])
    s = splitting.strengths(text, at[:, 0], at[:, 1])
    pieces = splitting.cuts(s, 200, 16)
    for a, b in pieces[:-1]:
        window = range(a + 100, a + 201)
        best = max((s[e], s[e - 16], e) for e in window)
        assert (s[b], s[b - 16], b) == best
        assert s[b] >= 5  # a block's end is in every window here
    with pytest.raises(ValueError):
        splitting.cuts(s, 100, 50)


def test_no_boundary_is_cut_at_the_limit():
    text = "x" + " x" * 999
    at = np.array([m.span() for m in CODE_TOKEN.finditer(text)])
    pieces = splitting.cuts(splitting.strengths(text, at[:, 0], at[:, 1]), 100, 10)
    assert all(b - a == 100 for a, b in pieces[:-1])


def test_empty_table_gives_no_pieces(spark):
    rows = spark.createDataFrame([], "record_id bigint, text string")
    assert splitting.split_texts(rows, "record_id", "text").count() == 0


VERSIONS = [
    (1, "luogu", "P1001", "2024-01-01T00:00:00Z", True, 3, "s1", "p1"),
    (2, " LUO_GU", "luogu-p1001", "2024-01-01T08:00:00+08:00", True, 4, "s2", "p2"),
    (3, "洛谷", "Ｐ１００１", None, True, 6, "s3", "p3"),
    (4, "luogu", "P1001.cpp", "2025-05-05T00:00:00", False, 6, "s4", "p4"),
    (5, "cf", "12/a", "n/a", None, 9, None, None),
    (6, "Codeforces", "CF 12 A", "2024-13-01T00:00:00Z", None, -1, None, None),
    (7, "ccpc", "2020  Place-3 ICPC b", None, False, None, "s", "p"),
    (8, "icpc", "2020_place_3_icpc_B", "2020-01-01T00:00:00.5Z", False, 0, "s", "q"),
    (9, None, "P7", None, True, 1, None, None),
    (10, "luogu", " ", None, True, 1, None, None),
    (11, "luogu", "P9", None, True, 1, None, None),
]


SCHEMA = "row_id bigint, source string, problem_id string, timestamp string, compile boolean, style_score int, sha256 string, path string, age_bucket string, rows int"


def test_problem_rows(spark):
    df = spark.createDataFrame([(*v, "b", i) for i, v in enumerate(VERSIONS)], SCHEMA)
    expected = {
        ("luogu", "P1001"): (4, 2, 2, 2),
        ("codeforces", "12A"): (2, 5, None, None),
        ("icpc", "2020_place_3_icpc_B"): (2, 8, 8, 8),
        ("luogu", "P9"): (1, 11, None, 11),
    }
    assert {(r.judge, r.problem): (r.rows, r.version_row, r.time_row, r.style_row) for r in survivors.problem_rows(df).collect()} == expected
    whole = {(r.judge, r.problem): r for r in survivors.problem_survivors(df).collect()}
    assert {k: (r.rows, r.version_row, r.time_row, r.style_row) for k, r in whole.items()} == expected
    assert whole["luogu", "P1001"][6:] == ("p2", "s2", True, "2024-01-01T08:00:00+08:00", "b", 4)
    for empty in (survivors.problem_rows(df.limit(0)), survivors.problem_survivors(df.limit(0))):
        assert empty.count() == 0


def test_a_dependency_changes_the_choice(spark):
    # Row 1 is the best version and the digest s1 has the score 2 (row 4), so row 2's score 6 is not its score. Problem P2: a version of
    # full trust with a score of full trust beats the first version with a lesser score.
    rows = [
        (1, "luogu", "P1", "2024-05-01T00:00:00Z", True, None, "s1", "a"), (2, "luogu", "P1", "2024-04-01T00:00:00Z", True, 6, "s2", "b"),
        (3, "luogu", "P1", None, None, 2, "s3", "c"), (4, "luogu", "P1", "2024-03-01T00:00:00Z", True, 2, "s1", "a"),
        (5, "luogu", "P2", "2024-05-01T00:00:00Z", True, None, "s1", "a"), (6, "luogu", "P2", "2024-04-01T00:00:00Z", True, 6, "s2", "b"), (7, "luogu", "P2", None, None, 2, "s1", "a"),
        (8, "luogu", "P3", "2024-05-01T00:00:00Z", True, None, "s1", "a"), (9, "luogu", "P3", None, True, 3, "s1", "a"), (10, "luogu", "P3", None, True, 4, "s1", "a"),
    ]
    df = spark.createDataFrame([(*v, "b", 0) for v in rows], SCHEMA)
    free = {r.problem: (r.version_row, r.time_row, r.style_row) for r in survivors.problem_rows(df).collect()}
    bound = {r.problem: (r.version_row, r.time_row, r.style_row, r.sha256, r.style_score) for r in survivors.problem_survivors(df).collect()}
    assert free == {"P1": (1, 1, 2), "P2": (5, 5, 6), "P3": (8, 8, 10)}
    # P3: the digest has two scores, so it implies none.
    assert bound == {"P1": (1, 1, 4, "s1", 2), "P2": (6, 5, 6, "s2", 6), "P3": (8, 8, 10, "s1", 4)}


def test_survivors_equal_all_choices(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(60) if i % 3 else 7, rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, None]), rng.randrange(1, 4), rng.randrange(1, 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, g int, k string, v int, ta int, tb int")
    bundles = [survivors.Bundle("a", ("k",), F.col("k").isNotNull(), F.col("ta")), survivors.Bundle("b", ("v",), F.col("v").isNotNull(), F.col("tb"))]
    got = {r.g: (r.rows, r.a_row, r.b_row) for r in survivors.survivors(df, ["g"], [F.col("id") % 5], "id", bundles, [survivors.Dependency(("k",), "v")]).collect()}
    plain = {r.g: (r.a_row, r.b_row) for r in survivors.survivors(df, ["g"], [F.col("id") % 5], "id", bundles).collect()}
    expected = {}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        seen = {}
        for r in own:
            if r[2] is not None and r[3] is not None:
                seen.setdefault(r[2], set()).add(r[3])
        best = None
        for a in [r for r in own if r[2] is not None] + [None]:
            for b in [r for r in own if r[3] is not None] + [None]:
                if a and b and len(seen.get(a[2], ())) == 1 and b[3] not in seen[a[2]]:
                    continue
                ta, tb = a[4] if a else 0, b[5] if b else 0
                rank = (-ta - tb, -ta, (a[0] % 5, a[0]) if a else (), -tb, (b[0] % 5, b[0]) if b else ())
                if best is None or rank < best[0]:
                    best = rank, (len(own), a and a[0], b and b[0])
        expected[g] = best[1]
    assert got == expected
    assert any(plain[g] != expected[g][1:] for g in plain)


def test_only_dependencies_are_searched(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(40) if i % 3 else 7, rng.choice(["x", None, None]), rng.choice([1, None]), rng.randrange(1, 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, g int, k string, v int, t int")
    bundles = [survivors.Bundle("a", ("k",), F.col("k").isNotNull(), F.col("t")), survivors.Bundle("b", ("v",), F.col("v").isNotNull())]
    free = survivors.survivors(df, ["g"], [F.col("id") % 5], "id", bundles)
    best = lambda own, field, trust: min(((-trust(r), r[0] % 5, r[0]) for r in own if r[field] is not None), default=(None,))[-1]
    groups = {g: [r for r in rows if r[1] == g] for g in {r[1] for r in rows}}
    assert {r.g: r[1:] for r in free.collect()} == {g: (len(own), best(own, 2, lambda r: r[4]), best(own, 3, lambda r: 1)) for g, own in groups.items()}
    assert free.dtypes == [("g", "int"), ("rows", "bigint"), ("a_row", "bigint"), ("b_row", "bigint")]
    versions = spark.createDataFrame([(*v, "b", i) for i, v in enumerate(VERSIONS)], SCHEMA)
    searched = {f.__name__: "MapInPandas" in f(versions)._jdf.queryExecution().toString() for f in (survivors.problem_rows, survivors.problem_survivors)}
    assert searched == {"problem_rows": False, "problem_survivors": True}


def test_dependencies_are_checked(spark):
    df = spark.createDataFrame([(i, "g", f"k{i}", i) for i in range(9)], "id bigint, g string, k string, v int")
    bundles = [survivors.Bundle("a", ("k",), F.lit(True)), survivors.Bundle("b", ("v",), F.lit(True))]
    rule = [survivors.Dependency(("k",), "v")]
    assert survivors.survivors(df, ["g"], [], "id", bundles, rule).first()[1:] == (9, 0, 0)
    with pytest.raises(Exception, match="more than 5 values"):
        survivors.survivors(df, ["g"], [], "id", bundles, rule, 5).collect()
    for wrong in (survivors.Dependency(("k",), "k"), survivors.Dependency(("k", "v"), "v")):
        with pytest.raises(ValueError):
            survivors.survivors(df, ["g"], [], "id", bundles, [wrong])


def test_bundles_come_whole_from_one_row(spark):
    rows = [(1, "g", "10 Main St", None, 5, "a@x"), (2, "g", "1 Side St", "Town", 4, None), (3, "g", None, "City", 3, "b@x"), (4, None, "x", "y", 1, None)]
    df = spark.createDataFrame(rows, "id bigint, g string, street string, city string, trust int, mail string")
    bundles = [survivors.Bundle("address", ("street", "city"), F.col("street").isNotNull() & F.col("city").isNotNull()), survivors.Bundle("mail", ("mail",), F.col("mail").isNotNull())]
    chosen = survivors.survivors(df, ["g"], [-F.col("trust")], "id", bundles)
    out = survivors.assembled(chosen, df, ["g"], "id", bundles).collect()
    assert [(r.g, r.rows, r.address_row, r.mail_row, r.street, r.city, r.mail) for r in out] == [("g", 3, 2, 1, "1 Side St", "Town", "a@x")]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_branch_and_bound_equals_trying_all(seed):
    rng = random.Random(seed)
    bundles = rng.randrange(1, 4)
    rules = [(rng.randrange(bundles), rng.randrange(bundles)) for _ in range(rng.randrange(3))]
    rules = [(a, b) for a, b in rules if a != b]
    value = lambda: tuple(rng.choice([None, "x", "y"]) for _ in rules)
    options = [[survivors.Option(float(rng.randrange(1, 4)), (i,), value(), value()) for i in range(rng.randrange(4))] for _ in range(bundles)]

    def fine(choice):
        for k, (a, b) in enumerate(rules):
            if choice[a] is not None and choice[b] is not None:
                implied, held = options[a][choice[a]].implied[k], options[b][choice[b]].held[k]
                if None not in (implied, held) and implied != held:
                    return False
        return True

    total = lambda c: sum(options[b][i].trust for b, i in enumerate(c) if i is not None)
    good = [c for c in itertools.product(*[[*range(len(o)), None] for o in options]) if fine(c)]
    got = survivors.branch_and_bound(options, rules)
    assert fine(got) and total(got) == max(map(total, good))
