"""Style vectors, masked code, answers with flags, and categories, on small texts with known results."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import classify, extract
from corpusloom.functions import features as ft
from corpusloom.functions import identifiers as ids

CODE = """#include <bits/stdc++.h>
using namespace std;
// vector<int> in a comment
int grid[10][20];
const int MAXN = 5;
int main() {
    ios::sync_with_stdio(false); /* map<int, int> m; */
    int a, b_c; vector<int> xs; string someName = "set<int> {";
    return 0;
}
"""


def first(spark, text, columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns(F.col("t"))).first().asDict()


def test_style_vector(spark):
    got = first(spark, CODE, ft.style_vector)
    assert got == {
        "vector": True, "static_array": True, "maxn_or_maxm": True, "bits_stdcpp": True, "using_namespace_std": True, "global_array": True, "fast_io": True,
        "line_comment": True, "block_comment": True, "any_comment": True, "line_comment_count": 1, "block_comment_count": 1, "variable_declaration_count": 5,
        "single_letter_variable_count": 1, "snake_case_variable_count": 0, "camel_case_variable_count": 1, "variable_name_characters": 21,
    }
    assert set(first(spark, "", ft.style_vector).values()) == {False, 0} and len(got) == 17
    assert set(first(spark, None, ft.style_vector).values()) <= {None, -1}


@pytest.mark.parametrize("patterns", [ft.COMPARE_PATTERNS, ft.ABLATION_PATTERNS, ft.ANSWER_PATTERNS, ft.FIRST_ANSWER_PATTERNS, ft.STRICT_ANSWER_PATTERNS])
def test_pattern_vectors_equal_plain_python(spark, patterns):
    texts = [CODE, "", "#include<bits/stdc++.h>\n#define int long long\nsigned main(){Node t[5][6];\n  Node q[5];\nstd :: vector <int> v;ios_base::sync_with_stdio(0);cin . tie(0);}", "unordered_map<int,int> m; std::set<int> s;\nstatic constexpr auto MAX_Q = 1;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *ft.pattern_vector(F.col("t"), patterns)).orderBy("i").collect()
    for row, text in zip(rows, texts):
        assert row.asDict() == {"i": row.i} | {n: bool(re.search(p, text)) for n, p in patterns.items()}


def test_masked_code_keeps_lines(spark):
    df = spark.createDataFrame([(CODE,), ("a\n}\n}\nb {\nc\n}\nd",), (None,)], "t string")
    masked = [r[0] for r in df.select(ft.mask_literals(F.col("t"))).collect()]
    assert len(masked[0]) == len(CODE) and masked[0].count("\n") == CODE.count("\n") and "map<" not in masked[0] and "set<" not in masked[0] and "comment" not in masked[0]
    assert [r[0] for r in df.select(ft.top_level(F.col("t"))).collect()][1:] == ["a\n}\n}\nb {\nd", None]


ANSWERS = {
    "fenced": "Sure:\n```cpp\nint main(){}\n```\nand ```c++\nint main() { return 0; }\n``` done",
    "code": "#include <a>\nint main(){ return 0; }",
    "prose": "Here it is:\nint main(){ return 0; }\nBye",
    "none": "no code",
    "empty": " ",
}


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ("longest", {"fenced": ("int main() { return 0; }", True, True, False), "code": (ANSWERS["code"], False, False, True), "prose": ("int main(){ return 0; }", False, True, False), "none": ("no code", False, True, False), "empty": ("", False, False, False)}),
        ("first", {"fenced": ("int main(){}", True, True, False), "code": (ANSWERS["code"], False, False, True), "prose": (ANSWERS["prose"], False, True, False), "none": ("no code", False, True, False), "empty": ("", False, True, False)}),
        ("strict", {"fenced": ("int main(){}", True, True, False), "code": (ANSWERS["code"], False, False, True), "prose": (ANSWERS["prose"], False, True, False), "none": ("no code", False, True, False), "empty": ("", False, True, False)}),
    ],
)
def test_answers(spark, rule, expected):
    df = spark.createDataFrame(list(ANSWERS.items()), "name string, text string")
    got = {r.name: (r.code, r.had_markdown_fence, r.extra_natural_language, r.strict_code_only) for r in extract.with_answer(df, F.col("text"), rule).collect()}
    assert got == expected
    with pytest.raises(ValueError):
        extract.with_answer(df, F.col("text"), "other")


def test_identifiers_of_paths(spark):
    rows = [("a/CF1234A.cpp", "p1", "1234A", False), ("a/cf1234.cpp", "p1", "1234A", False), ("icpc/12/x.cpp", "p2", "icpcx12", False), ("x12/y.cpp", "p2", "icpcx12", False), ("a/12.cpp", "p2", "icpc12", True), ("P3/x.cpp", "p3", "z", True), (None, "p3", "z", None)]
    df = spark.createDataFrame(rows, "path string, id string, number string, hit boolean")
    got = df.select(ids.path_has_identifier(F.col("path"), ids.identifier_forms(F.col("id"), F.col("number"))).alias("got"), "hit").collect()
    # 1234A is the tokens CF1234 and A in the first path, so neither names it; icpcx is no judge, so its 12 isn't looked for.
    assert [r.got for r in got] == [r.hit for r in got] == [False, False, False, False, True, True, None]
    forms = df.select(ids.identifier_forms(F.col("id"), F.col("number"))).collect()
    assert [r[0] for r in forms][2:5] == [["p2", "icpcx12"], ["p2", "icpcx12"], ["p2", "icpc12", "12"]]


def test_later_categories(spark):
    rows = [("error: 'accumulate' was not declared in this scope", "int main(){}", "missing_include"), ("'accumulate' was not declared in this scope", "#include <numeric>", "undeclared_identifier"), ("undefined reference to f", "x", "undeclared_identifier"), ("expected ';' before '}'", "x", "syntax_error"), ("strange", "x", "other"), (None, "x", None)]
    df = spark.createDataFrame(rows, "m string, c string, e string")
    got = [r[0] for r in df.select(classify.later_category(F.col("m"), F.col("c"))).collect()]
    assert got[:5] == [r[2] for r in rows[:5]]


def test_limit_messages_by_mode(spark):
    df = spark.createDataFrame([("time limit hit",), ("File size limit exceeded",), ("size limit",)], "m string")
    full, short = (df.select(classify.submission_status(F.lit(False), F.lit(True), F.col("m"), texts=t)).collect() for t in (classify.LIMIT_TEXTS, classify.SHORT_LIMIT_TEXTS))
    assert [r[0] for r in full] == ["wrong_answer", "output_limit_exceeded", "wrong_answer"]
    assert [r[0] for r in short] == ["time_limit_exceeded", "output_limit_exceeded", "output_limit_exceeded"]


def test_conflicting_candidates(spark):
    df = spark.createDataFrame([("luogu", "p1", ["luogu:P1"]), ("luogu", "P1", ["luogu:P1", "luogu:P2"]), ("luogu", "P1", ["codeforces:1A"]), ("luogu", "P1", None), (None, "P1", ["luogu:P2"])], "s string, p string, c array<string>")
    assert [r[0] for r in df.select(ids.conflicting(F.col("s"), F.col("p"), F.col("c"))).collect()] == [False, True, False, False, False]
