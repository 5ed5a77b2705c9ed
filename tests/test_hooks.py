import pytest
from pyspark.sql import functions as F

from corpusloom.functions import registry
from corpusloom.functions.tokens import CODE_TOKEN
from corpusloom.operators import chunking, generation, validation
from corpusloom.sources import readers


def test_functions_by_name(spark):
    names = registry.register_all(spark)
    assert set(names) == {*registry.FUNCTIONS, "chunk_spans"}
    assert spark.sql("select mask_literals('a // b') as x, token_shingles('a b').tokens as n").first()[:] == ("a     ", 2)
    spans = [tuple(r) for r in spark.sql("select * from chunk_spans(1000, 512, 64, 64)").collect()]
    assert spans == [(0, 0, 512), (1, 448, 960), (2, 896, 1000)]


def test_generation_hook(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k bigint, p string")
    got = {r.k: r.output for r in generation.generated(df, "k", "p", lambda: lambda ps: [p * 2 for p in ps], 2).collect()}
    assert got == {1: "aa", 2: None, 3: "bb"}


def test_chunk_texts_are_stretches(spark):
    text = "  " + " ".join(f"x{i};" for i in range(700)) + "\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "a b"), (4, "")], "k int, t string")
    rows = sorted(chunking.chunk_texts(df, "k", "t", 200, 20, 20).collect(), key=lambda r: r.chunk_index)
    tokens = CODE_TOKEN.findall(text)
    spans = sorted((r.token_start, r.token_end) for r in chunking.chunk_spans(spark.createDataFrame([(1, len(tokens))], "k int, n int"), "k", "n", 200, 20, 20).collect())
    assert {r.k for r in rows} == {1} and [(r.token_start, r.token_end) for r in rows] == spans
    assert all(r.text in text and CODE_TOKEN.findall(r.text) == tokens[r.token_start : r.token_end] for r in rows)


def test_pages_are_fetched_with_retries(spark):
    def fetch(url):
        if url == "down":
            raise OSError("no route")
        return {"ok": (200, "page"), "busy": (503, None), "gone": (404, None)}[url]

    df = spark.createDataFrame([("s", u, u) for u in ("ok", "busy", "gone", "down")] + [("s", "none", None)], "source string, problem_id string, url string")
    got = {r.problem_id: (r.html, r.error) for r in readers.fetch_pages(df, fetch, spacing=0.0).collect()}
    assert got == {"ok": ("page", None), "busy": (None, "status 503"), "gone": (None, "status 404"), "down": (None, "failed: no route"), "none": (None, "no address")}


def test_audit(spark):
    manifest = spark.createDataFrame([("p1", "luogu"), ("p2", "icpc"), ("p3", "x")], "id string, oj string")
    texts = spark.createDataFrame([("p1", "statement.md", "s"), ("p1", "reference.cpp", "r"), ("p2", "statement.md", " ")], "id string, file string, text string")
    cases = spark.createDataFrame([("p1", "1", b"a", b"b"), ("p2", "1", b"a", None)], "id string, suffix string, input binary, output binary")
    metas = spark.createDataFrame([("p1", "oj", "luogu"), ("p1", "checker.type", "token"), ("p2", "oj", "other"), ("p2", "checker.type", "fuzzy")], "id string, key string, value string")
    got = {r.id: r.errors for r in validation.audit_problems(manifest, texts, cases, metas, ["statement.md", "reference.cpp"], ["oj"], ["token", "exact"]).collect()}
    assert got == {"p1": [], "p2": ["missing_reference.cpp", "missing_statement.md", "oj_differs", "unknown_checker", "unpaired_cases"], "p3": ["missing_reference.cpp", "missing_statement.md", "no_cases", "oj_differs"]}
    again = manifest.where("id <> 'p3'").withColumn("oj", F.when(F.col("id") == "p2", "new").otherwise(F.col("oj")))
    assert {r.id: r.fields for r in validation.consistent(manifest, again, ["id"], ["oj"]).collect()} == {"p2": ["oj"], "p3": ["oj", "missing"]}
    assert validation.checked_names(["a", "b"]) == ["a", "b"]
    for bad in ([], ["a", "a"], ["a/b"]):
        with pytest.raises(validation.ExpectationError):
            validation.checked_names(bad)


def test_text_sources(spark, tmp_path):
    path = tmp_path / "w.jsonl"
    path.write_text('{"text": "a", "time_weight": 2.0}\n', encoding="utf-8")
    assert readers.read_weighted_texts(spark, str(path)).first()[:] == ("a", 2.0)
    path2 = tmp_path / "v.jsonl"
    path2.write_text('{"text": "a", "time_weight": 0}\n', encoding="utf-8")
    with pytest.raises(Exception, match="positive"):
        readers.read_weighted_texts(spark, str(path2)).collect()
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "p1.cpp").write_text("int x;\nint y;", encoding="utf-8")
    assert [tuple(r) for r in readers.read_outputs(spark, str(tmp_path)).collect()] == [("m1", "p1", "int x;\nint y;")]
    pairs = tmp_path / "p.jsonl"
    pairs.write_text('{"id": "1", "instruction": "i", "response": "r"}\n' * 3, encoding="utf-8")
    assert readers.read_pairs(spark, str(pairs), 2).count() == 2
    assert readers.prompt_template("x {problem}") == "x {problem}"
    with pytest.raises(validation.ExpectationError):
        readers.prompt_template("{problem} {problem}")
