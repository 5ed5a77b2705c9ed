import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html
from corpusloom.operators import judging
from corpusloom.operators.validation import ExpectationError
from corpusloom.sources import readers, writers
from corpusloom.streaming import incremental


def test_strict_json_lines(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": 1, "t": "x"}\n\n  \n{"id": 2, "t": null}\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_jsonl(spark, str(good), "id bigint, t string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="not a valid row"):
        readers.read_jsonl(spark, str(good), "id bigint, t string", ["t"]).collect()
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": 1, "t": "x"}\n[1]\n{"id": \n', encoding="utf-8")
    with pytest.raises(Exception, match="not a valid row"):
        readers.read_jsonl(spark, str(bad), "id bigint, t string").collect()
    assert sorted(r.value for r in readers.broken_lines(spark, str(bad), "id bigint, t string").collect()) == ["[1]", '{"id": ']


def test_manifest_checks(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('# note\n{"id": "p1", "oj": "luogu"}\n{"id": "p2", "oj": "icpc"}\n', encoding="utf-8")
    read = lambda **kw: readers.read_manifest(spark, str(path), "id string, oj string", "id", **kw)
    assert read(enums={"oj": ["luogu", "icpc"]}, count=2).count() == 2
    with pytest.raises(ExpectationError):
        read(enums={"oj": ["luogu"]})
    with pytest.raises(ExpectationError):
        read(count=3)
    path.write_text('{"id": "../x", "oj": "luogu"}\n', encoding="utf-8")
    with pytest.raises(ExpectationError):
        read()
    path.write_text('{"id": "p1", "oj": "a"}\n{"id": "p1", "oj": "b"}\n', encoding="utf-8")
    with pytest.raises(ExpectationError):
        read()


def test_details_in_partitions(spark, tmp_path):
    for p in ("P0", "P1"):
        (tmp_path / f"prompt={p}").mkdir()
        (tmp_path / f"prompt={p}" / "d.json").write_text(json.dumps([{"model": "a", "ac": p == "P0"}]), encoding="utf-8")
    rows = readers.read_details(spark, str(tmp_path), "model string, ac boolean", ["prompt", "model"])
    assert {tuple(r) for r in rows.collect()} == {("a", True, "P0"), ("a", False, "P1")}
    with pytest.raises(ExpectationError):
        readers.read_details(spark, str(tmp_path), "model string, ac boolean", ["model"])
    assert readers.read_json_document(spark, str(tmp_path / "prompt=P0" / "d.json")).count() == 1


def test_raw_files_and_decoding(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.cpp").write_bytes("// 中\r\n".encode("gb18030"))
    (tmp_path / "d" / "e" / "b.cpp").write_bytes("// é".encode())
    (tmp_path / "d" / "c.txt").write_bytes(b"no")
    (tmp_path / "d" / "x.cpp").write_bytes(b"\xff\xff\xff")
    files = readers.read_raw_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: tuple(r.d) for r in files.select("path", readers.decoded("content").alias("d")).collect()}
    assert got == {"a.cpp": ("// 中\r\n", "gb18030"), "b.cpp": ("// é", "utf-8"), "x.cpp": (None, None)}


def test_statement_and_case_files(spark, tmp_path):
    (tmp_path / "s" / "luogu").mkdir(parents=True)
    (tmp_path / "s" / "luogu" / "p1.md").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "s" / "Q2.txt").write_text("two", encoding="utf-8")
    assert {tuple(r) for r in readers.statement_index(spark, str(tmp_path / "s")).collect()} == {("luogu", "P1", "one\ntwo\n"), ("unknown", "Q2", "two")}
    keyed = readers.read_keyed_texts(spark, str(tmp_path / "s"), "md", ["source", "problem"])
    assert [tuple(r) for r in keyed.collect()] == [("luogu", "p1", "one\ntwo\n")]
    tests = tmp_path / "p" / "p001" / "tests"
    tests.mkdir(parents=True)
    for name in ("input01.txt", "output01.txt", "input02.txt"):
        (tests / name).write_bytes(name.encode())
    (tmp_path / "p" / "p001" / "meta.yaml").write_text("id: p001\nchecker:\n  type: token\ntime_limit_seconds: 1.5\n", encoding="utf-8")
    cases = {r.suffix: (r.input, r.output) for r in readers.test_cases(spark, str(tmp_path / "p")).collect()}
    assert cases == {"01": (b"input01.txt", b"output01.txt"), "02": (b"input02.txt", None)}
    metas = {(r.problem, r.key): r.value for r in readers.read_metas(spark, str(tmp_path / "p")).collect()}
    assert metas == {("p001", "id"): "p001", ("p001", "checker.type"): "token", ("p001", "time_limit_seconds"): "1.5"}


def test_configuration():
    text = "a: 1\nb:\n  c: 'x'\n  d: true\n# note\ne: 1.5\nf: plain text\n"
    assert readers.parse_config(text) == {"a": 1, "b.c": "x", "b.d": True, "e": 1.5, "f": "plain text"}
    for bad in ("no colon", "  x: 1"):
        with pytest.raises(ExpectationError):
            readers.parse_config(bad)
    assert readers.limits_of({})["memory_limit_mb"] == 256
    for bad in ({"memory_limit_mb": 0}, {"time_limit_seconds": True}, {"checker.type": "fuzzy"}):
        with pytest.raises(ExpectationError):
            readers.limits_of(bad)


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_history(spark, tmp_path):
    run = lambda *a, when: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_DATE": when, "HOME": str(tmp_path)})
    run("init", "-q", when="@1000 +0000")
    for when, names in (("@1000 +0000", ["a.cpp", "b.cpp"]), ("@2000 +0000", ["a.cpp"])):
        for n in names:
            (tmp_path / n).write_text(when)
        run("add", ".", when=when)
        run("commit", "-qm", f"at {when}", when=when)
    log = spark.createDataFrame(readers.history_log(str(tmp_path)), "file string, line int, value string")
    got = {r.path: (r.committed_at.timestamp(), r.subject) for r in readers.history(spark, log).select("path", "committed_at", "subject").collect()}
    assert {k: v[1] for k, v in got.items()} == {"a.cpp": "at @2000 +0000", "b.cpp": "at @1000 +0000"}


PAGES = {
    ("luogu", "P1"): '<html><script type="application/json">{"data": {"problem": {"pid": "P1", "title": "T", "description": "D", "inputFormat": "I", "outputFormat": "O", "hint": "H", "samples": [["1", "2"], ["3", "4"]]}}}</script></html>',
    ("codeforces", "1A"): '<div class="problem-statement"><div class="header"><div class="title">A. Name</div></div><div>Body <b>bold</b><p>two</div><div class="input-specification"><div class="section-title">Input</div><p>in</p></div><div class="output-specification"><div class="section-title">Output</div>out<br>more</div><div class="sample-test"><div class="input"><pre>1 2\n3</pre></div><div class="output"><pre>x</pre></div></div></div>',
    ("luogu", "P2"): "<article><h1>P2 Name</h1><h2>题目描述</h2><p>text &amp; more <img alt='pic'></p><script>var x</script><h2>输入格式</h2><ul><li>a</li><li>b</li></ul><h2>输出格式</h2><p>o</p><pre>1</pre><pre>2</pre></article></bogus>",
    ("luogu", "P3"): "<html>Checking your browser</html>",
}


def test_pages_replayed(spark):
    pages = spark.createDataFrame([(*k, v) for k, v in PAGES.items()], "source string, problem_id string, html string")
    manifest = pages.select("source", "problem_id").unionByName(spark.createDataFrame([("luogu", "P9")], "source string, problem_id string"))
    got = {(r.source, r.problem_id): r for r in readers.replay_pages(manifest, pages).collect()}
    one, two, three = got["luogu", "P1"], got["codeforces", "1A"], got["luogu", "P2"]
    assert (one.title, one.statement, one.input, one.output, one.constraints) == ("T", "D", "I", "O", "H")
    assert [tuple(s) for s in one.samples] == [("1", "2"), ("3", "4")]
    assert two.title == "A. Name" and two.statement == "Body bold\ntwo" and two.input == "in" and two.output == "out\nmore"
    assert [tuple(s) for s in two.samples] == [("1 2\n3", "x")]
    assert three.title == "P2 Name" and three.statement == "text & more pic" and three.input == "a\n\nb" and three.output == "o"
    assert [tuple(s) for s in three.samples] == [("1", "2")]
    assert got["luogu", "P3"].error == "blocked: checking your browser" and got["luogu", "P3"].manual_required
    assert got["luogu", "P9"].error == "not_cached" and not got["luogu", "P9"].success
    page = readers.replay_pages(manifest, pages).where("problem_id = 'P1'")
    text = page.select(html.statement_markdown(*[F.col(c) for c in ("title", "statement", "input", "output", "constraints", "samples")]).alias("m")).first().m
    assert text.startswith("# T\n\n## 题目描述\n\nD") and "## 样例 2" in text and "## 数据范围\n\nH" in text


def test_page_metadata(spark):
    rows = [("luogu", "P1", '{"difficulty": 3}'), ("luogu", "P2", '"difficulty":8'), ("codeforces", "1A", '<span class="tag-box" title="x"> dp </span><span class="tag-box">*1300</span>'), ("codeforces", "1B", "")]
    got = {r.problem_id: (r.difficulty, r.tags, r.rating) for r in readers.page_metadata(spark.createDataFrame(rows, "source string, problem_id string, html string")).collect()}
    assert got == {"P1": ("medium", [], None), "P2": ("unknown", [], None), "1A": ("medium", ["dp"], 1300), "1B": ("unknown", [], None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a|b"), (2, "test", None)], "id bigint, split string, t string").withColumn("hidden", F.lit(1))
    out = str(tmp_path / "j")
    writers.write_jsonl(df, out, ["hidden"], files=1)
    assert readers.read_jsonl(spark, out, "id bigint, split string, t string").count() == 2
    with pytest.raises(Exception, match="already exists"):
        writers.write_jsonl(df, out)
    writers.write_jsonl(df, out, overwrite=True)
    writers.write_splits(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=train")).count() == 1
    writers.write_texts(df, str(tmp_path / "t"), ["split", "id"], "t", "md")
    assert (tmp_path / "t" / "train" / "1.md").read_text() == "a|b" and (tmp_path / "t" / "test" / "2.md").read_text() == ""
    with pytest.raises(ExpectationError):
        readers.safe_name("../x")
    writers.write_report({"a": "é"}, str(tmp_path / "r" / "r.json"))
    assert json.loads((tmp_path / "r" / "r.json").read_text(encoding="utf-8")) == {"a": "é"}
    table = writers.markdown_table(df.select("id", "t").orderBy("id"), "Report")
    assert table == "# Report\n\n| id | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        writers.markdown_table(df, most=1)
    assert writers.percentage(1, 3) == "33.33%" and writers.percentage(0, 0) == "0.00%"


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:20", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 00:01:20", "a")]
    spark.createDataFrame(rows, "ts string, t string").coalesce(1).write.json(str(source / "x"))
    stream = spark.readStream.schema("ts string, t string").json(str(source / "*")).withColumn("ts", F.to_timestamp("ts"))

    def result(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    first = result(incremental.first_seen(stream, F.sha2("t", 256), "ts"), "first_rows", "append")
    assert sorted(r.t for r in first) == ["a", "b"]
    counts = result(incremental.windowed_counts(stream, "ts", ["t"], "1 minute"), "counts", "complete")
    assert sorted((r.window_start.minute, r.t, r.n) for r in counts) == [(0, "a", 2), (1, "a", 1), (1, "b", 1)]
    done = incremental.not_done(spark.range(3), spark.range(1), ["id"])
    assert sorted(r.id for r in done.collect()) == [1, 2]


SCRIPTS = {"right": "read a; echo $((a * 2))", "wrong": "read a; echo $a", "crash": "exit 3", "loop": "while :; do :; done", "flood": "while :; do echo xxxxxxxxxxxxxxxxxxxx; done"}


def test_cases_run_within_limits(tmp_path):
    got = {}
    for name, body in SCRIPTS.items():
        program = tmp_path / name
        program.write_text(f"#!/bin/sh\n{body}\n")
        program.chmod(0o755)
        got[name] = judging.run_case(str(program), b"21\n", b"42", seconds=1.0, output_kb=16)[0]
    assert got == {"right": "accepted", "wrong": "wrong_answer", "crash": "runtime_error", "loop": "time_limit_exceeded", "flood": "output_limit_exceeded"}
    assert judging.equal_outputs(b"1 2", b"1  2\n", "token") and not judging.equal_outputs(b"1 2", b"1  2\n", "exact")


def test_judging_without_code(spark):
    submissions = spark.createDataFrame([("a", "p", None)], "submission string, problem string, code string")
    cases = spark.createDataFrame([], "problem string, name string, input binary, output binary")
    row = judging.judge(submissions, cases, 1).first()
    assert (row.compiled, row.tests, row.ac, row.error, row.cases) == (False, 0, False, "no code", [])


PROGRAM = "#include <iostream>\nint main(){ int a; std::cin >> a; %s }"


@pytest.mark.skipif(not judging.compiler_found(), reason="no compiler")
def test_judging(spark):
    programs = {
        "right": PROGRAM % "std::cout << a * 2 << '\\n';",
        "wrong": PROGRAM % "std::cout << a;",
        "crash": PROGRAM % "if (a > 1) return 3; std::cout << 2;",
        "loop": PROGRAM % "while (true) {}",
        "flood": PROGRAM % "for (int i = 0; i < 400000; i++) std::cout << \"xxxxxxxxxx\";",
        "broken": "int main( {",
        "none": None,
    }
    submissions = spark.createDataFrame([(k, "p", v) for k, v in programs.items()] + [("right", "q", programs["right"])], "submission string, problem string, code string")
    cases = spark.createDataFrame([("p", "01", b"1", b"2 \n"), ("p", "02", b"5", b"10")], "problem string, name string, input binary, output binary")
    got = {(r.submission, r.problem): r for r in judging.judge(submissions, cases, 4, seconds=1.0, output_kb=64).collect()}
    assert got["right", "p"].ac and got["right", "p"].passed == 2
    assert not got["right", "q"].ac and got["right", "q"].compiled and got["right", "q"].tests == 0
    statuses = {k: [c.status for c in got[k, "p"].cases] for k in programs}
    assert statuses["wrong"] == ["wrong_answer"] * 2 and statuses["crash"] == ["accepted", "runtime_error"]
    assert statuses["loop"] == ["time_limit_exceeded"] * 2 and statuses["flood"] == ["output_limit_exceeded"] * 2
    assert not got["broken", "p"].compiled and "error" in got["broken", "p"].error and got["none", "p"].error == "no code"
    gate = {r.submission: r.status for r in judging.compile_gate(submissions.where("problem = 'p'").select("submission", "code"), "submission", "code", 2).collect()}
    assert gate["right"] == "pass" and gate["broken"] == "fail" and gate["none"] == "fail"
