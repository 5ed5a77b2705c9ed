"""Process-bound operators: compile and run submissions in Arrow batches, with limits set in the worker.

A task works on its rows one after the other; ``parallel`` spreads them. Results are made idempotent by working in
temporary folders, so a task that is run twice gives the same rows. Speculative execution should be off.
"""

from __future__ import annotations

import os
import resource
import shutil
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validation import checked_names

#: Compiler, standard, and limits.
COMPILER = ("g++", "-std=c++17", "-O2", "-pipe")
COMPILE_SECONDS = 30.0
MESSAGE_CHARS = 2000
STATUSES = ("accepted", "wrong_answer", "runtime_error", "time_limit_exceeded", "output_limit_exceeded")


@lru_cache(maxsize=1)
def compiler_found() -> bool:
    """Whether programs can be compiled here: a driver alone isn't a compiler, so one is tried."""
    if shutil.which(COMPILER[0]) is None:
        return False
    folder = tempfile.mkdtemp(prefix="compiler-")
    try:
        return compile_source("int main() { return 0; }", folder)[0] == "pass"
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def compile_source(code: str, folder: str, syntax_only: bool = False, seconds: float = COMPILE_SECONDS) -> tuple[str, str]:
    """(pass, fail or timeout; the end of the message). The program is ``folder/program``."""
    source = os.path.join(folder, "source.cpp")
    with open(source, "w", encoding="utf-8") as f:
        f.write(code)
    flags = ["-fsyntax-only"] if syntax_only else ["-o", os.path.join(folder, "program")]
    try:
        done = subprocess.run([*COMPILER, *flags, source], capture_output=True, text=True, errors="replace", timeout=seconds)
    except subprocess.TimeoutExpired:
        return "timeout", f"compile exceeded {seconds:g}s"
    return ("pass", "") if done.returncode == 0 else ("fail", done.stderr[-MESSAGE_CHARS:])


def script_source(code: str, folder: str) -> tuple[str, str]:
    """(pass or fail; a message) of a program that needs no compiler: a script that names its interpreter. The program is ``folder/program``."""
    if not code.startswith("#!"):
        return "fail", "a script must name its interpreter"
    program = os.path.join(folder, "program")
    with open(program, "w", encoding="utf-8", newline="\n") as f:
        f.write(code)
    os.chmod(program, 0o700)
    return "pass", ""


def _limits(memory: int, output: int, seconds: float):
    def set_limits() -> None:
        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
        resource.setrlimit(resource.RLIMIT_FSIZE, (output + 1, output + 1))
        cpu = int(seconds) + 1
        resource.setrlimit(resource.RLIMIT_CPU, (cpu, cpu + 1))

    return set_limits


def equal_outputs(actual: bytes, expected: bytes, checker: str) -> bool:
    return actual.split() == expected.split() if checker == "token" else actual == expected


def run_case(program: str, given: bytes, expected: bytes, seconds: float = 2.0, memory_mb: int = 256, output_kb: int = 1024, checker: str = "token") -> tuple[str, float, str]:
    """(status, seconds, message) of one run in a session of its own, which a wall-clock timeout ends whole."""
    folder = tempfile.mkdtemp(prefix="case-")
    try:
        with open(os.path.join(folder, "in"), "wb") as f:
            f.write(given)
        began = time.monotonic()
        with open(os.path.join(folder, "in"), "rb") as source, open(os.path.join(folder, "out"), "wb") as sink, open(os.path.join(folder, "err"), "wb") as errors:
            child = subprocess.Popen([program], stdin=source, stdout=sink, stderr=errors, cwd=folder, start_new_session=True, preexec_fn=_limits(memory_mb << 20, output_kb << 10, seconds))
            try:
                code, late = child.wait(seconds), False
            except subprocess.TimeoutExpired:
                code, late = None, True
            finally:
                try:
                    os.killpg(child.pid, signal.SIGKILL)
                except ProcessLookupError:
                    pass
                child.wait()
        took = time.monotonic() - began
        with open(os.path.join(folder, "out"), "rb") as f:
            actual = f.read()
        if late or code == -signal.SIGXCPU:
            return "time_limit_exceeded", took, f"time limit exceeded ({seconds:g}s)"
        if len(actual) > output_kb << 10 or code == -signal.SIGXFSZ:
            return "output_limit_exceeded", took, "output limit exceeded"
        if code:
            with open(os.path.join(folder, "err"), "rb") as f:
                said = f.read().decode("utf-8", "replace")[-MESSAGE_CHARS:]
            return "runtime_error", took, f"process exited with {code}: {said}".strip()
        return ("accepted", took, "") if equal_outputs(actual, expected, checker) else ("wrong_answer", took, "output differs")
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def compile_gate(df: DataFrame, key: str, code: str, parallel: int, seconds: float = 20.0) -> DataFrame:
    """(key, status, message) of a syntax check of every row; null code fails."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["c"]):
                folder = tempfile.mkdtemp(prefix="gate-")
                try:
                    rows.append((k, *(compile_source(text, folder, True, seconds) if text is not None else ("fail", "no code"))))
                finally:
                    shutil.rmtree(folder, ignore_errors=True)
            yield pd.DataFrame(rows, columns=["k", "status", "message"])

    return df.select(F.col(key).alias("k"), F.col(code).alias("c")).repartition(parallel).mapInPandas(run, f"k {kind}, status string, message string").withColumnRenamed("k", key)


def judge(
    submissions: DataFrame, cases: DataFrame, parallel: int, seconds: float = 2.0, memory_mb: int = 256, output_kb: int = 1024, checker: str = "token", build: Callable[[str, str], tuple[str, str]] = compile_source
) -> DataFrame:
    """(submission, problem, compiled, tests, passed, ac, time, error, cases) of every submission, even those without cases.

    From (submission, problem, code) and (problem, name, input binary, output binary). A problem's cases are few and travel as one array.
    ``build`` makes ``folder/program`` of the code.
    """
    if checker not in ("token", "exact"):
        raise ValueError(f"unknown checker {checker!r}")
    listed = cases.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("name", "input", "output"))).alias("cases"))
    rows = submissions.select("submission", "problem", "code").join(listed, "problem", "left").repartition(parallel)
    schema = "submission string, problem string, compiled boolean, tests int, passed int, ac boolean, time double, error string, cases array<struct<name:string,passed:boolean,status:string,time:double,error:string>>"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                given = [] if row.cases is None else list(row.cases)
                folder = tempfile.mkdtemp(prefix="judge-")
                try:
                    status, message = build(row.code, folder) if row.code else ("fail", "no code")
                    results = []
                    if status == "pass":
                        for case in given:
                            verdict, took, error = run_case(os.path.join(folder, "program"), bytes(case["input"] or b""), bytes(case["output"] or b""), seconds, memory_mb, output_kb, checker)
                            results.append({"name": case["name"], "passed": verdict == "accepted", "status": verdict, "time": took, "error": error})
                    passed = sum(r["passed"] for r in results)
                    error = message if status != "pass" else next((r["error"] for r in results if r["error"]), "")
                    out.append((row.submission, row.problem, status == "pass", len(given), passed, status == "pass" and bool(given) and passed == len(given), max((r["time"] for r in results), default=0.0), error, results))
                finally:
                    shutil.rmtree(folder, ignore_errors=True)
            yield pd.DataFrame(out, columns=["submission", "problem", "compiled", "tests", "passed", "ac", "time", "error", "cases"])

    return rows.mapInPandas(run, schema)


def evaluate(models: list[str], problems: DataFrame, outputs: DataFrame, cases: DataFrame, parallel: int, **limits) -> tuple[DataFrame, DataFrame]:
    """Details (model, problem, compile, ac, time, tests, passed, error) of every model and problem, and a summary (model, total, compile, compile_rate, ac, ac_rate).

    From (problem), (model, problem, code) and the cases of ``judge``. A pair without an output, or without cases, fails with a row of its own.
    """
    names = problems.sparkSession.createDataFrame([(m,) for m in checked_names(models)], "model string")
    grid = names.join(F.broadcast(problems.select("problem").distinct()), how="cross").join(outputs.select("model", "problem", "code"), ["model", "problem"], "left")
    judged = judge(grid.where("code is not null").select(F.col("model").alias("submission"), "problem", "code"), cases, parallel, **limits).withColumnRenamed("submission", "model")
    done = grid.select("model", "problem").join(judged, ["model", "problem"], "left")
    details = done.select(
        "model", "problem", F.coalesce("compiled", F.lit(False)).alias("compile"), F.coalesce("ac", F.lit(False)).alias("ac"), F.coalesce("time", F.lit(0.0)).alias("time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tests", "passed")], F.coalesce("error", F.lit("no output")).alias("error"),
    )
    rates = [F.count("*").alias("total"), F.count_if("compile").alias("compile"), F.round(F.count_if("compile") / F.count("*"), 6).alias("compile_rate"), F.count_if("ac").alias("ac"), F.round(F.count_if("ac") / F.count("*"), 6).alias("ac_rate")]
    return details, details.groupBy("model").agg(*rates)


#: Limits of a run on samples, and how much of its texts is kept.
SAMPLE_MEMORY_MB, SAMPLE_CPU, SAMPLE_OUTPUT_KB = 512, 3, 1024
SAMPLE_TEXT, SAMPLE_ERROR = 500, 1000


def run_sample(program: str, given: str, expected: str, seconds: float = 3.0) -> dict[str, object]:
    """Status, expected and actual text, message and exit code of a run on a sample: too much output counts before a bad exit."""
    most = SAMPLE_OUTPUT_KB << 10
    with tempfile.TemporaryFile() as sink, tempfile.TemporaryFile() as errors:
        child = subprocess.Popen([program], stdin=subprocess.PIPE, stdout=sink, stderr=errors, start_new_session=True, preexec_fn=_limits(SAMPLE_MEMORY_MB << 20, most - 1, SAMPLE_CPU - 1))
        try:
            child.communicate(given.encode("utf-8"), seconds)
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, signal.SIGKILL)
            child.wait()
            return {"status": "time_limit_exceeded", "expected": expected[:SAMPLE_TEXT], "actual": "", "error": f"exceeded {seconds:g}s", "returncode": None}
        sink.seek(0)
        errors.seek(0)
        actual = sink.read()
        text = actual.decode("utf-8", "replace")
        status = "output_limit_exceeded" if len(actual) >= most else "runtime_error" if child.returncode else "accepted" if text.split() == expected.split() else "wrong_answer"
        return {"status": status, "expected": expected[:SAMPLE_TEXT], "actual": text[:SAMPLE_TEXT], "error": errors.read().decode("utf-8", "replace")[-SAMPLE_ERROR:], "returncode": child.returncode}


_VERIFIED = "id string, compile boolean, status string, compile_error string, samples int, passed int, cases array<struct<index:int,status:string,expected:string,actual:string,error:string,returncode:int>>"


def verify_pairs(pairs: DataFrame, parallel: int, seconds: float = 3.0, build: Callable[[str, str], tuple[str, str]] = compile_source) -> DataFrame:
    """(id, compile, status, compile_error, samples, passed, cases) of every pair run on its samples; from (id, code, samples array<struct<input, output>>).

    Samples with a blank side are unparseable and fail. Null code doesn't compile.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                samples = [] if row.samples is None else list(row.samples)
                folder = tempfile.mkdtemp(prefix="verify-")
                try:
                    built, message = build(row.code, folder) if row.code else ("fail", "no code")
                    cases = []
                    if built == "pass":
                        for i, sample in enumerate(samples, 1):
                            given, expected = (sample or {}).get("input"), (sample or {}).get("output")
                            if not (given and given.strip() and expected and expected.strip()):
                                cases.append({"index": i, "status": "unparseable_sample", "expected": None, "actual": None, "error": None, "returncode": None})
                            else:
                                cases.append({"index": i, **run_sample(os.path.join(folder, "program"), given, expected, seconds)})
                    passed = sum(c["status"] == "accepted" for c in cases)
                    out.append((row.id, built == "pass", verification_label(built, len(cases), passed), None if built == "pass" else message, len(cases), passed, cases))
                finally:
                    shutil.rmtree(folder, ignore_errors=True)
            yield pd.DataFrame(out, columns=["id", "compile", "status", "compile_error", "samples", "passed", "cases"])

    return pairs.select("id", "code", "samples").repartition(parallel).mapInPandas(run, _VERIFIED)


def verification_label(built: str, samples: int, passed: int) -> str:
    """The status of a pair, as ``functions.classify.verification_status`` has it for columns."""
    if built != "pass":
        return "compile_timeout" if built == "timeout" else "compile_error"
    if not samples:
        return "no_executable_sample"
    return "all_samples_passed" if passed == samples else "partial_sample_failure" if passed else "all_samples_failed"
