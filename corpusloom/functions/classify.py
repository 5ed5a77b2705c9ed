"""Classifiers: ordered rules as one conditional expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered pattern groups of compiler messages.
COMPILE_ERRORS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("template_error", ("template argument", "template-id", "no matching function.*template", "type/value mismatch at argument")),
    ("missing_symbol", ("undefined reference", "is not a member of", "incomplete type", "cannot find -l", r"ld returned \d+ exit status")),
    ("undeclared_identifier", ("was not declared in this scope", "undeclared identifier", "has not been declared")),
    ("type_error", ("invalid conversion", "cannot convert", "no match for .?operator", "incompatible type", "invalid operands", "reference to .+ is ambiguous", "has no member named")),
    ("syntax_error", ("missing terminating", "stray .+ in program", "expected .+ before", "expected .+ at end", "expected declaration", "does not name a type", "redefinition of")),
)
#: Traces of a crashed process.
RUNTIME_MARKERS = ("process exited", "assert", "double free", "corruption", "segmentation", "invalid pointer", "core dumped")
#: Symbols and the header each needs.
MISSING_INCLUDES = {"accumulate": "numeric", "reverse": "algorithm", "__gcd": "algorithm", "setprecision": "iomanip", "int_max": "climits", "llong_max": "climits"}
#: Categories of the later report.
LATER_CATEGORIES = ("missing_include", "undeclared_identifier", "syntax_error", "type_error", "template_error", "other")
#: What the two limit messages contain, as a whole and in short.
LIMIT_TEXTS = {"output": ("output limit", "size limit exceeded"), "time": ("time limit exceeded",)}
SHORT_LIMIT_TEXTS = {"output": ("output limit", "size limit"), "time": ("time limit",)}
#: Short labels of statuses.
STATUS_LABELS = {"accepted": "AC", "compile_error": "CE", "wrong_answer": "WA", "runtime_error": "RE", "time_limit_exceeded": "TLE", "output_limit_exceeded": "OLE"}
#: Findings and statuses that prove a pair wrong.
CLEAR_REVIEW = ("code_error", "problem_id_mapping_error", "statement_parse_error", "multiple_testcase_format")
CLEAR_RUNTIME = ("compile_error", "compile_timeout", "runtime_error", "time_limit_exceeded", "output_limit_exceeded")
_CASE_ORDER = ("output_limit_exceeded", "time_limit_exceeded", "runtime_error", "wrong_answer")


def compile_error_category(message: Column) -> Column:
    """The first group of which a pattern occurs, else other."""
    text, out = F.lower(message), None
    for name, patterns in COMPILE_ERRORS:
        test = text.rlike("(?s)" + "|".join(patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def _marked(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def submission_status(accepted: Column, compiled: Column, error: Column, cases: Column | None = None, limits: tuple[str, str] = ("output", "time"), texts: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Status of a judged submission; ``limits`` is the order in which the two limit messages are looked for, ``texts`` what they contain."""
    texts = texts or LIMIT_TEXTS
    text = F.lower(F.coalesce(error, F.lit("")))
    tests = {name: (_marked(text, texts[name]), f"{name}_limit_exceeded") for name in ("output", "time")}
    out = F.when(accepted, "accepted").when(~compiled, "compile_error")
    for limit in limits:
        out = out.when(*tests[limit])
    out = out.when(_marked(text, RUNTIME_MARKERS), "runtime_error")
    if cases is not None:
        for status in _CASE_ORDER:
            out = out.when(F.array_contains(cases, status), status)
    return out.otherwise("wrong_answer")


def status_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair]), status), status)


def missing_include(message: Column, code: Column) -> Column:
    """Whether a symbol is complained of whose header the code doesn't include."""
    error, text = F.lower(message), F.lower(code)
    out = F.lit(False)
    for symbol, header in MISSING_INCLUDES.items():
        out = out | (F.contains(error, F.lit(symbol)) & ~F.contains(text, F.lit(f"#include <{header}>")))
    return out & ~F.contains(text, F.lit("bits/stdc++.h"))


def later_category(message: Column, code: Column) -> Column:
    """Category of the later report: a missing include first, then the first group, missing symbols as undeclared."""
    first = compile_error_category(message)
    kept = F.when(first == "missing_symbol", "undeclared_identifier").when(first.isin(*LATER_CATEGORIES), first).otherwise("other")
    return F.when(missing_include(message, code), "missing_include").otherwise(kept)


def verification_status(compile_status: Column, samples: Column, passed: Column) -> Column:
    """Status of a pair that was run on its samples."""
    return F.when(compile_status == "timeout", "compile_timeout").when(compile_status != "pass", "compile_error").when(samples == 0, "no_executable_sample").when(passed == samples, "all_samples_passed").when(passed > 0, "partial_sample_failure").otherwise("all_samples_failed")


def semantic_confidence(status: Column, review: Column, case_statuses: Column) -> Column:
    """A to D: passed; not testable; not proven wrong; proven wrong."""
    wrong = F.coalesce(review.isin(*CLEAR_REVIEW), F.lit(False)) | F.coalesce(F.arrays_overlap(case_statuses, F.array(*[F.lit(s) for s in CLEAR_RUNTIME])), F.lit(False))
    return F.when(status == "all_samples_passed", "A").when(status == "no_executable_sample", "B").when(wrong, "D").otherwise("C")


def malformed_reason(code: Column) -> Column:
    """Why a source file can't be whole: empty, missing_main or unbalanced_braces; null if it may be."""
    braces = [F.length(code) - F.length(F.replace(code, F.lit(b), F.lit(""))) for b in "{}"]
    return F.when(~code.rlike(r"[^\s]"), "empty").when(~code.rlike(r"\b(?:int|signed|auto)\s+main\s*\("), "missing_main").when(braces[0] != braces[1], "unbalanced_braces")


#: An opened code fence, a complete one, and what shows C++.
FENCE = "```"
COMPLETE_FENCE = r"(?s)```[^\r\n`]*\r?\n.*?```"
CODE_MARKER = r"#\s*include|\b(?:int|signed)\s+main\s*\("


def instruction_following(raw: Column, code: Column) -> Column:
    """What a model's answer is besides code: unextractable, extra_natural_language, markdown_code_fence or pure_code."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    own = F.regexp_replace(code, r"^\s+|\s+$", "")
    fenced, complete = F.contains(text, F.lit(FENCE)), text.rlike(COMPLETE_FENCE)
    outside = F.regexp_replace(text, COMPLETE_FENCE, "").rlike(r"[^\s]")
    unclosed = ~F.regexp_replace(text, r"^[^\n]*\n?", "").rlike(CODE_MARKER)
    without = F.when(F.endswith(text, own), F.left(text, F.length(text) - F.length(own))).otherwise(text)
    extra = F.when(complete, outside).when(fenced, unclosed).otherwise((text != own) & without.rlike(r"[^\s]"))
    return F.when(~own.rlike(CODE_MARKER), "unextractable").when(extra, "extra_natural_language").when(fenced, "markdown_code_fence").otherwise("pure_code")
