"""Code out of model answers: one function with modes, for the rules that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fenced block with its language, fences with an optional C++ language, and where code begins.
FENCED = r"(?s)```[ \t]*([^\r\n`]*)\r?\n(.*?)```"
CPP_FENCED = r"(?is)```(?:cpp|c\+\+|cc|cxx)?\s*\n?(.*?)```"
CODE_START = r"(?m)^[ \t]*(?:#[ \t]*include\b|using[ \t]+namespace[ \t]+std\b|(?:int|signed)[ \t]+main[ \t]*\()"
INCLUDE = r"(?m)^\s*#\s*include\b"
CPP_LANGUAGES = ("cpp", "c++", "cc", "cxx")
MODES = ("labelled_longest", "longest", "first", "first_from_include")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _from(text: Column, pattern: str) -> Column:
    """From the first match of ``pattern`` on; the text if there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def _longest(blocks: Column) -> Column:
    """The longest string of an array, the first of equally long ones."""
    return F.aggregate(blocks, F.lit("").cast("string"), lambda best, b: F.when(F.length(b) > F.length(best), b).otherwise(best))


def extract_code(text: Column, mode: str = "labelled_longest") -> Column:
    """The code in an answer.

    labelled_longest: the longest block labelled as C++, else the longest block, else from the first line of code on.
    longest: the longest block, else from the first line of code to the last closing brace. first: the first block, else the text.
    first_from_include: the first block or the text, from its first include on.
    """
    whole = _strip(text)
    if mode == "first":
        found = F.regexp_extract(whole, CPP_FENCED, 1)
        return F.when(whole.rlike(CPP_FENCED), _strip(found)).otherwise(whole)
    if mode == "first_from_include":
        found = F.when(whole.rlike(CPP_FENCED), F.regexp_extract(whole, CPP_FENCED, 1)).otherwise(whole)
        return _strip(_from(found, INCLUDE))
    blocks = F.transform(F.regexp_extract_all(whole, F.lit(FENCED), 2), _strip)
    if mode == "labelled_longest":
        languages = F.transform(F.regexp_extract_all(whole, F.lit(FENCED), 1), lambda x: F.lower(_strip(x)))
        labelled = F.filter(F.arrays_zip(languages.alias("l"), blocks.alias("b")), lambda z: z["l"].isin(*CPP_LANGUAGES))
        chosen = F.when(F.size(labelled) > 0, _longest(F.transform(labelled, lambda z: z["b"]))).otherwise(_longest(blocks))
        return F.when(F.size(blocks) > 0, _strip(chosen)).otherwise(_strip(_from(whole, CODE_START)))
    if mode == "longest":
        begun = _from(whole, CODE_START)
        return F.when(F.size(blocks) > 0, _longest(blocks)).otherwise(F.when(F.regexp_instr(whole, F.lit(CODE_START)) > 0, _strip(F.regexp_replace(begun, r"\}[^}]*$", "}"))).otherwise(whole))
    raise ValueError(f"mode must be one of {MODES}")


#: Where code begins in an answer, by rule, and the fence of the strict rule.
ANSWER_START = r"(?:#\s*include|#\s*define|using\s+namespace|typedef\b|template\s*<|(?:const|constexpr|static)\b|struct\b|class\b|enum\b|(?:int|signed|int32_t)\s+main\s*\(|//|/\*)"
FIRST_START = r"^\s*(?:#\s*include|#\s*define|using\s+namespace|//|/\*|(?:int|signed|int32_t)\s+main\s*\()"
STRICT_FENCED = r"(?s)```(?:cpp|c\+\+|cc|C\+\+)?\s*\n?(.*?)```"
STRICT_START = r"^\s*(?:#include|using\s+namespace|typedef|struct|class|const\b)"
RULES = ("longest", "first", "strict")


def with_answer(df: DataFrame, text: Column, rule: str) -> DataFrame:
    """``df`` with the code of an answer and what else is in it: columns code, had_markdown_fence, extra_natural_language, strict_code_only.

    longest: the longest fenced block; else from where code begins to the last closing brace. first: the first fenced block, else the whole
    answer, which must begin like code. strict: as first, but a fence or anything after the last closing brace is extra as well, and
    only an answer that is its code is strict. Each step is a column of its own, as later ones use it more than once.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    read = df.withColumn("_whole", _strip(text))
    whole = F.col("_whole")
    if rule == "longest":
        read = read.withColumns({"_blocks": F.regexp_extract_all(whole, F.lit(CPP_FENCED), 1), "_at": F.regexp_instr(whole, F.lit(r"(?m)^\s*" + ANSWER_START))})
        fenced, begun = F.size("_blocks") > 0, F.col("_at") > 0
        read = read.withColumns({"_candidate": F.when(begun, _strip(F.substr(whole, "_at"))), "_before": F.when(begun, _strip(F.left(whole, F.col("_at") - 1)))})
        candidate = F.col("_candidate")
        closed = F.contains(candidate, F.lit("}"))
        after = F.when(closed, _strip(F.substring_index(candidate, "}", -1))).otherwise("")
        plain = F.when(closed, F.regexp_replace(candidate, r"\}[^}]*\z", "}")).otherwise(candidate)
        read = read.withColumns({"code": F.when(fenced, _strip(_longest(F.col("_blocks")))).when(begun, plain).otherwise(whole), "had_markdown_fence": fenced})
        extra = F.when(fenced, F.regexp_replace(whole, CPP_FENCED, "").rlike(r"[^\s]")).when(begun, (F.col("_before") != "") | (after != "")).otherwise(whole != "")
        read = read.withColumn("extra_natural_language", extra)
        strict = ~fenced & begun & ~F.col("extra_natural_language") & (whole == F.col("code"))
        return read.withColumn("strict_code_only", strict).drop("_whole", "_blocks", "_at", "_candidate", "_before")
    pattern = CPP_FENCED if rule == "first" else STRICT_FENCED
    fenced = whole.rlike(pattern)
    flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    around = flags + "^(.*?)" + body + "(.*)"
    outside = F.when(fenced, F.concat(F.regexp_extract(whole, around, 1), F.regexp_extract(whole, around, 3)).rlike(r"[^\s]")).otherwise(False)
    read = read.withColumns({"had_markdown_fence": fenced, "_outside": outside, "code": F.when(fenced, _strip(F.regexp_extract(whole, pattern, 1))).otherwise(whole)})
    code, had = F.col("code"), F.col("had_markdown_fence")
    if rule == "first":
        extra = F.when(had, F.col("_outside")).otherwise(~code.rlike(FIRST_START))
        return read.withColumns({"extra_natural_language": extra, "strict_code_only": ~extra}).drop("_whole", "_outside")
    trailing = F.contains(code, F.lit("}")) & F.substring_index(code, "}", -1).rlike(r"[^\s]")
    read = read.withColumn("extra_natural_language", had | F.col("_outside") | ~code.rlike(STRICT_START) | trailing)
    return read.withColumn("strict_code_only", ~F.col("extra_natural_language") & (whole == code)).drop("_whole", "_outside")
