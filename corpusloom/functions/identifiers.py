"""Identifier functions: judge names, problem numbers, instants. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names a judge goes by, after lower-casing and without underscores.
SOURCE_ALIASES = {
    "cf": "codeforces",
    "codeforces": "codeforces",
    "luogu": "luogu",
    "洛谷": "luogu",
    "icpc": "icpc",
    "ccpc": "icpc",
    "atcoder": "atcoder",
    "nowcoder": "nowcoder",
    "牛客": "nowcoder",
    "hdu": "hdu",
    "poj": "poj",
}
#: Characters without width.
ZERO_WIDTH = "​‌‍⁠﻿"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "


def plain(text: Column) -> Column:
    """Full-width forms as ASCII, characters without width dropped, outer white space trimmed; null if nothing is left."""
    clean = F.translate(F.translate(text, _FULL, _HALF), ZERO_WIDTH, "")
    return F.nullif(F.regexp_replace(clean, r"^\s+|\s+$", ""), F.lit(""))


def canonical_source(name: Column, otherwise: Column | None = None) -> Column:
    """The one name of a judge; ``otherwise`` (null if not given) for null, blank or unknown names."""
    key = F.translate(F.lower(plain(name)), "_", "")
    aliases = F.create_map(*[F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair])
    known = F.try_element_at(aliases, key)
    return known if otherwise is None else F.coalesce(known, otherwise)


def _marked(text: Column, pattern: str, form: str) -> Column:
    """``form`` of the match of a pattern that ends a text, null without one; the pattern is tried once."""
    tried = F.regexp_replace(text, rf"(?is)^.*?{pattern}$", "\u0001" + form)
    return F.when(tried.startswith("\u0001"), F.substring(tried, 2, 1 << 30))


def with_problem(df: DataFrame, source: Column, problem: Column, judge: str = "judge", number: str = "problem") -> DataFrame:
    """``df`` with the canonical judge and the one spelling of the problem number in its judge's numbering, null where there is none.

    luogu: P and digits. codeforces: contest, capital letter, optional digit. icpc: lower-case words and numbers joined by
    single underscores, and the capital letter of the problem. What later steps use more than once is a column of its own, so that
    each pattern is tried once a row.
    """
    read = df.withColumns({judge: canonical_source(source), "_plain": plain(problem)})
    read = read.withColumn("_text", F.regexp_replace("_plain", r"(?i)\.(cpp|cc|cxx|c|hpp|h|py|java|txt|md)$", ""))
    read = read.withColumn("_words", F.when(F.col(judge) == "icpc", F.btrim(F.regexp_replace(F.lower("_text"), r"(?U)[^\p{L}\p{N}]+", "_"), F.lit("_"))))
    text, letter = F.col("_text"), F.substring_index("_words", "_", -1)
    luogu = _marked(text, r"(?:^|[^0-9A-Za-z]|luogu)p?[\s_/-]*0*(\d+)", "P$1")
    contest = F.upper(_marked(text, r"(?:^|[^0-9])0*(\d+)[\s_/.-]*(?:problem[\s_/-]*)?([a-z])[\s_/-]?(\d?)", "$1$2$3"))
    event = F.when(F.col("_words").rlike("_[a-z][0-9]?$"), F.concat(F.expr("left(_words, length(_words) - length(substring_index(_words, '_', -1)))"), F.upper(letter)))
    return read.withColumn(number, F.when(F.col(judge) == "luogu", luogu).when(F.col(judge) == "codeforces", contest).when(F.col(judge) == "icpc", event)).drop("_plain", "_text", "_words")


#: Fixed value: an ISO 8601 date and time with optional seconds, fraction and offset.
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)?\z"


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 date and time, UTC where no offset is given; null for anything else."""
    seconds = F.when(F.substring(text, 17, 1) == ":", text).otherwise(F.overlay(text, F.lit(":00"), F.lit(17), F.lit(0)))
    zone = F.translate(F.substring(seconds, 20, 40), "0123456789.,", "")
    utc = F.concat(F.translate(seconds, ",", "."), F.when(zone == "", "Z").otherwise(""))
    return F.when(text.rlike(ISO_INSTANT), F.unix_micros(utc.try_cast("timestamp")))


#: Identifiers in running text, in addresses, and events in paths. The first group ends before what bounds it.
LUOGU_BARE = r"(?i)(?:^|[^A-Za-z0-9])(P\d{3,7})(?![A-Za-z0-9])"
LUOGU_URL = r"(?i)luogu\.com\.cn/problem/(P\d{3,7})(?![A-Za-z0-9])"
CF_BARE = r"(?i)(?:^|[^A-Za-z0-9])CF(\d{1,7}[A-Z]\d?)(?![A-Za-z0-9])"
CF_SET_URL = r"(?i)codeforces\.com/problemset/problem/(\d{1,7}/[A-Z]\d?)"
CF_CONTEST_URL = r"(?i)codeforces\.com/contest/(\d{1,7}/problem/[A-Z]\d?)"
EVENT = r"(?i)ICPC|CCPC"
LOCATABLE = {"luogu": r"(?i)^P\d{3,7}\z", "codeforces": r"(?i)^\d{1,7}[A-Z]\d?\z", "atcoder": r"(?i)^(?:ABC|ARC|AGC)\d{3}_[A-H]\z", "hdu": r"^\d{3,6}\z", "poj": r"^\d{3,6}\z"}


def candidate_ids(text: Column) -> Column:
    """Sorted distinct "judge:number" of all identifiers in a text."""

    def found(pattern: str, judge: str) -> Column:
        each = F.regexp_extract_all(text, F.lit(pattern), 1)
        return F.transform(each, lambda x: F.concat(F.lit(f"{judge}:"), F.regexp_replace(F.upper(x), "/(?:PROBLEM/)?", "")))

    every = F.concat(found(LUOGU_BARE, "luogu"), found(LUOGU_URL, "luogu"), found(CF_BARE, "codeforces"), found(CF_SET_URL, "codeforces"), found(CF_CONTEST_URL, "codeforces"))
    return F.array_sort(F.array_distinct(every))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")


def event_id(path: Column, header: Column) -> Column:
    """"icpc:event_LETTER" of a file named by a letter under directories that name an event; else null."""
    stem = path_stem(path)
    parts = F.filter(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.rlike(EVENT) | p.rlike(r"20\d{2}"))
    slug = F.regexp_replace(F.lower(F.regexp_replace(F.array_join(parts, "_"), "[^A-Za-z0-9]+", "_")), "^_+|_+$", "")
    named = path.rlike(EVENT) | F.coalesce(header, F.lit("")).rlike(EVENT)
    return F.when(named & stem.rlike(r"^[A-Ma-m](?:[_-]?\d+)?$") & (F.size(parts) > 0), F.concat(F.lit("icpc:"), slug, F.lit("_"), F.upper(stem)))


#: The levels of evidence, in the order in which they are tried.
LEVELS = ("filename", "path", "header", "git_subject")


def resolve_ids(df: DataFrame, key: str, path: Column, header: Column, subject: Column) -> DataFrame:
    """(key, id, evidence, candidates): the identifier at the first of four levels that has any.

    A level with one candidate gives it; one with several is ambiguous and ends the search. Then comes the event of the path.
    Levels are columns of a projection of their own, so that each text is searched once.
    """
    base = df.select(key, path.alias("_p"), header.alias("_h"), F.coalesce(subject, F.lit("")).alias("_s"))
    texts = (path_stem(F.col("_p")), F.col("_p"), F.col("_h"), F.col("_s"))
    found = base.select(key, *[candidate_ids(t).alias(f"_{n}") for n, t in zip(LEVELS, texts)], event_id(F.col("_p"), F.col("_h")).alias("_event"))
    identifier, evidence = F, F
    for n in LEVELS:
        c = F.col(f"_{n}")
        identifier = identifier.when(F.size(c) == 1, c[0]).when(F.size(c) > 1, F.lit(None).cast("string"))
        evidence = evidence.when(F.size(c) == 1, n).when(F.size(c) > 1, f"ambiguous_{n}")
    event = F.col("_event")
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"_{n}" for n in LEVELS]))))
    return found.select(key, identifier.otherwise(event).alias("id"), evidence.when(event.isNotNull(), "explicit_icpc_path").otherwise("none").alias("evidence"), F.when((F.size(every) == 0) & event.isNotNull(), F.array(event)).otherwise(every).alias("candidates"))


def locatable(source: Column, problem: Column) -> Column:
    """Whether a judge's page can be found by the number alone."""
    out = F.lit(False)
    for name, pattern in LOCATABLE.items():
        out = out | ((source == name) & problem.rlike(pattern))
    return F.coalesce(out, F.lit(False))


def statement_url(source: Column, problem: Column) -> Column:
    """Address of a problem's page; null where there is no rule. Contests from 100000 on are gyms."""
    contest, index = F.regexp_extract(problem, r"(?i)^(\d{1,7})([A-Z]\d?)$", 1), F.upper(F.regexp_extract(problem, r"(?i)^(\d{1,7})([A-Z]\d?)$", 2))
    luogu = F.concat(F.lit("https://www.luogu.com.cn/problem/"), F.upper(problem))
    gym = F.concat(F.lit("https://codeforces.com/gym/"), contest, F.lit("/problem/"), index)
    plain_set = F.concat(F.lit("https://codeforces.com/problemset/problem/"), contest, F.lit("/"), index)
    return F.when((source == "luogu") & problem.rlike(LOCATABLE["luogu"]), luogu).when((source == "codeforces") & (index != ""), F.when(contest.cast("int") >= 100000, gym).otherwise(plain_set))


#: Fixed value: the tokens of a path in which identifiers are looked for.
PATH_TOKEN = r"[A-Za-z]+\d+|\d+[A-Za-z]+|[A-Za-z]+|\d+"
#: Judges whose name before a number may be left out.
PREFIXES = ("kattis", "boj", "uva", "icpc")


def path_tokens(path: Column) -> Column:
    """Distinct tokens of a path in lower case: letters and digits, digits and letters, letters, digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(path, F.lit(PATH_TOKEN), 0), F.lower))


def path_forms(identifiers: Column) -> Column:
    """Identifiers as tokens of a path: lower case, other characters left out."""
    return F.array_distinct(F.transform(identifiers, lambda i: F.regexp_replace(F.lower(i), "[^a-z0-9]", "")))


def path_has_identifier(path: Column, identifiers: Column) -> Column:
    """Whether a token of a path is one of the identifiers."""
    return F.arrays_overlap(path_tokens(path), path_forms(identifiers))


def text_has_identifier(text: Column, identifier: Column) -> Column:
    """Whether a text has the identifier with no letter or digit beside it; identifiers under three characters never."""
    bounded = F.concat(F.lit(r"(?i)(?:^|[^A-Za-z0-9])\Q"), identifier, F.lit(r"\E(?:$|[^A-Za-z0-9])"))
    return (F.length(identifier) >= 3) & F.regexp_like(text, bounded)


def identifier_forms(item: Column, problem: Column) -> Column:
    """Identifiers an item goes by: its name, its number, and the number without a judge whose name is its first run of letters."""
    parts = F.regexp_extract_all(F.lower(problem), F.lit(r"[a-z]+|\d+"), 0)
    short = F.when((F.size(parts) > 1) & F.element_at(parts, 1).isin(*PREFIXES), F.array_join(F.slice(parts, 2, F.size(parts)), ""))
    return F.array_distinct(F.array_compact(F.array(F.lower(item), F.lower(problem), short)))


def conflicting(source: Column, problem: Column, candidates: Column) -> Column:
    """Whether another number of the same judge is among the candidates ("judge:number")."""
    own = F.concat(F.lower(source), F.lit(":"), F.upper(problem))
    return F.coalesce(F.exists(candidates, lambda c: (F.substring_index(c, ":", 1) == F.lower(source)) & (c != own)), F.lit(False))
