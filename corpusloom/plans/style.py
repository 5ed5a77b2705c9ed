"""Queries over the style of code: the vectors of the reports, and counts in code whose comments and literals are masked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract
from ..functions import features as ft
from ..functions import text as tx
from ..operators import stats
from .catalog import Catalog, table

CATALOG = Catalog()


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{_q(pattern)}')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{_q(pattern)}'))::bigint"


def _vector_sql(x: str, patterns: dict[str, str]) -> str:
    return ", ".join(f"{_has(x, p)} as {n}" for n, p in patterns.items())


def _comments_sql(x: str) -> str:
    return ", ".join(f"{_count(x, ft.PATTERNS[n])} as {n}_count" for n in ("line_comment", "block_comment"))


def _lines(x: str) -> str:
    return f"regexp_split_to_array({x}, '{tx.LINE_END}')"


#: A running state over lines: outside comments and braces, an array is declared.
_GLOBAL_ARRAY_SQL = (
    "list_reduce(list_prepend({'d': 0, 'c': false, 'h': false, 't': ''}, list_transform(" + _lines("text") + ", lambda l: {'d': 0, 'c': false, 'h': false, 't': l})), lambda s, x: "
    "list_transform([case when not s.c then x.t when contains(x.t, '*/') then regexp_replace(x.t, '^.*?\\*/', '') else '' end], lambda r: "
    "list_transform([split_part(case when contains(r, '/*') then split_part(r, '/*', 1) else r end, '//', 1)], lambda k: case when s.c and not contains(x.t, '*/') then {'d': s.d, 'c': true, 'h': s.h, 't': ''} else "
    "{'d': greatest(0, s.d + (2 * length(k) - length(replace(k, '{', '')) - length(k)) - (length(k) - length(replace(k, '}', ''))))::int, "
    "'c': contains(r, '/*') and not contains(regexp_replace(r, '^.*?/\\*', ''), '*/'), 'h': s.h or (s.d = 0 and " + _has("k", ft.PATTERNS["static_array"].replace("(?m)", "")) + "), 't': ''} end)[1])[1]).h"
)
_NAMES_SQL = f"regexp_extract_all(text, '{ft.DECLARED}', 1)"


@CATALOG.query(
    f"with n as (select record_id, text, {_NAMES_SQL} as d from style_v3 where text is not null) select record_id, "
    + ", ".join(f"{_has('text', ft.PATTERNS[n])} as {n}" for n in ("vector", "static_array", "maxn_or_maxm", "bits_stdcpp", "using_namespace_std", "line_comment", "block_comment"))
    + f", {_GLOBAL_ARRAY_SQL} as global_array, ({_has('text', ft.PATTERNS['ios_sync_off'])} or {_has('text', ft.PATTERNS['cin_untie'])}) as fast_io, ({_has('text', ft.PATTERNS['line_comment'])} or {_has('text', ft.PATTERNS['block_comment'])}) as any_comment, "
    + _comments_sql("text")
    + ", len(d)::bigint as variable_declaration_count, len(list_filter(d, lambda x: length(x) = 1))::bigint as single_letter_variable_count, len(list_filter(d, lambda x: contains(trim(x, '_'), '_')))::bigint as snake_case_variable_count, "
    "len(list_filter(d, lambda x: regexp_matches(x, '[a-z][A-Z]')))::bigint as camel_case_variable_count, length(array_to_string(d, ''))::bigint as variable_name_characters from n"
)
def style_vectors(spark, sf_dir):
    """The seventeen style measures of every file."""
    rows = table(spark, sf_dir, "style_v3").where("text is not null").select("record_id", *ft.style_vector(F.col("text")))
    return rows.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else c for c, t in rows.dtypes])


@CATALOG.query("select row_id, " + _vector_sql("response", ft.COMPARE_PATTERNS) + " from dataset where response is not null")
def compare_vectors(spark, sf_dir):
    """The nine features of the comparison of models, for every answer."""
    return table(spark, sf_dir, "dataset").where("response is not null").select("row_id", *ft.pattern_vector(F.col("response"), ft.COMPARE_PATTERNS))


@CATALOG.query("with f as (select split, " + _vector_sql("response", ft.ABLATION_PATTERNS) + " from dataset where response is not null) select split, count(*) as n, " + ", ".join(f"count(*) filter (where {n}) as {n}" for n in ft.ABLATION_PATTERNS) + " from f group by 1")
def ablation_vectors(spark, sf_dir):
    """Answers with each of the three features of the prompt ablation, by split."""
    rows = table(spark, sf_dir, "dataset").where("response is not null").select("split", *ft.pattern_vector(F.col("response"), ft.ABLATION_PATTERNS))
    return rows.groupBy("split").agg(F.count("*").alias("n"), *[F.count_if(n).alias(n) for n in ft.ABLATION_PATTERNS])


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_BLANKLESS = "regexp_matches({}, '[^\\s]')".format
#: Code and flags of the answers in documents, by rule: (doc_id, w, code, had, extra, strict).
_LONGEST_SQL = (
    f"with w as (select doc_id, {_strip_sql('text')} as w from documents where text is not null), b as (select doc_id, w, regexp_extract_all(w, '{extract.CPP_FENCED}', 1) as b, {_has('w', '(?m)^\\s*' + extract.ANSWER_START)} as s, "
    f"regexp_extract(w, '(?s)^(.*?)(?m:^)\\s*{extract.ANSWER_START}', 1) as pre from w), "
    f"c as (select *, {_strip_sql('substr(w, length(pre) + 1)')} as cand from b), "
    f"e as (select doc_id, w, len(b) > 0 as had, s, case when len(b) > 0 then {_strip_sql('list_reduce(b, lambda x, y: if(length(y) > length(x), y, x))')} when s then case when contains(cand, '}}') then regexp_replace(cand, '\\}}[^}}]*$', '}}') else cand end else w end as code, "
    f"case when len(b) > 0 then {_BLANKLESS(f'''regexp_replace(w, '{extract.CPP_FENCED}', '', 'g')''')} when s then {_BLANKLESS('pre')} or (contains(cand, '}}') and {_BLANKLESS('''string_split(cand, '}')[-1]''')}) else w <> '' end as extra from c), "
    "a as (select doc_id, w, code, had, extra, not had and s and not extra and w = code as strict from e) "
)


def _around_sql(pattern: str, start: str, strict: bool) -> str:
    flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    around = f"{flags}^(.*?){body}(.*)"
    first = (
        f"with w as (select doc_id, {_strip_sql('text')} as w from documents where text is not null), "
        f"e as (select doc_id, w, {_has('w', pattern)} as had, {_has('w', pattern)} and {_BLANKLESS(f'''(regexp_extract(w, '{around}', 1) || regexp_extract(w, '{around}', 3))''')} as outside, case when {_has('w', pattern)} then {_strip_sql(f'''regexp_extract(w, '{pattern}', 1)''')} else w end as code from w), "
    )
    if strict:
        return first + f"x as (select *, had or outside or not {_has('code', start)} or (contains(code, '}}') and {_BLANKLESS('''string_split(code, '}')[-1]''')}) as extra from e), a as (select doc_id, w, code, had, extra, not extra and w = code as strict from x) "
    return first + f"x as (select *, case when had then outside else not {_has('code', start)} end as extra from e), a as (select doc_id, w, code, had, extra, not extra as strict from x) "


def _answers(spark, sf_dir, rule):
    return extract.with_answer(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), F.col("text"), rule).drop("text")


@CATALOG.query(_LONGEST_SQL + "select doc_id, " + _vector_sql("code", ft.ANSWER_PATTERNS) + f", {_has('code', ft.ANSWER_PATTERNS['map'])} or {_has('code', ft.ANSWER_PATTERNS['unordered_map'])} or {_has('code', ft.ANSWER_PATTERNS['set'])} as associative_container, " + _comments_sql("code") + ", had as had_markdown_fence, extra as extra_natural_language, strict as strict_code_only from a")
def answer_vectors(spark, sf_dir):
    """Features of the code in every document and what else is in it, the longest fenced block first."""
    rows, code = _answers(spark, sf_dir, "longest"), F.col("code")
    flags = rows.select("doc_id", *ft.pattern_vector(code, ft.ANSWER_PATTERNS), *[c.cast("bigint").alias(n) for n, c in zip(("line_comment_count", "block_comment_count"), ft.comment_counts(code))], "had_markdown_fence", "extra_natural_language", "strict_code_only")
    return flags.withColumn("associative_container", F.col("map") | F.col("unordered_map") | F.col("set"))


@CATALOG.query(_around_sql(extract.CPP_FENCED, extract.FIRST_START, False) + "select doc_id, " + _vector_sql("code", ft.FIRST_ANSWER_PATTERNS) + ", " + _comments_sql("code") + ", extra as extra_explanation, strict as code_only from a")
def first_answer_vectors(spark, sf_dir):
    """The fourteen features of the first evaluation, by the first fenced block."""
    rows, code = _answers(spark, sf_dir, "first"), F.col("code")
    return rows.select("doc_id", *ft.pattern_vector(code, ft.FIRST_ANSWER_PATTERNS), *[c.cast("bigint").alias(n) for n, c in zip(("line_comment_count", "block_comment_count"), ft.comment_counts(code))], F.col("extra_natural_language").alias("extra_explanation"), F.col("strict_code_only").alias("code_only"))


@CATALOG.query(_around_sql(extract.STRICT_FENCED, extract.STRICT_START, True) + "select doc_id, " + _vector_sql("code", ft.STRICT_ANSWER_PATTERNS) + ", extra as extra_natural_language, strict as code_only from a")
def strict_answer_vectors(spark, sf_dir):
    """The fourteen features of the strict evaluation."""
    rows = _answers(spark, sf_dir, "strict")
    return rows.select("doc_id", *ft.pattern_vector(F.col("code"), ft.STRICT_ANSWER_PATTERNS), "extra_natural_language", F.col("strict_code_only").alias("code_only"))


_SUMMED = ("had_markdown_fence", "extra_natural_language", "strict_code_only", "using_namespace_std", "associative_container", "int_main")


@CATALOG.query(
    f"with v as ({CATALOG.sql['answer_vectors']}) select kind, count(*) as n, " + ", ".join(f"count(*) filter (where {c}) as {c}, count(*) filter (where {c}) / count(*) as {c}_rate" for c in _SUMMED)
    + ", sum(line_comment_count + block_comment_count)::bigint as comments, sum(line_comment_count + block_comment_count)::bigint / count(*) as average_comments from v join documents using (doc_id) group by 1"
)
def answer_summary(spark, sf_dir):
    """Count and rate of the flags of answers by kind, and their comments in all and on average."""
    kinds = table(spark, sf_dir, "documents").select("doc_id", "kind")
    comments = F.sum(F.col("line_comment_count") + F.col("block_comment_count"))
    counts = [x for c in _SUMMED for x in (F.count_if(c).alias(c), (F.count_if(c) / F.count("*")).alias(f"{c}_rate"))]
    return answer_vectors(spark, sf_dir).join(kinds, "doc_id").groupBy("kind").agg(F.count("*").alias("n"), *counts, comments.alias("comments"), (comments / F.count("*")).alias("average_comments"))


_LITERAL_SQL = _q(ft.LITERAL)
#: The text with comments and literals as spaces, line feeds kept.
MASKED_SQL = f"array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{_LITERAL_SQL}'), list_append(regexp_extract_all(text, '{_LITERAL_SQL}'), '')), lambda z: z[1] || regexp_replace(z[2], '[^\\n]', ' ', 'g')), '')"
_MASKED = f"with m as (select record_id, source_type, text as source, {MASKED_SQL} as text from style_v3 where text is not null) "
_SCOPE = "unnest(case when source_type = 'template' then ['all', 'templates'] else ['all', 'non_templates'] end) as scope"
#: Lines that begin at depth 0: the running depth never falls below 0, so it is the sum so far less its least value.
_TOP_SQL = (
    f", l as (select record_id, unnest({_lines('text')}) as line, generate_subscripts({_lines('text')}, 1) as i from m), "
    "d as (select *, sum((length(line) - length(replace(line, '{', ''))) - (length(line) - length(replace(line, '}', '')))) over (partition by record_id order by i) as s from l), "
    "v as (select *, least(0, min(s) over (partition by record_id order by i)) as low from d), "
    "t as (select record_id, string_agg(line, chr(10) order by i) filter (where before = 0) as top from (select *, coalesce(lag(s - low) over (partition by record_id order by i), 0) as before from v) group by 1) "
)


def _masked(spark, sf_dir):
    rows = table(spark, sf_dir, "style_v3").where("text is not null")
    return rows.select("record_id", "source_type", "text", ft.mask_literals(F.col("text")).alias("code"))


def _by_scope(rows, counts: dict):
    """(scope, name, total, files, occurrences) of counted columns; the groups overlap, so counts come before they are repeated."""
    each = rows.select("source_type", *[c.alias(n) for n, c in counts.items()])
    summed = each.groupBy("source_type").agg(F.count("*").alias("total"), *[F.count_if(F.col(n) > 0).alias(f"f_{n}") for n in counts], *[F.sum(n).alias(f"o_{n}") for n in counts])
    stack = ", ".join(f"'{n}', f_{n}, o_{n}" for n in counts)
    long = summed.select("source_type", "total", F.expr(f"stack({len(counts)}, {stack}) as (name, files, occurrences)"))
    scopes = F.array(F.lit("all"), F.when(F.col("source_type") == "template", "templates").otherwise("non_templates"))
    return long.select(F.explode(scopes).alias("scope"), "name", "total", "files", "occurrences").groupBy("scope", "name").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("total", "files", "occurrences")])


def _scope_sql(counts: dict[str, str], rows: str = "m") -> str:
    inner = f"g as (select {_SCOPE}, " + ", ".join(f"{c} as c_{n}" for n, c in counts.items()) + f" from {rows}) "
    return inner + " union all ".join(f"select scope, '{n}' as name, count(*) as total, count(*) filter (where c_{n} > 0) as files, sum(c_{n})::bigint as occurrences from g group by 1" for n in counts)


@CATALOG.query(_MASKED + ", " + _scope_sql({n: _count("text", p) for n, p in ft.CONTAINERS.items()}))
def container_usage(spark, sf_dir):
    """Containers in masked code by overlapping groups: all, templates, non-templates."""
    return _by_scope(_masked(spark, sf_dir), {n: F.regexp_count("code", F.lit(p)) for n, p in ft.CONTAINERS.items()})


@CATALOG.query(_MASKED + ", " + _scope_sql({n: _count("text", rf"\b{n}\s*\(") for n in ft.FUNCTION_NAMES}))
def function_usage(spark, sf_dir):
    """Calls and definitions of functions with common names, in masked code."""
    return _by_scope(_masked(spark, sf_dir), {n: F.regexp_count("code", F.lit(rf"\b{n}\s*\(")) for n in ft.FUNCTION_NAMES})


@CATALOG.query(
    _MASKED + _TOP_SQL + ", j as (select m.*, coalesce(top, '') as top from m left join t using (record_id)), "
    + _scope_sql({**{n: _count("text", p) for n, p in ft.USAGE_PATTERNS.items()}, "global_const_max": _count("top", ft.TOP_CONSTANT), "line_comments": _count("source", ft.PATTERNS["line_comment"]), "block_comments": _count("source", ft.PATTERNS["block_comment"])}, "j")
)
def feature_usage(spark, sf_dir):
    """Includes, input and output settings, constants of the top level and comments."""
    rows = _masked(spark, sf_dir).withColumn("top", ft.top_level(F.col("code")))
    counts = {n: F.regexp_count("code", F.lit(p)) for n, p in ft.USAGE_PATTERNS.items()}
    counts |= {"global_const_max": F.regexp_count("top", F.lit(ft.TOP_CONSTANT)), "line_comments": ft.count(F.col("text"), "line_comment"), "block_comments": ft.count(F.col("text"), "block_comment")}
    return _by_scope(rows, counts)


_WORDS_SQL = ", ".join(f"'{w}'" for w in (*ft.KEYWORDS, *ft.FUNCTION_NAMES))


@CATALOG.query(_MASKED + "select name, count(*) as n from (select unnest(regexp_extract_all(text, '\\b[A-Za-z_]\\w{0,3}\\b')) as name from m) where name not in (" + _WORDS_SQL + ") group by 1 order by 2 desc, 1 limit 25")
def top_identifiers(spark, sf_dir):
    """The 25 most common short identifiers of masked code that are no words of the language."""
    names = _masked(spark, sf_dir).select(F.explode(F.regexp_extract_all("code", F.lit(r"\b[A-Za-z_]\w{0,3}\b"), 0)).alias("name"))
    return stats.top_values(names.where(~F.col("name").isin(*ft.KEYWORDS, *ft.FUNCTION_NAMES)), "name", 25)


_INDENTED = f"list_filter({_lines('source')}, lambda x: regexp_matches(x, '^[ \\t]') and regexp_matches(x, '[^\\s]'))"


@CATALOG.query(
    _MASKED + f", l as (select record_id, {_INDENTED} as i, text from m), c as (select record_id, len(list_filter(i, lambda x: starts_with(x, chr(9)))) as tabs, len(list_filter(i, lambda x: regexp_matches(x, '^(?:    )+(?:[^ ]|$)'))) as fours, len(i) as n, "
    f"regexp_extract(text, '{ft.MAIN}', 1) as kind, regexp_replace(regexp_extract(text, '{ft.MAIN}', 2), '^\\s+|\\s+$', '', 'g') as args from l) "
    "select record_id, case when tabs > 0 and tabs > fours and tabs > n - tabs - fours then 'tab' when fours > 0 and fours >= tabs and fours >= n - tabs - fours then '4_spaces' else 'other' end as indentation, "
    "case when kind = '' then 'other_or_missing' else kind || '_main_' || case args when '' then 'empty' when 'void' then 'void' else 'arguments' end end as main_form from c"
)
def layout_style(spark, sf_dir):
    """Indentation of every file, and the entry point of its masked code."""
    return _masked(spark, sf_dir).select("record_id", ft.indentation(F.col("text")).alias("indentation"), ft.main_form(F.col("code")).alias("main_form"))


@CATALOG.query(_MASKED + f", l as (select record_id, {_lines('text')} as i from m) select record_id, len(list_filter(i, lambda x: regexp_matches(x, '^[^{{]*[^{{\\s][^{{]*\\{{') and not regexp_matches(x, '^\\s*#')))::bigint as same_line, len(list_filter(i, lambda x: regexp_matches(x, '^\\s*\\{{\\s*$')))::bigint as next_line from l")
def brace_style(spark, sf_dir):
    """Where blocks are opened, in masked code."""
    return _masked(spark, sf_dir).select("record_id", ft.brace_lines(F.col("code")).alias("b")).select("record_id", *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("same_line", "next_line")])


@CATALOG.query(_MASKED + _TOP_SQL + f"select m.record_id, {_GLOBAL_ARRAY_SQL.replace('(text,', '(source,')} as global_array, {_has('''coalesce(top, '')''', ft.TOP_CONSTANT)} as top_level_constant from m left join t using (record_id)")
def global_arrays(spark, sf_dir):
    """Arrays outside all braces and comments, by a fold over lines; and constants of the top level in masked code."""
    rows = _masked(spark, sf_dir).withColumn("top", ft.top_level(F.col("code")))
    return rows.select("record_id", ft.global_array(F.col("text")).alias("global_array"), F.col("top").rlike(ft.TOP_CONSTANT).alias("top_level_constant"))
