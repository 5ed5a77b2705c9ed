"""Queries over instruction pairs, solution versions and evaluation items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat, classify, extract
from ..functions import identifiers as ids
from ..functions import text as tx
from ..operators import assembly, compare, contamination, ranking, sampling, stats, validation
from .catalog import Catalog, table

CATALOG = Catalog()

_TOKEN = tx.TOKEN.replace("'", "''")


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all({column}, '{_TOKEN}')"


#: Marks of pages that aren't statements, in the order in which they are looked for.
PAGE_MARKERS = ["cloudflare", "checking your browser", "verify you are human", "captcha", "验证码", "登录后继续", "404 not found", "page not found"]
_MARKERS_SQL = ", ".join(f"'{m}'" for m in PAGE_MARKERS)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g')"


_FULL, _HALF = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 ", "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + "  "


def plain_sql(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(translate({x}, '{_FULL}', '{_HALF}'), '[{ids.ZERO_WIDTH}]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '')"


ALIASES_SQL = "case replace(lower(" + plain_sql("source") + "), '_', '') " + " ".join(f"when '{a}' then '{n}'" for a, n in ids.SOURCE_ALIASES.items()) + " end"


@CATALOG.query(f"select {ALIASES_SQL} as judge, count(*) as attempted, count(*) filter (where compile) as compiled, count(*) filter (where uniquely_locatable) as locatable from pilot_manifest group by 1")
def judge_matrix(spark, sf_dir):
    """Versions, compiled and locatable ones by unified judge name."""
    rows = table(spark, sf_dir, "pilot_manifest").select(ids.canonical_source(F.col("source")).alias("judge"), "compile", "uniquely_locatable")
    return rows.groupBy("judge").agg(F.count("*").alias("attempted"), F.count_if("compile").alias("compiled"), F.count_if("uniquely_locatable").alias("locatable"))


_LOCATABLE_SQL = "coalesce(case source " + " ".join(f"when '{s}' then regexp_matches(problem_id, '{p}')" for s, p in ids.LOCATABLE.items()) + " end, false)"


@CATALOG.query(f"select row_id, {_LOCATABLE_SQL} as locatable from pilot_manifest")
def locatable_rows(spark, sf_dir):
    return table(spark, sf_dir, "pilot_manifest").select("row_id", ids.locatable(F.col("source"), F.col("problem_id")).alias("locatable"))


@CATALOG.query(f"select coalesce({ALIASES_SQL}, 'other') as judge, count(*) as versions, count(distinct source) as spellings from pilot_manifest group by 1")
def judge_inventory(spark, sf_dir):
    """Versions and spellings by judge, unknown ones as other."""
    rows = table(spark, sf_dir, "pilot_manifest").select("source", ids.canonical_source(F.col("source"), F.lit("other")).alias("judge"))
    return rows.groupBy("judge").agg(F.count("*").alias("versions"), F.count_distinct("source").alias("spellings"))


_CONTEST = "(?i)(?:^|[^0-9])0*(\\d+)[\\s_/.-]*(?:problem[\\s_/-]*)?([a-z])[\\s_/-]?(\\d?)$"
_WORDED = "regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')"
#: Versions with the one name of their judge and the one spelling of their number.
VERSIONS_SQL = (
    f"with v as (select *, {ALIASES_SQL} as judge, regexp_replace({plain_sql('problem_id')}, '(?i)\\.(cpp|cc|cxx|c|hpp|h|py|java|txt|md)$', '') as t from pilot_manifest), "
    "u as (select *, case judge when 'luogu' then 'P' || nullif(regexp_extract(t, '(?i)(?:^|[^0-9A-Za-z]|luogu)p?[\\s_/-]*0*(\\d+)$', 1), '') "
    f"when 'codeforces' then nullif(regexp_extract(t, '{_CONTEST}', 1) || upper(regexp_extract(t, '{_CONTEST}', 2)) || regexp_extract(t, '{_CONTEST}', 3), '') "
    f"when 'icpc' then case when regexp_matches({_WORDED}, '_[a-z][0-9]?$') then regexp_extract({_WORDED}, '^(.*_)[^_]+$', 1) || upper(regexp_extract({_WORDED}, '_([^_]+)$', 1)) end end as problem from v) "
)


def _versions(spark, sf_dir):
    return ids.with_problem(table(spark, sf_dir, "pilot_manifest"), F.col("source"), F.col("problem_id"))


@CATALOG.query(
    VERSIONS_SQL + "select distinct judge, problem, case when judge = 'luogu' and regexp_matches(problem, '(?i)^P\\d{3,7}$') then 'https://www.luogu.com.cn/problem/' || upper(problem) when judge = 'codeforces' and regexp_matches(problem, '(?i)^\\d{1,7}[A-Z]\\d?$') then "
    "case when regexp_extract(problem, '^(\\d+)', 1)::int >= 100000 then 'https://codeforces.com/gym/' || regexp_extract(problem, '^(\\d+)', 1) || '/problem/' else 'https://codeforces.com/problemset/problem/' || regexp_extract(problem, '^(\\d+)', 1) || '/' end || upper(regexp_extract(problem, '([A-Za-z]\\d?)$', 1)) end as url from u where problem is not null"
)
def statement_urls(spark, sf_dir):
    """The page of every problem that versions are of, by unified judge and number."""
    rows = _versions(spark, sf_dir).where("problem is not null").select("judge", "problem").distinct()
    return rows.select("judge", "problem", ids.statement_url(F.col("judge"), F.col("problem")).alias("url"))


_CONFLICT_SQL = (
    "with c as (select sha, list_sort(list_distinct(flatten(list(cs)))) as cs from (select sha256(text) as sha, {found} as cs from style_v3 where text is not null) group by 1) "
    "select row_id, {locatable} as by_number, coalesce(len(list_filter(cs, lambda x: split_part(x, ':', 1) = lower(source) and x <> lower(source) || ':' || upper(problem_id))) > 0, false) as conflicting from pilot_manifest p left join c on lower(p.sha256) = c.sha"
)


_HEADER = "array_to_string(list_slice(regexp_split_to_array(coalesce(text, ''), '" + tx.LINE_END + "'), 1, 100), chr(10))"


def _found_sql(text: str) -> str:
    def each(pattern: str, judge: str) -> str:
        return f"list_transform(regexp_extract_all({text}, '{pattern}', 1), lambda x: '{judge}:' || regexp_replace(upper(x), '/(?:PROBLEM/)?', ''))"

    end = "(?:[^A-Za-z0-9]|$)"
    patterns = [(ids.LUOGU_BARE, "luogu"), (ids.LUOGU_URL, "luogu"), (ids.CF_BARE, "codeforces"), (ids.CF_SET_URL, "codeforces"), (ids.CF_CONTEST_URL, "codeforces")]
    lists = ", ".join(each(p.replace("(?![A-Za-z0-9])", end), j) for p, j in patterns)
    return f"list_sort(list_distinct(flatten([{lists}])))"


@CATALOG.query(_CONFLICT_SQL.format(found=_found_sql("text"), locatable=_LOCATABLE_SQL))
def locatable_conflicts(spark, sf_dir):
    """Whether a version's number can be looked up, and whether its file names another number of the same judge; candidates are found by digest."""
    found = table(spark, sf_dir, "style_v3").where("text is not null").select(tx.sha256_text(F.col("text")).alias("sha"), ids.candidate_ids(F.col("text")).alias("c"))
    named = found.where(F.size("c") > 0).groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("candidates"))
    rows = table(spark, sf_dir, "pilot_manifest").select("row_id", "source", "problem_id", F.lower("sha256").alias("sha")).join(named, "sha", "left")
    return rows.select("row_id", ids.locatable(F.col("source"), F.col("problem_id")).alias("by_number"), ids.conflicting(F.col("source"), F.col("problem_id"), F.col("candidates")).alias("conflicting"))


@CATALOG.query(f"select doc_id, {_found_sql(_strip_sql('text'))} as candidates from documents where text is not null and len({_found_sql('text')}) > 0")
def candidate_ids(spark, sf_dir):
    """Identifiers named in documents."""
    found = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.candidate_ids(F.col("text")).alias("candidates"))
    return found.where(F.size("candidates") > 0)


_PARTS_SQL = f"list_filter(string_split(path, '/')[:-2], lambda x: regexp_matches(x, '{ids.EVENT}') or regexp_matches(x, '20[0-9]{{2}}'))"
_STEM_SQL = "regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1')"
_LADDER_SQL = (
    "with v as (select path, max(problem_id) as subject from pilot_manifest where path is not null and problem_id is not null group by 1), "
    f"b as (select record_id, path, {_HEADER} as header, coalesce(subject, '') as subject from style_v3 left join v using (path) where path is not null), "
    f"l as (select record_id, {_found_sql(_STEM_SQL)} as f, {_found_sql('path')} as p, {_found_sql('header')} as h, {_found_sql('subject')} as g, case when (regexp_matches(path, '{ids.EVENT}') or regexp_matches(header, '{ids.EVENT}')) and regexp_matches({_STEM_SQL}, '^[A-Ma-m](?:[_-]?\\d+)?$') and len({_PARTS_SQL}) > 0 then 'icpc:' || regexp_replace(lower(regexp_replace(array_to_string({_PARTS_SQL}, '_'), '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') || '_' || upper({_STEM_SQL}) end as e from b) "
    "select record_id, case when len(f) = 1 then f[1] when len(f) > 1 then null when len(p) = 1 then p[1] when len(p) > 1 then null when len(h) = 1 then h[1] when len(h) > 1 then null when len(g) = 1 then g[1] when len(g) > 1 then null else e end as id, "
    "case when len(f) = 1 then 'filename' when len(f) > 1 then 'ambiguous_filename' when len(p) = 1 then 'path' when len(p) > 1 then 'ambiguous_path' when len(h) = 1 then 'header' when len(h) > 1 then 'ambiguous_header' when len(g) = 1 then 'git_subject' when len(g) > 1 then 'ambiguous_git_subject' when e is not null then 'explicit_icpc_path' else 'none' end as evidence, "
    "case when len(f) + len(p) + len(h) + len(g) = 0 and e is not null then 1 else len(list_distinct(flatten([f, p, h, g]))) end::int as candidates from l"
)


@CATALOG.query(_LADDER_SQL)
def evidence_ladder(spark, sf_dir):
    """The identifier of each file and the level that gives it; the greatest number noted with its path stands for a commit's subject."""
    noted = table(spark, sf_dir, "pilot_manifest").where("path is not null and problem_id is not null").groupBy("path").agg(F.max("problem_id").alias("subject"))
    lines = tx.split_lines(F.coalesce("text", F.lit("")))
    header = F.array_join(F.slice(lines, 1, 100), "\n")
    files = table(spark, sf_dir, "style_v3").where("path is not null").join(noted, "path", "left")
    found = ids.resolve_ids(files, "record_id", F.col("path"), header, F.col("subject"))
    return found.withColumn("candidates", F.size("candidates"))


@CATALOG.query(f"select row_id, length({_strip_sql('instruction')}) >= 100 and {_strip_sql('instruction')} not like '%#include%' and (instruction like '%输入%' or lower(instruction) like '%input%') and (instruction like '%输出%' or lower(instruction) like '%output%') as valid from dataset where instruction is not null")
def valid_statements(spark, sf_dir):
    t = F.col("instruction")
    lower = F.lower(t)
    valid = (F.length(tx.strip(t)) >= 100) & ~F.contains(t, F.lit("#include")) & (F.contains(t, F.lit("输入")) | F.contains(lower, F.lit("input"))) & (F.contains(t, F.lit("输出")) | F.contains(lower, F.lit("output")))
    return table(spark, sf_dir, "dataset").where("instruction is not null").select("row_id", valid.alias("valid"))


_RULES = {
    "missing_id": ("id is null or trim(id) = ''", lambda: F.coalesce(F.trim("id"), F.lit("")) == ""),
    "missing_instruction": ("instruction is null or trim(instruction) = ''", lambda: F.coalesce(F.trim("instruction"), F.lit("")) == ""),
    "missing_response": ("response is null or trim(response) = ''", lambda: F.coalesce(F.trim("response"), F.lit("")) == ""),
    "statement_too_short": ("length(instruction) < 50", lambda: F.length("instruction") < 50),
    "bad_digest": ("code_sha256 is null or not regexp_matches(code_sha256, '^[0-9a-f]{64}$')", lambda: F.col("code_sha256").isNull() | ~F.col("code_sha256").rlike("^[0-9a-f]{64}$")),
    "digest_mismatch": ("lower(code_sha256) <> sha256(response)", lambda: F.lower("code_sha256") != tx.sha256_text(F.col("response"))),
    "not_verified": ("not coalesce(verified, false)", lambda: ~F.coalesce("verified", F.lit(False))),
    "bad_id": ("id <> source || '_' || problem_id", lambda: F.col("id") != F.concat("source", F.lit("_"), "problem_id")),
}


@CATALOG.query("with r as (select row_id, list_sort(list_filter([" + ", ".join(f"case when {sql} then '{n}' end" for n, (sql, _) in _RULES.items()) + "], lambda x: x is not null)) as errors from dataset) select row_id, errors, len(errors) = 0 as valid from r")
def rule_validation(spark, sf_dir):
    """Names of the rules that each pair breaks."""
    errors = validation.violations({n: rule() for n, (_, rule) in _RULES.items()})
    return table(spark, sf_dir, "dataset").select("row_id", errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


@CATALOG.query(f"select doc_id, list_filter([{_MARKERS_SQL}], lambda m: contains(lower(text), m))[1] as marker from documents where text is not null")
def page_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", validation.first_marker(F.col("text"), PAGE_MARKERS).alias("marker"))


@CATALOG.query("select row_id, length(instruction)::bigint as instruction_chars, length(response)::bigint as response_chars, timestamp is not null as timed, not coalesce(verified, false) or response is null as queued from dataset")
def pair_metadata(spark, sf_dir):
    """Lengths and flags instead of content, and who needs a look."""
    return table(spark, sf_dir, "dataset").select("row_id", F.length("instruction").cast("bigint").alias("instruction_chars"), F.length("response").cast("bigint").alias("response_chars"), F.col("timestamp").isNotNull().alias("timed"), (~F.coalesce("verified", F.lit(False)) | F.col("response").isNull()).alias("queued"))


_BEST = "order by coalesce(epoch_us(try_cast(case when regexp_matches(timestamp, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}([.,]\\d+)?)?(Z|[+-]\\d{2}(:?\\d{2})?)?$') then case when regexp_matches(timestamp, '(Z|[+-]\\d{2}:\\d{2})$') then timestamp else timestamp || 'Z' end end as timestamptz)), 0) desc, coalesce(style_score, 0) desc, coalesce(sha256, '') desc, row_id desc"


@CATALOG.query(f"select source, problem_id, versions, row_id, path from (select source, problem_id, row_id, path, count(*) over (partition by source, problem_id) as versions, row_number() over (partition by source, problem_id {_BEST}) as r from pilot_manifest) where r = 1")
def best_version(spark, sf_dir):
    """The best version of each problem as spelled: latest, best styled, by digest."""
    order = [F.coalesce(ids.instant_micros(F.col("timestamp")), F.lit(0)), F.coalesce("style_score", F.lit(0)), F.coalesce("sha256", F.lit("")), F.col("row_id")]
    return ranking.best_version(table(spark, sf_dir, "pilot_manifest"), ["source", "problem_id"], order, ["row_id", "path"]).select("source", "problem_id", "versions", "row_id", "path")


@CATALOG.query(f"select source, problem_id, r as place, row_id from (select source, problem_id, row_id, row_number() over (partition by source, problem_id {_BEST}) as r from pilot_manifest) where r > 1")
def losing_versions(spark, sf_dir):
    order = [F.coalesce(ids.instant_micros(F.col("timestamp")), F.lit(0)), F.coalesce("style_score", F.lit(0)), F.coalesce("sha256", F.lit("")), F.col("row_id")]
    return ranking.losing_versions(table(spark, sf_dir, "pilot_manifest"), ["source", "problem_id"], order, ["row_id"]).withColumn("place", F.col("place").cast("bigint"))


@CATALOG.query("with c as (select source, problem_id, count(*) as n from pilot_manifest group by all) select count(*) as keys, count(*) filter (where n > 1) as keys_with_versions, coalesce(sum(n) filter (where n > 1), 0)::bigint as rows_in_them from c")
def version_counts(spark, sf_dir):
    return ranking.versions_per_key(table(spark, sf_dir, "pilot_manifest"), ["source", "problem_id"])


_ASSEMBLY_SQL = """
with v as (select row_id, source, upper(problem_id) as problem_id, sha256, path, compile from pilot_manifest),
code as (select sha256(text) as sha, min(record_id) as record_id from style_v3 where text is not null group by 1),
st as (select source, upper(problem_id) as problem_id, min(row_id) as statement_row from dataset where instruction is not null and source is not null and problem_id is not null group by 1, 2),
item as (select distinct oj as source, upper(problem_id) as problem_id, true as held from manifest),
j as (select v.*, code.record_id, st.statement_row, item.held from v left join code on lower(v.sha256) = code.sha left join st using (source, problem_id) left join item using (source, problem_id))
select row_id, record_id, statement_row, case when source is null or problem_id is null or trim(problem_id) = '' then 'metadata_missing' when sha256 is null then 'digest_missing' when record_id is null then 'code_missing' when statement_row is null then 'statement_missing' when held then 'held_out_item' when compile is distinct from true then 'not_compiled' end as reason from j
"""


def _assembled(spark, sf_dir):
    versions = table(spark, sf_dir, "pilot_manifest").select("row_id", "source", F.upper("problem_id").alias("problem_id"), F.col("sha256"), "path", "compile", F.lower("sha256").alias("sha"))
    code = table(spark, sf_dir, "style_v3").where("text is not null").groupBy(tx.sha256_text(F.col("text")).alias("sha")).agg(F.min("record_id").alias("record_id"))
    statements = table(spark, sf_dir, "dataset").where("instruction is not null and source is not null and problem_id is not null").groupBy("source", F.upper("problem_id").alias("problem_id")).agg(F.min("row_id").alias("statement_row"))
    held = contamination.sized_broadcast(table(spark, sf_dir, "manifest").select(F.col("oj").alias("source"), F.upper("problem_id").alias("problem_id")).distinct().withColumn("held", F.lit(True)), 100_000)
    joined = versions.join(code, "sha", "left").join(statements, ["source", "problem_id"], "left").join(held, ["source", "problem_id"], "left")
    reasons = {
        "metadata_missing": F.col("source").isNull() | F.col("problem_id").isNull() | (F.trim("problem_id") == ""),
        "digest_missing": F.col("sha256").isNull(),
        "code_missing": F.col("record_id").isNull(),
        "statement_missing": F.col("statement_row").isNull(),
        "held_out_item": F.col("held"),
        "not_compiled": ~F.col("compile").eqNullSafe(True),
    }
    return assembly.routed(joined, reasons)


@CATALOG.query(_ASSEMBLY_SQL)
def pair_assembly(spark, sf_dir):
    """Versions joined to their code and statement, with the reason of those that give no pair."""
    return _assembled(spark, sf_dir).select("row_id", "record_id", "statement_row", "reason")


@CATALOG.query(f"with a as ({_ASSEMBLY_SQL}), f as (select count(*) as n, count(*) filter (where reason is distinct from 'metadata_missing') as a, count(*) filter (where reason is null or reason not in ('metadata_missing', 'digest_missing', 'code_missing')) as b, count(*) filter (where reason is null or reason in ('held_out_item', 'not_compiled')) as c, count(*) filter (where reason is null) as d from a) select 'identified' as stage, 0::bigint as ord, n as attempted, a as kept, n - a as dropped from f union all select 'with_code', 1, a, b, a - b from f union all select 'with_statement', 2, b, c, b - c from f union all select 'usable', 3, c, d, c - d from f")
def assembly_funnel(spark, sf_dir):
    """What is left after each stage of the assembly, in one pass."""
    reason = F.coalesce("reason", F.lit("none"))
    stages = {"identified": reason != "metadata_missing", "with_code": ~reason.isin("digest_missing", "code_missing"), "with_statement": reason != "statement_missing", "usable": reason == "none"}
    return assembly.funnel(_assembled(spark, sf_dir), stages).withColumn("ord", F.col("ord").cast("bigint"))


_SHINGLE_SQL = """
with i as (select problem_id, {0} as t from (select problem_id, {1} as x from bench_problem) where x is not null),
r as (select row_id, {0} as t from (select row_id, {2} as x from dataset) where x is not null),
ish as (select problem_id, len(t) as n, unnest(list_distinct(case when len(t) >= 5 then list_transform(range(1, len(t) - 3), lambda k: array_to_string(t[k:k + 4], chr(0))) else t end)) as s from i),
rsh as (select row_id, len(t) as n, unnest(list_distinct(case when len(t) >= 5 then list_transform(range(1, len(t) - 3), lambda k: array_to_string(t[k:k + 4], chr(0))) else t end)) as s from r),
isz as (select problem_id, count(*) as c from ish group by 1), rsz as (select row_id, count(*) as c from rsh group by 1),
m as (select row_id, problem_id, count(*) as shared from rsh join ish using (s) where least(rsh.n, ish.n) / greatest(rsh.n, ish.n, 1) >= 0.35 group by 1, 2)
select row_id, problem_id, shared, rsz.c + isz.c - shared as all_shingles from m join rsz using (row_id) join isz using (problem_id)
"""


def _similar_sql(item: str, row: str) -> str:
    return _SHINGLE_SQL.format(_tokens_sql("x"), item, row)


def _normal_sql(x: str) -> str:
    fold = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    return _strip_sql(f"regexp_replace({fold}, '[{tx.BLANK}]+\\n', chr(10), 'g')")


_CONTAMINATION_SQL = (
    f"with code as ({_similar_sql('reference_code', 'response')}), st as ({_similar_sql('statement', 'instruction')}), "
    "e as (select row_id, b.problem_id, 'problem_id' as reason, null::bigint as cs, null::bigint as ca, null::bigint as ss, null::bigint as sa from dataset d join bench_problem b on upper(d.problem_id) = upper(b.problem_id) "
    f"union select row_id, b.problem_id, 'sha256', null, null, null, null from dataset d join bench_problem b on sha256({_normal_sql('d.response')}) = sha256({_normal_sql('b.reference_code')}) "
    "union all select row_id, problem_id, 'code_similarity', shared, all_shingles, null, null from code where shared >= 0.8 * all_shingles "
    "union all select row_id, problem_id, 'statement_similarity', null, null, shared, all_shingles from st where shared >= 0.8 * all_shingles) "
    "select row_id, problem_id, list_sort(list(distinct reason)) as reasons, max(cs) as code_shared, max(ca) as code_all, max(ss) as statement_shared, max(sa) as statement_all from e group by 1, 2"
)


@CATALOG.query(_CONTAMINATION_SQL)
def contamination_join(spark, sf_dir):
    """Pairs that equal or resemble evaluation items, with all reasons."""
    items = table(spark, sf_dir, "bench_problem").select(F.col("problem_id").alias("item"), F.col("problem_id").alias("item_problem"), "reference_code", "statement")
    rows = table(spark, sf_dir, "dataset").select("row_id", "problem_id", "response", "instruction")
    return contamination.contamination(rows, "row_id", "problem_id", "response", "instruction", items, "item", "item_problem", "reference_code", "statement").withColumnRenamed("item", "problem_id")


@CATALOG.query(f"with s as ({_similar_sql('reference_code', 'text').replace('from dataset', 'from (select record_id as row_id, text from style_v3)')}) select problem_id, row_id as best_record, shared, all_shingles from (select *, row_number() over (partition by problem_id order by shared::double / all_shingles desc, row_id) as r from s) where r = 1")
def closest_records(spark, sf_dir):
    """For each evaluation item the most similar file of the corpus, matched or not."""
    items = table(spark, sf_dir, "bench_problem").select("problem_id", "reference_code")
    files = table(spark, sf_dir, "style_v3").select("record_id", "text")
    pairs = contamination.similar_pairs(files, "record_id", "text", items, "problem_id", "reference_code")
    order = [F.col("shared").cast("double") / F.col("all"), -F.col("record_id")]
    best = ranking.best_version(pairs, ["problem_id"], order, ["record_id", "shared", "all"])
    return best.select("problem_id", F.col("record_id").alias("best_record"), "shared", F.col("all").alias("all_shingles"))


@CATALOG.query(f"with s as ({_similar_sql('reference_code', 'response')}) select problem_id, count(*)::bigint as matches, list_sort(list(row_id))[1:10] as first_rows from s where shared >= 0.8 * all_shingles group by 1")
def item_matches(spark, sf_dir):
    """Matches per item and its first ten rows: a bounded list, ranked before it is collected."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "bench_problem").select("problem_id", "reference_code")
    pairs = contamination.similar_pairs(table(spark, sf_dir, "dataset").select("row_id", "response"), "row_id", "response", items, "problem_id", "reference_code", least_similarity=0.8)
    counted = pairs.groupBy("problem_id").agg(F.count("*").alias("matches"))
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("problem_id").orderBy("row_id"))).where("r <= 10").groupBy("problem_id").agg(F.array_sort(F.collect_list("row_id")).alias("first_rows"))
    return counted.join(first, "problem_id")


_FORMS_SQL = (
    "select id, unnest(list_distinct(list_transform(list_filter([lower(id), lower(problem_id), case when len(p) > 1 and p[1] in (" + ", ".join(f"'{x}'" for x in ids.PREFIXES) + ") then array_to_string(p[2:], '') end], lambda x: x is not null), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')))) as token "
    "from (select id, problem_id, regexp_extract_all(lower(problem_id), '[a-z]+|\\d+') as p from bench_problem)"
)


def _path_items_sql(source: str, key: str, path: str) -> str:
    return f"select distinct {key}, f.id as item from (select {key}, unnest(list_transform(regexp_extract_all({path}, '{ids.PATH_TOKEN}'), lambda x: lower(x))) as token from {source}) t join ({_FORMS_SQL}) f using (token)"


def _path_items(rows, key, path, items):
    """(key, item): an equi-join on the tokens of paths and the forms of items."""
    tokens = rows.select(key, F.explode(ids.path_tokens(F.col(path))).alias("token"))
    forms = items.select(F.col("id").alias("item"), F.explode(ids.path_forms(ids.identifier_forms(F.col("id"), F.col("problem_id")))).alias("token"))
    return tokens.join(contamination.sized_broadcast(forms, 100_000), "token").select(key, "item").distinct()


@CATALOG.query(_path_items_sql("dataset", "row_id", "origin_path"))
def path_identifiers(spark, sf_dir):
    """Pairs whose path has an item's name or number as a token."""
    return _path_items(table(spark, sf_dir, "dataset"), "row_id", "origin_path", table(spark, sf_dir, "bench_problem"))


_EVIDENCE_SQL = (
    f"with sim as ({_similar_sql('reference_code', 'text').replace('from dataset', 'from (select record_id as row_id, text from style_v3)')}), "
    "near as (select b.id as item, row_id as record_id, shared / all_shingles as s, shared >= 0.8 * all_shingles as hit from sim join bench_problem b using (problem_id)), "
    f"e as (select item, record_id, 'path' as reason from ({_path_items_sql('style_v3', 'record_id', 'path')}) "
    "union select b.id, record_id, 'problem_id' from style_v3 t join bench_problem b on length(b.problem_id) >= 3 and regexp_matches(t.text, '(?i)(?:^|[^A-Za-z0-9])' || b.problem_id || '(?:$|[^A-Za-z0-9])') "
    f"union select b.id, record_id, 'sha256' from style_v3 t join bench_problem b on t.sha256 = sha256(b.reference_code) or t.sha256 = sha256({_normal_sql('b.reference_code')}) or sha256({_normal_sql('t.text')}) = sha256({_normal_sql('b.reference_code')}) "
    "union select item, record_id, 'similarity' from near where hit) "
    "select b.id as item, count(e.item) > 0 as matched, coalesce(string_agg(distinct e.reason, ',' order by e.reason), 'none') as reason, count(distinct e.record_id) as records, "
    "coalesce((select max(s) from near where near.item = b.id), 0.0) as max_similarity, coalesce(list_sort(list(distinct e.record_id) filter (where e.record_id is not null))[1:10], []) as first_records from bench_problem b left join e on e.item = b.id group by b.id"
)


@CATALOG.query(_EVIDENCE_SQL)
def item_evidence(spark, sf_dir):
    """For each evaluation item all evidence in the corpus: path, number in the whole text, digest, similar code; the greatest similarity, met or not, and the first ten records."""
    files = table(spark, sf_dir, "style_v3").select("record_id", "path", "sha256", "text")
    items = table(spark, sf_dir, "bench_problem").select("id", "problem_id", "reference_code")
    return contamination.item_evidence(files, "record_id", "path", "text", "sha256", items, "id", "problem_id", "reference_code", _path_items(files, "record_id", "path", items))


@CATALOG.query("select p.row_id, m.id as item from pilot_manifest p join manifest m on length(m.problem_id) >= 3 and regexp_matches(p.problem_id, '(?i)(?:^|[^A-Za-z0-9])' || m.problem_id || '(?:$|[^A-Za-z0-9])')")
def text_identifiers(spark, sf_dir):
    """Versions whose number has an item's in it, bounded: an equi-join on the item's first run of letters and digits, then the test."""
    run = F.lit("[a-z0-9]+")
    items = table(spark, sf_dir, "manifest").select("id", "problem_id", F.regexp_extract(F.lower("problem_id"), "[a-z0-9]+", 0).alias("run"))
    rows = table(spark, sf_dir, "pilot_manifest").where("problem_id is not null").select("row_id", F.col("problem_id").alias("x"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("problem_id"), run, 0))).alias("run"))
    met = rows.join(contamination.sized_broadcast(items, 10_000), "run").where(ids.text_has_identifier(F.col("x"), F.col("problem_id")))
    return met.select("row_id", F.col("id").alias("item")).distinct()


#: Table, key and text column of everything in which item numbers are looked for.
_NAMING = (("dataset", "row_id", "response"), ("dataset", "row_id", "instruction"), ("style_v3", "record_id", "text"))


@CATALOG.query(" union all ".join(f"select '{t}' as table_name, '{x}' as field, t.{k} as record, m.id as item from {t} t join manifest m on length(m.problem_id) >= 3 and regexp_matches(t.{x}, '(?i)(?:^|[^A-Za-z0-9])' || m.problem_id || '(?:$|[^A-Za-z0-9])')" for t, k, x in _NAMING))
def corpus_identifiers(spark, sf_dir):
    """Pairs and files that name an item's number anywhere in their whole text."""
    each = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.lit(x).alias("field"), F.col(k).alias("record"), F.col(x).alias("x")) for t, k, x in _NAMING]
    items = table(spark, sf_dir, "manifest").select(F.col("id").alias("item"), "problem_id")
    return contamination.named_items(reduce(DataFrame.unionByName, each), ["table_name", "field", "record"], "x", items, "item", "problem_id")


@CATALOG.query("select m.id, list_filter([case when m.oj is distinct from b.oj then 'oj' end, case when m.problem_id is distinct from b.problem_id then 'problem_id' end, case when m.difficulty is distinct from b.difficulty then 'difficulty' end], lambda x: x is not null) as fields from manifest m join bench_problem b using (id) where m.oj is distinct from b.oj or m.problem_id is distinct from b.problem_id or m.difficulty is distinct from b.difficulty")
def item_metadata_diff(spark, sf_dir):
    return validation.differing_fields(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "bench_problem"), "id", ["oj", "problem_id", "difficulty"])


#: Tags of each category.
_CATEGORIES = {"dp": ["dp"], "graph": ["graph", "graphs", "tree", "trees", "dfs and similar", "dsu", "shortest paths", "2-sat"], "data_structure": ["data structures", "data_structure"], "math": ["math", "combinatorics", "number theory", "fft", "probabilities", "geometry"], "string": ["string", "strings", "string suffix structures", "hashing"], "greedy": ["greedy"], "search": ["brute force", "binary search", "ternary search", "meet-in-the-middle", "search"], "implementation": ["implementation", "constructive algorithms", "sorting", "sortings"]}


@CATALOG.query("with c as (select id, list_filter([" + ", ".join(f"case when len(list_intersect(tags, [{', '.join(repr(t) for t in ts)}])) > 0 then '{n}' end" for n, ts in _CATEGORIES.items()) + "], lambda x: x is not null) as cs from manifest) select category, count(*) as n from (select unnest(case when len(cs) = 0 then ['other'] else cs end) as category from c) group by 1")
def tag_categories(spark, sf_dir):
    """Items by category; an item may be in several, or in other."""
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), n) for n, tags in _CATEGORIES.items()]))
    each = table(spark, sf_dir, "manifest").select(F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("other")))).alias("category"))
    return stats.value_counts(each, "category")


@CATALOG.query("select tag, count(*) as n from (select unnest(tags) as tag from manifest) group by 1 order by 2 desc, 1")
def tag_frequency(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "manifest").select(F.explode("tags").alias("tag")), "tag").orderBy(F.desc("n"), "tag")


#: Prompt and response lengths in code tokens and the limit they are cut to.
LIMIT = 1024
_PROMPT = "'" + chat.USER.replace("\n", "' || chr(10) || '") + "' || instruction || '" + (chat.END + chat.ASSISTANT).replace("\n", "' || chr(10) || '") + "'"
_LENGTHS = f"with l as (select row_id, len({_tokens_sql(_PROMPT)}) as p, len({_tokens_sql('response')}) as r from dataset where instruction is not null and response is not null), k as (select row_id, p, r, case when p + r <= {LIMIT} then p when r < {LIMIT} then least(p, {LIMIT} - r) else least(p, {min(256, max(32, LIMIT // 8))}) end as kp from l), t as (select row_id, p, r, kp, case when p + r <= {LIMIT} or r < {LIMIT} then r else least(r, {LIMIT} - kp) end as kr from k) "


def _lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "dataset").where("instruction is not null and response is not null")
    return rows.select("row_id", tx.token_count(chat.prompt_text(F.col("instruction"))).cast("bigint").alias("p"), tx.token_count(F.col("response")).cast("bigint").alias("r"))


@CATALOG.query(_LENGTHS + f"select row_id, p as prompt_tokens, r as response_tokens, kp as kept_prompt, kr as kept_response, p + r > {LIMIT} as truncated, r - kr as removed, greatest(0, least(r, {LIMIT} - p)) as naive_response, least(r, {LIMIT}) as first_response from t")
def truncation_what_if(spark, sf_dir):
    """What response-preserving truncation keeps of each pair, beside cutting right and keeping responses first; from lengths alone."""
    p, r = F.col("p"), F.col("r")
    kr = chat.kept_response_tokens(p, r, LIMIT)
    return _lengths(spark, sf_dir).select(
        "row_id", p.alias("prompt_tokens"), r.alias("response_tokens"), chat.kept_prompt_tokens(p, r, LIMIT).cast("bigint").alias("kept_prompt"), kr.cast("bigint").alias("kept_response"), (p + r > LIMIT).alias("truncated"),
        (r - kr).cast("bigint").alias("removed"), F.greatest(F.lit(0), F.least(r, F.lit(LIMIT) - p)).cast("bigint").alias("naive_response"), F.least(r, F.lit(LIMIT)).cast("bigint").alias("first_response"),
    )


@CATALOG.query(_LENGTHS + f"select count(*) as samples, count(*) filter (where p + r > {LIMIT}) as truncated, count(*) filter (where r > kr) as response_truncated, count(*) filter (where p + r > {LIMIT} and r = kr) as instruction_only, coalesce(sum(r - kr), 0)::bigint as removed, count(*) filter (where least(r, greatest(0, {LIMIT} - p)) < r) as naive_truncated from t")
def truncation_report(spark, sf_dir):
    each = truncation_what_if(spark, sf_dir)
    return each.agg(F.count("*").alias("samples"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("removed") > 0).alias("response_truncated"), F.count_if(F.col("truncated") & (F.col("removed") == 0)).alias("instruction_only"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"), F.count_if(F.col("naive_response") < F.col("response_tokens")).alias("naive_truncated"))


@CATALOG.query(_LENGTHS + "select row_id, r - kr as removed from t where r > kr order by 2 desc, 1 limit 20")
def largest_truncations(spark, sf_dir):
    return truncation_what_if(spark, sf_dir).where("removed > 0").select("row_id", "removed").orderBy(F.desc("removed"), "row_id").limit(20)


def _encoded(spark, sf_dir):
    """Pairs encoded with numbered tokens: ids are hashes of tokens, so any vocabulary can take their place."""
    rows = table(spark, sf_dir, "dataset").where("instruction is not null and response is not null")

    def numbered(text):
        return F.transform(tx.code_tokens(text), lambda t: F.pmod(F.crc32(t), F.lit(50_000)).cast("int"))

    # Both token arrays are bound before they are used; a lambda variable isn't written out again where it is used.
    both = F.struct(numbered(chat.prompt_text(F.col("instruction"))).alias("p"), numbered(F.col("response")).alias("r"))
    encoded = tx.let(both, lambda x: chat.encode_pair(x["p"], x["r"], LIMIT))
    answered = F.col("response").rlike("[^" + tx.SPACE + "]")
    return rows.where(answered).select("row_id", "split", encoded.alias("e"))


@CATALOG.query(_LENGTHS + f"select row_id, kp as assistant_start, kp + kr as length, p + r as original_length, p + r > {LIMIT} as truncated, kr as labelled, true as mask_right from t where kr > 0")
def loss_mask_audit(spark, sf_dir):
    """Encoded pairs and whether their loss mask is right; the mask is looked at in the arrays."""
    return _encoded(spark, sf_dir).select("row_id", F.col("e.assistant_start").cast("bigint").alias("assistant_start"), F.size("e.input_ids").cast("bigint").alias("length"), F.col("e.original_length").cast("bigint").alias("original_length"), F.col("e.truncated").alias("truncated"), F.size(F.filter("e.labels", lambda x: x != chat.NO_LOSS)).cast("bigint").alias("labelled"), chat.mask_is_right(F.col("e")).alias("mask_right"))


@CATALOG.query(_LENGTHS + ", b as (select t.row_id, d.split, kp + kr as n, (row_number() over (partition by hash_of order by t.row_id) - 1) // 8 as batch, hash_of from t join (select row_id, split, row_id % 64 as hash_of from dataset) d using (row_id) where kr > 0) select row_id, max(n) over (partition by hash_of, batch)::bigint as padded, n::bigint as real_tokens from b")
def padded_batches(spark, sf_dir):
    """Batches of eight padded to their longest, numbered within shards so that no task sees all rows."""
    rows = _encoded(spark, sf_dir).select("row_id", (F.col("row_id") % 64).alias("shard"), "e.input_ids", "e.labels")
    padded = chat.pad_batches(rows, ["row_id"], 8, "shard")
    return padded.select("row_id", F.size("input_ids").cast("bigint").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("real_tokens"))


@CATALOG.query(f"select row_id, length({_PROMPT} || response || '" + chat.END.replace("\n", "' || chr(10) || '") + f"')::bigint as rendered_chars, length({_PROMPT})::bigint as prompt_chars, true as prefix from dataset where instruction is not null and response is not null")
def chat_rendering(spark, sf_dir):
    """Rendered conversations; the prompt is a prefix of each."""
    prompt, full = chat.prompt_text(F.col("instruction")), chat.full_text(F.col("instruction"), F.col("response"))
    return table(spark, sf_dir, "dataset").where("instruction is not null and response is not null").select("row_id", F.length(full).cast("bigint").alias("rendered_chars"), F.length(prompt).cast("bigint").alias("prompt_chars"), F.startswith(full, prompt).alias("prefix"))


@CATALOG.query("select id, sha256('Solve:' || chr(10) || statement || chr(10) || 'Code only.') as prompt_sha256 from bench_problem")
def filled_prompts(spark, sf_dir):
    return table(spark, sf_dir, "bench_problem").select("id", tx.sha256_text(chat.fill_prompt("Solve:\n{problem}\nCode only.", "problem", F.col("statement"))).alias("prompt_sha256"))


_WHOLE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _fenced_sql(columns: str, rows: str) -> str:
    return f"with w as (select {columns}, {_WHOLE} as w from documents where {rows}), b as (select {columns}, w, list_transform(regexp_extract_all(w, '{extract.FENCED}', 2), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as blocks from w) select {columns}, len(blocks)::bigint as blocks, length(case when len(blocks) > 0 then list_sort(list_transform(blocks, lambda x: {{'n': -length(x), 'x': x}}))[1].x end)::bigint as longest_chars, contains(w, '```') as fenced from b"


def _fenced(documents, *columns):
    t = F.col("text")
    blocks = F.regexp_extract_all(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(extract.FENCED), 2)
    return documents.select(*columns, F.size(blocks).cast("bigint").alias("blocks"), F.when(F.size(blocks) > 0, F.length(extract.extract_code(t, "longest"))).cast("bigint").alias("longest_chars"), F.contains(t, F.lit("```")).alias("fenced"))


@CATALOG.query(_fenced_sql("doc_id", "kind = 'chat' and text is not null"))
def fenced_code(spark, sf_dir):
    """Code blocks of chat documents, and the length of the longest."""
    return _fenced(table(spark, sf_dir, "documents").where("kind = 'chat' and text is not null"), "doc_id")


@CATALOG.query(_fenced_sql("doc_id, kind", "text is not null"))
def fenced_documents(spark, sf_dir):
    """Code blocks of documents of all kinds, and the length of the longest."""
    return _fenced(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "kind")


def _py_strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_OWN_SQL = (
    f"with w as (select doc_id, {_WHOLE} as w from documents where kind = 'chat' and text is not null), "
    f"b as (select w, list_zip(list_transform(regexp_extract_all(w, '{extract.FENCED}', 1), lambda x: lower({_py_strip_sql('x')})), list_transform(regexp_extract_all(w, '{extract.FENCED}', 2), lambda x: {_py_strip_sql('x')})) as z, regexp_matches(w, '{extract.CODE_START}') as s, "
    f"regexp_extract(w, '(?s)^(.*?)(?m:^)[ \\t]*{extract.CODE_START.replace('(?m)^[ \\t]*', '')}', 1) as pre from w), "
    f"l as (select *, list_transform(list_filter(z, lambda x: x[1] in ({', '.join(repr(x) for x in extract.CPP_LANGUAGES)})), lambda x: x[2]) as marked, list_transform(z, lambda x: x[2]) as blocks from b), "
    f"c as (select w, case when len(marked) > 0 then list_reduce(marked, lambda x, y: if(length(y) > length(x), y, x)) when len(blocks) > 0 then list_reduce(blocks, lambda x, y: if(length(y) > length(x), y, x)) when s then {_py_strip_sql('substr(w, length(pre) + 1)')} else w end as own from l), "
    f"f as (select w, {_py_strip_sql('own')} as own, contains(w, '{classify.FENCE}') as fenced, regexp_matches(w, '{classify.COMPLETE_FENCE}') as complete from c), "
    f"x as (select *, case when complete then regexp_matches(regexp_replace(w, '{classify.COMPLETE_FENCE}', '', 'g'), '[^\\s]') when fenced then not regexp_matches(regexp_replace(w, '^[^\\n]*\\n?', ''), '{classify.CODE_MARKER}') "
    "else w <> own and regexp_matches(case when ends_with(w, own) then left(w, length(w) - length(own)) else w end, '[^\\s]') end as extra from f) "
    f"select case when not regexp_matches(own, '{classify.CODE_MARKER}') then 'unextractable' when extra then 'extra_natural_language' when fenced then 'markdown_code_fence' else 'pure_code' end as category, count(*) as n from x group by 1"
)


@CATALOG.query(_OWN_SQL)
def instruction_following(spark, sf_dir):
    """What answers in chat documents hold besides code."""
    t = F.col("text")
    chats = table(spark, sf_dir, "documents").where("kind = 'chat' and text is not null")
    return stats.value_counts(chats.select(classify.instruction_following(t, extract.extract_code(t)).alias("category")), "category")


@CATALOG.query(
    VERSIONS_SQL + ", l as (select distinct judge, problem from u where problem is not null and uniquely_locatable), k as (select *, row_number() over (partition by judge order by sha256('pilot:' || judge || ':' || problem), problem) as r from l), "
    "a as (select * from k where judge = 'codeforces' and r <= 30), b as (select * from k where judge = 'luogu' and r <= 60 - (select count(*) from a)), "
    "c as (select *, row_number() over (order by sha256('pilot:' || judge || ':' || problem), problem) as q from (select * from k where not (judge = 'codeforces' and r <= 30) and judge <> 'luogu')) "
    "select judge, problem from a union all select judge, problem from b union all select judge, problem from c where q <= 60 - (select count(*) from a) - (select count(*) from b)"
)
def stratified_pilot(spark, sf_dir):
    """Sixty locatable problems: up to half of one judge, then another's, then any, by hash."""
    rows = _versions(spark, sf_dir).where("problem is not null and uniquely_locatable").select("judge", "problem").distinct()
    return sampling.stratified_quota(rows, F.col("judge"), sampling.hash_key("pilot", F.col("judge"), F.col("problem")), "problem", 60, "codeforces", "luogu").select("judge", "problem")


@CATALOG.query("select id, oj from manifest order by case oj when 'icpc' then 0 when 'luogu' then 1 else 2 end, oj")
def fixed_order(spark, sf_dir):
    return ranking.in_fixed_order(table(spark, sf_dir, "manifest").select("id", "oj"), "oj", ["icpc", "luogu"])


@CATALOG.query("select problem_id from dataset where problem_id is not null intersect select problem_id from manifest")
def shared_problems(spark, sf_dir):
    return table(spark, sf_dir, "dataset").select("problem_id").where("problem_id is not null").intersect(table(spark, sf_dir, "manifest").select("problem_id"))


@CATALOG.query("select problem_id from manifest except select problem_id from dataset")
def untouched_problems(spark, sf_dir):
    return table(spark, sf_dir, "manifest").select("problem_id").subtract(table(spark, sf_dir, "dataset").select("problem_id"))


@CATALOG.query("select d.row_id, coalesce(s.record_id, p.record_id) as record_id, case when s.record_id is not null then 0 when p.record_id is not null then 1 end as level from dataset d left join (select sha256(text) as sha, min(record_id) as record_id from style_v3 where text is not null group by 1) s on lower(d.code_sha256) = s.sha left join (select path, min(record_id) as record_id from style_v3 where path is not null group by 1) p on d.origin_path = p.path")
def code_lookup(spark, sf_dir):
    """The file of each pair by digest, else by path."""
    files = table(spark, sf_dir, "style_v3")
    by_digest = files.where("text is not null").groupBy(tx.sha256_text(F.col("text")).alias("sha")).agg(F.min("record_id").alias("r"))
    by_path = files.where("path is not null").groupBy(F.col("path").alias("origin_path")).agg(F.min("record_id").alias("r"))
    rows = table(spark, sf_dir, "dataset").select("row_id", F.lower("code_sha256").alias("sha"), "origin_path")
    return assembly.fallback_chain(rows, [(by_digest, ["sha"], "r"), (by_path, ["origin_path"], "r")], "record_id").select("row_id", "record_id", F.col("record_id_level").alias("level"))


@CATALOG.query("select id, count(*) as rows from dataset where id is not null group by 1 having count(*) > 1")
def repeated_ids(spark, sf_dir):
    return validation.duplicate_keys(table(spark, sf_dir, "dataset").where("id is not null"), ["id"])


@CATALOG.query("select t.record_id, t.path, d.rows as pairs from style_v3 t join (select lower(code_sha256) as sha, count(*) as rows from dataset where code_sha256 is not null group by 1) d on lower(t.sha256) = d.sha where t.path is not null")
def metadata_join(spark, sf_dir):
    """Files with how many pairs name their digest."""
    pairs = table(spark, sf_dir, "dataset").where("code_sha256 is not null").groupBy(F.lower("code_sha256").alias("sha")).agg(F.count("*").alias("pairs"))
    files = table(spark, sf_dir, "style_v3").where("path is not null").select("record_id", "path", F.lower("sha256").alias("sha"))
    return files.join(pairs, "sha").select("record_id", "path", "pairs")


@CATALOG.query("select row_id, age_bucket, response_token_length as claimed, " + f"len({_tokens_sql('response')})::bigint as counted from dataset where response is not null and response_token_length is distinct from len({_tokens_sql('response')})")
def stale_lengths(spark, sf_dir):
    """Pairs whose stored length isn't the counted one."""
    counted = tx.token_count(F.col("response")).cast("bigint")
    return table(spark, sf_dir, "dataset").where("response is not null").select("row_id", "age_bucket", F.col("response_token_length").alias("claimed"), counted.alias("counted")).where(~F.col("claimed").eqNullSafe(F.col("counted")))
