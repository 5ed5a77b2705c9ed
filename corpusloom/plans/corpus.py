"""Queries over the corpus after splitting (style_v3) and over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import text as tx
from ..functions import timeage as ta
from ..operators import assembly, chunking, contamination, dedup, ranking, sampling, stats, validation
from .catalog import Catalog, table

CATALOG = Catalog()

#: The instant that ages are counted to; a parameter, so that results can be had again.
REFERENCE = "2026-06-01T00:00:00Z"

_TOKEN = tx.TOKEN.replace("'", "''")
_TOKENS_SQL = f"len(regexp_extract_all(text, '{_TOKEN}'))"
_LINES_SQL = "case when length(text) = 0 then 0 else length(text) - length(replace(text, chr(10), '')) + (case when text like '%' || chr(10) then 0 else 1 end) end"
_FOLD_SQL = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
_NORMAL_SQL = f"regexp_replace(regexp_replace({_FOLD_SQL}, '[{tx.BLANK}]+\\n', chr(10), 'g'), '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g')"
_MATCHES = "regexp_matches(text, '{}')".format


def _has(name: str) -> str:
    if name == "fast_io":
        return f"({_has('ios_sync_off')} or {_has('cin_untie')})"
    if name == "any_comment":
        return f"({_has('line_comment')} or {_has('block_comment')})"
    return _MATCHES(ft.PATTERNS[name].replace("'", "''"))


def _style(spark, sf_dir):
    return table(spark, sf_dir, "style_v3")


def _tokens(spark, sf_dir):
    return _style(spark, sf_dir).where("text is not null").select("record_id", "path", "split", "source_type", "time_bucket", "time_weight", tx.token_count(F.col("text")).cast("bigint").alias("tokens"))


_TOKENS_CTE = f"with t as (select record_id, path, split, source_type, time_bucket, time_weight, {_TOKENS_SQL} as tokens from style_v3 where text is not null) "


@CATALOG.query(f"select source_type, count(*) as files, count(*) filter (where text is null or length(text) = 0) as empty, count(*) filter (where text is not null and length(text) > 0 and lines < 10) as short, count(*) filter (where lines >= 10) as kept from (select *, {_LINES_SQL} as lines from style_v3) group by source_type")
def drop_counts(spark, sf_dir):
    """Empty and short files, and what is kept, by type."""
    lines = tx.newline_count(F.col("text"))
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    return _style(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("files"), F.count_if(empty).alias("empty"), F.count_if(~empty & (lines < 10)).alias("short"), F.count_if(lines >= 10).alias("kept"))


@CATALOG.query("select record_id, list_contains(string_split(path, '/'), 'templates') as is_template, nullif(regexp_extract(path, '^([^/]+)/', 1), '') as directory, nullif(regexp_extract(path, '(?:^|/)(20\\d{6})(?:/|$)', 1), '') as path_date from style_v3")
def path_components(spark, sf_dir):
    """Type by a whole path component, first directory, and date component."""
    return _style(spark, sf_dir).select("record_id", F.array_contains(F.split("path", "/"), "templates").alias("is_template"), F.nullif(F.regexp_extract("path", "^([^/]+)/", 1), F.lit("")).alias("directory"), ta.date_in_path(F.col("path")).alias("path_date"))


@CATALOG.query(f"select record_id, sha256({_NORMAL_SQL}) as normal_sha256, length({_NORMAL_SQL})::bigint as normal_chars from style_v3 where text is not null")
def normalized_digests(spark, sf_dir):
    normal = tx.normalize_code(F.col("text"))
    return _style(spark, sf_dir).where("text is not null").select("record_id", tx.sha256_text(normal).alias("normal_sha256"), F.length(normal).cast("bigint").alias("normal_chars"))


@CATALOG.query(f"select digest, rows, first.path as path, first.record_id as record_id from (select sha256({_FOLD_SQL}) as digest, count(*) as rows, arg_min({{'path': path, 'record_id': record_id}}, (path, record_id)) as first from style_v3 where text is not null group by 1)")
def exact_dedup_keep_first(spark, sf_dir):
    """One row per newline-folded text: the first in path order."""
    rows = _style(spark, sf_dir).where("text is not null")
    return dedup.keep_first(rows, tx.sha256_text(tx.fold_newlines(F.col("text"))), ["path", "record_id"])


@CATALOG.query(f"select sha256({_FOLD_SQL}) as digest, count(*) as rows, min(record_id) as first_member, max(record_id) as last_member from style_v3 where text is not null group by 1 having count(*) > 1")
def duplicate_groups(spark, sf_dir):
    rows = _style(spark, sf_dir).where("text is not null")
    return dedup.duplicate_groups(rows, tx.sha256_text(tx.fold_newlines(F.col("text"))), "record_id")


@CATALOG.query(f"with d as (select record_id, sha256({_FOLD_SQL}) as digest from style_v3 where text is not null) select digest, record_id from d where digest in (select digest from d group by digest having count(*) > 1)")
def duplicate_members(spark, sf_dir):
    rows = _style(spark, sf_dir).where("text is not null").select("record_id", tx.sha256_text(tx.fold_newlines(F.col("text"))).alias("d"))
    return dedup.members(rows, F.col("d"), dedup.duplicate_groups(rows, F.col("d"), "record_id"), "record_id")


@CATALOG.query(f"select doc_id, {_TOKENS_SQL} as tokens, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\t\\n\\x0B\\f\\r ]')) as ascii_tokens, ({_LINES_SQL})::bigint as lines from documents where text is not null")
def document_counts(spark, sf_dir):
    """Code tokens, their ASCII variant, and lines of every document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.token_count(t).cast("bigint").alias("tokens"), tx.ascii_token_count(t).cast("bigint").alias("ascii_tokens"), tx.newline_count(t).cast("bigint").alias("lines"))


@CATALOG.query(_TOKENS_CTE + "select split, count(*) as n, sum(tokens)::bigint as total, min(tokens) as minimum, max(tokens) as maximum, sum(tokens)::bigint / count(*) as mean, quantile_cont(tokens, 0.5)::double as median from t group by split")
def token_summary(spark, sf_dir):
    return stats.numeric_summary(_tokens(spark, sf_dir), "tokens", ["split"])


@CATALOG.query(_TOKENS_CTE + "select split, quantile_cont(tokens, 0.5)::double as p50, quantile_cont(tokens, 0.9)::double as p90, quantile_cont(tokens, 0.95)::double as p95 from t group by split")
def percentiles_linear(spark, sf_dir):
    return stats.interpolated(_tokens(spark, sf_dir), "tokens", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, ["split"])


@CATALOG.query(_TOKENS_CTE + "select split, quantile_disc(tokens, 0.5) as p50, quantile_disc(tokens, 0.9) as p90, quantile_disc(tokens, 0.95) as p95 from t group by split")
def percentiles_nearest_rank(spark, sf_dir):
    return stats.nearest_rank(_tokens(spark, sf_dir), "tokens", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, ["split"])


@CATALOG.query(_TOKENS_CTE + ", s as (select split, list_sort(list(tokens)) as v from t group by split) select split, v[1 + floor((len(v) - 1) * 0.5)::int] as median, v[1 + floor((len(v) - 1) * 0.9)::int] as p90 from s")
def percentiles_floor_index(spark, sf_dir):
    return stats.floor_index(_tokens(spark, sf_dir), "tokens", {"median": 0.5, "p90": 0.9}, ["split"])


@CATALOG.query(_TOKENS_CTE + ", l(max_length) as (values (512), (1024), (1536), (2048), (4096)) select max_length, count(*) as samples, count(*) filter (where tokens > max_length) as truncated, sum(tokens)::bigint as tokens, sum(greatest(tokens - max_length, 0))::bigint as lost from t, l where split = 'train' group by max_length")
def truncation_table(spark, sf_dir):
    return stats.truncation_table(_tokens(spark, sf_dir).where("split = 'train'"), "tokens", [512, 1024, 1536, 2048, 4096])


@CATALOG.query(_TOKENS_CTE + "select case when tokens <= 512 then '<=512' when tokens <= 1024 then '513-1024' else '>1024' end as band, count(*) as n from t group by 1")
def length_bands(spark, sf_dir):
    return stats.value_counts(_tokens(spark, sf_dir).select(stats.length_bands(F.col("tokens"), [512, 1024]).alias("band")), "band")


_BUCKETS_SQL = ", ".join(f"('{n}', {i}, {w})" for i, (n, w) in enumerate(ta.WEIGHTS_KEEP_ALL.items()))


@CATALOG.query(_TOKENS_CTE + f", d(time_bucket, ord, weight) as (values {_BUCKETS_SQL}), c as (select time_bucket, count(*) as samples, sum(tokens)::bigint as tokens from t group by 1) select d.time_bucket, ord, weight::double as weight, coalesce(samples, 0) as samples, coalesce(tokens, 0) as tokens from d left join c using (time_bucket)")
def bucket_distribution(spark, sf_dir):
    """Samples and tokens of every age bucket, 0 where there are none."""
    return stats.zero_filled(ta.bucket_dimension(spark, ta.WEIGHTS_KEEP_ALL), _tokens(spark, sf_dir), "time_bucket", {"samples": F.count("*"), "tokens": F.sum("tokens")})


_RESAMPLE_SQL = ", ".join(f"('{n}', {i}, {w})" for i, (n, w) in enumerate(ta.WEIGHTS_RESAMPLE.items()))


@CATALOG.query(_TOKENS_CTE + f", d(time_bucket, ord, weight) as (values {_RESAMPLE_SQL}), c as (select time_bucket, count(*) as samples, sum(tokens)::bigint as tokens from t group by 1) select d.time_bucket, ord, weight::double as weight, coalesce(samples, 0) as samples, coalesce(tokens, 0) as tokens from d left join c using (time_bucket)")
def resampled_buckets(spark, sf_dir):
    """The same with the weights of resampling, which know no unknown times."""
    return stats.zero_filled(ta.bucket_dimension(spark, ta.WEIGHTS_RESAMPLE), _tokens(spark, sf_dir), "time_bucket", {"samples": F.count("*"), "tokens": F.sum("tokens")})


@CATALOG.query(_TOKENS_CTE + "select time_weight, count(*) as samples, sum(tokens)::bigint as tokens, (sum((time_weight * 2)::bigint))::bigint as doubled_mass from t where split = 'train' group by 1")
def weight_classes(spark, sf_dir):
    """Samples, tokens and weighted mass by weight; masses in halves are whole numbers."""
    return _tokens(spark, sf_dir).where("split = 'train'").groupBy("time_weight").agg(F.count("*").alias("samples"), F.sum("tokens").alias("tokens"), F.sum((F.col("time_weight") * 2).cast("bigint")).alias("doubled_mass"))


_SECONDS_SQL = "case when regexp_matches(modified_at, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}(:\\d{2}([.,]\\d+)?)?(Z|[+-]\\d{2}(:?\\d{2})?)?$') then epoch_us(try_cast(case when regexp_matches(modified_at, '(Z|[+-]\\d{2}:?(\\d{2})?)$') and regexp_matches(modified_at, 'T.*(Z|[+-]\\d{2})') then modified_at else modified_at || 'Z' end as timestamptz)) end"


@CATALOG.query(f"with m as (select record_id, ({_SECONDS_SQL}) / 1e6 as s from style_v3), a as (select record_id, greatest(0, (epoch(timestamptz '2026-06-01 00:00:00+00') - s) / 86400.0) as d, s from m) select record_id, (s * 1000000)::bigint as micros, case when s is null then 'unknown_time' when d <= 183 then 'recent_6_months' when d <= 365 then '6_to_12_months' when d <= 730 then '1_to_2_years' else 'older_than_2_years' end as bucket from a")
def age_buckets(spark, sf_dir):
    """Instant and age bucket of every record's modification time."""
    from ..functions.identifiers import instant_micros

    micros = instant_micros(F.col("modified_at"))
    days = ta.age_days(micros / 1e6, instant_micros(F.lit(REFERENCE)) / 1e6)
    return _style(spark, sf_dir).select("record_id", micros.alias("micros"), F.when(micros.isNull(), ta.UNKNOWN).otherwise(ta.age_bucket(days)).alias("bucket"))


_FLAGS = (*ft.CORE_FLAGS, "maxn_maxm_constant", "ios_sync_with_stdio", "cin_tie", "long_long", "define_int_long_long", "line_comment", "block_comment")


@CATALOG.query("select record_id, " + ", ".join(f"{_has(n)} as {n}" for n in _FLAGS) + " from style_v3 where text is not null")
def style_flags(spark, sf_dir):
    return _style(spark, sf_dir).where("text is not null").select("record_id", *ft.flags(F.col("text"), _FLAGS))


@CATALOG.query("with f as (select time_bucket, " + ", ".join(f"{_has(n)} as {n}" for n in ft.CORE_FLAGS) + " from style_v3 where text is not null) " + " union all ".join(f"select time_bucket, '{n}' as feature, count(*) filter (where {n}) as hits, count(*) as n from f group by 1" for n in ft.CORE_FLAGS))
def style_prevalence(spark, sf_dir):
    """Files with each feature by age bucket: one scan, flags unpivoted after the projection."""
    return _prevalence(spark, sf_dir)


def _prevalence(spark, sf_dir):
    flagged = _style(spark, sf_dir).where("text is not null").select("time_bucket", *ft.flags(F.col("text"), ft.CORE_FLAGS))
    counted = flagged.groupBy("time_bucket").agg(F.count("*").alias("n"), *[F.count_if(n).alias(n) for n in ft.CORE_FLAGS])
    pairs = ", ".join(f"'{n}', `{n}`" for n in ft.CORE_FLAGS)
    return counted.select("time_bucket", F.expr(f"stack({len(ft.CORE_FLAGS)}, {pairs}) as (feature, hits)"), "n")


@CATALOG.query(
    "with f as (select source_type, (time_weight * 2)::bigint as w, " + ", ".join(f"{_has(n)} as {n}" for n in ft.CORE_FLAGS) + f", len(regexp_extract_all(text, '{ft.PATTERNS['line_comment']}')) as comments from style_v3 where text is not null and time_weight is not null) "
    + " union all ".join(f"select source_type, '{n}' as feature, coalesce(sum(w) filter (where {n}), 0)::bigint as mass, sum(w)::bigint as all_mass, coalesce(sum(w) filter (where {n}), 0)::bigint / sum(w)::bigint as rate, coalesce(sum(comments) filter (where {n}), 0)::bigint as comments, coalesce(sum(comments) filter (where {n})::bigint / count(*) filter (where {n}), 0) as average_comments from f group by 1" for n in ft.CORE_FLAGS)
)
def weighted_prevalence(spark, sf_dir):
    """Share of the weighted mass with each feature by type, and the average number of line comments of files that have it."""
    t = F.col("text")
    rows = _style(spark, sf_dir).where("text is not null and time_weight is not null").select("source_type", (F.col("time_weight") * 2).cast("bigint").alias("w"), *ft.flags(t, ft.CORE_FLAGS), ft.count(t, "line_comment").alias("c"))
    sums = [x for n in ft.CORE_FLAGS for x in (F.sum(F.when(F.col(n), F.col("w"))).alias(f"m_{n}"), F.sum(F.when(F.col(n), F.col("c"))).cast("bigint").alias(f"c_{n}"), F.count_if(n).alias(f"n_{n}"))]
    summed = rows.groupBy("source_type").agg(F.sum("w").alias("all_mass"), *sums)
    long = summed.select("source_type", "all_mass", F.expr(f"stack({len(ft.CORE_FLAGS)}, " + ", ".join(f"'{n}', m_{n}, c_{n}, n_{n}" for n in ft.CORE_FLAGS) + ") as (feature, mass, comments, n)"))
    mass, comments = F.coalesce("mass", F.lit(0)), F.coalesce("comments", F.lit(0))
    return long.select("source_type", "feature", mass.alias("mass"), "all_mass", (mass / F.col("all_mass")).alias("rate"), comments.alias("comments"), F.coalesce(F.when(F.col("n") > 0, comments / F.col("n")), F.lit(0.0)).alias("average_comments"))


@CATALOG.query("with f as (select time_bucket, " + ", ".join(f"{_has(n)} as {n}" for n in ft.CORE_FLAGS) + " from style_v3 where text is not null), p as (" + " union all ".join(f"select time_bucket, '{n}' as feature, count(*) filter (where {n}) as hits, count(*) as n from f group by 1" for n in ft.CORE_FLAGS) + "), s as (select feature, coalesce(sum(hits) filter (where time_bucket = 'recent_6_months'), 0)::bigint as recent_hits, coalesce(sum(n) filter (where time_bucket = 'recent_6_months'), 0)::bigint as recent_n, coalesce(sum(hits) filter (where time_bucket = '1_to_2_years'), 0)::bigint as baseline_hits, coalesce(sum(n) filter (where time_bucket = '1_to_2_years'), 0)::bigint as baseline_n from p group by 1), m as (select *, abs(recent_hits * baseline_n - baseline_hits * recent_n) * 100 >= 10.0 * recent_n * baseline_n as material from s) select *, (select count(*) from m where material) >= 3 as clear_shift from m")
def recent_shift(spark, sf_dir):
    """Features that shifted by ten points between recent files and the baseline bucket."""
    return stats.prevalence_shift(_prevalence(spark, sf_dir), "time_bucket", "recent_6_months", "1_to_2_years")


@CATALOG.query("select style_score::bigint as style_score, count(*) as n from (select " + " + ".join(f"{_has(n)}::int" for n in ft.SCORE_FLAGS) + " as style_score from style_v3 where text is not null) group by 1")
def style_scores(spark, sf_dir):
    return stats.value_counts(_style(spark, sf_dir).where("text is not null").select(ft.score(F.col("text")).cast("bigint").alias("style_score")), "style_score")


@CATALOG.query("with n as (select split, regexp_extract_all(text, '" + ft.DECLARED + "', 1) as d from style_v3 where text is not null) select split, sum(len(d))::bigint as declarations, sum(len(list_filter(d, lambda x: length(x) = 1)))::bigint as single_letter, sum(len(list_filter(d, lambda x: regexp_matches(x, '[^_]_+[^_]'))))::bigint as snake_case, sum(len(list_filter(d, lambda x: regexp_matches(x, '[a-z][A-Z]'))))::bigint as camel_case, sum(length(array_to_string(d, '')))::bigint as name_characters from n group by 1")
def naming_style(spark, sf_dir):
    """How declared names are written, by split."""
    each = _style(spark, sf_dir).where("text is not null").select("split", *ft.naming(F.col("text")))
    return each.groupBy("split").agg(*[F.sum(c).cast("bigint").alias(c) for c in each.columns if c != "split"])


@CATALOG.query(f"select split, min(l) as least, arg_min(record_id, (l, record_id)) as least_at, max(l) as greatest, arg_max(record_id, (l, record_id)) as greatest_at from (select split, record_id, ({_LINES_SQL})::bigint as l from style_v3 where text is not null) group by 1")
def shortest_longest(spark, sf_dir):
    """Files with the fewest and the most lines."""
    return ranking.extremes(_style(spark, sf_dir).where("text is not null"), tx.newline_count(F.col("text")).cast("bigint"), "record_id", ["split"])


@CATALOG.query("with s as (select path, split, min(sha256(text)) as text from style_v3 where path is not null group by 1, 2), l as (select path, text from s where split = 'train'), r as (select path, text from s where split = 'test') select count(*) filter (where l.path is not null and r.path is not null) as shared, count(*) filter (where l.path is not null and r.path is not null and l.text is not distinct from r.text) as same, count(*) filter (where l.path is not null and r.path is not null and l.text is distinct from r.text) as changed, count(*) filter (where r.path is null) as left_only, count(*) filter (where l.path is null) as right_only from l full join r on l.path = r.path")
def version_diff(spark, sf_dir):
    """Paths in both the train and the test split: the same or another text."""
    first = _style(spark, sf_dir).where("path is not null").groupBy("path", "split").agg(F.min(tx.sha256_text(F.col("text"))).alias("digest"))
    return assembly.version_diff(first.where("split = 'train'"), first.where("split = 'test'"), "path", "digest")


@CATALOG.query("select sha as digest, list_sort(list(distinct split)) as splits from (select sha256(text) as sha, split from style_v3 where text is not null) group by 1 having count(distinct split) > 1")
def split_leakage(spark, sf_dir):
    """Texts in more than one split."""
    return validation.leaked_keys(_style(spark, sf_dir).where("text is not null").select(tx.sha256_text(F.col("text")).alias("digest"), "split"), "digest", "split")


@CATALOG.query("select case when text is null then 'no_text' when sha256 is null then 'no_digest' when sha256 = sha256(text) then 'equal' when lower(sha256) = sha256(text) then 'other_case' else 'stale' end as state, split, count(*) as n from style_v3 group by 1, 2")
def digest_states(spark, sf_dir):
    """Whether stored digests are those of the texts, with the reason where a time can't be trusted."""
    real = tx.sha256_text(F.col("text"))
    state = F.when(F.col("text").isNull(), "no_text").when(F.col("sha256").isNull(), "no_digest").when(F.col("sha256") == real, "equal").when(F.lower("sha256") == real, "other_case").otherwise("stale")
    return stats.value_counts(_style(spark, sf_dir).select(state.alias("state"), "split"), "state", "split")


@CATALOG.query("select doc_id, 'documents' as origin from documents where text is null union all select record_id, 'style_v3' from style_v3 where text is null")
def null_texts(spark, sf_dir):
    """Rows without text of two tables, as one."""
    return table(spark, sf_dir, "documents").where("text is null").select("doc_id", F.lit("documents").alias("origin")).unionByName(_style(spark, sf_dir).where("text is null").select(F.col("record_id").alias("doc_id"), F.lit("style_v3").alias("origin")))


@CATALOG.query("select record_id, reason from (select record_id, case when not regexp_matches(text, '[^\\s]') then 'empty' when not regexp_matches(text, '\\b(?:int|signed|auto)\\s+main\\s*\\(') then 'missing_main' when length(replace(text, '{', '')) <> length(replace(text, '}', '')) then 'unbalanced_braces' end as reason from style_v3 where text is not null) where reason is not null")
def malformed_files(spark, sf_dir):
    from ..functions.classify import malformed_reason

    return _style(spark, sf_dir).where("text is not null").select("record_id", malformed_reason(F.col("text")).alias("reason")).where("reason is not null")


@CATALOG.query(f"select record_id, len(list_filter(regexp_extract_all(text, '{ft.FUNCTION_LINE}', 1), lambda x: x not in ('if', 'for', 'while', 'switch')))::bigint as functions, len(regexp_extract_all(text, '\\btemplate\\s*<'))::bigint as templates from style_v3 where text is not null")
def code_structure(spark, sf_dir):
    t = F.col("text")
    return _style(spark, sf_dir).where("text is not null").select("record_id", ft.function_count(t).cast("bigint").alias("functions"), ft.count(t, "template").cast("bigint").alias("templates"))


@CATALOG.query(_TOKENS_CTE + "select record_id, i as chunk_index, i * 448 as token_start, least(i * 448 + 512, tokens) as token_end from (select record_id, tokens, unnest(range(0, case when tokens < 64 then 0 else (greatest(tokens - 65, 0) // 448) + 1 end)) as i from t)")
def chunk_spans(spark, sf_dir):
    return chunking.chunk_spans(_tokens(spark, sf_dir), "record_id", "tokens").withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@CATALOG.query(_TOKENS_CTE + ", c as (select record_id, split, tokens, unnest(range(0, case when tokens < 64 then 0 else (greatest(tokens - 65, 0) // 448) + 1 end)) as i from t), k as (select split, count(*) as chunks, count(*) filter (where least(i * 448 + 512, tokens) - i * 448 = 512) as full, sum(least(i * 448 + 512, tokens) - i * 448)::bigint as emitted from c group by 1), d as (select split, count(*) as documents, sum(tokens)::bigint as tokens, sum(case when tokens >= 64 then tokens else 0 end)::bigint as covered from t group by 1) select d.split, documents, tokens, coalesce(chunks, 0) as chunks, coalesce(k.full, 0) as full, coalesce(chunks - k.full, 0) as partial, coalesce(emitted, 0) as emitted, covered, coalesce(emitted, 0) - covered as extra from d left join k using (split)")
def chunk_statistics(spark, sf_dir):
    return chunking.chunk_statistics(_tokens(spark, sf_dir), "tokens", ["split"])


@CATALOG.query("select record_id from style_v3 where split = 'train' and text is not null and (('0x' || substr(sha256('42:' || sha256(text)), 1, 13))::bigint / 4503599627370496.0) < time_weight / 4.0")
def acceptance_sample(spark, sf_dir):
    """Train records kept with a chance in proportion to their weight, by the digest of their text."""
    rows = _style(spark, sf_dir).where("split = 'train' and text is not null")
    return sampling.acceptance_sample(rows, "42", tx.sha256_text(F.col("text")), F.col("time_weight") / 4.0).select("record_id")


@CATALOG.query("with r as (select record_id as k, (time_weight * 2)::bigint as w, substr(sha256(record_id::varchar), 1, 3) as b from style_v3 where time_weight > 0), c as (select k, sum(w) over (order by b, k rows unbounded preceding) as hi, w from r), n as (select i as draw, floor((('0x' || substr(sha256('7:' || i::varchar), 1, 13))::bigint / 4503599627370496.0) * (select sum(w) from r))::bigint as place from range((select count(*) from r)) t(i)) select draw, k as record_id from n join c on place >= hi - w and place < hi")
def weighted_draws(spark, sf_dir):
    """As many draws with replacement as there are rows, in proportion to doubled weights."""
    rows = _style(spark, sf_dir).select("record_id", (F.col("time_weight") * 2).cast("bigint").alias("w"))
    return sampling.weighted_draws(rows, "record_id", "w", None, "7")


@CATALOG.query("with k as (select doc_id, row_number() over (order by sha256('42:' || doc_id::varchar), doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= (case when n >= 10 then round_even(n * 0.1, 0) else 0 end) then 'val' else 'train' end as split from k")
def hash_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.hash_split(docs, sampling.hash_key("42", F.col("doc_id").cast("string")), "doc_id")


@CATALOG.query("with k as (select record_id, row_number() over (order by sha256('42:' || record_id::varchar), record_id) as r, count(*) over () as n from style_v3) select record_id, case when r <= floor(n * 0.9) then 'train' when r <= floor(n * 0.9) + floor(n * 0.05) then 'validation' else 'test' end as split from k")
def three_way_split(spark, sf_dir):
    rows = _style(spark, sf_dir).select("record_id")
    return sampling.three_way_split(rows, sampling.hash_key("42", F.col("record_id").cast("string")), "record_id")


_DRAWS = next(sql for name, sql in CATALOG.sql.items() if name == "weighted_draws")


@CATALOG.query(f"select (s.time_weight * 2)::bigint as weight, count(*) as draws, count(distinct d.record_id) as records from ({_DRAWS}) d join style_v3 s using (record_id) group by 1")
def draw_counts(spark, sf_dir):
    """Draws, and the records they fall on, by doubled weight."""
    weights = _style(spark, sf_dir).select("record_id", (F.col("time_weight") * 2).cast("bigint").alias("weight"))
    return weighted_draws(spark, sf_dir).join(weights, "record_id").groupBy("weight").agg(F.count("*").alias("draws"), F.count_distinct("record_id").alias("records"))


@CATALOG.query("select doc_id, source from (select doc_id, source from documents order by sha256('u:' || doc_id::varchar), doc_id limit 200)")
def uniform_sample_all(spark, sf_dir):
    """Two hundred of all documents, by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.uniform_sample(docs, sampling.hash_key("u", F.col("doc_id").cast("string")), "doc_id", 200)


@CATALOG.query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha256('s:' || doc_id::varchar), doc_id) as r from documents) where r <= 20")
def uniform_sample(spark, sf_dir):
    """Twenty documents of every source, by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.sample_per_stratum(docs, "source", sampling.hash_key("s", F.col("doc_id").cast("string")), "doc_id", 20)


@CATALOG.query("with s as (select kind, count(*) as n, count(*) filter (where lang is null) as no_lang, count(*) filter (where n_chars <> length(text)) as wrong_chars from documents group by 1) select * from s")
def document_quality(spark, sf_dir):
    """Rows, missing languages and wrong lengths by kind."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_chars"))


@CATALOG.query(f"select case when instr(path, '.') > 0 then regexp_extract(path, '\\.([^./]*)$', 1) end as suffix, kind, count(*) as files, sum(strlen(text))::bigint as bytes, count(*) filter (where regexp_matches(text, '\\btemplate\\s*<')) as with_templates from documents group by 1, 2")
def file_inventory(spark, sf_dir):
    """Files, bytes and template use by suffix and kind."""
    suffix = F.when(F.instr("path", ".") > 0, F.regexp_extract("path", r"\.([^./]*)$", 1))
    return table(spark, sf_dir, "documents").groupBy(suffix.alias("suffix"), "kind").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.count_if(ft.flag(F.col("text"), "template")).alias("with_templates"))


@CATALOG.query("select key, list_sort(list(distinct split) filter (where split is not null)) as split, list_sort(list(distinct source_type) filter (where source_type is not null)) as source_type from (select sha256(text) as key, split, source_type from style_v3 where text is not null) group by 1")
def accumulated_sets(spark, sf_dir):
    """Splits and types met with each text."""
    rows = _style(spark, sf_dir).where("text is not null")
    return dedup.accumulated(rows, tx.sha256_text(F.col("text")), ["split", "source_type"])
