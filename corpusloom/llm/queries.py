"""The queries of problems 1 to 8 over whole tables with production parameters, and SQL where there is some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import text as tx
from ..plans.catalog import Catalog, table
from ..plans.pairs import ALIASES_SQL, plain_sql
from . import bpe, leaks, neardup, overlap, packing, spans, splitting, survivors

CATALOG = Catalog()

_TOKEN_SQL = "regexp_extract_all({}, '" + tx.TOKEN.replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"


def _grams_sql(name: str, key: str, source: str, words: str, width: int) -> str:
    """Two common tables: (key, g) of the distinct runs of ``width`` words, and (key, n) of their number."""
    return f"{name} as (select distinct {key} as k, unnest(list_transform(range(1, len(w) - {width - 2}), lambda i: md5(array_to_string(w[i:i + {width - 1}], chr(0))))) as g from (select {key}, {words} as w from {source}) where len(w) >= {width}), {name}_n as (select k, count(*) as n from {name} group by 1)"


def _similar_sql(name: str, label: str) -> str:
    return f"select '{label}' as table_name, a.k as id_a, b.k as id_b from {name} a join {name} b on a.g = b.g and a.k < b.k join {name}_n m on m.k = a.k join {name}_n o on o.k = b.k group by a.k, b.k, m.n, o.n having count(*) >= 0.8 * (m.n + o.n - count(*))"


_P1_SQL = "with " + _grams_sql("s", "record_id", "style_v3", _TOKEN_SQL.format("text"), 5) + ", " + _grams_sql("d", "row_id", "dataset", _TOKEN_SQL.format("response"), 5) + " " + _similar_sql("s", "style_v3") + " union all " + _similar_sql("d", "dataset")
_P3_SQL = (
    "with " + _grams_sql("h", "record_id", "style_v3 where split in ('validation', 'test')", _TOKEN_SQL.format("text"), 5) + ", " + _grams_sql("t", "record_id", "style_v3 where split = 'train'", _TOKEN_SQL.format("text"), 5)
    + " select least(h.k, t.k) as id_a, greatest(h.k, t.k) as id_b from h join t using (g) join h_n on h_n.k = h.k group by h.k, t.k, h_n.n having count(*) >= 0.85 * h_n.n - 1e-9"
)
_P4_SQL = f"select record_id from style_v3 where len({_TOKEN_SQL.format('text')}) > 1024"
_WORDS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+|[一-鿿]')"
_P5_SQL = (
    "with " + _grams_sql("a", "problem_id", "(select problem_id, unnest([statement, reference_code]) as x from bench_problem)", _WORDS_SQL.format("x"), 40) + ", " + _grams_sql("b", "row_id", "(select row_id, unnest([instruction, response]) as x from dataset)", _WORDS_SQL.format("x"), 40)
    + " select distinct b.k as row_id, a.k as problem_id from a join b using (g)"
)
_P8_SQL = "with w as (select distinct doc_id, md5(substr(text, i, 200)) as g from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)) select distinct a.doc_id as doc_a, b.doc_id as doc_b from w a join w b on a.g = b.g and a.doc_id < b.doc_id"
_NUMBER_SQL = "regexp_extract(t, '{}', {})".format
_CF = "(?i)(?:^|[^0-9])0*(\\d+)[\\s_/.-]*(?:problem[\\s_/-]*)?([a-z])[\\s_/-]?(\\d?)$"
_WORDED = "regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')"
_INSTANT_SQL = "case when regexp_matches(timestamp, '" + ids.ISO_INSTANT + "') then epoch_us(try_cast(case when regexp_matches(timestamp, '(Z|[+-]\\d{2}:?(\\d{2})?)$') and regexp_matches(timestamp, '[T ].*(Z|[+-]\\d{2})') then timestamp else timestamp || 'Z' end as timestamptz)) end"
_P2_ROWS = (
    f"with r as (select *, {ALIASES_SQL} as judge, regexp_replace({plain_sql('problem_id')}, '(?i)\\.(cpp|cc|cxx|c|hpp|h|py|java|txt|md)$', '') as t, {_INSTANT_SQL} as ts, case when style_score between 0 and 6 then style_score end as score, coalesce(compile, false) as ok from pilot_manifest), "
    f"p as (select *, case judge when 'luogu' then 'P' || nullif({_NUMBER_SQL('(?i)(?:^|[^0-9A-Za-z]|luogu)p?[\\s_/-]*0*(\\d+)$', 1)}, '') when 'codeforces' then nullif({_NUMBER_SQL(_CF, 1)} || upper({_NUMBER_SQL(_CF, 2)}) || {_NUMBER_SQL(_CF, 3)}, '') when 'icpc' then case when regexp_matches({_WORDED}, '_[a-z][0-9]?$') then regexp_extract({_WORDED}, '^(.*_)[^_]+$', 1) || upper(regexp_extract({_WORDED}, '_([^_]+)$', 1)) end end as problem from r), "
    "o as (select *, row_number() over (partition by judge, problem order by ok desc, ts desc nulls last, score desc nulls last, row_id) as place from p where judge is not null and problem is not null)"
)
_P2_SQL = _P2_ROWS + " select judge as source, problem as problem_id, arg_min(row_id, place) as row_id, coalesce(arg_min(row_id, place) filter (where ts is not null), 0) as timestamp_row_id, coalesce(arg_min(row_id, place) filter (where score is not null), 0) as style_row_id from o group by 1, 2 having count(*) > 1"
#: All choices of a version and a style row (or none) of a problem that keep the dependency; the greatest trust comes first.
_P2_SURVIVORS_SQL = (
    _P2_ROWS + ", i as (select judge, problem, sha256, min(score) as implied from o where sha256 is not null group by all having min(score) = max(score)), "
    "v as (select o.*, implied, if(ok, 2, 1) as trust from o left join i using (judge, problem, sha256)), "
    "s as (select judge, problem, row_id, score, place, if(ok, 2, 1) as trust from o where score is not null union all select distinct judge, problem, null, null, 1000000000, 0 from o), "
    "c as (select v.judge, v.problem, v.row_id as version_row, s.row_id as style_row, s.score as style_score, v.path, v.sha256, v.compile from v join s on v.judge = s.judge and v.problem = s.problem and (implied is null or s.score is null or implied = s.score) "
    "qualify row_number() over (partition by v.judge, v.problem order by v.trust + s.trust desc, v.trust desc, v.place, s.trust desc, s.place) = 1), "
    "n as (select judge, problem, count(*) as rows, arg_min(row_id, place) filter (where ts is not null) as time_row, arg_min(timestamp, place) filter (where ts is not null) as timestamp, arg_min(coalesce(age_bucket, chr(1)), place) filter (where ts is not null) as age_bucket from o group by all) "
    "select judge as source, problem as problem_id, rows, version_row, time_row, style_row, path, sha256, compile, timestamp, nullif(age_bucket, chr(1)) as age_bucket, style_score from c join n using (judge, problem)"
)



def _groups_sql(n: int, table_name: str, key: str, text: str) -> str:
    """Common tables of one table: classes of equal tokens, links between their least records, components by repeated steps."""
    t, tokens = f"g{n}", _TOKEN_SQL.format(text)
    return (
        f"{t}_w as (select {key} as id, {tokens} as w from {table_name} where len({tokens}) >= 5), {t}_r as (select min(id) over (partition by array_to_string(w, chr(0))) as rep, id, w from {t}_w), "
        f"{t}_g as (select distinct rep, unnest(list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], chr(0))))) as g from {t}_r where rep = id), {t}_n as (select rep, count(*) as n from {t}_g group by 1), "
        f"{t}_e as (select a.rep as a, b.rep as b from {t}_g a join {t}_g b on a.g = b.g and a.rep <> b.rep join {t}_n m on m.rep = a.rep join {t}_n o on o.rep = b.rep group by a.rep, b.rep, m.n, o.n having count(*) >= 0.8 * (m.n + o.n - count(*))), "
        f"{t}_c(rep, label) as (select distinct rep, rep from {t}_r union select e.b, c.label from {t}_c c join {t}_e e on e.a = c.rep where c.label < e.b), "
        f"{t}_l as (select rep, min(label) as label from {t}_c group by 1), {t}_k as (select a as rep, count(*) as links from {t}_e group by 1), "
        f"{t} as (select '{table_name}' as table_name, r.id, l.label as class_id, coalesce(k.links, 0) as links from {t}_r r join {t}_l l using (rep) left join {t}_k k using (rep))"
    )


_P1_GROUPS_SQL = "with recursive " + _groups_sql(0, "style_v3", "record_id", "text") + ", " + _groups_sql(1, "dataset", "row_id", "response") + " select * from g0 union all select * from g1"
_JOINED = "(chr(1) || array_to_string(" + _TOKEN_SQL.format("text") + ", chr(1)) || chr(1))"
_P3_REPORT_SQL = (
    f"with f as ({_P3_SQL}), s as (select record_id, split, coalesce(nullif(split_part(path, '/', 1), ''), 'none') as directory, {_JOINED} as w from style_v3), "
    "p as (select h.record_id, h.split, h.directory, contains(t.w, h.w) as exact from f join s h on h.record_id in (id_a, id_b) and h.split <> 'train' join s t on t.record_id in (id_a, id_b) and t.record_id <> h.record_id) "
    "select split, directory, count(*) as pairs, count(distinct record_id) as records, count(distinct record_id) filter (where exact) as exact_records from p group by 1, 2"
)
#: Runs of consecutive matching places; a place begins a new span if the one before doesn't reach it.
_P5_SPANS_SQL = (
    "with i as (select problem_id, x, regexp_extract_all(lower(x), '[a-z0-9]+|[一-鿿]') as w from (select problem_id, unnest([statement, reference_code]) as x from bench_problem)), "
    "ig as (select distinct problem_id, unnest(list_transform(range(1, len(w) - 38), lambda k: md5(array_to_string(w[k:k + 39], chr(0))))) as g from i where len(w) >= 40), "
    "r as (select row_id, field, regexp_extract_all(lower(x), '[a-z0-9]+|[一-鿿]') as w from (select row_id, unnest(['instruction', 'response']) as field, unnest([instruction, response]) as x from dataset)), "
    "rg as (select row_id, field, unnest(range(0, len(w) - 39)) as k, unnest(list_transform(range(1, len(w) - 38), lambda k: md5(array_to_string(w[k:k + 39], chr(0))))) as g from r where len(w) >= 40), "
    "m as (select distinct row_id, field, problem_id, k from rg join ig using (g)), n as (select *, case when k - lag(k) over (partition by row_id, field, problem_id order by k) <= 40 then 0 else 1 end as fresh from m), "
    "o as (select *, sum(fresh) over (partition by row_id, field, problem_id order by k) as span from n), spans as (select row_id, field, problem_id, min(k)::int as word_begin, (max(k) + 40)::int as word_end from o group by row_id, field, problem_id, span) "
)
_P5_REPORT_SQL = _P5_SPANS_SQL + "select problem_id, count(distinct row_id) as rows, sum(word_end - word_begin)::bigint as words, max(word_end - word_begin) as longest from spans group by 1"
_P8_COVERAGE_SQL = (
    "with w as (select doc_id, unnest(range(1, length(text) - 198)) as i, text from documents where length(text) >= 200), g as (select doc_id, i, md5(substr(text, i, 200)) as g from w), s as (select g from g group by 1 having count(distinct doc_id) > 1), "
    "p as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from g join s using (g)), "
    "c as (select doc_id, sum(case when before is null or i > before + 200 then 1 else 0 end)::bigint as spans, sum(least(200, i - coalesce(before, i - 200)))::bigint as shared from p group by 1) "
    "select doc_id, length(text)::bigint as n_chars, coalesce(shared, 0) as shared_chars, coalesce(spans, 0) as spans from documents left join c using (doc_id) where text is not null"
)

#: Tables compared by problem 1, in the order of their numbers: name, key and text.
_RECORDS = (("style_v3", "record_id", "text"), ("dataset", "row_id", "response"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (table(spark, sf_dir, name).select(F.lit(t).alias("t"), F.col(key).alias("id"), F.col(text).alias("x")) for t, (name, key, text) in enumerate(_RECORDS))
    return one.union(two)


def _table_name(t: str):
    return F.element_at(F.array(*[F.lit(name) for name, *_ in _RECORDS]), F.col(t) + 1)


@CATALOG.query(_P1_SQL)
def p1_found(spark, sf_dir):
    pairs, members = neardup.near_duplicates(_records(spark, sf_dir))
    return neardup.expand(pairs, members).select(_table_name("t").alias("table_name"), "id_a", "id_b")


@CATALOG.query(_P1_GROUPS_SQL)
def p1_groups(spark, sf_dir):
    pairs, members = neardup.near_duplicates(_records(spark, sf_dir))
    return neardup.groups(pairs, members).select(_table_name("t").alias("table_name"), "id", F.col("group").alias("class_id"), "links")


@CATALOG.query(_P2_SQL)
def p2_found(spark, sf_dir):
    found = survivors.problem_rows(table(spark, sf_dir, "pilot_manifest")).where("rows > 1")
    return found.select(F.col("judge").alias("source"), F.col("problem").alias("problem_id"), F.col("version_row").alias("row_id"), F.coalesce("time_row", F.lit(0)).alias("timestamp_row_id"), F.coalesce("style_row", F.lit(0)).alias("style_row_id"))


@CATALOG.query(_P2_SURVIVORS_SQL)
def p2_survivors(spark, sf_dir):
    return survivors.problem_survivors(table(spark, sf_dir, "pilot_manifest")).withColumnsRenamed({"judge": "source", "problem": "problem_id"})


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("validation", "test"), 1)
    records = table(spark, sf_dir, "style_v3").select(side.alias("t"), F.col("record_id").alias("id"), F.col("text").alias("x"))
    return overlap.expand(*overlap.split_overlaps(records))


@CATALOG.query(_P3_SQL)
def p3_found(spark, sf_dir):
    return _overlaps(spark, sf_dir).select(F.least("held", "train").alias("id_a"), F.greatest("held", "train").alias("id_b"))


@CATALOG.query(_P3_REPORT_SQL)
def p3_report(spark, sf_dir):
    """Pairs, held-out records and exact finds by split and first directory."""
    directory = F.nullif(F.split_part(F.col("path"), F.lit("/"), F.lit(1)), F.lit(""))
    held = table(spark, sf_dir, "style_v3").select(F.col("record_id").alias("held"), "split", F.coalesce(directory, F.lit("none")).alias("directory"))
    per = _overlaps(spark, sf_dir).groupBy("held").agg(F.count("*").alias("n"), F.max((F.col("edits") == 0).cast("int")).alias("exact"))
    return per.join(held, "held").groupBy("split", "directory").agg(F.sum("n").alias("pairs"), F.count("*").alias("records"), F.sum(F.coalesce("exact", F.lit(0))).alias("exact_records"))


@CATALOG.query(_P4_SQL)
def p4_found(spark, sf_dir):
    pieces = splitting.split_texts(table(spark, sf_dir, "style_v3"), "record_id", "text", with_text=False)
    return pieces.where("piece = 0").select("record_id")


@CATALOG.query()
def p4_pieces(spark, sf_dir):
    return splitting.split_texts(table(spark, sf_dir, "style_v3"), "record_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "manifest").select("problem_id").join(table(spark, sf_dir, "bench_problem").select("problem_id", "statement", "reference_code"), "problem_id")
    return leaks.leaked_spans(table(spark, sf_dir, "dataset"), "row_id", ["instruction", "response"], items, "problem_id", ["statement", "reference_code"])


@CATALOG.query(_P5_SQL)
def p5_found(spark, sf_dir):
    return leaks.leaked_items(_leaks(spark, sf_dir), "row_id").select("row_id", F.col("item").alias("problem_id"))


@CATALOG.query(_P5_SPANS_SQL + "select * from spans")
def p5_spans(spark, sf_dir):
    return _leaks(spark, sf_dir).withColumnRenamed("item", "problem_id")


@CATALOG.query(_P5_REPORT_SQL)
def p5_report(spark, sf_dir):
    return leaks.leak_report(_leaks(spark, sf_dir), "row_id").withColumnRenamed("item", "problem_id")


@CATALOG.query()
def p6_ids(spark, sf_dir):
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOG.query()
def p7_containers(spark, sf_dir):
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@CATALOG.query()
def p7_fill(spark, sf_dir):
    return packing.fill(packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text"))


@CATALOG.query(_P8_SQL)
def p8_found(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    classes, _, members = spans.shared_spans(documents, "doc_id", "text")
    return spans.expand(classes, members, documents, "doc_id", "text")


@CATALOG.query(_P8_COVERAGE_SQL)
def p8_coverage(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    _, shared, members = spans.shared_spans(documents, "doc_id", "text")
    return spans.coverage(shared, members, documents, "doc_id", "text")
