"""Queries through files: a table is written by a sink to the shared folder and read back by the source for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, html
from ..functions import identifiers as ids
from ..functions import text as tx
from ..functions import timeage as ta
from ..operators import assembly, chunking, judging, stats
from ..session import scratch
from ..sources import readers, writers
from .catalog import Catalog, table

CATALOG = Catalog()


def _digest(column: str):
    return tx.sha256_text(F.col(column)).alias("digest")


@CATALOG.query("select record_id, path, split, length(text)::bigint as chars, sha256(text) as digest from style_v3")
def jsonl_round_trip(spark, sf_dir):
    """The corpus written as JSON lines, nulls kept, and read strictly."""
    path = scratch(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "style_v3").select("record_id", "path", "split", "text"), path)
    rows = readers.read_jsonl(spark, path, "record_id bigint, path string, split string, text string", ["record_id"])
    return rows.select("record_id", "path", "split", F.length("text").cast("bigint").alias("chars"), _digest("text"))


@CATALOG.query("select record_id, path, source_type, split, token_length from style_v3")
def pruned_round_trip(spark, sf_dir):
    """A write that drops internal columns: the reader infers what is left."""
    path = scratch(spark, "pruned")
    writers.write_jsonl(table(spark, sf_dir, "style_v3"), path, drop=["text", "sha256", "modified_at", "time_bucket", "time_weight"])
    written = spark.read.json(path)
    return written.select(*[F.col(c).cast("int") if c == "token_length" else F.col(c) for c in written.columns])


@CATALOG.query("select split, record_id, sha256(text) as digest from style_v3 where split = 'test'")
def split_round_trip(spark, sf_dir):
    """Split folders, of which only one is read."""
    path = scratch(spark, "splits")
    writers.write_splits(table(spark, sf_dir, "style_v3"), path)
    return spark.read.parquet(path).where("split = 'test'").select("split", "record_id", _digest("text"))


@CATALOG.query("select id, length(instruction)::bigint as asked, length(response)::bigint as answered from dataset where regexp_matches(instruction, '[^ \\t\\n\\r\\f\\v]') and regexp_matches(response, '[^ \\t\\n\\r\\f\\v]')")
def pair_scan(spark, sf_dir):
    """Instruction pairs with neither side blank, as JSON lines."""
    path = scratch(spark, "pairs")
    both = F.col("instruction").rlike(r"[^\s]") & F.col("response").rlike(r"[^\s]")
    writers.write_jsonl(table(spark, sf_dir, "dataset").where(both).select("id", "instruction", "response"), path)
    rows = readers.read_pairs(spark, path)
    return rows.select("id", F.length("instruction").cast("bigint").alias("asked"), F.length("response").cast("bigint").alias("answered"))


@CATALOG.query("select sha256(text) as digest, time_weight from style_v3 where regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') and time_weight > 0")
def weighted_scan(spark, sf_dir):
    """Texts with positive weights, as JSON lines."""
    path = scratch(spark, "weighted")
    writers.write_jsonl(table(spark, sf_dir, "style_v3").where(F.col("text").rlike(r"[^\s]") & (F.col("time_weight") > 0)).select("text", "time_weight"), path)
    return readers.read_weighted_texts(spark, path).select(_digest("text"), "time_weight")


@CATALOG.query("select id, problem_id, difficulty from manifest")
def document_scan(spark, sf_dir):
    """A report of evaluation items (bounded) as one JSON document, replaced by a rename, and read whole."""
    path = scratch(spark, "report").removeprefix("file:") + "/report.json"
    items = [r.asDict() for r in table(spark, sf_dir, "manifest").select("id", "problem_id", "difficulty").collect()]
    writers.write_report({"items": items}, path)
    document = readers.read_json_document(spark, path, "items array<struct<id: string, problem_id: string, difficulty: string>>")
    return document.select(F.explode("items").alias("i")).select("i.*")


@CATALOG.query("select id, oj, problem_id, difficulty from manifest")
def manifest_scan(spark, sf_dir):
    """A manifest with comments, whose keys are unique and safe and whose fields keep to their values."""
    path = scratch(spark, "manifest")
    lines = table(spark, sf_dir, "manifest").select(F.explode(F.array(F.concat(F.lit("# "), "id"), F.lit("  "), F.to_json(F.struct("id", "oj", "problem_id", "difficulty")))).alias("value"))
    lines.write.text(path)
    return readers.read_manifest(spark, path, "id string, oj string, problem_id string, difficulty string", "id", {"oj": ["luogu", "codeforces", "icpc"], "difficulty": ["easy", "medium", "hard"]}, 120)


_DETAILS = "(select m.model, b.problem_id as problem, p.prompt, (ascii(md5(m.model || b.problem_id || p.prompt)) % 2) = 0 as ac from bench_problem b, (values ('base'), ('tuned')) m(model), (values ('P0'), ('P1'), ('P2')) p(prompt))"


@CATALOG.query(f"select prompt, model, count(*) as problems, count(*) filter (where ac) as accepted from {_DETAILS} group by 1, 2")
def detail_scan(spark, sf_dir):
    """Results by prompt folder, each key once: the partition column comes from the folder."""
    path = scratch(spark, "details")
    grid = table(spark, sf_dir, "bench_problem").select(F.col("problem_id").alias("problem"), F.explode(F.array(F.lit("base"), F.lit("tuned"))).alias("model")).withColumn("prompt", F.explode(F.array(F.lit("P0"), F.lit("P1"), F.lit("P2"))))
    ac = F.ascii(F.md5(F.concat("model", "problem", "prompt").cast("binary"))) % 2 == 0
    # One array per model and prompt, as a judge leaves it.
    arrays = grid.withColumn("ac", ac).groupBy("prompt", "model").agg(F.to_json(F.collect_list(F.struct("model", "problem", "ac"))).alias("value"))
    arrays.select("prompt", "value").repartition("prompt", "value").write.option("maxRecordsPerFile", 1).partitionBy("prompt").text(path)
    rows = readers.read_details(spark, path, "model string, problem string, ac boolean, prompt string", ["prompt", "model", "problem"])
    return rows.groupBy("prompt", "model").agg(F.count("*").alias("problems"), F.count_if("ac").alias("accepted"))


@CATALOG.query("select problem_id, case when length(title) % 2 = 0 and regexp_matches(statement, '[^\\x00-\\x7f]') then 'gb18030' else 'utf-8' end as encoding, sha256(statement) as digest, strlen(statement) > 0 as has_text from bench_problem")
def encoding_scan(spark, sf_dir):
    """Files in two encodings, found in all folders, read as bytes and decoded."""
    path = scratch(spark, "raw")
    items = table(spark, sf_dir, "bench_problem").select("oj", "problem_id", "statement", (F.length("title") % 2 == 0).alias("odd"))
    for odd, encoding in ((False, "utf-8"), (True, "gb18030")):
        writers.write_texts(items.where(F.col("odd") == odd), path, ["oj", "problem_id"], "statement", "cpp", encoding)
    files = readers.read_raw_files(spark, path).select(F.regexp_extract("path", r"([^/]*)\.cpp$", 1).alias("problem_id"), readers.decoded(F.col("content")).alias("d"))
    return files.select("problem_id", "d.encoding", tx.sha256_text(F.col("d.text")).alias("digest"), (F.length("d.text") > 0).alias("has_text"))


@CATALOG.query("select case when length(title) % 2 = 0 and regexp_matches(statement, '[^\\x00-\\x7f]') then 'gb18030' else 'utf-8' end as encoding, count(*) as files, sum(length(statement))::bigint as chars from bench_problem group by 1")
def encoding_counts(spark, sf_dir):
    """Files and characters by encoding."""
    path = scratch(spark, "raw")
    items = table(spark, sf_dir, "bench_problem").select("problem_id", "statement", (F.length("title") % 2 == 0).alias("odd"))
    for odd, encoding in ((False, "utf-8"), (True, "gb18030")):
        writers.write_texts(items.where(F.col("odd") == odd), path, ["problem_id"], "statement", "cpp", encoding)
    files = readers.read_raw_files(spark, path).select(readers.decoded(F.col("content")).alias("d")).select("d.*")
    return files.groupBy("encoding").agg(F.count("*").alias("files"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@CATALOG.query(
    "select problem_id as problem, k.key, case k.key when 'id' then id when 'time_limit_seconds' then time_limit_seconds::varchar when 'memory_limit_mb' then memory_limit_mb::varchar when 'strict' then 'true' else checker_type end as value "
    "from bench_problem, (values ('id'), ('time_limit_seconds'), ('memory_limit_mb'), ('strict'), ('checker.type')) k(key)"
)
def config_scan(spark, sf_dir):
    """Small configurations of two levels, flattened to dotted keys."""
    path = scratch(spark, "metas")
    text = F.concat(F.lit("# item\nid: '"), "id", F.lit("'\n\ntime_limit_seconds: "), F.col("time_limit_seconds").cast("string"), F.lit("\nmemory_limit_mb: "), F.col("memory_limit_mb").cast("string"), F.lit("\nstrict: True\nchecker:\n  type: "), "checker_type", F.lit("\n"))
    writers.write_texts(table(spark, sf_dir, "bench_problem").select("problem_id", F.lit("meta").alias("name"), text.alias("text")), path, ["problem_id", "name"], "text", "yaml")
    return readers.read_metas(spark, path)


@CATALOG.query("select problem_id as problem, '01' as suffix, title as input, difficulty as output from bench_problem union all select problem_id, '_big', statement, null from bench_problem")
def case_scan(spark, sf_dir):
    """Inputs and outputs of test cases paired by suffix; a missing side is null."""
    path = scratch(spark, "cases")
    items = table(spark, sf_dir, "bench_problem")
    for name, column in (("input01", "title"), ("output01", "difficulty"), ("input_big", "statement")):
        writers.write_texts(items.select("problem_id", F.lit("tests").alias("folder"), F.lit(name).alias("name"), column), path, ["problem_id", "folder", "name"], column, "txt")
    return readers.test_cases(spark, path).select("problem", "suffix", *[F.col(c).cast("string").alias(c) for c in ("input", "output")])


@CATALOG.query("select oj as source, upper(problem_id) as problem_id, sha256(statement) as digest from bench_problem union all select 'unknown', upper(problem_id), sha256(title) from bench_problem where difficulty = 'easy'")
def statement_scan(spark, sf_dir):
    """Statements in a judge's folder as Markdown, and elsewhere as text: keyed by judge, or unknown, and number."""
    path = scratch(spark, "statements")
    items = table(spark, sf_dir, "bench_problem")
    writers.write_texts(items, path, ["oj", "problem_id"], "statement", "md")
    writers.write_texts(items.where("difficulty = 'easy'").select(F.lit("other").alias("folder"), "problem_id", "title"), path, ["folder", "problem_id"], "title", "txt")
    return readers.statement_index(spark, path).select("source", "problem_id", _digest("text"))


@CATALOG.query("select m.model, problem_id as problem, sha256(reference_code) as digest from bench_problem, (values ('base'), ('tuned')) m(model)")
def output_scan(spark, sf_dir):
    """Answers of models, one file per model and item."""
    path = scratch(spark, "outputs")
    items = table(spark, sf_dir, "bench_problem").withColumn("model", F.explode(F.array(F.lit("base"), F.lit("tuned"))))
    writers.write_texts(items, path, ["model", "problem_id"], "reference_code", "cpp")
    return readers.read_outputs(spark, path).select("model", "problem", _digest("code"))


def _escaped(column):
    out = column
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def _pages(spark, sf_dir):
    """A page for every evaluation item in the form of its judge: an embedded record, classes, or headings."""
    items = table(spark, sf_dir, "bench_problem").select("oj", "problem_id", "difficulty", "title", "checker_type")
    title = _escaped(F.col("title"))
    record = F.to_json(F.struct("title", F.concat(F.lit("About "), "title").alias("description"), F.col("difficulty").alias("inputFormat"), F.col("checker_type").alias("outputFormat"), F.lit("n < 10").alias("hint"), F.array(F.array(F.lit("1 2"), F.lit("3"))).alias("samples")))
    embedded = F.concat(F.lit('<html><body><script type="application/json">'), F.replace(record, F.lit("<"), F.lit("\\u003c")), F.lit("</script></body></html>"))
    classes = F.concat(
        F.lit('<div class="problem-statement"><div class="title">'), title, F.lit("</div><p>About "), title, F.lit('</p><div class="input-specification"><div class="section-title">Input</div><p>'), "difficulty",
        F.lit('</p></div><div class="output-specification"><div class="section-title">Output</div><p>'), "checker_type", F.lit('</p></div><div class="note"><div class="section-title">Note</div><p>n &lt; 10</p></div>'),
        F.lit('<div class="sample-test"><div class="input"><pre>1 2</pre></div><div class="output"><pre>3</pre></div></div></div>'),
    )
    headings = F.concat(
        F.lit("<article><h1>"), title, F.lit(f"</h1><h2>{html.HEADINGS['statement']}</h2><p>About "), title, F.lit(f"</p><h2>{html.HEADINGS['input']}</h2><p>"), "difficulty", F.lit(f"</p><h2>{html.HEADINGS['output']}</h2><p>"), "checker_type",
        F.lit(f"</p><h2>{html.HEADINGS['constraints']}</h2><p>n &lt; 10</p><pre>1 2</pre><pre>3</pre></article>"),
    )
    page = F.when(F.col("oj") == "luogu", embedded).when(F.col("oj") == "codeforces", classes).otherwise(headings)
    return items.select(F.col("oj").alias("source"), "problem_id", page.alias("html"))


@CATALOG.query("select oj as source, problem_id, true as success, title, 'About ' || title as statement, difficulty as input, checker_type as output, 'n < 10' as constraints, '1 2' as sample_input, '3' as sample_output, 1::bigint as samples from bench_problem")
def page_replay(spark, sf_dir):
    """Pages of three forms written to a cache, read from it and parsed again."""
    path = scratch(spark, "pages")
    writers.write_texts(_pages(spark, sf_dir), path, ["source", "problem_id"], "html", "html")
    cached = readers.read_keyed_texts(spark, path, "html", ["source", "problem_id"]).withColumnRenamed("text", "html")
    manifest = table(spark, sf_dir, "bench_problem").select(F.col("oj").alias("source"), "problem_id")
    rows = readers.replay_pages(manifest, cached)
    return rows.select("source", "problem_id", "success", "title", "statement", "input", "output", "constraints", F.col("samples")[0]["input"].alias("sample_input"), F.col("samples")[0]["output"].alias("sample_output"), F.size("samples").cast("bigint").alias("samples"))


@CATALOG.query(
    "with p as (select oj, problem_id, tags, length(problem_id) % 9 as level, 800 + 100 * (length(problem_id) % 16) as stars from manifest) select oj as source, problem_id, coalesce(case when oj = 'luogu' then case when level in (1, 2) then 'easy' when level in (3, 4) then 'medium' when level in (5, 6, 7) then 'hard' end "
    "when stars <= 1200 then 'easy' when stars <= 1900 then 'medium' else 'hard' end, 'unknown') as difficulty, tags, stars::int as rating from p"
)
def page_tags(spark, sf_dir):
    """Difficulty, tags and rating of pages, read by patterns."""
    level, stars = F.length("problem_id") % 9, F.lit(800) + F.lit(100) * (F.length("problem_id") % 16)
    boxes = F.array_join(F.transform("tags", lambda t: F.concat(F.lit('<span title="t" class="tag-box"> <b>'), _escaped(t), F.lit("</b>\n</span>"))), "")
    page = F.concat(F.lit('{"difficulty": '), level.cast("string"), F.lit("}"), boxes, F.lit('<span class="tag-box">*'), stars.cast("string"), F.lit("</span>"))
    return readers.page_metadata(table(spark, sf_dir, "manifest").select(F.col("oj").alias("source"), "problem_id", page.alias("html")))


def _section(name: str) -> str:
    return f"chr(10) || chr(10) || '## {html.HEADINGS[name]}' || chr(10) || chr(10)"


@CATALOG.query(
    f"select id, sha256('# ' || title || {_section('statement')} || statement || {_section('input')} || difficulty || {_section('output')} || oj || case when difficulty = 'easy' then '' else {_section('constraints')} || 'n < 10' end "
    "|| chr(10) || chr(10) || '## 样例 1' || chr(10) || chr(10) || '```input' || chr(10) || problem_id || chr(10) || '```' || chr(10) || chr(10) || '```output' || chr(10) || title || chr(10) || '```' || chr(10)) as digest from bench_problem"
)
def statement_documents(spark, sf_dir):
    """Canonical Markdown of every item."""
    samples = F.array(F.struct(F.col("problem_id").alias("input"), F.col("title").alias("output")))
    text = html.statement_markdown(F.col("title"), F.col("statement"), F.col("difficulty"), F.col("oj"), F.when(F.col("difficulty") == "easy", "").otherwise("n < 10"), samples)
    return table(spark, sf_dir, "bench_problem").select("id", tx.sha256_text(text).alias("digest"))


_SECONDS_SQL = (
    "case when regexp_matches(timestamp, '" + ids.ISO_INSTANT + "') then epoch_us(try_cast(case when regexp_matches(timestamp, '(Z|[+-]\\d{2}:?(\\d{2})?)$') and regexp_matches(timestamp, '[T ].*(Z|[+-]\\d{2})') then timestamp else timestamp || 'Z' end as timestamptz)) end"
)


@CATALOG.query(
    f"with c as (select path, row_id, ({_SECONDS_SQL}) // 1000000 as s, problem_id from pilot_manifest where path is not null and regexp_matches(path, '[^ ]')), m as (select path, max((s, -row_id)) as m, arg_max(coalesce(problem_id, ''), (s, -row_id)) as subject from c where s is not null and s >= 0 group by 1) "
    "select record_id, epoch_us(make_timestamp((m.m[1] * 1000000)::bigint)) // 1000000 as committed, subject, m.path is not null as found from style_v3 r left join m on r.path = m.path"
)
def history_lookup(spark, sf_dir):
    """Files with the latest commit of their path in 64 logs of versions; a log is carried forward line by line.

    Subjects and names are percent-encoded in the logs: each stays one line whatever it holds, and no name reads like a commit.
    """
    versions = table(spark, sf_dir, "pilot_manifest").where(F.col("path").rlike("[^ ]")).select("row_id", "path", ids.instant_micros(F.col("timestamp")).alias("micros"), F.coalesce("problem_id", F.lit("")).alias("subject"))
    versions = versions.withColumn("s", F.expr("micros div 1000000")).where("s >= 0")
    lines = F.array(F.concat(F.lit("commit:"), F.col("s").cast("string"), F.lit(":"), F.url_encode("subject")), F.lit(""), F.url_encode("path"))
    log = versions.select(F.concat(F.lit("log"), (F.col("row_id") % 64).cast("string")).alias("file"), "row_id", F.posexplode(lines).alias("place", "value")).select("file", (F.col("row_id") * 3 + F.col("place")).alias("line"), "value")
    latest = readers.history(spark, log)
    found = assembly.left_lookup(table(spark, sf_dir, "style_v3").select("record_id", F.url_encode("path").alias("path")), latest, ["path"], ["committed_at", "subject"], "git_")
    return found.select("record_id", F.unix_seconds("git_committed_at").alias("committed"), F.url_decode("git_subject").alias("subject"), F.col("git_found").alias("found"))


@CATALOG.query("select row_id, sha256(to_json({'row_id': row_id, 'source': source, 'problem_id': problem_id, 'path': path, 'compile': compile, 'style_score': style_score})::varchar) as digest from pilot_manifest")
def record_texts(spark, sf_dir):
    """Every version as one JSON text to search in."""
    columns = ("row_id", "source", "problem_id", "path", "compile", "style_score")
    return table(spark, sf_dir, "pilot_manifest").select("row_id", tx.sha256_text(tx.record_json(*columns)).alias("digest"))


@CATALOG.query(
    "with s as (select row_id, list_distinct(regexp_extract_all(lower(instruction), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(response), '[a-z0-9]+')) as b from dataset where instruction is not null and response is not null) "
    "select row_id, len(list_intersect(a, b))::bigint as shared, case when len(a) + len(b) = 0 then 1.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end as jaccard from s"
)
def word_overlap(spark, sf_dir):
    """Words that a question and its answer have in common, and their share of all words."""
    words = [F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)).alias(c) for c in ("instruction", "response")]
    sets = table(spark, sf_dir, "dataset").where("instruction is not null and response is not null").select("row_id", *words)
    return sets.select("row_id", F.size(F.array_intersect("instruction", "response")).cast("bigint").alias("shared"), tx.jaccard(F.col("instruction"), F.col("response")).alias("jaccard"))


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{tx.SPACE}]+'), lambda w: w <> '')"


@CATALOG.query(
    "with f as (select sha256(text) as sha, min(record_id) as record_id, min(text) as text from style_v3 where text is not null group by 1) "
    f"select row_id, record_id, {_words_sql('response')} = {_words_sql('text')} as same_words, response = text as same_text, sha256(right(response, 200)) as tail, sha256(left(response, 500)) as head from dataset join f on lower(code_sha256) = sha where response is not null"
)
def output_checks(spark, sf_dir):
    """Answers against the file they come from, by words and by characters, with the digests of their last 200 and first 500 characters."""
    files = table(spark, sf_dir, "style_v3").where("text is not null").groupBy(tx.sha256_text(F.col("text")).alias("sha")).agg(F.min("record_id").alias("record_id"))
    texts = files.join(table(spark, sf_dir, "style_v3").select("record_id", "text"), "record_id")
    rows = table(spark, sf_dir, "dataset").where("response is not null").select("row_id", F.lower("code_sha256").alias("sha"), "response").join(texts, "sha")
    response, text = F.col("response"), F.col("text")
    ends = [tx.sha256_text(c).alias(n) for c, n in ((tx.last_characters(response, 200), "tail"), (tx.first_characters(response, 500), "head"))]
    return rows.select("row_id", "record_id", tx.same_output(response, text).alias("same_words"), tx.same_output(response, text, "exact").alias("same_text"), *ends)


@CATALOG.query(f"with s as (select row_id, coalesce(({_SECONDS_SQL}) / 1e6, 0.0) as seconds from pilot_manifest) select row_id, seconds, strftime(make_timestamp((floor(seconds) * 1000000)::bigint), '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso from s")
def version_instants(spark, sf_dir):
    """Instants of versions as seconds, 0 where there is none, and as ISO text."""
    seconds = ta.epoch_seconds(F.col("timestamp"))
    return table(spark, sf_dir, "pilot_manifest").select("row_id", seconds.alias("seconds"), ta.iso_utc(F.floor(seconds)).alias("iso"))


def _groups_sql(x: str) -> str:
    tests = " ".join(f"when regexp_matches(lower({x}), '(?s){'|'.join(p)}') then '{name}'" for name, p in classify.COMPILE_ERRORS)
    return f"case {tests} else 'other' end"


_MISSING_SQL = "(" + " or ".join(f"(contains(lower(text), '{s}') and not contains(lower(code), '#include <{h}>'))" for s, h in classify.MISSING_INCLUDES.items()) + ") and not contains(lower(code), 'bits/stdc++.h')"
_LOGS = "(select d.doc_id, d.kind, d.text, coalesce(s.text, '') as code from documents d left join style_v3 s on s.record_id = d.doc_id)"


@CATALOG.query(f"select kind, {_groups_sql('text')} as category, count(*) as n from documents where text is not null group by 1, 2")
def message_categories(spark, sf_dir):
    """Documents read as compiler messages, by the first group of patterns that occurs."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return stats.value_counts(docs.select("kind", classify.compile_error_category(F.col("text")).alias("category")), "kind", "category")


@CATALOG.query(
    f"with c as (select case when {_MISSING_SQL} then 'missing_include' when c = 'missing_symbol' then 'undeclared_identifier' when c in ({', '.join(repr(c) for c in classify.LATER_CATEGORIES)}) then c else 'other' end as category from (select *, {_groups_sql('text')} as c from {_LOGS} where text is not null)) "
    f"select k.category, count(c.category) as n from (values {', '.join(f'({c!r})' for c in classify.LATER_CATEGORIES)}) k(category) left join c using (category) group by 1"
)
def reclassified_messages(spark, sf_dir):
    """Messages with the code they are about, by the later categories, 0 where there are none."""
    code = table(spark, sf_dir, "style_v3").select(F.col("record_id").alias("doc_id"), F.col("text").alias("code"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").join(code, "doc_id", "left")
    later = rows.select(classify.later_category(F.col("text"), F.coalesce("code", F.lit(""))).alias("category"))
    categories = spark.createDataFrame([(c,) for c in classify.LATER_CATEGORIES], "category string")
    return stats.zero_filled(categories, later, "category", {"n": F.count("*")})


@CATALOG.query(
    f"with p as (select record_id, text, regexp_extract_all(text, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}') as t, regexp_split_to_array(text, '{tx.TOKEN.replace(chr(39), chr(39) * 2)}') as g from style_v3 where text is not null), "
    "c as (select *, len(t) as n, unnest(range(0, case when len(t) < 128 then 0 else greatest(len(t) - 129, 0) // 1408 + 1 end)) as i from p), s as (select *, i * 1408 as a, least(i * 1408 + 1536, n) as b from c) "
    "select record_id, i::int as chunk_index, a::int as token_start, b::int as token_end, array_to_string(list_transform(range(a + 1, b + 1), lambda k: (case when k > a + 1 then g[k] else '' end) || t[k]), '') as text from s"
)
def chunk_texts(spark, sf_dir):
    """Chunks of 1,536 tokens with 128 of overlap as stretches of the text."""
    return chunking.chunk_texts(table(spark, sf_dir, "style_v3"), "record_id", "text", 1536, 128, 128)


_RUN_SQL = "select user_id, event_type, count(*) as tests, coalesce(max(value), 0) > 100 as ac from events where {} group by 1, 2"


@CATALOG.query(
    f"with a as ({_RUN_SQL.format('true')}), b as ({_RUN_SQL.format('event_id % 7 <> 0')}) select user_id, event_type, list_filter([case when a.tests is distinct from b.tests then 'tests' end, case when a.ac is distinct from b.ac then 'ac' end, case when a.tests is null or b.tests is null then 'missing' end], lambda x: x is not null) as fields "
    "from a full join b using (user_id, event_type) where a.tests is distinct from b.tests or a.ac is distinct from b.ac"
)
def judged_again(spark, sf_dir):
    """Results of a second judging, over part of the cases, that differ from the first."""
    from ..operators.validation import consistent

    def results(events):
        return events.groupBy("user_id", "event_type").agg(F.count("*").alias("tests"), (F.coalesce(F.max("value"), F.lit(0.0)) > 100).alias("ac"))

    events = table(spark, sf_dir, "events")
    return consistent(results(events), results(events.where("event_id % 7 <> 0")), ["user_id", "event_type"], ["tests", "ac"])


#: Programs that need no compiler: one repeats its input, one is wrong, one fails, one says too much, one is no program.
_PROGRAMS = {"repeats": "#!/bin/sh\ncat\n", "wrong": "#!/bin/sh\necho no\n", "fails": "#!/bin/sh\ncat\nexit 3\n", "floods": "#!/bin/sh\nwhile :; do printf '%01000d' 0; done\n", "broken": "cat\n"}


def _programs(spark, sf_dir):
    items = table(spark, sf_dir, "bench_problem").select(F.col("problem_id").alias("problem"), "title", "difficulty")
    programs = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(c).alias("code")) for n, c in _PROGRAMS.items()])
    return items.select("problem", "title", "difficulty", F.explode(programs).alias("p")).select("problem", "title", "difficulty", "p.*")


_JUDGED = (
    "with d as (select m.model, problem_id as problem, difficulty, m.model not in ('broken', 'absent') and not (m.model = 'fails' and difficulty = 'hard') as compile, case when m.model in ('absent', 'broken') or difficulty = 'hard' then 0 else 1 end as tests0, "
    "m.model = 'repeats' and difficulty <> 'hard' as ac from bench_problem, (values ('repeats'), ('wrong'), ('fails'), ('broken'), ('absent')) m(model)) "
)


@CATALOG.query(_JUDGED + "select model, problem, compile, ac, case when model = 'absent' or (model = 'fails' and difficulty = 'hard') or difficulty = 'hard' then 0 else 1 end as tests, case when ac then 1 else 0 end as passed from d")
def judged_grid(spark, sf_dir):
    """Every model and item judged: a model without outputs, an output that is missing, a program that isn't one, and items without cases fail in rows of their own."""
    rows = _programs(spark, sf_dir)
    outputs = rows.where("model <> 'floods'").where("not (model = 'fails' and difficulty = 'hard')").select("model", "problem", "code")
    items = rows.select("problem", "title", "difficulty").distinct()
    cases = items.where("difficulty <> 'hard'").select("problem", F.lit("01").alias("name"), F.col("title").cast("binary").alias("input"), F.col("title").cast("binary").alias("output"))
    details, _ = judging.evaluate(["repeats", "wrong", "fails", "broken", "absent"], items.select("problem"), outputs, cases, spark.sparkContext.defaultParallelism, seconds=10.0, build=judging.script_source)
    return details.select("model", "problem", "compile", "ac", "tests", "passed")


@CATALOG.query(_JUDGED + "select model, count(*) as total, count(*) filter (where compile) as compile, round(count(*) filter (where compile) / count(*), 6) as compile_rate, count(*) filter (where ac) as ac, round(count(*) filter (where ac) / count(*), 6) as ac_rate from d group by 1")
def judged_summary(spark, sf_dir):
    """Programs that compile and pass by model, with rates."""
    rows = _programs(spark, sf_dir)
    outputs = rows.where("model <> 'floods'").where("not (model = 'fails' and difficulty = 'hard')").select("model", "problem", "code")
    items = rows.select("problem", "title", "difficulty").distinct()
    cases = items.where("difficulty <> 'hard'").select("problem", F.lit("01").alias("name"), F.col("title").cast("binary").alias("input"), F.col("title").cast("binary").alias("output"))
    _, summary = judging.evaluate(["repeats", "wrong", "fails", "broken", "absent"], items.select("problem"), outputs, cases, spark.sparkContext.defaultParallelism, seconds=10.0, build=judging.script_source)
    return summary


@CATALOG.query(
    "select m.model || ':' || problem_id as id, m.model <> 'broken' as compile, case when m.model = 'broken' then 'compile_error' when difficulty = 'hard' then 'no_executable_sample' when m.model = 'repeats' then case difficulty when 'easy' then 'all_samples_passed' else 'partial_sample_failure' end else 'all_samples_failed' end as status, "
    "case when m.model = 'broken' or difficulty = 'hard' then [] else [case m.model when 'repeats' then 'accepted' when 'wrong' then 'wrong_answer' when 'fails' then 'runtime_error' else 'output_limit_exceeded' end] || case difficulty when 'medium' then ['unparseable_sample'] else [] end end as statuses "
    "from bench_problem, (values ('repeats'), ('wrong'), ('fails'), ('floods'), ('broken')) m(model)"
)
def verified_pairs(spark, sf_dir):
    """Pairs run on their samples: one sample, one and a blank one, or none by difficulty."""
    sample = F.struct(F.col("title").alias("input"), F.col("title").alias("output"))
    blank = F.struct(F.col("title").alias("input"), F.lit(" ").alias("output"))
    samples = F.when(F.col("difficulty") == "easy", F.array(sample)).when(F.col("difficulty") == "medium", F.array(sample, blank))
    pairs = _programs(spark, sf_dir).select(F.concat_ws(":", "model", "problem").alias("id"), "code", samples.alias("samples"))
    verified = judging.verify_pairs(pairs, spark.sparkContext.defaultParallelism, seconds=10.0, build=judging.script_source)
    return verified.select("id", "compile", "status", F.col("cases.status").alias("statuses"))
