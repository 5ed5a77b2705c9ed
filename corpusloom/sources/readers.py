"""Sources: strict JSON lines, manifests, keyed text files, raw files, configuration, test cases, history logs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validation import ExpectationError, duplicate_keys, require_empty, violations

#: How an extension maps to text files, and keys of statements whose judge isn't known.
STATEMENT_SUFFIXES = ("md", "txt")
UNKNOWN = "unknown"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, required: list[str] = ()) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are skipped; a line that isn't an object of that schema fails the read.

    ``required`` columns must not be null or blank.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    own = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.text(path).where(F.col("value").rlike(r"[^\s]"))
    parsed = rows.select(F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    for name in required:
        bad = bad | F.coalesce(F.trim(F.col(f"r.{name}").cast("string")), F.lit("")).eqNullSafe("")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a valid row: "), F.left("value", F.lit(200))))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])


def broken_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """(file, value) of lines that ``read_jsonl`` would refuse."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    own = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(r"[^\s]"))
    parsed = rows.withColumn("r", F.from_json("value", own, {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.where(F.col("r").isNull() | F.col("r._broken").isNotNull() | ~F.col("value").rlike(r"^\s*\{")).select("file", "value")


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole files of one JSON document each."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, key: str, enums: dict[str, list[str]] | None = None, count: int | None = None, safe: bool = True) -> DataFrame:
    """A manifest of JSON lines: lines that begin with # are comments, keys are unique and safe as file names, fields keep to their values."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"[^\s]") & ~F.col("value").rlike(r"^\s*#"))
    fields = T.StructType.fromDDL(schema)
    rows = lines.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    rules: dict[str, Column] = {f"missing_{f.name}": F.col(f.name).isNull() for f in fields.fields}
    if safe:
        rules["unsafe_key"] = ~F.col(key).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
    for name, values in (enums or {}).items():
        rules[f"bad_{name}"] = ~F.col(name).isin(values)
    require_empty(rows.select(key, violations(rules).alias("errors")).where(F.size("errors") > 0), "manifest rows break rules")
    require_empty(duplicate_keys(rows, [key]), "manifest keys repeat")
    if count is not None and (n := rows.count()) != count:
        raise ExpectationError(f"expected {count} manifest rows, found {n}")
    return rows


def read_details(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Result rows of one or many JSON files, each key once. A partitioned directory adds its partition columns."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    require_empty(duplicate_keys(rows, keys), "result keys repeat")
    return rows


def read_raw_files(spark: SparkSession, path: str, pattern: str = "*.cpp") -> DataFrame:
    """(path, modified_at, bytes, content) of all files under a folder: only what is asked for is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"), "content")


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decoded(content: pa.Array) -> pa.Array:
    """Text of bytes as UTF-8, else as GB18030, and which it was; neither: null. The JVM has GB18030 only behind a legacy setting."""

    def one(data: bytes | None) -> dict | None:
        for name in ("utf-8-sig", "gb18030"):
            try:
                return data if data is None else {"text": data.decode(name), "encoding": name.removesuffix("-sig")}
            except UnicodeDecodeError:
                continue
        return {"text": None, "encoding": None}

    return pa.array([one(d) for d in content.to_pylist()], pa.struct([("text", pa.string()), ("encoding", pa.string())]))


def read_keyed_texts(spark: SparkSession, path: str, suffix: str, parts: list[str]) -> DataFrame:
    """(parts..., text) of files ``.../a/b.suffix`` whose last path components are the key parts."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True)
    names = F.split(F.regexp_replace(F.col("_metadata.file_path"), rf"\.{suffix}$", ""), "/")
    return files.select(*[F.url_decode(F.element_at(names, i - len(parts))).alias(p) for i, p in enumerate(parts)], F.col("value").alias("text"))


def statement_index(spark: SparkSession, path: str) -> DataFrame:
    """(source, problem_id, text) of statement files; files beside no judge's folder have the unknown key. The first path wins."""
    texts = None
    for suffix in STATEMENT_SUFFIXES:
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        texts = found if texts is None else texts.unionByName(found)
    parent, stem = F.element_at(F.split("file", "/"), -2), F.upper(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""))
    source = F.when(F.lower(parent).isin("luogu", "codeforces", "icpc"), F.lower(parent)).otherwise(UNKNOWN)
    return texts.groupBy(source.alias("source"), stem.alias("problem_id")).agg(F.min_by("text", "file").alias("text"))


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """(problem, suffix, input, output) of ``<problem>/tests/input*.txt`` and ``output*.txt`` paired by suffix; a missing side is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    keyed = files.select(F.element_at(F.split("path", "/"), -3).alias("problem"), F.regexp_extract(name, r"^(input|output)(.*)\.txt$", 1).alias("side"), F.regexp_extract(name, r"^(input|output)(.*)\.txt$", 2).alias("suffix"), "content").where("side <> ''")
    return keyed.groupBy("problem", "suffix").agg(F.max(F.when(F.col("side") == "input", F.col("content"))).alias("input"), F.max(F.when(F.col("side") == "output", F.col("content"))).alias("output"))


def parse_config(text: str) -> dict[str, object]:
    """A small key-value configuration: two levels by indentation, flattened to dotted keys; booleans, numbers and quoted text are read as such."""

    def scalar(value: str) -> object:
        value = value.strip()
        if value.lower() in ("true", "false"):
            return value.lower() == "true"
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            return value[1:-1]
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
        return value

    out: dict[str, object] = {}
    section = ""
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise ExpectationError(f"line {number}: expected 'key: value'")
        nested = line[0] in " \t"
        if nested and not section:
            raise ExpectationError(f"line {number}: an indented key needs a section")
        if not nested:
            section = "" if value.strip() else key.strip()
        if value.strip():
            out[f"{section}.{key.strip()}" if nested else key.strip()] = scalar(value)
    return out


#: Judge defaults.
LIMITS = {"time_limit_seconds": 2.0, "memory_limit_mb": 256, "stdout_limit_kb": 1024, "checker.type": "exact"}


def limits_of(meta: dict[str, object]) -> dict[str, object]:
    """Typed limits of a configuration, with defaults; they must be positive and the checker known."""
    found = {k: meta.get(k, v) for k, v in LIMITS.items()}
    for k in ("time_limit_seconds", "memory_limit_mb", "stdout_limit_kb"):
        if isinstance(found[k], bool) or not isinstance(found[k], (int, float)) or found[k] <= 0:
            raise ExpectationError(f"{k} must be a positive number")
    if found["checker.type"] not in ("exact", "token"):
        raise ExpectationError(f"unknown checker {found['checker.type']!r}")
    return found


def read_metas(spark: SparkSession, path: str) -> DataFrame:
    """(problem, key, value) of all ``<problem>/meta.yaml`` files, values as text."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "meta.yaml").text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("problem"), "value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [(p, k, str(v).lower() if isinstance(v, bool) else str(v)) for p, t in zip(part.column("problem").to_pylist(), part.column("value").to_pylist()) for k, v in parse_config(t).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["problem", "key", "value"])

    return files.mapInArrow(run, "problem string, key string, value string")


#: Fixed value: marks a commit line in a history log written with this format.
LOG_FORMAT = "commit:%ct:%s"


def history(spark: SparkSession, log: DataFrame, newest_first: bool = True) -> DataFrame:
    """(path, committed_at, subject): the latest commit of each path of a log with ``LOG_FORMAT`` lines followed by names.

    From (file, line, value): the lines of one or several logs, numbered. A running value carries each commit to its
    names, within one log at a time.
    """
    from pyspark.sql import Window

    seconds, subject = F.regexp_extract("value", r"^commit:(\d+):(.*)$", 1), F.regexp_extract("value", r"^commit:(\d+):(.*)$", 2)
    commit = F.when(seconds != "", F.struct(seconds.cast("bigint").alias("s"), subject.alias("subject")))
    carried = log.withColumn("c", F.last(commit, ignorenulls=True).over(Window.partitionBy("file").orderBy("line"))).where((seconds == "") & (F.trim("value") != ""))
    return carried.groupBy(F.col("value").alias("path")).agg(F.max(F.struct(F.col("c.s").alias("s"), (-F.col("line")).alias("n"), F.col("c.subject").alias("subject"))).alias("m")).select("path", F.timestamp_seconds("m.s").alias("committed_at"), F.col("m.subject").alias("subject"))


def history_log(root: str, file: str = "log") -> list[tuple[str, int, str]]:
    """(file, line, value) rows of a repository's log, by one call of git on the driver."""
    import subprocess

    said = subprocess.run(["git", "-C", root, "log", f"--format={LOG_FORMAT}", "--name-only"], capture_output=True, text=True, timeout=120, check=True).stdout
    return [(file, i, line) for i, line in enumerate(said.splitlines())]


#: Marks of pages that were blocked, in the order in which they are looked for.
BLOCK_MARKERS = ["cf-chl-", "cloudflare ray id", "checking your browser", "verify you are human", "captcha", "验证码", "登录后继续", "page not found"]


def replay_pages(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Statements parsed from cached pages: (source, problem_id, success, error, manual_required, title, ...), one row per manifest row.

    From (source, problem_id) and (source, problem_id, html). A missing page fails; a blocked one needs a hand.
    """
    from ..functions.html import statement_page
    from ..operators.validation import first_marker

    joined = manifest.select("source", "problem_id").join(pages.select("source", "problem_id", "html"), ["source", "problem_id"], "left")
    marked = joined.withColumn("marker", first_marker(F.coalesce("html", F.lit("")), BLOCK_MARKERS))
    parsed = marked.withColumn("page", statement_page(F.when(F.col("marker").isNull(), F.col("html"))))
    error = F.when(F.col("html").isNull(), "not_cached").when(F.col("marker").isNotNull(), F.concat(F.lit("blocked: "), "marker")).when(F.coalesce("page.statement", F.lit("")) == "", "no_statement")
    return parsed.select("source", "problem_id", error.isNull().alias("success"), error.alias("error"), error.isNotNull().alias("manual_required"), "page.title", "page.statement", "page.input", "page.output", "page.constraints", "page.samples")


def page_metadata(pages: DataFrame) -> DataFrame:
    """(source, problem_id, difficulty, tags, rating) read from pages without parsing them whole."""
    def unescaped(text: Column) -> Column:
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(sign))
        return text

    boxes = F.regexp_extract_all("html", F.lit(r"(?s)<span[^>]*class=\"tag-box\"[^>]*>(.*?)</span>"), 1)
    tags = F.transform(boxes, lambda t: unescaped(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), r"^\s+|\s+$", "")))
    level = F.regexp_extract("html", r"\"difficulty\"\s*:\s*(\d+)", 1).cast("int")
    rating = F.try_element_at(F.filter(tags, lambda t: t.rlike(r"^\*\d+$")), F.lit(1))
    stars = F.substring(rating, 2, 10).cast("int")
    by_level = F.when(level.isin(1, 2), "easy").when(level.isin(3, 4), "medium").when(level.isin(5, 6, 7), "hard")
    by_rating = F.when(stars <= 1200, "easy").when(stars <= 1900, "medium").when(stars.isNotNull(), "hard")
    band = F.coalesce(F.when(F.col("source") == "luogu", by_level).otherwise(by_rating), F.lit("unknown"))
    return pages.select("source", "problem_id", band.alias("difficulty"), F.filter(tags, lambda t: (t != "") & ~F.startswith(t, F.lit("*"))).alias("tags"), stars.alias("rating"))


def safe_name(name: str) -> str:
    """The name, if it is one path component of letters, digits and ._-; else an error."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ExpectationError(f"unsafe name {name!r}")
    return name


def read_weighted_texts(spark: SparkSession, path: str, need_weight: bool = True) -> DataFrame:
    """(text, time_weight) of JSON lines; a weight must be a positive number, and be there unless it isn't needed (then 1)."""
    rows = read_jsonl(spark, path, "text string, time_weight double", ["text"])
    weight = F.col("time_weight") if need_weight else F.coalesce("time_weight", F.lit(1.0))
    return rows.select("text", F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("a weight must be positive")).cast("double")).alias("time_weight"))


def read_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Instruction pairs of JSON lines, neither side blank."""
    rows = read_jsonl(spark, path, "id string, instruction string, response string", ["instruction", "response"])
    return rows.limit(limit) if limit else rows


def read_outputs(spark: SparkSession, path: str, suffix: str = "cpp") -> DataFrame:
    """(model, problem, code) of ``<model>/<problem>.suffix`` files."""
    return read_keyed_texts(spark, path, suffix, ["model", "problem"]).withColumnRenamed("text", "code")


def prompt_template(text: str, field: str = "problem") -> str:
    """A template, if it has its placeholder exactly once."""
    if text.count("{" + field + "}") != 1:
        raise ExpectationError(f"the template needs {{{field}}} exactly once")
    return text


#: Answers after which a page is asked for once more.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def fetch_pages(wanted: DataFrame, fetch, parallel: int = 1, spacing: float = 1.0, attempts: int = 2) -> DataFrame:
    """(source, problem_id, html, error) of (source, problem_id, url), fetched by ``fetch(url) -> (status, text)`` in the workers.

    Each of ``parallel`` tasks keeps ``spacing`` seconds between its calls. Rows with a cached page are left out beforehand with
    ``streaming.incremental.not_done``.
    """
    import time

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for part in batches:
            rows = []
            for source, problem, url in zip(*(part.column(c).to_pylist() for c in ("source", "problem_id", "url"))):
                page, error = None, "no address"
                for _ in range(attempts if url else 0):
                    time.sleep(max(0.0, last + spacing - time.monotonic()))
                    last = time.monotonic()
                    try:
                        status, text = fetch(url)
                    except OSError as e:
                        status, text, error = 0, None, f"failed: {e}"
                    if status == 200:
                        page, error = text, None
                        break
                    error = error if status == 0 else f"status {status}"
                    if status and status not in RETRYABLE:
                        break
                rows.append((source, problem, page, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["source", "problem_id", "html", "error"])

    return wanted.select("source", "problem_id", "url").repartition(parallel).mapInArrow(run, "source string, problem_id string, html string, error string")
