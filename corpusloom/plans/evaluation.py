"""Queries that compare conditions over the same keys, on events: a user stands for a problem, an event type for a model.

A user's rows of one type are one outcome: it passed if its greatest value is over 100, it compiled if it is over 20, and its
message is the status in words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify
from ..functions import timeage as ta
from ..operators import assembly, compare, stats, validation
from .catalog import Catalog, table

CATALOG = Catalog()

TYPES = ("click", "error", "purchase", "signup", "view")
_OUTCOME = """with o as (select user_id, event_type, count(*) as tests, count(*) filter (where value > 50) as passed, coalesce(max(value) > 100, false) as ac, coalesce(max(value) > 20, false) as compiled,
case (sum(event_id) % 6)::int when 0 then 'Time Limit exceeded' when 1 then 'output limit' when 2 then 'double free or corruption' when 3 then 'size limit reached' when 4 then 'Time limit hit' else 'wrong' end as message from events group by 1, 2),
s as (select *, case when ac then 'accepted' when not compiled then 'compile_error' when contains(lower(message), 'output limit') or contains(lower(message), 'size limit exceeded') then 'output_limit_exceeded' when contains(lower(message), 'time limit exceeded') then 'time_limit_exceeded' when message = 'double free or corruption' then 'runtime_error' else 'wrong_answer' end as status from o) """


def _outcomes(spark, sf_dir):
    value = F.col("value")
    messages = F.element_at(F.array(*[F.lit(m) for m in ("Time Limit exceeded", "output limit", "double free or corruption", "size limit reached", "Time limit hit", "wrong")]), (F.sum("event_id") % 6 + 1).cast("int"))
    grouped = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("tests"), F.count_if(value > 50).alias("passed"), F.coalesce(F.max("value") > 100, F.lit(False)).alias("ac"), F.coalesce(F.max("value") > 20, F.lit(False)).alias("compiled"), messages.alias("message"))
    return grouped.withColumn("status", classify.submission_status(F.col("ac"), F.col("compiled"), F.col("message")))


@CATALOG.query(_OUTCOME + "select event_type, count(*) as total, count(*) filter (where compiled) as compiled, count(*) filter (where ac) as accepted, count(*) filter (where compiled) / count(*) as compiled_rate, count(*) filter (where ac) / count(*) as accepted_rate from s group by 1")
def outcome_rates(spark, sf_dir):
    return stats.rates(_outcomes(spark, sf_dir), ["event_type"], {"compiled": F.col("compiled"), "accepted": F.col("ac")})


@CATALOG.query(_OUTCOME + ", g as (select event_type, user_id % 3 as band, compiled, ac, ac and user_id % 10 <> 0 as clean from s) select event_type, band, concat_ws('+', case when grouping(event_type) = 0 then 'event_type' end, case when grouping(band) = 0 then 'band' end) as level, count(*) as total, count(*) filter (where compiled) as compiled, count(*) filter (where ac) as ac, count(*) filter (where clean) as clean from g group by grouping sets ((event_type), (event_type, band), (band), ())")
def grouping_summary(spark, sf_dir):
    """Overall, per type, per band and both, in one pass; clean leaves out a list of users."""
    rows = _outcomes(spark, sf_dir).withColumn("band", F.col("user_id") % 3)
    return compare.grouping_summary(rows, [["event_type"], ["event_type", "band"], ["band"], []], {"compiled": F.col("compiled"), "ac": F.col("ac"), "clean": F.col("ac") & (F.col("user_id") % 10 != 0)})


@CATALOG.query("with e as (select user_id, event_type from (select distinct user_id from events) cross join (select unnest(['click', 'error', 'purchase', 'signup', 'view', 'refund']) as event_type)) select user_id, event_type, 'missing' as problem from e where not exists (select 1 from events v where v.user_id = e.user_id and v.event_type = e.event_type) union all select distinct user_id, event_type, 'extra' from events where event_type not in ('click', 'error', 'purchase', 'signup', 'view', 'refund')")
def completeness(spark, sf_dir):
    """Users without an event of some expected type. The six types are exploded on the users' rows, not crossed."""
    events = table(spark, sf_dir, "events")
    expected = validation.expected_grid(events, "user_id", {"event_type": [*TYPES, "refund"]})
    return validation.completeness(events, expected, ["user_id", "event_type"])


@CATALOG.query(_OUTCOME + "select l.status || '->' || r.status as transition, count(*) as n from s l join s r using (user_id) where l.event_type = 'click' and r.event_type = 'view' and l.status <> r.status group by 1")
def paired_transitions(spark, sf_dir):
    return compare.transitions(_outcomes(spark, sf_dir), ["user_id"], "event_type", "click", "view", "status")


@CATALOG.query(_OUTCOME + ", p as (select user_id, coalesce(bool_or(ac) filter (where event_type = 'click'), false) as l, coalesce(bool_or(ac) filter (where event_type = 'view'), false) as r from s where event_type in ('click', 'view') group by 1) select user_id, case when r then 'gained' else 'lost' end as change from p where l <> r")
def gained_lost(spark, sf_dir):
    return compare.gained_lost(_outcomes(spark, sf_dir), ["user_id"], "event_type", "click", "view", "ac")


@CATALOG.query(_OUTCOME + ", q as (select user_id, bool_or(ac) as a, bool_and(ac) as e, coalesce(bool_or(ac) filter (where event_type = 'click'), false) as b from s group by 1) select user_id, a as any_pass, e as all_pass, not a as none_pass, a and not e as differ, not b and a as recovered, b and not e as regressed from q")
def quantifiers(spark, sf_dir):
    return compare.quantified(_outcomes(spark, sf_dir), "user_id", "event_type", "ac", "click")


@CATALOG.query(_OUTCOME + "select event_type, status, count(*) as n from s group by 1, 2")
def status_distribution(spark, sf_dir):
    return stats.value_counts(_outcomes(spark, sf_dir), "event_type", "status")


@CATALOG.query(_OUTCOME + "select user_id, event_type, case when ac then 'AC' when not compiled then 'CE' when contains(lower(message), 'time limit') then 'TLE' when contains(lower(message), 'output limit') or contains(lower(message), 'size limit') then 'OLE' when message = 'double free or corruption' then 'RE' else 'WA' end as label from s")
def status_labels(spark, sf_dir):
    """Short labels with the time limit looked for first."""
    rows = _outcomes(spark, sf_dir)
    status = classify.submission_status(F.col("ac"), F.col("compiled"), F.col("message"), limits=("time", "output"), texts=classify.SHORT_LIMIT_TEXTS)
    return rows.select("user_id", "event_type", classify.status_label(status).alias("label"))


@CATALOG.query(_OUTCOME + ", l as (select user_id, event_type, case when not compiled then 'compile_error' when tests = 0 then 'no_executable_sample' when passed = tests then 'all_samples_passed' when passed > 0 then 'partial_sample_failure' else 'all_samples_failed' end as verified, status from s) select case when verified = 'all_samples_passed' then 'A' when verified = 'no_executable_sample' then 'B' when user_id % 7 = 0 or status in ('compile_error', 'compile_timeout', 'runtime_error', 'time_limit_exceeded', 'output_limit_exceeded') then 'D' else 'C' end as confidence, event_type, count(*) as n from l group by 1, 2")
def semantic_labels(spark, sf_dir):
    """A to D by verification, review and statuses. Every seventh user has a review."""
    rows = _outcomes(spark, sf_dir)
    verified = classify.verification_status(F.when(F.col("compiled"), "pass").otherwise("fail"), F.col("tests"), F.col("passed"))
    review = F.when(F.col("user_id") % 7 == 0, "code_error")
    return stats.value_counts(rows.select(classify.semantic_confidence(verified, review, F.array("status")).alias("confidence"), "event_type"), "confidence", "event_type")


_LABELS_SQL = CATALOG.sql["semantic_labels"]


@CATALOG.query(f"select t.event_type, k.confidence, coalesce(l.n, 0)::bigint as n, coalesce(l.n, 0)::bigint / t.total as rate from (select event_type, sum(n)::bigint as total from ({_LABELS_SQL}) group by 1) t cross join (values ('A'), ('B'), ('C'), ('D')) k(confidence) left join ({_LABELS_SQL}) l on l.event_type = t.event_type and l.confidence = k.confidence")
def semantic_distribution(spark, sf_dir):
    """Count and rate of every label from A to D by type, 0 where there are none."""
    counted = semantic_labels(spark, sf_dir).groupBy("event_type").pivot("confidence", ["A", "B", "C", "D"]).agg(F.sum("n"))
    filled = counted.select("event_type", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in "ABCD"])
    long = filled.withColumn("total", F.col("A") + F.col("B") + F.col("C") + F.col("D")).select("event_type", "total", F.expr("stack(4, 'A', A, 'B', B, 'C', C, 'D', D) as (confidence, n)"))
    return long.select("event_type", "confidence", "n", (F.col("n") / F.col("total")).alias("rate"))


@CATALOG.query(_OUTCOME + ", c as (select event_type, status, count(*) as hits from s group by 1, 2), t as (select event_type, count(*) as n from s group by 1), f as (select c.event_type, status, hits, n from c join t using (event_type)) select f.event_type, f.status, f.hits, f.n, b.hits as base_hits, b.n as base_n from f join f b using (status) where f.event_type <> 'click' and b.event_type = 'click'")
def rate_deltas(spark, sf_dir):
    """Counts of each status beside those of a baseline, as numerators and denominators."""
    per = _outcomes(spark, sf_dir).groupBy("event_type", "status").agg(F.count("*").alias("hits"))
    totals = per.groupBy("event_type").agg(F.sum("hits").alias("n"))
    return compare.delta_table(per.join(totals, "event_type"), "event_type", "status", "click")


@CATALOG.query(_OUTCOME + ", u as (select unnest(list_filter(['all', case when compiled then 'compiled' end, case when ac then 'accepted' end], lambda x: x is not null)) as scope, tests, passed from s) select scope, count(*) as n, sum(tests)::bigint as tests, sum(passed)::bigint as passed from u group by 1")
def scope_metrics(spark, sf_dir):
    rows = compare.scoped(_outcomes(spark, sf_dir), {"all": F.lit(True), "compiled": F.col("compiled"), "accepted": F.col("ac")})
    return rows.groupBy("scope").agg(F.count("*").alias("n"), F.sum("tests").alias("tests"), F.sum("passed").alias("passed"))


@CATALOG.query(_OUTCOME + ", m as (select event_type, count(*) filter (where ac) as score from s group by 1) select event_type, score from m where score = (select max(score) from m)")
def best_type(spark, sf_dir):
    per = _outcomes(spark, sf_dir).groupBy("event_type").agg(F.count_if("ac").alias("score"))
    return compare.best_groups(per, "event_type", "score")


@CATALOG.query("with c as (select user_id, list({'n': event_id, 't': event_type} order by event_id) as cases from events group by 1) select user_id, list_filter(cases, lambda x: x.t = 'error')[1].n as first_error, len(list_distinct(list_transform(cases, lambda x: x.t)))::bigint as kinds from c")
def first_failing_case(spark, sf_dir):
    """The first error of each user and how many kinds of events it has; no list is built."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first_error"), F.count_distinct("event_type").alias("kinds"))


@CATALOG.query("select event_type as status, count(distinct user_id) as records from events group by 1")
def distinct_status_counts(spark, sf_dir):
    """In how many users' cases each type occurs."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.count("*").alias("records"))
    return per.withColumnRenamed("event_type", "status")


@CATALOG.query("with a as (select event_id, greatest(0, (epoch(timestamptz '2024-07-15 00:00:00+00') - epoch(ts)) / 86400.0) as d from events) select bucket, count(*) as n from (select case when d <= 183 then 'recent_6_months' when d <= 365 then '6_to_12_months' when d <= 730 then '1_to_2_years' else 'older_than_2_years' end as bucket from a) group by 1")
def event_age_buckets(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    reference = F.unix_timestamp(F.lit("2024-07-15 00:00:00")).cast("double")
    return stats.value_counts(table(spark, sf_dir, "events").select(ta.age_bucket(ta.age_days(seconds, reference)).alias("bucket")), "bucket")


@CATALOG.query("select event_type, sum(case when value > 50 then value * 100 else 0 end)::bigint as heavy, sum(value * 100)::bigint as all_values from (select event_type, round(value)::bigint as value from events) group by 1")
def weighted_share(spark, sf_dir):
    """Mass over 50 and in all, by type, in whole numbers."""
    v = F.round("value").cast("bigint")
    return table(spark, sf_dir, "events").select("event_type", v.alias("v")).groupBy("event_type").agg(F.sum(F.when(F.col("v") > 50, F.col("v") * 100).otherwise(0)).alias("heavy"), F.sum(F.col("v") * 100).alias("all_values"))


@CATALOG.query("select 'seen' as stage, 0::bigint as ord, count(*) as attempted, count(*) filter (where user_id is not null) as kept, count(*) - count(*) filter (where user_id is not null) as dropped from events union all select 'valued', 1, count(*) filter (where user_id is not null), count(*) filter (where user_id is not null and value > 0), count(*) filter (where user_id is not null) - count(*) filter (where user_id is not null and value > 0) from events union all select 'bought', 2, count(*) filter (where user_id is not null and value > 0), count(*) filter (where user_id is not null and value > 0 and event_type = 'purchase'), count(*) filter (where user_id is not null and value > 0) - count(*) filter (where user_id is not null and value > 0 and event_type = 'purchase') from events")
def event_funnel(spark, sf_dir):
    stages = {"seen": F.col("user_id").isNotNull(), "valued": F.col("value") > 0, "bought": F.col("event_type") == "purchase"}
    return assembly.funnel(table(spark, sf_dir, "events"), stages).withColumn("ord", F.col("ord").cast("bigint"))


@CATALOG.query("select s as step, case when s < 100 then (s + 1) / 100.0 else 0.5 * (1 + cos(pi() * least(1.0, (s - 100) / 900.0))) end as multiplier from range(0, 1200) t(s)")
def learning_rate(spark, sf_dir):
    return spark.range(1200).select(F.col("id").alias("step"), ta.cosine_multiplier(F.col("id"), 1000, 100).alias("multiplier"))
