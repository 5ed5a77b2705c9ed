"""Time and sampling functions: ages, buckets, weights, digests as probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .identifiers import instant_micros

#: Upper bounds of the age buckets in days, and the weights of the two schemes.
BUCKETS = (("recent_6_months", 183), ("6_to_12_months", 365), ("1_to_2_years", 730), ("older_than_2_years", None))
UNKNOWN = "unknown_time"
WEIGHTS_RESAMPLE = {"recent_6_months": 3.0, "6_to_12_months": 2.0, "1_to_2_years": 2.0, "older_than_2_years": 1.0}
WEIGHTS_KEEP_ALL = {"recent_6_months": 4.0, "6_to_12_months": 3.0, "1_to_2_years": 1.0, "older_than_2_years": 0.5, UNKNOWN: 1.0}
#: 52 bits of a digest fill a double exactly.
_DIGITS = 13


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO instant; 0 where it is missing or invalid."""
    return F.coalesce(instant_micros(text) / 1e6, F.lit(0.0))


def iso_utc(seconds: Column) -> Column:
    """ISO 8601 text with offset of epoch seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def age_days(instant: Column, reference: Column) -> Column:
    """Days from ``instant`` to ``reference``, both epoch seconds; never negative."""
    return F.greatest(F.lit(0.0), (reference - instant) / 86400.0)


def age_bucket(days: Column) -> Column:
    """Bucket of an age with inclusive upper bounds; unknown for null."""
    out = F.when(days.isNull(), UNKNOWN)
    for name, bound in BUCKETS:
        out = out.otherwise(name) if bound is None else out.when(days <= bound, name)
    return out


def weight(bucket: Column, weights: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), bucket)


def bucket_dimension(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """(time_bucket, ord, weight): a few rows, for zero-filled reports."""
    return spark.createDataFrame([(name, i, w) for i, (name, w) in enumerate(weights.items())], "time_bucket string, ord int, weight double")


#: Fixed value: a date as a whole path component.
PATH_DATE = r"(?:^|/)(20\d{6})(?:/|$)"


def date_in_path(path: Column) -> Column:
    """The first eight-digit date component of a path; null if there is none."""
    return F.nullif(F.regexp_extract(path, PATH_DATE, 1), F.lit(""))


def hash_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from SHA-256 of "seed:key": the same in every engine and run."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, _DIGITS), 16, 10).cast("bigint") / F.lit(float(1 << 4 * _DIGITS))


def cosine_multiplier(step: Column, total: int, warmup: int) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    done = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))
