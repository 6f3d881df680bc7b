"""Identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "b3e7a9f16c2d4a8b9f013d5e7a2b8c4f"


def random_uid() -> Column:
    """The first 16 hex digits of a random UUID."""
    return F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 16)


def uid_source(*values: Column) -> Column:
    """The values joined by "|"; whole floats print as integers."""
    return F.concat_ws("|", *[v.cast("string") for v in values])


def whole_number(value: Column) -> Column:
    """A float as text, without ".0" where it is whole."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def stable_uid(*values: Column) -> Column:
    """The first 16 hex digits of the version-5 UUID of the joined values; null if any value is null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(uid_source(*values), "utf-8")))
    uid = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3))
    some = F.lit(True)
    for v in values:
        some = some & v.isNotNull()
    return F.when(some, uid)


def layout_uid(features: Column) -> Column:
    """The content hash of an ordered array of feature uids."""
    return F.substring(F.sha2(F.concat_ws("", F.transform(features, lambda x: F.concat(x, F.lit("\0")))), 256), 1, 16)
