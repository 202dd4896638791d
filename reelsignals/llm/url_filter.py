"""Operator 4: URL filter with rules, and a list behind a blocked Bloom filter.

Every url is brought to a canonical form. A fixed-size Bloom filter of the listed urls is
broadcast; urls it rules out are allowed at once. The possible hits alone are joined with
the list by an exact hash join, which removes the filter's false positives. Rules (host,
path, verdict) come before the list; the longest rule that fits wins. They are few and
become one expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; '' without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, AFTER_SCHEME, 1), UPPER, LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., path without closing slashes, and the query without
    utm_ and ref parameters; no scheme, no fragment. '' without a host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[a-z]*|ref)=[^&]*", ""), "^&", "")
    rest = F.concat(F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.coalesce(F.when(host != "", F.concat(host, rest)), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int = 1 << 14) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url, listed for every row of ``pages``.

    ``listed`` has a column canonical_url; null and '' list nothing, repeats count once. A
    null url, or one without ://, has empty host and path and is allowed. Repeated rows
    each get a verdict; other columns are ignored. An empty list blocks nothing.
    """
    listed = listed.select("canonical_url").where("canonical_url <> ''")
    filt = pages.sparkSession.sparkContext.broadcast(bloom.build(listed.select(F.xxhash64("canonical_url").alias("key")), "key", blocks))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical_url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("rule_verdict", verdict).withColumn("key", F.xxhash64("canonical_url"))

    def flag(batches):
        for b in batches:
            maybe = filt.value.may_hold(b.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe)], [*b.schema.names, "maybe"])

    rows = rows.mapInArrow(flag, T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())]))
    ruled_out = rows.where("not maybe").withColumn("listed", F.lit(False))
    exact = listed.distinct().withColumn("listed", F.lit(True))
    hits = rows.where("maybe").join(exact, "canonical_url", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = ruled_out.unionByName(hits)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "canonical_url", "listed")
