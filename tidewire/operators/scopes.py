"""Matching addresses against tables of scoped rules with equi-joins only.

A rule becomes a text key (``ip:<hex>``, ``net:<network key>``, ``type:<name>``)
and a row becomes the few keys it can match: one per scope, plus one per network
prefix length that the rule table really uses.  However many rules there are,
the match is a hash or sort-merge join on that key; the planner broadcasts the
rules only when their size allows.  A global rule meets every row, so it stands
under ``g0`` .. ``g63`` and a row looks under one of these, by hash: the rows
spread even where nothing splits skewed keys, as in stream sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import ip


SALTS = 64


def global_keys() -> Column:
    """All keys of a global rule."""
    return F.array(*[F.lit(f"g{i}") for i in range(SALTS)])


def global_key(*columns: str) -> Column:
    """The one key under which a row meets global rules."""
    return F.concat(F.lit("g"), F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("string"))


def network_lengths(rules: DataFrame, target: str = "target") -> Column:
    """Distinct prefix lengths of the subnet rules: at most 129 values, read as a subquery."""
    bits = rules.filter(F.col("scope") == "subnet").select(ip.cidr_bits(F.col(target)).alias("b"))
    return bits.filter("b is not null").agg(F.collect_set("b")).scalar()


def network_keys(address_hex: Column, lengths: Column) -> Column:
    keys = F.transform(
        F.coalesce(lengths, F.array().cast("array<int>")),
        lambda b: F.concat(F.lit("net:"), ip.network_key(address_hex, b)),
    )
    return F.when(address_hex.isNotNull(), keys).otherwise(F.array().cast("array<string>"))


def network_rule_key(target: Column) -> Column:
    return F.concat(F.lit("net:"), ip.cidr_key(target))
