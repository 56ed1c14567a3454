"""IDS alert lines (EVE JSON) to alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.functions.barrier import once
from tidewire.functions.ip import in_cidr


def eve_timestamp(text: Column) -> Column:
    """EVE writes offsets without a colon."""
    return F.regexp_replace(text, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp")


def ids_alerts(lines: DataFrame, local_cidrs: Sequence[str], text: str = "value") -> DataFrame:
    """Alert records that touch a local network.

    Malformed lines and other record kinds are dropped.  The alert belongs to
    the destination when that is local, else to the source.
    """
    parsed = F.from_json(F.col(text), schemas.EVE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    alerts = (
        once(lines, e=parsed)
        .filter("e is not null and e._bad is null and e.event_type = 'alert' and e.alert is not null")
        .select("e.*")
    )
    # no test for special addresses here: membership alone decides
    local = F.coalesce(
        F.when(in_cidr("dest_ip", local_cidrs), F.col("dest_ip")),
        F.when(in_cidr("src_ip", local_cidrs), F.col("src_ip")),
    )
    level = F.col("alert.severity")
    created = eve_timestamp(F.col("timestamp"))
    return (
        once(alerts, ip=local)
        .filter("ip is not null")
        .select(
            "ip",
            F.lit("").alias("destination_ip"),
            F.lit("SURICATA_ALERT").alias("type"),
            # fixed text format
            F.format_string(
                "IDS Alert: %s (Category: %s, Signature ID: %d)",
                F.coalesce("alert.signature", F.lit("")),
                F.coalesce("alert.category", F.lit("")),
                F.coalesce("alert.signature_id", F.lit(0)),
            ).alias("description"),
            F.when(level == 1, "high").when(level == 3, "low").otherwise("medium").alias("severity"),
            F.lit("active").alias("status"),
            created.alias("created_at"),
            F.coalesce("alert.signature_id", F.lit(0)).alias("signature_id"),
        )
    )
