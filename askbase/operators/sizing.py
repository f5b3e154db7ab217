"""Broadcast only behind a measured bound.

``sized_broadcast`` sums the bytes of a lookup table's values (one aggregate
over the table, which is bounded by the knowledge base or the calendar) and adds
the broadcast hint only within the budget; beyond it the join is a shuffle
join.  Without the hint AQE would find out too late: the big side is
shuffled while the small one is measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

BROADCAST_CONF = "askbase.lookup.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def table_bytes(df: DataFrame) -> int:
    """About what the rows take in a hash table: text bytes and 24 a value."""
    row = F.lit(24)
    for f in df.schema.fields:
        row = row + F.lit(24)
        if isinstance(f.dataType, T.StringType):
            row = row + F.coalesce(F.octet_length(f.name), F.lit(0))
    return df.select(F.sum(row.cast("bigint")).alias("b")).first()["b"] or 0


def sized_broadcast(df: DataFrame) -> DataFrame:
    budget = int(df.sparkSession.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST_BYTES)))
    return F.broadcast(df) if table_bytes(df) <= budget else df
