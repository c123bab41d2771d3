"""Merging arrivals into a store table by buckets of the key: only buckets with a change are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.upsert import admit_newer, latest_per_key
from tidemark.sources.store import Change, Store

BUCKETS = 256


def merge_into(store: Store, name: str, batch: DataFrame, keys: list[str], received: str, buckets: int = BUCKETS) -> int:
    """Per key the latest arrival, where a held row gives way to a strictly later one only; returns rows written."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
    order = [F.col(received).desc_nulls_last()]
    if not store.exists(name):
        return store.commit({name: Change(latest_per_key(batch, keys, order), bucket, whole=True)})[name]
    newer = latest_per_key(admit_newer(batch, store.read(name), keys, received), keys, order)
    with store.staged(newer=newer) as (newer,):
        touched = frozenset(r[0] for r in newer.select(bucket).distinct().collect())  # as many as buckets
        if not touched:
            return 0
        kept = store.read(name, set(touched)).join(newer.select(*keys), keys, "left_anti")
        return store.commit({name: Change(kept.select(*newer.columns).unionByName(newer), bucket, touched)})[name]
