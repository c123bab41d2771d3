"""Column expressions that differ from Spark's built-ins in a way results depend on."""

from tidemark.functions.exprs import days_between, hash_pick, md5_mod, round2, to_date_utc

__all__ = ["days_between", "hash_pick", "md5_mod", "round2", "to_date_utc"]
