"""References to records that do not exist (at the time of the reference).

Skew-aware split: references are pre-aggregated per field, key and period (count, first and last time).
Keys with more than 1/``HEAVY_SHARE`` of a field's references are heavy; there are fewer than
``HEAVY_SHARE`` of them per field, so their targets' lifetimes (at most ``MAX_LIVES`` each) are broadcast.
The other keys go through a shuffle join. A group that one lifetime covers has no orphan, a group that no
lifetime touches is all orphans, and only the rest is looked at reference by reference, where the verdicts
of heavy keys are broadcast again (at most a row per key and period), so no key is a hot spot of that join.

Defined cases: a null key or a null time is no reference; a target with a null key or null start is no
target; a null end means "still there"; repeated targets and references count as they stand; empty tables
give no rows; the input tables' other columns are never read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.session import Scratch

HEAVY_SHARE = 1000
MAX_LIVES = 64
#: Sub-groups in which the lifetimes of one target key are first united.
SALTS = 32


def _unite(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the lifetimes [born, died) per key as disjoint islands; died null is no end."""
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    w = Window.partitionBy(*keys).orderBy("born", "end")
    t = targets.withColumn("end", F.coalesce("died", far)).where(F.col("end") > F.col("born"))
    t = t.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("island", F.sum(F.when(F.col("before") >= F.col("born"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.groupBy(*keys, "island").agg(F.min("born").alias("born"), F.max("end").alias("end"))
    return t.select(*keys, "born", F.when(F.col("end") < far, F.col("end")).alias("died"))


def lifetimes(targets: DataFrame) -> DataFrame:
    """(field, key, born, died) rows to one row per key with its disjoint lifetimes, salted against hot keys."""
    once = targets.where(F.col("key").isNotNull() & F.col("born").isNotNull()).groupBy("field", "key", "born", F.pmod(F.xxhash64("born"), F.lit(SALTS)).alias("salt")).agg(F.max(F.coalesce("died", F.lit("9999-12-31 00:00:00").cast("timestamp"))).alias("died"))
    parts = _unite(once, ["field", "key", "salt"]).drop("salt")
    whole = _unite(parts, ["field", "key"])
    return whole.groupBy("field", "key").agg(F.collect_list(F.struct("born", "died")).alias("lives"))


def _verdict(groups: DataFrame) -> DataFrame:
    """state: 0 no orphan, 1 all orphans, 2 to be looked at one by one."""
    covers = F.exists("lives", lambda x: (x["born"] <= F.col("t_min")) & (x["died"].isNull() | (x["died"] > F.col("t_max"))))
    touches = F.exists("lives", lambda x: (x["born"] <= F.col("t_max")) & (x["died"].isNull() | (x["died"] > F.col("t_min"))))
    return groups.withColumn("state", F.when(F.col("lives").isNull() | ~touches, 1).when(covers, 0).otherwise(2))


def _groups(refs: DataFrame, targets: DataFrame, period: str) -> DataFrame:
    """Reference groups per (field, key, period) with the lifetimes of their key and a verdict."""
    agg = refs.groupBy("field", "key", F.trunc("t", period).alias("period")).agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    per_key = agg.groupBy("field", "key").agg(F.sum("n").alias("n_key"))
    totals = per_key.groupBy("field").agg(F.sum("n_key").alias("n_field"))
    heavy = per_key.join(F.broadcast(totals), "field").where(F.col("n_key") * HEAVY_SHARE > F.col("n_field")).select("field", "key")
    lives = lifetimes(targets)
    hot = lives.join(F.broadcast(heavy), ["field", "key"]).where(F.size("lives") <= MAX_LIVES)
    is_hot = F.broadcast(heavy.join(hot, ["field", "key"], "left").select("field", "key", F.lit(True).alias("heavy"), F.col("lives").alias("hot_lives")))
    marked = agg.join(is_hot, ["field", "key"], "left")
    # a heavy key without broadcastable lifetimes (none, or too many) takes the shuffle path: nothing is lost
    by_hand = marked.where(F.col("heavy") & F.col("hot_lives").isNotNull()).withColumn("lives", F.col("hot_lives"))
    rest = marked.where(F.col("heavy").isNull() | F.col("hot_lives").isNull()).join(lives, ["field", "key"], "left")
    few = F.coalesce(F.col("heavy"), F.lit(False)) & (F.coalesce(F.size("lives"), F.lit(0)) <= MAX_LIVES)
    cols = ["field", "key", "period", "n", "t_min", "t_max", "lives", few.alias("heavy")]
    groups = _verdict(by_hand.select(*cols).unionByName(rest.select(*cols)))
    # read several times below: written once, with lifetimes only where references need them
    groups = groups.select("field", "key", "period", "n", "state", "heavy", F.when(F.col("state") == 2, F.col("lives")).alias("lives"))
    return Scratch(refs.sparkSession).write(groups, "groups")


def _met(refs: DataFrame, groups: DataFrame, period: str) -> DataFrame:
    """References with the state and lifetimes of their group; heavy keys by broadcast, the others by a shuffle."""
    refs = refs.withColumn("period", F.trunc("t", period))
    on = ["field", "key", "period"]
    groups = groups.select(*on, "state", "lives", "heavy")
    hot = F.broadcast(groups.where("heavy").drop("heavy"))
    light = refs.join(F.broadcast(groups.where("heavy").select(*on)), on, "left_anti")
    return refs.join(hot, on).unionByName(light.join(groups.where("NOT heavy").drop("heavy"), on))


def _alive(t: str):
    return F.exists("lives", lambda x: (x["born"] <= F.col(t)) & (x["died"].isNull() | (x["died"] > F.col(t))))


def orphan_references(refs: DataFrame, targets: DataFrame, period: str = "month") -> DataFrame:
    """Rows of ``refs (field, key, t, row_id)`` with no living target at ``t``: ``field, key, t, row_id``.

    ``targets`` is (field, key, born, died): alive in [born, died).
    """
    refs = refs.where(F.col("key").isNotNull() & F.col("t").isNotNull()).select("field", "key", "t", "row_id")
    hit = _met(refs, _groups(refs, targets, period).where("state > 0"), period)
    return hit.where((F.col("state") == 1) | ~_alive("t")).select("field", "key", "t", "row_id")


def orphan_counts(refs: DataFrame, targets: DataFrame, period: str = "month") -> DataFrame:
    """``field, period, n_refs, n_orphans`` per field and period; only mixed groups are read row by row."""
    refs = refs.where(F.col("key").isNotNull() & F.col("t").isNotNull()).select("field", "key", "t", "row_id")
    groups = _groups(refs, targets, period)
    plain = groups.select("field", "period", F.col("n").alias("n_refs"), F.when(F.col("state") == 1, F.col("n")).otherwise(0).alias("n_orphans"))
    slow = _met(refs, groups.where("state = 2"), period).where(~_alive("t"))
    slow = slow.select("field", "period", F.lit(0).cast("bigint").alias("n_refs"), F.lit(1).cast("bigint").alias("n_orphans"))
    return plain.unionByName(slow).groupBy("field", "period").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_orphans").alias("n_orphans"))
