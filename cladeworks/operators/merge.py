"""Merging the classifications of one set of reads by two indexes over a common taxonomy.

Hit lists are run-length lists over the same tokens. Their runs are laid over each other by prefix sums: the
cut points of both lists cut the tokens into pieces, each piece takes the lowest common ancestor of its two
codes (0 is the identity), and the read is voted on again.

Policies: ``resolve-lca`` votes on the merged hits; ``lca`` takes the lowest common ancestor of both calls;
``first`` keeps the first call unless it is unclassified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.classify import hit_lists, resolve
from cladeworks.operators.taxonomy import pair_lca

POLICIES = ("resolve-lca", "lca", "first")


def parse_hits(df: DataFrame, side: str) -> DataFrame:
    """``read_id, i, start, n, code_<side>, border`` of the items of a hit list; borders have n 0."""
    items = df.select("read_id", F.posexplode(F.split(F.trim("hits"), r"\s+")).alias("i", "x"))
    code, n = F.split_part("x", F.lit(":"), F.lit(1)), F.split_part("x", F.lit(":"), F.lit(2))
    border = F.when(F.col("x").isin("|:|", "-:-"), F.substring("x", 1, 1))
    items = items.select("read_id", "i", code.alias(f"code_{side}"), F.when(border.isNull(), F.coalesce(n.try_cast("bigint"), F.lit(0))).otherwise(0).alias("n"), border.alias("border"))
    before = F.sum("n").over(Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return items.withColumn("start", F.coalesce(before, F.lit(0)))


def merge(a: DataFrame, b: DataFrame, taxonomy: DataFrame, confidence: float = 0.0, policy: str = "resolve-lca") -> DataFrame:
    """Both are outputs of ``classify`` on the same reads: ``read_id, status, taxon, revote, n_tokens, hits``.

    ``status`` is C if either input is; ``revote`` is the new vote and may be null even then.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    x = a.select("read_id", "hits", F.col("status").alias("sa"), F.col("taxon").alias("ta"), "length")
    y = b.select("read_id", "hits", F.col("status").alias("sb"), F.col("taxon").alias("tb"))
    both = x.drop("hits").join(y.drop("hits"), "read_id")
    p, q = parse_hits(x, "a"), parse_hits(y, "b")
    # the starts of both lists' runs, in order; between starts the last code of each list holds
    none = F.lit(None).cast("string")
    marks = p.where("n > 0").select("read_id", "start", "code_a", none.alias("code_b"), "n").unionByName(q.where("n > 0").select("read_id", "start", none.alias("code_a"), "code_b", "n"))
    marks = marks.groupBy("read_id", "start").agg(F.max("code_a").alias("code_a"), F.max("code_b").alias("code_b"), F.max(F.col("start") + F.col("n")).alias("reach"))
    w = Window.partitionBy("read_id").orderBy("start")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    end = F.coalesce(F.lead("start").over(w), F.max("reach").over(Window.partitionBy("read_id")))
    runs = marks.select("read_id", "start", F.last("code_a", True).over(upto).alias("code_a"), F.last("code_b", True).over(upto).alias("code_b"), end.alias("end"))
    runs = runs.withColumn("n", F.col("end") - F.col("start"))
    tax = F.col("code_a").try_cast("bigint")
    runs = runs.withColumn("xa", F.nullif(tax, F.lit(0))).withColumn("xb", F.nullif(F.col("code_b").try_cast("bigint"), F.lit(0)))
    runs = pair_lca(runs, taxonomy, "xa", "xb")
    # an ambiguous run stays one; it is never looked up
    code = F.when(F.col("code_a").isNotNull() & tax.isNull(), F.col("code_a")).otherwise(F.coalesce(F.col("lca").cast("string"), F.lit("0")))
    runs = runs.select("read_id", "start", F.lit(1).alias("i"), F.lit(None).cast("string").alias("border"), code.alias("code"), "n")
    borders = p.where("border IS NOT NULL").select("read_id", "start", F.lit(0).alias("i"), "border", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("n"))
    listed = runs.unionByName(borders)
    texts = hit_lists(listed.select("read_id", F.struct("start", "i").alias("order"), "border", "code", "n")).withColumnRenamed("hits", "text")
    total = runs.groupBy("read_id").agg(F.sum("n").alias("n_tokens"))
    counts = runs.withColumn("taxon", F.col("code").try_cast("bigint")).where("taxon > 0").groupBy("read_id", "taxon").agg(F.sum("n").alias("n"))
    hits = counts.join(taxonomy.select(F.col("tax_id").alias("taxon"), F.col("path").cast("array<bigint>").alias("path")), "taxon").groupBy("read_id").agg(F.collect_list(F.struct("taxon", "n", "path")).alias("hits"))
    d = both.select("read_id", "sa", "sb", "ta", "tb", "length").join(total, "read_id", "left").join(hits, "read_id", "left").join(texts, "read_id", "left")
    d = d.withColumn("hits", F.coalesce("hits", F.array().cast(d.schema["hits"].dataType))).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    d = resolve(d, "hits", "n_tokens", confidence)
    if policy == "lca":
        d = pair_lca(d.drop("call"), taxonomy, "ta", "tb", "call")
    elif policy == "first":
        d = d.withColumn("call", F.coalesce("ta", "tb"))
    status = F.when((F.col("sa") == "C") | (F.col("sb") == "C"), "C").otherwise("U")
    taxon = F.when(status == "C", F.col("call"))
    return d.select("read_id", status.alias("status"), taxon.alias("taxon"), F.col("call").alias("revote"), "length", "n_tokens", F.coalesce("text", F.lit("0:0")).alias("hits"))


def merge_all(parts: list[DataFrame], taxonomy: DataFrame, confidence: float = 0.0, policy: str = "resolve-lca") -> DataFrame:
    """Merge any number of classifications pairwise."""
    out = parts[0]
    for p in parts[1:]:
        out = merge(out, p, taxonomy, confidence, policy)
    return out
