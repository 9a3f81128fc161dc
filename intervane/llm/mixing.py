"""Sources mixed to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, available, wanted_share, budget, shortfall: the tokens each source gives to each mix.

    Sources that have no tokens cannot contribute; the shares of the others are
    scaled up in proportion (``wanted_share``), which keeps them to each other
    as wanted. Without a ``total`` a mix is as large as the scarcest source allows:
    every source then gives its share and repeats no text more often than its limit.
    With one, a source gives its share of it or, where that takes more repeats than
    allowed, all it may; ``shortfall`` is what is then missing.
    """
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.max("n_tokens").alias("longest"))
    wanted = (
        targets.select("mix_name", "source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
        .filter("mix_name IS NOT NULL AND source IS NOT NULL AND target_share >= 0")
        .distinct()
        .join(totals, "source", "left")
    )
    mix = Window.partitionBy("mix_name")
    usable = (F.coalesce("available", F.lit(0)) > 0) & (F.col("target_share") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    share = F.when(usable, F.col("target_share")).otherwise(0.0)
    limit = F.coalesce("max_repeats", F.lit(1)) * F.col("available")
    least = F.min(F.try_divide(limit, F.col("wanted_share"))).over(mix)
    planned = wanted.withColumn("wanted_share", F.try_divide(share, F.sum(share).over(mix))).withColumn("total", least if total is None else F.lit(float(total)))
    budget = F.least(F.col("wanted_share") * F.col("total"), limit)
    return planned.select(
        "mix_name", "source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "available", "wanted_share", budget.alias("budget"),
        F.greatest(F.col("wanted_share") * F.col("total") - F.coalesce(budget, F.lit(0.0)), F.lit(0.0)).alias("shortfall"),
    )


def prefix_sums(sizes: DataFrame, seed: int = 0, bucket_bits: int = 12) -> DataFrame:
    """``sizes`` with ``before``: the tokens of its source that come earlier in hash-random order.

    The order is that of a hash (MD5, which other engines have too) of the document and
    the seed, ties by id. Its leading bits (32 at most) range-partition each source into buckets
    of about equal numbers of texts, so a source with a third of all rows is spread
    over as many tasks as it has buckets; sums within buckets are shifted by the sums of
    the buckets before, computed on one row per bucket.
    """
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))))
    keyed = sizes.select("doc_id", "source", "n_tokens", hashed.alias("key")).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), 32 - bucket_bits))
    bucket = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("source", "bucket", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = keyed.withColumn("upto", F.sum("n_tokens").over(inside)).join(bucket, ["source", "bucket"])
    return running.select("doc_id", "source", "n_tokens", (F.col("shift") + F.col("upto") - F.col("n_tokens")).alias("before"))


def mixed(sizes: DataFrame, targets: DataFrame, seed: int = 0, bucket_bits: int = 12, total: int | None = None) -> DataFrame:
    """mix_name, source, doc_id, copies, n_tokens: what each mix takes.

    ``sizes``: doc_id, source, n_tokens, read several times. ``targets``:
    mix_name, source, target_share, max_repeats (how often a text may occur in
    the mix in all). Each source is put in hash-random order and repeated epoch
    by epoch until its budget (see :func:`budgets`, also for ``total``) is spent: every text occurs
    once per full epoch, and once more if its middle token lies within what is left
    for the last epoch. The cut is then within half a text of the exact budget.

    Defined cases: texts of a null source, or of a source in no mix, are in no
    mix; texts without tokens are in none; a null max_repeats means 1; repeated
    rows are texts of their own; a mix of which no source has tokens is empty;
    extra columns are ignored.
    """
    sizes = sizes.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")).filter("source IS NOT NULL AND n_tokens > 0")
    plan = budgets(sizes, targets, total).filter("budget > 0")
    epochs = F.floor(F.col("budget") / F.col("available"))
    plan = plan.select("mix_name", "source", "max_repeats", epochs.alias("epochs"), (F.col("budget") - epochs * F.col("available")).alias("rest"))
    last = (2 * F.col("before") + F.col("n_tokens") <= 2 * F.col("rest")).cast("bigint")
    return (
        prefix_sums(sizes, seed, bucket_bits)
        .join(plan, "source")
        .withColumn("copies", F.least(F.col("epochs") + last, F.col("max_repeats")))
        .filter("copies > 0")
        .select("mix_name", "source", "doc_id", "copies", "n_tokens")
    )


def mix_shares(mix: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per mix and listed source: target, the share reached, tokens, texts, the most copies of one text, and the tokens that limits on repeats left missing."""
    taken = mix.groupBy("mix_name", "source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies")
    )
    listed = budgets(sizes.filter("source IS NOT NULL AND n_tokens > 0"), targets, total).select("mix_name", "source", "target_share", "max_repeats", "shortfall")
    tokens = F.coalesce("tokens", F.lit(0))
    return listed.join(taken, ["mix_name", "source"], "left").select(
        "mix_name",
        "source",
        "target_share",
        "max_repeats",
        tokens.alias("tokens"),
        F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy("mix_name"))).alias("share"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.ceil("shortfall"), F.lit(0)).alias("shortfall"),
    )


def mix_faults(mix: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per mix: listed sources (n_sources), those more than half a text of their longest off their budget (n_off_share), and those with a text repeated too often (n_repeated_too_often)."""
    longest = sizes.filter("source IS NOT NULL").groupBy("source").agg(F.max("n_tokens").alias("longest"))
    plan = budgets(sizes.filter("source IS NOT NULL AND n_tokens > 0"), targets, total).select("mix_name", "source", "budget")
    rows = mix_shares(mix, sizes, targets, total).join(plan, ["mix_name", "source"]).join(longest, "source", "left")
    off = F.abs(F.col("tokens") - F.coalesce("budget", F.lit(0.0))) > F.coalesce("longest", F.lit(0)) / 2
    return rows.groupBy("mix_name").agg(
        F.count("*").alias("n_sources"),
        F.sum(off.cast("bigint")).alias("n_off_share"),
        F.sum((F.col("most_copies") > F.col("max_repeats")).cast("bigint")).alias("n_repeated_too_often"),
    )
