"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source walks its documents in a shuffled order, at most `epochs` times over. A document's virtual finish time is its
source's cumulative size up to and with it, divided by the source's target. All documents of all sources are put in the
order of their finish times, and the mix is what comes first until the total budget is spent; so each source gets its share at
every point of the mix, and its target at the end.

A source's running sums don't need its rows in one task: they are dealt into buckets of their shuffled order, sums per bucket
are accumulated, and a window runs within each bucket. The queue of all sources is then range-sorted by finish time and cut off
at the budget: ranges whose sums end before it are in the mix, and a window runs within the one range where it ends. So a source that
holds most rows is spread over many tasks, and ranges number as many as the shuffle's partitions.

Defined results: the size of a null text is 0, and a row of size 0 is taken 0 words. Sources are ranked by code point, null last.
Rows that repeat a doc_id, or have none, are documents of their own, each taken at most `epochs` times; they are told apart by their place in
the input's files, which settles their order among themselves alone. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import remove_written, row_key, scratch, stable, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """sources (source, total) with `target`: share of all sizes by weight, none above cap times its own, the excess reshared.

    A source is full if raising all by the ratio that fills it spends the budget at most; the rest share what is left by weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("total") * cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    up_to = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("budget", F.sum("total").over(every) * F.lit(share)).withColumn("w_all", F.sum("weight").over(every))
    s = s.withColumn("filled", F.sum("cap").over(up_to) + F.col("ratio") * (F.col("w_all") - F.sum("weight").over(up_to)))
    s = s.withColumn("full", F.col("filled") <= F.col("budget"))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("budget") - spent) * F.col("weight") / open_w)
    return s.select("source", "total", "weight", target.alias("target"), F.col("budget").alias("budget"))


def _shuffle_key(epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def _running(rows: DataFrame, value: str, parts: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """rows with `out`, the sum of value over the rows of the same parts up to and with each, in the order (bucket, order)."""
    per = rows.groupBy(*parts, bucket).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(c).alias(f"_{c}") for c in parts], F.col(bucket).alias("_bucket"), before.alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts] + [F.col(bucket) == F.col("_bucket")]
    inside = F.sum(value).over(Window.partitionBy(*parts, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.withColumn("_inside", inside).join(per, on).withColumn(out, F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_bucket", *[f"_{c}" for c in parts])


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix", rows_per_bucket: int = 4096) -> DataFrame:
    """file, row, doc_id, source, size, source_size, target and taken for each row of stable(docs)."""
    key = row_key()
    sized = written(docs.select(key["f"].alias("file"), key["n"].alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n")).drop("n"), weights, share, epochs)
    targets = written(targets, "targets")
    n, budget = sized.count(), targets.select(F.max("budget")).first()[0] or 0.0
    n_buckets = max(8, epochs * n // rows_per_bucket)
    t = targets.select(F.col("source").alias("_source"), F.col("total").alias("source_size"), "target")
    aimed = sized.join(F.broadcast(t) if targets.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # one row per document and epoch, in a shuffled order of its own in each epoch; rows without words or target aren't queued
    queued = aimed.where("size > 0 AND target > 0").select("file", "row", "doc_id", "source", "size", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    queued = queued.withColumn("draw", _shuffle_key(F.col("epoch"), seed))
    first = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    queued = queued.withColumn("bucket", F.col("epoch") * n_buckets + F.floor(first * F.lit(n_buckets) / F.lit(1 << 32)))
    # one sum per source and bucket, not one task per source
    finish = _running(queued, "size", ["source"], "bucket", ["draw", "doc_id", "file", "row"], "served").withColumn("finish", F.col("served") / F.col("target"))
    finish = written(finish.select("file", "row", "doc_id", "source", "size", "epoch", "draw", "finish"), "queue")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("epoch"), F.col("draw"), F.col("doc_id"), F.col("file"), F.col("row")]
    ranged = written(finish.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    remove_written(finish)
    before, edge = 0, None  # the range where the budget ends; all before it are in the mix, all after it out
    for r in sorted(ranged.groupBy("part").agg(F.sum("size").alias("words")).collect(), key=lambda r: r["part"]):  # a row per range
        if before < budget:
            edge = (r["part"], before)
        before += r["words"]
    if edge is None:
        return aimed.withColumn("taken", F.lit(0).cast("long"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = ranged.where(F.col("part") == edge[0]).withColumn("ahead", ahead + edge[1]).where(F.col("ahead") < budget)
    picked = ranged.where(F.col("part") < edge[0]).select("file", "row").union(last.select("file", "row"))
    taken = picked.groupBy("file", "row").agg(F.count("*").alias("times"))
    return aimed.join(taken, ["file", "row"], "left").withColumn("taken", F.col("size") * F.coalesce("times", F.lit(0))).drop("times")


@scratch
def mixed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of docs (doc_id, text, source)."""
    return _mixed(stable(docs), **how).select("doc_id", "source", "size", "source_size", "target", "taken")


@scratch
def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """docs, each row as often as the mix takes it; rows that it leaves out are gone, and so are rows without words."""
    docs = stable(docs)
    got = _mixed(docs, **how).where("taken > 0").select(F.struct(F.col("file").alias("f"), F.col("row").alias("n")).alias("_mix_row"), (F.col("taken") / F.col("size")).cast("int").alias("_mix_times"))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns], row_key().alias("_mix_row")).join(got, "_mix_row")
    return kept.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_digest(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB: running sums over all rows at once.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
ranked AS (
  SELECT source, total, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * total AS cap,
         (2 * total)::DOUBLE / [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS ratio,
         (SELECT sum(total) FROM totals) * 1.5::DOUBLE AS budget FROM totals),
filled AS (
  SELECT *, sum(cap) OVER w + ratio * ((SELECT sum(weight) FROM ranked) - sum(weight) OVER w) <= budget AS is_full
  FROM ranked WINDOW w AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, total, budget,
         CASE WHEN is_full THEN cap::DOUBLE ELSE (budget - (SELECT coalesce(sum(cap) FILTER (is_full), 0) FROM filled)) * weight::DOUBLE
              / (SELECT sum(weight) FILTER (NOT is_full) FROM filled) END AS target FROM filled),
queued AS (
  SELECT d.doc_id, d.source, d.size, t.target, e.epoch, md5('mix:' || e.epoch || ':' || coalesce(d.doc_id::VARCHAR, 'null')) AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(epoch) WHERE d.size > 0 AND t.target > 0),
served AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY epoch, draw, doc_id ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish FROM queued),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, draw, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead FROM served),
taken AS (SELECT doc_id, count(*) AS times FROM placed WHERE ahead < (SELECT max(budget) FROM targets) GROUP BY doc_id)
SELECT d.doc_id, d.size, t.total AS source_size, t.target, (d.size * coalesce(k.times, 0))::BIGINT AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON d.doc_id = k.doc_id
"""
