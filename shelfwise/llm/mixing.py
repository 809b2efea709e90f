"""Operator 9, mixing sources to target weights, with DataFrame functions only.

A source's weight is its token share to the power ``exponent``, normalised.  The exponent (0 flat,
1 natural) is bisected until the mix reaches a target entropy or keeps a repetition limit.  The
weights become token quotas; a quota is realised as whole epochs plus the leading part of one
seeded block permutation of the source, cut at the document that fills the quota.

Without ``budget`` the total is such that the least repeated source is read exactly once, so no
document is lost.  With a budget, a quota may be less than a source: that is the sampling.

Null or empty texts have no tokens; a source without tokens keeps one epoch and takes no part in
the weights.  A null source is a source of its own.  Rows that share an id share their place in the
permutation, so they are taken or left together.  An empty table gives an empty result.  Columns
of the input pass through ``mixed``, whatever their names; ``apply_mix`` adds names that begin with
``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD_RX, aside, text_or_empty, written

MAX_REPETITION = 2.0
BLOCK_ROWS = 4096          # documents a block holds on average
BLOCKS_A_GROUP = 1024      # blocks summed before the running sum of a source
HALVINGS_A_JOB = 5         # 2 ** 5 - 1 exponents are tried at once
JOBS = 7


def n_tokens(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD_RX)).cast("long")


def _at(exponent: Column, shares: DataFrame) -> DataFrame:
    """Entropy (nats) and largest repetition over the least, for every exponent in a column."""
    tried = shares.where("share > 0").withColumn("exponent", F.explode(exponent))
    power = F.exp(F.col("exponent") * F.log("share"))
    gain = power / F.col("share")
    sums = tried.groupBy("exponent").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("exponent") * F.log("share")).alias("slope"),
        (F.max(gain) / F.min(gain)).alias("repetition"), F.max(gain).alias("gain"))
    return sums.withColumn("entropy", F.log("z") - F.col("slope") / F.col("z"))


def find_exponent(shares: DataFrame, total_tokens: int, target_entropy: float | None = None,
                  max_repetition: float | None = MAX_REPETITION, budget: int | None = None) -> float:
    """Smallest exponent in [0, 1] that keeps the repetition limit, or the largest whose entropy
    reaches the target.  Both measures are monotone; each job does ``HALVINGS_A_JOB`` halvings."""
    if target_entropy is None and max_repetition is None:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(JOBS):
        cells = 1 << HALVINGS_A_JOB
        grid = [low + (high - low) * k / cells for k in range(cells + 1)]
        seen = {r["exponent"]: r for r in _at(F.array(*map(F.lit, grid)), shares).collect()}   # 33 rows
        if not seen:
            return 1.0

        def flat_enough(r) -> bool:
            """True on the side of small exponents."""
            if target_entropy is not None:
                return r["entropy"] >= target_entropy
            most = r["repetition"] if budget is None else r["gain"] / r["z"] * budget / total_tokens
            return most > max_repetition

        side = [flat_enough(seen[x]) for x in grid]
        if all(side):
            return high
        if not any(side):
            return low
        k = side.index(False)
        low, high = grid[k - 1], grid[k]
    return low if target_entropy is not None else high


def _block(seed: int, source: Column, key: Column) -> Column:
    """A document's block: the seeded hash deals documents out, so block order is a permutation."""
    return F.pmod(F.xxhash64(F.lit(seed), source, key), F.col("_mix_blocks"))


def _place(seed: int, source: Column, key: Column) -> Column:
    """A document's place inside its block."""
    return F.xxhash64(F.lit(seed + 1), source, key)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             target_entropy: float | None = None, max_repetition: float | None = MAX_REPETITION,
             budget: int | None = None, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(sources, sizes): a row per source with its weight, quota, whole epochs and cut, and the
    documents as (id, source, n_tokens).  Both are written below the shared folder."""
    sizes = written(docs.select(F.col(id_col).alias("key"), F.col(source_col).cast("string").alias("source"),
                                n_tokens(text_col).alias("n_tokens")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    every = totals.agg(F.sum("tokens").alias("all_tokens"))
    shares = written(totals.crossJoin(F.broadcast(every))      # one row
                     .withColumn("share", F.col("tokens") / F.greatest("all_tokens", F.lit(1))), "mix-shares")
    total = every.first()["all_tokens"] or 0
    exponent = find_exponent(shares, total, target_entropy, max_repetition, budget)
    power = F.when(F.col("share") > 0, F.exp(F.lit(exponent) * F.log("share")))
    gains = shares.agg(F.sum(power).alias("z"), F.min(power / F.col("share")).alias("least"))
    repeats = power / F.col("share") / F.col("least")
    if budget is not None:
        repeats = power / F.col("z") * F.lit(float(budget)) / F.col("tokens")
    quota = F.when(F.col("share") > 0, F.round(repeats * F.col("tokens")).cast("long")).otherwise(F.lit(0).cast("long"))
    weighted = (shares.crossJoin(F.broadcast(gains))           # one row
                .withColumn("weight", F.coalesce(power / F.col("z"), F.lit(0.0)))
                .withColumn("quota", quota)
                .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1))
                .withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(0))
                .withColumn("_mix_blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("long")))

    # Tokens of every block, summed before any running sum; then the block where each quota ends.
    same = F.col("s.source").eqNullSafe(F.col("w.source"))
    placed = (sizes.alias("s").join(weighted.select("source", "_mix_blocks", "rest").alias("w"), same)
              .select("s.source", "s.key", "s.n_tokens", "rest",
                      _block(seed, F.col("s.source"), F.col("s.key")).alias("block")))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("band", F.floor(F.col("block") / BLOCKS_A_GROUP))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bands = (blocks.groupBy("source", "band").agg(F.sum("tokens").alias("band_tokens"))
             .withColumn("band_start", F.coalesce(F.sum("band_tokens").over(
                 before.partitionBy("source").orderBy("band")), F.lit(0))))
    inside = blocks.withColumn("start", F.coalesce(F.sum("tokens").over(
        before.partitionBy("source", "band").orderBy("block")), F.lit(0)))
    start = F.col("i.start") + F.col("b.band_start")
    cut_blocks = (inside.alias("i")
                  .join(bands.alias("b"), F.col("i.source").eqNullSafe(F.col("b.source")) & (F.col("i.band") == F.col("b.band")))
                  .where((start < F.col("rest")) & (start + F.col("tokens") >= F.col("rest")))
                  .select("i.source", F.col("i.block").alias("cut_block"), (F.col("rest") - start).alias("left")))
    # One block of each source: the last place whose predecessors do not fill the quota.
    member = (placed.alias("p").join(cut_blocks.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))
                                     & (F.col("p.block") == F.col("c.cut_block")))
              .select("p.source", "cut_block", "left", "n_tokens",
                      _place(seed, F.col("p.source"), F.col("p.key")).alias("place")))
    ties = member.groupBy("source", "cut_block", "left", "place").agg(F.sum("n_tokens").alias("n_tokens"))
    used = F.coalesce(F.sum("n_tokens").over(before.partitionBy("source", "cut_block").orderBy("place")), F.lit(0))
    cuts = (ties.withColumn("used", used).where(F.col("used") < F.col("left"))
            .groupBy("source", "cut_block").agg(F.max("place").alias("cut_place")))
    sources = (weighted.alias("w").join(cuts.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left")
               .select("w.source", "tokens", "rows", "share", "weight", "quota", "epochs", "_mix_blocks",
                       "cut_block", "cut_place", F.lit(exponent).alias("exponent")))
    return written(sources, "mix-sources"), sizes


def apply_mix(docs: DataFrame, sources: DataFrame, id_col: str, source_col: str, seed: int = 9) -> DataFrame:
    """``docs`` with a row per copy and the columns ``_mix_epoch``, ``_mix_block``, ``_mix_place``."""
    s = sources.select(*[F.col(c).alias("_mix_" + c.removeprefix("_mix_")) for c in
                         ("source", "epochs", "_mix_blocks", "cut_block", "cut_place")])
    out = docs.join(s, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    out = (out.withColumn("_mix_block", _block(seed, F.col("_mix_source"), F.col(id_col)))
           .withColumn("_mix_place", _place(seed, F.col("_mix_source"), F.col(id_col))))
    extra = (F.col("_mix_block") < F.col("_mix_cut_block")) | (
        (F.col("_mix_block") == F.col("_mix_cut_block")) & (F.col("_mix_place") <= F.col("_mix_cut_place")))
    copies = F.col("_mix_epochs") + F.when(extra, 1).otherwise(0)
    return (out.where(copies > 0).withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
            .drop("_mix_source", "_mix_epochs", "_mix_blocks", "_mix_cut_block", "_mix_cut_place"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               **how) -> DataFrame:
    """A row per copy: id, source, epoch, block and place in the permutation, tokens."""
    seed = how.get("seed", 9)
    sources, sizes = plan_mix(docs, id_col, source_col, text_col, **how)
    out = apply_mix(sizes, sources, "key", "source", seed)
    return out.select(F.col("key").alias(id_col), "source", F.col("_mix_epoch").alias("epoch"),
                      F.col("_mix_block").alias("block"), F.col("_mix_place").alias("place"), "n_tokens")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          **how) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as the weights ask; texts are not shuffled."""
    sources, _ = plan_mix(docs, id_col, source_col, text_col, **how)
    docs, back = aside(docs, "_mix_")
    out = apply_mix(docs, sources, id_col, source_col, how.get("seed", 9)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumnsRenamed(back)
