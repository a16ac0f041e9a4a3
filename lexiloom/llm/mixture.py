"""Problem 8: a mixture of sources with target shares of tokens, drawn by a multivariate-hypergeometric splitting tree.

1. Every document's size in tokens is counted once (Arrow, one pass) and kept in the shared folder without its text.
2. Documents of a source fall into `BLOCKS` blocks by the leading bits of a seeded hash of their id, and the blocks have a
   seeded order. Tokens per source and block, quotas and block orders are tables; only sums over all sources and one
   count per group of sources reach the driver, so sources may be as many as they like.
3. The total is the largest at which every usable source reaches its share within its number of repeats. A source's quota
   is made of whole passes over its blocks and of one partial pass: blocks in their order up to the quota, the last of them
   cut by sub-blocks, the last of these document by document (one window over 1 / (BLOCKS * SUB_BLOCKS) of a source).
4. The exact counts of block copies are partitioned recursively among the output shards: each node of the tree draws the
   left half's counts from the multivariate hypergeometric distribution, the right half gets the rest. The tree runs over
   `GROUPS` groups of sources; inside a group the shard's count is drawn for its sources in the same way, which is the same
   distribution. Shards then take disjoint ranges of each source's permuted block copies, and are shuffled locally.

No group is gathered in one task: sums are pre-aggregated, and placing is a join with the block table on (source, block).

Defined results
* null and empty texts (0 tokens) aren't drawn; a null source, or one not listed, contributes nothing.
* a listed source without tokens, or with no positive share or number of repeats, is reported with what it reached (0);
  the shares of the others are scaled to sum to 1 (`asked_share`). Null `max_repeats` counts as 1.
* several rows for one source in the weights: the shares add up and the smallest number of repeats holds.
* repeated crawls are documents of their own. Empty tables give an empty mixture and a report with zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.tokens import token_counts
from lexiloom.session import bounded_rows, broadcast_if_small
from lexiloom.storage import materialize

BLOCKS = 256
SUB_BLOCKS = 4096
SHARDS = 32
SEED = 20240607
GROUPS = 1000
# Listed sources up to this number filter the scan; more of them are joined.
FILTERED = 1000
# Copies from which numpy can't draw; a normal deviate of the same mean and variance stands in beyond.
LARGEST_DRAW = 10**9


def _place(id_col: str, seed: int) -> Column:
    """The document's place in its source's permutation: 44 seeded bits."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 44))


def _take(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among `n` drawn without replacement from `counts` (multivariate hypergeometric)."""
    if int(counts.sum()) < LARGEST_DRAW:
        return rng.multivariate_hypergeometric(counts, n, method="marginals") if n else np.zeros_like(counts)
    out, left = np.zeros_like(counts), int(counts.sum())
    for k, own in enumerate(counts.tolist()):
        rest = left - own
        if left < LARGEST_DRAW:
            out[k] = rng.hypergeometric(own, rest, n) if n else 0
        else:
            deviation = (n * (own / left) * (rest / left) * ((left - n) / (left - 1))) ** 0.5
            out[k] = min(max(round(n * (own / left) + deviation * rng.standard_normal()), n - rest, 0), own, n)
        left, n = rest, n - int(out[k])
    return out


def _split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The splitting tree: exact counts per kind for each shard."""
    if shards == 1:
        return [counts]
    left = shards // 2
    mine = _take(counts, int(counts.sum()) * left // shards, rng)
    return _split(mine, left, rng) + _split(counts - mine, shards - left, rng)


def _coprime(n: int, rng: np.random.Generator) -> int:
    """A factor for the permutation x -> factor * x + shift of 0 .. n - 1."""
    while True:
        a = int(rng.integers(1, min(n, 1 << 20) + 1))
        if math.gcd(a, n) == 1:
            return a


class Mixture:
    """`drawn` (shard, position, doc_id, source, repeat, n_tokens) and `report` (one row per listed source)."""

    def __init__(self, documents: DataFrame, weights: DataFrame, *, shards: int = SHARDS, seed: int = SEED, **tokenizer: str):
        self.seed = seed
        kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("source is not null and text is not null")
        listed = weights.where("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"))
        names = bounded_rows(listed.select("source"), FILTERED)
        if names is not None:
            kept = kept.where(F.col("source").isin([r.source for r in names]))
        sized = token_counts(kept, **tokenizer).where("n_tokens > 0")
        if names is None:
            sized = sized.join(listed.select("source"), "source", "left_semi")
        place = _place("doc_id", seed)
        sized = sized.select("doc_id", "source", "n_tokens", F.shiftright(place, 36).cast("int").alias("block"), F.pmod(F.shiftright(place, 24), F.lit(SUB_BLOCKS)).cast("int").alias("sub"), place.alias("place"))
        self.sized = materialize(sized, "mixture-sizes")
        by_block = self.sized.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))
        # One window over the at most BLOCKS rows of a source.
        order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
        ranked = materialize(by_block.select("source", "block", "n", "tokens", (F.row_number().over(order) - 1).alias("rank"), F.sum("tokens").over(order).alias("running")), "mixture-blocks")
        self.quotas = materialize(self._quotas(listed, ranked), "mixture-quotas")
        blocks = ranked.join(self.quotas.where("quota > 0").select("source", "passes", "rest"), "source")
        before = F.col("running") - F.col("tokens")
        partial = (before < F.col("rest")).alias("partial")
        self.blocks = materialize(blocks.select("source", "block", "rank", "passes", partial, (F.col("running") > F.col("rest")).alias("cut"), (F.col("rest") - before).alias("left")).where("partial or passes > 0"), "mixture-placed")
        self.ranges = materialize(self._ranges(shards), "mixture-ranges")
        self.drawn = self._draw()

    def _quotas(self, listed: DataFrame, ranked: DataFrame) -> DataFrame:
        per = ranked.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_blocks"))
        q = listed.join(per, "source", "left").fillna(0, ["documents", "tokens", "n_blocks"])
        usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
        most = F.col("max_repeats") * F.col("tokens")
        asked, least = q.where(usable).agg(F.sum("target_share"), F.min(most / F.col("target_share"))).first()
        asked_share = F.when(usable, F.col("target_share") / F.lit(asked or 1.0)).otherwise(0.0)
        quota = F.when(usable, F.least(F.round(F.lit((asked or 0.0) * (least or 0.0)) * F.col("asked_share")).cast("long"), most)).otherwise(0).cast("long")
        q = q.withColumn("asked_share", asked_share).withColumn("quota", quota)
        size = F.greatest("tokens", F.lit(1))
        return q.withColumn("passes", F.floor(F.col("quota") / size).cast("long")).withColumn("rest", F.col("quota") % size)

    def _ranges(self, shards: int) -> DataFrame:
        """source, n_blocks, copies, starts (of each shard's range), factor and shift of its permutation."""
        seed = self.seed
        partial = self.blocks.where("partial").groupBy("source").agg(F.count("*").alias("n_partial"))
        counts = self.quotas.where("quota > 0").join(partial, "source", "left").select("source", "n_blocks", (F.col("passes") * F.col("n_blocks") + F.coalesce("n_partial", F.lit(0))).alias("copies"))
        counts = counts.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(GROUPS)).cast("int"))
        groups = sorted((r.g, r.copies) for r in counts.groupBy("g").agg(F.sum("copies").alias("copies")).collect())
        rng = np.random.default_rng(seed)
        parts = _split(np.array([n for _, n in groups], np.int64), shards, rng) if groups else []
        shares = {g: [int(p[k]) for p in parts] for k, (g, _) in enumerate(groups)}

        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            own = np.random.default_rng([seed, int(key[0])])
            pdf = pdf.sort_values("source")
            left = pdf["copies"].to_numpy(np.int64).copy()
            taken = [np.zeros_like(left)]
            for n in shares[int(key[0])]:
                taken.append(_take(left, n, own))
                left = left - taken[-1]
            starts = np.cumsum(taken, axis=0)
            factors = [_coprime(n, own) for n in pdf["copies"].tolist()]
            return pd.DataFrame({"source": pdf["source"], "n_blocks": pdf["n_blocks"], "copies": pdf["copies"], "starts": list(starts.T), "factor": factors, "shift": [int(own.integers(n)) for n in pdf["copies"].tolist()]})

        return counts.groupBy("g").applyInPandas(run, "source string, n_blocks long, copies long, starts array<long>, factor long, shift long")

    def _draw(self) -> DataFrame:
        copies = self.sized.join(broadcast_if_small(self.blocks), ["source", "block"])
        # The cut block's part: sub-blocks in their order (one window over at most SUB_BLOCKS sums of a source).
        cut = copies.where("partial and cut")
        sums = cut.groupBy("source", "sub", "left").agg(F.sum("n_tokens").alias("tokens"))
        running = F.sum("tokens").over(Window.partitionBy("source").orderBy("sub"))
        ends = sums.withColumn("running", running).where("running > left").groupBy("source").agg(F.min_by(F.struct(F.col("sub").alias("end"), (F.col("left") - F.col("running") + F.col("tokens")).alias("over")), "sub").alias("e"))
        ends = broadcast_if_small(materialize(ends.select("source", "e.*"), "mixture-ends"))
        single = lambda c: F.when(c, F.array(F.col("passes") + 1)).otherwise(F.array().cast("array<bigint>"))
        passes = F.when(F.col("passes") > 0, F.sequence(F.lit(1).cast("long"), F.col("passes"))).otherwise(F.array().cast("array<bigint>"))
        whole = copies.join(ends, "source", "left").withColumn("repeat", F.explode(F.concat(passes, single(F.col("partial") & (~F.col("cut") | (F.col("sub") < F.col("end")))))))
        # The document at the very end counts if it brings the sum nearer to the quota.
        told = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place", "doc_id"))
        last = cut.join(ends, "source").where(F.col("sub") == F.col("end")).withColumn("told", told).where(2 * F.col("told") - F.col("n_tokens") <= 2 * F.col("over")).withColumn("repeat", F.col("passes") + 1)
        columns = ["source", "rank", "doc_id", "repeat", "n_tokens"]
        drawn = whole.select(*columns).unionByName(last.select(*columns)).join(broadcast_if_small(self.ranges), "source")
        index = F.pmod(F.col("factor") * ((F.col("repeat") - 1) * F.col("n_blocks") + F.col("rank")) + F.col("shift"), F.col("copies"))
        shard = F.size(F.filter("starts", lambda x: x <= index)) - 1
        position = F.xxhash64(F.lit(self.seed + 1), F.col("doc_id"), F.col("repeat"))
        return drawn.select(shard.alias("shard"), position.alias("position"), "doc_id", "source", F.col("repeat").cast("int").alias("repeat"), "n_tokens")

    def report(self) -> DataFrame:
        """source, target_share, asked_share, actual_share, documents, tokens, drawn_tokens, max_repeats, repeats_used."""
        reached = materialize(self.drawn.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.max("repeat").alias("repeats_used")), "mixture-reached")
        total = reached.agg(F.sum("drawn_tokens")).first()[0] or 0
        zero = lambda c: F.coalesce(c, F.lit(0))
        out = self.quotas.join(reached, "source", "left").select("source", "target_share", "asked_share", "documents", "tokens", zero("drawn_tokens").alias("drawn_tokens"), "max_repeats", zero("repeats_used").alias("repeats_used"))
        return out.withColumn("actual_share", F.col("drawn_tokens") / F.lit(total) if total else F.lit(0.0))


def written(mixture: Mixture, path: str) -> None:
    """Writes the mixture shard by shard, each in its shuffled order; nothing is sorted across shards."""
    mixture.drawn.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
