"""Mixing sources to target weights (problem 9).

Every document has a hash; a source's share is a hash threshold. Thresholds come from
histograms of tokens by (source, leading hash bits): the bucket in which the cumulated
tokens pass the budget is refined by the next bits, and only that bucket's documents are
read again: sizes are stored with the hash, ordered by source and hash within each file, and
the bucket's bounds are pushed down to the scan. Documents are then filtered by threshold, and
a smaller budget selects a subset of a larger one.

The total is the largest at which every source that has documents reaches its share
within its cap of repeats: T = min over sources of tokens x max_repeats / share. The
shares of sources without documents are spread over the others in proportion.

Defined results
    * sources are compared trimmed and in lower case; a target given twice adds up, with
      the smaller cap; null and unlisted sources are never selected.
    * blank texts have no tokens and are never selected.
    * null or non-positive shares and caps count as no target.
    * no targets or no documents: an empty selection, and a report of the targets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import tabled
from almudi.llm.tokens import VOCABULARY, token_counts

BITS = 60
STEP = 12
SEEDS = 16
NEAR = 0.005


def _targets(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    return t.where("source is not null and source <> '' and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def _hash(seed: Column | None = None) -> Column:
    """The hash of a document under a seed; that of seed 0 is stored as ``h``."""
    of = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(0) if seed is None else seed), 64 - BITS)
    return of if seed is None else F.when(seed == 0, F.col("h")).otherwise(of)


class Mix:
    """Sized documents, the total, and per source the hash seed and nested thresholds.

    In a large source the boundary document hardly matters. Where it leaves more than
    ``NEAR`` of the budget (a small source of long texts), the source tries further hash
    seeds and takes the one that comes closest; all parts of the budget share it, so they
    stay nested.
    """

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY):
        self.spark = documents.sparkSession
        self.targets = _targets(mix_targets)
        sized = token_counts(documents, vocabulary).where("n_tokens > 0")
        self.sized = tabled(sized.join(self.targets.select("source"), "source", "left_semi").withColumn("h", _hash()).sortWithinPartitions("source", "h"), "sized")
        totals = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        # one row per target source
        self.sources = {r.source: r for r in self.targets.join(totals, "source").collect()}
        present = sum(r.target_share for r in self.sources.values())
        self.share = {s: r.target_share / present for s, r in self.sources.items()}
        self.total = min((r.tokens * r.max_repeats / self.share[s] for s, r in self.sources.items()), default=0.0)
        first = self._search({(s, 0): self._whole(s, 1.0)[1] for s in self.sources})
        far = [s for s, r in self.sources.items() if abs(first[s, 0][1]) > NEAR * self.share[s] * self.total]
        tried = first | self._search({(s, k): self._whole(s, 1.0)[1] for s in far for k in range(1, SEEDS)})
        self.seed = {s: min((k for t, k in tried if t == s), key=lambda k, s=s: (abs(tried[s, k][1]), k)) for s in self.sources}

    def _whole(self, source: str, part: float) -> tuple[int, int]:
        """Whole repeats of everything, and tokens still to be selected."""
        return divmod(int(self.share[source] * self.total * part), self.sources[source].tokens)

    def _search(self, budgets: dict[tuple[str, int], int]) -> dict[tuple[str, int], tuple[int, int]]:
        """By (source, seed): the hash below which documents make up the budget, and the
        tokens then missing (negative: too many, where that comes closer)."""
        low = dict.fromkeys(budgets, 0)  # start of the bucket that holds the boundary
        left = dict(budgets)
        edge: dict[tuple[str, int], int] = {}
        for used in range(STEP, BITS + 1, STEP):
            ask = [(*k, low[k], left[k]) for k in budgets if left[k] > 0]
            if not ask:
                break
            width, span = 1 << (BITS - used), 1 << (BITS - used + STEP)
            bounds = self.spark.createDataFrame(ask, "source string, seed int, low long, remaining long")
            bucket = lambda s, k, lo: (F.col("source") == s) & ((F.col("h") >= lo) & (F.col("h") < lo + span) if k == 0 and used > STEP else F.lit(True))  # noqa: E731, B023
            here = reduce(Column.__or__, [bucket(s, k, lo) for s, k, lo, _ in ask])
            inside = self.sized.where(here).join(F.broadcast(bounds), "source").withColumn("h", _hash(F.col("seed")))  # targets x seeds rows
            if used > STEP:
                inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + span))
            hist = inside.groupBy("source", "seed", "remaining", F.floor((F.col("h") - F.col("low")) / width).cast("long").alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
            w = W.partitionBy("source", "seed").orderBy("bucket")
            run = hist.withColumn("upto", F.sum("tokens").over(w))  # at most 2^STEP buckets
            for r in run.where(F.col("upto") > F.col("remaining")).groupBy("source", "seed").agg(F.min_by(F.struct("bucket", "tokens", "upto"), "bucket").alias("b")).collect():
                k = (r.source, r.seed)
                low[k] += r.b.bucket * width
                left[k] -= r.b.upto - r.b.tokens
                edge[k] = r.b.tokens
        for k, tokens in edge.items():
            if 0 < tokens - left[k] < left[k]:  # the boundary document comes closer
                low[k], left[k] = low[k] + 1, left[k] - tokens
        return {k: (low[k], left[k]) for k in budgets}

    def thresholds(self, part: float = 1.0) -> dict[str, tuple[int, int, int]]:
        """By source: seed, whole repeats, and the hash below which one more is taken."""
        whole = {s: self._whole(s, part) for s in self.sources}
        found = self._search({(s, self.seed[s]): rest for s, (_, rest) in whole.items()})
        return {s: (self.seed[s], times, found[s, self.seed[s]][0]) for s, (times, _) in whole.items()}

    def selection(self, part: float = 1.0) -> DataFrame:
        """(doc_id, source, n_tokens, repeats) of the documents used at least once."""
        rows = [(s, *x) for s, x in self.thresholds(part).items()]
        cut = self.spark.createDataFrame(rows, "source string, seed int, times long, below long")
        repeats = F.col("times") + (_hash(F.col("seed")) < F.col("below")).cast("long")
        return self.sized.join(F.broadcast(cut), "source").select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")

    def report(self, part: float = 1.0) -> DataFrame:
        """Reached shares per target source."""
        used = self.selection(part).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("documents"))
        all_tokens = used.agg(F.sum("tokens").alias("all_tokens"))
        out = self.targets.join(used, "source", "left").join(F.broadcast(all_tokens), how="left")  # one row
        return out.select("source", F.round("target_share", 6).alias("target_share"), "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"))
