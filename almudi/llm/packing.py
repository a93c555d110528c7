"""Filling fixed-capacity containers with items (problem 8).

A grouping genetic algorithm, distributed as islands. Items are dealt at random into
shards of bounded size; each shard is worked on by several islands, each with its own
population. Crossover injects whole well-filled containers of one parent into another,
drops the containers that hold the same documents, exchanges the displaced documents for
smaller ones where that fills a container better, and fits what is left into the tightest
space (best fit, largest first). Between epochs the elite of every island migrates to the
next one; the best island's solution counts. An island stops at the least number of
containers that its documents need, or after ``PATIENCE`` children in a row without gain.
Containers that stay badly filled are dissolved and packed again across shards, so that a
shard's last container isn't wasted.

A text longer than the capacity is cut into whole containers and a remainder, which is an
item; no other text is cut.

Defined results
    * null and blank texts have 0 tokens; they go into the shard's fullest container.
    * sizes given twice for one name: the larger capacity counts; null or non-positive
      capacities are ignored.
    * rows that share a doc_id, or have none, are documents of their own: each is packed, and
      no two share a container of a whole piece.
    * empty tables give an empty assignment; extra columns are ignored.
    * the same input gives the same assignment, however it is partitioned.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almudi.core.runtime import tabled
from almudi.llm.tokens import VOCABULARY, token_counts

SHARD = 1_500
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
CHILDREN = 40
PATIENCE = 12
WELL_FILLED = 0.97

Bins = list[list[int]]


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Each item of ``order`` into the bin with the least space that holds it, else a new one."""
    bins = bins if bins is not None else []
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - sizes[i], len(bins) - 1))
        else:
            space, k = free.pop(at)
            bins[k].append(i)
            insort(free, (space - sizes[i], k))
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Mean squared fill: of equally many containers, fuller and emptier ones beat even ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound of the containers (Martello and Toth's L2): for every k, items over
    ``capacity`` - k fill a container alone, those over half of it share with none of their
    kind, and those of k or more must fit into what the latter leave or need containers."""
    asc = sorted(sizes)
    upto = [0]
    for x in asc:
        upto.append(upto[-1] + x)
    half = bisect_right(asc, capacity // 2)
    best = -(-upto[-1] // capacity)
    for k in {x for x in asc[:half]} | {0}:
        big, low = bisect_right(asc, capacity - k), bisect_left(asc, k)
        mid = max(big, half) - half
        free = mid * capacity - (upto[max(big, half)] - upto[half])
        best = max(best, len(asc) - half + max(0, -(-(upto[half] - upto[low] - free) // capacity)))
    return best


def exchange(bins: Bins, loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Puts loose items in place of one or two smaller ones of a bin where they fill it
    better, and returns what is loose then: the same items or smaller ones, easier to fit."""
    loose = sorted(loose, key=lambda i: sizes[i])
    for b in sorted(bins, key=lambda x: -sum(sizes[i] for i in x)):
        free = capacity - sum(sizes[i] for i in b)
        while free and loose:
            gain, out, at = 0, (), -1
            for x, i in enumerate(b):
                for j in (None, *b[x + 1 :]):
                    gone = sizes[i] + (sizes[j] if j is not None else 0)
                    k = bisect_right(loose, gone + free, key=lambda z: sizes[z]) - 1
                    if k >= 0 and sizes[loose[k]] - gone > gain:
                        gain, out, at = sizes[loose[k]] - gone, (i,) if j is None else (i, j), k
            if not gain:
                break
            new = loose.pop(at)
            for i in out:
                b.remove(i)
                insort(loose, i, key=lambda z: sizes[z])
            b.append(new)
            free -= gain
    return loose


def _placed(bins: Bins, loose: list[int], sizes: list[int], capacity: int) -> Bins:
    loose = exchange(bins, loose, sizes, capacity)
    return best_fit(sorted(loose, key=lambda i: -sizes[i]), sizes, capacity, bins)


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: Random) -> Bins:
    """Whole well-filled bins of ``b`` into ``a``; bins of ``a`` that share a document with
    them are dissolved and what they alone held is fitted in again."""
    fill = [sum(sizes[i] for i in x) for x in b]
    ranked = sorted(range(len(b)), key=lambda k: -fill[k])
    pool = ranked[: max(1, len(ranked) // 2)]
    injected = [b[k] for k in rng.sample(pool, max(1, len(pool) // 8))]
    inside = {i for x in injected for i in x}
    child, displaced = [list(x) for x in injected], []
    for x in a:
        if inside.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    return _placed(child, displaced, sizes, capacity)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: Random) -> Bins:
    """Dissolves the emptiest bins and some at random."""
    ranked = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(ranked[:2]) | set(rng.sample(range(len(bins)), min(len(bins), 3)))
    return _placed([list(b) for k, b in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k]], sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[Bins] | None = None) -> Bins:
    """The best packing an island finds, from elites and best-fit packings of disturbed orders."""
    rng = Random(seed)
    base = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bound = max(least_bins(sizes, capacity), 1)
    people = list(elites or []) or [best_fit(base, sizes, capacity)]
    if min(map(len, people)) > bound:
        while len(people) < POPULATION:
            people.append(best_fit(sorted(base, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0)), sizes, capacity))
    rated = lambda p, k: (-len(p), fitness(p, sizes, capacity), k, p)
    scored = sorted((rated(p, -k) for k, p in enumerate(people)), reverse=True)
    idle = 0
    for n in range(CHILDREN):
        if len(scored[0][3]) <= bound or idle >= PATIENCE:
            break
        a, b = rng.sample(scored, 2)
        child = mutate(a[3], sizes, capacity, rng) if rng.random() < 0.3 else crossover(a[3], b[3], sizes, capacity, rng)
        best = scored[0][:2]
        scored = sorted([*scored, rated(child, -POPULATION - n)], reverse=True)[:POPULATION]
        idle = 0 if scored[0][:2] > best else idle + 1
    return scored[0][3]


_ITEM = ["doc_id", "whole", "copy", "piece_no"]
_ISLAND = "size_name string, capacity long, shard long, island int, doc_id long, whole long, copy long, piece_no int, n_tokens long, bin int, origin int, score double, fitted int"


def _bins(pdf: pd.DataFrame, position: dict) -> Bins:
    out: dict[int, list[int]] = {}
    for *item, b in zip(*[pdf[c] for c in _ITEM], pdf.bin, strict=True):
        out.setdefault(b, []).append(position[tuple(item)])
    return list(out.values())


def _epoch(pdf: pd.DataFrame) -> pd.DataFrame:
    """One island's epoch. Rows with a bin are elites that migrated here, by origin."""
    first = pdf[pdf.origin == pdf.origin.iloc[0]] if len(pdf) else pdf
    items = first.sort_values(["n_tokens", *_ITEM], ascending=[False, True, True, True, True])
    position = {k: i for i, k in enumerate(zip(*[items[c] for c in _ITEM], strict=True))}
    sizes, capacity, island = [int(x) for x in items.n_tokens], int(pdf.capacity.iloc[0]), int(pdf.island.iloc[0])
    elites = [_bins(g, position) for o, g in pdf.groupby("origin") if o >= 0]
    best = evolve(sizes, capacity, hash((int(pdf.shard.iloc[0]), island, capacity, len(elites))) & 0x7FFFFFFF, elites)
    bin_of = [0] * len(sizes)
    for k, b in enumerate(best):
        for i in b:
            bin_of[i] = k
    fitted = len(best_fit(range(len(sizes)), sizes, capacity)) if not elites else int(pdf.fitted.iloc[0])
    return items.assign(bin=bin_of, origin=island, island=island, score=fitness(best, sizes, capacity) - len(best), fitted=fitted)[["size_name", "capacity", "shard", "island", *_ITEM, "n_tokens", "bin", "origin", "score", "fitted"]]


def _islands(items: DataFrame) -> DataFrame:
    """(size_name, capacity, shard, bin, item, n_tokens): each shard's best island."""
    key = ["size_name", "capacity", "shard", "island"]
    now = items.select("size_name", "capacity", "shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), *_ITEM, "n_tokens", F.lit(-1).alias("bin"), F.lit(-1).alias("origin"), F.lit(0.0).alias("score"), F.lit(0).alias("fitted"))
    for e in range(EPOCHS):
        if e:
            here = F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island")
            now = now.select("size_name", "capacity", "shard", here, *_ITEM, "n_tokens", "bin", "origin", "score", "fitted")
        now = tabled(now.groupBy(*key).applyInPandas(_epoch, _ISLAND), "islands")
    best = now.groupBy("size_name", "shard").agg(F.max(F.struct("score", -F.col("island"))).alias("b")).select("size_name", "shard", (-F.col("b.col2")).alias("island"))
    return now.join(best, ["size_name", "shard", "island"]).select("size_name", "capacity", "shard", "bin", *_ITEM, "n_tokens", "fitted")


def _sharded(items: DataFrame, per_shard: int, salt: int) -> DataFrame:
    """Deals each size's items at random into shards of about ``per_shard``."""
    count = items.groupBy("size_name").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_shard)).alias("shards"))  # one row a size
    return items.join(F.broadcast(count), "size_name").withColumn("shard", F.pmod(F.xxhash64(*_ITEM, F.lit(salt)), F.col("shards"))).drop("shards")


def pieces(documents: DataFrame, context_sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(size_name, capacity, doc_id, whole, copy, piece_no, n_tokens) for every size and text.

    Rows of one doc_id are told apart by the whole text's tokens, and equally long ones by
    a number; where doc_id is null it is 0 here and the number negative.
    """
    known = F.when(F.col("doc_id").isNull(), -1).otherwise(1)
    rows = token_counts(documents, vocabulary).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("rows"))
    sized = tabled(rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_tokens", F.explode(F.sequence(known.cast("long"), known * F.col("rows"), known.cast("long"))).alias("copy")), "token-counts")
    sizes = context_sizes.where("size_name is not null and capacity_tokens > 0").groupBy("size_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    given = [(r.size_name, r.capacity) for r in sizes.collect()]  # a handful of container sizes
    if not given:
        return sized.where("false").select(F.lit("").alias("size_name"), F.lit(0).cast("long").alias("capacity"), "doc_id", F.col("n_tokens").alias("whole"), "copy", F.lit(0).alias("piece_no"), "n_tokens")
    each = sized.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("size_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(given)])))
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("s.capacity")), F.lit(1)).cast("int") - 1
    cut = each.select("s.size_name", "s.capacity", "doc_id", F.col("n_tokens").alias("whole"), "copy", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return cut.select("size_name", "capacity", *_ITEM, F.least(F.col("capacity"), F.col("whole") - F.col("piece_no") * F.col("capacity")).alias("n_tokens"))


def _packed(documents: DataFrame, context_sizes: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole containers of cut texts, first round with its badly filled containers marked,
    second round)."""
    every = tabled(pieces(documents, context_sizes, vocabulary), "pieces")
    first = tabled(_islands(_sharded(every.where("n_tokens < capacity"), SHARD, 1)), "packed")
    fill = first.groupBy("size_name", "shard", "bin").agg((F.sum("n_tokens") / F.first("capacity") >= WELL_FILLED).alias("well"))
    marked = tabled(first.join(fill, ["size_name", "shard", "bin"]), "marked")
    again = _islands(_sharded(marked.where("not well").select("size_name", "capacity", *_ITEM, "n_tokens"), SHARD, 2))
    return every.where("n_tokens = capacity"), marked, again


def pack(documents: DataFrame, context_sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(size_name, container_id, doc_id, piece_no, n_tokens): every text in some container."""
    shown = [F.when(F.col("copy") > 0, F.col("doc_id")).alias("doc_id"), "piece_no", "n_tokens"]
    full, marked, again = _packed(documents, context_sizes, vocabulary)
    whole = full.select("size_name", F.concat_ws("-", "size_name", F.lit("full"), *_ITEM).alias("container_id"), *shown)
    kept = marked.where("well").select("size_name", F.concat_ws("-", "size_name", F.lit("a"), "shard", "bin").alias("container_id"), *shown)
    rest = again.select("size_name", F.concat_ws("-", "size_name", F.lit("b"), "shard", "bin").alias("container_id"), *shown)
    return whole.unionByName(kept).unionByName(rest)


def fill_report(documents: DataFrame, context_sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per size: containers, the least number possible and the unused share; and over both
    rounds' shards the containers of plain best fit, of the evolved packings, and the least."""
    full, marked, again = _packed(documents, context_sizes, vocabulary)
    again = tabled(again, "again")
    rounds = marked.withColumn("round", F.lit(1)).unionByName(again.withColumn("round", F.lit(2)).withColumn("well", F.lit(True)))
    shards = rounds.groupBy("size_name", "round", "shard").agg(F.first("fitted").alias("fitted"), (F.max("bin") + 1).alias("evolved"), F.ceil(F.sum("n_tokens") / F.first("capacity")).alias("least"))
    effect = shards.groupBy("size_name").agg(F.sum("fitted").alias("best_fit_containers"), F.sum("evolved").alias("evolved_containers"), F.sum("least").alias("least_of_shards"))
    bins = rounds.where("well").groupBy("size_name", "capacity", "round", "shard", "bin").agg(F.sum("n_tokens").alias("n")).select("size_name", "capacity", "n").unionByName(full.select("size_name", "capacity", F.col("n_tokens").alias("n")))
    used = bins.groupBy("size_name", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    return used.join(effect, "size_name", "left").select("size_name", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"), "best_fit_containers", "evolved_containers", "least_of_shards")


def checks(packed: DataFrame, documents: DataFrame, context_sizes: DataFrame) -> DataFrame:
    """Per size: texts, and how many of them or of the containers break a rule of the packing."""
    sizes = context_sizes.where("size_name is not null and capacity_tokens > 0").groupBy("size_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    docs = documents.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    p = tabled(packed.join(sizes, "size_name"), "assignment")
    texts = p.groupBy("size_name", "doc_id").agg(F.sum((F.col("piece_no") == 0).cast("long")).alias("seen"), F.sum("n_tokens").alias("tokens"), F.max("piece_no").alias("last"), F.first("capacity").alias("capacity"))
    one = texts.join(docs, texts.doc_id.eqNullSafe(docs.doc_id), "left")
    t = one.groupBy("size_name").agg(F.sum("seen").alias("n_packed"), F.count_if(~F.col("seen").eqNullSafe(F.col("copies"))).alias("n_miscounted"), F.count_if((F.col("copies") == 1) & (F.col("last") > 0) & (F.col("tokens") <= F.col("capacity"))).alias("n_cut_in_vain"))
    over = p.groupBy("size_name", "container_id").agg((F.sum("n_tokens") > F.first("capacity")).alias("over")).groupBy("size_name").agg(F.count_if("over").alias("n_over_capacity"))
    return t.join(over, "size_name").select("size_name", "n_packed", "n_miscounted", "n_cut_in_vain", "n_over_capacity")
