"""Fill containers of fixed capacity with documents by a grouping genetic algorithm.

A chromosome is a packing: its genes are whole bins. Crossover injects the well-filled bins of one parent into the
other, removes the bins that hold a document twice, and puts the displaced documents back by best fit. Islands evolve
apart and hand their best packings to the next island (elite migration).

How it is spread: the items of a container are dealt by hash to blocks of about ``block_items``, so that a task holds
one block whatever the corpus' size. Each block lives on ``islands`` islands. An epoch is a map over islands; migration
is a shuffle of a few short integer arrays. After the last epoch each block keeps its well-filled bins; the items of the
other bins are dealt to new, fewer blocks and packed again, until one block or few items are left. Nothing is gathered
on the driver but counts.

Defined results: a document with more tokens than the capacity is cut into parts; all its parts but the last fill a bin
each, and only such a document is cut. Null and empty documents have length 0 and take a place without using space.
Repeated ids are told apart by nothing, so ``doc_id`` must be unique. No items: no rows. A capacity below 1 is an error.
Equal seeds give equal packings.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.encode import TOKENIZER_DIR, encode_documents
from quillveil.runtime import written

#: Items of a block; what one task holds.
BLOCK_ITEMS = 1200
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 2, 2, 12, 6, 2
#: A bin is final when it is filled at least so far; others are packed again in the next round.
FULL = 0.985
ROUNDS = 4


class Packing:
    """Bins as lists of item numbers, with their fills."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> float:
        """Mean square of the fill: it prefers few, full bins, and among equally many those with one emptier bin."""
        return sum(f * f for f in self.fills) / (capacity * capacity * max(1, len(self.fills)))

    def codes(self, n: int) -> list[int]:
        code = [0] * n
        for b, items in enumerate(self.bins):
            for i in items:
                code[i] = b
        return code


def from_codes(codes: list[int], sizes: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(max(codes, default=-1) + 1)]
    for i, b in enumerate(codes):
        bins[b].append(i)
    return Packing(bins, [sum(sizes[i] for i in b) for b in bins])


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int]) -> Packing:
    """Put items, in the order given, each into the fullest bin that it fits in; open a bin where none does."""
    free = sorted((capacity - f, b) for b, f in enumerate(fills))
    for i in items:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b = capacity, len(bins)
            bins.append([])
            fills.append(0)
        bins[b].append(i)
        fills[b] += size
        insort(free, (space - size, b))
    return Packing(bins, fills)


def crossover(keeper: Packing, giver: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject a share of the giver's best-filled bins into the keeper."""
    order = sorted(range(len(giver.bins)), key=lambda b: -giver.fills[b] * (0.9 + 0.1 * rng.random()))
    chosen = order[: max(1, int(len(order) * rng.uniform(0.2, 0.5)))]
    held = {i for b in chosen for i in giver.bins[b]}
    bins, fills, displaced = [giver.bins[b] for b in chosen], [giver.fills[b] for b in chosen], []
    worst = sorted(range(len(keeper.bins)), key=lambda b: keeper.fills[b])[: rng.randrange(3)]
    for b, items in enumerate(keeper.bins):
        if b in worst or not held.isdisjoint(items):
            displaced += [i for i in items if i not in held]
        else:
            bins.append(items)
            fills.append(keeper.fills[b])
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, capacity, [list(b) for b in bins], list(fills))


def evolve(sizes: list[int], capacity: int, seed: int, settled: list[list[int]], generations: int = GENERATIONS, population: int = POPULATION) -> list[Packing]:
    """Elites of an island after some generations; ``settled`` are packings, as codes, that came with it."""
    rng, n = random.Random(seed), len(sizes)
    least = max(1, -(-sum(sizes) // capacity)) if n else 0
    pool = [from_codes(c, sizes) for c in settled]
    while len(pool) < population:
        shaken = [s * (1 + (0.25 * rng.random() if pool else 0)) for s in sizes]
        pool.append(best_fit(sorted(range(n), key=lambda i: -shaken[i]), sizes, capacity, [], []))
        if len(pool[-1].bins) <= least:
            break
    rank = lambda p: -p.fitness(capacity)
    pool.sort(key=rank)
    for _ in range(generations):
        if len(pool) < 2 or len(pool[0].bins) <= least:
            break
        a, b = sorted(rng.sample(range(len(pool)), 2))
        pool += [crossover(pool[a], pool[b], sizes, capacity, rng), crossover(pool[b], pool[a], sizes, capacity, rng)]
        pool.sort(key=rank)
        del pool[population:]
    return pool[:ELITES]


_STATE = "container string, capacity int, block bigint, island int, doc_ids array<bigint>, parts array<int>, sizes array<int>, elites array<array<int>>, fitness double, n_bins int"


def _evolve_rows(frames: Iterator[pd.DataFrame], epoch: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            sizes, settled = [int(x) for x in r.sizes], [[int(x) for x in e] for e in r.elites]
            best = evolve(sizes, int(r.capacity), hash((int(r.block), int(r.island), epoch)) & 0x7FFFFFFF, settled)
            rows.append((r.container, r.capacity, r.block, r.island, r.doc_ids, r.parts, r.sizes, [p.codes(len(sizes)) for p in best], best[0].fitness(int(r.capacity)), len(best[0].bins)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])


def _pack_round(items: DataFrame, n_round: int, block_items: int, islands: int, epochs: int) -> DataFrame:
    """Best packing of each block of ``container, capacity, doc_id, part, size, n_items``: one row an item, with its bin and the bin's fill."""
    block = F.pmod(F.xxhash64("doc_id", "part", F.lit(n_round)), F.greatest(F.lit(1), F.ceil(F.col("n_items") / block_items)))
    blocks = (
        items.withColumn("block", block).groupBy("container", "capacity", "block")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "part", "size"))).alias("x"))
        .select("container", "capacity", "block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"),
                F.col("x.doc_id").alias("doc_ids"), F.col("x.part").alias("parts"), F.col("x.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("elites"))
    )
    state = blocks.withColumn("elites", F.array().cast("array<array<int>>"))
    for epoch in range(epochs):
        if epoch:
            # The next island receives this one's elites; islands of a block meet in one row, which is as small as a block.
            moved = state.select("container", "capacity", "block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elites").alias("came"))
            state = state.join(moved, ["container", "capacity", "block", "island"]).withColumn("elites", F.array_distinct(F.concat("elites", "came"))).drop("came")
        state = state.select("container", "capacity", "block", "island", "doc_ids", "parts", "sizes", "elites").mapInPandas(lambda it, e=epoch: _evolve_rows(it, e), _STATE)
        state = written(state, f"packing-{n_round}-{epoch}")
    best = state.groupBy("container", "capacity", "block").agg(F.max_by(F.struct("doc_ids", "parts", "sizes", F.col("elites")[0].alias("code")), F.struct(-F.col("n_bins"), "fitness", -F.col("island"))).alias("b"))
    rows = best.select("container", "capacity", "block", F.explode(F.arrays_zip("b.doc_ids", "b.parts", "b.sizes", "b.code")).alias("i"))
    rows = rows.select("container", "capacity", "block", F.col("i.doc_ids").alias("doc_id"), F.col("i.parts").alias("part"), F.col("i.sizes").alias("size"), F.col("i.code").alias("bin"))
    fills = rows.groupBy("container", "capacity", "block", "bin").agg(F.sum("size").alias("fill"))
    return rows.join(fills, ["container", "capacity", "block", "bin"])


def fill_containers(items: DataFrame, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS, full: float = FULL) -> DataFrame:
    """Pack ``container, capacity, doc_id, n_tokens`` (null length: 0) into bins.

    Result: ``container, bin_id, doc_id, part, start_token, n_tokens``, a row for each document and part of one.
    """
    if items.filter(F.col("capacity") < 1).limit(1).count():
        raise ValueError("a container's capacity must be 1 or more")
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    whole = F.when(n > F.col("capacity"), F.floor(n / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    items = items.withColumns({"n": n, "whole": whole}).withColumn("rest", (F.col("n") - F.col("whole") * F.col("capacity")).cast("int"))
    bins = [
        items.filter("whole > 0").select("container", "capacity", "doc_id", F.posexplode(F.array_repeat(F.col("capacity"), F.col("whole"))).alias("part", "size"))
        .select("container", "capacity", F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("bin_id"), "doc_id", "part", "size")
    ]
    left = items.filter("rest > 0 or whole = 0").select("container", "capacity", "doc_id", F.col("whole").alias("part"), F.col("rest").alias("size"))
    for n_round in range(rounds):
        counts = left.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"))
        sized = left.join(F.broadcast(counts), "container")  # one row a container
        packed = written(_pack_round(sized, n_round, block_items, islands, epochs), f"packed-{n_round}")
        named = packed.withColumn("bin_id", F.concat_ws("-", F.lit(f"r{n_round}"), F.col("block").cast("string"), F.col("bin").cast("string")))
        many = packed.groupBy("container").agg(F.countDistinct("block").alias("blocks")).filter("blocks > 1").select("container")
        again = [r[0] for r in many.collect()] if n_round < rounds - 1 else []  # container names only
        settled = F.coalesce(~F.col("container").isin(again), F.lit(False)) if again else F.lit(True)
        done = settled | (F.col("fill") >= full * F.col("capacity"))
        bins.append(named.filter(done).select("container", "capacity", "bin_id", "doc_id", "part", "size"))
        if not again:
            break
        left = named.filter(~done).select("container", "capacity", "doc_id", "part", "size")
    out = bins[0]
    for more in bins[1:]:
        out = out.unionByName(more)
    return out.select("container", "bin_id", "doc_id", "part", (F.col("part").cast("bigint") * F.col("capacity")).alias("start_token"), F.col("size").alias("n_tokens"))


def pack_documents(documents: DataFrame, containers: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, **options) -> DataFrame:  # noqa: ANN003
    """Lengths by each container's tokenizer, computed once a tokenizer, then `fill_containers`."""
    rows = containers.select("container", "tokenizer", "capacity_tokens").dropna().dropDuplicates().collect()  # a fixed table of few rows
    parts = []
    for tokenizer in sorted({r.tokenizer for r in rows}):
        lengths = written(encode_documents(documents.select("doc_id", "text"), out="n_tokens", tokenizer=tokenizer, tokenizer_dir=tokenizer_dir, lengths_only=True).drop("text"), "token-lengths")
        of = F.array(*[F.struct(F.lit(r.container).alias("container"), F.lit(r.capacity_tokens).alias("capacity")) for r in rows if r.tokenizer == tokenizer])
        parts.append(lengths.select(F.explode(of).alias("c"), "doc_id", "n_tokens").select("c.container", "c.capacity", "doc_id", "n_tokens"))
    items = parts[0]
    for more in parts[1:]:
        items = items.unionByName(more)
    return fill_containers(items, **options)


def bins_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, n_documents, n_bins, least_bins, over_full, fill`` of a packing.

    ``least_bins`` is the bound that no packing can beat, ``over_full`` the number of bins above the capacity, ``fill``
    the share of the bins' space that is used.
    """
    capacities = containers.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).dropna().dropDuplicates()
    per_bin = packed.groupBy("container", "bin_id").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("used"), F.sum((F.col("part") == 0).cast("int")).alias("begun"))
    rows = per_bin.join(F.broadcast(capacities), "container")  # the fixed list of containers
    return rows.groupBy("container").agg(
        F.sum("begun").cast("bigint").alias("n_documents"), F.count("*").alias("n_bins"), F.ceil(F.sum("used") / F.max("capacity")).cast("bigint").alias("least_bins"),
        F.count_if(F.col("used") > F.col("capacity")).alias("over_full"), (F.sum("used") / F.sum("capacity")).alias("fill"),
    )
