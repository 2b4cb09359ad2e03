"""Problem 7: documents packed into containers of fixed capacity with little room left.

Only the histogram of sizes is solved, at most one row per size up to the
capacity, whatever the number of documents. For each container a configuration
program (patterns of sizes that fit together, each used a whole number of
times) is solved round by round on the counts that are left: the largest size
left must be placed, and a knapsack by dynamic programming prices what fills
the rest of its pattern best, where sizes that are covered least weigh most
(multiplicative weights). Every container comes from such a pattern; nothing is
filled in another way. A size over the capacity is a feasible dual value of the
program, so all tokens over the capacity bound its optimum from below, and the
summary states the gap to that bound. Documents then find their place by joins: the k-th
document of a size goes to the k-th place for that size.

A document beyond the capacity is cut into full containers and a rest; no other
is split. Documents without tokens take no room and lie in container 0.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm import tokens
from labelforge.session import cut_lineage

#: Least number of salts over which the documents of one size are ranked, and documents for each salt beyond that.
SALTS, SALT_ROWS = 64, 200_000
#: Places up to which they are broadcast (32 bytes each); more are joined by a shuffle.
FEW_PLACES = 500_000
#: Steps of the knapsack; a larger capacity is counted in units of several tokens, sizes rounded up.
GRID = 8192
#: Neighbouring sizes are joined into so many classes; the member covered least stands for its class, with its own size.
CLASSES = 64
#: Learning rate of the weights. In the first ROUNDS rounds a pattern takes the part STEP of what it could, then all:
#: each round then uses up a size, so there are at most ROUNDS rounds and one for each size.
RATE, STEP, ROUNDS = 0.05, 0.5, 2000
#: A pattern filled less is priced again by fill alone, with all sizes.
FULL = 0.985


def knapsack(sizes: np.ndarray, prices: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the most valuable pattern that fits, within ``counts``."""
    best = np.zeros(capacity + 1)
    pieces: list[tuple[int, int]] = []
    taken: list[np.ndarray] = []
    for k, (size, price) in enumerate(zip(sizes, prices, strict=True)):
        # 1, 2, 4, ... copies at once, so that few steps allow any number
        left, copies = min(int(counts[k]), capacity // int(size)), 1
        while left > 0:
            copies = min(copies, left)
            room = copies * int(size)
            value = best[: capacity + 1 - room] + copies * price
            better = value > best[room:]
            best[room:] = np.where(better, value, best[room:])
            pieces.append((k, copies))
            taken.append(np.packbits(better))
            left -= copies
            copies *= 2
    pattern = np.zeros(len(sizes), dtype=np.int64)
    room = capacity
    for (k, copies), bits in zip(reversed(pieces), reversed(taken), strict=True):
        at = room - copies * int(sizes[k])
        if at >= 0 and bits[at >> 3] >> (7 - (at & 7)) & 1:
            pattern[k] += copies
            room = at
    return pattern


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns (items per size) with their whole number of uses; together they hold exactly ``counts``.

    ``sizes`` are distinct, ascending, from 1 to ``capacity``.
    """
    unit = -(-capacity // GRID)
    small = -(-sizes // unit)
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []
    while left.any():
        whole = np.zeros(len(sizes), dtype=np.int64)
        largest = np.flatnonzero(left)[-1]
        whole[largest] = 1
        room = (capacity - int(sizes[largest])) // unit
        free = left - whole
        fits = np.flatnonzero((free > 0) & (small <= room))
        if len(fits):
            share = left / counts
            ends = np.linspace(0, len(fits), min(CLASSES, len(fits)) + 1).astype(int)
            least = np.array([fits[a + np.argmax(share[fits[a:b]])] for a, b in zip(ends, ends[1:], strict=False)])
            for at, rate in ((least, RATE), (fits, 0.0)):
                whole[:] = 0
                whole[at] = knapsack(small[at], small[at] * np.exp(rate * (share[at] - 1)), free[at], room)
                whole[largest] += 1
                if whole @ sizes >= FULL * capacity:
                    break
        used = whole > 0
        uses = int((left[used] // whole[used]).min())
        if len(chosen) < rounds:
            uses = max(1, int(STEP * uses))
        left -= uses * whole
        chosen.append((whole, uses))
    return chosen


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the containers of a task: which ranks of a size go to which containers."""
    held = list(frames)
    for name, frame in pd.concat(held).groupby("container") if held else ():
        frame = frame.sort_values("tokens")
        capacity = int(frame["capacity_tokens"].iloc[0])
        sizes, counts = frame["tokens"].to_numpy(dtype=np.int64), frame["n"].to_numpy(dtype=np.int64)
        placed, base, rows = np.zeros(len(sizes), dtype=np.int64), 0, []
        for pattern, uses in solve(sizes, counts, capacity):
            for k in np.flatnonzero(pattern):
                rows.append((name, int(sizes[k]), int(placed[k]), int(placed[k] + pattern[k] * uses), int(pattern[k]), base))
                placed[k] += pattern[k] * uses
            base += uses
        yield pd.DataFrame(rows, columns=["container", "tokens", "first", "last", "each", "base"])


def items(documents: DataFrame, limits: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``container, capacity_tokens, doc_id, part, tokens``: documents, and parts of those beyond a capacity."""
    sized = documents.select("doc_id", tokens.token_count(F.col("text"), vocabulary).alias("size"))
    kinds = limits.where("capacity_tokens > 0").select(F.struct("container", "capacity_tokens").alias("kind")).distinct().agg(F.collect_list("kind").alias("kinds"))
    one = F.lit(1).alias("one")
    # pack_limits is a fixed list; it becomes one array beside every document
    each = sized.select("*", one).join(F.broadcast(kinds.select("kinds", one)), "one").select("doc_id", "size", F.explode("kinds").alias("kind")).select("kind.container", "kind.capacity_tokens", "doc_id", "size")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens"))).cast("int")
    cut = each.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.select("container", "capacity_tokens", "doc_id", "part", F.greatest(F.lit(0), F.least(F.col("capacity_tokens").cast("bigint"), F.col("size") - F.col("part").cast("bigint") * F.col("capacity_tokens"))).cast("bigint").alias("tokens"))


def pack(documents: DataFrame, limits: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``container, capacity_tokens, bin, doc_id, part, tokens``: where every document or part lies.

    Repeated documents are packed as often as they occur.
    """
    numbered = cut_lineage(items(documents, limits, vocabulary))
    # a size may hold any part of all documents, so salts grow with their number
    salts = max(SALTS, -(-numbered.count() // SALT_ROWS))
    numbered = numbered.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    solid = numbered.where("tokens > 0")
    key = ["container", "tokens"]
    per_salt = solid.groupBy("container", "capacity_tokens", "tokens", "salt").agg(F.count("*").alias("n"))
    histogram = per_salt.groupBy("container", "capacity_tokens", "tokens").agg(F.sum("n").alias("n"))
    # pack_limits is a fixed list; each container's program is a task of its own
    names = [r["container"] for r in limits.select("container").distinct().collect()]
    task = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("container")), F.lit(0)).cast("int")
    spread = histogram.withColumn("task", task).repartitionById(len(names) + 1, "task").drop("task")
    places = spread.mapInPandas(_places, "container string, tokens bigint, first bigint, last bigint, each bigint, base bigint")
    # the places of a size as one list, so that the join gives each document one row
    places = cut_lineage(places.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("first", "last", "each", "base"))).alias("places")))
    few = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= FEW_PLACES
    # the window holds one row for each salt of a size
    before = per_salt.select(*key, "salt", (F.sum("n").over(Window.partitionBy(*key).orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("doc_id", "part")) - 1
    ranked = solid.withColumn("own", rank).join(before, [*key, "salt"]).withColumn("k", F.col("own") + F.col("before"))
    put = ranked.join(F.broadcast(places) if few else places, key).withColumn("p", F.expr("filter(places, p -> k < p.last)[0]"))
    full = put.select("container", "capacity_tokens", (F.col("p.base") + F.floor((F.col("k") - F.col("p.first")) / F.col("p.each"))).cast("bigint").alias("bin"), "doc_id", "part", "tokens")
    return full.union(numbered.where("tokens = 0").select("container", "capacity_tokens", F.lit(0).cast("bigint").alias("bin"), "doc_id", "part", "tokens"))


def containers(packed: DataFrame) -> DataFrame:
    """Fill of every container."""
    used = packed.groupBy("container", "capacity_tokens", "bin").agg(F.count("*").alias("items"), F.sum("tokens").alias("used_tokens"))
    return used.withColumn("fill", F.round(F.col("used_tokens") / F.col("capacity_tokens"), 6))
