"""Problem 8: filling containers of fixed capacity with whole items.

Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver. There the configuration linear
program (how often to use each way of filling one container) is solved by multiplicative weights: each round prices
all lengths (lengths covered less than the others weigh more), a knapsack dynamic program gives the greatest worth
of each capacity, and fillings of nearly that worth are read off its table and used for a small share of the items.
The prices of each round, divided by the greatest worth, are a solution of the dual program, whose value is a bound
below which no packing is possible.

The fractional solution is rounded to whole containers in one sweep over its fillings, which keeps the sum of any
stretch of them. Items, longest first, then take the least slot of the containers that they fit in; the items left
over, and those of the emptiest tenth at most of the containers, are filled best fit decreasing, first into the gaps. The plan's size depends on the capacity and the number of
rounds, not on the number of items.

The items are then numbered within each length, by partition offsets and a count inside each partition, and look up
their container in the plan. No length, however common, is gathered in one task.

Items over the capacity are cut into full containers and a rest, which is placed like any item. Items of size 0 or
null are left out. Ids must be unique.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.session import cut


@dataclass(frozen=True)
class Plan:
    """``fillings[i]`` (length -> items) is used ``times[i]`` times; containers are numbered in that order."""

    fillings: list[dict[int, int]]
    times: list[int]

    @property
    def containers(self) -> int:
        return sum(self.times)


@dataclass(frozen=True)
class Solution:
    """Fractional ``use`` of fillings, keyed by sorted (length, items), and a lower ``bound`` on the number of containers."""

    use: dict[tuple[tuple[int, int], ...], float]
    bound: float


def greatest_worth(worth: np.ndarray, capacity: int) -> np.ndarray:
    """Greatest worth of a filling of each capacity; ``worth[l]``: of one item of length l, minus infinity if there is none."""
    best = np.zeros(capacity + 1)
    lo = int(np.argmax(worth > -np.inf)) if (worth > -np.inf).any() else capacity + 1
    for c in range(lo, capacity + 1):
        best[c] = max(best[c - 1], (worth[lo : c + 1] + best[: c - lo + 1][::-1]).max())
    return best


def _filling(worth: np.ndarray, best: np.ndarray, supply: np.ndarray, wanted: np.ndarray, capacity: int, slack: float, rng: np.random.Generator) -> tuple[dict[int, int], float]:
    """A filling of about the greatest worth, read off its table at random, lengths in proportion to ``wanted``; and its worth."""
    f: dict[int, int] = {}
    room, value = capacity, 0.0
    while room > 0:
        v = worth[1 : room + 1] + best[:room][::-1]
        for l, k in f.items():
            if l <= room and k >= supply[l]:
                v[l - 1] = -np.inf
        top = v.max()
        if top <= 0:
            break
        fit = np.flatnonzero(v >= top - slack * best[capacity])
        chance = np.cumsum(wanted[fit + 1])
        l = int(fit[min(np.searchsorted(chance, rng.random() * chance[-1], "right"), len(fit) - 1)]) + 1
        f[l] = f.get(l, 0) + 1
        value += worth[l]
        room -= l
    return f, value


def _classes(supply: np.ndarray, most: int) -> np.ndarray:
    """Class of each length: neighbouring lengths of about the same total size together, each length alone where there are few."""
    lengths = np.flatnonzero(supply)
    out = np.zeros(len(supply), np.int64)
    if len(lengths) <= most:
        out[lengths] = np.arange(len(lengths))
    else:
        size = np.cumsum(supply[lengths] * lengths)
        out[lengths] = np.unique((size * most / size[-1]).astype(np.int64), return_inverse=True)[1]
    return out


def linear_program(histogram: dict[int, int], capacity: int, gap: float = 0.01, runs: int = 2, classes: int = 192, batch: int = 128, slack: float = 0.001, loose: float = 0.1, seed: int = 7) -> Solution:
    """Fractional covering of all items by fillings, by multiplicative weights, at most ``gap`` above the lower bound.

    A filling is used for a small share of the items of its scarcest class of lengths; a class's weight falls at once
    with its coverage. Every length has a price, its share of the capacity by its class's weight. A table of greatest
    worths serves until a filling read off it is worth less by ``loose``, or ``batch`` are made. A run ends when all
    is covered; the next one begins with the mean prices of the last, with half its share, twice its sharpness and half
    its looseness, until the gap is closed or ``runs`` are made; the best is returned.
    """
    rng = np.random.default_rng(seed)
    length = np.arange(capacity + 1)
    supply = np.zeros(capacity + 1)
    for l, n in histogram.items():
        supply[l] = n
    there = supply > 0
    bound = float((supply * length).sum()) / capacity
    found = Solution({}, bound)
    if not there.any():
        return found
    cls = _classes(supply, classes)
    members = [np.flatnonzero((cls == c) & there) for c in range(int(cls[there].max()) + 1)]
    items = np.array([supply[m].sum() for m in members])
    base, step, sharpness, least = length / capacity, 0.01, 20.0, math.inf
    for _ in range(runs):
        used, left, mean, sum_used, rounds = np.zeros(len(items)), supply.copy(), np.zeros(capacity + 1), 0.0, 0
        use: dict[tuple[tuple[int, int], ...], float] = {}
        worth = np.where(there, base, -np.inf)
        while (left > 0).any():
            # Weights are relative: the least covered class that is still open has 1.
            price = np.where(there, base * np.exp(-sharpness * np.clip(used[cls] - used[cls[left > 0]].min(), -1, 1)), 0.0)
            worth = np.where(left > 0, price, -np.inf)
            best = greatest_worth(worth, capacity)
            before = sum_used
            for i in range(batch):
                f, value = _filling(worth, best, supply, left * length, capacity, slack, rng)
                if not f or (i and value < best[capacity] * (1 - loose)):
                    break
                of: dict[int, int] = {}
                for l, k in f.items():
                    of[cls[l]] = of.get(cls[l], 0) + k
                amount = min(*(step * items[c] / k for c, k in of.items()), *(left[l] / k for l, k in f.items()))
                for l, k in f.items():
                    left[l] -= k * amount
                    if left[l] < 1e-9 * supply[l]:
                        left[l] = 0.0
                        worth[l] = -np.inf
                for c, k in of.items():
                    used[c] += k * amount / items[c]
                    worth[members[c]] *= math.exp(-sharpness * k * amount / items[c])
                key = tuple(sorted(f.items(), reverse=True))
                use[key] = use.get(key, 0.0) + amount
                sum_used += amount
            # The mean of the prices, while all lengths are open and after the weights have settled.
            if worth[there].min() > -np.inf and used.mean() > 0.2:
                mean += price / best[capacity] * (sum_used - before)
            rounds += 1
        if not mean.any():
            mean = price
        bound = max(bound, float((supply * mean).sum()) / greatest_worth(np.where(there, mean, -np.inf), capacity)[capacity])
        total = sum(use.values())
        if total < least:
            least, found = total, Solution(use, bound)
        if least <= (1 + gap) * bound:
            break
        base, step, sharpness, loose = mean / mean.max(), step / 2, sharpness * 2, loose / 2
    return Solution(found.use, bound)


def rounded(solution: Solution, histogram: dict[int, int]) -> tuple[Plan, dict[int, int]]:
    """Whole containers from the fractional solution, and the items that have no slot in them.

    Neighbouring fillings in the order of their lengths share their fractions. Items take the least free slot that they
    fit in, longest items first, so that what is missing of one length is made up by slots of the next ones.
    """
    slots: list[tuple[tuple[tuple[int, int], ...], int]] = []
    total, done = 0.0, 0
    for key, x in sorted(solution.use.items(), reverse=True):
        total += x
        n = math.floor(total + 0.5) - done
        if n > 0:
            slots.append((key, n))
            done += n
    # Runs of equal slots: (filling, which of its items), in the order of filling; each run has one slot a container.
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for i, (key, n) in enumerate(slots):
        place = 0
        for l, k in key:
            for _ in range(k):
                by_length.setdefault(l, []).append((i, place, n))
                place += 1
    filled: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in slots]
    rest: dict[int, int] = {}
    free: list[list[int]] = []
    for l in sorted(set(histogram) | set(by_length), reverse=True):
        # [filling, place, first container, containers]; the shortest slots are last.
        free.extend([i, place, 0, n] for i, place, n in by_length.get(l, ()))
        n = histogram.get(l, 0)
        while n > 0 and free:
            run = free[-1]
            take = min(n, run[3])
            filled[run[0]].setdefault(run[1], []).append((run[2], take, l))
            n -= take
            run[2] += take
            run[3] -= take
            if run[3] == 0:
                free.pop()
        if n > 0:
            rest[l] = n
    fillings: list[dict[int, int]] = []
    times: list[int] = []
    for (_, n), places in zip(slots, filled, strict=True):
        cuts = sorted({0, n, *(at for runs in places.values() for first, k, _ in runs for at in (first, first + k))})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            f: dict[int, int] = {}
            for runs in places.values():
                for first, k, l in runs:
                    if first <= lo < first + k:
                        f[l] = f.get(l, 0) + 1
            fillings.append(f)
            times.append(hi - lo)
    return Plan(fillings, times), rest


def best_fit(histogram: dict[int, int], capacity: int, begun: Plan | None = None) -> Plan:
    """Best fit decreasing, with equal items and equally filled containers handled together; ``begun``: containers that have gaps."""
    room: list[tuple[int, int]] = []
    fillings: list[dict[int, int]] = []
    times: list[int] = []

    def add(f: dict[int, int], n: int, space: int) -> None:
        fillings.append(f)
        times.append(n)
        if space > 0:
            insort(room, (space, len(fillings) - 1))

    for f, n in zip(begun.fillings, begun.times, strict=True) if begun else ():
        add(f, n, capacity - sum(l * k for l, k in f.items()))
    for l in sorted(histogram, reverse=True):
        n = histogram[l]
        while n > 0:
            k = bisect_left(room, (l, -1))
            if k == len(room):
                each = capacity // l
                full, part = divmod(n, each)
                if full:
                    add({l: each}, full, capacity - each * l)
                if part:
                    add({l: part}, 1, capacity - part * l)
                break
            space, i = room.pop(k)
            # Each of these containers takes as many as fit; the last one may take fewer.
            each = min(space // l, n)
            used = min(times[i], n // each)
            times[i] -= used
            n -= used * each
            f = dict(fillings[i])
            if times[i]:
                insort(room, (space, i))
            f[l] = f.get(l, 0) + each
            add(f, used, space - each * l)
    kept = [(f, t) for f, t in zip(fillings, times, strict=True) if t and f]
    return Plan([f for f, _ in kept], [t for _, t in kept])


def emptied(plan: Plan, rest: dict[int, int], capacity: int, share: float) -> tuple[Plan, dict[int, int]]:
    """The plan without its emptiest containers, up to ``share`` of them, and the rest with their items."""
    left, rest, times = int(share * plan.containers), dict(rest), list(plan.times)
    space = [capacity - sum(l * k for l, k in f.items()) for f in plan.fillings]
    for i in sorted(range(len(times)), key=lambda i: -space[i]):
        n = min(left, times[i]) if space[i] else 0
        if not n:
            break
        times[i] -= n
        left -= n
        for l, k in plan.fillings[i].items():
            rest[l] = rest.get(l, 0) + k * n
    return Plan(plan.fillings, times), rest


def configuration_plan(histogram: dict[int, int], capacity: int, most_emptied: float = 0.1) -> Plan:
    """Fillings for all items of the histogram (length -> items, lengths 1..capacity): the rounded linear program, its gaps and rest filled best fit.

    Of the emptiest containers of the program, a share of up to ``most_emptied`` is taken apart for the rest, whichever
    of five shares needs the fewest containers.
    """
    wanted = {l: n for l, n in histogram.items() if n > 0}
    plan, rest = rounded(linear_program(wanted, capacity), wanted)
    tried = []
    for i in range(5):
        kept, loose = emptied(plan, rest, capacity, most_emptied * i / 4)
        tried.append(best_fit(loose, capacity, kept))
    return min(tried, key=lambda p: p.containers)


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 2048) -> DataFrame:
    """``(container, id_col, piece, start, size)``: every item, or piece of an item over the capacity, in its container."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    size = F.col(size_col).cast("long")
    whole = F.floor((size - 1) / capacity)
    cells = items.filter(size > 0).select(F.col(id_col).alias("id"), F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int")), F.array(size - whole * capacity))).alias("piece", "size"))
    # Kept in the shared folder, so that partitions and their order are the same in both uses.
    cells = cut(cells.withColumn("part", F.spark_partition_id()))
    counts = cells.groupBy("part", "size").agg(F.count("*").alias("n"))
    histogram = {int(r["size"]): r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = configuration_plan(histogram, capacity)
    # A length's rows here are one for each partition of the items.
    before = counts.select("part", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            sizes = b.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            values, begin, n = np.unique(sizes[order], return_index=True, return_counts=True)
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - np.repeat(begin, n) + np.repeat(seen[values], n)
            seen[values] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], names=["id", "piece", "size", "part", "rank"])

    numbered = cells.mapInArrow(number, T.StructType([*cells.schema.fields, T.StructField("rank", T.LongType())]))
    # Slots of the plan: of length l, ranks from ``lo`` on are in containers ``base + (rank - lo) // each``.
    slots: list[tuple[int, int, int, int]] = []
    next_rank = dict.fromkeys(histogram, 0)
    base = 0
    for f, t in zip(plan.fillings, plan.times, strict=True):
        for l, k in f.items():
            slots.append((l, next_rank[l], k, base))
            next_rank[l] += t * k
        base += t
    slots.sort()
    span = max(histogram.values(), default=0) + 1
    key = np.array([l * span + lo for l, lo, _, _ in slots], np.int64)
    lo, each, bases = (np.array([s[i] for s in slots], np.int64) for i in (1, 2, 3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            s = np.searchsorted(key, sizes * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(bases[s] + (rank - lo[s]) // each[s]), b.column(0), b.column(1), pa.array(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * capacity), b.column(2)], names=["container", id_col, "piece", "start", "size"])

    ranked = numbered.join(before, ["part", "size"]).select("id", "piece", "size", (F.col("rank") + F.col("before")).alias("rank"))
    kind = dict(cells.dtypes)["id"]
    return ranked.mapInArrow(place, f"container bigint, {id_col} {kind}, piece int, start bigint, size bigint")
