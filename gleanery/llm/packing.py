"""Problem 9: filling fixed-capacity containers with items.

Method: a configuration linear program over the histogram of lengths. A configuration says how many items of each length share one
container; the program wants the fewest containers whose configurations cover the histogram. It is solved by multiplicative weights:
each length carries a price, a knapsack dynamic program finds the configuration worth most among the items left, it is used a whole number of
times (so the solution is feasible and rounded at every step), and the prices of what it covers fall. When configurations no longer fill their
containers, what is left over is placed by best fit. Prices also bound the optimum from below: their sum over the histogram, divided by
the value of the best configuration, is a dual solution.

The driver only ever sees the histogram (at most capacity rows, whatever the corpus' size). Items get their containers by their number
among items of the same length and by a segment table, so no group of items is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.tokens import count_tokens
from gleanery.operators.ranking import distributed_row_number
from gleanery.session import cut, load

CAPACITY = 2048


def _fill(configuration: np.ndarray, left: np.ndarray, capacity: int) -> None:
    """Use up free room with the largest lengths that still fit."""
    room = capacity - int((configuration * np.arange(1, capacity + 1)).sum())
    while room > 0:
        fits = np.flatnonzero(left[:room] > 0)
        if not len(fits):
            return
        length = int(fits[-1]) + 1
        n = min(room // length, int(left[length - 1]))
        configuration[length - 1] += n
        left[length - 1] -= n
        room -= n * length


def price(weights: np.ndarray, left: np.ndarray, capacity: int, width: int = 96) -> np.ndarray:
    """The configuration worth most of the items left, none beyond their number: knapsack over the `width` lengths of highest price for their length."""
    lengths = np.flatnonzero(left > 0) + 1
    lengths = lengths[np.argsort(-weights[lengths - 1] / lengths, kind="stable")][:width]
    best, pieces, taken = np.zeros(capacity + 1), [], []
    for length in lengths.tolist():
        copies, k = min(int(left[length - 1]), capacity // length), 1
        while copies > 0:  # copies in powers of two
            k = min(k, copies)
            size = k * length
            trial = best[:-size] + k * weights[length - 1]
            better = trial > best[size:] + 1e-12
            best[size:][better] = trial[better]
            pieces.append((length, k, size))
            taken.append(better)
            copies, k = copies - k, 2 * k
    out, room = np.zeros(capacity, np.int64), capacity
    for (length, k, size), better in zip(reversed(pieces), reversed(taken)):
        if room >= size and better[room - size]:
            out[length - 1] += k
            room -= size
    return out


def dual_bound(weights: np.ndarray, histogram: np.ndarray) -> float:
    """Containers that any solution needs, by these prices: no container holds more worth than the best configuration."""
    capacity = len(histogram)
    lengths = np.flatnonzero((histogram > 0) & (weights > 0)) + 1
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, c, side="right")]
        best[c] = max(best[c - 1], (best[c - fit] + weights[fit - 1]).max()) if len(fit) else best[c - 1]
    return float((histogram * weights).sum() / best[capacity]) if best[capacity] > 0 else 0.0


def program(histogram: np.ndarray, rounds: int = 4000, slack: float = 0.001, rate: float = 1.0, learning: float = 0.003, rest: float = 0.05) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, float]:
    """Configurations by multiplicative weights, the items left over, and a lower bound on all containers.

    It ends when a share `rest` of the items is left, when a configuration leaves more than `slack` of its container empty, or after `rounds`.
    """
    capacity = len(histogram)
    kinds, left = np.arange(1, capacity + 1), histogram.astype(np.int64).copy()
    demand, plan = np.maximum(histogram, 1).astype(float), []
    weights, bound = kinds / capacity, float((histogram * kinds).sum() / capacity)
    for done in range(rounds):
        if left.sum() <= rest * histogram.sum():
            break
        for width in (96, 384, capacity):
            config = price(weights, left, capacity, width)
            full = int((config * kinds).sum()) >= capacity * (1 - slack)
            if full:
                break
        if not full:
            break
        held = config > 0
        n = max(1, int((left[held] // config[held]).min() * rate))  # not all at once: prices keep the rest alike in shape
        plan.append((config, n))
        left -= config * n
        weights = (kinds / capacity) * np.exp(learning * (left - histogram) / demand)
        if done == 0:
            bound = max(bound, dual_bound(weights, histogram))
    return plan, left, bound


#: Learning rate and slack of the runs of the program. The plan with the fewest containers is taken; best fit alone competes.
RUNS = ((0.003, 0.001),)


def solve(histogram: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Configurations with the number of containers of each, covering the histogram (index 0: length 1) exactly."""
    plans = [_complete(*program(histogram, rounds, slack, learning=learning)[:2]) for learning, slack in RUNS]
    return min([*plans, _complete([], histogram.astype(np.int64).copy())], key=lambda plan: sum(n for _, n in plan))


def _complete(plan: list[tuple[np.ndarray, int]], left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The rest by best fit, largest first, whole runs of equal containers at once."""
    capacity = len(left)
    while left.any():
        config = np.zeros(capacity, np.int64)
        trial = left.copy()
        first = int(np.flatnonzero(trial)[-1])
        config[first] += 1
        trial[first] -= 1
        _fill(config, trial, capacity)
        held = config > 0
        n = int((left[held] // config[held]).min())
        plan.append((config, n))
        left -= config * n
    return plan


def segments(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, per container, first container): items number first to last of a length go to these containers."""
    rows, container = [], 0
    seen: dict[int, int] = {}
    for config, n in plan:
        for i in np.flatnonzero(config):
            length, per = int(i) + 1, int(config[i])
            first = seen.get(length, 0)
            rows.append((length, first, first + per * n - 1, per, container))
            seen[length] = first + per * n
        container += n
    return rows


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(item, piece_no, start, length, container_id) for each piece of each item.

    An item within the capacity is one piece; a larger one is cut into full pieces and a rest. Pieces of full capacity fill a container
    alone. Items of size 0 or null take no room: one piece of length 0 with container_id null. Repeated items are items of their own; an
    empty table gives an empty result. Which of several items of one length goes where is decided by item, then piece_no.
    """
    sized = items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    pieces = sized.select("item", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    pieces = pieces.select("item", "piece_no", (F.col("piece_no") * capacity).alias("start"), F.least(F.col("size") - F.col("piece_no") * capacity, F.lit(capacity)).alias("length"))
    pieces = cut(pieces, "pieces")
    numbers = np.zeros(capacity, np.int64)
    for r in pieces.where("length > 0").groupBy("length").count().collect():  # at most capacity rows
        numbers[r["length"] - 1] = r["count"]
    alone = int(numbers[capacity - 1])
    numbers[capacity - 1] = 0
    plan = segments(solve(numbers))
    if alone:
        plan.append((capacity, 0, alone - 1, 1, max((p[4] + (p[2] - p[1] + 1) // p[3] for p in plan), default=0)))
    table = items.sparkSession.createDataFrame(plan or [(0, 0, -1, 1, 0)], "length bigint, first bigint, last bigint, per bigint, container bigint")
    numbered = distributed_row_number(pieces.where("length > 0"), ["length"], [F.col("item").asc(), F.col("piece_no").asc()], "number").withColumn("number", F.col("number") - 1)
    placed = numbered.alias("n").join(F.broadcast(table).alias("t"), (F.col("n.length") == F.col("t.length")) & F.col("n.number").between(F.col("t.first"), F.col("t.last")))
    placed = placed.select("n.item", "n.piece_no", "n.start", "n.length", (F.col("t.container") + F.floor((F.col("n.number") - F.col("t.first")) / F.col("t.per"))).cast("bigint").alias("container_id"))
    empty = pieces.where("length = 0").select("item", "piece_no", "start", "length", F.lit(None).cast("bigint").alias("container_id"))
    return placed.unionByName(empty).withColumnRenamed("item", item)


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of CAPACITY tokens for all texts of documents: doc_id, piece_no, start, length, container_id."""
    return pack(count_tokens(load(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens")


QUERIES = {"p9_pack": p9_pack}
