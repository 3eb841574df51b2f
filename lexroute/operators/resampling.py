"""Resampling of evaluation rows, dealt over tasks by rows and by rounds.

Random numbers come from a counter: the number of (seed, stream, round, block, row) is three keyed cubings modulo a
prime, so any task, NumPy and SQL get the same one, and none has to be sent. Rows of a group are ordered, numbered
and cut into blocks of BLOCK rows; a work item is one block and CHUNK rounds. Items give partial sums for each round, which Spark adds up:
what is shuffled grows with the rounds, not with rows times rounds (but where a resample has to be ranked).

Draws with replacement are exact: of the n draws of a round, those that fall into each block are counted first, each block then
draws as many of its rows. A sample of k rows without replacement is the k smallest numbers of a round; their
bound is found from the few numbers around the place where it is expected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.operators import ordering

#: A prime that is 2 modulo 3, so that cubing moves every residue to another place; squares of residues fit into 62 bits.
PRIME = 2147483579
#: First digits of pi, e, the roots of 2, 3 and 5, and the golden ratio.
STEPS = (314159265, 271828182, 141421356, 173205080, 223606797, 161803398)
BLOCK, CHUNK, ROUNDS = 1 << 14, 128, 10_000
#: How far apart the signs and picks of two blocks' first rows are numbered: as the rows themselves.
STRIDE = BLOCK
#: What a number is for.
DEAL, DRAW, SIGN, PICK = 1, 2, 3, 4


def _cube(x):
    return x * x % PRIME * x % PRIME


def keys(seed: int, stream: int, rounds: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three keys of each round."""
    start = _cube((_cube((seed + STEPS[0]) % PRIME) + stream) % PRIME)
    one = _cube((_cube((start + rounds.astype(np.int64) + STEPS[1]) % PRIME) + block + STEPS[2]) % PRIME)
    two = _cube((one + STEPS[3]) % PRIME)
    return one, two, _cube((two + STEPS[4]) % PRIME)


def numbers(seed: int, stream: int, rounds: np.ndarray, block: int, n: int) -> np.ndarray:
    """(rounds, n) whole numbers from 0 to PRIME - 1, as good as evenly spread. Signs and picks are a row's own by its number in the group, so its block's keys are those of block 0."""
    own = stream in (SIGN, PICK)
    x = (np.arange(n, dtype=np.int64) + (block * STRIDE if own else 0))[None, :]
    for k in keys(seed, stream, rounds, 0 if own else block):
        x = _cube((x + k[:, None]) % PRIME)
    return x


def sql(seed: int, stream: int, rounds: str, rows: str) -> str:
    """CTEs that end in u (r, i, u): the same numbers for block 0 (signs and picks: for all blocks); rounds gives r, rows gives r and i (or i alone, for every round)."""
    start = _cube((_cube((seed + STEPS[0]) % PRIME) + stream) % PRIME)
    cube = f"(x * x % {PRIME} * x % {PRIME})"
    return f"""g0 as (select r, ({start} + r + {STEPS[1]}) % {PRIME} as x from ({rounds}) q), g1 as (select r, ({cube} + {STEPS[2]}) % {PRIME} as x from g0), g2 as (select r, {cube} as k1 from g1),
g3 as (select r, k1, (k1 + {STEPS[3]}) % {PRIME} as x from g2), g4 as (select r, k1, {cube} as k2 from g3), g5 as (select r, k1, k2, (k2 + {STEPS[4]}) % {PRIME} as x from g4), g6 as (select r, k1, k2, {cube} as k3 from g5),
u1 as (select r, i, k2, k3, (i + k1) % {PRIME} as x from g6 cross join ({rows}) w), u2 as (select r, i, k3, ({cube} + k2) % {PRIME} as x from u1), u3 as (select r, i, ({cube} + k3) % {PRIME} as x from u2), u as (select r, i, {cube} as u from u3)"""


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


class Sample:
    """Rows of each group in the order of `order` and `payload` (doubles), numbered from 0 and cut into blocks; rows without one of them take no part."""

    def __init__(self, rows: DataFrame, by: list[str], payload: list[str], order: list[str] | None = None, rounds: int = ROUNDS, seed: int = 0):
        self.by, self.rounds, self.seed, self.width = by, rounds, seed, len(payload)
        named = [f"o{k}" for k in range(len(order or []))] + [f"p{k}" for k in range(len(payload))]
        x = rows.dropna(subset=[*(order or []), *payload]).select(ordering.group(by).alias("_g"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order or [])), *(F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(payload)))
        placed, offsets = ordering.prefix(x.groupBy("_g", *named).agg(F.count("*").alias("m")), named, ["m"])
        n = offsets.groupBy("_g").agg(F.sum("m_sum").alias("n"))
        first, end = F.col("m_before"), F.col("m_before") + F.col("m")
        block = lambda p: F.floor(p / BLOCK).cast("int")
        spread = placed.withColumn("_block", F.explode(F.sequence(block(first), block(end - 1))))
        base = F.col("_block").cast("long") * BLOCK
        start = F.greatest(first, base)
        run = F.struct(start.alias("at"), (F.least(end, base + BLOCK) - start).alias("times"), *(f"p{k}" for k in range(self.width)))
        packed = spread.groupBy("_g", "_block").agg(F.array_sort(F.collect_list(run)).alias("runs")).join(n, "_g")  # at most BLOCK runs
        self.blocks = sessions.cut(packed.select("_g", "_block", "n", *(F.transform("runs", _field(c)).alias(c) for c in ("times", *(f"p{k}" for k in range(self.width))))))
        self.n = n

    def items(self, *more: Column) -> DataFrame:
        """One row for each block and CHUNK rounds, dealt over tasks."""
        first = F.explode(F.sequence(F.lit(0), F.lit(self.rounds - 1), F.lit(CHUNK))).alias("first")
        return self._dealt(self.blocks.select("*", first, *more).withColumn("rounds", F.sequence("first", F.least(F.col("first") + CHUNK, F.lit(self.rounds)) - 1)))

    def _dealt(self, items: DataFrame) -> DataFrame:
        width = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return items.repartition(width, "_g", "_block", "first")

    def run(self, items: DataFrame, work: Callable, columns: str, extra: tuple[str, ...] = ()) -> DataFrame:
        """(_g, round, columns): work(rounds, block, n, values (payload, rows), {extra: array or number}) gives one array for each column, with a row for each round, or also the rounds."""
        width, names = self.width, [c.split()[0] for c in columns.split(", ")]

        def batches(source) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for k in range(batch.num_rows):
                    get = lambda c: batch.column(c)[k]  # noqa: B023, E731
                    listed = lambda c: get(c).values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    times = listed("times")
                    values = np.array([np.repeat(listed(f"p{j}"), times) for j in range(width)])
                    more = {c: listed(c) if pa.types.is_list(batch.column(c).type) else get(c).as_py() for c in extra}
                    rounds = listed("rounds").astype(np.int64)
                    out = work(rounds, get("_block").as_py(), get("n").as_py(), values, more)
                    if "round" in out:
                        rounds = out.pop("round")
                    rows = [c if isinstance(c, pa.Array) else pa.array(c) for c in out.values()]
                    for a in range(0, len(rounds), 1 << 16):
                        part = slice(a, a + (1 << 16))
                        size = len(rounds[part])
                        group = batch.column("_g").take(pa.array(np.full(size, k)))
                        yield pa.RecordBatch.from_arrays([group, pa.array(rounds[part].astype(np.int32)), *(r[part] for r in rows)], ["_g", "round", *names])

        kind = f"_g {items.schema['_g'].dataType.simpleString()}, round int, {columns}"
        return items.select("_g", "_block", "n", "rounds", "times", *(f"p{j}" for j in range(width)), *extra).mapInArrow(batches, kind)

    def drawn(self, *more: str) -> DataFrame:
        """Items with, for each round, how many of the group's n draws fall into the block: `draws`; blocks without any leave that round."""
        seed = self.seed

        def deal(rounds, block, n, values, more):
            size = values.shape[1]
            to = numbers(seed, DEAL, rounds, block, size) * n // PRIME // BLOCK
            each, times = np.unique(to + np.arange(len(rounds))[:, None] * (1 << 32), return_counts=True)
            return {"round": rounds[each >> 32], "_block": (each & ((1 << 32) - 1)).astype(np.int32), "draws": times}

        lone = self.items().filter(F.col("n") <= BLOCK).withColumn("draws", F.transform("rounds", lambda _: F.col("n")))  # all draws fall into the only block
        many = self.items().filter(F.col("n") > BLOCK)
        dealt = self.run(many, deal, "_block int, draws long").groupBy("_g", "_block", "round").agg(F.sum("draws").alias("draws"))
        packed = dealt.groupBy("_g", "_block", (F.col("round") - F.col("round") % CHUNK).alias("first")).agg(F.array_sort(F.collect_list(F.struct("round", "draws"))).alias("x"))
        far = self._dealt(self.blocks.join(packed, ["_g", "_block"]).withColumns({"rounds": F.transform("x", _field("round")), "draws": F.transform("x", _field("draws"))}))
        return lone.select(*far.drop("x").columns).union(far.drop("x"))

    def _draw(self):
        seed = self.seed

        def draw(rounds, block, draws, size):
            """Rows drawn in each round, and which of them count."""
            most = int(draws.max())
            return numbers(seed, DRAW, rounds, block, most) * size // PRIME, np.arange(most)[None, :] < draws[:, None]

        return draw

    def sums(self) -> DataFrame:
        """(_g, round, s0, s1..., n): sums of the payload over n rows drawn with replacement."""
        draw, width = self._draw(), self.width

        def work(rounds, block, n, values, more):
            at, on = draw(rounds, block, more["draws"], values.shape[1])
            return {f"s{j}": np.where(on, values[j][at], 0.0).sum(1) for j in range(width)}

        out = self.run(self.drawn(), work, ", ".join(f"s{j} double" for j in range(width)), ("draws",))
        return out.groupBy("_g", "round").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(width))).join(self.n, "_g")

    def resamples(self) -> DataFrame:
        """(_g, round, p0, p1..., w): the rows of each resample, equal ones together. Rows times rounds: for what has to be ranked."""
        draw, width = self._draw(), self.width

        def work(rounds, block, n, values, more):
            at, on = draw(rounds, block, more["draws"], values.shape[1])
            place = (np.arange(len(rounds))[:, None] * BLOCK + at)[on]
            each, times = np.unique(place, return_counts=True)
            return {"round": rounds[each // BLOCK]} | {f"p{j}": values[j][each % BLOCK] for j in range(width)} | {"w": times}

        cols = [f"p{j}" for j in range(width)]
        out = self.run(self.drawn(), work, ", ".join(f"{c} double" for c in cols) + ", w long", ("draws",))
        return out.groupBy("_g", "round", *cols).agg(F.sum("w").alias("w"))

    def medians(self) -> DataFrame:
        """(_g, round, median) of rows drawn with replacement, by the first payload column (and no order)."""
        draw = self._draw()
        items = self.drawn()
        counts = items.select("_g", "_block", "n", "first", F.explode(F.arrays_zip("rounds", "draws")).alias("x")).select("_g", "_block", "n", "first", F.col("x.rounds").alias("round"), F.col("x.draws").alias("draws"))
        upto = Window.partitionBy("_g", "round").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        cut = counts.withColumn("before", F.coalesce(F.sum("draws").over(upto), F.lit(0)))
        places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
        held = cut.withColumn("places", F.filter(F.transform(places, lambda p: p - F.col("before")), lambda p: (p >= 0) & (p < F.col("draws")))).filter(F.size("places") > 0)
        wanted = held.groupBy("_g", "_block", "first").agg(F.array_sort(F.collect_list(F.struct("round", "draws", "places"))).alias("x"))
        parts = {"rounds": _field("round"), "draws": _field("draws"), "low": lambda v: v["places"][0], "high": lambda v: F.element_at(v["places"], -1), "both": lambda v: F.size(v["places"])}
        each = wanted.select("_g", "_block", "first", *(F.transform("x", f).alias(c) for c, f in parts.items()))

        def work(rounds, block, n, values, more):
            at, on = draw(rounds, block, more["draws"], values.shape[1])
            at = np.sort(np.where(on, at, BLOCK), axis=1)
            row = np.arange(len(rounds))
            low, high = values[0][at[row, more["low"]]], values[0][at[row, more["high"]]]
            return {"s": np.where(more["both"] == 2, low + high, low), "k": more["both"].astype(np.int64)}

        found = self.run(self._dealt(self.blocks.join(each, ["_g", "_block"])), work, "s double, k long", ("draws", "low", "high", "both"))
        return found.groupBy("_g", "round").agg((F.sum("s") / F.sum("k")).alias("median"))

    def flips(self) -> DataFrame:
        """(_g, round, s0, n): sums of the first payload column under random signs."""
        seed = self.seed

        def work(rounds, block, n, values, more):
            signs = (numbers(seed, SIGN, rounds, block, values.shape[1]) & 1) * 2.0 - 1
            return {"s0": signs @ values[0]}

        return self.run(self.items(), work, "s0 double").groupBy("_g", "round").agg(F.sum("s0").alias("s0")).join(self.n, "_g")

    def picked(self, wanted: DataFrame) -> DataFrame:
        """(_g, round, s0, s1..., k, n): sums over k rows drawn without replacement; wanted has (_g, k)."""
        seed, width = self.seed, self.width
        items = self.items().join(wanted.select("_g", "k"), "_g")

        def places(block, size):
            return np.arange(size, dtype=np.int64) + block * BLOCK

        def around(deviations):
            def work(rounds, block, n, values, more):
                u, k = numbers(seed, PICK, rounds, block, values.shape[1]), more["k"]
                reach = deviations * (k * max(0, n - k) / n) ** 0.5 + 40 if deviations else n
                low, high = PRIME * (k - reach) / n, PRIME * (k + reach) / n
                inside = (u >= low) & (u <= high)
                near = np.split(((u << 32) + places(block, u.shape[1]))[inside], np.cumsum(inside.sum(1))[:-1])
                return {"below": (u < low).sum(1), "near": pa.array(list(near), pa.list_(pa.int64()))}

            return work

        def bounds(items, deviations):
            """(_g, round, bound): the k-th smallest number and place, null where it isn't among those looked at."""
            seen = self.run(items, around(deviations), "below long, near array<long>", ("k",)).groupBy("_g", "round").agg(F.sum("below").alias("below"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
            at = F.least(F.col("k"), F.col("n")) - F.col("below")
            bound = F.when(F.col("k") <= 0, F.lit(-1).cast("long")).when((at >= 1) & (at <= F.size("near")), F.get("near", (at - 1).cast("int")))
            return seen.join(self.n, "_g").join(wanted.select("_g", "k"), "_g").select("_g", "round", bound.alias("bound"))

        found = sessions.cut(bounds(items, 10.0))
        missed = found.filter("bound is null").select("_g", "round")
        if not missed.isEmpty():  # beyond ten deviations: all numbers of such rounds
            again = missed.groupBy("_g", (F.col("round") - F.col("round") % CHUNK).alias("first")).agg(F.collect_list("round").alias("rounds"))
            found = found.filter("bound is not null").union(bounds(items.drop("rounds").join(again, ["_g", "first"]), 0.0))
        packed = found.groupBy("_g", (F.col("round") - F.col("round") % CHUNK).alias("first")).agg(F.array_sort(F.collect_list(F.struct("round", "bound"))).alias("x"))
        ready = items.drop("rounds").join(packed, ["_g", "first"]).withColumns({"rounds": F.transform("x", _field("round")), "bounds": F.transform("x", _field("bound"))})

        def work(rounds, block, n, values, more):
            u = numbers(seed, PICK, rounds, block, values.shape[1])
            on = (u << 32) + places(block, u.shape[1]) <= more["bounds"][:, None]
            return {f"s{j}": np.where(on, values[j][None, :], 0.0).sum(1) for j in range(width)}

        out = self.run(ready, work, ", ".join(f"s{j} double" for j in range(width)), ("bounds",))
        return out.groupBy("_g", "round").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(width))).join(self.n, "_g").join(wanted.select("_g", "k"), "_g")


def interval(statistic: str, confidence: float = 0.95) -> list[Column]:
    """lo and hi of a statistic's values over the rounds."""
    tail = (1 - confidence) / 2
    return [F.percentile(statistic, F.lit(q)).alias(name) for q, name in ((tail, "lo"), (1 - tail, "hi"))]


def ungrouped(df: DataFrame, by: list[str], *columns) -> DataFrame:
    return df.select(*(F.col("_g").getField(c).alias(c) for c in by), *columns)
