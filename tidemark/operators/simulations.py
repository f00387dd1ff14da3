"""Monte Carlo runs over a trade ledger.

Every draw is a function of whole numbers, so runs need no order and no gathering of trades, and any engine finds the
same ones. Tasks hold a few trades and all runs as arrays: sums of each run leave them, never a row for a trade and a run.

A resample with replacement is split, not drawn and joined. The trades of a ledger are numbered and cut into blocks; the
blocks are the leaves of a fixed binary tree. A run draws as many trades as the ledger has, and at each node so many of
its draws go left as a binomial number says. The way from the root to a block takes a number for each level, so the task that
has a block finds for itself how often each run draws from it, and draws within the block only. These draws depend on the block's
number and not on the ledger, so ledgers share them: they are made once for the blocks of one number. For each run they
are counted by trade of the block, and costs' draws added up by trade; a ledger's sums are these counts times its trades, a matrix product. What only some
ledgers draw is added one by one.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.draws import PRIME, Grid, first_draw, places, row_terms, shares, sim_terms, uniform_array
from tidemark.functions.rows import row_numbers

BLOCK = 1024  # trades of a block, at least
ROOM = 1 << 14  # numbers that the draws within a block take
COLUMNS, AT_ONCE = 2500, 20_000  # runs and draws that a task makes at a time: their arrays stay in a core's cache
LEDGERS, RUNS = 8, 32  # ledgers that share a block's draws, and runs that a task draws for at a time, as many draws each as a block has


@dataclass(frozen=True)
class Shocks:
    """What each run changes. The ranges are fixed values."""

    resample: bool = False
    dropout: tuple[float, float] | None = None  # a run's share of missed trades is drawn from this range
    cost: tuple[float, float] | None = None  # largest relative change of slippage and of commission
    seed: int = 42


DROPOUT, COST = (0.0, 0.15), (0.25, 0.10)
BOOTSTRAP = Shocks(resample=True)
MISSED = Shocks(dropout=DROPOUT)
COSTS = Shocks(cost=COST)
COMBINED = Shocks(resample=True, dropout=DROPOUT, cost=COST)


def _normal(seed: int, node: int, sims: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(1 - uniform_array(seed + 11, node, sims))) * np.cos(2 * np.pi * uniform_array(seed + 12, node, sims))


def split(draws: np.ndarray, left: int, right: int, normal: Callable[[], np.ndarray]) -> np.ndarray:
    """How many of each run's ``draws`` fall in the first ``left`` of ``left + right`` trades.

    A normal number of the binomial mean and variance, rounded (the rounding's own variance taken off): nodes split more than
    ``BLOCK`` trades, where the two agree to a fraction of a draw.
    """
    if not right:
        return draws
    p = left / (left + right)
    spread = np.sqrt(np.maximum(draws * p * (1 - p) - 1 / 12, 0))
    return np.clip(np.floor(draws * p + normal() * spread + 0.5), 0, draws).astype(np.int64)


def block_draws(n: int, block: int, seed: int, sims: np.ndarray, normal: Callable[[int, int, np.ndarray], np.ndarray] = _normal) -> np.ndarray:
    """How often each run draws from a block of a ledger of ``n`` trades."""
    size = 1 << (-(-n // BLOCK) - 1).bit_length()
    draws, first, node = np.full(len(sims), n, np.int64), 0, 1
    while size > 1:
        size //= 2
        left = min(n - first * BLOCK, size * BLOCK)
        right = max(0, min(n - (first + size) * BLOCK, size * BLOCK))
        taken = split(draws, left, right, functools.partial(normal, seed, node, sims))
        later = block >= first + size
        draws, first, node = (draws - taken, first + size, 2 * node + 1) if later else (taken, first, 2 * node)
    return draws


Trade = dict[str, np.ndarray]
#: From a grid of draws, what finds from trades' columns their results and which of them count (None: all).
Value = Callable[[Grid], Callable[[Trade], tuple[np.ndarray, np.ndarray | None]]]


def _first_kept(shocks: Shocks, sims: np.ndarray) -> np.ndarray:
    low, high = shocks.dropout
    return first_draw(low + (high - low) * uniform_array(shocks.seed + 3, np.int64(0), sims), above=True)


def _shocked(shocks: Shocks) -> Value:
    """Of trades whose columns are those of :func:`_costs`."""

    def bind(grid: Grid) -> Callable[[Trade], tuple[np.ndarray, np.ndarray | None]]:
        if shocks.dropout:
            first = _first_kept(shocks, grid.sims)

        def value(trade: Trade) -> tuple[np.ndarray, np.ndarray | None]:
            pnl = trade["x"]
            for k in range(1, 1 + len(shocks.cost or ())):
                change = grid.floats(shocks.seed + k)
                np.multiply(change, trade[("slippage", "commission")[k - 1]], out=change)
                pnl = np.subtract(pnl, change, out=change)
            return pnl, grid.reach(shocks.seed + 4, first) if shocks.dropout else None

        return value

    return bind


def _costs(trades: DataFrame, most: tuple[float, float] | None) -> DataFrame:
    """``net_pnl`` at the least costs, ``slippage`` and ``commission`` as what one of the ``PRIME`` steps of a draw adds to them."""
    if not most:
        return trades
    named = {c: F.col(c).cast("double") * F.lit(2 * m / PRIME) for c, m in zip(("slippage", "commission"), most)}
    least = F.col("net_pnl").cast("double")
    for c, m in zip(named, most):
        least = least + F.col(c).cast("double") * F.lit(m * (1 + 2 / PRIME))  # draws in a grid are one step more
    return trades.withColumns(named | {"net_pnl": least})


def _add(mine: np.ndarray, value: np.ndarray, seen: np.ndarray | None, grid: Grid, squares: bool) -> None:
    """Number, sum and, where asked for, sum of squares of the values seen, added to ``mine``."""
    if value.shape[1] < len(grid.sims):  # one value for all runs, of the ledger; else an array of the grid's own
        value, one = grid.buffer("result", np.float64), value
        np.copyto(value, one)
    if seen is None:
        mine[0] += len(value)
    else:
        np.copyto(value, 0, where=np.logical_not(seen, out=grid.buffer("unseen", bool)))
        mine[0] += np.add.reduce(seen.view(np.uint8), axis=0, dtype=np.uint8 if len(seen) < 256 else np.int64)
    mine[1] += np.add.reduce(value, axis=0)
    if squares:
        mine[2] += np.add.reduce(value * value, axis=0)


def _grids(sims: int) -> Iterator[tuple[int, int, Grid, int]]:
    """The runs in parts: first and last of each, its grid and the grid's rows."""
    parts = -(-sims // COLUMNS)
    for i in range(parts):
        first, last = i * sims // parts, (i + 1) * sims // parts
        rows = max(1, AT_ONCE // (last - first))
        yield first, last, Grid(np.arange(first, last), rows), rows


Sums = dict[tuple, np.ndarray]


def _added(parts: DataFrame, keys: tuple[str, ...], work: Callable[[Iterator[pa.RecordBatch], Sums], None], sims: int) -> DataFrame:
    """``keys, sim, n, x, xx``: what ``work`` adds to the moments of each ledger and run from a task's rows, over all tasks."""
    kinds = [parts.schema[k] for k in keys]
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["sim long", "n double", "x double", "xx double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = {}, []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.schema.field(k).type for k in keys]
                yield batch

        work(typed(), sums)
        for key, moments in sums.items():
            columns = [pa.array([v] * sims, t) for v, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(sims)), *map(pa.array, moments)], names=[*keys, "sim", "n", "x", "xx"])

    return parts.mapInArrow(run, shape).groupBy(*keys, "sim").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx")])


def _tasks(df: DataFrame) -> int:
    """More than there are cores, so that none waits long for the last."""
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN


def _keys(batch: pa.RecordBatch, keys: tuple[str, ...]) -> list[tuple]:
    return list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows


def every_trade(trades: DataFrame, columns: dict[str, str], row: str, value: Value, sims: int, keys: tuple[str, ...], squares: bool = False) -> DataFrame:
    """Moments of runs in which each trade occurs once, with the draws of its ``row`` number. Nothing is ordered or joined.

    A trade with a null in one of ``columns`` counts as missed.
    """
    named = trades.select(*keys, F.col(row).cast("long").alias("_row"), *[F.col(c).cast("double").alias(n) for n, c in columns.items()])

    def work(batches: Iterator[pa.RecordBatch], sums: Sums) -> None:
        grids = list(_grids(sims))
        for batch in batches:
            of: dict[tuple, list[int]] = {}
            for i, key in enumerate(_keys(batch, keys)):
                of.setdefault(key, []).append(i)
            ids = batch.column("_row").to_numpy()
            held = {n: _floats(batch.column(n)) for n in columns}
            whole = ~np.any([np.isnan(x) for x in held.values()], axis=0)
            for key, mine in of.items():
                moments = sums.setdefault(key, np.zeros((3, sims)))
                mine = np.array(mine)[whole[mine]]
                for first, last, grid, step in grids:
                    found = value(grid)
                    for start in range(0, len(mine), step):
                        at = mine[start : start + step]
                        grid.at(ids[at])
                        _add(moments[:, first:last], *found({n: x[at][:, None] for n, x in held.items()}), grid, squares)

    return _added(named.repartition(_tasks(trades), "_row"), keys, work, sims)


class Blocks:
    """Moments of all runs' draws from a block, for ledgers whose blocks have the same number and size."""

    def __init__(self, shocks: Shocks, sims: int, squares: bool = False) -> None:
        if squares and shocks.cost:
            raise ValueError("squares are of results without costs' draws")
        self.shocks, self.squares, self.sims = shocks, squares, np.arange(sims)
        self._by_sim = sim_terms(self.sims)
        if shocks.dropout:
            self._kept = ((_first_kept(shocks, self.sims) - 1.0) / PRIME)[:, None]
        # blocks come in order, so most of the way down the tree is that of the block before
        self._normal = functools.lru_cache(64)(lambda seed, node: _normal(seed, node, self.sims))

    def _tables(self, trades: list[Trade], size: int) -> tuple[np.ndarray, np.ndarray]:
        """What a draw of a trade adds: by trade and ledger in turn results, numbers, squares and numbers of endless results of both signs, as far as they are
        needed; and to the results for shares of two costs, whose rows alternate. The last trade is none."""
        wide, names = len(trades), ("slippage", "commission") if self.shocks.cost else ()
        columns, costs = np.zeros((5, size + 1, wide)), np.zeros((size + 1, 2, wide))
        for k, trade in enumerate(trades):
            whole = ~np.any([np.isnan(x) for x in trade.values()], axis=0)
            x = trade["x"] - sum(trade[c] for c in names) / 2  # a share is half a step less than the steps that costs are for
            ends = np.isinf([trade[c] for c in names]).any(axis=0) if names else np.zeros(size, bool)  # no number with any share
            up, down = whole & ((x == np.inf) | ends), whole & ((x == -np.inf) | ends)
            held = whole & ~up & ~down
            x = np.where(held, x, 0)
            columns[:, :size, k] = x, whole, x * x, up, down
            for c, name in enumerate(names):
                costs[:size, c, k] = np.where(held, -PRIME * trade[name], 0)
        used = [0, 1] + [2] * self.squares + [3, 4] * bool(columns[3:].any())
        return np.concatenate(columns[used], axis=1), costs.reshape(-1, wide)

    def moments(self, block: int, ledgers: list[int], trades: list[Trade]) -> np.ndarray:
        """Results, numbers and, where asked for, squares by ledger and run, from the ledgers' lengths and the block's trades in each."""
        size, wide, seed = len(trades[0]["x"]), len(trades), self.shocks.seed
        draws = np.array([block_draws(n, block, seed, self.sims, lambda s, node, _: self._normal(s, node)) for n in ledgers])
        shared, most = draws.min(axis=0), -(-draws.max(axis=0) // 8) * 8
        first, costs = self._tables(trades, size)
        rows = block * ROOM + np.arange(most.max())
        by_row = {k: row_terms(seed + k, rows) for k in (0, *((1, 2) if self.shocks.cost else ()), *((4,) if self.shocks.dropout else ()))}
        if self.shocks.cost:
            both = np.stack([by_row[1], by_row[2]], axis=2).reshape(len(by_row[1]), -1)
        sums = np.zeros((first.shape[1], len(self.sims)))
        held = [np.empty(RUNS * len(rows) * k, kind) for k, kind in ((2, np.float64), (2, np.float64), (1, np.int64), (1, bool))]
        starts = np.arange(RUNS, dtype=np.float64)[:, None] * (size + 1)
        counts, weights = np.empty(RUNS * (size + 1)), np.empty(RUNS * (size + 1), np.complex128)
        for start in range(0, len(self.sims), RUNS):
            at = slice(start, start + RUNS)
            low, length = shared[at], int(most[at].max())
            n = len(low)
            share, spare, place, missed = (x[: n * length].reshape(n, length) for x in held)
            if self.shocks.dropout:
                np.less(shares(self._by_sim[at], by_row[4][:, :length], share, spare), self._kept[at], out=missed)
            else:
                missed[:] = False
            pick = places(shares(self._by_sim[at], by_row[0][:, :length], share, spare), size)
            own = (draws[:, at] - low).ravel()  # draws that not all ledgers have
            some = wide > 1 and own.any()
            if some:
                run = np.repeat(np.arange(wide * n), own)
                cell = np.arange(len(run)) + np.repeat(np.tile(np.arange(n) * length + low, wide) - (np.cumsum(own) - own), own)
                trade, ledger = np.where(missed.ravel()[cell], size, pick.ravel()[cell]).astype(np.int64), run // n
                single = first.reshape(size + 1, -1, wide)[trade, :, ledger]
            least = int(low.min())
            missed[:, least:] |= np.arange(least, length) >= low[:, None]
            np.putmask(pick, missed, size)
            np.add(pick, starts[:n], out=pick)
            np.copyto(place, pick, casting="unsafe")
            place, cells = place.ravel(), n * (size + 1)
            counts[:cells] = 0
            np.add.at(counts, place, 1.0)
            found = counts[:cells].reshape(n, -1) @ first
            if self.shocks.cost:  # two shares are added up at once as the parts of a complex number
                share, spare = (x[: n * length * 2].reshape(n, -1) for x in held[:2])
                two = shares(self._by_sim[at], both[:, : 2 * length], share, spare).view(np.complex128).ravel()
                weights[:cells] = 0
                np.add.at(weights, place, two)
                found[:, :wide] += weights[:cells].view(np.float64).reshape(n, -1) @ costs
                if some:
                    single[:, 0] += two.real[cell] * costs[2 * trade, ledger] + two.imag[cell] * costs[2 * trade + 1, ledger]
            sums[:, at] = found.T
            if some:
                for i, column in enumerate(single.T):
                    sums[i * wide : (i + 1) * wide, at] += np.bincount(run, column, wide * n).reshape(wide, n)
        sums = sums.reshape(-1, wide, len(self.sims))
        if len(sums) > 2 + self.squares:
            *sums, up, down = sums
            with np.errstate(invalid="ignore"):
                sums[0] = sums[0] + np.where(up > 0, np.inf, 0) + np.where(down > 0, -np.inf, 0)
            sums[2:] = [np.where(up + down > 0, np.inf, x) for x in sums[2:]]
        return np.stack(sums)


def resampled(trades: DataFrame, columns: dict[str, str], order: str, shocks: Shocks, sims: int, keys: tuple[str, ...], squares: bool = False) -> DataFrame:
    """Moments of runs that draw as many trades as the ledger has, with replacement. ``order`` numbers the trades and is unique.

    A draw of a trade with a null in one of ``columns`` counts as missed.
    """
    rows = row_numbers(trades.select(*keys, order, *[F.col(c).cast("double").alias(f"_{n}") for n, c in columns.items()]), keys, order, "_nth")
    count = trades.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))  # one row for each ledger
    # ledgers in groups of about LEDGERS, so that no task has the first blocks of all
    groups = F.broadcast(count.agg(F.ceil(F.count(F.lit(1)) / LEDGERS).alias("_groups")))
    count = count.crossJoin(groups).withColumn("_group", F.pmod(F.xxhash64(F.lit(0), *[f"_k_{k}" for k in keys]), "_groups"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    held = F.array_sort(F.collect_list(F.struct("_nth", *[f"_{n}" for n in columns])))  # at most BLOCK trades
    blocks = rows.groupBy(*keys, F.floor(F.col("_nth") / BLOCK).alias("_block")).agg(held.alias("_held")).join(count, same)
    picked = blocks.select(*keys, "_group", "_block", "_n", *[F.col(f"_held._{n}").alias(n) for n in columns])

    def work(batches: Iterator[pa.RecordBatch], sums: Sums) -> None:
        drawn = Blocks(shocks, sims, squares)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, (key, block, n) in enumerate(zip(_keys(batch, keys), batch.column("_block").to_pylist(), batch.column("_n").to_pylist())):
                    trade = {name: _floats(batch.column(name)[i].values) for name in columns}
                    yield (block, len(trade["x"])), key, n, trade

        for (block, _), same in itertools.groupby(rows(), lambda row: row[0]):
            while some := list(itertools.islice(same, LEDGERS)):
                found = drawn.moments(block, [n for _, _, n, _ in some], [trade for *_, trade in some])
                for k, (_, key, _, _) in enumerate(some):
                    moments = sums.setdefault(key, np.zeros((3, sims)))
                    for i, j in enumerate((1, 0, 2)[: len(found)]):
                        moments[j] += found[i, k]

    tasks = picked.repartition(_tasks(trades), "_group", "_block").sortWithinPartitions("_block", "_group", F.size("x"))
    return _added(tasks, keys, work, sims)


def runs(trades: DataFrame, sims: int, shocks: Shocks, keys: tuple[str, ...] = ("model",), id_col: str = "trade_id") -> DataFrame:
    """``sim, net_pnl, trades`` of each run of each ledger.

    Trades need a unique whole number ``id_col``; ``slippage`` and ``commission`` are read for cost shocks only.
    A resample has as many trades as the ledger. Null keys are a ledger of their own; null results count as missed.
    """
    columns = {"x": "net_pnl"} | ({"slippage": "slippage", "commission": "commission"} if shocks.cost else {})
    trades = _costs(trades, shocks.cost)
    if shocks.resample:
        out = resampled(trades, columns, id_col, shocks, sims, keys)
    else:
        numbered = row_numbers(trades.select(*keys, id_col, "net_pnl", *[c for c in columns if c != "x"]), keys, id_col, "_nth")
        out = every_trade(numbered, columns, "_nth", _shocked(shocks), sims, keys)
    return out.select(*keys, "sim", F.when(F.col("n") > 0, F.col("x")).alias("net_pnl"), F.col("n").cast("long").alias("trades"))


def intervals(sims: DataFrame, x: str, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """The middle 95 % of a run's value."""
    return sims.groupBy(*keys).agg(F.percentile(x, F.lit(0.025)).alias("ci_low"), F.percentile(x, F.lit(0.975)).alias("ci_high"))


def sharpe_runs(returns: DataFrame, x: str, sims: int, keys: tuple[str, ...] = ("model",), id_col: str = "date", year: float = 252.0, seed: int = 42) -> DataFrame:
    """``sim, sharpe``: annualised Sharpe ratios of resamples with replacement; ``id_col`` orders the returns."""
    sums = resampled(returns, {"x": x}, id_col, Shocks(resample=True, seed=seed), sims, keys, squares=True)
    mean = F.col("x") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("xx") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.where("n > 0").select(*keys, "sim", (mean / (spread + 1e-10) * F.lit(year**0.5)).alias("sharpe"))
