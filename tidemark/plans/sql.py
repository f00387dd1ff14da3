"""Builds the DuckDB statements that the queries are held against.

The statements restate each operator from its formula, as layers of window expressions over
the same tables.
"""

from __future__ import annotations

KEYS = "PARTITION BY symbol ORDER BY ts"
BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY 1, 2)"""


def over(n: int | None = None, keys: str = KEYS) -> str:
    frame = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else ""
    return f"OVER ({keys}{frame})"


def roll(agg: str, x: str, n: int, keys: str = KEYS) -> str:
    """A full-frame rolling aggregate."""
    return f"(CASE WHEN count({x}) {over(n, keys)} = {n} THEN {agg}({x}) {over(n, keys)} END)"


def quantile(x: str, n: int, p: float) -> str:
    return f"(CASE WHEN count({x}) {over(n)} = {n} THEN quantile_cont({x}, {p}) {over(n)} END)"


def ahead(agg: str, x: str, h: int) -> str:
    w = f"OVER ({KEYS} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"(CASE WHEN count({x}) {w} = {h} THEN {agg}({x}) {w} END)"


def before(agg: str, x: str, n: int) -> str:
    w = f"OVER ({KEYS} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"(CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END)"


def running(agg: str, x: str) -> str:
    return f"{agg}({x}) OVER ({KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {over()}"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INTEGER)"


def statement(layers: list[dict[str, str]], floats: list[str], ints: list[str] = (), where: str = "", base: str = BARS, first: str = "bars", keys: tuple[str, ...] = ("symbol", "ts")) -> str:
    """``WITH`` layers over ``first``, then the keys, floats rounded to six places (ties moved as in the catalogue) and ints."""
    parts, last = [base], first
    for i, layer in enumerate(layers):
        columns = ", ".join(f"{e} AS {n}" for n, e in layer.items())
        parts.append(f"l{i} AS (SELECT *, {columns} FROM {last})")
        last = f"l{i}"
    picks = [*keys, *(f"round(CAST({c} AS DOUBLE) + 1.3e-7, 6) AS {c}" for c in floats), *(f"CAST({c} AS INTEGER) AS {c}" for c in ints)]
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT {', '.join(picks)} FROM {last}" + (f" WHERE {where}" if where else "")


def ema_ctes(base: str, source: str, names: dict[str, tuple[str, int]], out: str) -> str:
    """Recursive steps along the rows of each symbol: exponential averages of non-null columns."""
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, (c, _) in names.items())
    step = ", ".join(f"{2 / (s + 1)!r} * r.{c} + (1 - {2 / (s + 1)!r}) * e.{n}" for n, (c, s) in names.items())
    columns = ", ".join(names)
    return f"""{out}_n AS (SELECT *, row_number() {over()} AS rn FROM {source}),
{out}_e AS (SELECT symbol, rn, {first} FROM {out}_n WHERE rn = 1
  UNION ALL SELECT r.symbol, r.rn, {step} FROM {out}_e e JOIN {out}_n r ON r.symbol = e.symbol AND r.rn = e.rn + 1),
{out} AS (SELECT n.*, {", ".join(f"e.{c}" for c in names)} FROM {out}_n n JOIN {out}_e e USING (symbol, rn))"""


def uniform(seed: int, row: str, sim: str) -> str:
    """The draw of ``tidemark.functions.draws`` for whole numbers from 0."""
    p = 2**31 - 1
    mixed = f"((({row}) % {p} * 48271 + ({sim}) % {p} * 69621 + {seed * 16807}) % {p})"
    once = f"(({mixed} * {mixed} + ({row}) % {p}) % {p})"
    return f"((({once} * {once} + ({sim}) % {p}) % {p}) / {p}::DOUBLE)"


def resample(seed: int, num: str = "num", sims: str = "sims") -> str:
    """``d(model, sim, nth, pick)``: the draws of ``tidemark.operators.simulations``, down its tree of blocks. The statement must be recursive."""
    z = f"sqrt(-2 * ln(1 - {uniform(seed + 11, 'node', 'sim')})) * cos(2 * pi() * {uniform(seed + 12, 'node', 'sim')})"
    return f"""tree(model, n, sim, lo, size, node, k) AS (
      SELECT model, n, sim, CAST(0 AS BIGINT), CAST(pow(2, ceil(log2(ceil(n / 1024.0)))) AS BIGINT), CAST(1 AS BIGINT), n FROM (SELECT DISTINCT model, n FROM {num}), {sims}
      UNION ALL SELECT model, n, sim, lo + side * half, half, 2 * node + side, CASE side WHEN 0 THEN l ELSE k - l END
      FROM (SELECT *, CAST(CASE WHEN b <= 0 THEN k ELSE greatest(0, least(k, floor(k * (a / (a + b)) + {z} * sqrt(greatest(k * (a / (a + b)) * (1 - a / (a + b)) - 1 / 12, 0)) + 0.5))) END AS BIGINT) AS l
        FROM (SELECT *, size // 2 AS half, least(n - lo * 1024, size // 2 * 1024) AS a, greatest(0, least(n - (lo + size // 2) * 1024, size // 2 * 1024)) AS b FROM tree WHERE size > 1)), (SELECT unnest([0, 1]) AS side)
      WHERE (lo + side * half) * 1024 < n),
    leaves AS (SELECT model, n, sim, lo, unnest(range(k)) AS j FROM tree WHERE size = 1),
    d AS (SELECT model, sim, lo * 16384 + j AS nth, lo * 1024 + CAST(floor({uniform(seed, "(lo * 16384 + j)", "sim")} * least(1024, n - lo * 1024)) AS BIGINT) AS pick FROM leaves)"""


def normal_tail(x: str) -> str:
    """1 - Phi(x) by the series of odd powers over double factorials; beyond 8 it is 0 or 1."""
    term = f"exp((2 * k + 1) * ln(abs({x})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))"
    area = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: {term}))"
    return f"(CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 8 THEN 0.0 WHEN {x} < -8 THEN 1.0 ELSE 0.5 - sign({x}) * ({area}) END)"
