"""Sentiment columns: keyword scores of texts, titles of pages, breadth, positioning and daily composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, flag, ratio
from tidemark.operators.recursive import ema

FRAMES = Frames()


def keyword_score(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Distinct positive and negative keywords among the lower-cased words of a text, and their balance."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    pos = F.size(F.array_intersect(words, F.array(*map(F.lit, positive))))
    neg = F.size(F.array_intersect(words, F.array(*map(F.lit, negative))))
    out = df.withColumns({"positive_hits": pos, "negative_hits": neg})
    total = F.col("positive_hits") + F.col("negative_hits")
    return out.withColumn("keyword_score", F.when(total > 0, (F.col("positive_hits") - F.col("negative_hits")) / total).otherwise(0.0))


def titles(pages: DataFrame, html: str = "html", most: int = 20, longer_than: int = 10) -> DataFrame:
    """The first titles of each page's html that are longer than ``longer_than`` characters."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<title>(.*?)</title>"), 1)
    return pages.withColumn("titles", F.filter(F.slice(found, 1, most), lambda t: F.length(t) > longer_than))


def contrarian(score: Column, extreme: float = 0.7) -> Column:
    """-1 where a score is extremely high, 1 where it is extremely low, else 0."""
    return F.when(score > extreme, -1).when(score < -extreme, 1).otherwise(0)


def breadth(daily: DataFrame, up: str, down: str, frames: Frames = FRAMES) -> DataFrame:
    """Advance-decline line and ratio, and the McClellan oscillator from adjusted exponential averages."""
    net = F.col(up) - F.col(down)
    out = daily.withColumn("_n", net.cast("double"))
    out = out.withColumns({"ad_ratio": ratio(up, down, EPS), "ad_line": frames.running("_n"), "_x": F.lit(1.0)})
    # an adjusted average is the unadjusted one of the values over that of ones, both started at zero
    out = out.withColumns({"_k": F.row_number().over(frames.window)})
    out = ema(out, {"_e19": ("_n", 19), "_e39": ("_n", 39)})
    first = F.first("_n").over(frames.so_far)
    for n in (19, 39):
        a = 2.0 / (n + 1)
        decay = F.pow(F.lit(1 - a), F.col("_k") - 1)
        # seeded at the first value, the fold holds it with weight decay instead of a * decay
        zero_start = F.col(f"_e{n}") - decay * first * (1 - a)
        out = out.withColumn(f"_a{n}", zero_start / (1 - decay * (1 - a)))
    return out.withColumn("mcclellan", F.col("_a19") - F.col("_a39")).drop("_n", "_x", "_k", "_e19", "_e39", "_a19", "_a39")


def positioning(weekly: DataFrame, net: str, n: int = 52, frames: Frames = FRAMES) -> DataFrame:
    """Change, percentile and z-score of a net position."""
    return weekly.withColumns(
        {
            "position_change": F.col(net) - frames.lag(net),
            "position_percentile": frames.rank_share(net, n),
            "position_zscore": (F.col(net) - frames.mean(net, n)) / (frames.std(net, n) + EPS),
        }
    )


def fear_greed(daily: DataFrame, x: str, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    """A 0 to 100 composite of a level's place in its range and above its mean, and its regimes."""
    low, high = frames.low(x, n), frames.high(x, n)
    place = (F.col(x) - low) / (high - low + EPS)
    strong = flag(F.col(x) > frames.mean(x, n))
    out = daily.withColumn("composite", 100 * (0.7 * place + 0.3 * strong))
    return out.withColumns(
        {
            "fear": flag(F.col("composite") < 25),
            "greed": flag(F.col("composite") > 75),
            "extreme_quantile": flag(F.col(x) > frames.quantile(x, n, 0.9)),
        }
    )


def broadcast_snapshot(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Every bar with the columns of a one-row table of current indices."""
    return bars.join(F.broadcast(snapshot.limit(1)))


def macro_transforms(daily: DataFrame, x: str, year_rows: int = 252, month_rows: int = 21, frames: Frames = FRAMES) -> DataFrame:
    """Level changes of a daily series: year on year, month on month, difference."""
    return daily.withColumns(
        {
            f"{x}_yoy": (ratio(x, frames.lag(x, year_rows)) - 1) * 100,
            f"{x}_mom": (ratio(x, frames.lag(x, month_rows)) - 1) * 100,
            f"{x}_diff": F.col(x) - frames.lag(x),
        }
    )
