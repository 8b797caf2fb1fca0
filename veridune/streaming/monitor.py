"""Anytime-valid alarm monitor: a bet on calibrated tails, multiplied up per asset, alarm at 1 / (alpha - delta), sticky.

A step whose score is missing or not finite refuses the asset: it is reported and never silently dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bet(score: Column, cutoff: float, bound: float, stake: float = 0.5) -> Column:
    """e = 1 + stake (1[score > cutoff] - bound): mean at most one while the tail is at most ``bound``."""
    return 1.0 + stake * (F.when(score > cutoff, 1.0).otherwise(0.0) - bound)


def eprocess(df: DataFrame, asset: str, t: str, score: str, cutoff: float, bound: float, stake: float = 0.5, alpha: float = 0.05, delta: float = 0.005) -> DataFrame:
    """(asset, steps, log_wealth, high_water, alarm_at, refused): the monitor over a finished table."""
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double")) | (F.abs(F.col(score)) == float("inf"))
    w = Window.partitionBy(asset).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = df.withColumn("__i", F.row_number().over(Window.partitionBy(asset).orderBy(t)))
    x = x.withColumn("__l", F.sum(F.when(bad, 0.0).otherwise(F.log(bet(F.col(score), cutoff, bound, stake)))).over(w))
    x = x.withColumn("__hit", F.col("__l") >= math.log(1 / (alpha - delta)))
    return x.groupBy(asset).agg(F.count(F.lit(1)).alias("steps"), F.max_by("__l", "__i").alias("log_wealth"), F.greatest(F.max("__l"), F.lit(0.0)).alias("high_water"), F.min(F.when(F.col("__hit"), F.col("__i"))).alias("alarm_at"), F.max(bad).alias("refused"))


def simulate(scores: DataFrame, kind: str, pos: str, score: str, cutoff: float, bound: float, streams: int = 200, horizon: int = 80, seed: str = "", alpha: float = 0.05, delta: float = 0.005) -> DataFrame:
    """Per kind: simulated streams, the share the monitor alarms on, and the share a test repeated at every step alarms on.

    scores: (kind, pos from 0 without gaps, score).  Step t of stream s takes the row that an md5 of seed, kind, s and t names.
    The repeated test alarms where, at some step, more than bound t + 1.645 sqrt(bound (1 - bound) t) scores so far exceed the cutoff.
    """
    n = scores.groupBy(kind).agg(F.count(F.lit(1)).alias("__n"))
    spark = scores.sparkSession
    steps = spark.range(streams * horizon).select((F.col("id") / horizon).cast("long").alias("__s"), (F.col("id") % horizon).alias("__t")).join(F.broadcast(n))  # n: a row a kind
    h = F.md5(F.concat_ws("/", F.lit(seed), F.col(kind), F.col("__s").cast("string"), F.col("__t").cast("string")))
    drawn = steps.withColumn("__pos", F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.col("__n"))
    x = drawn.join(scores.select(kind, F.col(pos).alias("__pos"), F.col(score).alias("__v")), [kind, "__pos"])
    x = x.select(kind, "__s", "__t", "__v", F.struct(kind, "__s").alias("__stream"))
    bets = eprocess(x, "__stream", "__t", "__v", cutoff, bound, alpha=alpha, delta=delta).select(F.col(f"__stream.{kind}").alias(kind), F.col("alarm_at").isNotNull().alias("__a"))
    w = Window.partitionBy("__stream").orderBy("__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.col("__t") + 1
    fixed = x.withColumn("__k", F.sum((F.col("__v") > cutoff).cast("long")).over(w)).groupBy(kind, "__s").agg(F.max(F.col("__k") > bound * t + 1.645 * F.sqrt(bound * (1 - bound) * t)).alias("__r"))
    a = bets.groupBy(kind).agg(F.count(F.lit(1)).alias("streams"), F.avg(F.col("__a").cast("int")).alias("monitor_alarms"))
    return a.join(fixed.groupBy(kind).agg(F.avg(F.col("__r").cast("int")).alias("repeated_alarms")), kind)


def stream_monitor(events: DataFrame, asset: str, t: str, score: str, cutoff: float, bound: float, stake: float = 0.5, alpha: float = 0.05, delta: float = 0.005) -> DataFrame:
    """The same over a stream: one row an asset and micro-batch with its state so far; rows of a batch are taken by t."""
    bar = math.log(1 / (alpha - delta))
    kind = events.schema[asset].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, wealth, high, alarm, refused = state.get if state.exists else (0, 0.0, 0.0, 0, False)
        for s in pd.concat(list(frames)).sort_values("t")["score"]:
            n += 1
            if s is None or not math.isfinite(s):
                refused = True
                continue
            wealth += math.log(1 + stake * ((s > cutoff) - bound))
            high = max(high, wealth)
            if not alarm and wealth >= bar:
                alarm = n
        state.update((n, wealth, high, alarm, refused))
        yield pd.DataFrame({"asset": [key[0]], "steps": [n], "log_wealth": [wealth], "high_water": [high], "alarm_at": [alarm or None], "refused": [refused]})

    src = events.select(F.col(asset).alias("asset"), F.col(t).cast("double").alias("t"), F.col(score).cast("double").alias("score"))
    return src.groupBy("asset").applyInPandasWithState(
        step, f"asset {kind}, steps long, log_wealth double, high_water double, alarm_at long, refused boolean", "n long, w double, h double, a long, r boolean", "update", GroupStateTimeout.NoTimeout
    )


def stream_replays(seals: DataFrame, key: str, seq: str, nonce: str, arrived: str, horizon: str | None = None) -> DataFrame:
    """(key, seq, nonce, problem) of seals as they arrive: nonces seen before under any key, and numbers not above their key's greatest so far.

    State: a number for each nonce and each key; rows of a batch are taken by ``arrived``.  A nonce
    is forgotten once it hasn't been seen for ``horizon`` (such as '30 days'; None: never).  A seal with both problems gives both rows.
    """
    kind = seals.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if horizon else GroupStateTimeout.NoTimeout

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        high, out, is_nonce = state.get[0] if state.exists else None, [], of[0] == "nonce"
        for r in pd.concat(list(frames)).sort_values("arrived", kind="stable")[["key", "seq", "nonce"]].itertuples(index=False):
            if high is not None and (is_nonce or r.seq <= high):
                out.append((*r, "replayed_nonce" if is_nonce else "stale_sequence"))
            high = int(r.seq) if high is None else max(high, int(r.seq))
        state.update((high,))
        if horizon and is_nonce:
            state.setTimeoutDuration(horizon)
        yield pd.DataFrame(out, columns=["key", "seq", "nonce", "problem"])

    src = seals.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(nonce).cast("string").alias("nonce"), F.col(arrived).alias("arrived"))
    # one stateful step is allowed on a stream: a seal goes to its nonce and to its key
    ends = F.inline(F.array(F.struct(F.lit("nonce").alias("what"), F.col("nonce").alias("value")), F.struct(F.lit("key").alias("what"), F.col("key").cast("string").alias("value"))))
    return src.select("*", ends).groupBy("what", "value").applyInPandasWithState(step, f"key {kind}, seq long, nonce string, problem string", "high long", "append", timeout)
