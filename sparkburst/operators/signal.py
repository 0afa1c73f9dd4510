"""Bursts and their spectrograms in long form.

A burst table has (burst_id, i, v), i the sample's place from 0. Frames of ``nperseg``
samples start every nperseg - nperseg // 8 samples; the tail that fills no frame is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .ordered import running_sums

#: Samples of a block of frames, and of a burst that is numbered by one window at most.
SAMPLES = WHOLE = 65_536
#: Samples whose frames are made at once, about.
GROUP = 16_384
TINY = 2.2250738585072014e-308  # fixed value: the least normal double, below which power is not let fall


def event_bursts(events: DataFrame) -> DataFrame:
    """One burst per user: its events' values in order of (ts, event_id), events without a time first.

    Samples of bursts longer than ``WHOLE`` are numbered by ranges of time, so a user with a
    third of all events is no task's alone; the others by a window.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").alias("burst_id"), F.col("value").alias("v"), us.alias("us"), F.coalesce(us, F.lit(-(1 << 62))).alias("_at"), "event_id", F.lit(1).alias("one"))
    rows = rows.where("burst_id is not null")
    long = stored(rows.groupBy("burst_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).select("burst_id"))  # one of WHOLE events at most
    some = not long.isEmpty()
    short = rows.join(F.broadcast(long), "burst_id", "left_anti") if some else rows
    known = short.withColumn("below_one", F.row_number().over(Window.partitionBy("burst_id").orderBy("_at", "event_id")) - 1)
    if some:
        known = known.unionByName(running_sums(rows.join(F.broadcast(long), "burst_id", "left_semi"), ["burst_id"], "_at", ["one"], ("event_id",)))
    return known.select("burst_id", F.col("below_one").cast("int").alias("i"), "v", "us")


def sampling_frequency(bursts: DataFrame) -> DataFrame:
    """Samples a second from each burst's first two times (nanoseconds in ``ns``)."""
    first = bursts.where("i < 2").groupBy("burst_id").agg(F.max(F.when(F.col("i") == 0, F.col("ns"))).alias("a"), F.max(F.when(F.col("i") == 1, F.col("ns"))).alias("b"))
    return first.select("burst_id", (1e9 / F.nullif(F.col("b") - F.col("a"), F.lit(0))).alias("fs"))


def differential(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of two antennas' samples at the same place of the same burst."""
    right = b.select("burst_id", "i", F.col("v").alias("_b"))
    return a.join(right, ["burst_id", "i"]).select("burst_id", "i", (F.col("v") - F.col("_b")).alias("v"))


def periodic_hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frame_power(frames: np.ndarray) -> np.ndarray:
    """One-sided spectrum-scaled power of frames (frames, nperseg), each detrended and windowed: (frames, nperseg // 2 + 1)."""
    nperseg = frames.shape[1]
    window = periodic_hann(nperseg)
    spectrum = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1)
    power = np.abs(spectrum) ** 2 / window.sum() ** 2
    power[:, 1 : (nperseg + 1) // 2] *= 2
    return power


def segment_power(v: np.ndarray, nperseg: int) -> np.ndarray:
    """``frame_power`` of a burst's frames."""
    hop = nperseg - nperseg // 8
    if len(v) < nperseg:
        return np.zeros((0, nperseg // 2 + 1))
    return frame_power(np.lib.stride_tricks.sliding_window_view(v, nperseg)[::hop])


def spectrogram(bursts: DataFrame, nperseg: int = 1024, fs: float = 1.0, block_frames: int | None = None) -> DataFrame:
    """(burst_id, k, m, t, f_log, p_log) for m >= 1, by FFTs over the frames of many bursts at once.

    A burst of any length is cut into blocks of frames (by default of about 65,536 samples);
    a sample where two blocks overlap goes to both. Blocks are dealt to groups of about
    ``GROUP`` samples, so short bursts share a call. Places must have no gaps.
    """
    hop = nperseg - nperseg // 8
    block_frames = block_frames or max(1, SAMPLES // hop)
    span = block_frames * hop

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        burst, block = pd.factorize(frame["burst_id"], use_na_sentinel=False)[0], frame["block"].to_numpy()
        order = np.lexsort((frame["i"].to_numpy(), block, burst))
        burst, block, v = burst[order], block[order], frame["v"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(burst) != 0) | (np.diff(block) != 0)])
        size = np.diff(np.r_[starts, len(v)])
        n = np.where(size >= nperseg, np.minimum((size - nperseg) // hop + 1, block_frames), 0)  # frames of each block
        own, first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(starts, n)
        power = frame_power(v[(first + own * hop)[:, None] + np.arange(nperseg)])[:, 1:]
        bins = power.shape[1]
        k, m = np.repeat(block[first] * block_frames + own, bins), np.tile(np.arange(1, bins + 1), len(own))
        ids = None if key[1] else frame["burst_id"].to_numpy()[order[np.repeat(first, bins)]]
        return pd.DataFrame({"burst_id": ids, "k": k, "m": m, "t": (nperseg / 2 + k * hop) / fs, "f_log": np.log10(m * fs / nperseg), "p_log": np.log10(np.maximum(power.ravel(), TINY))})

    own = F.floor(F.col("i") / span)
    both = F.when((own > 0) & (F.col("i") - own * span < nperseg - hop), F.array(own - 1, own)).otherwise(F.array(own))
    kind = dict(bursts.dtypes)["burst_id"]
    held = stored(bursts.select("burst_id", "i", F.col("v").cast("double").alias("v")))
    group = F.pmod(F.xxhash64("burst_id", "block"), F.lit(max(1, -(-held.count() // GROUP))))
    dealt = held.withColumn("block", F.explode(both)).withColumns({"_group": group, "_none": F.col("burst_id").isNull()})  # nulls apart, so that whole ids stay whole
    return dealt.groupBy("_group", "_none").applyInPandas(run, f"burst_id {kind}, k int, m int, t double, f_log double, p_log double")


def timed_spectrogram(bursts: DataFrame, nperseg: int = 1024) -> DataFrame:
    """Spectrograms of bursts (burst_id, i, v, ns) at their own sampling frequency, with ``fs`` and the first sample's ``ns``.

    Power doesn't depend on the frequency, so frames are made at 1 a second and times and
    frequencies are scaled then. A burst whose first two times are equal or absent has nulls there.
    """
    start = bursts.where("i = 0").select("burst_id", F.col("ns").alias("start_ns"))
    rate = sampling_frequency(bursts).join(start, "burst_id")
    made = spectrogram(bursts.select("burst_id", "i", "v"), nperseg).join(rate, "burst_id")
    return made.withColumns({"t": F.col("t") / F.col("fs"), "f_log": F.col("f_log") + F.log10("fs")})


def roll(cells: DataFrame, shift_m: int, shift_k: int, height: int, width: int) -> DataFrame:
    """Cyclic shift of spectrograms (id, m, k, p) with m and k from 0."""
    return cells.withColumn("m", F.pmod(F.col("m") + shift_m, F.lit(height))).withColumn("k", F.pmod(F.col("k") + shift_k, F.lit(width)))


def align_to_least(cells: DataFrame) -> DataFrame:
    """Crop all spectrograms (id, m, k, p; from 0) to the least height and width among them."""
    shapes = cells.groupBy("id").agg(F.max("m").alias("_h"), F.max("k").alias("_w")).agg(F.min("_h").alias("_h"), F.min("_w").alias("_w"))
    return cells.crossJoin(F.broadcast(shapes)).where("m <= _h and k <= _w").drop("_h", "_w")


def align_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both spectrograms of an id have."""
    return a.join(b.select("id", "m", "k", F.col("p").alias("q")), ["id", "m", "k"])


def smooth(cells: DataFrame, win_h: int, win_w: int) -> DataFrame:
    """Moving average of (id, m, k, p) by win_h x win_w, edges repeated; an even window reaches one further back.

    Separable: one window pass per axis. Repeated edges are weights on the first and last cell.
    """

    def one_axis(df: DataFrame, line: str, along: str, size: int) -> DataFrame:
        back, ahead = size // 2, size - size // 2 - 1
        whole = Window.partitionBy("id", line)
        near = Window.partitionBy("id", line).orderBy(along).rowsBetween(-back, ahead)
        first, last = F.first("p").over(whole.orderBy(along)), F.last("p").over(whole.orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        top = F.max(along).over(whole)
        short_front = F.greatest(F.lit(back) - F.col(along), F.lit(0))
        short_end = F.greatest(F.col(along) + ahead - top, F.lit(0))
        return df.withColumn("p", (F.sum("p").over(near) + first * short_front + last * short_end) / size)

    return one_axis(one_axis(cells, "k", "m", win_h), "m", "k", win_w)


def robust_normalise(cells: DataFrame) -> DataFrame:
    """(p - median) / max(q75 - q25, 1e-6) of each spectrogram."""
    q = cells.groupBy("id").agg(F.percentile("p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    scaled = (F.col("p") - F.col("_q")[1]) / F.greatest(F.col("_q")[2] - F.col("_q")[0], F.lit(1e-6))
    return cells.join(q, "id").withColumn("p", scaled).drop("_q")


def resize(spec: np.ndarray, height: int, width: int, corners: bool = True) -> np.ndarray:
    """Bilinear resize: grids map corner to corner, or (``corners`` false) half-pixel centres."""

    def places(n: int, to: int) -> np.ndarray:
        if corners:
            return np.linspace(0, n - 1, to) if to > 1 else np.zeros(1)
        return np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)

    r, c = places(spec.shape[0], height), places(spec.shape[1], width)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, spec.shape[0] - 1), np.minimum(c0 + 1, spec.shape[1] - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    top = spec[np.ix_(r0, c0)] * (1 - fc) + spec[np.ix_(r0, c1)] * fc
    return top * (1 - fr) + (spec[np.ix_(r1, c0)] * (1 - fc) + spec[np.ix_(r1, c1)] * fc) * fr


def resize_specs(specs: DataFrame, height: int = 64, width: int = 64, corners: bool = False) -> DataFrame:
    """(sample_idx, spec) resized, as arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(spec=[resize(np.array(s.tolist(), float), height, width, corners).tolist() for s in f["spec"]])

    return specs.select("sample_idx", "spec").mapInPandas(run, "sample_idx long, spec array<array<double>>")
