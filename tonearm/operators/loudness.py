"""Integrated loudness and loudness range of PCM blocks: K-weighting, then two-stage gating, as ITU-R BS.1770 and EBU Tech 3342 define them.

Blocks of a track's channel pass by in order; the weighting filters are applied by overlap-save convolution with their impulse response,
and what a block needs of those before it is carried along, so blocks of any length give the same result. A task holds a block and that
history, never a track. Gating works on energies of tenths of a second, as DataFrame operations.

Input: track, channel (from 0), block (order), rate (samples a second), samples (array of numbers from -1 to 1). Null samples count as silence; a block
without samples adds nothing; a track without a rate, or shorter than the window, has null loudness.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the standard: the analogue prototypes behind both filters, gates, windows in tenths of a second, and the offset.
SHELF_HZ, SHELF_DB, SHELF_Q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773
OFFSET, ABSOLUTE, RELATIVE, RANGE_RELATIVE = -0.691, -70.0, -10.0, -20.0
MOMENT, SHORT = 4, 30
#: Channels beyond the third, but for the fourth (low frequencies, left out), are surrounds.
SURROUND = 1.41
#: Seconds after which the filters' response is below 1e-16 of its start.
RESPONSE = 0.35


def biquads(rate: float) -> list[tuple[list[float], list[float]]]:
    """The shelf and the high pass for a sample rate: numerator and denominator each."""
    k = math.tan(math.pi * SHELF_HZ / rate)
    high = 10 ** (SHELF_DB / 20)
    band = high**0.4996667741545416
    a0 = 1 + k / SHELF_Q + k * k
    shelf = ([(high + band * k / SHELF_Q + k * k) / a0, 2 * (k * k - high) / a0, (high - band * k / SHELF_Q + k * k) / a0], [1, 2 * (k * k - 1) / a0, (1 - k / SHELF_Q + k * k) / a0])
    k = math.tan(math.pi * PASS_HZ / rate)
    a0 = 1 + k / PASS_Q + k * k
    return [shelf, ([1, -2, 1], [1, 2 * (k * k - 1) / a0, (1 - k / PASS_Q + k * k) / a0])]


def filtered(x: list[float], rate: float) -> list[float]:
    """Both filters by their recursion, sample by sample."""
    for b, a in biquads(rate):
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for v in x:
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        x = out
    return x


@functools.lru_cache(16)
def response(rate: int) -> np.ndarray:
    return np.array(filtered([1.0] + [0.0] * int(rate * RESPONSE), rate))


@functools.lru_cache(16)
def spectrum(rate: int, size: int) -> np.ndarray:
    return np.fft.rfft(response(rate), size)


class Weighting:
    """Filters one channel block by block."""

    def __init__(self, rate: int):
        self.h, self.rate = response(rate), rate
        self.past = np.zeros(len(self.h) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        whole = np.concatenate((self.past, x))
        size = 1 << (len(whole) - 1).bit_length()  # what wraps around falls into the past, which is cut off
        y = np.fft.irfft(np.fft.rfft(whole, size) * spectrum(self.rate, size), size)[len(self.past) : len(whole)]
        self.past = whole[len(whole) - len(self.past) :]
        return y


def energies(blocks: DataFrame, in_order: bool = False) -> DataFrame:
    """track, channel, tenth (number of the tenth of a second), squares (sum of the weighted samples' squares) and n (samples in it here).

    in_order: each channel's blocks follow each other in one task already, as where a row or file holds a track; then no samples are shuffled. Blocks that go back are an error.
    """
    track = blocks.schema["track"]
    schema = T.StructType([track, *T._parse_datatype_string("channel int, tenth bigint, squares double, n bigint").fields])
    rows = blocks.where("rate > 0").select("track", F.col("channel").cast("int").alias("channel"), "block", F.col("rate").cast("int").alias("rate"), F.col("samples").cast("array<double>").alias("samples"))
    ordered = rows if in_order else rows.repartition("track", "channel").sortWithinPartitions("track", "channel", "block")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        here, weigh, at, last = None, None, 0, None
        for big in batches:
            row, channels, tenths, squares, counts = [], [], [], [], []
            tracks, channel, block, rate = (big.column(c).to_pylist() for c in ("track", "channel", "block", "rate"))
            samples = big.column("samples")
            for i, key in enumerate(zip(tracks, channel, rate)):
                if key != here:
                    here, weigh, at = key, Weighting(key[2]), 0
                elif None not in (block[i], last) and block[i] < last:
                    raise ValueError(f"block {block[i]} after {last}")
                last = block[i]
                x = np.nan_to_num(samples.slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                if not len(x):
                    continue
                y = weigh(x)
                tenth = (np.arange(at, at + len(x)) * 10) // key[2]
                first = np.flatnonzero(np.concatenate(([True], tenth[1:] != tenth[:-1])))
                at += len(x)
                row.append(np.full(len(first), i))
                channels.append(np.full(len(first), key[1], np.int32))
                tenths.append(tenth[first])
                squares.append(np.add.reduceat(y * y, first))
                counts.append(np.diff(np.append(first, len(x))))
            if row:  # one batch for each that came
                out = [big.column("track").take(pa.array(np.concatenate(row))), *(pa.array(np.concatenate(c)) for c in (channels, tenths, squares, counts))]
                yield pa.RecordBatch.from_arrays([o.cast(f.type) for o, f in zip(out, arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def _level(energy):
    return F.when(energy > 0, F.lit(OFFSET) + 10 * F.log10(energy))


def loudness(blocks: DataFrame, in_order: bool = False, tracks: DataFrame | None = None) -> DataFrame:
    """track, integrated (LUFS), loudness_range (LU) and seconds of each track. in_order: see energies. tracks: the tracks, if they are known without their blocks."""
    weight = F.when(F.col("channel") == 3, 0.0).when(F.col("channel") > 3, SURROUND).otherwise(1.0)
    each = energies(blocks, in_order).groupBy("track", "channel", "tenth").agg(F.sum("squares").alias("s"), F.sum("n").alias("n"))
    tenths = each.groupBy("track", "tenth").agg(F.sum(weight * F.col("s") / F.col("n")).alias("z"))
    order = Window.partitionBy("track").orderBy("tenth")

    def windows(size: int, name: str):
        w = order.rowsBetween(1 - size, 0)
        return F.when(F.count("*").over(w) == size, F.avg("z").over(w)).alias(name)

    loud = lambda c: F.when(_level(F.col(c)) > ABSOLUTE, F.col(c))
    # gates are made where a track's tenths lie: a join with them had all tenths sent to each task, as the planner sizes them like the blocks' keys
    whole = Window.partitionBy("track")
    gates = {"gate": _level(F.avg(loud("moment")).over(whole)) + RELATIVE, "range_gate": _level(F.avg(loud("short")).over(whole)) + RANGE_RELATIVE}
    rows = tenths.select("track", windows(MOMENT, "moment"), windows(SHORT, "short")).withColumns(gates)
    gated = lambda c, gate: F.when((_level(F.col(c)) > ABSOLUTE) & (_level(F.col(c)) > F.col(gate)), F.col(c))
    levels = rows.groupBy("track").agg(
        F.round(_level(F.avg(gated("moment", "gate"))), 6).alias("integrated"), F.percentile(_level(gated("short", "range_gate")), F.array(F.lit(0.1), F.lit(0.95))).alias("p"), (F.count("*") / 10).alias("seconds")
    )
    tracks = blocks.select("track").distinct() if tracks is None else tracks.select("track").distinct()
    return tracks.join(levels.hint("merge"), "track", "left").select("track", "integrated", F.round(F.col("p")[1] - F.col("p")[0], 6).alias("loudness_range"), "seconds")
