"""Deterministic sensors: a value is a pure function of time and device seed, so any row can be made anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

DAY, HOUR = 86_400_000, 3_600_000

#: Error codes of the error sensor.
CODES = ("E_OVERHEAT", "E_COMM_LOST", "E_SENSOR_DRIFT", "E_POWER_DIP")

#: The kind of each sensor, in the order in which a tick gives them.
SENSORS = {"temperature": "DOUBLE", "humidity": "DOUBLE", "power_wh": "LONG", "running": "BOOL", "error_code": "STRING"}


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit integers."""
    z = z + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(a.astype(np.int64).view(np.uint64) ^ mix(b.astype(np.int64).view(np.uint64))) >> np.uint64(11)).astype(float) * 2.0**-53


@arrow_udf(DoubleType())
def unit(a: pa.Array, b: pa.Array) -> pa.Array:
    """A number in [0, 1) that hangs on both longs alone, with 53 bits."""
    x, y = (np.atleast_1d(c.to_numpy(zero_copy_only=False)) for c in (a, b))
    return pa.array(uniform(x, y))


def noise(a: Column, b: Column) -> Column:
    return unit(a, b) * 2 - 1


def round1(v: Column) -> Column:
    """Halves go up, below zero too."""
    return F.floor(v * 10 + 0.5) / 10


def soft_clamp(v: Column, lo: float, hi: float) -> Column:
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    return mid + half * F.tanh((v - mid) / half)


def hour(ts: Column) -> Column:
    return (ts % DAY) / float(HOUR)


def wave(x: Column, at: float, length: float) -> Column:
    return F.sin(2 * np.pi * (x - at) / length)


def temperature(ts: Column, seed: Column) -> Column:
    yearly = wave((ts / float(DAY)) % 365, 100, 365)
    return round1(18 + noise(seed, F.lit(0x7E11).cast("long")) * 5 + wave(hour(ts), 9, 24) * 6 + yearly * 8 + noise(ts, seed) * 0.3)


def humidity(ts: Column, seed: Column) -> Column:
    raw = 70 - (temperature(ts, seed) - 18) * 1.2 + wave(hour(ts), 3, 24) * 8 + noise(ts, seed.bitwiseXOR(F.lit(0x5EED).cast("long"))) * 2
    return round1(soft_clamp(raw, 20, 95))


def power_wh(ts: Column, seed: Column) -> Column:
    duty = F.when((hour(ts) >= 8) & (hour(ts) < 20), 1.0).otherwise(0.25)
    spike = F.when(unit(ts, seed.bitwiseXOR(F.lit(0x5A1CE).cast("long"))) < 0.002, 1500.0).otherwise(0.0)
    return F.floor(400 * duty * (0.8 + unit(seed, F.lit(0x9051).cast("long")) * 0.4) + spike + noise(ts, seed) * 20 + 0.5).cast("long")


def running(ts: Column, seed: Column) -> Column:
    """Changes every four hours at most."""
    return unit(F.floor(ts / (4 * HOUR)), seed) < 0.85


def error_code(ts: Column, seed: Column) -> Column:
    u = unit(F.floor(ts / (HOUR // 2)), seed.bitwiseXOR(F.lit(0xE770).cast("long")))
    return F.when(u >= 0.02, "OK").otherwise(F.element_at(F.array(*map(F.lit, CODES)), (F.floor(u * 1000) % len(CODES) + 1).cast("int")))
