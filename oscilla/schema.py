"""Schemas of the engine's frames, and the bands and rates that callers usually ask for."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType


def _fields(*pairs) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in pairs])


SAMPLES = _fields(("series_id", LongType), ("ts_us", LongType), ("x", DoubleType), ("y", DoubleType), ("z", DoubleType))
JERK = _fields(("series_id", LongType), ("ts_us", LongType), ("jerk", DoubleType))
SIGNAL = _fields(("series_id", LongType), ("idx", LongType), ("value", DoubleType))
SPEC = _fields(
    ("series_id", LongType), ("seg", IntegerType), ("t_s", DoubleType), ("k", IntegerType), ("freq_hz", DoubleType), ("mag", DoubleType)
)
FEATURES = _fields(
    ("series_id", LongType),
    ("seg", IntegerType),
    ("t_s", DoubleType),
    ("breathing_rate", DoubleType),
    ("heart_rate", DoubleType),
    ("frequency_sum", DoubleType),
    ("breathing_rate_std", DoubleType),
    ("heart_rate_std", DoubleType),
)


class FrequencyRanges:
    """Bands at rest in Hz: breaths (9 to 25 a minute) and beats (30 to 120 a minute)."""

    BR_RESTING_MIN, BR_RESTING_MAX = 0.15, 25 / 60
    HR_RESTING_MIN, HR_RESTING_MAX = 0.5, 2.0
    BREATHING, HEART = (BR_RESTING_MIN, BR_RESTING_MAX), (HR_RESTING_MIN, HR_RESTING_MAX)


class SamplingRates:
    """Usual device rates in Hz."""

    ACCELEROMETER_STANDARD, ACCELEROMETER_HIGH = 50.0, 100.0
