"""Column expressions of the record formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.schemas import DOWN, FEATURES, KS_SEED, TRAIN_SEED, UP


def clean_key(part: Column) -> Column:
    """Key part without dots. Pass text: a number would first be printed, maybe with an exponent."""
    return F.regexp_replace(part, r"\.", "")


def event_key(date: Column, day: Column, period: Column, separator: str = "") -> Column:
    """Event key from date, day and period; null if a part is null.

    Without a separator, parts of varying width can collide; see `quality.key_collisions`.
    """
    parts = [clean_key(date), day, clean_key(period)]
    if not separator:
        return F.concat(*parts)
    return F.concat(parts[0], F.lit(separator), parts[1], F.lit(separator), parts[2])


def legacy_key(key: Column) -> Column:
    """Key as written by a reader that took all-digit keys for numbers: no leading zeros."""
    digits = F.regexp_replace(key, "^0+(?=[0-9])", "")
    return F.when(key.rlike("^[0-9]+$"), digits).otherwise(key)


def encode_label(label: Column, unknown: str = "null") -> Column:
    """UP as 1 and DOWN as 0.

    Any other label becomes null, or 1 (`unknown="up"`, the base training rule), or 0
    (`unknown="down"`, the retraining rule).
    """
    other = {"null": F.lit(None), "up": F.lit(1), "down": F.lit(0)}[unknown]
    return F.when(label == UP, F.lit(1)).when(label == DOWN, F.lit(0)).otherwise(other).cast("int")


def decode_prediction(prediction: Column) -> Column:
    """0 as DOWN, any other number as UP; a missing prediction stays missing."""
    return F.when(prediction == 0, F.lit(DOWN)).when(prediction.isNotNull(), F.lit(UP))


def is_correct(predicted: Column, truth: Column) -> Column:
    """Whether a prediction holds; a missing label counts as an error."""
    return F.coalesce(predicted == truth, F.lit(False))


def is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def feature_array(features: Sequence[str] = FEATURES) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def margin(weights: Sequence[float], intercept: float, features: Sequence[str] = FEATURES) -> Column:
    """Linear score of a row; stays inside generated code."""
    total = F.col(features[0]) * float(weights[0])
    for f, w in zip(features[1:], weights[1:]):
        total = total + F.col(f) * float(w)
    return total + float(intercept)


def hash_share(key: Column, seed: int = TRAIN_SEED) -> Column:
    """Number in [0, 1) that depends on the key and seed only, not on the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def draw_hash(position: Column, seed: int = KS_SEED) -> Column:
    """60-bit hash of a position."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), position.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
