"""From log records to checked rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.columns import is_number
from driftline.schemas import FEATURES, KEY


def decode_json(df: DataFrame, schema: T.StructType, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Fields of a JSON value next to the `keep` columns of its envelope.

    Reading is lenient: text that is no JSON gives nulls, as does a field of the wrong type. The struct is
    unpacked by a generator because filters are not pushed through it: pushed into the projection, every
    condition on a field would parse the text once more.
    """
    return df.select(*keep, F.inline(F.array(F.from_json(F.col(value).cast("string"), schema))))


def reject_reason(key: str = KEY, features: Sequence[str] = FEATURES):
    """Why a row cannot be scored: `no key`, or `bad <features>`; null for a good row."""
    bad = F.array_compact(F.array(*[F.when(~is_number(F.col(f)), F.lit(f)) for f in features]))
    return F.when(F.col(key).isNull(), F.lit("no key")).when(
        F.size(bad) > 0, F.concat(F.lit("bad "), F.array_join(bad, ","))
    )


def split_rejects(
    df: DataFrame, key: str = KEY, features: Sequence[str] = FEATURES
) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and the others with their `reason`."""
    good = df.filter(F.col(key).isNotNull())
    for f in features:
        good = good.filter(is_number(F.col(f)))
    return good, df.withColumn("reason", reject_reason(key, features)).filter("reason is not null")


_NUMBER = "^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def reject_records(df: DataFrame, value: str = "value", key: str = KEY, features: Sequence[str] = FEATURES) -> DataFrame:
    """Records that cannot be scored, as they came, with their `reason`: `not json`, `no key`, `missing <fields>`, `bad type <fields>`.

    A record is parsed once, into a variant that knows which fields there are and of what type. A JSON null is a missing field, and
    a key that is neither text nor number is none. Missing fields are named before those that are no numbers.
    """
    record = F.try_parse_json(F.col(value).cast("string"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("_record", f"$.{name}", "variant"))
    parsed = df.withColumn("_record", record).withColumn("_kinds", F.array(*[kind(name) for name in (key, *features)]))
    kinds = {f: F.col("_kinds")[i] for i, f in enumerate((key, *features))}

    def named(word: str, wrong: Callable[[Column], Column]) -> Column:
        listed = F.array_compact(F.array(*[F.when(wrong(kinds[f]), F.lit(f)) for f in features]))
        return F.when(F.size(listed) > 0, F.concat(F.lit(f"{word} "), F.array_join(listed, ",")))

    absent = lambda k: k.isNull() | (k == "VOID")
    keyed = F.coalesce((kinds[key] == "STRING") | kinds[key].rlike(_NUMBER), F.lit(False))
    reason = F.coalesce(
        F.when(F.col("_record").isNull(), F.lit("not json")),
        F.when(~keyed, F.lit("no key")),
        named("missing", absent),
        named("bad type", lambda k: ~absent(k) & ~k.rlike(_NUMBER)),
    )
    return parsed.withColumn("reason", reason).filter("reason is not null").drop("_record", "_kinds")
