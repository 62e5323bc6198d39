"""Serving: as-of reads, gates, ranking and checked copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalar import first_true

#: Labels by class, and seconds of ingestion lag that warn and suppress.
LABELS = {"strong_over": "Strong over evidence", "moderate_over": "Moderate over evidence", "mixed": "Mixed evidence", "moderate_under": "Moderate under evidence", "strong_under": "Strong under evidence", "insufficient_evidence": "Insufficient evidence", "unavailable": "Unavailable"}
LAG = (172800, 345600)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, seen: str, value: str) -> DataFrame:
    """For each left row, the latest right value no later than its time (J-08). Both sides meet in one shuffle on
    the keys, and a running last value replaces a range join."""
    from pyspark.sql import Window

    a = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[c for c in left.columns if c not in keys]).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast("timestamp").alias("__s"))
    b = right.select(*keys, F.col(seen).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.col(seen).alias("__s"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__side") == 0, F.struct("__s", "__v")), ignorenulls=True).over(w)
    rows = a.unionByName(b).withColumn("__last", last).where("__side = 1")
    return rows.select(*keys, "__row.*", F.col("__last.__s").alias("observed_at"), F.col("__last.__v").alias("observed"))


def serving_gate(age: Column, most: int = 3600) -> Column:
    return F.when(age.isNull() | (age > most), "suppress").otherwise("serve")


def ingestion_gate(oldest_age: Column, readable: Column) -> Column:
    """Suppress if the oldest unresolved game is over 96 hours back, or its time can't be read (V-03)."""
    return first_true([(~readable, "suppress"), (oldest_age > LAG[1], "suppress")], "serve")


def ranked(rows: DataFrame, score: str, tie: list[str], n: int) -> DataFrame:
    """A report of the top n by size of score, null last (W-10)."""
    return rows.orderBy(F.abs(F.col(score)).desc_nulls_last(), *tie).limit(n)


def labelled(classification: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), classification)


def copy_violations(text: Column, words: list[str], phrases: list[str]) -> Column:
    """Forbidden words (at word boundaries) and phrases (anywhere) in a text, without regard to case (V-10)."""
    low = F.lower(text)
    hit = [F.when(low.rlike(rf"\b{w}\b"), F.lit(w)) for w in words] + [F.when(low.contains(p), F.lit(p)) for p in phrases]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def redacted(rows: DataFrame, grants: dict[str, list[str]], held: set[str]) -> DataFrame:
    """Columns of a capability that isn't held become null (P-14)."""
    hidden = {c for capability, columns in grants.items() if capability not in held for c in columns}
    return rows.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c in hidden else F.col(c) for c in rows.columns])


def restricted(rows: DataFrame, equal: dict, among: dict) -> DataFrame:
    """rows under optional predicates (P-07): equal(column: value, None for any), among(column: frame of that column,
    None for any), the latter as semi-joins."""
    for name, value in equal.items():
        rows = rows if value is None else rows.where(F.col(name) == F.lit(value))
    for name, frame in among.items():
        rows = rows if frame is None else rows.join(frame.select(name), name, "left_semi")
    return rows


def field_names(kind: T.DataType) -> set[str]:
    """Names of all fields at any depth: of structs, in arrays, and in keys and values of maps."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind.fields}.union(*(field_names(f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType)
    if isinstance(kind, T.MapType):
        return field_names(kind.keyType) | field_names(kind.valueType)
    return set()


def projected(rows: DataFrame, allowed: list[str], forbidden: list[str] = ()) -> DataFrame:
    """The allowed columns, in order (P-13). An error if one is missing or forbidden, at any depth of structs, arrays and
    maps."""
    if bad := set(allowed) & set(forbidden):
        raise ValueError(f"forbidden columns: {sorted(bad)}")
    if missing := set(allowed) - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    out = rows.select(*allowed)
    if bad := field_names(out.schema) & set(forbidden):
        raise ValueError(f"forbidden fields: {sorted(bad)}")
    return out
