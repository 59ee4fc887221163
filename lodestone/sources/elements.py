"""JSON lists and objects, element by element: a bad one costs itself only.

Texts become variants; a list is taken apart and every field is read on its own
and only as what it is, so a field of another type than declared is refused
rather than turned into something.  What is refused is kept with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reasons for which a text or an element is refused.
BROKEN, NO_LIST, NO_OBJECT, WRONG_FIELD = "not JSON", "not a list", "not an object", "field {name} is not {kind}"
#: What schema_of_variant says of values that a field of each type may hold.
KINDS = {
    T.StringType(): "STRING", T.BooleanType(): "BOOLEAN", T.IntegerType(): "BIGINT", T.LongType(): "BIGINT", T.DoubleType(): "BIGINT|DECIMAL.*|DOUBLE",
}


def _field(v: Column, f: T.StructField) -> tuple[Column, Column]:
    """A field's value, null where it is absent, null or refused, and whether it is refused."""
    path = "$." + f.name if f.name.isidentifier() else f"$['{f.name}']"
    raw = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(raw)
    absent = raw.isNull() | F.is_variant_null(raw)
    if isinstance(f.dataType, (T.ArrayType, T.StructType)):
        got = F.try_variant_get(v, path, f.dataType.simpleString())
        fits = got.isNotNull() & F.startswith(kind, F.lit("ARRAY" if isinstance(f.dataType, T.ArrayType) else "OBJECT"))
    else:
        got = F.try_variant_get(v, path, f.dataType.simpleString())
        fits = got.isNotNull() & F.rlike(kind, F.lit(f"^({KINDS[f.dataType]})$"))
    return F.when(~absent & fits, got), ~absent & ~fits


def _read(items: DataFrame, schema: T.StructType, strict: bool) -> tuple[Column, Column]:
    v, values, wrong = F.col("_v"), [], []
    for f in schema:
        got, refused = _field(v, f)
        values.append(got.alias(f.name))
        wrong.append(F.when(refused, F.lit(WRONG_FIELD.format(name=f.name, kind=f.dataType.simpleString()))))
    first = F.coalesce(*wrong) if strict else F.lit(None).cast("string")
    object_ = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.struct(*values), F.when(~F.coalesce(object_, F.lit(False)), F.lit(NO_OBJECT)).otherwise(first)


def lists(texts: DataFrame, schema: T.StructType, text: str = "content", strict: bool = True) -> DataFrame:
    """A row for each element of the JSON lists in a column: the other columns, ord (its place from 0), value (a struct, or null), raw and reason.

    reason is null for a good element.  A text that is not JSON, or no list, makes one row with ord -1; a null text
    makes none.  With strict, a field of another type refuses its element; else that field alone is null.
    """
    others = [c for c in texts.columns if c != text]
    parsed = texts.where(F.col(text).isNotNull()).withColumn("_root", F.try_parse_json(text))
    shape = F.when(F.col("_root").isNull(), F.lit(BROKEN)).when(~F.startswith(F.schema_of_variant("_root"), F.lit("ARRAY")), F.lit(NO_LIST))
    parsed = parsed.withColumn("_shape", shape)
    taken = parsed.where("_shape is null").select(*others, "_root").lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_root").outer())).select(*others, F.col("pos").alias("ord"), F.col("value").alias("_v"))
    value, reason = _read(taken, schema, strict)
    good = taken.select(*others, "ord", value.alias("value"), F.to_json("_v").alias("raw"), reason.alias("reason"))
    good = good.withColumn("value", F.when(F.col("reason").isNull(), F.col("value")))
    bad = parsed.where("_shape is not null").select(*others, F.lit(-1).alias("ord"), F.lit(None).cast(schema).alias("value"), F.col(text).alias("raw"), F.col("_shape").alias("reason"))
    return good.unionByName(bad)


def objects(texts: DataFrame, schema: T.StructType, text: str = "content", strict: bool = False) -> DataFrame:
    """The same for texts that hold one object each: the other columns, value, raw and reason."""
    others = [c for c in texts.columns if c != text]
    parsed = texts.where(F.col(text).isNotNull()).select(*others, F.col(text).alias("raw"), F.try_parse_json(text).alias("_v"))
    value, reason = _read(parsed, schema, strict)
    told = parsed.select(*others, value.alias("value"), "raw", F.when(F.col("_v").isNull(), F.lit(BROKEN)).otherwise(reason).alias("reason"))
    return told.withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).select(*others, "value", "raw", "reason")


def counts(read: DataFrame) -> DataFrame:
    """(reason, n): how many were read, with a null reason, and how many refused for what."""
    return read.groupBy("reason").agg(F.count("*").alias("n"))
