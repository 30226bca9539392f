"""Explicit schemas: nothing in the engine is inferred."""

from pyspark.sql import types as T

RATINGS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("rating", T.ShortType()),
        T.StructField("rated_on", T.DateType()),
    ]
)

REJECTS = T.StructType(
    [T.StructField("line", T.StringType()), T.StructField("reason", T.StringType())]
)

FACTORS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("prediction", T.DoubleType()),
    ]
)

# A rating as it arrives on a stream: event time plus a tie-breaking sequence.
RATING_EVENTS = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("item_id", T.IntegerType()),
        T.StructField("rating", T.ShortType()),
        T.StructField("rated_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

# Orientation of a ratings table: (own id column, counterpart id column).
SIDES = {"item": ("item_id", "user_id"), "user": ("user_id", "item_id")}


def side_columns(side):
    if side not in SIDES:
        raise ValueError(f"side must be 'user' or 'item', got {side!r}")
    return SIDES[side]
