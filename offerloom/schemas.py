"""Declared schemas of the tables the jobs exchange."""

from pyspark.sql import types as T

#: Place of a row in the collection order: run, source, page, position on the page.
ORD = T.StructType(
    [
        T.StructField("run", T.TimestampType()),
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("page_key", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)

RAW_OFFER = T.StructType(
    [
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("page_key", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("code", T.StringType()),
        T.StructField("store_name", T.StringType()),
        T.StructField("store_domain", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("min_spend", T.DoubleType()),
        T.StructField("expiry", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("success_rate", T.DoubleType()),
    ]
)

OFFER = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("norm_code", T.StringType()),
        T.StructField("dup_no", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("min_spend", T.DoubleType()),
        T.StructField("expiry", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("added_at", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("total", T.LongType()),
        T.StructField("worked", T.LongType()),
        T.StructField("last_tested", T.TimestampType()),
        T.StructField("ord", ORD),
    ]
)

STORE = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("ord", ORD),
    ]
)

#: A place in the collection order as published: the run as a time in UTC, then source, page and position.
_PLACE = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("sourceRank", T.IntegerType()),
        T.StructField("page", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)

_DOCUMENT_CODE = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("minSpend", T.DoubleType()),
        T.StructField("expiry", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("url", T.StringType()),
        T.StructField("addedAt", T.StringType()),
        T.StructField("lastSeen", T.StringType()),
        T.StructField(
            "testResults",
            T.StructType(
                [
                    T.StructField("total", T.LongType()),
                    T.StructField("worked", T.LongType()),
                    T.StructField("lastTested", T.StringType()),
                ]
            ),
        ),
        T.StructField("ord", _PLACE),
    ]
)

#: The published nested document. A line has the same shape: one part of one store. Places are the store's and the
#: offer's own; a document without them is in the order of its arrays.
DOCUMENT = T.StructType(
    [
        T.StructField(
            "meta",
            T.StructType(
                [
                    T.StructField("lastUpdated", T.StringType()),
                    T.StructField("totalCodes", T.LongType()),
                    T.StructField("version", T.StringType()),
                    T.StructField("sources", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "stores",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("category", T.StringType()),
                        T.StructField("ord", _PLACE),
                        T.StructField("part", T.IntegerType()),
                        T.StructField("codes", T.ArrayType(_DOCUMENT_CODE)),
                    ]
                ),
            ),
        ),
    ]
)

RUN = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("codesFound", T.LongType()),
        T.StructField("codesAdded", T.LongType()),
        T.StructField("codesUpdated", T.LongType()),
        T.StructField("duration", T.LongType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)
