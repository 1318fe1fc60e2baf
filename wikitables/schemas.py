"""Table schemas.  Optional fields are nullable columns; order is carried by ``pos``."""

from __future__ import annotations

from pyspark.sql import types as T

_REF = T.StructType([T.StructField("id", T.StringType())])

RAW_PAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField(
            "body",
            T.StructType([T.StructField("storage", T.StructType([T.StructField("value", T.StringType())]))]),
        ),
        T.StructField(
            "version",
            T.StructType([T.StructField("number", T.IntegerType()), T.StructField("when", T.StringType())]),
        ),
        T.StructField("ancestors", T.ArrayType(_REF)),
        T.StructField(
            "history",
            T.StructType([T.StructField("lastUpdated", T.StructType([T.StructField("when", T.StringType())]))]),
        ),
    ]
)

def _envelope(item: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("space", T.StringType()),
            T.StructField("results", T.ArrayType(item)),
            T.StructField("start", T.LongType()),
            T.StructField("limit", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("_links", T.StructType([T.StructField("next", T.StringType())])),
        ]
    )


# One listing response: a page of results with its offset.
ENVELOPE = _envelope(RAW_PAGE)
ENVELOPE_WITHOUT_BODY = _envelope(T.StructType([f for f in RAW_PAGE.fields if f.name != "body"]))

USER = T.StructType(
    [
        T.StructField("userKey", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("displayName", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)

SIDECAR = T.StructType(
    [
        T.StructField("pageId", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("modifiedDate", T.StringType()),
        T.StructField("downloadedAt", T.StringType()),
    ]
)

PAGE_INDEX = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("modified_at", T.TimestampNTZType()),
        T.StructField("indexed_at", T.TimestampNTZType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("downloaded_version", T.IntegerType()),
        T.StructField("downloaded_at", T.TimestampNTZType()),
    ]
)

META_COLUMNS = ["pos", "id", "title", "version", "parent_id", "modified_at"]
INDEX_COLUMNS = [f.name for f in PAGE_INDEX.fields]
