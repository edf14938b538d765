"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import _open, remove, saved, saved_at, scratch, shared_dir  # noqa: F401

#: Bytes of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_hash(docs: DataFrame) -> Column:
    """Of doc_id and text: rows that repeat an id stay apart unless their texts are equal."""
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text under names that clash with nothing, with the hash of the row."""
    return docs.select(docs["doc_id"].alias("_id"), row_hash(docs).alias("_h"), docs["text"].alias("_text"))


def packed(docs: DataFrame) -> DataFrame:
    """The whole rows as one column _row beside those of keyed(): what an operator
    adds can't clash with the caller's columns, which come back as _row.*."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs["doc_id"].alias("_id"), row_hash(docs).alias("_h"), docs["text"].alias("_text"))


@contextlib.contextmanager
def kept_after(spark: SparkSession, name: str):
    """Within the block what is saved() goes to a folder that is deleted at its end; what is given to the function that it gets stays."""
    path = f"{_open[-1] if _open else shared_dir(spark) + '/inkwell'}/{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    with scratch(spark):
        yield keep


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.MapType):
            return F.coalesce(F.aggregate(c, F.lit(24).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(8))
        each = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
        return F.greatest(F.size(c), F.lit(0)) * (8 * each + 16) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows were measured to have few bytes. Use it on saved tables, which are read for it."""
    each = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    return (df.agg(F.sum(each)).first()[0] or 0) <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it fits(); beyond that it is left for a shuffled join."""
    return F.broadcast(df) if fits(df, limit) else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row: a name bound in a
    lambda isn't inlined again by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    """keep and the columns, worked out once for each row whatever is filtered or
    selected after: what a generator gives isn't inlined again by the optimizer."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
