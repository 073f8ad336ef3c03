"""Small expression helpers shared by the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda in the body uses it for each element."""
    return F.transform(F.array(value), body)[0]


def _hashable(kind: DataType) -> bool:
    """Whether Spark hashes values of this type: none with a map or a variant at any depth."""
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, MapType | VariantType)


def row_key(df: DataFrame) -> Column:
    """128 bits of hash over all columns of ``df`` and over which of them are null, as text.

    Rows with one key are taken as one row repeated: clashes need about 10^18 different rows.
    """
    names = [f"`{f.name.replace('`', '``')}`" for f in df.schema]
    values = [F.col(n) if _hashable(f.dataType) else F.to_json(F.struct(n)) for n, f in zip(names, df.schema, strict=True)]
    nulls = F.concat_ws("", *(F.isnull(n).cast("int").cast("string") for n in names))
    return F.concat(F.hex(F.xxhash64(nulls, *values)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *values, nulls)))
