"""Nested values: flattening to paths, remapping, and JSON-safe forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squashed(df: DataFrame, separator: str = "/") -> DataFrame:
    """All leaves of nested structs as columns named by their path; a name that would appear twice raises."""
    out: list[tuple[str, Column]] = []

    def walk(fields: list[T.StructField], path: tuple[str, ...]) -> None:
        for f in fields:
            at = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType.fields, at)
            else:
                col = F.col(f"`{at[0]}`")
                for name in at[1:]:
                    col = col.getField(name)
                out.append((separator.join(at), col))

    walk(df.schema.fields, ())
    names = [n for n, _ in out]
    if len(set(names)) < len(names):
        raise ValueError(f"paths repeat: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.select(*[c.alias(n) for n, c in out])


def remapped(values: Column, mapping: dict[str, str]) -> Column:
    """An array of strings with those in the mapping replaced."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(values, lambda x: F.coalesce(m[x], x))


def flattened(values: Column, depth: int) -> Column:
    """An array of arrays, flattened `depth` levels."""
    for _ in range(depth):
        values = F.flatten(values)
    return values


def json_row(*columns: str) -> Column:
    """The columns as one JSON object: times in ISO form, nulls left in."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"})
