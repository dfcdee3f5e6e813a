"""Functions that walk nested types by schema."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.replace(c, F.lit("\0"), F.lit(" "))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: _clean(k, kind.keyType)), lambda _, v: _clean(v, kind.valueType))
    return c


def strip_nul(df: DataFrame) -> DataFrame:
    """df with NUL characters replaced by blanks in all strings, keys of maps included; other columns untouched."""
    return df.select(*(_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


# What no value of a plan may hold.
UNSAFE = r"(?i)https?://|(?:curl|wget|sudo|rm\s+-|chmod|bash|powershell)\b|</?(?:system|assistant|tool)"

#: UNSAFE for Java with the meaning that it has in the queries' SQL (RE2): \b stands between ASCII letters and others, \s is no \x0B, and the long s is a small S.
_BOUND = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
UNSAFE_JAVA = UNSAFE.replace(r"\s", r"[\t\n\f\r ]").replace("s", "[sſ]").replace(r"\b", _BOUND)


def violations(c: Column, kind: T.DataType, caps: Mapping[str, int] = {}, unsafe: str = UNSAFE_JAVA, most: int = 160, path: Column | str = "$", name: str = "") -> Column:
    """array<struct<path, reason>>: where a nested value breaks the rules, in order, e.g. ``$.steps[2].title``.

    A string that matches ``unsafe`` is ``unsafe``, keys of maps too; one longer than its field's cap is
    ``too_long``, a list or map with more entries than its field's cap ``too_many``.  caps has a cap for a
    field's name, or for a path without indexes (``steps.title``); other strings have ``most``.  Null
    breaks no rule.
    """
    here = F.lit(path) if isinstance(path, str) else path
    none = F.array().cast("array<struct<path:string,reason:string>>")
    cap = caps.get(name, caps.get(name.rsplit(".", 1)[-1]))
    told = lambda ok, reason: F.when(ok, F.array(F.struct(here.alias("path"), F.lit(reason).alias("reason")))).otherwise(none)
    go = lambda x, k, p, n: violations(x, k, caps, unsafe, most, p, n)
    if isinstance(kind, T.StringType):
        return F.concat(told(c.rlike(unsafe), "unsafe"), told(F.length(c) > (most if cap is None else cap), "too_long"))
    if isinstance(kind, T.StructType):
        inner = [go(c[f.name], f.dataType, F.concat(here, F.lit(f".{f.name}")), f"{name}.{f.name}".lstrip(".")) for f in kind.fields]
        return F.concat(none, *inner)
    size = told(F.size(c) > cap, "too_many") if cap is not None else none
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x, i: go(x, kind.elementType, F.concat(here, F.lit("["), i.cast("string"), F.lit("]")), name))
        return F.concat(size, F.coalesce(F.flatten(inner), none))
    if isinstance(kind, T.MapType):
        at = lambda k: F.concat(here, F.to_json(F.array(k.cast("string"))))
        inner = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(go(k, kind.keyType, F.concat(at(k), F.lit(".key")), name), go(c[k], kind.valueType, at(k), name)))
        return F.concat(size, F.coalesce(F.flatten(inner), none))
    return none


def quarantine(df: DataFrame, column: str, **rules) -> tuple[DataFrame, DataFrame]:
    """(safe rows, refused rows with ``path`` and ``reason`` of the first violation)."""
    told = df.withColumn("_first", F.try_element_at(violations(F.col(column), df.schema[column].dataType, **rules), F.lit(1)))
    refused = told.where("_first IS NOT NULL").select(*(F.col(f"`{c}`") for c in df.columns), F.col("_first.path").alias("path"), F.col("_first.reason").alias("reason"))
    return told.where("_first IS NULL").drop("_first"), refused


def folded(c: Column) -> Column:
    """Case folding: letters that lower case keeps apart become one (ß and ss, ς and σ)."""
    # the dotless i has a capital letter that is not its own; its detour also keeps apart what the optimizer would make one step
    capital = F.upper(F.replace(F.lower(c), F.lit("ı"), F.lit("\x01")))
    return F.replace(F.lower(F.replace(capital, F.lit("\x01"), F.lit("ı"))), F.lit("ς"), F.lit("σ"))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """Compact JSON with the keys of structs and maps in order at every level, null written, other characters than ASCII as they are."""
    quote = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    if isinstance(kind, T.StringType):
        text = quote(c)
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        text = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), canonical_json(c[f.name], f.dataType)) for f in fields)), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(quote(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))))
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    else:
        text = c.cast("string")
    return F.when(c.isNotNull(), text).otherwise(F.lit("null"))
