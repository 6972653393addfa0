"""Types of text columns by vote: what at least four fifths of all rows parse as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the vote and of boolean words.
SHARE = 0.8
TRUE_WORDS, FALSE_WORDS = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]
_NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
_INTEGER = r"^[+-]?[0-9]+$"


def parse_bool(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def parse_int(c: Column) -> Column:
    return F.when(c.rlike(_INTEGER), c.try_cast("bigint"))


def parse_double(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


PARSERS = {"bigint": parse_int, "double": parse_double, "boolean": parse_bool}
ZERO = {"bigint": 0, "double": 0.0, "boolean": False}


def vote(counts: dict[str, int], total: int) -> str:
    """bool before int before int or float before text; blanks count in the total only."""
    need = -(-total * 4 // 5)
    if not total:
        return "string"
    if counts["bool"] >= need:
        return "boolean"
    if counts["int"] >= need:
        return "bigint"
    return "double" if counts["int"] + counts["float"] >= need else "string"


def infer_types(df: DataFrame) -> dict[str, str]:
    """One pass over all columns: each non-blank value votes as an integer, else a float, else a boolean."""
    if not df.columns:
        return {}
    aggs = [F.count(F.lit(1)).alias("total")]
    for k, name in enumerate(df.columns):
        v = F.trim(F.col(f"`{name}`"))
        is_int, is_float, is_bool = parse_int(v).isNotNull(), parse_double(v).isNotNull(), parse_bool(v).isNotNull()
        aggs += [F.count_if(is_int).alias(f"int{k}"), F.count_if(~is_int & is_float).alias(f"float{k}"), F.count_if(~is_int & ~is_float & is_bool).alias(f"bool{k}")]
    row = df.agg(*aggs).first()
    return {name: vote({x: row[f"{x}{k}"] for x in ("int", "float", "bool")}, row["total"]) for k, name in enumerate(df.columns)}


def typed(df: DataFrame, types: dict[str, str], on_error: str = "text") -> DataFrame:
    """Cast text columns to their types. A value that fails gives zero (``on_error="zero"``), or keeps its whole column text (``"text"``)."""
    parsed = {c: PARSERS[t](F.trim(F.col(f"`{c}`"))) for c, t in types.items() if t != "string"}
    if on_error == "zero":
        return df.select(*[F.coalesce(parsed[c], F.lit(ZERO[types[c]])).alias(c) if c in parsed else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    if parsed:
        names = list(parsed)
        bad = df.agg(*[F.count_if(parsed[c].isNull()).alias(f"b{k}") for k, c in enumerate(names)]).first()
        parsed = {c: parsed[c] for k, c in enumerate(names) if not bad[f"b{k}"]}
    return df.select(*[parsed[c].alias(c) if c in parsed else F.col(f"`{c}`") for c in df.columns])
