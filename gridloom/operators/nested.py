"""Records of any shape as VARIANT: every value with its path, and one spelling for equal records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = r'"(?:[^"\\]|\\.)*+"'
#: A number with a point, as a double is written, with an exponent if it is large or small.
POINTED = r"-?[0-9]+\.[0-9]+(?:E-?[0-9]+)?"

#: A text, a zero with a sign, or a number with a point and zeros at its end; the groups are what stays of each.
ZEROS = rf'({TEXT})|-(0)\.0+(?![0-9])|(-?[0-9]+)(?:\.0+|(\.[0-9]*?[1-9])0*)(?![0-9])'


def as_json(df: DataFrame, column: str) -> Column:
    """JSON text of a column: texts are JSON already, VARIANT and nested ones are written, with their nulls."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.col(column)
    return F.to_json(column) if isinstance(kind, T.VariantType) else F.to_json(column, {"ignoreNullFields": "false"})


def depth(text: Column) -> Column:
    """How many objects and arrays of JSON text stand within each other: 0 for a plain value."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, TEXT, ""), r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda acc: acc["most"])


def values(df: DataFrame, key: list[str], record: str) -> DataFrame:
    """key, path and value (as text, null for null) of every plain value of record, at any depth.

    A path names members as .name and elements as [place]; that of a record which is a plain value itself is empty.
    Empty objects and arrays hold none; a null record gives no row, text that is no JSON an error. The greatest depth
    is found first, in one pass, and as many levels are taken apart below each other in one plan.
    """
    text = as_json(df, record)
    levels = df.agg(F.max(depth(text))).first()[0] or 0
    now = df.select(F.struct(*key).alias("k"), F.lit("").alias("path"), F.parse_json(text).alias("v")).where(F.col("v").isNotNull())
    nested, found = F.schema_of_variant("v").rlike(r"^(OBJECT|ARRAY)\b"), []
    for _ in range(levels + 1):
        found.append(now.where(~nested).select("k.*", "path", F.try_variant_get("v", "$", "string").alias("value")))
        parts = now.where(nested).lateralJoin(now.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "below"))
        step = F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        now = parts.select("k", F.concat("path", step).alias("path"), F.col("below").alias("v"))
    return reduce(DataFrame.unionByName, found)


def absolute_texts(df: DataFrame, key: list[str], record: str) -> DataFrame:
    """key, path and value of every text in record, at any depth, that begins with a slash; a release must hold none."""
    return values(df, key, record).where(F.startswith("value", F.lit("/")))


def without_absolute_texts(df: DataFrame, key: list[str], record: str) -> DataFrame:
    """df, or an error that names an absolute text in a record."""
    if found := absolute_texts(df, key, record).limit(1).collect():
        raise ValueError(f"absolute local path in {record}{found[0]['path']}: {found[0]['value']}")
    return df


def _plain(number: Column) -> Column:
    """A number with a point as a plain decimal, without zeros at its end, and zero without a sign."""
    part = lambda k: F.regexp_extract(number, r"^(-?)([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", k)
    power, digits = F.coalesce(part(4).try_cast("int"), F.lit(0)), F.concat(part(2), part(3))
    point = F.length(part(2)) + power
    whole = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), F.greatest(point, F.lit(0))), F.greatest(point, F.lit(1)), "0"))
    behind = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)).otherwise(F.substring(digits, point + 1, F.length(digits)))
    behind = F.regexp_replace(behind, "0+$", "")
    plain = F.concat(part(1), whole, F.when(behind == "", F.lit("")).otherwise(F.concat(F.lit("."), behind)))
    return F.when(plain == "-0", "0").otherwise(plain)


def canonical(text: Column) -> Column:
    """JSON text in one spelling: compact, members of every object in the order of their names, numbers as plain decimals.

    A number that is written in another way, such as 1.50, 15e-1 or 1.5, has one spelling; beyond 38 digits it is a
    double. Texts keep their characters and escape only quotes, backslashes and control characters. Text that is no
    JSON, and an object with a name twice, are errors; null stays null.
    """
    sorted_ = F.to_json(F.parse_json(text))
    bare = F.regexp_replace(sorted_, TEXT, "")
    pieces = F.regexp_extract_all(sorted_, F.lit(rf'{TEXT}|{POINTED}|-?[0-9]+|[^"0-9-]+'), F.lit(0))
    spelled = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{POINTED}$"), _plain(p)).otherwise(p)), "")
    # without exponents there are only zeros to take off, in one go over the text
    trimmed = F.regexp_replace(sorted_, ZEROS, "$1$2$3$4")
    return F.when(bare.contains("E"), spelled).when(bare.contains("."), trimmed).otherwise(sorted_)


def fingerprint(df: DataFrame, column: str) -> Column:
    """sha256 of the canonical JSON of a column of any shape: text, struct, map, array or VARIANT."""
    return F.sha2(canonical(as_json(df, column)), 256)
