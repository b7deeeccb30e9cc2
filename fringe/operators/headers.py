"""Header keywords as a table (pos, key, value, comment)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringe.session import fresh

#: The classes of keywords, each by a pattern; the first that fits decides.
CLASSES = (
    ("structural", r"SIMPLE|BITPIX|NAXIS\d*|EXTEND|XTENSION|PCOUNT|GCOUNT|TFIELDS|TFORM\d+|TBCOL\d+|THEAP|GROUPS|END"),
    ("compression", r"Z(IMAGE|CMPTYPE|NAME\d+|VAL\d+|TILE\d+|BITPIX|NAXIS\d*|SCALE|ZERO|BLANK|SIMPLE|TENSION|QUANTIZ|DITHER0)"),
    ("scale", r"BSCALE|BZERO|TSCAL\d+|TZERO\d+"),
    ("null", r"BLANK|TNULL\d+"),
    ("dimension", r"TDIM\d+"),
    ("range", r"DATAMIN|DATAMAX|TL(MIN|MAX)\d+|TD(MIN|MAX)\d+"),
    ("unit", r"BUNIT|TUNIT\d+"),
    ("display", r"TDISP\d+"),
    ("hdu_id", r"EXTNAME|EXTVER|EXTLEVEL|HDUNAME|HDUVER|HDULEVEL"),
    ("checksum", r"CHECKSUM|DATASUM"),
    ("wcs", r"WCSAXES[A-Z]?|C(RVAL|TYPE|RPIX|DELT|UNIT|ROTA)\d+[A-Z]?|(PC|CD)\d+_\d+[A-Z]?|EQUINOX|RADECSYS|RADESYS|LONPOLE|LATPOLE|TC(RVL|TYP|RPX|DLT|UNI|ROT)\d+"),
    ("reference_system", r"TIMESYS|MJDREF[IF]?|TIMEZERO|TREFPOS|TREFDIR"),
    ("comment", r"COMMENT|HISTORY|"),
    ("continue", r"CONTINUE"),
)


def keyword_class(key: Column) -> Column:
    out = None
    for name, pattern in CLASSES:
        hit = key.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("user")


def find(header: DataFrame, pattern: str) -> DataFrame:
    """Cards whose key fits ``*``, ``?`` and ``#``, in order."""
    wanted = "".join({"*": ".*", "?": ".", "#": r"\d+"}.get(c, re.escape(c)) for c in pattern.upper())
    return header.where(F.upper("key").rlike(f"^{wanted}$")).orderBy("pos")


def upsert(header: DataFrame, changes: DataFrame) -> DataFrame:
    """``header`` with the values and comments of ``changes`` (key, value, comment): in place of the first card of a key, or after the last card where there is none.

    Headers of many files and units (columns ``path`` and ``hdu``) are each changed on their own, by the changes that
    name it in the same columns. Further cards of a key, as COMMENT has them, stay. Of several changes for one key
    that with the largest value and comment counts.
    """
    own = [c for c in ("path", "hdu") if c in header.columns]
    if lacking := [c for c in own if c not in changes.columns]:
        raise ValueError(f"changes of many headers need columns {lacking}")
    new = changes.groupBy(*own, "key").agg(F.max(F.struct(F.col("value").alias("new_value"), F.col("comment").alias("new_comment"))).alias("new")).select(*own, "key", "new.*")
    met = new.join(header.groupBy(*own, "key").agg(F.min("pos").alias("pos")), [*own, "key"], "left")
    if own:
        met = met.join(header.groupBy(*own).agg(F.max("pos").alias("last")), own, "left")
    else:
        met = met.withColumn("last", F.lit(header.agg(F.max("pos")).first()[0]))
    order = F.row_number().over(Window.partitionBy(*own, F.col("pos").isNull()).orderBy("key"))
    place = F.coalesce("pos", F.coalesce("last", F.lit(0)) + order).cast(header.schema["pos"].dataType)
    placed = met.select(*own, "key", "new_value", "new_comment", place.alias("pos"))
    out = header.join(placed, [*own, "key", "pos"], "full")
    columns = {"value": F.coalesce("new_value", "value"), "comment": F.coalesce("new_comment", "comment")}
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in header.columns])


def delete(header: DataFrame, *keys: str) -> DataFrame:
    return header.where(~F.col("key").isin(*keys))


def rename(header: DataFrame, old: str, new: str) -> DataFrame:
    return header.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def value_type(value: Column) -> Column:
    """C text, L logical, I whole number, F real, X complex; null for no value."""
    v = F.trim(value)
    return (
        F.when(v == "", None).when(v.startswith("'"), "C").when(v.isin("T", "F"), "L").when(v.rlike(r"^\(.*,.*\)$"), "X")
        .when(v.rlike(r"^[+-]?\d+$"), "I").when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?$"), "F")
    )


def typed_value(value: Column, kind: str) -> Column:
    """A card's value as a ``string``, ``boolean``, ``long`` or ``double``; null where it is none."""
    v = F.trim(value)
    text = F.rtrim(F.regexp_replace(F.regexp_replace(v, "^'|'$", ""), "''", "'"))
    match kind:
        case "string":
            return F.when(v.startswith("'"), text).otherwise(F.nullif(v, F.lit("")))
        case "boolean":
            return F.when(v == "T", True).when(v == "F", False)
        case "long" | "double":
            return v.try_cast("long") if kind == "long" else F.translate(F.upper(v), "D", "E").try_cast("double")
    raise ValueError(f"no type {kind}")


def card_value(value: Column, kind: str) -> Column:
    """A value of that type as a card has it; the empty text for null."""
    text = value.cast("string")
    if kind == "string":
        text = F.concat(F.lit("'"), F.rpad(F.replace(text, F.lit("'"), F.lit("''")), F.greatest(F.length(F.replace(text, F.lit("'"), F.lit("''"))), F.lit(8)), F.lit(" ")), F.lit("'"))
    elif kind == "boolean":
        text = F.when(value, "T").otherwise(F.when(~value, "F"))
    return F.coalesce(text, F.lit(""))


def with_keywords(rows: DataFrame, header: DataFrame, keys: Mapping[str, tuple[str, str]], file: str = "_file") -> DataFrame:
    """``rows`` with columns of keyword values of the file in their column ``file``: ``{"exposure": ("EXPTIME", "double")}``.

    Of several cards of a key the first unit's first counts (give the cards of one unit only, if others don't matter);
    keys are met in any case. A file without the key, or with a value of another type, gives null, and so does a row
    without a file. A column of that name is replaced. The join is on the file, of which a table has far fewer than rows.
    """
    wanted = {key.upper() for key, _ in keys.values()}
    place = F.struct("hdu", "pos") if "hdu" in header.columns else F.struct("pos")
    values = [F.min_by(typed_value(F.col("value"), kind), F.when(F.upper("key") == key.upper(), place)).alias(name) for name, (key, kind) in keys.items()]
    (path,) = fresh([*rows.columns, *keys], "path")
    found = header.where(F.upper("key").isin(*wanted)).groupBy(F.col("path").alias(path)).agg(*values)
    kept = rows.drop(*keys)
    return kept.join(found, kept[file] == found[path], "left").drop(path)


def calculate_keywords(header: DataFrame, rows: DataFrame, keys: Mapping[str, tuple[Column, str]], file: str = "_file", hdu: int = 1) -> DataFrame:
    """``header`` with keywords set to aggregates of each file's rows: ``{"EXPTIME": (F.sum("exposure"), "double")}``.

    They go to unit ``hdu`` of the file, in place of its first card of that name or after its last card, with an empty
    comment. Files without rows, and cards of other files and units, stay as they are; a null aggregate is a card without a value.
    """
    found = rows.where(F.col(file).isNotNull()).groupBy(F.col(file).alias("path")).agg(*[value.alias(f"value_{i}") for i, (value, _) in enumerate(keys.values())])
    cards = F.array(*[F.struct(F.lit(key.upper()).alias("key"), card_value(F.col(f"value_{i}"), kind).alias("value")) for i, (key, (_, kind)) in enumerate(keys.items())])
    changes = found.select("path", F.lit(hdu).cast(header.schema["hdu"].dataType).alias("hdu"), F.explode(cards).alias("card")).select("path", "hdu", "card.*", F.lit("").alias("comment"))
    return upsert(header, changes)


def parse_time(text: Column) -> Column:
    """``YYYY-MM-DD`` with an optional time, or ``dd/mm/yy`` of the twentieth century, as a timestamp."""
    old = F.regexp_replace(text, r"^(\d\d)/(\d\d)/(\d\d)$", "19$3-$2-$1")
    return F.coalesce(F.try_to_timestamp(old, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")), F.try_to_timestamp(old, F.lit("yyyy-MM-dd")))
