"""Scalar and aggregate functions by name, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Build = Callable[..., Column]


def _round(x: Column, digits: Column | None = None) -> Column:
    return F.round(x) if digits is None else F.round(x, digits)


def _substring(x: Column, start: Column, length: Column | None = None) -> Column:
    """From a place counted from 0."""
    at = start + 1
    return F.substring(x, at, F.length(x) if length is None else length)


def _substr(x: Column, start: Column, length: Column | None = None) -> Column:
    """From a place counted from 1."""
    return F.substring(x, start, F.length(x) if length is None else length)


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    return F.sequence(a.cast("long"), b.cast("long"), (F.lit(1) if step is None else step).cast("long"))


def _strftime(form: Column, x: Column) -> Column:
    """The directives that have a counterpart in Spark's patterns."""
    pattern = form
    for a, b in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%j", "DDD")):
        pattern = F.replace(pattern, F.lit(a), F.lit(b))
    return F.call_function("date_format", F.try_to_timestamp(x.cast("string")), pattern)


def _moment(x: Column) -> Column:
    return F.try_to_timestamp(x.cast("string"))


def _iif(a: Column, b: Column, c: Column) -> Column:
    return F.when(a, b).otherwise(c)


def _json_path(x: Column, path: Column) -> Column:
    return F.call_function("get_json_object", x.cast("string"), path)



def storage_class(x: Column) -> Column:
    """null, integer, real or text."""
    kind = F.typeof(x)
    number = F.when(kind.isin("boolean", "tinyint", "smallint", "int", "bigint"), "integer").when(kind.rlike("^(float|double|decimal)"), "real")
    return F.when(x.isNull(), "null").otherwise(number.otherwise("text"))


SCALARS: dict[str, Build] = {
    # text
    "upper": F.upper,
    "toupper": F.upper,
    "lower": F.lower,
    "tolower": F.lower,
    "trim": lambda x, c=None: F.trim(x) if c is None else F.btrim(x, c),
    "ltrim": lambda x, c=None: F.ltrim(x) if c is None else F.call_function("ltrim", c, x),
    "rtrim": lambda x, c=None: F.rtrim(x) if c is None else F.call_function("rtrim", c, x),
    "substring": _substring,
    "substr": _substr,
    "replace": F.replace,
    "instr": lambda x, y: F.call_function("instr", x, y),
    "length": F.length,
    "char_length": F.length,
    "hex": F.hex,
    "char": F.chr,
    "unicode": F.ascii,
    "reverse": F.reverse,
    "left": lambda x, n: F.left(x, n),
    "right": lambda x, n: F.right(x, n),
    "split": lambda x, d: F.call_function("split", x, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "printf": lambda f, *xs: F.call_function("format_string", f, *xs),
    "format": lambda f, *xs: F.call_function("format_string", f, *xs),
    "concat": F.concat,
    # casts
    "tostring": lambda x: x.cast("string"),
    "tointeger": lambda x: x.try_cast("double").cast("long"),
    "tofloat": lambda x: x.try_cast("double"),
    "toboolean": lambda x: x.try_cast("boolean"),
    # numbers
    "abs": F.abs,
    "round": _round,
    "sign": lambda x: F.signum(x).cast("long"),
    "random": lambda: F.rand(),
    "rand": lambda: F.rand(),
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": F.ln,
    "ln": F.ln,
    "log10": F.log10,
    "log2": F.log2,
    "pow": F.pow,
    "power": F.pow,
    "ceil": F.ceil,
    "floor": F.floor,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "atan2": F.atan2,
    "pi": lambda: F.pi(),
    "e": lambda: F.e(),
    "degrees": F.degrees,
    "radians": F.radians,
    "mod": lambda a, b: F.try_mod(a, b),
    # choice and type
    "coalesce": F.coalesce,
    "ifnull": lambda a, b: F.coalesce(a, b),
    "nullif": F.nullif,
    "iif": _iif,
    "typeof": storage_class,
    # dates
    "date": lambda x: F.date_format(_moment(x), "yyyy-MM-dd"),
    "time": lambda x: F.date_format(_moment(x), "HH:mm:ss"),
    "datetime": lambda x: F.date_format(_moment(x), "yyyy-MM-dd HH:mm:ss"),
    "julianday": lambda x: F.unix_micros(_moment(x)) / 86_400_000_000 + 2_440_587.5,
    "strftime": _strftime,
    "year": lambda x: F.year(_moment(x)),
    "month": lambda x: F.month(_moment(x)),
    "day": lambda x: F.day(_moment(x)),
    # JSON text
    "json_extract": _json_path,
    "json_array_length": lambda x: F.json_array_length(x),
    "json_valid": lambda x: F.try_parse_json(x).isNotNull(),
    "json_type": lambda x, p=None: F.lower(F.schema_of_variant(F.try_parse_json(x if p is None else F.call_function("get_json_object", x, p)))),
    "json_array": lambda *xs: F.to_json(F.array(*xs)),
    "json_object": lambda *xs: F.to_json(F.create_map(*xs)),
    # lists
    "head": lambda x: F.get(x, F.lit(0)),
    "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))),
    "range": _range,
    "keys": lambda x: F.map_keys(x),
}

#: Aggregates: column, then whether only different values count.
AGGREGATES: dict[str, Build] = {
    "count": lambda x, d: F.count_distinct(x) if d else F.count(x),
    "sum": lambda x, d: F.sum_distinct(x) if d else F.sum(x),
    "avg": lambda x, d: F.call_function("avg", x) if not d else F.sum_distinct(x) / F.count_distinct(x),
    "min": lambda x, d: F.min(x),
    "max": lambda x, d: F.max(x),
    "collect": lambda x, d: F.collect_set(x) if d else F.collect_list(x),
    "total": lambda x, d: F.coalesce((F.sum_distinct(x) if d else F.sum(x)).cast("double"), F.lit(0.0)),
    "stdev": lambda x, d: F.stddev_samp(x),
    "stdevp": lambda x, d: F.stddev_pop(x),
}


def group_concat(x: Column, separator: Column | None, distinct: bool) -> Column:
    values = (F.collect_set if distinct else F.collect_list)(x.cast("string"))
    joined = F.call_function("array_join", F.array_sort(values), F.lit(",") if separator is None else separator)
    return F.when(F.count(x) > 0, joined)
