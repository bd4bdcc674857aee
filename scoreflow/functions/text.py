"""Text helpers: trimming, splitting, JSON recovery and cell normalization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import once, with_values

# Characters removed around ids and names (fixed value).
BLANKS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def strip_column(name: str) -> Column:
    """:func:`strip` of a text column. A text without a blank at its end, as most are, is not walked through."""
    text = F.col(f"`{name}`")
    ends = [F.endswith(text, F.lit(blank)) for blank in BLANKS]
    return F.when(reduce(Column.__or__, ends), strip(text)).otherwise(F.ltrim(text, F.lit(BLANKS)))


def clean_id(column: Column) -> Column:
    """Ids are compared as trimmed text."""
    return strip(column.cast("string"))


def match_id(column: Column, mode: str) -> Column:
    """Id in the form used for matching: ``exact``, ``trim`` or ``ci`` (case ignored)."""
    if mode == "exact":
        return column.cast("string")
    if mode == "trim":
        return clean_id(column)
    if mode == "ci":
        return F.upper(clean_id(column))
    raise ValueError(f"unknown match mode: {mode}")


def email_key(column: Column) -> Column:
    return F.lower(strip(column))


def is_blank(column: Column) -> Column:
    return F.coalesce(strip(column) == "", F.lit(True))


def split_list(text: Column, separator: str = ",") -> Column:
    """Split, trim the parts and leave the blank ones out."""
    parts = F.transform(F.split(text, separator), strip)
    return F.filter(parts, lambda part: part != "")


def bullet_lines(*points: Column) -> Column:
    """The given texts without nulls, in the given order, a line with a dash for each."""
    return F.concat_ws("\n", *[F.concat(F.lit("- "), p) for p in points])


def strip_bullets(text: Column) -> Column:
    """Lines of a bulleted text without their dash, blank lines left out."""
    lines = F.filter(F.split(text, "\n"), lambda line: strip(line) != "")
    return F.transform(lines, lambda line: strip(F.ltrim(line, F.lit("- "))))


def filled_text(template: str, *values: Column) -> Column:
    """The template with each ``%s`` replaced by a text; a null is written ``null``. Put together in compiled code, which
    ``format_string`` is not."""
    pieces = template.split("%s")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [F.coalesce(value, F.lit("null")), F.lit(piece)]
    return F.concat(*parts)


def present(*items: Column) -> Column:
    """Array of the given texts without nulls, in the given order."""
    return F.array_compact(F.array(*items))


# --- JSON ---------------------------------------------------------------------------


# A scalar JSON value (fixed pattern).
JSON_SCALAR = r"^(-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null)$"


def _looks_like_json(text: Column) -> Column:
    """Cheap test before parsing: a failed parse costs far more than a look at both ends."""
    ends = [F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b)) for a, b in ("{}", "[]", '""')]
    return ends[0] | ends[1] | ends[2] | text.rlike(JSON_SCALAR)


def _json_values(text: Column) -> Column:
    """VARIANTs in a text, separated by commas; null where it is no JSON.

    The parser stops after the first value, so the text is parsed as the elements of
    an array; a second value or trailing text then shows.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(_looks_like_json(text), F.try_variant_get(wrapped, "$", "array<variant>"))


def _only(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def _braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parse_json_text(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null."""
    return once(_json_values(text), _only)


def recover_json(text: Column) -> Column:
    """VARIANT of a JSON text; else of the part from its first ``{`` to its last ``}``."""
    return F.coalesce(parse_json_text(strip(text)), parse_json_text(_braces(text)))


def with_recovered_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add :func:`recover_json` of the column ``text``, step by step in columns of their own.

    Every step is compiled and done once per row, which the one expression for all of them is not.
    """
    part = f"_{name}_part"
    rows = df.withColumn(part, strip_column(text))
    rows = with_values(rows, {name: _json_values(F.col(part))})
    one = F.size(name) == 1
    rows = rows.withColumn(part, F.when(one, F.lit(None)).otherwise(_braces(F.col(text))))
    rows = with_values(rows, {name: F.when(one, F.col(name)).otherwise(_json_values(F.col(part)))})
    return with_values(rows.drop(part), {name: _only(F.col(name))})


def is_filled_object(value: Column) -> Column:
    """True for a JSON object that has at least one key."""
    return F.coalesce(F.size(F.try_variant_get(value, "$", "map<string,variant>")) > 0, F.lit(False))


def field_text(value: Column, key: str, default: str = "") -> Column:
    """Field of a JSON object as cell text: nested values as JSON, null as empty, booleans capitalized.

    ``default`` only where the key is absent. The field's type is looked up only where its text leaves it open.
    """
    text = F.try_variant_get(value, f"$.{key}", "string")
    field = F.try_variant_get(value, f"$.{key}", "variant")
    boolean = text.isin("true", "false") & (F.schema_of_variant(field) == "BOOLEAN")
    none = F.when(field.isNull(), F.lit(default)).otherwise(F.lit("")) if default else F.lit("")
    return F.when(boolean, F.initcap(text)).otherwise(F.coalesce(text, none))


def normalize_cell(text: Column) -> Column:
    """Cell as VARIANT: parsed where it is JSON, else its trimmed text; null is empty text."""
    cell = F.coalesce(strip(text), F.lit(""))
    return F.coalesce(parse_json_text(cell), cell.cast("variant"))


def with_json_strings(df: DataFrame, names: list[str]) -> DataFrame:
    """The text columns as JSON strings; null stays null."""
    own = {n: f"_json_{n}" for n in names}
    wrapped = df.withColumns({j: F.when(F.col(n).isNotNull(), F.to_json(F.struct(F.col(n).alias("v")))) for n, j in own.items()})
    return wrapped.withColumns({n: only_field(j, "v") for n, j in own.items()}).drop(*own.values())


def only_field(json: str, field: str) -> Column:
    """JSON text of the only field of the objects in the column ``json``, cut out as bytes: characters need not be counted."""
    start = len(f'{{"{field}":')
    return F.substring(F.col(json).cast("binary"), F.lit(start + 1), F.octet_length(json) - (start + 1)).cast("string")


def with_cell_json(df: DataFrame, names: list[str]) -> DataFrame:
    """The text columns as JSON texts of :func:`normalize_cell`.

    Only a cell that looks like JSON is parsed; plain text is just quoted. Every step has columns of its own, so
    none is done twice.
    """
    own = {n: f"_cell_{n}" for n in names}
    rows = df.withColumns({n: F.coalesce(strip_column(n), F.lit("")) for n in names})
    parsed = {c: F.when(_looks_like_json(F.col(n)), F.to_json(parse_json_text(F.col(n)))) for n, c in own.items()}
    rows = with_json_strings(rows.withColumns(parsed), names)
    return rows.withColumns({n: F.coalesce(c, n) for n, c in own.items()}).drop(*own.values())


def next_steps(text: Column) -> Column:
    """Free text, JSON list or JSON object as an array of step texts."""
    blank = F.coalesce(text, F.lit("")) == ""
    trimmed = strip(text)
    empty = F.array().cast("array<string>")
    steps = F.transform(
        F.map_entries(F.from_json(trimmed, "map<string,string>")),
        lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))),
    )
    listed = F.from_json(trimmed, "array<string>")

    def by_shape(shape: Column) -> Column:
        return (
            F.when(shape.isNull(), F.array(text))
            .when(shape.startswith("ARRAY<"), listed)
            .when(shape.startswith("OBJECT<"), steps)
            .otherwise(empty)
        )

    shape = F.schema_of_variant(parse_json_text(trimmed))
    return F.when(blank, empty).otherwise(once(shape, by_shape))
