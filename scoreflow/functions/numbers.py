"""Rounding, exact sums and guarded text-to-value conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import with_values

# Accepted number texts. Spark alone would also take suffixes such as 1.5d.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Whole dates only: a plain cast would also take 2024 and 2024-02.
MOMENT_PATTERN = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?\s*$"

#: Doubles from here on are whole numbers.
WHOLE = float(1 << 52)
#: Values from here on have sums of their own.
WIDE = float(1 << 20)
#: Bits of the low limb of a product of two parts.
LIMB = 24


def round_even(value: Column, digits: int) -> Column:
    """Round by scaling to an integer, ties to even (how array libraries round).

    From 2**52 on a double has no fraction, and scaling might leave its range.
    """
    scale = F.lit(float(10**digits))
    return F.when(F.abs(value) >= F.lit(WHOLE), value).otherwise(F.rint(value * scale) / scale)


def round_tenth(value: Column) -> Column:
    """Round to one decimal by the exact binary value, ties to even.

    66.35 is stored slightly below 66.35 and becomes 66.3. The fraction is held as a
    multiple of 2**-56, so the comparison with one half is done on exact integers.
    """
    near = F.when(F.abs(value) < F.lit(WHOLE / 16), value)
    whole = F.floor(near)
    tenths = ((near - whole) * F.lit(float(1 << 56))).cast("bigint") * F.lit(10)
    digit = F.shiftright(tenths, 56)
    rest = tenths.bitwiseAND(F.lit((1 << 56) - 1))
    half = F.lit(1 << 55)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    return F.coalesce((whole * 10 + digit + up.cast("int")).cast("double") / F.lit(10.0), value)


# --- exact sums ---------------------------------------------------------------------
#
# A value below WIDE counts by its decimals: a whole part, millionths and ten-thousandths of a millionth.
# All three, and the products for the deviation, are summed as bigint buffers of fixed size; products are cut into
# limbs of 24 bits, so a group may hold 2**39 rows. Wider values are kept apart and summed by
# their binary exponent, which is exact for every finite double.


def steady_mean(value: Column) -> Column:
    """Aggregate: mean over an exact decimal sum, so the order of the rows cannot move a tie.

    With a value of over 17 whole digits it is the plain mean. For columns of averages; attempts have the sums below.
    """
    exact = value.try_cast("decimal(28,10)")
    mean = F.sum(exact).cast("double") / F.count(value)
    return F.when(F.count(exact) == F.count(value), mean).otherwise(F.avg(value))


def is_wide(value: str) -> str:
    """Values that have sums of their own. Written so that a scan can skip row groups without any."""
    return f"({value} >= {WIDE}D or {value} <= {-WIDE}D)"


def narrow_sums(value: str, kinds: list[str], kind: str = "exam_type", squares: bool = True) -> dict[str, str]:
    """Aggregates over the narrow values: count and sums, over all and for each kind, and sums of
    products over all. ``n`` and ``n_<kind>`` count wide values too."""
    near = f"if({is_wide(value)}, null, {value})"
    low = f"cast(floor({near}) as bigint)"
    fine = f"cast(rint(({near} - floor({near})) * 1e10D) as bigint)"
    millionths = f"(({fine} + 5000L) div 10000L)"
    parts = {"w": low, "f": millionths, "g": f"({fine} - {millionths} * 10000L)"}
    out = {"n": f"count({value})"}
    out |= {c: f"coalesce(sum({v}), 0L)" for c, v in parts.items()}
    for k in kinds:
        out[f"n_{k}"] = f"count(if({kind} = '{k}', {value}, null))"
        out |= {f"{c}_{k}": f"coalesce(sum(if({kind} = '{k}', {v}, null)), 0L)" for c, v in parts.items()}
    if squares:
        for name, x, y in (("ww", "w", "w"), ("wf", "w", "f"), ("ff", "f", "f")):
            product = f"({parts[x]} * {parts[y]})"
            out[f"{name}_high"] = f"coalesce(sum(shiftright({product}, {LIMB})), 0L)"
            out[f"{name}_low"] = f"coalesce(sum({product} & {(1 << LIMB) - 1}L), 0L)"
    return out


def columns(named: dict[str, str]) -> list[Column]:
    """SQL texts as columns. One text costs one call into the JVM, whatever its length."""
    return [F.expr(f"{text} as `{name}`") for name, text in named.items()]


def narrow_total(suffix: str = "") -> str:
    """Sum of the narrow values from the columns of :func:`narrow_sums`, as the nearest double."""
    w, f, g = (f"cast({c}{suffix} as decimal(19,0))" for c in "wfg")
    return f"cast({w} + {f} * 0.000001BD + {g} * 0.0000000001BD as double)"


def narrow_deviation(count: str) -> str:
    """Population deviation of ``count`` narrow values. Where 38 digits do not hold it, from the nearest doubles."""
    ww, wf, ff = (f"(cast({c}_high as decimal(19,0)) * {1 << LIMB} + {c}_low)" for c in ("ww", "wf", "ff"))
    total = "cast(cast(w as decimal(19,0)) * 1000000 + f as decimal(38,0))"
    squares = f"cast(cast({ww} as decimal(38,0)) * 1000000000000BD + {wf} * 2000000BD + {ff} as decimal(38,0))"
    n = f"cast({count} as decimal(19,0))"
    exact = f"cast(try_subtract(try_multiply({n}, {squares}), try_multiply({total}, {total})) as double)"
    double = f"(cast({n} as double) * cast({squares} as double) - power(cast({total} as double), 2))"
    return f"(sqrt(greatest(coalesce({exact}, {double}), 0D)) / ({count} * 1e6D))"


WIDE_NAMES = ["n", "high", "low", *[f"{c}_{limb}" for c in ("hh", "hl", "ll") for limb in ("high", "low")]]
WIDE_SUM = "kind:string,unit:int," + ",".join(f"{c}:bigint" for c in WIDE_NAMES)
NO_WIDE = f"cast(array() as array<struct<{WIDE_SUM}>>)"


def wide_sums(df: DataFrame, keys: list[str], value: str, kind: str) -> DataFrame:
    """Rows (keys, wide): exact sums of the wide values by kind and binary exponent.

    A value is a whole multiple of 2**unit below 2**55. There are at most some two thousand exponents, so the array is bounded.
    """
    unit = f"cast(floor(log2(abs({value}))) - 53 as int)"
    rows = df.filter(is_wide(value)).select(*keys, *columns({"kind": kind, "unit": unit, "value": value}))
    whole = rows.withColumn("whole", F.expr("cast(value * power(2D, -unit) as bigint)"))
    mask, limbs = (1 << 28) - 1, {"_high": "shiftright(whole, 28)", "_low": f"whole & {(1 << 28) - 1}L"}
    whole = whole.select(*keys, "kind", "unit", *columns(limbs))
    sums = {"n": "count(1)", "high": "sum(_high)", "low": "sum(_low)"}
    for name, a, b in (("hh", "_high", "_high"), ("hl", "_high", "_low"), ("ll", "_low", "_low")):
        sums[f"{name}_high"] = f"sum(shiftright({a} * {b}, 28))"
        sums[f"{name}_low"] = f"sum(({a} * {b}) & {mask}L)"
    parts = whole.groupBy(*keys, "kind", "unit").agg(*columns(sums))
    return parts.groupBy(*keys).agg(F.collect_list(F.struct("kind", "unit", *WIDE_NAMES)).alias("wide"))


def merged_wide(wide: str) -> str:
    """One entry for each kind and exponent of an array of ``wide`` entries."""
    added = ", ".join(f"element_at(done, -1).{c} + e.{c} as {c}" for c in WIDE_NAMES)
    same = "size(done) > 0 and try_element_at(done, -1).kind = e.kind and try_element_at(done, -1).unit = e.unit"
    return (
        f"aggregate(array_sort({wide}), {NO_WIDE}, (done, e) -> if({same}, "
        f"concat(slice(done, 1, size(done) - 1), array(struct(e.kind as kind, e.unit as unit, {added}))), "
        f"concat(done, array(struct(e.kind as kind, e.unit as unit, {', '.join(f'e.{c} as {c}' for c in WIDE_NAMES)})))))"
    )


def _united(wide: str) -> str:
    """Count, mean and deviation of entries: of each by itself, then joined in the order of the array.

    The deviation within an exponent is exact up to some 10**4 values, and from the nearest doubles beyond.
    """
    hh, hl, ll = (f"(cast(e.{c}_high as decimal(19,0)) * {1 << 28} + cast(e.{c}_low as decimal(19,0)))" for c in ("hh", "hl", "ll"))
    total = f"cast(cast(e.high as decimal(19,0)) * {1 << 28} + cast(e.low as decimal(19,0)) as decimal(38,0))"
    squares = (
        f"try_add(try_cast(try_multiply({hh}, {1 << 56}BD) as decimal(38,0)), "
        f"try_cast({hl} * {1 << 29}BD + {ll} as decimal(38,0)))"
    )
    exact = f"cast(try_subtract(try_multiply(cast(e.n as decimal(19,0)), {squares}), try_multiply({total}, {total})) as double)"
    double = f"(e.n * (cast({hh} as double) * {float(1 << 56)}D + cast({hl} as double) * {float(1 << 29)}D) - power(cast({total} as double), 2))"
    bucket = (
        f"struct(cast(e.n as double) as n, cast({total} as double) * power(2D, e.unit) as total, "
        f"cast({total} as double) / e.n * power(2D, e.unit) as mean, "
        f"sqrt(greatest(coalesce({exact}, {double}), 0D)) / e.n * power(2D, e.unit) as deviation)"
    )
    whole = "(a.n + b.n)"
    return (
        f"aggregate(transform({wide}, e -> {bucket}), struct(0D as n, 0D as total, 0D as mean, 0D as deviation), "
        f"(a, b) -> struct({whole} as n, a.total + b.total as total, a.mean + (b.mean - a.mean) * (b.n / {whole}) as mean, "
        f"hypot(hypot(a.deviation * sqrt(a.n / {whole}), b.deviation * sqrt(b.n / {whole})), "
        f"(b.mean - a.mean) * sqrt(a.n / {whole}) * sqrt(b.n / {whole})) as deviation))"
    )


def _united_kinds(kinds: list[str]) -> dict[str, str]:
    """Figures of all ``wide`` entries of a row and of those of each kind, by column name."""
    return {"_all": _united("array_sort(wide)")} | {
        f"_{kind}": _united(f"array_sort(filter(wide, e -> e.kind = '{kind}'))") for kind in kinds
    }


def _wide_columns(kinds: list[str]) -> dict[str, str]:
    figures = {"wide_deviation": "_all.deviation"}
    for name, kind in [("", "all"), *((f"_{kind}", kind) for kind in kinds)]:
        figures |= {f"wide_{c}{name}": f"_{kind}.{c}" for c in ("n", "total", "mean")}
    return figures


def wide_figures(df: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Rows (keys, wide_deviation, and wide_n, wide_total, wide_mean, the same for each kind) of a frame with ``wide`` sums."""
    found = df.select(*keys, *columns(_united_kinds(kinds)))
    return found.select(*keys, *columns(_wide_columns(kinds)))


def with_wide_figures(df: DataFrame, kinds: list[str]) -> DataFrame:
    """The columns of :func:`wide_figures` beside those of a frame whose rows hold their ``wide`` sums; null where a row has none."""
    found = {name: F.expr(f"if(size(wide) > 0, {text}, null)") for name, text in _united_kinds(kinds).items()}
    return with_values(df, found).select(*df.columns, *columns(_wide_columns(kinds)))


def joint_mean(suffix: str = "") -> str:
    """Mean of narrow and wide values from their sums; null without any value. A sum that leaves the
    range of doubles is not needed: the means are weighed then."""
    near = narrow_total(suffix)
    weighed = f"{near} / n{suffix} + wide_mean{suffix} * (wide_n{suffix} / n{suffix})"
    total = f"if(abs(wide_total{suffix}) < 1e300D, ({near} + wide_total{suffix}) / n{suffix}, {weighed})"
    return f"if(n{suffix} > 0, if(wide_n{suffix} > 0, {total}, {near} / n{suffix}), null)"


def deviation_steps() -> dict[str, str]:
    """Steps to the deviation ``spread`` of narrow and wide values together: from both parts and the distance of their means.

    Each step is a column of its own that the next ones read: ``near`` and ``own`` are count and deviation of the narrow values.
    """
    apart = f"if(near > 0, wide_mean - {narrow_total()} / near, 0D)"
    within = "hypot(own * sqrt(near / n), wide_deviation * sqrt(wide_n / n))"
    return {
        "near": "n - coalesce(cast(wide_n as bigint), 0L)",
        "own": f"if(near > 0, {narrow_deviation('near')}, 0D)",
        "spread": f"if(wide_n > 0, hypot({within}, {apart} * sqrt(near / n) * sqrt(wide_n / n)), own)",
    }


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a plain finite number becomes null."""
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER_PATTERN) & (F.abs(value) < float("inf")), value)


def as_number(df: DataFrame, name: str) -> Column:
    """The column as finite double, whether the table holds text or numbers."""
    kind = df.schema[name].dataType.typeName()
    return to_number(F.col(name)) if kind == "string" else finite(F.col(name).cast("double"))


def as_int(df: DataFrame, name: str) -> Column:
    """The column as int, fractions cut off; null where it does not fit."""
    if df.schema[name].dataType.typeName() == "integer":
        return F.col(name)
    return as_number(df, name).try_cast("int")


def to_moment(text: Column) -> Column:
    """ISO date, with an optional time, to timestamp; null when it is not a real date."""
    return F.when(text.rlike(MOMENT_PATTERN), text.try_cast("timestamp"))


def finite(value: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
