"""Secret scans with DataFrame functions only.

Base patterns, leftmost and non-overlapping: ``assign`` (a key word, a sign and a value of 12 or more
characters), ``access`` (an access key id of 18 or more) and ``hex`` (16 or more lower-case hex
digits). Positions come from the pieces between matches: a match starts after all pieces and
matches before it.

The method adds ``entropy`` spans: candidate strings of ``WINDOW`` or more characters of the widest
class, not covered by one base span, whose best window has an entropy of at least the threshold of the narrowest
class that holds the string. The entropy of a window is log2(w) - S / w with S the sum of c * log2(c)
over its character counts, which a step carries on: it changes only those of the character that leaves and the one
that enters. Strings on the allow list are left out.

Defined cases: a null text counts as empty; offsets are code points, ends exclusive; repeated rows are
judged one by one; empty tables give no rows; other columns are not read, and ``redacted`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import once, with_values

# Base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"([A-Za-z0-9+/_=-]{{{WINDOW},}})"
#: Character classes from narrow to wide with the least entropy, in bits, of a secret's best window.
CLASSES = (("^[0-9A-Fa-f]+$", 3.0), ("^[A-Z0-9]+$", 3.5), ("^[A-Za-z0-9]+$", 3.8), ("", 4.0))
#: A secret holds a digit and a letter.
MIXED = "[0-9].*[A-Za-z]|[A-Za-z].*[0-9]"
#: Strings that are no secrets: unique ids, published examples, alphabets, digests named as such, paths.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^(?:sha(?:1|256|512)|md5)[-_=]",
    r"^/?(?:[a-z_-]{2,}/){2,}",
)
MASK = "[SECRET]"
SPAN = "array<struct<start:long,kind_no:int,end:long>>"


def _xlogx(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def best_entropy(text: Column, width: int = WINDOW) -> Column:
    """Largest entropy of a window of ``width`` characters; the text has at least so many.

    Characters are numbered by their first place in the text. The state holds the counts of the window by number.
    """

    def numbered(chars: Column) -> Column:
        return once(F.array_distinct(chars), lambda known: F.transform(chars, lambda c: F.array_position(known, c).cast("int")))

    def least_sum(numbers: Column) -> Column:
        def count(k: Column) -> Column:
            return F.size(F.filter(F.slice(numbers, 1, width), lambda c: c == k))

        def step(state: Column, i: Column) -> Column:
            old, new, counts = F.get(numbers, i), F.get(numbers, i + width), state["counts"]
            leaving, entering = F.element_at(counts, old).cast("double"), F.element_at(counts, new).cast("double")
            s = state["s"] - _xlogx(leaving) + _xlogx(leaving - 1) + _xlogx(entering + 1) - _xlogx(entering)
            moved = F.transform(counts, lambda c, k: c - (k + 1 == old).cast("int") + (k + 1 == new).cast("int"))
            one = once(s, lambda v: F.struct(moved.alias("counts"), v.alias("s"), F.least(state["least"], v).alias("least")))
            return F.when(old == new, state).otherwise(one)

        counts = F.transform(F.sequence(F.lit(1), F.array_max(numbers)), count)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, n: s + _xlogx(n.cast("double")))
        first = once(counts, lambda c: once(total(c), lambda s: F.struct(c.alias("counts"), s.alias("s"), s.alias("least"))))
        last = F.size(numbers) - width
        moves = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(moves, first, step)["least"]

    least = once(F.filter(F.split(text, ""), lambda c: c != ""), lambda chars: once(numbered(chars), least_sum))
    return math.log2(width) - least / width


def _matches(text: Column, test: Column, pattern: str, groups: tuple[int, ...]) -> dict[str, Column]:
    """Pieces between the matches of a text that passes ``test``, and the groups of each match."""
    found = {"gaps": F.split(text, pattern, -1)}
    found |= {f"g{g}": F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups}
    none = F.array().cast("array<string>")
    return {k: F.when(test, v).otherwise(none) for k, v in found.items()}


def _spans(gaps: Column, hits: Column, kind: int, keep: Column) -> Column:
    """Spans of the matches that ``keep`` (an array of booleans) marks."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gaps"])
        end = start + F.length(row["hits"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind_no"), end.alias("end"))
        out = F.when(row["keep"], F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    rows = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gaps"), hits.alias("hits"), keep.alias("keep"))
    return F.when(F.size(hits) > 0, F.aggregate(rows, empty, add)["out"]).otherwise(F.array().cast(SPAN))


def secret_spans(text: Column, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_assign``, ``_access``, ``_hex`` and ``_entropy``: spans in ``text`` by kind."""
    text = F.coalesce(text, F.lit(""))
    tests = {
        "assign": (ASSIGN, F.rlike(text, F.lit(ASSIGN)), (0, 2)),
        "access": (ACCESS, F.contains(text, F.lit("AKIA")), (0,)),
        "hex": (f"([0-9a-f]{{{HEX_LEAST},}})", F.rlike(text, F.lit(f"[0-9a-f]{{{HEX_LEAST}}}")), (0,)),
        "entropy": (CANDIDATE, F.rlike(text, F.lit(CANDIDATE)), (0,)),
    }
    parts = {
        f"_{kind}_{k}": v for kind, (pattern, test, groups) in tests.items()
        for k, v in _matches(text, test, pattern, groups).items()
    }
    rows = with_values(rows, parts)
    long = {
        "assign": F.transform("_assign_g2", lambda v: F.length(v) >= ASSIGN_LEAST),
        "access": F.transform("_access_g0", lambda v: F.length(v) >= ACCESS_LEAST),
        "hex": F.transform("_hex_g0", lambda v: F.length(v) >= HEX_LEAST),
        "entropy": F.transform("_entropy_g0", _is_random),
    }
    spans = {
        f"_{kind}": _spans(F.col(f"_{kind}_gaps"), F.col(f"_{kind}_g0"), no, long[kind]) for no, kind in enumerate(KINDS)
    }
    rows = with_values(rows, spans).drop(*parts)
    base = F.concat("_assign", "_access", "_hex")
    added = F.filter("_entropy", lambda e: ~F.exists(base, lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"])))
    return with_values(rows, {"_entropy": added})


def _is_random(value: Column) -> Column:
    least = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        least = F.lit(bits) if not pattern else F.when(F.rlike(value, F.lit(pattern)), bits).otherwise(least)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(value, F.lit(pattern))
    return F.when(F.rlike(value, F.lit(MIXED)) & ~allowed, best_entropy(value) >= least).otherwise(False)


def found_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, spans by kind (arrays of start, kind_no, end), sorted base and all spans."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text"))
    rows = secret_spans(F.col("_text"), rows).drop("_text")
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    return rows.select(
        "doc_id", *[F.col(f"_{k}").alias(k) for k in KINDS], base.alias("base"),
        F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy")).alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind_no"]), s["start"], s["end"])), ","
    )


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """Documents with every span replaced by ``mask``; overlapping spans become one.

    All columns stay; ``n_chars``, where it is a column, is counted anew for changed texts.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = secret_spans(F.col("_doc.text"), packed)
    spans = F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy"))
    text = F.col("_doc.text")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(state: Column, span: Column) -> Column:
        gap = text.substr((state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        parts = F.when(span["start"] >= state["at"], F.concat(state["parts"], F.array(gap, F.lit(mask)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    whole = once(
        F.aggregate(spans, empty, cut),
        lambda s: F.concat(F.array_join(s["parts"], ""), text.substr((s["at"] + 1).cast("int"), F.length(text))),
    )
    some = F.size(spans) > 0
    rows = with_values(rows, {"_new": F.when(some, whole).otherwise(text), "_some": some})
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_some"), F.length("_new")).otherwise(F.col("_doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
