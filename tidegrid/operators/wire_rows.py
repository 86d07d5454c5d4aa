"""Rows that fail to parse: split wire lines into loaded rows and rejected lines with reasons.

Every column is loaded as nullable text; vectorised rules over that text build an array of
errors for each line, and a line is loaded exactly when its array is empty.  Everything is a
built-in column expression (no Python in the executors, one pass, no shuffle).

Escapes and quoted stretches are masked first: the characters they make ordinary are replaced by
noncharacters (U+FDD0 ...), after which plain splits on space, comma and equals sign give the
structure.  No pattern repeats an alternation, so very long lines cannot exhaust the regex stack.
Noncharacters that a line has itself are written as an escape and a letter first and restored last.

Defined results for odd input:

* null and blank lines, and influx lines beginning with ``#``: neither loaded nor rejected
  (``status`` is ``skipped``);
* one carriage return at the end is ignored, a second one is part of the line;
* repeated lines count each time; a null or unknown format is rejected with ``unknown_format``;
* an empty table gives empty results; columns of the input other than the three named ones never
  collide with the result's because only the named ones are read, plus those in ``keep``;
* an integer time that does not fit 64 bits is valid but loads as a null time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literals that the line protocol accepts as booleans.
BOOLEANS = ["t", "T", "true", "True", "TRUE", "f", "F", "false", "False", "FALSE"]
TRUTHS = BOOLEANS[:5]
# (\z is the very end; a dollar sign would also match before a last line end)
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER = r"^[+-]?[0-9]+\z"
EXACT = "decimal(20,0)"  # holds signed and unsigned 64-bit integers

_BACKSLASH, _COMMA, _SPACE, _EQUALS, _QUOTE = (chr(0xFDD0 + i) for i in range(5))
_SPECIAL, _MASKED = ', ="', _COMMA + _SPACE + _EQUALS + _QUOTE
MASKS = "".join(chr(0xFDD0 + i) for i in range(14))  # all characters that stand for others, here and in sources.formats
_OWN, _OWN_LETTERS = chr(0xFDEF), "abcdefghijklmno"


def has_masks(s: Column) -> Column:
    """Whether text has mask characters of its own."""
    return s.rlike(f"[{MASKS}{_OWN}]")


def guard(s: Column, own: Column | None = None) -> Column:
    """Text without mask characters of its own: each becomes an escape and a letter."""
    marked = F.regexp_replace(F.replace(s, F.lit(_OWN), F.lit(_OWN + _OWN_LETTERS[-1])), f"([{MASKS}])", f"{_OWN}$1")
    return F.when(has_masks(s) if own is None else own, F.translate(marked, MASKS, _OWN_LETTERS[:-1])).otherwise(s)


def unguard(s: Column, own: Column | None = None) -> Column:
    """The text that guard was given; own says whether it had mask characters, so that s is evaluated once where it had none."""
    restore = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.translate(F.substring(p, 1, 1), _OWN_LETTERS, MASKS + _OWN), F.substring(p, F.lit(2), F.length(p))))
    return F.when(s.contains(_OWN) if own is None else own, F.array_join(F.transform(F.split(s, _OWN, -1), restore), "")).otherwise(s)


def _mask_escapes(s: Column) -> Column:
    """Runs of backslashes pair up from the left, so doubled ones go first and a left-over one escapes what follows."""
    s = F.replace(s, F.lit("\\\\"), F.lit(_BACKSLASH))
    for plain, masked in zip(_SPECIAL, _MASKED, strict=True):
        s = F.replace(s, F.lit("\\" + plain), F.lit(masked))
    return s


def _mask_quoted(s: Column, specials: str, masked: str) -> Column:
    """Mask specials between double quotes: every second piece between quote characters lies inside."""
    pieces = F.split(s, '"', -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.translate(p, specials, masked)).otherwise(p)), '"')


def _unmask(s: Column) -> Column:
    return unguard(F.translate(s, _MASKED + _BACKSLASH, _SPECIAL + "\\"), F.col("own"))


def _odd_quotes(s: Column) -> Column:
    return F.size(F.split(s, '"', -1)) % 2 == 0


def _is_number(s: Column) -> Column:
    """A decimal number that is finite as a double (the pattern leaves no other text that casts)."""
    return s.rlike(NUMBER) & (F.abs(s.try_cast("double")) < float("inf"))


def _digits_fit(digits: Column, largest: str) -> Column:
    """Unsigned decimal digits up to largest, whatever their number."""
    d = F.regexp_replace(digits, "^0+", "")
    return (F.length(d) < len(largest)) | ((F.length(d) == len(largest)) & (d <= largest))


def _value_kind(v: Column) -> Column:
    body = F.substring(v, 1, F.length(v) - 1)
    return (
        F.when(_is_number(v), "float")
        .when(v.rlike(r"^[+-]?[0-9]+i\z") & body.try_cast("bigint").isNotNull(), "int")
        .when(v.rlike(r"^[0-9]+u\z") & _digits_fit(body, str(2**64 - 1)), "uint")
        .when(v.isin(BOOLEANS), "bool")
        .when(v.rlike(r'^"[^"]*"\z'), "string")
    )


def _errors(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)), lambda e: e.isNotNull())


def _bad_pair(kv: Column) -> Column:
    return (F.size(kv) != 2) | (F.get(kv, F.lit(0)) == "") | (F.coalesce(F.get(kv, F.lit(1)), F.lit("")) == "")


def classify_lines(df: DataFrame, line_id: str = "line_id", fmt: str = "fmt", line: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line: line_id, the columns in keep, fmt, line, status, errors and the masked pieces.

    ``status`` is ``valid``, ``rejected`` or ``skipped``; ``errors`` is empty unless rejected.
    """
    base = df.select(F.col(line_id).alias("line_id"), *keep, F.col(fmt).cast("string").alias("fmt"), F.col(line).cast("string").alias("line"))
    text = F.when(F.col("line").endswith("\r"), F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    d = base.withColumn("text", text).withColumn("own", has_masks(F.col("text")))
    influx, csv = F.col("fmt") == "influx", F.col("fmt") == "csv"

    # influx: head is measurement and tags, rest is fields and time
    d = d.withColumn("esc", F.when(influx, _mask_escapes(guard(F.col("text"), F.col("own")))))
    d = d.withColumn("head", F.substring_index("esc", " ", 1))
    d = d.withColumn("rest", F.ltrim(F.substring("esc", F.length("head") + 1, F.length("esc"))))
    d = d.withColumn("tail", F.rtrim(_mask_quoted(F.col("rest"), ", =", _MASKED[:3])))
    d = d.withColumn("sections", F.split("tail", " +", -1))
    pairs = lambda parts: F.transform(parts, lambda p: F.split(p, "=", -1))
    d = d.withColumn("head_parts", F.split("head", ",", -1)).withColumn("field_kv", pairs(F.split(F.get("sections", F.lit(0)), ",", -1)))
    d = d.withColumn("tag_kv", pairs(F.slice("head_parts", 2, F.greatest(F.size("head_parts") - 1, F.lit(0)))))
    d = d.withColumn("kinds", F.transform("field_kv", lambda kv: F.when(F.size(kv) == 2, _value_kind(F.get(kv, F.lit(1)))).otherwise("")))
    influx_errors = _errors(
        (F.get("head_parts", F.lit(0)) == "", "empty_measurement"),
        (F.exists("tag_kv", _bad_pair), "bad_tag"),
        (F.col("tail") == "", "no_fields"),
        (_odd_quotes(F.col("rest")), "unbalanced_quotes"),
        (F.size("sections") > 2, "too_many_sections"),
        ((F.col("tail") != "") & F.exists("field_kv", _bad_pair), "bad_field"),
        ((F.col("tail") != "") & F.exists("kinds", lambda k: k.isNull()), "bad_field_value"),
        ((F.size("sections") == 2) & ~F.get("sections", F.lit(1)).rlike(INTEGER), "bad_time"),
    )

    # csv: cells after masking commas between quotes
    d = d.withColumn("cells", F.when(csv, F.split(_mask_quoted(guard(F.col("text"), F.col("own")), ",", _COMMA), ",", -1)))

    def quoted(c: Column) -> Column:
        return (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')

    def inner(c: Column) -> Column:
        return F.substring(c, F.lit(2), F.length(c) - 2)

    cell_bad = F.exists("cells", lambda c: c.contains('"') & ~(quoted(c) & ~F.replace(inner(c), F.lit('""'), F.lit("")).contains('"')))
    d = d.withColumn("plain", F.transform("cells", lambda c: unguard(F.translate(F.when(quoted(c), F.replace(inner(c), F.lit('""'), F.lit('"'))).otherwise(c), _COMMA, ","), F.col("own"))))

    def cell(i: int) -> Column:
        return F.get("plain", F.lit(i))

    six = F.size("cells") == 6
    csv_errors = _errors(
        (~six, "column_count"),
        (_odd_quotes(F.col("text")) | cell_bad, "bad_quoting"),
        (six & ~cell(0).rlike(INTEGER), "bad_time"),
        (six & (cell(1) == ""), "empty_measurement"),
        (six & (cell(4) == ""), "empty_field"),
        (six & ~_is_number(cell(5)), "bad_field_value"),
    )
    skipped = F.col("line").isNull() | F.col("text").rlike(r"^[\s\p{Z}\x1c-\x1f\x85]*\z") | (influx & F.col("line").startswith("#"))
    none = F.array().cast("array<string>")
    errors = F.when(F.coalesce(skipped, F.lit(False)), none).when(influx, influx_errors).when(csv, csv_errors).otherwise(F.array(F.lit("unknown_format")))
    d = d.withColumn("errors", errors)
    d = d.withColumn("status", F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(F.size("errors") > 0, "rejected").otherwise("valid"))
    # a number that the optimiser cannot move: filters on the status stay above, so that nothing is evaluated twice for them
    return d.select("line_id", *keep, "fmt", "line", "status", "errors", "own", "head_parts", "tag_kv", "field_kv", "kinds", "sections", "plain", F.monotonically_increasing_id().alias("line_no"))


def rejected_lines(df: DataFrame, **names) -> DataFrame:
    """line_id, fmt, line, errors of every line that is not valid."""
    return classify_lines(df, **names).where("status = 'rejected' and line_no >= 0").select("line_id", "fmt", "line", "errors")


def loaded_rows(df: DataFrame, **names) -> DataFrame:
    """line_id, fmt, measurement, ts_raw, ts, tags, fields of every valid line.

    ``tags`` maps key to value, the last of repeated keys winning; ``fields`` is an array of
    (key, kind, number, exact, text): integers are exact in ``exact`` (decimal, as unsigned ones exceed a
    bigint) and, like booleans, as the nearest double in ``number``; strings are only in ``text``.
    """
    d = classify_lines(df, **names).where("status = 'valid' and line_no >= 0")
    influx = F.col("fmt") == "influx"

    influx_tags = F.transform("tag_kv", lambda t: F.struct(_unmask(F.get(t, F.lit(0))).alias("key"), _unmask(F.get(t, F.lit(1))).alias("value")))
    csv_tags = F.filter(F.array(F.struct(F.lit("host").alias("key"), F.get("plain", F.lit(2)).alias("value")), F.struct(F.lit("zone").alias("key"), F.get("plain", F.lit(3)).alias("value"))), lambda t: t["value"] != "")

    def typed(kv: Column, kind: Column) -> Column:
        v = F.get(kv, F.lit(1))
        body = F.substring(v, F.lit(1), F.length(v) - 1)
        number = F.when(kind == "float", v.try_cast("double")).when(kind.isin("int", "uint"), body.try_cast("double")).when(kind == "bool", v.isin(TRUTHS).cast("double"))
        exact = F.when(kind.isin("int", "uint"), body.try_cast(EXACT))
        text = F.when(kind == "string", _unmask(F.substring(v, F.lit(2), F.length(v) - 2)))
        return F.struct(_unmask(F.get(kv, F.lit(0))).alias("key"), kind.alias("kind"), number.alias("number"), exact.alias("exact"), text.alias("text"))

    csv_field = F.array(F.struct(F.get("plain", F.lit(4)).alias("key"), F.lit("float").alias("kind"), F.get("plain", F.lit(5)).try_cast("double").alias("number"), F.lit(None).cast(EXACT).alias("exact"), F.lit(None).cast("string").alias("text")))
    distinct_last = lambda t: F.map_from_entries(F.filter(t, lambda x, i: ~F.exists(F.slice(t, i + 2, F.size(t)), lambda y: y["key"] == x["key"])))
    raw = F.when(influx, F.get("sections", F.lit(1))).otherwise(F.get("plain", F.lit(0)))
    return d.select(
        "line_id",
        "fmt",
        F.when(influx, _unmask(F.get("head_parts", F.lit(0)))).otherwise(F.get("plain", F.lit(1))).alias("measurement"),
        raw.alias("ts_raw"),
        raw.try_cast("bigint").alias("ts"),
        distinct_last(F.when(influx, influx_tags).otherwise(csv_tags)).alias("tags"),
        F.when(influx, F.zip_with("field_kv", "kinds", typed)).otherwise(csv_field).alias("fields"),
    )
