"""Tag lists that travel as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nearwise.functions.text import strip

_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
_STRING = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_HOLE = "\uffff"  # stands for a string where only the shape of the list matters


def parse_tags(literal: Column | str) -> Column:
    """A list literal such as ``['a', "b's"]`` as an array; null when it is anything but a list of strings.

    Nothing is evaluated. The strings are cut out; what is left must be one pair of brackets with single commas, the
    last of which may follow the last string. Strings side by side are one element. Escapes of two, four and eight
    hexadecimal digits are understood, a backslash before any other character but JSON's escapes is dropped.
    """
    text = F.col(literal) if isinstance(literal, str) else literal
    shape = F.regexp_replace(F.regexp_replace(text, _STRING, _HOLE), r"[ \t\n\r\f]+", "")
    inner = F.substring(shape, F.lit(2), F.length(shape) - 2)
    fits = (
        ~F.contains(text, F.lit(_HOLE)) & F.rlike(shape, F.lit(f"^\\[[{_HOLE},]*\\]$"))
        & ~F.contains(shape, F.lit(",,")) & ~F.startswith(shape, F.lit("[,"))
    )
    strings = F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    widened = F.regexp_replace(F.array_join(strings, ","), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    parsed = F.from_json(F.concat(F.lit("["), _with_long_escapes(widened), F.lit("]")), "array<string>", _OPTIONS)
    runs = F.transform(F.filter(F.split(inner, ","), lambda run: run != ""), F.length)
    return F.when(fits, F.when(F.size(strings) == F.size(runs), parsed).otherwise(_joined(parsed, runs)))


def _with_long_escapes(text: Column) -> Column:
    """Escapes of eight digits replaced by their characters."""
    between = F.split(text, r"\\U[0-9a-fA-F]{8}", -1)
    codes = F.regexp_extract_all(text, F.lit(r"\\U([0-9a-fA-F]{8})"), F.lit(1))
    filled = F.zip_with(between, codes, lambda part, code: F.concat(part, F.coalesce(F.decode(F.unhex(code), "UTF-32"), F.lit(""))))
    return F.when(F.contains(text, F.lit("\\U")), F.array_join(filled, "")).otherwise(text)


def _joined(strings: Column, runs: Column) -> Column:
    """Strings side by side put together: ``runs`` has the number of strings of each element."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put_together(both: Column) -> Column:
        def step(acc: Column, n: Column) -> Column:
            part = F.array_join(F.slice(both["strings"], acc["at"] + 1, n), "")
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))

        return F.aggregate(both["runs"], empty, step, lambda acc: acc["out"])

    # The one-element array binds both once for all steps.
    both = F.struct(strings.alias("strings"), runs.alias("runs"))
    return F.get(F.transform(F.array(both), put_together), F.lit(0))


def render_tags(tags: Column) -> Column:
    """Trimmed non-blank tags joined by a comma and a blank."""
    trimmed = F.transform(tags, strip)
    return F.array_join(F.filter(trimmed, lambda tag: tag != ""), ", ")


def display_tags(literal: Column | str) -> Column:
    """The rendered tag list, or the raw text when it does not parse."""
    text = F.col(literal) if isinstance(literal, str) else literal
    return F.coalesce(render_tags(parse_tags(text)), text)


def tags_literal(tags: Column) -> Column:
    """An array as a single-quoted list literal, the form the CSV files carry."""
    quoted = F.transform(
        tags, lambda tag: F.concat(F.lit("'"), F.regexp_replace(tag, r"([\\'])", r"\\$1"), F.lit("'"))
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
