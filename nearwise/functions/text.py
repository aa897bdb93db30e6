"""Text cleaning as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nearwise.functions.romanize import has_devanagari, romanize

# The 32 ASCII punctuation characters, and every character Unicode calls white space
# (Java's \s alone misses the separators U+001C-U+001F, U+0085 and the Z categories).
PUNCTUATION = r"!-/:-@\[-`{-~"
WHITE_SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    """Each run of white space becomes one blank; none remains at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "))


def clean_query_text(text: Column | str) -> Column:
    """Lowercase words without ASCII punctuation; null becomes the empty string.

    One pattern covers punctuation and white space, so the text is scanned once.
    """
    lowered = F.lower(F.coalesce(_col(text), F.lit("")))
    return F.trim(F.regexp_replace(lowered, f"[{PUNCTUATION}{WHITE_SPACE}]+", " "))


def clean_index_text(text: Column | str) -> Column:
    """The lowercased text followed by its lowercased romanised form; punctuation is kept.

    Text without Devanagari appears twice, which changes term counts but not term shares; it is cleaned
    once and repeated.
    """
    source = F.coalesce(_col(text), F.lit(""))
    both = collapse_space(F.concat_ws(" ", F.lower(source), F.lower(romanize(source))))
    twice = F.trim(F.repeat(F.concat(collapse_space(F.lower(source)), F.lit(" ")), 2))
    return F.when(has_devanagari(source), both).otherwise(twice)


CLEANERS = {"index": clean_index_text, "query": clean_query_text}


def add_combined_text(
    records: DataFrame, columns: tuple[str, ...] = ("name", "description", "tags"), cleaner: str = "index"
) -> DataFrame:
    """Add ``cleaned_<column>`` for every column and their blank-joined ``combined_text``."""
    clean = CLEANERS[cleaner]
    names = [f"cleaned_{column}" for column in columns]
    cleaned = records.withColumns({name: clean(column) for name, column in zip(names, columns)})
    return cleaned.withColumn("combined_text", F.concat_ws(" ", *names))


def tokens(clean_text: Column | str) -> Column:
    """The blank-separated words of a cleaned text; none for the empty text."""
    return F.filter(F.split(_col(clean_text), " "), lambda word: word != "")


def title_case(text: Column | str) -> Column:
    """Upper-case the first letter of each run of cased letters and lower-case the others.

    ``initcap`` starts a word only after white space; here one also starts after an apostrophe or a dash.
    """
    runs = F.regexp_extract_all(
        F.lower(_col(text)), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    return F.array_join(F.transform(runs, F.initcap), "")


def four_decimals(number: Column | str) -> Column:
    """A score rendered with four decimals, rounding the number's exact binary value.

    ``format_string`` alone rounds the shortest decimal form, so 0.32575 (stored slightly below that)
    would become 0.3258. The product with 10,000 is split into its rounded value and its rounding error.
    """
    size = F.abs(_col(number))
    stretched = size * F.lit(134217729.0)
    high = stretched - (stretched - size)
    product = size * 10000.0
    error = (high * 10000.0 - product) + (size - high) * 10000.0
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = F.format_string("%.4f", (whole + F.when(up, 1.0).otherwise(0.0)) / 10000.0)
    text = F.when(size < 1e11, rounded).otherwise(F.format_string("%.4f", size))
    return F.when(_col(number) < 0, F.concat(F.lit("-"), text)).when(size.isNotNull(), text)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
