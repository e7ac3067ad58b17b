"""Column expressions on text: analysis, keys, identifiers, citations. All null-safe: null gives null or an empty array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyser's word pattern and its ranges of CJK characters (ideographs, kana, hangul).
WORD = r"[A-Za-z0-9]+(?:[._\-][A-Za-z0-9]+)*"
CJK_CHAR = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
CJK = CJK_CHAR + "+"


def words(text: Column) -> Column:
    """Lower-case words in order, with repeats."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def cjk_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CJK), F.lit(0))


def bigrams(runs: Column) -> Column:
    """Every two neighbouring characters of each run; a run of one character stays whole."""
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: r.substr(i, F.lit(2)))))


def tokens(text: Column) -> Column:
    """Words, then bigrams of CJK runs."""
    return F.concat(words(text), bigrams(cjk_runs(text)))


def query_tokens(text: Column) -> Column:
    """Tokens, and the single characters of CJK runs of more than two."""
    long = F.filter(cjk_runs(text), lambda r: F.length(r) > 2)
    return F.concat(tokens(text), F.flatten(F.transform(long, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: r.substr(i, F.lit(1))))))


def normalized(text: Column) -> Column:
    """Lower case with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def item_key(*parts: Column) -> Column:
    """32 hexadecimal digits that stay the same however the parts are spaced or cased."""
    return F.substring(F.sha2(F.concat_ws("|", *[normalized(F.coalesce(p, F.lit(""))) for p in parts]), 256), 1, 32)


def safe_id(text: Column, most: int | None = 64) -> Column:
    out = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_.\-]", "_")
    return out if most is None else F.substring(out, 1, most)


def deadline(text: Column) -> Column:
    """The date in the first ten characters as yyyy-MM-dd, else ''."""
    return F.coalesce(F.date_format(F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-M-d"), "yyyy-MM-dd"), F.lit(""))


def priority(text: Column) -> Column:
    name = F.lower(F.trim(text))
    return F.when(name == "low", "Low").when(name == "high", "High").when(name == "urgent", "Highest").otherwise("Medium")


def citations(text: Column, sources: Column) -> Column:
    """Distinct [n] of an answer in order of first use, 1 <= n <= sources."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= sources)))


def phrases(text: Column) -> Column:
    """All stretches of 4 and of 6 characters of the text without white space."""
    bare = F.regexp_replace(text, r"\s+", "")

    def of(n: int) -> Column:
        return F.when(F.length(bare) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1))), lambda i: bare.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(4), of(6)))


def citation(title: Column, section: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(title, F.lit(" / "), section)).otherwise(title)


def clock_line(start: Column, end: Column, speaker: Column, text: Column) -> Column:
    return F.format_string("[%.1fs-%.1fs] %s: %s", start, end, speaker, text)


def salvaged_json(text: Column) -> Column:
    """The text if it is JSON, else what lies from the first { to the last } if that is, else null."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull(), inner)
