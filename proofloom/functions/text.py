"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params

#: Lines that are numbers, page marks, table heads, short capitals, or a dated row of numbers.
NUMERIC_ROW = r"^[\d\s\(\),\.\-]+$"
PAGE_MARK = r"(?i)^\d+\s*\|\s*P\s*a\s*g\s*e$"
TABLE_HEAD = r"(?i)^(Month\s*End|FCA|Gold|SDR|RTP|Forex\s*Reserves|USD\s*Million|Rs\.?\s*Crore|Table\s*\d+|Chart\s*\d+).*$"
CAPITALS = r"^[A-Z\s\-\.]{1,30}$"
DATED_ROW = r"^[A-Za-z]+-\d{2,4}\s+[\d\s\(\),\.\-]+$"
CAPITALS_BELOW = 25


def words(text: Column) -> Column:
    """Runs without white space, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, r"\s+"), ""), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    return words(F.lower(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def noise(line: Column) -> Column:
    """Whether a stripped line is not prose."""
    return (line == "") | line.rlike(NUMERIC_ROW) | line.rlike(PAGE_MARK) | line.rlike(TABLE_HEAD) | (line.rlike(CAPITALS) & (F.length(line) < CAPITALS_BELOW)) | line.rlike(DATED_ROW)


def strip_noise(text: Column) -> Column:
    """The prose lines of a text, joined by single spaces."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: ~noise(x)), " ")


def strip_fence(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(json)?", ""), r"```$", ""))


def sentences(text: Column) -> Column:
    """Split after . ! or ? that white space follows; stands in for a model's splitter."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def focused(text: Column, score, least: int, top: int, cut: int) -> Column:
    """The `top` sentences of most score, in text order, of those longer than least; without any, the text's first characters.

    Table noise goes first. score(sentence, place) stands in for a model's similarity; of equals the earlier counts more.
    """
    clean = strip_noise(text)
    long = F.filter(sentences(clean), lambda x: F.length(x) > least)
    rated = F.transform(long, lambda x, i: F.struct((-score(x, i)).alias("s"), i.alias("i"), x.alias("x")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(rated), 1, top), lambda r: F.struct(r["i"].alias("i"), r["x"].alias("x"))))
    chosen = F.array_join(F.transform(F.when(F.size(long) <= top, F.transform(long, lambda x, i: F.struct(i.alias("i"), x.alias("x")))).otherwise(best), lambda r: r["x"]), " ")
    return F.when(F.size(long) == 0, F.substring(F.when(clean != "", clean).otherwise(text), 1, cut)).otherwise(chosen)


def prepared(text: Column, score, p: Params, strip_first: bool = True) -> Column:
    """A passage as a model reads it: focused if it has more than p.focus_words words, else as it is.

    With strip_first, table noise goes before the words are counted and from short passages too; without, a short passage
    stays as it came.
    """
    own = strip_noise(text) if strip_first else text
    return F.when(F.size(words(own)) > p.focus_words, focused(own, score, p.min_sentence, p.top_sentences, p.passage_cut)).otherwise(own)


def shortened(text: Column, n: int) -> Column:
    """A text of more than n characters as its first n and three dots."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def fixed(x: Column, places: int) -> Column:
    """A double with so many decimal places: its exact binary value is rounded, and a tie goes to the even digit."""
    x = x.cast("double")
    shown = F.call_function("format_number", x, F.lit("0." + "0" * places))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(shown)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case and without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1_000_000)))
