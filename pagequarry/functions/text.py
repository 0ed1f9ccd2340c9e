"""Tokens, headings, clean-up and pattern mining as expressions over text columns.

Word characters are Unicode letters, numbers and the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEARCH_TOKEN = r"[\p{L}\p{N}_.]+"
COUNT_TOKEN = r"[\p{L}\p{N}_.+%-]+"
CITATION = r"\[Source:\s*([^,\]]+),\s*page\s*(\d+)\]"
NUMBER = r"\b[\d,]+\.?\d*\b"
YEAR = r"\b(20\d{2}|19\d{2})\b"
PERCENT = r"\b\d+\.?\d*%"

# First words that make a line a heading, characters that end a line, and OCR corrections.
HEADING_WORDS = [
    "1", "2", "3", "4", "5", "6", "7", "8", "9", "10",
    "一", "二", "三", "四", "五", "六", "七", "八", "九", "十",
    "chapter", "section", "part", "abstract", "introduction", "conclusion", "summary", "references", "appendix", "acknowledgements",
]
LINE_ENDS = ".。!?;:»)"
OCR_CELL = ("—–．，（）％¥￥", "--.,()%$$")
OCR_EN = ("—–．（）％¥￥", "--.()%$$")
OCR_ZH = ("（）：，。【】￥—", "():,.[]$-")
OCR_MIXED = ("—–．（）％¥￥：，。【】", "--.()%$$:,.[]")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def search_terms(text: Column, least: int = 2) -> Column:
    """Terms of the search index: camel case is split, lower case, terms of ``least`` characters or more."""
    spaced = F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))
    return F.filter(F.regexp_extract_all(spaced, F.lit(SEARCH_TOKEN), F.lit(0)), lambda x: F.length(x) >= least)


def count_tokens(text: Column) -> Column:
    """Number of tokens by the chunkers' pattern."""
    return F.size(F.regexp_extract_all(text, F.lit(COUNT_TOKEN), F.lit(0)))


def count_spaced(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def heading_level(text: Column, font_size: Column | None = None) -> Column:
    """1-6 where a line is taken for a heading, else null: by markers, section numbers, font size, then first word."""
    return level_of_line(strip(text), font_size)


def level_of_line(s: Column, font_size: Column | None = None) -> Column:
    """``heading_level`` of a line without white space at its ends; what a line begins with decides which patterns are tried."""
    marks = F.length(F.regexp_extract(s, r"^(#{1,6})\s+(.+)", 1))
    number = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\s+", 1)
    depth = F.size(F.split(number, r"\."))
    first = F.regexp_replace(F.lower(F.regexp_extract(s, r"^\S+", 0)), r"\.+$", "")
    digit = F.left(s, F.lit(1)).between("0", "9")
    level = F.when(s == "", F.lit(None).cast("int")).when(s.startswith("#") & (marks > 0), marks).when(digit & (number != "") & (depth <= 3), depth + 1)
    if font_size is not None:
        level = level.when(font_size >= 18, 1).when(font_size >= 15, 2).when(font_size >= 13, 3).when(font_size >= 12, 4)
    return level.when(first.isin(HEADING_WORDS), 2).cast("int")


def clean_paragraph(text: Column) -> Column:
    """One blank for blanks and tabs, lines that go on in lower case are joined, ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n(?=[a-z])", " "))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"^#+\s*", "")


def continued(line: Column) -> Column:
    """A long line that doesn't end a sentence gets a blank for what follows."""
    goes_on = ~F.lit(LINE_ENDS).contains(F.right(line, F.lit(1))) & (F.length(line) > 20)
    return F.when(goes_on, F.concat(line, F.lit(" "))).otherwise(line)


def correct_ocr(text: Column, language: Column | None = None) -> Column:
    """Table cells' corrections, or those of a language (en, zh, anything else: mixed)."""
    if language is None:
        return strip(F.translate(text, *OCR_CELL))
    return strip(F.when(language == "en", F.translate(text, *OCR_EN)).when(language == "zh", F.translate(text, *OCR_ZH)).otherwise(F.translate(text, *OCR_MIXED)))


def escape_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def clean_title(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?i)^(figure|fig\.|fig|chart|exhibit)\s*\d*[:.\s]*", ""))


def augment_query(description: Column, terms: Column) -> Column:
    """The description, with its key terms in brackets where there are any."""
    return F.when(F.size(terms) > 0, F.concat(description, F.lit(" ("), F.array_join(terms, ", "), F.lit(")"))).otherwise(description)


def json_in_text(text: Column) -> Column:
    """The JSON object in a model's reply: in a fenced block, else from the first to the last brace, else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    plain = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(plain != "", plain)


def citations(text: Column) -> Column:
    """array<struct<doc, page>> of [Source: doc, page n] marks."""
    docs = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.zip_with(docs, pages, lambda d, p: F.struct(strip(d).alias("doc"), p.cast("int").alias("page")))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))


def percents(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0))


def first_fifth(text: Column) -> Column:
    """The stand-in for a summary: the first fifth of the words."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    return F.concat(F.array_join(F.slice(words, 1, F.floor(F.size(words) / 5).cast("int")), " "), F.lit(" [... compressed]"))
