"""Text functions as native columns: cleaning, whitespace, token estimates, previews, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

#: White space as Unicode has it, and the four separators that Python also strips.
SPACE = r"(?U)[\s\x1C-\x1F]"

#: The same characters, each by itself.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

#: Characters that cleaning replaces.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
PUNCTUATION = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " "}
SOFT_HYPHEN = "\u00ad"


def strip(c: Column) -> Column:
    """Without white space at both ends. Trimmed, not matched: a pattern would try every gap inside for one at the end."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Runs of non-white-space; an empty array for null or blank text."""
    return F.filter(F.coalesce(F.split(c, rf"{SPACE}+"), F.array().cast("array<string>")), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def estimate_tokens(c: Column) -> Column:
    """One token to four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def clean(c: Column) -> Column:
    """Characters mapped, hyphenated line ends joined, blanks and blank lines collapsed, control characters dropped, stripped."""
    for old, new in LIGATURES.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.translate(c, "".join(PUNCTUATION) + SOFT_HYPHEN, "".join(PUNCTUATION.values()))
    c = F.regexp_replace(c, r"-\n(?U)[\s\x1C-\x1F]*", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.coalesce(strip(c), F.lit(""))


def clean_ocr(c: Column) -> Column:
    """Lines stripped, stray single marks dropped, runs of bars removed, wide gaps narrowed; then ``clean``."""
    lines = F.transform(F.split(c, "\n"), strip)
    kept = F.filter(lines, lambda x: (x == "") | (F.length(x) > 1) | x.rlike(r"^[\p{L}\p{N}]\z"))
    tidy = F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"\|{3,}", ""), rf"{SPACE}{{3,}}", "  "))
    return F.coalesce(clean(F.array_join(tidy, "\n")), F.lit(""))


def table_to_text(rows: Column) -> Column:
    """An array of rows of cells as lines between bars; rows of empty cells go."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda x: F.coalesce(strip(x), F.lit(""))))
    full = F.filter(cells, lambda r: F.exists(r, lambda x: x != ""))
    return F.coalesce(F.array_join(F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n"), F.lit(""))


def needs_ocr(c: Column, force: bool = False, least: int = config.MIN_PAGE_CHARS) -> Column:
    return F.lit(force) | (F.length(F.coalesce(strip(c), F.lit(""))) < least)


def preview(c: Column, most: int = config.PREVIEW_CHARS) -> Column:
    """The first characters, and dots where more follow."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def page_label(start: Column, end: Column, dash: str = "-") -> Column:
    return F.when(start == end, F.concat(F.lit("p."), start.cast("string"))).otherwise(F.concat(F.lit("p."), start.cast("string"), F.lit(dash), end.cast("string")))


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


#: Letters that have a case, as a character class; and the four letters whose title form isn't their capital, with that form.
CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
DIGRAPHS = ("\u01c4\u01c7\u01ca\u01f1", "\u01c5\u01c8\u01cb\u01f2")


def title_case(c: Column) -> Column:
    """Every run of letters that have a case begins with its title form, small letters else, in every script."""
    runs = F.regexp_extract_all(c, F.lit(rf"([{CASED}]+|[^{CASED}]+)"), F.lit(1))

    def shown(x: Column) -> Column:
        first = F.upper(F.substring(x, 1, 1))  # of a letter whose capital is two letters, only the first is one
        return F.concat(F.translate(F.substring(first, 1, 1), *DIGRAPHS), F.lower(F.substring(first, 2, 9)), F.lower(F.substring(x, 2, 1 << 30)))

    return F.array_join(F.transform(runs, shown), "")


#: The same function: it covers every script.
title_case_unicode = title_case


def title_from_path(path: Column) -> Column:
    """A title from a file name: underscores and hyphens are spaces, words have capitals."""
    return title_case(F.translate(stem(path), "_-", "  "))


def highlight(c: Column, terms: list[str]) -> Column:
    """Terms of more than three letters between ``<mark>`` tags, whatever their case."""
    import re

    wanted = [re.escape(t) for t in terms if len(t) > 3]
    return F.regexp_replace(c, "(?i)(" + "|".join(wanted) + ")", "<mark>$1</mark>") if wanted else c


def score_class(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "mid").otherwise("low")
