"""Cleaners and keys for titles, authors, tags and descriptions, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label, suffix, sentinel and word lists that decide results.
ENGLISH_LABELS = ("en", "eng", "english")
UNKNOWN_LABELS = ("", "nan", "none", "unknown", "und", "undetermined")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")
NO_DESCRIPTION, NO_SUBJECT = "No description available", "[NO_SUBJECT]"
UNINFORMATIVE_TAGS = (
    "fiction", "general", "adult", "novels", "literature", "nonfiction", "audiobook", "large type books",
    "juvenile fiction", "contemporary", "classics", "short stories", "adult fiction", "literary fiction",
    "american", "english", "british literature", "american literature", "juvenile literature", "reference",
)
FUNCTION_WORDS = (
    "the and of to in is was he she his her it with for that on as by this are from at or but not "
    "have has they their who which will when into be been"
).split()
STOP_WORDS = (
    "about above after again against all am an and any are as at be because been before being below between both but by can "
    "could did do does doing down during each few for from further had has have having he her here hers herself him himself his "
    "how if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves "
    "out over own same she should so some such than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with would you your yours "
    "yourself yourselves"
).split()
LETTERS, WORD_CHARACTER = r"[\p{L}\p{Nl}\p{No}]", r"[\p{L}\p{N}_]"


def _accents() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one plain letter and marks, and those letters."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if c == c.lower() and len(plain) == 1 and plain[0] != c and plain[0].isascii():
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fold(c: Column) -> Column:
    """Caseless text without accents; other scripts keep their letters (see udf.fold_any for all of Unicode)."""
    return F.translate(F.regexp_replace(casefold(c), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def without_parentheses(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\(.*?\)", "")


def is_english(c: Column, keep_missing: bool = True) -> Column:
    label = casefold(F.trim(c))
    known = label.isin(*ENGLISH_LABELS)
    return F.when(c.isNull() | label.isin(*UNKNOWN_LABELS), F.lit(keep_missing)).otherwise(known)


def normalize_title(c: Column) -> Column:
    t = F.regexp_replace(fold(c), r"\s*\(.*?\)|\s*\[.*?\]", "")
    t = F.replace(F.split_part(t, F.lit(":"), F.lit(1)), F.lit("&"), F.lit(" and "))
    t = collapsed(F.regexp_replace(t, r"[^\p{L}\p{N}_ ]", ""))
    return empty_to_null(F.regexp_replace(t, r"^(the|a|an) ", ""))


def any_script_key(c: Column) -> Column:
    """A caseless, accentless key for every script, to group and join by: the string under an ICU collation of primary strength.

    Where both are defined it joins what casefolded strings without combining marks join, and more: characters that ICU
    ranks alike at that strength, such as full-width forms, ligatures and the Greek final sigma.
    """
    return F.collate(c, "UNICODE_CI_AI")


def display_author(c: Column) -> Column:
    name = F.trim(without_parentheses(c))
    parts = F.split(name, ",", -1)
    last, first = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    suffix = F.regexp_replace(casefold(first), r"^\.+|\.+$", "").isin(*NAME_SUFFIXES)
    swapped = F.when(suffix, F.concat(last, F.lit(" "), first)).otherwise(F.concat(first, F.lit(" "), last))
    return empty_to_null(collapsed(F.when(F.size(parts) == 2, swapped).otherwise(name)))


def author_key(c: Column) -> Column:
    tokens = F.regexp_extract_all(fold(display_author(c)), F.lit(f"({LETTERS}+)"))
    tokens = F.filter(tokens, lambda t: ~t.isin(*NAME_SUFFIXES))
    last = F.try_element_at(tokens, F.lit(-1))
    initial = F.substring(F.get(tokens, F.lit(0)), 1, 1)
    return F.when(F.size(tokens) == 1, last).when(F.size(tokens) > 1, F.concat(last, F.lit("_"), initial))


def clean_description(c: Column, least: int = 50) -> Column:
    text = collapsed(F.regexp_replace(c, r"<[^>]+>", " "))
    return F.when(F.length(text) >= least, text)


def first_author_by_comma(c: Column) -> Column:
    """Cuts at the comma before it strips parentheses, so a comma within them leaves an open one."""
    return empty_to_null(F.trim(without_parentheses(F.split_part(c, F.lit(","), F.lit(1)))))


def first_author_by_semicolon(c: Column) -> Column:
    return display_author(F.split_part(c, F.lit(";"), F.lit(1)))


def list_literal(c: Column) -> Column:
    """Quoted lists to arrays; anything else to an empty array (udf.any_list_literal reads all flat lists)."""
    parsed = F.from_json(c, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def count_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def combine_tags(*columns: Column) -> Column:
    joined = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])
    tags = F.transform(joined, lambda t: casefold(F.trim(t)))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))


def match_key(title: Column, author: Column) -> Column:
    return F.concat(normalize_title(title), F.lit("|"), author_key(author))


def model_text(title: Column, tags: Column, description: Column, most_tags: int = 10) -> Column:
    tags = F.array_join(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, most_tags), ", ")
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), tags, F.lit(". "), F.coalesce(description, F.lit("")))


def snippet(c: Column, most: int = 300) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, most), r" [^ ]*$", "")
    return F.when(F.length(c) > most, F.concat(cut, F.lit("…"))).otherwise(c)


def informative_tags(tags: Column) -> Column:
    return F.array_except(combine_tags(tags), F.array(*map(F.lit, UNINFORMATIVE_TAGS)))


def function_word_ratio(c: Column) -> Column:
    """Share of letter runs that are English function words; null for null, 0 without words."""
    words = F.regexp_extract_all(casefold(c), F.lit(f"({LETTERS}+)"))
    # Named in a lambda, the words are found once, not once for each use.
    share = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS))) / F.size(w)))
    return F.when(c.isNotNull(), F.get(share, F.lit(0)))


def is_english_text(c: Column, least: float = 0.05) -> Column:
    return F.coalesce(function_word_ratio(c) >= least, F.lit(False))


def normalized_text(c: Column) -> Column:
    return collapsed(casefold(c))


def title_and_subtitle(title: Column, subtitle: Column) -> Column:
    return F.concat(title, F.coalesce(F.concat(F.lit(": "), subtitle), F.lit("")))


def edition_year(c: Column) -> Column:
    four = empty_to_null(F.regexp_extract(c, r"(\d{4})", 1)).cast("int")
    two = empty_to_null(F.regexp_extract(c, r"^\d{2}/\d{2}/(\d{2})$", 1)).cast("int")
    return F.coalesce(four, two + F.when(two <= 20, 2000).otherwise(1900))


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")


def year_of(c: Column) -> Column:
    return F.year(F.try_to_timestamp(c))


def tokens(c: Column) -> Column:
    """Words of two and more letters, lower-cased, that touch no digit or underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"((?<!{WORD_CHARACTER}){LETTERS}{{2,}}(?!{WORD_CHARACTER}))"))


def word_trigrams(c: Column) -> Column:
    """3-grams of every word with a space at either end."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))
