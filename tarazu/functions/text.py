"""Text expressions: digit folding, Persian normalisation, scripts, keys for equal texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three digit systems.
LATIN, PERSIAN, ARABIC = "0123456789", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
#: Arabic letters and their Persian forms.
ARABIC_LETTERS, PERSIAN_LETTERS = "يكىة", "یکیه"
ZWNJ = "‌"
#: Verbal prefixes; words that no verb starts with, before which می is a noun; suffixes that are written after a joiner; those that follow a silent ه only; words that merely end like a plural.
VERB_PREFIXES = ("می", "نمی")
NO_VERBS = ("و", "که", "را", "از", "به", "با", "در", "تا", "است", "بود", "هم", "یا")
SUFFIXES = ("ها", "های", "هایی", "هایم", "هایت", "هایش", "هایمان", "هایتان", "هایشان", "تر", "تری", "ترین")
AFTER_HE = ("ام", "ات", "اش", "ای", "ایم", "اید", "اند", "مان", "تان", "شان")
NO_PLURALS = ("تنها", "تنهای", "تنهایی", "بها", "بهای", "بهایی", "رها", "رهای", "رهایی", "انتها", "انتهای", "انتهایی", "منتها", "منتهای", "التها", "اژدها", "اژدهای")


def fold_digits(c: Column) -> Column:
    """Persian and Arabic-Indic digits as Latin ones."""
    return F.translate(c, PERSIAN + ARABIC, LATIN + LATIN)


def to_persian_digits(c: Column) -> Column:
    return F.translate(c, LATIN + ARABIC, PERSIAN + PERSIAN)


def swap_digits(c: Column) -> Column:
    """Latin digits as Persian ones and the reverse; doing it twice changes nothing."""
    return F.translate(c, LATIN + PERSIAN, PERSIAN + LATIN)


def _one_of(words: tuple[str, ...]) -> str:
    """The words as alternatives, longest first."""
    return f"(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})"


def place_zwnj(c: Column) -> Column:
    """Zero-width non-joiners where they belong in Persian text of single spaces; doing it twice changes nothing. Null stays null.

    They replace the space behind a verbal prefix (می رود), before a plural, possessive or comparative suffix (کتاب های من)
    and, behind ه, before an ending (رفته ام), and part a plural suffix written onto its word (کتابهایش) unless the word is
    one of NO_PLURALS. A stray one beside anything but a letter goes. Each space is judged by its neighbours as they
    were, and a suffix before a joiner counts for none, so what one step joins never lets another join more.
    """
    letter, end, start = r"[\p{L}\p{M}]", rf"(?![\p{{L}}\p{{M}}{ZWNJ}])", rf"(?<![\p{{L}}\p{{M}}{ZWNJ}])"
    c = F.regexp_replace(c, f"(?<!{letter}){ZWNJ}+|{ZWNJ}+(?!{letter})", "")
    prefixed = "|".join(f"(?<={start}{w})" for w in VERB_PREFIXES)
    verb = rf"(?:{prefixed}) (?=\p{{IsArabic}})(?=\p{{L}})(?!{_one_of(NO_VERBS)}(?!{letter}))"
    suffixed = rf"(?<=[\p{{L}}&&\p{{IsArabic}}]) (?={_one_of(SUFFIXES)}{end})"
    ending = f"(?<=ه) (?={_one_of(AFTER_HE)}{end})"
    c = F.regexp_replace(c, f"{verb}|{suffixed}|{ending}", ZWNJ)
    plural = _one_of(tuple(w for w in SUFFIXES if w.startswith("ها")))
    return F.regexp_replace(c, rf"{start}(?!{_one_of(NO_PLURALS)}{end})([\p{{L}}&&\p{{IsArabic}}]{{2,30}}?)({plural}){end}", f"$1{ZWNJ}$2")


def normalize(c: Column, digits: str = "latin") -> Column:
    """Persian letters for Arabic ones, one digit policy, single spaces, zero-width non-joiners once and where place_zwnj puts them. Doing it twice changes nothing."""
    c = F.translate(c, ARABIC_LETTERS, PERSIAN_LETTERS)
    c = fold_digits(c) if digits == "latin" else to_persian_digits(c)
    c = F.regexp_replace(c, f"{ZWNJ}+", ZWNJ)
    c = F.regexp_replace(c, f"(?<![\\p{{L}}\\p{{M}}]){ZWNJ}+|{ZWNJ}+(?![\\p{{L}}\\p{{M}}])", "")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    return place_zwnj(F.regexp_replace(c, "^ | $", ""))


def text_key(c: Column) -> Column:
    """MD5 of the text in lower case with every run of other characters than letters and digits as one space."""
    return F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")))


def words(c: Column) -> Column:
    """Array of the runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def numbers(c: Column) -> Column:
    """The numbers of a text after digit folding, thousands separators dropped, sorted."""
    return F.array_sort(F.regexp_extract_all(F.regexp_replace(fold_digits(F.coalesce(c, F.lit(""))), r"(\d),(?=\d{3})", "$1"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def script_share(c: Column, script: str) -> Column:
    """Share of the text's letters that are of the script (a Java script name, as in Latin or Arabic); null without a letter."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(f"\\p{{Is{script}}}")) / letters)
