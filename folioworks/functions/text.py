"""Text expressions: normal form, keys, labels, words, numbers and snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Characters that carry no text, digits, and letters written in several ways.
INVISIBLE = "[​-‏‪-‮⁦-⁩﻿]"
TATWEEL = "ـ"
HIDDEN = INVISIBLE[:-1] + TATWEEL + "]"
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
LETTER_FORMS, PLAIN_LETTERS = "أإآىة", "ااايه"
ARABIC_LETTERS = "؀-ۿ"
BLANK = r"[\s\x1c-\x1f]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility form; rows of ASCII, which it can't change, never leave the JVM's side."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _where(text: Column, needed: Callable[[Column], Column], pattern: str, by: str) -> Column:
    """``text``, made once, with the pattern replaced where ``needed`` holds: a search for plain
    characters costs far less than a pattern that finds nothing."""
    return F.get(F.transform(F.array(text), lambda t: F.when(needed(t), F.regexp_replace(t, pattern, by)).otherwise(t)), 0)


def strip(text: Column) -> Column:
    """Without white space, of all of Unicode, at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def normalize_text(text: Column) -> Column:
    """T-01: compatibility form, no invisible characters or tatweel, LF line ends, single
    spaces, none around line ends, at most one blank line in a row, nothing at the ends."""
    t = F.regexp_replace(nfkc(text), HIDDEN, "")
    # Patterns match only what changes: a match for every space would cost more than all else.
    t = _where(t, lambda t: t.contains("\r"), r"\r\n?", "\n")
    t = _where(t, lambda t: t.contains("  ") | t.contains("\t"), " [ \t]+|\t[ \t]*", " ")
    t = _where(t, lambda t: t.contains(" \n") | t.contains("\n "), " +\n *|\n +", "\n")
    t = _where(t, lambda t: t.contains("\n\n\n"), "\n{3,}", "\n\n")
    return _where(t, lambda t: F.left(t, F.lit(1)).rlike("(?U)" + BLANK) | F.right(t, F.lit(1)).rlike("(?U)" + BLANK), rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def fold_digits(text: Column) -> Column:
    """T-02."""
    return F.translate(text, ARABIC_DIGITS, ASCII_DIGITS)


def slug(text: Column, default: str = "OBJECT") -> Column:
    """T-03: words in upper case with hyphens between."""
    plain = F.regexp_replace(fold_digits(normalize_text(text)), r"(?U)[^\w\-]+", "-")
    return F.coalesce(F.nullif(F.upper(F.trim(plain, F.lit("-"))), F.lit("")), F.lit(default))


def safe_stem(name: Column, default: str = "source", length: int = 80) -> Column:
    """T-04: a file's stem of word characters, spaces and hyphens only."""
    kept = F.regexp_replace(nfkc(name), rf"(?U)[^\w{ARABIC_LETTERS}\s\-]", "")
    return F.coalesce(F.nullif(F.left(strip(F.regexp_replace(kept, r"(?U)\s+", " ")), F.lit(length)), F.lit("")), F.lit(default))


def short_key(text: Column, length: int = 45) -> Column:
    """T-05: word characters with underscores between, cut and trimmed."""
    return F.trim(F.left(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)[^\w{ARABIC_LETTERS}]+", "_"), F.lit(length)), F.lit("_"))


def content_digest(text: Column) -> Column:
    """T-06: SHA-256 of the normal form."""
    return F.sha2(normalize_text(text), 256)


def normal_digest(text: Column) -> Column:
    """``content_digest`` of ``normalize_text(text)``. A normal form is one of itself, unless what
    was taken out stood between characters that compose: only those are normalised twice."""
    return digest_of_normal(normalize_text(text), hides(text))


def hides(text: Column) -> Column:
    """Whether the compatibility form holds characters that the normal form takes out."""
    return nfkc(text).rlike(HIDDEN)


def digest_of_normal(normal: Column, hidden: Column) -> Column:
    """``normal_digest`` from what is at hand: a text's normal form, and whether it ``hides``."""
    return F.sha2(F.coalesce(normalize_text(F.when(hidden, normal)), normal), 256)


def object_id(object_type: Column, local_id: Column, text: Column, prefix: Column | None = None) -> Column:
    """T-07: prefix, local id and 16 digits of the content's hash. Types have own prefixes."""
    by_type = F.when(object_type == "legislation", "LEG").when(object_type == "judicial_principle", "PRN").when(object_type == "full_judgment", "JUD").otherwise("OBJ")
    given = by_type if prefix is None else F.coalesce(F.nullif(prefix, F.lit("")), by_type)
    return F.concat_ws("-", given, local_id, F.substring(F.sha2(text, 256), 1, 16))


def point_id(value: Column) -> Column:
    """T-08: the first eight bytes of SHA-256, big-endian, without the sign bit."""
    digest = F.sha2(value, 256)
    top = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").bitwiseAND(7)
    return F.conv(F.concat(top.cast("string"), F.substring(digest, 2, 15)), 16, 10).cast("long")


def batch_id(at: Column, key: Column, digits: int = 8) -> Column:
    """T-09: BATCH-yyyymmdd-HHMMSS-<hex digits of the key's hash>. Eight digits tell apart the few
    keys of one second; of 50,000 keys of one time two are likely alike, so those need more."""
    return F.concat(F.lit("BATCH-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(key, 256), 1, digits))


def parse_batch_name(name: Column) -> dict[str, Column]:
    """Parts of an archived file's name: BATCH-<stamp>-<hex>[-DUPLICATE]_<original>."""
    pattern = r"^BATCH-(\d{8}-\d{6})-([0-9a-f]{8,64})(-DUPLICATE)?_(.*)$"
    part = lambda n: F.nullif(F.regexp_extract(name, pattern, n), F.lit(""))
    return {"stamp": F.to_timestamp(part(1), "yyyyMMdd-HHmmss"), "is_duplicate": part(3).isNotNull(), "original": F.coalesce(part(4), name)}


# Ordinals that number headings.
ORDINALS = "أولاً ثانياً ثالثاً رابعاً خامساً سادساً سابعاً ثامناً تاسعاً عاشراً".split() + ["حادي عشر", "ثاني عشر"]
LETTER = "[أ-يهـ]"


def clean_label(text: Column) -> Column:
    """T-10: without a leading ordinal, number, letter and dash, in that order."""
    t = F.coalesce(text, F.lit(""))
    for pattern in (rf"^\s*(?:{'|'.join(ORDINALS)})\s*—\s*", r"^\s*\d+\s*[-–:]\s*", rf"^\s*{LETTER}\s*[–\-:]\s*", r"^\s*[–\-]\s*"):
        t = F.regexp_replace(t, "(?U)" + pattern, "")
    return strip(t)


def plain_word(word: Column) -> Column:
    """T-11: letters written in several ways as one, no tatweel."""
    return F.translate(F.translate(word, TATWEEL, ""), LETTER_FORMS, PLAIN_LETTERS)


def search_word(word: Column) -> Column:
    """T-12: without punctuation at its ends and, if it stays longer than two, the article."""
    bare = F.regexp_replace(word, r"""^[()؟?.,:؛«»"'—-]+|[()؟?.,:؛«»"'—-]+$""", "")
    plain = F.translate(bare, LETTER_FORMS, PLAIN_LETTERS)
    return F.when(plain.startswith("ال") & (F.length(plain) > 4), F.substring(plain, 3, 1 << 30)).otherwise(plain)


def renumber(text: Column, number: Column) -> Column:
    """T-13: the leading ``n -`` with another number; other texts stay."""
    rest = F.regexp_replace(text, r"(?U)^\s*\d+\s*-\s*", "")
    return F.when(text.rlike(r"(?U)^\s*\d+\s*-\s*"), F.concat(number.cast("string"), F.lit("- "), rest)).otherwise(text)


def word_signatures(text: Column, letters: str = ARABIC_LETTERS, least: int = 3) -> Column:
    """T-14: the distinct words of ``least`` letters or more, each with its letters sorted."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"([{letters}]{{2,}})")), lambda w: F.length(w) >= least)
    return F.array_distinct(F.transform(found, lambda w: F.array_join(F.array_sort(F.filter(F.split(plain_word(w), ""), lambda c: c != "")), "")))


def first_line(text: Column, length: int = 120) -> Column:
    """T-15: the first line with anything on it, else a title from the text's hash."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, 0), F.lit(length)), F.concat(F.lit("TEXT-"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12)))


def number_in(text: Column, before: str = "") -> Column:
    """T-16: the first number after ``before`` (a pattern), or null."""
    return F.regexp_extract(fold_digits(text), before + r"(\d+)", 1).try_cast("int")


def structural_key(object_id: Column, most: int = 999) -> Column:
    """T-17: (part, class, sequence) out of ids like P3-ART-12; what is absent sorts last."""
    number = lambda p: F.coalesce(F.regexp_extract(object_id, p, 1).try_cast("int"), F.lit(most))
    kind = F.when(object_id.rlike("ART-"), 0).when(object_id.rlike("PR-"), 1).otherwise(2)
    return F.struct(number(r"(?:^|-)P(\d+)-").alias("part"), kind.alias("kind"), number(r"(?:ART|PR|DOC)-(\d+)").alias("sequence"))


def part_number(object_id: Column) -> Column:
    """T-18."""
    return F.regexp_extract(object_id, r"(?:^|-)P(\d+)-", 1).try_cast("int")


def preview(text: Column, length: int) -> Column:
    """T-19."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(length))


def snippet(text: Column, found: Column, before: int = 120, after: int = 250) -> Column:
    """T-20: what stands around the first occurrence of ``found``; null without one."""
    at = F.instr(text, found)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + after))


def metadata_fields(branch: Column, topic: Column, subtopic: Column, source_type: Column, title: Column, name: Column) -> dict[str, Column]:
    """T-21: trimmed fields, empty as null, and what is derived where a field is empty."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = clean(source_type)
    object_type = F.when(kind.isin("judicial_principles_collection", "single_judicial_principle"), "judicial_principle").otherwise(F.coalesce(kind, F.lit("legal_document")))
    return {
        "branch": clean(branch), "topic": clean(topic), "subtopic": F.coalesce(clean(subtopic), clean(topic)), "object_type": object_type,
        "title": F.coalesce(clean(title), clean(name)), "drafting_status": F.when(kind == "judicial_template", F.lit("draft")),
    }


def citation(branch: Column, circuit: Column, session: Column) -> Column:
    """T-23: branch or circuit, then the session's date."""
    return F.concat_ws(" ", F.coalesce(F.nullif(branch, F.lit("")), F.nullif(circuit, F.lit(""))), F.concat(F.lit("جلسة "), F.date_format(session, "dd/MM/yyyy")))


# Words that say nothing about which law a question means.
STOP_WORDS = "المادة مادة رقم من في نص ما هي هو قانون القانون لائحة اللائحة مرسوم المرسوم بقانون لسنة سنة و او أو على عن عند".split()


def query_tokens(query: Column, stop: list[str] = STOP_WORDS, least: int = 3) -> Column:
    """T-24: the distinct words of a question that are neither numbers nor stop words."""
    words = F.filter(F.split(fold_digits(query), r"(?U)\s+"), lambda w: (w != "") & ~F.regexp_replace(w, r"\p{P}+", "").rlike(r"^\d+$"))
    kept = F.filter(F.transform(F.array_except(F.transform(words, lambda w: F.regexp_replace(w, r"^[()؟?.,:؛«»\"']+|[()؟?.,:؛«»\"']+$", "")), F.array(*map(F.lit, stop))), search_word), lambda w: F.length(w) >= least)
    return F.array_distinct(kept)


def json_text(json: Column, path: str) -> Column:
    """T-25: a field as text, or null."""
    return F.get_json_object(json, path)


def merged(old: Column, patch: Column) -> Column:
    """T-26: maps merged shallowly, the patch's values winning."""
    none = F.create_map().cast("map<string,string>")
    new = F.coalesce(patch, none)
    return F.map_concat(F.map_filter(F.coalesce(old, none), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def or_old(value: Column, old: Column) -> Column:
    """T-27: an empty value leaves the old one."""
    return F.coalesce(F.nullif(value, F.lit("")), old)
