"""Text columns: tokens, names, titles, passages, snippets. Everything but Unicode NFC stays in the JVM.

Arguments named `c`, `text`, `name`... are Columns. Regexes use explicit Unicode classes, because Java's
plain \\w and \\s are ASCII-only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fv
from .dates import bind

TOKEN_GAP = r"[^\p{L}\p{N}]+"  # keyword index: letters and digits
WORD_GAP = r"[^\p{L}\p{N}_]+"  # plain words: letters, digits, underscore
SPACE = r"[\s\p{Z}]+"
BLANKS = " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def tokens(c: Column) -> Column:
    """Lower-cased keyword-index tokens, with repetitions."""
    return _non_empty(F.split(F.lower(c), TOKEN_GAP))


def split_at_blanks(c: Column) -> Column:
    """Tokens joined by single blanks, apart again."""
    return _non_empty(F.split(c, " "))


def word_list(c: Column) -> Column:
    """Lower-cased words (underscore kept), with repetitions."""
    return _non_empty(F.split(F.lower(c), WORD_GAP))


def split_words(c: Column) -> Column:
    """Whitespace-separated words as written."""
    return _non_empty(F.split(c, SPACE))


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def ordered_unique(*arrays: Column) -> Column:
    """Concatenate arrays, keep the first occurrence of each value, drop nulls and empty strings."""
    return F.filter(F.array_distinct(F.concat(*arrays)), lambda x: x.isNotNull() & (x != ""))


# ---------------------------------------------------------------- file and folder names
@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def to_nfc(c: Column) -> Column:
    """Unicode NFC. ASCII rows are passed to Python as nulls, so they cost no conversion."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def _safe_segment(c: Column) -> Column:
    plain = strip(F.regexp_replace(c, r'[\x00-\x1f\\/:*?"<>|]', "_"))
    return F.substring(F.regexp_replace(plain, r"^\.+$", ""), 1, 120)


def clean_name(c: Column) -> Column:
    """A file name that every provider accepts."""
    return _safe_segment(to_nfc(F.coalesce(c, F.lit(""))))


def folder_path(c: Column) -> Column:
    """A relative folder, at most ten clean levels joined by '/'."""
    raw = F.split(to_nfc(F.coalesce(c, F.lit(""))), r"[\\/]+")
    return F.array_join(F.slice(_non_empty(F.transform(raw, _safe_segment)), 1, 10), "/")


def ancestors(path: Column, depth: int | Column = 1) -> Column:
    """'a/b/c' -> ['a', 'a/b', 'a/b/c'], starting at the given depth."""
    parts = F.split(path, "/")
    first = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(
        first <= F.size(parts),
        F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; '' when there is none or the name is a dot-file."""
    return F.regexp_extract(F.lower(name), r"^.+(\.[^./]*)$", 1)


def filename_words(name: Column) -> Column:
    """Meaningful lower-case words of a file name, repetitions kept."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.[a-z0-9]{2,5}$", "")
    spaced = F.regexp_replace(stem, r"([a-z])([A-Z])", "$1 $2")
    parts = F.transform(F.split(spaced, r"[^A-Za-z]+"), F.lower)
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*fv.FILENAME_NOISE))


def camera(make: Column, model: Column) -> Column:
    """Model alone when it already names its maker, else 'make model'; null when both are empty."""

    def tidy(c: Column) -> Column:
        return F.coalesce(F.btrim(c, F.lit(" \u0000")), F.lit(""))

    mk, md = tidy(make), tidy(model)
    brand = F.lower(F.regexp_extract(mk, r"^\S+", 0))
    full = F.when((mk != "") & F.startswith(F.lower(md), brand), md).otherwise(F.trim(F.concat_ws(" ", mk, md)))
    return F.nullif(full, F.lit(""))


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def model_slug(c: Column, prefix: str = "Img_") -> Column:
    return F.concat(F.lit(prefix), F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), F.lit("_")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def valid_hash(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def _one_decimal(x: Column) -> Column:
    """'%.1f' of a positive double as C prints it: the nearest tenth to the exact value, ties to an even digit."""
    whole = F.floor(x).cast("double")
    eight, two = (x - whole) * 8, (x - whole) * 2  # exact, and so is their sum as tenths + rest

    def digits(tenths: Column) -> Column:
        back = tenths - eight
        rest = (eight - (tenths - back)) + (two - back)
        low = F.floor(tenths)
        over = tenths - low - 0.5
        up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
        n = (low + up.cast("long")).cast("int")
        return F.format_string("%.0f.%d", F.when(n == 10, whole + 1).otherwise(whole), n % 10)

    return bind(eight + two, digits)


def format_bytes(c: Column) -> Column:
    """'0 B', '12 KB', '1.5 GB'; halves go to the even digit, as in C and unlike Java."""
    size = c.cast("double")
    step = F.least(F.lit(4), F.floor(F.log(size) / F.log(F.lit(1024.0))).cast("int"))
    shown = size / F.pow(F.lit(1024.0), step)
    unit = F.get(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), step)
    number = F.when(step >= 3, _one_decimal(shown)).otherwise(F.format_string("%.0f", F.rint(shown)))
    return F.when(size > 0, F.concat(number, F.lit(" "), unit)).otherwise(F.lit("0 B"))


# ---------------------------------------------------------------- documents
def clean_text(c: Column) -> Column:
    """Soft hyphens out, words broken at a line end re-joined, runs of blanks and newlines capped.

    A plain substring test spares the regex on texts that do not need it.
    """

    def where_found(text: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
        def apply(x: Column) -> Column:
            needed = F.contains(x, F.lit(marks[0]))
            for mark in marks[1:]:
                needed = needed | F.contains(x, F.lit(mark))
            return F.when(needed, F.regexp_replace(x, pattern, by)).otherwise(x)

        return bind(text, apply)

    out = F.replace(c, F.lit("\u00ad"), F.lit(""))
    out = where_found(out, ("-\n",), r"-\n([\p{L}\p{N}_])", "$1")
    out = where_found(out, ("  ", "\t"), r"[ \t]{2,}|\t", " ")
    return strip(where_found(out, ("\n\n\n",), r"\n{3,}", "\n\n"))


def doc_title(text: Column, filename: Column) -> Column:
    """First level-one heading of a Markdown file, else the readable file name, else 'Untitled'."""
    heading = F.when(
        F.lower(filename).rlike(r"\.(md|markdown)$"), strip(F.regexp_extract(text, r"(?md)^#\s+(.+)$", 1))
    )
    readable = strip(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"[_-]+", " "))
    title = F.coalesce(F.nullif(heading, F.lit("")), F.nullif(readable, F.lit("")), F.lit("Untitled"))
    return F.substring(title, 1, fv.TITLE_CHARS)


def excerpt(c: Column, n: int = fv.EXCERPT_CHARS) -> Column:
    return F.substring(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"[#*_`>]+", "")), 1, n)


def chunk_words(ws: Column, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Overlapping windows over a *materialised* word array; [] for an empty one.

    Pass a column of the input frame, not an expression: lambdas would evaluate an expression per window.
    """
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(ws) - size) / F.lit(float(step))).cast("int"))
    return F.when(
        F.size(ws) > 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def query_terms(query: Column) -> Column:
    """Distinct query words longer than two characters."""
    return F.filter(F.array_distinct(word_list(query)), lambda t: F.length(t) > 2)


def term_coverage(query: Column, text: Column) -> Column:
    """Share of the query's meaningful words present in the text; 1.0 when it has none."""
    terms = F.array_except(query_terms(query), F.array(*[F.lit(w) for w in fv.COVERAGE_STOP_WORDS]))
    found = F.size(F.array_intersect(terms, word_list(text)))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(found / F.size(terms))


def snippet(text: Column, query: Column, width: int = fv.SNIPPET_WORDS) -> Column:
    """About `width` words around the first word that contains a query term."""
    ws, terms = split_words(text), query_terms(query)
    # what precedes the first term, in single-blank text: its blanks count the words before the hit
    pattern = F.concat(F.lit("(?s)^(.*?)(?:"), F.array_join(terms, "|"), F.lit(")"))
    before = F.call_function("regexp_extract", F.lower(F.array_join(ws, " ")), pattern, F.lit(1))
    hit = F.when(F.size(terms) > 0, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).otherwise(0)
    start = F.greatest(F.lit(0), hit - width // 3)
    return F.concat(
        F.when(start > 0, F.lit("… ")).otherwise(F.lit("")),
        F.array_join(F.slice(ws, start + 1, F.lit(width)), " "),
        F.when(start + width < F.size(ws), F.lit(" …")).otherwise(F.lit("")),
    )
