"""Text, token, hash and layer-name functions as column expressions; Arrow functions where no built-in exists."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layer names of structural members (fixed values; ``STRUCTURAL_KOREAN`` match anywhere as they stand).
STRUCTURAL = r"(?i)BEAM|COL(?:UMN)?|BRACE|BRACING|TRUSS|GIRDER|FRAME|WALL|SLAB|PLATE|FOOTING|FOUNDATION|PILE|\bBM[_-]|\bCL[_-]|\bGR[_-]|\bWL[_-]|\bFT[_-]"
STRUCTURAL_KOREAN = "기둥|보|가새|거더|트러스|벽|슬래브|기초|파일|프레임"
#: Words that mark a title block layer when they stand between separators (fixed values).
TITLE_WORDS = "TITLE[_-]?BLOCK|TITLEBLOCK|TITLE|BORDER|DRAWING[_-]?BORDER|DWG[_-]?BORDER|REV|REVISION|REVISION[_-]?BLOCK|SHEET|STAMP|DRAWING[_-]?FRAME|DWG[_-]?FRAME"
TITLE_KOREAN = "표제란|도면틀|도장|개정|도면번호|도면제목"
#: A revision mark in an upper-case file name.
REVISION = r"(?<![A-Z0-9])(?:REVISION|REV|R)[ _.-]*([0-9]+[A-Z]?)(?![A-Z0-9])"


def plain(value: Column) -> Column:
    """Line ends and runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def lowered(value: Column) -> Column:
    return F.lower(plain(value))


def mtext(value: Column) -> Column:
    """Formatted drawing text without its control codes: font, height and colour switches, stacks, braces, paragraph marks."""
    steps = [(r"\\[A-Za-z][^;\\{}]*;", ""), (r"\\S([^;^/#]*)[\^/#]([^;]*);", "$1/$2"), (r"\\P", "\n"), (r"\\~", " "), (r"\\[LlOoKk]", ""), (r"[{}]", ""), (r"%%[cC]", "\u2300"), (r"%%[dD]", "\u00b0"), (r"%%[pP]", "\u00b1")]
    stacked = [steps[1], steps[2], steps[3], steps[0], *steps[4:]]
    for pattern, by in stacked:
        value = F.regexp_replace(value, pattern, by)
    return plain(value)


@F.pandas_udf(T.StringType())
def composed(values: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), upper case, white space collapsed: no built-in composes."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).upper().split()))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in has (``levenshtein`` is another measure); null if one is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def text_hash(value: Column) -> Column:
    """First 16 hex digits of the SHA-1 of a text."""
    return F.substring(F.sha1(value.cast("binary")), 1, 16)


def tokens(value: Column, least: int = 2) -> Column:
    """Distinct lower-case words of letters and digits of at least ``least`` characters, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{N}]{%d,}" % least), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays: 0.5 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def hash_similarity(a: Column, b: Column, both: bool = False) -> Column:
    """1 - differing bits / 64 of two 16-digit hex hashes.

    Without a hash 0.5: on either side, or with ``both`` only if both lack it and 0 if one does.
    """
    missing = lambda x: x.isNull() | (x == "")
    bits = F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
    same = 1 - bits / 64
    if both:
        return F.when(missing(a) & missing(b), 0.5).when(missing(a) | missing(b), 0.0).otherwise(same)
    return F.when(missing(a) | missing(b), 0.5).otherwise(same)


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole name, any case."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?is)^{body}$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether a name fits one of the shell patterns."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.rlike(name, F.lit("|".join(f"(?:{glob(p)})" for p in patterns))), F.lit(False))


def is_structural(layer: Column) -> Column:
    return F.coalesce(F.rlike(layer, F.lit(STRUCTURAL)) | F.rlike(layer, F.lit(STRUCTURAL_KOREAN)), F.lit(False))


def is_title_block(layer: Column) -> Column:
    """A title word between separators; SHEET does not count before PILE, METAL, ROCK or WORK."""
    pattern = rf"(?i)(?:^|[-_\s\d])(?!SHEET[-_\s]?(?:PILE|METAL|ROCK|WORK))(?:{TITLE_WORDS})(?:$|[-_\s])"
    return F.coalesce(F.rlike(layer, F.lit(pattern)) | F.rlike(layer, F.lit(TITLE_KOREAN)), F.lit(False))


def layer_prefix(layer: Column) -> Column:
    return F.regexp_replace(layer, r"\d+$", "")


#: A project's drawing number and what a file name may have instead (fixed values); a broad number is a project's first part alone.
DRAWING_NUMBER = r"(?<![A-Z0-9])([A-Z]{1,4}[0-9]{2})[-_. ]+([0-9]{3,5}[A-Z]?)(?![A-Z0-9])"
COMPACT_NUMBER = r"(?<![A-Z0-9])([A-Z]{1,4}[0-9]{2})([0-9]{3,5}[A-Z]?)(?![A-Z0-9])"
SEPARATED_NUMBER = r"(?<![A-Z0-9])([A-Z]{1,4})[-_. ]+([0-9]{1,5}[A-Z]?)(?![A-Z0-9])"
GENERIC_NUMBER = r"(?<![A-Z0-9])([A-Z]{1,4})([0-9]{3,5}[A-Z]?)(?![A-Z0-9])"
BROAD_NUMBER = r"^[A-Z]{1,4}[0-9]{2}$"
#: Floor and sheet marks of a file name, in order (fixed values).
SHEET_MARKS = (r"\bB[0-9]{1,2}F?\b", r"\b[0-9]{1,2}F\b", r"\bRF\b", r"\bPH[0-9]+\b", r"\b[A-Z]+[ _.-]*[0-9]{1,3}\b")
#: Words of a file name that name a version (fixed values).
VERSION_WORDS = ("OLD", "NEW", "FINAL", "COPY")


def _upper(text: Column) -> Column:
    return F.upper(F.coalesce(text, F.lit("")))


def _both(text: Column, pattern: str, by: str = "") -> Column:
    """The two groups of every match, joined."""
    one, two = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(one, two, lambda x, y: F.concat(x, F.lit(by), y))


def drawing_number(text: Column) -> Column:
    """The first project number of a text, its parts joined by a dash; empty without one."""
    return F.coalesce(F.get(_both(_upper(text), DRAWING_NUMBER, "-"), 0), F.lit(""))


def first_longest(values: Column) -> Column:
    """The longest of an array of texts, the first of equally long ones; empty without any."""
    return F.aggregate(values, F.lit(""), lambda best, v: F.when(F.length(v) > F.length(best), v).otherwise(best))


def longest(values: Column) -> Column:
    """The longest of an array of texts, the smaller of equally long ones; empty without any."""
    best = F.array_max(F.transform(values, lambda v: F.length(v)))
    return F.coalesce(F.array_min(F.filter(values, lambda v: F.length(v) == best)), F.lit(""))


def file_drawing_number(name: Column) -> Column:
    """The drawing number of a file name without its revision marks; empty without one.

    The longest project number; else the first one written together; else the longest of
    letters and digits apart that is not broad; else the longest of such written together.
    """
    text = F.regexp_replace(_upper(name), REVISION, " ")
    separated = F.filter(_both(text, SEPARATED_NUMBER), lambda v: ~F.rlike(v, F.lit(BROAD_NUMBER)))
    choices = [first_longest(_both(text, DRAWING_NUMBER, "-")), F.get(_both(text, COMPACT_NUMBER, "-"), 0), first_longest(separated), first_longest(_both(text, GENERIC_NUMBER))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in choices], F.lit(""))


def sheet_token(text: Column) -> Column:
    """The first floor or sheet mark of a text, by the order of the marks, its letters and digits alone; empty without one."""
    found = [F.regexp_replace(F.regexp_extract(_upper(text), p, 0), "[^A-Z0-9]", "") for p in SHEET_MARKS]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def file_identity(path: Column) -> Column:
    """Struct of a file name's ``key`` (words without revision, date and version words, joined), ``revision``, ``drawing_number``, ``sheet``.

    A date counts only where no letter, digit or underscore touches it.
    """
    stem = composed(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    key = F.regexp_replace(stem, REVISION, " ")
    key = F.regexp_replace(key, r"(?<![\p{L}\p{N}_])(?:20[0-9]{6}|(?:19|20)?[0-9]{6})(?![\p{L}\p{N}_])", " ")
    words = F.filter(F.regexp_extract_all(key, F.lit(r"[A-Z0-9\uAC00-\uD7A3]+"), F.lit(0)), lambda w: ~w.isin(*VERSION_WORDS))
    return F.struct(
        F.array_join(words, "").alias("key"), F.regexp_replace(F.regexp_extract(stem, REVISION, 0), " ", "").alias("revision"),
        file_drawing_number(stem).alias("drawing_number"), sheet_token(stem).alias("sheet"),
    )


_BY = r"\s*[\u00D7xX\-_]\s*"
_CANONICAL_TOKENS = r"(?!H_BEAM_|SQR_TUBE_|ROUND_PIPE_|DIM_|REBAR_|PLATE_|FLOOR_|ELEV_PLUS_|ELEV_MINUS_|ELEV_PM_|GRID_|DETAIL_)"
_CALLOUT = r"([A-Z0-9]+(?:\s*[-_]\s*[A-Z0-9]+)?)"
#: Rewrites of engineering notation, in order: pattern, new form, whether letter case counts, and how the groups go in:
#: as they are, in upper case, or as a callout without blanks and dashes (fixed values).
CANONICAL = (
    (rf"H\s*(\d+){_BY}(\d+){_BY}(\d+){_BY}(\d+)", "H_BEAM_$1_$2_$3_$4", True, ""),
    (rf"(?:[\u25A1\u3141]|BOX|SQR|HSS)\s*(\d+){_BY}(\d+){_BY}(\d+)", "SQR_TUBE_$1_$2_$3", False, ""),
    (rf"(?:[\u25A1\u3141]|BOX|SQR|HSS)\s*(\d+){_BY}(\d+)", "SQR_TUBE_$1_$2", False, ""),
    (rf"(?:[\u00D8\u00F8\u03A6\u03C6\u03D5]|PIPE|HSS\s*ROUND)\s*(\d+){_BY}(\d+)", "ROUND_PIPE_$1_$2", False, ""),
    (r"(?:[\u00D8\u00F8\u03A6\u03C6\u03D5]|PIPE|HSS\s*ROUND)\s*(\d+)", "ROUND_PIPE_$1", False, ""),
    (r"(\d+)[.,](\d+)\s*(?:mm|MM)", "DIM_$1_$2_MM", True, ""),
    (r"(\d+)\s*(?:mm|MM)", "DIM_$1_MM", True, ""),
    (r"(\d+)[.,](\d+)\s*(?:cm|CM)\b", "DIM_$1_$2_CM", True, ""),
    (r"(\d+)\s*(?:cm|CM)\b", "DIM_$1_CM", True, ""),
    (r"(\d+)[.,](\d+)\s*(?:m|M)\b", "DIM_$1_$2_M", True, ""),
    (r"(\d+)\s*(?:m|M)\b", "DIM_$1_M", True, ""),
    (r"\b(?:PL|t)\s*(\d+)\.(\d+)\b", "PLATE_$1_$2", False, ""),
    (r"\b(?:PL|t)\s*(\d+)\b", "PLATE_$1", False, ""),
    (r"\b(?:D|HD|SD)\s*(\d+)\b", "REBAR_$1", False, ""),
    (r"\bB(\d+)\s*(?:FL?|\uCE35)\b", "FLOOR_B$1", False, ""),
    (r"\b(\d+)\s*(?:FL?|\uCE35)\b", "FLOOR_$1", False, ""),
    (r"\bEL\s*\+\s*(\d+)\.(\d+)", "ELEV_PLUS_$1_$2", False, ""),
    (r"\bEL\s*\+\s*(\d+)", "ELEV_PLUS_$1", False, ""),
    (r"\bEL\s*-\s*(\d+)\.(\d+)", "ELEV_MINUS_$1_$2", False, ""),
    (r"\bEL\s*-\s*(\d+)", "ELEV_MINUS_$1", False, ""),
    (r"\bEL\s*\u00B1\s*(\d+)\.(\d+)", "ELEV_PM_$1_$2", False, ""),
    (r"\bEL\s*\u00B1\s*(\d+)", "ELEV_PM_$1", False, ""),
    (r"\b([XYAB])\s*(\d+)\s*['\u2032\u02B9]", "GRID_$1_$2_PRIME", True, ""),
    (r"\bGRID\s+([A-Z]+)\s*[-\u2013]\s*(\d+[A-Z]?)\b", "GRID_$1_$2", False, "upper"),
    (r"\b(FAB|ZONE|AXIS|GRID)\s*[-\u2013]\s*(\d+[A-Z]?)\b", "GRID_$1_$2", False, "upper"),
    (r"\bGRID\s+(?!_)([A-Z][A-Z0-9]*)\b", "GRID_$1", False, "upper"),
    (rf"\b(?:DETAIL|DET|SECTION|SEC)(?![A-Z])\s*[-_]?\s*{_CALLOUT}", "DETAIL_$1", False, "callout"),
    (rf"\b(?:\uC0C1\uC138|\uB2E8\uBA74)\s*[-_]?\s*{_CANONICAL_TOKENS}{_CALLOUT}", "DETAIL_$1", True, "callout"),
)


@F.pandas_udf(T.StringType())
def compatible(values: pd.Series) -> pd.Series:
    """Compatibility forms, then composed: no built-in has either."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", unicodedata.normalize("NFKC", v)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rewritten(text: Column, pattern: str, form: str, how: str) -> Column:
    """Every match as the form, with the first group changed: what stands between matches, and the matches' new forms, in turn."""
    return let(text, lambda once: _put(once, pattern, form, how))


def _put(text: Column, pattern: str, form: str, how: str) -> Column:
    change = {"upper": F.upper, "callout": lambda g: F.translate(F.replace(g, F.lit(" ")), "-", "_")}[how]
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, form.count("$") + 1)]
    parts = F.arrays_zip(*[x.alias(f"g{k}") for k, x in enumerate(found)], F.slice(F.split(text, pattern, -1), 2, 1_000_000_000).alias("rest"))
    pieces = [F.lit(form.split("$")[0]), *(x for k in range(len(found)) for x in (("g", k), form.split("$")[k + 1][1:]))]
    put = lambda p: F.concat(*[(change(p[f"g{x[1]}"]) if x[1] == 0 else p[f"g{x[1]}"]) if isinstance(x, tuple) else F.lit(x) if isinstance(x, str) else x for x in pieces], p["rest"])
    return F.concat(F.get(F.split(text, pattern, -1), 0), F.array_join(F.transform(parts, put), ""))


def canonical(text: Column) -> Column:
    """Engineering text in one notation: compatible forms, no control characters, members and marks rewritten in order."""
    value = F.regexp_replace(compatible(F.coalesce(text, F.lit(""))), r"[\p{C}&&[^\t\n]]", "")
    for pattern, form, cased, how in CANONICAL:
        pattern = ("(?U)" if cased else "(?iU)") + pattern
        value = _rewritten(value, pattern, form, how) if how else F.regexp_replace(value, pattern, form)
    return plain(value)


def redacted(text: Column) -> Column:
    """Absolute paths as their last part behind ``<path>/``."""
    value = F.regexp_replace(text, r"(?:[A-Za-z]:[\\/]|\\\\)(?:[^\\/\s\"']+[\\/])*([^\\/\s\"']+)", "<path>/$1")
    return F.regexp_replace(value, r"(?<![\w<>/.:])/(?:home|root|Users|tmp|var|mnt|opt)/(?:[^/\s\"']+/)*([^/\s\"']+)", "<path>/$1")


def leaks_path(text: Column) -> Column:
    """Whether a text still holds an absolute path."""
    return F.rlike(text, F.lit(r"(?:[A-Za-z]:[\\/]|\\\\)[^\s\"']+|(?<![\w<>/.:])/(?:home|root|Users|tmp|var|mnt|opt)/[^\s\"']+"))


def colour_hex(index: Column) -> Column:
    """Base and grey entries of the indexed palette (fixed values) as hex; null for the others."""
    names = {1: "#FF0000", 2: "#FFFF00", 3: "#00FF00", 4: "#00FFFF", 5: "#0000FF", 6: "#FF00FF", 7: "#FFFFFF", 8: "#808080", 9: "#C0C0C0", 250: "#333333", 251: "#505050", 252: "#696969", 253: "#828282", 254: "#BEBEBE", 255: "#FFFFFF"}
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(index == k, v).otherwise(out)
    return out


#: Millimetres in a drawing unit, by its header code (fixed values).
UNITS_MM = {0: 1.0, 1: 25.4, 2: 304.8, 3: 1609344.0, 4: 1.0, 5: 10.0, 6: 1000.0, 7: 1e6, 8: 2.54e-5, 9: 0.0254, 10: 914.4, 11: 1e-7, 12: 1e-6, 13: 1e-3, 14: 100.0, 15: 1e4, 16: 1e5, 17: 1e12, 18: 1.495978707e14, 19: 9.4607e18, 20: 3.0857e19}


def unit_mm(code: Column) -> Column:
    """Scale to millimetres of a header's unit code; 1 for unknown codes."""
    table = F.create_map(*[F.lit(x) for k, v in UNITS_MM.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, code), F.lit(1.0))
