"""Text functions as Columns, evaluated in the JVM.

Where a definition needs whitespace, Python's and JavaScript's sense is meant (``\\s``), not SQL trim's single space.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


@cache
def accent_map() -> tuple[str, str]:
    """Characters of the basic plane whose decomposition without marks is one other character, and these characters."""
    src, dst = [], []
    for point in range(0x80, 0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(point):
            src.append(chr(point))
            dst.append(bare)
    return "".join(src), "".join(dst)


def strip_accents(c: Column | str) -> Column:
    src, dst = accent_map()
    return F.when(col(c).rlike(r"[^\x00-\x7f]"), F.translate(F.regexp_replace(col(c), r"\p{Mn}", ""), src, dst)).otherwise(col(c))


def norm_title(c: Column | str) -> Column:
    """Accents folded, lower case, runs of anything but a-z and 0-9 to one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def dedupe_key(c: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one space; accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def year_of(c: Column | str) -> Column:
    """The first four digits as a number; null when there are none."""
    return F.nullif(F.regexp_extract(col(c), r"\d{4}", 0), F.lit("")).cast("int")


def year_text(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\d{4}", 0)


def is_blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(r"^\s*$")


def canonical_tag(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def container_key(c: Column | str) -> Column:
    return F.lower(strip(strip_accents(c)))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", " ")


#: Whitespace in Unicode's sense, which character references bring in.
WHITE = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


#: A character reference, as browsers read one: decimal, hexadecimal, or a name.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def unescape(c: Column | str) -> Column:
    """HTML character references, named and numeric, decoded as browsers do. Names come from the standard library's table;
    of an unknown name the longest beginning counts that is known without its semicolon."""
    text = col(c)
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    open_ends = F.from_json(F.lit(json.dumps(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))), "array<string>")
    low = F.from_json(F.lit(json.dumps({n: bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"})), "map<string,string>")

    def numeric(s: Column) -> Column:
        digits = F.ltrim(F.regexp_extract(s, "^#([0-9]+)", 1), F.lit("0"))
        hexa = F.ltrim(F.regexp_extract(s, "^#[xX]([0-9a-fA-F]+)", 1), F.lit("0"))
        is_hex = s.rlike("^#[xX]")
        beyond = F.lit(1 << 30).cast("long")
        n = F.when(is_hex, F.when(F.length(hexa) > 7, beyond).otherwise(F.conv(F.concat(F.lit("0"), F.substring(hexa, 1, 7)), 16, 10).cast("long"))).otherwise(F.when(F.length(digits) > 9, beyond).otherwise(F.concat(F.lit("0"), F.substring(digits, 1, 9)).cast("long")))
        nothing = n.between(1, 8) | n.between(14, 31) | (n == 11) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        return F.coalesce(F.try_element_at(low, n.cast("string")), F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(nothing, "").otherwise(_code_point(n)))

    def named(s: Column) -> Column:
        known = F.get(F.filter(open_ends, lambda e: F.startswith(s, e)), F.lit(0))
        return F.coalesce(F.try_element_at(names, s), F.concat(F.try_element_at(names, known), F.substring(s, F.length(known) + 1, F.length(s))), F.concat(F.lit("&"), s))

    def decoded(reference: Column) -> Column:
        s = F.substring(reference, F.lit(2), F.length(reference))
        return F.when(F.startswith(s, F.lit("#")), numeric(s)).otherwise(named(s))

    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), decoded)
    pieces = F.zip_with(F.split(text, REFERENCE, -1), found, lambda part, ref: F.concat(part, F.coalesce(ref, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def clean_abstract(c: Column | str) -> Column:
    """Tags to spaces, character references decoded, whitespace squeezed, and a leading label dropped with its separator."""
    plain = F.trim(F.regexp_replace(unescape(strip_tags(c)), WHITE, " "))
    # The labels and separators.
    return F.regexp_replace(plain, r"^(Abstract|Resumen|ABSTRACT|RESUMEN)[\s:.\-‐-―]*", "")


def note_preview(c: Column | str, length: int = 100) -> Column:
    return F.substring(squeeze(strip_tags(c)), 1, length)


def text_to_html(c: Column | str) -> Column:
    """Each line that is not blank as a paragraph; text that has a ``<`` already stays."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: ~is_blank(x))
    return F.when(F.contains(col(c), F.lit("<")), col(c)).otherwise(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), strip(x), F.lit("</p>"))), ""))


def display_name(first: Column, last: Column, single: Column | None = None) -> Column:
    """``first last``, or the single-field name in place of an empty last name; stripped."""
    family = F.coalesce(F.nullif(last, F.lit("")), single if single is not None else F.lit(""), F.lit(""))
    return strip(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), family))


def one_decimal(x: Column, unit: str) -> Column:
    """Rounded to one decimal as C does: by the number's exact value, and to the even digit where that stands exactly between
    two. (Java's formatter rounds the shortest decimal that stands for the number.) Twenty times the number is formed as
    a sum and its rounding error; an odd sum is a number that looks like a tie."""
    big, small = x * 16, x * 4
    total = big + small
    part = total - big
    error = (big - (total - part)) + (small - part)
    below = F.floor((total - 1) / 2)
    tenths = F.when(error > 0, below + 1).when(error < 0, below).otherwise(below + below % 2)
    return F.format_string(f"%.1f {unit}", F.when((total == F.floor(total)) & (total % 2 == 1), tenths / 10).otherwise(x))


def human_size_binary(c: Column | str) -> Column:
    """1024-based, one decimal from KB on."""
    n = col(c).cast("double")
    out = F.format_string("%.0f B", n)
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024.0**k, one_decimal(n / 1024.0**k, unit)).otherwise(out)
    return out


def human_size_decimal(c: Column | str) -> Column:
    return one_decimal(col(c).cast("double") / 1e6, "MB")


def version_tuple(c: Column | str) -> Column:
    """The number that each dot-separated part starts with (0 when it starts with none)."""
    return F.transform(F.split(col(c), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))


def code_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 when equal, 0 when either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def similarity_within(a: Column, b: Column, least: float) -> Column:
    """levenshtein_similarity where that is ``least`` or more, else 0 or another number below it. The distance is bounded by what
    the longer text allows, so only a band of the matrix is filled, once; -1, what lies beyond, wraps round to the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    distance = F.call_function("levenshtein", a, b, F.floor(longer * (1.0 - least) + 1e-9).cast("int"))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.pmod(distance, longer + 1) / longer)


def similar(a: Column, b: Column, least: float) -> Column:
    """levenshtein_similarity >= least, by a bounded distance."""
    return similarity_within(a, b, least) >= least


ROMAN = [("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1)]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that stands in the plan, and is evaluated, once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def roman_value(c: Column | str) -> Column:
    """Value of a numeral of at most 15 letters, order not checked; 0 when it is none."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    value = lambda x: reduce(lambda acc, r: F.when(x == r[0], r[1]).otherwise(acc), ROMAN, F.lit(0))
    signed = lambda digits: F.transform(digits, lambda d, i: F.when(d < F.coalesce(F.get(digits, i + 1), F.lit(0)), -d).otherwise(d))
    total = lambda t: F.aggregate(let(F.transform(F.split(t, ""), value), signed), F.lit(0), lambda a, x: a + x)
    return let(text, lambda t: F.when(t.rlike("^[ivxlcdm]{1,15}$"), total(t)).otherwise(0))


def roman_text(c: Column | str) -> Column:
    """Lower-case numeral; empty for numbers below 1."""
    n = col(c).cast("int")
    tables = [["", "m", "mm", "mmm"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]]
    parts = [F.coalesce(F.get(F.array(*(F.lit(x) for x in t)), F.floor(n / 10 ** (3 - k)).cast("int") % (10 if k else 4)), F.lit("")) for k, t in enumerate(tables)]
    return F.when(n > 0, F.concat(*parts)).otherwise("")


# Fixed value: a section number, up to four levels of one or two digits each, before a word.
SECTION_NUMBER = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+\S"


def numbering_depth(c: Column | str) -> Column:
    """Depth of a leading section number: ``3.1.2. T`` is 3, no number 0."""
    number = F.regexp_extract(col(c), SECTION_NUMBER, 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


#: Verbs of scripts that change a library. Fixed values.
WRITE_VERBS = ["saveTx", "eraseTx", "save", "erase", "addTag", "removeTag", "setField", "setTags", "setNote", "addToCollection", "removeFromCollection", "trash"]


def writes(c: Column | str) -> Column:
    """Whether a script's text calls something that changes the library."""
    return F.coalesce(col(c), F.lit("")).rlike(r"\.(?:" + "|".join(WRITE_VERBS) + r")\s*\(")


def is_loopback(c: Column | str) -> Column:
    """Whether a base URL's host is this machine."""
    host = F.try_parse_url(col(c), F.lit("HOST"))
    return F.coalesce(F.lower(host).isin("localhost", "127.0.0.1", "[::1]", "::1"), F.lit(False))


def is_page_number(c: Column | str) -> Column:
    """A line that is nothing but an arabic or roman page number."""
    return F.trim(col(c)).rlike(r"^(?:\d{1,4}|(?i:[ivxlcdm]{1,15}))$")


def join_wrapped(head: Column, tail: Column) -> Column:
    """Two lines of one title: a single hyphen at the end of the first goes, else a space joins them."""
    first, second = F.regexp_replace(head, r"\s+$", ""), F.regexp_replace(tail, r"^\s+", "")
    return F.when(first == "", second).when(first.rlike(r"(?<!-)-$"), F.concat(F.regexp_replace(first, "-$", ""), second)).otherwise(F.concat(first, F.lit(" "), second))
