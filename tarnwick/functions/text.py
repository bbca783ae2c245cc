"""Text functions as column expressions; Arrow UDFs only for Unicode normal forms, which Spark lacks.

Strings are sequences of code points here (Spark's own semantics), and ordered by code point.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Token of the positional index: letters and digits, with inner apostrophes, dots and hyphens (fixed value).
WORD = r"[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*"
#: Token of the ranked index (fixed value).
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: Query-side token of the ranked index (fixed value).
QUERY_TOKEN = r"(?U)[\w’']+"
#: Named entities that are decoded (fixed values).
ENTITIES = {"apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "amp": "&"}
#: Words that routing ignores (fixed values).
ROUTE_STOP = (
    "the a an of and or is are to in as for with from by after before be becoming not model recall conversation book show mechanism function state rule question decision endpoint event "
    "relation knowledge claim legal holds requires preserves binds remains becomes"
).split()


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    def plain(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))

    return s.map(plain)


def _marks() -> tuple[str, str]:
    """(characters, what stands for them): letters below U+2000 that are composed with marks, by their bases, then marks, by nothing."""
    composed, plain, marks = [], [], []
    for i in range(0xC0, 0x2000):
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if not base:
            marks.append(c)
        elif base != c and len(base) == 1:
            composed.append(c)
            plain.append(base)
    return "".join(composed + marks), "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without diacritics, as the ranked index compares terms; built in, by one pass over the text."""
    marked, plain = _marks()
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(F.lower(c), marked, plain)).otherwise(F.lower(c))


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that folding changes and the one that stands for each, and those that become several."""
    one, several = {}, {}
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            if (full := c.casefold()) != c:
                (one if len(full) == 1 else several)[c] = full
    return "".join(one), "".join(one.values()), several


def casefold(c: Column) -> Column:
    """Full case folding, so that sharp s equals ss and a ligature its letters; null stays null.

    Built in: texts are taken apart only where they hold a character that becomes several.
    """
    before, after, several = _foldings()
    single = F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(c, before, after)).otherwise(F.lower(c))
    full = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    apart = F.regexp_extract_all(single, F.lit("(?s)."), F.lit(0))
    whole = F.array_join(F.transform(apart, lambda x: F.coalesce(F.element_at(full, x), x)), "")
    return F.when(single.rlike("[" + "".join(several) + "]"), whole).otherwise(single)


def locale(c: Column) -> Column:
    """A text to be sorted as readers expect: by letter, then accent, then case, and marks before digits before letters.

    Sort by the text itself after it, as different texts may be equal here.
    """
    return F.collate(c, "UNICODE")


def normalize_term(c: Column) -> Column:
    """NFKC and lower case."""
    return F.lower(nfkc(c))


def fold_term(c: Column) -> Column:
    """Lower case without diacritics by full decomposition: also of characters that `fold` has not."""
    return F.lower(strip_diacritics(c))


def words(c: Column) -> Column:
    """Tokens of the positional index, lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Tokens of the ranked index, lower case, in order; `fold` the text first to drop diacritics."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def query_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(QUERY_TOKEN), F.lit(0))


def route_tokens(c: Column) -> Column:
    """ASCII words of more than one letter that are no stop words; hyphens part words."""
    found = F.regexp_extract_all(F.lower(F.replace(c, F.lit("-"), F.lit(" "))), F.lit("[a-z0-9]+(?:['’][a-z0-9]+)?"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(ROUTE_STOP))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def normalize_text(c: Column) -> Column:
    """No byte order mark, LF line ends, single spaces within lines, at most one blank line, trimmed."""
    t = F.regexp_replace(c, r"^\x{FEFF}", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\t \x{A0}]+", " ")
    t = F.regexp_replace(t, r"(?m)^ +| +$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def decode_entities(c: Column) -> Column:
    """Numeric entities and the six named ones, each once: what comes out is not decoded again."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]+);|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        token = F.lower(F.regexp_extract(p, r"^&(#?[a-zA-Z0-9]+);$", 1))
        code = F.when(token.startswith("#x"), F.conv(F.substring(token, 3, 12), 16, 10)).otherwise(F.substring(token, 2, 12)).cast("bigint")
        sane = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # four bytes of UTF-32 spell any code point
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(token.startswith("#") & F.coalesce(sane, F.lit(False)), char)
        for name, value in ENTITIES.items():
            out = out.when(token == name, F.lit(value))
        return F.coalesce(out.otherwise(p), p)

    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def strip_markup(c: Column) -> Column:
    """Comments, scripts, styles and tags go; block ends become blank lines, <br> a line end."""
    t = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|svg|math)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|section|article|li|blockquote|h[1-6]|tr)>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return decode_entities(t)


def first_heading(c: Column) -> Column:
    """The text of the first h1 to h3, null if there is none or it is blank."""
    inner = F.regexp_extract(c, r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]\s*>", 1)
    return F.nullif(normalize_text(strip_markup(inner)), F.lit(""))


def html_title(c: Column) -> Column:
    title = F.nullif(normalize_text(strip_markup(F.regexp_extract(c, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))), F.lit(""))
    return F.coalesce(title, first_heading(c))


def html_lang(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def heading_line(c: Column) -> Column:
    """A line that opens a unit: a keyword, or capitals of up to 80 characters without end mark."""
    t = F.trim(c)
    keyword = t.rlike(r"(?i)^(?:prologue|epilogue|chapter\b|appendix\b|part\b|book\b)")
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    capitals = (F.length(letters) >= 3) & (t == F.upper(t)) & ~t.rlike(r"[.!?]$")
    return (t != "") & (F.length(t) <= 80) & (keyword | capitals)


def title_case(c: Column) -> Column:
    """A heading all in capitals gets title case: a capital after anything that is no letter."""
    parts = F.regexp_extract_all(F.trim(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    cased = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))))
    shout = (F.trim(c) == F.upper(c)) & (F.upper(c) != F.lower(c)) & (F.length(F.trim(c)) < 80)
    return F.when(shout, F.array_join(cased, "")).otherwise(F.trim(c))


def slug(c: Column, fallback: str = "edition") -> Column:
    """Lower-case letters and digits joined by hyphens, up to 72 characters."""
    t = F.lower(strip_diacritics(nfkc(c)))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, 72), F.lit("")), F.lit(fallback))


def snippet(text: Column, terms: list[str], context: int) -> Column:
    """The text around the earliest term, with ellipses where it is cut."""
    context = max(20, min(int(context), 500))
    low = F.lower(text)
    found = [F.nullif(F.locate(t, low), F.lit(0)) for t in terms]
    at = F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - context)
    end = F.least(F.length(text), at + max(map(len, terms), default=1) + context)
    cut = F.trim(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))


def safe_relative(uri: Column) -> Column:
    """No scheme, no backslash, not absolute, and no empty, `.` or `..` segment."""
    parts = F.forall(F.split(uri, "/"), lambda p: ~p.isin("", ".", ".."))
    return ~uri.contains("\\") & ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & parts


def private_contact(c: Column) -> Column:
    """Whether a text holds an e-mail address, a telephone number or a street address."""
    mail = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
    phone = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}"
    street = r"(?i)\b\d{1,5} [a-z]+ (?:street|st\.|avenue|ave\.|road|rd\.|lane|drive)\b"
    return c.rlike(mail) | c.rlike(phone) | c.rlike(street)


def contact_key(c: Column) -> Column:
    """Whether a key names a contact (fixed pattern)."""
    return c.rlike("(?i)email|phone|address|contact")


def date_parts(parts: Column) -> Column:
    """[y, m?, d?] as YYYY-MM-DD, missing parts as 01."""
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(1)).cast("int")
    return F.when(F.get(parts, F.lit(0)).isNotNull(), F.format_string("%04d-%02d-%02d", F.get(parts, F.lit(0)).cast("int"), part(1), part(2)))


def bib_key(c: Column) -> Column:
    return F.right(F.regexp_replace(c, "[^A-Za-z0-9]", ""), F.lit(24))
