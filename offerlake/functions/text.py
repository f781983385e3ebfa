"""Text columns: HTML to text, repair, folding, keys, slugs, URLs."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.dims import TRACKING


def unmarked(text: str) -> str:
    """The compatibility decomposition without combining marks. That of a text is that of its characters in a row."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def fold_table(first: int, last: int) -> dict[str, str]:
    """Characters of a range that folding changes, from the Unicode tables. Hangul syllables follow from their numbers."""
    chars = (chr(i) for i in range(first, last) if not 0xAC00 <= i <= 0xD7A3 and not 0xD800 <= i <= 0xDFFF)
    return {c: unmarked(c) for c in chars if unmarked(c) != c}


def translated(text: Column, folds: dict[str, str]) -> Column:
    """Characters that fold to one or to none."""
    to_one, to_none = ({c: f for c, f in folds.items() if len(f) == n} for n in (1, 0))
    return F.translate(text, "".join([*to_one, *to_none]), "".join(to_one.values()))


def char_class(chars: Iterable[str]) -> str:
    """The inside of a pattern's brackets, by ranges."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


LATIN, UNICODE = (0x80, 0x180), (0x80, 0x30000)  # no character beyond folds
PUNCTUATION = "–—‘’“”•…€"
SYLLABLES = r"\x{ac00}-\x{d7a3}"


def jamo(syllable: Column) -> Column:
    """The two or three letters of a Hangul syllable, by its number."""
    k = F.ascii(syllable) - 0xAC00
    letter = lambda first, size, place: F.substring(F.lit("".join(map(chr, range(first, first + size)))), place.cast("int") + 1, F.lit(1))
    tail = F.when(k % 28 > 0, letter(0x11A8, 27, k % 28 - 1)).otherwise("")
    return F.concat(letter(0x1100, 19, F.floor(k / 588)), letter(0x1161, 21, F.floor(k % 588 / 28)), tail)


def deaccent_any(text: Column) -> Column:
    """deaccent for all of Unicode: those of its characters that fold to several are replaced one after another."""
    folds = fold_table(*UNICODE)
    several = {c: f for c, f in folds.items() if len(f) > 1}
    by_char = F.map_from_arrays(*[F.split(F.lit("\x1f".join(x)), "\x1f") for x in (several, several.values())])
    pattern = F.lit(f"[{char_class(several)}{SYLLABLES}]")

    def replaced(t: Column) -> Column:
        return F.aggregate(F.array_distinct(F.regexp_extract_all(t, pattern, F.lit(0))), t, lambda so_far, c: F.replace(so_far, c, F.coalesce(F.try_element_at(by_char, c), jamo(c))))

    return once(translated(text, folds), replaced)


def deaccent(text: Column) -> Column:
    """The text's compatibility decomposition without combining marks; null stays null. Texts of Latin letters and usual
    punctuation take a short way."""
    usual = [c for c in map(chr, range(LATIN[1])) if len(unmarked(c)) == 1]
    latin = translated(F.replace(text, F.lit("…"), F.lit("...")), fold_table(*LATIN))
    beyond = F.regexp_replace(text, r"[\x00-\x7f]+", "")  # short, as a rule: every character that is translated is looked up
    others = F.translate(beyond, "".join([c for c in usual if c > "\x7f"] + [*PUNCTUATION]), "")
    return F.when(F.octet_length(text) == F.char_length(text), text).when(others != "", deaccent_any(text)).otherwise(latin)


def normalize_key(text: Column) -> Column:
    """Folded, lower-case, trimmed; empty for null. Made once for a column and reused."""
    return F.regexp_replace(F.lower(deaccent(F.coalesce(text, F.lit("")))), r"(?U)^\s+|\s+$", "")


def folded(text: str) -> str:
    """normalize_key for a literal."""
    return unmarked(text).lower().strip()


def sql_literal(value: object) -> str:
    if isinstance(value, str):
        return f'r"{value}"' if '"' not in value else "r'" + value + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(sql_literal, value))})"
    if isinstance(value, dict):
        return f"named_struct({', '.join(f'{sql_literal(k)}, {sql_literal(v)}' for k, v in value.items())})"
    return "CAST(NULL AS STRING)" if value is None else f"{value}D" if isinstance(value, float) else str(value).lower()


def table(rows: list) -> Column:
    """A word list or lookup of this package as one literal array. Functions over it keep a plan small, however long the
    list: one node instead of some for each word."""
    return F.expr(sql_literal(rows))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


MARK, OTHER = "\u0001", "\u0002"
BOUNDARY = MARK + MARK  # two, so that needles side by side have one each
SHORT = 3  # needles up to this many characters are looked for between word boundaries


def marked(key: Column) -> Column:
    """The text with marks at each start and end of a word; texts of ASCII alone take the plain pattern."""
    plain = F.translate(key, MARK, OTHER)
    mark = lambda flags: F.regexp_replace(plain, rf"{flags}(\w+)", f"{BOUNDARY}$1{BOUNDARY}")
    return F.when(F.octet_length(key) == F.char_length(key), mark("")).otherwise(mark("(?U)"))


def bounded(letters: str, always: bool = False) -> str:
    """How a needle between word boundaries stands in a marked text. Ends that are letters or digits have one, with
    `always` other ends, too: a sign at which a word ends, or that one follows."""
    form = re.sub(r"(\w+)", rf"{BOUNDARY}\1{BOUNDARY}", letters)
    first, last = (MARK if always or form[k] == MARK else "" for k in (0, -1))
    return first + form.strip(MARK) + last


def needle(letters: str, bounded_up_to: int = SHORT) -> dict:
    """What is looked for in marked texts, if the needle is short, else in plain ones."""
    short = len(letters) <= bounded_up_to
    return {"letters": letters, "form": bounded(letters, always=True) if short else letters, "short": short}


def contains_any(key: Column, needles: Sequence[str], marks: Column | None = None) -> Column:
    """The first needle of the list, as written, that the normalised text holds; null if none. `marks`: the marked text,
    where it is there already."""
    known = [(n, needle(folded(n))) for n in needles if folded(n)]
    if not known:
        return F.lit(None).cast("string")
    if marks is not None:
        return F.coalesce(*[F.when(F.contains(marks if n["short"] else key, F.lit(n["form"])), F.lit(text)) for text, n in known], F.lit(None).cast("string"))
    both = F.struct(key.alias("key"), (marked(key) if any(n["short"] for _, n in known) else F.lit("")).alias("marks"))
    return once(both, lambda b: F.coalesce(*[F.when(F.contains(b["marks" if n["short"] else "key"], F.lit(n["form"])), F.lit(text)) for text, n in known], F.lit(None).cast("string")))


ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def named_entities(names: Iterable[str]) -> Column:
    """name -> characters, as one literal map, from the list of all names of HTML 5."""
    return F.map_from_arrays(*[F.split(F.lit("\x1f".join(x)), "\x1f") for x in (names, [html5[n] for n in names])])


def by_number(digits: Column, base: int) -> Column:
    """The character of a code point: those below 160 as browsers read them, none for what is no character, the
    replacement character for what can't be one."""
    plain = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(plain) > 8, 0x110000).otherwise(F.conv(F.coalesce(F.nullif(plain, F.lit("")), F.lit("0")), base, 10).cast("bigint"))

    def char(n: Column) -> Column:
        low = F.split(F.lit("\x1e".join(html.unescape(f"&#{k};") for k in range(0xA0))), "\x1e")
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        other = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(n < 0xA0, F.get(low, n.cast("int"))).when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(none, "").otherwise(other)

    return once(code, char)


def entity(e: Column) -> Column:
    """The characters of one entity with its ampersand. An unknown name is read by its longest beginning that needs no
    semicolon; if there is none, it stays as it is."""
    name = F.substring(e, F.lit(2), F.length(e))
    whole, open_ = named_entities(html5), named_entities([n for n in html5 if not n.endswith(";")])
    begun = F.transform(F.sequence(F.greatest(F.length(name) - 1, F.lit(2)), F.lit(2), F.lit(-1)), lambda k: F.struct(F.try_element_at(open_, F.substring(name, F.lit(1), k)).alias("chars"), k.alias("k")))
    best = once(F.get(F.filter(begun, lambda b: b["chars"].isNotNull()), F.lit(0)), lambda b: F.concat(b["chars"], F.substring(name, b["k"] + 1, F.length(name))))
    digits = F.rtrim(name, F.lit(";"))
    hex_, decimal = F.substring(digits, F.lit(3), F.length(digits)), F.substring(digits, F.lit(2), F.length(digits))
    usual = F.when(e == "&amp;", "&").when(e == "&lt;", "<").when(e == "&gt;", ">").when(e == "&quot;", '"').when(e == "&nbsp;", "\u00a0").when(e == "&#39;", "'")
    return usual.when(F.lower(F.substring(name, 1, 2)) == "#x", by_number(hex_, 16)).when(F.startswith(name, F.lit("#")), by_number(decimal, 10)).otherwise(F.coalesce(F.try_element_at(whole, name), best, e))


def unescape(text: Column) -> Column:
    """HTML entities decoded, in one pass: what an entity stands for is not read again."""
    ampersand = F.contains(text, F.lit("&"))
    found, between = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.split(text, ENTITY, -1)
    known = F.transform(found, entity)
    return F.when(ampersand, F.array_join(F.zip_with(between, known, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


MOJIBAKE = "[\u00c2\u00c3\u00e2][\u0080-\u00bf]"


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; the text stays where that fails or nothing looks wrong."""
    fits = text.rlike(MOJIBAKE) & text.rlike("(?s)^[\u0000-\u00ff]*$")
    return F.coalesce(F.try_validate_utf8(F.encode(F.when(fits, text), "ISO-8859-1").cast("string")), text)


def clean_text(text: Column) -> Column:
    """Control characters out, runs of white space to one blank, trimmed; empty for null."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip_html(raw: Column) -> Column:
    """Readable text: scripts and styles out, line ends at block ends, list marks, entities decoded, white space tidied."""
    x = F.coalesce(raw, F.lit(""))
    for pattern, by in (
        (r"(?is)<(script|style).*?</\1>", " "),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|li|h[1-6]|tr)>", "\n"),
        (r"(?i)<li[^>]*>", "- "),
        (r"<[^>]+>", " "),
    ):
        x = F.regexp_replace(x, pattern, by)
    x = once(once(x, unescape), fix_mojibake)  # both name their text several times
    for pattern, by in (("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]", ""), ("[ \t\u00a0]+", " "), ("\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, by)
    lines = F.transform(F.split(x, "\r\n|[\r\n\u2028\u2029]"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def identity_part(text: Column) -> Column:
    """Lower-case a-z and 0-9 only; accented letters are dropped, not folded."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def fingerprint(title: Column, company: Column, source: Column) -> Column:
    """Identity of an offer within its source."""
    return F.substring(F.sha1(F.concat(identity_part(title), F.lit("|"), identity_part(company), F.lit("|"), F.coalesce(source, F.lit("")))), 1, 16)


def cross_key(title: Column, company: Column) -> Column:
    """Identity of an offer across sources. Without a company, equal titles are one offer."""
    return F.substring(F.sha1(F.concat(identity_part(title), F.lit("|"), identity_part(company))), 1, 16)


def slugify(text: Column, size: int = 45) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.btrim(F.substring(dashed, 1, size), F.lit("-"))
    return F.when(cut == "", F.lit("offre")).otherwise(cut)


def clean_url(url: Column) -> Column:
    """Tracking parameters out of the query; the rest and the fragment stay as they are. Empty for null."""
    u = F.coalesce(url, F.lit(""))
    before, query, fragment = (F.regexp_extract(u, r"(?s)^([^?#]*)(?:\?([^#]*))?(#.*)?$", k) for k in (1, 2, 3))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(TRACKING)), "&")
    return F.concat(before, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)), fragment)


def is_truncated(description: Column) -> Column:
    """Does the text end in an ellipsis?"""
    return F.regexp_replace(F.coalesce(description, F.lit("")), r"(?U)\s+$", "").endswith("…")


def url_title(url: Column) -> Column:
    """The last part of a URL as words."""
    return F.translate(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), "-", " ")
