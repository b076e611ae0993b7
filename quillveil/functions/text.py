"""Text preparation, guards and masks as native column expressions.

Each function takes and returns a Column, so Catalyst sees one expression: no Python worker, no shuffle. Null in, null
out, unless a docstring says otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a mail address, a link, and a digit (decimal digits and the digits among other numbers).
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
LINK = r"^(https?|s?ftps?|scp)://(([A-Za-z0-9-]+\.)+[A-Za-z]{2,})(:\d+)?(/.*)?$"
_OTHER_DIGITS = r"\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
DIGIT = rf"[\p{{Nd}}{_OTHER_DIGITS}]"
#: A numeric date with dots or slashes.
NUMERIC_DATE = r"\d{1,2}[./]\d{1,2}[./]\d{2,4}"
_OPEN, _CLOSE = "\x01", "\x02"


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def clean_lines(text: Column | str) -> Column:
    """The lines of a text, stripped of white space of any kind, without blank ones."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def clean_text(text: Column | str) -> Column:
    """`clean_lines`, joined again."""
    return F.array_join(clean_lines(text), "\n")


def is_usable(text: Column | str, unmatched: str = "unmatched") -> Column:
    """Whether a field is to be processed: neither null nor empty nor the stand-in of a missing column. Never null."""
    t = _c(text)
    return F.coalesce((t != "") & (t != unmatched), F.lit(False))


def split_sentences(text: Column | str) -> Column:
    """Sentences by a rule: a break follows . ! ? with closing marks and a blank. An empty text has none."""
    broken = F.regexp_replace(_c(text), r"([.!?]+[\"')»”’\]]*)[ \t]+", "$1" + _OPEN)
    return F.filter(F.split(broken, _OPEN), lambda x: x != "")


def join_sentences(sentences: Column | str) -> Column:
    return F.array_join(_c(sentences), " ")


def strip_punctuation(text: Column | str) -> Column:
    """Letters, numbers and white space only."""
    return F.regexp_replace(_c(text), r"(?U)[^\p{L}\p{N}\s]", "")


def only_punctuation(text: Column | str) -> Column:
    return ~_c(text).rlike(r"[\p{L}\p{N}]")


def only_numbers(text: Column | str) -> Column:
    """Whether nothing but digits is left without punctuation and blanks; false for an empty rest."""
    return F.regexp_replace(strip_punctuation(text), r"(?U)\s", "").rlike(rf"^{DIGIT}+$")


def _words(text: Column | str) -> Column:
    stripped = F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")
    return F.filter(F.split(stripped, " "), lambda w: F.regexp_replace(w, r"(?U)\s", "") != "")


def only_emails(text: Column | str) -> Column:
    """Whether every word (split at blanks only) holds an @; true for a text without words."""
    return F.forall(_words(text), lambda w: F.contains(w, F.lit("@")))


def only_links(text: Column | str) -> Column:
    """Whether every word is a link; true for a text without words."""
    return F.forall(_words(text), lambda w: w.rlike(LINK))


def detectable(text: Column | str) -> Column:
    """Whether a language can be told at all. Never null."""
    t = _c(text)
    blank = F.regexp_replace(t, r"(?U)\s", "") == ""
    return F.coalesce(~(blank | only_punctuation(t) | only_numbers(t) | only_emails(t) | only_links(t)), F.lit(False))


def mask_emails(text: Column | str, by: str = "[email]") -> Column:
    return F.regexp_replace(_c(text), EMAIL, by)


def find_emails(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(EMAIL), F.lit(0))


def find_numeric_dates(text: Column | str) -> Column:
    """All numeric dates; a naive search that may also hit version numbers and the like."""
    return F.regexp_extract_all(_c(text), F.lit(NUMERIC_DATE), F.lit(0))


def mask_numbers(text: Column | str, by: str = "[number]") -> Column:
    """Each run of digits becomes one placeholder."""
    return F.regexp_replace(_c(text), f"{DIGIT}+", by)


def mask_numbers_except(text: Column | str, dates: Column | str, by: str = "[number]") -> Column:
    """`mask_numbers` that spares the given phrases wherever they stand in the text.

    A run of digits that follows a spared digit without a gap vanishes without a placeholder.
    """
    t, quoted = _c(text), F.transform(F.filter(_c(dates), lambda d: d != ""), lambda d: F.concat(F.lit(r"\Q"), d, F.lit(r"\E")))
    # Longer phrases first, so that a phrase inside another doesn't cut it short.
    order = F.transform(F.array_sort(F.transform(quoted, lambda q: F.struct((-F.length(q)).alias("n"), q.alias("q")))), lambda s: s["q"])
    pattern = F.when(F.size(order) > 0, F.concat(F.lit("("), F.array_join(order, "|"), F.lit(f")|{DIGIT}+"))).otherwise(F.lit(f"(\x03)|{DIGIT}+"))
    marked = F.regexp_replace(t, F.coalesce(pattern, F.lit(f"(\x03)|{DIGIT}+")), F.lit(f"{_OPEN}$1{_CLOSE}"))
    marked = F.regexp_replace(marked, f"({DIGIT}){_CLOSE}{_OPEN}{_CLOSE}", f"$1{_CLOSE}")
    return F.regexp_replace(F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit(by)), f"[{_OPEN}{_CLOSE}]", "")


def mask_numbers_except_numeric_dates(text: Column | str, by: str = "[number]") -> Column:
    """`mask_numbers` that spares numeric dates found by their form."""
    marked = F.regexp_replace(_c(text), rf"({NUMERIC_DATE})|{DIGIT}+", f"{_OPEN}$1{_CLOSE}")
    return F.regexp_replace(F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit(by)), f"[{_OPEN}{_CLOSE}]", "")


def title_case(text: Column | str) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    parts = F.split(_c(text), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**30)))), "")


_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def unescape_html(text: Column | str) -> Column:
    """Character references as their characters: all names of HTML, decimal and hexadecimal numbers; unknown ones stay."""
    t = _c(text)
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def one(ref: Column) -> Column:
        body = F.substring(ref, 2, F.length(ref) - 2)
        hexa = F.lower(F.substring(body, 2, 1)) == "x"
        code = F.when(hexa, F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(F.substring(body, 2, 8)).cast("int")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
        return F.when(F.substring(body, 1, 1) == "#", F.when(valid, char).otherwise(ref)).otherwise(F.coalesce(F.element_at(names, body), ref))

    refs, parts = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)), F.split(t, _ENTITY)
    joined = F.array_join(F.zip_with(parts, F.transform(refs, one), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(t.rlike(_ENTITY), joined).otherwise(t)


def html_to_text(text: Column | str) -> Column:
    """Text of a string that holds a tag: comments, scripts, styles and tags are cut, character references decoded. Others stay."""
    t = _c(text)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"(?si)<(script|style)[^>]*>.*?</(script|style)>", ""), r"<[^>]*>", "")
    return F.when(t.rlike(r"<[A-Za-z!/][^>]*>"), unescape_html(bare)).otherwise(t)


def detokenize(text: Column | str) -> Column:
    """Join tokens that were set apart by blanks, in this order: blanks are made one, then punctuation, opening and closing
    brackets, apostrophes between words, and what stands in quotes lose the blank beside them."""
    t = F.regexp_replace(F.regexp_replace(_c(text), r"(?U)\s+", " "), r"^ | $", "")
    for pattern, by in ((r" ([?.!,;:%])", "$1"), (r"([(\[{]) ", "$1"), (r" ([)\]}])", "$1"), (r"(?U)(\w) ' (\w)", "$1'$2"), (r"(?U)(\w) ’ (\w)", "$1’$2"), (r'(["“‘]) (.*?) (["”’])', "$1$2$3")):
        t = F.regexp_replace(t, pattern, by)
    return t


def placeholder_count(text: Column | str, placeholder: str) -> Column:
    return F.regexp_count(_c(text), F.lit(rf"\Q{placeholder}\E"))


def literal_mask(text: Column | str, values: Column | str, by: str) -> Column:
    """Replace each given string, in order, wherever it stands."""
    return F.aggregate(_c(values), _c(text), lambda acc, v: F.when(v == "", acc).otherwise(F.replace(acc, v, F.lit(by))))


def first_of(columns: Sequence[Column]) -> Column:
    return F.coalesce(*columns)
