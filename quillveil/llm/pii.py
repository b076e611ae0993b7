"""Find personal information in free text and replace it with typed placeholders.

Kinds: email (spelled-out forms too), phone, identity, address, name. Numbers are looked for where digits stand only, by the
formats of the countries at hand, and validated: a telephone number by its count of digits, a number of a record by the
check digits of its format or by a label before it. Names are recognised by a lexicon: the given list, names that header
and attribution lines of the whole corpus give, those that the message's own header lines give, and what follows a title.

A mention is what validation gives a canonical form; pseudonyms are a format-preserving permutation of it. A keyed Feistel
network runs over the subscriber's digits of a telephone number (without country code, trunk zero and separators), over
the body of a number with check digits (which are computed anew), over all digits and letters of other numbers, over the
days of a calendar for dates. So equal values get equal pseudonyms in every document, however they are written, and the
key's holder can undo it. Values that would leave their format are permuted again. Names, mail and street addresses get a
keyed code of 64 bits.

Defined results: null stays null; empty and blank texts have no mention; mentions never overlap (the earlier kind of
email, identity, address, phone, name wins); offsets count code points of the stored text; extra columns pass by. Names of
the corpus count from NAME_SHARE of all names on, which bounds the lexicon by definition.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.batches import uncollected
from quillveil.runtime import written

KINDS = ["email", "identity", "address", "phone", "name"]
NAME_SHARE = 2e-5
#: Entries of the given list of names that may be collected; its size is checked.
LISTED = 200_000

_S = r"[ \xa0]{1,6}"
_UP = "A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ"
_FLOW = re.compile(r"(?<= )\r?\n(?:[>|]+[ \t]?)*")

# ---- mail addresses
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|[ ]?[\[(][ ]?(?:dot|punto|ponto|point|punkt)[ ]?[\])][ ]?|[ ](?:dot|punto|ponto|punkt)[ ])"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9_.+\-])[A-Za-z0-9_](?:[A-Za-z0-9_.+\-]*[A-Za-z0-9_])?(?:[ ]{{0,3}}@[ ]{{0,3}}|[ ]{{0,3}}[\[(][ ]?(?:at|AT|At|arroba|arobase)[ ]?[\])][ ]{{0,3}}|[ ](?:at|arroba|arobase)[ ](?={_HOST}[ ](?:dot|punto|ponto|punkt)[ ])){_HOST}(?:{_DOT}{_HOST})*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])",
    re.I,
)

_AT = re.compile(r"@|[\[(][ ]?(?:at|arroba|arobase)[ ]?[\])]|[ ](?:at|arroba|arobase)[ ](?=[A-Za-z0-9\-]+[ ](?:dot|punto|ponto|punkt)[ ])", re.I)
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Mail addresses, looked for around their signs."""
    out: list[tuple[int, int]] = []
    low = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < low:
            continue
        while at > low and text[at - 1] == " " and m.start() - at < 3:
            at -= 1
        if at == low or text[at - 1] not in _LOCAL:
            continue
        while at > low and text[at - 1] in _LOCAL:
            at -= 1
        if found := _EMAIL.match(text, at):
            out.append(found.span())
            low = found.end()
    return out


# ---- telephone numbers
_SEP = r"[ \xa0.\-/Â]{0,4}"
_PHONE = re.compile(
    rf"""(?<![A-Za-z0-9_.,\-/@+:])(?<!\d[ \xa0])(?:
      \(?\+\d{{1,3}}\)?{_SEP}(?:\(0\){_SEP})?\(?\d{{1,5}}\)?(?:{_SEP}\d{{2,9}}){{0,5}}
    | 00\d{{2}}\d?{_SEP}\d{{1,3}}(?:{_SEP}\d{{2,9}}){{1,5}}
    | \(0?\d{{2,4}}\){_SEP}\d{{3,5}}[ \xa0\-]{{1,4}}\d{{3,4}}
    | \(0\d{{1,4}}\){_SEP}\d{{5,8}}(?:-\d{{2,4}})?
    | \d{{3}}-\d{{3}}-\d{{4}} | [2-9]\d{{2}}\.\d{{3}}\.\d{{4}}
    | 0\d{{4}}{_S}\d{{6}} | 0\d{{4}}{_S}\d{{3}}{_S}\d{{3}}
    | 0\d(?:(?:{_S}|\.)\d{{2}}){{4}}
    | 0\d{{2,4}}[ \xa0/\-]{{1,4}}\d{{3,8}}(?:[ \xa0\-]{{1,4}}\d{{2,5}})?
    | [2-9]\d{{2}}(?P<s>-|{_S})\d{{3}}(?P=s)\d{{3}}
    | [2-9]\d{{2}}{_S}\d{{3}}{_S}\d{{3}}
    )(?![A-Za-z0-9_/@]|[.,\-:]\d|{_S}\d{{2,}})""",
    re.X,
)

# ---- numbers of persons' records
_ID_LABEL = re.compile(
    r"(?:carte\s+d['’]identit\S{1,8}|s\S{1,8}curit\S{1,8}\s+sociale|passeport|passport|num\S{1,8}ro\s+fiscal|social\s+security(?:\s+number)?|\bSSN|national\s+insurance(?:\s+number)?|driving\s+licen[cs]e|tax\s+(?:id|number)"
    r"|\bD\.?\s?N\.?\s?I\b\.?|\bN\.?\s?I\.?\s?[EF]\b\.?|\bC\.?\s?P\.?\s?F\b\.?|\bS\.\s?S\.\s?N\.|\bCIF|\bdocumento|pasaporte|seguridad\s+social|\bRG\b|contribuinte|cart\S{1,6}o\s+de\s+cidad\S{1,6}o|passaporte|bilhete\s+de\s+identidade"
    r"|Ausweis\w*|Personalausweis\w*|Reisepass\w*|Steuer-?ID|Steuernummer|Sozialversicherungsnummer|codice\s+fiscale|passaporto|carta\s+d['’]identit\S{1,6})",
    re.I,
)
#: Numbers that could be of a person's record; a label before them tells.
_ID_NUMBER = re.compile(
    rf"(?<![\w.\-/])(?:\d{_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d|\d{{2,3}}{_S}\d{{2,3}}{_S}\d{{3,4}}(?:{_S}\d{{3}})?|\d{{3}}-\d\d-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d|\d\d?\.\d{{3}}\.\d{{3}}[- ]?[A-Z](?![a-z])"
    rf"|[XYZ]-?\d{{7}}[- ]?[A-Z](?![a-z])|\d{{8}}[- ]?[A-Z](?![a-z])|[A-Z]{{0,3}}\d[A-Z0-9]{{5,14}})(?![\w])"
)
_ID_BEFORE = re.compile(_ID_LABEL.pattern + r"[\s:]*(?:n\S{0,4}[°ºo.]\S?|no\.|nr\.|num\S{0,4}\.?|number|nummer|is|es|é|ist|lautet)?[\s:]*$", re.I)
#: Formats that are told without a label.
_ID_PLAIN = re.compile(
    rf"(?<![\w.\-/])(?:[12]{_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d|[12]\d{{14}}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d|\d\d\.\d{{3}}\.\d{{3}}[- ]?[A-Z]|[XYZ]\d{{7}}-?[A-Z]|\d{{8}}-?[A-Z]|\d\d[A-Z]{{2}}\d{{5}}|[A-Z]\d\d[A-Z]\d{{5}}|\d{{3}}-\d\d-\d{{4}})(?![\w\-]|[.,]\d)"
)

#: A stretch of digits, capitals and separators: numbers are looked for within such only.
_FIELD = re.compile(r"[0-9+(][0-9A-Z \xa0.\-/()+Â]{5,}")
_DIGITS = re.compile(r"\d")

# ---- street addresses
_TOWN = rf"(?:(?:Groß|Bad|Klein|Alt|Neu)[ ]{{1,4}}[\w\-]+|[{_UP}][\w'’\-]*(?:[ \xa0]{{1,4}}(?:(?:de|del|da|do|das|dos|di|du|des|la|las|el|le|los|sur|am|an|der)[ ]{{1,4}}){{0,2}}[{_UP}][\w'’\-]+){{0,3}})"
_ADDRESSES = [
    (re.compile(p), tuple(words.split("|")))
    for words, p in (
        ("", rf"(?:(?:Flat|Apt\.?|Unit){_S}\w{{1,4}},?{_S})?(?<![\w\-])\d{{1,4}}[a-z]?{_S}[A-Z][\w'’.]*(?:{_S}[A-Z][\w'’.]*){{0,3}},{_S}[A-Z][\w'’\-]*(?:{_S}[A-Z][\w'’\-]*){{0,3}},?{_S}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}}(?!\w)"),
        ("Street|St.|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way", rf"(?<![\w\-])\d{{1,5}}{_S}(?:[NSEW]\.?{_S})?[A-Z][\w'’]*(?:{_S}[A-Z][\w'’]*){{0,3}}{_S}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way)\.?,?{_S}(?:(?:Apt|Suite|Unit)\.?{_S}\w{{1,5}},?{_S})?[A-Z][\w'’\-]*(?:{_S}[A-Z][\w'’\-]*){{0,3}},?{_S}[A-Z]{{2}}{_S}\d{{5}}(?:-\d{{4}})?(?!\w)"),
        ("rue|avenue|av.|bd.|boulevard|impasse|chemin|place|all|quai|route|cours|square", rf"(?<![\w\-])\d{{1,4}}(?:{_S}(?:bis|ter|quater))?,?{_S}(?:rue|avenue|av\.|bd\.|boulevard|impasse|chemin|place|all\S{{1,6}}e|quai|route|cours|square){_S}[^,\n]{{3,45}},{_S}\d{{5}}{_S}{_TOWN}"),
        ("Calle|C/|Av|Paseo|Plaza|Pza.|Camino|Ronda|Glorieta|Via|Corso|Piazza", rf"(?:Calle|C/|Avda\.|Avenida|Av\.|Paseo|Plaza|Pza\.|Camino|Ronda|Glorieta|Via|Viale|Corso|Piazza){_S}[^\n]{{3,60}}?,{_S}\d{{5}}{_S}{_TOWN}"),
        ("R|Av|Travessa|Tv.|Largo|Pra|Estrada|Alameda|Beco|Calle|C/|Paseo|Plaza", rf"(?:Rua|R\.|Av\.|Avenida|Travessa|Tv\.|Largo|Pra\S{{1,4}}a|Estrada|Alameda|Beco|R\S{{1,4}}a|Praza|Calle|C/|Avda\.|Paseo|Plaza){_S}[^\n]{{3,60}}?,{_S}\d{{4,5}}-\d{{3}}{_S}{_TOWN}"),
        ("str|allee|weg|gasse|platz|ring|ufer|damm|anger|hof|steig|Am |An |Im |Auf |Zum |Zur ", rf"(?:[{_UP}][\w]*(?:str\S{{1,6}}e|str\.|allee|weg|gasse|platz|ring|ufer|damm|anger|hof|steig)|(?:Am|An{_S}de[rn]|Im|Auf{_S}de[rm]|Zum|Zur){_S}[{_UP}]\w+(?:{_S}[{_UP}]\w+)?){_S}\d{{1,4}}{_S[:-1]}?[a-z]?,{_S}(?:[DA]-)?\d{{4,5}}{_S}{_TOWN}".replace(_S[:-1] + "?[a-z]", "[ ]?[a-z]")),
    )
]
_POSTCODE = re.compile(r"\d{4,5}(?:-\d{3})?[ \xa0]|[A-Z]{1,2}\d{1,2}[A-Z]?[ \xa0]+\d[A-Z]{2}")

_UK_POSTCODE = re.compile(r"\d[A-Z]{2}(?!\w)")

# ---- names
_CAP = re.compile(rf"(?<![\w@./\-])[{_UP}][\w'’]*(?:-[{_UP}][\w'’]*)*")
_INITIALS = re.compile(rf"(?<![\w.])(?:[{_UP}]\.(?:-[{_UP}]\.)?[ \xa0]{{0,4}}){{1,3}}$")
_TITLES = frozenset("Mr. Mrs. Ms. Miss Dr. Prof. Prof.ª Prof.ssa prof. prof.ª Sr. Sra. Srta. Dra. Sig. Sig.ra Dott. Dott.ssa avv. Hr. Fr. Herr Herrn Frau M. Mme Mlle Monsieur Madame г-н г-жа д-р проф.".split())
#: Vowel signs and tone marks, which Python takes for no part of a word.
_MARKS = "ऀ-ःऺ-ॏ॑-ॗॢॣัิ-ฺ็-๎"
_PERSON_MAIL = re.compile(rf"(?:^|(?<=[^\w{_MARKS}]))((?:[^\W\d_][\w{_MARKS}'’.\-]*[ \xa0]+){{0,3}}[^\W\d_][\w{_MARKS}'’.\-]*)[ \xa0]{{0,6}}\(?$")
_PERSON_TO = re.compile(r"(?m)^[>| ]*\*?(?:To|Para|À|Ã€|An|A|Pour|Кому|Cc)[ \xa0]?:\*?[ ]+([^\n<@:]{2,}?)\r?$")
#: Words of the name of one person at most.
NAME_OF = 6
_STOP = frozenset("mr mrs ms dr prof sr sra srta dra sig dott avv hr fr herr frau monsieur madame mme mlle on le la am el em a den the von an de um re fwd à um schrieb wrote hello hi dear lundi".split())
_OTHER = re.compile("[぀-ヿ㐀-鿿฀-๿؀-ۿऀ-ॿ]")
_MONTHLIKE = frozenset(["may", "mai", "august", "avril", "juin", "abril", "sol", "mark", "till"])


_SPACED = re.compile("[؀-ۿऀ-ॿ]+")
_FRENCH = re.compile(r"\b(?:et|est|chez|pour|vous|avec|des|les)\b")
_ATTRIBUTED = re.compile(r"(?:schrieb|wrote|,|:)\s+")
_HEADER_LINE = re.compile(r"[>| ]*\*?[^\W\d_]{1,8}[ \xa0]?:\*? ")


class Lexicon:
    """Name words in small letters, and the names in scripts without capitals: by word, or where no spaces are by automaton."""

    def __init__(self, words: set[str], others: set[str]):
        self.words, self.others = words, others
        self.spaced = {w for w in others if _SPACED.match(w)}
        self.solid = ahocorasick.Automaton()
        for w in others - self.spaced:
            self.solid.add_word(w, len(w))
        self.solid.make_automaton()
        self.memo: dict[str, tuple[int, int]] = {}

    def __reduce__(self):  # noqa: ANN204
        return Lexicon, (self.words, self.others)

    def other_names(self, text: str) -> list[list[int]]:
        """Names in scripts without capitals; neighbours are one name (with a space or hyphen between, in scripts without spaces with nothing or a space)."""
        found = []
        if self.spaced:
            found += [(m.start(), m.end(), 1) for m in _SPACED.finditer(text) if m[0] in self.spaced]
        if len(self.solid):
            found += [(end + 1 - n, end + 1, 0) for end, n in self.solid.iter_long(text)]
        out: list[list[int]] = []
        for a, b, spaced in sorted(found):
            if out and (text[out[-1][1] : a] in ((" ", "-") if spaced else ("", " "))):
                out[-1][1] = b
            else:
                out.append([a, b])
        return out

    def look(self, token: str) -> tuple[int, int]:
        """Where in a capitalised token a name begins and how long it is; length 0: none. Kept for tokens that come again."""
        got = self.memo.get(token)
        if got is None:
            got = self._look(token)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = got
        return got

    def _look(self, token: str) -> tuple[int, int]:
        if self.has(token):
            return 0, len(token)
        for end in ("'s", "’s", "'", "’"):
            if token.endswith(end) and self.has(token[: -len(end)]):
                return 0, len(token) - len(end)
        head, mark, rest = token.replace("’", "'").partition("'")
        if mark and len(head) <= 2 and rest[:1].isupper() and self.has(rest):  # an elided article
            return len(head) + 1, len(rest)
        return 0, 0

    def has(self, word: str, own: frozenset[str] = frozenset()) -> bool:
        low = word.lower()
        if low in self.words or low in own:
            return True
        return "-" in low and all(p in self.words or p in own for p in low.split("-"))


def name_words(name: str) -> list[str]:
    """The words of a full name: no initials, no titles; names in scripts without capitals whole and by word."""
    out = []
    for w in name.replace("\xa0", " ").split():
        w = w.strip(".,;:()\"'")
        if len(w) < 2 or w.lower() in _STOP or any(c.isdigit() for c in w):
            continue
        if _OTHER.match(w):
            out.append(w)
        elif w[0].isupper():
            out += [w.lower(), *(p.lower() for p in w.split("-") if "-" in w and len(p) > 1)]
        else:
            return out if not out else []
    return out


def persons(text: str) -> list[str]:
    """Names that header and attribution lines give, as they are written there."""
    out = []
    at = text.find("<")
    while at >= 0:
        end = text.find(">", at)
        if end < 0:
            break
        if end - at > 3 and text.find("\n", at, end) < 0:
            head = text[text.rfind("\n", 0, at) + 1 : at].replace("\xa0", " ").rsplit(None, 4)
            if m := _PERSON_MAIL.search(" ".join(head[-4:])):
                out.append(m[1])
        at = text.find("<", at + 1)
    if ": " in text or ":*" in text:
        out += [m[1] for m in _PERSON_TO.finditer(text) if m[1].count(" ") < NAME_OF]
    # What stands before the name in an attribution is no part of it.
    return [_ATTRIBUTED.split(n)[-1] for n in out]


def numbers(text: str, taken: list[tuple[int, int, str]]) -> None:
    """Add the validated numbers: identity before address before phone."""
    fields = []
    for m in _FIELD.finditer(text):
        if len(_DIGITS.findall(m[0])) >= 6:
            fields.append((max(0, m.start() - 4), min(len(text), m.end() + 3)))
    for a, b in fields:
        for m in _ID_NUMBER.finditer(text, a, b):
            if free(taken, *m.span()) and _ID_BEFORE.search(text[max(0, m.start() - 96) : m.start()]):
                taken.append((*m.span(), "identity"))
        for m in _ID_PLAIN.finditer(text, a, b):
            if free(taken, *m.span()) and told_alone(m[0]):
                taken.append((*m.span(), "identity"))
    if _POSTCODE.search(text):
        for p, words in _ADDRESSES:
            if any(w in text for w in words) if words[0] else _UK_POSTCODE.search(text):
                taken += [(m.start(), m.end(), "address") for m in p.finditer(text) if free(taken, *m.span())]
    for a, b in fields:
        for m in _PHONE.finditer(text, a, b):
            if free(taken, *m.span()) and 8 <= len(_DIGITS.findall(m[0])) <= 15:
                taken.append((*m.span(), "phone"))


def free(taken: list[tuple[int, int, str]], a: int, b: int) -> bool:
    return all(b <= s or a >= e for s, e, _ in taken)


def find_mentions(message: str, lexicon: Lexicon) -> list[tuple[str, int, int]]:
    """Kind, start and end of each mention, in order."""
    text = _FLOW.sub(lambda m: " " * len(m[0]), message) if " \n" in message or " \r\n" in message else message
    taken: list[tuple[int, int, str]] = []
    if "@" in text or "at]" in text or "at)" in text or " at " in text or "AT" in text or "rroba" in text or "robase" in text:
        taken += [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        numbers(text, taken)
    taken += _names(text, lexicon, taken)
    return sorted(((k, a, b) for a, b, k in taken), key=lambda x: x[1])


def _names(text: str, lexicon: Lexicon, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    given = [w for n in persons(text) for w in name_words(n)] if "<" in text or ": " in text or ":*" in text else []
    own = frozenset(w for w in given if len(w) > 2)
    busy = sorted((a, b) for a, b, _ in taken)
    out: list[list[int]] = []
    french: bool | None = None
    q = 0
    known, look = lexicon.memo.get, lexicon.look
    for m in _CAP.finditer(text):
        token = m[0]
        skip, size = known(token) or look(token)
        if not size:
            if own and lexicon.has(token, own):
                size = len(token)
            elif len(token) > 2 and titled(text, m.start()):
                size = len(token) - (2 if token.endswith(("'s", "’s")) else 0)
            else:
                continue
        a, b = m.span()
        while q < len(busy) and busy[q][1] <= a:
            q += 1
        if q < len(busy) and busy[q][0] < b:
            continue
        a += skip
        word = text[a : a + size]
        joined = bool(out) and text[out[-1][1] : a].strip(" \xa0") == "" and 0 < a - out[-1][1] <= 6
        if word.lower() in _MONTHLIKE and not joined and (re.search(r"\d[.\s]*(?:de\s)?$", text[max(0, a - 6) : a]) or re.match(r"\.?\s+\d", text[b : b + 4])):
            continue
        b = a + len(word)
        if joined:
            out[-1][1] = b
        else:
            i = _INITIALS.search(text, max(0, a - 14), a) if text[a - 1 : a] in ". \xa0" and "." in text[max(0, a - 5) : a] else None
            if i and i[0].strip() == "M." and french is None:
                french = _FRENCH.search(text) is not None
            # In French a single M. is a title, but for header lines.
            if i and not (i[0].strip() == "M." and french and not _HEADER_LINE.match(text, text.rfind("\n", 0, a) + 1)):
                before = i.start()
                if not any(before < e and s < a for s, e in busy):
                    a = before
            out.append([a, b])
    if _OTHER.search(text):
        out += [x for x in lexicon.other_names(text) if all(x[1] <= s or x[0] >= e for s, e in busy)]
        if others := {w for w in given if len(w) > 1 and _OTHER.match(w)}:
            # The message's own names in scripts without capitals; one that touches a known name makes it longer.
            for a, b in Lexicon(set(), others).other_names(text):
                if not all(b <= s or a >= e for s, e in busy):
                    continue
                near = [x for x in out if (x[0] <= b and a <= x[1]) or text[x[1] : a] == " " or text[b : x[0]] == " "]
                out = [x for x in out if x not in near] + [[min([a, *(x[0] for x in near)]), max([b, *(x[1] for x in near)])]]
    return [(a, b, "name") for a, b in out]


def titled(text: str, at: int) -> bool:
    """Whether a title stands right before a place."""
    if text[at - 1 : at] not in (" ", "\xa0"):
        return False
    before = text[max(0, at - 16) : at].replace("\xa0", " ")
    word = before.split()[-1:]
    return bool(word) and word[0].lstrip("([\"'«“„>*") in _TITLES and before.endswith(word[0] + " " * (len(before) - len(before.rstrip(" "))))


def corpus_names(samples: DataFrame, share: float = NAME_SHARE) -> Counter:
    """Words of the names in header and attribution lines, with their numbers, over all messages."""

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for m in batch.column("message").to_pylist():
                if "<" in m or ": " in m:
                    for n in persons(m):
                        counts.update(name_words(n))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = samples.select("message").filter(F.length("message") > 0).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = written(rows, "corpus-names")
    everything = rows.agg(F.sum("n")).first()[0] or 0
    kept = rows.filter(F.col("n") >= max(2, everything * share)).collect()  # at most 1 / share words
    return Counter({r.word: r.n for r in kept})


def fit_lexicon(samples: DataFrame, gazetteer: DataFrame) -> Lexicon:
    words: set[str] = set()
    others: set[str] = set()
    listed = [r.word for r in gazetteer.filter("entity_group = 'PER'").select("word").dropna().distinct().limit(LISTED + 1).collect()]
    if len(listed) > LISTED:
        raise ValueError(f"the list of names has more than {LISTED} entries")
    for w in listed:
        if _OTHER.match(w):
            others.update([w, *w.split()])
        else:
            words.add(w.lower())
            words.update(p.lower() for p in w.split() if len(p) > 2)
    for w in corpus_names(samples):
        if _OTHER.match(w):
            others.add(w)
        else:
            words.add(w)
    # Full names without a space: what stands beside a known part is the other part.
    full = [w for w in others if len(w) >= 3 and re.match("[぀-ヿ㐀-鿿]", w)]
    for _ in range(2):
        parts = {w[len(p) :] for w in full for p in others if len(p) >= 2 and w.startswith(p) and len(w) - len(p) >= 2}
        parts |= {w[: -len(p)] for w in full for p in others if len(p) >= 2 and w.endswith(p) and len(w) - len(p) >= 2}
        others |= parts
    return Lexicon(words, others)


# ---- pseudonyms
def _round(key: bytes, n: int, value: int, salt: str) -> int:
    return int.from_bytes(hmac.digest(key, f"{salt}|{n}|{value}".encode(), "sha256")[:12], "big")


def feistel(left: int, right: int, left_size: int, right_size: int, key: bytes, salt: str, rounds: int = 8, back: bool = False) -> tuple[int, int]:
    """A keyed permutation of pairs below the two sizes, by additions of keyed functions of the other half."""
    for n in reversed(range(rounds)) if back else range(rounds):
        sign = -1 if back else 1
        if n % 2:
            right = (right + sign * _round(key, n, left, salt)) % right_size
        else:
            left = (left + sign * _round(key, n, right, salt)) % left_size
    return left, right


# Formats with check digits, by their compact form: body and check of a number, and the check that its body asks for.
def _cpf(body: str) -> str:
    for weight in (10, 11):
        body += str(sum(int(c) * (weight - k) for k, c in enumerate(body)) * 10 % 11 % 10)
    return body[-2:]


def _nif(body: str) -> str:
    rest = 11 - sum(int(c) * (9 - k) for k, c in enumerate(body)) % 11
    return str(rest if rest < 10 else 0)


def _tax_id(body: str) -> str:
    product = 10
    for c in body:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return str((11 - product) % 10)


def _letter(body: str) -> str:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(body.translate(str.maketrans("XYZ", "012"))) % 23]


CHECKED = {
    "national number": (re.compile(r"([12]\d{12})(\d\d)"), lambda body: f"{97 - int(body) % 97:02d}"),
    "person's tax number": (re.compile(r"(\d{9})(\d\d)"), _cpf),
    "tax id": (re.compile(r"([1-9]\d{9})(\d)"), _tax_id),
    "identity letter": (re.compile(r"((?:\d|[XYZ])\d{7}|\d{8})([A-Z])"), _letter),
    "contributor's number": (re.compile(r"([125689]\d{7})(\d)"), _nif),
}
_COMPACT = re.compile(r"[^0-9A-Za-z]")


def checked(compact: str) -> tuple[str, str] | None:
    """Name of the format whose check digits a compact number holds right, and its body; None if there is none."""
    for name, (form, check) in CHECKED.items():
        m = form.fullmatch(compact)
        if m and check(m[1]) == m[2]:
            return name, m[1]
    return None


#: Shapes that say by themselves what they are, although they have no check digits.
_SAID = re.compile(r"\d\d[A-Z]{2}\d{5}|[A-Z]\d\d[A-Z]\d{5}|\d{3}-\d\d-\d{4}")


def told_alone(text: str) -> bool:
    """Whether a number without a label is one of a record: its check digits are right or its shape says so."""
    return _SAID.fullmatch(text) is not None or checked(_COMPACT.sub("", text)) is not None


#: Country calling codes by which the subscriber's digits are told from them: fixed values.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 966 971 972".split())


def subscriber(text: str) -> list[int]:
    """Places of a telephone number's digits after country code and trunk zeros."""
    places = [k for k, c in enumerate(text) if c.isascii() and c.isdigit()]
    digits = "".join(text[k] for k in places)
    skip = 0
    if text.lstrip("( ").startswith("+") or digits.startswith("00"):
        skip = 2 if digits.startswith("00") else 0
        skip += next((n for n in (1, 2, 3) if digits[skip : skip + n] in CALLING), 0)
    while skip < len(digits) - 4 and digits[skip] == "0":
        skip += 1
    return places[skip:]


def permuted(text: str, key: bytes, salt: str, back: bool = False) -> str:
    """A keyed permutation of the strings of one form: digits stay digits, letters letters of their case."""
    zeros = ["0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" for c in text]
    radix = [10 if z == "0" else 26 for z in zeros]
    half = len(text) // 2

    def number(a: int, b: int) -> tuple[int, int]:
        value, size = 0, 1
        for k in range(a, b):
            value, size = value * radix[k] + ord(text[k]) - ord(zeros[k]), size * radix[k]
        return value, size

    (left, left_size), (right, right_size) = number(0, half), number(half, len(text))
    out = []
    for value, a, b in zip(feistel(left, right, left_size, right_size, key, salt + "".join(zeros), back=back), (0, half), (half, len(text)), strict=True):
        part = []
        for k in reversed(range(a, b)):
            value, digit = divmod(value, radix[k])
            part.append(chr(ord(zeros[k]) + digit))
        out += reversed(part)
    return "".join(out)


def pseudonym_number(text: str, key: bytes, back: bool = False, kind: str = "identity") -> str:
    """Permute a number within its format; all that is no digit or letter stays in place.

    Of a telephone number only the subscriber's digits change, and they stay told from the rest; a number whose check digits
    are right gets a body of its form and the check digits for it, and one without right check digits gets none.
    """
    if kind == "phone":
        places = subscriber(text)
        good = lambda t: subscriber(filled(text, places, t)) == places
        form, body = "phone", "".join(text[k] for k in places)
    else:
        places = [k for k, c in enumerate(text) if c.isascii() and c.isalnum()]
        compact = "".join(text[k] for k in places)
        form, body = checked(compact) or ("", compact)
        if form:
            shape, check = CHECKED[form]
            good = lambda t: t[1:].isdigit() and (t[0] in "XYZ" or t[0].isdigit()) and checked(t + check(t)) == (form, t)
        else:
            good = lambda t: checked(t) is None
    if len(body) < 2 or not good(body):
        return text
    made = permuted(body, key, form, back)
    while not good(made):  # outside the format: permuted again, until it comes back into it
        made = permuted(made, key, form, back)
    if form and form != "phone":
        made += CHECKED[form][1](made)
    return filled(text, places, made)


def filled(text: str, places: list[int], chars: str) -> str:
    out = list(text)
    for k, c in zip(places, chars, strict=True):
        out[k] = c
    return "".join(out)


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def pseudonym_date(day: date, key: bytes, back: bool = False) -> date:
    """Permute the days from 1900 to 2099; a value that leaves the range is permuted again. Other days stay."""
    days = (LAST_DAY - FIRST_DAY).days + 1
    n = (day - FIRST_DAY).days
    if not 0 <= n < days:
        return day
    side = 271
    while True:
        a, b = feistel(*divmod(n, side), side, side, key, "date", back=back)
        n = a * side + b
        if n < days:
            return FIRST_DAY + timedelta(days=n)


_DATES = re.compile(r"(?<![\w./\-])(?:(?P<y>(?:19|20)\d\d)-(?P<m>\d\d)-(?P<d>\d\d)|(?P<d2>\d\d)(?P<s>[./])(?P<m2>\d\d)(?P=s)(?P<y2>(?:19|20)\d\d))(?![\w/\-]|\.\d)")


def mask_dates(text: str, key: bytes) -> str:
    """Permute the dates of days written in numbers (year first, or day first with points or slashes), in their format."""

    def change(m: re.Match) -> str:
        first = m["y"] is not None
        try:
            day = date(*(int(m[k]) for k in (("y", "m", "d") if first else ("y2", "m2", "d2"))))
        except ValueError:
            return m[0]  # no day of the calendar
        made = pseudonym_date(day, key)
        return f"{made:%Y-%m-%d}" if first else f"{made:%d{m['s']}%m{m['s']}%Y}"

    return _DATES.sub(change, text)


def placeholder(kind: str, text: str, key: bytes) -> str:
    """``[phone 553-118-904]`` for numbers, ``[name 3f9c01d27a40be15]`` for the rest; equal values (but for case and spaces) alike."""
    if kind in ("phone", "identity"):
        return f"[{kind} {pseudonym_number(' '.join(text.split()), key, kind=kind)}]"
    plain = " ".join(text.casefold().split()).encode()
    return f"[{kind} {hashlib.blake2b(plain, key=key[:64], digest_size=8).hexdigest()}]"


def mask(message: str | None, lexicon: Lexicon, key: bytes, dates: bool = False) -> str | None:
    """The message with a placeholder for each mention; with ``dates`` its dates are permuted, too."""
    if not message:
        return message
    between = (lambda t: mask_dates(t, key)) if dates else str
    out, at = [], 0
    for kind, a, b in find_mentions(message, lexicon):
        out += [between(message[at:a]), placeholder(kind, message[a:b], key)]
        at = b
    out.append(between(message[at:]))
    return "".join(out)


def mentions(samples: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``row_id, kind, start_char, end_char`` of each mention; a map without shuffle."""
    shared = samples.sparkSession.sparkContext.broadcast(lexicon)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, starts, ends = [], [], [], []
            for row, m in zip(batch.column("row_id").to_pylist(), batch.column("message").to_pylist(), strict=True):
                for kind, a, b in find_mentions(m, shared.value):
                    ids.append(row), kinds.append(kind), starts.append(a), ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["row_id", "kind", "start_char", "end_char"])

    return samples.select("row_id", "message").filter(F.length("message") > 0).mapInArrow(run, "row_id bigint, kind string, start_char bigint, end_char bigint")


def masked(samples: DataFrame, lexicon: Lexicon, key: bytes, out: str = "masked", dates: bool = False) -> DataFrame:
    """All columns and ``out``: the message with a typed placeholder for each mention. A column of that name is replaced."""
    shared = samples.sparkSession.sparkContext.broadcast(lexicon)
    keep = [f for f in samples.schema.fields if f.name != out]

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([mask(m, shared.value, key, dates) for m in batch.column("message").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), made], names=[*(f.name for f in keep), out])

    return samples.select(*[f.name for f in keep]).mapInArrow(run, T.StructType([*keep, T.StructField(out, T.StringType())]))


def p2_found(samples: DataFrame, gazetteer: DataFrame) -> DataFrame:
    return mentions(samples, fit_lexicon(samples, gazetteer))


def p2_masked(samples: DataFrame, gazetteer: DataFrame, key: bytes) -> DataFrame:
    return masked(samples.select("row_id", "message"), fit_lexicon(samples, gazetteer), key).select("row_id", "masked")
