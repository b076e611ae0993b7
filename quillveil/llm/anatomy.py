"""Anatomy of an e-mail: a label for each line, by a sequence model over line features.

Physical lines are joined to logical ones where a line ends in a space (flowed text). Each logical line gets the cues of
its form, prefix, position, punctuation and neighbours; an averaged perceptron with Viterbi decoding labels the sequence.
It is trained on messages whose lines `draft_labels` marks from unmistakable signs (quote prefixes, header blocks,
signature delimiters, known closings): a bounded sample or, by `fit_line_model`, all; all of the corpus is then labelled by the model alone. On demand a
line whose sign admits no other reading (a quote prefix, what follows a header block) keeps the label of the sign.

Labels: N new text, G greeting, C closing, M name under a closing, L list item; Q quoted line, A attribution, H header
line, X separator, F text forwarded below a header block; S signature, D disclaimer.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.batches import uncollected

LABELS = "NGCMLQAHXFSD"
_ID = {c: i for i, c in enumerate(LABELS)}
NEW = frozenset("NGCML")
#: Messages from which the model is trained.
TRAIN_MESSAGES = 2500
#: Distinct lines whose scores a worker keeps; beyond that it starts afresh, which costs time but changes nothing.
KEPT_LINES = 250_000
#: Least share of all messages that hold a line which counts as shared, where all of them train the model.
SHARED_LINES = 1e-4
#: Messages that a worker should have learned from; where all are fewer it reads them several times.
LEARNED = 12_500
#: Messages labelled wrong that are labelled again together.
AGAIN = 8
#: White space that lines are stripped of.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Words that open a greeting, close a letter, mark device lines and disclaimers, and begin header lines.
GREETING = r"""coucou|bonjour|salut|cher|chère|chers|chères|bonsoir|hello|hi|hey|dear|good (?:morning|afternoon|evening)|hola|querid[oa]s?|estimad[oa]s?|buen[oa]s|olá|ola|oi|boa|exm[oa]|car[oa]s?|prezad[oa]s?|bom dia|boas|hallo|guten|moin|lieber?|sehr geehrte|ciao|gentile|egregio|buongiorno|buonasera|salve|здравствуй|привет|добр|уважаем|дорог|प्रिय|नमस्ते|आदरणीय|お世話|皆様|皆さん|各位|您好|你好|大家好|亲爱的|尊敬的|مرحبا|السلام|عزيز|أهلا|تحية طيبة|สวัสดี|เรียน"""
CLOSING = r"""bien à (?:toi|vous)|bises|bisous|bien cordialement|cordialement|amicalement|à bientôt|à plus|kind regards|best regards|regards|best wishes|best|yours|see you|cheers|many thanks|thanks|saludos|un beso|besos|un abrazo|abrazos|hasta|atentamente|com os melhores|cumprimentos|beijinhos|beijos|um abraço|abraços|atenciosamente|até|bis bald|liebe grüße|viele grüße|mit freundlichen|beste grüße|herzliche|herzlichst|gruß|unha aperta|unha|saúdos|saudos|ata|cordiali|a presto|un abbraccio|distinti|с уважением|до скор|обнимаю|всего|आपका|आपकी|धन्यवाद|सादर|よろしく|敬具|またね|かしこ|祝好|再见|此致|敬礼|顺祝|مع (?:التحية|تحيات|خالص)|إلى اللقاء|تحياتي|ขอบคุณ|ด้วย|แล้วพบ"""
DEVICE = r"""phone|mobile|iphone|ipad|android|screen|typos|téléphone|portable, pardon|depuis mon|de mon t|fautes|móvil|teléfono|erratas|celular|telemóvel|telefone|gralhas|telefon gesendet|unterwegs|tippfehler|handy|meinem|telefono|cellulare|телефон|смартфон|スマ|手机"""
DISCLAIMER = r"""confiden|notice:|avis :|avis:|avis légal|aviso|hinweis|vertraulich|addressee|liab|consent|if you must|if you have received|adressé|destinat|erreur|ne peut être|responsab|n'imprimez|imprim|planète|autorización|entorno|ambiente|autorização|untersagt|empfänger|irrtümlich|umwelt|drucken|trees|destinatari|stampa|puede contener|elimine|löschen|supprim|delete it|verbreit|weitergabe"""
_FROM = r"(?:from|de|von|da|fra|van|от|от кого|发件人|差出人|寄件人|من|จาก|प्रेषक)"
_GREETING = re.compile(rf"[¡*\s]*(?:{GREETING})(?!\w)|.{{0,12}}(?:さん、こんにちは|，你好|様$|さん、)|.{{1,24}}(?:जी,)$", re.I)
_CLOSING = re.compile(rf"\W*(?:{CLOSING})", re.I)
_HEADER_FROM = re.compile(rf"\*?{_FROM}\s?:\*?\s*\S", re.I)
_KEYED = re.compile(r"\*?[^\W\d_][^:<>@]{0,14}?\s?[:：]\*?\s+\S")
_RULE = re.compile(r"(?:[-_=*~#–—]\s?){3,}$")
_BANNER = re.compile(r"-{2,}\s*[^\W\d_].*-{2,}$")
_QUOTE = re.compile(r"\s{0,2}[>|]")
_LIST = re.compile(r"(?:[-*•·–]|\d{1,2}[.)]|[a-z]\))\s+\S")
_MAIL_LINE = re.compile(r"\S+\s?(?:@|\[at\]|\(at\))\s?\S+(?:\s?(?:\[dot\]|\(dot\))\s?\S+)*", re.I)
_ABBREVIATED_END = re.compile(r"\b(?:Ltd|Inc|Co|St|S\.A|e\.V|S\.L)\.$")
_NOT_NAME = re.compile(r"[@!?:;,。、]")
_PHONE = re.compile(r"\+?\(?\d[\d\s().\-/\xa0]{6,}\d")
_PHONE_LABEL = re.compile(r"[^\W\d_][\w.\s]{0,12}?[.:]*\s*:?\s*\(?[+(]?\d[\d\s().\-/\xa0+]{6,}\d$")
WROTE_WORDS = r"""wrote|crit|escribi|escreve|schrieb|ha scritto|написал|写道|写了|書きました|のメール|كتب|เขียน|लिखा"""
_SENTENCE_END = re.compile(r"[.!?…。！？।؟]['\"»”’)\]]*\s*(?:[:;]-?[)(DP]|[\U0001F300-\U0001FAFF☀-➿]️?)?$")
_DATE = re.compile(r"\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b(?:19|20)\d{2}\b")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
#: First two letters of what may greet or close: most lines are told apart by them.
_GREETING_HEADS, _CLOSING_HEADS = (frozenset(w[:2] for w in x.split("|")) for x in (GREETING, CLOSING))


def logical_lines(message: str) -> list[tuple[int, int, list[int]]]:
    """Start and end of each logical line, with the numbers of its physical lines (split at LF).

    A line that ends in a space goes on in the next one. A signature delimiter, a blank line and a line with a quote
    prefix stand alone (a quoted line goes on only in a line that is quoted too).
    """
    out: list[tuple[int, int, list[int]]] = []
    at, open_kind = 0, ""
    for k, raw in enumerate(message.split("\n")):
        size = len(raw)
        end = at + size
        if raw[-1:] == "\r":
            raw = raw.rstrip("\r")
            size = len(raw)
        flows = raw[-1:] == " "
        if open_kind or flows:
            bare = raw.strip(" >|\t")
            kind = "q" if _QUOTE.match(raw) else "t"
            if open_kind == kind and (bare if kind == "q" else raw.strip()):
                s, _, numbers = out[-1]
                out[-1] = (s, at + size, [*numbers, k])
            else:
                out.append((at, at + size, [k]))
            open_kind = kind if flows and bare and bare != "--" else ""
        else:
            out.append((at, at + size, [k]))
        at = end + 1
    return out


_FLAGS: dict[str, int] = {}


def flags_of(t: str) -> int:
    """Flags of a stripped line by itself; kept for lines that come again."""
    got = _FLAGS.get(t)
    if got is None:
        got = _cues(t, named=False)[1]
        if len(_FLAGS) > 200_000:
            _FLAGS.clear()
        _FLAGS[t] = got
    return got


# Flags of a line, as bits.
QUOTE, RULE, BANNER, FROM, KEYED, GREET, CLOSE, LIST, PHONE, MAIL, DEV, DISC, SENT, SHORT, NAME, ATTR, DASH2, SIGN, WROTE = (1 << k for k in range(19))
_NAMED = [(FROM, "from"), (KEYED, "keyed"), (GREET, "greet"), (CLOSE, "close"), (LIST, "list"), (PHONE, "phonelabel"), (MAIL, "mail"), (SIGN, "mailonly"), (DEV, "device"), (DISC, "disclaimer"), (SENT, "sent"), (NAME, "name"), (ATTR, "attr")]
_LENGTHS = ["len:" + str(0 if n <= 3 else 1 if n <= 15 else 2 if n <= 30 else 3 if n <= 60 else 4 if n <= 120 else 5) for n in range(122)]


_N_WORDS = [f"words:{n}" for n in range(10)]


@lru_cache(4096)
def _end_of(c: str) -> str:
    return "end:" + (c if not c.isalnum() else "9" if c.isdigit() else "a")


@lru_cache(4096)
def _start_of(c: str) -> str:
    return "start:" + ("A" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c)


@lru_cache(65536)
def _names_of(flags: int) -> tuple[str, ...]:
    return tuple(name for bit, name in _NAMED if flags & bit)


def _cue_words() -> ahocorasick.Automaton:
    """The cue words of device lines, disclaimers and attributions in one automaton; a value is their flag."""
    out = ahocorasick.Automaton()
    for bit, words in ((DEV, DEVICE), (DISC, DISCLAIMER), (WROTE, WROTE_WORDS)):
        for w in words.split("|"):
            w = w.lower().replace(" ?", " ")
            out.add_word(w, out.get(w, 0) | bit)
    out.make_automaton()
    return out


_CUE_WORDS = _cue_words()


def _cues(t: str, named: bool = True) -> tuple[list[str], int]:
    """Features of a stripped line by itself, if they are to be ``named``, and its flags."""
    n, flags = len(t), 0
    if t[0] in ">|":
        return ["quote"], QUOTE
    if t == "--":
        return ["dash2"], DASH2 | RULE
    if n >= 3 and t != "..." and t[0] in "-_=*~#–—":
        if _RULE.match(t):
            return ["rule", "rule:" + t[0] + str(min(n, 40) // 8)], RULE
        if _BANNER.match(t):
            return ["banner"], BANNER | RULE
    if n > 70:
        return _long_cues(t, n)
    low = t.lower()
    words = t.split()
    digits = len(_DIGIT.findall(t)) if _DIGIT.search(t) else 0
    c = t[-1]
    colon = t.find(":") if ":" in t else t.find("：")
    if 0 < colon < 18:
        if _HEADER_FROM.match(t):
            flags |= FROM | KEYED
        elif _KEYED.match(t) and not (digits >= 6 and _PHONE_LABEL.match(t)):
            flags |= KEYED
    if (not c.isalnum() or c in "DP") and _SENTENCE_END.search(t[-14:]) and not _ABBREVIATED_END.search(t[-14:]):
        flags |= SENT
    if n <= 48 and (low[:2] in _GREETING_HEADS or t[0] in "¡*" or not t.isascii()) and _GREETING.match(t):
        flags |= GREET
    if n <= 40 and (low[:2] in _CLOSING_HEADS or not t[0].isalnum()) and _CLOSING.match(t) and not (flags & SENT and not t.endswith(("。", "！")) and len(words) > 2):
        flags |= CLOSE
    if not t[0].isalpha() or t[1:2] == ")":
        if _LIST.match(t):
            flags |= LIST
    if digits >= 6 and n <= 60 and _PHONE_LABEL.match(t):
        flags |= PHONE
    if "@" in t or "at]" in low or "(at)" in low:
        flags |= MAIL
        if n <= 60 and (len(words) == 1 or (len(words) <= 7 and _MAIL_LINE.fullmatch(t))):
            flags |= SIGN
    found = 0
    for _, bit in _CUE_WORDS.iter(low):
        found |= bit
    if found & DEV and n <= 70 and not digits:
        flags |= DEV
    if found & DISC and n >= 25:
        flags |= DISC
    flags |= SHORT
    letters = _WORD.findall(t)
    if letters and n <= 45 and len(letters) <= 6 and not digits and not flags & SENT and not _NOT_NAME.search(t):
        if all(w[0].isupper() or not w[0].islower() or len(w) <= 3 for w in letters):
            flags |= NAME
    if t[-1] in ":：" and (found & WROTE or flags & MAIL or (n > 15 and _DATE.search(t))):
        flags |= ATTR
    if not named:
        return [], flags
    out = [_LENGTHS[n], _N_WORDS[min(len(words), 9)], _end_of(c), _start_of(t[0])]
    if digits:
        out.append("digit")
        if digits >= 7 and _PHONE.search(t):
            out.append("phone")
        if digits >= 3 and "," in t:
            out.append("address")
    out += _names_of(flags)
    if letters:
        out += ["first:" + low.split(None, 1)[0].strip(".,:!¡*")[:12], "last:" + letters[-1].lower()[:12]]
    return out, flags


def _long_cues(t: str, n: int) -> tuple[list[str], int]:
    """Features of a line too long for a name, a phone number or a greeting alone."""
    flags = 0
    if -1 < t.find(":", 0, 18) or -1 < t.find("：", 0, 18):
        if _HEADER_FROM.match(t):
            flags |= FROM | KEYED
        elif _KEYED.match(t):
            flags |= KEYED
    if (not t[-1].isalnum() or t[-1] in "DP") and _SENTENCE_END.search(t[-14:]) and not _ABBREVIATED_END.search(t[-14:]):
        flags |= SENT
    if not t[0].isalpha() and _LIST.match(t):
        flags |= LIST
    if "@" in t or "at]" in t or "(at)" in t:
        flags |= MAIL
    found = 0
    for _, bit in _CUE_WORDS.iter(t.lower()):
        found |= bit
    if found & DISC:
        flags |= DISC
    if t[-1] in ":：" and (found & WROTE or flags & MAIL or _DATE.search(t)):
        flags |= ATTR
    return [_LENGTHS[min(n, 121)], _end_of(t[-1]), _start_of(t[0]), f"long:{flags & (SENT | DISC | ATTR | MAIL | KEYED)}"], flags


def line_view(message: str) -> tuple[list[tuple[int, int, list[int]]], list[str]]:
    """Logical lines and their stripped texts."""
    if " \n" in message or " \r\n" in message:
        lines = logical_lines(message)
        return lines, [message[a:b].strip() if len(k) == 1 else message[a:b].replace("\r", "").replace("\n", "").strip() for a, b, k in lines]
    # No line goes on in the next one.
    rows = message.split("\n")
    out, at = [], 0
    for k, raw in enumerate(rows):
        n = len(raw)
        out.append((at, at + (n if raw[-1:] != "\r" else len(raw.rstrip("\r"))), [k]))
        at += n + 1
    return out, [raw.strip() for raw in rows]


def line_texts(message: str) -> list[str]:
    """The stripped texts of the logical lines alone."""
    if " \n" in message or " \r\n" in message:
        return line_view(message)[1]
    return list(map(str.strip, message.split("\n")))


def draft_labels(texts: list[str], flags: list[int]) -> list[str]:
    """Labels from unmistakable signs; blank lines get ''. Used to train, and to pin what admits one reading only."""
    n = len(texts)
    lab = ["" if not t else "N" for t in texts]
    full = [i for i in range(n) if texts[i]]
    nxt = dict(zip(full, [*full[1:], -1], strict=False))
    # Header blocks: a line "from" with a second keyed line right after it; the rest of the message is forwarded text.
    body_end = n
    for i in full:
        j = nxt[i]
        if flags[i] & FROM and j == i + 1 and flags[j] & KEYED:
            k = i
            while k < n and texts[k] and flags[k] & KEYED:
                lab[k] = "H"
                k += 1
            for m in full:
                if m >= k:
                    lab[m] = "Q" if flags[m] & QUOTE else "F"
            body_end = i
            before = [m for m in full if m < i]
            while before and flags[before[-1]] & RULE and not flags[before[-1]] & DASH2:
                lab[before[-1]] = "X"
                body_end = before.pop()
            break
    full = [i for i in full if i < body_end]
    for i in full:
        if flags[i] & QUOTE:
            lab[i] = "Q"
    for i in full:
        if lab[i] == "Q":
            continue
        j = nxt[i]
        if texts[i].endswith((":", "：")) and len(texts[i]) < 260 and not flags[i] & LIST and ((flags[i] & ATTR) or (0 <= j < body_end and flags[j] & QUOTE and not flags[i] & GREET)):
            if (0 <= j < body_end and flags[j] & QUOTE) or flags[i] & ATTR:
                lab[i] = "A"
                if texts[i].startswith("<") and i - 1 >= 0 and texts[i - 1] and lab[i - 1] == "N" and len(texts[i - 1]) < 90 and not flags[i - 1] & SENT:
                    lab[i - 1] = "A"
    # Regions of the sender's own lines between quotes.
    region: list[int] = []
    for i in [*full, -1]:
        if i >= 0 and lab[i] == "N":
            region.append(i)
            continue
        if region:
            _own_lines(region, texts, flags, lab, tail=i < 0 or lab[i] != "Q" or not any(j > i and lab[j] == "N" for j in full))
        region = []
    return lab


def _own_lines(region: list[int], texts: list[str], flags: list[int], lab: list[str], tail: bool) -> None:
    first = region[0]
    if flags[first] & GREET and (len(region) > 1 or not flags[first] & SENT):
        lab[first] = "G"
    state = "body"
    for p, i in enumerate(region):
        f, t = flags[i], texts[i]
        if lab[i] == "G":
            continue
        gap = p > 0 and region[p] - region[p - 1] > 1
        if f & DASH2:
            lab[i], state = "S", "sig"
        elif f & RULE:
            rest = [j for j in region[p + 1 :]]
            lab[i] = "S" if rest and flags[rest[0]] & SHORT and not flags[rest[0]] & (SENT | DISC) and t[0] == "_" else "D" if rest else "X"
            state = "sig" if lab[i] == "S" else "disc"
        elif state == "sig":
            if f & DISC and (f & SENT or len(t) > 45):
                lab[i], state = "D", "disc"
            elif gap and f & (SENT | GREET) and not f & (DEV | SIGN | PHONE) and len(t) > 60:
                lab[i] = "N"
                state = "body"
            else:
                lab[i] = "S"
        elif state == "disc":
            lab[i] = "D"
        elif f & LIST:
            lab[i] = "L"
        elif f & CLOSE and p > 0 or (f & CLOSE and len(region) <= 3):
            lab[i], state = "C", "closed"
        elif state == "closed":
            if region[p - 1] == i - 1 and lab[region[p - 1]] == "C" and f & SHORT and not f & (SENT | DISC | PHONE | SIGN | DEV) and len(t) <= 45:
                lab[i] = "M"
            elif f & DISC and not f & DEV:
                lab[i], state = "D", "disc"
            elif f & SENT and not f & DEV and len(t) > 60:
                lab[i], state = "N", "body"
            else:
                lab[i], state = "S", "sig"
        elif f & DISC and f & SENT and gap and not any(lab[j] == "N" and flags[j] & DISC for j in region[:p]) and tail and all(flags[j] & (DISC | RULE) for j in region[p:]):
            lab[i], state = "D", "disc"
        elif f & DEV and gap and not f & SENT and p > 0:
            lab[i], state = "S", "sig"
    if any(lab[j] in "CS" for j in region) or not tail:
        return
    # A block of short lines at the end, without closing: a signature if it shows one of its marks.
    block = []
    for j in reversed(region):
        if lab[j] in "DX":
            continue
        if lab[j] != "N" or not flags[j] & SHORT or flags[j] & (SENT | LIST | GREET):
            break
        block.append(j)
    marks = sum(bool(flags[j] & (PHONE | SIGN)) for j in block)
    if block and (marks or (len(block) >= 3 and sum(bool(flags[j] & NAME) for j in block) >= 2)):
        for j in block:
            lab[j] = "S"


KINDS = "q-brfwpmgcldvksnho"
_START, _END = len(KINDS), len(KINDS) + 1
_RADIX = (len(KINDS) + 2, len(KINDS), len(KINDS) + 2, len(KINDS) + 2, 2, 3, 2, 2, 2, 2)


def contexts(flags: np.ndarray, kinds: np.ndarray, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A code for what surrounds each non-blank line: neighbours' kinds, gap, place and history; see `context_of`.

    ``flags``, ``kinds`` and ``numbers`` (of the line in its message) are those of the non-blank lines of all messages,
    one after the other; ``first`` tells which are the first of their message.
    """
    n = len(flags)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(first, at, 0))
    last = np.append(first[1:], True)
    ahead = np.append(first[2:], [True, True])[:n] | last
    up, down, down2 = (np.roll(kinds, k) for k in (1, -1, -2))
    near = np.append(numbers[1:] == numbers[:-1] + 1, False) & ~last
    apart = ~first & (numbers != np.roll(numbers, 1) + 1)

    def latest(hit: np.ndarray) -> np.ndarray:
        """The last line up to each, in any message, where ``hit`` holds."""
        return np.maximum.accumulate(np.where(hit, at, -1))

    header = latest((flags & FROM != 0) & near & (np.roll(flags, -1) & KEYED != 0)) >= begin
    dash = kinds == KINDS.index("-")
    reset = ~dash & ((kinds == KINDS.index("q")) | (flags & ATTR != 0))
    close = ~dash & ~reset & (flags & CLOSE != 0)
    rule = ~dash & ~reset & ~close & (flags & RULE != 0)
    since = np.maximum(np.append(-1, latest(reset)[:-1]), begin - 1)
    after = [np.append(-1, latest(hit)[:-1]) > since for hit in (dash, close, rule)]
    quote = np.where(kinds == KINDS.index("q"), at, -1)
    starts = np.flatnonzero(first)
    below = np.repeat(np.maximum.reduceat(quote, starts), np.diff(np.append(starts, n))) > at if n else quote > at
    digits = (np.where(first, _START, up), kinds, np.where(last, _END, down), np.where(ahead, _END, down2), apart, header * np.where(flags & KEYED, 2, 1), *after, below)
    code = np.zeros(n, np.int64)
    for size, digit in zip(_RADIX, digits, strict=True):
        code = code * size + digit
    return code


def context_of(code: int) -> tuple:
    """What a code says: kinds of the line before, the line itself and the two after it; gap, header, dash, closed, ruled, quote below."""
    out = []
    for size in reversed(_RADIX):
        code, digit = divmod(code, size)
        out.append(digit)
    out.reverse()
    return (*((KINDS + "^$")[x] for x in out[:4]), *out[4:])


def context_features(c: tuple) -> list[str]:
    before, k, after, after2, gap, header, dash, closed, ruled, quote_below = c
    x = ["b:" + before, "a:" + after, "aa:" + after + after2, "ba:" + before + k + after, "k:" + k]
    if gap:
        x += ["gap", "gap:" + k]
    if before == "^":
        x.append("top")
    if after == "$":
        x.append("bottom")
    if header:
        x.append("inheader" if header == 2 else "afterheader")
    if dash:
        x.append("afterdash:" + k)
    if closed:
        x += ["afterclose:" + k, "afterclose:" + k + ("g" if gap else "")]
    if ruled:
        x.append("afterrule:" + k)
    if quote_below:
        x.append("quotebelow")
    return x


def _kind(f: int) -> int:
    for k, bit in enumerate((QUOTE, DASH2, BANNER, RULE, FROM, ATTR, PHONE, SIGN, GREET, CLOSE, LIST, DISC, DEV, KEYED, SENT, NAME, SHORT)):
        if f & bit:
            return k
    return len(KINDS) - 1


def _line_arrays(views: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines of all messages: place among all lines, number in the message, whether it is the first there."""
    lengths = np.array([len(v) for v in views], np.int64)
    solid = np.flatnonzero(np.array([t != "" for v in views for t in v], bool))
    begins = np.repeat(np.cumsum(lengths) - lengths, lengths)[solid]
    first = np.ones(len(solid), bool)
    first[1:] = begins[1:] != begins[:-1]
    return solid, solid - begins, first


class LineModel:
    """Linear-chain model: feature weights for each label, weights for each pair of labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray, seen: frozenset[str]):
        self.index, self.emit, self.move, self.start, self.seen = index, emit, move, start, seen
        self._forget()

    def _forget(self) -> None:
        k = len(LABELS)
        self.own: dict[str, int] = {}
        self.own_score, self.own_flags = np.zeros((4096, k)), np.zeros(4096, np.int64)
        self.around: dict[int, int] = {}
        self.around_score = np.zeros((256, k))

    def __reduce__(self):  # noqa: ANN204 - what a worker has met is not sent along
        return LineModel, (self.index, self.emit, self.move, self.start, self.seen)

    def _sums(self, rows: list[list[int]]) -> np.ndarray:
        """Summed weights of each row of features."""
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.add.reduceat(self.emit[np.fromiter(chain.from_iterable(rows), np.int64)], np.cumsum(sizes) - sizes, axis=0)

    def _lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by their own features, and flags, of non-blank lines; kept for lines that come again."""
        own, get = self.own, self.index.get
        if len(own) > KEPT_LINES:
            self._forget()
            own = self.own
        ids, rows, flags = [], [], []
        for t in texts:
            k = own.get(t)
            if k is None:
                names, f = _cues(t)
                row = [j for j in map(get, names) if j is not None]
                if t in self.seen:
                    row.append(0)
                rows.append(row or [1]), flags.append(f)
                k = own[t] = len(own)
            ids.append(k)
        if rows:
            while len(self.own_flags) < len(own):
                self.own_score, self.own_flags = np.concatenate([self.own_score, np.zeros_like(self.own_score)]), np.concatenate([self.own_flags, np.zeros_like(self.own_flags)])
            self.own_score[len(own) - len(rows) : len(own)] = self._sums(rows)
            self.own_flags[len(own) - len(rows) : len(own)] = flags
        at = np.array(ids, np.int64)
        return self.own_score[at], self.own_flags[at]

    def _surroundings(self, codes: np.ndarray) -> np.ndarray:
        """Scores by the contexts' features."""
        kinds, which = np.unique(codes, return_inverse=True)
        new = [c for c in kinds.tolist() if c not in self.around]
        if new:
            rows = [[k for k in map(self.index.get, context_features(context_of(c))) if k is not None] or [1] for c in new]
            n = len(self.around)
            self.around.update((c, n + k) for k, c in enumerate(new))
            self.around_score = np.concatenate([self.around_score[:n], self._sums(rows)])
        return self.around_score[np.array([self.around[c] for c in kinds.tolist()], np.int64)][which]

    def label_many(self, views: list[list[str]], pinned: bool = False) -> tuple[list[str], list[list[int]]]:
        """A letter for each logical line of each message ('-' for blank ones), and the lines' flags.

        All messages are decoded together. With ``pinned``, a line whose sign admits one reading keeps it; see `pin`.
        """
        solid, numbers, first = _line_arrays(views)
        total = sum(map(len, views))
        letters, all_flags = np.full(total, ord("-"), np.uint8), np.zeros(total, np.int64)
        if len(solid):
            score, flags = self._lines([t for v in views for t in v if t])
            kinds = _kinds(flags)
            score += self._surroundings(contexts(flags, kinds, numbers, first))
            tags = self._decode(score, np.flatnonzero(first))
            if pinned:
                pin(flags, numbers, first, tags)
            letters[solid], all_flags[solid] = np.frombuffer(LABELS.encode(), np.uint8)[tags], flags
        joined, every = letters.tobytes().decode(), all_flags.tolist()
        out, of, at = [], [], 0
        for v in views:
            out.append(joined[at : at + len(v)]), of.append(every[at : at + len(v)])
            at += len(v)
        return out, of

    def _decode(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of each sequence (Viterbi); sequences begin at ``first``."""
        lengths = np.diff(np.append(first, len(score)))
        order = np.argsort(-lengths, kind="stable")
        sizes = -lengths[order]
        best = np.zeros((len(first), len(LABELS)))
        back = []
        for step in range(int(lengths.max())):
            live = order[: int(np.searchsorted(sizes, -step, side="left"))]
            now = score[first[live] + step]
            if step == 0:
                best[live] = self.start + now
                continue
            paths = best[live][:, :, None] + self.move[None]
            arg = paths.argmax(1)
            best[live] = paths.max(1) + now
            back.append((live, arg))
        tags = np.zeros(len(score), np.int64)
        current = best.argmax(1)
        for step in range(int(lengths.max()) - 1, -1, -1):
            live = order[: int(np.searchsorted(sizes, -step, side="left"))]
            tags[first[live] + step] = current[live]
            if step:
                rows, arg = back[step - 1]
                current[rows] = arg[np.arange(len(rows)), current[rows]]
        return tags


def _kinds(flags: np.ndarray) -> np.ndarray:
    values, which = np.unique(flags, return_inverse=True)
    return np.array([_kind(f) for f in values.tolist()], np.int64)[which]


def pin(flags: np.ndarray, numbers: np.ndarray, first: np.ndarray, tags: np.ndarray) -> None:
    """Keep the labels of signs that admit one reading: quote prefixes, header blocks and all that follows them."""
    quoted = flags & QUOTE != 0
    long = np.isin(tags, [_ID[c] for c in "SMD"]) & (flags & SENT != 0) & (flags & (SHORT | DISC) == 0)
    tags[(tags == _ID["Q"]) | long] = _ID["N"]
    tags[quoted] = _ID["Q"]
    follows = np.append(~first[1:] & (numbers[1:] == numbers[:-1] + 1), False)
    heads = np.flatnonzero((flags & FROM != 0) & follows & (np.roll(flags, -1) & KEYED != 0))
    if not len(heads):
        return
    starts = np.flatnonzero(first)
    message = np.searchsorted(starts, heads, side="right") - 1
    ends = np.append(starts[1:], len(tags))
    for p, m in zip(*(x.tolist() for x in (heads[np.unique(message, return_index=True)[1]], np.unique(message))), strict=True):
        end, k = int(ends[m]), p
        while k < end and flags[k] & KEYED and (k == p or follows[k - 1]):
            tags[k] = _ID["H"]
            k += 1
        rest = tags[k:end]
        rest[rest != _ID["Q"]] = _ID["F"]


def train_line_model(messages: list[str], epochs: int = 5) -> LineModel:
    """Averaged perceptron on the draft labels. Lines of 25 characters or more that several messages share are a cue."""
    views = [line_view(m)[1] for m in messages]
    shared = Counter(t for v in views for t in set(v) if len(t) >= 25 and not any(c.isdigit() for c in t) and not _QUOTE.match(t))
    drafts, data, counts = [], [], Counter()
    for v in views:
        basic = [_cues(t) if t else ([], 0) for t in v]
        lab = draft_labels(v, [f for _, f in basic])
        full, numbers, first = _line_arrays([v])
        flags = np.array([f for _, f in basic], np.int64)[full]
        feats = [basic[i][0] + context_features(context_of(c)) for i, c in zip(full.tolist(), contexts(flags, _kinds(flags), numbers, first).tolist(), strict=True)]
        if len(full):
            drafts.append([_ID[lab[i]] for i in full.tolist()])
            data.append((feats, [v[i] for i in full.tolist()]))
            for x in feats:
                counts.update(x)
    # A shared line is a cue only where drafts found it mostly outside new text.
    where: dict[str, list[int]] = {}
    for gold, (_, texts) in zip(drafts, data, strict=True):
        for y, t in zip(gold, texts, strict=True):
            if shared.get(t, 0) >= 3:
                where.setdefault(t, []).append(y)
    seen = frozenset(t for t, ys in where.items() if sum(y in (_ID["D"], _ID["S"]) for y in ys) * 2 > len(ys))
    index = {f: k + 2 for k, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    rows = [[np.array([index[f] for f in x if f in index] + ([0] if t in seen else []) or [1]) for x, t in zip(feats, texts, strict=True)] for feats, texts in data]
    k = len(LABELS)
    emit, move, start = np.zeros((len(index) + 2, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.zeros_like(a) for a in (emit, move, start)]
    t = 1
    for epoch in range(epochs):
        for m in np.random.RandomState(epoch).permutation(len(rows)):
            feats, gold = rows[m], drafts[m]
            score = np.stack([emit[f].sum(0) for f in feats])
            best, back = start + score[0], []
            for s in score[1:]:
                paths = best[:, None] + move
                arg = paths.argmax(0)
                best = paths[arg, np.arange(k)] + s
                back.append(arg)
            tags = [int(best.argmax())]
            for arg in reversed(back):
                tags.append(int(arg[tags[-1]]))
            tags.reverse()
            if tags != gold:
                for f, y, z in zip(feats, gold, tags, strict=True):
                    if y != z:
                        np.add.at(emit, (f, y), 1), np.add.at(emit, (f, z), -1)
                        np.add.at(sums[0], (f, y), t), np.add.at(sums[0], (f, z), -t)
                for seq, sign in ((gold, 1), (tags, -1)):
                    start[seq[0]] += sign
                    sums[2][seq[0]] += sign * t
                    for a, b in zip(seq, seq[1:], strict=False):
                        move[a, b] += sign
                        sums[1][a, b] += sign * t
            t += 1
    return LineModel(index, *(a - s / t for a, s in zip((emit, move, start), sums, strict=True)), seen)


def may_be_shared(text: str) -> bool:
    """Whether a line can be a cue because several messages hold it."""
    return len(text) >= 25 and not any(c.isdigit() for c in text) and not _QUOTE.match(text)


class LineLearner:
    """The perceptron of `train_line_model` on the messages of one worker, as many as there are.

    A chunk of messages is labelled at once; those labelled wrong are labelled again and learned from, a few at a time.
    Chunks grow as errors get rare. ``shared`` has the checksums of the lines that several messages hold.
    """

    def __init__(self, shared: frozenset[int]):
        self.shared, self.number, self.messages, self.size = shared, Counter(), 0, 32
        self.drafted: dict[str, list[int]] = {}
        self.index: dict[str, int] = {"": 0, "-": 1}  # the cue of shared lines, and nothing known
        k = len(LABELS)
        self.weights = [np.zeros((4096, k)), np.zeros((k, k)), np.zeros(k)]
        self.sums = [np.zeros_like(a) for a in self.weights]
        self.own: dict[str, tuple[list[int], int]] = {}
        self.around: dict[int, list[int]] = {}
        self.rng = np.random.RandomState(0)

    def _ids(self, names: list[str]) -> list[int]:
        index = self.index
        ids = list(map(index.get, names))
        if None not in ids:
            return ids
        ids = [index.setdefault(f, len(index)) for f in names]
        if len(index) > len(self.weights[0]):
            for group in (self.weights, self.sums):
                group[0] = np.concatenate([group[0], np.zeros_like(group[0])])
        return ids

    def _cues(self, t: str) -> tuple[list[int], int]:
        got = self.own.get(t)
        if got is None:
            if len(self.own) > KEPT_LINES:
                self.own.clear()
            names, flags = _cues(t)
            got = self.own[t] = self._ids(names), flags
        return got

    def _context(self, code: int) -> list[int]:
        got = self.around.get(code)
        if got is None:
            got = self.around[code] = self._ids(context_features(context_of(code)))
        return got

    def learn(self, messages: list[str], epochs: int = 1) -> None:
        views = [line_texts(m) for m in messages]
        for epoch in range(epochs):
            order, at = self.rng.permutation(len(views)).tolist(), 0
            while at < len(order):
                self._chunk([views[i] for i in order[at : at + self.size]], epoch == 0)
                at += self.size
                self.size = self.grown

    def _chunk(self, views: list[list[str]], new: bool) -> None:
        basic = [[self._cues(t) if t else ([], 0) for t in v] for v in views]
        drafts = [draft_labels(v, [f for _, f in b]) for v, b in zip(views, basic, strict=True)]
        solid, numbers, first = _line_arrays(views)
        self.messages += len(views)
        self.grown = self.size
        if not len(solid):
            return
        texts = [t for v in views for t in v if t]
        own = [x for v, b in zip(views, basic, strict=True) for t, x in zip(v, b, strict=True) if t]
        gold = np.array([_ID[c] for d in drafts for c in d if c], np.int64)
        flags = np.array([f for _, f in own], np.int64)
        codes = contexts(flags, _kinds(flags), numbers, first).tolist()
        rows = [ids + self._context(c) for (ids, _), c in zip(own, codes, strict=True)]
        for k, t in enumerate(texts):
            if len(t) >= 25 and zlib.crc32(t.encode("utf-8", "replace")) in self.shared:
                seen = self.drafted.setdefault(t, [0, 0])
                if new:
                    seen[0] += int(gold[k] in (_ID["D"], _ID["S"]))
                    seen[1] += 1
                if seen[0] * 2 > seen[1]:
                    rows[k] = [*rows[k], 0]
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(gold))
        tags = self._tags(rows, heads)
        wrong = np.flatnonzero(np.add.reduceat(tags != gold, heads))
        for at in range(0, len(wrong), AGAIN):
            some = wrong[at : at + AGAIN].tolist()
            parts = [(int(heads[m]), int(ends[m])) for m in some]
            tags = self._tags([r for a, b in parts for r in rows[a:b]], np.cumsum([0, *(b - a for a, b in parts[:-1])]))
            done = 0
            for m, (a, b) in zip(some, parts, strict=True):
                self._correct(rows[a:b], gold[a:b], tags[done : done + b - a], self.messages - len(views) + m)
                done += b - a
        if len(wrong) * 10 < len(heads):
            self.grown = min(2 * self.size, 1024)

    def _correct(self, rows: list[list[int]], gold: np.ndarray, found: np.ndarray, t: int) -> None:
        bad = np.flatnonzero(gold != found).tolist()
        if bad:
            right, tags = gold.tolist(), found.tolist()
            sizes = [len(rows[i]) for i in bad]
            ids, y, z = np.fromiter(chain.from_iterable(rows[i] for i in bad), np.int64), np.repeat(gold[bad], sizes), np.repeat(found[bad], sizes)
            for group, by in ((self.weights, 1), (self.sums, t)):
                np.add.at(group[0], (ids, y), by), np.add.at(group[0], (ids, z), -by)
            for seq, sign in ((right, 1), (tags, -1)):
                for group, by in ((self.weights, sign), (self.sums, sign * t)):
                    group[2][seq[0]] += by
                    if len(seq) > 1:
                        np.add.at(group[1], (seq[:-1], seq[1:]), by)

    def _tags(self, rows: list[list[int]], heads: np.ndarray) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], np.int64)
        score = np.add.reduceat(self.weights[0][np.fromiter(chain.from_iterable(rows), np.int64)], np.cumsum(sizes) - sizes, axis=0)
        return LineModel({}, *self.weights, frozenset())._decode(score, heads)

    def rows(self) -> Iterator[tuple]:
        """Kind, name, number of messages and a number for each label: averaged weights by that number, and counts of shared lines."""
        n, k = self.messages, len(LABELS)
        emit, move, start = (w * n - s for w, s in zip(self.weights, self.sums, strict=True))
        names = list(self.index)
        for i in np.flatnonzero(emit[: len(names)].any(1)).tolist():
            yield ("emit", names[i], n, *emit[i].tolist())
        for i in range(k):
            yield ("move", LABELS[i], n, *move[i].tolist())
        yield ("start", "", n, *start.tolist())
        for t, (out, every) in self.drafted.items():
            yield ("line", t, n, float(out), float(every), *[0.0] * (k - 2))


def fit_line_model(samples: DataFrame, total: int) -> LineModel:
    """The model of all ``total`` messages that are not empty: each worker learns from all of its own; a weight is the
    mean, by the number of messages, over the workers that found cause to change it, so that what only some workers meet counts in full.

    Features are those that any error ever touched, so what comes to the driver grows with errors, not with messages.
    """
    rows = samples.select("message").filter(F.length("message") > 0)
    flowed = F.when(F.col("message").contains(" \n") | F.col("message").contains(" \r\n"), F.regexp_replace("message", r"(?<!--) \r?\n(?=[ \t]*[^\s>|])", " ")).otherwise(F.col("message"))
    lines = F.array_distinct(F.transform(F.filter(F.split(flowed, "\n"), lambda x: (F.length(x) >= 25) & ~x.rlike(r"\d")), lambda x: F.btrim(x, F.lit(_BLANKS))))
    least = max(3, int(total * SHARED_LINES))
    counted = rows.select(F.explode(lines).alias("line")).filter((F.length("line") >= 25) & ~F.col("line").startswith(">") & ~F.col("line").startswith("|")).groupBy(F.crc32(F.encode("line", "UTF-8")).alias("line")).count()
    shared = samples.sparkSession.sparkContext.broadcast(frozenset(r.line for r in counted.filter(F.col("count") >= least).collect()))  # at most lines a message / SHARED_LINES
    epochs = max(1, min(5, -(-LEARNED // max(1, total))))
    names = [f"w{i}" for i in range(len(LABELS))]

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = LineLearner(shared.value)
        for batch in batches:
            learner.learn(batch.column("message").to_pylist(), epochs)
        if learner.messages:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*learner.rows(), strict=True)], names=["kind", "name", "n", *names])

    found = rows.mapInArrow(run, ", ".join(["kind string", "name string", "n bigint", *(f"{w} double" for w in names)]))
    summed = found.groupBy("kind", "name").agg(*(F.sum(w).alias(w) for w in ["n", *names])).filter((F.col("kind") != "line") | ((F.col("w1") >= least) & (F.col("w0") * 2 > F.col("w1"))))
    return _mixed([(r[0], r[1], r[2], r[3:]) for r in summed.orderBy("kind", "name").collect()])


def _mixed(rows: list[tuple[str, str, int, tuple]]) -> LineModel:
    """The model that summed rows of `LineLearner.rows` give."""
    k = len(LABELS)
    emit = {name: np.array(x) / n for kind, name, n, x in rows if kind == "emit"}
    cue, none = emit.pop("", np.zeros(k)), emit.pop("-", np.zeros(k))
    move, start = np.zeros((k, k)), np.zeros(k)
    for kind, name, n, x in rows:
        if kind == "move":
            move[_ID[name]] = np.array(x) / n
        elif kind == "start":
            start[:] = np.array(x) / n
    seen = frozenset(name for kind, name, _, _ in rows if kind == "line" and may_be_shared(name))
    return LineModel({f: i + 2 for i, f in enumerate(emit)}, np.array([cue, none, *emit.values()]), move, start, seen)


def sampled(rows: DataFrame, n: int = TRAIN_MESSAGES) -> list:
    """At most ``n`` rows, those with the lowest hash of ``row_id``; the same ones at every run.

    Only rows in the lowest part of the hash's range are sorted, about twice as many as wanted, so that no task sends
    more than a few rows to the driver whatever the table's size.
    """
    total = rows.count()
    part = F.shiftrightunsigned(F.xxhash64("row_id"), 2)  # 0 .. 2**62
    if total > 4 * n:
        rows = rows.filter(part < int(2**62 * min(1.0, 2.0 * n / total)))
    return rows.orderBy(part, "row_id").limit(n).collect()


def sample_messages(samples: DataFrame, n: int = TRAIN_MESSAGES) -> list[str]:
    """At most ``n`` messages to train from."""
    return [r.message for r in sampled(samples.select("row_id", "message").filter(F.length("message") > 0), n)]
