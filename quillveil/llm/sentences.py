"""Sentence units of every message, by a hidden-event n-gram language model.

Between two words of running text a boundary token may be hidden. The model holds, over the whole corpus: how often a
boundary follows a word (with its punctuation), how often a word comes first after a boundary, and how often a word
follows another without one; rare words fall back to classes of their form. Certain events come from line breaks: a line
of running text begins and ends a unit. Hidden ones are filled in by expectation maximisation over the counted pairs.
Decoding is a forward-backward pass over the places of a line where a boundary may be, whose two states are "a boundary
lies before this word" and "none does"; a place is a boundary if its posterior passes one half. In scripts that end
sentences by no mark every space is such a place. In a line without any sentence mark every gap between words is one, in
East Asian text every gap between characters; there the prior comes from the line's length: a line that is longer than
sentences are is text written without marks, whose sentences are as long as others.

Lines that are one unit each (header, attribution, greeting, list, name, signature) are told by the line model of
`anatomy`. No boundary lies inside a quotation that is closed on its line.

Counting covers every message; only words and pairs above a share of the corpus are kept by themselves, which bounds the
tables by definition; all others count in their classes. Defined results: null, empty and blank messages, and lines
without letter or digit, have no unit. Offsets count code points. Messages of any length are processed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.anatomy import ATTR, CLOSE, DISC, FROM, GREET, KEYED, LIST, NAME, PHONE, SENT, LineModel, flags_of
from quillveil.llm.batches import uncollected
from quillveil.llm.replies import fitted, labelled
from quillveil.runtime import written

#: Least share of its kind that a word or a pair needs to be kept by itself.
WORD_SHARE, PAIR_SHARE = 2e-5, 1e-6
EM_STEPS = 6
#: Share of lines taken to be written without sentence marks before their length is known.
UNMARKED = 0.02
#: Lengths of sentences, in words or East Asian characters, that are told apart.
LONGEST = 400

_EMOJI = "[\U0001F300-\U0001FAFF☀-➿]️?"
_SMILEY = r"[:;]'?-?[)(DPp](?!\w)"
_CLOSERS = "[\"'»”’)\\]」』》】›“*]"
_MARKS = ".!?…。！？।؟"
_FACES = rf"(?:{_EMOJI}|{_SMILEY})"
_AFTER_MARK = rf"(?:[\s\xa0]?»|{_CLOSERS})*(?:[\s\xa0]*{_FACES})*"
_PLACE = re.compile(rf"[{_MARKS}][{_MARKS}]*+(?![a-z0-9@]){_AFTER_MARK}")
#: The same, and emoji or smileys without a mark before them.
_FACED_PLACE = re.compile(rf"(?:[{_MARKS}]++(?![a-z0-9@]){_AFTER_MARK}|(?:{_EMOJI}|(?<=\s){_SMILEY})+(?:\s*{_FACES})*)")
_FACE = re.compile("[:;\U0001F300-\U0001FAFF☀-➿](?:(?<![:;])|'?-?[)(DPp])")
_QUOTED = re.compile("«[^»]*»|„[^“”]*[“”]|“[^”]*”|「[^」]*」|『[^』]*』|‹[^›]*›|(?<!\\w)\"[^\"]*\"(?!\\w)|《[^》]*》")
_QUOTE_MARK = re.compile("[«„“「『‹\"《]")
_THAI = re.compile("[฀-๿຀-໿ក-៿က-႟]")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_OPEN = "\"'«“„¿¡([「『‹《*"
_SOLID = re.compile(r"[^\W_]")
_PREFIX = re.compile(r"[\s>|]*")
_INNER_PREFIX = re.compile(r"\n[ \t]*[>|][>| \t]*")
_GAP = re.compile(r"\s+")
_NEXT = re.compile(r"\S+")
_TAIL_MARKS = re.compile(rf"(?:[\s\xa0]*(?:{_EMOJI}|{_SMILEY}))+$")
_DIGIT = re.compile(r"\d")
_CJK_END = "。！？"
_CJK_PAIR = re.compile("[぀-ヿ㐀-鿿](?=[぀-ヿ㐀-鿿])")
_CJK_HEAD = re.compile("[぀-ヿ㐀-鿿]{1,2}")
_ANY_MARK = re.compile(f"[{_MARKS}]")
_WORDS: dict[str, tuple[str, str]] = {}


def left_form(raw: str) -> tuple[str, str]:
    """Form and class of the word before a place."""
    got = _WORDS.get(raw)
    if got is None:
        core = _TAIL_MARKS.sub("", raw.strip().lstrip(_OPEN))
        stem = core.rstrip(".!?…。！？।؟\"'»”’)]」』》】›“* \xa0")
        tail = core[len(stem) :]
        end = next((c for c in tail if c in ".!?…。！？।؟"), "E" if len(core) < len(raw.strip().lstrip(_OPEN)) else "")
        if end == "." and tail.count(".") > 1:
            end = "…"
        if _THAI.search(stem[-1:] or ""):
            form = stem[-3:] + end
        elif _CJK.search(stem[-1:] or ""):
            form = stem[-2:] + end
        else:
            form = _DIGIT.sub("9", stem.lower()) + end
        n = len(stem)
        kind = "9" if any(map(str.isdigit, stem)) else "t" if _THAI.search(stem) else "c" if _CJK.search(stem) else "U" if stem[:1].isupper() else "l" if stem[:1].isalpha() else "-"
        got = form, f"{end}|{min(n, 4)}|{kind}|{'.' if '.' in stem else ''}|{'q' if any(c in '»”’」』›“' for c in tail) else ''}"
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        _WORDS[raw] = got
    return got


def right_form(raw: str) -> tuple[str, str]:
    """Form and case class of the word after a place."""
    key = "\0" + raw
    got = _WORDS.get(key)
    if got is None:
        core = raw.lstrip(_OPEN)
        if _THAI.search(core[:1]):
            form = core[:4]
        elif _CJK.search(core[:1]):
            form = _CJK_HEAD.match(core)[0]
        else:
            form = _DIGIT.sub("9", core.rstrip(".,;:!?…»”\"').").lower())
        opened = "q" if raw[:1] in _OPEN and raw else ""
        case = "9" if core[:1].isdigit() else "U" if core[:1].isupper() else "l" if core[:1].islower() else "o" if core[:1].isalpha() else "-"
        got = form, opened + case
        _WORDS[key] = got
    return got


def places(text: str) -> list[tuple[int, int, str, str, bool]]:
    """Places of a line where a boundary may be: end of the left part, start of the right part, both words, and whether
    the left word comes right after the place before."""
    out: list[tuple[int, int, str, str, bool]] = []
    n = len(text)
    hits = []
    for m in (_PLACE if _FACE.search(text) is None else _FACED_PLACE).finditer(text):
        a, b = m.span()
        if b >= n:
            break
        c = text[b]
        if c.isspace():
            nxt = b + 1
            if nxt < n and not text[nxt].isspace():
                hits.append((a, b, nxt))
            elif (nxt := _GAP.match(text, b).end()) < n:
                hits.append((a, b, nxt))
        elif any(x in _CJK_END for x in m[0]):
            if c not in "，、；：,":
                hits.append((a, b, b))
        elif m[0][0] in "!?…" and c.isupper():
            hits.append((a, b, b))
        elif m[0] == "." and c.isupper() and text[a - 3 : a].isalpha() and text[a - 3 : a].islower() and text[b + 1 : b + 2].islower():
            left, right = text.rfind(" ", 0, a) + 1, text.find(" ", b)
            token = text[left : right if right > 0 else n]
            if "@" not in token and "/" not in token and "." not in token[b - left :].rstrip("."):
                hits.append((a, b, b))
    plain = text.isascii()
    if not plain and _THAI.search(text):
        taken = {h[1] for h in hits}
        hits += [(g.start(), g.start(), g.end()) for g in _GAP.finditer(text) if g.start() > 0 and g.end() < n and g.start() not in taken]
        hits.sort()
    if not hits:
        return gaps(text) if _ANY_MARK.search(text) is None else out
    spans = [m.span() for m in _QUOTED.finditer(text)] if _QUOTE_MARK.search(text) else ()
    broken, fixed = "\n" in text, "\xa0" in text
    odd = broken or fixed or "\t" in text or not plain
    last_start = 0
    for a, b, nxt in hits:
        if spans and any(s < b < e for s, e in spans):
            continue
        stop = a
        while stop > last_start and text[stop - 1] in " \xa0":  # a mark set off by a space
            stop -= 1
        left = text.rfind(" ", last_start, stop) + 1
        if broken:
            left = max(left, text.rfind("\n", last_start, stop) + 1)
        if fixed:
            left = max(left, text.rfind("\xa0", last_start, stop) + 1)
        if left < last_start:
            left = last_start
        u = text[left:b]
        if odd:
            v = _NEXT.match(text, nxt)[0]
        else:
            end = text.find(" ", nxt)
            v = text[nxt:end] if end > 0 else text[nxt:]
        out.append((b, nxt, u if len(u) <= 24 else _left_word(u), v if len(v) <= 12 else _right_word(v), left <= last_start))
        last_start = nxt
    return out


def gaps(text: str) -> list[tuple[int, int, str, str, bool]]:
    """The places of a line without sentence marks: between any two words, or East Asian characters."""
    if not text.isascii() and _CJK.search(text):
        at = [m.start() + 1 for m in _CJK_PAIR.finditer(text)]
        return [(i, i, text[max(0, i - 4) : i], text[i : i + 4], i - 1 in (0, before)) for i, before in zip(at, [0, *at], strict=False)]
    words = [(m.start(), m.end(), m[0]) for m in _NEXT.finditer(text)]
    return [(b, c, u, v, True) for (_, b, u), (c, _, v) in zip(words, words[1:], strict=False)]


def _left_word(word: str) -> str:
    """In scripts without spaces the last characters stand for the word before a place."""
    return word if word.isascii() or not (_CJK.search(word) or _THAI.search(word)) else word[-24:]


def _right_word(word: str) -> str:
    """In scripts without spaces the first characters stand for the word after a place."""
    if word.isascii():
        return word
    core = word.lstrip(_OPEN)
    return word[: len(word) - len(core) + 8] if _CJK.match(core) or _THAI.match(core) else word


def running_parts(message: str, lines: list[tuple[int, int, list[int]]], labels: str, flags: list[int]) -> Iterator[tuple[int, str, bool, str]]:
    """Offset, text, whether it may be split, and label, of each line that has a letter or digit. Quote marks are cut off or blanked."""
    for (a, b, physical), label, own in zip(lines, labels, flags, strict=True):
        if label == "-":
            continue
        text = message[a:b]
        quoted = label in "QF" or text[0] in ">|"
        if quoted:
            skip = _PREFIX.match(text).end()
            if len(physical) > 1:
                text = _INNER_PREFIX.sub(lambda m: "\n" + " " * (len(m[0]) - 1), text)
        else:
            skip = 0 if not text[0].isspace() else len(text) - len(text.lstrip())
        text = text[skip:].rstrip()
        if not text[:1].isalnum() and not _SOLID.search(text):
            continue
        if label in "NDQF":
            single = False
            if len(text) > 48 and text[-1] in ".!?…。！？।" and text[0].isalpha():
                pass  # of the lines that are one unit none looks so
            else:
                f = flags_of(text) if quoted else own
                single = bool(f & (LIST | FROM | ATTR | PHONE)) or bool(f & (GREET | CLOSE | NAME) and not f & DISC) or bool(f & KEYED and not f & (SENT | DISC))
                if label in "ND":
                    single = single and not f & (FROM | ATTR)
        else:
            single = not (label == "S" and len(text) > 45 and own & DISC and own & SENT)
        yield a + skip, text, not single, label


def _coded(words: list[str] | pa.Array) -> tuple[np.ndarray, list[str]]:
    """Words as numbers of the distinct ones."""
    found = (words if isinstance(words, pa.Array) else pa.array(words, pa.string())).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


class EventModel:
    """Log odds of a boundary; see the module's docstring.

    ``left`` has by form of the word before a place its prior, and how often and with how many kinds of words it goes on;
    ``right`` by form of the word after it how often it begins, goes on and goes on for sure; ``pairs`` the sorted keys
    ``left number * len(right) + right number`` and how often the two follow each other without a boundary; ``lengths``
    the numbers of sentences by their length in words (``w``) and East Asian characters (``c``).
    """

    def __init__(self, left: dict[str, tuple[float, float, float]], left_class: dict[str, float], right: dict[str, tuple[float, float, float]], pairs: tuple[np.ndarray, np.ndarray], case: dict[tuple[str, str], float], lengths: dict[str, dict[int, int]]):
        self.bare = np.stack([_bare_odds(lengths.get(kind, {})) for kind in ("w", "c")])
        self.left_class, self.case, self.pair_keys, self.pair_mass = left_class, case, *pairs
        self.left = {w: k for k, w in enumerate(left)}
        self.right = {w: k for k, w in enumerate(right)}
        self.left_values = np.array([*left.values(), (0.5, 0.0, 2.0)])
        self.right_values = np.array(list(right.values()))

    def log_odds(self, lefts: list[str] | pa.Array, rights: list[str] | pa.Array, low: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Log odds of a boundary between each two words; ``low``: the line begins with a small letter, ``per``: it has so many places."""
        u, u_words = _coded(lefts)
        v, v_words = _coded(rights)
        u_forms, v_forms = [left_form(w) for w in u_words], [right_form(w) for w in v_words]
        ids = np.array([self.left.get(f, -1) for f, _ in u_forms], np.int64)
        prior = np.where(ids >= 0, self.left_values[ids, 0], [self.left_class.get(c, 0.5) for _, c in u_forms])
        prior = np.clip(prior, 1e-4, 1 - 1e-4)
        other = np.array([self.right.get(f, -1) for f, _ in v_forms], np.int64)
        values = self.right_values[np.where(other >= 0, other, self.right[""])]
        case = np.array([[self.case.get((c, style), 0.0) for _, c in v_forms] for style in ("up", "low")])
        uid, vid = ids[u], other[v]
        key = np.where((uid >= 0) & (vid >= 0), uid * len(self.right) + vid, -1)
        pair = np.zeros(len(key))
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            pair = np.where(self.pair_keys[at] == key, self.pair_mass[at], 0.0)
        mass, types = self.left_values[uid, 1], self.left_values[uid, 2]
        goes_on = (pair + types * values[v, 1]) / (mass + types)
        before = np.log(prior / (1 - prior))[u]
        # Words without a mark, in scripts that have some: the line's length tells.
        kinds = np.array([-1 if c[0] != "|" else {"t": -1, "c": 1}.get(c.split("|")[2], 0) for _, c in u_forms], np.int64)[u]
        before = np.where(kinds >= 0, self.bare[np.maximum(kinds, 0), np.minimum(per, LONGEST)], before)
        goes_on = np.where(kinds >= 0, values[v, 2], goes_on)
        return before + np.log(values[v, 0] / goes_on) + case[low.astype(np.int64), v]

    def posteriors(self, per: np.ndarray, lefts: list[str] | pa.Array, rights: list[str] | pa.Array, tied: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Posterior of a boundary at each place, by forward-backward over all lines together.

        ``per`` has the number of places of each line, ``low`` whether the line begins with a small letter, and ``tied``
        for each place whether its left word comes right after the place before. Such a word stands alone if a boundary
        lies at either place, and is rarely a whole unit, so its own odds fall by the weight LONELY.
        """
        if not per.sum():
            return np.zeros(0)
        odds = self.log_odds(lefts, rights, np.repeat(low, per), np.repeat(per, per))
        lines = per[per > 0]
        first = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        sizes = -lines[order]
        tied = tied.copy()
        tied[first] = False
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        hard = odds - LONELY
        # move[i, s, t]: from state s at the place before to state t at place i.
        move = np.empty((len(odds), 2, 2))
        move[:, 0, 0], move[:, 0, 1], move[:, 1, 0], move[:, 1, 1] = no, yes, np.where(tied, -np.logaddexp(0, hard), no), np.where(tied, -np.logaddexp(0, -hard), yes)
        alpha, beta = np.zeros((len(odds), 2)), np.zeros((len(odds), 2))
        alpha[first] = move[first, 0]
        steps = [order[: int(np.searchsorted(sizes, -k, side="left"))] for k in range(int(lines.max()))]
        for k, live in enumerate(steps):
            if k:
                at = first[live] + k
                alpha[at] = np.logaddexp(alpha[at - 1, 0, None] + move[at, 0], alpha[at - 1, 1, None] + move[at, 1])
        for k in range(len(steps) - 1, 0, -1):
            at = first[steps[k]] + k
            beta[at - 1] = np.logaddexp(move[at, :, 0] + beta[at, None, 0], move[at, :, 1] + beta[at, None, 1])
        post = alpha + beta
        return 1 / (1 + np.exp(np.clip(post[:, 0] - post[:, 1], -700, 700)))


#: Log weight against a unit of a single word between two places.
LONELY = 1.5


def _bare_odds(lengths: dict[int, int]) -> np.ndarray:
    """Log odds of a boundary at a gap without mark, by the number of gaps in a line that has no marks at all."""
    number = np.zeros(LONGEST + 2)
    for n, k in lengths.items():
        number[min(n, LONGEST + 1)] += k
    number[1] += 1  # as a start
    tail = number[::-1].cumsum()[::-1] / number.sum()
    style = UNMARKED / (UNMARKED + (1 - UNMARKED) * tail[1:])  # a line with n gaps is as long as n + 1 words
    p = np.clip(style / max(2.0, float((number * np.arange(LONGEST + 2)).sum() / number.sum())), 1e-5, 0.5)
    return np.log(p / (1 - p))


def _solid_pieces(text: str, spots: list[tuple[int, int, str, str, bool]]) -> list[bool]:
    """Whether each piece between places holds a letter or digit."""
    if not spots:
        return [True]
    out, begin = [], 0
    for end, nxt, *_ in spots:
        out.append(text[begin].isalnum() or _SOLID.search(text, begin, end) is not None)
        begin = nxt
    out.append(text[begin].isalnum() or _SOLID.search(text, begin) is not None)
    return out


class Lines:
    """The lines of running text of some messages, labelled, with their places, laid out in columns.

    ``rows`` has for each line the number of its message, ``labels`` its letter (small: not to be split), ``low`` whether it
    begins with a small letter, ``at`` and ``size`` its place, ``per`` its number of places; for each place there are
    ``ends`` and ``nexts`` (in the line), ``lefts`` and ``rights``, ``tied``; ``solid`` tells for each piece between places
    whether it holds a letter or digit. What `counts` counts is gathered if ``counted``.
    """

    def __init__(self, messages: list[str], model: LineModel, counted: bool = True):
        lines: list[tuple[int, int, int, bool, str, int]] = []
        spots: list[tuple[int, int, str, str, bool]] = []
        self.solid: list[bool] = []
        self.words: Counter = Counter()
        self.lengths: Counter = Counter()
        self.firsts: Counter = Counter()
        self.lasts: Counter = Counter()
        met: dict[str, tuple[list[tuple[int, int, str, str, bool]], list[bool], bool]] = {}
        times: Counter = Counter()
        row = 0
        for message, (found, letters, flags) in zip(messages, labelled(messages, model), strict=True):
            for a, text, split, label in running_parts(message, found, letters, flags):
                if split:
                    got = met.get(text)
                    if got is None:
                        new = places(text)
                        got = met[text] = new, _solid_pieces(text, new), text[0].islower()
                    times[text] += 1
                    new, solid, low = got
                    self.solid += solid
                    spots += new
                    lines.append((row, a, len(text), low, label, len(new)))
                else:
                    self.solid.append(True)
                    lines.append((row, a, len(text), text[0].islower(), label.lower(), 0))
            row += 1
        if counted:
            self._gather({t: (n, not met[t][0], met[t][2]) for t, n in times.items()})
        self.rows, self.at, self.size, self.low, self.labels, self.per = map(list, zip(*lines, strict=True)) if lines else ([] for _ in range(6))
        self.ends, self.nexts, self.lefts, self.rights, self.tied = map(list, zip(*spots, strict=True)) if spots else ([] for _ in range(5))

    def _gather(self, texts: dict[str, tuple[int, bool, bool]]) -> None:
        """What distinct lines hold; of each how often it comes, whether it has no place, whether it begins small."""
        by_times: dict[int, list[str]] = {}
        for text, (n, alone, low) in texts.items():
            tokens = text.split()
            words = by_times.get(n)
            if words is None:
                words = by_times[n] = []
            words += tokens
            if alone and text[-1] in _MARKS:  # a sentence by itself
                east = text.isascii() or len(_CJK.findall(text))
                self.lengths[("w", len(tokens)) if east is True or not east else ("c", east)] += n
            self.firsts[tokens[0], "low" if low else "up"] += n
            last = tokens[-1]
            if not last[0].isalnum() and not _SOLID.search(last):
                for before in tokens[-2:-5:-1]:
                    last = before + " " + last
                    if _SOLID.search(before):
                        break
            self.lasts[last] += n
        for n, words in by_times.items():
            for w, k in Counter(words).items():
                self.words[w] += n * k

    def counts(self) -> dict[str, list]:
        """Events of these lines, in columns: kind, forms and classes of both words, number.

        ``g`` counts places with a mark or in scripts without marks, ``s`` first words, ``e`` last words, ``c`` words of the
        running text (in East Asian text each two characters), ``l`` lengths of sentences.
        """
        out: Counter = Counter()
        for w, n in self.words.items():
            if not w.isascii() and _CJK.search(w):
                for m in _CJK.finditer(w):
                    out["c", "", "", right_form(w[m.start() : m.start() + 2])[0], ""] += n
            else:
                out["c", "", "", right_form(w)[0], ""] += n
        for (kind, n), k in self.lengths.items():
            out["l", "", kind, str(min(n, LONGEST + 1)), ""] += k
        for (w, c), n in self.firsts.items():
            f, k = right_form(w)
            out["s", "", "", f, k + c] += n
        for w, n in self.lasts.items():
            if w[-1] not in ",:;":
                f, k = left_form(w[-4:] if _CJK.search(w) else w)
                out["e", f, k, "", ""] += n
        u, u_words = _coded(self.lefts)
        v, v_words = _coded(self.rights)
        low = np.repeat(np.array(self.low, np.int64), np.array(self.per, np.int64))
        keys, numbers = np.unique((u * max(1, len(v_words)) + v) * 2 + low, return_counts=True)
        u_forms, v_forms = [left_form(w) for w in u_words], [right_form(w) for w in v_words]
        for key, n in zip(keys.tolist(), numbers.tolist(), strict=True):
            pair, low_line = divmod(key, 2)
            i, j = divmod(pair, len(v_words))
            if u_forms[i][1][0] == "|" and "|t|" not in u_forms[i][1]:
                continue  # a gap of a line without marks
            f, k = v_forms[j]
            out["g", *u_forms[i], f, k + ("low" if low_line else "up")] += n
        cols = list(zip(*out, strict=True)) or [()] * 5
        return dict(zip(("kind", "u", "uc", "v", "vc"), map(list, cols), strict=True)) | {"n": list(out.values())}


def units_of(rows: np.ndarray, labels: np.ndarray, at: np.ndarray, size: np.ndarray, per: np.ndarray, ends: np.ndarray, nexts: np.ndarray, solid: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Message number, start, end and label of each unit: lines cut at the places whose posterior passes one half.

    Marks alone are no unit: before a unit they open it, after the last one of a line they belong to that.
    """
    line_of = np.repeat(np.arange(len(rows)), per + 1)  # of each piece
    inner = np.ones(len(line_of), bool)  # pieces with a place after them
    inner[np.cumsum(per + 1) - 1] = False
    place_of = np.cumsum(inner) - 1
    cut = np.zeros(len(line_of), bool)
    cut[inner] = post > 0.5
    # Pieces that no cut parts hold together as a group.
    heads = np.flatnonzero(np.append(True, cut[:-1] | (line_of[1:] != line_of[:-1]))) if len(line_of) else np.zeros(0, np.int64)
    full = np.flatnonzero(np.maximum.reduceat(solid.astype(np.int8), heads)) if len(heads) else heads
    line = line_of[heads]
    tails = np.append(heads[1:], len(line_of)) - 1
    begin = np.zeros(len(heads), np.int64)
    later = np.flatnonzero(line[1:] == line[:-1]) + 1
    begin[later] = nexts[place_of[tails[later - 1]]]
    # A unit begins where the group after the unit before begins, and the last of a line goes on to the line's end.
    of = line[full]
    same = of[1:] == of[:-1]
    opening = np.searchsorted(line, of, side="left")
    opening[1:][same] = full[:-1][same] + 1
    stop = size[of]
    stop[:-1][same] = ends[place_of[tails[full[:-1][same]]]]
    return rows[of], at[of] + begin[opening], at[of] + stop, labels[of]


def located_units(lines: Lines, model: EventModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Message number, start, end and label of each unit of some lines."""
    per = np.array(lines.per, np.int64)
    post = model.posteriors(per, lines.lefts, lines.rights, np.array(lines.tied, bool), np.array(lines.low, bool))
    labels = np.frombuffer("".join(lines.labels).upper().encode(), np.uint8)
    rows, at, size, ends, nexts = (np.array(x, np.int64) for x in (lines.rows, lines.at, lines.size, lines.ends, lines.nexts))
    return units_of(rows, labels, at, size, per, ends, nexts, np.array(lines.solid, bool), post)


def message_units(messages: list[str], lines: Lines, model: EventModel) -> list[list[tuple[int, int, str, str]]]:
    """Start, end, text and label of the units of each message, in order; ``lines`` are theirs."""
    out: list[list[tuple[int, int, str, str]]] = [[] for _ in messages]
    for row, a, b, label in zip(*(x.tolist() for x in located_units(lines, model)), strict=True):
        out[row].append((a, b, messages[row][a:b], chr(label)))
    return out


# A message's row: a letter for each of its lines of running text (small: not to be split), their places and lengths; for
# each line the number of places, and for each place its two sides. `solid` tells which pieces hold a letter or digit.
_INTS, _TEXTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())
STAGED = [("kinds", T.StringType()), ("low", T.StringType()), ("at", _INTS), ("size", _INTS), ("n_places", _INTS), ("ends", _INTS), ("nexts", _INTS), ("lefts", _TEXTS), ("rights", _TEXTS), ("tied", T.StringType()), ("solid", T.StringType())]
_COUNTED = [("is_count", T.BooleanType()), ("kind", _TEXTS), ("u", _TEXTS), ("uc", _TEXTS), ("v", _TEXTS), ("vc", _TEXTS), ("n", T.ArrayType(T.LongType()))]


def _list(values: list | pa.Array, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _bits(values: list[bool], ends: np.ndarray) -> list[str]:
    """Strings of 0 and 1, one for each stretch."""
    text = (np.array(values, np.uint8) + 48).tobytes().decode()
    return [text[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]  # noqa: B905 - one end more


def staged_columns(lines: Lines, n: int) -> list[pa.Array]:
    """The columns of ``STAGED`` for ``n`` messages and a last row of nulls."""
    per = np.array(lines.per, np.int64)
    line_ends = np.searchsorted(np.array(lines.rows, np.int64), np.arange(n), side="right")
    place_ends = np.concatenate([[0], np.cumsum(per)])[line_ends]
    piece_ends = place_ends + line_ends
    letters = "".join(lines.labels)
    kinds = [letters[a:b] for a, b in zip([0, *line_ends.tolist()], line_ends.tolist())]  # noqa: B905
    ints, texts = pa.int32(), pa.string()
    more = lambda e: np.append(e, e[-1] if len(e) else 0)
    by_line, by_place = more(line_ends), more(place_ends)
    return [
        pa.array([*kinds, None], texts), pa.array([*_bits(lines.low, line_ends), None], texts), *(_list(x, by_line, ints) for x in (lines.at, lines.size, lines.per)), *(_list(x, by_place, ints) for x in (lines.ends, lines.nexts)),
        _list(lines.lefts, by_place, texts), _list(lines.rights, by_place, texts), pa.array([*_bits(lines.tied, place_ends), None], texts), pa.array([*_bits(lines.solid, piece_ends), None], texts),
    ]


def count_columns(counts: dict[str, list], n: int) -> list[pa.Array]:
    """The columns of ``_COUNTED``: ``n`` rows without counts and one that has them."""
    ends = np.array([0] * n + [len(counts["n"])], np.int64)
    return [pa.array([False] * n + [True]), *(_list(counts[c], ends, pa.string()) for c in ("kind", "u", "uc", "v", "vc")), _list(counts["n"], ends, pa.int64())]


def stage_messages(samples: DataFrame, model: LineModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Label lines, find the places of running text, and count them, in one pass whose result is written once.

    Besides a row for each message there is one for each batch that holds the counts of the batch, with ``is_count``;
    `count_events` adds these up. The columns ``keep`` go along.
    """
    shared = samples.sparkSession.sparkContext.broadcast(model)
    rows = samples.select("row_id", "message", *(c for c in keep if c != "message")).filter(F.length("message") > 0)
    schema = T.StructType([rows.schema["row_id"], *(T.StructField(n, k) for n, k in [*STAGED, *_COUNTED]), *(rows.schema[c] for c in keep)])

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, ids = Lines(batch.column("message").to_pylist(), shared.value), batch.column("row_id")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids, pa.nulls(1, ids.type)]), *staged_columns(lines, len(ids)), *count_columns(lines.counts(), len(ids)), *(pa.concat_arrays([batch.column(c), pa.nulls(1, batch.column(c).type)]) for c in keep)], names=schema.names)

    return written(rows.mapInArrow(run, schema), "staged-messages")


def count_events(staged: DataFrame) -> DataFrame:
    """``kind, u, uc, v, vc, n`` over all messages: the batches' own sums, added up."""
    rows = staged.filter("is_count").select(F.inline(F.arrays_zip("kind", "u", "uc", "v", "vc", "n")))
    return written(rows.groupBy("kind", "u", "uc", "v", "vc").agg(F.sum("n").alias("n")), "sentence-events")


def staged_units(batch: pa.RecordBatch, model: EventModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, start, end and label of the units of a staged batch."""

    def flat(name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def letters(name: str) -> np.ndarray:
        return np.frombuffer("".join(batch.column(name).to_pylist()).encode(), np.uint8)

    per = flat("n_places")
    rows = np.repeat(np.arange(batch.num_rows), batch.column("at").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    post = model.posteriors(per, batch.column("lefts").flatten(), batch.column("rights").flatten(), letters("tied") == 49, letters("low") == 49)
    return units_of(rows, letters("kinds") & 0xDF, flat("at"), flat("size"), per, flat("ends"), flat("nexts"), letters("solid") == 49, post)


def fit_events(events: DataFrame, word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE, steps: int = EM_STEPS) -> EventModel:
    """Expectation maximisation over the counted pairs; the driver gets frequent words and pairs only."""
    totals = {r.kind: r.n for r in events.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # four rows
    least = lambda kind, share: max(2, totals.get(kind, 0) * share)

    def words(kind: str, col: str) -> dict[str, int]:
        return {r[0]: r.n for r in events.filter(F.col("kind") == kind).groupBy(col).agg(F.sum("n").alias("n")).filter(F.col("n") >= least(kind, word_share)).collect()}  # at most 1 / word_share

    lengths = {k: {int(r.v): r.n for r in events.filter((F.col("kind") == "l") & (F.col("uc") == k)).select("v", "n").collect()} for k in ("w", "c")}  # at most LONGEST rows each
    starts, follows, ends, lefts = words("s", "v"), words("c", "v"), words("e", "u"), words("g", "u")
    end_class = {r[0]: r.n for r in events.filter("kind = 'e'").groupBy("uc").agg(F.sum("n").alias("n")).collect()}  # classes are few
    spark = events.sparkSession
    gaps = events.filter("kind = 'g'")
    known_u = F.broadcast(spark.createDataFrame([(u,) for u in lefts] or [("",)], "u string").withColumn("ku", F.lit(True)))
    known_v = F.broadcast(spark.createDataFrame([(v,) for v in starts.keys() | follows.keys()] or [("",)], "v string").withColumn("kv", F.lit(True)))
    mapped = gaps.join(known_u, "u", "left").join(known_v, "v", "left").select(F.when(F.col("ku"), F.col("u")).otherwise("").alias("u"), "uc", F.when(F.col("kv"), F.col("v")).otherwise("").alias("v"), "vc", "n")
    summed = mapped.groupBy("u", "uc", "v", "vc").agg(F.sum("n").alias("n"))
    kept = summed.withColumn("v", F.when(F.col("n") >= least("g", pair_share), F.col("v")).otherwise("")).groupBy("u", "uc", "v", "vc").agg(F.sum("n").alias("n"))
    table = kept.toPandas()  # at most 1 / pair_share pairs, and a class row for each word
    return _em(table, starts, follows, ends, end_class, totals, lengths, steps)


def events_of(lines: Lines, steps: int = EM_STEPS) -> EventModel:
    """The model of a few messages by themselves: every word and pair is kept."""
    table = pd.DataFrame(lines.counts())
    by = lambda kind, col: table[table["kind"] == kind].groupby(col)["n"].sum().to_dict()
    totals = table.groupby("kind")["n"].sum().to_dict()
    lengths = {k: {int(v): n for v, n in table[(table["kind"] == "l") & (table["uc"] == k)].groupby("v")["n"].sum().items()} for k in ("w", "c")}
    return _em(table[table["kind"] == "g"].reset_index(drop=True), by("s", "v"), by("c", "v"), by("e", "u"), by("e", "uc"), totals, lengths, steps)


def _em(table: pd.DataFrame, starts: dict[str, int], follows: dict[str, int], ends: dict[str, int], end_class: dict[str, int], totals: dict[str, int], lengths: dict[str, dict[int, int]], steps: int) -> EventModel:
    n_start, n_follow = max(1, totals.get("s", 0)), max(1, totals.get("c", 0))
    if not len(table):  # no place has a mark
        begins = {w: (n + 0.3) / (n_start + 0.3) for w, n in starts.items()}
        goes_on = {w: (n + 0.3) / (n_follow + 0.3) for w, n in follows.items()}
        right = {w: (begins.get(w, 0.3 / n_start), goes_on.get(w, 0.3 / n_follow), (max(0, follows.get(w, 0) - starts.get(w, 0)) + 0.3) / (n_follow + 0.3)) for w in dict.fromkeys([*begins, *goes_on])}
        return EventModel({}, {}, right | {"": (1e-3, 1e-3, 1e-3)}, (np.zeros(0, np.int64), np.zeros(0)), {}, lengths)
    n = table["n"].to_numpy(float)
    u_names, u = np.unique(table["u"].to_numpy(str), return_inverse=True)
    c_names, c = np.unique(table["uc"].to_numpy(str), return_inverse=True)
    v_names, v = np.unique(table["v"].to_numpy(str), return_inverse=True)
    case = table["vc"].to_numpy(str)
    k_names, k = np.unique(case, return_inverse=True)
    add = lambda idx, size, w: np.bincount(idx, w, size)
    end_u = np.array([ends.get(x, 0) for x in u_names], float)
    end_c = np.array([end_class.get(x, 0) for x in c_names], float)
    mid_u, mid_c = add(u, len(u_names), n), add(c, len(c_names), n)
    # Share of units that end where their line ends; so a word that never ends a line hardly ends a unit.
    rho = min(0.9, max(0.05, end_c.sum() / max(1.0, end_c.sum() + 0.8 * n.sum())))
    class_p = np.clip((end_c * (1 - rho) / rho + 0.2) / (mid_c + 0.4), 0.001, 0.995)
    prior_of = np.zeros(len(u_names))
    prior_of[u] = class_p[c]
    p_u = np.clip((np.minimum(end_u * (1 - rho) / rho, mid_u) + 2 * prior_of) / (mid_u + 2), 0.001, 0.999)
    rare = u_names == ""
    start_v = np.array([starts.get(x, 0) for x in v_names], float)
    follow_v = np.array([follows.get(x, 0) for x in v_names], float)
    # Where no rare word was seen, one is as likely to begin as to go on.
    s_rest, f_rest = max(n_start / n_follow, n_start - sum(starts.values())), max(1.0, n_follow - sum(follows.values()))
    start_v[v_names == ""], follow_v[v_names == ""] = s_rest, f_rest
    case_yes, case_no = np.full(len(k_names), 0.5), np.full(len(k_names), 0.5)
    pairs, pair_of = np.unique(u * len(v_names) + v, return_inverse=True)
    ps, pf = (start_v + 0.3) / (n_start + 0.3 * len(v_names)), (follow_v + 0.3) / (n_follow + 0.3 * len(v_names))
    back = pf[v]
    # Witten-Bell: a word that many different ones follow leaves more room for others yet.
    # A word whose line ends show that it ends units has no followers of its own: they are those of any place.
    types = np.maximum(np.bincount(pairs // len(v_names), minlength=len(u_names)), 2).astype(float)
    anchor = np.minimum(end_u * (1 - rho) / rho / np.maximum(mid_u, 1e-9), 0.999)
    types += mid_u * np.where(anchor > 0.5, anchor / (1 - anchor), 0)
    for _ in range(steps):
        prior = np.where(rare[u], class_p[c], p_u[u])
        yes = prior * ps[v] * case_yes[k]
        no = (1 - prior) * back * case_no[k]
        g = yes / (yes + no + 1e-300)
        b, nb = n * g, n * (1 - g)
        ps = (start_v + add(v, len(v_names), b) + 0.3) / (n_start + b.sum() + 0.3 * len(v_names))
        class_p = (add(c, len(c_names), b) + 0.2) / (mid_c + 0.4)
        prior_of[u] = class_p[c]
        # The line ends stay part of the evidence, so that a word is not drawn away from them.
        p_u = np.clip((add(u, len(u_names), b) + 3 * anchor + prior_of) / (mid_u + 4), 0.0005, 0.9995)
        mass = add(u, len(u_names), nb)
        back = (add(pair_of, len(pairs), nb)[pair_of] + types[u] * pf[v]) / (mass[u] + types[u])
        case_yes, case_no = (add(k, len(k_names), b) + 0.5) / (b.sum() + 0.5 * len(k_names)), (add(k, len(k_names), nb) + 0.5) / (nb.sum() + 0.5 * len(k_names))
    by_pair = add(pair_of, len(pairs), nb)
    mass = add(u, len(u_names), nb)
    odds = {}
    for name, y, z in zip(k_names, np.log(case_yes), np.log(case_no), strict=True):
        style = "low" if name.endswith("low") else "up"
        odds[str(name[: -len(style)]), style] = float(y - z)
    # Words of the running text that were never beside a place come in, too.
    start_all = {w: (x + 0.3) / (n_start + b.sum() + 0.3 * len(v_names)) for w, x in starts.items()} | {str(w): float(p) for w, p in zip(v_names, ps, strict=True)}
    follow_all = {w: (x + 0.3) / (n_follow + 0.3 * len(v_names)) for w, x in follows.items()}
    start_all[""], follow_all[""] = s_rest / n_start / 50, f_rest / n_follow / 50
    # Where no mark tells, a word goes on as often as it comes without being known to begin.
    begun = dict(zip(map(str, v_names), add(v, len(v_names), b), strict=True))
    inner = {w: (max(0.0, x - starts.get(w, 0) - begun.get(w, 0.0)) + 0.3) / (n_follow + 0.3 * len(v_names)) for w, x in follows.items()}
    right = {w: (start_all.get(w, start_all[""]), follow_all.get(w, follow_all[""]), inner.get(w, follow_all[""])) for w in dict.fromkeys([*start_all, *follow_all])}
    left = {str(x): (float(p), float(m), float(t)) for x, p, m, t in zip(u_names, p_u, mass, types, strict=True) if x}
    # The pairs by the numbers of their words in these tables.
    left_no, right_no = {w: k for k, w in enumerate(left)}, {w: k for k, w in enumerate(right)}
    uid = np.array([left_no.get(str(x), -1) for x in u_names], np.int64)[pairs // len(v_names)]
    vid = np.array([right_no[str(x)] if x else -1 for x in v_names], np.int64)[pairs % len(v_names)]
    known = (uid >= 0) & (vid >= 0)
    keys, weights = (uid * len(right) + vid)[known], by_pair[known]
    order = np.argsort(keys)
    return EventModel(left, {str(x): float(p) for x, p in zip(c_names, class_p, strict=True)}, right, (keys[order], weights[order]), odds, lengths)


def sentence_units(staged: DataFrame, model: EventModel) -> DataFrame:
    """``row_id, start_char, end_char`` of each unit; a map without shuffle."""
    shared = staged.sparkSession.sparkContext.broadcast(model)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, ends, _ = staged_units(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(rows)), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["row_id", "start_char", "end_char"])

    return staged.filter("not is_count").select("row_id", *(n for n, _ in STAGED)).mapInArrow(run, "row_id bigint, start_char bigint, end_char bigint")


def p3_found(samples: DataFrame) -> DataFrame:
    staged = stage_messages(samples, fitted(samples))
    return sentence_units(staged, fit_events(count_events(staged)))
