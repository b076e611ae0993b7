"""Find fields that were decoded with the wrong character encoding, and restore their original text.

Adjacent character pairs with a character beyond ASCII are counted over all fields. A pair's contribution to the mutual
information of neighbouring characters, p(xy) log(p(xy) / p(x)p(y)), is large for pairs that belong to the corpus'
languages and small for accidents. Its shortfall is the pair's score; pairs within ASCII score a little below 0, so that
maximum-scoring segments isolate improbable runs. Only fields with such a run are tried: inverse mappings are tested on
the characters of the runs, and the one that removes most of the shortfall is applied, again and again for text that was
garbled more than once.

A large garbled source must not vouch for itself. Lines whose characters beyond ASCII are nearly all sequences of UTF-8 as
one page shows them are left out of the counts. Where the pairs of one page come as pairs of another at one steady rate,
the second ones are taken for its misread text, and their share is taken off their counts.

Inverse mappings: UTF-8 read as one of several single-byte code pages (every sequence must decode strictly), one
single-byte code page read as another, and East Asian double-byte text read as a single-byte code page. For the second
kind each word is restored only if that makes it more probable, or if it stands between words that are restored.

Defined results: a field that holds replacement characters (U+FFFD) has lost text for good; what can be told is only
that. Null, empty and blank fields, ASCII text, and text without a likelier reading are not garbled. Pairs that make up
less than PAIR_SHARE of all counted pairs share one floor, which bounds the table by definition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.batches import uncollected
from quillveil.runtime import written

FIELDS = ["message", "subject"]
PAIR_SHARE = 3e-7
#: Contribution to mutual information, as log10, below which a pair counts as improbable.
PROBABLE = -3.4
#: Shortfall of a pair that isn't in the table.
FLOOR = 3.0
#: Score of a step within ASCII, and least sum of a segment.
STEP, LEAST = -0.05, 0.3
#: Share of the shortfall that a mapping must remove, for pages mistaken for each other.
GAIN = 0.55
ROUNDS = 3
#: Share of a line's characters beyond ASCII in sequences of UTF-8 from which it is left out of the counts.
MISREAD = 0.75
#: Least rate of misread to right pairs that is looked for, share of pairs that must keep it within a factor of 2, and least number of pairs to tell by.
RATE, STEADY, TOLD_BY = 0.02, 0.55, 30

SINGLE = ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_5", "iso8859_15", "cp1253", "cp1256", "cp874"]
#: Pages in which mistaken single-byte text may have been written.
WRITTEN = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "iso8859_15"]
DOUBLE = ["shift_jis", "gb18030", "euc_jp", "big5"]
READINGS = [(shown, was) for shown in SINGLE for was in WRITTEN if was != shown]
#: What a reading must gain more when its page is seldom written.
UNUSUAL = np.array([0.0 if was in ("cp1252", "cp1251", "koi8_r") else 1.5 for _, was in READINGS])
LOST = "�"
#: Letters that lead no UTF-8 sequence by themselves in the languages at hand.
LETTERS = frozenset("éèêëàâçîïôùûüöäßñíóúáãõìòÉÀÇÊÓÁÍÚÑÖÜÄ")
_WIDE = re.compile("[^\x00-\x7f]+")
_TOKEN = re.compile(r"[^ \t\r\n]+")


@lru_cache(maxsize=64)
def page(name: str) -> tuple[dict[str, int], list[str]]:
    """Characters of a code page beyond ASCII, both ways; bytes that it leaves undefined are control characters."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {c: b for b, c in enumerate(chars) if b >= 0x80}
    if name == "cp1252":  # also the page without the characters between 0x80 and 0x9f
        back |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in back}
    return back, chars


@lru_cache(maxsize=256)
def table(shown: str, was: str) -> dict[int, str]:
    """Translation of characters shown by one page to those of the page they were written in."""
    back, _ = page(shown)
    chars = page(was)[1]
    return {ord(c): chars[b] for c, b in back.items()}


def from_utf8(text: str, shown: str) -> str | None:
    """The text with its valid UTF-8 sequences decoded; None if there is none."""
    back, _ = page(shown)
    hits = 0

    def decode(m: re.Match) -> str:
        nonlocal hits
        out, raw, run = [], bytearray(), m[0]
        codes = [back.get(c, -1) for c in run]
        i, n = 0, len(run)
        while i < n:
            b = codes[i]
            size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if size and i + size <= n and all(0x80 <= x <= 0xBF for x in codes[i + 1 : i + size]):
                raw = bytes(codes[i : i + size])
                try:
                    out.append(raw.decode("utf-8"))
                    hits += 1
                    i += size
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(run[i])
            i += 1
        return "".join(out)

    done = _WIDE.sub(decode, text)
    return done if hits else None


class PairScores:
    """Shortfalls of pairs from the corpus' counts."""

    def __init__(self, keys: np.ndarray, short: np.ndarray, floor: float):
        self.keys, self.short, self.floor = keys, short, floor
        self.words: dict[str, float] = {}
        self.readings: dict[str, np.ndarray] = {}
        self.pairs: dict[int, float] | None = None

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Shortfall of each pair: 0 for probable ones, up to ``floor``."""
        key = (x.astype(np.int64) << 21) | y
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return np.full(len(key), self.floor)
        return np.where(self.keys[at] == key, self.short[at], self.floor)

    def word_cost(self, word: str) -> float:
        """Sum of the shortfalls of a word between spaces; kept for words that come again."""
        got = self.words.get(word)
        if got is None:
            if self.pairs is None:
                self.pairs = dict(zip(self.keys.tolist(), self.short.tolist(), strict=True))
            pairs, floor, got, x = self.pairs, self.floor, 0.0, 32
            for c in word + " ":
                y = ord(c)
                if x > 127 or y > 127:
                    got += pairs.get((x << 21) | y, floor)
                x = y
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[word] = got
        return got

    def word_readings(self, word: str) -> np.ndarray:
        """Cost of a word read by each of READINGS; infinite where the page doesn't have its characters."""
        got = self.readings.get(word)
        if got is None:
            got = np.full(len(READINGS), np.inf)
            wide = [c for c in word if c > "\x7f"]
            for k, (shown, was) in enumerate(READINGS):
                back, _ = page(shown)
                if all(c in back for c in wide):
                    got[k] = self.word_cost(word.translate(table(shown, was)))
            if len(self.readings) > 50_000:
                self.readings.clear()
            self.readings[word] = got
        return got

    def cost(self, words: list[str]) -> float:
        return sum(map(self.word_cost, words))


def segments(at: list[int], score: list[float], least: float) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa) with at least the given sum, as half-open ranges of pairs.

    ``at`` are the places of the pairs that have a score; each step between them scores STEP.
    """
    stack: list[tuple[float, float, int, int]] = []  # left sum, right sum, begin, end
    total, last = 0.0, -1
    for k, s in zip(at, score, strict=True):
        before = total + STEP * (k - last - 1)
        total, last = before + s, k
        if s <= 0:
            continue
        lo, hi, begin, end = before, total, k, k + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= lo:
                j -= 1
            if j < 0 or stack[j][1] >= hi:
                stack.append((lo, hi, begin, end))
                break
            lo, begin = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b) for lo, hi, a, b in stack if hi - lo >= least]


def run_words(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The words with characters beyond ASCII that touch a run."""
    out, at = [], -1
    for a, b in spans:
        while a > 0 and text[a] not in " \t\r\n":
            a -= 1
        a, stop = max(a, at), b + 1
        while stop < len(text) and text[stop] not in " \t\r\n":
            stop += 1
        at = stop
        out += [w for w in _TOKEN.findall(text[a:stop]) if not w.isascii()]
    return out


def restore(text: str, scores: PairScores, spans: list[tuple[int, int]]) -> str:
    """The text after the best inverse mapping, or as it is. Mappings are tried on the words of the runs only."""
    words = run_words(text, spans)
    wide = {c for w in words for c in w if c > "\x7f"}
    if not wide:
        return text
    cost = scores.cost(words)
    whole = " ".join(words)
    best, chosen, depth = cost - 0.3, "", 0
    if any(x[k : k + 2] in utf8_pairs() for x in _WIDE.findall(whole) for k in range(len(x) - 1)):
        for shown in SINGLE:
            back, _ = page(shown)
            # A sequence has a leading and a following byte, so two of the runs' characters must be of the page.
            if sum(c in back for c in wide) < 2:
                continue
            done = whole
            for k in range(1, ROUNDS + 1):
                if (done := from_utf8(done, shown)) is None:
                    break
                # Leading bytes that are left over speak against the page.
                after = scores.cost(_TOKEN.findall(done)) + 0.4 * sum(back.get(c, 0) >= 0xC2 for c in done if c not in LETTERS)
                if after < best:
                    best, chosen, depth = after, shown, k
    if len(wide) >= 4 and sum(c.isascii() and c.isalpha() for c in whole) < 0.3 * len(whole):
        for shown in SINGLE:
            back, _ = page(shown)
            if not all(c in back for c in wide):
                continue
            for was in DOUBLE:
                # The second byte of a character may lie within ASCII, so whole words are decoded.
                decode = lambda m, back=back, was=was: m[0] if m[0].isascii() else bytes(back[c] if c > "\x7f" else ord(c) for c in m[0]).decode(was)
                try:
                    if scores.cost(_TOKEN.findall(_TOKEN.sub(decode, whole))) < min(best, 0.4 * cost):
                        return _TOKEN.sub(decode, text)
                except (UnicodeDecodeError, KeyError):
                    continue
    decoded = text
    for _ in range(depth):
        decoded = from_utf8(decoded, chosen) or decoded
    if cost < 1.0 or (chosen and best <= (1 - GAIN) * cost):
        return decoded
    # A letter by itself has too little context to tell a page by.
    words = sorted({w for w in words if len(w.strip(".,;:!?…()\"'«»")) > 1})
    if not words:
        return decoded
    own = np.array([scores.word_cost(w) for w in words])
    read = np.stack([scores.word_readings(w) for w in words])
    better = read < own[:, None] - 1.0
    gain = np.where(better, own[:, None] - read, 0).sum(0) - UNUSUAL
    left = np.where(better, read, 0).sum(0)
    k = int((gain - left).argmax())
    # A few sequences that are UTF-8 by accident don't stand against a page that explains more.
    if gain[k] >= 2.5 and left[k] <= (1 - GAIN) * (left[k] + gain[k]) and (not chosen or (own.sum() - gain[k]) / own.sum() < best / cost):
        return by_words(text, table(*READINGS[k]), scores)
    return decoded


def by_words(text: str, mapping: dict[int, str], scores: PairScores) -> str:
    """Map the words that get likelier, and those between two such words unless they get much less likely."""
    words = [(m.start(), m.end(), scores.word_cost(m[0]) - scores.word_cost(m[0].translate(mapping))) for m in _TOKEN.finditer(text) if not m[0].isascii()]
    chosen = [g > 0.05 for _, _, g in words]
    for k in range(1, len(words) - 1):
        if not chosen[k] and words[k][2] > -0.4 and chosen[k - 1] and chosen[k + 1]:
            chosen[k] = True
    out, at = [], 0
    for (a, b, _), yes in zip(words, chosen, strict=True):
        if yes:
            out += [text[at:a], text[a:b].translate(mapping)]
            at = b
    out.append(text[at:])
    return "".join(out)


def examine(text: str, scores: PairScores) -> str | None:
    """What a garbled field was before, LOST if that is gone, None if the field isn't garbled."""
    if LOST in text:
        return LOST
    now = text
    for _ in range(ROUNDS):
        codes = np.frombuffer(now.encode("utf-32-le", "surrogatepass"), np.uint32)
        at, score = wide_pairs(codes, scores)
        spans = segments(at.tolist(), score.tolist(), LEAST)
        if not spans:
            break
        done = restore(now, scores, spans)
        if done == now:
            break
        now = done
    return None if now == text else now


def wide_pairs(codes: np.ndarray, scores: PairScores) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with a character beyond ASCII, and the score of each: its shortfall less what is usual."""
    x, y = codes[:-1], codes[1:]
    at = np.flatnonzero((x > 127) | (y > 127))
    return at, scores.of(x[at], y[at]) - 0.15


@lru_cache(maxsize=1)
def utf8_pairs() -> frozenset[str]:
    """All pairs of a leading and a following byte of UTF-8, as the pages show them."""
    out = set()
    for name in SINGLE:
        back, _ = page(name)
        lead = [c for c, b in back.items() if 0xC2 <= b <= 0xF4]
        follow = [c for c, b in back.items() if 0x80 <= b <= 0xBF]
        out.update(a + b for a in lead for b in follow)
    return frozenset(out)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=16)
def _bytes_of(name: str) -> np.ndarray:
    """Bytes beyond ASCII of a page by character, 0 for characters that it lacks."""
    out = np.zeros(0x10000, np.uint8)
    for c, b in page(name)[0].items():
        out[ord(c)] = b
    return out


def misread(codes: np.ndarray) -> np.ndarray:
    """Whether each character stands in a line that is UTF-8 as one page shows it."""
    line = np.cumsum(codes == 10)
    at = np.flatnonzero(codes > 127)
    if not len(at):
        return np.zeros(len(codes), bool)
    chars, whose = np.minimum(codes[at], 0xFFFF), line[at]
    near = np.diff(at, append=-1) == 1
    wide = np.bincount(whose, minlength=line[-1] + 1)
    out = np.zeros(len(wide), bool)
    for name in SINGLE:
        b = _bytes_of(name)[chars]
        follow = (b >= 0x80) & (b <= 0xBF)
        runs = [follow]  # whether 0, 1, 2, 3 following bytes come next
        for _ in range(3):
            runs.append(near & np.append((runs[-1] & follow if len(runs) > 1 else follow)[1:], False))
        size = 2 * ((b >= 0xC2) & (b <= 0xDF) & runs[1]) + 3 * ((b >= 0xE0) & (b <= 0xEF) & runs[2]) + 4 * ((b >= 0xF0) & (b <= 0xF4) & runs[3])
        out |= np.bincount(whose, size, len(wide)) >= MISREAD * np.maximum(wide, 1)
    return out[line]


def without_misread(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of pairs less those that another page's misread pairs explain."""
    keys = (x.astype(np.int64) << 21) | y
    order = np.argsort(keys)
    keys, left = keys[order], n[order].astype(float)
    given, x, y = left.copy(), x[order], y[order]
    for shown, was in READINGS:
        to = np.arange(0x10000)
        to[0x80:] = -1
        for c, b in page(was)[0].items():
            to[ord(c)] = ord(page(shown)[1][b])
        right = np.flatnonzero((x < 0x10000) & (y < 0x10000))
        a, b = to[x[right]], to[y[right]]
        whole = (a >= 0) & (b >= 0) & ((a != x[right]) | (b != y[right]))
        right, key = right[whole], (a[whole].astype(np.int64) << 21) | b[whole]
        if len(right) < TOLD_BY:
            continue
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        rate = np.where(keys[place] == key, given[place], 0) / given[right]
        by = np.argsort(rate)
        weight = given[right][by].cumsum()
        # The garbled pairs may be of the right page themselves, at no rate; so the middle may lie above the median.
        found = [(given[right][(rate > m / 2) & (rate < m * 2)].sum(), m) for m in rate[by][np.searchsorted(weight, weight[-1] * np.array([0.5, 0.65, 0.8]))]]
        share, middle = max(found)
        if RATE <= middle < 1 and share >= STEADY * weight[-1]:
            hit = keys[place] == key
            np.subtract.at(left, place[hit], 1.5 * middle * given[right][hit])
    out = np.empty(len(left))
    out[order] = np.maximum(left, 0)
    return out


def count_pairs(fields: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, n``: counts of adjacent characters of which one is beyond ASCII (y -1: of single characters, all of them), without lines of misread UTF-8."""

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes([t for c in columns for t in batch.column(c).to_pylist() if t])
            codes = codes[~misread(codes)]
            x, y = codes[:-1], codes[1:]
            wide = (x > 127) | (y > 127)
            keys, n = np.unique((x[wide].astype(np.int64) << 21) | y[wide], return_counts=True)
            low = np.bincount(np.minimum(codes, 128), minlength=129)[:128]
            high, m = np.unique(codes[codes > 127], return_counts=True)
            some = np.flatnonzero(low)
            one = np.concatenate([some, high.astype(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys >> 21, one]), pa.int64()), pa.array(np.concatenate([keys & 0x1FFFFF, np.full(len(one), -1)]), pa.int64()), pa.array(np.concatenate([n, low[some], m]), pa.int64())], names=["x", "y", "n"]
            )

    rows = fields.select(*columns).mapInArrow(run, "x bigint, y bigint, n bigint")
    return written(rows.groupBy("x", "y").agg(F.sum("n").alias("n")), "character-pairs")


def fit_pairs(counts: DataFrame, share: float = PAIR_SHARE) -> PairScores:
    total = counts.filter("y >= 0").agg(F.sum("n")).first()[0] or 0
    singles = {r.x: r.n for r in counts.filter("y < 0").collect()}  # at most the characters of Unicode
    pairs = counts.filter((F.col("y") >= 0) & (F.col("n") >= F.greatest(F.lit(2), F.lit(total * share)))).toPandas()  # at most 1 / share
    chars = sum(singles.values())
    if not len(pairs) or not chars:
        return PairScores(np.zeros(0, np.int64), np.zeros(0), FLOOR)
    x, y, n = (pairs[c].to_numpy() for c in ("x", "y", "n"))
    n = without_misread(x, y, n)
    x, y, n = x[n > 0], y[n > 0], n[n > 0]
    px, py, p = np.array([singles[k] for k in x]) / chars, np.array([singles[k] for k in y]) / chars, n / chars
    part = p * np.log(np.maximum(p / (px * py), 1.05))
    keys = (x.astype(np.int64) << 21) | y
    order = np.argsort(keys)
    short = np.clip(PROBABLE - np.log10(part), 0, FLOOR)
    return PairScores(keys[order], short[order], FLOOR)


def garbled_fields(samples: DataFrame, scores: PairScores, columns: list[str]) -> DataFrame:
    """``row_id, field_name, restored``: each garbled field with its original text, null where it is lost."""
    shared = samples.sparkSession.sparkContext.broadcast(scores)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in batches:
            ids, names, found = [], [], []
            rows = batch.column("row_id").to_pylist()
            for c in columns:
                texts = batch.column(c).to_pylist()
                # One pass over the whole batch tells which texts have a run worth a closer look.
                held = [k for k, t in enumerate(texts) if t and not t.isascii()]
                if not held:
                    continue
                sizes = np.array([len(texts[k]) + 1 for k in held])
                codes = _codes([texts[k] for k in held])
                at, steps = wide_pairs(codes, scores)
                whose = np.searchsorted(np.cumsum(sizes), at, side="right")
                sums = np.bincount(np.minimum(whose, len(held) - 1), np.maximum(steps, 0), len(held))
                for k, s in zip(held, sums.tolist(), strict=True):
                    if s >= LEAST or LOST in texts[k]:
                        if (was := examine(texts[k], scores)) is not None:
                            ids.append(rows[k]), names.append(c), found.append(None if was == LOST else was)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(found, pa.string())], names=["row_id", "field_name", "restored"])

    return samples.select("row_id", *columns).mapInArrow(run, "row_id bigint, field_name string, restored string")


def restore_fields(samples: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or FIELDS
    return garbled_fields(samples, fit_pairs(count_pairs(samples, columns)), columns)


def p4_found(samples: DataFrame) -> DataFrame:
    """``row_id, field_name, restored_md5`` of each garbled field."""
    return restore_fields(samples).select("row_id", "field_name", F.coalesce(F.md5(F.encode("restored", "UTF-8")), F.lit("lost")).alias("restored_md5"))
