"""Language of documents and of their single-language runs, by hierarchical discrimination.

A unit's language family is predicted first: the script decides where it belongs to one family, and a linear support
vector machine tells Romance from Germanic in Latin script. Within a family one-versus-one linear support vector machines
over character n-grams and words separate the languages; their margins become scores. Units are then labelled in
sequence, as a change of language needs evidence (Viterbi with a price for a change).

The machines are trained on the labelled short texts and then, in rounds, on the units of all messages on which the machines
so far and the message's own label agree. The line model and the boundary model that cut messages into units come from all
messages, too. Each worker learns from all of its messages; each weight of a machine is the mean over the workers that changed
it, by how much these saw of both its sides. A worker runs its rounds on the units of its part together, so the later ones start from
its own machines. The units are written once; training and labelling read them.

Defined results: null, empty and blank messages and those without running text (numbers, addresses and links only) have no row. Labels are read without
regard to case, blanks and region suffixes, as two- or three-letter codes or English names; all else names no language.
A tie between languages goes to the one that the label names, else to the one met first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.anatomy import ATTR, CLOSE, DISC, FROM, GREET, KEYED, NAME, NEW, PHONE, SENT, SIGN, fit_line_model, flags_of
from quillveil.llm.batches import uncollected
from quillveil.llm.sentences import STAGED, EventModel, count_events, fit_events, stage_messages, staged_units
from quillveil.runtime import written

LANGS = ["fr", "es", "pt", "en", "de", "gl", "it", "ru", "zh", "ja", "hi", "ar", "th"]
_AT = {x: i for i, x in enumerate(LANGS)}
ROMANCE, GERMANIC, EAST = ["fr", "es", "pt", "gl", "it"], ["en", "de"], ["zh", "ja"]
#: Names of each language: code of three letters (both where there are two) and English name.
NAMES = {
    "fr": "fra fre french", "es": "spa spanish castilian", "pt": "por portuguese", "en": "eng english", "de": "deu ger german", "gl": "glg galician", "it": "ita italian",
    "ru": "rus russian", "zh": "zho chi cmn chinese mandarin", "ja": "jpn japanese", "hi": "hin hindi", "ar": "ara arabic", "th": "tha thai",
}
_NAMED = {w: k for k, v in NAMES.items() for w in [k, *v.split()]}
PAIRS = [(a, b) for group in (ROMANCE, GERMANIC, EAST) for i, a in enumerate(group) for b in group[i + 1 :]]
MACHINES = [("romance", "germanic"), *PAIRS]
#: Price of a change of language between neighbouring units, in units of score.
CHANGE = 1.2
#: Score of its message's language below which a unit speaks against it.
AGAINST = -1.5
#: Buckets of features; all features have one, some share theirs.
BUCKETS = 1 << 19
#: Messages that a worker should have learned from in a round; where all are fewer it reads them several times.
LEARNED = 30_000
#: Messages in each part of the units, from which one worker learns.
PART = 25_000
#: Distinct tokens that a worker keeps; beyond that it starts afresh, which costs time but changes nothing.
KEPT_TOKENS = 250_000
#: Tokens of units that a worker trains on at once; those of a part's further units train machines of their own.
BLOCK_TOKENS = 8_000_000
#: Sharpnesses of confidences that are tried.
SHARPNESSES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
#: Most labelled texts that may be collected.
SEEDS = 5000
_SCRIPTS = [(0x0400, 0x052F, "ru"), (0x0900, 0x097F, "hi"), (0x0600, 0x06FF, "ar"), (0x0750, 0x077F, "ar"), (0x0E00, 0x0E7F, "th"), (0x3040, 0x30FF, "east"), (0x3400, 0x9FFF, "east")]
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ADDRESS = re.compile(r"\S*(?:@|://|\[at\]|\(at\))\S*|\[at\]\s*\S+|\S+\s*\[at\]", re.I)


def named_language(label: str | None) -> str | None:
    """The language that a label names, or None."""
    if label is None:
        return None
    low = label.strip().lower()
    return _NAMED.get(low) or _NAMED.get(re.split(r"[-_ (]", low, maxsplit=1)[0])


def script_of(word: str) -> str:
    c = ord(word[0])
    if c < 0x250:
        return "latin"
    for a, b, name in _SCRIPTS:
        if a <= c <= b:
            return name
    return "latin"


def _gram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of n-grams, one a row of character codes."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for c in codes.T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words, one word after the other, and their number for each word.

    Of a word these are it itself and its n-grams with its edges; of a stretch of East Asian text its characters, pairs of
    characters, and each kana as such.
    """
    east = np.array(["぀" <= w[0] <= "鿿" for w in words], bool)
    texts = [w if x else f"<{w.lower()}>" for w, x in zip(words, east.tolist(), strict=True)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array(list(map(len, texts)), np.int64)
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(len(codes))  # characters up to the word's end
    of = np.repeat(np.arange(len(words)), size)
    kana = east[of] & (codes >= 0x3040) & (codes <= 0x30FF)
    whole = np.array([zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in texts], np.int32)
    owners, buckets = [np.flatnonzero(~east), of[kana]], [whole[~east], np.zeros(int(kana.sum()), np.int32)]
    for n in (1, 2, 3, 4):
        at = np.flatnonzero((left >= n) & (east[of] if n == 1 else ~east[of] if n > 2 else True))
        owners.append(of[at])
        buckets.append(_gram_buckets(codes[at[:, None] + np.arange(n)]))
    owner = np.concatenate(owners)
    return np.concatenate(buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


_KINDS = ["latin", "ru", "hi", "ar", "th", "east"]


def stretches(sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The numbers of all items of some stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Tokens by number: the buckets of their features, ``sizes`` of these, and their ``letters`` by script."""

    #: Stands between texts that are cut into tokens together.
    BETWEEN = "\0\1\0"

    def __init__(self):
        self.numbers: dict[str, int] = {self.BETWEEN: 0}
        self.buckets, self.begins, self.sizes, self.letters = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(_KINDS)), np.float32)

    def tokens_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of all texts, one text after the other, and how many each text has, at least one."""
        texts = [_ADDRESS.sub(" - ", t) if " @" in t or "@ " in t or "t]" in t or "t)" in t else t for t in texts]  # `_add` passes by addresses of one word
        every = f" {self.BETWEEN} ".join(texts).split()
        if every.count(self.BETWEEN) != len(texts) - 1 or not all(texts):
            return self._one_by_one(texts)
        flat = self._numbered(every)
        cuts = np.flatnonzero(flat == 0)
        sizes = np.diff(np.concatenate([[-1], cuts, [len(flat)]])) - 1
        return (np.delete(flat, cuts), sizes) if sizes.all() else self._one_by_one(texts)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [t.replace(self.BETWEEN, " ").split() or ["-"] for t in texts]
        return self._numbered([w for t in own for w in t]), np.array(list(map(len, own)), np.int64)

    def _numbered(self, tokens: list[str]) -> np.ndarray:
        flat = np.fromiter(map(self.numbers.get, tokens, repeat(-1)), np.int64, len(tokens))
        new = np.flatnonzero(flat < 0)
        if len(new):
            words = [tokens[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(words)))
            flat[new] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return flat

    def _add(self, tokens: list[str]) -> None:
        words, owners, of, kinds, counts = [], [], [], [], []
        for k, token in enumerate(tokens):
            if "@" in token or "://" in token:
                continue
            for w in (token,) if token.isalpha() or "\u0e00" <= token[:1] <= "\u0e7f" else _WORD.findall(token):
                kind = script_of(w)
                of.append(k), kinds.append(_KINDS.index(kind)), counts.append(len(w))
                if kind in ("latin", "east"):
                    words.append(w), owners.append(k)
        letters, sizes = np.zeros((len(tokens), len(_KINDS)), np.float32), np.zeros(len(tokens), np.int64)
        np.add.at(letters, (np.array(of, np.int64), np.array(kinds, np.int64)), counts)
        if words:
            buckets, n = word_buckets(words)
            np.add.at(sizes, owners, n)
            self.buckets = np.concatenate([self.buckets, buckets])
        self.begins = np.concatenate([self.begins, self.begins[-1] + self.sizes[-1] + np.cumsum(sizes) - sizes])
        self.sizes, self.letters = np.concatenate([self.sizes, sizes]), np.concatenate([self.letters, letters])
        first = len(self.numbers)
        self.numbers.update((w, first + k) for k, w in enumerate(tokens))

    def features(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of some tokens, one after the other, and their number for each."""
        sizes = self.sizes[tokens]
        return self.buckets[stretches(sizes, self.begins[tokens])], sizes


def summed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over stretches of rows; none of them is empty."""
    return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) if len(sizes) else np.zeros((0, rows.shape[1]), rows.dtype)


class LanguageModel:
    """Weights of all machines by bucket of features: ``buckets`` that have some, in order, and theirs."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: np.ndarray, vocabulary: Vocabulary | None = None):
        self.buckets, self.bias = buckets, bias
        self.weights = np.concatenate([np.zeros((1, len(MACHINES)), np.float32), weights.astype(np.float32)])
        self.row = np.zeros(BUCKETS, np.int32)
        self.row[buckets] = np.arange(1, len(buckets) + 1)
        #: What scores are multiplied by to be the logarithms of confidences.
        self.sharpness = 1.0
        self.forget(vocabulary)

    def __reduce__(self):  # noqa: ANN204 - what a worker has met is not sent along
        return _language_model, (self.buckets, self.weights[1:], self.bias, self.sharpness)

    def forget(self, vocabulary: Vocabulary | None = None) -> None:
        self.vocabulary = vocabulary or Vocabulary()
        #: A row for each token: sums of weights, number of features, letters by script.
        self.table = np.zeros((0, len(MACHINES) + 1 + len(_KINDS)), np.float32)

    def confidences(self, score: np.ndarray) -> np.ndarray:
        weight = np.exp(self.sharpness * score)
        return weight / weight.sum(1, keepdims=True)

    def _know(self) -> None:
        """A row for each token that the vocabulary has by now."""
        known, vocabulary, m = len(self.table), self.vocabulary, len(MACHINES)
        if known < len(vocabulary.sizes):
            rows = np.zeros((len(vocabulary.sizes) - known, self.table.shape[1]), np.float32)
            rows[:, m], rows[:, m + 1 :] = vocabulary.sizes[known:], vocabulary.letters[known:]
            speak = known + np.flatnonzero(vocabulary.sizes[known:])
            buckets, sizes = vocabulary.features(speak)
            rows[speak - known, :m] = summed(self.weights[self.row[buckets]], sizes)
            self.table = np.concatenate([self.table, rows])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of the languages for each unit, one row a unit; the best is 0 and all others are below."""
        if not texts:
            return np.zeros((0, len(LANGS)))
        if len(self.vocabulary.numbers) > KEPT_TOKENS:
            self.forget()
        return self.scores_of(*self.vocabulary.tokens_of(texts))

    def scores_of(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same of units whose tokens are numbered, one unit after the other."""
        self._know()
        sums = summed(self.table[tokens], sizes).astype(np.float64)
        m = len(MACHINES)
        margin = sums[:, :m] / np.sqrt(np.maximum(sums[:, m : m + 1], 1)) + self.bias
        letters = sums[:, m + 1 :]
        total = np.maximum(letters.sum(1, keepdims=True), 1)
        out = np.full((len(sizes), len(LANGS)), -8.0)
        share = letters / total
        for name, lang in (("ru", "ru"), ("hi", "hi"), ("ar", "ar"), ("th", "th")):
            out[:, _AT[lang]] = np.minimum(0, 20 * (share[:, _KINDS.index(name)] - 0.3))
        latin = np.minimum(0, 20 * (share[:, 0] - 0.7)) * (letters.sum(1) > 0)
        east = np.minimum(0, 20 * (share[:, _KINDS.index("east")] - 0.3))
        # A few letters are little evidence; then the neighbouring units decide.
        weight = np.minimum(1, letters[:, 0] / 30 + letters[:, _KINDS.index("east")] / 8)
        half = lambda z: weight * np.minimum(0, 2 * z)  # noqa: E731 - hinge-like: no loss on the right side of the margin
        family = margin[:, 0]
        at = {pair: k + 1 for k, pair in enumerate(PAIRS)}
        for group, base in ((ROMANCE, latin + half(family)), (GERMANIC, latin + half(-family)), (EAST, east)):
            for lang in group:
                votes = [half(margin[:, at[p]] if p[0] == lang else -margin[:, at[p]]) for p in PAIRS if lang in p]
                out[:, _AT[lang]] = base + np.min(votes, axis=0)
        out[letters.sum(1) == 0] = 0.0
        return np.maximum(out - out.max(1, keepdims=True), -8)


def _language_model(buckets: np.ndarray, weights: np.ndarray, bias: np.ndarray, sharpness: float) -> LanguageModel:
    model = LanguageModel(buckets, weights, bias)
    model.sharpness = sharpness
    return model


#: What each machine is to say of each language: 1, -1, or nothing.
GOALS = np.zeros((len(LANGS), len(MACHINES)), np.float32)
GOALS[[_AT[x] for x in ROMANCE], 0], GOALS[[_AT[x] for x in GERMANIC], 0] = 1, -1
for _k, (_a, _b) in enumerate(PAIRS):
    GOALS[_AT[_a], _k + 1], GOALS[_AT[_b], _k + 1] = 1, -1


class LanguageLearner:
    """All machines at once by averaged stochastic subgradient steps on the hinge loss, some units a step.

    Margins are taken of ``screened`` units at once, more as errors get rare; those that no machine has within its margin
    change nothing, the others are stepped over. ``weight`` has the weight of a unit of each language in each machine, so that both sides of a
    machine count alike.
    """

    def __init__(self, vocabulary: Vocabulary, start: LanguageModel | None = None, weight: np.ndarray | None = None, penalty: float = 1e-4, together: int = 32, screened: int = 128):
        m = len(MACHINES)
        self.vocabulary = vocabulary
        self.w, self.bias = np.zeros((BUCKETS, m), np.float32), np.zeros(m)
        if start is not None:
            self.w[start.buckets], self.bias = start.weights[1:], start.bias.copy()
        self.sums, self.bias_sums, self.t = np.zeros((BUCKETS, m), np.float32), np.zeros(m), 0
        self.goals, self.weight = GOALS.astype(np.float32), np.ones(GOALS.shape, np.float32) if weight is None else weight.astype(np.float32)
        self.penalty, self.together, self.screened = penalty, together, screened
        self.rng = np.random.RandomState(7)
        self.seen = np.zeros(len(LANGS))

    def learn(self, tokens: np.ndarray, sizes: np.ndarray, langs: np.ndarray, epochs: int = 1) -> None:
        """Learn from units: their tokens by number, one unit after the other, how many each has, and their languages."""
        speak = self.vocabulary.sizes[tokens] > 0
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[speak], minlength=len(sizes))
        tokens, begins = tokens[speak], np.cumsum(sizes) - sizes
        able = np.flatnonzero((sizes > 0) & GOALS[langs].any(1))
        self.seen += np.bincount(langs[able], minlength=len(LANGS))
        for _ in range(epochs):
            order = self.rng.permutation(able)
            while len(order):
                part, order = order[: self.screened], order[self.screened :]
                near = np.arange(len(part))
                if self.screened > self.together:
                    z = self._margins(tokens[stretches(sizes[part], begins[part])], sizes[part])[0]
                    near = np.flatnonzero((self._hits(z, langs[part]) != 0).any(1))
                for k in range(0, len(near), self.together):
                    some = near[k : k + self.together]
                    units = part[some]
                    self._step(tokens[stretches(sizes[units], begins[units])], sizes[units], langs[units], self.t + int(some[-1]) + 1)
                self.t += len(part)
                if self.screened > self.together and len(near) * 10 < len(part):
                    self.screened = min(2 * self.screened, 4096)

    def _margins(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Margins of units, and their tokens' distinct ones, which of them each is, and the distinct ones' features."""
        words, which = np.unique(tokens, return_inverse=True)
        buckets, n = self.vocabulary.features(words)
        z = summed(summed(self.w[buckets], n)[which], sizes) / np.sqrt(summed(n[which][:, None], sizes)) + self.bias
        return z, (words, which, buckets, n)

    def _hits(self, z: np.ndarray, langs: np.ndarray) -> np.ndarray:
        y = self.goals[langs]
        return y * (y * z < 1) * self.weight[langs]

    def _step(self, tokens: np.ndarray, sizes: np.ndarray, langs: np.ndarray, t: int) -> None:
        z, (words, which, buckets, n) = self._margins(tokens, sizes)
        hit = self._hits(z, langs)
        rate = 0.5 / (1 + self.penalty * t * 10)
        self.bias += 0.05 * rate * hit.sum(0)
        self.bias_sums += 0.05 * rate * hit.sum(0) * t
        if hit.any():
            own = (rate * hit / np.sqrt(summed(n[which][:, None], sizes))).astype(np.float32)
            by_word = np.argsort(which, kind="stable")
            steps = np.repeat(summed(own[np.repeat(np.arange(len(sizes)), sizes)[by_word]], np.bincount(which)), n, axis=0)
            order = np.argsort(buckets, kind="stable")
            ids = buckets[order]
            heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            step = np.add.reduceat(steps[order], heads, axis=0)
            self.w[ids[heads]] += step
            self.sums[ids[heads]] += step * t

    def averaged(self) -> tuple[np.ndarray, np.ndarray]:
        t = max(1, self.t)
        return self.w - self.sums / t, self.bias - self.bias_sums / t

    def model(self) -> LanguageModel:
        weights, bias = self.averaged()
        buckets = np.flatnonzero(weights.any(1))
        return LanguageModel(buckets, weights[buckets], bias, self.vocabulary)


def train_languages(texts: list[str], langs: list[str], epochs: int = 12, penalty: float = 1e-4) -> LanguageModel:
    """The machines of some texts."""
    vocabulary = Vocabulary()
    learner = LanguageLearner(vocabulary, penalty=penalty, together=1, screened=1)
    learner.learn(*vocabulary.tokens_of(texts), np.array([_AT[x] for x in langs]), epochs)
    return learner.model()


def runs_on(text: str, label: str) -> bool:
    """Whether a unit is running text: not a header, attribution, name or signature line."""
    if label in "HAXM":
        return False
    n = len(text)
    if label in "GCL" or (label == "N" and n > 40) or (label in "QFD" and n > 48 and text[-1] in ".!?…。！？।" and text[0].isalpha()):
        return True  # of the lines that are no running text none looks so
    flags = flags_of(text)
    if label == "S":
        return bool(flags & DISC and flags & SENT)
    if label == "N":
        return not (flags & NAME and not flags & (GREET | CLOSE))
    if flags & (FROM | PHONE | SIGN) or (flags & ATTR and label in "QF") or (flags & KEYED and not flags & (SENT | DISC)):
        return False
    return not (flags & NAME and not flags & (GREET | CLOSE))


def best_path(score: np.ndarray, change: float = CHANGE) -> list[int]:
    """Languages of a sequence of units with a price for each change."""
    n = len(score)
    if n == 1 or (score.argmax(1) == score[0].argmax()).all():
        return score.argmax(1).tolist()
    best, back = score[0], []
    for s in score[1:]:
        top = int(best.argmax())
        jump = best[top] - change
        back.append(np.where(best >= jump, -1, top))
        best = np.maximum(best, jump) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        k = int(b[path[-1]])
        path.append(path[-1] if k < 0 else k)
    return path[::-1]


def named_numbers(labels: list[str | None], kept: dict[str | None, int]) -> np.ndarray:
    """The number of the language that each label names, or -1; ``kept`` are those of labels met before."""
    for x in set(labels) - kept.keys():
        kept[x] = _AT.get(named_language(x), -1)
    return np.array([kept[x] for x in labels], np.int64)


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Number of the row, start, label and text of each unit of a batch of `running_units`."""
    rows = np.repeat(np.arange(batch.num_rows), batch.column("texts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    labels = np.frombuffer("".join(batch.column("labels").to_pylist()).encode(), np.uint8)
    return rows, batch.column("at").flatten().to_numpy(zero_copy_only=False).astype(np.int64), labels, batch.column("texts").flatten().to_numpy(zero_copy_only=False).tolist()


def running_units(staged: DataFrame, events: EventModel, total: int) -> DataFrame:
    """``row_id, language, at, labels, texts``: the units of running text of each message that has some, written once.

    The ``total`` messages are dealt to parts by the hash of ``row_id``, so that every worker learns from messages of all
    kinds whatever order the table has.
    """
    shared = staged.sparkSession.sparkContext.broadcast(events)
    schema = T.StructType([staged.schema["row_id"], staged.schema["language"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("labels", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages = batch.column("message").to_pylist()
            rows, at, end, labels = staged_units(batch, shared.value)
            texts = [messages[r][a:b] for r, a, b in zip(rows.tolist(), at.tolist(), end.tolist(), strict=True)]
            letters = labels.tobytes().decode()
            runs = np.array([runs_on(t, c) for t, c in zip(texts, letters, strict=True)], bool)
            rows, letters = rows[runs], labels[runs].tobytes().decode()
            own, first = np.unique(rows, return_index=True)
            ends = np.append(first[1:], len(rows)).tolist() if len(own) else []
            offsets = pa.array([0, *ends], pa.int32())
            took = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(took), batch.column("language").take(took), pa.ListArray.from_arrays(offsets, pa.array(at[runs], pa.int32())), pa.array([letters[a:b] for a, b in zip(first.tolist(), ends, strict=True)], pa.string()), pa.ListArray.from_arrays(offsets, pa.array([t for t, ok in zip(texts, runs.tolist(), strict=True) if ok], pa.string()))],
                names=schema.names,
            )

    units = staged.filter("not is_count").select("row_id", "language", "message", *(n for n, _ in STAGED)).mapInArrow(run, schema)
    return written(units.repartition(max(1, -(-total // PART)), "row_id").sortWithinPartitions(F.xxhash64("row_id"), "row_id"), "running-units")


class OwnUnits:
    """Of a batch of `running_units` the sender's own units in messages whose label names a language: their tokens by
    number, one unit after the other, ``sizes`` of these, and the label's language ``told``."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: Vocabulary, names: dict[str | None, int]):
        rows, _, labels, texts = columns_of(batch)
        told = named_numbers(batch.column("language").to_pylist(), names)[rows]
        own = (told >= 0) & _IS_NEW[labels]
        rows, labels, self.told, texts = rows[own], labels[own], told[own], list(compress(texts, own.tolist()))
        self.tokens, self.sizes = vocabulary.tokens_of(texts) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if texts else np.zeros(0, np.int64)
        self.long = np.isin(labels, [ord("G"), ord("C")]) | (np.array(list(map(len, texts)), np.int64) >= 12)

    def scores(self, model: LanguageModel) -> np.ndarray:
        return model.scores_of(self.tokens, self.sizes) if len(self.told) else np.zeros((0, len(LANGS)))

    def confirmed(self, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, their numbers and languages of the units that confirm the label: all units of the message together score
        best for it, and the unit does not speak clearly against it, so that the machines learn from the units they were unsure of."""
        if not len(self.told):
            return self.tokens, self.sizes, self.told
        score = self.scores(model)
        agrees = np.repeat(np.add.reduceat(score, self.first, axis=0).argmax(1), np.diff(np.append(self.first, len(score)))) == self.told
        chosen = agrees & self.long & (score[np.arange(len(score)), self.told] > AGAINST)
        return self.tokens[np.repeat(chosen, self.sizes)], self.sizes[chosen], self.told[chosen]


def trained_rounds(blocks: Iterator[tuple[Vocabulary, list[OwnUnits]]], before: LanguageModel, seeds: list[tuple[str, str]], weight: np.ndarray, epochs: int, rounds: int) -> Iterator[tuple[LanguageLearner, np.ndarray]]:
    """The machines that rounds over each block of units give, and how often the units of each language trained them."""
    for vocabulary, units in blocks:
        tokens, sizes = vocabulary.tokens_of([t for t, _ in seeds])
        langs = np.array([_AT[x] for _, x in seeds])
        model = LanguageModel(before.buckets, before.weights[1:], before.bias, vocabulary)
        for _ in range(rounds):
            learner = LanguageLearner(vocabulary, model, weight)
            learner.learn(tokens, sizes, langs)
            chosen = [u.confirmed(model) for u in units]
            learner.learn(*(np.concatenate(x) for x in zip(*chosen, strict=True)), epochs)
            model = learner.model()
        yield learner, learner.seen


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Vocabulary, list[OwnUnits]]]:
    """Units of some batches together, as many as a worker may hold."""
    names: dict[str | None, int] = {}
    vocabulary, units, size = Vocabulary(), [], 0
    for batch in batches:
        units.append(OwnUnits(batch, vocabulary, names))
        size += len(units[-1].tokens)
        if size > BLOCK_TOKENS:
            yield vocabulary, units
            vocabulary, units, size = Vocabulary(), [], 0
    if size:
        yield vocabulary, units


def mixed_rounds(units: DataFrame, model: LanguageModel, seeds: list[tuple[str, str]], totals: np.ndarray, rounds: int) -> LanguageModel:
    """The machines of rounds of training on all units that the machines so far confirm; ``totals`` has the messages of each
    language by their labels."""
    m = len(MACHINES)
    epochs = int(max(1, min(8, -(-LEARNED // max(1, totals.sum())))))
    sides = [((GOALS == s) * totals[:, None]).sum(0) for s in (1, -1)]
    weight = sum((GOALS == s) * np.clip((sides[0] + sides[1]) / np.maximum(2 * own, 1), 0.3, 3) for s, own in zip((1, -1), sides, strict=True))
    shared = units.sparkSession.sparkContext.broadcast((model, seeds, weight))
    names = [f"{x}{i}" for x in "wn" for i in range(m)]

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seeds, weight = shared.value
        for learner, each in trained_rounds(blocks_of(batches), before, seeds, weight, epochs, rounds):
            seen = [((GOALS == s) * each[:, None]).sum(0) for s in (1, -1)]
            mix = np.maximum(np.minimum(*seen), 1e-3)
            weights, bias = learner.averaged()
            weights[before.buckets] -= before.weights[1:]
            moved = np.flatnonzero(weights.any(1))
            change = np.concatenate([weights[moved], [bias - before.bias]]).astype(np.float64)
            table = np.concatenate([change * mix, (change != 0) * mix], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(moved, BUCKETS), pa.int64()), *(pa.array(x) for x in table.T)], names=["bucket", *names])

    found = units.mapInArrow(run, ", ".join(["bucket bigint", *(f"{w} float" for w in names)]))
    table = found.groupBy("bucket").agg(*(F.sum(w).cast("float").alias(w) for w in names)).toArrow()  # at most BUCKETS rows
    if not table.num_rows:
        return model
    at = table.column("bucket").to_numpy()
    change, mix = np.split(np.stack([table.column(x).to_numpy() for x in names], axis=1), 2, axis=1)
    change = change / np.maximum(mix, 1e-9)
    weights = np.zeros((BUCKETS + 1, m), np.float32)
    weights[model.buckets], weights[BUCKETS] = model.weights[1:], model.bias
    weights[at] += change
    buckets = np.flatnonzero(weights[:BUCKETS].any(1))
    return LanguageModel(buckets, weights[buckets], weights[BUCKETS].astype(float))


def fit_languages(units: DataFrame, seeds: list[tuple[str, str]], rounds: int = 2) -> LanguageModel:
    """Rounds of training: on the labelled texts, then on the units of all messages that the machines so far confirm."""
    seeds = [(t, x) for t, x in seeds if t and x in _AT]
    if not seeds:
        return LanguageModel(np.zeros(0, np.int64), np.zeros((0, len(MACHINES)), np.float32), np.zeros(len(MACHINES)))
    model = train_languages(*map(list, zip(*seeds, strict=True)))
    totals = np.zeros(len(LANGS))
    for r in units.groupBy(label_language(F.col("language")).alias("told")).count().collect():  # the languages and null
        if r.told in _AT:
            totals[_AT[r.told]] = r["count"]
    return mixed_rounds(units, model, seeds, totals, rounds)


def calibrate(units: DataFrame, model: LanguageModel) -> None:
    """Choose the sharpness under which the labels of all units are likeliest; one label in twenty may be wrong."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}
        for batch in batches:
            if len(shared.value.vocabulary.numbers) > KEPT_TOKENS:
                shared.value.forget()
            own = OwnUnits(batch, shared.value.vocabulary, known)
            told, score = own.told, own.scores(shared.value)
            gains = []
            for sharpness in SHARPNESSES:
                p = np.exp(sharpness * score)
                gains.append(float(np.log(0.95 * p[np.arange(len(told)), told] / p.sum(1) + 0.05 / len(LANGS)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(SHARPNESSES, pa.float64()), pa.array(gains, pa.float64())], names=["sharpness", "gain"])

    found = units.mapInArrow(run, "sharpness double, gain double").groupBy("sharpness").agg(F.sum("gain").alias("gain")).collect()
    if found and any(r.gain for r in found):
        model.sharpness = max(found, key=lambda r: (round(r.gain, 6), -r.sharpness)).sharpness


class Told:
    """The running units of a batch of `running_units` with their languages, in columns.

    ``rows`` has for each unit the number of its message, ``at`` its start, ``new`` whether the sender wrote it anew,
    ``langs`` the number of its language after smoothing over the message, ``sure`` its confidence. ``first`` has the
    first unit of each message with running text, ``mixed`` whether that message has several languages.
    """

    def __init__(self, batch: pa.RecordBatch, model: LanguageModel):
        self.rows, self.at, labels, texts = columns_of(batch)
        self.new = _IS_NEW[labels]
        score, which = model.scores(texts), np.arange(len(texts))
        if texts:  # a message of numbers or addresses only, which speak for no language, has no running text
            speaks = np.isin(self.rows, self.rows[np.ptp(score, axis=1)[which] > 0])
            self.rows, self.at, self.new, which = (x[speaks] for x in (self.rows, self.at, self.new, which))
        best = score.argmax(1)[which] if len(which) else which
        opens = np.ones(len(which), bool)
        opens[1:] = self.rows[1:] != self.rows[:-1]
        self.first = np.flatnonzero(opens)
        self.ends = np.append(self.first[1:], len(which))
        if len(which):
            several = np.minimum.reduceat(best, self.first) != np.maximum.reduceat(best, self.first)
            for a, b in zip(self.first[several].tolist(), self.ends[several].tolist(), strict=True):
                best[a:b] = best_path(score[which[a:b]])
            self.sure = model.confidences(score)[which, best]
            self.mixed = np.minimum.reduceat(best, self.first) != np.maximum.reduceat(best, self.first)
        else:
            self.sure, self.mixed = np.zeros(0), np.zeros(0, bool)
        self.langs = best


_IS_NEW = np.zeros(256, bool)
_IS_NEW[[ord(c) for c in NEW]] = True


def most(langs: list[int], told: int) -> int:
    """The commonest; a tie goes to the label's language, else to the one met first."""
    counts = Counter(langs)
    top = max(counts.values())
    tied = [x for x in counts if counts[x] == top]
    return told if told in tied else tied[0]


SCHEMA = "row_id bigint, scope string, start_char bigint, lang string, confidence double"


def languages(units: DataFrame, model: LanguageModel, faults_only: bool = False) -> DataFrame:
    """A row of scope ``message`` for each message with running text, and of scope ``segment`` for each of its longest runs
    in one language. ``faults_only``: messages whose label names no or another language, and runs of messages in several."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str | None, int] = {}
        for batch in batches:
            found = Told(batch, shared.value)
            told = named_numbers(batch.column("language").to_pylist(), names)[found.rows[found.first]] if len(found.first) else np.zeros(0, np.int64)
            # Of messages in one language there is no more to say than that and, on demand, that all is one run.
            one = ~found.mixed & ((told != found.langs[found.first]) if faults_only else True) if len(told) else told.astype(bool)
            own = np.maximum(found.new, np.repeat(np.maximum.reduceat(found.new, found.first) == 0, found.ends - found.first)) if len(told) else found.new
            sure, n = (np.add.reduceat(x, found.first) if len(told) else np.zeros(0) for x in (found.sure * own, own.astype(float)))
            every = np.add.reduceat(found.sure, found.first) / (found.ends - found.first) if len(told) else np.zeros(0)
            at = found.first[one]
            rows, scopes, starts, langs, confidence = [found.rows[at]], [np.zeros(len(at), np.int64)], [np.zeros(len(at), np.int64)], [found.langs[at]], [sure[one] / n[one]]
            if not faults_only:
                for to, x in zip((rows, scopes, starts, langs, confidence), (found.rows[at], np.ones(len(at), np.int64), found.at[at], found.langs[at], every[one]), strict=True):
                    to.append(x)
            out: list[tuple[int, int, int, int, float]] = []
            for k in np.flatnonzero(found.mixed).tolist():
                a, b = int(found.first[k]), int(found.ends[k])
                row, units, p = int(found.rows[a]), found.langs[a:b].tolist(), found.sure[a:b].tolist()
                mine = [i for i, x in enumerate(own[a:b].tolist()) if x]
                lang = most([units[i] for i in mine], int(told[k]))
                if not faults_only or lang != told[k]:
                    out.append((row, 0, 0, lang, sum(p[i] for i in mine if units[i] == lang) / len(mine)))
                i = 0
                for j in range(1, len(units) + 1):
                    if j == len(units) or units[j] != units[i]:
                        out.append((row, 1, int(found.at[a + i]), units[i], sum(p[i:j]) / (j - i)))
                        i = j
            for to, x in zip((rows, scopes, starts, langs, confidence), zip(*out, strict=True) if out else ((),) * 5, strict=True):
                to.append(np.array(x, to[0].dtype))
            rows, scopes, starts, langs, confidence = map(np.concatenate, (rows, scopes, starts, langs, confidence))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").take(pa.array(rows, pa.int64())), pa.array(["message", "segment"]).take(pa.array(scopes, pa.int64())), pa.array(starts, pa.int64()), pa.array(LANGS).take(pa.array(langs, pa.int64())), pa.array(confidence, pa.float64())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return units.mapInArrow(run, SCHEMA)


def label_language(label: Column) -> Column:
    """`named_language` as an expression."""
    names = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
    low = F.lower(F.trim(label))
    return F.coalesce(F.element_at(names, low), F.element_at(names, F.split(low, "[-_ (]")[0]))


def detect(samples: DataFrame, lang_samples: DataFrame, faults_only: bool = False) -> DataFrame:
    """All operators together: lines, sentence units, languages; every model comes from all messages."""
    found = lang_samples.select("text", "lang").orderBy("sample_id").limit(SEEDS + 1).collect()
    if len(found) > SEEDS:
        raise ValueError(f"there are more than {SEEDS} labelled texts")
    total = samples.filter(F.length("message") > 0).count()
    staged = stage_messages(samples, fit_line_model(samples, total), keep=("message", "language"))
    units = running_units(staged, fit_events(count_events(staged)), total)
    model = fit_languages(units, [(r.text, named_language(r.lang)) for r in found])
    if not faults_only:  # the faults come without confidence
        calibrate(units, model)
    return languages(units, model, faults_only)


def p5_found(samples: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """Messages whose label is missing or wrong, and the runs of messages in several languages."""
    return detect(samples, lang_samples, faults_only=True).select("row_id", "scope", "start_char", "lang")


def p5_languages(samples: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """Every message and run with its language and confidence."""
    return detect(samples, lang_samples).select("row_id", "scope", "start_char", "lang", "confidence")
