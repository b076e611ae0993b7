"""Reading level of documents by regularised ordinal regression, calibrated to graded texts.

Features of a document: lexical diversity, word rarity in the corpus' own frequencies, share of connectives, a proxy of
clause depth (commas, connectives and relative words in a sentence), lengths of words and sentences, and how the words
are spread over short and long sentences. They are standardised within each language over all documents.

The model is a proportional-odds logistic regression with an L2 penalty: one weight vector for all languages and an
ordered pair of thresholds. Raters err at times, so a document's ratings are all used and the penalty keeps single wrong
ones from being fitted. It is fitted on the driver on at most ``sample_labels`` ratings, chosen by a hash of the
document; everything else covers all documents. Scoring is a native expression.

Defined results: null, empty and blank texts and languages other than the five have no band (null); so has everything
when no ratings exist. Ties of a rating count as they are. Duplicate ids keep a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm.batches import uncollected
from quillveil.runtime import written

BANDS = ["basic", "middle", "advanced"]
LANGUAGES = ["fr", "es", "pt", "en", "de"]
SAMPLE_LABELS = 20_000
#: A word is frequent when it makes up at least this share of its language's words; so there are at most 1 / FREQUENT of them.
FREQUENT = 5e-5

# Connectives and clause-opening words by language; those of several words are phrases by themselves.
CONNECTIVES = {
    "fr": "que,qui,dont,lorsque,puisque,quoique,afin,cependant,toutefois,néanmoins,car,donc,ainsi,parce,considérant,à mesure,de sorte,bien que,où,lequel,laquelle,lesquels,lesquelles,tandis,si,comme,quand,mais,or,selon",
    "es": "que,quien,cuyo,cuya,cuando,porque,aunque,sin embargo,no obstante,puesto,pues,así,mientras,donde,a medida,considerando,cual,cuales,si,como,pero,según,ya,dado que,salvo",
    "pt": "que,quem,cujo,cuja,quando,porque,embora,contudo,todavia,portanto,assim,enquanto,onde,à medida,considerando,qual,quais,se,como,mas,conforme,dado que,uma vez,salvo",
    "en": "that,which,who,whose,when,because,although,though,however,nevertheless,notwithstanding,whereas,while,given,considering,insofar,unless,since,if,as,but,thus,therefore,hence,such,so",
    "de": "dass,das,welche,welcher,welches,wenn,weil,obwohl,obgleich,jedoch,dennoch,daher,somit,während,wobei,sofern,soweit,indem,damit,ob,als,aber,da,insofern,angesichts,sodass,wonach",
}
FEATURES = ["ttr", "rarity", "rare_share", "connectives", "commas", "word_len", "long_words", "sentence_len", "sentence_mass", "short_mass", "long_mass", "brief_mass", "short_share", "long_share", "log_words"]
_CONNECTIVES = {k: frozenset(w for w in v.split(",") if " " not in w) for k, v in CONNECTIVES.items()}
_PHRASES = {k: tuple(f" {w} " for w in v.split(",") if " " in w) for k, v in CONNECTIVES.items()}
# A period after an initial or a short capitalised title ends no sentence, nor does one before a small letter.
_SENTENCE = re.compile(r"(?:(?<!\b[^\W\d_])(?<!\b[A-ZÁÉ][a-z])(?<!\b[A-ZÁÉ][a-z]{2})\.|[!?…。])[.!?…]*[\"'»”)]*\s+(?![a-zà-ÿ])|\n+")
_EDGE = "\"'«»“”„‘’()[].,;:!?…-–—*"


def text_features(text: str, lang: str, shares: dict[str, float]) -> list[float] | None:
    """The features in the order of FEATURES; None if the text has no word."""
    words = [w for w in (x.strip(_EDGE).lower() for x in text.split()) if w and w[0].isalpha()]
    if not words:
        return None
    n, link = len(words), _CONNECTIVES[lang]
    floor = np.log(FREQUENT)
    logs = [shares.get(w, floor) for w in words]
    lengths = [len(s.split()) for s in _SENTENCE.split(text)]
    lengths = [k for k in lengths if k] or [1]
    total = sum(lengths)
    # Type-token ratio over windows of 40 words, so that it doesn't fall with the length.
    steps = range(0, max(1, n - 39), 20)
    ttr = sum(len(set(words[a : a + 40])) / len(words[a : a + 40]) for a in steps) / len(steps)
    linked = sum(w in link for w in words)
    if _PHRASES[lang]:
        joined = f" {' '.join(words)} "
        linked += sum(joined.count(p) for p in _PHRASES[lang])
    return [
        ttr, -sum(logs) / n, sum(x <= floor for x in logs) / n, linked / len(lengths), text.count(",") / len(lengths), sum(map(len, words)) / n, sum(len(w) >= 9 for w in words) / n,
        float(np.log(total / len(lengths))), float(np.log(sum(k * k for k in lengths) / total)), sum(k for k in lengths if k <= 7) / total, sum(k for k in lengths if k >= 22) / total, sum(k for k in lengths if k <= 4) / total,
        sum(k <= 7 for k in lengths) / len(lengths), sum(k >= 22 for k in lengths) / len(lengths), float(np.log(n)),
    ]


def word_shares(documents: DataFrame) -> DataFrame:
    """``lang, word, log_share`` of the frequent words of each language, counted over all documents.

    Counts are combined on the map side, so the commonest words cost no more than others. By its definition the result
    has at most ``1 / FREQUENT`` rows a language.
    """
    words = documents.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}'’\-]+")).alias("word")).filter(F.col("word").rlike(r"^\p{L}"))
    counts = written(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= F.col("total") * FREQUENT).select("lang", "word", F.log(F.col("n") / F.col("total")).alias("log_share"))


def document_features(documents: DataFrame, shares: dict[str, dict[str, float]]) -> DataFrame:
    """``doc_id, lang, n_words`` and the features of documents in the five languages that have a word."""
    known = documents.sparkSession.sparkContext.broadcast(shares)
    schema = "doc_id bigint, lang string, n_words int, " + ", ".join(f"{f} double" for f in FEATURES)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, counts, rows = [], [], [], []
            for i, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x := text_features(text, lang, known.value.get(lang, {}))) is not None:
                    ids.append(i), langs.append(lang), counts.append(len(text.split())), rows.append(x)
            made = np.array(rows, np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(counts, pa.int32()), *(pa.array(made[:, k]) for k in range(len(FEATURES)))], names=["doc_id", "lang", "n_words", *FEATURES])

    wanted = documents.filter(F.col("lang").isin(LANGUAGES) & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text", "lang")
    return wanted.mapInArrow(run, schema)


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a proportional-odds model; ``y`` holds 0..k-1. Full-batch Adam, no randomness."""
    k, (n, d) = int(max(y.max() + 1, 2)), x.shape
    w, base, gaps = np.zeros(d), np.array([-1.0]), np.zeros(k - 2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, base, gaps)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        cut = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        z = x @ w
        upper = np.where(y < k - 1, sigmoid(cut[np.minimum(y, k - 2)] - z), 1.0)
        lower = np.where(y > 0, sigmoid(cut[np.maximum(y - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_cut = np.zeros(k - 1)
        np.add.at(g_cut, np.minimum(y, k - 2), -up * (y < k - 1))
        np.add.at(g_cut, np.maximum(y - 1, 0), low * (y > 0))
        grads = (x.T @ (up - low) / n + penalty * w / n, np.array([g_cut.sum() / n]), np.array([g_cut[j + 1 :].sum() / n * np.exp(gaps[j]) for j in range(k - 2)]))
        for param, grad, (m, v) in zip((w, base, gaps), grads, moments, strict=True):
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.999 * v + 0.001 * grad * grad
            param -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w, np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def reading_levels(documents: DataFrame, labels: DataFrame, sample_labels: int = SAMPLE_LABELS, penalty: float = 1.0) -> DataFrame:
    """``doc_id, lang, n_words, score, band`` of each document in the five languages with at least one word."""
    documents = documents.select("doc_id", "text", "lang")
    shares: dict[str, dict[str, float]] = {}
    for r in word_shares(documents.filter(F.col("lang").isin(LANGUAGES))).collect():  # bounded by FREQUENT
        shares.setdefault(r.lang, {})[r.word] = r.log_share
    features = written(document_features(documents, shares), "reading-features")
    stats = features.groupBy("lang").agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES])
    scaled = features.join(F.broadcast(stats), "lang").select("doc_id", "lang", "n_words", *[((F.col(f) - F.col(f"m_{f}")) / F.greatest(F.col(f"s_{f}"), F.lit(1e-6))).alias(f) for f in FEATURES])
    rated = labels.filter(F.col("band").isin(BANDS) & F.col("doc_id").isNotNull()).select("doc_id", "band").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_labels)
    train = scaled.join(F.broadcast(rated), "doc_id").select("band", *FEATURES).toPandas()  # at most sample_labels rows
    if train.empty:
        return scaled.select("doc_id", "lang", "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("band"))
    w, cut = fit_ordinal(train[FEATURES].to_numpy(), train["band"].map(BANDS.index).to_numpy(), penalty)
    if len(cut) < len(BANDS) - 1:  # the highest band has no rating
        cut = np.concatenate([cut, np.full(len(BANDS) - 1 - len(cut), 1e9)])
    score = sum((F.col(f) * F.lit(float(c)) for f, c in zip(FEATURES, w, strict=True)), F.lit(0.0))
    # The most likely band: with the middle band's interval narrow enough its own probability never wins, so compare all three.
    below, beyond = 1 / (1 + F.exp(score - F.lit(float(cut[0])))), 1 / (1 + F.exp(F.lit(float(cut[1])) - score))
    middle = 1 - below - beyond
    band = F.when((below >= middle) & (below >= beyond), "basic").when(beyond >= middle, "advanced").otherwise("middle")
    return scaled.select("doc_id", "lang", "n_words", score.alias("score"), band.alias("band"))


def p9_found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, band`` of documents with at least 40 words in one of the five languages."""
    return reading_levels(documents, labels).filter(F.col("n_words") >= 40).select("doc_id", "band")
