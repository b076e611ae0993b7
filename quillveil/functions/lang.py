"""Language of a text: guarded dispatch over backends, and runs of one language over sentences.

The default backend counts stop words with native expressions. Optional model backends are Arrow UDFs that import their
library on the worker; they are looked up by name, and a missing library is reported as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillveil.backends import factory, load, register
from quillveil.functions.text import detectable
from quillveil.runtime import written

# A few very common words of each language; ties go to the language that stands first.
STOPWORDS = {
    "en": ["the", "and", "of", "to", "is", "in", "you", "for", "that", "with", "are", "this", "have", "not", "was"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "pour", "dans", "que", "vous", "du", "au", "pas", "nous"],
    "es": ["el", "los", "las", "y", "del", "una", "para", "con", "que", "por", "es", "lo", "su", "al", "mi"],
    "pt": ["o", "os", "as", "e", "do", "da", "uma", "para", "com", "que", "não", "em", "está", "na", "se"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "für", "mit", "den", "wir", "zu", "auf", "ich"],
}
# Languages that a model of another one serves; all others without a model fall back to German's.
MODEL_OF = {"gl": "pt"}
#: Rows of a range in `language_runs`.
RANGE_ROWS = 1_000_000
MODELS = ("en", "fr", "es", "pt", "de", "it", "ru", "zh", "ja")


def constrain(languages: list[str], supported: list[str]) -> list[str]:
    """Languages to tell apart: the wanted ones that are supported. None wanted: all; none left: an error."""
    if not languages:
        return supported
    kept = [x for x in supported if x in set(languages)]
    if not kept:
        raise ValueError(f"none of {languages} is supported")
    return kept


def stopword_language(text: Column | str, languages: list[str] | None = None) -> Column:
    """``struct<lang, prob>``: the language with most stop words, and its share of all hits; lang is null without a hit.

    Each word is looked up in a hash set for each language; the lists of words and of hits are bound once.
    """
    t = F.col(text) if isinstance(text, str) else text
    langs = constrain(languages or [], list(STOPWORDS))
    nothing = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("prob"))

    def number(words: Column, lang: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(STOPWORDS[lang])))

    def hits(words: Column) -> Column:
        return F.array(*[F.struct(number(words, k).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("lang")) for i, k in enumerate(langs)])

    def decided(h: Column) -> Column:
        best = F.array_max(h)
        return F.when(best["n"] > 0, F.struct(best["lang"].alias("lang"), (best["n"] / F.aggregate(h, F.lit(0), lambda a, s: a + s["n"])).alias("prob"))).otherwise(nothing)

    longest = max(len(w) for k in langs for w in STOPWORDS[k])
    words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: F.length(w) <= longest)
    return F.transform(F.array(F.transform(F.array(words), hits)[0]), decided)[0]


def _langid(languages: tuple[str, ...] = (), **_: str):  # noqa: ANN202
    from langid.langid import LanguageIdentifier, model

    identifier = LanguageIdentifier.from_modelstring(model, norm_probs=True)
    if languages:
        identifier.set_languages(list(languages))
    return lambda text: [identifier.classify(text)]


def _langdetect(languages: tuple[str, ...] = (), **_: str):  # noqa: ANN202
    import langdetect

    langdetect.DetectorFactory.seed = 0
    wanted = set(languages)
    return lambda text: [(r.lang, r.prob) for r in langdetect.detect_langs(text) if not wanted or r.lang in wanted]


def _transformer(languages: tuple[str, ...] = (), task: str = "text-classification", model: str = "default", **options: str):  # noqa: ANN202
    from transformers import pipeline

    classify = pipeline(task, model=None if model == "default" else model, top_k=None, **options)
    wanted = set(languages)
    return lambda text: [(r["label"], float(r["score"])) for r in classify(text, truncation=True) if not wanted or r["label"] in wanted]


register("langid", _langid)
register("langdetect", _langdetect)
register("trans", _transformer)


def _library(name: str, languages: tuple[str, ...], options: dict[str, str]):  # noqa: ANN202
    """An Arrow UDF around a registered detector: texts to ranked lists of ``lang, prob``; loaded once a worker."""
    make = factory(name)  # sent along, so that detectors registered on the driver work

    @F.pandas_udf("array<struct<lang:string,prob:double>>")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = load(name, make, languages=languages, **options)
        for texts in batches:
            yield pd.Series([[(str(lang), float(p)) for lang, p in one(t)] if isinstance(t, str) else [] for t in texts])

    return detect


def ranked_languages(text: Column | str, backend: str, languages: list[str] | None = None, options: dict[str, str] | None = None) -> Column:
    """``array<struct<lang, prob>>`` of a model backend, most probable first; empty where no language can be told.

    Texts without anything to tell are null when they reach the model, so it does not run on them.
    """
    t = F.col(text) if isinstance(text, str) else text
    found = _library(backend, tuple(languages or ()), options or {})(F.when(detectable(t), t))
    return F.array_sort(found, lambda a, b: F.coalesce(F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1), F.lit(0)))


def detect_language(text: Column | str, backend: str = "stopwords", languages: list[str] | None = None, options: dict[str, str] | None = None) -> Column:
    """``struct<lang, prob>`` for texts whose language can be told, else (null, 0). Unknown backends are an error."""
    t = F.col(text) if isinstance(text, str) else text
    none = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("prob"))
    if backend == "stopwords":
        return F.when(detectable(t), stopword_language(t, languages)).otherwise(none)
    return F.coalesce(F.get(ranked_languages(t, backend, languages, options), F.lit(0)), none)


def model_language(lang: Column | str) -> Column:
    """Language whose model serves a language; unknown and null ones: German."""
    x = F.col(lang) if isinstance(lang, str) else lang
    for k, v in MODEL_OF.items():
        x = F.when(x == k, F.lit(v)).otherwise(x)
    return F.when(x.isin(*MODELS), x).otherwise(F.lit("de"))


def language_runs(sentences: DataFrame, key: str, idx: str, lang: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``key, begin, end, lang``: runs of equal language over sentence numbers, half open; null is a language of its own.

    A key may hold any share of the rows. So numbers are cut into ranges of about ``range_rows`` rows (by approximate
    quantiles over all keys), runs are found within key and range, and those at the edges of ranges are put together by
    one row for each key and range.
    """
    rows = sentences.select(F.col(key).alias("_key"), F.col(idx).alias("_at"), F.col(lang).alias("_lang"))
    total = rows.count()
    n_ranges = max(1, -(-total // range_rows))
    cuts = sorted(set(rows.select(F.col("_at").cast("double").alias("x")).approxQuantile("x", [k / n_ranges for k in range(1, n_ranges)], 0.1 / n_ranges))) if n_ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_at").cast("double"))) if cuts else F.lit(0)
    w = Window.partitionBy("_key", "_part").orderBy("_at")
    changed = (~F.col("_lang").eqNullSafe(F.lag("_lang").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("_part", part).withColumn("_run", F.sum(changed).over(w).cast("int"))
    runs = marked.groupBy("_key", "_part", "_run").agg(F.min("_at").alias("begin"), F.max("_at").alias("last"), F.first("_lang").alias("_lang"))
    if not cuts:
        return runs.select(F.col("_key").alias(key), "begin", (F.col("last") + 1).alias("end"), F.col("_lang").alias("lang"))
    runs = written(runs, "language-runs")
    edges = runs.groupBy("_key", "_part").agg(F.max("_run").alias("n"), F.min_by(F.struct("_lang"), "_run").alias("head"), F.max_by(F.struct("_lang"), "_run").alias("tail"))
    by_part = Window.partitionBy("_key").orderBy("_part")  # a row for each range
    joins = F.lag("tail").over(by_part)["_lang"].eqNullSafe(F.col("head")["_lang"]) & F.lag("_part").over(by_part).isNotNull()
    edges = edges.withColumn("joins", joins)
    own = F.when((F.col("n") > 1) | ~F.col("joins"), F.struct(F.col("_part").alias("p"), F.col("n").alias("r")))
    edges = edges.withColumn("open", F.last(own, ignorenulls=True).over(by_part)).withColumn("before", F.lag("open").over(by_part))
    joined = edges.filter("joins").select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "before")
    named = runs.join(joined, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    run = F.when((F.col("_run") == 1) & F.col("before").isNotNull(), F.col("before")).otherwise(F.struct(F.col("_part").alias("p"), F.col("_run").alias("r")))
    whole = named.groupBy("_key", run.alias("_id")).agg(F.min("begin").alias("begin"), F.max("last").alias("last"), F.first("_lang").alias("_lang"))
    return whole.select(F.col("_key").alias(key), "begin", (F.col("last") + 1).alias("end"), F.col("_lang").alias("lang"))
