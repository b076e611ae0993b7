"""The whole pseudonymization of records, as one plan of column expressions around the entity recogniser.

For each field, in order: clean, language, date phrases, sentences, mail masking, entities, pseudonyms, number masking
outside of dates, joining. Records are independent but for the shrinking pool: a pool's name that occurs as a person in
the texts is not given to this or any later record. The first such places are one small aggregation over the entities
(at most a row for each name of the pools); they come back to the plan as literals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillveil import backends
from quillveil.config import Settings
from quillveil.functions import text as X
from quillveil.functions.lang import detect_language
from quillveil.operators import entities as E
from quillveil.operators.dates import DatePatterns, detect_dates
from quillveil.runtime import written

Backend = Callable[[Column], Column]


def prepared(df: DataFrame, settings: Settings, ner: Backend | None, languages: str, patterns: DatePatterns | None, splitter: Backend | None = None) -> DataFrame:
    """Fields cleaned, told apart by language, split and searched: everything before a pseudonym is chosen."""
    for k, f in enumerate(settings.pseudo_fields):
        usable = X.is_usable(F.col(f"`{f}`"), settings.csv_col_unmatched_keyword)
        df = df.withColumn(f"cleaned_{f}", F.when(usable, X.clean_text(F.col(f"`{f}`"))))
        lang = F.lit(settings.default_lang) if settings.default_lang else detect_language(f"cleaned_{f}", languages, options=settings.lang_pipeline if languages == "trans" else None)["lang"]
        dates = detect_dates(f"cleaned_{f}", settings.time_parsing, patterns) if settings.datetime_detection else F.array().cast("array<string>")
        df = df.withColumns({f"_lang{k}": lang, f"_dates{k}": F.coalesce(dates, F.array().cast("array<string>")), f"_sents{k}": (splitter or X.split_sentences)(F.col(f"cleaned_{f}"))})
        masked = F.transform(f"_sents{k}", lambda s: X.mask_emails(s)) if settings.pseudo_emailaddresses else F.col(f"_sents{k}")
        df = df.withColumn(f"_masked{k}", masked)
        found = ner(F.col(f"_masked{k}")) if ner is not None and settings.pseudo_ne else F.lit(None).cast(E.T.ArrayType(E.ENTITY))
        df = df.withColumn(f"_ents{k}", F.coalesce(found, F.array().cast(E.T.ArrayType(E.ENTITY))))
    return df


def _replaced(sentences: Column, given: Column) -> Column:
    return F.transform(sentences, lambda s, i: E.replace_entities(s, F.filter(given, lambda e: e["sent_idx"] == i)))


def _unnumbered(sentences: Column, dates: Column) -> Column:
    return F.transform(sentences, lambda s: X.mask_numbers_except(s, dates))


def pseudonymize(df: DataFrame, settings: Settings, row_id: str = "row_id", ner: Backend | None = None, languages: str | None = None, patterns: DatePatterns | None = None, used_up: str | None = None, splitter: Backend | None = None) -> DataFrame:
    """Records with ``cleaned_*``, ``lang``, ``detected_datetime``, ``sentences``, ``sentences_after_email``, ``ne_list``,
    ``ne_sent`` and ``pseudo_*``. ``row_id``, a whole number, orders the records. Null, empty and unmatched fields stay out of the maps.
    An entity for which the pool has shrunk to nothing is an error, or gets ``used_up`` if that is given.

    What is not given comes from the settings: ``languages`` from `lang_detection_lib` (needed without a default language
    only), ``ner`` from `ner_pipeline`, ``splitter`` from `spacy_model`; where these are unset, there is no recogniser and
    sentences are split by rule."""
    fields, pools = list(settings.pseudo_fields), settings.pseudo_first_names
    languages = languages or settings.lang_detection_lib
    if ner is None and settings.pseudo_ne and settings.ner_pipeline is not None:
        ner = backends.recogniser("transformers", settings.ner_pipeline)
    if splitter is None and settings.spacy_model != "default":
        splitter = backends.sentence_splitter("spacy", model=settings.spacy_model)
    df = prepared(df, settings, ner, languages, patterns, splitter)
    use_ne = ner is not None and settings.pseudo_ne
    seen: list = []
    if use_ne:
        E.pool_for(F.lit(None), pools)  # an empty pool is an error up front
        df = written(df, "prepared-records")
        people = [
            df.select(F.col(row_id).cast("bigint").alias("_row"), F.lit(k).cast("bigint").alias("_field"), E.pool_language(f"_lang{k}", pools).alias("pool_lang"), F.explode(f"_ents{k}").alias("e"))
            .filter("e.entity_group = 'PER'").select("pool_lang", F.col("e.word").alias("word"), "_row", "_field") for k in range(len(fields))
        ]
        seen = E.first_seen(reduce(DataFrame.unionByName, people), pools, ["_row", "_field"]).collect()  # at most the pools' size
    history: Column = F.array().cast(E.CHOSEN)
    for k, f in enumerate(fields):
        if use_ne:
            order = F.struct(F.col(row_id).cast("bigint"), F.lit(k).cast("bigint"))
            pool = E.shrunken_pool(E.pool_for(f"_lang{k}", pools), E.pool_language(f"_lang{k}", pools), seen, order)
            empty = (F.size(f"_ents{k}") > 0) & (F.size(pool) == 0)
            df = df.withColumn(f"_pool{k}", F.when(empty, F.raise_error(F.lit("the pool of pseudonyms is used up")) if used_up is None else F.array(F.lit(used_up))).otherwise(pool))
            df = df.withColumn(f"_chosen{k}", E.choose_pseudonyms(f"_ents{k}", f"_pool{k}", history))
            given = F.zip_with(f"_ents{k}", f"_chosen{k}", lambda e, c: F.struct(e["entity_group"].alias("entity_group"), e["word"].alias("word"), e["start"].alias("start"), e["end"].alias("end"), e["sent_idx"].alias("sent_idx"), c["p"].alias("pseudonym")))
            df = df.withColumn(f"_given{k}", given)
            replaced = _replaced(F.col(f"_masked{k}"), F.col(f"_given{k}"))
            history = F.concat(F.col(f"_chosen{k}"), history)
        else:
            empty_list = F.array().cast("array<struct<entity_group:string,word:string,start:int,end:int,sent_idx:int,pseudonym:string>>")
            df = df.withColumn(f"_given{k}", empty_list)
            replaced = F.col(f"_masked{k}")
        done = _unnumbered(replaced, F.col(f"_dates{k}")) if settings.pseudo_numbers else replaced
        df = df.withColumn(f"pseudo_{f}", X.join_sentences(done))
    used = [(k, f) for k, f in enumerate(fields)]

    def by_field(value: Callable[[int], Column], kind: str) -> Column:
        entries = [F.when(F.col(f"cleaned_{f}").isNotNull(), F.struct(F.lit(f).alias("key"), value(k).alias("value"))) for k, f in used]
        return F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull())).cast(f"map<string,{kind}>")

    entity = "array<struct<entity_group:string,word:string,start:int,end:int,sent_idx:int,pseudonym:string>>"
    df = df.withColumns(
        {
            "lang": by_field(lambda k: F.col(f"_lang{k}"), "string"),
            "sentences": by_field(lambda k: F.col(f"_sents{k}"), "array<string>"),
            "sentences_after_email": by_field(lambda k: F.col(f"_masked{k}"), "array<string>") if settings.pseudo_emailaddresses else F.create_map().cast("map<string,array<string>>"),
            "ne_list": by_field(lambda k: F.col(f"_given{k}"), entity),
            "ne_sent": by_field(lambda k: F.transform(f"_given{k}", lambda e: e["sent_idx"]), "array<int>"),
            "detected_datetime": by_field(lambda k: F.col(f"_dates{k}"), "array<string>") if settings.datetime_detection else F.create_map().cast("map<string,array<string>>"),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith(("_lang", "_dates", "_sents", "_masked", "_ents", "_pool", "_chosen", "_given"))])


def mask_only(text: Column | str) -> Column:
    """Clean, split, mask mail addresses and numbers, join: the pipeline without entities and dates, as one expression."""
    return X.join_sentences(F.transform(X.split_sentences(X.clean_text(text)), lambda s: X.mask_numbers(X.mask_emails(s))))


def timed(steps: dict[str, Callable[[], DataFrame]]) -> dict[str, float]:
    """Seconds of each step, run on its own over all of its rows."""
    import time

    out = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step().write.format("noop").mode("overwrite").save()
        out[name] = time.perf_counter() - start
    return out
