"""Named entities: a gazetteer recogniser, pseudonym choice, replacement, and the pool of pseudonyms.

An entity is ``struct<entity_group, word, start, end, score, sent_idx>``; offsets count code points of the sentence in
which mail addresses are masked already. Choice and replacement are folds inside a row, so equal names of a record get
equal pseudonyms without any shuffle; the shrinking pool is one small aggregation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.functions.text import title_case

ENTITY = T.StructType([T.StructField("entity_group", T.StringType()), T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("sent_idx", T.IntegerType())])
# What stands for an entity of each group that is no person.
PLACEHOLDERS = {"LOC": "[location]", "ORG": "[organization]", "MISC": "[misc]"}
#: Entries of a gazetteer that may be sent to the workers; its size is checked.
GAZETTEER_ROWS = 200_000


def gazetteer_backend(spark: SparkSession, gazetteer: DataFrame, max_rows: int = GAZETTEER_ROWS):  # noqa: ANN201
    """A function from a column of sentences to a column of entities, for words that the gazetteer lists.

    The longest entry wins where several fit; matches lie at word bounds. The gazetteer is collected only if it has at
    most ``max_rows`` entries, else it is an error.
    """
    rows = gazetteer.select("word", "entity_group").dropna().distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"the gazetteer has more than {max_rows} entries")
    shared = spark.sparkContext.broadcast(sorted((r.word, r.entity_group) for r in rows if r.word.strip()))

    @F.pandas_udf(T.ArrayType(ENTITY))
    def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, group in shared.value:
            automaton.add_word(word, (word, group))
        automaton.make_automaton()
        for column in batches:
            yield pd.Series([_entities(s, automaton) for s in column])

    return recognise


def _in_word(c: str) -> bool:
    """Whether a character continues a word; vowel signs do."""
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def _entities(sentences, automaton) -> list[dict] | None:  # noqa: ANN001
    if sentences is None:
        return None
    out = []
    for k, s in enumerate(sentences):
        if not s or not len(automaton):
            continue
        hits = sorted(((end - len(word) + 1, end + 1, word, group) for end, (word, group) in automaton.iter(s)), key=lambda h: (h[0], -h[1]))
        last = 0
        for a, b, word, group in hits:
            if a < last or (a and _in_word(s[a - 1])) or (b < len(s) and _in_word(s[b])):
                continue
            out.append({"entity_group": group, "word": word, "start": a, "end": b, "score": 1.0, "sent_idx": k})
            last = b
    return out


def gazetteer_matches(tokens: DataFrame, gazetteer: DataFrame, token: str = "token") -> DataFrame:
    """Rows of tokens that are single entries of the gazetteer, with its group: a native join, spread by the token."""
    entries = gazetteer.select(F.col("word").alias(token), "entity_group").dropna().distinct()
    return tokens.join(entries, token)


def pool_for(lang: Column | str, pools: dict[str, list[str]]) -> Column:
    """The ordered pool of a language; a language without one gets the first language's."""
    if not pools or not any(pools.values()):
        raise ValueError("there is no pool of pseudonyms")
    first = next(iter(pools))
    x = F.col(lang) if isinstance(lang, str) else lang
    out = F.array(*map(F.lit, pools[first]))
    for k, names in pools.items():
        out = F.when(x == k, F.array(*map(F.lit, names))).otherwise(out)
    return out


def pool_language(lang: Column | str, pools: dict[str, list[str]]) -> Column:
    x = F.col(lang) if isinstance(lang, str) else lang
    return F.when(x.isin(*pools), x).otherwise(F.lit(next(iter(pools))))


def _met(before: Column, word: Column) -> Column:
    """Stand-in of the first entity with this word."""
    return F.get(F.filter(before, lambda u: u["w"] == word), F.lit(0))["p"]


CHOSEN = "array<struct<w:string,g:string,p:string>>"


def choose_pseudonyms(entities: Column | str, pool: Column | str, previous: Column | None = None) -> Column:
    """The entities of a field with their pseudonyms: ``array<struct<w, g, p>>`` in order.

    A word met before in this field, else in earlier fields of the record (``previous``), as it is, in small letters or
    in title case, gets the same stand-in. A new person gets the pool's name at the number of persons met so far in the
    field, or the first one when the pool ends. Other groups get their placeholders, unknown groups that of MISC.
    """
    e = F.col(entities) if isinstance(entities, str) else entities
    names = F.col(pool) if isinstance(pool, str) else pool
    earlier = previous if previous is not None else F.array().cast(CHOSEN)

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc, earlier)
        met = [_met(before, v) for v in (x["word"], F.lower(x["word"]), title_case(x["word"]))]
        fresh = F.coalesce(F.get(names, F.size(F.filter(acc, lambda u: u["g"] == "PER"))), F.get(names, F.lit(0)))
        group = x["entity_group"]
        stand_in = F.when(group == "PER", F.coalesce(*met, fresh))
        for g, text in PLACEHOLDERS.items():
            stand_in = stand_in.when(group == g, F.lit(text))
        return F.concat(acc, F.array(F.struct(x["word"].alias("w"), group.alias("g"), stand_in.otherwise(F.lit(PLACEHOLDERS["MISC"])).alias("p"))))

    return F.aggregate(e, F.array().cast(CHOSEN), step)


def replace_entities(sentence: Column | str, entities: Column | str) -> Column:
    """Replace ``struct<word, start, end, pseudonym>`` from left to right; offsets shift by the lengths of the words."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    e = F.col(entities) if isinstance(entities, str) else entities
    zero = F.struct(s.alias("t"), F.lit(0).alias("o"))

    def step(acc: Column, x: Column) -> Column:
        a, b = F.greatest(x["start"] + acc["o"], F.lit(0)), F.greatest(x["end"] + acc["o"], F.lit(0))
        made = F.concat(F.substring(acc["t"], F.lit(1), a), x["pseudonym"], F.substring(acc["t"], b + 1, F.lit(2**30)))
        return F.struct(made.alias("t"), (acc["o"] + F.length(x["pseudonym"]) - F.length(x["word"])).alias("o"))

    return F.aggregate(e, zero, step, lambda acc: acc["t"])


def first_seen(mentions: DataFrame, pools: dict[str, list[str]], order: list[str]) -> DataFrame:
    """``pool_lang, name, seen``: the first place, by ``order``, where a pool's name is a person of the texts.

    ``mentions`` holds persons as ``word``, the order columns and, if only names of a text's own pool count, ``pool_lang``. A pool's name is met when it equals the
    word's first token, as it is, in small letters or in title case. The result has at most a row for each pool entry,
    so the aggregation's map side does nearly all of the work.
    """
    spark = mentions.sparkSession
    entries = spark.createDataFrame([(k, n) for k, names in pools.items() for n in dict.fromkeys(names)], "pool_lang string, name string")
    token = F.split(F.col("word"), " ")[0]
    variants = mentions.withColumn("name", F.explode(F.array_distinct(F.array(token, F.lower(token), title_case(token)))))
    return variants.join(F.broadcast(entries), [c for c in ("pool_lang", "name") if c in variants.columns]).groupBy("pool_lang", "name").agg(F.min(F.struct(*order)).alias("seen"))


def shrunken_pool(pool: Column, pool_lang: Column, seen: list, order: Column) -> Column:  # noqa: ANN001
    """The pool without the names met at or before this place; ``seen`` are the rows of `first_seen`, ``order`` a struct of bigints. Order and repeats stay."""
    if not seen:
        return pool
    places = F.array(*[F.struct(F.lit(r.pool_lang).alias("k"), F.lit(r.name).alias("n"), F.struct(*[F.lit(int(v)).cast("bigint") for v in r.seen]).alias("at")) for r in seen])
    gone = F.transform(F.filter(places, lambda s: (s["k"] == pool_lang) & (s["at"] <= order)), lambda s: s["n"])
    return F.filter(pool, lambda n: ~F.array_contains(gone, n))


def entities_by_sentence(entities: Column | str, n_sentences: Column) -> Column:
    """``map<string, array<entity>>`` from the number of a sentence to its entities; sentences without any are left out."""
    e = F.col(entities) if isinstance(entities, str) else entities
    keys = F.sequence(F.lit(0), F.greatest(n_sentences - 1, F.lit(0)))
    pairs = F.transform(keys, lambda k: F.struct(k.cast("string").alias("key"), F.filter(e, lambda x: x["sent_idx"] == k).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))
