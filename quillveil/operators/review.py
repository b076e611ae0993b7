"""Review of found entities by people: corrections, new pseudonyms, and highlighting as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillveil.operators.entities import choose_pseudonyms, replace_entities

EDITS = "record_id, field_name, sent_idx, ent_idx, action (remove, regroup, reword, insert), entity_group, word, start_char, end_char"


def apply_corrections(entities: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Entities after the edits: ``remove`` drops one, ``regroup`` changes its group (and its pseudonym, if both tables have
    one), ``reword`` its word and span, ``insert`` adds one. ``keys`` name an entity (with its number); one edit at most for
    each. One shuffle on the keys; edits without an entity do nothing unless they insert.

    The span of a reworded entity begins where the new word begins in the old one, or as far before it as the old word
    begins in the new one; where neither holds the other the start stays."""
    named = "pseudonym" in entities.columns and "pseudonym" in edits.columns
    change = edits.filter("action <> 'insert'").select(*keys, "action", F.col("entity_group").alias("_group"), F.col("word").alias("_word"), *([F.col("pseudonym").alias("_pseudonym")] if named else []))
    kept = entities.join(change, keys, "left").filter("action is null or action <> 'remove'")
    regroup, reword = F.col("action") == "regroup", F.col("action") == "reword"
    inside, around = F.call_function("locate", F.col("_word"), F.col("word")), F.call_function("locate", F.col("word"), F.col("_word"))
    start = F.col("start_char") + F.when(inside > 0, inside - 1).when(around > 0, 1 - around).otherwise(F.lit(0))
    changed = {
        "entity_group": F.when(regroup, F.col("_group")),
        "word": F.when(reword, F.col("_word")),
        "start_char": F.when(reword, start),
        "end_char": F.when(reword, start + F.length("_word")),
    } | ({"pseudonym": F.when(regroup, F.col("_pseudonym"))} if named else {})
    edited = kept.select(*[(changed[c].otherwise(F.col(c)) if c in changed else F.col(c)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns])
    added = edits.filter("action = 'insert'").select(*[F.col(c) if c in edits.columns else F.lit(None).alias(c) for c in entities.columns])
    return edited.unionByName(added)


def nth_occurrence(text: Column, word: Column, n: Column | int) -> Column:
    """Start of the n-th occurrence (from 1) of a word, from 0; null if there are fewer."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")))
    n = F.lit(n) if isinstance(n, int) else n
    before = F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, p: a + F.length(p)) + (n - 1) * F.length(word)
    return F.when(F.size(parts) > n, before)


def repseudonymize(sentences: Column, entities: Column, pool: Column) -> Column:
    """Sentences with corrected entities replaced anew: the same choice and fold as in the pipeline."""
    chosen = choose_pseudonyms(entities, pool)
    given = F.zip_with(entities, chosen, lambda e, c: F.struct(e["word"].alias("word"), e["start"].alias("start"), e["end"].alias("end"), e["sent_idx"].alias("sent_idx"), c["p"].alias("pseudonym")))
    return F.transform(sentences, lambda s, k: replace_entities(s, F.filter(given, lambda e: e["sent_idx"] == k)))


def highlight(sentence: Column | str, entities: Column | str, colors: dict[str, str] | None = None) -> Column:
    """HTML of a sentence with a coloured span around each entity ``struct<word, start, end, entity_group>``, in order.

    Only < and > outside of entities are escaped. A group without a colour is light gray. An entity that lacks a member
    is an error.
    """
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    e = F.col(entities) if isinstance(entities, str) else entities
    escape = lambda t: F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        color = F.lit("lightgray")
        for group, c in (colors or {}).items():
            color = F.when(x["entity_group"] == group, F.lit(c)).otherwise(color)
        missing = x["word"].isNull() | x["start"].isNull() | x["end"].isNull() | x["entity_group"].isNull()
        word = F.when(missing, F.raise_error(F.lit("an entity lacks word, start, end or entity_group"))).otherwise(x["word"])
        plain = escape(F.substring(s, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))))
        return F.struct(F.concat(acc["t"], plain, F.lit('<span style="background-color:'), color, F.lit('">'), word, F.lit("</span>")).alias("t"), x["end"].cast("int").alias("at"))

    return F.aggregate(e, zero, step, lambda acc: F.concat(acc["t"], escape(F.substring(s, acc["at"] + 1, F.lit(2**30)))))


def highlight_record(sentences: Column | str, entities: Column | str, colors: dict[str, str] | None = None) -> Column:
    """All sentences of a record, highlighted and joined by line breaks."""
    s = F.col(sentences) if isinstance(sentences, str) else sentences
    e = F.col(entities) if isinstance(entities, str) else entities
    return F.array_join(F.transform(s, lambda t, k: highlight(t, F.filter(e, lambda x: x["sent_idx"] == k), colors)), "<br>")


def place_entities(sentences: Column | str, entities: Column | str) -> Column:
    """``struct<sentences, entities, unplaced>``: entities numbered by other sentences than these, placed in these.

    ``entities`` are ``struct<sent_idx, start, word, entity_group>``. Each of their sentences begins where one of the given
    ones does, in order: at the first place, from that number on, where all its words stand. Given sentences are joined where
    a word lies across their bound. ``unplaced`` counts the entities of sentences without such a place.
    """
    s = F.col(sentences) if isinstance(sentences, str) else sentences
    e = F.col(entities) if isinstance(entities, str) else entities
    text = F.array_join(s, " ")
    starts = F.slice(F.aggregate(s, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(t) + 1))), 1, F.size(s))
    span = "array<struct<word:string,start:int,end:int,entity_group:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        own = F.filter(e, lambda x: x["sent_idx"] == k)
        fits = F.filter(F.slice(starts, k + 1, F.size(s)), lambda b: (b >= acc["at"]) & F.forall(own, lambda x: F.substring(text, b + x["start"] + 1, F.length(x["word"])) == x["word"]))
        at = F.get(fits, F.lit(0))
        made = F.transform(own, lambda x: F.struct(x["word"].alias("word"), (at + x["start"]).cast("int").alias("start"), (at + x["start"] + F.length(x["word"])).cast("int").alias("end"), x["entity_group"].alias("entity_group")))
        return F.when(at.isNull(), acc).otherwise(F.struct((at + 1).cast("int").alias("at"), F.concat(acc["out"], F.array_sort(made, lambda a, b: a["start"] - b["start"])).cast(span).alias("out")))

    numbers = F.array_sort(F.array_distinct(F.transform(e, lambda x: x["sent_idx"])))

    def cut(found: Column) -> Column:
        bounds = F.filter(starts, lambda b: ~F.exists(found, lambda x: (x["start"] < b) & (b < x["end"])))
        parts = F.transform(bounds, lambda b, i: F.substring(text, b + 1, F.coalesce(F.get(bounds, i + 1) - 1, F.length(text)) - b))

        def own(x: Column) -> Column:
            k = F.size(F.filter(bounds, lambda b: b <= x["start"])) - 1
            b = F.get(bounds, k)
            return F.struct(x["word"].alias("word"), (x["start"] - b).alias("start"), (x["end"] - b).alias("end"), x["entity_group"].alias("entity_group"), k.alias("sent_idx"))

        return F.struct(parts.alias("sentences"), F.transform(found, own).alias("entities"), (F.size(e) - F.size(found)).alias("unplaced"))

    return F.aggregate(numbers, zero, step, lambda acc: cut(acc["out"]))
