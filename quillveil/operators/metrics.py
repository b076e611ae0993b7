"""Measures of masking and recognition, and the token tools of the evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillveil.functions.text import placeholder_count


def validated_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of tables that are both unique by the keys; a repeated key is an error when the plan runs.

    Each side is grouped by the keys, which checks it, and the groups are joined as they lie: one shuffle a side.
    """

    def unique(side: DataFrame, name: str) -> DataFrame:
        rest = [c for c in side.columns if c not in on]
        once = side.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest, F.lit(0).alias("_"))).alias("_row"))
        fail = F.raise_error(F.lit(f"the {name} table isn't unique by {on}"))
        checked = F.when(F.col("_n") > 1, fail.cast("struct<_ok:int>")).otherwise(F.struct(F.lit(1).alias("_ok")))
        return once.withColumn("_ok", checked["_ok"]).filter("_ok = 1").select(*on, *[F.col("_row")[c].alias(c) for c in rest])

    return unique(left, "left").join(unique(right, "right"), on)


def mask_counts(found: Column | str, gold: Column | str, placeholder: str) -> Column:
    """``struct<tp, fp, fn>`` from the numbers of placeholders in a masked text and in the right one."""
    a, b = placeholder_count(found, placeholder), placeholder_count(gold, placeholder)
    return F.struct(F.least(a, b).alias("tp"), F.greatest(a - b, F.lit(0)).alias("fp"), F.greatest(b - a, F.lit(0)).alias("fn"))


def set_counts(found: Column | str, gold: Column | str) -> Column:
    """``struct<tp, fp, fn>`` of two sets given as arrays."""
    a, b = (F.array_distinct(F.coalesce(F.col(x) if isinstance(x, str) else x, F.array())) for x in (found, gold))
    return F.struct(F.size(F.array_intersect(a, b)).alias("tp"), F.size(F.array_except(a, b)).alias("fp"), F.size(F.array_except(b, a)).alias("fn"))


def scores(counts: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1, 0 where undefined, and the share of rows without any error."""
    t, p, n = F.sum(tp), F.sum(fp), F.sum(fn)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    grouped = counts.groupBy(*(by or []))
    return grouped.agg(
        t.alias("tp"), p.alias("fp"), n.alias("fn"), ratio(t, t + p).alias("precision"), ratio(t, t + n).alias("recall"), ratio(2 * t, 2 * t + p + n).alias("f1"),
        F.avg(((F.col(fp) == 0) & (F.col(fn) == 0)).cast("double")).alias("exact"),
    )


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used inside of lambdas."""
    return F.transform(F.array(value), use)[0]


def bio_spans(tags: Column | str) -> Column:
    """``array<struct<type, first, last>>`` of entity spans from BIO tags; an I without its B opens a span.

    Firsts and lasts are picked by their neighbours alone, so a text costs its length once.
    """

    def spans(t: Column) -> Column:
        at = lambda k: F.get(t, k)
        inside = lambda k: F.coalesce(F.substring(at(k), 1, 1) != "O", F.lit(False))
        goes_on = lambda k: F.coalesce((F.substring(at(k), 1, 1) == "I") & (k > 0) & inside(k - 1) & (F.substring(at(k), 3, 1000) == F.substring(at(k - 1), 3, 1000)), F.lit(False))
        numbers = F.transform(t, lambda x, k: k)
        firsts = F.filter(numbers, lambda k: inside(k) & ~goes_on(k))
        lasts = F.filter(numbers, lambda k: inside(k) & ~goes_on(k + 1))
        return F.zip_with(firsts, lasts, lambda a, b: F.struct(F.substring(at(a), 3, 1000).alias("type"), a.alias("first"), b.alias("last")))

    return bound(F.col(tags) if isinstance(tags, str) else tags, spans)


def token_offsets(sentence: Column | str, tokens: Column | str) -> Column:
    """``array<struct<token, start, end>>``: each token's place in the sentence, searched from the end of the one before; -1 if it isn't there."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    zero = F.struct(F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.call_function("locate", x, s, acc["at"])
        start = F.when(hit > 0, hit - 1).otherwise(F.lit(-1))
        end = F.when(hit > 0, hit - 1 + F.length(x)).otherwise(F.lit(-1))
        return F.struct(F.concat(acc["out"], F.array(F.struct(x.alias("token"), start.alias("start"), end.alias("end")))).alias("out"), F.when(hit > 0, hit + F.length(x)).otherwise(acc["at"]).alias("at"))

    return F.aggregate(t, zero, step, lambda acc: acc["out"])


def parse_iob_line(line: Column | str) -> Column:
    """``struct<tokens, tags>`` of a line ``BOS w1 w2 .. EOS <tab> O t1 t2 .. intent``."""
    x = F.col(line) if isinstance(line, str) else line
    halves = F.split(x, "\t")
    words, tags = F.split(F.trim(halves[0]), r"\s+"), F.split(F.trim(F.get(halves, F.lit(1))), r"\s+")
    inner = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))
    return F.struct(inner(words).alias("tokens"), inner(tags).alias("tags"))
