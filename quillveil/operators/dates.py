"""Date and time phrases in running text, found by a grammar of patterns.

Strict: a date must be followed by a time, at most two separators later. Non-strict: dates, times, weekdays and small
numbers count, neighbours are merged over the usual separators, and phrases without a digit are dropped. Only what can be
a day of the calendar or a time of the day counts. `detect_dates` is one native expression; `detect_by_steps` does the
same step by step: find parts of several and of single words, unite those that overlap, sort, merge, filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillveil.functions.text import DIGIT

MONTHS = (
    "janvier février fevrier mars avril mai juin juillet août aout septembre octobre novembre décembre decembre janv févr avr juil sept oct nov déc "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre ene abr ago dic "
    "janeiro fevereiro março maio junho julho setembro outubro novembro dezembro jan fev mai jun jul set out dez "
    "januar februar märz april juni juli august september oktober november dezember feb mär okt "
    "january february march may june july october december mar apr aug sep dec"
).split()
WEEKDAYS = (
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim lunes martes miércoles jueves viernes sábado domingo mié jue vie sáb dom "
    "segunda-feira terça-feira quarta-feira quinta-feira sexta-feira montag dienstag mittwoch donnerstag freitag samstag sonntag "
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun"
).split()
_MONTH = "(?:" + "|".join(sorted(set(MONTHS), key=lambda w: (-len(w), w))) + r")\b\.?"
_WEEKDAY = r"\b(?:" + "|".join(sorted(set(WEEKDAYS), key=lambda w: (-len(w), w))) + r")\b"
# Words and marks that may stand between two parts of one phrase.
SEPARATORS = ("at", "um", "à", ",", ".", "-", ".,", "a las")
_MARKS = "|".join(re.escape(x) for x in sorted((x for x in SEPARATORS if not x[0].isalpha()), key=len, reverse=True))
_WORDS = "|".join(sorted((x for x in SEPARATORS if x[0].isalpha()), key=len, reverse=True))
_GAP = rf"(?:\s*(?:{_MARKS})\s*|\s+(?:{_WORDS})\s+|\s+)"
_DAY, _MONTH_NO = r"(?:3[01]|[12]\d|0?[1-9])", r"(?:1[0-2]|0?[1-9])"
TIME = r"(?:2[0-3]|[01]?\d):[0-5]\d(?::[0-5]\d)?"
_OFFSET = r"[+\-]\d{4}\b"
_WORDED = [rf"\b{_DAY}\.?\s+{_MONTH}\s+\d{{4}}\b", rf"\b{_MONTH}\s+{_DAY}(?:st|nd|rd|th)?,?\s+\d{{4}}\b"]
_YEAR_FIRST = rf"\b\d{{4}}[-/]{_MONTH_NO}[-/]{_DAY}(?!\d)"
_YEAR_LAST = rf"(?<![\d./])(?:{_DAY}(?P<A>[./]){_MONTH_NO}|{_MONTH_NO}(?P<B>[./]){_DAY})[./](?:\d{{4}}|\d{{2}})(?!\d)".replace("(?P<A>[./])", "[./]").replace("(?P<B>[./])", "[./]")
#: A time after a date, where a point will do, too; and a bare hour right behind the date.
_STRICT_TIME = rf"(?:(?<![\d:]){TIME}(?![\d:])|(?<![\d.])(?:2[0-3]|[01]?\d)\.[0-5]\d(?![\d.]))"
_BARE_HOUR = r"[ \t]+(?:2[0-3]|[01]?\d)(?![\w:$%€£]|[.,\-/]\d|\s\d)"


@dataclass
class DatePatterns:
    """The registry of date patterns by mode; times are added to the strict ones by the grammar."""

    patterns: dict[str, list[str]] = field(
        default_factory=lambda: {mode: [*_WORDED, _YEAR_FIRST, _YEAR_LAST] for mode in ("strict", "non-strict")}
    )

    def add(self, pattern: str, mode: str) -> None:
        if not isinstance(pattern, str) or not pattern:
            raise ValueError("a pattern must be a non-empty regular expression")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"a pattern must be a regular expression: {e}") from e
        if pattern in self.patterns[mode]:
            raise ValueError("the pattern is there already")
        self.patterns[mode].append(pattern)

    def remove(self, pattern: str, mode: str) -> None:
        if pattern not in self.patterns[mode]:
            raise ValueError("there is no such pattern")
        self.patterns[mode].remove(pattern)

    def dates(self, mode: str) -> str:
        """Dates, which are of several words or of one; in strict mode with their time."""
        date = "(?:" + "|".join(self.patterns[mode]) + ")"
        if mode == "strict":
            return rf"{date}(?:(?:\s*(?:[,.\-]|\b(?:{_WORDS}|le|the|el)\b)?\s*){{0,2}}{_STRICT_TIME}(?:\s+{_OFFSET})?|{_BARE_HOUR})"
        return date

    def words(self) -> str:
        """What is no date by itself: times, offsets, weekdays, small numbers."""
        number = r"(?<![\w.,/:+\-])\d{1,2}(?![\w/:$%€£]|[.,\-]\d)"
        return rf"(?:(?<![\d:.]){TIME}(?![\d:])|{_OFFSET}|{_WEEKDAY}|{number})"

    def regex(self, mode: str) -> str:
        if mode == "strict":
            return "(?iu)" + self.dates(mode)
        part = rf"(?:{self.dates(mode)}|{self.words()})"
        return rf"(?iu){part}(?:{_GAP}{part})*"


def detect_dates(text: Column | str, mode: str = "strict", patterns: DatePatterns | None = None) -> Column:
    """``array<string>`` of the date phrases of a text, in order; null for null."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(t, F.lit((patterns or DatePatterns()).regex(mode)), F.lit(0))
    return only_with_digit(found) if mode != "strict" else found


def find_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end>>`` of all matches of a pattern, in order."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"), end.alias("at"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def detect_by_steps(text: Column | str, patterns: DatePatterns | None = None) -> Column:
    """The phrases of `detect_dates` in non-strict mode, by its steps one after the other."""
    t = F.col(text) if isinstance(text, str) else text
    p = patterns or DatePatterns()
    dates = unite_overlapping(sort_spans(find_spans(t, "(?iu)" + p.dates("non-strict"))))
    words = F.filter(find_spans(t, "(?iu)" + p.words()), lambda w: ~F.exists(dates, lambda d: (w["start"] < d["end"]) & (d["start"] < w["end"])))
    merged = merge_spans(t, sort_spans(F.concat(dates, words)))
    return only_with_digit(F.transform(merged, lambda x: F.substring(t, x["start"] + 1, x["end"] - x["start"])))


def only_with_digit(phrases: Column | str) -> Column:
    """Drop phrases without any digit (weekdays alone and the like)."""
    p = F.col(phrases) if isinstance(phrases, str) else phrases
    return F.filter(p, lambda x: x.rlike(DIGIT))


def parse_time(text: Column | str) -> Column:
    """Timestamp of a numeric or worded date phrase, month first where both readings are possible; null if it is none."""
    t = F.trim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"(?<=\d)(?:st|nd|rd|th)\b|,|\b(?:um|at|à|a las)\b", " "))
    t = F.regexp_replace(t, r"\s+", " ")
    names = {"jan": 1, "ene": 1, "fév": 2, "fev": 2, "feb": 2, "mar": 3, "mär": 3, "avr": 4, "abr": 4, "apr": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6, "juil": 7, "jul": 7, "aoû": 8, "aou": 8, "aug": 8, "ago": 8, "sep": 9, "set": 9, "oct": 10, "okt": 10, "out": 10, "nov": 11, "déc": 12, "dec": 12, "dez": 12, "dic": 12}
    word = F.regexp_extract(t, r"(\p{L}{3,})", 1)
    number = F.lit(None).cast("int")
    for k, v in names.items():
        number = F.when(word.startswith(k), F.lit(v)).otherwise(number)
    day_first = F.concat_ws("-", F.regexp_extract(t, r"(\d{4})", 1), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, r"\b(\d{1,2})\b", 1), 2, "0"))
    worded = F.when((word != "") & number.isNotNull() & t.rlike(r"\d{4}"), F.concat_ws(" ", day_first, F.coalesce(F.nullif(F.regexp_extract(t, r"(\d{1,2}:\d{2}(?::\d{2})?)", 1), F.lit("")), F.lit("00:00"))))
    tries = [F.try_to_timestamp(worded, F.lit(f)) for f in ("yyyy-MM-dd H:mm:ss", "yyyy-MM-dd H:mm")]
    for d in ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M.d.yyyy", "d/M/yyyy", "d.M.yyyy", "d/M/yy"):
        tries += [F.try_to_timestamp(t, F.lit(d + tail)) for tail in ("", " H:mm", " H:mm:ss")]
    return F.coalesce(*tries)


def sort_spans(spans: Column | str) -> Column:
    """Spans ``struct<start, end>`` by start, then end."""
    s = F.col(spans) if isinstance(spans, str) else spans
    return F.array_sort(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))


def unite_overlapping(spans: Column | str) -> Column:
    """Unite a sorted span with the next one where they touch; a united pair is not united with a third."""
    s = F.col(spans) if isinstance(spans, str) else spans
    zero = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(False).alias("fresh"))

    def step(acc: Column, x: Column) -> Column:
        last, size = F.element_at(acc["done"], -1), F.size(acc["done"])
        x = F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
        joined = F.struct(F.least(last["start"], x["start"]).alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (size > 0) & acc["fresh"] & (last["end"] >= x["start"])
        return F.when(touches, F.struct(F.concat(F.slice(acc["done"], 1, F.greatest(size - 1, F.lit(0))), F.array(joined)).alias("done"), F.lit(False).alias("fresh"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(x)).alias("done"), F.lit(True).alias("fresh"))
        )

    return F.aggregate(s, zero, step, lambda acc: acc["done"])


def mergeable(gap: Column) -> Column:
    """Whether the text between two spans lets them be one phrase."""
    return gap.rlike(rf"^(?:{_GAP})?$")


def merge_spans(text: Column | str, spans: Column | str) -> Column:
    """Merge sorted spans from left to right over the usual separators; ``array<struct<start, end>>``. What comes in is a
    part of a date or time each, so what is merged is one, too."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.col(spans) if isinstance(spans, str) else spans

    def step(acc: Column, x: Column) -> Column:
        last, size = F.element_at(acc, -1), F.size(acc)
        x = F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
        gap = F.substring(t, last["end"] + 1, F.greatest(x["start"] - last["end"], F.lit(0)))
        joined = F.struct(last["start"].alias("start"), x["end"].alias("end"))
        return F.when((size > 0) & (x["start"] >= last["end"]) & mergeable(gap), F.concat(F.slice(acc, 1, F.greatest(size - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(s, F.array().cast("array<struct<start:int,end:int>>"), step)
