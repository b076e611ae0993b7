"""Normalise mixed timestamp texts to one UTC instant.

A large table repeats few ways to write a date, and often the very same text. So the work is split in three:

1. the distinct triples of text, home zone and date order become a dictionary, with the number of rows of each;
2. only triples that the persisted dictionary lacks are parsed, once each, by an Arrow-batched parser that tries every
   known form; the result is appended to the dictionary (`TimestampDictionary.update`);
3. instants are joined back to the rows, hot texts by broadcast, all others by a shuffle on the triple.

Defined results: a null, blank, relative, incomplete or impossible text has no instant. A text without zone or offset
takes the home zone; if that is null or unknown, there is no instant. A date alone means its midnight. A local time that
occurs twice means its first occurrence; one that is skipped is read with the offset before the change. Dates with
slashes follow the date order (``mdy`` or ``dmy``, null: the only possible reading, else day first) unless the year
leads; dates with dots or dashes are day first unless the year leads. Two-digit years are 20xx. Bare counts of seconds,
milli-, micro- or nanoseconds since 1970 are UTC. Fractions below the microsecond are cut. An hour without minutes ("5pm",
"17h") and a second of 60 are no instant. Zone abbreviations of several meanings are read in one: CST as US Central, IST
as Indian, BST as British Summer Time, EST, MST and PST as North American.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillveil.runtime import HOT_SHARE, broadcast_checked, fresh_path, lookup_join, written

# Month names and their usual short forms, January first; accents are removed before the lookup.
_MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "fr_short": "janv fevr mars avr mai juin juil aout sept oct nov dec",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es_short": "ene feb mar abr may jun jul ago sept oct nov dic",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "pt_short": "jan fev mar abr mai jun jul ago set out nov dez",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "de_short": "jan feb mrz apr mai jun jul aug sept okt nov dez",
    "de_at": "janner feber maerz april mai juni juli august september oktober november dezember",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "it_short": "gen feb mar apr mag giu lug ago set ott nov dic",
    "gl": "xaneiro febreiro marzo abril maio xuno xullo agosto setembro outubro novembro decembro",
    "gl_short": "xan feb mar abr mai xun xul ago set out nov dec",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru_short": "янв фев мар апр мая июн июл авг сен окт ноя дек",
    "ru_plain": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "hi": "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर",
    "ar": "يناير فبراير مارس ابريل مايو يونيو يوليو اغسطس سبتمبر اكتوبر نوفمبر ديسمبر",
    "th": "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม",
}
# Zone abbreviations as minutes east of UTC.
_ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "ist": 330, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480,
    "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180, "brst": -120, "art": -180, "cot": -300, "clt": -240, "clst": -180,
    "pet": -300, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "sast": 120, "ict": 420, "gst": 240, "pkt": 300, "hora": None,
}


def _plain(text: str) -> str:
    """Lower case without accents; marks of scripts that need them stay."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "̀" <= c <= "ͯ")


_MONTH = {_plain(unicodedata.normalize("NFKC", w)): n for names in _MONTHS.values() for n, w in enumerate(names.split(), 1)}
_TIME = r"(?P<h>\d{1,2})(?::|h|\.(?=\d\d(?:\D|$)))(?P<mi>\d{2})(?:(?::|m|\.)(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*(?P<ap>[ap]\.?\s?m\b\.?)?"
_ZONE = r"(?P<zone>\[[^\]]+\]|[a-z]+(?:/[a-z_+\-0-9]+)+|(?:utc|gmt)?\s?[+\-−]\d{1,2}(?::?\d{2})?(?::?\d{2})?(?:\s?\[[^\]]+\])?|[a-z]{1,5})"
_TAIL = rf"(?:(?:[t\s,]|\s(?:at|um|a|as|ore|alle|om|kl|в|को)\s|a las\s|alle ore\s|-)*{_TIME}(?:\s?(?:h|uhr|horas))?\s*{_ZONE}?)?\s*(?:\([^)]*\))?$"
_WEEKDAY = r"(?:[^\W\d]+\.?,?\s+(?=\d))?"
_FORMS = [
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}}){_TAIL}",
        rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_TAIL}",
        rf"(?P<y>\d{{4}})\.(?P<m>\d{{1,2}})\.(?P<d>\d{{1,2}})\.?{_TAIL}",
        rf"{_WEEKDAY}(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}}|\d{{2}}){_TAIL}",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})[.](?P<m>\d{{1,2}})[.](?P<y>\d{{4}}|\d{{2}}){_TAIL}",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})-(?P<m>\d{{1,2}})-(?P<y>\d{{4}}|\d{{2}}){_TAIL}",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|º|ª|er|st|nd|rd|th)?[\s\-]+(?:de\s+|of\s+)?(?P<mon>[^\W\d_]\w*)\.?,?[\s\-]+(?:de\s+|del\s+)?(?P<y>\d{{4}}|\d{{2}})(?:\s?г\.?)?{_TAIL}",
        rf"(?:[^\W\d]+\.?,?\s+)?(?P<mon>[^\W\d_]\w*)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}",
        rf"(?:[^\W\d]+\.?,?\s+)?(?P<mon>[^\W\d_]\w*)\.?\s+(?P<d>\d{{1,2}})\s+{_TIME}\s+(?:(?P<zone>[a-z]{{1,5}}|[+\-]\d{{4}})\s+)?(?P<y>\d{{4}})$",
        rf"(?P<y>\d{{4}})\s?[年년]\s?(?P<m>\d{{1,2}})\s?[月월]\s?(?P<d>\d{{1,2}})\s?[日일号]?(?:\s?\(?[月火水木金土日一二三四五六]\)?)?{_TAIL}",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:[t\s]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?\s*(?P<zone>z|utc|gmt|[+\-]\d{2}:?\d{2})?)?$",
    )
]
_EPOCH = re.compile(r"(\d{9,19})(?:[.,](\d{1,9}))?$")
_UNIT = {9: 10**6, 10: 10**6, 12: 10**3, 13: 10**3, 15: 1, 16: 1}
_OFFSET = re.compile(r"([+\-])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?")
_EPOCH_DAY = datetime(1970, 1, 1)
_NAMES: dict[str, str] = {}


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    """A region of the time zone database; letter case doesn't matter."""
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - bad keys raise several kinds
        if not _NAMES:
            from zoneinfo import available_timezones

            _NAMES.update({x.lower(): x for x in available_timezones()})
        return ZoneInfo(_NAMES[name.lower()]) if name.lower() in _NAMES else None


@lru_cache(maxsize=65536)
def _micros_of_day(zone: str, year: int, month: int, day: int) -> tuple[int, ...] | None:
    """UTC offset in seconds at each hour mark of a local day, or a single one when it doesn't change that day."""
    info = _zone(zone)
    if info is None:
        return None
    at = datetime(year, month, day)
    first, last = at.replace(tzinfo=info).utcoffset(), (at + timedelta(days=1)).replace(tzinfo=info).utcoffset()
    return (int(first.total_seconds()),) if first == last else ()


def _local_micros(at: datetime, zone: str) -> int | None:
    """Microseconds since 1970 UTC of a local time; fold 0 is the first occurrence, or the offset before a gap."""
    day = _micros_of_day(zone, at.year, at.month, at.day)
    if day is None:
        return None
    offset = day[0] if day else int(at.replace(tzinfo=_zone(zone)).utcoffset().total_seconds())
    return (at - _EPOCH_DAY) // timedelta(microseconds=1) - offset * 10**6


def parse_instant(text: str | None, home_zone: str | None, date_order: str | None) -> int | None:
    """Microseconds since 1970-01-01 UTC that a text names, or None. See the module's docstring for the rules."""
    if text is None:
        return None
    s = text.strip().lower() if text.isascii() else _plain(unicodedata.normalize("NFKC", text)).strip()
    s = re.sub(r"\s+", " ", s.strip("‎‏﻿\"'<>"))
    if (m := _EPOCH.match(s)) and len(m[1]) not in (14,):
        n, fraction = len(m[1]), m[2]
        if n in (18, 19) and not fraction:
            return int(m[1]) // 1000
        unit = _UNIT.get(n)
        if unit is None:
            return None
        micros = int(m[1]) * unit
        return micros + int(fraction.ljust(9, "0")[:9]) * unit // 10**9 if fraction else micros
    for form in _FORMS:
        if m := form.match(s):
            found = _instant(m.groupdict(), home_zone, date_order)
            if found is not False:
                return found
    return None


def _instant(g: dict, home_zone: str | None, date_order: str | None) -> int | None | bool:
    """The instant of one match; False if another form may still fit."""
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("mon") is not None:
        month = _MONTH.get(g["mon"].strip("."))
        if month is None:
            return False
        day = int(g["d"])
    elif g.get("a") is not None:
        a, b = int(g["a"]), int(g["b"])
        month_first = date_order == "mdy" or (date_order != "dmy" and b > 12 >= a)
        month, day = (a, b) if month_first else (b, a)
    else:
        month, day = int(g["m"]), int(g["d"])
    hour, minute, second, micro = int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0), int((g.get("f") or "").ljust(6, "0")[:6])
    if half := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half[0] == "p" else 0)
    try:
        at = datetime(year, month, day, hour, minute, second, micro)
    except ValueError:
        return None
    zone = (g.get("zone") or "").strip()
    if zone:
        if offset := _OFFSET.search(zone.replace("−", "-")) if "/" not in zone.split("[")[0] else None:
            hours, minutes, seconds = int(offset[2]), int(offset[3] or 0), int(offset[4] or 0)
            if hours > 18 or minutes > 59:
                return None
            shift = (hours * 3600 + minutes * 60 + seconds) * (-1 if offset[1] == "-" else 1)
            return (at - _EPOCH_DAY) // timedelta(microseconds=1) - shift * 10**6
        name = zone.strip("[]")
        if name in _ZONES:
            return None if _ZONES[name] is None else (at - _EPOCH_DAY) // timedelta(microseconds=1) - _ZONES[name] * 60 * 10**6
        return _local_micros(at, name)
    return _local_micros(at, home_zone) if home_zone else None


KEYS = ["raw", "zone", "date_order"]
_ARROW = pa.schema([("raw", pa.string()), ("zone", pa.string()), ("date_order", pa.string()), ("utc_micros", pa.int64())])
SCHEMA = "raw string, zone string, date_order string, utc_micros bigint"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, zone, order = (batch.column(k) for k in KEYS)
        found = [parse_instant(t, z or None, o or None) for t, z, o in zip(raw.to_pylist(), zone.to_pylist(), order.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([raw, zone, order, pa.array(found, pa.int64())], schema=_ARROW)


def timestamp_keys(rows: DataFrame, text: Column, zone: Column, order: Column) -> DataFrame:
    """Add the dictionary's key columns. Null zones and orders become '' so that they join; null texts stay null."""
    return rows.withColumns({"raw": text, "zone": F.coalesce(zone, F.lit("")), "date_order": F.coalesce(order, F.lit(""))})


#: To be raised with every change of what `parse_instant` gives, so that texts are parsed anew.
PARSER_VERSION = 1


class TimestampDictionary:
    """The persisted dictionary of parsed timestamp texts: a Parquet table that grows by appends.

    ``path`` None: a new, empty one in the shared work folder. Texts already in it, also those without an instant, are
    never parsed again by the same version of the parser; each version has its own table below the path. An append that
    was repeated, or two at once, may write an entry twice: entries are unique by their key when they are read, as equal
    keys have equal instants.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, f"{path or fresh_path(spark, 'timestamps')}/parser-{PARSER_VERSION}"

    def _stored(self) -> DataFrame:
        """The appended rows as they are."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def entries(self) -> DataFrame:
        return self._stored().groupBy(*KEYS).agg(F.max("utc_micros").alias("utc_micros"))

    def update(self, counted: DataFrame) -> DataFrame:
        """Parse the triples of ``counted`` that are new, append them, and return all entries."""
        known = self._stored()
        new = counted.select(*KEYS) if known.isEmpty() else counted.select(*KEYS).join(known.select(*KEYS), KEYS, "left_anti")
        new.mapInArrow(_parse_batches, SCHEMA).write.mode("append").parquet(self.path)
        return self.entries()


def normalize_timestamps(rows: DataFrame, text: str, zone: Column, order: Column, dictionary: TimestampDictionary, keep: list[str]) -> DataFrame:
    """Rows that name an instant: the columns ``keep`` and ``utc_micros``.

    One shuffle counts the distinct triples (combined on the map side first), one joins the instants back. Both move
    only the key columns and ``keep``.
    """
    keyed = timestamp_keys(rows, F.col(text), zone, order).filter(F.col("raw").isNotNull()).select(*keep, *KEYS)
    counted = written(keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")), "timestamp-counts")
    entries = dictionary.update(counted)
    total = counted.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    # Only a hot text needs its count afterwards; those above the share are few, so this side is small at any size.
    hot = F.broadcast(counted.filter(F.col("n_rows") > total * HOT_SHARE))
    weighed = entries.filter(F.col("utc_micros").isNotNull()).join(hot, KEYS, "left").fillna(0, ["n_rows"])
    return lookup_join(keyed, weighed, KEYS, "n_rows", total).select(*keep, "utc_micros")


def p1_found(spark: SparkSession, samples: DataFrame, mailboxes: DataFrame, path: str | None = None) -> DataFrame:
    """``row_id, utc_micros`` of each sample whose ``date`` names an instant; ``path``: a dictionary kept between runs."""
    homes = mailboxes.select(F.col("mailbox").alias("sender"), F.col("home_zone").alias("_zone"), F.col("date_order").alias("_order")).dropna(subset=["sender"]).dropDuplicates(["sender"])
    rows = samples.select("row_id", "date", "sender").join(broadcast_checked(homes), "sender", "left")
    return normalize_timestamps(rows, "date", F.col("_zone"), F.col("_order"), TimestampDictionary(spark, path), ["row_id"])
