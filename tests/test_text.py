import pytest
from pyspark.sql import functions as F

from quillveil.functions import lang as L
from quillveil.functions import text as X
from quillveil.operators import dates as D


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "masked"),
    [  # fixed values: texts and what the masks make of them
        ("Contact us at support@example.com or sales@example.com.", "Contact us at [email] or [email]."),
        ("@user and a@name stay", "@user and a@name stay"),
        ("éa@b.de", "éa@b.de"),
        ("", ""),
        (None, None),
    ],
)
def test_emails(spark, text, masked):
    assert one(spark, text, X.mask_emails) == masked


def test_numbers(spark):
    assert one(spark, "My phone number is 123-456-7890.", X.mask_numbers) == "My phone number is [number]-[number]-[number]."
    assert one(spark, "² ① ½ ٣", X.mask_numbers) == "[number] [number] ½ [number]"
    keep = lambda dates: lambda t: X.mask_numbers_except(t, F.array(*map(F.lit, dates)).cast("array<string>"))
    assert one(spark, "The test date is 27.03.2025 13:37 with number 123-456-789.", keep(["27.03.2025 13:37"])) == "The test date is 27.03.2025 13:37 with number [number]-[number]-[number]."
    assert one(spark, "27.03.202512345", keep(["27.03.2025"])) == "27.03.2025"
    assert one(spark, "a 1 b", keep([])) == "a [number] b"


def test_cleaning(spark):
    assert one(spark, "  a \n\n \xa0\n b\t", X.clean_text) == "a\nb"
    assert one(spark, "One. Two! (Three?) four", X.split_sentences) == ["One.", "Two!", "(Three?)", "four"]
    assert one(spark, "", X.split_sentences) == []
    assert one(spark, "jean-pierre O'NEIL", X.title_case) == "Jean-Pierre O'Neil"
    assert one(spark, "a <b>bold</b> &amp; <script>x</script>c", X.html_to_text) == "a bold & c"
    assert one(spark, "1 < 2 & 3", X.html_to_text) == "1 < 2 & 3"


@pytest.mark.parametrize(("text", "ok"), [("hello", True), ("...", False), ("12 34.", False), ("a@b c@d", False), ("a@b\nfoo", False), ("https://a.bc/x", False), ("", False), (None, False), ("see https://a.bc", True)])
def test_guard(spark, text, ok):
    assert one(spark, text, X.detectable) is ok


def test_languages(spark):
    assert one(spark, "le chat et la souris dans une maison", L.stopword_language).lang == "fr"
    assert one(spark, "xyz", L.stopword_language).lang is None
    with pytest.raises(ValueError):
        L.constrain(["xx"], ["fr"])
    with pytest.raises(ValueError):
        L.detect_language(F.lit("a"), "unknown")
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(["fr", "fr", None, "de"])], "doc int, idx int, lang string")
    assert sorted(map(tuple, L.language_runs(rows, "doc", "idx", "lang").collect())) == [(1, 0, 2, "fr"), (1, 2, 3, None), (1, 3, 4, "de")]


def test_date_steps(spark):
    spans = lambda *p: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in p])
    assert [tuple(x) for x in one(spark, "x", lambda t: D.unite_overlapping(spans((0, 3), (3, 5), (5, 7))))] == [(0, 5), (5, 7)]
    assert [tuple(x) for x in one(spark, "ven. 14 mars 2025, 10:30 x 9", lambda t: D.merge_spans(t, spans((0, 3), (5, 17), (19, 24), (27, 28))))] == [(0, 24), (27, 28)]
    assert str(one(spark, "14 mars 2025 à 10:30", D.parse_time)) == "2025-03-14 10:30:00"
    assert str(one(spark, "10.03.2025", D.parse_time)) == "2025-10-03 00:00:00"
    assert str(one(spark, "17/02/2009", D.parse_time)) == "2009-02-17 00:00:00"
    patterns = D.DatePatterns()
    for bad in ("", None, patterns.patterns["strict"][0]):
        with pytest.raises(ValueError):
            patterns.add(bad, "strict")
    with pytest.raises(ValueError):
        patterns.remove("nothing", "strict")
