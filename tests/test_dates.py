"""Date phrases inside one sentence, and the steps of their detection."""

import pytest
from pyspark.sql import functions as F

from quillveil.operators import dates as D

SENTENCE = "Alice sera présente le {} et apportera 100$."
# Phrase, what is found in it without a time being required, what is found with one.
PHRASES = [
    ("02/17/2009", ["02/17/2009"], []),
    ("17/02/2009", ["17/02/2009"], []),
    ("2009/02/17", ["2009/02/17"], []),
    ("12 mars 2025", ["12 mars 2025"], []),
    ("2/17/2009", ["2/17/2009"], []),
    ("17/2/2009", ["17/2/2009"], []),
    ("2009/2/17", ["2009/2/17"], []),
    ("09 février 2009", ["09 février 2009"], []),
    ("2025-03-12", ["2025-03-12"], []),
    ("2025-03-01", ["2025-03-01"], []),
    ("2025-11-20", ["2025-11-20"], []),
    ("ven. 14 mars 2025, 10:30", ["ven. 14 mars 2025, 10:30"], ["14 mars 2025, 10:30"]),
    ("vendredi 14 mars 2025 à 10:30", ["vendredi 14 mars 2025 à 10:30"], ["14 mars 2025 à 10:30"]),
    ("14/03/2025 10:30", ["14/03/2025 10:30"], ["14/03/2025 10:30"]),
    ("14/03/2025 à 10:30", ["14/03/2025 à 10:30"], ["14/03/2025 à 10:30"]),
    ("2025-03-14 10:30", ["2025-03-14 10:30"], ["2025-03-14 10:30"]),
    ("le 14 mars 2025", ["14 mars 2025"], []),
    ("ce vendredi 14 mars 2025", ["vendredi 14 mars 2025"], []),
    ("2 avril 2015", ["2 avril 2015"], []),
    ("6/12/25", ["6/12/25"], []),
    ("17/04/2024 um 17:23 Uhr", ["17/04/2024 um 17:23"], ["17/04/2024 um 17:23"]),
    ("Mittwoch, 17. April 2024 um 17:23 Uhr", ["Mittwoch, 17. April 2024 um 17:23"], ["17. April 2024 um 17:23"]),
    ("mié., 17 abr. 2024 17:20:18 +0200", ["mié., 17 abr. 2024 17:20:18 +0200"], ["17 abr. 2024 17:20:18 +0200"]),
    ("Wednesday, April 17th 2024 at 17:23", ["Wednesday, April 17th 2024 at 17:23"], ["April 17th 2024 at 17:23"]),
    ("el 24 a las 3", ["24 a las 3"], []),
    ("Mittwoch, 17. April 2024 17:02", ["Mittwoch, 17. April 2024 17:02"], ["17. April 2024 17:02"]),
    ("am Mittwoch, 17. April 2024 um 16:58:57", ["Mittwoch, 17. April 2024 um 16:58:57"], ["17. April 2024 um 16:58:57"]),
    ("17.04.2024 17:33:23", ["17.04.2024 17:33:23"], ["17.04.2024 17:33:23"]),
]


def test_phrases(spark):
    df = spark.createDataFrame([(k, SENTENCE.format(p)) for k, (p, _, _) in enumerate(PHRASES)], "k int, t string").coalesce(1)
    rows = sorted(df.select("k", D.detect_dates("t", "non-strict").alias("any"), D.detect_dates("t").alias("strict")).collect())
    assert [(PHRASES[r.k][0], r.any, r.strict) for r in rows] == PHRASES


@pytest.mark.parametrize(
    ("phrase", "strict"),
    [
        ("17.04.24 10:30", ["17.04.24 10:30"]),
        ("2025/03/12 10:30", ["2025/03/12 10:30"]),
        ("14 mars 2025 17.30", ["14 mars 2025 17.30"]),
        ("09 février 2009 10", ["09 février 2009 10"]),
        ("09 février 2009 10 000", []),
        ("1.2.3 4:50", []),
    ],
)
def test_strict_times(spark, phrase, strict):
    assert spark.range(1).select(D.detect_dates(F.lit(f"x {phrase} y")).alias("x")).first().x == strict


def test_null_and_empty(spark):
    row = spark.createDataFrame([(None, "")], "a string, b string").select(D.detect_dates("a").alias("a"), D.detect_dates("b", "non-strict").alias("b")).first()
    assert row.a is None and row.b == []


def test_steps_give_the_phrases(spark):
    """The steps one by one (find, unite, sort, merge, parse, filter) give what the one expression gives."""
    df = spark.createDataFrame([(k, SENTENCE.format(p)) for k, (p, _, _) in enumerate(PHRASES)], "k int, t string").coalesce(1)
    rows = df.select("t", D.detect_dates("t", "non-strict").alias("any"), D.detect_by_steps("t").alias("steps")).collect()
    assert [r["any"] for r in rows] == [r.steps for r in rows]


def test_patterns_are_checked():
    p = D.DatePatterns()
    with pytest.raises(ValueError, match="regular expression"):
        p.add("(", "strict")
    with pytest.raises(ValueError):
        p.add("", "strict")
    p.add(r"\bKW\s\d{1,2}", "non-strict")
    with pytest.raises(ValueError, match="already"):
        p.add(r"\bKW\s\d{1,2}", "non-strict")
    p.remove(r"\bKW\s\d{1,2}", "non-strict")
    with pytest.raises(ValueError, match="no such"):
        p.remove(r"\bKW\s\d{1,2}", "non-strict")
