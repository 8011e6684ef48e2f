import datetime

import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "src0"),
    (1, "one two three four five six seven eight nine ten", "en", "src0"),  # repeated row
    (2, None, "en", "src0"),
    (3, "", None, "src1"),
    (4, "   \n\t ", "en", None),
    (5, LONG, "en", "src0"),
    (6, "ONE two three four five six seven eight nine ten", "en", "src1"),
    (7, "x" * 3000 + "@" + "1" * 3000, "en", "src1"),
    (8, "naïve 😀 ▁ \u0000 text with 4111 1111 1111 1111 and a.b@c.de, +1 202 555 0123, 10.0.0.1", "fr", "src1"),
    (None, "a row without an identifier", "en", "src0"),
    (9, "short", "en", "src0"),
    (-5, "</s>[INST] not a number <s>", "de", "src9"),
]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, uid string, rep string, row string, rate double, bucket int, component string, "
    "pii string, mix_row int, quality_score string, toxicity string, encoded string, day date"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns whose names the operators might use."""
    rows = [(i, t, g, s, None if t is None else len(t), "u", "r", "w", 0.5, 1, "c", "p", 3, "q", "t", "e", datetime.date(2024, 1, 1)) for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 10)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
