"""Fixture documents with the awkward cases, and plain versions of the contracts."""

import re

import pytest

HARD = [
    (1, "The quick brown fox jumps over the lazy dog while seven wise owls watch it run far away into the old wood"),
    (2, "the QUICK brown fox jumps over the lazy dog while seven wise owls watch it run far away into the old wood"),
    (3, None), (4, ""), (5, " \t\n\x0b\x0c\r "), (6, "one"), (7, "one two three"), (8, "One two\nthree"),
    (9, "été naïve 日本語 \U0001f600 x y z " * 6),
    (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (11, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 41),
    (12, "mail me at a.b+c@mail.example.com or 10.0.0.1, 10.0.0.256; +1 (132) 555-1352; 4111 1111-1111 1111; 4111111111111112 x@y@z.com"),
    (13, "# junk $$$ ### *** &&& | | |\n" * 30), (14, "same line here\n" * 20), (15, "w " * 20000 + "end"),
    (16, "The quick brown fox jumps over the lazy dog while seven wise owls watch it run far away into the old wood"),
    (16, "The quick brown fox jumps over the lazy dog while seven wise owls watch it run far away into the old wood"),
    (17, "x" * 50000), (18, "9" * 3000 + " 1.2.3.4.5.6.7.8 +" + "(" * 2000), (19, "<|endoftext|> and İ́ ﬁ"),
    (20, "prefix words come first then one two three four five six seven eight nine ten eleven twelve thirteen and more"),
    (21, "other start one two three four five six seven eight nine ten eleven twelve thirteen but another end"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty, blank, very long and repeated texts; extra columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "x", i, 0.5) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string, id long, score double").repartition(3)


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def plain_words():
    return lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
