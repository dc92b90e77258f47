"""Counting against hand-picked cases and a naive count."""

import random

import pytest
from pyspark.sql import functions as F

from lexisweep.functions.match import (
    count_substring,
    count_whole_word,
    is_word_char,
    match_count,
    match_regex,
    overlap_shifts,
)

WORD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
LINE = "test test 1 two three banana triangle"
TEN = "test test one two three four five six seven eight nine ten"

CASES = [
    ("test", True, TEN, 2),
    ("test", True, "hello test there test test", 3),
    ("test", True, "hello test there testtest", 1),
    ("test", False, TEN, 2),
    ("test", False, "hello test there test test", 3),
    ("test", False, "hello test there testest", 3),
    ("here", False, "And another line is herehereherehereherehere", 6),
    ("test", False, LINE, 2),
    ("test", True, LINE, 2),
    (" test", False, LINE, 1),
    (" test", True, LINE, 0),
    (" test", False, " " + LINE, 2),
    (" test", True, " " + LINE, 1),
    ("xtest", False, LINE, 0),
    ("xtest", True, " " + LINE, 0),
    ("triangle", False, LINE, 1),
    ("triangle", True, LINE, 1),
    ("triangle ", False, LINE, 0),
    ("triangle ", True, LINE, 0),
    ("triangle ", False, LINE + " ", 1),
    ("triangle ", True, LINE + " ", 1),
    ("trianglex", False, LINE, 0),
    ("trianglex", True, LINE, 0),
    ("a", False, LINE, 4),
    ("a", True, LINE, 0),
    ("test test 1 two three banana", True, LINE, 1),
    ("a a", True, "a a a", 2),
    ("a", True, "é a ça", 2),
    ("test", True, "testé", 1),
    ("a.b", False, "a.b axb", 1),
    ("x\\E", False, "x\\E", 1),
    ("test", False, "a\0test", 1),
    ("aa", False, "aaaa", 3),
    ("aa", True, "aaaa aa", 1),
    ("😀", False, "😀😀 x", 2),
    ("😀😀", False, "😀😀😀", 2),
    ("\n", False, "a\nb\n", 2),
    ("a$1", False, "a$1 a$1", 2),
]


def naive(pattern, whole, text):
    n = 0
    for i in range(len(text) - len(pattern) + 1):
        if not text.startswith(pattern, i):
            continue
        end = i + len(pattern)
        if whole and ((i > 0 and text[i - 1] in WORD) or (end < len(text) and text[end] in WORD)):
            continue
        n += 1
    return n


def counts(spark, cases):
    """One row per case, so that every pattern is its own expression."""
    frames = {}
    for index, (pattern, whole, text) in enumerate(cases):
        frames.setdefault((pattern, whole), []).append((index, text))
    found = {}
    for (pattern, whole), rows in frames.items():
        df = spark.createDataFrame(rows, "i int, text string")
        found |= dict(df.select("i", match_count("text", pattern, whole)).collect())
    return [found[i] for i in range(len(cases))]


def test_cases(spark):
    got = counts(spark, [(p, w, t) for p, w, t, _ in CASES])
    assert got == [n for *_, n in CASES]
    assert got == [naive(p, w, t) for p, w, t, _ in CASES]


def test_random_overlaps(spark):
    rng = random.Random(7)
    alphabets = ["ab", "a ", "aé_", "a.", "ab -"]
    cases = []
    for _ in range(40):
        letters = rng.choice(alphabets)
        pattern = "".join(rng.choices(letters, k=rng.randint(1, 5)))
        whole = rng.random() < 0.5
        for _ in range(25):
            text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
            cases.append((pattern, whole, text))
    assert counts(spark, cases) == [naive(*case) for case in cases]


def test_real_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text")
    texts = [row[0] for row in docs.collect()]
    wanted = [("tion", False), ("erer", False), ("the", True), ("on the", True), ("é", True)]
    got = docs.agg(*(F.sum(match_count("text", p, w)).alias(str(i)) for i, (p, w) in enumerate(wanted))).first()
    assert list(got) == [sum(naive(p, w, t) for t in texts) for p, w in wanted]


def test_null_text_has_no_match(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(match_count("text", "a"), match_count("text", "a", True)).first()[:] == (0, 0)


def test_bad_patterns():
    for build in (count_substring, count_whole_word):
        with pytest.raises(ValueError):
            build("text", "")
        with pytest.raises(TypeError):
            build("text", None)


def test_overlap_shifts():
    shifts = {"test": [3], "aaa": [1, 2], "abab": [2], "tion": [], "a": [], "abcab": [3]}
    assert {p: overlap_shifts(p) for p in shifts} == shifts
    assert match_regex("tion") == "tion"
    assert match_regex("test") == "tes(?=t)"


def test_word_characters(spark):
    chars = [chr(i) for i in range(1, 256)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    assert {c for c, w in df.select("c", is_word_char("c")).collect() if w} == WORD


def test_counting_stays_in_the_jvm(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = docs.agg(F.sum(match_count("text", "the", True)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<text:string>" in plan
