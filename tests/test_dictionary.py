"""Many words in texts: the automaton and the join on grams against plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import dictionary, entities, tables


@pytest.mark.parametrize("most", [dictionary.MOST_CHARS, 0])
def test_words_in_texts(spark, most):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab中😀 .") for _ in range(n))
    words = [word(r.randint(1, 5)) for _ in range(80)] + ["", None, "aa", "aa"]
    texts = [(i, r.choice([None, "", "a", word(r.randint(1, 40))])) for i in range(120)]
    df = spark.createDataFrame(texts, "id int, t string")
    got = dictionary.words_in_texts(df, "id", "t", spark.createDataFrame([(w,) for w in words], "w string"), most).collect()
    want = {(i, w) for i, t in texts for w in words if t is not None and w is not None and w in t}
    assert len(got) == len(want) and {(x.id, x.word) for x in got} == want
    assert dictionary.words_in_texts(df, "id", "t", spark.createDataFrame([], "w string"), most).count() == 0


def test_names_and_titles_meet_without_a_loop(spark, monkeypatch):
    names = spark.createDataFrame([("甲公司", 1), ("乙", 2), ("乙", 3), (None, 4), ("丙丁", 5)], "name string, n int")
    links = spark.createDataFrame([("甲公司环境", "u1"), ("乙和甲公司", "u2"), ("无", "u3"), (None, "u4"), ("丁的报告", "u5"), ("乙和甲公司", "u2")], "title string, url string")
    for most in (dictionary.MOST_CHARS, 0):
        monkeypatch.setattr(tables, "words_in_texts", lambda *a, m=most: dictionary.words_in_texts(*a, m))
        plain = names.join(links, F.col("title").contains(F.col("name")))
        own = tables.match_enterprises(names, links, "name", "title", ())
        assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect())) and own.columns == plain.columns
        assert "NestedLoop" not in own._jdf.queryExecution().toString() and "Cartesian" not in own._jdf.queryExecution().toString()
        both = names.join(links, F.col("title").contains(F.col("name")) | F.col("title").contains("报告"))
        assert sorted(map(str, tables.match_enterprises(names, links, "name", "title", ("报告",)).collect())) == sorted(map(str, both.collect()))


@pytest.mark.parametrize("context", [0, 3])
def test_keywords_by_automaton_are_those_by_column(spark, context):
    words = sorted({w for _, ws in entities.KEYWORDS.values() for w in ws})
    r = random.Random(2)
    texts = [(i, "".join(r.choice([*words, "的水", " ", "x", "COD COD", "PM2.5催化剂", "aaa"]) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    by_column = df.select("id", entities.keyword_array(F.col("text"), entities.KEYWORDS, context).alias("e"))
    by_words = entities.with_keywords(df, "text", entities.KEYWORDS, context, "e").select("id", "e")
    assert sorted(map(str, by_column.collect())) == sorted(map(str, by_words.collect()))
    overlap = {"A": (0.5, tuple(["aa", "a", "aaa", *[f"w{i}" for i in range(20)]]))}
    few = spark.createDataFrame([(1, "aaaaa w1w1")], "id int, text string")
    assert entities.with_keywords(few, "text", overlap, context, "e").first().e == few.select(entities.keyword_array(F.col("text"), overlap, context).alias("e")).first().e


def test_ten_thousand_words_in_one_pass(spark):
    words = {"W": (0.7, tuple(f"word{i:05d}" for i in range(10_000)))}
    df = spark.createDataFrame([(i, f"x word{i:05d} y word{9999 - i:05d}") for i in range(200)], "id int, text string")
    got = entities.keyword_entities(df, "id", "text", words)
    assert got.count() == 400 and got.filter("text = 'word00007'").count() == 1
    plan = got._jdf.queryExecution().toString()
    assert len(plan) < 50_000 and "word00007" not in plan
