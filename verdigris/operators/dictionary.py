"""Many words in many texts: one automaton for a dictionary of a checked size, an equi-join on rare grams beyond it.

The automaton is broadcast as its words and reads a text once, however many words there are. A larger dictionary stays a table: each word
is known by one of its grams, the one that stands in the fewest texts, and texts meet words where they hold that gram; what meets is
looked at in full. Neither way is a loop over words.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import batches
from verdigris.functions.segments import each

#: Characters of the words that an automaton is made of at most, and the length of grams.
MOST_CHARS, GRAM = 1 << 20, 3


class Automaton:
    """Finds words in texts, each word from left to right without overlaps; words may overlap each other."""

    def __init__(self, words: list[str]) -> None:
        import ahocorasick

        self.words, self._empty = words, [i for i, w in enumerate(words) if not w]
        self._machine = ahocorasick.Automaton()
        for i, w in enumerate(words):
            if w:
                self._machine.add_word(w, i)
        if len(self._machine):
            self._machine.make_automaton()

    def starts(self, text: str) -> list[tuple[int, int]]:
        """Number of the word and start of each occurrence, in the order of the text."""
        ends: dict[int, int] = {}
        found = []
        for last, i in self._machine.iter(text) if len(self._machine) and text else ():
            start = last + 1 - len(self.words[i])
            if start >= ends.get(i, 0):
                ends[i] = last + 1
                found.append((i, start))
        return found

    def held(self, text: str | None) -> list[int]:
        """Numbers of the words that stand in a text; the empty word stands in each but a null one."""
        if text is None:
            return []
        found = {i for _, i in self._machine.iter(text)} if len(self._machine) and text else set()
        return sorted([*found, *self._empty])


def mapped(df: DataFrame, text: str, words: list[str], out: str, kind: str, make: Callable[[Automaton, str | None], object]) -> DataFrame:
    """df with a column of what make(automaton, text) gives."""
    shared, made, arrow = df.sparkSession.sparkContext.broadcast(words), [], batches.arrow_type(kind)

    def run(texts: list) -> list[pa.Array]:
        if not made:
            made.append(Automaton(shared.value))
        return [pa.array([make(made[0], t) for t in texts], arrow)]

    return batches.mapped(df, text, [c for c in df.columns if c != out], {out: kind}, run)


def _grams(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep and the distinct grams of GRAM characters of a text, or a shorter text itself."""
    n = F.length(text)
    some = F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(GRAM)))).otherwise(F.array(F.col(text)))
    return each(df, keep, F.array_distinct(some), "gram")


def _by_grams(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key and word of all words (distinct, none empty) that stand in a text, without a limit of their number."""
    short = words.filter(F.length("word") < GRAM)
    long = _grams(words.filter(F.length("word") >= GRAM), ["word"], "word")
    held = _grams(texts.filter(F.length(text) >= GRAM), [key], text)
    asked = held.join(long.select("gram").distinct(), "gram", "left_semi")
    rare = asked.groupBy("gram").agg(F.count("*").alias("df"))
    # A word with a gram that no text holds stands in no text.
    known = long.join(rare, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram").alias("gram"))).alias("g")).filter("g.df > 0").select("word", F.col("g.gram").alias("gram"))
    pairs = asked.join(known, "gram").select(key, "word")
    sure = pairs.join(texts, key).filter(F.col(text).contains(F.col("word"))).select(key, "word")
    # Words of one or two characters are looked up among all runs of so many.
    for n in range(1, GRAM):
        runs = each(texts, [key], F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n)))), "word")  # noqa: B023
        sure = sure.unionByName(runs.join(short.filter(F.length("word") == n), "word", "left_semi").select(key, "word"))
    return sure


def words_in_texts(texts: DataFrame, key: str, text: str, words: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """key and word: each word of words (its first column) that stands in a text, once if key tells the rows of texts apart."""
    rows, named = texts.select(key, text), words.select(F.col(words.columns[0]).alias("word")).filter("word is not null").distinct()
    size, empty = named.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)), F.count_if(F.col("word") == "")).first()
    if size <= most_chars:
        listed = sorted(r["word"] for r in named.collect())  # most_chars at most
        found = mapped(rows, text, listed, "_held", "array<int>", lambda a, t: a.held(t))
        spelled = mapped_words(found, listed)
        return spelled.select(key, "word")
    there = rows.filter(F.col(text).isNotNull())
    found = _by_grams(there, key, text, named.filter("word != ''"))
    return found.unionByName(there.select(key, F.lit("").alias("word"))) if empty else found


def mapped_words(found: DataFrame, listed: list[str]) -> DataFrame:
    """A row for each number in _held, with its word."""
    spark = found.sparkSession
    numbers = spark.createDataFrame(list(enumerate(listed)), "_i int, word string")
    rows = each(found, [c for c in found.columns if c != "_held"], F.col("_held"), "_i")
    return rows.join(F.broadcast(numbers), "_i").drop("_i")  # as large as the automaton's words at most
