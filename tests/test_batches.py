"""What a Python worker holds of a batch: slices of bounded size, whatever comes in."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from verdigris.functions import batches
from verdigris.llm import neardup, pieces
from verdigris.operators import dictionary, pages, textsearch
from verdigris.operators import elements as el


@pytest.fixture
def tasks(monkeypatch, spark):
    """The functions that are handed to mapInArrow, to be run here."""
    held, frame = [], type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: held.append(f) or real(self, f, *a, **b))
    return held


def peak(f, batch: pa.RecordBatch) -> tuple[int, int]:
    """Bytes that f holds at most for a batch, and rows of the largest batch that it gives."""
    rows = 0
    tracemalloc.start()
    for b in f(iter([batch])):
        rows = max(rows, b.num_rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def grows_little(f, columns: dict, n: int) -> None:
    """What f holds for ten times the rows isn't half as much again."""
    one, ten = (pa.RecordBatch.from_pydict({c: v * k for c, v in columns.items()}) for k in (n, 10 * n))
    list(f(iter([one])))
    few, _ = peak(f, one)
    many, rows = peak(f, ten)
    assert many < 1.5 * few and rows <= max(batches.SLICE_ROWS, textsearch.SPELLED)


def test_slices_are_the_batch():
    r = random.Random(2)
    texts = [r.choice([None, "", "é" * 9, "x" * 200_000, "y" * 900_000]) for _ in range(300)] + ["a"] * 700
    whole = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": texts})
    found = list(batches.slices(iter([whole, whole.slice(5, 0), whole.slice(7, 3)]), "t"))
    assert [x for b in found for x in b.to_pydict()["k"]] == [*range(1000), 7, 8, 9]
    assert [x for b in found for x in b.to_pydict()["t"]] == [*texts, *texts[7:10]]
    for b in found:
        size = sum(len((x or "").encode()) for x in b.to_pydict()["t"])
        assert 1 <= b.num_rows <= batches.SLICE_ROWS and (size <= batches.SLICE_BYTES or b.num_rows == 1)


def test_page_trees_hold_a_slice(spark, tasks):
    df = spark.createDataFrame([(1, "u", "")], "page_id int, url string, html string")
    el.with_tree(df, keep=("page_id",))
    grows_little(tasks[-1], {"page_id": [1], "_html": ["<ul>" + "<li class='a b'><a href='x'>y</a></li>" * 20 + "</ul>"]}, 300)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= batches.BATCH_ROWS


def test_listings_hold_a_slice(spark, tasks):
    pages.listing_rows(spark.createDataFrame([(1, "u", "")], "page_id int, url string, html string"), keep=("page_id",))
    row = "<tr>" + "<td><a class='f_title' href='/d?id=1'>t</a></td>" * 5 + "</tr>"
    grows_little(tasks[-1], {"page_id": [1], "url": ["u"], "_html": [f"<table>{row * 5}</table>"]}, 300)


def test_a_task_drops_what_other_steps_keep(spark, tasks):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    neardup.sketches(docs)
    encode, sketch = tasks
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some text"], "_key": [5]})
    first = [b.to_pydict() for b in encode(iter([batch]))]
    (held,) = batches.kept("pieces").values()
    assert [b.to_pydict() for b in encode(iter([batch] * 5))] == first * 5
    assert list(batches.kept("pieces").values()) == [held]  # for its own tasks
    assert list(sketch(iter([batch]))) and not batches.kept("pieces")


def random_texts(n: int) -> list:
    r = random.Random(3)
    return ["".join(r.choices("abcdefghij klmn", k=400)) for _ in range(n)]


def test_tfidf_fit_holds_a_slice(spark, tasks, monkeypatch):
    monkeypatch.setattr(textsearch, "MOST_GRAMS", 20_000)  # fewer than either batch sums up
    textsearch.tfidf_fit_texts(spark.createDataFrame([("a",)], "text string"))
    grows_little(tasks[-1], {"text": random_texts(1000)}, 3)


def test_tfidf_sums_dont_depend_on_how_often_they_are_given_out(spark, tasks, monkeypatch):
    textsearch.tfidf_fit_texts(spark.createDataFrame([("a",)], "text string"))
    sums = []
    for most in (textsearch.MOST_GRAMS, 700):
        monkeypatch.setattr(textsearch, "MOST_GRAMS", most)
        found: dict = {}
        given = list(tasks[-1](iter([pa.RecordBatch.from_pydict({"text": random_texts(900)})])))
        for b in given:
            for g, t, d in zip(*b.to_pydict().values(), strict=True):
                found[g] = tuple(map(sum, zip(found.get(g, (0, 0)), (t, d), strict=True)))
        sums.append((len(given), found))
    assert sums[0][1] == sums[1][1] and sums[0][1][None] == (900, 900) and sums[0][0] < sums[1][0]


def test_embeddings_hold_a_slice(spark, tasks):
    docs = spark.createDataFrame([(t,) for t in random_texts(20)], "text string")
    textsearch.with_embedding(docs, textsearch.tfidf_fit_texts(docs))
    grows_little(tasks[-1], {"text": random_texts(1000)}, 3)


def test_words_in_texts_hold_a_slice(spark, tasks):
    words = [a + b for a in "abcdefgh" for b in "ijklmn"]
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    dictionary.words_in_texts(df, "id", "t", spark.createDataFrame([(w,) for w in words], "w string"))
    grows_little(tasks[0], {"id": [1] * 100, "t": random_texts(100)}, 3)
