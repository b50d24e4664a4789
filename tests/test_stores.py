"""Stored tables: the search index against a scan of the texts, keyed tables against their plain twins, versions against rival writers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import lookups, searchindex, tables, textsearch
from verdigris.operators.keyedtable import KeyedTable
from verdigris.operators.searchindex import SearchIndex
from verdigris.sources import versions

WORDS = ["License", "password", "déjà", "许可", "a", "b2", "the", "of", "x-y", "Straße"]


def texts(n: int, seed: int, start: int = 0) -> list[tuple]:
    r = random.Random(seed)
    return [(start + i, r.choice([None, "", *[" ".join(r.choices(WORDS, [1, 1, 2, 1, 5, 3, 40, 30, 2, 1], k=r.randint(1, 90)))] * 30])) for i in range(n)]


def rounded(rows) -> list:
    return sorted((r[0], round(r[1], 9)) for r in rows)


def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK", 8)
    monkeypatch.setattr(searchindex, "FILE_DOCS", 100)
    index, rows = SearchIndex(spark, str(tmp_path / "index")), []
    assert index.scores("the").count() == 0 and index.top("the", 5).count() == 0 and index.total("the").first()[0] == 0
    for part in (texts(150, 1), texts(1, 2, 500), texts(60, 3, 1000)):
        rows += part
        index.append(spark.createDataFrame(part, "doc_id long, text string").repartition(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        for query in ("License password", "the", "许可 STRASSE straße", "of the A", "nothing like it", "!?", "the the"):
            want = rounded(textsearch.bm25(docs, "doc_id", query).collect())
            assert rounded(index.scores(query).collect()) == want
            assert index.total(query).first()[0] == len(want)
            best = sorted(want, key=lambda x: (-x[1], x[0]))
            got = [(r.key, round(r.score, 9)) for r in index.top(query, 7).collect()]
            assert got == best[:7] or [s for _, s in got] == [s for _, s in best[:7]]
        index.merge()
        assert len(index.versions.read()["segments"]) == 1
    gone = index.expire()
    assert any(g.startswith("segments/") for g in gone) and index.total("the").first()[0] == len(textsearch.bm25(docs, "doc_id", "the").collect())


def test_search_by_index_pages_filters_and_highlights(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK", 8)
    docs = spark.createDataFrame(texts(120, 4), "doc_id long, text string")
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.append(docs)
    even = docs.filter("doc_id % 2 = 0")
    for page in (1, 2, 3):
        for allowed, those in ((None, docs), (even.select("doc_id"), even)):
            got = index.search("License déjà", docs, page=page, size=10, allowed=allowed).collect()
            # Statistics are the whole collection's, also where a filter narrows what may be found.
            every = [r for r in textsearch.bm25(docs, "doc_id", "License déjà").collect() if allowed is None or r.doc_id % 2 == 0]
            want = sorted(((r.doc_id, round(r.score, 9)) for r in every), key=lambda x: (-x[1], x[0]))[(page - 1) * 10 : page * 10]
            assert [(r.doc_id, round(r.score, 9)) for r in got] == want and all(r.total == len(every) for r in got)
            assert all(r.highlights and all("<em>" in h for h in r.highlights) for r in got)
    assert index.search("!", docs).count() == 0


def test_index_skips_blocks_and_reads_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(searchindex, "BLOCK", 4)
    monkeypatch.setattr(searchindex, "FIRST_BLOCKS", 2)
    rows = [(i, "the " + "of " * (i % 7) + ("rare " * 9 if i in (3, 77) else "")) for i in range(400)]
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame(rows, "doc_id long, text string"))
    bounds, first, least = index.blocks("the rare", 2)
    open_ = bounds.filter(F.col("bound") >= least).count()
    assert len(first) == 2 and open_ < 0.1 * bounds.count()
    assert [r.key for r in index.top("the rare", 2).collect()] == [77, 3]  # the shorter one first
    plan = index.scores("the rare")._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1] and "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term" in plan or "term" in plan


def test_segment_that_isnt_named_doesnt_exist(spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))

    def fails(*_):
        raise OSError("the driver is lost")

    monkeypatch.setattr(index.versions, "commit", fails)
    with pytest.raises(OSError):
        index.append(spark.createDataFrame([(2, "a")], "doc_id long, text string"))
    assert [r.key for r in SearchIndex(spark, str(tmp_path / "index")).scores("a").collect()] == [1]


def test_versions_dont_overwrite(spark, tmp_path):
    a, b = versions.Versions(spark, str(tmp_path / "v")), versions.Versions(spark, str(tmp_path / "v"))
    base = a.read()
    assert base == {"version": 0} and a.commit(base, {"x": 1})["version"] == 1
    with pytest.raises(versions.Conflict):
        b.commit(base, {"x": 2})
    assert b.read() == {"x": 1, "version": 1} and not [n for n in b._names("versions") if n.startswith(".draft")]


def test_keyed_table_is_what_upserts_and_inserts_give(spark, tmp_path):
    r = random.Random(3)
    kept, late = KeyedTable(spark, str(tmp_path / "kept"), "k", 5), KeyedTable(spark, str(tmp_path / "late"), "k", 5)
    with pytest.raises(ValueError):
        kept.read()
    schema = "k string, seq int, v int"
    want_kept = want_late = spark.createDataFrame([], schema)
    for i in range(4):
        new = spark.createDataFrame([(r.choice(["a", "b", "c", "d", "e", "f", None, ""]), r.randint(0, 9), 100 * i + j) for j in range(12)], schema)
        new = tables.first_per_key(new, "k", [F.desc("seq"), "v"]) if i % 2 else new.withColumn("seq", F.lit(100 * i) + F.col("v") % 100)
        want_late = spark.createDataFrame(tables.upsert_latest(new, want_late, "k", "seq").collect(), schema)
        rows = {x.k: x for x in want_kept.collect()}
        for x in sorted(new.collect(), key=lambda x: (x.seq, x.v)):
            rows.setdefault(x.k, x)
        want_kept = spark.createDataFrame([tuple(x) for x in rows.values()], schema)
        late.upsert(new.repartition(3), "seq")
        kept.insert(new, [F.asc("seq"), F.asc("v")])
        assert sorted(map(str, late.read().collect())) == sorted(map(str, want_late.collect()))
        assert sorted(map(str, kept.read().collect())) == sorted(map(str, want_kept.collect()))
    assert late.read(1).count() <= late.read(4).count() and late.upsert(spark.createDataFrame([], schema), "seq")["version"] == 5
    before = sorted(map(str, late.read().collect()))
    assert late.resize(2)["buckets"] == 2 and sorted(map(str, late.read().collect())) == before and not late.grown()
    late.upsert(spark.createDataFrame([("a", 10_000, 0), ("new", 0, 0)], schema), "seq")
    assert late.read().filter("k = 'a'").first().v == 0 and late.read().count() == len(before) + 1
    late.expire()
    assert late.versions.numbers() == [7] and late.read().count() == len(before) + 1


def test_merge_rewrites_touched_buckets_only_and_knows_its_batches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", 16)
    first = t.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("seq")), "seq", ("s", 0))
    again = t.upsert(spark.createDataFrame([(5, 2)], "k long, seq int"), "seq", ("s", 1))
    moved = [b for b in first["folders"] if again["folders"][b] != first["folders"][b]]
    assert len(moved) == 1 and t.read().agg(F.sum("seq")).first()[0] == 201
    assert t.upsert(spark.createDataFrame([(5, 9)], "k long, seq int"), "seq", ("s", 1)) == again
    assert t.upsert(spark.createDataFrame([(5, 9)], "k long, seq int"), "seq", ("other", 1))["version"] == 3
    assert t.read().filter("k = 5").first().seq == 9
    wider = t.upsert(spark.createDataFrame([(6, 3, "x")], "k long, seq int, more string"), "seq")
    assert wider["version"] == 4 and t.read().filter("more is not null").count() == 1 and t.read().count() == 200


def test_failed_merge_leaves_the_table(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    t.upsert(spark.createDataFrame([(1, 1)], "k int, seq int"), "seq")
    real, rivals = t.versions.commit, []

    def rival(base, content):
        if not rivals:  # another writer is faster, once
            rivals.append(1)
            KeyedTable(spark, str(tmp_path / "t"), "k").upsert(spark.createDataFrame([(1, 5), (2, 5)], "k int, seq int"), "seq")
        return real(base, content)

    monkeypatch.setattr(t.versions, "commit", rival)
    t.upsert(spark.createDataFrame([(1, 3), (3, 3)], "k int, seq int"), "seq")
    assert sorted(map(tuple, t.read().collect())) == [(1, 5), (2, 5), (3, 3)]

    def lost(*_):
        raise OSError("the driver is lost")

    monkeypatch.setattr(t.versions, "commit", lost)
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([(1, 99)], "k int, seq int"), "seq")
    other = KeyedTable(spark, str(tmp_path / "t"), "k")
    assert sorted(map(tuple, other.read().collect())) == [(1, 5), (2, 5), (3, 3)]
    other.expire()
    assert sorted(map(tuple, other.read().collect())) == [(1, 5), (2, 5), (3, 3)]


@pytest.mark.parametrize("rows", [0, 400])
def test_suggestions_by_prefix_are_those_of_a_scan(spark, tmp_path, rows):
    r = random.Random(1)
    words = [r.choice([None, "", " ", "".join(r.choice("abAB é") for _ in range(r.randint(1, 7)))]) for _ in range(rows)] + ["abcdefgh", "abcdefgi"] * (rows > 0)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    index = lookups.SuggestIndex(spark, str(tmp_path / "s"))
    assert index.suggest("a").count() == 0
    index.build(df, F.col("w"))
    for prefix in ("", "a", "AB", "ab ", "abab", "ababa", "abcdefg", "é", "zz"):
        for limit in (3, 50):
            assert list(map(tuple, index.suggest(prefix, limit).collect())) == list(map(tuple, textsearch.suggest(df, F.col("w"), prefix, limit).collect())), prefix
    plan = index.suggest("ab")._jdf.queryExecution().toString()
    assert "EqualTo(prefix,ab)" in plan and "StringStartsWith(low,abcdef)" in index.suggest("abcdef")._jdf.queryExecution().toString()
    index.build(df.limit(0), F.col("w"))
    assert index.suggest("a").count() == 0 and index.expire()


def test_seen_keys(spark):
    seen = lookups.SeenKeys(spark, "seen_test", bits=1 << 16, buckets=4)
    seen.drop()
    r = random.Random(6)
    old: list = []
    try:
        for _ in range(3):
            items = [(r.choice([None, "", *map(str, range(300))]), i) for i in range(200)]
            df = spark.createDataFrame(items, "k string, i int")
            got = seen.take(df, "k", ["i"]).collect()
            want = tables.drop_seen(df, spark.createDataFrame([(k,) for k in old], "k string"), "k", ["i"]).collect()
            assert sorted(map(str, got)) == sorted(map(str, want))
            seen.add(df.select("k"))
            old += [k for k, _ in items]
        assert spark.table("seen_test").count() == len({k for k in old if k})
        # Most new keys pass by the filter, and the table's side of the join isn't shuffled.
        fresh = spark.createDataFrame([(f"new{i}", i) for i in range(1000)], "k string, i int")
        assert seen.unseen(fresh, "k").count() == 1000
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = seen.unseen(fresh, "k")._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("SortMergeJoin") :] if "SortMergeJoin" in plan else plan[plan.index("ShuffledHashJoin") :]
        scan = next(line for line in side.splitlines() if "seen_test[" in line or "seen_test" in line)
        assert "Bucketed: true" in scan or "Bucketed: true" in side
        assert side.count("Exchange hashpartitioning(_key") == 1 and "hashpartitioning(_seen" not in side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        seen.drop()


def test_index_deals_out_documents_and_lists_but_no_postings(spark, tmp_path):
    sc = spark.sparkContext

    def dealt() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    r, before = random.Random(6), dealt()
    rows = [(i, " ".join(r.choices([f"w{j}" for j in range(300)], k=64))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    SearchIndex(spark, str(tmp_path / "index")).append(docs)
    assert dealt() - before < 5000  # 900 documents, 300 lists in a block, and not 50,000 postings


def test_terms_are_counted_within_the_row(spark):
    docs = spark.createDataFrame(texts(200, 9), "doc_id long, text string")
    got = docs.select("doc_id", F.inline(textsearch.term_counts(F.col("text"))))
    want = docs.select("doc_id", F.explode(textsearch.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = docs.filter("text is not null").select(textsearch.token_count(F.col("text")), F.size(textsearch.tokens(F.col("text"))))
    assert all(a == b for a, b in sizes.collect())
