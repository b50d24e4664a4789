"""Benchmark decontamination with suffix arrays of the training texts.

Each task cuts its documents into shards of bounded size and builds a word suffix array of each
shard, sorted to the depth of the longest item by prefix doubling. The array is sparse: only runs of words that occur in
the benchmark can hold a match, so only their suffixes are sorted. Every benchmark suffix is then binary-searched: the
interval that begins with its first window holds all its occurrences, however many, and searching on inside it, a window of words at a
time, tells how long each of them is verbatim. Matches that can't be extended to the left are reported with their places.
A document never leaves its task, so nothing is shuffled.

The benchmark is read in blocks of at most BLOCK_CHARS characters (and one item); each block is broadcast and
takes one pass over the documents, and the passes' spans are merged by document.

Defined cases: words are runs of letters and digits, A-Z lowered, every character beyond ASCII
being a letter; a null or empty text has none. An item shorter than the window, but not empty, is one
window. Repeated rows are reported row by row; items with equal text are all reported. Of equally long matches the first in the document
is the longest. Empty tables give no rows, an empty benchmark no hits. Extra columns are ignored, and kept by clean(), whatever
their names. A very long text is a shard of its own, of some 200 bytes of arrays a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common

WINDOW = 10
#: Bound of one broadcast block of the benchmark, and of the words in one shard's suffix array.
BLOCK_CHARS, SHARD_WORDS = 8 << 20, 2 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _windows(items: list[tuple], window: int) -> dict:
    """The block's vocabulary and its distinct windows as sorted key rows, with the (item, place) pairs of each."""
    vocab: dict[bytes, int] = {}
    rows: dict[tuple, list[tuple[int, int]]] = {}
    texts: list[list[int]] = []
    for i, (_, text) in enumerate(items):
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
        texts.append(ids)
        for p in range(max(1, len(ids) - window + 1) if ids else 0):
            rows.setdefault(tuple(ids[p : p + window]), []).append((i, p))
    keys, sizes = np.zeros((len(rows), window), ">u4"), np.array([len(k) for k in rows], np.int64)
    for r, k in enumerate(rows):
        keys[r, : len(k)] = k
    places, lengths = list(rows.values()), np.array([len(t) for t in texts], np.int64)
    return {
        # The items' words one after another, each with a gap of a window behind it, and one before the first.
        "words": np.array([0] + [w for t in texts for w in [*t, *[0] * window]], np.uint32), "begin": 1 + np.cumsum(lengths + window) - lengths - window, "lengths": lengths,
        "vocab": vocab, "keys": keys, "sizes": sizes, "item_ids": [x[0] for x in items],
        "first": np.cumsum([0, *map(len, places)]), "place": np.array([x for ps in places for x in ps], np.int64).reshape(-1, 2),
    }


def _word_ids(text: str | None, block: dict) -> np.ndarray:
    """The block's number of each word, 0 for words it doesn't have."""
    w = words_of(text)
    return np.fromiter(map(block["vocab"].get, w, repeat(0)), np.uint32, len(w))


def _as_bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1] * 4}").ravel()


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the intervals [first, last), and the interval each belongs to."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), of


def suffix_array(seq: np.ndarray, at: np.ndarray, room: np.ndarray, window: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes seq[at : at + room] in order, compared to `depth` words at least or their end, and their first words, sorted.

    at holds whole runs: where at + k is within a suffix, it is in at, too.
    """
    head = seq[at[:, None] + np.arange(window)]
    head[np.arange(window) >= room[:, None]] = 0
    order = np.lexsort(head.T[::-1])
    at, room, head = at[order], room[order], head[order]
    new = np.r_[True, (head[1:] != head[:-1]).any(1)] if len(at) else np.empty(0, bool)
    rank = np.zeros(len(seq) + 1, np.int64)  # by place; 0 beyond a suffix's end
    group = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    rank[at] = group + 1
    known = window
    while known < depth:
        size = np.bincount(group, minlength=len(at))
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_) or not (room[open_] > known).any():
            break
        then = np.where(room[open_] > known, rank[np.minimum(at[open_] + known, len(seq))], 0)
        o = np.lexsort((then, group[open_]))
        moved = open_[o]
        at[open_], room[open_], then = at[moved], room[moved], then[o]
        first = np.r_[True, (group[open_][1:] != group[open_][:-1]) | (then[1:] != then[:-1])]
        group[open_] = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
        rank[at] = group + 1
        known *= 2
    return at, room


def _blocks_at(seq: np.ndarray, at: np.ndarray, room: np.ndarray, window: int) -> np.ndarray:
    """The next words of suffixes, 0 beyond their ends."""
    out = seq[np.minimum(at, len(seq) - window)[:, None] + np.arange(window)]
    out[np.arange(window) >= room[:, None]] = 0
    return out


def _bisect(seq: np.ndarray, array: np.ndarray, room: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, target: np.ndarray, after: bool) -> np.ndarray:
    """For each interval [low, high) of the array, the first suffix whose words at depth are not before (after: are behind) the target's."""
    low, high, window = low.copy(), high.copy(), target.shape[1]
    while (go := np.flatnonzero(low < high)).size:
        mid = (low[go] + high[go]) // 2
        words, want = _blocks_at(seq, array[mid] + depth, room[mid] - depth, window), target[go]
        other = words != want
        k = other.argmax(1)
        rows = np.arange(len(go))
        before = np.where(other.any(1), words[rows, k] < want[rows, k], after)
        low[go] = np.where(before, mid + 1, low[go])
        high[go] = np.where(before, high[go], mid)
    return low


def _lengths(seq: np.ndarray, array: np.ndarray, room: np.ndarray, block: dict, low: np.ndarray, high: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """How many words each suffix of the intervals [low, high) shares with the benchmark suffix (start, left words) of its interval, the intervals one after another.

    An interval is narrowed by binary search, a window of words at a time; a suffix's length is known where it drops out.
    """
    window, words = block["keys"].shape[1], block["words"]
    base = np.cumsum(high - low) - (high - low) - low
    out = np.zeros(int((high - low).sum()), np.int64)
    low, high, depth = low.copy(), high.copy(), 0
    live = np.flatnonzero(low < high)
    while len(live):
        more = np.minimum(left[live] - depth, window)
        target = words[start[live][:, None] + depth + np.arange(window)]
        target[np.arange(window) >= more[:, None]] = 0
        most = target.copy()
        most[np.arange(window) >= more[:, None]] = 0xFFFFFFFF
        a = _bisect(seq, array, room, low[live], high[live], depth, target, False)
        b = _bisect(seq, array, room, a, high[live], depth, most, True)
        for x, y in ((low[live], a), (b, high[live])):
            i, of = _spread(x, y)
            if len(i):
                same = (_blocks_at(seq, array[i] + depth, room[i] - depth, window) == target[of]) & (np.arange(window) < more[of][:, None])
                out[base[live][of] + i] = depth + np.minimum.accumulate(same, axis=1).sum(1)
        ended = left[live] - depth <= window
        i, of = _spread(a[ended], b[ended])
        out[base[live[ended]][of] + i] = left[live[ended]][of]
        low[live], high[live] = a, b
        depth += window
        live = live[~ended & (a < b)]
    return out


def search_shard(texts: list[np.ndarray], block: dict, longest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of the block's windows in documents given as word ids (0: not in the benchmark): document, word offset, window. If asked, also
    the verbatim matches that can't be extended: rows of document, word offset, item, word offset in it, words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes + 1
    window, none = block["keys"].shape[1], np.empty(0, np.int64)
    matches = np.empty((0, 5), np.int64)
    if not len(block["keys"]):
        return none, none, none, matches
    seq = np.zeros(int(sizes.sum()) + 1 + window, np.uint32)
    for s, t in zip(starts, texts, strict=True):
        seq[s : s + len(t)] = t
    gaps = np.flatnonzero(seq == 0)
    inside = np.flatnonzero(seq)
    end = np.searchsorted(gaps, inside)
    some = gaps[end] - gaps[end - 1] - 1 >= block["sizes"].min()  # runs that are long enough
    inside, end = inside[some], end[some]
    array, room = suffix_array(seq, inside, gaps[end] - inside, window, int(block["lengths"].max()) if longest else window)
    heads = _as_bytes(_blocks_at(seq, array, room, window).astype(">u4"))
    ends = block["keys"].copy()
    ends[np.arange(window) >= block["sizes"][:, None]] = 0xFFFFFFFF
    low, high = np.searchsorted(heads, _as_bytes(block["keys"])), np.searchsorted(heads, _as_bytes(ends), "right")
    at, which = _spread(low, high)
    places = array[at]
    doc = np.searchsorted(starts, places, "right") - 1
    if longest and len(at):
        # Every benchmark suffix with occurrences, one for each place of its window.
        hit = np.flatnonzero(low < high)
        suffix, of = _spread(block["first"][hit], block["first"][hit + 1])
        item, place = block["place"][suffix].T
        low, high = low[hit][of], high[hit][of]
        begin = block["begin"][item] + place
        words = _lengths(seq, array, room, block, low, high, begin, block["lengths"][item] - place)
        i, k = _spread(low, high)
        before = seq[array[i] - 1]
        new = (before == 0) | (block["words"][begin[k] - 1] != before)  # not a part of a match that begins earlier
        i, k, words = i[new], k[new], words[new]
        d = np.searchsorted(starts, array[i], "right") - 1
        matches = np.stack([d, array[i] - starts[d], item[k], place[k], words], 1)
        matches = matches[np.lexsort(matches.T[::-1])]
    return doc, places - starts[doc], which, matches


def _merged(first: np.ndarray, last: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals that touch, within each group: group, first, last."""
    o = np.lexsort((last, first, group))
    first, last, group = first[o], last[o], group[o]
    if not len(first):
        return group, first, last
    wide = int(last.max()) + 2
    reach = np.maximum.accumulate(last + group * wide)
    new = np.r_[True, first[1:] + group[1:] * wide > reach[:-1]]
    begin = np.flatnonzero(new)
    return group[begin], first[begin], np.r_[reach[begin[1:] - 1], reach[-1]] - group[begin] * wide


def _report(texts: list[np.ndarray], block: dict, longest: bool) -> Iterator[tuple]:
    """For each document: number of words, hit spans, matching items, and if asked the longest matches."""
    doc, at, which, found = search_shard(texts, block, longest)
    size = block["sizes"][which]
    g, a, b = _merged(at, at + size, doc)
    span_of = np.searchsorted(g, np.arange(len(texts) + 1))
    pairs = np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else np.empty((0, 2), np.int64)
    k, of = _spread(block["first"][pairs[:, 1]], block["first"][pairs[:, 1] + 1])
    items = np.unique(np.stack([pairs[of, 0], block["place"][k, 0]], 1), axis=0) if len(k) else np.empty((0, 2), np.int64)
    item_of = np.searchsorted(items[:, 0], np.arange(len(texts) + 1))
    match: list[list] = [[] for _ in texts]
    for d, x, i, p, n in found.tolist():
        match[d].append((block["item_ids"][i], x, p, n))
    for d, t in enumerate(texts):
        spans = list(zip(a[span_of[d] : span_of[d + 1]].tolist(), b[span_of[d] : span_of[d + 1]].tolist(), strict=True))
        yield len(t), spans, [block["item_ids"][i] for i in items[item_of[d] : item_of[d + 1], 1]], match[d]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about BLOCK_CHARS characters at most."""
    b = benchmark.select("item_id", "text")
    chars = b.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + chars // BLOCK_CHARS
    return [b] if n == 1 else [b.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, spans (hit words, array<struct<first,last>>), item_ids,
    and matches (item_id, doc_word, item_word, n_words: longest verbatim matches; empty unless `longest`)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, row_id long, n_words long, spans array<struct<first:long,last:long>>, item_ids array<{kinds[1]}>, matches array<struct<item_id:{kinds[1]},doc_word:long,item_word:long,n_words:long>>"
    span_kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def passed(block: DataFrame, source: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(_windows([tuple(r) for r in block.collect()], window))  # at most BLOCK_CHARS of text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            item_kind = pa.array(model["item_ids"]).type if model["item_ids"] else pa.int64()
            match_kind = pa.list_(pa.struct([("item_id", item_kind), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))

            def flush(ids, rows, texts):
                n, spans, items, match = zip(*_report(texts, model, longest), strict=True)
                return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(rows), pa.array(n, pa.int64()), pa.array(spans, span_kind), pa.array(items, pa.list_(item_kind)), pa.array(match, match_kind)], names=["doc_id", "row_id", "n_words", "spans", "item_ids", "matches"])

            ids, rows, texts, total = [], [], [], 0
            for b in batches:
                ids.append(b.column(0))
                rows.append(b.column(2))
                for t in b.column(1).to_pylist():
                    texts.append(_word_ids(t, model))
                    total += len(texts[-1])
                if total >= SHARD_WORDS:
                    yield flush(ids, rows, texts)
                    ids, rows, texts, total = [], [], [], 0
            if texts:
                yield flush(ids, rows, texts)

        return source.mapInArrow(common.lean(run), schema)

    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        return passed(blocks[0], docs.select("doc_id", "text", F.lit(0).cast("long").alias("row_id"))).drop("row_id")
    keyed = common.materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id")), "decontaminate")
    several = common.union_all([passed(b, keyed) for b in blocks])
    joined = several.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"), F.flatten(F.collect_list("matches")).alias("matches"))
    # Sorted spans of several blocks: join those that touch.
    union = F.expr(
        "aggregate(spans, cast(array() as array<struct<first:bigint,last:bigint>>), (a, x) -> if(size(a) > 0 and element_at(a, -1).last >= x.first,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))), concat(a, array(x))))"
    )
    return joined.select("doc_id", "n_words", union.alias("spans"), "item_ids", "matches")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that share no window with the benchmark; each row is judged by its own text, and nothing is shuffled."""
    spark, cols = docs.sparkSession, docs.columns
    common.bound_batches(spark)
    kept = docs
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(_windows([tuple(r) for r in block.collect()], window))  # at most BLOCK_CHARS of text

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in batches:
                texts = [_word_ids(t, model) for t in b.column("text").to_pylist()]
                hit = np.zeros(len(texts), bool)
                hit[search_shard(texts, model)[0]] = True
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(~hit)) for c in cols], names=cols)

        kept = kept.mapInArrow(common.lean(run), docs.schema)
    return kept


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n_words, doc_id, doc_word, item_word: the longest verbatim match of each item in any document (smallest doc_id, then places, on ties)."""
    every = match_benchmark(docs, benchmark, window).select("doc_id", F.explode_outer("matches").alias("m")).filter("m is not null").select("doc_id", "m.*")
    first = F.struct(F.col("n_words"), *[(-F.col(c)).alias(c) for c in ("doc_id", "doc_word", "item_word")])
    return every.groupBy("item_id").agg(F.max(first).alias("b")).select("item_id", "b.n_words", *[(-F.col(f"b.{c}")).alias(c) for c in ("doc_id", "doc_word", "item_word")])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_benchmark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["n_words"].alias("n"), (-m["doc_word"]).alias("a"), (-m["item_word"]).alias("b"), m["item_id"].alias("i"))))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce(best["n"], F.lit(0).cast("long")).alias("longest_words"), best["i"].alias("longest_item"), (-best["a"]).alias("longest_doc_word"), (-best["b"]).alias("longest_item_word"),
    )
