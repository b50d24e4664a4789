"""Suffix-array deduplication: bytes covered by a string of MIN_BYTES that also starts earlier.

Suffixes of a whole corpus can't be sorted in one place, so repeats are first located by anchors. The
anchor of a stretch of MIN_BYTES is its K-gram with the least hash, leftmost on ties: equal stretches
have equal anchors at equal places. Neighbouring stretches with one anchor form a piece, at most
2 * MIN_BYTES - K bytes long. Pieces are dealt out by anchor; equal pieces need no more than their order,
and different pieces with one anchor go on, with their bytes, to a suffix array of their group.

There each group gets an enhanced suffix array of the starts that can begin a repeat. A stack scan of its
common prefixes gives the tree of intervals, those whose occurrences differ in what precedes them are the maximal
repeats of the pieces, and every occurrence but the first of such a repeat is removed over its whole length.

Anchors met in very many different pieces (the edges of a passage that many documents share) are found first, by counting
one distinct piece in SAMPLE, and marked in a bitmap of fixed size. Their pieces are dealt out by the hash of the piece
and then stretch by stretch, so that neither the records nor the bytes of a common passage gather in one task. An anchor that the bitmap marks
by chance, or that the count misses, costs time and changes no result.

Order: smaller doc_id first, then smaller start. Defined cases: null texts are empty; nothing shorter than
MIN_BYTES is removed; null doc_ids come first, and rows with equal doc_id are ordered by text. Removed bytes may
leave incomplete UTF-8, so what is kept is binary. An empty table gives no rows. Extra columns are ignored, whatever their names. A very
long text is never split: some 60 bytes of arrays a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common
from verdigris.llm.hashing import ODD, Substrings, mix

MIN_BYTES, K = 100, 32
#: Different pieces of one anchor from which stretches are dealt out one by one, and text bytes of a part.
HOT, PART_BYTES = 1000, 6 << 20
#: One distinct piece in SAMPLE is counted in the search for hot anchors, which a bitmap of BITMAP_BITS names.
SAMPLE, BITMAP_BITS = 32, 1 << 24
_SLICE = 1 << 20
_PACKED = "kind int, part int, data binary"
#: Layouts of packed rows. RANGE: bytes to remove. RECORD: a piece. VARIANT: a piece whose bytes are needed.
RECORD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("key", "<i8"), ("start", "<u4"), ("more", "u1"), ("off", "u1")])
RANGE = np.dtype([("key", "<i8"), ("start", "<u4"), ("size", "<u4")])
VARIANT = np.dtype([("key", "<i8"), ("h1", "<u8"), ("start", "<u4"), ("more", "u1"), ("hot", "?")])
PIECE = np.dtype([("key", "<i8"), ("start", "<u4"), ("size", "<u4")])
_RECORDS, _RANGES, _VARIANTS, _PIECES, _TEXT = 0, 1, 2, 3, 4


def pieces_of(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of texts that lie one after another in raw: text number, start in the text, further stretches after the first, anchor's place, anchor's and piece's hash."""
    width = MIN_BYTES - K + 1
    none = np.empty(0, np.int64)
    if len(raw) < MIN_BYTES:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sub = Substrings(raw)
    grams = sub.all_of(K)
    mask = np.uint64((1 << len(grams).bit_length()) - 1)
    least, s = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * s <= width:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if s < width:
        least = np.minimum(least[: len(least) - (width - s)], least[width - s :])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    p = np.flatnonzero(owner[: len(least)] == owner[MIN_BYTES - 1 :])
    if not len(p):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[p] & mask).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)])
    a, b, anchor = p[first], p[np.r_[first[1:] - 1, len(p) - 1]], anchor[first]
    h2 = mix(sub(a, b + MIN_BYTES) + (anchor - a).astype(np.uint64) * ODD)
    doc = owner[a]
    return doc, a - (np.cumsum(sizes) - sizes)[doc], b - a, anchor - a, grams[anchor], h2


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal values."""
    if not len(sorted_):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return first, np.r_[first[1:], len(sorted_)]


def _dealt(kind: int, part: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """Packed rows, one for each part."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    return [(kind, int(part[a]), rows[a:b].tobytes()) for a, b in zip(*_runs(part), strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, part, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["kind", "part", "data"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "data"])


def _read(frame: pd.DataFrame, kind: int, layout: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(frame.loc[frame["kind"] == kind, "data"]), layout)


def _merged(r: np.ndarray) -> np.ndarray:
    """RANGE rows sorted, those that touch joined."""
    r = r[np.lexsort((r["start"], r["key"]))]
    if not len(r):
        return r
    key, start, end = r["key"], r["start"].astype(np.int64), r["start"].astype(np.int64) + r["size"]
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * wide)
    begin = np.flatnonzero(np.r_[True, start[1:] + group[1:] * wide > reach[:-1]])
    out = r[begin].copy()
    out["size"] = np.r_[reach[begin[1:] - 1], reach[-1]] - group[begin] * wide - start[begin]
    return out


def _split_known(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RECORD rows: the first of each distinct piece, and the ranges of the others."""
    r = r[np.lexsort((r["start"], r["key"], r["h2"], r["h1"]))]
    new = np.r_[True, (r["h2"][1:] != r["h2"][:-1]) | (r["h1"][1:] != r["h1"][:-1])] if len(r) else np.empty(0, bool)
    again = r[~new]
    gone = np.empty(len(again), RANGE)
    gone["key"], gone["start"], gone["size"] = again["key"], again["start"], again["more"].astype(np.uint32) + MIN_BYTES
    return r[new], gone


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > _SLICE:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _sampled_pieces(sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in _slices(texts):
                h1, h2 = pieces_of(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.array([len(t) for t in texts[i:j]]))[4:]
                some = h2 % np.uint64(sample) == 0
                pair = np.unique(np.stack([h1[some], h2[some]], 1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["h1", "h2"])

    return run


def hot_anchors(keyed: DataFrame, hot: int, sample: int) -> np.ndarray:
    """The bitmap of anchors with about `hot` different pieces or more, counted on one distinct piece in `sample`."""
    pairs = keyed.select("data").mapInArrow(_sampled_pieces(sample), "h1 long, h2 long").distinct()
    counted = pairs.groupBy("h1").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, hot // sample))
    return common.bitmap(counted, F.pmod("h1", F.lit(BITMAP_BITS)), BITMAP_BITS)


def _marked(held: np.ndarray, h1: np.ndarray) -> np.ndarray:
    return common.in_bitmap(held, (h1 & np.uint64(BITMAP_BITS - 1)).astype(np.int64))


def _find_pieces(parts: int, doc_parts: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            found = []
            for i, j in _slices(texts):
                doc, start, more, off, h1, h2 = pieces_of(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.array([len(t) for t in texts[i:j]]))
                r = np.empty(len(doc), RECORD)
                r["h1"], r["h2"], r["key"], r["start"], r["more"], r["off"] = h1, h2, keys[i:j][doc], start, more, off
                found.append(r)
            first, gone = _split_known(np.concatenate(found) if found else np.empty(0, RECORD))
            gone = _merged(gone)
            dealt_by = np.where(_marked(shared.value, first["h1"]), first["h2"], first["h1"])
            yield _batch(_dealt(_RECORDS, (dealt_by % np.uint64(parts)).astype(np.int64), first) + _dealt(_RANGES, gone["key"] % doc_parts, gone))

    return run


def _sort_pieces(doc_parts: int, hot: int, shared):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first, gone = _split_known(_read(frame, _RECORDS, RECORD))
        gone = _merged(np.concatenate([gone, _read(frame, _RANGES, RANGE)]))
        a, b = _runs(first["h1"])
        count = np.repeat(b - a, b - a)
        marked = _marked(shared.value, first["h1"])
        needed = marked | (count > 1)
        several = first[needed]
        v = np.empty(len(several), VARIANT)
        for c in ("key", "h1", "start", "more"):
            v[c] = several[c]
        v["hot"] = (marked | (count >= hot))[needed]
        return _frame(_dealt(_RANGES, gone["key"] % doc_parts, gone) + _dealt(_VARIANTS, v["key"] % doc_parts, v))

    return run


def _take(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes flat[start : start + size] of all rows, one after another."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return flat[at]


def _packed_pieces(part: np.ndarray, key: np.ndarray, start: np.ndarray, flat: np.ndarray, place: np.ndarray, size: np.ndarray) -> list[tuple]:
    """Packed rows of pieces: their number, their heads, their bytes."""
    order = np.argsort(part, kind="stable")
    part, key, start, place, size = part[order], key[order], start[order], place[order], size[order]
    out = []
    for a, b in zip(*_runs(part), strict=True):
        head = np.empty(b - a, PIECE)
        head["key"], head["start"], head["size"] = key[a:b], start[a:b], size[a:b]
        out.append((_PIECES, int(part[a]), np.uint32(b - a).tobytes() + head.tobytes() + _take(flat, place[a:b], size[a:b]).tobytes()))
    return out


def _fetch_bytes(parts: int, doc_parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = _read(frame, _VARIANTS, VARIANT)
        docs = frame[frame["kind"] == _TEXT].sort_values("key")
        docs = docs[docs["key"].isin(np.unique(v["key"]))]
        if not len(v):
            return _frame([])
        texts = list(docs["data"])
        flat, keys = np.frombuffer(b"".join(texts), np.uint8), docs["key"].to_numpy(np.int64)
        base = np.cumsum([0, *map(len, texts)])[np.searchsorted(keys, v["key"])]
        place, size = base + v["start"], v["more"].astype(np.int64) + MIN_BYTES
        cool = ~v["hot"]
        out = _packed_pieces((v["h1"][cool] % np.uint64(parts)).astype(np.int64), v["key"][cool], v["start"][cool], flat, place[cool], size[cool])
        hot = np.flatnonzero(v["hot"])
        if len(hot):
            # One stretch each; equal ones of this part are combined here.
            n = v["more"][hot].astype(np.int64) + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, start, key = np.repeat(place[hot], n) + step, np.repeat(v["start"][hot], n) + step, np.repeat(v["key"][hot], n)
            h, other = Substrings(flat)(at, at + MIN_BYTES), Substrings(flat ^ np.uint8(0x5A))(at, at + MIN_BYTES)
            o = np.lexsort((start, key, other, h))
            new = np.r_[True, (h[o][1:] != h[o][:-1]) | (other[o][1:] != other[o][:-1])]
            gone = np.empty(int((~new).sum()), RANGE)
            gone["key"], gone["start"], gone["size"] = key[o][~new], start[o][~new], MIN_BYTES
            gone = _merged(gone)
            o = o[new]
            out += _packed_pieces((h[o] % np.uint64(parts)).astype(np.int64), key[o], start[o], flat, at[o], np.full(len(o), MIN_BYTES))
            out += [(k, int(p % parts), d) for k, p, d in _dealt(_RANGES, gone["key"] % doc_parts, gone)]
        return _frame(out)

    return run


def suffix_array(flat: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes flat[start : start + room] and the common prefix of each with the one before it."""
    wide = np.r_[flat, np.zeros(16, np.uint8)].astype(np.uint64)
    words = np.zeros(len(flat) + 8, np.uint64)
    for k in range(8):
        words |= wide[k : k + len(words)] << np.uint64(56 - 8 * k)
    n_words = -(-int(room.max()) // 8)
    table = np.empty((n_words, len(starts)), np.uint64)
    for k in range(n_words):
        left = np.clip(room - 8 * k, 0, 8)
        cut = np.where(left > 0, np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(64) - np.maximum(left, 1).astype(np.uint64) * np.uint64(8)), np.uint64(0))
        table[k] = words[np.minimum(starts + 8 * k, len(words) - 1)] & cut
    order = np.lexsort((room, *table[::-1]))
    table, room = table[:, order], room[order]
    other = table[:, 1:] ^ table[:, :-1]
    first = (other != 0).argmax(0)
    x = other[first, np.arange(other.shape[1])]
    lead = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        lead += x < np.uint64(1 << (64 - 8 * k))
    same = np.where(x == 0, 8 * n_words, 8 * first + lead)
    return order, np.r_[0, np.minimum(same, np.minimum(room[1:], room[:-1]))]


def prefix_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals (first, last, length) of suffixes with common prefixes of `least` bytes or more, by a stack scan."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # length, first
    values = lcp.tolist()
    values.append(0)
    for i in np.flatnonzero(np.r_[lcp >= least, False] | np.r_[False, lcp >= least]).tolist():
        v, first = values[i], i - 1
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            out.append((first, i - 1, length))
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, first))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def maximal_repeats(flat: np.ndarray, place: np.ndarray, size: np.ndarray, least: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Maximal repeats of pieces flat[place : place + size]: suffixes in suffix-array order (piece, start in it), and groups as
    intervals (first, last, length) of them. A group lists all its occurrences; what precedes them is not always the same byte."""
    n = np.maximum(size - least + 1, 0)
    piece = np.repeat(np.arange(len(size)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = place[piece] + step
    h = Substrings(flat)(at, at + least)
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    some = count[back] > 1  # a lone stretch repeats nothing
    piece, step, at = piece[some], step[some], at[some]
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    order, lcp = suffix_array(flat, at, size[piece] - step)
    piece, step, at = piece[order], step[order], at[order]
    first, last, length = prefix_intervals(lcp, least)
    before = np.where(step > 0, flat[at - 1].astype(np.int64), -1 - np.arange(len(at)))  # a piece's edge is like nothing else
    changes = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    diverse = changes[last] > changes[first]
    return piece, step, first[diverse], last[diverse], length[diverse]


def _search_group(doc_parts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        heads, data = [], []
        for d in frame.loc[frame["kind"] == _PIECES, "data"]:
            m = int(np.frombuffer(d, np.uint32, 1)[0])
            heads.append(np.frombuffer(d, PIECE, m, 4))
            data.append(d[4 + m * PIECE.itemsize :])
        found = [_read(frame, _RANGES, RANGE)]
        if heads:
            head, flat = np.concatenate(heads), np.frombuffer(b"".join(data), np.uint8)
            size = head["size"].astype(np.int64)
            piece, step, first, last, length = maximal_repeats(flat, np.cumsum(size) - size, size)
            key, start = head["key"][piece], head["start"][piece].astype(np.int64) + step
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((start, key))] = np.arange(len(key))
            longest = np.zeros(len(key), np.int64)
            ranks = rank
            for o in np.argsort(length, kind="stable").tolist():  # longer repeats lie within shorter ones
                a, b = first[o], last[o] + 1
                earliest = a + ranks[a:b].argmin()
                held = longest[earliest]
                longest[a:b] = length[o]
                longest[earliest] = held
            gone = np.empty(int((longest > 0).sum()), RANGE)
            gone["key"], gone["start"], gone["size"] = key[longest > 0], start[longest > 0], longest[longest > 0]
            found.append(gone)
        gone = _merged(np.concatenate(found))
        return _frame(_dealt(_RANGES, gone["key"] % doc_parts, gone))

    return run


def _apply(frame: pd.DataFrame) -> pd.DataFrame:
    gone = _merged(_read(frame, _RANGES, RANGE))
    docs = frame[frame["kind"] == _TEXT]
    a, b = np.searchsorted(gone["key"], docs["key"]), np.searchsorted(gone["key"], docs["key"], "right")
    rows = []
    for key, text, i, j in zip(docs["key"], docs["data"], a.tolist(), b.tolist(), strict=True):
        spans, kept, at = [], [], 0
        for s, n in zip(gone["start"][i:j].tolist(), gone["size"][i:j].tolist(), strict=True):
            spans.append({"first": s, "last": s + n})
            kept.append(text[at:s])
            at = s + n
        kept.append(text[at:])
        rows.append((key, len(text), spans, b"".join(kept)))
    return pd.DataFrame(rows, columns=["key", "n_bytes", "spans", "kept"])


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """key and data (bytes) of each row, key ascending in the order of documents, and doc_id by key unless they are equal."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(common.text_or_empty(), "UTF-8").alias("data"))
    plain = own.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null or doc_id < 0").limit(1).count() == 0
    if plain:
        return own.withColumnRenamed("doc_id", "key"), None
    rows = common.materialize(own.withColumn("row", F.monotonically_increasing_id()), "repeats")
    ranked = rows.select("row", "doc_id", F.sha2("data", 256).alias("h")).orderBy(F.asc_nulls_first("doc_id"), "h", "row").select("row").rdd.map(lambda r: r[0]).zipWithIndex().toDF("row long, key long")
    ranked = common.materialize(ranked, "repeats")
    return rows.join(ranked, "row").select("key", "data"), rows.select("row", "doc_id").join(ranked, "row").select("key", "doc_id")


def remove_repeats(docs: DataFrame, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, spans (removed runs, array<struct<first,last>> in bytes), kept (the remaining bytes)."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    keyed, names = _keyed(docs)
    size = keyed.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    doc_parts = next(n for n in range(parts, 3 * parts + 3) if _is_prime(n))
    shared = spark.sparkContext.broadcast(hot_anchors(keyed, hot, sample))  # BITMAP_BITS / 8 bytes
    cut = keyed.select("key", "data").mapInArrow(_find_pieces(parts, doc_parts, shared), _PACKED)
    known = common.materialize(cut.groupBy("part").applyInPandas(_sort_pieces(doc_parts, hot, shared), _PACKED), "repeats")
    common.free_shuffles(spark)
    texts = keyed.select(F.lit(_TEXT).alias("kind"), F.pmod("key", F.lit(doc_parts)).cast("int").alias("part"), "data", "key")
    no_key = F.lit(None).cast("long").alias("key")
    wanted = texts.unionByName(known.filter(F.col("kind") == _VARIANTS).select("kind", "part", "data", no_key))
    pieces = wanted.groupBy("part").applyInPandas(_fetch_bytes(parts, doc_parts), _PACKED)
    more = common.materialize(pieces.groupBy("part").applyInPandas(_search_group(doc_parts), _PACKED), "repeats")
    common.free_shuffles(spark)
    ranges = known.filter(F.col("kind") == _RANGES).unionByName(more).select("kind", "part", "data", no_key)
    out = texts.unionByName(ranges).groupBy("part").applyInPandas(_apply, "key long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")
    if names is None:
        return out.withColumnRenamed("key", "doc_id")
    return out.join(names, "key").select("doc_id", "n_bytes", "spans", "kept")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
