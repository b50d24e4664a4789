"""Token ids in a packed binary table: fixed width, the fewest bits that hold the vocabulary.

Documents are range-partitioned and sorted by doc_id; each partition is a shard and writes blocks of
about BLOCK_IDS ids. A block row is self-contained: the packed payload, the documents in it and their
offsets, so a reader unpacks with numpy and finds a document without reading the rest. A document is
never split over blocks. The table is Parquet in the shared folder, so any executor can read any block.

Encoding goes by pieces: a run of ASCII white space with what follows it, cut again after a lone line end
and between an ASCII letter and punctuation. A byte-level pre-tokenizer never joins characters over such a cut, so the ids
of pieces concatenate to the ids of the text. Pieces are found and hashed (twice 64 bits) with numpy over all
texts of a slice; each worker keeps the ids of the first MEMO_PIECES short pieces it meets, and those it
lacks go to the tokenizer together. Texts with white space beyond ASCII or with an added token go there whole,
as all texts do if the tokenizer isn't of this kind.

Defined cases: a null text is empty; every document ends with END_ID. Null doc_ids come first; rows with equal
doc_ids keep their own entries, in any order among them; they are dealt out by their texts, so only rows equal in both must lie in one shard. An empty table gives a table without blocks. Extra columns are
ignored, whatever their names. A very long text is encoded in segments, and is one block.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm import common
from verdigris.llm.hashing import ODD, Substrings, mix

END_ID, BLOCK_IDS = 0, 1 << 16
#: Bytes of text in a shard.
SHARD_BYTES = 128 << 20
#: Bounds of a worker's table: pieces, and bytes of a piece in it. Characters that are encoded at once.
MEMO_PIECES, MEMO_BYTES, SLICE_CHARS = 1 << 20, 40, 1 << 21
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=[^ \t-\r]) ")
_OTHER, _SPACE, _LETTER, _MARK = range(4)
_KIND = np.array([_SPACE if c == 32 or 9 <= c <= 13 else _LETTER if chr(c).isalpha() and c < 128 else _MARK if 32 < c < 127 and not chr(c).isalnum() else _OTHER for c in range(256)], np.uint8)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """The ids from place first to last, exclusive, as uint32; only their bytes are looked at."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", last - first, first * bits // 8).astype("<u4")
    a, b = first * bits // 8, -(-last * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, b - a, a), bitorder="little")[first * bits - 8 * a :][: (last - first) * bits]
    return (flat.reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def piece_starts(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie one after another in raw and begin at first; pieces cover raw without gaps."""
    kind = _KIND[raw]
    starts = np.zeros(len(raw) + 1, bool)
    starts[1:-1] = ((kind[1:] == _SPACE) & (kind[:-1] != _SPACE)) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
    starts[first] = True
    # A lone line end or tab is a piece of its own.
    ends = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (raw[:-1] != 32) & starts[:-2]) + 1
    starts[ends] = True
    return np.flatnonzero(starts[:-1])


def _end_words(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Length, first eight and last eight bytes of each raw[a:b], which spell pieces of up to 16 bytes."""
    wide = np.r_[np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)]
    words = np.ndarray(len(wide) - 7, "<u8", wide, strides=(1,))
    n = b - a
    yield n
    short = np.minimum(n, 8).astype(np.uint64) * np.uint64(8)
    yield words[a + 8] << (np.uint64(64) - short)
    yield words[b] >> (np.uint64(64) - short)


class PieceTable:
    """Ids of pieces, as arrays sorted by the pieces' hashes."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, "<u4"), 0

    def place(self, ids: np.ndarray) -> int:
        """Put ids behind those in use; returns where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            wider = np.empty(self.used * 5 // 4, "<u4")
            wider[:at] = self.flat[:at]
            self.flat = wider
        self.flat[at : self.used] = ids
        return at

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether the piece is there."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys) & (self.checks[at] == checks) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, checks: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        where = np.searchsorted(self.keys, keys)
        for name, values in (("keys", keys), ("checks", checks), ("first", first), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), where, values))


class Encoder:
    """A tokenizer with the ids of pieces it has met."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        how = made["pre_tokenizer"] or {}
        self.by_pieces = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and not made["normalizer"] and made["model"]["type"] == "BPE"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.by_pieces:
            # A character of a byte-level token is a byte of the text.
            self.spelled = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.spelled[i] = len(token)
            self.by_pieces = self._ids("\n").size == 1
        self.memo = PieceTable()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _met(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces raw[a:b], one after another, and how many each has. Pieces are put in one text, a line end before those that begin without white space."""
        bare, blank = _KIND[raw[a]] != _SPACE, _KIND[raw[b - 1]] == _SPACE
        n = b - a + bare
        n[blank] = 0
        last = np.cumsum(n)
        text = np.full(int(last[-1]) if len(last) else 0, 10, np.uint8)
        for_piece, at = np.repeat(np.arange(len(a)), n), np.arange(len(text))
        source = at - np.repeat(last - n, n) - bare[for_piece] + a[for_piece]
        own = source >= a[for_piece]
        text[own] = raw[source[own]]
        ids = self._ids(text.tobytes().decode("utf-8", "surrogatepass"))
        ends = np.cumsum(self.spelled[ids])
        upto = np.searchsorted(ends, last, "right")
        size = np.diff(np.r_[0, upto])
        keep = np.ones(len(ids), bool)
        heads = (upto - size)[bare & ~blank]
        keep[heads] = False
        size = size - (bare & ~blank)
        ids = ids[keep]
        if blank.any():  # pieces of white space alone, of which there are few kinds
            parts = np.split(ids, np.cumsum(size)[:-1])
            for i in np.flatnonzero(blank).tolist():
                parts[i] = self._ids(raw[a[i] : b[i]].tobytes().decode())
                size[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, size

    def _segments(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        sizes = np.array([len(d) for d in data], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(data), np.uint8)
        if not len(raw):
            return np.empty(0, "<u4"), np.zeros(len(data), np.int64)
        a = piece_starts(raw, ends - sizes)
        b = np.r_[a[1:], len(raw)]
        sub = Substrings(raw)
        keys, some, back = np.unique(sub(a, b), return_index=True, return_inverse=True)
        for ends_of in _end_words(raw, a, b):
            if (ends_of != ends_of[some][back]).any():  # one hash of two pieces
                found = [self._ids(d.decode("utf-8", "surrogatepass")) for d in data]
                return np.concatenate(found), np.array([len(x) for x in found])
        sizes_of = b - a
        a, b = a[some], b[some]
        checks = sub.weighted(a, b)
        memo = self.memo
        at, hit = memo.find(keys, checks)
        if len(memo.keys) >= MEMO_PIECES and (~hit).sum() > len(keys) / 2:
            memo.clear()  # other text than before
            hit[:] = False
        first, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        first[hit], size[hit] = memo.first[at[hit]], memo.size[at[hit]]
        new = np.flatnonzero(~hit)
        held = memo.used
        if len(new):
            # Pieces that are kept come first, so that the ids of the others can be dropped.
            lasting = (b[new] - a[new] <= MEMO_BYTES) & (len(memo.keys) < MEMO_PIECES)
            if len(memo.keys):
                lasting &= memo.keys[at[new]] != keys[new]
            new = np.r_[new[lasting], new[~lasting]]
            ids, n = self._met(raw, a[new], b[new])
            start = memo.place(ids)
            first[new], size[new] = start + np.cumsum(n) - n, n
            m = int(lasting.sum())
            held = start + int(n[:m].sum())
            memo.add(keys[new[:m]], checks[new[:m]], first[new[:m]], size[new[:m]])
        n = size[back]
        total = np.cumsum(n)
        out = memo.flat[np.repeat(first[back] - (total - n), n) + np.arange(int(total[-1]))]
        memo.used = held
        piece_end = np.searchsorted(np.cumsum(sizes_of), ends, "right")
        upto = np.r_[0, total][piece_end]
        return out, np.diff(np.r_[0, upto])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts: list[list] = [[] for _ in texts]
        data, owner, total = [], [], 0

        def flush() -> None:
            ids, n = self._segments(data)
            for i, x in zip(owner, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i].append(x)

        for i, t in enumerate(texts):
            if not self.by_pieces or (not t.isascii() and _OTHER_SPACE.search(t)) or any(x in t for x in self.added):
                parts[i].append(self._ids(t))
                continue
            at = 0
            while at < len(t):
                cut = _CUT.search(t, at + SLICE_CHARS) if len(t) - at > SLICE_CHARS else None
                stop = cut.start() if cut else len(t)
                if total + stop - at > SLICE_CHARS and data:
                    flush()
                    data, owner, total = [], [], 0
                data.append(t[at:stop].encode("utf-8", "surrogatepass"))
                owner.append(i)
                total, at = total + stop - at, stop
        if data:
            flush()
        none = np.empty(0, "<u4")
        return [p[0] if len(p) == 1 else np.concatenate([none, *p]) for p in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, n_shards: int | None = None) -> None:
    """Encode docs (doc_id, text) and write the packed table to path.

    Columns: shard, block, bits, n_ids, first_doc, last_doc, doc_ids, offsets (len(doc_ids) + 1 places), payload.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    common.bound_batches(spark)
    bits = max(1, (Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1).bit_length())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4")
        ids, sizes, payload, total = [], [], [], 0
        doc_type = None

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, sizes, payload, total
            flat = np.concatenate(payload)
            offsets = np.r_[0, np.cumsum(sizes)]
            row = [shard, block, bits, len(flat), ids[0], ids[-1], ids, offsets, pack(flat, bits)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), doc_type, doc_type, pa.list_(doc_type), pa.list_(pa.int64()), pa.binary()]
            block += 1
            ids, sizes, payload, total = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "block", "bits", "n_ids", "first_doc", "last_doc", "doc_ids", "offsets", "payload"])

        for b in batches:
            doc_type = b.column(0).type
            for doc_id, found in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                sizes.append(len(found) + 1)
                payload += [found, end]
                total += len(found) + 1
                if total >= BLOCK_IDS:
                    yield flush()
        if ids:
            yield flush()

    ordered = docs.select("doc_id", common.text_or_empty().alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    blocks = ordered.mapInArrow(run, f"shard int, block int, bits int, n_ids long, first_doc {kind}, last_doc {kind}, doc_ids array<{kind}>, offsets array<long>, payload binary")
    blocks.write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, and first_id: the number of ids before the block."""
    blocks = spark.read.parquet(path).select("shard", "block", "n_ids")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_before"))  # one row for each shard
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return blocks.withColumn("_inside", inside).join(before, "shard").select("shard", "block", (F.col("_before") + F.col("_inside")).alias("first_id"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the packed blocks."""
    blocks = spark.read.parquet(path).select("shard", "block", "bits", "doc_ids", "offsets", "payload")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                o = np.array(row["offsets"])
                ids = unpack(row["payload"], row["bits"], 0, int(o[-1]))
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(o[:-1], o[1:], strict=True)]
                m = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * m, pa.int32()), pa.array([row["block"]] * m, pa.int32()), pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(o[:-1], pa.int64()), pa.array(np.diff(o), pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    common.bound_batches(spark)
    docs = blocks.mapInArrow(run, f"shard int, block int, doc_id {kind}, place long, n_tokens long, ids_crc32 long")
    return docs.join(read_index(spark, path), ["shard", "block"]).select("doc_id", (F.col("first_id") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_id) -> list[int]:
    """Random access: the ids of one document, from the blocks whose range holds it."""
    hit = spark.read.parquet(path).filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id) & F.array_contains("doc_ids", doc_id)).select("bits", "payload", "offsets", F.array_position("doc_ids", doc_id).alias("k")).first()
    return [] if hit is None else unpack(hit["payload"], hit["bits"], hit["offsets"][hit["k"] - 1], hit["offsets"][hit["k"]]).tolist()


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch_path(spark, "token-ids")
    write_token_ids(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    common.delete_at_exit(spark, path)
    return read_documents(spark, path)
