"""Approximate nearest neighbours: anisotropic four-bit product quantisation and exact reranking.

Codebooks are fitted on a bounded sample with the score-aware loss: the residual's part parallel to
the vector costs ETA times its orthogonal part, since it is the parallel part that shifts large inner
products. Every vector is then indexed, once: a shard is a row of a table in the shared folder, with packed codes (two per byte), the vectors and
the bounds of their errors. Queries are a table of blocks of bounded size; a block is broadcast to scan every shard's codes with lookup tables, one table
entry for each byte of codes, and scores the best SEED of the shard exactly in double precision. The
worst of their k best is a threshold t: every row of the shard that can reach it is scored exactly, too.
With code vector c and residual u - c = a u + o of a unit vector u (o orthogonal to u), the score s with
a unit query is s (1 - a) = c.query + o.query <= c.query + |o| sqrt(1 - s^2), which bounds c.query from
below for s >= t > 0. So no row is lost, and the window narrows as t nears 1, as in a group of near
copies. The shards' few best rows meet in one window by query.

Defined cases: vectors that are null, empty, zero, of another length than most rows of the index, or hold
null or non-finite components take no part; all others do, however large or small their components are. Equal vectors share one code row, of which the smallest
ids are kept, as many as can be reported. Ties go to the smaller id; repeated ids are repeated rows. Extra columns are ignored, but
for those that the query condition reads. Empty tables, or no query, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm import common

#: Bound of the rows that codebooks are fitted on (expected number), dimensions of a codebook, weight of parallel error.
SAMPLE, SUB, ETA = 8192, 2, 4.0
#: Bytes of a shard's vectors and of a block's queries, rows of a shard whose exact scores give the threshold, and rows scored at once.
SHARD_BYTES, BLOCK_BYTES, SEED, SCORED_ROWS = 8 << 20, 8 << 20, 256, 4096
_CENTRES, _ROUNDS = 16, 8


def _encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes of unit vectors under the anisotropic loss, by coordinate descent over the codebooks."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, SUB)
    codes = ((parts[:, :, None] - books[None]) ** 2).sum(-1).argmin(-1)
    along = np.einsum("nmd,nmd->nm", parts, parts - books[np.arange(m), codes])  # x . residual, by part
    for _ in range(sweeps):
        for j in range(m):
            rest = along.sum(1) - along[:, j]
            diff = parts[:, j, None] - books[j][None]
            dot = np.einsum("nd,nkd->nk", parts[:, j], diff)
            loss = (diff**2).sum(-1) + (ETA - 1) * (rest[:, None] + dot) ** 2
            codes[:, j] = loss.argmin(1)
            along[:, j] = dot[np.arange(n), codes[:, j]]
    return codes.astype(np.uint8)


def fit_codebooks(sample: np.ndarray) -> np.ndarray:
    """Codebooks (parts x 16 x SUB) for unit vectors: alternating assignment and weighted least squares."""
    n, dim = sample.shape
    m = dim // SUB
    parts = sample.reshape(n, m, SUB)
    rng = np.random.default_rng(7)
    books = parts[rng.choice(n, _CENTRES, replace=n < _CENTRES)].transpose(1, 0, 2).copy()
    for _ in range(_ROUNDS):
        codes = _encode(sample, books, 1)
        for j in range(m):
            other = np.einsum("nmd,nmd->n", parts, parts - books[np.arange(m), codes]) - np.einsum("nd,nd->n", parts[:, j], parts[:, j] - books[j][codes[:, j]])
            for c in range(_CENTRES):
                p = parts[codes[:, j] == c, j]
                if len(p):
                    # min sum |p - b|^2 + (ETA - 1) (other + p.(p - b))^2
                    o = other[codes[:, j] == c] + (p * p).sum(1)
                    books[j, c] = np.linalg.solve(len(p) * np.eye(SUB) + (ETA - 1) * p.T @ p, p.sum(0) + (ETA - 1) * p.T @ o)
    return books


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def _units(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    return (x / big) / np.linalg.norm(x / big, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two so that the largest component is between a half and one: cosines stay the same to the last bit, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _padded(x: np.ndarray) -> np.ndarray:
    """Columns of zeros up to a whole number of code bytes."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * SUB))))


# Arrays of a shard, each stored as bytes: its rows by id, the first row of each group of equal vectors, rows by group and where groups begin,
# packed codes by code byte, parallel and orthogonal error, what rounding adds to a scan, and lengths.
_ARRAYS = {"ids": "<i8", "x": "<f8", "first": "<i8", "by_group": "<i8", "begin": "<i8", "columns": "u1", "along": "<f8", "across": "<f8", "slack": "<f8", "norms": "<f8"}
_STORED = "shard int, dim int, " + ", ".join(f"{n} binary" for n in _ARRAYS)


def _rounding(dim: int) -> float:
    """What rounding adds to an exact score, at most."""
    return 1e-14 * (dim + 2 * SUB + 10)


def _index_shard(ids: np.ndarray, x: np.ndarray, books: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of one shard."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(_scaled(x[order]))
    _, first, group = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    units = _padded(_units(x[first]))
    codes = _encode(units, books)
    columns = (codes[:, 0::2] | codes[:, 1::2] << 4).T  # what a scan reads: half a byte for each codebook
    coded = books[np.arange(len(books)), codes].reshape(units.shape)
    along = ((units - coded) * units).sum(1)
    across = np.sqrt((((units - coded) - along[:, None] * units) ** 2).sum(1))
    slack = (len(columns) + 4) * 2.0**-23 * np.sqrt((coded**2).sum(1)) + _rounding(x.shape[1])
    return {"ids": ids, "x": x, "first": first, "by_group": by_group, "begin": begin, "columns": columns, "along": along, "across": across, "slack": slack, "norms": np.sqrt((x[first] ** 2).sum(1))}


def _search_shard(stored: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int) -> Iterator[tuple]:
    """Best k of one shard for each query: arrays of query row, vec_id, score."""
    ids, x, first, by_group, begin, columns, along, across, slack, norms = (stored[n] for n in _ARRAYS)
    rounding = _rounding(x.shape[1])
    top = min(SEED, len(first))
    for q, (qid, v) in enumerate(zip(query_ids, queries, strict=True)):
        tables = (books * _padded(_units(v[None]))[0].reshape(-1, 1, SUB)).sum(-1).astype(np.float32)
        pairs = (tables[1::2, :, None] + tables[0::2, None, :]).reshape(len(columns), 256)
        approx = pairs[0][columns[0]]
        for t, c in zip(pairs[1:], columns[1:], strict=True):
            approx += t[c]
        length = np.sqrt(v @ v)
        most = k + int(np.searchsorted(ids, qid, "right") - np.searchsorted(ids, qid))  # the query's own rows are not reported

        def scored(groups: np.ndarray, qid=qid, v=v, length=length, most=most) -> tuple[np.ndarray, np.ndarray]:
            """Rows (as many of each group as can be reported) and scores of the k best of groups."""
            near = x[first[groups]] @ v / (norms[groups] * length)
            if len(near) > most:
                some = near >= np.partition(near, -most)[-most]
                groups, near = groups[some], near[some]
            sizes = np.minimum(begin[groups + 1] - begin[groups], most)
            rows = by_group[np.repeat(begin[groups] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            score = np.repeat(near, sizes)
            rows, score = rows[ids[rows] != qid], score[ids[rows] != qid]
            keep = np.lexsort((ids[rows], -score))[:k]
            return rows[keep], score[keep]

        best = np.argpartition(-approx, top - 1)[:top] if top < len(first) else np.arange(top)
        rows, score = scored(best)
        if top < len(first):
            least = min(score[-1], 1.0) - rounding if len(score) == k else -1.0
            reach = approx + slack + across * np.sqrt(1 - least**2) >= least * (1 - along) if least > 0 else np.ones(len(first), bool)
            reach |= along >= 1
            reach[best] = False
            more = np.flatnonzero(reach)
            for at in range(0, len(more), SCORED_ROWS):
                r, s = scored(more[at : at + SCORED_ROWS])
                rows, score = np.r_[rows, r], np.r_[score, s]
                keep = np.lexsort((ids[rows], -score))[:k]
                rows, score = rows[keep], score[keep]
        yield np.full(len(rows), q), ids[rows], score


def build_index(good: DataFrame, books, shards: int) -> DataFrame:
    """The stored index: a row for each shard. Rows are dealt to shards by a hash of vec_id."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(part["embedding"])
        made = _index_shard(part["vec_id"].to_numpy(), x, books.value)
        return pd.DataFrame([{"shard": part["shard"].iloc[0], "dim": x.shape[1], **{n: np.ascontiguousarray(made[n], t).tobytes() for n, t in _ARRAYS.items()}}])

    dealt = good.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    return common.materialize(dealt.groupBy("shard").applyInPandas(run, _STORED), "vectors")


def _query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """The stored queries: a row for each block, with ids and vectors as bytes."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = _scaled(_matrix(part["embedding"]))
        return pd.DataFrame([{"block": part["block"].iloc[0], "query_ids": part["vec_id"].to_numpy().astype("<i8").tobytes(), "queries": x.astype("<f8").tobytes()}])

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int"))
    return common.materialize(dealt.groupBy("block").applyInPandas(run, "block int, query_ids binary, queries binary"), "queries")


def _scanner(books, k: int):
    """Scans stored shards, one at a time, for the block of queries that stands beside each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column("dim")[i].as_py()
                stored = {n: np.frombuffer(b.column(n)[i].as_buffer(), t) for n, t in _ARRAYS.items()}
                stored["x"] = stored["x"].reshape(-1, dim)
                stored["columns"] = stored["columns"].reshape(-1, len(stored["first"]))
                ids, queries = np.frombuffer(b.column("query_ids")[i].as_buffer(), "<i8"), np.frombuffer(b.column("queries")[i].as_buffer(), "<f8").reshape(-1, dim)
                q, v, score = (np.concatenate(x) for x in zip(*_search_shard(stored, ids, queries, books.value, k), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where is_query holds, its k nearest other rows by cosine."""
    spark = vectors.sparkSession
    good = usable(vectors)
    sizes = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes or not sizes[0]["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, n_queries = sizes[0]["dim"], sizes[0]["n"], sizes[0]["q"]
    good = good.filter(F.size("embedding") == dim)
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)
    sample = good.filter(share).select("embedding").toPandas()["embedding"]  # about SAMPLE rows at most
    if not len(sample):
        sample = good.limit(1).toPandas()["embedding"]
    books = spark.sparkContext.broadcast(fit_codebooks(_padded(_units(_matrix(sample)))))
    shards = max(1, -(-n * dim * 8 // SHARD_BYTES))
    common.bound_batches(spark)
    index = build_index(good, books, shards)
    n_blocks = max(1, -(-n_queries * dim * 8 // BLOCK_BYTES))
    blocks = _query_blocks(good.filter(is_query), n_blocks)
    path = common.scratch_path(spark, "nearest")
    for b in range(n_blocks):
        # One block, of about BLOCK_BYTES, meets every shard; what it finds is written, so a plan has one scan of the index.
        block = blocks.filter(F.col("block") == b)
        met = index.withColumn("block", F.lit(b)).join(F.broadcast(block), "block")
        met.mapInArrow(_scanner(books, k), "query_id long, vec_id long, score double").write.parquet(f"{path}/part={b}")
    common.delete_at_exit(spark, path)
    common.discard(index)
    common.discard(blocks)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(*[f"{path}/part={b}" for b in range(n_blocks)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
