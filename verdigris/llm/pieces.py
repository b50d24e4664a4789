"""Encoding into vocabulary pieces by forward filtering and backward sampling, and lossless decoding.

A text is cut into units only where no piece can span the cut: a unit is a run of characters without
space or line feed, however long, with all spaces before it; or spaces alone; or a line feed. If the
vocabulary has a piece with a line feed or with a space behind another character, the text is one unit.
So the lattice of a unit has an edge for every vocabulary piece that covers a stretch of the text, and
one for the bytes of any character that no piece spells. Forward filtering sums the weights of all paths to each place; sampling walks back from the
end, taking each edge with its exact share. The draws are a counter hash of the row's key, the unit's
place and the step, so a row's segmentation does not depend on partitions, batches or retries.

Weights: pieces have ranks, not probabilities, so a piece weighs rank^-THETA; larger THETA prefers
long frequent pieces more. A worker keeps the lattices of the first units it meets, up to a bound; all
others, and all units of over MEMO_CHARS, are built when met. What it keeps goes when it is given a task of another step. A unit of over MEMO_CHARS, such as a text without spaces, is first cut at the places that no
piece spans in it, which are nearly all places of a script that the vocabulary spells by characters. What stays long is filtered together
with others of about one length, padded, a block of places at a time. Walking is vectorised over all units of a slice of texts.

Defined cases: a null text gives a null list and decodes to null; an empty one gives an empty list.
The space marker in a text is spelled by its bytes, so decoding returns every text exactly. Equal
rows (key and text) give equal lists. An empty table gives an empty one. Extra columns are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import common

THETA = 0.6
#: Bounds of the units whose lattices a worker keeps (number, length of each), and characters of one vectorised slice.
MEMO_UNITS, MEMO_CHARS, SLICE_CHARS = 150_000, 41, 1 << 19
#: Cells (units x places x reach) that are filtered at once, and edges that a worker has room for between slices.
_CELLS, _ROOM = 1 << 19, 1 << 21
#: Ids that are decoded at once, some 50 bytes of arrays for each byte they spell.
DECODE_IDS = 1 << 17
#: Units that are filtered one by one.
FEW = 4
_UNIT, _WHOLE = re.compile(r" *[^ \n]+| +|\n"), re.compile(r"(?s).+")
_MARKER = "▁"
#: What the marker itself becomes when it stands in a text, and the base of the hash of a run of characters.
_LITERAL, _BASE = 0x110000, np.uint64(0x9E3779B97F4A7C15)
_GAP = np.uint64(0x110001)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)  # plus one, so that no run of the character 0 is as good as nothing
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_held: list[np.ndarray] = []


def running_powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n at least of the base, and of its inverse modulo 2^64."""
    if not _held or len(_held[0]) <= n:
        size, inverse = max(n, 1 << 16), np.uint64(pow(int(_BASE), -1, 1 << 64))
        _held[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b)]) for b in (_BASE, inverse)]
    return _held


class Vocabulary:
    """Pieces of a model file: hashes with ids and log-weights, and the bytes of each id."""

    def __init__(self, path: str, theta: float = THETA) -> None:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        self.size = p.get_piece_size()
        self.spelled, self.byte_id, pieces = [b""] * self.size, {}, []
        for i in range(self.size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.spelled[i] = piece.replace(_MARKER, " ").encode()
                pieces.append((piece, i, p.get_score(i)))
        best = max((x[2] for x in pieces), default=0.0)
        self.longest = max((len(x[0]) for x in pieces), default=1)
        self.unit = _WHOLE if any("\n" in x[0] or _MARKER in x[0].lstrip(_MARKER) for x in pieces) else _UNIT
        hashes = np.array([_hash(x[0]) for x in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([x[1] for x in pieces], np.int64)[order]
        self.first_bits = np.zeros(1 << 20, bool)
        self.first_bits[hashes >> np.uint64(44)] = True
        self.weights = np.array([-theta * math.log(2 + best - x[2]) for x in pieces])[order]
        self.by_bytes = -theta * math.log(4 * self.size)
        self.lengths = np.array([len(b) for b in self.spelled])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.spelled), np.uint8)

    def _likely(self, h: np.ndarray) -> np.ndarray:
        """Where h can be a piece's hash, by a table of first bits: few other hashes pass."""
        return np.flatnonzero(self.first_bits[h >> np.uint64(44)])

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are a piece's."""
        some, out = self._likely(h), np.zeros(len(h), bool)
        out[some] = self._place(h[some])[1]
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and weight of the piece with each hash; -1 and minus infinity where there is none."""
        flat = h.ravel()
        some = self._likely(flat)
        at, hit = self._place(flat[some])
        ids, weights = np.full(flat.shape, -1, np.int64), np.full(flat.shape, -np.inf)
        ids[some[hit]], weights[some[hit]] = self.ids[at[hit]], self.weights[at[hit]]
        return ids.reshape(h.shape), weights.reshape(h.shape)


def _one_unit(weight: np.ndarray, ids: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """Turn the weights of the edges into the first n places to running shares; the totals of all places, and of those before them."""
    place, k = np.nonzero(ids[: max(n, 0)] >= 0)
    sums, shares, begin = total.tolist(), [], 0
    edges = list(zip((place + k).tolist(), weight[place, k].tolist(), strict=True))
    reach = weight.shape[1]
    for j, end in enumerate(np.cumsum(np.bincount(place, minlength=max(n, 0))).tolist()):
        all_of = [sums[o] + w for o, w in edges[begin:end]]
        top, running, upto = max(all_of), 0.0, []
        for x in all_of:
            running += math.exp(x - top)
            upto.append(running)
        sums[j + reach] = top + math.log(running)
        shares += [x / running for x in upto]
        begin = end
    weight[place, k] = shares
    return np.array(sums)


class Sampler:
    """Lattices of units as flat arrays: states with their first incoming edge, edges with running shares."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.last_state: dict[str, int] = {}
        self.spellings, self.spelling_of = [], {}
        self.n_states = self.n_edges = 0
        self.first_edge = np.empty(1 << 16, np.int32)
        self.share, self.piece, self.came_from = np.empty(1 << 18, np.float32), np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int32)

    def _spelling(self, point: int) -> int:
        """A number beyond the vocabulary that stands for the byte pieces of a character."""
        if point not in self.spelling_of:
            self.spelling_of[point] = self.v.size + len(self.spellings)
            char = _MARKER if point == _LITERAL else chr(point)
            self.spellings.append([self.v.byte_id[b] for b in char.encode("utf-8", "surrogatepass")])
        return self.spelling_of[point]

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            wider = np.empty((at + len(values)) * 5 // 4, held.dtype)
            wider[:at] = held[:at]
            setattr(self, name, held := wider)
        held[at : at + len(values)] = values

    def add(self, units: list[str]) -> None:
        """Forward-filter the lattices of units, those of one length together; above MEMO_CHARS, of nearly one length."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            n = len(u)
            step = 1 if n <= MEMO_CHARS else 1 << max(0, n.bit_length() - 4)
            by_length.setdefault(-(-n // step) * step, []).append(u)
        for n, same in by_length.items():
            some = max(1, _CELLS // (n * min(n, self.v.longest)))
            for at in range(0, len(same), some):
                part = same[at : at + some]
                self._filter(part, max(map(len, part)))

    def _cut(self, units: list[str]) -> dict[str, list[str]]:
        """Units cut at every place that no vocabulary piece spans in them: all paths meet there, so the parts are units of their own."""
        v = self.v
        sizes = np.array([len(u) for u in units])
        ends = np.cumsum(sizes + 1)  # a gap behind each unit
        points = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        points = np.where(points == ord(_MARKER), np.uint64(_LITERAL), np.where(points == 32, np.uint64(ord(_MARKER)), points))
        points[ends - 1] = _GAP
        n = len(points)
        power, inverse = running_powers(n)
        sums = np.r_[np.uint64(0), np.cumsum((points + np.uint64(1)) * inverse[1 : n + 1])]
        spanned = np.zeros(n + 1, np.int32)  # how many pieces begin to span the cut before a place, less those that end to
        for length in range(2, min(int(sizes.max()), v.longest) + 1):
            hit = np.flatnonzero(v.has((sums[length:] - sums[: n + 1 - length]) * power[length : n + 1]))
            spanned[hit + 1] += 1
            spanned[hit + length] -= 1
        safe = np.cumsum(spanned)[:n] == 0
        out = {}
        for u, end, size in zip(units, ends.tolist(), sizes.tolist(), strict=True):
            at = [*np.flatnonzero(safe[end - 1 - size : end - 1]).tolist(), size]
            out[u] = [u[a:b] for a, b in zip([0, *at[1:-1]] if at[0] == 0 else [0, *at[:-1]], at[1:] if at[0] == 0 else at, strict=True)]
        return out

    def _filter(self, units: list[str], n: int) -> None:
        m, v, reach = len(units), self.v, min(n, self.v.longest)
        sizes = np.array([len(u) for u in units])
        points = np.frombuffer("".join(u.ljust(n, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        base = self.n_states + np.cumsum(sizes) - sizes
        self._put("first_edge", self.n_states, np.zeros(int(sizes.sum()), np.int32))
        self.last_state.update(zip(units, (base + sizes - 1).tolist(), strict=True))
        self.n_states += int(sizes.sum())
        total = np.full((m, reach), -np.inf)  # of the places up to a block, as far back as a piece reaches
        total[:, -1] = 0.0
        block = max(reach, _CELLS // (m * reach))
        for start in range(0, n, block):
            total = self._block(points, sizes, base, total, start, min(n, start + block))

    def _block(self, all_points: np.ndarray, sizes: np.ndarray, base: np.ndarray, before: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Put the edges into places start to stop; before has, and the result is, the totals of the last places before the block."""
        (m, reach), v, n = before.shape, self.v, stop - start
        back = min(start, reach - 1)  # characters before the block that a piece can begin with
        points = all_points[:, start - back : stop].astype(np.uint64)
        points = np.where(points == ord(_MARKER), np.uint64(_LITERAL), np.where(points == 32, np.uint64(ord(_MARKER)), points))
        power, inverse = running_powers(back + n)
        sums = np.zeros((m, back + n + 1), np.uint64)
        np.cumsum((points + np.uint64(1)) * inverse[1 : back + n + 1], axis=1, out=sums[:, 1:])
        # Edge k of place j comes from place j - reach + k.
        weight, ids = np.full((m, n, reach), -np.inf), np.full((m, n, reach), -1, np.int64)
        inside = np.arange(start, stop) < sizes[:, None]
        for length in range(1, reach + 1):
            skip = max(0, length - 1 - back)  # places that a piece of this length can't end at
            if skip >= n:
                break
            first, last = back + skip + 1, back + n + 1
            found, w = v.find((sums[:, first:last] - sums[:, first - length : last - length]) * power[first:last])
            if length == 1 and ((found < 0) & inside).any():
                own = points[:, back:]
                lone = np.unique(own[(found < 0) & inside])
                names = np.array([self._spelling(int(x)) for x in lone])
                found = np.where(found < 0, names[np.minimum(np.searchsorted(lone, own), len(lone) - 1)], found)
                w = np.where(np.isinf(w), v.by_bytes, w)
            ids[:, skip:, reach - length], weight[:, skip:, reach - length] = found, w
        weight[:, :, -1] = np.where(inside, weight[:, :, -1], 0.0)  # padding, whose edges are left out
        total = np.concatenate([before, np.full((m, n), -np.inf)], 1)  # shifted so that all places reach back alike
        if m <= FEW:  # place by place in plain numbers, as arrays of so few cost more than they hold
            for i in range(m):
                total[i] = _one_unit(weight[i], ids[i], min(n, int(sizes[i]) - start), total[i])
        for j in range(n if m > FEW else 0):
            weight[:, j] += total[:, j : j + reach]
            top = weight[:, j].max(1)
            mass = np.exp(weight[:, j] - top[:, None])
            sums = mass.cumsum(1)
            total[:, j + reach] = top + np.log(sums[:, -1])
            weight[:, j] = sums / sums[:, -1:]
        unit, place, k = np.nonzero((ids >= 0) & inside[:, :, None])
        origin = start + place + 1 - reach + k
        last = np.r_[(unit[1:] != unit[:-1]) | (place[1:] != place[:-1]), True]
        first = np.flatnonzero(np.r_[True, last[:-1]])
        self.first_edge[base[unit[first]] + start + place[first]] = self.n_edges + first
        self._put("share", self.n_edges, np.where(last, 2.0, weight[unit, place, k]))
        self._put("piece", self.n_edges, ids[unit, place, k])
        self._put("came_from", self.n_edges, np.where(origin > 0, base[unit] + origin - 1, -1))
        self.n_edges += len(k)
        return total[:, n:]

    def _walk(self, unit: int, state: int, seed: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps of one unit from state on, k steps after its end, in plain numbers: unit, step and piece of each."""
        first_edge, share, came_from, edges = self.first_edge, self.share, self.came_from, []
        drawn: list = []
        while state >= 0:
            at = len(edges) % 4096
            if not at:
                with np.errstate(over="ignore"):
                    drawn = ((_mix(seed + np.arange(k + len(edges) + 1, k + len(edges) + 4097, dtype=np.uint64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)).tolist()
            e, u = int(first_edge[state]), drawn[at]
            while share[e] <= u:
                e += 1
            edges.append(e)
            state = int(came_from[e])
        return np.full(len(edges), unit), np.arange(k, k + len(edges)), self.piece[np.array(edges, np.int64)]

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each text has; keys: uint64, one for each text."""
        units = [self.v.unit.findall(t) for t in texts]
        wide = [k for k, t in enumerate(units) if len(max(t, key=len, default="")) > MEMO_CHARS]
        if wide:
            parts = self._cut(sorted({u for k in wide for u in units[k] if len(u) > MEMO_CHARS}))
            for k in wide:
                units[k] = [x for u in units[k] for x in parts.get(u, (u,))]
        used = set().union(*units)
        new = used.difference(self.last_state)
        if len(self.last_state) + len(new) > MEMO_UNITS and len(new) > len(used) / 2:
            self.clear()  # other text than before
            new = used
        lasting = sorted(u for u in new if len(u) <= MEMO_CHARS) if len(self.last_state) + len(new) <= MEMO_UNITS else []
        self.add(lasting)
        held, passing = (self.n_states, self.n_edges), new.difference(lasting)
        self.add(sorted(passing))
        counts = np.array([len(u) for u in units], np.int64)
        where = self.last_state.__getitem__
        state = np.fromiter(map(where, chain.from_iterable(units)), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(state)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = _mix(keys[of] + _mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
        alive, steps, walked, k = np.arange(len(state)), [], [], 0
        length = np.zeros(len(state), np.int64)
        while len(alive) > FEW:
            e = self.first_edge[state[alive]]
            u = (_mix(seed[alive] + np.uint64(k + 1)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            look = np.flatnonzero(self.share[e] <= u)
            while len(look):
                e[look] += 1
                look = look[self.share[e[look]] <= u[look]]
            steps.append((alive, np.full(len(alive), k), self.piece[e]))
            k += 1
            if len(steps) == 1024:  # long units take many steps of few units
                walked, steps = [*walked, tuple(map(np.concatenate, zip(*steps, strict=True)))], []
            length[alive] += 1
            back = self.came_from[e]
            state[alive] = back
            alive = alive[back >= 0]
        for a in alive.tolist():
            walked.append(self._walk(a, int(state[a]), seed[a], k))
            length[a] += len(walked[-1][0])
        ends = np.cumsum(length)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for a, at, p in walked + steps:
            out[ends[a] - 1 - at] = p
        owner = np.repeat(of, length)
        if len(out) and out.max() >= self.v.size:
            sizes = np.ones(self.v.size + len(self.spellings), np.int64)
            sizes[self.v.size :] = [len(s) for s in self.spellings]
            flat = np.concatenate([np.arange(self.v.size), *map(np.array, self.spellings)])
            starts = np.cumsum(sizes) - sizes
            n = sizes[out]
            at = np.repeat(starts[out] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out, owner = flat[at], np.repeat(owner, n)
        for u in passing:
            del self.last_state[u]
        self.n_states, self.n_edges = held
        for name, n in (("first_edge", held[0]), ("share", held[1]), ("piece", held[1]), ("came_from", held[1])):
            if len(getattr(self, name)) > max(_ROOM, 2 * n):
                setattr(self, name, getattr(self, name)[: max(n, _ROOM)].copy())
        return out.astype(np.int32), np.bincount(owner, minlength=len(texts))


def decode_flat(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids spell, and the bytes of each id."""
    n = v.lengths[ids]
    at = np.repeat(v.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return v.flat[at], n


def sampler(path: str, theta: float) -> Sampler:
    held = common.kept("pieces")
    if (path, theta) not in held:
        held[path, theta] = Sampler(Vocabulary(path, theta))
    return held[path, theta]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _sampled(s: Sampler, texts: list[str | None], keys: np.ndarray) -> pa.ListArray:
    lists = []
    for i, j in _slices([t or "" for t in texts]):
        ids, n = s.sample([t or "" for t in texts[i:j]], keys[i:j])
        lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids, pa.int32())))
    out = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
    if None in texts:
        out = pa.array([None if t is None else x for t, x in zip(texts, out.to_pylist(), strict=True)], pa.list_(pa.int32()))
    return out


def _texts(ids: pa.ListArray, v: Vocabulary) -> list[str | None]:
    """The texts that lists of ids spell, worked out DECODE_IDS ids at a time."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    at = np.r_[0, np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))]
    out: list[str | None] = []
    held, begin = bytearray(), 0  # bytes of the lists from `begin` on
    size = np.zeros(len(ids), np.int64)
    for low in range(0, len(flat), DECODE_IDS):
        spelled, n = decode_flat(flat[low : low + DECODE_IDS], v)
        held += spelled.tobytes()
        owner = np.searchsorted(at, np.arange(low, low + len(n)), "right") - 1
        size += np.bincount(owner, n, len(ids)).astype(np.int64)
        done = int(np.searchsorted(at, low + len(n), "right")) - 1  # lists that end here
        upto = 0
        for k in range(begin, done):
            out.append(held[upto : upto + size[k]].decode("utf-8", "surrogatepass"))
            upto += int(size[k])
        del held[:upto]
        begin = max(begin, done)
    out += [""] * (len(ids) - len(out))
    return [t if ok else None for t, ok in zip(out, ids.is_valid().to_pylist(), strict=True)]


def _with_ids(docs: DataFrame, path: str, theta: float, seed: int, key: str, columns: list[tuple[str, str]], more) -> DataFrame:
    """One pass over docs that samples ids; more(batch, ids, sampler) gives the arrays of the columns to return."""
    common.bound_batches(docs.sparkSession)
    drawn = common.free_name("_key", docs.columns)
    keyed = docs.withColumn(drawn, F.xxhash64(F.col(key).cast("string"), F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, theta)
        for b in batches:
            keys = b.column(drawn).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays(more(b, _sampled(s, b.column("text").to_pylist(), keys), s), names=[n for n, _ in columns])

    return keyed.mapInArrow(common.lean(run, "pieces"), ", ".join(f"`{n}` {t}" for n, t in columns))


def encode(docs: DataFrame, model_path: str, theta: float = THETA, seed: int = 0, key: str = "doc_id", decoded: str | None = None) -> DataFrame:
    """docs with a column ids, array<int>: a segmentation of text sampled with the row's key and the seed.

    decoded: the name of a further column for the text that the ids spell, made in the same pass. Columns of docs with these names are replaced.
    """
    cols = [c for c in docs.columns if c not in ("ids", decoded)]
    columns = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name in cols] + [("ids", "array<int>")] + ([(decoded, "string")] if decoded else [])

    def more(b: pa.RecordBatch, ids: pa.ListArray, s: Sampler) -> list:
        return [*[b.column(c) for c in cols], ids, *([pa.array(_texts(ids, s.v), pa.string())] if decoded else [])]

    return _with_ids(docs, model_path, theta, seed, key, columns, more)


def decode(encoded: DataFrame, model_path: str, out: str = "decoded") -> DataFrame:
    """encoded with a column of the texts that its ids spell, in place of one with that name."""
    cols = [c for c in encoded.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sampler(model_path, THETA).v
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array(_texts(b.column("ids"), v), pa.string())], names=[*cols, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in cols)
    return encoded.mapInArrow(common.lean(run, "pieces"), f"{ddl}, `{out}` string")


def round_trip(docs: DataFrame, model_path: str, theta: float = THETA, seed: int = 0) -> DataFrame:
    """For each row of docs: doc_id, n_pieces, ids_crc32 (of the ids as 32-bit little-endian), lossless (decoding gave the text back)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def more(b: pa.RecordBatch, ids: pa.ListArray, s: Sampler) -> list:
        flat, sizes = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        at = np.r_[0, np.cumsum(sizes)]
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        same = [x == y for x, y in zip(_texts(ids, s.v), b.column("text").to_pylist(), strict=True)]
        return [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]

    columns = [("doc_id", kind), ("n_pieces", "long"), ("ids_crc32", "long"), ("lossless", "boolean")]
    return _with_ids(docs.select("doc_id", "text"), model_path, theta, seed, "doc_id", columns, more)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
