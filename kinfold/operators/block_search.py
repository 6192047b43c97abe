"""Exact top-k analogs by blocks.

Identical entities are first reduced to one representative, so copies cost one
row however many there are. Representatives are put into blocks of bounded
size: sets by their size, vectors by a k-d tree.

Sets: a task holds one block of targets and lets packed candidates stream by, those
of near sizes first. Candidates are written once, as compressed pieces of similar sizes, and
each block's task reads them there: no copy is shuffled, so the disk that a search takes
does not depend on the number of blocks. Each target leaves as one row with its k best.

Vectors: round one scores every target against its own block and gives a lower bound
for its k-th similarity. Round two visits only blocks whose best possible similarity
reaches that bound. The kernel turns two blocks into at most k rows per target.

Pairs are never emitted. Results are exact whatever the blocks are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinfold.operators import packed_sets
from kinfold.session import cut_lineage

#: Bounds are sums in another order than scores, so pruning leaves them this much room.
SLACK = 1e-9
#: Room for rounding in squared distances from a matrix product, relative to the norms.
PRESELECT = 1e-9
MIN_BLOCK, MAX_BLOCK = 512, 8192
#: Targets and features of a block of sets: candidates are read by each block, so few and large ones, within the memory of a task.
MAX_SETS, MAX_FEATURES = 262_144, 12_000_000
#: Features of the candidates that are looked at together.
STREAM_FEATURES = 4_000_000
#: Sets and features of a piece, in which sets travel compressed; some 64 KB.
PIECE_SETS, PIECE_FEATURES = 2048, 65_536
MAX_LEAF_DEPTH = 14
SPLIT_POINTS = 20_000
#: Rows of a tile of vectors against a block: five matrices of TILE x MAX_BLOCK doubles are held, 84 MB.
TILE = 256
#: Rows and columns of a tile of two blocks of sets, columns of the first tile at least, before which targets have no bound,
#: and features in its matrix product.
SET_TILE, SET_FACE, FIRST_FACE, FREQUENT = 3072, 16_384, 256, 1024
#: Columns of that product made at once, which stay in a core's cache, columns, of similar sizes, that share a bound,
#: and rows whose product with all columns is held where features are listed.
SET_PIECE, SET_CHUNK, SET_ROWS = 512, 256, 384
#: How long a list has to be to be taken by itself.
SHORT_LIST = 40
#: Features that may be rows of bits, rows made at a time, columns that share a bound, and words of a matrix of bits, which stays in a core's cache.
BIT_FEATURES, BIT_ROWS, BIT_CHUNK, PLANE_WORDS = 4096, 512, 4096, 16_384


@dataclass(frozen=True)
class Part:
    """One similarity: column with the features, metric and weight."""

    column: str
    metric: str = "jaccard"  # or euclid, cosine
    weight: float = 1.0


# ---- kernels on two blocks -------------------------------------------------


class Overlap:
    """Sizes of the intersections of two blocks of sets, tile by tile.

    Right sets are columns. Frequent features count by matrix product, for some left sets at once, the others by lists of
    the columns that have them. Where bounds are given and no feature is rare, features may be rows of bits instead, one bit
    for a column, which full adders sum up.
    """

    def __init__(self, left: pa.ListArray, right: pa.ListArray):
        self.l_len, self.r_len = lengths(left), lengths(right)
        coded = right.flatten().dictionary_encode()
        self.names, self.r_code = len(coded.dictionary), coded.indices.to_numpy()
        found = pc.fill_null(pc.index_in(left.flatten(), value_set=coded.dictionary), -1).to_numpy()
        row = np.repeat(np.arange(len(left)), self.l_len)[found >= 0]
        self.l_code = found[found >= 0]  # what no right set has counts nowhere
        self.l_from = np.searchsorted(row, np.arange(len(left) + 1))
        self.r_from = np.concatenate(([0], np.cumsum(self.r_len)))
        self.l_freq = np.bincount(self.l_code, minlength=self.names)

    def face(self, lo: int, hi: int, by_size: bool = False) -> None:
        """Turn to the right sets from lo to hi, in the order of their sizes if asked."""
        self.width, size = hi - lo, self.r_len[lo:hi]
        #: right set of each column, from lo
        self.column = np.argsort(size, kind="stable") if by_size else np.arange(hi - lo)
        place = np.empty(hi - lo, np.int64)
        place[self.column] = np.arange(hi - lo)
        self.size = size[self.column]
        code = self.r_code[self.r_from[lo] : self.r_from[hi]]
        row = np.repeat(place, size)
        freq = np.where(self.l_freq > 0, np.bincount(code, minlength=self.names), 0)
        met = self.l_freq * freq
        frequent = np.flatnonzero(met > len(self.l_len) * (hi - lo) / 300)
        frequent = frequent[np.argsort(-met[frequent], kind="stable")[:FREQUENT]]
        self.planes = by_size and self._dense(freq, met, frequent)
        if self.planes:
            return self._face_of_bits(code, row, np.flatnonzero(freq))
        self.place = np.full(self.names, -1, dtype=np.int32)
        self.place[frequent] = np.arange(len(frequent))
        rare = (self.place[code] < 0) & (freq[code] > 0)
        known = self.place[code] >= 0
        self.listed = np.sort(code[rare].astype(np.int64) << 32 | row[rare]) & (1 << 32) - 1
        freq[frequent] = 0
        self.at = np.concatenate(([0], np.cumsum(freq)))
        # long lists as arrays of their own, by their numbers
        self.long = np.cumsum((freq >= SHORT_LIST) & (self.l_freq > 0)) - 1
        some = np.flatnonzero((freq >= SHORT_LIST) & (self.l_freq > 0))
        self.lists = [self.listed[b:e] for b, e in zip(self.at[some].tolist(), self.at[some + 1].tolist())]
        self.frequent = len(frequent)
        # without lists the last columns mark the chunks of a piece, by which bounds join the product
        marks = 0 if len(self.listed) else -(-SET_PIECE // SET_CHUNK)
        self.right = np.zeros((hi - lo, len(frequent) + marks), dtype=np.float32)
        self.right[row[known], self.place[code[known]]] = 1
        self.most = np.bincount(row[known], minlength=hi - lo)
        if marks:
            at = np.arange(hi - lo)
            self.right[at, len(frequent) + at % SET_PIECE // SET_CHUNK] = 1

    def _dense(self, freq: np.ndarray, met: np.ndarray, frequent: np.ndarray) -> bool:
        """Whether rows of bits cost less than products and lists, in nanoseconds a pair; a steering only."""
        pairs = max(1, len(self.l_len) * self.width)
        features = np.count_nonzero(freq)
        if features > BIT_FEATURES:
            return False
        met = met.astype(np.float64)
        lists = met.sum() - met[frequent].sum()
        return 0.085 * len(self.l_code) / max(1, len(self.l_len)) + 0.5 < 0.0045 * len(frequent) + (2.4 * lists / pairs + 2.5) * (lists > 0)

    def _face_of_bits(self, code: np.ndarray, column: np.ndarray, features: np.ndarray) -> None:
        # chunks of columns, of whole words
        self.chunks = max(1, self.width // BIT_CHUNK)
        self.words = -(-self.width // (64 * self.chunks))
        self.bit = np.full(self.names, -1, dtype=np.int64)
        self.bit[features] = np.arange(len(features))
        known = self.bit[code] >= 0
        self.bits = self._bit_rows(self.bit[code[known]], column[known], len(features))

    def _bit_rows(self, bit: np.ndarray, column: np.ndarray, rows: int) -> np.ndarray:
        """Bits of the columns that have each feature, and an empty row."""
        made = np.zeros((rows + 1, self.chunks * self.words), np.uint64)
        order = np.argsort(bit, kind="stable")
        bit, column = bit[order], column[order]
        for first in range(0, rows, BIT_ROWS):
            lo, hi = np.searchsorted(bit, (first, min(first + BIT_ROWS, rows)))
            has = np.zeros((min(BIT_ROWS, rows - first), made.shape[1] * 64), np.uint8)
            has[bit[lo:hi] - first, column[lo:hi]] = 1
            made[first : first + len(has)] = np.packbits(has, axis=1, bitorder="little").view("<u8")
        return made

    def _planes(self, rows: np.ndarray) -> list[np.ndarray]:
        """How many features of each left set every column has: a matrix of bits for each binary digit.

        ``rows`` are features of the left sets, padded with the empty row.
        """
        spare, shape = [], (len(rows), self.bits.shape[1])
        new = lambda: spare.pop() if spare else np.empty(shape, np.uint64)
        digits, turned = [[]], np.ascontiguousarray(rows.T)
        held = new()

        def add(x: np.ndarray, d: int) -> None:
            while True:
                if d == len(digits):
                    digits.append([])
                digits[d].append(x)
                if len(digits[d]) < 3:
                    return
                # a full adder: the sum stays in a, the carry goes to the next digit in b
                a, b, c = digits[d]
                np.bitwise_xor(a, b, out=held)
                np.bitwise_and(a, b, out=b)
                np.bitwise_xor(held, c, out=a)
                np.bitwise_and(held, c, out=c)
                np.bitwise_or(b, c, out=b)
                spare.append(c)
                digits[d], x, d = [a], b, d + 1

        for of in turned:
            add(np.take(self.bits, of, axis=0, out=new(), mode="clip"), 0)
        d = 0
        while d < len(digits):
            if len(digits[d]) == 2:
                a, b = digits[d]
                carry = np.bitwise_and(a, b, out=new())
                np.bitwise_xor(a, b, out=a)
                digits[d] = [a]
                spare.append(b)
                if d + 1 == len(digits):
                    digits.append([])
                digits[d + 1].append(carry)
                if len(digits[d + 1]) == 3:
                    x = digits[d + 1].pop()
                    add(x, d + 1)
            d += 1
        return [x[0] for x in digits if x]

    def _reached(self, planes: list[np.ndarray], need: np.ndarray) -> np.ndarray:
        """Bits of the columns whose counts reach what their chunk needs, one at least: the carry of adding the rest to a power of two."""
        shape = (len(need), self.chunks, self.words)
        rest = np.maximum((1 << len(planes)) - need, 0)
        carry, held = np.zeros(shape, np.uint64), np.empty(shape, np.uint64)
        for d, plane in enumerate(planes):
            k = (np.zeros_like(rest) - (rest >> d & 1)).astype(np.uint64)[:, :, None]
            np.bitwise_or(carry, k, out=held)
            np.bitwise_and(held, plane.reshape(shape), out=held)
            np.bitwise_and(carry, k, out=carry)
            np.bitwise_or(carry, held, out=carry)
        return carry.reshape(len(need), -1)

    def _groups(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Left sets from lo to hi, some at a time, and the planes of their counts."""
        rows = self.bit[self.l_code[self.l_from[lo] : self.l_from[hi]]]
        ends = np.concatenate(([0], np.cumsum(rows >= 0)))[self.l_from[lo : hi + 1] - self.l_from[lo]]
        rows, count = rows[rows >= 0], np.diff(ends)
        step = max(1, PLANE_WORDS // max(1, self.bits.shape[1]))
        order = np.argsort(count, kind="stable")
        for some in (order[i : i + step] for i in range(0, hi - lo, step)):
            n = count[some]
            padded = np.full((len(some), max(1, int(n.max()))), len(self.bits) - 1)
            flat = np.repeat(ends[:-1][some], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            padded[np.repeat(np.arange(len(some)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = rows[flat]
            yield some, self._planes(padded)

    def _left(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, column) of the frequent features of the left sets from lo to hi, and the most that a set has."""
        row = np.repeat(np.arange(hi - lo), np.diff(self.l_from[lo : hi + 1]))
        at = self.place[self.l_code[self.l_from[lo] : self.l_from[hi]]]
        row, at = row[at >= 0], at[at >= 0]
        return row, at, int(np.bincount(row, minlength=1).max())

    @staticmethod
    def _packed(row: np.ndarray, at: np.ndarray, rows: int, columns: int, fields: int, bits: int) -> np.ndarray:
        """Left sets as rows of 0/1, those of ``fields`` consecutive sets added up in ``bits`` bits each."""
        m = np.zeros((-(-rows // fields), columns), dtype=np.float32)
        for f in range(fields):
            mine = row % fields == f
            m[row[mine] // fields, at[mine]] += 1 << bits * f
        return m

    def _lists(self, lo: int, hi: int) -> Iterator[np.ndarray | None]:
        """Columns of each left set's rare features, as often as they share one; None if there are none."""
        code = self.l_code[self.l_from[lo] : self.l_from[hi]]
        ends = self.l_from[lo : hi + 1] - self.l_from[lo]
        begin, count = self.at[code], self.at[code + 1] - self.at[code]
        # short lists of all rows are put together at once, long ones as they are
        short, long = (count > 0) & (count < SHORT_LIST), count >= SHORT_LIST
        spans = np.cumsum(count[short]) - count[short]
        joined = self.listed[np.repeat(begin[short] - spans, count[short]) + np.arange(int(count[short].sum()))]
        before = np.concatenate(([0], np.cumsum(np.where(short, count, 0))))[ends].tolist()
        of = np.concatenate(([0], np.cumsum(long)))[ends].tolist()
        number = self.long[code[long]].tolist()
        for i in range(hi - lo):
            lists = list(map(self.lists.__getitem__, number[of[i] : of[i + 1]]))
            if before[i + 1] > before[i]:
                lists.append(joined[before[i] : before[i + 1]])
            yield np.concatenate(lists) if len(lists) > 1 else lists[0] if lists else None

    def rows(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        """Overlaps of each left set from lo to hi with the right ones faced."""
        for top in range(lo, hi, SET_ROWS):
            yield from self._rows(top, min(top + SET_ROWS, hi))

    def _rows(self, lo: int, hi: int) -> Iterator[np.ndarray]:
        row, at, most = self._left(lo, hi)
        fields, bits = fields_of(min(most, int(self.most.max(initial=0))) + 1)
        if len(at):
            made = self._packed(row, at, hi - lo, self.frequent, fields, bits) @ self.right[:, : self.frequent].T
        packed, one = np.empty(self.width, np.int32), np.empty(self.width, np.int32)
        for i, columns in enumerate(self._lists(lo, hi)):
            count = np.zeros(self.width, np.int64) if columns is None else np.bincount(columns, minlength=self.width)
            if len(at):
                if i % fields == 0:
                    np.copyto(packed, made[i // fields], casting="unsafe")
                np.right_shift(packed, bits * (i % fields), out=one)
                np.bitwise_and(one, (1 << bits) - 1, out=one)
                count += one
            yield count

    def tile(self, lo: int, hi: int) -> np.ndarray:
        """The same as a matrix."""
        return np.stack(list(self.rows(lo, hi))) if hi > lo else np.zeros((0, self.width))

    def reaching(self, lo: int, hi: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, right set, overlap) of those whose similarity reaches the floor of their row, but for its rounding.

        A Jaccard similarity of s needs s / (1 + s) of both sizes in common. Columns of a chunk are screened by what
        the least of them needs.
        """
        share, l_len = floor / (1 + floor), self.l_len[lo:hi]
        if self.planes:
            starts = np.arange(0, self.width, 64 * self.words)
        elif len(self.listed):
            starts = np.arange(0, self.width, SET_CHUNK)
        else:
            starts = np.concatenate([np.arange(p, min(p + SET_PIECE, self.width), SET_CHUNK) for p in range(0, self.width, SET_PIECE)])
        least = np.minimum.reduceat(self.size, starts)
        both = l_len[:, None] + least[None, :]
        # room for the rounding of the floor
        room = lambda both: 1e-6 + 1e-9 * both
        need = np.maximum(np.ceil(share[:, None] * both - room(both)), 1).astype(np.int64)
        reaching = self._reaching_bits if self.planes else self._reaching_lists if len(self.listed) else self._reaching_products
        row, col, shared = (np.concatenate(x) for x in zip(*reaching(lo, hi, need)))
        both = l_len[row] + self.size[col]
        good = shared >= share[row] * both - room(both)
        return row[good], self.column[col[good]], shared[good].astype(np.float64)

    def _reaching_bits(self, lo: int, hi: int, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = [(np.zeros(0, np.int64),) * 3]
        # chunks of no column need anything
        need = np.pad(need, ((0, 0), (0, self.chunks - need.shape[1])), constant_values=1)
        for some, planes in self._groups(lo, hi):
            row, col = bit_places(self._reached(planes, need[some]))
            shared = np.zeros(len(row), np.int64)
            for d, plane in enumerate(planes):
                shared += (plane[row, col >> 6] >> (col & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << d
            found.append((some[row], col, shared))
        return found

    def _reaching_lists(self, lo: int, hi: int, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found, even = [(np.zeros(0, np.int64),) * 3], self.width // SET_CHUNK * SET_CHUNK
        passes, chunks = np.empty(self.width, bool), even // SET_CHUNK
        for i, count in enumerate(self.rows(lo, hi)):
            np.greater_equal(count[:even].reshape(chunks, SET_CHUNK), need[i, :chunks, None], out=passes[:even].reshape(chunks, SET_CHUNK))
            if even < self.width:
                np.greater_equal(count[even:], need[i, -1], out=passes[even:])
            col = true_places(passes)
            if len(col):
                found.append((np.full(len(col), i), col, count[col]))
        return found

    def _reaching_products(self, lo: int, hi: int, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlaps of some left sets are fields of one number: exact in 32-bit floats, and the top bit of a field says whether the bound is reached."""
        row, at, most = self._left(lo, hi)
        rows, marks = hi - lo, self.right.shape[1] - self.frequent
        lefts, found = {}, [(np.zeros(0, np.int64),) * 3]
        for n, start in enumerate(range(0, self.width, SET_PIECE)):
            right = self.right[start : start + SET_PIECE]
            wanted = need[:, n * marks : n * marks + marks]
            fields, bits = fields_of(2 * min(most, int(self.most[start : start + SET_PIECE].max())))
            half = 1 << bits - 1
            if fields not in lefts:
                shape = (-(-rows // fields), SET_PIECE)
                lefts[fields] = self._packed(row, at, rows, self.right.shape[1], fields, bits), *(np.empty(shape, kind) for kind in (np.float32, np.int32, np.int32))
            left, *buffers = lefts[fields]
            if len(right) < SET_PIECE:
                buffers = [np.empty((len(left), len(right)), x.dtype) for x in buffers]
            made, packed, marked = buffers
            wanted = np.minimum(wanted, half)
            bias = np.zeros((len(left) * fields, marks), np.int64)
            bias[:rows, : wanted.shape[1]] = half - wanted
            left[:, self.frequent :] = sum(bias[f::fields] << bits * f for f in range(fields))
            np.matmul(left, right.T, out=made)
            np.copyto(packed, made, casting="unsafe")
            np.bitwise_and(packed, sum(half << bits * f for f in range(fields)), out=marked)
            place = true_places(marked)
            number, top, col = packed.ravel()[place], place // len(right), place % len(right)
            for f in range(fields):
                value = number >> bits * f & (1 << bits) - 1
                hit = value >= half
                of, c = top[hit] * fields + f, col[hit]
                found.append((of, start + c, value[hit] - bias[of, c // SET_CHUNK]))
        return found


def fields_of(values: int) -> tuple[int, int]:
    """(fields, bits) of the numbers below ``values`` that fit into the 24 bits to which 32-bit floats are exact."""
    return (3, 8) if values <= 1 << 8 else (2, 12) if values <= 1 << 12 else (1, 24)


def bit_places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the bits that are set in a matrix of 64-bit words."""
    row, word = bits.nonzero()
    one = np.unpackbits(bits[row, word].view(np.uint8), bitorder="little")
    at = one.nonzero()[0]
    return row[at >> 6], 64 * word[at >> 6] + (at & 63)


def true_places(mask: np.ndarray) -> np.ndarray:
    """Places of the few values of a contiguous array that are not zero; eight bytes of zeros are one look."""
    flat = mask.ravel()
    step = 8 // flat.itemsize
    even = len(flat) // step * step
    some = flat[:even].view(np.uint64).nonzero()[0]
    at = (step * some[:, None] + np.arange(step)).ravel()
    at = at[flat[at] != 0]
    return at if even == len(flat) else np.concatenate([at, even + np.flatnonzero(flat[even:])])


def set_overlap(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Size of the intersection of every left set with every right set."""
    both = Overlap(left, right)
    both.face(0, len(right))
    return both.tile(0, len(left))


def lengths(sets: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def jaccard(overlap: np.ndarray, l_len: np.ndarray, r_len: np.ndarray) -> np.ndarray:
    overlap = overlap.astype(np.float64)
    union = l_len + r_len - overlap
    return np.divide(overlap, union, out=np.zeros_like(overlap), where=union > 0)


def vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(known, matrix): which rows have a vector, and those vectors."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return known, flat.reshape(known.sum(), -1) if known.any() else flat.reshape(0, 1)


def distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    total = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        total += (left[:, j, None] - right[None, :, j]) ** 2
    return np.sqrt(total)


def nearest_vectors(metric: str, left: pa.ListArray, right: pa.ListArray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the k best vectors of each row; earlier columns win ties.

    One matrix product gives every squared distance up to a rounding error far below PRESELECT; what may be among
    the k best by that is measured exactly, the differences of the coordinates in their order.
    """
    (has_l, a), (has_r, b) = vectors(left), vectors(right)
    if not len(a) or not len(b):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    dims = a.shape[1]
    a_norm, b_norm = (a * a).sum(1), (b * b).sum(1)
    square = a_norm[:, None] + b_norm[None, :] - 2 * (a @ b.T)
    room = PRESELECT * (1 + a_norm.max() + b_norm.max())
    least = floor[has_l]
    most = (dims * np.maximum(0, 1 - least) ** 2 if metric == "euclid" else 2 * (1 - least)) + room
    if square.shape[1] > k:
        most = np.minimum(most, np.partition(square, k - 1, axis=1)[:, k - 1] + 2 * room)
    row, col = np.nonzero(square <= most[:, None])
    total = np.zeros(len(row))
    for j in range(dims):
        total += (a[row, j] - b[col, j]) ** 2
    d = np.sqrt(total)
    similarity = np.round(1 - d / math.sqrt(dims) if metric == "euclid" else 1 - d**2 / 2, 12)
    good = (similarity >= least[row]) & (similarity > 0)
    row, col, similarity = np.flatnonzero(has_l)[row[good]], np.flatnonzero(has_r)[col[good]], similarity[good]
    order = np.lexsort((col, -similarity, row))
    row, col, similarity = row[order], col[order], similarity[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], col[best], similarity[best]


def vector_similarity(metric: str, left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """Similarity matrix; an entity without the feature has similarity 0."""
    out = np.zeros((len(left), len(right)))
    (has_l, a), (has_r, b) = vectors(left), vectors(right)
    if len(a) and len(b):
        d = distance(a, b)
        out[np.ix_(has_l, has_r)] = 1 - d / math.sqrt(a.shape[1]) if metric == "euclid" else 1 - d**2 / 2
    return out


def best_rows(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best per row; earlier columns win ties."""
    floor = floor.copy()
    possible = (scores >= floor[:, None]) & (scores > 0)
    many = np.flatnonzero(possible.sum(axis=1) > k)
    if len(many):
        floor[many] = -np.partition(-scores[many], k - 1, axis=1)[:, k - 1]
        possible[many] = (scores[many] >= floor[many, None]) & (scores[many] > 0)
    row, col = np.nonzero(possible)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def best_of(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; earlier columns win ties."""
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], col[best], score[best]


def reaching_blends(
    parts: list[Part], sets: dict[str, Overlap], top: int, low: int, left: int, right: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the left sets from top to low and the right ones faced, for parts with sets that all add up to the floor of a row.

    Sums of 32 bits say which may reach it; only those are made exactly.
    """
    weight = sum(p.weight for p in parts)
    of = [sets[p.column] for p in parts]
    sizes = [both.size.astype(np.float32) for both in of]
    found = []
    for i, overlaps in enumerate(zip(*(both.rows(top, low) for both in of))):
        about = np.zeros(right - left, np.float32)
        for p, both, size, shared in zip(parts, of, sizes, overlaps):
            shared = shared.astype(np.float32)
            union = size + np.float32(both.l_len[top + i])
            union -= shared
            np.maximum(union, np.float32(0.5), out=union)
            np.divide(shared, union, out=union)
            union *= np.float32(p.weight / weight)
            about += union
        col = np.flatnonzero((about >= floor[i] - 1e-5) & (about > 0))
        made = np.round(sum(p.weight / weight * jaccard(x[col], both.l_len[top + i], both.r_len[left:right][col]) for p, both, x in zip(parts, of, overlaps)), 12)
        found.append((np.full(len(col), i), col, made))
    row, col, made = (np.concatenate(x) for x in zip(*found))
    good = made > 0
    return row[good], col[good], made[good]


def set_scores(
    parts: list[Part], targets: pa.Table, candidates: pa.Table, k: int, least: np.ndarray, first: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, similarity) of the k best candidates of each target, for parts with sets.

    Overlaps are made for tiles of both blocks. What is found in one tile raises a target's bound for the next;
    ``first`` is the width of the first tiles, narrow as long as there are no bounds.
    Twelve digits, so that the order of sums changes neither ties nor what reaches the floor.
    """
    weight = sum(p.weight for p in parts)
    sets = {p.column: Overlap(targets[p.column].combine_chunks(), candidates[p.column].combine_chunks()) for p in parts if p.metric == "jaccard"}
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * -(-len(least) // SET_TILE)
    least = least.copy()
    # faces grow with what is seen: one that is so many times wider than all before it finds about as many times k
    starts, wider = [0], min(max(100 // k, 1), 7)
    while starts[-1] < candidates.num_rows:
        starts.append(min(starts[-1] + min(max(wider * starts[-1], first or max(FIRST_FACE, 4 * k)), SET_FACE), candidates.num_rows))
    for left, right in zip(starts, starts[1:]):
        for both in sets.values():
            both.face(left, right, by_size=len(parts) == 1)
        for n, top in enumerate(range(0, len(least), SET_TILE)):
            low = min(top + SET_TILE, len(least))
            floor = least[top:low]
            made = None
            if len(parts) == 1:
                both = sets[parts[0].column]
                l_len, r_len = both.l_len[top:low], both.r_len[left:right]
                if (floor / (1 + floor) * (l_len + r_len.min()) - 1e-2 > np.minimum(l_len, r_len.max())).all():
                    continue
                row, col, shared = both.reaching(top, low, floor)
                made = np.round(jaccard(shared, l_len[row], r_len[col]), 12)
                if len(row) > (low - top) * (right - left) / 20:
                    scores = np.zeros((low - top, right - left))
                    scores[row, col], made = made, None
            elif len(sets) == len(parts):
                row, col, made = reaching_blends(parts, sets, top, low, left, right, floor)
            else:
                similar = lambda p: (
                    jaccard(sets[p.column].tile(top, low), sets[p.column].l_len[top:low, None], sets[p.column].r_len[None, left:right])
                    if p.column in sets
                    else vector_similarity(p.metric, targets[p.column][top:low].combine_chunks(), candidates[p.column][left:right].combine_chunks())
                )
                scores = np.round(sum(p.weight / weight * similar(p) for p in parts), 12)
            if made is None:
                row, col = best_rows(scores, k, floor)
                made = scores[row, col]
            good = made >= floor[row]
            row, col, made = (np.concatenate(x) for x in zip(found[n], (row[good], col[good] + left, made[good])))
            found[n] = row, col, made = best_of(row, col, made, k)
            full = np.flatnonzero(np.bincount(row, minlength=low - top) == k)
            last = np.searchsorted(row, full, side="right") - 1
            least[top + full] = np.maximum(least[top + full], made[last])
    for n, (row, col, made) in enumerate(found):
        yield row + n * SET_TILE, col, made


def vector_scores(part: Part, targets: pa.Table, candidates: pa.Table, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for one part with vectors."""
    right = candidates[part.column].combine_chunks()
    for top in range(0, len(least), TILE):
        row, col, made = nearest_vectors(part.metric, targets[part.column][top : top + TILE].combine_chunks(), right, k, least[top : top + TILE])
        yield row + top, col, made


def block_kernel(parts: list[Part], order: list[str], k: int, floor: float, schema: T.StructType):
    """Function for a cogroup of targets and candidates."""
    arrow_schema = to_arrow_schema(schema)

    def score(targets: pa.Table, candidates: pa.Table) -> pa.Table:
        if not targets.num_rows or not candidates.num_rows:
            return arrow_schema.empty_table()
        candidates = candidates.sort_by([(c, "ascending") for c in order]).combine_chunks()
        least = np.round(np.maximum(targets["bound"].to_numpy(), floor), 12)
        vectors_only = len(parts) == 1 and parts[0].metric != "jaccard"
        results = vector_scores(parts[0], targets, candidates, k, least) if vectors_only else set_scores(parts, targets, candidates, k, least)
        names, found = candidates.select(order), []
        for row, col, made in results:
            hit = names.take(pa.array(col))
            columns = {"target": targets["target"].take(pa.array(row)), "similarity": pa.array(made)}
            found.append(pa.table({**columns, **{c: hit[c] for c in order}}).select(schema.names).cast(arrow_schema))
        return pa.concat_tables(found)

    return score


class Nearest:
    """The k best candidates of each target of a block, while candidates stream by."""

    def __init__(self, parts: list[Part], words: dict[str, np.ndarray], targets: pa.Table, k: int, floor: float):
        self.parts, self.words, self.k = parts, words, k
        targets = self._plain(targets)
        main = max((p for p in parts if p.metric == "jaccard"), key=lambda p: p.weight).column
        # tiles of similar sizes
        self.targets = targets.take(pa.array(np.argsort(lengths(targets[main].combine_chunks()), kind="stable")))
        self.least = np.full(len(self.targets), np.round(floor, 12))
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * -(-len(self.targets) // SET_TILE)
        self.place, self.hits = np.zeros(0, np.int64), []

    def _plain(self, table: pa.Table) -> pa.Table:
        for column, words in self.words.items():
            sets = packed_sets.unpack_sets(table[column].combine_chunks(), words)
            table = table.set_column(table.schema.get_field_index(column), column, sets)
        return table.combine_chunks()

    def see(self, candidates: pa.Table) -> None:
        candidates = self._plain(candidates.sort_by("_place"))  # earlier candidates win ties
        before = len(self.place)
        self.place = np.concatenate([self.place, candidates["_place"].to_numpy()])
        self.hits += candidates["_hits"].chunks
        for n, (row, col, made) in enumerate(set_scores(self.parts, self.targets, candidates, self.k, self.least, SET_FACE if before else None)):
            if not len(row):
                continue
            row, col, made = (np.concatenate(x) for x in zip(self.found[n], (row - n * SET_TILE, col + before, made)))
            best = np.lexsort((self.place[col], -made, row))
            best = best[np.arange(len(row)) - np.searchsorted(row[best], row[best]) < self.k]
            self.found[n] = row, col, made = row[best], col[best], made[best]
            full = np.flatnonzero(np.bincount(row) == self.k)
            last = np.searchsorted(row, full, side="right") - 1
            self.least[n * SET_TILE + full] = np.maximum(self.least[n * SET_TILE + full], made[last])

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row for each target with a neighbour; copies of a candidate are neighbours of their own."""
        hits = pa.chunked_array(self.hits) if self.hits else None
        for n, (row, col, made) in enumerate(self.found):
            if not len(row):
                continue
            lists = hits.take(pa.array(col)).combine_chunks()
            flat, count = lists.flatten(), lengths(lists)
            row, made = np.repeat(row, count), np.repeat(made, count)
            if (count > 1).any():
                keys = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
                table = pa.table({"_row": row, "_worse": -made, **keys})
                best = pc.sort_indices(table, [(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy()
                best = best[np.arange(len(row)) - np.searchsorted(row[best], row[best]) < self.k]
                row, made, flat = row[best], made[best], flat.take(pa.array(best))
            some, first = np.unique(row, return_index=True)
            ends = pa.array(np.append(first, len(row)), pa.int32())
            of = self.targets.take(pa.array(some + n * SET_TILE))
            near = pa.ListArray.from_arrays(ends, flat.field(flat.type.num_fields - 1))
            columns = [of["_target"], of["_n"], near, pa.ListArray.from_arrays(ends, pa.array(made))]
            yield from pa.table(columns, names=schema.names).cast(schema).to_batches()


def piece_bytes(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed binary."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def piece_rows(piece: bytes) -> pa.Table:
    return pa.ipc.open_stream(piece).read_all()


PIECE = "_home int, _lo int, _hi int, _first long, _features long, _piece binary"


def piece_kernel(kept: list[str]):
    """Function for sets in the order of their homes and sizes: pieces of the columns kept, within one home each.

    Each home ends with a row without a piece that has its least and largest size.
    """
    arrow_schema = to_arrow_schema(T.StructType.fromDDL(PIECE))

    def made(home: int, sizes: np.ndarray, first: int, rows: pa.RecordBatch | None) -> pa.RecordBatch:
        row = {"_home": home, "_lo": int(sizes.min()), "_hi": int(sizes.max()), "_first": first, "_features": int(sizes.sum()), "_piece": rows and piece_bytes(rows)}
        return pa.RecordBatch.from_pylist([row], schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, ends, seen = None, np.zeros(0, np.int64), 0
        for batch in batches:
            homes, sizes = (batch.column(c).to_numpy().astype(np.int64) for c in ("_home", "_size"))
            part = np.stack([homes, np.arange(len(sizes)) // PIECE_SETS, np.cumsum(sizes) // PIECE_FEATURES])
            cuts = np.flatnonzero((np.diff(part) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                if lo == hi:
                    continue
                if home is not None and homes[lo] != home:
                    yield made(home, ends, seen, None)
                    ends = np.zeros(0, np.int64)
                home = int(homes[lo])
                ends = np.array([min([*ends, sizes[lo:hi].min()]), max([*ends, sizes[lo:hi].max()])])
                yield made(home, sizes[lo:hi], seen, batch.slice(lo, hi - lo).select(kept))
                seen += 1
        if home is not None:
            yield made(home, ends, seen, None)

    return run


def stream_kernel(parts: list[Part], words: dict[str, np.ndarray], k: int, floor: float, schema: T.StructType):
    """Function for pieces in the order of their blocks: the targets of a block, then its candidates."""
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, near, held, weight = None, None, [], 0

        def flush() -> None:
            nonlocal near, held, weight
            rows, held, weight = held, [], 0
            if not rows:
                return
            table = pa.concat_tables(rows)
            if near is None:
                near = Nearest(parts, words, table, k, floor)
            else:
                near.see(table)

        for batch in batches:
            for block, far, features, piece in zip(*(batch.column(c) for c in ("_home", "_far", "_features", "_piece"))):
                block, candidates = block.as_py(), far.as_py() >= 0
                if block != home:
                    flush()
                    if near is not None:
                        yield from near.rows(arrow_schema)
                    home, near = block, None
                elif candidates and near is None:
                    flush()
                held.append(piece_rows(piece.as_buffer()))
                weight += features.as_py()
                if candidates and (sum(len(b) for b in held) >= SET_FACE or weight >= STREAM_FEATURES):
                    flush()
        flush()
        if near is not None:
            yield from near.rows(arrow_schema)

    return run


# ---- blocks ----------------------------------------------------------------


class SizeBlocks:
    """Sets of similar size; Jaccard is at most the ratio of the sizes."""

    def __init__(self, sides: list[DataFrame], column: str, block_rows: int, block_features: int = MAX_FEATURES, size: Column | None = None):
        self.column, self._size = column, size
        counts = None
        for side in sides:
            c = side.groupBy(self.bucket().alias("bucket")).agg(
                F.count(F.lit(1)).alias("n"), F.min(self.size()).alias("lo"), F.max(self.size()).alias("hi")
            )
            counts = c if counts is None else counts.unionByName(c)
        # buckets grow by 5 %, so there are a few hundred at most
        table = (
            counts.groupBy("bucket").agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .orderBy("bucket").toPandas()
        )
        group, rows, features = [], 0, 0
        table["features"] = table["n"] * table["hi"]
        for n, f in zip(table["n"], table["features"]):
            start = not group or rows + n > block_rows or features + f > block_features
            group.append((group[-1] + 1 if group else 0) if start else group[-1])
            rows, features = (n, f) if start else (rows + n, features + f)
        table["group"] = group
        by = table.groupby("group").agg(n=("n", "sum"), features=("features", "sum"), lo=("lo", "min"), hi=("hi", "max"))
        by["chunks"] = np.maximum(-(-by["n"] // block_rows), -(-by["features"] // block_features))
        by["first"] = by["chunks"].cumsum() - by["chunks"]
        self.table = table.join(by[["first", "chunks"]], on="group")
        self.lo = np.repeat(by["lo"].to_numpy(), by["chunks"]).astype(float)
        self.hi = np.repeat(by["hi"].to_numpy(), by["chunks"]).astype(float)
        self.count = len(self.lo)

    def size(self) -> Column:
        return F.coalesce(F.size(self.column), F.lit(0)) if self._size is None else self._size

    def bucket(self) -> Column:
        return F.floor(F.log(F.greatest(self.size(), F.lit(1))) / math.log(1.05)).cast("int")

    def assign(self, df: DataFrame) -> DataFrame:
        rows = [(int(r.bucket), int(r.first), int(r.chunks)) for r in self.table.itertuples()]
        table = df.sparkSession.createDataFrame(rows, "bucket int, first int, chunks int")
        place = (F.col("first") + F.pmod(F.hash("sig"), F.col("chunks"))).cast("int")
        return (
            df.withColumn("bucket", self.bucket())
            .join(F.broadcast(table), "bucket")
            .withColumn("block", place)
            .drop("bucket", "first", "chunks")
        )

    def hold(self, candidates: DataFrame) -> None:
        """Note which blocks have candidates and of which sizes."""
        found = candidates.groupBy("block").agg(F.min(self.size()).alias("lo"), F.max(self.size()).alias("hi")).toPandas()
        at = found["block"].to_numpy(dtype=int)
        self.held = np.zeros(self.count, dtype=bool)
        self.held[at] = True
        self.lo[at], self.hi[at] = found["lo"], found["hi"]


class TreeBlocks:
    """Leaves of a k-d tree; similarity is bounded by the distance to the leaf's box."""

    def __init__(self, sides: list[DataFrame], column: str, block_rows: int, metric: str):
        self.column, self.metric = column, metric
        known = sides[-1].where(F.col(column).isNotNull())
        # split points only: they decide where blocks end, never which rows count
        points = np.array([r[0] for r in known.orderBy(F.xxhash64("sig")).select(column).limit(SPLIT_POINTS).collect()])
        depth = min(MAX_LEAF_DEPTH, max(0, math.ceil(math.log2(max(1, known.count() / block_rows)))))
        self.dims = points.shape[1] if len(points) else 1
        boxes = [(np.full(self.dims, -np.inf), np.full(self.dims, np.inf), points)]
        self.levels = []
        for _ in range(depth if len(points) else 0):
            level, below = [], []
            for lo, hi, inside in boxes:
                dim = int(np.argmax(np.ptp(inside, axis=0))) if len(inside) else 0
                cut = float(np.median(inside[:, dim])) if len(inside) else 0.0
                level.append((dim, cut))
                left_hi, right_lo = hi.copy(), lo.copy()
                left_hi[dim] = min(hi[dim], cut)
                right_lo[dim] = max(lo[dim], cut)
                side = inside[:, dim] > cut if len(inside) else np.zeros(0, dtype=bool)
                below += [(lo, left_hi, inside[~side]), (right_lo, hi, inside[side])]
            self.levels.append((np.array([d for d, _ in level]), np.array([c for _, c in level])))
            boxes = below
        leaves = len(boxes)
        counts = np.zeros(leaves, dtype=int)
        for side in sides:
            leaf = self._place(np.arange(leaves), np.ones(leaves, dtype=int))
            for r in side.groupBy(leaf.alias("leaf")).count().collect():  # at most one row per leaf
                counts[r["leaf"]] = max(counts[r["leaf"]], r["count"])
        self.chunks = np.maximum(1, -(-counts // block_rows))
        self.first = np.cumsum(self.chunks) - self.chunks
        self.lo = np.repeat(np.array([b[0] for b in boxes]), self.chunks, axis=0)
        self.hi = np.repeat(np.array([b[1] for b in boxes]), self.chunks, axis=0)
        self.count = int(self.chunks.sum())

    def _place(self, first: np.ndarray, chunks: np.ndarray) -> Column:
        """Block of a vector: the first one of its leaf plus a hashed chunk; leaf 0 without a vector."""
        levels = self.levels

        @F.pandas_udf(T.IntegerType())
        def place(features: pd.Series, spread: pd.Series) -> pd.Series:
            leaf = np.zeros(len(features), dtype=np.int64)
            known = features.notna().to_numpy()
            if known.any() and levels:
                x = np.array(features[known].tolist(), dtype=np.float64)
                at = np.zeros(len(x), dtype=np.int64)
                for dims, cuts in levels:
                    at = 2 * at + (x[np.arange(len(x)), dims[at]] > cuts[at])
                leaf[known] = at
            return pd.Series(first[leaf] + spread.to_numpy() % chunks[leaf])

        return place(F.col(self.column), F.pmod(F.hash("sig"), F.lit(1_000_003)))

    def assign(self, df: DataFrame) -> DataFrame:
        return df.withColumn("block", self._place(self.first, self.chunks))

    def hold(self, candidates: DataFrame) -> None:
        """Note which leaves have candidates."""
        self.held = np.zeros(self.count, dtype=bool)
        self.held[[r[0] for r in candidates.select("block").distinct().collect()]] = True

    def measure(self) -> Column:
        """What ``best_possible`` needs of a row."""
        return F.col(self.column)

    def best_possible(self, features: pd.Series) -> np.ndarray:
        out = np.ones((len(features), self.count))
        known = features.notna().to_numpy()
        if known.any():
            x = np.array(features[known].tolist(), dtype=np.float64)
            total = np.zeros((len(x), self.count))
            for j in range(self.dims):
                total += np.maximum(0, np.maximum(self.lo[None, :, j] - x[:, j, None], x[:, j, None] - self.hi[None, :, j])) ** 2
            out[known] = 1 - (np.sqrt(total / self.dims) if self.metric == "euclid" else total / 2)
        return out + 1e-12


def block_size(rows: int, cores: int, most: int = MAX_BLOCK) -> int:
    """Enough block pairs to keep every core busy, within memory bounds."""
    return max(MIN_BLOCK, min(most, math.ceil(rows / math.ceil(math.sqrt(4 * cores)))))


# ---- the operator ----------------------------------------------------------


def _representatives(df: DataFrame, parts: list[Part], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): the first entity in ``order`` of each distinct features, as ``name``."""
    columns = [p.column for p in parts]
    # SHA-256 of the features stands for them as a key
    keyed = df.withColumn("sig", F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)))
    rep = keyed.groupBy("sig").agg(*(F.first(c).alias(c) for c in columns), F.min(F.struct(*order)).alias("_best"))
    rep = rep.select("sig", *columns, "_best.*").withColumnRenamed(order[-1], name).persist()
    return keyed.drop(*columns).join(rep.select("sig", name), "sig").drop("sig"), rep


def pack(frames: list[DataFrame], parts: list[Part]) -> tuple[list[DataFrame], dict[str, np.ndarray]]:
    """The frames with their sets packed alike, and the dictionaries by which; the first frame gives the dictionaries."""
    words = {p.column: packed_sets.learn(frames[0], p.column) for p in parts if p.metric == "jaccard"}
    for column, found in words.items():
        frames = [packed_sets.pack(df, column, found) for df in frames]
    return frames, words


def by_sets(parts: list[Part]) -> bool:
    """Whether sets weigh most, and so are searched as a stream."""
    return max(parts, key=lambda p: p.weight).metric == "jaccard"


def _stream_search(targets: DataFrame, candidates: DataFrame, parts: list[Part], words: dict[str, np.ndarray], k: int, order: list[str], floor: float, block_rows: int | None) -> DataFrame:
    """``top_matches`` of packed sets."""
    columns = [p.column for p in parts]
    main = max(parts, key=lambda p: p.weight)
    keyed = lambda df: df.withColumn("sig", F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)))
    kept = [F.first(c).alias(c) for c in columns]
    of = keyed(targets.select("id", *columns))
    t_rep = of.groupBy("sig").agg(*kept, F.min("id").alias("_target"), F.count(F.lit(1)).alias("_n")).persist()
    among = keyed(candidates.select(*columns, *order, "id"))
    first = W.partitionBy("sig").orderBy(*order, "id")
    hits = (
        among.select("sig", *order, "id").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
        .groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("_r", *order, "id"))).alias("hits"))
        .select("sig", F.transform("hits", lambda h: F.struct(*(h[c].alias(c) for c in order), h["id"].alias("id"))).alias("_hits"))
    )
    # places number the candidates in the order of ties and must not change
    c_rep = cut_lineage(
        among.groupBy("sig").agg(*kept).join(hits, "sig").drop("sig").orderBy(*(F.col("_hits")[0][c] for c in [*order, "id"]))
        .withColumn("_place", F.monotonically_increasing_id())
    )
    size = packed_sets.size(main.column)
    cores = targets.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        block_rows = max(MIN_BLOCK, min(MAX_SETS, math.ceil(t_rep.count() / math.ceil(1.5 * cores))))
    blocks = SizeBlocks([t_rep], main.column, block_rows, size=size)
    kinds = {f.name: f.dataType for f in t_rep.schema}
    cut = lambda df, *kept: df.mapInArrow(piece_kernel([*kept, *columns]), PIECE)
    own = blocks.assign(t_rep).withColumn("_home", F.col("block")).withColumn("_size", size).select("_home", "_size", "_target", "_n", *columns)
    own = cut(own.repartitionById(blocks.count, F.col("_home")).sortWithinPartitions("_home", "_size"), "_target", "_n")
    sized = c_rep.select(F.lit(0).alias("_home"), size.alias("_size"), "_place", "_hits", *columns)
    pieces = cut_lineage(cut(sized.repartitionByRange("_size", "_place").sortWithinPartitions("_size", "_place"), "_place", "_hits").where("_piece IS NOT NULL"))
    # a row without a piece, which the pieces of targets meet; that of a home meets the candidates
    none = targets.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema))
    among = pieces.unionByName(none).select(*(F.col(c).alias(f"c{c}") for c in pieces.columns)).coalesce(1)
    share = main.weight / sum(p.weight for p in parts)
    double = lambda c: F.col(c).cast("double")
    ratio = F.when(F.col("c_hi") < F.col("_lo"), double("c_hi") / F.col("_lo")).when(F.col("c_lo") > F.col("_hi"), double("_hi") / F.col("c_lo")).otherwise(1.0)
    possible = ratio * share + (1 - share)
    middle = lambda lo, hi: F.log(F.greatest(double(lo), F.lit(1.0)) * F.greatest(double(hi), F.lit(1.0))) / 2
    far = F.floor(F.abs(middle("c_lo", "c_hi") - middle("_lo", "_hi")) * 5).cast("int")
    itself = F.col("_piece").isNotNull()
    meet = (itself & F.col("c_piece").isNull()) | (~itself & F.col("c_piece").isNotNull() & (possible >= floor - SLACK) & (possible > 0))
    mine = lambda c: F.when(itself, F.col(c)).otherwise(F.col(f"c{c}")).alias(c)
    # each home's partition reads the pieces of candidates where they were written
    rows = own.join(among.hint("shuffle_replicate_nl"), meet).select("_home", F.when(itself, -1).otherwise(far).alias("_far"), *(mine(c) for c in ("_first", "_features", "_piece")))
    entity = candidates.schema["id"].dataType
    schema = T.StructType([
        T.StructField("_target", kinds["_target"]), T.StructField("_n", T.LongType()),
        T.StructField("near", T.ArrayType(entity)), T.StructField("similarity", T.ArrayType(T.DoubleType())),
    ])
    found = cut_lineage(
        rows.sortWithinPartitions("_home", "_far", "_first").mapInArrow(stream_kernel(parts, words, k + 1, floor, schema), schema)
    )
    copies = t_rep.where("_n > 1").select("sig", "_target")
    members = cut_lineage(of.select("sig", "id").join(copies, "sig").drop("sig"))
    alone = found.where("_n = 1").select(F.col("_target").alias("id"), "near", "similarity")
    lists = alone.unionByName(found.where("_n > 1").join(members, "_target").select("id", "near", "similarity"))
    t_rep.unpersist()
    hit = F.filter(F.arrays_zip("near", "similarity"), lambda x: x["near"] != F.col("id"))
    return lists.select("id", F.posexplode(F.slice(hit, 1, k)).alias("rank", "hit")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("hit.near").alias("nn_id"), F.col("hit.similarity").alias("similarity")
    )


def compact(df: DataFrame, column: str) -> DataFrame:
    """Texts as 64-bit hashes, since a set travels once to each block that it visits; two of a million texts meet with a probability of 3e-8."""
    if not isinstance(df.schema[column].dataType.elementType, T.StringType):
        return df
    return df.withColumn(column, F.transform(column, lambda x: F.xxhash64(x)))


def top_matches(
    targets: DataFrame,
    candidates: DataFrame,
    parts: list[Part],
    k: int,
    order: list[str] | None = None,
    floor: float = 0.0,
    block_rows: int | None = None,
    words: dict[str, np.ndarray] | None = None,
) -> DataFrame:
    """(id, rank, nn_id, similarity): the k most similar other candidates per target.

    ``targets`` and ``candidates`` have ``id`` and the parts' columns: distinct
    features as an array, or a vector. Ties go by ``order``, columns of the
    candidates compared ascending and always ended by the id. Similarities of 0
    are left out, so are those under ``floor``. ``words``: the sets are packed already, by these dictionaries.
    """
    for p in parts:
        if p.metric == "cosine":
            unit = lambda c: F.transform(c, lambda x: F.try_divide(x, F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y))))
            targets = targets.withColumn(p.column, unit(F.col(p.column).cast("array<double>")))
            candidates = candidates.withColumn(p.column, unit(F.col(p.column).cast("array<double>")))
        elif p.metric == "jaccard" and not by_sets(parts):
            targets, candidates = compact(targets, p.column), compact(candidates, p.column)
    if by_sets(parts):
        if words is None:
            (targets, candidates), words = pack([targets, candidates], parts)
        return _stream_search(targets, candidates, parts, words, k, order or [], floor, block_rows)
    t_members, t_rep = _representatives(targets.select("id", *(p.column for p in parts)), parts, ["id"], "target")
    c_members, c_rep = _representatives(candidates, parts, [*(order or []), "id"], "analog")
    keys = [*(order or []), "analog"]

    main = max(parts, key=lambda p: p.weight)
    cores = targets.sparkSession.sparkContext.defaultParallelism
    if block_rows is None:
        block_rows = block_size(max(t_rep.count(), c_rep.count()), cores)
    blocks = TreeBlocks([t_rep, c_rep], main.column, block_rows, main.metric)
    tasks = lambda groups: int(max(1, min(20_000, groups)))

    t_block, c_block = blocks.assign(t_rep), blocks.assign(c_rep)
    fields = c_rep.schema
    schema = T.StructType(
        [T.StructField("target", t_rep.schema["target"].dataType), T.StructField("similarity", T.DoubleType()), *(fields[c] for c in keys)]
    )
    kernel = block_kernel(parts, keys, k + 1, floor, schema)
    own = (
        t_block.withColumn("bound", F.lit(0.0)).repartition(tasks(blocks.count), "block").groupBy("block")
        .cogroup(c_block.repartition(tasks(blocks.count), "block").groupBy("block"))
        .applyInArrow(kernel, schema)
    )
    if blocks.count > 1:
        own = cut_lineage(own)
        blocks.hold(c_block)
        bound = own.groupBy("target").agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_least"))
        bound = bound.where(F.col("_n") > k).select("target", F.col("_least").alias("bound"))
        share = main.weight / sum(p.weight for p in parts)

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def visits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for features, home, least in batches:
                possible = share * blocks.best_possible(features) + (1 - share)
                wanted = (possible >= np.maximum(least.to_numpy(), floor)[:, None] - SLACK) & (possible > 0)
                wanted[:, ~blocks.held] = False
                wanted[np.arange(len(home)), home.to_numpy()] = False
                yield pd.Series([np.flatnonzero(w) for w in wanted])

        trips = (
            t_block.join(bound, "target", "left").fillna(0.0, ["bound"]).withColumnRenamed("block", "home")
            .withColumn("block", F.explode(visits(blocks.measure(), "home", "bound")))
        )
        pairs = trips.select(F.col("home").alias("visitor"), F.col("block").alias("place")).distinct()
        visited = c_block.join(pairs, F.col("block") == F.col("place")).drop("block")
        groups = tasks(blocks.count**2)
        other = (
            trips.repartition(groups, "home", "block").groupBy("home", "block")
            .cogroup(visited.repartition(groups, "visitor", "place").groupBy("visitor", "place"))
            .applyInArrow(kernel, schema)
        )
        own = own.unionByName(other)

    best = W.partitionBy("target").orderBy(F.desc("similarity"), *keys)
    near = own.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("target", "analog", "similarity")
    first = W.partitionBy("analog").orderBy(*(order or []), "nn_id")
    copies = c_members.withColumnRenamed("id", "nn_id").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    best = W.partitionBy("target").orderBy(F.desc("similarity"), *(order or []), "nn_id")
    lists = (
        near.join(copies.drop("_r"), "analog")
        .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
        .groupBy("target")  # at most k + 1 rows each
        .agg(F.sort_array(F.collect_list(F.struct("_r", "nn_id", "similarity"))).alias("near"))
    )
    mine = F.slice(F.filter("near", lambda x: x["nn_id"] != F.col("id")), 1, k)
    # kept, since callers read the neighbours several times and the kernel is dear
    found = cut_lineage(
        t_members.join(lists, "target")
        .select("id", F.posexplode(mine).alias("rank", "hit"))
        .select("id", (F.col("rank") + 1).alias("rank"), F.col("hit.nn_id").alias("nn_id"), F.col("hit.similarity").alias("similarity"))
    )
    t_rep.unpersist()
    c_rep.unpersist()
    return found
