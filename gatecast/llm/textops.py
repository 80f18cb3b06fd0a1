"""Vectorised word and n-gram hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Texts:
    """Whole texts of some rows: UTF-8 bytes and row offsets; nulls are empty."""

    data: np.ndarray
    offs: np.ndarray
    lo: int
    hi: int

    @property
    def n(self) -> int:
        return self.hi - self.lo


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of rows of about ``max_bytes``, at least one row each.

    Only rows are grouped: a text is never cut, however long it is.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, ob, db = col.buffers()
    offs = np.frombuffer(ob, np.int64, n + 1 + col.offset)[col.offset:]
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Texts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], lo, hi)
        lo = hi


def lower_ascii(t: Texts) -> Texts:
    return Texts(_LOWER[t.data], t.offs, t.lo, t.hi)


def spans(t: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of ``inside`` bytes, cut at row borders."""
    n = len(t.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = t.offs[1:-1]
    before[cut[cut < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(t.offs, starts, "right") - 1
    return starts, ends, rows


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: the delimiters are single bytes in UTF-8."""
    return spans(t, ~_SPACE[t.data])


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts, ends and rows of the ``\n``-split lines, empty ones included, of non-empty texts."""
    nl = np.flatnonzero(t.data == 10)
    full = np.flatnonzero(np.diff(t.offs) > 0)
    starts = np.concatenate([t.offs[full], nl + 1])
    ends = np.concatenate([nl, t.offs[full + 1]])
    rows = np.searchsorted(t.offs, nl, "right") - 1
    rows_s = np.concatenate([full, rows])
    rows_e = np.concatenate([rows, full])
    a, b = np.lexsort((starts, rows_s)), np.lexsort((ends, rows_e))
    return starts[a], ends[b], rows_s[a]


def ranks(x: np.ndarray) -> np.ndarray:
    """Rank of each value among the distinct ones."""
    order = np.argsort(x)
    y = x[order]
    up = np.zeros(len(x), np.uint64)
    np.cumsum(y[1:] != y[:-1], out=up[1:])
    out = np.empty(len(x), np.uint64)
    out[order] = up
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value among the distinct ones, and one position of each of those."""
    index = ranks(x).astype(np.int64)
    at = np.zeros(int(index.max(initial=-1)) + 1, np.int64)
    at[index] = np.arange(len(x))
    return index, at


class Hasher:
    """64-bit hashes of byte spans by a polynomial over prefix sums."""

    def __init__(self) -> None:
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULT)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INV)]), dtype=np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.over(_BYTE[data], starts, ends)

    def over(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of elements that are given as well-mixed 64-bit values."""
        n = len(values)
        self._grow(n)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.power[:n], dtype=np.uint64, out=acc[1:])
        return mix((acc[ends] - acc[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, rows: np.ndarray, n_rows: int, n: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and first word positions of the ``n``-word windows of every row.

    With ``short``, a row of fewer words (but at least one) gives its whole
    sequence as one window.
    """
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    m = len(h)
    out_h, out_r, out_p = [], [], []
    if m >= n:
        acc = np.zeros(m - n + 1, np.uint64)
        for k in range(n):
            acc += h[k:m - n + 1 + k] * mult[k]
        ok = np.flatnonzero(rows[:m - n + 1] == rows[n - 1:])
        out_h.append(mix(acc[ok]))
        out_r.append(rows[ok])
        out_p.append(ok)
    if short:
        count = np.bincount(rows, minlength=n_rows)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        few = np.flatnonzero((count > 0) & (count < n))
        acc = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = count[few] > k
            acc[has] += h[first[few[has]] + k] * mult[k]
        out_h.append(mix(acc + count[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        out_r.append(few)
        out_p.append(first[few])
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r), np.concatenate(out_p)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
