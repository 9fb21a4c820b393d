"""Edit distance of long sequences: bit-parallel columns in linear memory, and the operations of a shortest script.

The column of the distance matrix is kept as two whole numbers of as many bits as the
shorter sequence has places: where the value goes up by one and where it goes down
(Myers 1999). A step takes some ten operations on such numbers, so texts of a hundred
thousand characters take seconds and no matrix exists. The script comes from cutting
one sequence in half and finding where a shortest path crosses (Hirschberg 1975),
until the columns of a part are few enough to keep.

No script is shorter than what one side's characters, as a bag, lack of the other's. Most
recognised texts have a script of just that many operations, and one pass over a batch finds it by
following a few diagonals round the farthest (Ukkonen 1985), for thousands of pairs at once;
only pairs without one need columns. Where the bags decide, so do they over how many operations of each kind there are.

Spark calls these by Arrow batches; the distance of two null or missing sides is that of empty ones.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a matrix whose columns are kept at a time, two bits each.
_CELLS = 2**25
_KINDS = ("ins", "del", "sub")
#: Characters and pairs taken at once, counters a pair (characters beyond share them), and diagonals followed to each side, first and where that finds nothing.
_CHARS, _PAIRS, _BAGS, _REACH = 2**22, 2**13, 512, (3, 12)
_UNREACHED = -(2**40)
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def tokens(text: str | None) -> list[str]:
    """Pieces between runs of white space, as split(text, "\\\\s+") gives them."""
    return _SPACE.split(text or "")


def _ids(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as whole numbers, the same for equal members."""
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in (a, b))  # type: ignore[return-value]
    known: dict = {}
    return tuple(np.array([known.setdefault(t, len(known)) for t in x], dtype=np.uint32) for x in (a, b))  # type: ignore[return-value]


def _places(a: np.ndarray) -> dict[int, int]:
    """Member -> the number whose bits are its places."""
    if not len(a):
        return {}
    values, inverse = np.unique(a, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    cuts = np.cumsum(np.bincount(inverse))[:-1]
    out = {}
    for v, at in zip(values.tolist(), np.split(order, cuts), strict=True):
        bits = np.zeros(len(a) // 8 + 1, dtype=np.uint8)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        out[v] = int.from_bytes(bits.tobytes(), "little")
    return out


def _columns(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each column of the matrix of a (down) and b (across) goes up and down, from the one before b on."""
    full, where = (1 << len(a)) - 1, _places(a)
    up, down = full, 0
    yield up, down
    for t in b.tolist():
        same = where.get(t, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = (down | (full ^ ((across | up) & full))) << 1 | 1, (up & across) << 1
        up, down = (minus | (full ^ ((vertical | plus) & full))) & full, plus & vertical & full
        yield up, down


def _column(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The last column."""
    return deque(_columns(a, b), maxlen=1)[0]


def _traced(a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int]]:
    """A shortest script, last operation first, by walking back through all columns."""
    columns, out = list(_columns(a, b)), []
    i, j, x, y = len(a), len(b), a.tolist(), b.tolist()
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        elif columns[j][0] >> (i - 1) & 1:  # one more than above
            i -= 1
            out.append(("del", i, j))
        elif columns[j - 1][1] >> (i - 1) & 1:  # to the left it falls, so the corner is no better
            j -= 1
            out.append(("ins", i, j))
        else:
            i, j = i - 1, j - 1
            out.append(("sub", i, j))
    return out + [("del", t, 0) for t in range(i - 1, -1, -1)] + [("ins", 0, t) for t in range(j - 1, -1, -1)]


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with alike."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    i = int(differs[0]) if len(differs) else n
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    j = int(differs[0]) if len(differs) else n
    return a[: len(a) - j], b[: len(b) - j]


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions from one sequence (text or tokens) to the other, the fewest."""
    x, y = _trimmed(*_ids(a, b))
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return len(x)
    up, down = _column(x, y)
    return len(y) + up.bit_count() - down.bit_count()


def _values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each beginning of a (none to all) from b."""
    up, down = _column(a, b) if len(a) else (0, 0)
    bits = lambda v: np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)].astype(np.int64)
    return np.r_[0, np.cumsum(bits(up) - bits(down))] + len(b)


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """A shortest script as (operation, place in a, place in b), in order; equal places are left out. Operations: sub, del (of a), ins (from b)."""
    x, y = _ids(a, b)
    out: list[tuple[str, int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and x[i] == y[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            j, m = j - 1, m - 1
        if m - k < 2 or (j - i) * (m - k) <= _CELLS:
            out += [(kind, i + t, k + v) for kind, t, v in reversed(_traced(x[i:j], y[k:m]))]
        else:
            half = (k + m) // 2
            cross = int(np.argmin(_values(x[i:j], y[k:half]) + _values(x[i:j][::-1], y[half:m][::-1])[::-1]))
            todo += [(i + cross, j, half, m), (i, i + cross, k, half)]
    return out


def _laid_out(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one behind the other, ``end`` after each: for every place the eight bytes from there on as one number, and where sequences begin."""
    out = np.full(len(ids) + len(sizes) + 8, end, dtype=ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    words = np.ndarray((len(ids) + len(sizes),), dtype="<u8", buffer=out.data, strides=(ids.itemsize,)).copy()
    return words, np.cumsum(sizes + 1) - sizes - 1


def _reached(x: np.ndarray, y: np.ndarray, a0: np.ndarray, b0: np.ndarray, n: np.ndarray, m: np.ndarray, low: np.ndarray, reach: int, shift: int) -> np.ndarray:
    """Which pairs (by falling low) have a script of low operations, as far as ``reach`` diagonals to both sides of the farthest one show.

    far holds how much of a is done on each diagonal after e operations. x and y are laid out, an id has 1 << shift bits.
    """
    far = np.full((len(n), 2 * reach + 3), _UNREACHED)
    far[:, reach + 1] = 0
    diagonal = np.zeros((len(n), 1), dtype=np.int64) + np.arange(-reach, reach + 1)
    a0, b0, n, m = (v[:, None] for v in (a0, b0, n, m))
    found, size, e, one, falling = np.zeros(len(n), dtype=bool), len(n), 0, np.uint64(1), -low
    while size:
        d = diagonal[:size]
        done = far[:size, 1:-1].copy()
        if e:
            done = np.maximum(np.maximum(done, far[:size, 2:]) + 1, far[:size, :-2])
            np.minimum(done, np.minimum(n[:size], m[:size] - d), out=done)
        i, j = (a0[:size] + done).ravel(), (b0[:size] + done + d).ravel()
        flat, at = done.ravel(), np.arange(done.size)
        while len(at):  # as far as both are alike, some ids at a time
            differ = x.take(i, mode="clip") ^ y.take(j, mode="clip")
            flat[at] += np.bitwise_count((differ & (~differ + one)) - one) >> shift
            more = np.flatnonzero((differ == 0) & (flat[at] >= 0))
            at, i, j = at[more], i[more] + (64 >> shift), j[more] + (64 >> shift)
        far[:size, 1:-1] = done
        left = int(np.searchsorted(falling[:size], -e))
        found[left:size] = ((done[left:] == n[left:size]) & (d[left:] == m[left:size] - n[left:size])).any(axis=1)
        best = np.argmax(2 * done[:left] + d[:left], axis=1) - reach
        for step, rows in ((1, np.flatnonzero(best > 0)), (-1, np.flatnonzero(best < 0))):  # the farthest stays in the middle
            if len(rows):
                held, far[rows] = far[rows], _UNREACHED
                far[rows, 1:-1] = held[:, 2:] if step > 0 else held[:, :-2]
                diagonal[rows] += step
        size, e = left, e + 1
    return found


def _by_bags(a: list[str], b: list[str]) -> np.ndarray:
    """As settled(), of pairs without empty sides."""
    n, m = (np.array([len(t) for t in s], dtype=np.int64) for s in (a, b))
    p, q = (np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for s in (a, b))
    known = np.zeros(int(max(p.max(), q.max())) + 1, dtype=bool)
    known[p] = known[q] = True
    ids = np.cumsum(known) + 1  # 0 and 1 are ends
    k = int(ids[-1]) + 1
    ids = ids.astype(np.uint8 if k <= 2**8 else np.uint16 if k <= 2**16 else np.uint32)
    p, q = ids[p], ids[q]
    bags = min(k, _BAGS)
    count = lambda v, sizes: np.bincount(v % np.int64(bags) + np.repeat(np.arange(len(n)) * bags, sizes), minlength=len(n) * bags).reshape(-1, bags)
    more = count(p, n) - count(q, m)
    low = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    even = n == m
    unlike = p[np.repeat(even, n)] != q[np.repeat(even, m)]
    replaced = np.bincount(np.repeat(np.flatnonzero(even), n[even]), weights=unlike, minlength=len(n))
    out = np.where(even & (replaced == low), low, -1)
    (x, a0), (y, b0) = _laid_out(p, n, 0), _laid_out(q, m, 1)
    for reach in _REACH:
        todo = np.flatnonzero(out < 0)
        todo = todo[np.argsort(-low[todo], kind="stable")]
        hit = todo[_reached(x, y, a0[todo], b0[todo], n[todo], m[todo], low[todo], reach, {1: 3, 2: 4, 4: 5}[ids.itemsize])]
        out[hit] = low[hit]
    return out


def settled(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The edit distance of each pair of texts, or -1 where no script of as few operations as the bags of characters ask for was found."""
    out = np.array([max(len(s), len(t)) if not s or not t else 0 if s == t else -1 for s, t in zip(a, b, strict=True)], dtype=np.int64)
    sizes = [len(s) + len(t) for s, t in zip(a, b, strict=True)]
    todo = sorted(np.flatnonzero(out < 0).tolist(), key=sizes.__getitem__)
    while todo:
        own, size = [todo.pop()], 0
        while todo and len(own) < _PAIRS and (size := size + sizes[own[-1]]) + sizes[todo[-1]] <= _CHARS:
            own.append(todo.pop())
        out[own] = _by_bags([a[i] for i in own], [b[i] for i in own])
    return out


def edit_distances(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """The edit distance of each pair of texts."""
    return [d if d >= 0 else edit_distance(*pair) for *pair, d in zip(a, b, settled(a, b).tolist(), strict=True)]


def edit_kinds(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """How many insertions, deletions and substitutions a shortest script of each pair has.

    Where the bags decide, every shortest script has the same: all that the longer side has too much is removed or replaced, so nothing is inserted into it.
    """

    def of(s: str, t: str, d: int) -> tuple[int, int, int]:
        if d < 0:
            kinds = [kind for kind, _, _ in edit_script(s, t)]
            return kinds.count("ins"), kinds.count("del"), kinds.count("sub")
        return max(len(t) - len(s), 0), max(len(s) - len(t), 0), d - abs(len(s) - len(t))

    return [of(*pair) for pair in zip(a, b, settled(a, b).tolist(), strict=True)]


@F.pandas_udf(T.LongType())
def text_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in characters of whole texts."""
    return pd.Series(edit_distances([s or "" for s in a], [t or "" for t in b]), dtype="int64")


@F.pandas_udf(T.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in tokens between white space of whole texts."""
    return pd.Series([edit_distance(tokens(s), tokens(t)) for s, t in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.StructType([T.StructField(k, T.LongType()) for k in _KINDS]))
def edit_operations(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """How many operations of each kind a shortest script of whole texts has."""
    return pd.DataFrame(edit_kinds([s or "" for s in a], [t or "" for t in b]), columns=_KINDS, dtype="int64")
