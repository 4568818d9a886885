"""String metrics. The weighted distance and Jaro run over whole Arrow batches at once; the others are expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .confusion import Confusion, drop_column, substitution_column


def _grid(words: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    out = np.zeros((len(words), max(1, size.max(initial=0))), np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = [place[c] for c in w]
    return out, size


#: Pairs that advance through the table together, so that a row of it stays in the cache.
BLOCK = 4096


def _numbered(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct upper-case words, and which of them each word is."""
    place: dict[str, int] = {}
    at = np.fromiter((place.setdefault((w or "").upper(), len(place)) for w in words), np.int64, len(words))
    return list(place), at


def distances(a: list[str], b: list[str], model: Confusion | None = None) -> np.ndarray:
    """Restricted Damerau-Levenshtein distances of pairs under the model's costs; blocks of pairs advance through the table together."""
    return _distances(_numbered(a), _numbered(b), model or Confusion())


def _distances(a: tuple[list[str], np.ndarray], b: tuple[list[str], np.ndarray], model: Confusion) -> np.ndarray:
    """The same for distinct words and which of them each pair has."""
    if not len(a[1]):
        return np.zeros(0)
    alphabet = sorted(set("".join(a[0])) | set("".join(b[0]))) or [" "]
    place = {c: i for i, c in enumerate(alphabet)}
    change, drop = model.costs(alphabet)
    (left, rows), (top, columns) = _grid(a[0], place), _grid(b[0], place)
    pairs, back = np.unique(a[1] * len(b[0]) + b[1], return_inverse=True)
    out = np.empty(len(pairs))
    for lo in range(0, len(pairs), BLOCK):
        x, y = np.divmod(pairs[lo : lo + BLOCK], len(b[0]))
        n, m = max(1, rows[x].max()), max(1, columns[y].max())
        out[lo : lo + BLOCK] = _table(left[x, :n].T.copy(), rows[x], top[y, :m].T.copy(), columns[y], change, drop, model.transpose_cost)
    return out[back]


def _table(left: np.ndarray, rows: np.ndarray, top: np.ndarray, columns: np.ndarray, change: np.ndarray, drop: np.ndarray, swap: float) -> np.ndarray:
    """left, top: characters by place, then pair."""
    every, insert, costs = np.arange(len(rows)), drop[top], change.ravel()
    row = np.concatenate([np.zeros((1, len(rows))), np.cumsum(insert, 0)])
    before = row
    out = np.where(rows == 0, row[columns, every], 0.0)
    for i in range(1, len(left) + 1):
        char, delete = left[i - 1], drop[left[i - 1]]
        base = char * len(change)
        next_row = np.empty_like(row)
        next_row[0] = row[0] + delete
        for j in range(1, len(top) + 1):
            best = np.minimum(row[j] + delete, next_row[j - 1] + insert[j - 1])
            np.minimum(best, row[j - 1] + costs.take(base + top[j - 1]), out=best)
            if i > 1 and j > 1:
                crossed = np.flatnonzero((char == top[j - 2]) & (left[i - 2] == top[j - 1]) & (char != top[j - 1]))
                if len(crossed):
                    best[crossed] = np.minimum(best[crossed], before[j - 2][crossed] + swap)
            next_row[j] = best
        before, row = row, next_row
        done = np.flatnonzero(rows == i)
        out[done] = row[columns[done], done]
    return out


#: Characters of a word whose places fit a mask.
MASKED = 64


def jaro_winklers(a: list[str], b: list[str], winkler: bool = True) -> np.ndarray:
    """Jaro (with halves of transpositions) or Jaro-Winkler similarities of pairs, case aside. Words of up to 64 characters are
    matched together, the free places of each second word in a mask; longer ones one by one."""
    (own, x), (other, y) = _numbered(a), _numbered(b)
    if not len(x):
        return np.zeros(0)
    pairs, back = np.unique(x * len(other) + y, return_inverse=True)
    left, right = np.divmod(pairs, len(other))
    out = np.zeros(len(pairs))
    for lo in range(0, len(pairs), BLOCK):
        u, v = [own[i] for i in left[lo : lo + BLOCK].tolist()], [other[i] for i in right[lo : lo + BLOCK].tolist()]
        short = np.array([len(p) <= MASKED and len(q) <= MASKED for p, q in zip(u, v)])
        part = np.zeros(len(u))
        if short.any():
            part[short] = _jaros([p for p, k in zip(u, short) if k], [q for q, k in zip(v, short) if k], winkler)
        for i in np.flatnonzero(~short).tolist():
            part[i] = _jaro(u[i], v[i], winkler)
        out[lo : lo + BLOCK] = part
    return out[back]


def _jaros(a: list[str], b: list[str], winkler: bool) -> np.ndarray:
    place = {c: i + 1 for i, c in enumerate(dict.fromkeys("".join(a) + "".join(b)))}
    (x, n), (y, m) = _grid(a, place), _grid(b, place)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    one = np.uint64(1)

    def below(k: np.ndarray) -> np.ndarray:
        """A mask of the places before k."""
        k = np.clip(k, 0, MASKED)
        return np.where(k == MASKED, ~np.uint64(0), (one << np.minimum(k, MASKED - 1).astype(np.uint64)) - one)

    free, hit = below(m), np.zeros(x.shape, bool)
    octets = np.zeros((len(n), MASKED // 8), np.uint8)
    for i in range(x.shape[1]):
        octets[:, : -(-y.shape[1] // 8)] = np.packbits(y == x[:, i : i + 1], axis=1, bitorder="little")
        same = octets.view(np.uint64)[:, 0]
        open_ = same & free & below(i + reach + 1) & ~below(i - reach)
        open_ = np.where(i < n, open_, np.uint64(0))
        free ^= open_ & (~open_ + one)  # the first place
        hit[:, i] = open_ != 0
    taken = (below(m) ^ free)[:, None] >> np.arange(y.shape[1], dtype=np.uint64) & one != 0
    matches = hit.sum(1)
    mine, theirs = np.zeros(x.shape, np.int64), np.zeros(x.shape, np.int64)
    row, at = np.nonzero(hit)
    mine[row, (np.cumsum(hit, 1) - 1)[row, at]] = x[row, at]
    row, at = np.nonzero(taken)
    theirs[row, (np.cumsum(taken, 1) - 1)[row, at]] = y[row, at]
    moved = (mine != theirs).sum(1) / 2.0
    some = np.maximum(matches, 1)
    jaro = np.where(matches > 0, (matches / np.maximum(n, 1) + matches / np.maximum(m, 1) + (matches - moved) / some) / 3, 0.0)
    if winkler:
        k = min(4, x.shape[1], y.shape[1])
        alike = np.cumprod((x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None]), 1).sum(1) if k else np.zeros(len(n))
        jaro = np.where(jaro > 0.7, jaro + 0.1 * alike * (1 - jaro), jaro)
    equal = np.array([p == q for p, q in zip(a, b)])
    return np.where(equal, 1.0, jaro)


def _jaro(a: str, b: str, winkler: bool) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = list(range(len(b))), []
    for i, c in enumerate(a):
        hit = next((j for j in free if i - reach <= j <= i + reach and b[j] == c), None)
        if hit is not None:
            free.remove(hit)
            mine.append((c, hit))
    if not mine:
        return 0.0
    other = [b[j] for j in sorted(j for _, j in mine)]
    m, moved = len(mine), sum(c != d for (c, _), d in zip(mine, other)) / 2.0
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if not winkler or jaro <= 0.7:
        return jaro
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def _paired(scores):  # noqa: ANN001, ANN202
    """An Arrow UDF of two columns that scores each distinct pair of a batch once.

    It is marked nondeterministic so that a filter on its result doesn't run it a second time.
    """

    @F.pandas_udf("double")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
            codes, distinct = pairs.factorize()
            yield pd.Series(scores([p[0] for p in distinct], [p[1] for p in distinct])[codes])

    return udf.asNondeterministic()


def weighted_distance(a: Column, b: Column, model: Confusion | None = None) -> Column:
    @F.pandas_udf("double")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series(distances(x.tolist(), y.tolist(), model))

    return udf.asNondeterministic()(a, b)


def normalised(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(distance / longest)


def jaro(a: Column, b: Column) -> Column:
    return _paired(lambda x, y: jaro_winklers(x, y, False))(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _paired(jaro_winklers)(a, b)


def weighted_distance_expr(a: Column, b: Column, model: Confusion | None = None) -> Column:
    """The weighted distance as one expression: a fold over the rows of the table, for use where no Python may run."""
    model = model or Confusion()
    a, b = F.upper(F.coalesce(a, F.lit(""))), F.upper(F.coalesce(b, F.lit("")))
    at = lambda s, i: F.substring(s, i, F.lit(1))
    zero = F.array(F.lit(0.0))
    columns = F.when(F.length(b) > 0, F.sequence(F.lit(1), F.length(b))).otherwise(F.array().cast("array<int>"))
    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    first = F.aggregate(columns, zero, lambda acc, j: F.concat(acc, F.array(F.element_at(acc, -1) + drop_column(at(b, j), model))))

    def line(before: Column, row: Column, i: Column) -> Column:
        char = at(a, i)
        delete = drop_column(char, model)

        def cell(acc: Column, j: Column) -> Column:
            other = at(b, j)
            crossed = (i > 1) & (j > 1) & (char == at(b, j - 1)) & (at(a, i - 1) == other) & (char != other)
            swap = F.when(crossed, F.get(before, j - 2) + model.transpose_cost)
            return F.concat(acc, F.array(F.least(F.get(row, j) + delete, F.element_at(acc, -1) + drop_column(other, model), F.get(row, j - 1) + substitution_column(char, other, model), swap)))

        return F.aggregate(columns, F.array(F.get(row, F.lit(0)) + delete), cell)

    start = F.struct(zero.alias("before"), first.alias("row"))
    return F.element_at(F.aggregate(rows, start, lambda s, i: F.struct(s["row"].alias("before"), line(s["before"], s["row"], i).alias("row")))["row"], -1)


def grams(text: Column, n: int = 2) -> Column:
    """The n-grams of the upper-cased text between ^ and $."""
    framed = F.concat(F.lit("^"), F.upper(F.coalesce(text, F.lit(""))), F.lit("$"))
    count = F.length(framed) - (n - 1)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_cosine(a: Column, b: Column, n: int = 2) -> Column:
    x, y = grams(a, n), grams(b, n)
    count = lambda own, g: F.size(F.filter(own, lambda h: h == g)).cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.transform(F.array_intersect(x, y), lambda g: count(x, g) * count(y, g)))
    norm = lambda own: F.sqrt(total(F.transform(F.array_distinct(own), lambda g: F.pow(count(own, g), F.lit(2.0)))))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))


def register(spark) -> None:  # noqa: ANN001
    """SQL names of the metrics that are UDFs."""
    spark.udf.register("weighted_distance", _paired(lambda x, y: distances(x, y)))
    spark.udf.register("jaro", _paired(lambda x, y: jaro_winklers(x, y, False)))
    spark.udf.register("jaro_winkler", _paired(jaro_winklers))
