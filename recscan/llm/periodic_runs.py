"""Runs of words that repeat periodically, by longest common extensions in suffix trees.

A run is a stretch of consecutive words with smallest period q that is at least LEAST words and
TIMES * q long and that no neighbouring word extends with that period. Ukkonen's trees of a text
and of its reversal, with Euler tours and range minima over them, tell how far two places agree
to the right and to the left in constant time. Every run has a root that is the longest Lyndon word
at its start, in one of the two orders of the words; so the two Lyndon words at each place are all
the candidates there are, and extending them to both sides gives each run, with its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import small_batches

LEAST, TIMES = 24, 3
#: Words of the grams that a stretch must repeat near by before trees are built over it. A run of L words and period q has
#: L - q - GRAM + 1 grams that recur q words on, and as many that recur q words back; for L >= LEAST, TIMES * q those are all its grams.
GRAM = LEAST - 2 * (LEAST // TIMES)
#: Words of texts whose grams are looked at together.
CHUNK_WORDS = 200_000


class SuffixTree:
    """Ukkonen's tree of a sequence of integers above 0; 0 is put at the end.

    ``leaves`` holds the suffixes in order, 0 being the smallest of all symbols, and ``rank`` the place of each. ``low[k]`` is the
    depth of the lowest common ancestor of leaves k - 1 and k on the Euler tour: the tour between two leaves is
    lowest at their ancestor, so the minimum of ``low`` over that part is what they share.
    """

    def __init__(self, symbols: list[int]) -> None:
        self.s = s = [*symbols, 0]
        self.n = n = len(s)
        self.width = max(s) + 1
        self._build(s, n, self.width)
        self.leaves, low = self._tour(last_first=True)
        self.rank = np.empty(n, np.int64)
        self.rank[self.leaves] = np.arange(n)
        # minima over ranges of 2^k places
        self.table = [low]
        while 2 << len(self.table) - 1 <= n:
            half, row = 1 << len(self.table) - 1, self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))

    def _build(self, s: list[int], n: int, width: int) -> None:
        start, stop, link, to = [0], [0], [0], {}
        get = to.get
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = get(key)
                if child is None:
                    to[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = start[child]
                    span = stop[child] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    met = s[at + length]
                    if met == c:
                        if last and node:
                            link[last] = node
                        length += 1
                        break
                    fork = len(start)
                    start += (at, i)
                    stop += (at + length, n)
                    link += (0, 0)
                    to[key] = fork
                    to[fork * width + c] = fork + 1
                    start[child] = at + length
                    to[fork * width + met] = child
                    if last:
                        link[last] = fork
                    last = fork
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        keys = np.fromiter(to.keys(), np.int64, len(to))
        order = np.argsort(keys)
        self.symbol = (keys[order] % width).tolist()
        self.child = np.fromiter(to.values(), np.int64, len(to))[order].tolist()
        self.first = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
        self.span = (np.array(stop) - np.array(start)).tolist()

    def _tour(self, last_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in the order of the tour, and the lowest depth before each; the end symbol goes first or last."""
        first, child, symbol, span, n = self.first, self.child, self.symbol, self.span, self.n
        leaves, low, above = [], [], 0
        todo = [(0, 0, 0)]
        while todo:
            node, depth, lowest = todo.pop()
            if lowest >= 0:
                above = lowest
            a, b = first[node], first[node + 1]
            if a == b:
                leaves.append(n - depth)
                low.append(above)
                continue
            kids = range(a, b)
            if not last_first and not symbol[a]:
                kids = (*range(a + 1, b), a)
            head = kids[0]
            for k in reversed(kids):
                todo.append((child[k], depth + span[child[k]], -1 if k == head else depth))
        return np.array(leaves, np.int64), np.array(low, np.int64)

    def falling(self) -> np.ndarray:
        """The rank of each suffix where larger symbols come first; the end stays the smallest."""
        rank = np.empty(self.n, np.int64)
        rank[self._tour(last_first=False)[0][::-1]] = np.arange(self.n)
        return rank

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and at j, two different places, have in common."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        out, level = np.empty(len(a), np.int64), np.frexp((b - a).astype(float))[1] - 1
        for k in np.unique(level):
            at, row = np.flatnonzero(level == k), self.table[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """The next place to the right with a smaller value, for each but the last, which is the smallest."""
    out, open_ = [0] * (len(rank) - 1), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def tree_runs(symbols: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of integers above 0, by start, then period."""
    n = len(symbols)
    if n < least:
        return []
    right, left = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i = np.arange(n)
    found = set()
    for rank in (right.rank, right.falling()):
        j = _next_smaller(rank.tolist())
        on = np.flatnonzero((j < n) & ((j - i) * times <= n))  # a run holds its root more than once
        a, b = i[on], j[on]
        period, stop, start = b - a, b + right.agree(a, b), a.copy()
        inner = np.flatnonzero(a > 0)
        start[inner] -= left.agree(n - a[inner], n - b[inner])
        size = stop - start
        good = size >= np.maximum(least, times * period)
        found.update(zip(start[good].tolist(), size[good].tolist(), period[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def near_repeats(words: np.ndarray, text: np.ndarray, gram: int = GRAM, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches (start, stop) outside of which no run has a word; each lies within one text.

    ``words`` are word numbers, ``text`` the text of each. In a run each gram recurs at the distance of the period, a third of
    the run at most. So places whose gram recurs no nearer than a third of the stretch are cut out, until none is.
    """
    n = len(words) - gram + 1
    if n <= 0:
        return []
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    value = text[:n].astype(np.uint64)
    for k in range(gram):
        value = value * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    inside = np.flatnonzero(text[:n] == text[gram - 1 :])
    value = value[inside]
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    gap = np.where(same, np.diff(inside[order]), len(words))
    nearest = np.full(n, len(words))
    nearest[inside[order[1:]]] = gap
    nearest[inside[order[:-1]]] = np.minimum(nearest[inside[order[:-1]]], gap)
    places = np.flatnonzero(nearest < len(words))
    found, todo = [], [places]
    while todo:
        parts = todo.pop()
        cuts = np.flatnonzero((np.diff(parts) > 1) | (text[parts[1:]] != text[parts[:-1]])) + 1
        for part in np.split(parts, cuts) if len(parts) else ():
            size = len(part) + gram - 1
            if size < least:
                continue
            near = part[nearest[part] * times <= size]
            if len(near) == len(part):
                found.append((int(part[0]), int(part[0]) + size))
            elif len(near):
                todo.append(near)
    return sorted(found)


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for t in texts for w in t), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, stop in near_repeats(words, text):
        k = int(text[start])
        base = start - int(ends[k] - sizes[k])
        symbols = np.unique(words[start:stop], return_inverse=True)[1] + 1
        out[k] += [(base + s, size, p) for s, size, p in tree_runs(symbols.tolist())]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _chunks(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """Texts as words, in groups of about CHUNK_WORDS words."""
    held, n = [], 0
    for t in texts:
        held.append((t or "").encode().split())  # bytes split at exactly the six white characters of ASCII
        n += len(held[-1])
        if n >= CHUNK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        done = 0
        for words in _chunks(x.as_py() for x in batch["text"]):
            runs = runs_of_texts(words)
            kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs, strict=True)]
            spans = [[{"start": s, "length": size, "period": p} for s, size, p in r] for r in runs]
            yield pa.RecordBatch.from_arrays([batch["id"].slice(done, len(words)), pa.array(spans, run), pa.array(kept, pa.string())], ["id", "runs", "collapsed"])
            done += len(words)


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, runs (array of start, length, period, by start, then period) and collapsed.

    Words are what stands between the six white characters of ASCII, numbered from 0. collapsed joins by one space the words that no run
    holds after its first period. A null or empty text has no run and an empty collapsed text. Ids (null too), rows
    and repeats stay as they are; other columns are not read. One pass, no shuffle. Trees are built one
    stretch after the other, and take some 500 bytes for each of its words.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema).withColumnRenamed("id", id_col)
