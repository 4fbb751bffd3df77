"""SimHash fingerprints, and near-dedup by a self-join of binary tries.

The join finds all pairs of fingerprints within an error budget of bits. Fingerprints are the
leaves of a binary trie; pairs of nodes are walked down together, differing bits add up, and a
pair that exceeds the budget is dropped with everything below it. Since a budget of k errors
leaves one of k + 1 blocks of bits untouched, the trie is built once for each block, with that
block first and equal: so the walk starts from nodes that a block's value names, and Spark deals
those out to tasks. What a task finds it returns as a spanning forest, never as all pairs. Where
pairs must still be verified, a forest of them is only the first pass: a second one verifies every
pair that joins two components within the tasks, and returns a forest of what it accepts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recscan.llm.components import connected_components
from recscan.llm.shared import join_groups, materialize, numbered, settled, small_batches

SEED = 42
#: Node pairs that a task holds at once, and shingles that it hashes at once.
FRONTIER, HASHES = 1 << 19, 1 << 16
#: A block value shared by more fingerprints than this is dealt to several tasks, by pairs of slots.
HOT = 8192
#: Rows, and members of sets, that a task of the join gets on average at most; more tasks are made for more.
TASK_ROWS, TASK_MEMBERS = 1 << 19, 1 << 23
#: So many leading bits of a fingerprint go along to the tries, to test pairs there.
CHECK_BITS = 128


# ---- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; A-Z lower-cased, words joined by a space.

    Fewer than k words are one shingle; no word gives no hash.
    """
    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not norm:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(norm)]))
    n = max(1, len(starts) - k + 1)
    view, digest = memoryview(norm), xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((digest(view[s:e], SEED) for s, e in spans), np.uint64, n)


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64 bits from each hash; word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(word) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """The SimHash of some shingle hashes: ``words`` uint64; a bit is 1 if over half have it set."""
    lanes = 8 * words
    counts = np.zeros((lanes, 256), np.int64)
    offsets = 256 * np.arange(lanes)
    for i in range(0, len(h), HASHES):
        part = np.stack([_mix(h[i : i + HASHES], w) for w in range(words)], axis=1)
        octets = part.astype(">u8").view(np.uint8).reshape(len(part), lanes)
        counts += np.bincount((octets + offsets).ravel(), minlength=256 * lanes).reshape(lanes, 256)
    ones = (counts @ _BITS).reshape(words, 64)
    return np.packbits(2 * ones > len(h), axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text_col: str, cols: list[str], k: int, words: int = 1, as_sets: bool = False) -> DataFrame:
    """``cols`` of ``docs`` and fp, the fingerprint in big-endian bytes. No word: all bits zero.

    ``as_sets`` counts each shingle of a text once, and adds digest, 128 bits that are equal where
    the sets of shingles are.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, k) for t in b["_text"].to_pylist()]
            if as_sets:
                hashes = [np.unique(h) for h in hashes]
            fp = [fingerprint(h, words).astype(">u8").tobytes() for h in hashes]
            made = [pa.array(fp, pa.binary())]
            if as_sets:
                made.append(pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in cols), *made], [*cols, *names])

    names = ["fp", "digest"][: 1 + as_sets]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols), *(f"{c} binary" for c in names)])
    return docs.select(*cols, F.col(text_col).alias("_text")).mapInArrow(scan, schema)


# ---- the trie self-join within a task -----------------------------------------------------


class Forest:
    """A spanning forest of the lightest links seen so far, by rounds of Boruvka's method."""

    def __init__(self, n: int) -> None:
        self.n, self.a, self.b = n, np.empty(0, np.int64), np.empty(0, np.int64)
        self.w = np.empty(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        a, b, w = np.concatenate((self.a, a)), np.concatenate((self.b, b)), np.concatenate((self.w, w))
        order = np.lexsort((b, a, w))
        a, b, w = a[order], b[order], w[order]
        label, taken = np.arange(self.n), np.zeros(len(a), bool)
        live = np.arange(len(a))
        while True:
            la, lb = label[a[live]], label[b[live]]
            live = live[la != lb]
            if not len(live):
                break
            la, lb = label[a[live]], label[b[live]]
            first = np.full(self.n, len(a))
            np.minimum.at(first, la, live)
            np.minimum.at(first, lb, live)
            pick = np.unique(first[first < len(a)])
            taken[pick] = True
            # components merge along the picked links until labels stand still
            x, y = label[a[pick]], label[b[pick]]
            to = np.arange(self.n)
            while True:
                low = np.minimum(to[x], to[y])
                new = to.copy()
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                new = new[new]
                if (new == to).all():
                    break
                to = new
            label = to[label]
        self.a, self.b, self.w = a[taken], b[taken], w[taken]


def _children(parent_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children of each of n nodes, children being in order."""
    count = np.bincount(parent_of, minlength=n)
    return np.cumsum(count) - count, count


def _cross(i: np.ndarray, j: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a child of i and a child of j, and which pair of nodes each came from."""
    n = count[i] * count[j]
    of = np.repeat(np.arange(len(i)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return first[i][of] + k // count[j][of], first[j][of] + k % count[j][of], of


def walk_trie(keys: np.ndarray, bits: int, head: int, budget: int, stride: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i <= j of sorted distinct keys of ``bits`` bits, within the budget.

    The first ``head`` bits must be equal; below that, nodes of ``stride`` levels of the binary
    trie are opened at a time. Pairs of nodes are held in blocks, last in first out, so that
    memory is bounded however many there are.
    """
    depths = [head, *range(head + stride, bits, stride), bits]
    shift = lambda d: np.uint64(bits - d)
    levels = [np.unique(keys >> shift(d) if d else np.zeros(1, np.uint64)) for d in depths]
    links = []
    for up, down, d_up, d_down in zip(levels, levels[1:], depths, depths[1:], strict=False):
        parents = np.searchsorted(up, down >> np.uint64(d_down - d_up))
        links.append(_children(parents, len(up)))
    roots = np.arange(len(levels[0]))
    stack = [(0, roots, roots)]
    while stack:
        depth, i, j = stack.pop()
        if depth == len(links):
            yield i, j
            continue
        first, count = links[depth]
        total = np.cumsum(count[i] * count[j])
        if total[-1] > FRONTIER and len(i) > 1:
            cut = max(1, int(np.searchsorted(total, total[-1] // 2)))
            stack += [(depth, i[cut:], j[cut:]), (depth, i[:cut], j[:cut])]
            continue
        ci, cj, of = _cross(i, j, first, count)
        once = ci <= cj
        ci, cj, of = ci[once], cj[once], of[once]
        below = np.bitwise_count(levels[depth + 1][ci] ^ levels[depth + 1][cj])
        # a node's number holds its whole path, so this is the sum of the bits that differ so far
        stay = below <= budget
        if stay.any():
            stack.append((depth + 1, ci[stay], cj[stay]))


# ---- dealing the walk out -----------------------------------------------------------------


def _rotated(part: np.ndarray, bits: int, at: int, width: int) -> np.ndarray:
    """``part`` with the block of ``width`` bits at ``at`` (from the left) moved to the front."""
    part = part.astype(np.uint64)
    tail = bits - at - width
    block = (part >> np.uint64(tail)) & np.uint64((1 << width) - 1)
    left = part >> np.uint64(bits - at) if at else np.zeros_like(part)
    right = part & np.uint64((1 << tail) - 1)
    return (block << np.uint64(bits - width)) | (left << np.uint64(tail)) | right


def _parts(fp: list[bytes], part_bits: int) -> np.ndarray:
    """Fingerprints as a matrix of unsigned parts of 32 or 64 bits."""
    return np.frombuffer(b"".join(fp), f">u{part_bits // 8}").reshape(len(fp), -1).astype(np.uint64)


def trie_links(fps: DataFrame, part_bits: int = 64, budget: int = 3, within: int | None = None, hot: int = HOT, words: int = 1) -> DataFrame:
    """Links (a, b, bits) between rows of ``fps`` (id long, fp binary, distinct in both).

    Two rows are linked if some part of ``part_bits`` bits of their fingerprints differs in at
    most ``budget`` bits and, given ``within``, the first CHECK_BITS bits in at most that many.
    The result has, for each task, links that connect what its pairs connect, the closest first:
    the components are exact, and a task returns fewer links than it has rows.

    Fingerprints are ``words`` times 64 bits. Each goes to budget + 1 tries per part. A block value that more than ``hot``
    fingerprints share is cut into slots, and pairs of slots are walked by different tasks.
    """
    check = F.substring("fp", 1, CHECK_BITS // 8)
    dealt_out = _deal(fps.select("id", "fp", check.alias("check")), part_bits, budget, hot, ["check"], 64 * words // part_bits)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, which = _gathered(batches)
        if rows is None:
            return
        ids, key = rows["id"].to_numpy(), rows["key"].to_numpy().view(np.uint64)
        check = _parts(rows["check"].to_pylist(), 64)
        for lo, hi, pairs in _walks(which, key, part_bits, budget):
            forest = Forest(hi - lo)
            for a, b in pairs:
                far = np.bitwise_count(check[a] ^ check[b]).sum(axis=1, dtype=np.int64)
                near = slice(None) if within is None else far <= within
                forest.add(a[near] - lo, b[near] - lo, far[near])
            if len(forest.a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + forest.a]), pa.array(ids[lo + forest.b]), pa.array(forest.w)], ["a", "b", "bits"])

    return dealt_out.mapInArrow(join, "a long, b long, bits long")


def _deal(fps: DataFrame, part_bits: int, budget: int, hot: int, cols: list[str], fps_parts: int) -> DataFrame:
    """Rows of ``fps`` (id, fp, ``cols``) once for each trie and slot: bucket, lo, hi, slot, key, id, ``cols``.

    ``fps_parts`` is the number of parts in a fingerprint.
    """
    blocks, width = budget + 1, part_bits // (budget + 1)
    names = ["bucket", "key", "id", *cols]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = _parts(b["fp"].to_pylist(), part_bits)
            for p in range(parts.shape[1]):
                for k in range(blocks):
                    key = _rotated(parts[:, p], part_bits, k * width, width)
                    bucket = (key >> np.uint64(part_bits - width)).astype(np.int64) + ((p * blocks + k) << width)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), b["id"], *(b[c] for c in cols)], names)

    schema = ", ".join(["bucket long, key long, id long", *(f"{c} {fps.schema[c].dataType.simpleString()}" for c in cols)])
    dealt = fps.select("id", "fp", *cols).mapInArrow(spread, schema)
    sizes = materialize(dealt.groupBy("bucket").count().filter(F.col("count") > hot), "hot")
    one = F.lit(0).cast("long")
    # the numbers of rows and of what hot blocks add to them are known, so tasks stay of one size
    more = sizes.agg(F.sum(F.col("count") * (F.ceil(F.col("count") / hot) - 1))).first()[0] or 0
    total = fps.count() * blocks * fps_parts + int(more)
    if not more:
        tasks = dealt.withColumns({"lo": one, "hi": one, "slot": one})
    else:
        slotted = dealt.join(sizes, "bucket", "left").withColumn("slots", F.ceil(F.coalesce("count", F.lit(1)) / hot).cast("long"))
        slot = F.pmod(F.xxhash64("key", "id"), F.col("slots"))
        # a row meets the rows of every slot, in the task of that pair of slots
        pairs = slotted.select("*", slot.alias("slot"), F.explode(F.sequence(one, F.col("slots") - 1)).alias("other"))
        tasks = pairs.withColumns({"lo": F.least("slot", "other"), "hi": F.greatest("slot", "other")})
    return tasks.select("bucket", "lo", "hi", "slot", "key", "id", *cols).repartition(tasks_for(fps, total, TASK_ROWS), "bucket", "lo", "hi")


def tasks_for(df: DataFrame, total: int, each: int) -> int:
    """Number of tasks so that each has about ``each`` of ``total``, and at least the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each))


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, np.ndarray]:
    """The dealt rows of a task in the order that _walks wants, and the number of each row's walk."""
    full = [b for b in batches if b.num_rows]
    if not full:
        return None, np.empty(0, np.int64)
    rows = pa.Table.from_batches(full)
    _, which = np.unique(np.stack([rows[c].to_numpy() for c in ("bucket", "lo", "hi")], axis=1), axis=0, return_inverse=True)
    which = which.ravel()
    order = np.lexsort((rows["id"].to_numpy(), rows["key"].to_numpy().view(np.uint64), which))
    return rows.take(pa.array(order)), which[order]


def _walks(which: np.ndarray, key: np.ndarray, part_bits: int, budget: int) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Slices lo, hi of a task's rows, each with the pairs of its rows that are within the budget."""
    width = part_bits // (budget + 1)
    # a task's number stands in the key where its block value was, so that one walk serves many
    for first in range(0, int(which[-1]) + 1, 1 << width):
        lo, hi = np.searchsorted(which, (first, first + (1 << width)))
        tail = key[lo:hi] & np.uint64((1 << (part_bits - width)) - 1)
        placed = ((which[lo:hi] - first).astype(np.uint64) << np.uint64(part_bits - width)) | tail
        leaves, at, count = np.unique(placed, return_index=True, return_counts=True)
        yield lo, hi, ((lo + a, lo + b) for i, j in walk_trie(leaves, part_bits, width, budget) for a, b in _rows_of(i, j, at, count))


def _rows_of(i: np.ndarray, j: np.ndarray, at: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows below pairs of leaves, a leaf with itself too, in blocks of bounded size."""
    of = np.repeat(np.arange(len(i)), count[i])
    a = at[i][of] + np.arange(len(of)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
    first, n = at[j][of], count[j][of]
    own = (i == j)[of]  # only the rows behind it
    n = np.where(own, first + n - a - 1, n)
    first = np.where(own, a + 1, first)
    ends = np.cumsum(n)
    start = 0
    while start < len(a):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + FRONTIER)))
        k = n[start:end]
        if k.sum():
            left = np.repeat(a[start:end], k)
            yield left, np.repeat(first[start:end], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        start = end


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 3, budget: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of 64 bits over k-word shingles link at ``budget`` or fewer differing bits;
    component_id is the smallest doc_id reachable. Texts without a word, null ones too, have
    fingerprint zero and link like any other. Equal fingerprints are one node, so copies cost one
    partial minimum. A row with a null doc_id keeps its row and gets its component's id, null if
    it has none. Other columns are not read; an empty table gives no row.
    """
    hashed = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), text_col), text_col, ["id"], k), "fingerprints")
    nodes = materialize(hashed.groupBy("fp").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n")), "nodes")
    links = trie_links(nodes.filter("_first is not null").select(F.col("_first").alias("id"), "fp"), 64, budget)
    found = connected_components(materialize(links, "links"))
    named = nodes.join(found.withColumnRenamed("node", "_first"), "_first", "left").select("fp", "_n", F.coalesce("component", "_first").alias("component_id"))
    return join_groups(hashed, materialize(named, "named"), ["fp"], "_n").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# ---- near-dedup on word shingles ------------------------------------------------------------

#: 256 bits in parts of 32: pairs of similarity 0.8 differ in 4.8 bits of a part on average, so
#: that one of eight parts is within 3 bits in 91 of 100 cases, and at 0.85 in 98.7.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
WIDE, PART_BITS, PART_BUDGET = 4, 32, 3
#: Of CHECK_BITS bits, 19 differ on average at 0.8 (deviation 4), and 64 in unlike texts.
CHECK_WITHIN = 36


def _own(x: np.ndarray, trie: np.ndarray) -> np.ndarray:
    """Whether ``trie`` is the first that joins a pair whose parts differ in the bits ``x``: each pair has one."""
    blocks, width = PART_BUDGET + 1, PART_BITS // (PART_BUDGET + 1)
    part = (np.bitwise_count(x) <= PART_BUDGET).argmax(axis=1)
    shifts = np.array([PART_BITS - width * (k + 1) for k in range(blocks)], np.uint64)
    same = (x[np.arange(len(x)), part][:, None] >> shifts) & np.uint64((1 << width) - 1) == 0
    return part * blocks + same.argmax(axis=1) == trie


def _open_pairs(rows: pa.Table, which: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates between different ``comp``, in all tasks each once."""
    key, full = rows["key"].to_numpy().view(np.uint64), _parts(rows["full"].to_pylist(), PART_BITS)
    slot, lo, hi = (rows[c].to_numpy() for c in ("slot", "lo", "hi"))
    trie = rows["bucket"].to_numpy() >> (PART_BITS // (PART_BUDGET + 1))
    for _, _, pairs in _walks(which, key, PART_BITS, PART_BUDGET):
        for a, b in pairs:
            keep = (comp[a] != comp[b]) & (np.minimum(slot[a], slot[b]) == lo[a]) & (np.maximum(slot[a], slot[b]) == hi[a])
            a, b = a[keep], b[keep]
            x = full[a] ^ full[b]
            far = np.bitwise_count(x[:, : CHECK_BITS // PART_BITS]).sum(axis=1, dtype=np.int64)
            keep = (far <= CHECK_WITHIN) & _own(x, trie[a])
            if keep.any():
                yield a[keep], b[keep]


class Sets:
    """Sets of a task's rows, to verify pairs of them, and what the accepted links join so far."""

    def __init__(self, sets: pa.Array, comp: np.ndarray, similar: float) -> None:
        values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
        distinct, self.items = np.unique(values, return_inverse=True)
        self.start, self.size, self.similar = ends[:-1], np.diff(ends), similar
        self.seen = np.zeros(len(distinct), np.int8)
        names, self.comp = np.unique(comp, return_inverse=True)
        self.label = np.arange(len(names))

    def common(self, a: int, b: np.ndarray) -> np.ndarray:
        """Number of items that the set of a shares with each of b."""
        own = self.items[self.start[a] : self.start[a] + self.size[a]]
        self.seen[own] = 1
        ends = np.cumsum(self.size[b])
        found, first = np.empty(len(b), np.int64), 0
        while first < len(b):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + FRONTIER)))
            n, at = self.size[b[first:last]], ends[first:last] - self.size[b[first:last]] - done
            index = np.arange(n.sum()) + np.repeat(self.start[b[first:last]] - at, n)
            found[first:last] = np.add.reduceat(self.seen[self.items[index]], at, dtype=np.int64)
            first = last
        self.seen[own] = 0
        return found

    def links(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Those of the pairs that are similar enough and join what nothing accepted joined before."""
        x, y = self.size[a], self.size[b]
        keep = np.minimum(x, y) / np.maximum(x, y) >= self.similar  # no pair can be more similar
        a, b = a[keep], b[keep]
        order = np.argsort(a, kind="stable")
        firsts, at = np.unique(a[order], return_index=True)
        for one, others in zip(firsts.tolist(), np.split(b[order], at[1:]), strict=True):
            others = others[self.label[self.comp[others]] != self.label[self.comp[one]]]
            if not len(others):
                continue
            common = self.common(one, others)
            for other in others[common / (self.size[one] + self.size[others] - common) >= self.similar].tolist():
                mine, its = self.label[self.comp[one]], self.label[self.comp[other]]
                if mine != its:
                    self.label[self.label == its] = mine
                    yield one, other


def open_links(nodes: DataFrame, sets: DataFrame, similar: float, hot: int = HOT // 4) -> DataFrame:
    """Links (a, b) that join what ``nodes`` (id, fp, comp) leave apart: all candidates between
    different comp are verified on ``sets`` (id, set), in the task of the trie they belong to.

    Sets go only to the tries in which their row has such a candidate, and what a task accepts it
    returns as a forest. Pairs that an accepted link of the task already joins are not looked at.
    """
    dealt = _deal(nodes.select("id", "fp", F.col("fp").alias("full"), "comp"), PART_BITS, PART_BUDGET, hot, ["full", "comp"], 64 * WIDE // PART_BITS)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, which = _gathered(batches)
        if rows is None:
            return
        met = np.zeros(rows.num_rows, bool)
        for a, b in _open_pairs(rows, which, rows["comp"].to_numpy()):
            met[a] = met[b] = True
        yield from rows.filter(pa.array(met)).to_batches()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, which = _gathered(batches)
        if rows is None:
            return
        ids, comp = rows["id"].to_numpy(), rows["comp"].to_numpy()
        known = Sets(rows["set"].combine_chunks(), comp, similar)
        for a, b in _open_pairs(rows, which, comp):
            found = list(known.links(a, b))
            if found:
                left, right = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], ["a", "b"])

    met = materialize(dealt.mapInArrow(members, dealt.schema), "contested")
    total = met.join(sets.select("id", F.size("set").alias("n")), "id").agg(F.sum("n")).first()[0] or 0
    return met.join(sets, "id").select(*dealt.columns, "set").repartition(tasks_for(met, total, TASK_MEMBERS), "bucket", "lo", "hi").mapInArrow(verify, "a long, b long")


def near_links(docs: DataFrame, text_col: str = "text", k: int = NEAR_WORDS, similar: float = NEAR_SIMILARITY) -> DataFrame:
    """Verified links (a, b) between rows of ``docs`` (_row long, text), enough for the components.

    Candidates come from the tries of all parts of a wide fingerprint of the set of shingles; each that matters is
    verified by the Jaccard similarity of the sets of k-word shingles, equal sets being one node.
    A forest of candidates is verified first, so that large groups are joined by few links; then
    all candidates between the components so far. Only texts in some candidate are read again,
    and only as hashes. Texts without a word link to nothing.
    """
    wordy = docs.filter(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]")) > 0).select("_row", text_col)
    hashed = materialize(fingerprints(wordy, text_col, ["_row"], k, WIDE, as_sets=True), "fingerprints")
    nodes = materialize(hashed.groupBy("fp", "digest").agg(F.min("_row").alias("id"), F.count(F.lit(1)).alias("_n")), "nodes")
    equal = join_groups(hashed, nodes.filter("_n > 1"), ["fp", "digest"], "_n").filter("_row <> id").select(F.col("id").alias("a"), F.col("_row").alias("b"))
    close = trie_links(nodes.select("id", "fp"), PART_BITS, PART_BUDGET, CHECK_WITHIN, words=WIDE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(close.distinct(), "candidates")

    words = F.filter(F.split(F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct()
    read = wordy.join(rows, "_row", "left_semi").select("_row", words.alias("w"))
    few, at = F.size("w") < k, F.sequence(F.lit(0), F.size("w") - k)
    several = F.transform(at, lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(k))))
    sets = materialize(read.select("_row", F.array_distinct(F.when(few, F.array(F.xxhash64("w"))).otherwise(several)).alias("set")), "sets")
    both = pairs.join(sets.select(F.col("_row").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("_row").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    first = materialize(both.filter(common / (F.size("x") + F.size("y") - common) >= similar).select("a", "b"), "accepted")

    # a row in any candidate is in the forest of its trie too, so rows without a set have none
    comps = connected_components(first).withColumnRenamed("node", "id")
    left = nodes.join(sets.select(F.col("_row").alias("id")), "id").join(comps, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("comp"))
    found = open_links(materialize(left, "open"), sets.withColumnRenamed("_row", "id"), similar)
    return first.union(found).union(equal)


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = NEAR_WORDS, similar: float = NEAR_SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but for near duplicates, all columns unchanged.

    Of each group of linked rows the one with the smallest id (null last, then the first row of
    the input) stays; rows in no link stay. Null and empty texts are never near duplicates.
    """
    all_rows = numbered(settled(docs, "docs"), "_row")
    rows = all_rows.select("_row", F.col(f"_all.{id_col}").alias("id"), F.col(f"_all.{text_col}").alias(text_col))
    found = connected_components(materialize(near_links(rows.select("_row", text_col), text_col, k, similar), "links"))
    known = materialize(found.join(rows.select("_row", "id"), found["node"] == F.col("_row")).select("_row", "id", "component"), "members")
    best = known.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "_row")).alias("best"))
    out = known.join(best, "component").filter(F.col("_row") != F.col("best._row")).select("_row")
    return all_rows.join(out, "_row", "left_anti").select("_all.*")
