"""The prefix trie of conversations: double-array tries over shards of prefixes, joined at the nodes they share.

A node is a distinct sequence of first turns (role, text). Texts are only hashed where they are read; what is shuffled
is a digest and a length for each turn. Equal conversations collapse in partial aggregates. Sequences are dealt
to shards by their prefix, a longer one where too many turns share it, so that no shard is large whatever conversations share.
Each shard numbers its turns densely, packs BASE and CHECK, and walks them for its nodes. Nodes below a shard's prefix are
its own; those on the way to it are shared by shards and merged over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recscan.llm.shared import BROADCAST_ROWS, join_groups, materialize, small_batches
from recscan.operators.ranks import ranked

#: Turns after which a conversation is cut; what follows hangs below the node reached. One round of jobs for each.
BAND = 65_536
#: Turns of the sequences in a shard, if it holds more than one.
SHARD_TURNS = 100_000
#: Places that are tried for the children of a node before they are put behind all others.
TRIES = 32
#: Hex digits of the digests that name turns and nodes.
DIGITS = 32

_NODE = "shard string, upper boolean, node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long"


def _digest(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, DIGITS)


ROOT = hashlib.sha256(b"").hexdigest()[:DIGITS]


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key and chars of each turn in its conversation's order; no texts.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns go by turn (null first), then role, then
    text; a null role or text is empty, repeated rows are repeated turns, and rows with a null conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    ties = materialize(rows.groupBy("conv_id", "turn").count().filter("count > 1"), "turn_ties")
    tie = F.lit(None).cast("struct<role:string,text:string>")
    if not ties.isEmpty():  # only turns that share their number are told apart by role and text
        same = ties.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"))
        rows = rows.join(same, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
        tie = F.when(F.col("_c").isNotNull(), F.struct(role.alias("role"), text.alias("text")))
    key = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    read = materialize(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), tie.alias("tie"), key.alias("key"), F.length(text).cast("long").alias("chars")), "turns")
    placed = ranked(read, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie").asc_nulls_first()], "place").drop("turn", "tie")
    firsts = materialize(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size")), "conversations")
    return join_groups(placed, firsts, ["conv_id"], "size").select("conv_id", (F.col("place") - F.col("first") + 1).alias("pos"), "key", "chars")


# ---- one shard ----------------------------------------------------------------------------


class DoubleArray:
    """A trie of sorted, distinct sequences of codes above 0: child c of s is at BASE[s] + c if CHECK says s there."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.base, self.check, self._free = [0], [0], [1]
        todo = [(0, 0, len(sequences), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            low += low < high and len(sequences[low]) == depth  # one that ends here comes first
            heads = [low]
            for i in range(low + 1, high):
                if sequences[i][depth] != sequences[i - 1][depth]:
                    heads.append(i)
            if low < high:
                codes = [sequences[i][depth] for i in heads]
                self.base[node] = base = self._place(codes)
                for c in codes:
                    self.check[base + c] = node
                todo.extend((base + c, i, j, depth + 1) for c, i, j in zip(codes, heads, [*heads[1:], high], strict=True))

    def _next(self, at: int) -> int:
        """The first free place from ``at`` on; the way there is shortened."""
        free, way = self._free, []
        while at < len(free) and free[at] != at:
            way.append(at)
            at = free[at]
        for x in way:
            free[x] = at
        return at

    def _place(self, codes: list[int]) -> int:
        """A base at which all codes are free; their places are taken."""
        at = self._next(1)
        for _ in range(TRIES):
            if all(self._next(at - codes[0] + c) == at - codes[0] + c for c in codes):
                break
            at = self._next(at + 1)
        else:
            at = max(at, len(self.check))
        base = at - codes[0]
        grow = base + codes[-1] + 1 - len(self.check)
        if grow > 0:
            self.base += [0] * grow
            self.check += [-1] * grow
        self._free.extend(range(len(self._free), len(self.check) + 1))
        for c in codes:
            self._free[base + c] = base + c + 1
        return base

    def step(self, node: int, code: int) -> int:
        """The child by a code, or -1."""
        at = self.base[node] + code
        return at if 0 < at < len(self.check) and self.check[at] == node else -1


def shard_nodes(rows: list[dict]) -> list[tuple]:
    """The nodes of one shard, whose sequences are all below ``start`` and share their first ``top`` turns or are alone.

    Nodes of at least ``top`` turns are whole. On those above, n_leaves and saved_tokens are what the shard has below them all.
    """
    start, top, before = rows[0]["start"], rows[0]["top"], rows[0]["band"] * BAND
    code: dict[str, int] = {}
    held = sorted(([code.setdefault(k, len(code) + 1) for k in r["keys"]], i) for i, r in enumerate(rows))
    trie = DoubleArray([s for s, _ in held])
    size = len(trie.check)
    name, depth, chars, n, conv = [""] * size, [0] * size, [0] * size, [0] * size, [None] * size
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    name[0], way, order, prev = start or ROOT, [0], [0], []
    hashes = [hashlib.sha256(start.encode())]
    for s, i in held:
        r, shared = rows[i], 0
        while shared < len(prev) and prev[shared] == s[shared]:
            shared += 1
        del way[shared + 1 :], hashes[shared + 1 :]
        for k in range(shared, len(s)):
            at = trie.step(way[-1], s[k])
            if at < 0:
                raise ValueError("a sequence is not in its trie")
            h = hashes[-1].copy()
            h.update(r["keys"][k].encode())
            name[at], depth[at], chars[at] = h.hexdigest()[:DIGITS], k + 1, r["chars"][k]
            way.append(at)
            hashes.append(h)
            order.append(at)
        at, prev = way[-1], s
        n[at], conv[at], kids[at], leaves[at], saved[at] = r["n"], r["conv_id"], r["kids"], r["leaves"], r["saved"]
    out = []
    for at in reversed(order):
        up = trie.check[at]
        if own := depth[at] >= top:
            leaves[at] += not kids[at]
            saved[at] += (n[at] - 1) * chars[at]
        if at:
            n[up] += n[at]
            conv[up] = conv[at] if conv[up] is None else min(conv[up], conv[at])
            leaves[up] += leaves[at]
            saved[up] += saved[at]
            # children that other shards may have too are counted over all shards
            kids[up] += own
        out.append((at, up, own))
    key = rows[0]["shard"]
    below = (leaves[0], saved[0])
    return [
        (key, not own, name[at], name[up] if at else None, before + depth[at], conv[at], conv[up] if own and depth[at] > top else None, n[at], kids[at], *((leaves[at], saved[at]) if own else below), chars[at])
        for at, up, own in out
    ]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for batch in batches for r in batch.to_pylist())
    fields, kinds = [x.split() for x in _NODE.split(", ")], {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    for _, shard in groupby(rows, lambda r: r["shard"]):
        found = shard_nodes(list(shard))
        for first in range(0, len(found), BAND):
            columns = zip(*found[first : first + BAND], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


# ---- over all shards ----------------------------------------------------------------------


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node above each band but the first; rows come by conversation, then band."""
    at, name = None, ""
    for batch in batches:
        starts = []
        for conv, said in zip(batch["conv_id"].to_pylist(), batch["said"].to_pylist(), strict=True):
            name = name if conv == at else ""
            starts.append(name)
            at, name = conv, hashlib.sha256((name + said).encode()).hexdigest()[:DIGITS]
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["band"], pa.array(starts, pa.string())], ["conv_id", "band", "start"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the conversations that end at each node; rows come by node, then conversation, and are not gathered."""
    at, h = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for node, conv in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if node == at:
                h.update(b",%d" % conv)
                continue
            if h:
                done.append((at, h.hexdigest()))
            at, h = node, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["node", "ends_sha256"])
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (at, h.hexdigest())], ["node", "ends_sha256"])


def _sharded(strings: DataFrame) -> DataFrame:
    """``strings`` with shard, the digest of a prefix, and top, its number of turns, such that no shard with two rows is large."""
    todo, level, found = strings.select("start", "end", F.size("keys").alias("size"), "marks"), 0, []
    while True:
        mark = F.coalesce(F.get("marks", F.lit(level)), F.col("end")).alias("shard")
        here = todo.select("*", mark)
        sums = here.groupBy("shard").agg(F.sum("size").alias("turns"), F.count(F.lit(1)).alias("n"))
        large = materialize(sums.filter((F.col("turns") > SHARD_TURNS) & (F.col("n") > 1)).select("shard"), "large_prefixes")
        n = large.count()
        known = F.broadcast(large) if n <= BROADCAST_ROWS else large
        found.append(here.join(known, "shard", "left_anti").select("end", "shard", F.lit(1 << level).alias("top")))
        if not n:
            break
        todo, level = materialize(here.join(known, "shard", "left_semi").drop("shard"), "large_sequences"), level + 1
    shards = found[0]
    for more in found[1:]:
        shards = shards.unionByName(more)
    return strings.drop("marks").join(shards, "end")


def _band_nodes(strings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own nodes, shared nodes, totals of the starts) of one band; strings have start, end, band, n, conv_id, keys, chars, marks, kids, leaves, saved."""
    dealt = _sharded(strings).repartition("shard").sortWithinPartitions("shard", "end")
    made = materialize(dealt.select("shard", "top", "start", "band", "n", "conv_id", "keys", "chars", "kids", "leaves", "saved").mapInArrow(_shards, _NODE), "shard_nodes")
    part = made.filter("upper")
    both = part.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("own_children"),
        F.max("chars").alias("chars"), F.min("shard").alias("owner"), F.count(F.lit(1)).alias("shards"),
    )
    both = materialize(both, "shared_nodes")
    kids = both.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    merged = materialize(both.join(kids, "node", "left").withColumn("n_children", F.col("own_children") + F.coalesce("kids", F.lit(0))), "shared_nodes")
    # each shared node is counted on one shard's way only, below all the nodes above it
    facts = merged.select("node", "owner", "shards", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    on_way = join_groups(part.select("node", "shard", "depth", "n_leaves", "saved_tokens"), facts, ["node"], "shards")
    below = Window.partitionBy("shard").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.col("owner") == F.col("shard")
    sums = on_way.select(
        "node", (F.col("n_leaves") + F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(below)).alias("l"), (F.col("saved_tokens") + F.sum(F.when(mine, F.col("own")).otherwise(0)).over(below)).alias("s")
    )
    shared = merged.join(sums.groupBy("node").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens")), "node")
    columns = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own = made.filter("not upper").select(*columns, "parent_conv_id")
    return own, materialize(shared.select(*columns), "shared_nodes"), merged.filter("parent is null").select("node")


def prefix_trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` has conv_id, pos, key and chars, as of :func:`turn_rows`; ``conversations`` a row for each conv_id, those without a turn too. Members of a
    node are the conversations that start with it; n_leaves and saved_tokens are of its subtree, itself included; ends_sha256 is
    of the decimal conv_ids, ascending and joined by commas, that have no further turn. No conversation gives no row, conversations
    without turns the root. Shared nodes and shards are narrow rows; the conversations that end at one node are read in
    order by one task, which holds none of them.
    """
    small_batches(rows.sparkSession)
    bands = rows.withColumn("band", F.floor((F.col("pos") - 1) / BAND)).groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("ts"))
    bands = materialize(bands.select("conv_id", "band", F.col("ts.key").alias("keys"), F.col("ts.chars").alias("chars")), "bands")
    last = bands.agg(F.max("band")).first()[0] or 0
    said = F.array_join("keys", "")
    if last:
        long = bands.filter("band > 0").select("conv_id").distinct()
        order = bands.join(long, "conv_id", "left_semi").select("conv_id", "band", said.alias("said")).repartition("conv_id").sortWithinPartitions("conv_id", "band")
        starts = materialize(order.mapInArrow(_chains, "conv_id long, band long, start string").filter("band > 0"), "starts")
        bands = bands.join(starts, ["conv_id", "band"], "left")
    else:
        bands = bands.withColumn("start", F.lit(""))
    bands = bands.withColumn("start", F.coalesce("start", F.lit(""))).withColumn("end", _digest(F.concat("start", said)))
    ends = conversations.select("conv_id").distinct().join(bands.groupBy("conv_id").agg(F.max_by("end", "band").alias("node")), "conv_id", "left").select(F.coalesce("node", F.lit(ROOT)).alias("node"), "conv_id")
    ends = materialize(ends, "ends")
    marks = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BAND.bit_length())), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size("keys")),
        lambda k: _digest(F.concat("start", F.array_join(F.slice("keys", F.lit(1), F.call_function("shiftleft", F.lit(1), k)), ""))),
    )
    same = bands.groupBy("band", "start", "end").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min_by(F.struct("keys", "chars"), "conv_id").alias("x"))
    strings = materialize(same.select("band", "start", "end", "n", "conv_id", F.col("x.keys").alias("keys"), F.col("x.chars").alias("chars")).withColumn("marks", marks), "sequences")
    own_all, shared_all, extra = [], [], None
    for band in range(last, -1, -1):
        here = strings.filter(F.col("band") == band)
        if extra is not None:
            here = here.join(extra, "end", "left")
        for name in ("kids", "leaves", "saved"):
            here = here.withColumn(name, F.coalesce(name, F.lit(0).cast("long")) if extra is not None else F.lit(0).cast("long"))
        own, shared, top = _band_nodes(here)
        below = shared.join(top, "node", "left_semi")
        extra = below.select(F.col("node").alias("end"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        own_all.append(own)
        # what a band starts from is a node of the band before
        shared_all.append((shared.join(top, "node", "left_anti") if band else shared).withColumn("parent_conv_id", F.lit(None).cast("long")))
    nodes = _union([*own_all, *shared_all])
    # the root takes in the conversations without a turn
    bare = ends.filter(F.col("node") == ROOT).groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("conv_id").alias("_c"))
    root = bare.join(nodes.select("node").filter(F.col("node") == ROOT), "node", "left_anti").select(
        "node", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.col("_c").alias("conv_id"), F.lit(0).cast("long").alias("n_convs"),
        *(F.lit(v).cast("long").alias(k) for k, v in (("n_children", 0), ("n_leaves", 1), ("saved_tokens", 0), ("parent_conv_id", None))),
    )
    nodes = nodes.unionByName(root).join(F.broadcast(bare), "node", "left").withColumn("conv_id", F.least("conv_id", "_c")).withColumn("n_convs", F.col("n_convs") + F.coalesce("_n", F.lit(0))).drop("_n", "_c")
    nodes = materialize(nodes, "nodes")
    # parents that shards share, or that end a band, are looked up; the others are known to the shard
    open_ = nodes.filter("parent is not null and parent_conv_id is null")
    asked = materialize(open_.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("size")), "parents")
    parents = asked.join(nodes.select("node", F.col("conv_id").alias("_c")), "node").select(F.col("node").alias("parent"), "size", "_c")
    found = join_groups(open_, materialize(parents, "parents"), ["parent"], "size").withColumn("parent_conv_id", F.col("_c"))
    nodes = nodes.filter("parent is null or parent_conv_id is not null").unionByName(found.select(nodes.columns))
    digests = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "node string, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(digests, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def shared_starts(rows: DataFrame, take: Column, group: Column) -> DataFrame:
    """``rows`` where each conversation begins with the first ``take`` turns of the one that ``group`` names, then its own after as many.

    ``take`` and ``group`` are expressions over conv_id; take is below 16. If that conversation has fewer turns all are taken, none if there is none.
    """
    most = 16
    convs = materialize(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "conversations")
    first = rows.filter(F.col("pos") < most).groupBy(F.col("conv_id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("_first"))
    asked = convs.select("conv_id", "size", take.alias("_take"), group.alias("_of"))
    given = materialize(asked.join(first, "_of", "left").withColumn("_given", F.slice(F.coalesce("_first", F.array().cast("array<struct<pos:bigint,key:string,chars:bigint>>")), F.lit(1), F.col("_take"))), "given")
    lead = given.select("conv_id", F.explode("_given").alias("t")).select("conv_id", "t.pos", "t.key", "t.chars")
    shift = given.select("conv_id", "size", F.col("_take").alias("_take"), F.size("_given").alias("_n"))
    own = join_groups(rows, shift, ["conv_id"], "size").filter(F.col("pos") > F.col("_take"))
    return lead.unionByName(own.select("conv_id", (F.col("pos") - F.col("_take") + F.col("_n")).alias("pos"), "key", "chars"))
