"""Prefix tries of conversations in double arrays, shard by shard.

A conversation is the sequence of its turns, each known by two 64-bit hashes of role and text and by its length in code
points; texts do not travel. Equal sequences become one row that counts its conversations. The distinct sequences are dealt
to shards by ranges of their order, so that a shard holds whole subtrees but for the nodes on the paths of its first and
its last sequence, its edges. Each shard numbers its turns densely, packs its trie into BASE and CHECK arrays (the node in
slot s has the child for turn c in slot BASE[s] + c if CHECK says s there), walks all sequences through them, and adds up
its subtrees. Inner nodes are done then. Edge nodes, which neighbouring shards share, are merged in groups of ``GROUP``
neighbours, and what remains on the edges of a group in groups of groups, until none is left; so no task ever meets more
than the edges of ``GROUP`` shards, however many conversations begin alike.

The conversations that end at a node are listed by hashing their ids in order. Ranges of the sorted ids are joined to
texts first, so the one task that must hash a node's list in sequence reads few rows.

A null role or text is empty. Turns go by turn number, null first, ties by role and a hash of the text. Turns without a
conv_id belong to no conversation and are left out; extra columns are ignored; an empty table has no nodes. One
conversation's hashes (24 bytes a turn) are held as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.operators.joins import fits_broadcast
from weirworks.sources.workdir import written

HEAD = 5                     # the most turns that a rebuilt conversation takes from another
SHARD_TURNS = 400_000        # turns of distinct sequences in one double array
SPREAD_TURNS = 5_000         # a small input is dealt to shards of this size, while cores are free
LISTED = 20_000              # ids joined to one text
GROUP = 32
NONE = hashlib.sha256(b"").hexdigest()
FIRST, LAST = 1, 2           # edges of a shard
SUMS = ["n_convs", "n_children", "n_leaves", "spent", "chars_below"]
NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, spent long, chars_below long, chars long, ends_sha256 string"
ROW = NODE + ", parent_conv_id long, key binary, parent_key binary, edge int, shard long"


# --- sequences -------------------------------------------------------------------------------------------------------

def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns an array of (a, b, chars) in order, for every conversation with an id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"),
                    F.xxhash64(role, text, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
                    F.length(text).cast("long").alias("chars"))
    slim = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(whole: DataFrame) -> DataFrame:
    """Each conversation c with its first crc32(c) % 6 turns replaced by those of conversation c - c % 100, as far as there are."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")
    heads = whole.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD).alias("head"))
    own = whole.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("taken", taken)
    kept = F.expr("slice(turns, taken + 1, greatest(size(turns) - taken, 0))")
    head = F.expr("slice(head, 1, taken)")
    none = F.expr("slice(turns, 1, 0)")
    return own.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(head, none), kept).alias("turns"))


# --- lists of conversations --------------------------------------------------------------------------------------------

def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence, joined by commas; rows come sorted."""
    shape = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids = None, []
    for batch in batches:
        out = []
        for ha, hb, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (ha, hb) or len(ids) >= LISTED:
                if ids:
                    out.append({"ha": key[0], "hb": key[1], "first": ids[0], "ids": ",".join(map(str, ids))})
                key, ids = (ha, hb), []
            ids.append(conv)
        yield pa.RecordBatch.from_pylist(out, shape)
    if ids:
        yield pa.RecordBatch.from_pylist([{"ha": key[0], "hb": key[1], "first": ids[0], "ids": ",".join(map(str, ids))}], shape)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each sequence's list, of which the parts come one after the other."""
    shape, key, state = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("ends_sha256", pa.string())]), None, None
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            ha, hb, ids = (batch.column(c)[i].as_py() for c in (0, 1, 3))
            if key == (ha, hb):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append({"ha": key[0], "hb": key[1], "ends_sha256": state.hexdigest()})
            key, state = (ha, hb), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pylist(out, shape)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"ha": key[0], "hb": key[1], "ends_sha256": state.hexdigest()}], shape)


def ends(named: DataFrame, parts: int) -> DataFrame:
    """(ha, hb, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations with each sequence."""
    rows = named.select("ha", "hb", "conv_id").repartitionByRange(parts, "ha", "hb", "conv_id").sortWithinPartitions("ha", "hb", "conv_id")
    lists = rows.mapInArrow(_listed, "ha long, hb long, first long, ids string")
    lists = lists.repartition(parts, "ha", "hb").sortWithinPartitions("ha", "hb", "first")
    return lists.mapInArrow(_hashed, "ha long, hb long, ends_sha256 string")


# --- the double array --------------------------------------------------------------------------------------------------

class DoubleArray:
    """A trie over dense turn ids; the root is in slot 0, and ``base`` and ``check`` are -1 in slots that hold no node.

    Built from edges in level order: edge e leads from node ``parent[e]`` by turn ``label[e]`` (1 and up) to node e + 1.
    """
    def __init__(self, parent: np.ndarray, label: np.ndarray):
        nodes, labels = len(parent) + 1, int(label.max(initial=0))
        children = np.bincount(parent, minlength=nodes)
        first = np.append(0, np.cumsum(children))
        order = np.lexsort((label, parent))
        label, child = label[order], order + 1
        self.slot = np.zeros(nodes, np.int64)                # of each node
        start = np.zeros(nodes, np.int64)                    # each node's base
        taken = np.zeros(nodes + labels + 2, bool)
        taken[0] = True
        low = 1
        for node in np.flatnonzero(children > 1)[np.argsort(-children[children > 1], kind="stable")].tolist():
            own = label[first[node]:first[node + 1]]
            while low < len(taken) and taken[low]:
                low += 1
            at = self._place(taken, own - own[0], low)
            if at + own[-1] - own[0] >= len(taken):
                taken = np.append(taken, np.zeros(len(taken) + int(own[-1]), bool))
            taken[at + own - own[0]] = True
            start[node] = at - own[0]
        # a node with one child takes any free slot for it
        single = np.flatnonzero(children == 1)
        taken = np.append(taken, np.zeros(len(single), bool))
        free = np.flatnonzero(~taken)[:len(single)]
        start[single] = free - label[first[single]]
        self.slot[child] = start[parent[order]] + label
        size = int(self.slot.max(initial=0)) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[self.slot] = start
        self.check[self.slot[child]] = self.slot[parent[order]]

    @staticmethod
    def _place(taken: np.ndarray, offsets: np.ndarray, low: int) -> int:
        """The first slot from ``low`` on that leaves all offsets free."""
        while low < len(taken):
            tries = np.arange(low, min(low + 256, len(taken)))
            near = tries[:, None] + offsets[None, :] if len(offsets) < 64 else None
            if near is not None:
                fits = ~(taken[np.minimum(near, len(taken) - 1)] & (near < len(taken))).any(1)
                if fits.any():
                    return int(tries[np.argmax(fits)])
            else:
                for at in tries.tolist():
                    own = at + offsets
                    if not taken[own[own < len(taken)]].any():
                        return at
            low += 256
        return low

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The slots of children; -1 where there is none."""
        at = self.base[slots] + labels
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == slots), at, -1)

    def find(self, labels: list[int]) -> int:
        """The slot at the end of a path from the root, -1 where there is none."""
        slot = np.zeros(1, np.int64)
        for label in labels:
            slot = self.step(slot, np.array([label]))
            if slot[0] < 0:
                return -1
        return int(slot[0])


def _levels(turns: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (parent, turn) in level order of sorted sequences; sequence i has turns[ptr[i]:ptr[i + 1]]."""
    size, at = np.diff(ptr), np.zeros(len(ptr) - 1, np.int64)
    parents, labels, made, depth = [], [], 1, 0
    active = np.flatnonzero(size > 0)
    while len(active):
        turn, node = turns[ptr[active] + depth], at[active]
        new = np.append(True, (turn[1:] != turn[:-1]) | (node[1:] != node[:-1]))
        parents.append(node[new])
        labels.append(turn[new])
        at[active] = made + np.cumsum(new) - 1
        made, depth = made + int(new.sum()), depth + 1
        active = active[size[active] > depth]
    return (np.concatenate(parents), np.concatenate(labels)) if parents else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _keys(pairs: np.ndarray) -> list[bytes]:
    """The name of each prefix of a sequence of (a, b), the empty one first."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for pair in pairs:
        state.update(pair.tobytes())
        out.append(state.digest())
    return out


def _nodes(shard: int, pairs: np.ndarray, chars: np.ndarray, ptr: np.ndarray, counts: np.ndarray, convs: np.ndarray, hashes: list[str]) -> pa.RecordBatch:
    """All nodes of a shard's sorted distinct sequences; sequence i has pairs[ptr[i]:ptr[i + 1]]."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    turn = np.empty(len(pairs), np.int64)
    turn[order] = np.cumsum(np.append(False, (pairs[order[1:]] != pairs[order[:-1]]).any(1))[:len(pairs)])
    parent, label = _levels(turn, ptr)
    # dense ids in the order of first use, so that neighbours in the trie are neighbours in the arrays
    used, first = np.unique(label, return_index=True)
    dense = np.empty(len(used), np.int64)
    dense[np.argsort(first)] = np.arange(1, len(used) + 1)
    ids = dense[np.searchsorted(used, turn)]
    trie = DoubleArray(parent, dense[np.searchsorted(used, label)])
    n = len(trie.check)
    live = np.zeros(n, bool)
    live[0] = True
    depth, own, convs_at, least = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    listed = np.full(n, -1, np.int64)
    size, at, active, d, levels = np.diff(ptr), np.zeros(len(ptr) - 1, np.int64), np.arange(len(ptr) - 1), 0, [np.zeros(1, np.int64)]
    while True:                                              # walk all sequences, one turn a step
        np.add.at(convs_at, at[active], counts[active])
        np.minimum.at(least, at[active], convs[active])
        done = active[size[active] == d]
        listed[at[done]] = done
        active = active[size[active] > d]
        if not len(active):
            break
        spot = ptr[active] + d
        at[active] = trie.step(at[active], ids[spot])
        d += 1
        own[at[active]], depth[at[active]], live[at[active]] = chars[spot], d, True
        levels.append(np.unique(at[active]))
    edge = np.zeros(n, np.int64)
    keys: dict[int, bytes] = {}
    for i, flag in ((0, FIRST), (len(ptr) - 2, LAST)):
        slot = 0
        for d, key in enumerate(_keys(pairs[ptr[i]:ptr[i + 1]])):
            slot = int(trie.step(np.array([slot]), ids[ptr[i] + d - 1:ptr[i] + d])[0]) if d else 0
            edge[slot] |= flag
            keys[slot] = key
    inner = edge == 0
    children, leaves, spent, below = np.zeros(n, np.int64), np.zeros(n, np.int64), convs_at * own, np.where(inner, own, 0)
    for slots in levels[:0:-1]:                              # subtrees, from the deepest nodes up
        leaves[slots] += inner[slots] & (children[slots] == 0)
        up = trie.check[slots]
        np.add.at(children, up, inner[slots].astype(np.int64))
        for total in (leaves, spent, below):
            np.add.at(total, up, total[slots])
    at = np.flatnonzero(live)
    up = trie.check[at]
    top, shared = up < 0, np.where(up >= 0, edge[up] > 0, False)
    text = lambda s: hashes[listed[s]] if listed[s] >= 0 else None
    columns = {
        "conv_id": pa.array(least[at]), "depth": pa.array(depth[at]), "n_convs": pa.array(convs_at[at]), "n_children": pa.array(children[at]),
        "n_leaves": pa.array(leaves[at]), "spent": pa.array(spent[at]), "chars_below": pa.array(below[at]), "chars": pa.array(own[at]),
        "ends_sha256": pa.array([text(s) for s in at.tolist()], pa.string()),
        "parent_conv_id": pa.array(least[up], mask=top | shared), "key": pa.array([keys.get(s) for s in at.tolist()], pa.binary()),
        "parent_key": pa.array([keys[u] if s else None for u, s in zip(up.tolist(), shared.tolist(), strict=True)], pa.binary()),
        "edge": pa.array(edge[at].astype(np.int32)), "shard": pa.array(np.full(len(at), shard))}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition's sorted sequences (turns, n_convs, conv_id, ends_sha256), a shard of at most ``SHARD_TURNS`` at a time."""
    part, serial, held, rows = TaskContext.get().partitionId(), 0, 0, []

    def shard() -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        turns = table.column("turns").combine_chunks()
        flat = turns.flatten()
        pairs = np.stack([flat.field(name).to_numpy() for name in ("a", "b")], 1) if len(flat) else np.zeros((0, 2), np.int64)
        ptr = np.append(0, np.cumsum(turns.value_lengths().to_numpy())).astype(np.int64)
        return _nodes((part << 32) + serial, pairs, flat.field("chars").to_numpy(), ptr, table.column("n_convs").to_numpy(),
                      table.column("conv_id").to_numpy(), table.column("ends_sha256").to_pylist())

    for batch in batches:
        size = np.cumsum(batch.column(0).value_lengths().to_numpy() + 1)
        low = 0
        while low < batch.num_rows:
            before = int(size[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(size, before + SHARD_TURNS - held, "right")))
            rows.append(batch.slice(low, high - low))
            held += int(size[high - 1]) - before
            low = high
            if held >= SHARD_TURNS or low < batch.num_rows:
                yield shard()
                rows, held, serial = [], 0, serial + 1
    if rows:
        yield shard()


# --- shared nodes --------------------------------------------------------------------------------------------------------

def _merge(rows: pd.DataFrame, *, last: bool = False) -> pd.DataFrame:
    """Edge nodes of neighbouring shards as one: what is no edge of the group is done, with ``last`` all of it."""
    low, high = rows["shard"].min(), rows["shard"].max()
    rows["edge"] = np.where(rows["shard"] == low, rows["edge"] & FIRST, 0) | np.where(rows["shard"] == high, rows["edge"] & LAST, 0)
    text = rows.dropna(subset=["ends_sha256"]).groupby("key")["ends_sha256"].first()
    nodes = rows.groupby("key", sort=False).agg(**{"conv_id": ("conv_id", "min"), "edge": ("edge", lambda e: np.bitwise_or.reduce(e.to_numpy()))},
                                                **{c: (c, "sum") for c in SUMS}, **{c: (c, "first") for c in ("depth", "chars", "parent_key")})
    nodes["ends_sha256"] = text.reindex(nodes.index).astype(object)
    if last:
        nodes["edge"] = 0
    nodes = nodes.sort_values("depth", ascending=False, kind="stable")
    number = {key: i for i, key in enumerate(nodes.index)}
    up = [number[p] if p is not None and p == p else -1 for p in nodes["parent_key"]]
    inner, chars = (nodes["edge"] == 0).to_numpy(), nodes["chars"].to_numpy()
    children, leaves, below = (nodes[c].to_numpy().copy() for c in ("n_children", "n_leaves", "chars_below"))
    more_leaves, more_chars = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for i, parent in enumerate(up):                          # deepest first
        if inner[i]:
            more_leaves[i] += children[i] == 0
            more_chars[i] += chars[i]
        if parent >= 0:
            children[parent] += inner[i]
            more_leaves[parent] += more_leaves[i]
            more_chars[parent] += more_chars[i]
    nodes["n_children"], nodes["n_leaves"], nodes["chars_below"] = children, leaves + more_leaves, below + more_chars
    nodes["parent_conv_id"], nodes["shard"] = None, low
    return nodes.reset_index()[[c.split()[0] for c in ROW.split(", ")]]


def _merge_last(rows: pd.DataFrame) -> pd.DataFrame:
    return _merge(rows, last=True)


def _merged(edges: DataFrame, shards: int) -> DataFrame:
    """Edge nodes of all shards, done: rounds of groups of neighbours, each one written."""
    done, width = None, 1
    while True:
        width *= GROUP
        last = width >= shards
        group = F.floor(F.shiftright("shard", 32) / F.lit(width))
        rows = written(edges.groupBy(group.alias("group")).applyInPandas(_merge_last if last else _merge, ROW), "trie-edges")
        ready = rows.where("edge = 0")
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        edges = rows.where("edge <> 0")


def prefix_nodes(whole: DataFrame) -> DataFrame:
    """One row per node of the trie of ``whole`` (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = whole.sparkSession
    named = written(whole.select("conv_id", "turns", F.xxhash64("turns").alias("ha"), F.xxhash64(F.lit(3), "turns").alias("hb")), "trie-sequences")
    total = named.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(-(-total // SHARD_TURNS), min(-(-total // SPREAD_TURNS), 2 * spark.sparkContext.defaultParallelism), 1)
    distinct = named.groupBy("ha", "hb").agg(F.any_value("turns").alias("turns"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    rows = distinct.join(ends(named, shards), ["ha", "hb"]).select("turns", "n_convs", "conv_id", "ends_sha256")
    rows = written(rows, "trie-distinct").repartitionByRange(shards, "turns").sortWithinPartitions("turns")
    nodes = written(rows.mapInArrow(_tries, ROW), "trie-nodes")
    shared = written(_merged(nodes.where("edge <> 0"), shards), "trie-shared")
    nodes = nodes.where("edge = 0").unionByName(shared)
    above = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    if fits_broadcast(above):
        above = F.broadcast(above)
    nodes = nodes.join(above, "parent_key", "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                        (F.col("spent") - F.col("chars_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_nodes(rebuilt(sequences(conversations)))
