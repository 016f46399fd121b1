import hashlib
import random
import zlib

import numpy as np
import pytest

from weirworks.llm import trie

SHAPE = "conv_id long, turn long, role string, text string, depth int, shard string, n_convs long, key binary"


def rows(conversations):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t, 1, "x", 2, b"k") for c, turns in conversations.items() for i, t in enumerate(turns)]


def rebuild(table):
    """The contract: rows of (conv_id, turn, role, text) to {conv_id: [(role, text)]}."""
    own = {}
    for c, turn, role, text, *_ in table:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, role or ""), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = {c: own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), []) for c in own}
    return {c: base[c][:h[c]] + own[c][h[c]:] for c in own}


def brute(conversations):
    """All nodes, by listing every prefix."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ended = sorted(c for c in convs if len(conversations[c]) == len(path))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below),
                 sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in members) for p in below),
                 sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return out


def got(df):
    found = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def mixed(n, seed):
    """Conversations that begin alike, copies, one that is a prefix of others, and long ones."""
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        kind = rng.random()
        turns = [f"t{rng.randrange(3)}" for _ in range(rng.randrange(1, 7))]
        out[c] = ["hot", "hot answer"] + turns if kind < .4 else ["same", "copy", "of all"] if kind < .6 else turns
    out[n] = [f"long {i % 7}" for i in range(300)]
    out[n + 1] = out[n][:250] + ["other end"]
    return out


@pytest.mark.parametrize("shard", [10 ** 6, 40, 1])
def test_against_every_prefix(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(trie, "SPREAD_TURNS", 60)
    monkeypatch.setattr(trie, "GROUP", 3)
    monkeypatch.setattr(trie, "LISTED", 5)
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    table = rows(mixed(260, shard))
    table += [(7, 3, None, None, 0, "", 0, None), (8, None, "user", "no number comes first", 0, "", 0, None), (None, 0, "user", "lost", 0, "", 0, None),
              (900, 0, "user", "", 0, "", 0, None), (-105, 0, "user", "below zero", 0, "", 0, None), (1205, 0, "user", "x" * 5000, 0, "", 0, None),
              (1_000_003, 0, "user", "ü🙂漢", 0, "", 0, None)]
    if shard == 1:                                            # a shard for every sequence: short ones only
        table = [r for r in table if r[0] not in (260, 261)][:150] + table[-7:]
    df = spark.createDataFrame(table, SHAPE).repartition(5)
    assert got(trie.conversation_nodes(df)) == brute(rebuild(table))


def test_one_shard_for_each_core_and_several_rounds(spark, monkeypatch):
    """Many partitions, so that edges are merged in three rounds."""
    monkeypatch.setattr(trie, "SHARD_TURNS", 12)
    monkeypatch.setattr(trie, "GROUP", 2)
    conversations = {c: [f"r{c % 2}", f"s{c % 5}", f"t{c % 11}"][:c % 4] for c in range(1, 60)}
    whole = trie.sequences(spark.createDataFrame(rows(conversations) + [(c, 0, "user", "z", 0, "", 0, None) for c in (4, 8)], SHAPE))
    own = {c: [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)] for c, turns in conversations.items() if turns}
    own |= {4: [("user", "z")], 8: [("user", "z")]}
    assert got(trie.prefix_nodes(whole)) == brute(own)


def test_empty_and_one(spark):
    none = spark.createDataFrame([], SHAPE)
    assert trie.conversation_nodes(none).collect() == []
    one = spark.createDataFrame(rows({5: ["a"]}), SHAPE)
    assert got(trie.conversation_nodes(one)) == brute(rebuild(rows({5: ["a"]})))


def test_double_array_finds_what_it_holds():
    rng = random.Random(2)
    words = sorted({tuple(rng.randrange(40) for _ in range(rng.randrange(0, 6))) for _ in range(3000)})
    turns, ptr = np.array([t for w in words for t in w]), np.append(0, np.cumsum([len(w) for w in words]))
    parent, label = trie._levels(turns, ptr)
    held = trie.DoubleArray(parent, label + 1)
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    slots = {p: held.find([t + 1 for t in p]) for p in prefixes}
    assert len(set(slots.values())) == len(prefixes) == len(parent) + 1 and -1 not in slots.values()
    assert (held.check >= 0).sum() == len(parent)                      # no other slot claims a parent
    for _ in range(2000):
        w = tuple(rng.randrange(41) for _ in range(rng.randrange(0, 7)))
        assert (held.find([t + 1 for t in w]) >= 0) == (w in prefixes)
    assert len(held.check) < 3 * len(prefixes)
