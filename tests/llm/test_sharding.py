"""Sharding: the law, the slots, and that links are cut only where a quota forces it."""

import zlib
from collections import Counter, defaultdict

from weirworks.llm.sharding import shard_documents


def check(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_law_sizes_and_links(make, prose, odd):
    texts = [(i, prose(20, i % 60 if i < 240 else i)) for i in range(400)] + odd
    rows = shard_documents(make(texts, repeat=(0, 901)), 8).collect()
    assert len(rows) == len(texts) + 2
    check(rows, 8)
    by = dict(texts)
    for r in rows:
        data = (by[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data)
    places = defaultdict(set)
    for r in rows:
        if by[r.doc_id] is not None:
            places[by[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in places.values()) <= 2      # 62 groups of up to five, quotas of 51


def test_a_group_of_a_third_of_the_rows(make, prose):
    texts = [(i, "the same" if i % 3 == 0 else prose(9, i)) for i in range(600)]
    rows = shard_documents(make(texts), 10).collect()
    check(rows, 10)
    held = Counter(r.shard for r in rows if r.doc_id % 3 == 0)
    assert sum(held.values()) == 200 and sum(n for _, n in held.most_common(6)) >= 180      # four shards of 60 at least hold them; a hash gives 120


def test_empty_table(make):
    out = shard_documents(make([(1, "x")]).limit(0), 4)
    assert out.count() == 0 and "slot" in out.columns
