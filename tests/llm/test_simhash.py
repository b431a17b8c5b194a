"""SimHash links and classes against comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from surveyspark.llm import simhash as sh


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    codes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(c >> b & 1 for c in codes) * 2 > len(codes))


def groups(prints, distance=3):
    """Each print with the smallest print it reaches."""
    group = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= distance and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {p: new if g == old else g for p, g in group.items()}
    return {frozenset(p for p in prints if group[p] == g) for g in set(group.values())}


def found(spark, prints, **options):
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print bigint").repartition(3)
    group = {p: p for p in prints}
    for a, b in sh.links(rows, **options).collect():
        a, b = (int(x) & (1 << 64) - 1 for x in (a, b))
        assert (a ^ b).bit_count() <= options.get("distance", 3)
        if group[a] != group[b]:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {p: new if g == old else g for p, g in group.items()}
    return {frozenset(p for p in prints if group[p] == g) for g in set(group.values())}


@pytest.mark.parametrize("group, distance", [(4096, 3), (8, 3), (8, 2), (3, 1), (4096, 0)])
def test_links(spark, group, distance):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1, 1 << 63}
    for centre in [rng.getrandbits(64) for _ in range(6)]:
        for _ in range(18):
            p = centre
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                p ^= 1 << bit
            prints.add(p)
    # All of one half alike, and alike but for one bit.
    half = rng.getrandbits(32)
    prints |= {half << 32 | rng.getrandbits(32) & 0xFF0F000F for _ in range(20)}
    prints |= {(half ^ 1 << 5) << 32 | rng.getrandbits(32) & 0x0FF0000F for _ in range(20)}
    prints |= {rng.getrandbits(32) << 32 & 0xF00F0F << 32 | half for _ in range(20)}
    assert found(spark, prints, group=group, distance=distance) == groups(prints, distance)


def test_every_distance_is_met(spark):
    rng = random.Random(8)
    # Pairs far apart from each other, in one table.
    prints, pairs = set(), []
    for bits in [(0, 1, 2), (0, 1, 40), (0, 40, 41), (40, 41, 63), (31, 32, 33), (5,), (63, 62), (), (0, 1, 2, 3)]:
        one = other = rng.getrandbits(64)
        for b in bits:
            other ^= 1 << b
        pairs.append((one, other))
        prints |= {one, other}
    classes = found(spark, prints)
    together = [any({a, b} <= c for c in classes) for a, b in pairs]
    assert together == [True] * 8 + [False]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(700))
    whole = sh.fingerprint(text.encode())
    monkeypatch.setattr(sh, "BLOCK_WORDS", 64)
    assert sh.fingerprint(text.encode()) == whole == plain_print(text)


def test_near_duplicates(spark):
    base = " ".join(f"tok{i}" for i in range(300))
    texts = [(3, base), (1, base.replace("tok7 ", "tik7 ")), (4, base.upper()), (4, base), (None, base), (9, None), (8, ""), (7, "\t\n "), (10, "one"),
             (11, "ONE"), (12, "one two"), (13, "Ünï cödé tëxt"), (14, "a b c d e f g h"), (None, "alone here it is"), (15, base[:900])]
    docs = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in texts], "doc_id bigint, text string, print string, node int, component int")
    got = sh.near_duplicates(docs.repartition(3)).collect()
    prints = [plain_print(t) for _, t in texts]
    classes = groups(set(prints))
    want = []
    for (i, _), p in zip(texts, prints):
        members = next(c for c in classes if p in c)
        ids = [j for (j, _), q in zip(texts, prints) if q in members and j is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sh.near_duplicates(docs.filter(F.lit(False))).collect() == []
