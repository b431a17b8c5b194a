"""The prefix trie against a trie of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from surveyspark.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, d1 bigint, shard string, depth int"


def rows(n=60, seed=4, longest=9):
    """Conversations that share first turns; gaps, NULLs, repeated rows, one long one, one without an id."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(100), n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", None, ""]) if t else "user"
            text = rng.choice(["a", "bé", None, ""]) if t else rng.choice(["hello", "hello", "hi"])
            out.append((c, None if t == 0 else 3 * t, role, text))
    out += [(200, t, "user", f"t{t % 3}") for t in range(40)] + [(201, t, "user", f"t{t % 3}") for t in range(37)]
    out += [(300, t, "user", "same") for t in range(12)] + [(300, 3, "user", "same")] * 3
    out += [(None, 1, "user", "lost"), (-7, 1, "user", "hello"), (-5, 1, "user", "hi"), (-5, 2, "x", "y")]
    out += [(407, 0, "u", "x" * 20_000), (404, 1, "user", "one"), (406, 1, "user", "one")]
    rng.shuffle(out)
    return out


def expected(table):
    own = {}
    for c, turn, role, text in table:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    inside = {k: [m for m in nodes if m[:len(k)] == k] for k in nodes}
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(k))))
        leaves = sum(not any(len(x) == len(m) + 1 for x in inside[m]) for m in inside[k])
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in inside[k] if m)
        out.add((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(x) == len(k) + 1 for x in inside[k]),
                 leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    got = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def frame(spark, table):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in table], SCHEMA).repartition(3)


@pytest.mark.parametrize("shard_rows, segment", [(16384, 4096), (40, 3), (15, 1)])
def test_trie(spark, shard_rows, segment):
    table = rows()
    turns, lengths = pt.rebuilt_turns(frame(spark, table))
    assert found(pt.trie(turns, lengths, shard_rows=shard_rows, segment=segment)) == expected(table)


def test_hot_first_turn(spark):
    table = [(c, t, "user", "hello" if t == 0 else f"{c % 7}-{t}") for c in range(0, 400, 5) for t in range(3)]
    turns, lengths = pt.rebuilt_turns(frame(spark, table))
    assert found(pt.trie(turns, lengths, shard_rows=30)) == expected(table)


def test_no_conversations(spark):
    assert found(pt.trie(*pt.rebuilt_turns(frame(spark, [])))) == set()
    assert found(pt.trie(*pt.rebuilt_turns(frame(spark, [(None, 1, "a", "b")])))) == set()


def test_only_turnless(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    table = [(c, 1, "user", "a"), (c, 2, "user", "b")]
    got = found(pt.trie(*pt.rebuilt_turns(frame(spark, table))))
    assert got == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())} == expected(table)


def test_slots():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1 << 62, 1 << 62, (2, 5000))
    a[:2500] = a[2500:]  # same first halves
    slots = pt.Slots(a, b)
    assert sorted(slots.of) == list(range(5000))
    assert (slots.find(a, b) == slots.of).all() and (slots.find(a, b + 1) == -1).all()
    with pytest.raises(ValueError):
        pt.Slots(np.array([1, 1]), np.array([2, 2]))
