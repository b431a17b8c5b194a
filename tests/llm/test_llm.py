"""The text operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables."""

import math
import pathlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from surveyspark.llm import (
    ann, decontaminate, licenses, lm_score, mixing, ngram_join, pii, quality, suffix_dedup, url_filter)
from surveyspark.llm.components import connected_components
from surveyspark.runtime import shared_folder

DOCS = "doc_id bigint, text string, source string, node bigint, size int"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(6000))
SHARED = "the quick brown fox jumps over the lazy dog and then runs away from the very angry bear today"


def rows():
    base = " ".join(f"tok{i}" for i in range(200))
    near = base.replace("tok50 ", "changed ")
    return [(1, base, "a", 9, 1), (2, base, "a", 9, 1), (3, near, "b", 9, 1), (4, None, "b", 9, 1), (5, "", None, 9, 1),
            (6, "one two", "c", 9, 1), (7, "One TWO", "c", None, None), (8, SHARED + " alpha beta", "a", 9, 1),
            (9, "gamma " + SHARED, "a", 9, 1), (10, LONG, "z", 9, 1), (11, LONG + " tail", "z", 9, 1),
            (2, base, "a", 9, 1), (None, base + " more", "a", 9, 1), (12, "é" * 60 + " ü", "d", 9, 1), (13, "a" * 300, "d", 9, 1),
            (14, "a" * 120, "d", 9, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), (None, 1)], "a bigint, b bigint")
    assert dict(connected_components(edges).collect()) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}


def test_ngram_join(docs):
    sets = []
    for _, text, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    ids = [r[0] for r in rows()]
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, x in enumerate(sets):
        mine = [ids[j] for j in range(len(ids)) if group[j] == group[i] and ids[j] is not None]
        want.append((ids[i], len(x), min(mine) if x and mine else ids[i]))
    got = [tuple(r) for r in ngram_join.component_ids(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect()) == sorted(
        map(str, {w[2] for w in want if w[1]} | {4, 5}))
    assert ngram_join.component_ids(docs.limit(0)).count() == 0


def test_ngram_join_of_one_text_changed_in_many_ways(spark):
    """Copies with one to five changes, many of them alike: some link with the base, some with each other only."""
    rng = np.random.default_rng(8)
    base = [f"tok{i}" for i in range(70)]
    texts = []
    for _ in range(220):
        w = list(base)
        for _ in range(rng.integers(1, 6)):
            at = int(rng.integers(0, 8)) * 8
            w[at:at + int(rng.integers(0, 3))] = ["new"] * int(rng.integers(0, 3))
        texts.append(" ".join(w))
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                low_id, high_id = sorted((group[i], group[j]))
                group = [low_id if g == high_id else g for g in group]
    assert 3 < len(set(group)) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.component_ids(docs).collect()} == dict(enumerate(group))


def test_suffix_dedup(docs):
    data = sorted((((1 << 63) if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows())
    want = []
    for i, raw in data:
        seen = {b[j:j + 50] for k, b in data if k < i for j in range(len(b) - 49)}
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 49):
            if raw[j:j + 50] in seen:
                gone[j:j + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((None if i == 1 << 63 else i, len(raw), int(gone.sum()), runs, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.deduplicated(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_suffix_dedup_buckets_are_even(spark):
    """Smallest hashes of windows were dealt by their own size: the first bucket got most cover positions, its task their memory."""
    rng = np.random.default_rng(6)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [text(80) for _ in range(400)]
    docs = spark.createDataFrame(
        [(i, "".join(text(30) + x for x in shared)) for i in range(3)], "doc_id bigint, text string").repartition(2)
    rows = suffix_dedup.rows_of(docs)
    buckets = suffix_dedup.tx.n_buckets(docs)
    told = suffix_dedup.tickets(rows, 50, 20).groupBy("row_id").agg(F.collect_list("ticket").alias("tickets"))
    packed = suffix_dedup.contexts(suffix_dedup.squeezed(rows).join(told, "row_id")
                                   .select("row_id", "row_hash", "_bytes", "tickets"), 50, 20)
    for found, column, width in ((suffix_dedup.covers(rows, 50, 20), "row_id", 8), (packed, "bytes", 80)):
        sizes = [r.n // width for r in found.filter(F.length(column) > 0).groupBy("bucket")
                 .agg(F.sum(F.length(column)).alias("n")).collect()]
        assert len(sizes) == buckets == 12 and sum(sizes) > 1000 and max(sizes) < 1.5 * sum(sizes) / buckets, sizes


def test_blobs_keep_entries_in_order_by_bucket():
    tx = suffix_dedup.tx
    blobs = tx.Blobs(4, ["wide", "small"], limit=6)
    assert blobs.take() is None
    wide = np.arange(21, dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, :3].reshape(7, 9)
    bucket = np.array([3, 0, 3, 1, 0, 3, 1])
    for part in (slice(0, 3), slice(3, 3), slice(3, 7)):
        assert not blobs.full()
        blobs.add(bucket[part], wide[part], np.arange(7, dtype=np.uint8)[part])
    assert blobs.full()
    batch = blobs.take()
    batch.validate(full=True)
    assert not blobs.full() and blobs.take() is None
    want = [(b, wide[bucket == b].tobytes(), bytes(np.flatnonzero(bucket == b).astype(np.uint8))) for b in (0, 1, 3)]
    assert list(zip(*(c.to_pylist() for c in batch.columns))) == want and batch.schema.names == ["bucket", "wide", "small"]
    again = pa.Table.from_batches([batch])
    assert tx.unpack(again, "small", np.uint8).tolist() == [1, 4, 3, 6, 0, 2, 5]


def test_blobs_in_planes():
    """Row numbers of small blobs hardly compressed, so that shuffled bytes grew with the number of buckets."""
    tx = suffix_dedup.tx
    value = np.array([5, -1, 1 << 62, 0, 5, -(1 << 63), 300])
    tables = []
    for part in (slice(0, 4), slice(4, 7)):
        blobs = tx.Blobs(2, ["x"], planes=["x"])
        blobs.add(np.array([1, 0, 1, 1, 0, 0, 1])[part], value[part])
        tables.append(pa.Table.from_batches([blobs.take()]))
    assert tables[0]["x"][1].as_py() == np.array([5, 1 << 62, 0]).view(np.uint8).reshape(3, 8).T.tobytes()
    empty = pa.table({"bucket": pa.array([0], pa.int32()), "x": pa.nulls(1, pa.binary())})
    both = pa.concat_tables([tables[0], empty, tables[1]])
    want = [-1, 5, 1 << 62, 0, 5, -(1 << 63), 300]
    assert tx.unpack_planes(both, "x", np.int64).tolist() == want
    assert tx.unpack_planes(both.combine_chunks().slice(1), "x", np.int64).tolist() == want[1:]
    assert tx.unpack_planes(empty, "x", np.int64).tolist() == tx.unpack_planes(both.slice(0, 0), "x", np.int64).tolist() == []
    ids = np.sort(np.random.default_rng(3).integers(0, 3_000_000, 20_000))
    packed = {p: tx.Blobs(60, ["x"], planes=p) for p in ((), ("x",))}
    for blobs in packed.values():
        blobs.add(np.arange(20_000) % 60, ids)
    plain, planes = (sum(len(pa.compress(x, "lz4", asbytes=True)) for x in b.take()["x"].to_pylist()) for b in packed.values())
    assert planes < 0.7 * plain


def test_decontamination(spark, docs):
    items = [(1, SHARED), (2, "one two"), (3, None), (4, ""), (5, "not there at all in any text"), (None, "é" * 60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    windows = [(i, w[j:j + 10]) for i, t in items for w in [words(t)] if w for j in range(max(1, len(w) - 9))]
    want = []
    for i, text, *_ in rows():
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j:j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), sorted(found)))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.without_contaminated(docs, bench).count() == sum(w[2] == 0 for w in want)


def test_licenses(spark):
    texts = [(1, "x All Rights\nreserved. all rights all rights reserved"), (2, None), (3, ""), (4, "general public; license"),
             (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
             (6, "y " * 500 + "CC BY"), (6, "y " * 500 + "CC BY")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, ["reserved"])
    assert got[2].n_words == 0 and got[2].first_word is None and got[3].score == 0
    assert got[4].base_labels == ["gpl"] and got[5].labels == ["mit"] and got[5].n_base == 0
    assert got[6].first_word == 500 and got[6].score == 1


def test_licenses_side_by_side(spark):
    """Every template that reaches the threshold names its block, unless a closer one has all its words there."""
    bsd = "redistribution and use in source and binary forms with or without modification are permitted"
    gpl = "this work is licensed under the gnu general public license version 3"
    texts = [(1, f"{bsd} licensed under the apache license version 2"), (2, gpl), (3, gpl.replace("general", "lesser general")),
             (4, f"{gpl} or {bsd[:-10]}"), (5, "licensed under cc by 4 0"), (6, bsd)]
    got = {r.doc_id: (r["labels"], r.score) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: (["apache-2.0", "bsd"], 1), 2: (["gpl", "gpl-3.0"], 1), 3: (["gpl", "gpl-3.0", "lgpl-3.0"], 1),
                   4: (["bsd", "gpl", "gpl-3.0"], 1), 5: (["cc-by", "cc-by-4.0"], 1), 6: (["bsd"], 1)}


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    names = sorted((x for x in by if x is not None)) + [None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    size, capped = {x: sum(r["size"] for r in by[x]) for x in names}, set()
    while True:
        left, open_ = total - sum(3 * size[x] for x in capped), sum(weight[x] for x in names if x not in capped)
        target = {x: 3 * size[x] if x in capped else left * weight[x] / open_ for x in names}
        more = {x for x in names if target[x] > 3 * size[x]} - capped
        if not more:
            break
        capped |= more
    for x in names:
        assert math.isclose(by[x][0].target, target[x], rel_tol=1e-12, abs_tol=1e-9)
        assert abs(sum(r.taken for r in by[x]) - target[x]) <= 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in got) and len(got) == len(rows())
    assert sorted(got, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://b.net", "https://b.net/x", "http://example.com/de/", "http://xexample.com/de/",
            "http://q.org/fr/?", "http://m.casino-win.example.com/en/1", None, "no scheme/net/", "a://b://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got == {0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("b.net", "", None, "allow"),
                   2: ("b.net", "/x", "net/", "block"), 3: ("example.com", "/de/", "example.com/de/", "block"),
                   4: ("xexample.com", "/de/", None, "allow"), 5: ("q.org", "/fr/", "org/fr/", "allow"),
                   6: ("m.casino-win.example.com", "/en/1", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
                   9: ("b:", "//net/", None, "allow")}


def test_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[5] = x[4] = x[3]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [math.nan] * 8), (903, [None] * 8)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = ann.search(vectors, vectors.filter("vec_id % 100 = 0 or vec_id = 4")).collect()
    for q in (0, 4, 100, 200):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order
    assert ann.search(vectors.filter("vec_id > 800"), vectors).count() == 0


def test_forest_counts_repeated_ids_once(spark):
    """Every row twice, one near vector ten times, one id with many different near vectors: still k ids for each query."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] * 2 + [(1, x[1].tolist())] * 8 + [(2, (x[0] + j / 1000).tolist()) for j in range(1, 30)]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id in (0, 7)")).collect()
    for q in (0, 7):
        best = {}
        for i, v in data:
            if i != q:
                best[i] = min(best.get(i, math.inf), math.dist(v, x[q]))
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == sorted(
            best, key=lambda i: (best[i], i))[:10]


def test_forest_recall_by_share_alone(spark):
    """Vectors without near structure."""
    x = np.random.default_rng(6).normal(size=(8000, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.search(vectors, vectors.filter("vec_id % 200 = 0")).collect()}
    want = set()
    for q in range(0, 8000, 200):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want |= {(q, int(i)) for i in np.lexsort((np.arange(8000), d)) if i != q and d[i] <= np.partition(d, 10)[10]}
    assert len(want) == 400 and len(got & want) >= 0.9 * len(want)


def test_personal_data(spark):
    texts = [(1, "mail a.b@x.org, c@d and 1.2.3.4 but 999.1.1.1"), (2, None), (3, ""), (4, "4111 1111 1111 1111 +1 (415) 555-0100"),
             (5, "é é@é z@y.z.w 4111 1111 1111 1112"), (6, "9" * 5000 + "@" * 50)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base]
           for r in pii.personal_data(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: [(0, 5, 14), (1, 24, 31)], 2: [], 3: [], 4: [(2, 0, 19), (3, 20, 37)], 5: [(0, 6, 13)], 6: []}
    out = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert out[1].startswith("mail [EMAIL], c@d and [IP]") and out[2] is None and out[4] == "[CARD] [PHONE]"


def test_personal_data_adds_what_labelers_agree_on(spark):
    """A local phone and a spelled-out address are added; version numbers, failed card checks and hashes are not."""
    texts = [f"word {i} write to a{i}.b@mail{i}.example.com or call +1 ({200 + i}) 555-{1000 + i} today, host 10.0.{i}.7 there" for i in range(60)]
    texts += [f"number 4111 1111 1111 {1000 + i} of nothing" for i in range(40)] + [f"table 12{i}.3.400.500 and 999.{i}.1.300" for i in range(40)]
    extra = ["please call 212 555 0147 soon", "please write to jane(at)site(dot)org soon", "see version 2031 4410 2210 here", "mail me jim [at] corp.co.uk",
             "in chapter 12.345.6789 of it"]
    docs = spark.createDataFrame(list(enumerate(extra + texts)), "doc_id bigint, text string").repartition(3)
    added = {r.doc_id: [extra[r.doc_id][s.start:s.end] for s in r.spans if not s.base] for r in pii.personal_data(docs).collect() if r.doc_id < 5}
    assert added == {0: ["212 555 0147"], 1: ["jane(at)site(dot)org"], 2: [], 3: ["jim [at] corp.co.uk"], 4: []}
    more = [s for r in pii.personal_data(docs).collect() if r.doc_id >= 5 for s in r.spans if not s.base]
    assert more == []


def test_personal_data_edges(spark):
    rows = [(None, "0" * 5000 + "1.2.3.4", 1, "w"), (2, None, 2, None), (2, "", 3, "x"), (2, "a@b.c", 4, "y"), (2, "a@b.c", 4, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int, walk string")
    out = sorted(map(tuple, pii.masked(docs).collect()), key=str)
    assert out == sorted([(None, "[IP]", 1, "w"), (2, None, 2, None), (2, "", 3, "x"), (2, "[EMAIL]", 4, "y"), (2, "[EMAIL]", 4, "y")], key=str)
    assert pii.masked(docs.limit(0)).collect() == [] and pii.personal_data(docs.limit(0)).collect() == []


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like ones used inside, odd names, repeated rows and empty tables."""
    names = ["row", "score", "_bytes", "spans", "walk", "_id", "_source", "_hash", "mix_size", "_row_id", "_row_hash", "row_id", "text_hash", "a b.c"]
    rows = [(i, t, s, *[f"{n}{i}" for n in names]) for i, t, s in (
        (1, SHARED + " one", "a"), (2, None, None), (3, "", "b"), (4, "calm words about x@y.org and more of them", "b"), (None, "no id here", "a"),
        (5, "calm words about nothing at all", "b"), (5, "calm words about nothing at all", "b"))]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([("q1", SHARED)], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1), (5, 1)], "doc_id bigint, quality int")
    stages = {"quality": lambda d: quality.accepted(d, labels, 0.0), "near": lambda d: ngram_join.keep_one(d, 5, 80),
              "clean": lambda d: decontaminate.without_contaminated(d, benchmark), "masked": pii.masked, "mixed": mixing.mixed}
    kept = {"quality": 7, "near": 6, "clean": 6, "masked": 7, "mixed": 4}  # the mix takes less than all of b
    for name, stage in stages.items():
        out = stage(docs)
        got = out.collect()
        lost = {"mix_size"} if name == "mixed" else set()
        assert set(docs.columns) - lost <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
        assert len(got) == kept[name], name
        for r in got:
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n not in lost), name
        assert stage(docs.limit(0)).collect() == [], name


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id bigint, quality int")
    assert quality.sample(docs, labels, 10).count() <= 3


def test_quality(spark):
    good = [(i, f"Some calm words about number {i}. They go on and end well.") for i in range(0, 200, 2)]
    bad = [(i, "BUY!! NOW!! " * 9) for i in range(1, 200, 2)]
    docs = spark.createDataFrame(good + bad + [(500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    assert all(got[i] > 0.8 for i, _ in good) and all(got[i] < 0.2 for i, _ in bad) and 0 <= got[500] == got[501] <= 1
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}


def test_lm_score(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "x y x y"), (3, None), (2, "x y x y"), (4, "a")], "doc_id bigint, text string")
    got = lm_score.scores(docs, spark.createDataFrame([(1,), (None,)], "doc_id bigint"), common=2).collect()
    score = {r.doc_id: (r.n_tokens, r.score) for r in got}
    assert len(got) == 5 and score[3] == (0, 0.0) and score[1][0] == 5 and score[2][0] == 4
    assert score[1][1] > 0 > score[2][1]
    assert lm_score.scores(docs.limit(0), docs.select("doc_id")).count() == 0


def test_lm_score_models_every_word(spark):
    """More distinct words than a fixed vocabulary would hold; common entries sent to all tasks, or none, change no score."""
    data = [(i, " ".join(f"r{i}x{j} r{i}x{j // 2}" for j in range(110))) for i in range(500)] + [(-1, "a b a b r1x5"), (-2, "a b"), (None, "a")]
    target = set(range(0, 500, 3)) | {-1}
    count = [{}, {}]
    for i, text in data:
        w = text.split()
        for kind in range(1 + (i in target)):
            for x in [*w, *zip(w, w[1:])]:
                count[kind][x] = count[kind].get(x, 0) + 1
    size = sum(isinstance(x, str) for x in count[0])
    total = [sum(n for x, n in c.items() if isinstance(x, str)) for c in count]
    assert size > 50_000

    def loss(kind, a, b):
        c = count[kind]
        weight = lm_score.BIGRAM if c.get(a) else 0
        return -math.log(weight * c.get((a, b), 0) / max(c.get(a, 0), 1) + (1 - weight) * (c.get(b, 0) + 1) / (total[kind] + size + 1))

    want = {i: sum(loss(0, a, b) - loss(1, a, b) for a, b in zip([None, *w], w)) / len(w) for i, text in data for w in [text.split()]}
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    flags = spark.createDataFrame([(i,) for i in target], "doc_id bigint")
    for common in (0, 20, lm_score.COMMON):
        got = {r.doc_id: r.score for r in lm_score.scores(docs, flags, common=common).collect()}
        assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-12) for i in want)


def test_lm_score_writes_no_table_of_pairs(spark):
    """Nearly all pairs are distinct, so tables of pairs would be several times the texts."""
    def written():
        return sum(f.stat().st_size for f in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 200)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    before = written()
    assert lm_score.scores(docs, docs.filter("doc_id % 3 = 0").select("doc_id"), common=20).count() == len(texts)
    assert written() - before < 2 * sum(map(len, texts))


def test_lm_score_sends_the_same_for_any_number_of_buckets():
    """A document was sent to, and had a partial sum from, every bucket that held one of its pairs."""
    rng = np.random.default_rng(4)
    known = lm_score.Known(pa.table({"word": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "t": np.zeros(0, np.int64)}))
    first, second, doc = (rng.integers(1, 60, 4000).astype(np.uint64) for _ in range(3))
    doc = np.sort(doc.astype(np.int64))
    value = {(a, b): rng.random() for a in range(60) for b in range(60)}
    want = np.zeros(60)
    np.add.at(want, doc, [value[int(a), int(b)] for a, b in zip(first, second)])
    for buckets in (1, 64):
        block = lm_score.Packed(known, lambda a, b: (a + b * np.uint64(7)).astype(np.int64) % buckets, buckets, 3)
        block.add(first, second, doc, pa.array(range(60)), np.zeros(60, np.int8), np.full(60, 10), np.zeros(60))
        sent = pa.Table.from_batches(block.take())
        own = pa.compute.is_valid(sent.column("ids"))
        pairs = sent.filter(pa.compute.invert(own))
        a, b, n, _, sizes = lm_score.Packed.unpack(pairs, known)
        assert len(pairs) == buckets and len(a) == len(set(zip(a, b))) == len(set(zip(first, second))) and n.sum() == len(first)
        assert own.to_pylist().count(True) == 1, "documents stand in one row"
        values = np.split([value[int(x), int(y)] for x, y in zip(a, b)], np.cumsum(sizes)[:-1])
        back = pairs.append_column("value", pa.array([lm_score._squeezed(x) for x in values], pa.binary()))
        back = pa.concat_tables([sent.filter(own).append_column("value", pa.nulls(1, pa.binary())), back])
        assert np.allclose(lm_score.valued(back).column("score").to_numpy(), want / 10)


def test_lm_score_shuffles_squeezed_texts_for_any_number_of_labels(spark):
    """Whole texts were shuffled as they are once labels outgrew a broadcast: disk grew by a step."""
    seen = []

    def squeezed(rows):
        seen.append(rows.columns)
        return suffix_dedup.squeezed(rows)

    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(20)], "doc_id bigint, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_score, "squeezed", squeezed)
        got = lm_score.scores(docs, docs.select("doc_id").limit(3)).collect()
    assert seen == [["doc_id", "key", "_bytes"]] and sorted(r.doc_id for r in got) == list(range(20))


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    """Planted copies whose 5-word similarity is between 0.80 and 0.85, and one below 0.80."""
    import corpus_pipeline

    base = [f"tok{i}" for i in range(200)]
    changed = [f"new{i}" if i in (30, 80, 130, 180) else x for i, x in enumerate(base)]
    other = [f"else{i}" for i in range(200)]
    far = [f"new{i}" if i in (30, 70, 110, 150, 190) else x for i, x in enumerate(other)]
    texts = [base, base + [f"more{i}" for i in range(40)], changed, other, far]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 3, 4]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = str(tmp_path / str(number))
        stage(spark, docs, base).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:len(names)] == names
        if name == "quality":
            scored = quality.scores(before, spark.read.parquet(f"{base}/labels.parquet")).filter("score >= 0.3")
            assert docs.count() == scored.count()
        if name == "near duplicates":
            assert docs.count() == ngram_join.component_ids(before).filter("doc_id = component_id").count()
        if name == "personal data":
            assert docs.count() == before.count()
    assert docs.agg(F.min("mix_taken")).first()[0] > 0
