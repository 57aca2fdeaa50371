"""Hamerly clustering, Simple-8b files and fill-in-middle: brute force, exact round trips and edge cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("skygraph.llm")

from skygraph.llm import fim, hamerly, simple8b

EDGE = [(1, None), (2, ""), (3, "   \n\n "), (4, "x"), (5, "tie tie\ntie"), (6, "tie tie\ntie"), (None, "no key\nat all"), (7, "long line\n" * 40_000), (7, "the same key\ntwice"), (8, "ünï çødé 中文 \x00 end\n"), (9, "<P> a\nb"), (10, "a <\n S> < M>"), (11, "\n" * 300_000), (12, "é" * 300_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 0, 0.5, "x") for i, t in EDGE], "doc_id bigint, text string, n bigint, start double, form string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# 11 ----------------------------------------------------------------------------------------------
def lloyd(rows, k, rounds, scale):
    """Brute force in whole numbers."""
    q = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows]
    first = sorted(q, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", hamerly.packed(np.array([r[1]], dtype=object))[0]))
    centroids = [v for _, v in first[:k]]
    for step in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in q]
        own = [x.index(min(x)) for x in d]
        if step < rounds:
            groups = [[v for (_, v), o in zip(q, own) if o == c] for c in range(len(centroids))]
            centroids = [[sum(x) // len(g) for x in zip(*g)] if g else centroids[c] for c, g in enumerate(groups)]
    return sorted(((i, o, min(x), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), o, x in zip(q, own, d)), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "one hot group", "few", "large"])
def test_hamerly_equals_brute_force(spark, kind):
    r = np.random.default_rng(len(kind))
    n = 9 if kind == "few" else 600
    v = r.normal(size=(n, 4))
    if kind == "ties":
        v = r.integers(-2, 3, size=(n, 4)) / 4
    if kind == "one hot group":
        v[: n // 2] = v[0]
    if kind == "large":
        v *= 1e6
        v[5] = [1e12, -1e12, 3e13, 1.0]
    rows = [(i % 580 if kind != "ties" else i, list(map(float, x))) for i, x in enumerate(v)]
    if kind == "few":
        rows[3] = (None, rows[3][1])
    df = spark.createDataFrame([(i, x, "a", 3) for i, x in rows], "vec_id bigint, embedding array<double>, cluster string, q int").repartition(5)
    got = hamerly.cluster(df, k=12, rounds=4, width=4).collect()
    want = lloyd(rows, 12, 4, 64)
    as_long = lambda d: d if d < 1 << 63 else None
    assert sorted(((x.vec_id, x.cluster, x.distance, x.centroid_sha256) for x in got), key=str) == sorted(((i, c, as_long(d), h) for i, c, d, h in want), key=str)
    if kind != "large":
        by = {}
        for x in got:
            by[x.cluster] = by.get(x.cluster, 0) + x.distance
        assert all(x.cluster_inertia == by[x.cluster] and x.inertia == sum(by.values()) for x in got)
    if kind == "spread":
        # bounds spare most scans
        assert sum(x.scans for x in got) < 0.8 * 5 * len(got)


def test_hamerly_leaves_out_what_is_no_vector(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [2.0, 2.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert {x.vec_id for x in hamerly.cluster(df, width=2).collect()} == {1, 8}
    for empty in (df.limit(0), df.where("vec_id = 2")):
        got = hamerly.cluster(empty, width=2)
        assert got.count() == 0 and got.columns == hamerly.cluster(df, width=2).columns


def test_vectors_survive_packing():
    for x in ([[1, -127], [128, 3], [40_000, 0], [2**40, -1]], [[0, 0]], [[44, 44]]):
        v = np.array(x, dtype=np.int64)
        assert hamerly.unpacked(hamerly.packed(v), 2).tolist() == x
    big = np.array([[10**30, -5], [7, 8]], dtype=object)
    assert hamerly.unpacked(hamerly.packed(big), 2).tolist() == big.tolist()


# 12 ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["ids", "zeros", "wide", "mixed", "one", "none", "sixty"])
def test_simple8b_round_trip(kind):
    r = np.random.default_rng(3)
    values = {"ids": r.integers(0, 49_408, 20_000), "zeros": np.zeros(1000), "wide": r.integers(2**60, 2**63, 300), "one": np.array([5]), "none": np.zeros(0), "sixty": np.full(50, 2**60 - 1)}
    values["mixed"] = np.concatenate([r.permutation(np.concatenate([r.integers(0, 2 ** int(b), 40) for b in r.integers(1, 63, 60)])).astype(np.uint64), np.zeros(700, dtype=np.uint64), r.integers(0, 2, 90).astype(np.uint64), np.array([2**64 - 1, 2**60, 0], dtype=np.uint64)]).astype(np.uint64)
    v = values[kind].astype(np.uint64)
    words = simple8b.encode(v)
    assert (simple8b.decode(words, len(v)) == v).all() and len(simple8b.decode(words, len(v))) == len(v)
    if kind == "ids":
        assert len(words) * 8 < len(v) * 3  # under 3 bytes an id of up to 16 bits
    if kind == "zeros":
        assert len(words) == 5


def test_token_files_hold_every_document_in_order(spark, edge, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(5)
    rows = EDGE + [(r.randint(13, 400), " ".join(r.choices(["one", "Two,", "three's", "中", "<|endoftext|>", "\n"], k=r.randint(0, 300)))) for _ in range(200)]
    df = spark.createDataFrame([(i, x, 0, "clash") for i, x in rows], "doc_id bigint, text string, start int, ids string").repartition(7)
    path = f"file://{tmp_path}/ids"
    simple8b.write(df, path)
    got = simple8b.read(spark, path).collect()
    want = sorted((i is not None, i or 0, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for i, x in rows)
    assert sorted((x.doc_id is not None, x.doc_id or 0, bytes(x.ids)) for x in got) == want
    # starts are gapless in the order of keys, nulls first
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += len(x.ids) // 4
    keys = [(x.doc_id is not None, x.doc_id or 0) for x in sorted(got, key=lambda x: x.start)]
    assert keys == sorted(keys)
    # a file that no index names, as an aborted task leaves it, is no part of the table; writing again replaces what is read
    (tmp_path / "ids" / "part-000000-stray.s8b").write_bytes(b"not a file of ids")
    assert simple8b.read(spark, path).count() == len(rows)
    simple8b.write(df.limit(3), path)
    assert simple8b.read(spark, path).count() == 3
    assert simple8b.round_trip(none).count() == 0 and simple8b.round_trip(edge).count() == len(EDGE)


def test_token_files_of_several_blocks(spark, tmp_path):
    """Documents over the borders of blocks; a failed task leaves no index."""
    ids = np.arange(3 * simple8b.BLOCK + 77, dtype="<u4") * 80_000
    rows = [(1, bytearray(ids[:5].tobytes())), (2, bytearray(ids.tobytes())), (3, bytearray()), (4, None), (5, bytearray(ids[-3:].tobytes()))]
    df = spark.createDataFrame(rows, "doc_id bigint, ids binary").coalesce(1)
    spark.dataSource.register(simple8b.TokenFiles)
    df.write.format("simple8b").mode("append").save(f"{tmp_path}/blocks")
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in simple8b.read(spark, f"{tmp_path}/blocks").collect()}
    assert got == {1: (0, ids[:5].tobytes()), 2: (5, ids.tobytes()), 3: (5 + len(ids), b""), 4: (5 + len(ids), b""), 5: (5 + len(ids), ids[-3:].tobytes())}
    bad = df.withColumn("ids", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("simple8b").mode("append").save(f"{tmp_path}/failed")
    assert not os.path.exists(f"{tmp_path}/failed/_index.json")


# 13 ----------------------------------------------------------------------------------------------
def by_lines(key, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    told = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < suffix_first else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate", (100, 40))
def test_fim_equals_a_split_into_lines(spark, edge, none, rate):
    r = random.Random(rate)
    letters = ["a", "é", "中", "😀", "<", ">", "P", "S", "M", "<P", "\n", "\n", "\r", " ", "<<"]
    rows = EDGE + [(100 + i, "".join(r.choices(letters + ["<S>"] * (i % 7 == 0), k=r.choice([0, 1, 3, 30, 255, 256, 257, 900])))) for i in range(500)]
    got = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rate=rate)
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *by_lines(i, x, rate)) for i, x in rows]
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got), key=str) == sorted(want, key=str)
    assert sorted(x.back for x in got) == sorted(x or "" for _, x in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fim.transform(none).count() == 0 and fim.transform(edge).count() == len(EDGE)


def test_scan_counts_over_lanes(monkeypatch):
    """Lanes of a few bytes, so that characters and sentinels lie across their borders."""
    monkeypatch.setattr(fim, "LANE", 3)
    monkeypatch.setattr(fim, "LANES", 4)
    r = random.Random(1)
    data = ["".join(r.choices(["a", "é", "中", "😀", "<", ">", "P", "S", "M", "<M>", "\n"], k=r.randint(0, 25))) for _ in range(300)] + ["", "", "\n"]
    scan = fim.Scan([x.encode() for x in data])
    for i, x in enumerate(data):
        units = re.findall(r"[^\n]*\n|[^\n]+", x)
        assert scan.totals(i) == (len(units), len(re.findall("<[PSM]>", x)))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert scan.cuts(i, [k], len(units)) == [(len(before.encode()), len(before))]


def test_new_queries_have_the_columns_of_their_contract(spark):
    from skygraph.llm import queries

    small = "/root/testdata/sf0.001"
    contract = {"op11_hamerly": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string", "op12_simple8b": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", "op13_fim": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"}
    for name, columns in contract.items():
        got = queries.QUERIES[name](spark, small)
        assert [f"{c} {t}" for c, t in got.dtypes] == columns.split(", ")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in sorted(queries.op12_simple8b(spark, small).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(docs[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
