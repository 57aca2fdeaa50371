"""The ten operators and the pipeline on small fixtures: brute force, round trips, held-out accuracy and edge cases."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

pytest.importorskip("skygraph.llm")

from skygraph.llm import decontamination, embedding_dedup, importance, language_id, licenses, line_dedup, minhash, packing, token_counts, toxicity
from skygraph.llm.common import WordIds, words_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = random.Random(4)


def prose(n, seed, alphabet="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "   \n\n "), (4, "x"), (5, "tie tie tie"), (6, "tie tie tie"), (None, "no key at all"), (7, prose(6000, 1)), (7, "the same key twice"), (8, "ünï çødé 中文 \x00 end")]


@pytest.fixture(scope="module")
def edge(spark):
    # further columns with clashing names
    rows = [(i, t, 0, 0.5, "x", "y") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n bigint, score double, words string, label string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# 1 -----------------------------------------------------------------------------------------------
def test_marginals_equal_enumeration():
    margin, t = np.array([[0.3], [-1.2], [2.0], [0.1]]), np.array([[0.2, -0.4], [0.5, 0.9]])
    total, one = 0.0, np.zeros(4)
    for path in itertools.product((0, 1), repeat=4):
        s = sum(m * y for m, y in zip(margin[:, 0], path)) + sum(t[a, b] for a, b in zip(path, path[1:]))
        # the chain begins from the clean state
        s += t[0, path[0]]
        total += np.exp(s)
        one += np.exp(s) * np.array(path)
    assert np.allclose(toxicity.marginals(margin, t)[:, 0], one / total, atol=1e-6)


def toxic_rows(n):
    out = []
    for i in range(n):
        words = prose(60, i).split()
        if bad := i % 4 == 0:
            for k in range(3):
                words.insert(10 * k + 5, "zzvile" + prose(1, i * 3 + k)[:3])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_finds_spans_and_holds_on_edges(spark, edge, none):
    rows = toxic_rows(240)
    field = toxicity.learn(table(spark, [r[:2] for r in rows[:160]]), labels(spark, [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)]))
    got = {r.doc_id: r for r in toxicity.score(table(spark, [r[:2] for r in rows]), field).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, _, y in rows[160:])
    i, text, _ = rows[200]
    assert got[i].spans and all(text[s.start : s.end].startswith("zzvile") for s in got[i].spans)
    found = toxicity.score(edge, field).collect()
    assert len(found) == len(EDGE) and all(0 <= r.score <= 1 for r in found) and [r.score for r in found if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert toxicity.score(none, toxicity.learn(none, labels(spark, []))).count() == 0


# 2 -----------------------------------------------------------------------------------------------
def test_toxicity_learn_passes_its_chain_bound_on(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda *a, **b: seen.update(b))
    toxicity.learn(table(spark, [(1, "a b"), (2, "c d")]), labels(spark, [(1, 1, 1), (2, 1, 0)]), most_chains=123)
    assert seen == {"most_chains": 123}


def test_language_held_out_accuracy_and_edges(spark, edge, none):
    abc = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    rows = [(i, prose(40, i, abc[x]), x) for i in range(300) for x in [sorted(abc)[i % 3]]]
    docs = spark.createDataFrame([*rows[:200], (900, None, "aa"), (901, "x", None)], "doc_id bigint, text string, lang string")
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.predict(table(spark, [r[:2] for r in rows[200:]]), model).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows[200:]]) > 0.95
    found = language_id.predict(edge, model).collect()
    assert len(found) == len(EDGE) and {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    assert language_id.predict(none, language_id.learn(none.selectExpr("*", "string(null) lang"))).count() == 0


def test_presence_kernel_equals_sets():
    a, b = "abc abd", "abd xyz"
    grams = lambda s: {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    x, known = language_id.presence([a, b])
    want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    assert known.all() and abs(float(x[0] @ x[1]) - want) < 0.08  # the separator counts as a space


# 3 -----------------------------------------------------------------------------------------------
def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 16))
    x = np.vstack([base[r.integers(0, 60, 500)] + r.normal(scale=0.05, size=(500, 16)), base[:1].repeat(40, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, x[0].tolist(), None), (1004, [None] * 16, 0), (1005, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {q.vec_id: q for q in embedding_dedup.near_duplicates(vectors).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & (np.arange(540)[:, None] % 2 == np.arange(540) % 2)
    np.fill_diagonal(close, False)
    assert [got[i].n_links for i in range(540)] == close.sum(axis=1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006)) and len(got) == 546
    parent = list(range(540))
    for _ in range(540):
        new = [min([parent[i], *(parent[j] for j in np.flatnonzero(close[i]))]) for i in range(540)]
        if new == parent:
            break
        parent = new
    assert [got[i].component_id for i in range(540)] == parent
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


# 4 -----------------------------------------------------------------------------------------------
def multiset(text):
    w = text.lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_signatures_estimate_weighted_jaccard():
    ids, a, b = WordIds(), [], []
    for s in range(60):
        words = prose(60, s).split()
        a.append(" ".join(words * 3))
        b.append(" ".join(words * 2 + prose(20, s + 500).split()))
    sig = lambda texts: minhash.signatures(*zip(*[minhash.shingles(t, ids)[:2] for t in texts]))
    got = (sig(a) == sig(b)).mean(axis=1)
    want = [jaccard(multiset(x), multiset(y)) for x, y in zip(a, b)]
    assert abs(got.mean() - np.mean(want)) < 0.02


def test_near_duplicates_equal_brute_force(spark, edge, none):
    rows, i = [], 0
    for s in range(25):
        words = prose(90, s).split()
        for c in range(4):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = "other"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i + k, rows[0][1]) for k in range(30)] + [(i + 40, ""), (i + 41, None)]
    # a passage that many share: some of these link, most don't, and none may be lost in its wide buckets
    rows += [(i + 50 + k, prose(80, 99) + " " + prose(4 + k % 30, 200 + k)) for k in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    sets = {k: multiset(t or "") for k, t in rows}
    root = {k: k for k in sets}
    for _ in range(6):
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    found = {r.doc_id: r for r in minhash.near_duplicates(edge).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7, 8] and found[6].component_id == 5 and found[1].kept and found[2].kept
    assert minhash.near_duplicates(none).count() == 0


# 5 -----------------------------------------------------------------------------------------------
def test_token_counts_equal_whole_texts(spark, edge, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(edge, part_chars=500).collect())
    want = Counter((i, len((t or "").encode()), n, n > 4096) for i, t in EDGE for n in [len(sp.encode(t or ""))])
    assert got == want and token_counts.count_tokens(none).count() == 0


# 6 -----------------------------------------------------------------------------------------------
def test_resampling_prefers_target_and_takes_exactly_k(spark, edge, none):
    rows = [(i, prose(50, i, "abcdef" if i % 2 else "uvwxyz")) for i in range(200)]
    told = labels(spark, [(i, i % 2, 0) for i in range(100)])
    got = importance.resample(table(spark, rows), told, share=0.3).collect()
    chosen = [r.doc_id for r in got if r.selected]
    assert len(chosen) == 60 and np.mean([i % 2 for i in chosen]) > 0.95
    kept = sorted((r.perturbed, -r.doc_id) for r in got)[-60:]
    assert sorted(-i for _, i in kept) == sorted(chosen)
    assert importance.resample(edge, labels(spark, [])).count() == len(EDGE)
    assert importance.resample(none, labels(spark, [])).count() == 0
    tied = spark.createDataFrame([(i, 1.0) for i in range(50)], "doc_id bigint, perturbed double")
    assert sorted(r.doc_id for r in importance.top_k(tied, 7).where("selected").collect()) == list(range(7))


# 7 -----------------------------------------------------------------------------------------------
def tiles(doc, item, k=4):
    """Greedy string tiling word by word."""
    k = min(k, len(item))
    used_d, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in used_d and q + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        if best[0] < max(1, k):
            return covered
        n, p, q = best
        used_d.update(range(p, p + n))
        used_i.update(range(q, q + n))
        covered += n


def test_decontamination_catches_reordered_passages(spark, edge, none):
    items = [(i, prose(30, 900 + i)) for i in range(5)] + [(9, "two words"), (10, None), (11, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    w = items[0][1].split()
    docs = [
        (1, prose(20, 1) + " " + items[0][1] + " " + prose(20, 2)),
        (2, " ".join(w[20:] + ["foo"] + w[:10] + ["bar"] + w[10:20])),
        (3, " ".join(w[:6]) + " " + prose(40, 3)),
        (4, prose(80, 4)),
        (5, "here two words, there"),
        (6, items[1][1].upper() + "!"),
    ]
    got = {(r.doc_id, r.item_id): r.covered for r in decontamination.coverage(table(spark, docs), bench).collect()}
    want = {(d, i): n for d, t in docs for i, x in items if x and (n := tiles(words_of(t), words_of(x)))}
    assert got == want
    assert {r.doc_id for r in decontamination.contaminated(table(spark, docs), bench).collect()} == {1, 2, 5, 6}
    assert decontamination.contaminated(edge, bench).count() == 0 and decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(table(spark, docs), bench.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------
def test_packing_round_trip(spark, edge, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, prose(rng.choice([3, 40, 200, 1500]), i)) for i in range(150)] + [(500 + i, x) for i, x in enumerate(["<|endoftext|> a", "Émile ünï", "中文 кот", "", None, "don't  stop\n\n\t!"])]
    got = packing.pack(table(spark, rows)).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    crc = lambda v: zlib.crc32(np.array(v, dtype="<u4").tobytes())
    by_doc, by_seq = {}, {}
    for r in got:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, total in [(sorted(p), len(ids[i])) for i, p in by_doc.items()]:
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) == total
    for pieces in map(sorted, by_seq.values()):
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(pieces[-1]) <= 2048
    assert set(by_doc) == set(ids)
    assert packing.pack(edge).where("start = 0").count() == len(EDGE) and packing.pack(none).count() == 0


def test_plan_uses_the_histogram_up():
    r = np.random.default_rng(2)
    h = np.zeros(257, dtype=np.int64)
    h[1:257] = r.integers(0, 400, 256)
    h[256] = 0
    plan = packing.plan(h, 256)
    used = np.zeros_like(h)
    for n, lengths in plan:
        assert sum(lengths) <= 256
        for a in lengths:
            used[a] += n
    assert (used == h).all()
    assert 1 - (h * np.arange(257)).sum() / (256 * sum(n for n, _ in plan)) < 0.01


# 9 -----------------------------------------------------------------------------------------------
def longest_cut(rows, min_words=10):
    """Brute force: {id: (text, longest run)}, from each line the longest match over all earlier places."""
    docs = {i: t.split("\n") for i, t in rows}
    places = [(i, p) for i in sorted(docs) for p in range(len(docs[i]))]
    gone, longest = {i: set() for i in docs}, dict.fromkeys(docs, 0)
    for at, (i, p) in enumerate(places):
        size = max([0, *(sum(1 for _ in itertools.takewhile(lambda x: x[0] == x[1], zip(docs[i][p:], docs[j][q:]))) for j, q in places[:at])])
        if sum(x.count(" ") + 1 if x else 0 for x in docs[i][p : p + size]) >= min_words:
            gone[i].update(range(p, p + size))
            longest[i] = max(longest[i], size)
    return {i: ("\n".join(x for k, x in enumerate(v) if k not in gone[i]), longest[i]) for i, v in docs.items()}


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [prose(r.randint(1, 6), 70 + i) for i in range(12)] + [""]
    passage = [prose(20, 300 + i) for i in range(7)]
    rows = [(i, "\n".join([*(r.choice(pool) for _ in range(r.randint(1, 9))), *(passage[a : a + r.randint(1, 7)] if (a := r.randint(0, 6)) % 2 else []), prose(4, 1000 + i)])) for i in range(24)]
    rows += [(100, rows[3][1]), (101, "\n".join(["same line again here"] * 9))]
    want = {i: v[0] for i, v in longest_cut(rows).items()}
    # with and without the lengths of whole runs
    for longest in (True, False):
        got = {x.doc_id: x.text for x in line_dedup.dedup_lines(table(spark, rows), longest_runs=longest).collect()}
        assert got == want


def test_line_dedup_takes_the_longest_of_all_earlier_places(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(4)) for x in "abc")
    rows = [(1, f"{a}\n{b}\nx"), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n{c}\ny")]
    assert longest_cut(rows)[3] == ("y", 3)
    r = random.Random(8)
    pool = [prose(r.randint(1, 4), 500 + i) for i in range(4)] + [""]
    rows += [(10 + i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 24)))) for i in range(30)]
    rows += [(90, rows[9][1] + "\n" + rows[12][1]), (91, "\n".join(["four words in line"] * 40)), (92, "\n".join(["four words in line", "and four more words"] * 12))]
    got = {x.doc_id: (x.text, x.longest_run) for x in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == longest_cut(rows)


def test_line_dedup_edges(spark, edge, none):
    got = line_dedup.dedup_lines(edge).collect()
    assert len(got) == len(EDGE) and got[0].asDict().keys() >= {"label", "score", "words", "removed"}
    assert {(r.doc_id, r.text) for r in got} == set(EDGE)
    assert line_dedup.dedup_lines(none).count() == 0
    twice = table(spark, [(1, prose(30, 1)), (1, prose(30, 1)), (2, prose(30, 1))])
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(twice).collect()) == [(1, prose(30, 1)), (1, prose(30, 1)), (2, "")]


# 10 ----------------------------------------------------------------------------------------------
def test_licenses_by_regex_and_templates(spark, edge, none):
    import re

    rows = [
        (1, "Released under the MIT License."),
        (2, "x UNDER the mit-license under the MIT license; Apache License, Version 2.0"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "licensed under the terms of the gnu general public license version 3"),
        (6, "licensed under the gnu lesser public license version 3"),
        (7, "Copyright (c) 2020 Some One. All rights reserved."),
        (8, "mitlicense underthe mit license"),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, text in rows:
        words = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want = sorted((label, p) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(words) and sorted((x.label, x.word) for x in got[i].base_places) == want
    assert {i: {m.label for m in got[i].matches} for i in (1, 4, 5, 6, 7, 8)} == {1: {"mit"}, 4: {"gpl-3"}, 5: {"gpl-3"}, 6: set(), 7: {"all-rights-reserved"}, 8: set()}
    assert licenses.scan_licenses(edge).count() == len(EDGE) and licenses.scan_licenses(none).count() == 0


# pipeline ----------------------------------------------------------------------------------------
def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # planted: a benchmark passage, a near copy, a repeated passage
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    words, block = prose(120, 5).split(), prose(60, 6)
    own = [(9000, "lead " + passage), (9001, " ".join(words)), (9002, " ".join(words[:60] + ["changed"] + words[61:])), (9003, prose(30, 7) + "\n" + block), (9004, prose(30, 8) + "\n" + block), (9005, prose(40, 9))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in own], DOCS))
    lines = pipeline.drop_repeated_lines(spark, docs, sf)
    assert lines.columns == docs.columns
    text = {r.doc_id: r.text for r in lines.where("doc_id >= 9000").collect()}
    assert block in text[9003] and block not in text[9004] and text[9005] == own[5][1]
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf).select("doc_id").collect()}
    assert 9001 in kept and 9002 not in kept and 9005 in kept
    clean = {r.doc_id for r in pipeline.drop_contaminated(spark, docs, sf).select("doc_id").collect()}
    assert 9000 not in clean and {9001, 9003, 9005} <= clean
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]
