"""Further tests of the ten operators: brute force at several shards and parts, keys that repeat, long texts, and the registered queries themselves."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("skygraph.llm")

from skygraph.llm import common, decontamination, embedding_dedup, importance, language_id, licenses, line_dedup, minhash, packing, queries, token_counts, toxicity
from skygraph.llm.common import WordIds, words_of

SMALL = "/root/testdata/sf0.001"


def prose(n, seed, alphabet="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")


# what operators share ----------------------------------------------------------------------------
def test_word_ids_have_64_independent_bits():
    ids, pairs = WordIds(), [(b"gnyijstj", b"etislvlf")]
    assert all(ids[a] != ids[b] for a, b in pairs)
    words = [f"word{i}".encode() for i in range(50_000)]
    low = {ids[w] & 0xFFFFFFFF for w in words}
    high = {ids[w] >> 32 for w in words}
    assert len({ids[w] for w in words}) == len(words) and len(low) > 49_990 and len(high) > 49_990


def test_rows_that_agree_are_left_out_and_no_others(spark):
    docs = spark.createDataFrame([(1, 10), (1, 11), (None, 10), (2, None), (3, -5), (3, -5)], "doc_id bigint, h bigint")
    gone = spark.createDataFrame([(1, 10), (None, 10), (2, None), (3, -5), (9, 9)], "doc_id bigint, h bigint")
    assert sorted(map(tuple, common.without(docs, gone, ["doc_id", "h"]).collect()), key=str) == [(1, 11), (2, None)]
    assert common.without(docs, gone.limit(0), ["doc_id", "h"]).count() == 6
    assert sorted(r.h for r in common.without(docs, gone, ["h"]).where("h is not null").collect()) == [11]


def test_key_filter_never_loses_a_key(spark):
    keys = [random.Random(1).randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    held = common.KeyFilter.of(spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5))
    assert held.has(np.array(keys)).all() and held.has(np.arange(10_000)).mean() < 0.01


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_key_filter_runs_on_its_own_side_of_a_join_alone(spark):
    docs, others = (table(spark, [(i, f"text {i}") for i in range(n)]) for n in (50, 40))
    few = docs.where(common.KeyFilter.of(others.select("doc_id").where("doc_id < 9")).among(spark, "doc_id"))
    met = few.join(others.withColumnRenamed("text", "other"), "doc_id")
    assert sum("ArrowEvalPython" in x for x in plan_of(met)) == 1
    assert sorted(r.doc_id for r in met.collect()) == [*range(9)]


def test_multisets_are_made_in_tasks_without_another_worker(spark, tmp_path):
    texts = {i: prose(30 + i, i) for i in range(20)}
    table(spark, texts.items()).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, i % 2) for i in range(0, 20, 3)], "doc_id bigint, component bigint").write.parquet(f"{tmp_path}/wanted")
    held = minhash.contents(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/wanted"))
    plan = plan_of(held)
    made, tested = (next(i for i, x in enumerate(plan) if name in x) for name in ("MapInArrow", "ArrowEvalPython"))
    assert any("Exchange hashpartitioning" in x for x in plan[made:tested])
    got = {r.doc_id: (r.component, r.content) for r in held.collect()}
    assert got == {i: (i % 2, minhash.multiset(*minhash.shingles(texts[i], WordIds())[:2]).view(np.int64).tolist()) for i in range(0, 20, 3)}


# 1 -----------------------------------------------------------------------------------------------
def test_marginals_of_texts_of_any_length_equal_one_chain():
    r = np.random.default_rng(2)
    t = np.array([[0.2, -0.4], [0.5, 0.9]])
    lengths = np.array([1, 63, 64, 65, 0, 200, 1000, 128])
    texts = [r.normal(-1, 2, n) for n in lengths]
    got = toxicity.document_marginals(np.concatenate(texts), lengths, t)
    want = np.concatenate([toxicity.marginals(x[:, None], t)[:, 0] for x in texts if len(x)])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    # evidence on both sides of a block's border
    x = np.full(130, -3.0)
    x[63:65] = 4
    np.testing.assert_allclose(toxicity.document_marginals(x, np.array([130]), t), toxicity.marginals(x[:, None], t)[:, 0], rtol=1e-9)
    assert len(toxicity.document_marginals(np.zeros(0), np.array([0, 0]), t)) == 0


def test_toxicity_of_a_text_of_megabytes_and_of_rows_as_they_are(spark):
    field = toxicity.Field({zlib.crc32(b"vile"): 12.0}, -6.0, np.zeros((2, 2)))
    long = "plain words here " * 150_000
    rows = [(1, long), (1, long + "vile"), (None, "so vile"), (2, None)]
    got = toxicity.tag(spark.createDataFrame([(i, x, "kept") for i, x in rows], "doc_id bigint, text string, score string"), field, score="_score", spans="_spans").collect()
    assert [r["_score"] >= 0.7 for r in got] == [False, True, True, False] and {r.score for r in got} == {"kept"}
    assert [(s.start, s.end) for s in got[1]["_spans"]] == [(len(long), len(long) + 4)]


# 2 -----------------------------------------------------------------------------------------------
def test_presence_equals_sets_of_hashed_grams():
    held = ["Abc abd", "ABD  x1z", "", "12 !", "ünï 中文"]
    got, known = language_id.presence(held)
    for row, text in zip(got, held):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        squeezed = re.sub(" +", " ", letters).lstrip()
        want = set()
        for n in language_id.ORDERS:
            for i in range(len(squeezed) - n + 1):
                gram = np.zeros(1, dtype=np.uint64)
                for c in squeezed[i : i + n]:
                    gram = gram * np.uint64(1_114_112) + np.uint64(ord(c))
                want.add(int(common.mix(gram + np.uint64(n << 60))[0] % np.uint64(language_id.DIM)))
        assert set(np.flatnonzero(row)) == want
    assert known.tolist() == [True, True, False, False, True]
    # long texts go part by part, cut anywhere
    r = random.Random(1)
    for _ in range(100):
        text = "".join(r.choices("ab c!é\n中  ", k=r.randint(0, 60)))
        whole = language_id._marks([text])[0][0]
        for most in (1, 2, 3, 7):
            assert (language_id._marks(language_id.pieces(text, most))[0].max(axis=0) == whole).all()


# 3 -----------------------------------------------------------------------------------------------
def test_embedding_links_over_many_cells_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD", 300), ("REGION", 900), ("BLOCK", 500)):
        monkeypatch.setattr(embedding_dedup, name, value)
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 16))
    x = np.vstack([base[r.integers(0, 300, 2500)] + r.normal(scale=0.05, size=(2500, 16)), base[:1] + r.normal(scale=0.03, size=(900, 16)), base[3:4].repeat(100, 0)]).astype(np.float32)
    label = np.arange(len(x)) % 2
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    root = np.arange(len(x))
    while not np.array_equal(new := np.minimum(root, np.where(close, root[None, :], len(x)).min(axis=1)), root):
        root = new
    # columns with clashing names beside
    df = spark.createDataFrame([(i, v.tolist(), int(z), "a", 1) for i, (v, z) in enumerate(zip(x, label))], "vec_id bigint, embedding array<float>, label int, n_links string, cell int")
    got = {q.vec_id: q for q in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == close.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist() and got[0].recall == 1.0


def test_embeddings_with_repeated_and_null_keys_and_nothing_to_audit(spark):
    a, b, c = ([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0])
    rows = [(5, a, 1), (5, b, 1), (7, a, 1), (9, b, 1), (11, c, 1), (None, c, 1), (12, None, 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted([(r.vec_id, r.component_id) for r in got], key=str) == sorted([(5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (None, None), (12, 12)], key=str)
    assert got[0].recall is None


# 4 -----------------------------------------------------------------------------------------------
def test_near_duplicates_of_a_wide_group_and_many_checks_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB", 5)
    r = random.Random(11)
    words = prose(100, 7).split()
    rows = []
    for i in range(80):
        w = list(words)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {q.doc_id: q.component_id for q in minhash.near_duplicates(table(spark, rows)).collect()}
    ids = WordIds()
    sets = {i: minhash.shingles(x, ids)[:2] for i, x in rows}
    root = {i: i for i in sets}
    for _ in range(10):
        for a in sets:
            for b in sets:
                if minhash.overlap(sets[a], sets[b]) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root and len(set(root.values())) > 1


def test_overlap_of_multisets():
    a = (np.array([1, 2, 3], np.uint64), np.array([2, 1, 1]))
    b = (np.array([1, 3, 9], np.uint64), np.array([1, 4, 1]))
    assert minhash.overlap(a, b) == 2 / 8 and minhash.overlap(a, a) == 1


# 5 -----------------------------------------------------------------------------------------------
def test_token_counts_of_long_texts_with_and_without_boundaries(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(5)
    rows = [(1, "x" * 60_000), (2, prose(40_000, 3)), (3, "中文" * 20_000)]
    rows += [(10 + i, "".join(r.choices("ab C.,!?0 \n\u00e9\u4e2d  ", k=3000))) for i in range(20)]
    got = {q.doc_id: q.n_tokens for q in token_counts.count_tokens(table(spark, rows), part_chars=700).collect()}
    assert got == {i: len(sp.encode(x)) for i, x in rows}


# 6 -----------------------------------------------------------------------------------------------
def test_log_ratios_equal_counts_by_hand(spark):
    rows = [(i, prose(30, i) + "!? ..") for i in range(40)] + [(40, None), (41, "")]
    told = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id bigint, quality int")
    ids, n = WordIds(), np.ones((2, importance.BUCKETS))
    for i, x in rows:
        for at in importance.hashed(x or "", ids).tolist():
            n[1, at] += 1
            n[0, at] += i < 30 and i % 3 == 0
    ratio = np.log(n[0] / n[0].sum()) - np.log(n[1] / n[1].sum())
    got = {q.doc_id: q for q in importance.resample(table(spark, rows), told, share=0.5).collect()}
    for i, x in rows:
        at = importance.hashed(x or "", ids)
        assert got[i].n_grams == len(at) and abs(got[i].log_weight - (ratio[at].mean() if len(at) else 0)) < 1e-12
    best = sorted(got.values(), key=lambda q: -q.perturbed)[:21]
    assert {q.doc_id for q in best} == {i for i, q in got.items() if q.selected}


@pytest.mark.parametrize("keys", [[(1 << 60) + i for i in range(50)], [5] * 50, [-(1 << 62) + i % 7 for i in range(50)]])
def test_exactly_k_of_tied_rows(spark, keys):
    tied = spark.createDataFrame([(i, 1.0) for i in keys] + [(None, None)], "doc_id bigint, perturbed double")
    for k in (0, 1, 7, 49, 50, 60):
        got = [r.doc_id for r in importance.top_k(tied, k).where("selected").collect()]
        assert sorted(got) == sorted(keys)[: min(k, 50)]


# 7 -----------------------------------------------------------------------------------------------
def test_decontamination_keeps_rows_and_tests_of_one_key_apart(spark):
    test = prose(12, 31).split()
    rows = [(1, " ".join(test[:5]) + " " + prose(9, 1)), (1, " ".join(test[5:10]) + " " + prose(9, 2)), (None, " ".join(test)), (3, " ".join(test)), (3, " ".join(test)), (3, prose(9, 4))]
    bench = spark.createDataFrame([(7, " ".join(test), 1), (7, prose(6, 55), 2), (None, prose(8, 3), 3)], "item_id bigint, text string, covered int")
    docs = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "doc_id bigint, text string, seed int, th string")
    got = sorted(((r.doc_id, r.covered, r.n_item) for r in decontamination.coverage(docs, bench).collect()), key=str)
    assert got == sorted([(1, 5, 12), (1, 5, 12), (None, 12, 12), (3, 12, 12)], key=str)
    assert sorted([r.doc_id for r in decontamination.contaminated(docs, bench).collect()], key=str) == [3, None]


def test_tiles_of_repeated_words_equal_a_search_word_by_word():
    from tests_tiles import tiles

    r = random.Random(3)
    for _ in range(60):
        item = [r.choice("ab") for _ in range(r.randint(1, 14))]
        doc = [r.choice("abc") for _ in range(r.randint(1, 30))]
        k = 3
        size = min(k, len(item))
        grams = lambda w: np.array([hash(tuple(w[i : i + size])) for i in range(len(w) - size + 1)], dtype=np.int64)
        a, b = grams(doc), grams(item)
        at, item_at = decontamination.shared_places(np.arange(len(a)), a, np.arange(len(b)), b)
        assert decontamination.tile(at, item_at, k, len(item)) == tiles(doc, item, k)


# 8 -----------------------------------------------------------------------------------------------
def test_both_encoders_give_the_same_ids():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(6)
    letters = [chr(i) for i in range(0x250)] + list("  \n\t'") * 20 + ["<|endoftext|>", "中", "'s", "'LL", "123"]
    for _ in range(2000):
        text = "".join(r.choices(letters, k=r.randint(0, 40)))
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


# 9 -----------------------------------------------------------------------------------------------
def test_line_dedup_of_many_equal_lines(spark):
    rows = [(1, "\n".join(["two words"] * 20_000)), (2, "\n" * 50_000), (3, "\n".join(["two words"] * 3 + [""] * 4000 + ["two words"] * 2)), (4, "\n".join(["two words"] * 3 + [""] * 4000 + ["two words"] * 2 + ["end"]))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, rows), longest_runs=False).collect()}
    assert got[1].text == "two words" and got[1].removed == list(range(1, 20_000))
    assert got[2].text == "\n" * 50_000 and got[3].text == rows[2][1] and got[4].text == "end"


# 10 ----------------------------------------------------------------------------------------------
def test_license_query_columns_equal_a_regex_search(spark):
    got = {r.doc_id: r for r in queries.op10_licenses(spark, SMALL).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        places = sorted((p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


# the registered queries --------------------------------------------------------------------------
CONTRACT = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op4_minhash": "doc_id bigint, component_id bigint, kept boolean",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_importance": "doc_id bigint, selected boolean",
    "op7_decontamination": "doc_id bigint, contaminated boolean, coverage double",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_line_dedup": "doc_id bigint, text string",
    "op10_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_query_gives_its_columns_over_the_whole_table(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    types = dict(got.dtypes)
    for column in CONTRACT[name].split(", "):
        c, kind = column.split()
        assert types[c] == kind, c
    key = "vec_id" if name.startswith("op3") else "doc_id"
    source = f"{SMALL}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet"
    all_keys = [r[0] for r in duckdb.sql(f"SELECT {key} FROM '{source}'").fetchall()]
    rows = got.collect()
    found = [r[key] for r in rows]
    assert sorted(set(found) if name.startswith("op8") else found) == sorted(all_keys)
    if "held_out" in types:
        modulus, rest = (3, 1) if name.startswith("op1_") else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    if "predicted" in types:
        assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op5_token_counts":
        sizes = dict(duckdb.sql(f"SELECT doc_id, octet_length(encode(coalesce(text, ''))) FROM '{source}'").fetchall())
        assert all(r.n_bytes == sizes[r.doc_id] and r.over_limit == (r.n_tokens > 4096) for r in rows)


# the pipeline ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (None, "no key"), (None, None), (3, "tie tie tie tie"), (3, "tie tie tie tie"), (3, "same key, other text"), (4, "line one\nline two")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra", 1.0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, _score double")


def test_pipeline_stages_hold_on_odd_rows_and_empty_tables(spark, odd):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        none = stage(spark, odd.select(*pipeline.COLUMNS).limit(0), SMALL)
        assert none.count() == 0
        got = stage(spark, odd, SMALL)
        if name == "packing":
            assert got.where("start = 0").count() == 8
            continue
        assert got.columns == none.columns == pipeline.COLUMNS
        # nothing here is toxic, contaminated or a repeated run of ten words; of the ties none is another document
        assert got.count() == 8, name


def test_pipeline_judges_rows_by_their_own_text(spark, monkeypatch):
    import corpus_pipeline as pipeline

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(1, "clean words only"), (1, f"lead {bench}"), (None, f"{bench} tail"), (None, "vile vile"), (2, "so vile"), (2, "all is well")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = sorted(r.text for r in pipeline.drop_contaminated(spark, docs, SMALL).collect())
    assert left == sorted(t for _, t in rows if bench not in t)
    monkeypatch.setattr(toxicity, "learn", lambda *a, **b: toxicity.Field({zlib.crc32(b"vile"): 12.0}, -6.0, np.zeros((2, 2))))
    left = sorted(r.text for r in pipeline.drop_toxic(spark, docs, SMALL).collect())
    assert left == sorted(t for _, t in rows if "vile" not in t)


def test_pipeline_runs_its_stages_one_after_another(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = common.Scratch(spark).save(stage(spark, docs, SMALL))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = pipeline.run(spark, SMALL).select(*key)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.select(*key).collect()))
    assert got.agg(F.count_distinct("doc_id")).first()[0] < 200


# SQL by brute force ------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_lists_of_all_nodes_are_pruned_at_once():
    from skygraph.llm import embedding_dedup as dedup

    r = np.random.default_rng(19)
    x = dedup.unit(np.concatenate([r.normal(size=(90, 16)), r.normal(size=(1, 16)) + 0.05 * r.normal(size=(40, 16))]))
    distance = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    candidates = np.full((130, 60), -1)
    for n in range(130):
        own = r.permutation([i for i in range(130) if i != n])[: r.integers(0, 61)]
        candidates[n, : len(own)] = own
    got = dedup._least_redundant(distance, np.arange(130), candidates, 6)
    for n in range(130):
        kept = []
        for c in sorted(candidates[n][candidates[n] >= 0], key=lambda c: distance[n, c]):
            if len(kept) < 6 and all(1.2 * distance[k, c] > distance[n, c] for k in kept):
                kept.append(c)
        assert [c for c in got[n] if c >= 0] == kept
