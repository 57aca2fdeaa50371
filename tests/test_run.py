"""Sources, models, features and attention beside their queries: brute force, errors and degenerate tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygraph.operators import catalog, features, gat, graph
from skygraph.plans import graph_run
from skygraph.sources import tables


def folder(spark, name):
    return f"{tables.shared_folder(spark)}/{name}"


def test_missing_sources(spark):
    assert tables.read_partitioned(spark, folder(spark, "no-such")) is None
    spark.range(3).write.mode("overwrite").parquet(folder(spark, "some"))
    assert tables.read_partitioned(spark, folder(spark, "some"), "none-*.parquet") is None
    assert tables.read_partitioned(spark, folder(spark, "some")).count() == 3
    with pytest.raises(FileNotFoundError):
        graph_run.load_model(spark, folder(spark, "no-model"))
    spark.createDataFrame([("nside", "8")], "name string, value string").write.mode("overwrite").parquet(folder(spark, "properties"))
    assert tables.read_property(spark, folder(spark, "properties"), "nside") == "8"
    with pytest.raises(KeyError):
        tables.read_property(spark, folder(spark, "properties"), "other")


def test_padded_strings_are_trimmed(spark):
    spark.createDataFrame([("GALAXY  ", 0.02), ("STAR", 0.02)], "spectype string, z double").write.mode("overwrite").parquet(folder(spark, "padded"))
    assert catalog.select_rows(tables.read(spark, folder(spark, "padded"))).count() == 1


def test_pixel_names(spark):
    got = spark.createDataFrame([(7,), (191,)], "hpx int").select(catalog.pixel_name()).collect()
    assert [r[0] for r in got] == ["hp007", "hp191"]


def test_model_table_round_trip(spark):
    params = gat.formula_weights()
    schema = "layer string, param string, shape array<int>, data array<double>"
    model = spark.createDataFrame(gat.model_rows(params), schema)
    read = gat.params_of(model)
    assert all(np.array_equal(read[k][n], params[k][n]) for k in read for n in read[k])
    with pytest.raises(ValueError, match="gat_layer2.att"):
        gat.params_of(model.where("not (layer = 'gat_layer2' and param = 'att')"))


def dense(x, edges, params):
    """Graph attention on the driver, node by node."""
    n, prev = len(x), None
    for k in (1, 2, 3, 4):
        p = params[k]
        heads, width = p["att"].shape
        left, right = x @ p["wl"].T + p["bl"], x @ p["wr"].T + p["br"]
        out = np.zeros((n, heads * width))
        for i in range(n):
            own = [(a, length) for a, b, length in edges if b == i]
            s = np.array([(np.where((u := left[a] + right[i] + length * p["we"]) > 0, u, 0.2 * u).reshape(heads, width) * p["att"]).sum(axis=1) for a, length in own])
            e = np.exp(s - s.max(axis=0))
            a = e / e.sum(axis=0)
            out[i] = sum(np.repeat(a[j], width) * left[src] for j, (src, _) in enumerate(own)) + p["bias"]
        if k == 4:
            return out
        x = (out - out.mean(axis=1, keepdims=True)) / np.sqrt(out.var(axis=1, keepdims=True) + 1e-5) * p["gamma"] + p["beta"]
        x = prev = np.maximum(x + (prev if k > 1 else 0), 0)


def test_attention_equals_node_by_node_with_a_hub(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 10))
    pairs = sorted({(0, j) for j in range(1, 29)} | {tuple(sorted(map(int, r.choice(29, 2, replace=False)))) for _ in range(40)})
    length = {p: float(r.uniform(0.1, 3)) for p in pairs}
    both = [(a, b, v) for (a, b), v in length.items()] + [(b, a, v) for (a, b), v in length.items()]
    # node 29 has no edge but its loop
    loops = [(i, i, float(np.mean([v for _, b, v in both if b == i])) if i < 29 else 0.0) for i in range(30)]
    want = dense(x, both + loops, gat.formula_weights())
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in length.items()], "src bigint, dst bigint, length double")
    got = {q.id: q.logits for q in gat.logits(nodes, edges, gat.formula_weights()).collect()}
    np.testing.assert_allclose([got[i] for i in range(30)], want, rtol=1e-9, atol=1e-9)
    told = {q.id: q for q in gat.predict(gat.logits(nodes, edges, gat.formula_weights())).collect()}
    assert all(told[i].gat_env == want[i].argmax() for i in range(30))


def test_boxcox_optimum_and_degenerate_columns(spark):
    r = np.random.default_rng(4)
    x = np.column_stack([np.exp(r.normal(size=400)), r.gamma(2, size=400), np.full(400, 3.0)])
    df = spark.createDataFrame([(*map(float, v), None if i % 2 else float("nan")) for i, v in enumerate(x)], "a double, b double, c double, d double")
    got = features.fit(df, ["a", "b", "c", "d"])

    def like(values, p):
        y = np.log(values) if abs(p) < 1e-12 else (values**p - 1) / p
        return (p - 1) * np.log(values).sum() - len(values) / 2 * np.log(y.var())

    for c, v in zip("ab", x.T + features.OFFSET):
        best = max(np.arange(-1, 2, 1e-3), key=lambda p: like(v, p))
        assert abs(got[c][0] - best) < 2e-3
    assert got["c"][0] == 1.0 and got["c"][2] == 1.0 and got["d"] == (1.0, 0.0, 1.0)
    with pytest.raises(Exception, match="positive"):
        features.fit(spark.createDataFrame([(-1.0,)], "a double"), ["a"])


def test_result_needs_a_prediction_for_every_node(spark):
    catalogue = spark.range(4).select("id")
    scored = spark.createDataFrame([(i, [0.0, 1.0, 0.0, float(i)]) for i in range(3)], "id bigint, logits array<double>")
    with pytest.raises(Exception, match="no prediction for node 3"):
        graph_run.attach(catalogue, gat.predict(scored)).collect()
    out = graph_run.write_result(catalogue.where("id < 3"), gat.predict(scored), folder(spark, "result"))
    assert sorted(r.gat_env for r in out.collect()) == [1, 1, 3]
    twice = gat.predict(scored.unionByName(scored))
    with pytest.raises(ValueError, match="6 rows"):
        graph_run.write_result(catalogue.where("id < 3"), twice, folder(spark, "result2"))


def test_inference_by_its_parameters(spark):
    r = np.random.default_rng(9)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(r.uniform(0, 8, (60, 3)))], "id bigint, x double, y double, z double")
    spark.createDataFrame(gat.model_rows(gat.formula_weights()), "layer string, param string, shape array<int>, data array<double>").write.mode("overwrite").parquet(folder(spark, "model"))
    spark.createDataFrame([(c, 1.0, 0.5, 2.0) for c in graph_run.FEATURES], "feature string, lambda double, mean double, std double").write.mode("overwrite").parquet(folder(spark, "scaler"))
    spark.createDataFrame([(i, i % 4) for i in range(9)], "id bigint, cweb int").write.mode("overwrite").parquet(folder(spark, "reference"))
    told = dict(model_path=folder(spark, "model"), scaler_path=folder(spark, "scaler"), reference_path=folder(spark, "reference"), cache_folder=folder(spark, "bundle"), result_path=folder(spark, "vac"))
    first = tables.Settings(first_moment_matching=True, cache_mode="prefer-cache")
    result, shares = graph_run.run_inference(spark, points, settings=first, **told)
    assert result.count() == 60 and shares.count() == 8
    assert abs(sum(q.density for q in shares.collect()) - 2) < 1e-9
    # the bundle that was saved gives the same, and no features but those of the scaler
    again, none = graph_run.run_inference(spark, points, settings=tables.Settings(first_moment_matching=True, cache_mode="cache-only"), summary=False, **told)
    assert none is None and {(q.id, q.gat_env) for q in again.collect()} == {(q.id, q.gat_env) for q in spark.read.parquet(told["result_path"]).collect()}
    bundle = graph_run.build_bundle(points, first, tables.read_scaler(spark, told["scaler_path"]))
    stats = graph.node_stats(points, bundle["edges"])
    raw, got = ({q.id: q for q in df.collect()} for df in (stats, bundle["features"]))
    mean = np.mean([((raw[i].degree + 1e-6 - 1) - 0.5) / 2 for i in raw])
    assert all(abs(got[i].degree - (((raw[i].degree + 1e-6 - 1) - 0.5) / 2 - mean)) < 1e-9 for i in raw)
    with pytest.raises(ValueError, match="scaler"):
        graph_run.build_bundle(points, first)


def test_cache_that_cannot_be_saved_is_reported(spark, capsys):
    p = spark.range(2)
    bundle = dict.fromkeys(tables.PARTS, p.withColumn("bad", F.raise_error(F.lit("no")).cast("int")))
    got, origin = tables.Cache(spark, folder(spark, "broken"), tables.Settings()).resolve(lambda: bundle)
    assert origin == "built, not saved" and got is bundle and "not saved" in capsys.readouterr().out


def test_settings_order(monkeypatch):
    monkeypatch.setenv("SKYGRAPH_LOG_MASS", "9.7")
    monkeypatch.setenv("SKYGRAPH_FIRST_MOMENT_MATCHING", "true")
    assert tables.Settings.load().log_mass == 9.7 and tables.Settings.load(log_mass=9.1).log_mass == 9.1
    assert tables.Settings.load().first_moment_matching is True
    with pytest.raises(ValueError):
        tables.Cache(None, "x", tables.Settings(cache_mode="other"))


def test_distance_equals_a_fine_sum(spark):
    from skygraph.functions import cosmology as c

    assert abs(c.OMEGA_M + c.OMEGA_LAMBDA + c.OMEGA_GAMMA * c._today() - 1) < 1e-12 and 5.3e-5 < c.OMEGA_GAMMA < 5.5e-5
    z = [0.0, 0.01, 0.06, 0.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(c.comoving_distance(F.col("z"))).collect()]
    for x, d in zip(z, got):
        a = 1 + (np.arange(20_000) + 0.5) / 20_000 * x
        nu = c.NU_SHARE * (2 + (1 + (c.NU_K * c.NU_Y / a) ** c.NU_P) ** (1 / c.NU_P))
        want = c.LIGHT_KM_S / c.H0 * x * np.mean((c.OMEGA_M * a**3 + c.OMEGA_GAMMA * a**4 * (1 + nu) + c.OMEGA_LAMBDA) ** -0.5)
        assert abs(d - want) < 1e-6 * max(1, want)


def test_end_to_end_equals_its_parts_on_the_driver(spark):
    r = np.random.default_rng(12)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(r.uniform(0, 9, (50, 3)))], "id bigint, x double, y double, z double")
    got = {q.id: q for q in graph_run.end_to_end(spark, points, tables.Settings(), gat.formula_weights()).collect()}
    pairs = [(q.src, q.dst, q.length) for q in graph.alpha_edges(points, tables.Settings().radius).collect()]
    stats = {q.id: np.array([float(q[c]) for c in graph_run.FEATURES]) for q in graph.node_stats(points, spark.createDataFrame(pairs, "src bigint, dst bigint, length double")).collect()}
    x = np.array([stats[i] for i in range(50)]) + features.OFFSET
    for j in range(x.shape[1]):
        v, lo, hi = x[:, j], -5.0, 5.0
        if v.std() == 0:
            x[:, j] = 0
            continue
        for _ in range(5):
            p = np.linspace(lo, hi, 41)
            p[np.abs(p) < 1e-12] = 0
            y = [np.log(v) if a == 0 else (v**a - 1) / a for a in p]
            i = int(np.argmax([(a - 1) * np.log(v).sum() - len(v) / 2 * np.log(max(b.var(), 1e-300)) for a, b in zip(p, y)]))
            lo, hi = p[max(0, i - 1)], p[min(40, i + 1)]
        x[:, j] = (y[i] - y[i].mean()) / y[i].std()
    x -= x.mean(axis=0)
    both = pairs + [(b, a, v) for a, b, v in pairs]
    loops = [(i, i, float(np.mean(own)) if (own := [v for _, b, v in both if b == i]) else 0.0) for i in range(50)]
    want = dense(x, both + loops, gat.formula_weights())
    e = np.exp(want - want.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    names = [f"gat_{c.lower()}_prob" for c in gat.CLASSES]
    np.testing.assert_allclose([[got[i][c] for c in names] for i in range(50)], p, atol=2e-3)
    sure = np.sort(p, axis=1)[:, -1] - np.sort(p, axis=1)[:, -2] > 0.01
    assert all(got[i].gat_env == p[i].argmax() for i in np.flatnonzero(sure))
