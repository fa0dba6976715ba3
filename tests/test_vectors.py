from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensmill.operators import vectors as V

K = 21
AXES = np.eye(K)


def mentions(sims, margin=0.02):
    primary, mask = V.assign(np.array([sims]), margin)
    return int(primary[0]), np.flatnonzero(mask[0]).tolist()


def test_assign():
    base = [0.5] * K
    with_ = lambda **at: [at.get(f"s{i}", v) for i, v in enumerate(base)]
    assert mentions(with_(s1=0.95, s2=0.94)) == (1, [1, 2])
    assert mentions(with_(s1=0.95, s2=0.92)) == (1, [1])
    assert mentions([0.8] * K) == (20, [20])
    assert mentions(with_(s4=0.95, s1=0.94)) == (4, [4])
    assert mentions(with_(s1=0.95, s4=0.94)) == (1, [1])
    assert mentions(with_(s1=0.9, s6=0.9)) == (6, [1, 6])


def test_pooling():
    hidden = np.array([[[3.0, 4.0], [100.0, 0.0]]])
    assert V.pool(hidden, np.array([[1, 0]]), "mean")[0] == pytest.approx([0.6, 0.8])
    assert V.pool(hidden, np.array([[1, 1]]), "cls")[0] == pytest.approx([0.6, 0.8])


@pytest.mark.parametrize("name", sorted(V.ENCODERS))
def test_encoders_read_the_whole_text(name):
    model = V.hashing_forward(V.ENCODERS[name])
    a, b, c, d = model(["good map", "bad story", "word " * 600 + "map", "word " * 600 + "story"])
    assert a @ b < 0.9 and not np.array_equal(c, d)
    assert np.linalg.norm([a, b, c, d], axis=1) == pytest.approx(np.ones(4), abs=1e-6)


def test_reviews_do_not_all_get_one_category():
    from lensmill.cli import description_anchors
    from lensmill.schema import CATEGORIES

    texts = [f"{label} {label}" for _, label in CATEGORIES]
    x = V.hashing_forward(V.ENCODERS["hashing-wide"])(texts)
    assert len(set((x @ description_anchors("hashing-wide").vectors.T).argmax(axis=1).tolist())) > 10


def examples(n, slot=1):
    x = np.zeros((n, K))
    x[:, 2] = 1
    return V.Examples(x, np.full(n, slot), [[] for _ in range(n)])


def test_fit_moves_with_evidence():
    flat = V.Anchors(AXES.copy())
    few, many, none = (V.fit(flat, examples(n), 8.0, 0.5) for n in (5, 200, 0))
    assert few.evidence[1] == 5 and few.vectors[1] @ AXES[1] > few.vectors[1] @ AXES[2] > 0
    assert many.share[1] > 0.9 and many.vectors[1] @ AXES[2] > 0.99
    assert np.allclose(none.vectors, flat.vectors) and np.allclose(np.linalg.norm(few.vectors, axis=1), 1)


def test_calibration_is_the_mean_similarity():
    rng = np.random.default_rng(0)
    x = V._unit(rng.standard_normal((50, K)))
    flat = V.Anchors(AXES.copy())
    assert flat.prepare("bias", x.mean(axis=0)).similarities(x).mean(axis=0) == pytest.approx(np.zeros(K), abs=1e-12)
    assert flat.prepare("bias", np.zeros(3)).bias is None
    centred = flat.prepare("centred", x.mean(axis=0))
    assert np.allclose(np.linalg.norm(centred.vectors, axis=1), 1)


def test_anchor_files(tmp_path):
    a = V.Anchors(AXES.copy(), margin=0.03, scoring="bias", bias=np.arange(K) / 100)
    a.save(str(tmp_path / "a.json"))
    b = V.Anchors.load(str(tmp_path / "a.json"))
    assert np.allclose(a.vectors, b.vectors) and b.margin == 0.03 and np.allclose(a.bias, b.bias)
    with pytest.raises(ValueError, match="taxonomy"):
        V.Anchors.load(str(tmp_path / "a.json"), "core-9")
    with pytest.raises(ValueError, match="made with"):
        V.refuse_foreign(a, "other")


def test_texts_are_embedded_once_and_reviews_share_their_vector(spark):
    rows = spark.createDataFrame([("1", 1, "good game"), ("2", 1, "good game"), ("3", 1, "  "), ("4", 1, None), ("5", 1, "bad game")], "recommendationid string, appid bigint, review string")
    got = V.embedded(rows, V.ENCODERS["hashing"])
    assert sorted(r.n_reviews for r in got.collect()) == [1, 2]
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in got.collect())
    anchors = V.Anchors(V._unit(np.random.default_rng(1).standard_normal((K, 64))))
    tagged = {r.recommendationid: r for r in V.classified(rows, got, anchors).collect()}
    assert set(tagged) == {"1", "2", "5"} and tagged["1"].mentions == tagged["2"].mentions
    assert V.unmatched(rows, got.where("n_reviews = 2")).count() == 1


def test_column_algebra(spark):
    row = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert row.select(V.dot(F.col("v"), F.col("v"))).first()[0] == 25
    assert row.select(V.normalise(F.col("v"))).first()[0] == [0.6, 0.8]


def test_sums_match_the_fit(spark):
    rows = spark.createDataFrame([(1, [2], [1.0, 0.0]), (1, None, [0.0, 1.0])], "slot int, secondary array<int>, embedding array<float>")
    got = {(r.slot, r.pos): (r.total, r.evidence) for r in V.weighted_sums(rows, 0.5).collect()}
    assert got == {(1, 0): (1.0, 2.0), (1, 1): (1.0, 2.0), (2, 0): (0.5, 0.5), (2, 1): (0.0, 0.5)}


def labelled(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        slot = i % 4
        v = AXES[slot] * 0.5 + AXES[slot + 6] * 0.6 + rng.standard_normal(K) * 0.05
        rows.append((f"{i:03d}", slot, [], [float(x) for x in v / np.linalg.norm(v)], i % 3, "random" if i % 5 < 2 else "stratified", i % 10 == 0))
    return spark.createDataFrame(rows, "id string, slot int, secondary array<int>, embedding array<double>, app bigint, subset string, ambiguous boolean")


def test_search_and_transfer(spark):
    rows = labelled(spark)
    search = V.searched(rows, V.Anchors(AXES.copy()), np.zeros(K), folds=3)
    assert search.count() == 8 * 4 * 3 * 7
    smoothing, secondary, scoring, margin = V.best_params(search)
    assert smoothing in V.SMOOTHING and secondary in V.SECONDARY and scoring in V.SCORING and margin in V.MARGINS
    table = V.transfer(rows, V.Anchors(AXES.copy()), "app", folds=2, scorings=("raw",))
    got = table.collect()
    assert len(got) == 24 and sum(r.same for r in got) == 24 and sum(r.unseen for r in got) == 24 and sum(r.written for r in got) < 12
    totals = {r.app: r for r in V.transfer_table(table).collect()}
    assert set(totals) == {0, 1, 2, None} and totals[None].n == 24 and totals[None].gained == 24 - sum(r.written for r in got) and totals[None].p < 0.01
    assert {r.app: r.n for r in V.transfer_table(table, contested=True).collect()}[None] == 6
    same = {r.app: r for r in V.compare_encoders(table, table).collect()}[None]
    assert same.n == same.first == same.second == 24 and same.gained == same.lost == 0 and same.p is None
    with pytest.raises(Exception, match="different reviews"):
        V.compare_encoders(table, table.where("id > '030'")).collect()


def test_nothing_held_back_is_fitted_on(spark):
    """A label held back that contradicts all others moves no anchor."""
    rows = labelled(spark)
    training, held = V.split_labels(rows)
    assert training.count() == 36 and held.count() == 24 and training.join(held, "id").count() == 0
    odd = rows.withColumn("embedding", F.when(F.col("subset") == "random", F.array(*[F.lit(float(k == 15)) for k in range(K)])).otherwise(F.col("embedding")))
    got = V.transfer(odd, V.Anchors(AXES.copy()), "app", params=(1.0, 0.0, "raw")).collect()
    assert not any(r.same or r.unseen for r in got)


def test_the_other_objective(spark):
    training, held = (V.examples_of(x) for x in V.split_labels(labelled(spark)))
    base = V.Anchors(AXES.copy())
    chosen = V.fit(base, training, 1.0, 0.0)
    got = V.other_choice(base, training, held, np.zeros(K), chosen, "primary", folds=2, scorings=("raw",))
    assert got["objective"] == "mentions" and got["agreement"] > 0.9 and (got["gained"], got["lost"], got["p"]) == (0, 0, None)
    assert V.exact_p(12, 2) == pytest.approx(0.012939453125) and V.exact_p(7, 7) == 1


def test_named_reviews_are_embedded_afresh(spark):
    rows = spark.createDataFrame([("1", "good game"), ("2", "a bad game"), ("3", " "), ("4", "good game")], "recommendationid string, review string")
    got = {r.id: r.embedding for r in V.embed_reviews(rows, spark.createDataFrame([("1",), ("3",), ("4",), ("9",)], "id string"), V.ENCODERS["hashing"]).collect()}
    assert set(got) == {"1", "4"} and got["1"] == got["4"] and len(got["1"]) == 64
