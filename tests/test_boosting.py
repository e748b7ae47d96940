"""Boosted trees: sums against rows at hand, first splits by hand, prefixes, log loss, saving."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from airstats.operators.features import CATEGORICAL_FEATURES
from airstats.plans import boosting, models, scoring
from airstats.plans.boosting import Setting, boost

DEEP, FLAT = Setting(4, 0.3), Setting(2, 0.1)
ARGS = ("features", "delay_level", "weight", 4)


@pytest.fixture(scope="module")
def train(spark, flights):
    return models.prepare(flights, "flight_id").train


@pytest.fixture(scope="module")
def fitted(train):
    return boost(train, [DEEP, FLAT], 6, *ARGS)


def same(one, other):
    return all(np.array_equal(getattr(a, k), getattr(b, k))
               for r, s in zip(one, other, strict=True) for a, b in zip(r, s, strict=True)
               for k in ("cell", "left", "value", "gain"))


@pytest.mark.parametrize("local_rows", [0, 600, 3000])
def test_sums_choose_the_same_splits(train, fitted, local_rows, monkeypatch):
    monkeypatch.setattr(boosting, "SUMS", 2000)  # several jobs a level
    again = boost(train.repartition(3), [DEEP, FLAT], 3, *ARGS, local_rows=local_rows)
    assert same(again.rounds[DEEP], fitted.rounds[DEEP][:3]) and same(again.rounds[FLAT], fitted.rounds[FLAT][:3])


def test_nodes_are_dealt_to_different_tasks(spark, train):
    """As many tasks as trees each grow one, and rows travel as small numbers, once a tree."""
    bins = boosting.fit_bins(train, "features")
    rows = boosting.binned(train.repartition(2), bins, *ARGS[:3], 4)
    assert rows.rdd.getNumPartitions() >= 2 and len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert all(len(r.cells) <= 2 * r.rows * (len(bins.numbers) + len(CATEGORICAL_FEATURES)) for r in rows.collect())
    count = train.count()
    grown = boosting._rest(rows, boosting.Round(bins, [DEEP], 4, growing=[{}] * 4), {(t, 1): count for t in range(4)})
    assert {(r.tree, r.task) for r in grown.select("tree", F.spark_partition_id().alias("task")).collect()} == {(t, t) for t in range(4)}


def test_one_large_node_alone_is_split_from_sums(train, fitted, monkeypatch):
    """The bound is for the rows of a node, not for those of all trees side by side."""
    count, levels = train.count(), []
    level = boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *args: levels.append(args[2]) or level(*args))
    again = boost(train, [DEEP, FLAT], 1, *ARGS, local_rows=count)
    assert not levels and same(again.rounds[DEEP], fitted.rounds[DEEP][:1])
    again = boost(train, [DEEP, FLAT], 1, *ARGS, local_rows=count - 1)
    assert levels == [[(t, 1) for t in range(8)]] and same(again.rounds[FLAT], fitted.rounds[FLAT][:1])


def test_prefix_is_a_shorter_fit(train, fitted, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", 2)
    alone = boost(train, [DEEP], 5, *ARGS)
    assert same(alone.rounds[DEEP], fitted.rounds[DEEP][:5])
    assert fitted.model(DEEP, 5).getOrDefault("trees") == alone.model(DEEP).getOrDefault("trees")
    assert fitted.model(DEEP, 5).rounds() == 5


def test_log_loss_falls(train, fitted):
    losses = []
    for rounds in range(7):
        p = vector_to_array("probability")[F.col("delay_level")]
        scored = fitted.model(DEEP, rounds).transform(train)
        losses.append(scored.agg(F.sum(-F.log(p) * F.col("weight")) / F.sum("weight")).head()[0])
    assert losses[0] == pytest.approx(np.log(4)) and losses == sorted(losses, reverse=True) and losses[-1] < losses[0] - 0.05


def test_first_splits_by_hand(train, fitted):
    rows = train.select(vector_to_array("features").alias("x"), "delay_level", "weight").collect()
    x, y, w = (np.array([r[i] for r in rows]) for i in range(3))
    for c, tree in enumerate(fitted.rounds[DEEP][0]):
        g, h = np.rint((0.25 - (y == c)) * w * 2**20) / 2**20, np.rint(0.375 * w * 2**20) / 2**20
        best = (-1.0,)
        for place in range(x.shape[1]):
            cuts = fitted.bins.cuts[place] if place in fitted.bins.numbers else [0.5]
            assert set(cuts) <= set(x[:, place]) | {0.5}
            for t in cuts:
                left = x[:, place] <= t
                if min(h[left].sum(), h[~left].sum()) >= 1:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                    best = max(best, (gain, -place, t))
        place, threshold = fitted.bins.split(int(tree.cell[0]))
        assert tree.gain[0] == pytest.approx(best[0]) and place == -best[1]


def test_probabilities_are_those_of_the_fit(train, fitted):
    """Vectors scored by thresholds get what their cells got."""
    rows = train.select(vector_to_array("features").alias("x")).limit(300).collect()
    cells = fitted.bins.of(np.array([r.x for r in rows]))
    columns = boosting._columns(cells, fitted.bins)
    scores = np.zeros((len(rows), 4))
    for trees in fitted.rounds[DEEP]:
        for c, tree in enumerate(trees):
            scores[:, c] += tree.scores(columns, fitted.bins)
    got = fitted.model(DEEP).transform(train.limit(300)).select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert np.allclose(np.array([r.p for r in got]), boosting.softmax(scores))
    assert [r.prediction for r in got] == boosting.softmax(scores).argmax(axis=1).tolist()


def test_save_and_load(train, fitted, tmp_path):
    PipelineModel([fitted.model(FLAT)]).write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    one, other = (scoring.score(m, train.limit(50)).select("prob").collect() for m in (fitted.model(FLAT), loaded))
    assert one == other


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, delay_level int, weight double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(df)


def test_missing_numbers_go_beyond_every_split(spark):
    rows = [(float(i), None if i % 2 else 1.0, i % 2, 1.0) for i in range(60)]
    model = models.fit_boosted(vectors(spark, rows), 5, 2, 0.5)
    assert {r["class"] for r in scoring.score(model, vectors(spark, rows[1::2])).collect()} == {1}
    assert model.featureImportances.argmax() == 1


def test_nothing_to_split(spark):
    alike = vectors(spark, [(1.0, 2.0, i % 4, 1.0) for i in range(40)])
    model = models.fit_boosted(alike, 3, 3, 0.1)
    assert scoring.score(model, alike).head().prob == pytest.approx([0.25] * 4)
    assert not model.featureImportances.any()
    none = models.fit_boosted(alike.limit(0), 2, 2, 0.1)
    assert scoring.score(none, alike).head().prob == pytest.approx([0.25] * 4)


def test_grid(train, flights):
    grid = {"learning_rate": (0.1, 0.3), "max_depth": (2, 3), "n_estimators": (1, 3)}
    tuned = models.boosted_grid_fit(train, train, grid)
    rows = {(r.learning_rate, r.max_depth, r.n_estimators): r for r in tuned.results.collect()}
    assert len(rows) == 8 and all(r.error is None for r in rows.values())
    assert [r.config for r in sorted(rows.values(), key=lambda r: (r.learning_rate, r.max_depth, r.n_estimators))] == list(range(8))
    alone = models.fit_boosted(train, 3, 3, 0.3)
    assert alone.getOrDefault("trees") == tuned.models[rows[0.3, 3, 3].config].getOrDefault("trees")


def test_few_rows_are_boosted_by_a_task_for_many_rounds(train, fitted, monkeypatch):
    """No job for a round or a level: two for five rounds of both settings, whose scores are written in between."""
    monkeypatch.setattr(boosting, "_grow", lambda *args: pytest.fail("a job for a round"))
    monkeypatch.setattr(boosting, "ROUNDS_PER_TASK", 3)
    again = boost(train.repartition(3), [FLAT, DEEP], 5, *ARGS)
    assert same(again.rounds[DEEP], fitted.rounds[DEEP][:5]) and same(again.rounds[FLAT], fitted.rounds[FLAT][:5])


def test_of_two_children_one_is_summed_up(train, fitted, monkeypatch):
    """The other has what is left of their parent; leaves at the bottom have their sums from there."""
    asked, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *args: asked.append(args[2]) or level(*args))
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", 2)
    again = boost(train.repartition(3), [DEEP], 3, *ARGS, local_rows=0)
    assert same(again.rounds[DEEP], fitted.rounds[DEEP][:3])
    assert len(asked) == 3 * 4  # a job for each level that can be split
    below = [node for level in asked for _, node in level if node > 1]
    assert below and all(len({(t, node // 2) for t, node in level}) == len(level) for level in asked)


def test_sums_of_joint_columns():
    """By hand, for flags that stand in two columns, rows without flags and parts of few rows."""
    rng = np.random.default_rng(3)
    bins = boosting.Bins(7, (0, 1), ((1.0, 2.0, 3.0), (5.0,)))
    cells = np.full((500, 4), -1, np.int16)
    cells[:, 0], cells[:, 1] = rng.integers(0, 4, 500), rng.integers(4, 6, 500)
    cells[:, 2] = rng.choice([6, 7, 8, -1], 500)
    cells[:, 3] = np.where(cells[:, 2] >= 0, rng.choice([9, 10, -1], 500), -1)
    rows, value = boosting.Rows(boosting._columns(cells, bins), bins), rng.integers(-9, 9, 500).astype(float)
    assert [len(members) for _, members, _ in rows.joint] == [4]
    for parts in ([np.arange(500)], [np.arange(0, 300), np.arange(300, 303), np.arange(303, 500)], np.split(np.arange(500), 250)):
        by_cell, by_part = rows.sums(parts, [value, None])
        for i, part in enumerate(parts):
            assert by_part[:, i].tolist() == [value[part].sum(), len(part)]
            for c in range(bins.cells):
                here = part[(cells[part] == c).any(axis=1)]
                assert by_cell[:, i, c].tolist() == [value[here].sum(), len(here)]
