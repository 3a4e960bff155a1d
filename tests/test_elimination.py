from datetime import date, timedelta

import numpy as np
import pytest

from panelspark.operators import models as M
from panelspark.operators.elimination import EliminationModel, RecursiveElimination

DAY0 = date(2020, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    return [(DAY0 + timedelta(days=i), *map(float, v), float(10 * v[0] + rng.normal() * 0.1)) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "fecha date, good double, n1 double, n2 double, n3 double, y double")


def eliminate(**more):
    return RecursiveElimination(labelCol="y", features=["good", "n1", "n2", "n3"], step=1, numTrees=5, maxDepth=5, **more)


def test_keeps_the_informative_column_and_predicts(spark, rows, tmp_path):
    df = frame(spark, rows)
    model = eliminate().fit(df)
    table = {t[0]: t for t in model.table}
    assert sorted(table) == [1, 2, 3, 4] and all(t[1] == 3 for t in table.values()) and "good" in model.selected
    assert model.best_size == max(table.values(), key=lambda t: (t[2], -t[0]))[0]
    assert model.importances(spark).first().feature == "good" and model.importances(spark).count() == model.best_size
    shown = model.transform(df).select("fecha", "prediction").orderBy("fecha").collect()
    assert np.corrcoef([r.prediction for r in shown], [r[-1] for r in rows])[0, 1] > 0.95
    model.save(str(tmp_path / "kept"))
    again = EliminationModel.load(str(tmp_path / "kept"))
    assert (again.selected, again.table, again.uid) == (model.selected, model.table, model.uid) and again.getLabelCol() == "y"
    assert again.transform(df).select("fecha", "prediction").orderBy("fecha").collect() == shown
    model.write().overwrite().save(str(tmp_path / "kept"))
    how = eliminate(folds=2, horizon=9)
    how.save(str(tmp_path / "how"))
    assert RecursiveElimination.load(str(tmp_path / "how")).extractParamMap() and RecursiveElimination.load(str(tmp_path / "how")).getOrDefault("horizon") == 9


def test_a_fold_without_spread_is_left_out(spark, rows):
    """The target stands still in the last week, so only two folds have a score."""
    still = [(*r[:-1], 3.0) if i >= 83 else r for i, r in enumerate(rows)]
    model = eliminate().fit(frame(spark, still))
    assert {t[1] for t in model.table} == {2} and all(t[2] == t[2] for t in model.table)
    flat = eliminate().fit(frame(spark, [(*r[:-1], 3.0) for r in rows]))
    assert {t[1:] for t in flat.table} == {(0, None)} and flat.best_size == 4


def test_missing_features(spark, rows):
    holed = frame(spark, [(r[0], None if i % 9 == 0 else r[1], *r[2:]) for i, r in enumerate(rows)])
    with pytest.raises(Exception):
        eliminate().fit(holed)
    model = eliminate(handleInvalid="skip").fit(holed)
    assert model.skipped == 10 == M.incomplete(holed, ["good", "n1"])
    with pytest.raises(Exception):
        M.linear(holed, "y", ["good"])
    assert M.predict(M.linear(holed, "y", ["good"], invalid="skip"), holed).count() == 80


def test_folds_side_by_side_give_the_same(spark, rows):
    df = frame(spark, rows)
    one, three = (eliminate(parallelism=n, bootstrap=False).fit(df) for n in (1, 3))
    assert one.selected == three.selected and np.allclose([t[2] for t in one.table], [t[2] for t in three.table])


def test_components_are_fitted_once(spark, rows):
    df = frame(spark, rows)
    model = M.pca_forest(df, "y", ["good", "n1", "n2", "n3"], share=0.6, trees=3, depth=3)
    kinds = [type(s).__name__ for s in model.stages]
    assert kinds.count("PCAModel") == 1 and 1 <= len(model.stages[3].getIndices()) < 4
    assert set(M.predict(model, df).columns) == {*df.columns, "prediction"}
