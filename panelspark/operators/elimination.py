"""Recursive feature elimination over time folds as an estimator of ``pyspark.ml``."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasLabelCol, HasParallelism, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.models import DEPTH_LIMIT, forest, incomplete
from panelspark.operators.search import time_folds
from panelspark.session import stage


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _EliminationParams(HasLabelCol, HasSeed, HasParallelism, HasHandleInvalid):
    features = _param("features", "columns to choose from", TypeConverters.toListString)
    dateCol = _param("dateCol", "day of a row", TypeConverters.toString)
    folds = _param("folds", "expanding folds", TypeConverters.toInt)
    horizon = _param("horizon", "days that a fold tests", TypeConverters.toInt)
    step = _param("step", "features dropped at a time", TypeConverters.toInt)
    minimum = _param("minimum", "features that stay at least", TypeConverters.toInt)
    numTrees = _param("numTrees", "trees of a forest", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "levels of a tree", TypeConverters.toInt)
    maxBins = _param("maxBins", "bins of a feature", TypeConverters.toInt)
    bootstrap = _param("bootstrap", "whether trees draw their rows", TypeConverters.toBoolean)

    def _rank(self, rows: DataFrame, cols: list[str]) -> tuple[PipelineModel, list[str]]:
        """A forest on ``cols`` and the columns from the least to the most important, ties by name."""
        get = lambda p: self.getOrDefault(p)
        model = forest(rows, get(self.labelCol), cols, get(self.numTrees), get(self.maxDepth), get(self.seed), get(self.bootstrap), get(self.maxBins), get(self.handleInvalid))
        weights = model.stages[-1].featureImportances.toArray()
        return model, [c for _, c in sorted(zip(weights, cols), key=lambda x: (x[0], x[1]))]

    def _fewer(self, ranked: list[str], cols: list[str], size: int) -> list[str]:
        kept = set(ranked[len(ranked) - size:])
        return [c for c in cols if c in kept]


class RecursiveElimination(Estimator, _EliminationParams, DefaultParamsReadable, DefaultParamsWritable):
    """Drops the weakest ``step`` features of a forest again and again, and keeps the number that predicts best.

    Every fold trains on the days before its test days. The folds run side by side, ``parallelism`` at a time, over
    one staged table. The score of a size is the mean R2 of the folds in which R2 is defined; a fold whose target
    does not vary has none. The best size, the smaller one of equals, is then reached on all rows; without any score
    all features stay. NULL features are an error, or with ``handleInvalid='skip'`` left out and counted.
    """

    def __init__(self, **params):
        super().__init__()
        self._setDefault(labelCol="label", dateCol="fecha", folds=3, horizon=7, step=50, minimum=1, numTrees=100, maxDepth=DEPTH_LIMIT, maxBins=32,
                         bootstrap=True, seed=42, parallelism=3, handleInvalid="error")
        self._set(**params)

    def setParams(self, **params) -> "RecursiveElimination":
        return self._set(**params)

    def _path(self, train: DataFrame, test: DataFrame) -> list[tuple[int, float | None]]:
        """(number of features, R2 on the test rows or None) down to the minimum."""
        y, cols, out = F.col(f"`{self.getOrDefault(self.labelCol)}`"), list(self.getOrDefault(self.features)), []
        least, step = self.getOrDefault(self.minimum), self.getOrDefault(self.step)
        while True:
            model, ranked = self._rank(train, cols)
            error = y - F.col("prediction")
            score = model.transform(test).agg(1 - F.try_divide(F.avg(error * error), F.var_pop(y))).first()[0]
            out.append((len(cols), score if score is not None and score == score else None))
            if len(cols) <= least:
                return out
            cols = self._fewer(ranked, cols, max(len(cols) - step, least))

    def _fit(self, dataset: DataFrame) -> "EliminationModel":
        rows = self._staged(dataset)
        bounds = time_folds(rows, self.getOrDefault(self.dateCol), self.getOrDefault(self.folds), self.getOrDefault(self.horizon)).orderBy("fold").collect()
        return self.fit_folds(rows, [(b.train_to, b.test_from, b.test_to) for b in bounds])  # one row per fold

    def _staged(self, dataset: DataFrame) -> DataFrame:
        wanted = [self.getOrDefault(self.dateCol), self.getOrDefault(self.labelCol), *self.getOrDefault(self.features)]
        return stage(dataset.select(*[F.col(f"`{c}`") for c in dict.fromkeys(wanted)]), "elimination")

    def fit_folds(self, rows: DataFrame, bounds: list[tuple]) -> "EliminationModel":
        """Fit with given folds (train to, test from, test to). ``rows`` are read many times."""
        get = lambda p: self.getOrDefault(p)
        names, when = list(get(self.features)), F.col(f"`{get(self.dateCol)}`")
        pairs = [(rows.where(when <= until), rows.where(when.between(first, last))) for until, first, last in bounds]
        pool = ThreadPool(max(1, min(get(self.parallelism), len(pairs))))
        try:
            paths = pool.map(inheritable_thread_target(rows.sparkSession)(lambda p: self._path(*p)), pairs)
        finally:
            pool.close()
        scores: dict[int, list[float]] = {}
        for size, score in (s for path in paths for s in path):
            scores.setdefault(size, []).extend([] if score is None else [score])
        table = [(size, len(v), sum(v) / len(v) if v else None) for size, v in sorted(scores.items())]
        known = [(r2, -size) for size, _, r2 in table if r2 is not None]
        best = -max(known)[1] if known else len(names)
        cols = names
        while True:
            model, ranked = self._rank(rows, cols)
            if len(cols) <= best:
                break
            cols = self._fewer(ranked, cols, max(len(cols) - get(self.step), best))
        skipped = incomplete(rows, names) if get(self.handleInvalid) == "skip" else 0
        return self._copyValues(EliminationModel(model, cols, table, skipped))


class EliminationModel(Model, _EliminationParams):
    """The forest on the chosen features (``selected``), the scores by size (``table``) and how many rows were skipped."""

    def __init__(self, model: PipelineModel, selected: list[str], table: list[tuple], skipped: int = 0):
        super().__init__()
        self.model, self.selected, self.table, self.skipped = model, list(selected), [tuple(t) for t in table], skipped

    @property
    def best_size(self) -> int:
        return len(self.selected)

    def scores(self, spark) -> DataFrame:
        """One row per size: ``n_features``, folds with a defined score, their mean ``r2``."""
        return spark.createDataFrame(self.table, "n_features int, folds int, r2 double")

    def importances(self, spark) -> DataFrame:
        """The chosen features by importance."""
        weights = self.model.stages[-1].featureImportances.toArray()
        return spark.createDataFrame([(c, float(w)) for c, w in zip(self.selected, weights)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset).drop("_features")

    def write(self) -> "_EliminationWriter":
        return _EliminationWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> "_EliminationReader":
        return _EliminationReader()

    @classmethod
    def load(cls, path: str) -> "EliminationModel":
        return cls.read().load(path)


class _EliminationWriter(MLWriter):
    def __init__(self, instance: EliminationModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        own = {"selected": self.instance.selected, "table": self.instance.table, "skipped": self.instance.skipped}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=own)
        self.instance.model.write().save(f"{path}/model")


class _EliminationReader(MLReader):
    def load(self, path: str) -> EliminationModel:
        own = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = EliminationModel(PipelineModel.load(f"{path}/model"), own["selected"], own["table"], own["skipped"])
        out._resetUid(own["uid"])
        DefaultParamsReader.getAndSetParams(out, own)
        return out
