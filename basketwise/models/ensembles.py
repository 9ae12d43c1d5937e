"""The fitted ensemble as the last stage of a pipeline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.models.trees import STORED, Ensemble, Layout, as_row, of_row, packed, score_stored


def numbers(column: str) -> Column:
    """The entries of a vector column, as the trees read them."""
    return vector_to_array(F.col(f"`{column}`")).alias("values")


def codes(columns: list[str]) -> Column:
    """The indexes of the coded columns, as the trees read them."""
    return F.array(*[F.col(f"`{c}`").cast("int") for c in columns]).cast("array<int>").alias("codes")


class TreesModel(Model, MLWritable, MLReadable):
    """Adds the sum of the trees as `prediction`, or for a classifier margin, probability and class."""

    def __init__(self, ensemble: Ensemble | None = None, vector: str = "features", coded: list[str] | None = None, classifier: bool = False):
        super().__init__()
        self.ensemble, self.vector, self.coded, self.classifier = ensemble, vector, list(coded or []), classifier
        self._shared = None

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.ensemble.importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.ensemble.stored is not None:
            return self._from_stored(dataset)
        if self._shared is None:
            self._shared = dataset.sparkSession.sparkContext.broadcast(self.ensemble)
        shared = self._shared

        @F.arrow_udf("double")
        def total(values: pa.Array, coded: pa.Array) -> pa.Array:
            ensemble, size = shared.value, len(values)
            if not size:
                return pa.array([], pa.float64())
            rows = ensemble.layout.binned(values.flatten().to_numpy(zero_copy_only=False).reshape(size, -1))
            if ensemble.layout.values:
                rows = np.concatenate([rows.astype(np.int32), coded.flatten().to_numpy(zero_copy_only=False).reshape(size, -1)], 1)
            return pa.array(ensemble.total(rows))

        return self._with_results(dataset, total(numbers(self.vector), codes(self.coded)))

    def _from_stored(self, dataset: DataFrame) -> DataFrame:
        """Scores of trees that are not held here: rows of equal bins have one, which is joined to them."""
        layout = self.ensemble.layout

        @F.arrow_udf("binary")
        def bins(values: pa.Array, coded: pa.Array) -> pa.Array:
            size = len(values)
            if not size:
                return pa.array([], pa.binary())
            return packed(layout, *(part.flatten().to_numpy(zero_copy_only=False).reshape(size, -1) for part in (values, coded)))

        binned = bins(numbers(self.vector), codes(self.coded))
        scores = score_stored(dataset.select(binned.alias("bins")), self.ensemble)
        scores = scores.select(F.col("bins").alias("bins of trees"), F.col("prediction").alias("total of trees"))
        joined = dataset.withColumn("bins of trees", binned).join(scores, "bins of trees", "left").drop("bins of trees")
        return self._with_results(joined, F.col("total of trees")).drop("total of trees")

    def _with_results(self, dataset: DataFrame, found: Column) -> DataFrame:
        if not self.classifier:
            return dataset.withColumn("prediction", found)
        margin = F.col("margin of trees")
        likely = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))
        return (
            dataset.withColumn("margin of trees", found)
            .withColumn("rawPrediction", array_to_vector(F.array(-margin, margin)))
            .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - likely, likely)))
            .withColumn("prediction", (margin > 0).cast("double"))
            .drop("margin of trees")
        )

    def copy(self, extra=None) -> TreesModel:
        return self

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: TreesModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model, found = self.instance, self.instance.ensemble
        notes = {
            "vector": model.vector,
            "coded": model.coded,
            "classifier": model.classifier,
            "cuts": [cut.tolist() for cut in found.layout.cuts],
            "values": found.layout.values,
            "importances": found.importances.tolist(),
            "stored": found.nodes if found.stored is not None else 0,
        }
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, {"trees": notes})
        if found.stored is not None:
            found.stored.write.parquet(f"{path}/trees")
            return
        rows = [as_row(i, tree, weight) for i, (tree, weight) in enumerate(zip(found.trees, found.weights))]
        self.sparkSession.createDataFrame(rows, STORED).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> TreesModel:
        notes = DefaultParamsReader.loadMetadata(path, self.sparkSession)["trees"]
        layout, shares = Layout([np.array(cut, float) for cut in notes["cuts"]], notes["values"]), np.array(notes["importances"])
        stored = self.sparkSession.read.schema(STORED).parquet(f"{path}/trees")
        if notes.get("stored"):
            found = Ensemble(layout, [], [], shares, stored, notes["stored"])
        else:
            rows = sorted(stored.collect(), key=lambda row: row["tree"])
            found = Ensemble(layout, [of_row(row) for row in rows], [row["weight"] for row in rows], shares)
        return TreesModel(found, notes["vector"], notes["coded"], notes["classifier"])
