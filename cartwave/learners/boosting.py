"""AdaBoost: stumps for classes, rounds of weighted Spark trees for amounts.

Of the trees only the row weights change between rounds.  They are written to the shared folder
every few rounds, so the plan stays short and a lost executor re-reads them; the rows of earlier
rounds are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

from cartwave.learners import multiclass as mc
from cartwave.session import cut, delete, stored

CUT_EVERY = 5
_TINY = 1e-10


@dataclass
class BoostedClassifierModel:
    """Weighted vote of the stumps: ``score`` is their sum, prediction is 0 or 1."""

    quantiles: mc.Quantiles
    stumps: list[mc.Stump]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_x", vector_to_array("features"))
        out = out.withColumn("_bins", self.quantiles.bins_of([F.col("_x")[i] for i in range(len(self.quantiles.cuts))]))
        votes = [
            F.when(F.col("_bins")[s.feature] <= s.bin, F.lit(s.alpha * (2 * s.left - 1))).otherwise(F.lit(s.alpha * (2 * s.right - 1)))
            for s in self.stumps
        ]
        score = sum(votes, F.lit(0.0))
        out = out.withColumn("score", score).withColumn("prediction", (F.col("score") > 0).cast("double"))
        return out.drop("_x", "_bins")


@dataclass
class BoostedClassifier:
    """SAMME on decision stumps for a 0/1 target; features are cut at their quantiles.

    Rows are binned and stored once; a round is one job that sums their weights per (feature, bin, class).
    """

    rounds: int = 50
    learning_rate: float = 1.0

    def fit(self, df: DataFrame) -> BoostedClassifierModel:
        return self._fit(df, [F.lit(True)])[0]

    def fit_folds(self, df: DataFrame, folds: int) -> list[BoostedClassifierModel]:
        """A model per ``fold``, of all other folds' rows, in the same jobs; cuts come from all rows, without their targets."""
        return self._fit(df, [F.col("fold") != f for f in range(folds)])

    def _fit(self, df: DataFrame, trains: list) -> list[BoostedClassifierModel]:
        rows = cut(df.select(vector_to_array("features").alias("x"), F.col("target").cast("int").alias("class"), F.array(*trains).alias("trains")))
        first = rows.select(F.size("x").alias("n")).first()
        features = [F.col("x")[i] for i in range(first["n"] if first else 0)]
        quantiles = mc.quantiles_of(rows, features)
        binned = cut(rows.select("class", quantiles.bins_of(features).alias("bins"), "trains"))
        return [BoostedClassifierModel(quantiles, s) for s in mc.boost_stumps(binned, 2, len(trains), self.rounds, self.learning_rate)]


@dataclass
class BoostedRegressorModel:
    """Weighted median of the rounds."""

    rounds: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (model, _) in enumerate(self.rounds):
            out = model.copy().setPredictionCol(f"_p{i}").transform(out)
        votes = F.sort_array(
            F.array(
                *[
                    F.struct(F.col(f"_p{i}").alias("p"), F.lit(weight).alias("w"))
                    for i, (_, weight) in enumerate(self.rounds)
                ]
            )
        )
        half = sum(w for _, w in self.rounds) / 2
        out = out.withColumn("_v", votes).withColumn(
            "prediction",
            F.expr(
                "aggregate(_v, named_struct('s', 0D, 'p', cast(null as double)), (a, v) -> "
                f"named_struct('s', a.s + v.w, 'p', case when a.p is null and a.s + v.w >= {half!r}D "
                "then v.p else a.p end), a -> a.p)"
            ),
        )
        return out.drop("_v", *[f"_p{i}" for i in range(len(self.rounds))])


@dataclass
class BoostedRegressor:
    """AdaBoost.R2 with linear loss on shallow regression trees."""

    rounds: int = 60
    depth: int = 2
    seed: int = 0

    def fit(self, df: DataFrame) -> BoostedRegressorModel:
        rows, path = stored(df.select("features", "target").withColumn("_w", F.lit(1.0)))
        done = []
        for i in range(self.rounds):
            tree = DecisionTreeRegressor(
                labelCol="target", weightCol="_w", maxDepth=self.depth, seed=self.seed + i
            ).fit(rows)
            scored = tree.transform(rows).withColumn(
                "_e", F.abs(F.col("prediction") - F.col("target"))
            )
            sums = scored.agg(
                F.max("_e").alias("top"),
                F.sum(F.col("_w") * F.col("_e")).alias("lost"),
                F.sum("_w").alias("all"),
            ).first()
            if sums["top"] <= _TINY:
                done.append((tree, 1.0))
                break
            loss = sums["lost"] / sums["top"] / sums["all"]
            if loss >= 0.5:
                if not done:
                    done.append((tree, 1.0))
                break
            beta = max(loss, _TINY) / (1 - loss)
            done.append((tree, log(1 / beta)))
            rows = scored.select(
                "features",
                "target",
                (
                    F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / F.lit(sums["top"]))
                    / F.lit(beta)
                ).alias("_w"),
            )
            if (i + 1) % CUT_EVERY == 0:
                old = path
                rows, path = stored(rows)
                delete(df.sparkSession, old)
        delete(df.sparkSession, path)
        return BoostedRegressorModel(done)
