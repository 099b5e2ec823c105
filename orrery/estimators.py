"""Estimators: fit(df) gives a model with transform(df); parameters are read and set by name."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import frame_objectives as W
from .functions import objectives as O
from .operators.tree import bin_edges
from .plans.boosting import Booster, Params


class Configured:
    """get_params, set_params and clone over the arguments an estimator was made with."""

    def get_params(self) -> dict:
        defaults = {f.name: f.default if f.default is not dataclasses.MISSING else f.default_factory() for f in dataclasses.fields(Params)}
        return defaults | self.given

    def set_params(self, **changes):
        self.__init__(**self.given | changes)
        return self

    def clone(self, **changes):
        return type(self)(**self.given | changes)


class Regressor(Configured):
    objective, options = "mse", {}

    def __init__(self, features: list[str], label: str = "label", row: str = "row_id", era: str | None = None, order: str | None = None, objective: str | O.Objective | None = None, objective_options: dict | None = None, **params):
        self.given = {"features": features, "label": label, "row": row, "era": era, "order": order, **({"objective": objective} if objective else {}), **({"objective_options": objective_options} if objective_options else {}), **params}
        chosen = objective or self.objective
        if isinstance(chosen, str) and chosen not in O.ROWWISE:
            raise ValueError(f"objective must be one of {sorted(O.ROWWISE)} or an Objective")
        self.chosen = chosen if isinstance(chosen, O.Objective) else O.ROWWISE[chosen](**(objective_options or self.options))
        self.args = {"features": features, "label": label, "row": row, "era": era, "order": order}
        self.params = Params(**params)

    def fit(self, df: DataFrame, valid: DataFrame | None = None) -> Booster:
        return Booster(self.params, self.chosen, **self.args).fit(df, valid)


class BinaryClassifier(Regressor):
    objective = "binary_logloss"


class QuantileRegressor(Regressor):
    objective, options = "quantile", {"alpha": 0.5}


class Ranker(Regressor):
    """LambdaRank: the label is the relevance within a group."""

    def __init__(self, features: list[str], group: str, sigma: float = 1.0, **args):
        super().__init__(features, objective=W.lambdarank(group, sigma), **args)
        self.given = {"features": features, "group": group, "sigma": sigma, **args}


class Survival(Regressor):
    """Cox proportional hazards: the label is the time; `prediction` is the hazard."""

    def __init__(self, features: list[str], event: str, **args):
        super().__init__(features, objective=W.cox(event), **args)
        self.given = {"features": features, "event": event, **args}


class MultiTargetRegressor(Regressor):
    """The label's share of the gradient is alpha, or goes from alpha_start to alpha over the rounds."""

    def __init__(self, features: list[str], aux: list[str], alpha: float = 0.7, alpha_start: float | None = None, power: float = 1.0, base: str = "mse", base_options: dict | None = None, **args):
        super().__init__(features, objective=W.several(O.ROWWISE[base](**(base_options or {})), aux, alpha, alpha_start, power), **args)
        self.given = {"features": features, "aux": aux, "alpha": alpha, "alpha_start": alpha_start, "power": power, "base": base, "base_options": base_options, **args}


class RankRegressor(Regressor):
    """Learns the label's rank; `objective` is spearman, max_sharpe (needs eras) or neutral."""

    def __init__(self, features: list[str], objective: str = "spearman", **args):
        made = {"spearman": W.spearman, "max_sharpe": W.max_sharpe, "neutral": lambda: W.neutral(len(features))}[objective]()
        if objective == "max_sharpe" and not args.get("era"):
            raise ValueError("max_sharpe needs an era column")
        super().__init__(features, objective=made, **args)
        self.given = {"features": features, "objective": objective, **args}

    def fit(self, df: DataFrame, valid: DataFrame | None = None) -> Booster:
        label, row = self.args["label"], self.args["row"]
        ranked = lambda x: W.rank_target(x, label, row, "_target").drop(label).withColumnRenamed("_target", label)
        return super().fit(ranked(df), ranked(valid) if valid is not None else None)


class Classifier(Configured):
    """One model per class, softmax over their raw scores; two classes make one model."""

    def __init__(self, max_classes: int = 1000, **args):
        self.given = {"max_classes": max_classes, **args}
        self.max_classes, self.args = max_classes, args

    def fit(self, df: DataFrame, valid: DataFrame | None = None) -> "ClassifierModel":
        label = self.args.get("label", "label")
        classes = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(self.max_classes + 1).collect()]
        if len(classes) > self.max_classes:
            raise ValueError(f"over {self.max_classes} classes")
        positive = classes[1:] if len(classes) == 2 else classes
        shared = dict(self.args)
        if not shared.get("edges") and not shared.get("categorical"):  # the same for every class
            shared["edges"] = bin_edges(df, shared["features"], shared.get("max_bins", Params.max_bins), shared.get("exact_edges", False))
        one = lambda x, c: x.withColumn(label, (F.col(label) == F.lit(c)).cast("double"))
        return ClassifierModel(classes, [BinaryClassifier(**shared).fit(one(df, c), one(valid, c) if valid is not None else None) for c in positive])


class ClassifierModel:
    def __init__(self, classes, models):
        self.classes, self.models = classes, models

    def transform(self, df: DataFrame) -> DataFrame:
        names = []
        for k, m in enumerate(self.models):
            names.append(f"_raw{k}")
            df = m.raw_score(df, names[-1])
        if len(self.classes) == 2:
            p = O.sigmoid(F.col(names[0]))
            probability = F.array(1 - p, p)
        else:
            probability = O.softmax(F.array(*names))
        out = df.withColumn("probability", probability).drop(*names)
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("prediction", class_at(self.classes, best))

    def importances(self, kind: str = "gain") -> dict[str, float]:
        """The models' shares, summed and scaled to one."""
        sums: dict[str, float] = {}
        for m in self.models:
            for f, v in m.importances(kind).items():
                sums[f] = sums.get(f, 0.0) + v
        total = sum(sums.values()) or 1.0
        return {f: v / total for f, v in sums.items()}


def class_number(classes: list, label: str):
    """The place of a label among the classes, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)), F.lit(0).cast("long")) - 1


def class_at(classes: list, place):
    return F.element_at(F.array(*[F.lit(c) for c in classes]), place)


def set_num_threads(spark: SparkSession, n: int) -> None:
    """Spark's cores are set when it starts; what can change later is how many tasks a shuffle makes."""
    spark.conf.set("spark.sql.shuffle.partitions", str(max(1, n)))


def get_num_threads(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism
