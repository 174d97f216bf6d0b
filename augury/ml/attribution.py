"""How much each feature contributes to a model's scores."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from augury import schemas
from augury.ml.additive import Additive
from augury.ml.boosting import Boosted
from augury.ml.forests import Forest
from augury.ml.models import assemble_features, score
from augury.operators.joins import cross_scalar
from augury.operators.labels import numbered
from augury.operators.metrics import rank_metrics
from augury.session import materialise


def linear_attribution(model: PipelineModel | Additive, rows: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean absolute contribution coefficient x (value - mean) per feature, exact for a linear model."""
    cols = cols or schemas.FEATURES
    if isinstance(model, Additive) and model.kind == "logistic":
        raw, mean = model.values["raw"], model.values["mean"]
        parts = [F.struct(F.lit(c).alias("feature"), F.abs((F.col(c) - mean[j]) * raw[j]).alias("part")) for j, c in enumerate(model.cols)]
        return rows.select(F.inline(F.array(*parts))).groupBy("feature").agg(F.avg("part").alias("mean_abs_contribution"))
    linear = None if isinstance(model, Additive) else model.stages[-1]
    if not isinstance(linear, LogisticRegressionModel):
        raise TypeError("the last stage is not a linear model; use permutation_attribution")
    scaled = model.stages[0].transform(rows).select(vector_to_array("scaled").alias("x"))
    parts = [
        F.struct(F.lit(c).alias("feature"), F.abs(F.col("x")[i] * float(linear.coefficients[i])).alias("part"))
        for i, c in enumerate(cols)
    ]
    return scaled.select(F.inline(F.array(*parts))).groupBy("feature").agg(F.avg("part").alias("mean_abs_contribution"))


def permutation_attribution(model, rows: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Loss of the area under the curve when one feature is shuffled among the rows.

    All shuffled variants are scored in one pass: every row gets the features of a partner row, and is scored once
    per feature with only that one exchanged.
    """
    cols = cols or schemas.FEATURES
    base = rows.select("address", schemas.LABEL, *cols)
    here = materialise(numbered(base, ["address"], "_rn"), "rows")
    drawn = base.select(F.md5("address").alias("_draw"), "address", F.struct(*cols).alias("_partner"))
    partners = numbered(drawn, ["_draw", "address"], "_rn").select("_rn", "_partner")
    variants = here.join(partners, "_rn").select(
        "*", F.explode(F.array(F.lit(""), *[F.lit(c) for c in cols])).alias("feature")
    )
    exchanged = {c: F.when(F.col("feature") == c, F.col(f"_partner.{c}")).otherwise(F.col(c)) for c in cols}
    table = variants.withColumns(exchanged).drop("_partner", "_rn")
    scored = score(model, assemble_features(table, cols)).withColumn("actual_label", F.col(schemas.LABEL))
    areas = materialise(rank_metrics(scored.select("feature", "actual_label", "predicted_probability"), ["feature"]), "areas")
    whole = areas.where("feature = ''").select(F.col("auc_roc").alias("_whole"))
    return cross_scalar(areas.where("feature <> ''"), whole).select(
        "feature", (F.col("_whole") - F.col("auc_roc")).alias("auc_loss")
    )


def feature_attribution(model: PipelineModel | Additive, rows: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Features with their importance, the most important first: exact for linear models, by permutation for others."""
    if model.kind == "logistic" if isinstance(model, (Additive, Forest, Boosted)) else isinstance(model.stages[-1], LogisticRegressionModel):
        result = linear_attribution(model, assemble_features(rows, cols), cols).withColumnRenamed(
            "mean_abs_contribution", "importance"
        )
    else:
        result = permutation_attribution(model, rows, cols).withColumnRenamed("auc_loss", "importance")
    return result.orderBy(F.desc("importance"), "feature")
