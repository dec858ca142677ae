"""M5-M9: training, model selection, scoring and persistence with Spark ML.

The reference fine-tunes a multilingual DistilBERT; no weights ship with it
and no deep-learning runtime is assumed here, so the classifier is a Spark ML
pipeline with the same interface (cleaned text in; class and top probability
out).  Labels will differ from a DistilBERT run; the lexicon path is exact.

* M5 tokenise + encode: whitespace tokens of the whole ``model_clean`` text,
  hashed term frequencies, IDF.  Term counts have no position limit, so no text
  is cut; a network with one can be plugged in behind the scorer interface.
* M6 fit: binomial logistic regression.
* M7 select: the regularisation with the lowest validation log-loss on the
  hash-bucket fold (M4), like "best checkpoint by eval loss".  The features are
  made once and written to the shared folder for all fits.
* M8 score: argmax class and its probability, from the same features.
* M9 save/load: ``PipelineModel`` to the shared checkpoint directory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_clean
from ..session import scratch_path

NUM_FEATURES = 1 << 16
REG_GRID = [0.01, 0.1]


def features() -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="clean_text", outputCol="tokens", pattern=r"\s+", toLowercase=False),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES),
        IDF(inputCol="tf", outputCol="features"),
    ])


def classifier(reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", family="binomial", maxIter=20, regParam=reg)


@dataclass
class Fitted:
    model: PipelineModel
    reg: float
    val_log_loss: float
    val_accuracy: float


def prepare(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("clean_text", model_clean(F.col(text_col))).withColumn("label", F.col("label").cast("double"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.select("label", "features").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fit_select(train: DataFrame, validation: DataFrame, grid: list[float] | None = None) -> Fitted:
    """M6 + M7: fit each regularisation, keep the lowest validation log-loss.

    The loop runs over hyper-parameters (a handful); each fit is a distributed
    job over the written features, each evaluation one aggregation.
    """
    encode = features().fit(train)
    learn, check = _written(encode.transform(train), "train-features"), _written(encode.transform(validation), "val-features")
    best = None
    for reg in grid or REG_GRID:
        model = classifier(reg).fit(learn)
        p = F.greatest(vector_to_array("probability")[F.col("label").cast("int")], F.lit(1e-15))
        loss, accuracy = model.transform(check).agg(
            F.avg(-F.log(p)), F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
        loss = float("inf") if loss is None else loss
        if best is None or loss < best.val_log_loss:
            best = Fitted(PipelineModel([*encode.stages, model]), reg, loss, accuracy)
    return best


def save(model: PipelineModel, path: str) -> None:
    """M9."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_scorer(model: PipelineModel):
    """M8 as a scorer for ``hybrid_label``: class and top probability of the whole text."""
    def score(df: DataFrame) -> DataFrame:
        cols = df.columns
        out = model.transform(df)
        return out.select(*cols, F.col("prediction").cast("int").alias("model_label"),
                          F.array_max(vector_to_array(F.col("probability"))).alias("model_confidence"))

    return score
