"""Flow classification with a random forest, and the statistics reported over its results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.labels import coerce_number, is_benign, system_threat, threat_bucket
from packetloom.functions.net import flow_protocol

# Rows per progress chunk, classes listed per row, sample size, features in a report.
CHUNK_ROWS = 20_000
TOP_CLASSES = 6
SAMPLE_ROWS = 100
REPORT_FEATURES = 5


@dataclass(frozen=True)
class FlowModel:
    """Fitted pipeline with what is needed to align input: ``kind`` is scaled or bundle (raw features)."""

    name: str
    kind: str
    pipeline: PipelineModel
    features: list[str]
    means: dict[str, float]

    @property
    def forest(self):
        return next(s for s in self.pipeline.stages if hasattr(s, "featureImportances"))

    @property
    def classes(self) -> list[str]:
        return list(next(s for s in self.pipeline.stages if hasattr(s, "labelsArray")).labelsArray[0])

    def save(self, path: str) -> None:
        meta = {"name": self.name, "kind": self.kind, "features": self.features, "means": self.means}
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        _active().createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> FlowModel:
        meta = json.loads(_active().read.text(f"{path}/meta").first()[0])
        return FlowModel(meta["name"], meta["kind"], PipelineModel.load(f"{path}/pipeline"), meta["features"], meta["means"])


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def feature_means(df: DataFrame, features: list[str]) -> DataFrame:
    """One row with the mean of the usable values of every feature."""
    return df.agg(*[F.avg(coerce_number(F.col(c), F.lit(None).cast("double"))).alias(c) for c in features])


def align(df: DataFrame, features: list[str], means: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """The model's features in order: missing columns and unusable values become the mean, extras go."""
    columns = [
        (coerce_number(F.col(c), F.lit(means.get(c, 0.0))) if c in df.columns else F.lit(means.get(c, 0.0))).alias(c)
        for c in features
    ]
    return df.select(*(keep or []), *columns)


def fit_forest(
    df: DataFrame,
    features: list[str],
    label: str,
    *,
    name: str = "flows",
    scaled: bool = True,
    trees: int = 20,
    depth: int = 8,
    seed: int = 7,
) -> FlowModel:
    """Training reads its rows about ten times, so their numbers are parsed once and kept meanwhile."""
    unknown = F.lit(None).cast("double")
    parsed = df.select(label, *[coerce_number(F.col(c), unknown).alias(c) for c in features]).persist(StorageLevel.MEMORY_AND_DISK)
    means = {c: float(v or 0.0) for c, v in feature_means(parsed, features).first().asDict().items()}
    rows = align(parsed, features, means, [label])
    last = "raw_features"
    stages = [StringIndexer(inputCol=label, outputCol="class_index", stringOrderType="alphabetAsc"),
              VectorAssembler(inputCols=features, outputCol=last)]
    if scaled:
        stages.append(StandardScaler(inputCol=last, outputCol="scaled_features", withMean=True, withStd=True))
        last = "scaled_features"
    forest = RandomForestClassifier(
        labelCol="class_index", featuresCol=last, predictionCol="class_no", numTrees=trees, maxDepth=depth, seed=seed
    )
    prepared = None
    try:
        fitted = Pipeline(stages=stages).fit(rows)
        prepared = fitted.transform(rows).select("class_index", last).persist(StorageLevel.MEMORY_AND_DISK)
        grown = forest.fit(prepared)
    finally:
        parsed.unpersist()
        if prepared is not None:
            prepared.unpersist()
    decode = IndexToString(inputCol="class_no", outputCol="prediction", labels=fitted.stages[0].labels)
    pipeline = PipelineModel(stages=[*fitted.stages, grown, decode])
    return FlowModel(name, "scaled" if scaled else "bundle", pipeline, list(features), means)


def _scored(model: FlowModel, df: DataFrame, keep: list[str]) -> DataFrame:
    rows = align(df, model.features, model.means, keep)
    stages = [s for s in model.pipeline.stages if not hasattr(s, "labelsArray")]
    return PipelineModel(stages=stages).transform(rows)


def predict(model: FlowModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Class of every flow, keeping the aligned features."""
    scored = _scored(model, df, keep or [])
    return scored.select(
        *(keep or []), *model.features, "prediction", (~is_benign(F.col("prediction"))).alias("is_attack")
    )


def predict_requests(model: FlowModel, requests: DataFrame, keep: list[str]) -> DataFrame:
    """Class, confidence and the likeliest classes of flows that give only some features."""
    classes = F.array(*[F.lit(c) for c in model.classes])
    scored = _scored(model, requests, keep).withColumn("p", vector_to_array("probability"))
    pairs = F.zip_with("p", classes, lambda p, c: F.struct((-p).alias("order"), c.alias("class"), F.round(p * 100, 2).alias("prob")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, TOP_CLASSES), lambda t: F.struct(t["class"], t["prob"]))
    return scored.select(
        *keep,
        "prediction",
        (~is_benign(F.col("prediction"))).alias("is_attack"),
        F.round(F.array_max("p") * 100, 2).alias("confidence"),
        top.alias("probabilities"),
    )


def catalogue(model: FlowModel) -> DataFrame:
    rows = [(model.name, model.kind, i, c, round(model.means[c], 4)) for i, c in enumerate(model.features)]
    return _active().createDataFrame(rows, "model string, kind string, position int, feature string, default double")


def importances(model: FlowModel, top: int | None = None) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(model.features, model.forest.featureImportances.toArray(), strict=True)]
    out = _active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


# ---------------------------------------------------------------- statistics over predictions


def class_distribution(preds: DataFrame) -> DataFrame:
    counts = preds.groupBy("prediction").agg(F.count("*").alias("count"))
    total = preds.agg(F.count("*").alias("total"))
    out = counts.crossJoin(F.broadcast(total))
    return out.select("prediction", "count", F.round(F.col("count") / F.col("total") * 100, 2).alias("pct")).orderBy(
        F.desc("count"), "prediction"
    )


def totals() -> list[Column]:
    label, bucket = F.col("prediction"), threat_bucket(F.col("prediction"))
    proto = flow_protocol(F.col("protocol"))
    return [
        F.count("*").alias("total_rows"),
        F.count_if(is_benign(label)).alias("benign"),
        *[F.count_if(bucket == level).alias(level.lower()) for level in ("LOW", "MEDIUM", "HIGH", "CRITICAL")],
        *[F.count_if(proto == p).alias(p.lower()) for p in ("TCP", "UDP", "Other")],
        F.sum("flow_duration").alias("sum_duration"),
        F.sum("flow_byts_s").alias("sum_bytes_s"),
    ]


def rated(sums: DataFrame, digits: int = 1) -> DataFrame:
    total, benign = F.col("total_rows"), F.col("benign")
    return (
        sums.withColumn("attacks", total - benign)
        .withColumn("benign_pct", F.round(benign / total * 100, digits))
        .withColumn("attack_pct", F.round((total - benign) / total * 100, digits))
        .withColumn("system_threat", system_threat(total, benign))
        .withColumn("mean_flow_dur", F.round(F.col("sum_duration") / total, 2))
        .withColumn("mean_bandwidth", F.round(F.col("sum_bytes_s") / total, 2))
        .drop("sum_duration", "sum_bytes_s")
    )


def summary(preds: DataFrame) -> DataFrame:
    """One row: totals, threat and protocol counts, mean duration and bandwidth."""
    return rated(preds.agg(*totals()))


def progress(preds: DataFrame, chunk: str, total_rows: int | None = None, block: int = 10_000) -> DataFrame:
    """The summary after each chunk, over all chunks so far; blocks of chunks carry their sums forward."""
    per_chunk = preds.groupBy(chunk).agg(*totals()).withColumn("__b", F.floor(F.col(chunk) / block))
    sums = [c for c in per_chunk.columns if c not in (chunk, "__b")]
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.groupBy("__b").agg(*[F.sum(c).alias(c) for c in sums])
    carry = carry.select("__b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__b").orderBy(chunk).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = per_chunk.join(carry, "__b").select(
        chunk, *[(F.sum(c).over(inside) + F.col(f"__{c}")).alias(c) for c in sums]
    )
    whole = F.lit(total_rows) if total_rows else F.col("total_rows")
    done = F.round(F.least(F.col("total_rows") / whole * 100, F.lit(100.0)), 1)
    return rated(running).withColumn("pct", done)


def sample(preds: DataFrame, order: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """First predictions with a row number; only these rows are numbered."""
    first = preds.orderBy(order).limit(rows)
    return first.withColumn("row", F.row_number().over(Window.orderBy(order)))


def report(preds: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Statistics report as (section, key, value) rows."""
    totals = summary(preds)
    overall = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.cast("string").alias("value"))
                    for s, k, v in (
                        ("totals", "rows", F.col("total_rows")),
                        ("totals", "benign", F.col("benign")),
                        ("totals", "attacks", F.col("attacks")),
                        ("totals", "system threat", F.col("system_threat")),
                        ("statistics", "mean flow duration", F.format_string("%.2f us", F.col("mean_flow_dur"))),
                        ("statistics", "mean bandwidth", F.format_string("%.2f B/s", F.col("mean_bandwidth"))),
                    )
                ]
            )
        ).alias("r")
    ).select("r.*")
    attacks = class_distribution(preds).where(~is_benign(F.col("prediction")))
    listed = attacks.select(
        F.lit("attack types").alias("section"), F.col("prediction").alias("key"), F.col("count").cast("string").alias("value")
    )
    out = overall.unionByName(listed)
    if top is not None:
        out = out.unionByName(
            top.select(
                F.lit("features").alias("section"),
                F.col("feature").alias("key"),
                F.format_string("%.4f", F.col("importance")).alias("value"),
            )
        )
    return out
