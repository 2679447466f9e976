"""Decision trees over pattern scores and their translation to rules."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.sampling import stratified_folds
from tracemill.session import durable, shared_folder

# The depth grid, fold count and seed of the grid search.
DEPTHS = (2, 3, 4, 6, 8, 10)
FOLDS = 3
SEED = 42


def with_vector(rows: DataFrame) -> DataFrame:
    """Adds the feature vector of ``scores``; without any pattern it is a constant, which no tree splits."""
    scores = F.when(F.size("scores") == 0, F.array(F.lit(0))).otherwise(F.col("scores"))
    return rows.withColumn("features", array_to_vector(scores.cast("array<double>")))


def _stages(rows: DataFrame, label: str):
    """Indexer, tree and label decoder. Enough bins to try every cut between whole scores."""
    top = rows.agg(F.max(F.array_max("scores"))).first()[0] or 0
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")
    indexed = indexer.fit(rows)
    tree = DecisionTreeClassifier(
        labelCol="label_index", featuresCol="features", impurity="gini", seed=SEED, maxBins=max(32, int(top) + 2)
    )
    decoder = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexed.labels)
    return indexed, tree, decoder


def grid_search(
    rows: DataFrame, label: str = "label", name: str = "trace_id", depths: Sequence[int] = DEPTHS, parallelism: int = 6
) -> CrossValidatorModel:
    """Picks the depth with the best weighted F1 over stratified folds.

    The folds are stored once; every fit reads the same rows.
    """
    folded = durable(with_vector(stratified_folds(rows, label, name, FOLDS, SEED)))
    indexed, tree, decoder = _stages(folded, label)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    evaluator = MulticlassClassificationEvaluator(
        labelCol="label_index", predictionCol="prediction", metricName="f1"
    )
    search = CrossValidator(
        estimator=Pipeline(stages=[indexed, tree, decoder]),
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=FOLDS,
        foldCol="fold",
        seed=SEED,
        parallelism=parallelism,
    )
    return search.fit(folded)


def grid_report(search: CrossValidatorModel, spark: SparkSession, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """``(max_depth, f1, chosen)`` of a finished search."""
    scores = [float(m) for m in search.avgMetrics]
    best = scores.index(max(scores))
    rows = [(int(d), m, i == best) for i, (d, m) in enumerate(zip(depths, scores, strict=True))]
    return spark.createDataFrame(rows, "max_depth int, f1 double, chosen boolean")


def fit_tree(rows: DataFrame, depth: int, label: str = "label") -> PipelineModel:
    """A single tree of at most ``depth`` levels."""
    prepared = with_vector(rows)
    indexed, tree, decoder = _stages(prepared, label)
    return Pipeline(stages=[indexed, tree.setMaxDepth(depth), decoder]).fit(prepared)


def predict(model: PipelineModel, rows: DataFrame, label: str = "label", name: str = "trace_id") -> DataFrame:
    """``(filename, true_label, predicted_label)``."""
    return model.transform(with_vector(rows)).select(
        F.col(name).alias("filename"), F.col(label).alias("true_label"), F.col("predicted").alias("predicted_label")
    )


def tree_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Node table ``(node, left_node, right_node, pattern_id, threshold, cls)``; read from the saved model."""
    tree = next(s for s in model.stages if isinstance(s, DecisionTreeClassificationModel))
    decoder = next(s for s in model.stages if isinstance(s, IndexToString))
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    tree.write().overwrite().save(path)
    labels = F.array(*[F.lit(x) for x in decoder.getLabels()])
    return spark.read.parquet(f"{path}/data").select(
        F.col("id").alias("node"),
        F.col("leftChild").alias("left_node"),
        F.col("rightChild").alias("right_node"),
        (F.col("split.featureIndex") + 1).cast("long").alias("pattern_id"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.get(labels, F.col("prediction").cast("int")).alias("cls"),
    )


def tree_rules(nodes: DataFrame, depth: int) -> DataFrame:
    """One rule per leaf: ``(cls, rule_id, conditions)``, the conditions on the way from the root.

    Level by level, the inner nodes reached so far are joined to their children. A tree has at
    most ``2 ** (depth + 1)`` nodes.
    """
    stored = durable(nodes)
    to_child = stored.select(F.col("node").alias("__child"), *[c for c in stored.columns if c != "node"])
    no_conditions = F.array().cast("array<struct<pattern_id:bigint,op:string,value:double>>")
    level = stored.where("node = 0").withColumn("conditions", no_conditions)
    leaves = level.where("left_node < 0")
    for _ in range(depth):
        inner = level.where("left_node >= 0")

        def step(op: str):
            return F.array(F.struct("pattern_id", F.lit(op).alias("op"), F.col("threshold").alias("value")))

        branches = inner.select(
            F.inline(
                F.array(
                    F.struct(F.col("left_node").alias("__child"), F.concat("conditions", step("<=")).alias("conditions")),
                    F.struct(F.col("right_node").alias("__child"), F.concat("conditions", step(">")).alias("conditions")),
                )
            )
        )
        level = branches.join(to_child, "__child").withColumnRenamed("__child", "node")
        leaves = leaves.unionByName(level.where("left_node < 0"))
    return leaves.select("cls", F.col("node").cast("long").alias("rule_id"), "conditions")


def rule_conditions(rules: DataFrame) -> DataFrame:
    """Rules in long form ``(cls, rule_id, pattern_id, op, value)``; a rule without conditions keeps one NULL row."""
    return rules.select("cls", "rule_id", F.explode_outer("conditions").alias("c")).select(
        "cls", "rule_id", "c.pattern_id", "c.op", "c.value"
    )
