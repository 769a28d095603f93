"""Layout learning and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ValidationError


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and nulls become 0."""
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c)) for c in columns})


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with population deviation; one aggregate row joined back (one row, always broadcast)."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats), F.lit(True))
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.col(c) - F.col(f"__m_{c}"))
    return out.select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """Adds code: place of the label among the sorted distinct labels (few rows, ranked apart from the data)."""
    codes = df.select(label).distinct().withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))
    return df.join(codes, label)


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: per label the first share by hash order; reproducible by key.

    A label's rows are ranked in 1024 slices of the hash, each a task's worth,
    behind the running sum of the slices before.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumns({"__h": h, "__slice": F.shiftright(h, 54)})
    sizes = rows.groupBy(label, "__slice").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(label)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(label, "__slice", before.alias("__before"), F.sum("__n").over(w).alias("__all"))
    rank = F.row_number().over(Window.partitionBy(label, "__slice").orderBy("__h", key))
    marked = rows.withColumn("__rank", rank).join(sizes, [label, "__slice"])
    return marked.withColumn("is_test", F.col("__before") + F.col("__rank") <= F.round(F.col("__all") * test)).select(*df.columns, "is_test")


def held_out_share(smallest: int, test: float = 0.2) -> tuple[float, bool]:
    """(share of test rows, whether to split by class) given the smallest class's size.

    A class of one row can't be split; one of fewer than 1 / test rows lowers
    the share to just under 1 / size, to 0.1 at least.  No rows raise.
    """
    if smallest <= 0:
        raise ValidationError("a class has no rows")
    if smallest >= int(1 / test):
        return test, True
    return (test, False) if smallest == 1 else (max(0.1, min(test, 1 / smallest - 0.01)), True)


def split_rows(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test by held_out_share's rule."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    share, by_class = held_out_share(smallest, test)
    if by_class:
        return stratified_split(df, label, key, share, seed)
    return stratified_split(df.withColumn("__one", F.lit(0)), "__one", key, share, seed).drop("__one")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class tp, fp, fn, precision, recall, f1 (0/0 is 0)."""
    c = confusion(df, truth, predicted)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("actual"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    hit = c.filter("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    j = t.join(p, "label", "full").join(hit, "label", "left").na.fill(0, ["actual", "named", "tp"])
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    j = j.withColumns({"fp": F.col("named") - F.col("tp"), "fn": F.col("actual") - F.col("tp"), "precision": div(F.col("tp"), F.col("named")), "recall": div(F.col("tp"), F.col("actual"))})
    return j.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "tp", "fp", "fn", "precision", "recall", "f1")


def macro(metrics: DataFrame, df: DataFrame, truth: str, predicted: str) -> DataFrame:
    acc = df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    m = metrics.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return m.join(acc, F.lit(True))


def difference_to_baseline(metrics: DataFrame, name: str, baseline: str, columns: list[str]) -> DataFrame:
    # one row, whatever repeats
    base = metrics.filter(F.col(name) == baseline).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    return metrics.join(F.broadcast(base), F.lit(True)).select(name, *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in columns])


def class_guard(df: DataFrame, label: str) -> DataFrame:
    """One row: n_classes and the smallest class's size, which training needs to be at least two and one."""
    return df.groupBy(label).agg(F.count("*").alias("c")).agg(F.count("*").alias("n_classes"), F.min("c").alias("smallest"))


def fold_scores(scores: DataFrame, fold, value: str) -> DataFrame:
    """fold, mean and population deviation of the scores of each fold."""
    return scores.groupBy(fold).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def unpivot(metrics: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return metrics.unpivot([name], columns, "metric", "value")


def nearest(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vector: str, label: str, k: int = 5, q_block: int = 1024, p_block: int = 8192) -> DataFrame:
    """(q, n, p, d, label): the exact k nearest points of each query, n from 1; ties by the smaller point id.

    A stated query set against all points, in blocks: queries are packed into
    rows of about q_block, points into rows of about p_block; each block of
    queries goes to every block of points as a key of an equi-join, a pair of
    blocks keeps k rows a query, and a second top-k merges them.  Nothing comes
    to the driver but the two counts.
    """
    import heapq

    import numpy as np
    import pyarrow as pa

    def best(batches):
        for b in batches:
            out = []
            for q, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mat, pts = np.array([x["v"] for x in q], np.float64), np.array([x["v"] for x in p], np.float64)
                for i, one in enumerate(q):
                    d = ((pts - mat[i]) ** 2).sum(axis=1).round(9)
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else range(len(d))
                    out += [(one["id"], *x) for x in heapq.nsmallest(k, ((float(d[j]), p[j]["id"], p[j]["label"]) for j in near))]
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["q", "d", "p", "label"])

    def blocks(df: DataFrame, name: str, fields: list, n: int) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64(fields[0]), F.lit(n)).alias(name)).agg(F.collect_list(F.struct(*fields)).alias(name + "s"))

    n_p = max(1, -(-points.count() // p_block))
    q = blocks(queries, "q", [F.col(q_id).cast("long").alias("id"), F.col(vector).alias("v")], max(1, -(-queries.count() // q_block)))
    p = blocks(points, "p", [F.col(p_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label")], n_p)
    pairs = q.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_p - 1).cast("long")))).join(p, "p")
    near = pairs.select("qs", "ps").mapInArrow(best, "q long, d double, p long, label long")
    n = F.row_number().over(Window.partitionBy("q").orderBy("d", "p"))
    return near.withColumn("n", n).filter(F.col("n") <= k)


def vote(near: DataFrame, k: int) -> DataFrame:
    """(q, predicted): majority label of the k nearest, the smallest on ties."""
    votes = near.filter(F.col("n") <= k).groupBy("q", "label").agg(F.count("*").alias("c"))
    return votes.groupBy("q").agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("predicted"))


def knn_predict(queries: DataFrame, points: DataFrame, q_id: str, p_id: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """Label of each query by its k nearest points."""
    return vote(nearest(queries, points, q_id, p_id, vector, label, k), k).withColumnRenamed("q", q_id)


def best_k(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, ks=range(2, 16)) -> tuple[int, list[tuple[int, float]]]:
    """(k of the best accuracy on test, the first on ties, and all accuracies); one search serves all k."""
    near = nearest(test, train, key, key, vector, label, max(ks)).cache()
    truth = test.select(F.col(key).cast("long").alias("q"), F.col(label).cast("long").alias("truth"))
    scores = [(k, float(vote(near, k).join(truth, "q").agg(F.avg((F.col("predicted") == F.col("truth")).cast("double"))).first()[0] or 0.0)) for k in ks]
    near.unpersist()
    top = max(s for _, s in scores)
    return (next(k for k, s in scores if s == top) if top > 0 else 5), scores


class LayoutModel:
    """Impute, scale, classify, decode: nearest neighbours over scaled features, with its training rows.

    save and load keep the rows as a table and the rest as one row beside it.
    """

    def __init__(self, rows: DataFrame, features: list[str], labels: list[str], means: list[float], deviations: list[float], k: int):
        self.rows, self.features, self.labels, self.means, self.deviations, self.k = rows, features, labels, means, deviations, k

    @staticmethod
    def _scaled(df: DataFrame, features: list[str], means: list[float], deviations: list[float]):
        """Features in the model's order; missing columns and bad values are 0."""
        have = {c for c in df.columns}
        filled = impute(df.withColumns({f: F.lit(0.0) for f in features if f not in have}), features)
        return filled.withColumn("__v", F.array(*[(F.col(f).cast("double") - m) / (s or 1.0) for f, m, s in zip(features, means, deviations)]))

    @classmethod
    def fit(cls, df: DataFrame, key: str, features: list[str], label: str, k: int | None = None) -> "LayoutModel":
        df = impute(df, features)
        stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        means, deviations = [stats[f"m{i}"] for i in range(len(features))], [stats[f"s{i}"] for i in range(len(features))]
        labels = sorted(r[0] for r in df.select(label).distinct().collect())  # a few classes
        code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
        rows = cls._scaled(df, features, means, deviations).select(F.col(key).cast("long").alias("id"), F.col("__v").alias("v"), code.cast("long").alias("label"))
        if k is None:
            split = split_rows(rows, "label", "id")
            k, _ = best_k(split.filter("not is_test"), split.filter("is_test"), "id", "v", "label")
        return cls(rows, list(features), labels, means, deviations, k)

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, label, multi_column); one row or many."""
        q = self._scaled(df, self.features, self.means, self.deviations).select(F.col(key).cast("long").alias("id"), F.col("__v").alias("v"))
        got = vote(nearest(q, self.rows, "id", "id", "v", "label", self.k), self.k)
        name = F.get(F.array(*[F.lit(x) for x in self.labels]), F.col("predicted").cast("int"))
        return got.select(F.col("q").alias(key), name.alias("label"), F.lower(name).contains("multi").alias("multi_column"))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        one = [(self.features, self.labels, self.means, self.deviations, self.k)]
        schema = "features array<string>, labels array<string>, means array<double>, deviations array<double>, k int"
        self.rows.sparkSession.createDataFrame(one, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, spark, path: str) -> "LayoutModel":
        r = spark.read.parquet(f"{path}/parameters").first()
        return cls(spark.read.parquet(f"{path}/rows"), list(r.features), list(r.labels), list(r.means), list(r.deviations), r.k)


def classifiers() -> dict:
    """Estimators for the model comparison; features and label are assembled columns."""
    from pyspark.ml import classification as c

    from .kernel import RadialMachine

    return {
        "logistic": c.LogisticRegression(maxIter=100),
        "naive_bayes": c.NaiveBayes(modelType="gaussian"),
        "tree": c.DecisionTreeClassifier(seed=42),
        "forest": c.RandomForestClassifier(numTrees=100, seed=42),
        "radial_svm": RadialMachine(),
    }


def compare_with_neighbours(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str = "label") -> DataFrame:
    """compare_classifiers and, as the sixth model, nearest neighbours with the best k of 2 to 15 on the test rows."""
    vec = lambda df: df.withColumn("__v", F.array(*[F.col(f).cast("double") for f in features]))
    k, scores = best_k(vec(train), vec(test), key, "__v", label)
    row = train.sparkSession.createDataFrame([(f"neighbours_{k}", dict(scores)[k])], "model string, accuracy double")
    return compare_classifiers(train, test, features, label).unionByName(row)


def compare_classifiers(train: DataFrame, test: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(model, accuracy) of each estimator on the test rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    rows = []
    for name, est in classifiers().items():
        est = est.setLabelCol(label).setFeaturesCol("features")
        rows.append((name, float(ev.evaluate(Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), est]).fit(train).transform(test)))))
    return train.sparkSession.createDataFrame(rows, "model string, accuracy double")


def learning_curve(df: DataFrame, features: list[str], label: str, estimator, sizes=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 10, test: float = 0.2) -> DataFrame:
    """(size, mean, std) of test accuracy over shuffled splits."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    rows = []
    for fold in range(folds):
        train, held = df.randomSplit([1 - test, test], seed=fold)
        for s in sizes:
            part = train if s >= 1 else train.sample(fraction=s, seed=fold)
            model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator.setLabelCol(label).setFeaturesCol("features")]).fit(part)
            rows.append((float(s), fold, float(ev.evaluate(model.transform(held)))))
    return df.sparkSession.createDataFrame(rows, "size double, fold int, accuracy double").groupBy("size").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))
