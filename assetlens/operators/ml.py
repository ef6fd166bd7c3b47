"""Out-of-fold models and their explanation with Spark ML. Folds and samples are hashes of the id, so runs repeat."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import IDF, Bucketizer, CountVectorizer, ElementwiseProduct, Imputer, ImputerModel, Normalizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlens.functions.text import to_number
from assetlens.operators.profile import MISSING, seeded_sample
from assetlens.scratch import Scratch, spread, written


#: Suffixes of columns made from a source column: filled numbers, their bins and one-hot levels.
FILLED, BIN, HOT, INDEX = "::filled", "::bin", "::hot", "::index"


def with_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))


def with_rare_bucket(df: DataFrame, columns: list[str], least: int = 10, rare: str = "<rare>") -> DataFrame:
    """Category levels of fewer than `least` rows become one level. The levels' counts are broadcast only by Spark's own size rule."""
    for c in columns:
        keep = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(F.col(c).alias("_k"))
        df = df.join(keep, F.col(c) == F.col("_k"), "left").withColumn(c, F.when(F.col("_k").isNotNull(), F.col(c)).when(F.col(c).isNull(), MISSING).otherwise(rare)).drop("_k")
    return df


def char_grams(text: str, low: int = 2, high: int = 4):
    """n-grams inside words, each word padded with a blank on both sides; short words give themselves."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")

    def grams(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.array(*[_grams(p, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(words, grams))


def _grams(p, n: int):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substr(p, i, F.lit(n)))


class TermWeights(Estimator):
    """Term counts times idf + 1, idf being ln((1 + rows) / (1 + rows with the term)): a term of all rows keeps its count. Fits to a plain product, so it can be saved."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self.columns = {"inputCol": inputCol, "outputCol": outputCol}

    def _fit(self, df: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol=self.columns["inputCol"], outputCol="__idf").fit(df).idf.toArray()
        return ElementwiseProduct(scalingVec=Vectors.dense(idf + 1), **self.columns)


class Bins(Estimator):
    """The numbers of the bins that numbers lie in: each value of a column with no more than `bins` is one, else the ranges between quantiles are. Fits to Spark's Bucketizer."""

    def __init__(self, inputCols: list[str], outputCols: list[str], bins: int = 32):
        super().__init__()
        self.columns, self.bins = {"inputCols": inputCols, "outputCols": outputCols}, bins

    def _fit(self, df: DataFrame) -> Bucketizer:
        columns, splits = self.columns["inputCols"], []
        quantiles = df.approxQuantile(columns, [i / self.bins for i in range(1, self.bins)], 0.001)
        for c, q in zip(columns, quantiles):
            few = sorted(r[0] for r in df.select(c).distinct().limit(self.bins + 1).collect())
            cuts = q if len(few) > self.bins else few[1:] or few
            splits.append([-math.inf, *sorted(set(cuts)), math.inf])
        return Bucketizer(splitsArray=splits, **self.columns)


def feature_stages(numeric: list[str], categorical: list[str], grams: str | None = None, vocabulary: int = 5000, bins: int = 0) -> list:
    """Median imputation and scaling, one-hot levels with unknown ones kept apart, TF-IDF of n-grams (idf + 1, unit length). bins > 0: numbers are binned (see Bins), not scaled."""
    stages, parts = [], []
    if numeric and bins:
        filled, binned = [f"{c}{FILLED}" for c in numeric], [f"{c}{BIN}" for c in numeric]
        stages += [Imputer(inputCols=numeric, outputCols=filled, strategy="median"), Bins(filled, binned, bins)]
        parts += binned
    elif numeric:
        filled = [f"{c}{FILLED}" for c in numeric]
        stages += [Imputer(inputCols=numeric, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__num", handleInvalid="keep"), StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True)]
        parts.append("__scaled")
    if categorical:
        index, hot = [f"{c}{INDEX}" for c in categorical], [f"{c}{HOT}" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False)]
        parts += hot
    if grams:
        stages += [CountVectorizer(inputCol=grams, outputCol="__tf", vocabSize=vocabulary), TermWeights("__tf", "__weights"), Normalizer(inputCol="__weights", outputCol="__text", p=2.0)]
        parts.append("__text")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def ridge(alpha: float, rows: float, target: str = "label", spread: float = 1.0) -> LinearRegression:
    """Least squares plus alpha times the sum of squared weights. Spark divides its penalty by the label's spread (population standard deviation), so that comes in here."""
    return LinearRegression(labelCol=target, elasticNetParam=0.0, regParam=alpha * spread / max(rows, 1), standardization=False)


def ridge_for(df: DataFrame, alpha: float, target: str = "label", share: float = 1.0) -> LinearRegression:
    """ridge() for fitting on a share of df's rows."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    return ridge(alpha, share * r["n"], target, r["s"] or 1.0)


def random_forest(target: str = "label", trees: int = 450, leaf: int = 2, depth: int = 12, seed: int = 42) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=target, numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=leaf, maxDepth=depth, seed=seed)


def boosted_trees(target: str = "label", rounds: int = 350, rate: float = 0.04, depth: int = 5, sample: float = 0.85, leaf: int = 2, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(labelCol=target, maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=sample, minInstancesPerNode=leaf, seed=seed)


#: Most rows that a forest over classes is fitted on as they are, by Spark's own forest at once; the trees are drawn from the same distribution.
FEW = 50_000


class ClassForest(Estimator):
    """A random forest that is fitted on classes of rows with equal features, so its work grows with the classes (with binned features they are few) and not with rows.

    Every row counts, and the bootstrap is that of single rows: a row comes into a tree's sample a Poisson number of times with mean one, so m rows with one label come Poisson
    times with mean m. What splits and leaves depend on are counts and sums of labels, so a tree gets, of each class, the number of draws as weight and the mean of their labels; the
    sum of squares inside a class is the same on both sides of any split. A leaf's least rows become a least weight. Trees are fitted side by side, each by Spark's own forest of one tree.
    """

    def __init__(self, model: RandomForestRegressor):
        super().__init__()
        self.model = model

    def draws(self, df: DataFrame, scratch: Scratch) -> DataFrame:
        """tree, features, weight and label: of each tree's bootstrap the classes that it has."""
        m = self.model
        return _drawn(df.select(vector_to_array(m.getFeaturesCol()).alias("features"), F.col(m.getLabelCol()).cast("double").alias("label")), m.getNumTrees(), m.getSeed(), scratch)

    def _fit(self, df: DataFrame) -> RandomForestRegressionModel:
        spark, m = df.sparkSession, self.model
        if df.count() <= FEW:
            # without what is known of the columns: a bin's number is a number, not a level
            return m.fit(dealt(df.withMetadata(m.getFeaturesCol(), {})))
        scratch = Scratch(spark, "forest")
        path = scratch.path("draws")
        self.draws(df, scratch).repartition("tree").write.partitionBy("tree").parquet(path)
        table = spark.read.parquet(path)
        schema = table.drop("tree").schema
        totals = {r["tree"]: r["w"] for r in table.groupBy("tree").agg(F.sum("weight").alias("w")).collect()}
        subset = m.getFeatureSubsetStrategy()
        one = {m.numTrees: 1, m.bootstrap: False, m.subsamplingRate: 1.0, m.labelCol: "label", m.featuresCol: "features", m.weightCol: "weight", m.minInstancesPerNode: 1, m.featureSubsetStrategy: "onethird" if subset == "auto" and m.getNumTrees() > 1 else subset}

        def fit(tree: int) -> RandomForestRegressionModel:
            # weights are whole numbers, so a half below is as good as the least itself, and safe from rounding; what can't be split in two such parts is one leaf
            least = m.getMinInstancesPerNode()
            limits = {m.minWeightFractionPerNode: (least - 0.5) / totals[tree]} if totals[tree] >= 2 * least else {m.maxDepth: 0}
            return m.copy(one | limits | {m.seed: m.getSeed() + tree}).fit(spark.read.schema(schema).parquet(f"{path}/tree={tree}"))

        with ThreadPoolExecutor(spark.sparkContext.defaultParallelism) as pool:
            waiting = [pool.submit(inheritable_thread_target(spark)(lambda tree=tree: fit(tree))) for tree in sorted(totals)]
            fitted = [w.result() for w in waiting]
        scratch.close()
        return _joined(fitted, m)


def _drawn(rows: DataFrame, trees: int, seed: int, scratch: Scratch) -> DataFrame:
    """Bootstraps of rows (features array, label) for so many trees. Draws are seeded by a class's features and label, so they repeat whatever the partitions."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        for b in batches:
            f, y = np.stack(b["features"].to_numpy()), b["label"].to_numpy()
            k = np.stack([np.random.default_rng(h & (2**64 - 1)).poisson(n, trees) for h, n in zip(b["h"].tolist(), b["n"].tolist())]).astype("float64")
            first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]).any(axis=1)])
            yield pd.DataFrame({"features": list(f[first]), "n": list(np.add.reduceat(k, first)), "s": list(np.add.reduceat(k * y[:, None], first))})

    counted = scratch.written(rows.groupBy("features", "label").agg(F.count(F.lit(1)).alias("n"), F.xxhash64("features", "label", F.lit(seed)).alias("h")), "classes")
    dealt_out = counted.repartitionByRange(max(32, 4 * rows.sparkSession.sparkContext.defaultParallelism), "features", "label").sortWithinPartitions("features", "label")
    sums = dealt_out.mapInPandas(draw, "features array<double>, n array<double>, s array<double>")
    per = sums.select("features", F.posexplode(F.arrays_zip("n", "s")).alias("tree", "x")).where("x.n > 0").groupBy("tree", "features").agg(F.sum("x.n").alias("weight"), F.sum("x.s").alias("s"))
    return per.select("tree", array_to_vector("features").alias("features"), "weight", (F.col("s") / F.col("weight")).alias("label"))


def _joined(fitted: list[RandomForestRegressionModel], like: RandomForestRegressor) -> RandomForestRegressionModel:
    """One forest of the trees of several."""
    spark = SparkSession.active()
    ml_regression = spark._jvm.org.apache.spark.ml.regression
    trees = [t._java_obj for f in fitted for t in f.trees]
    array = spark.sparkContext._gateway.new_array(ml_regression.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    out = RandomForestRegressionModel(ml_regression.RandomForestRegressionModel(f"{like.uid}_classes", array, fitted[0].numFeatures))
    out = like.copy({like.numTrees: len(trees)})._copyValues(out)
    out._transfer_params_to_java()  # its predictions are sums over numTrees
    return out


class EarlyStopped(Estimator):
    """Boosted trees with as many rounds as are best for held-out training rows.

    A first fit leaves out the rows that the boolean column `validation` marks and is measured on them after each round; the model is fitted again on all rows, up to the best
    round. Its number of trees is that round. Without marked rows all rounds are taken.
    """

    def __init__(self, model: GBTRegressor, validation: str = "validation"):
        super().__init__()
        self.model, self.validation = model, validation

    def errors(self, df: DataFrame) -> list[float]:
        """Squared error on the marked rows after each round."""
        held = df.where(self.validation)
        if held.isEmpty():
            return []
        return self.model.fit(df.where(~F.col(self.validation))).evaluateEachIteration(held, "squared")

    def _fit(self, df: DataFrame) -> GBTRegressionModel:
        errors = self.errors(df)
        best = errors.index(min(errors)) + 1 if errors else self.model.getMaxIter()
        return self.model.copy({self.model.maxIter: best}).fit(df)


def dealt(df: DataFrame) -> DataFrame:
    """Rows to fit on, an even share per core: a table of a few MB is one partition when it is read, and a fit makes as many tasks as there are partitions."""
    return spread(df, df.sparkSession.sparkContext.defaultParallelism)


def fit_pipeline(df: DataFrame, stages: list, model) -> PipelineModel:
    return Pipeline(stages=[*stages, model]).fit(df)


def feature_frame(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """df with the column `features`, encoded on df itself."""
    return Pipeline(stages=feature_stages(numeric, categorical)).fit(df).transform(df)


def full_fit(df: DataFrame, stages: list, model, path: str, target: str = "label") -> DataFrame:
    """Fits on all rows, saves the pipeline at path (PipelineModel.load() reads it) and returns in-sample metrics, which say nothing of new rows."""
    from assetlens.operators.stats import regression_metrics

    fitted = fit_pipeline(df, stages, model)
    fitted.write().overwrite().save(path)
    return regression_metrics(fitted.transform(df), target, "prediction")


def fold_models(df: DataFrame, key: str, makes: dict[str, Callable[[], Pipeline]], k: int = 5, seed: int = 42, inner: float = 0.0, threads: int = 4) -> tuple[DataFrame, dict[tuple[str, int], PipelineModel]]:
    """key, model, fold and prediction, every row once per model by a pipeline fitted without its fold; and the fitted pipelines by model and fold.

    A make returns an unfitted Pipeline; encoders are inside it, so they see training rows only. inner > 0 marks that share
    of the training rows in the column `validation`, by a hash of the id: early stopping never looks at the scored fold.
    The folds are written once; models and folds are fitted side by side from a few threads.
    """
    folded = with_folds(df, key, k, seed)
    if inner:
        folded = folded.withColumn("validation", F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(1000)) < int(1000 * inner))
    scratch = Scratch(df.sparkSession, "folds")
    folded = scratch.written(folded, "rows")
    jobs = [(name, f) for name in makes for f in range(k)]
    with ThreadPoolExecutor(threads) as pool:
        waiting = [pool.submit(inheritable_thread_target(df.sparkSession)(lambda name=name, f=f: makes[name]().fit(folded.where(F.col("fold") != f)))) for name, f in jobs]
        models = {job: w.result() for job, w in zip(jobs, waiting)}
    out = None
    for (name, f), model in models.items():
        part = model.transform(folded.where(F.col("fold") == f)).select(key, F.lit(name).alias("model"), "fold", "prediction")
        out = part if out is None else out.unionByName(part)
    out = written(out, "out-of-fold")
    scratch.close()
    return out, models


def out_of_fold(df: DataFrame, key: str, make: Callable[[], Pipeline], k: int = 5, seed: int = 42, inner: float = 0.0) -> DataFrame:
    """key, fold and prediction of one model; see fold_models()."""
    return fold_models(df, key, {"": make}, k, seed, inner)[0].drop("model")


def importances(model: PipelineModel, df: DataFrame) -> DataFrame:
    """feature (source column) and importance, encoded slots summed per source."""
    attrs = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    values = model.stages[-1].featureImportances.toArray()
    hot = [c.removesuffix(INDEX) for s in model.stages if hasattr(s, "labelsArray") for c in s.getOutputCols()]
    filled = [c.removesuffix(FILLED) for s in model.stages if isinstance(s, ImputerModel) for c in s.getOutputCols()]
    # slots of scaled numbers are numbered in the order of the columns; a level's slot starts with its column's name, the longest that fits
    sources = {f"__scaled_{i}": c for i, c in enumerate(filled)} | {f"{c}{BIN}": c for c in filled}

    def source(n: str) -> str:
        return sources.get(n) or max((c for c in hot if n.startswith(c + HOT)), key=len, default="text" if n.startswith("__text") else n)

    spark = df.sparkSession
    rows = [(source(names.get(i, str(i))), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("encoded"))


def fold_importances(models: dict[tuple[str, int], PipelineModel], df: DataFrame) -> DataFrame:
    """model, fold, feature, importance and encoded of fitted trees; a fold's importances add up to one."""
    out = None
    for (name, fold), model in models.items():
        part = importances(model, df).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "feature", "importance", "encoded")
        out = part if out is None else out.unionByName(part)
    return out


def importance_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))


def inputs(model: PipelineModel, df: DataFrame) -> list[str]:
    """The columns of df that a fitted pipeline reads; all of them if a stage doesn't say what it reads."""
    used = []
    for stage in model.stages:
        own = [stage.getOrDefault(p) for p in ("inputCol", "inputCols", "featuresCol") if stage.hasParam(p) and stage.isDefined(p)]
        if not own:
            return df.columns
        used += [c for x in own for c in ([x] if isinstance(x, str) else x)]
    return [c for c in df.columns if c in used]


def partial_dependence(model: PipelineModel, df: DataFrame, feature: str, key: str, sample: int | None = 1800, points: int = 21, top: int = 12, seed: int = 42) -> DataFrame:
    """feature, value and mean prediction over rows whose feature is set to each grid value: a seeded sample, or all rows for None.

    The grid is part of the contract: the two values of a column that has no more, else quantiles from 5 to 95 % at `points` places; of a text
    column its `top` most frequent values. So it has at most max(points, top) rows, whatever the table's size, and is broadcast.
    Rows that are alike in all the model reads but the feature are predicted once and count as many.
    """
    s = seeded_sample(df, key, sample, seed) if sample is not None else df
    kind = dict(df.dtypes)[feature]
    if kind == "string":
        grid = df.groupBy(feature).count().orderBy(F.desc("count"), feature).limit(top).select(F.col(feature).alias("_g"))
    else:
        v = to_number(feature)
        few = df.select(v.alias("_g")).where("_g is not null").distinct().limit(3)
        if few.count() <= 2:
            grid = few
        else:
            q = [0.05 + 0.9 * i / (points - 1) for i in range(points)]
            grid = df.agg(F.percentile_approx(v, q, 10_000).alias("q")).select(F.explode(F.array_distinct("q")).alias("_g"))
    alike = s.groupBy(*[c for c in inputs(model, s) if c != feature]).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    crossed = spread(alike).crossJoin(F.broadcast(grid)).withColumn(feature, F.col("_g").cast(kind))
    mean = F.sum(F.col("prediction") * F.col("_rows")) / F.sum("_rows")
    return model.transform(crossed).groupBy(F.col("_g").cast("string").alias("value")).agg(mean.alias("mean_prediction")).select(F.lit(feature).alias("feature"), "value", "mean_prediction")


def shapley(model: PipelineModel, df: DataFrame, features: list[str], key: str, rows: int = 200, background: int = 10, permutations: int = 4, seed: int = 7) -> DataFrame:
    """key, feature, attribution: sampled-permutation Shapley values, whose sum over features is f(x) minus the mean prediction of the background.

    All hybrids of rows, background rows, permutations and prefixes are one DataFrame: one distributed transform, one aggregation.
    """
    import random

    r = random.Random(seed)
    orders = [r.sample(features, len(features)) for _ in range(permutations)]
    x = seeded_sample(df, key, rows, seed).select(key, *features)
    b = seeded_sample(df, key, background, seed + 1).select(*[F.col(c).alias(f"_b_{c}") for c in features]).withColumn("_bg", F.monotonically_increasing_id())
    steps = [(p, i) for p in range(permutations) for i in range(len(features) + 1)]
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in steps]))
    h = x.crossJoin(F.broadcast(b)).withColumn("_s", grid)
    place = {c: F.get(F.lit([o.index(c) for o in orders]).cast("array<int>"), F.col("_s.p")) for c in features}
    h = h.withColumns({c: F.when(place[c] < F.col("_s.i"), F.col(c)).otherwise(F.col(f"_b_{c}")) for c in features})
    scored = model.transform(h).select(key, "_bg", F.col("_s.p").alias("p"), F.col("_s.i").alias("i"), F.col("prediction"))
    before = scored.select(key, "_bg", "p", (F.col("i") + 1).alias("i"), F.col("prediction").alias("without"))
    gain = scored.join(before, [key, "_bg", "p", "i"])
    name = F.get(F.get(F.lit(orders).cast("array<array<string>>"), F.col("p")), F.col("i") - 1)
    return gain.groupBy(key, name.alias("feature")).agg(F.avg(F.col("prediction") - F.col("without")).alias("attribution"))


def attribution_summary(attributions: DataFrame) -> DataFrame:
    """Per feature the mean absolute and signed attribution, their spread, and rows."""
    a = F.col("attribution")
    return attributions.groupBy("feature").agg(F.avg(F.abs(a)).alias("mean_abs"), F.avg(a).alias("mean_signed"), F.stddev_samp(a).alias("std"), F.count(a).alias("rows"))


def model_comparison(predictions: DataFrame, actual: str, predicted: str, model: str = "model", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Metrics per model and fold, and per model with its place (see model_selection). predictions: model, fold, actual and predicted values."""
    from assetlens.operators.sensitivity import model_selection
    from assetlens.operators.stats import regression_metrics

    return regression_metrics(predictions, actual, predicted, (model, fold)), model_selection(regression_metrics(predictions, actual, predicted, (model,)))


def ablation(df: DataFrame, key: str, features: tuple[list[str], list[str]], dropped: tuple[str, ...], models: dict, k: int = 5, seed: int = 42, inner: float = 0.0) -> DataFrame:
    """key, model, dropped, fold and prediction of each model with all features and without the dropped ones. features: numeric and categorical; models: name -> function that returns an unfitted estimator."""
    makes = {}
    for name, make in models.items():
        for without in ((), dropped):
            numeric, categorical = ([c for c in part if c not in without] for part in features)
            makes[name + "/dropped" if without else name] = lambda make=make, n=numeric, c=categorical: Pipeline(stages=[*feature_stages(n, c), make()])
    p, _ = fold_models(df, key, makes, k, seed, inner)
    return p.select(key, F.regexp_replace("model", "/dropped$", "").alias("model"), F.endswith("model", F.lit("/dropped")).alias("dropped"), "fold", "prediction")


def potential_model(df: DataFrame, key: str, texts: list[str], categorical: list[str], numeric: list[str], target: str = "actual_use_v0", alpha: float = 1.0, vocabulary: int = 5000, tops: tuple[int, ...] = (100, 300), potential: float = 0.70, actual: float = 0.50) -> tuple[DataFrame, DataFrame]:
    """The first model: out-of-fold ridge on n-grams, levels and numbers predicts use; what is predicted high and used little is dormant.

    Returns df with potential_ml, its percentile, dormant_score, dormant_rank, top flags, quadrant and dormant_candidate; and one row of metrics.
    """
    from assetlens.operators.quality import prepared
    from assetlens.operators.rank import add_percentiles, first_rank
    from assetlens.operators.scores import quadrant
    from assetlens.operators.stats import regression_metrics

    d = prepared(df, categorical, numeric, texts).withColumns({"label": F.coalesce(to_number(target), F.lit(0.0)), **{c: F.coalesce(to_number(c), F.lit(0.0)) for c in numeric}})
    d = written(d.withColumn("_grams", char_grams("combined_text")), "model-frame")
    model = ridge_for(d, alpha, share=0.8)
    stages = lambda: [*feature_stages(numeric, categorical, "_grams", vocabulary), model.copy()]
    p = out_of_fold(d.select(key, "label", "_grams", *categorical, *numeric), key, lambda: Pipeline(stages=stages()))
    d = d.drop("_grams").join(p.select(key, F.col("prediction").alias("potential_ml"), "fold"), key)
    metrics = regression_metrics(d, "label", "potential_ml")
    d = add_percentiles(d, {"potential_ml_percentile": "potential_ml", "actual_use_percentile": "label"}, kind="pct")
    d = d.withColumn("dormant_score", F.col("potential_ml_percentile") - F.col("actual_use_percentile"))
    d = first_rank(d, "dormant_score", key, "dormant_rank")
    made = {f"dormant_top{k}": (F.col("dormant_rank") <= k).cast("int") for k in tops}
    made |= {"quadrant": quadrant("potential_ml_percentile", "actual_use_percentile"), "dormant_candidate": F.coalesce((F.col("potential_ml_percentile") >= potential) & (F.col("actual_use_percentile") <= actual), F.lit(False)).cast("int")}
    return d.withColumns(made), metrics


def direction(df: DataFrame, value: str, attribution: str) -> DataFrame:
    """How attribution moves with a value: for two values the difference of means, else the rank correlation, with its sign if beyond 0.05."""
    from assetlens.operators.stats import spearman

    v, a = to_number(value), to_number(attribution)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.countDistinct(v).alias("k"))
    d = df.crossJoin(F.broadcast(ends))
    diff = d.agg(F.max("k").alias("k"), (F.avg(F.when(v == F.col("hi"), a)) - F.avg(F.when(v == F.col("lo"), a))).alias("diff"), F.avg(F.abs(a)).alias("mean_abs"), F.avg(a).alias("mean_signed"))
    e = diff.crossJoin(spearman(df, value, attribution))
    stat = F.when(F.col("k") <= 2, F.col("diff")).otherwise(F.col("rho"))
    limit = F.when(F.col("k") <= 2, 0.0).otherwise(0.05)
    return e.select(stat.alias("effect"), F.when(stat > limit, "positive").when(stat < -limit, "negative").otherwise("flat").alias("direction"), "mean_abs", "mean_signed")
