"""Model-based comparison on Spark ML (M1-M8).

Rows without a key are folded by counting equal rows and dealing the copies
out per class (:func:`fidspark.operators.prep.fold_copies`), so learners see
distinct rows with weights. Training frames are persisted during a call and
released at its end.  Logistic regression uses the L2 strength
``regParam = 1 / n_train`` (C = 1).  Metrics on the scored rows reuse the
exact SQL metrics from :mod:`fidspark.operators.scores`.
"""

from __future__ import annotations

from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    GBTClassificationModel,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.functions import clean_label
from fidspark.operators import encode, perceptron, prep, scores
from fidspark.session import default_buckets, ensure_parallel, one_row


def encode_labels(r: DataFrame, s: DataFrame, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: one label dictionary fitted on both sides (sorted strings -> 0..K-1), nulls kept null; ``y`` is the number, also
    where the sides have a column of that name."""
    both = r.select(clean_label(label).alias("v")).unionByName(s.select(clean_label(label).alias("v")))
    dic = both.where("v IS NOT NULL").distinct().withColumn(
        "y", (F.dense_rank().over(Window.orderBy("v")) - 1).cast("double"))  # one row per class
    def apply(df):
        # a shuffle by the label would give each class to one task
        return df.withColumn("_v", clean_label(label)).drop("y").join(F.broadcast(dic), F.col("_v") == F.col("v"), "left").drop("_v", "v")

    return apply(r), apply(s), dic


def _assembler(cols: Sequence[str], out: str = "features") -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol=out, withMean=True, withStd=True),
    ])


FIT_ROWS = 10_000  # rows that a partition of a fitted table has at least
MOST_ROWS = 250_000  # and about at most


def _fit_parts(spark, n: int) -> int:
    """Partitions of a fitted table of ``n`` rows: every step of a fit is a job with a task for each, so a whole number of
    rounds over the cores, or fewer for small tables."""
    cores = spark.sparkContext.defaultParallelism
    return min(cores * max(1, -(-n // (cores * MOST_ROWS))), max(1, n // FIT_ROWS))


def side_by_side(calls: Sequence, parallel: int) -> list:
    """The results of ``calls`` (functions without arguments), ``parallel`` of them at a time, so that the many small jobs of
    one fill the cores that another leaves idle."""
    with ThreadPool(max(1, min(parallel, len(calls)))) as pool:
        return pool.map(lambda call: call(), calls, chunksize=1)


def _lr(n_train: int, weight: str | None = None, max_iter: int = 100) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / max(1, n_train),
                            maxIter=max_iter, probabilityCol="prob")
    if weight:
        lr.setWeightCol(weight)
    return lr


def propensity(r: DataFrame, s: DataFrame, cols: Sequence[str], folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: out-of-fold propensity of 'real' -> (scored rows, one-row pMSE / AUROC / log-loss).

    Stratified folds, as many as the smaller side has rows but at most
    ``folds``; below two, one model scores the rows it was fitted on. Scored
    rows are (y, fold, p, w), ``w`` being the number of equal rows. An empty
    side gives null metrics.
    """
    scored = _propensity_scores(r, s, cols, folds, seed)
    return scored, propensity_metrics(scored, "w")


def _propensity_scores(r: DataFrame, s: DataFrame, cols: Sequence[str], folds: int, seed: int) -> DataFrame:
    """The scored rows of :func:`propensity`, persisted."""
    st = r.select(*cols, F.lit(1.0).alias("y")).unionByName(s.select(*cols, F.lit(0.0).alias("y")))
    counts = {row["y"]: row["n"] for row in st.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return r.sparkSession.createDataFrame([], "y double, fold int, p double, w double")
    k = min(folds, *counts.values())
    dealt = prep.fold_copies(st, cols, "y", max(1, k), seed).repartition(_fit_parts(r.sparkSession, sum(counts.values())))
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {row["fold"]: row["n"] for row in dealt.groupBy("fold").agg(F.sum("w").alias("n")).collect()}

    def scored_fold(f: int) -> DataFrame:
        tr, te, n = (dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f), sum(counts.values()) - sizes[f])
        if k < 2:
            tr, te, n = dealt, dealt, sizes[0]
        # the learner scales features itself, by weighted deviations
        model = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"),
                                 _lr(n, weight="w")]).fit(tr)
        return model.transform(te).select("y", "fold", vector_to_array("prob")[1].alias("p"), "w")

    parts = side_by_side([partial(scored_fold, f) for f in range(max(1, k))], 4)
    # each part has all partitions of the dealt rows, nearly empty
    scored = reduce(DataFrame.unionByName, parts).coalesce(default_buckets(r.sparkSession)).persist(StorageLevel.MEMORY_AND_DISK)
    scored.count()  # fill before the training rows are released
    dealt.unpersist()
    return scored


def propensity_metrics(scored: DataFrame, copies: str | None = None, eps: float = 1e-12) -> DataFrame:
    """pMSE = mean (p - c)^2 with c the real share; AUROC; log-loss (eps 1e-12). ``copies``: rows one row stands for."""
    w, y, p = F.lit(1.0) if copies is None else F.col(copies), F.col("y"), F.col("p")
    sums = scored.agg(F.sum(w).alias("n"), F.sum(w * y).alias("ny"), F.sum(w * p).alias("np"), F.sum(w * p * p).alias("npp"),
                      F.sum(w * (y * F.log(p + eps) + (1 - y) * F.log(1 - p + eps))).alias("ll"))
    c, n = F.try_divide("ny", "n"), F.col("n")
    m = sums.select(F.try_divide(F.col("npp") - 2 * c * F.col("np") + c * c * n, n).alias("pmse"),
                    F.try_divide(-F.col("ll"), n).alias("domain_classifier_logloss")).withColumn("_k", F.lit(1))
    auc = scores.auroc(scored.withColumn("yl", F.col("y").cast("int")), "yl", "p", copies=copies).withColumnRenamed(
        "auroc", "domain_classifier_auroc").withColumn("_k", F.lit(1))
    return m.join(auc, "_k").select("pmse", "domain_classifier_auroc", "domain_classifier_logloss")


def detection_score(r: DataFrame, s: DataFrame, cols: Sequence[str], folds: int = 3, seed: int = 42) -> DataFrame:
    """M2: C2ST score = mean over folds of 1 - (2 max(0.5, AUROC_fold) - 1); a fold of one class has none and is skipped."""
    scored = _propensity_scores(r, s, cols, folds, seed)
    per = scores.auroc(scored.withColumn("yl", F.col("y").cast("int")), "yl", "p", copies="w", by=["fold"])
    best = F.when(F.col("auroc").isNotNull(), F.greatest(F.col("auroc"), F.lit(0.5)))
    return per.agg(F.avg(1.0 - (2.0 * best - 1.0)).alias("detection_score"))


def _balanced_weights(df: DataFrame) -> DataFrame:
    """n / (K * n_c) per row: per-class counts are one row per class (broadcast)."""
    cnt = df.groupBy("y").agg(F.count(F.lit(1)).alias("_nc"))
    tot = cnt.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_kc")).withColumn("_k", F.lit(1))
    w = cnt.withColumn("_k", F.lit(1)).join(tot, "_k").select("y", (F.col("_n") / (F.col("_kc") * F.col("_nc"))).alias("w"))
    return df.join(F.broadcast(w), "y")


def tstr(r: DataFrame, s: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """M3: train on synthetic (balanced weights), test on real: accuracy, F1 macro/weighted,
    AUROC (binary on class 1; one-vs-rest macro otherwise), AUROC coverage."""
    re, se, dic = encode_labels(r, s, label)
    tr = ensure_parallel(_balanced_weights(se.where("y IS NOT NULL").select(*cols, "y"))).persist(
        StorageLevel.MEMORY_AND_DISK)
    te = re.where("y IS NOT NULL").select(*cols, "y")
    counts = {row["y"]: row["n"] for row in tr.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row per class
    classes, n = sorted(counts), sum(counts.values())
    if len(classes) < 2:
        tr.unpersist()
        spark = r.sparkSession
        return spark.createDataFrame([(None,) * 5], "tstr_accuracy double, tstr_f1_macro double, "
                                     "tstr_f1_weighted double, tstr_auroc double, tstr_auroc_eval_coverage double")
    model = Pipeline(stages=[_assembler(cols), _lr(n, weight="w")]).fit(tr)
    tr.unpersist()
    pred = model.transform(te).select("y", "prediction", vector_to_array("prob").alias("pr")).persist()
    rep = scores.classification_report(pred, "y", "prediction").select(
        F.col("accuracy").alias("tstr_accuracy"), F.col("f1_macro").alias("tstr_f1_macro"),
        F.col("f1_weighted").alias("tstr_f1_weighted")).withColumn("_k", F.lit(1))
    valid = pred.where(F.col("y").isin(classes))
    cov = pred.agg(F.avg(F.col("y").isin(classes).cast("double")).alias("tstr_auroc_eval_coverage")).withColumn("_k", F.lit(1))
    if len(classes) == 2:
        auc = scores.auroc(valid.select("y", F.col("pr")[1].alias("s")).withColumn("yl", F.col("y").cast("int")),
                           "yl", "s", positive=int(classes[1]))
    else:
        probs = valid.select("y", *[F.col("pr")[int(c)].alias(f"p{int(c)}") for c in classes])
        auc = scores.auroc_ovr(probs.withColumn("y", F.col("y").cast("int")), "y",
                               {str(int(c)): f"p{int(c)}" for c in classes})
    auc = auc.select(F.col(auc.columns[0]).alias("tstr_auroc")).withColumn("_k", F.lit(1))
    out = one_row(rep.join(auc, "_k").join(cov, "_k").select(
        "tstr_accuracy", "tstr_f1_macro", "tstr_f1_weighted", "tstr_auroc", "tstr_auroc_eval_coverage"))
    pred.unpersist()
    return out


def _classifier(name: str, n: int, n_features: int, n_classes: int, seed: int):
    if name == "lr":
        return _lr(n)
    if name == "dt":
        return DecisionTreeClassifier(featuresCol="features", labelCol="y", probabilityCol="prob", seed=seed)
    if name == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="y", probabilityCol="prob", seed=seed)
    if name == "mlp":
        return perceptron.BlockPerceptron(featuresCol="features", labelCol="y", probabilityCol="prob",
                                          layers=[n_features, 100, n_classes], seed=seed, maxIter=100)
    if name == "svm":
        svm = LinearSVC(featuresCol="features", labelCol="y", regParam=1.0 / max(1, n))
        return svm if n_classes == 2 else OneVsRest(classifier=svm, featuresCol="features", labelCol="y")
    raise ValueError(name)


def _regressor(name: str, n: int):
    """Linear, ridge (alpha 1 on summed squares) and lasso (alpha 1 on mean squares) on features scaled before."""
    reg, mix = {"linear": (0.0, 0.0), "ridge": (1.0 / max(1, n), 0.0), "lasso": (1.0, 1.0)}[name]
    return LinearRegression(featuresCol="features", labelCol="y", regParam=reg, elasticNetParam=mix, standardization=False)


CLASSIFIERS = ("lr", "dt", "rf", "mlp", "svm")
REGRESSORS = ("linear", "ridge", "lasso")


def utility_gap(r: DataFrame, runs: Sequence[DataFrame], cols: Sequence[str], label: str,
                models: Sequence[str] | None = None, test_share: float = 0.2, seed: int = 42,
                key: str | None = None, task: str = "classification", parallel: int = 4) -> DataFrame:
    """M5/M6: real minus the mean over synthetic runs, each model trained on its table and tested on the same real 20 %.

    Classification: (model, accuracy_gap in points, auc_gap, f1_gap), the
    split stratified, the AUC (two classes) from probabilities or, for the
    support vector machine, raw scores; its kernel is linear, and beyond two
    classes it is one machine per class against the rest. Regression: (model, mape_gap, explained_variance_gap, r2_gap).
    ``key`` (default: a hash of the row) decides who is tested. Rows without a label are left out. ``parallel``: fits that run
    side by side, on features scaled once per table.
    """
    regression = task == "regression"
    models = models or (REGRESSORS if regression else CLASSIFIERS)
    spark = r.sparkSession
    if regression:
        tables = [d.withColumn("y", F.col(label).cast("double")) for d in (r, *runs)]
        n_classes = 0
    else:
        union = reduce(DataFrame.unionByName, [s.select(label) for s in runs])
        _, _, dic = encode_labels(r.select(label), union, label)
        dic = one_row(dic)  # one row per class; every job below would find the classes again
        tables = [d.withColumn("_v", clean_label(label)).drop("y").join(F.broadcast(dic), F.col("_v") == F.col("v"), "left").drop("_v", "v")
                  for d in (r, *runs)]
        n_classes = dic.count()
    own = F.xxhash64(*r.columns) if key is None else F.col(key)
    real = tables[0].where("y IS NOT NULL").select(*cols, "y", own.alias("_key"))
    held = (prep.random_split(real, [1 - test_share, test_share], "_key", seed) if regression
            else prep.stratified_split(real, "y", test_share, "_key", seed))
    held = held.select(*cols, "y", "split")
    held = held.repartition(_fit_parts(spark, real.count())).persist(StorageLevel.MEMORY_AND_DISK)
    test = held.where("split = 'test'")
    train = [held.where("split = 'train'")] + [d.where("y IS NOT NULL").select(*cols, "y") for d in tables[1:]]
    sizes = [d.count() for d in train]
    train[1:] = [d.repartition(_fit_parts(spark, n)).persist(StorageLevel.MEMORY_AND_DISK) for d, n in zip(train[1:], sizes[1:])]

    def scaled(tr: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The training table and the test rows, with the features scaled by the former."""
        scaler = _assembler(cols).fit(tr)
        x = scaler.transform(tr).select("features", "y").persist(StorageLevel.MEMORY_AND_DISK)
        x.count()
        return x, scaler.transform(test).select("features", "y")

    def measured(m: str, tr: DataFrame, on: DataFrame, n: int) -> tuple:
        learner = _regressor(m, n) if regression else _classifier(m, n, len(cols), n_classes, seed)
        out = learner.fit(tr).transform(on)
        if regression:
            rep = scores.regression_report(out, "y", "prediction").first()
            return rep["mape"], rep["explained_variance"], rep["r2"]
        score = vector_to_array("prob" if "prob" in out.columns else "rawPrediction")[1] if n_classes == 2 else F.lit(0.0)
        out = out.select("y", "prediction", score.alias("s"), F.col("y").cast("int").alias("yl")).persist()
        rep = scores.classification_report(out, "y", "prediction", positive="1.0").first()
        auc = scores.auroc(out, "yl", "s").first()[0] if n_classes == 2 else None
        out.unpersist()
        return rep["accuracy"] * 100.0, auc, rep["f1_macro"] if n_classes > 2 else rep["f1_pos"]

    sides = side_by_side([partial(scaled, tr) for tr in train], parallel)
    for d in train[1:]:
        d.unpersist()
    slow = sorted(models, key=lambda m: m not in ("mlp", "svm"))  # the longest fits start first
    fits = [(m, i) for m in slow for i in range(len(sides))]
    found = dict(zip(fits, side_by_side([partial(measured, m, *sides[i], sizes[i]) for m, i in fits], parallel)))
    rows = []
    for m in models:
        real_side, *syn = [found[m, i] for i in range(len(sides))]
        gaps = []
        for i, x in enumerate(real_side):
            ys = [y[i] for y in syn if y[i] is not None]
            gaps.append(x - sum(ys) / len(ys) if ys and x is not None else None)
        rows.append((m, *gaps))
    for d in (held, *[tr for tr, _ in sides]):
        d.unpersist()
    names = ("mape_gap", "explained_variance_gap", "r2_gap") if regression else ("accuracy_gap", "auc_gap", "f1_gap")
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} double" for c in names))


def ml_features(df: DataFrame, train: DataFrame, cols: Sequence[str], cats: Sequence[str] = ()) -> DataFrame:
    """M8: per number, log(max(x, 0.01)) if train min >= 0 and max >= 1000, else (x - min)/(max - min) * 5;
    per category, an array of 0/1 over the train categories (``<column>_oh``, unknown: all 0) in its place."""
    row = train.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    dictionary = encode.fit_dictionary(train, cats) if cats else None
    for c in cats:
        df = encode.one_hot(df, c, encode.categories_of(dictionary, c)).drop(c)
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        mn, mx = row[f"mn_{c}"], row[f"mx_{c}"]
        x = F.col(c).cast("double")
        if mn is None:  # no value in train
            out.append(x.alias(c))
        elif mn >= 0 and mx >= 1000:
            out.append(F.log(F.greatest(x, F.lit(0.01))).alias(c))
        else:
            w = (mx - mn) if mx != mn else 1.0
            out.append(((x - mn) / w * 5.0).alias(c))
    return df.select(*out)


BINS = 32  # parts that a tree learner cuts a number into (Spark's maxBins)


def _bin_cuts(df: DataFrame, n: int) -> list[list[float]]:
    """Rising cuts of each of the first ``n`` numbers of the array ``x``: between all values of a number that has at most
    BINS, else at its quantiles over all rows (percentile_approx, a rank error of at most 1 in 10,000)."""
    edges = [i / BINS for i in range(1, BINS)]
    at = df.agg(*[F.percentile_approx(F.col("x")[i], edges, 10_000).alias(f"q{i}") for i in range(n)]).first() if n else []
    cuts = []
    for i in range(n):
        few = sorted(row["v"] for row in df.select(F.col("x")[i].alias("v")).distinct().limit(BINS + 1).collect())
        cuts.append(few[:-1] if len(few) <= BINS else sorted(set(at[i])))
    return cuts


# The grid of M7 (36 points) and the criteria its best points are chosen by.
EFFICIENCY_GRID = {"maxIter": (10, 50, 100), "minInstancesPerNode": (1, 10), "maxDepth": (5, 10, 20), "minInfoGain": (0.0, 1.0)}
CRITERIA = {"classification": ("f1", "inverse_weighted_f1", "auroc", "accuracy", "average"), "regression": ("r2", "rmse")}


def ml_efficiency(s: DataFrame, test: DataFrame, cols: Sequence[str], label: str, cats: Sequence[str] = (),
                  task: str = "classification", grid: dict | None = None, seed: int = 42, parallel: int = 12) -> DataFrame:
    """M7: machine-learning efficiency -> one row per criterion: (criterion, params, validation metric, test metrics).

    A ninth of the training table ``s`` is validation; each point of the grid
    is fitted on the rest, and the best point per criterion is reported on
    ``test``. Gradient-boosted trees, or forests beyond two classes. Boosting
    adds trees one by one, so points that differ in ``maxIter`` alone are one
    fit of the longest and its first trees. ``average`` is the mean of the other criteria. Features are
    :func:`ml_features` of ``s``; rows without a label are left out.

    A tree learner sees numbers by their bins alone, so rows of equal bins and
    label stay together in every tree. Beyond FIT_ROWS rows, boosting therefore
    works on bins, equal rows being one with their number as weight: the rows
    are counted once, and the steps of the fits grow with the rows that differ.
    """
    from itertools import product

    from pyspark.ml.functions import array_to_vector

    regression = task == "regression"
    grid = grid or EFFICIENCY_GRID
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    if regression:
        tr, te, n_classes = s.withColumn("y", F.col(label).cast("double")), test.withColumn("y", F.col(label).cast("double")), 0
    else:
        tr, te, dic = encode_labels(s, test, label)
        n_classes = dic.count()
    feats = [F.array(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in cols] + [F.col(f"{c}_oh") for c in cats]

    def featured(d: DataFrame) -> DataFrame:
        """(y, _key, x), ``x`` the features: numbers, then the categories; in few partitions, as a fit runs thousands of small jobs."""
        own = F.xxhash64(*cols, *cats, "y").alias("_key")
        x = ml_features(d.where("y IS NOT NULL").select(*cols, *cats, "y", own), s, cols, cats)
        return x.select("y", "_key", F.concat(*feats).alias("x")).repartition(_fit_parts(x.sparkSession, d.count()))

    whole = prep.random_split(featured(tr), [8 / 9, 1 / 9], "_key", seed, ("train", "val")).persist(StorageLevel.MEMORY_AND_DISK)
    train, val_rows = whole.where("split = 'train'"), whole.where("split = 'val'")
    n_train = train.count()
    merged = ((regression or n_classes == 2) and n_train > max(FIT_ROWS, 2.1 * max(grid.get("minInstancesPerNode", (1,))))
              and "maxBins" not in grid)
    cuts = _bin_cuts(train, len(cols)) if merged else []

    def learned(d: DataFrame) -> DataFrame:
        """(y, x) as the learners see it: ``x`` with its numbers replaced by their bins."""
        if not merged:
            return d.select("y", "x")
        bins = [F.size(F.filter(F.array(*[F.lit(float(c)) for c in cut]), partial(lambda v, c: c < v, F.col("x")[i]))).cast("double")
                if cut else F.lit(0.0) for i, cut in enumerate(cuts)]
        return d.select("y", F.concat(F.array(*bins), F.slice("x", len(cols) + 1, F.greatest(F.size("x") - len(cols), F.lit(0)))).alias("x"))

    fitted = learned(train)
    if merged:
        fitted = fitted.groupBy("y", "x").agg(F.count(F.lit(1)).cast("double").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        held, fitted = fitted, fitted.repartition(_fit_parts(s.sparkSession, fitted.count()))
    fitted = fitted.withColumn("features", array_to_vector("x")).drop("x").persist(StorageLevel.MEMORY_AND_DISK)
    fitted.count()
    if merged:
        held.unpersist()
    val_rows, te = [learned(d).select("y", array_to_vector("x").alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
                    for d in (val_rows, featured(te))]
    val_rows.count()
    whole.unpersist()

    def fits() -> list[dict]:
        """What has to be fitted: of boosted trees the longest of each kind."""
        if not regression and n_classes != 2:
            return points
        longest = max(grid["maxIter"])
        return [p for p in points if p["maxIter"] == longest]

    def first_trees(model, n: int):
        """The boosted model of the first ``n`` trees."""
        gateway = s.sparkSession.sparkContext._gateway
        ml, all_trees, all_weights = gateway.jvm.org.apache.spark.ml, model._java_obj.trees(), model.treeWeights
        trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, n)
        weights = gateway.new_array(gateway.jvm.double, n)
        for i in range(n):
            trees[i], weights[i] = all_trees[i], all_weights[i]
        make, wrap = ((ml.regression.GBTRegressionModel, GBTRegressionModel) if regression
                      else (ml.classification.GBTClassificationModel, GBTClassificationModel))
        return wrap(make(model.uid, trees, weights))

    def fitted_models(point: dict) -> dict:
        """The models of all points that this fit serves, by the point's number."""
        model = learner(point).fit(fitted)
        if not regression and n_classes != 2:
            return {points.index(point): model}
        rest = {k: v for k, v in point.items() if k != "maxIter"}
        return {i: first_trees(model, p["maxIter"]) for i, p in enumerate(points)
                if {k: v for k, v in p.items() if k != "maxIter"} == rest}

    def learner(point: dict):
        own = dict(point, seed=seed, featuresCol="features", labelCol="y")
        if merged:
            # a row stands for w rows, so the least rows of a node are a share of the weight; bins of 0 may be counted
            # twice where the learner looks at a part of the rows, hence a few more
            least = own.pop("minInstancesPerNode", 1)
            own |= {"weightCol": "w", "maxBins": BINS + 8, "minWeightFractionPerNode": (least - 0.5) / n_train}
        if regression:
            return GBTRegressor(**own)
        if n_classes == 2:
            return GBTClassifier(**own)
        own["numTrees"] = own.pop("maxIter")
        return RandomForestClassifier(**own)

    def measured(model, on: DataFrame) -> dict:
        out = model.transform(on)
        if regression:
            return scores.regression_report(out, "y", "prediction").select("r2", "rmse").first().asDict()
        out = out.select("y", "prediction", F.col("y").cast("int").alias("yl"), vector_to_array("probability").alias("pr")).persist()
        rep = scores.classification_report(out, "y", "prediction", positive="1.0").first()
        if n_classes == 2:
            auc = scores.auroc(out.withColumn("s", F.col("pr")[1]), "yl", "s")
        else:
            probs = out.select("yl", *[F.col("pr")[c].alias(f"p{c}") for c in range(n_classes)])
            auc = scores.auroc_ovr(probs, "yl", {str(c): f"p{c}" for c in range(n_classes)})
        found = {"f1": rep["f1_macro"] if n_classes > 2 else rep["f1_pos"], "accuracy": rep["accuracy"], "auroc": auc.first()[0],
                 "inverse_weighted_f1": scores.inverse_weighted_f1(out, "y", "prediction").first()[0]}
        out.unpersist()
        values = [v for v in found.values() if v is not None]
        return found | {"average": sum(values) / len(values) if values else None}

    names = CRITERIA["regression" if regression else "classification"]
    with ThreadPool(parallel) as pool:  # fits of a grid run side by side on the cached rows
        served = {i: m for found in pool.map(fitted_models, fits()) for i, m in found.items()}
        val = pool.map(lambda i: measured(served[i], val_rows), range(len(points)))

        def best(name: str) -> int:
            sign = -1.0 if name == "rmse" else 1.0
            return max(range(len(points)), key=lambda i: float("-inf") if val[i][name] is None else sign * val[i][name])

        chosen = {name: best(name) for name in names}
        needed = sorted(set(chosen.values()))
        tested = dict(zip(needed, pool.map(lambda i: measured(served[i], te), needed)))
    for d in (fitted, val_rows, te):
        d.unpersist()
    rows = [(name, str(points[i]), val[i][name], *[tested[i][c] for c in names]) for name, i in chosen.items()]
    return s.sparkSession.createDataFrame(rows, "criterion string, params string, validation double, "
                                          + ", ".join(f"test_{c} double" for c in names))
