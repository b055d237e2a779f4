"""Features, hierarchical roll-up, and Spark ML wrappers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.scalars import corr


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def project_features(df: DataFrame, vector: str, basis: list[list[float]], names: list[str]) -> DataFrame:
    """Dot products with fixed filters, as expressions."""
    return df.withColumns({n: dot(F.col(vector), F.array(*[F.lit(float(x)) for x in b])) for n, b in zip(names, basis, strict=True)})


def order_by_correlation(means: DataFrame, key: str, vector: str) -> DataFrame:
    """Rank of each (of few) traces by correlation with the trace most correlated to all."""
    a = means.select(F.col(key).alias("a"), F.posexplode(vector).alias("p", "x"))
    b = means.select(F.col(key).alias("b"), F.posexplode(vector).alias("p", "y"))
    c = a.join(b, "p").groupBy("a", "b").agg(corr("x", "y").alias("c"))
    total = c.groupBy("a").agg(F.sum("c").alias("s"))
    top = total.groupBy().agg(F.min_by("a", F.struct(-F.round("s", 9), "a")).alias("top"))
    picked = c.join(F.broadcast(top), c["a"] == top["top"])  # one row
    return picked.select(F.col("b").alias(key), F.row_number().over(Window.orderBy(-F.round("c", 9), "b")).alias("rank"))


def prune_clusters(df: DataFrame, cluster: str, least: int) -> DataFrame:
    """Clusters of ``least`` members or fewer become -1, others are numbered from 1."""
    n = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_c"))
    n = n.withColumn("pruned", F.when(F.col("_c") > least, F.row_number().over(Window.partitionBy((F.col("_c") > least)).orderBy(cluster))).otherwise(F.lit(-1)))
    return df.join(n.select(cluster, "pruned"), cluster)


def scaled_pca(df: DataFrame, vector: str, k: int, seed: int = 0):
    """Standardised principal components (Spark ML); returns (frame with ``pc``, model)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    m = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=k, inputCol="_s", outputCol="pc")]).fit(d)
    return m.transform(d).drop("_v", "_s"), m


def forest(df: DataFrame, vector: str, label: str, trees: int = 100, seed: int = 0):
    """Random forest with class weights n / (classes x n_class)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    d = df.join(n.crossJoin(total), label).withColumns({"_w": F.col("_t") / (F.col("_k") * F.col("_n")), "_v": array_to_vector(F.col(vector).cast("array<double>"))})
    return RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_w", numTrees=trees, seed=seed).fit(d)


def mixture(df: DataFrame, vector: str, ks: range, seed: int = 0, kinds: tuple[str, ...] = ("full",), metric: str = "bic", cv: int = 1):
    """Gaussian mixture with the best criterion (``bic``, ``aic`` or ``likelihood``) over ``ks`` and covariance ``kinds`` (``spherical``,
    ``tied``, ``diag``, ``full``): (criterion, k, model).  All are fitted and judged on all rows, or, with ``cv`` > 1, on folds left out
    (:mod:`epochal.operators.mixtures`); :func:`assign_mixture` applies the model."""
    from epochal.operators import mixtures

    scores, model = mixtures.choose(df, vector, ks, kinds, metric, cv, seed)
    kind, k, value = min(scores, key=lambda s: s[2])
    return value, k, model


def assign_mixture(df: DataFrame, vector: str, model) -> DataFrame:
    """Rows with the ``cluster`` of a mixture."""
    from epochal.operators import mixtures

    return mixtures.described(df, vector, model, ("cluster", "_density")).drop("_density")


def sort_clusters(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Rows with ``sorted``: clusters numbered anew, in falling order of the correlation of their mean trace with that of the largest
    cluster; -1 stays.  New numbers are the old ones in order."""
    real = rows.where(F.col(cluster) != -1)
    each = real.select(cluster, F.posexplode(vector).alias("p", "x")).groupBy(cluster, "p").agg(F.avg("x").alias("m"))
    size = real.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    top = size.groupBy().agg(F.min_by(F.col(cluster), F.struct(-F.col("n"), F.col(cluster))).alias("_c"))
    lead = each.join(F.broadcast(top), F.col(cluster) == F.col("_c")).select("p", F.col("m").alias("_m"))  # one row is broadcast
    cc = each.join(lead, "p").groupBy(cluster).agg(F.round(corr("m", "_m"), 9).alias("cc"))
    by_cc = cc.withColumn("_r", F.row_number().over(Window.orderBy(F.col("cc").desc(), F.col(cluster).desc())))  # one row a cluster
    names = size.select(F.col(cluster).alias("sorted"), F.row_number().over(Window.orderBy(cluster)).alias("_r"))
    table = by_cc.join(names, "_r").select(cluster, "sorted")
    return rows.join(table, cluster, "left").withColumn("sorted", F.coalesce("sorted", F.lit(-1)))


def trained(df: DataFrame, vector: str, label: str, key: str, trees: int = 1000, seed: int = 0) -> tuple:
    """(model, scores): a balanced forest fitted on four fifths of the rows (by hash of the key), its accuracy on them and on the rest, and,
    fitted again on all, on all."""
    held = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(5)) == 0
    first = forest(df.where(~held), vector, label, trees, seed)
    final = forest(df, vector, label, trees, seed)

    def accuracy(model, rows: DataFrame):
        from pyspark.ml.functions import array_to_vector

        out = model.transform(rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
        return out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]

    return final, {"train": accuracy(first, df.where(~held)), "test": accuracy(first, df.where(held)), "all": accuracy(final, df)}


def classify(df: DataFrame, vector: str, model) -> DataFrame:
    """Rows with ``probabilities`` of all classes, the class of the largest, and that as ``confidence``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
    out = out.withColumn("probabilities", vector_to_array("probability"))
    best = F.array_max("probabilities")
    return out.withColumns({"cell_class": F.array_position("probabilities", best).cast("int") - 1, "confidence": best}).select(*df.columns, "probabilities", "cell_class", "confidence")


def confident(rows: DataFrame, least: float, other: int = -1) -> DataFrame:
    """Rows with the class only where the confidence is at least ``least``."""
    return rows.withColumn("cell_class", F.when(F.col("confidence") >= least, F.col("cell_class")).otherwise(F.lit(other)))


def good_responses(rows: DataFrame, bar_qi: str = "bar_qi", chirp_qi: str = "chirp_qi", bar: float = 0.6, chirp: float = 0.45) -> DataFrame:
    """Reference cells whose response to the bar or to the chirp is reliable."""
    return rows.where((F.col(bar_qi) > bar) | (F.col(chirp_qi) > chirp))


def training_rows(features: DataFrame, labels: DataFrame, key: list[str], levels: list[str]) -> DataFrame:
    """Features with their labels at every level; cells that lack one are left out."""
    return features.join(labels.select(*key, *levels), key).dropna(subset=levels)


def check_bundle(bundle: dict, n_features: int) -> None:
    """A saved classifier's description must name its features, classes and filters, in fitting numbers."""
    need = {"chirp_feats", "bar_feats", "feature_names", "y_names", "model"}
    if missing := need - set(bundle):
        raise ValueError(f"the bundle lacks {sorted(missing)}")
    if len(bundle["feature_names"]) != n_features or len(bundle["chirp_feats"]) + len(bundle["bar_feats"]) + 2 != n_features:
        raise ValueError("features, filters and names differ in number")
    if not bundle["y_names"]:
        raise ValueError("the bundle names no class")


def save_bundle(spark, model, path: str, chirp_feats, bar_feats, feature_names: list[str], y_names: dict[int, str]) -> None:
    """A classifier (Spark ML) and its description, checked; a path that exists is an error."""
    import json

    about = {"chirp_feats": [list(map(float, x)) for x in chirp_feats], "bar_feats": [list(map(float, x)) for x in bar_feats], "feature_names": list(feature_names), "y_names": {str(k): v for k, v in y_names.items()}, "model": type(model).__module__ + "." + type(model).__name__}
    check_bundle(about, model.numFeatures)
    model.save(f"{path}/model")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")


def load_bundle(spark, path: str) -> dict:
    """The description of a saved classifier with the model itself, checked."""
    import importlib
    import json

    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    module, _, name = about["model"].rpartition(".")
    if not module.startswith("pyspark.ml."):
        raise ValueError("not a model of Spark ML")
    model = getattr(importlib.import_module(module), name).load(f"{path}/model")
    check_bundle(about, model.numFeatures)
    return about | {"model": model, "y_names": {int(k): v for k, v in about["y_names"].items()}}


def cell_features(rows: DataFrame, chirp: str, bar: str, p_value: str, area: str, chirp_basis: list[list[float]], bar_basis: list[list[float]]) -> DataFrame:
    """Rows with ``features``: dot products with the chirp and bar filters, the tuning's p-value and the region's area; and their names."""
    parts = [dot(F.col(c), F.array(*[F.lit(float(x)) for x in b])) for c, basis in ((chirp, chirp_basis), (bar, bar_basis)) for b in basis]
    names = [f"chirp_{i}" for i in range(len(chirp_basis))] + [f"bar_{i}" for i in range(len(bar_basis))] + ["bar_ds_pvalue", "roi_size_um2"]
    return rows.withColumns({"features": F.array(*parts, F.col(p_value).cast("double"), F.col(area).cast("double")), "feature_names": F.array(*map(F.lit, names))})


#: Samples and step of the published chirp and bar responses.
CHIRP_SAMPLES, CHIRP_SECONDS, BAR_SAMPLES, STEP, BASE = 249, 32.0, 32, 0.128, 8


def interpolated(v: Column, dt: float, at: list[float], shift: float = 0.0, extend: bool = False) -> Column:
    """An array of samples every ``dt`` (from ``shift`` on), linear at the times ``at``: held beyond the ends, or, with ``extend``, carried on."""
    def one(t: float) -> Column:
        x = (t - shift) / dt
        last = F.size(v) - 1
        low = F.greatest(F.lit(0), F.least(F.floor(F.lit(x)).cast("int"), last - 1)) if extend or x >= 0 else F.lit(0)
        part = F.lit(x) - low
        if not extend:
            part = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
        a, b = F.get(v, low), F.coalesce(F.get(v, low + 1), F.get(v, low))
        return a + (b - a) * part

    return F.array(*[one(t) for t in at])


def median_of(v: Column, n: int) -> Column:
    """Median of the first ``n`` items."""
    s = F.array_sort(F.slice(v, 1, n))
    return (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2


def amplitude_one(rows: DataFrame, column: str, base: int = BASE) -> DataFrame:
    """Less the median of the first ``base`` items, over the largest size."""
    d = rows.withColumn("_b", median_of(F.col(column), base)).withColumn(column, F.transform(column, lambda x: x - F.col("_b"))).drop("_b")
    top = F.array_max(F.transform(column, F.abs))
    return d.withColumn("_t", top).withColumn(column, F.transform(column, lambda x: F.try_divide(x, F.col("_t")))).drop("_t")


def published_chirp(rows: DataFrame, column: str, dt: float, shift: int = 1) -> DataFrame:
    """Chirp averages on the published grid: ``shift`` steps later, baseline taken off, largest size 1."""
    at = [CHIRP_SECONDS * i / (CHIRP_SAMPLES - 1) for i in range(CHIRP_SAMPLES)]
    return amplitude_one(rows.withColumn(column, interpolated(F.col(column), dt, at, shift * STEP)), column)


def published_bar(rows: DataFrame, column: str, dt: float, shift: int = -4) -> DataFrame:
    """Bar time courses on the published grid, turned by ``shift`` samples, baseline taken off, largest size 1."""
    v = interpolated(F.col(column), dt, [i * STEP for i in range(BAR_SAMPLES)], 0.0, True)
    d = rows.withColumn("_v", v)
    turned = F.transform(F.sequence(F.lit(0), F.lit(BAR_SAMPLES - 1)), lambda i: F.get("_v", F.pmod(i - shift, F.lit(BAR_SAMPLES))))
    return amplitude_one(d.withColumn(column, turned).drop("_v"), column)


def warped_chirp(rows: DataFrame, column: str, dt: float = STEP) -> DataFrame:
    """Chirp averages on the published grid, whose second 80 samples are a little longer, largest size 1."""
    step = [0.0]
    for i in range(1, CHIRP_SAMPLES):
        step.append(step[-1] + (1 / 7.5 if 80 <= i < 160 else STEP))
    d = rows.withColumn(column, interpolated(F.col(column), dt, step, STEP))
    return d.withColumn("_t", F.array_max(F.transform(column, F.abs))).withColumn(column, F.transform(column, lambda x: F.try_divide(x, F.col("_t")))).drop("_t")


def role_matrix(averages: DataFrame, unit: str, role: str, roles: list[str], vector: str, tolerance: float = 0.15) -> DataFrame:
    """Units that have a trace of every role, one column a role, each cut to the role's shortest; an error where lengths of a role
    differ by more than ``tolerance``."""
    size = averages.where(F.col(role).isin(*roles)).groupBy(role).agg(F.min(F.size(vector)).alias("_l"), F.max(F.size(vector)).alias("_h"))
    ok = F.when(F.col("_h") - F.col("_l") <= tolerance * F.col("_h"), F.col("_l")).otherwise(F.raise_error(F.lit("traces of a role differ in length")).cast("int"))
    cut = averages.join(size.select(role, ok.alias("_n")), role).select(unit, role, F.slice(vector, F.lit(1), F.col("_n")).alias("_v"))
    wide = cut.groupBy(unit).agg(*[F.max(F.when(F.col(role) == r, F.col("_v"))).alias(r) for r in roles])
    return wide.where(" and ".join(f"`{r}` is not null" for r in roles))


def roll_up(probs: DataFrame, key: str, levels: list[str], prob: str) -> DataFrame:
    """Summed probability of each class at each level of a hierarchy; one pass over unrolled levels."""
    each = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("class")) for c in levels])
    return probs.select(key, prob, F.explode(each).alias("e")).groupBy(key, "e.level", "e.class").agg(F.sum(prob).alias(prob))


def covariance(df: DataFrame, vector: str, scale: bool = True):
    """(means, deviations, covariance) of a vector column as numpy; with ``scale`` the covariance of the
    standardised columns. Sums are merged on the executors; only dimensions squared reach the driver."""
    import numpy as np
    import pandas as pd

    def part(batches):
        total = None
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["v"].to_numpy()).astype(float)
            new = len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0))
            total = new if total is None else _merged(total, new)
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "m": [total[1]], "s": [total[2].ravel()]})

    schema = "n long, m array<double>, s array<double>"
    v = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    sums = v.mapInPandas(part, schema)
    n, mean, s = None, None, None
    for r in sums.toLocalIterator():  # one row a partition, dim squared each
        new = r["n"], np.array(r["m"]), np.array(r["s"]).reshape(len(r["m"]), -1)
        n, mean, s = new if n is None else _merged((n, mean, s), new)
    c = s / n
    sd = np.sqrt(np.diag(c))
    safe = np.where(sd > 0, sd, 1.0)
    return mean, sd, c / safe[:, None] / safe if scale else c


def _merged(a, b):
    """Counts, means and centred products of two parts."""
    import numpy as np

    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def sparse_pca(df: DataFrame, vector: str, k: int, share: float = 0.2):
    """Standardised sparse components as column ``spc``; returns (frame, loadings, share of variance)."""
    from epochal.functions.fitting import sparse_components, spread_explained

    mean, sd, c = covariance(df, vector)
    loadings = sparse_components(c, k, share)
    each = []
    for row in loadings:
        w = [float(a / s) if s > 0 else 0.0 for a, s in zip(row, sd, strict=True)]
        each.append(dot(F.col(vector), F.array(*map(F.lit, w))) - F.lit(sum(a * float(b) for a, b in zip(w, mean, strict=True))))
    return df.withColumn("spc", F.array(*each)), loadings, spread_explained(c, loadings)


def agglomerative(df: DataFrame, vector: str, linkage: str = "ward", k: int | None = None, threshold: float | None = None, most: int = 4096, seed: int = 0, approximate: bool = False) -> DataFrame:
    """Adds ``cluster`` by bottom-up clustering of the distinct vectors, by rounds of reciprocal neighbours on the executors
    (:mod:`epochal.operators.hierarchy`), exact and without a limit.  With ``approximate``, ``most`` k-means centres, weighted by their members,
    stand for the vectors. A null vector has a null cluster."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from epochal.functions.fitting import agglomerate
    from epochal.operators import hierarchy

    if not approximate:
        return hierarchy.agglomerative(df, vector, linkage, k, threshold)
    d = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    m = KMeans(featuresCol="_v", predictionCol="_c", k=most, seed=seed).fit(d)
    out = m.transform(d)
    sizes = {r["_c"]: r["n"] for r in out.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``most`` rows
    label = agglomerate(np.array(m.clusterCenters()), np.array([sizes.get(i, 1) for i in range(len(m.clusterCenters()))], float), linkage, k, threshold)
    table = F.array(*[F.lit(int(c)) for c in label])
    none = df.where(F.col(vector).isNull()).withColumn("cluster", F.lit(None).cast("int"))
    return out.withColumn("cluster", F.get(table, F.col("_c"))).drop("_v", "_c").unionByName(none)
