"""Reads with sequencing errors: found by two clusters in the control, then by a classifier in the sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliqua.functions import tokens as K


def features(reads: DataFrame, tokens: str = "tokens") -> DataFrame:
    """reads with n_ratio and n_run: share of unknown tokens and their longest run."""
    nm = reads.withColumn("_nm", K.nm_tag(F.col(tokens)))
    return nm.withColumn("n_ratio", K.n_ratio(F.col("_nm"))).withColumn("n_run", K.longest_n_run(F.col("_nm")).cast("double")).withColumn("n_match", F.regexp_count("_nm", F.lit("M"))).drop("_nm")


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["n_ratio", "n_run"], outputCol="_x").transform(df)


def control_errors(control: DataFrame, seed: int = 1) -> DataFrame:
    """control with error: in the one of two clusters whose median match count is lower."""
    from pyspark.ml.clustering import KMeans

    x = _vector(features(control))
    kinds = x.select("n_ratio", "n_run").distinct().limit(2).count()
    if kinds < 2:  # nothing tells reads apart
        return x.drop("_x").withColumn("error", F.lit(False))
    made = KMeans(k=2, seed=seed, featuresCol="_x", predictionCol="_c").fit(x).transform(x)
    medians = {r["_c"]: r["m"] for r in made.groupBy("_c").agg(F.median("n_match").alias("m")).collect()}  # two rows
    bad = min(medians, key=medians.get) if len(medians) > 1 else -1
    return made.withColumn("error", F.col("_c") == bad).drop("_x", "_c")


def sample_errors(sample: DataFrame, control: DataFrame) -> DataFrame:
    """sample with error, by a logistic regression fitted to the control's (n_ratio, n_run, error)."""
    from pyspark.ml.classification import LogisticRegression

    kinds = control.select(F.min("error").alias("a"), F.max("error").alias("b"), F.count(F.lit(1)).alias("n")).first()
    rows = features(sample)
    if kinds["a"] == kinds["b"]:
        return rows.withColumn("error", F.lit(False))
    train = _vector(control).withColumn("_y", F.col("error").cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", regParam=1 / kinds["n"], standardization=False).fit(train)
    return model.transform(_vector(rows)).withColumn("error", F.col("_p") == 1).drop("_x", "_p", "rawPrediction", "probability")


def kept(rows: DataFrame, judged: DataFrame, read: str = "qname") -> tuple[DataFrame, DataFrame]:
    """rows of the reads without and with errors."""
    bad = judged.filter("error").select(read).distinct()
    return rows.join(bad, read, "left_anti"), rows.join(bad, read, "left_semi")


def normal_reads(sample: DataFrame, control: DataFrame, read: str = "qname") -> DataFrame:
    """Control reads whose mutations, weighted by how rare they are in the sample, look like the sample's (read, tokens)."""
    from ampliqua.operators import profile, stats

    each = [df.select(read, F.posexplode("tokens").alias("pos", "tok")) for df in (sample, control)]
    weights = profile.mask_weights(profile.onehot_percent(each[0], []))
    sums = [zeros.join(profile.masked_sums(e, weights, read), [read, "mut"], "left").select(read, "mut", F.coalesce("value", F.lit(0.0)).alias("value")) for e, df in zip(each, (sample, control), strict=True) for zeros in [df.select(read, F.explode(F.array(*map(F.lit, profile.MUTATIONS))).alias("mut"))]]
    return control.join(stats.normal_controls(*sums, read), read, "left_semi")


def n_filtered(control: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Control reads with no more unknown tokens than the mean of two clusters' centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = control.withColumn("_n", F.size(F.filter(tokens, K.is_n_tag)).cast("double"))
    if n.select("_n").distinct().limit(2).count() < 2:
        return control
    model = KMeans(k=2, seed=1, featuresCol="_x").fit(VectorAssembler(inputCols=["_n"], outputCol="_x").transform(n))
    limit = sum(float(c[0]) for c in model.clusterCenters()) / len(model.clusterCenters())
    return n.filter(F.col("_n") <= limit).drop("_n")
