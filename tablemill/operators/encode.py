"""Categorical encoders. Fitting yields small tables of categories, applying is a projection or a join."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tablemill.functions.numbers import quoted, text_columns
from tablemill.operators.columns import worth_encoding
from tablemill.operators.joins import lookup, small_side
from tablemill.operators.profile import profile
from tablemill.operators.ranks import value_counts
from tablemill.operators.reports import value_shares
from tablemill.operators.types import dictionary


@dataclass(frozen=True)
class EncodingConfig:
    strategy: str = "one_hot"  # one_hot, count or hash
    min_frequency: float = 0.005
    max_categories: int = 20
    hash_bits: int = 8
    sparse_output: bool = True


def label_encode(df: DataFrame, cols: list[str], missing: str = "nan") -> DataFrame:
    """Replace every column by the position of its text in sorted order; gaps count as a text."""
    filled = df.select(*[F.coalesce(quoted(c).cast("string"), F.lit(missing)).alias(c) if c in cols else quoted(c)
                         for c in df.columns])
    codes = dictionary(filled, cols)
    out = filled
    for c in cols:
        table = codes.where(F.col("column") == c).select("value", F.col("code").cast("int").alias("_code"))
        out = lookup(out, table, c, "value").withColumn(c, F.col("_code")).drop("_code")
    return out


def categories_of(df: DataFrame, col: str) -> list[str]:
    """Sorted categories of one column. Each becomes a column of its own; for columns with very many,
    ``one_hot_vectors`` keeps them in one sparse vector instead."""
    return sorted(r["value"] for r in value_counts(df, [col]).select("value").collect())


def one_hot_columns(df: DataFrame, cols: list[str], categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Named 0/1 columns ``col_value`` in place of the originals; unknown values give zeros only."""
    categories = categories or {c: categories_of(df, c) for c in cols}
    rest = [quoted(c) for c in df.columns if c not in cols]
    return df.select(*rest, *[
        F.coalesce((quoted(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in cols for v in categories[c]])


def one_hot_vectors(df: DataFrame, col: str, out: str) -> DataFrame:
    """Sparse indicator vector of any number of categories, in sorted order of the values."""
    from pyspark.ml.feature import OneHotEncoder

    codes = dictionary(df, [col]).select("value", F.col("code").cast("double").alias("_code"))
    n = codes.count()
    coded = lookup(df, codes, col, "value").withColumn("_code", F.coalesce(F.col("_code"), F.lit(float(n))))
    model = OneHotEncoder(inputCol="_code", outputCol=out, dropLast=True, handleInvalid="keep")
    # one slot past the last category stands for unknown and is all zeros
    sizes = df.sparkSession.createDataFrame([(float(n - 1),)], "_code double")
    return model.fit(sizes).transform(coded).drop("_code")


def count_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    counts = value_counts(df, [col]).select("value", F.col("n").alias(out))
    return lookup(df, counts, col, "value")


def hash_bucket(col: str, bits: int = 8):
    """md5 bucket of the text, the same in every process."""
    head = F.conv(F.substring(F.md5(quoted(col).cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(2**bits))


def hash_indicators(df: DataFrame, col: str, n_components: int = 8) -> DataFrame:
    """``col_hash_0..`` indicator columns of the hashed value."""
    head = F.conv(F.substring(F.md5(quoted(col).cast("string")), 1, 8), 16, 10).cast("long")
    slot = F.pmod(head, F.lit(n_components))
    return df.withColumns({f"{col}_hash_{i}": F.coalesce((slot == i).cast("int"), F.lit(0))
                           for i in range(n_components)})


def frequent_values(df: DataFrame, cols: list[str], threshold: float) -> dict[str, list[str]]:
    """Values with at least ``threshold`` of the non-null rows: at most 1 / threshold per column."""
    rows = value_shares(df, cols).where(F.col("share") >= threshold).select("column", "value").collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["value"])
    return out


def handle_rare(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.01, strategy: str = "group",
                other: str = "Other") -> DataFrame:
    """Rare values become ``other`` (``group``) or their rows go (``drop``). NULL stays NULL.

    The frequent values are few by definition, so the test is an IN list, not a join.
    """
    cols = cols or text_columns(df)
    frequent = frequent_values(df, cols, threshold)
    if strategy == "group":
        return df.select(*[
            F.when(quoted(c).isNull() | quoted(c).isin(frequent[c]), quoted(c)).otherwise(F.lit(other)).alias(c)
            if c in cols else quoted(c) for c in df.columns])
    if strategy == "drop":
        for c in cols:
            df = df.where(quoted(c).isNull() | quoted(c).isin(frequent[c]))
        return df
    raise ValueError(f"unknown strategy {strategy}")


def rare_report(df: DataFrame, cols: list[str], threshold: float = 0.01) -> DataFrame:
    """(column, initial_categories, rare_categories) per column."""
    return value_shares(df, cols).groupBy("column").agg(
        F.count(F.lit(1)).alias("initial_categories"),
        F.count_if(F.col("share") < threshold).alias("rare_categories"))


def kept_categories(df: DataFrame, cols: list[str], min_frequency: float, max_categories: int,
                    ) -> dict[str, list[str]]:
    """Values kept per column: frequent ones, at least two, at most ``max_categories``.

    Ranked by count, then value. Only max(2, max_categories) values per column leave the executors.
    """
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    top = value_shares(df, cols).withColumn("rk", F.row_number().over(w)).where(
        F.col("rk") <= max(2, max_categories))
    keep = top.where((F.col("share") >= min_frequency) & (F.col("rk") <= max_categories) | (F.col("rk") <= 2))
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in keep.orderBy("column", "rk").collect():
        out[r["column"]].append(r["value"])
    return out


def limit_categories(df: DataFrame, cols: list[str], min_frequency: float = 0.005, max_categories: int = 20,
                     other: str = "Other", keep: dict[str, list[str]] | None = None) -> DataFrame:
    keep = keep or kept_categories(df, cols, min_frequency, max_categories)
    return df.select(*[
        F.when(quoted(c).isin(keep[c]), quoted(c)).otherwise(F.lit(other)).alias(c) if c in cols else quoted(c)
        for c in df.columns])


def encode_all(df: DataFrame, config: EncodingConfig | None = None, cols: list[str] | None = None,
               ) -> tuple[DataFrame, DataFrame]:
    """Encode every eligible text column and report (column, original, encoded, sparsity, prefix, strategy).

    Gaps become ``Unknown`` and rare values ``Other``. One projection over all columns.
    """
    config = config or EncodingConfig()
    p = profile(df)
    cols = cols or worth_encoding(p)
    filled = df.select(*[F.coalesce(quoted(c), F.lit("Unknown")).alias(c) if c in cols else quoted(c)
                         for c in df.columns])
    keep = kept_categories(filled, cols, config.min_frequency, config.max_categories)
    limited = limit_categories(filled, cols, keep=keep)
    prefix = {c: "col_" + h for c, h in zip(cols, _short_hashes(cols))}
    final = {}
    stats = []
    for c in cols:
        original = p[c].distinct + (1 if p[c].nulls else 0)
        values = sorted(keep[c] + (["Other"] if original > len(keep[c]) and "Other" not in keep[c] else []))
        final[c] = values
        sparsity = 1 - 1 / len(values) if config.strategy == "one_hot" and config.sparse_output else 0.0
        stats.append((c, original, len(values), sparsity, prefix[c], config.strategy))
    if config.strategy == "one_hot":
        encoded = one_hot_columns(limited, cols, final)
    elif config.strategy == "count":
        encoded = limited
        for c in cols:
            encoded = count_encode(encoded, c, f"{c}_count").drop(c)
    elif config.strategy == "hash":
        encoded = limited.withColumns({f"{c}_hash": hash_bucket(c, config.hash_bits) for c in cols}).drop(*cols)
    else:
        raise ValueError(f"unknown strategy {config.strategy}")
    report = df.sparkSession.createDataFrame(
        stats, "column string, original_categories long, encoded_categories long, sparsity double, "
               "file_prefix string, strategy string")
    return encoded, report


def _short_hashes(names: list[str]) -> list[str]:
    return [hashlib.md5(n.encode()).hexdigest()[:8] for n in names]


def encoding_effect(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """(stage, value, n): value counts before encoding and column sums of the indicators after it."""
    prefix = f"{col}_"
    indicators = [c for c in after.columns if c.startswith(prefix)]
    counts = value_counts(before, [col]).select(F.lit("before").alias("stage"), "value", "n")
    sums = after.agg(*[F.sum(quoted(c)).cast("long").alias(c) for c in indicators])
    long = sums.unpivot([], indicators, "value", "n").select(
        F.lit("after").alias("stage"), F.substring("value", len(prefix) + 1, 10_000).alias("value"), "n")
    return counts.unionByName(long)


class StoredEncoder:
    """Encoder whose category tables live in a folder; a column met again reuses its stored table."""

    def __init__(self, folder: str, method: str = "onehot", n_components: int = 8):
        self.folder, self.method, self.n_components = folder.rstrip("/"), method, n_components

    def _stored(self, spark, col: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.parquet(f"{self.folder}/{col}")
        except AnalysisException:
            return None

    def table(self, df: DataFrame, col: str) -> DataFrame:
        """Stored (value, n, code) of the column, fitted and written on first use."""
        found = self._stored(df.sparkSession, col)
        if found is None:
            dictionary(df, [col]).select("value", "n", "code").write.parquet(f"{self.folder}/{col}")
            found = self._stored(df.sparkSession, col)
        return found

    def encode(self, df: DataFrame, cols: list[str]) -> DataFrame:
        for c in [c for c in cols if c in df.columns]:
            if self.method == "onehot":
                table = self.table(df, c)
                values = [r["value"] for r in table.select("value").collect()]
                df = df.withColumns({f"{c}_{v}": F.coalesce((quoted(c) == v).cast("int"), F.lit(0))
                                     for v in sorted(values)})
            elif self.method == "hashing":
                df = hash_indicators(df, c, self.n_components)
            elif self.method == "count":
                counts = self.table(df, c).select("value", F.col("n").alias(f"{c}_count"))
                df = lookup(df, counts, c, "value")
            else:
                raise ValueError(f"unknown method {self.method}")
        return df


#: Numbers that ``cluster_categories`` gives to words by hash, whatever the size of the vocabulary.
WORD_FEATURES = 1 << 18


def cluster_categories(df: DataFrame, col: str, n_clusters: int = 5, seed: int = 42) -> DataFrame:
    """(value, n, cluster): group the texts of a column by tf-idf weight and k-means.

    Works on distinct values weighted by their counts, so repeated texts cost one row. Document
    frequencies are sums of those counts, one per word, in a table that stays in Spark. Every word counts;
    words are numbered by hash modulo ``WORD_FEATURES``, and two words of one number add their weights.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer, RegexTokenizer
    from pyspark.ml.linalg import Vectors, VectorUDT

    values = value_counts(df, [col]).select("value", "n")
    tokens = RegexTokenizer(inputCol="value", outputCol="words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2
                            ).transform(values)
    total = df.where(quoted(col).isNotNull()).count()
    counts = tokens.select("value", "n", F.explode("words").alias("word")).groupBy("value", "n", "word").agg(
        F.count(F.lit(1)).alias("times"))
    rarity = counts.groupBy("word").agg((F.log((1 + F.lit(total)) / (1 + F.sum("n"))) + 1).alias("idf"))
    width = WORD_FEATURES
    weighted = counts.join(rarity, "word").groupBy("value", F.pmod(F.xxhash64("word"), F.lit(width)).cast("int").alias("at")).agg(
        F.sum(F.col("times") * F.col("idf")).alias("weight"))
    pieces = weighted.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("pieces"))
    vector = F.udf(lambda p: Vectors.sparse(width, [x["at"] for x in p or []], [x["weight"] for x in p or []]), VectorUDT())
    rows = values.join(pieces, "value", "left").select("value", "n", vector("pieces").alias("weighted"))
    features = Normalizer(inputCol="weighted", outputCol="features").transform(rows)
    kmeans = KMeans(k=n_clusters, seed=seed, weightCol="n", featuresCol="features", predictionCol="cluster")
    return kmeans.fit(features).transform(features).select("value", "n", "cluster")


def encode_by_cluster(df: DataFrame, cols: list[str], n_clusters: int = 5, seed: int = 42, missing: str = "nan") -> DataFrame:
    """``df`` with every value of the columns replaced by its cluster; NULL counts as the text ``missing``."""
    out = df
    for c in cols:
        filled = out.withColumn(c, F.coalesce(quoted(c).cast("string"), F.lit(missing)))
        table = cluster_categories(filled, c, n_clusters, seed).select("value", F.col("cluster").alias("_cluster"))
        out = lookup(filled, table, c, "value").withColumn(c, F.col("_cluster")).drop("_cluster")
    return out.select(*[quoted(c) for c in df.columns])
