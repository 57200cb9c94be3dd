"""Indexing, splitting, training, scoring and recommending."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligatable.operators.ordering import running_totals
from ligatable.operators.skew import salted_join
from ligatable.session import cut_lineage, name_checkpoints, shuffles_go, staging_path


@dataclass(frozen=True)
class AlsParams:
    """Training settings (fixed values, but for the seed and the blocks).

    The blocks belong to the model: start values are drawn per block, so another number
    gives other factors. They do not follow the cluster. An iteration runs one task a
    block, so take about as many as there are cores for large inputs.
    """

    algorithm: str = "ALS-explicit"
    rank: int = 20
    reg: float = 0.05
    iterations: int = 15
    implicit: bool = False
    seed: int = 42
    drug_blocks: int = 10
    target_blocks: int = 10


TOP_DRUGS = 5
TRAINING_PERCENT = 80
#: Ratings that are moved with a vector of factors at once.
RATINGS_A_PASS = 1 << 25


def label_index(pairs: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    """``(id, idx, rows)``: dense index from 0, most frequent id first, ties by id.

    The labels stay a table. Ranks come from a range-partitioned order, not from a
    window over everything, and nothing is held by the driver.
    """
    counted = pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).withColumn("one", F.lit(1))
    ranked = running_totals(counted, [F.col("rows").desc(), F.col(id_col)], ["one"])
    return ranked.select(id_col, (F.col("cum_one") - 1).alias(idx_col), "rows")


def extend_labels(labels: DataFrame, pairs: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    """``labels`` after another load of ``pairs``: old ids keep their index, new ones follow.

    New ids are numbered without gaps from the first free index, most frequent in this load
    first, ties by id; ``rows`` counts all loads. Null ids get no index. Only ids move: the
    load is counted by id before it meets the labels. Without labels this is ``label_index``.
    """
    counted = pairs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_more"))
    total = (F.coalesce("rows", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("rows")
    # both kinds of ids are read from one written copy
    met = cut_lineage(labels.join(counted, id_col, "full_outer").select(id_col, idx_col, total))
    known = met.filter(F.col(idx_col).isNotNull())
    free = known.agg(F.coalesce(F.max(idx_col) + 1, F.lit(0)).alias("free")).scalar()
    fresh = met.filter(F.col(idx_col).isNull()).select(id_col, "rows").withColumn("one", F.lit(1))
    ranked = running_totals(fresh, [F.col("rows").desc(), F.col(id_col)], ["one"])
    return known.unionByName(ranked.select(id_col, (F.col("cum_one") - 1 + free).alias(idx_col), "rows"))


def _encode(pairs: DataFrame, labels: DataFrame, id_col: str, idx_col: str) -> DataFrame:
    unseen = F.lit(labels.count())
    joined = salted_join(
        pairs, labels.select(id_col, idx_col), id_col, "left", counts=labels.select(id_col, "rows")
    )
    return joined.withColumn(idx_col, F.coalesce(F.col(idx_col), unseen).cast("double"))


def index_ids(pairs: DataFrame, drug_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """Add ``drug_idx`` and ``target_idx``; an id without a label gets the next free index.

    Label tables are read several times: pass stored ones.
    """
    encoded = _encode(pairs, drug_labels, "DrugID", "drug_idx")
    return _encode(encoded, target_labels, "TargetID", "target_idx").select(
        *pairs.columns, "drug_idx", "target_idx"
    )


def mark_split(pairs: DataFrame, percent: int = TRAINING_PERCENT) -> DataFrame:
    """Add ``is_training`` from a hash of the pair, the same whatever the partitioning."""
    digest = F.md5(F.concat_ws("|", "DrugID", "TargetID"))
    bucket = F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % 100
    return pairs.withColumn("is_training", bucket < percent)


def split_pairs(pairs: DataFrame, percent: int = TRAINING_PERCENT) -> tuple[DataFrame, DataFrame]:
    marked = mark_split(pairs, percent)
    training = marked.filter("is_training").drop("is_training")
    return training, marked.filter("NOT is_training").drop("is_training")


def drop_cold_start(test: DataFrame, training: DataFrame) -> DataFrame:
    """Test rows whose drug and target both occur in training; both tables are read several times."""
    known = test
    for key in ("DrugID", "TargetID"):
        counts = test.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        known = salted_join(known, training.select(key).distinct(), key, "left_semi", counts=counts)
    return known.select(*test.columns)


def train_als(training: DataFrame, params: AlsParams = AlsParams()) -> ALSModel:
    """Matrix factorization of ``(drug_idx, target_idx, NormalizedScore)``.

    Every iteration sends the factors of a drug to each block of targets that rates it. Those shuffle files
    only go where Spark checkpoints, so it does so in each iteration: the disk holds one, not ten. That changes
    no factor. The model is read back from a written copy, so the blocks of ratings go as well.
    """
    name_checkpoints(training.sparkSession)
    ratings = training.select(
        F.col("drug_idx").cast("int").alias("drug_idx"),
        F.col("target_idx").cast("int").alias("target_idx"),
        F.col("NormalizedScore").cast("float").alias("NormalizedScore"),
    )
    als = ALS(
        rank=params.rank,
        regParam=params.reg,
        maxIter=params.iterations,
        implicitPrefs=params.implicit,
        seed=params.seed,
        userCol="drug_idx",
        itemCol="target_idx",
        ratingCol="NormalizedScore",
        coldStartStrategy="drop",
        numUserBlocks=params.drug_blocks,
        numItemBlocks=params.target_blocks,
        checkpointInterval=1,
    )
    return _written(als.fit(ratings), training.sparkSession)


def _written(trained: ALSModel, spark: SparkSession) -> ALSModel:
    """``trained`` from a written copy; what training left in shuffle files and storage goes."""
    path = staging_path(spark, "model")
    trained.save(path)
    for factors in (trained.userFactors, trained.itemFactors):
        rdd = factors._jdf.rdd()
        # the rows stand on the table that Spark keeps of the factors, each step on one before
        while rdd.getStorageLevel().equals(spark._jvm.org.apache.spark.storage.StorageLevel.NONE()):
            rdd = rdd.dependencies().head().rdd()
        rdd.unpersist(False)
        rdd.cleanShuffleDependencies(False)
    return ALSModel.load(path)


def score_pairs(model: ALSModel, test: DataFrame) -> DataFrame:
    """Add ``prediction``, the product of the factors; rows without factors are dropped.

    Both factor joins are salted, as one drug or target may have very many test rows.
    ``test`` is read several times: pass a stored table.
    """

    def with_factors(rows: DataFrame, factors: DataFrame, key: str, name: str) -> DataFrame:
        counts = test.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        table = factors.select(F.col("id").cast("double").alias(key), F.col("features").alias(name))
        return salted_join(rows, table, key, counts=counts)

    scored = with_factors(test, model.userFactors, "drug_idx", "_drug")
    scored = with_factors(scored, model.itemFactors, "target_idx", "_target")
    products = F.zip_with("_drug", "_target", lambda a, b: a.cast("double") * b)
    prediction = F.aggregate(products, F.lit(0.0), lambda total, x: total + x).cast("float")
    return scored.select(*test.columns, prediction.alias("prediction"))


def drug_residuals(model: ALSModel, training: DataFrame, params: AlsParams) -> DataFrame:
    """``(drug_idx, residual, rows)``: how far each drug's factors are from solving their equations.

    Drugs are the side that is solved last. With the targets' factors ``v`` and ratings
    ``r``, the factors ``u`` of a drug with ``n`` ratings solve
    ``sum(v * (v . u - r)) + reg * n * u = 0``; the residual is the largest component.
    """
    return _in_passes(model.userFactors, "drug_idx", model.itemFactors, "target_idx", training, params)


def target_residuals(model: ALSModel, before: ALSModel, training: DataFrame, params: AlsParams) -> DataFrame:
    """``(target_idx, residual, rows)`` of the targets' factors, as ``drug_residuals`` does for drugs.

    Targets are solved first in an iteration, from the drugs' factors of the one before: those of
    ``before``, trained alike with one iteration less. They do not solve the last drugs' equations.
    """
    return _in_passes(model.itemFactors, "target_idx", before.userFactors, "drug_idx", training, params)


def _in_passes(
    solved: DataFrame, key: str, given: DataFrame, other: str, training: DataFrame, params: AlsParams
) -> DataFrame:
    """In passes over the solved side, each written before the next: a rating moves with a vector of factors."""
    with shuffles_go(training.sparkSession):
        passes = max(1, -(-training.count() // RATINGS_A_PASS))
        # by the remainder, as indices have no gaps and stand by falling number of ratings
        found = [
            cut_lineage(
                _residuals(
                    solved.filter(F.pmod("id", F.lit(passes)) == i),
                    key,
                    given,
                    other,
                    training.filter(F.pmod(F.col(key).cast("long"), F.lit(passes)) == i),
                    params,
                )
            )
            for i in range(passes)
        ]
    return reduce(DataFrame.unionByName, found)


def _residuals(
    solved: DataFrame, key: str, given: DataFrame, other: str, training: DataFrame, params: AlsParams
) -> DataFrame:
    ours = solved.select(F.col("id").cast("long").alias(key), F.col("features").alias("u"))
    theirs = given.select(F.col("id").cast("long").alias(other), F.col("features").alias("v"))
    product = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, x: t + x)
    # the solved side last: rows then lie by it, and its sums need no shuffle of their own, as keys are no doubles
    ratings = training.select(*(F.col(c).cast("long").alias(c) for c in (key, other)), "NormalizedScore")
    rated = ratings.join(theirs, other).join(ours, key).withColumn("error", product - F.col("NormalizedScore"))
    sums = [F.sum(F.col("v")[i] * F.col("error")).alias(f"s{i}") for i in range(params.rank)]
    summed = rated.groupBy(key).agg(*sums, F.count(F.lit(1)).alias("rows"), F.min("u").alias("u"))
    parts = [F.abs(F.col(f"s{i}") + params.reg * F.col("rows") * F.col("u")[i]) for i in range(params.rank)]
    return summed.select(key, F.greatest(*parts).alias("residual"), "rows")


def recommend_all(model: ALSModel, k: int = TOP_DRUGS) -> DataFrame:
    """The ``k`` best drugs of every target: ``(target_idx, recommendations)``.

    Factors are multiplied block by block and each block keeps only its best ``k``.
    """
    return model.recommendForAllItems(k)


def recommend_for_targets(model: ALSModel, targets: DataFrame, k: int = TOP_DRUGS) -> DataFrame:
    """The same for the targets in ``(target_idx)``, where a catalogue need not be scored whole."""
    return model.recommendForItemSubset(targets.select(F.col("target_idx").cast("int").alias("target_idx")), k)


def flatten_recommendations(nested: DataFrame) -> DataFrame:
    return nested.select("target_idx", F.explode("recommendations").alias("r")).select(
        "target_idx", F.col("r.drug_idx").alias("drug_idx"), F.col("r.rating").alias("score")
    )


def decode_ids(flat: DataFrame, drug_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """Indices back to ids by joins with the label tables.

    ``flat`` is written once before, as it may be dear: see ``salted_join``.
    """
    keyed = flat.withColumns({c: F.col(c).cast("long") for c in ("target_idx", "drug_idx")})
    named = salted_join(keyed, drug_labels.select("drug_idx", "DrugID"), "drug_idx")
    named = named.join(target_labels.select("target_idx", "TargetID"), "target_idx")
    return named.select("TargetID", "DrugID", "score")


def topk_drugs(scored: DataFrame, k: int = TOP_DRUGS) -> DataFrame:
    """The ``k`` best rows per target of ``(TargetID, DrugID, score)``, with ``Rank``.

    Filtering the rank right on the window makes Spark cut each group on the map
    side, so a target with very many rows sends at most ``k`` per task.
    """
    best_first = Window.partitionBy("TargetID").orderBy(F.col("score").desc(), F.col("DrugID"))
    return (
        scored.select("TargetID", "DrugID", "score")
        .withColumn("Rank", F.row_number().over(best_first))
        .filter(F.col("Rank") <= k)
    )


def nested_recommendations(topk: DataFrame) -> DataFrame:
    """One row per target with its array of ``(DrugID, score)``, best first.

    For top-k rows: a target has at most ``k`` of them.
    """
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "DrugID", "score")))
    items = F.transform(best_first, lambda r: F.struct(r["DrugID"].alias("DrugID"), r["score"].alias("score")))
    return topk.groupBy("TargetID").agg(items.alias("recommendations"))


@dataclass(frozen=True)
class Recommender:
    """A trained model with its label tables, its training pairs and its held-out pairs."""

    model: ALSModel
    drug_labels: DataFrame
    target_labels: DataFrame
    training: DataFrame
    test: DataFrame
    params: AlsParams

    def predictions(self) -> DataFrame:
        return score_pairs(self.model, self.test)

    def recommendations(self, k: int = TOP_DRUGS) -> DataFrame:
        flat = flatten_recommendations(recommend_all(self.model, k))
        return nested_recommendations(decode_ids(flat, self.drug_labels, self.target_labels))


def fit_recommender(
    pairs: DataFrame, params: AlsParams = AlsParams(), encoded: Callable[[], None] = lambda: None
) -> Recommender:
    """Index, split and train on ``(DrugID, TargetID, NormalizedScore)``.

    ``pairs`` is read several times; pass a stored or checkpointed table. Label tables
    and encoded rows are written once and then read by training, scoring and decoding;
    ``encoded`` is called when they stand, from where on ``pairs`` is not read.
    """
    with shuffles_go(pairs.sparkSession):
        drug_labels = cut_lineage(label_index(pairs, "DrugID", "drug_idx"))
        target_labels = cut_lineage(label_index(pairs, "TargetID", "target_idx"))
        training, test = split_pairs(cut_lineage(index_ids(pairs, drug_labels, target_labels)))
    encoded()
    return Recommender(train_als(training, params), drug_labels, target_labels, training, test, params)
