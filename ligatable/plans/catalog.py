"""Every operator as a query over the given tables.

Doubles are rounded to six digits and arrays are written as text at the very end,
so that results can be compared with another engine; the operators themselves
return full precision and real arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ligatable.functions import labels, payloads, scores
from ligatable.operators import compounds, disease, evaluate, integrate, model, network, ppi, profile, recommend, retrieval
from ligatable.session import cut_lineage, drop_staged, shuffles_go, staging_path
from ligatable.sources import files, fixtures, tables
from ligatable.sources.registry import source_names

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6
LONG_LIST = 25
DATA_CUT = 5.0
#: Largest residual of a drug's normal equations, per rating; factors are single precision.
RESIDUAL = 1e-3
LOOKUP_TARGET = "P00007"
LOOKUP_DRUG = "17"
BLOOM_DRUGS = 100_000
#: Small, so that the test tables have several blocks.
FACTOR_BLOCK = 64
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name."""
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *(
            F.round(F.col(f"`{f.name}`").cast("double"), DIGITS).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def _recommendation_text() -> Column:
    def entry(r: Column) -> Column:
        return F.concat(r["DrugID"], F.lit(":"), r["score"].cast("decimal(10,6)").cast("string"))

    return F.concat_ws(",", F.transform("recommendations", entry))


# --- tables the queries start from -------------------------------------------------


def canonical(spark: SparkSession, folder: str) -> DataFrame:
    raw = fixtures.raw_affinity(spark, folder)
    return integrate.canonical_affinity(raw, "drug_id", "target_id", "affinity", F.col("source").alias("Source"))


def valid(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.valid_affinity(canonical(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.score_affinity(valid(spark, folder))


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.minmax_by_source(scored(spark, folder))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.integrated_pairs(normalized(spark, folder))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return ppi.ppi_edges(ppi.ppi_confidence(fixtures.raw_ppi(spark, folder)))


def edges_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    secondary = ppi.ppi_confidence(fixtures.raw_ppi_secondary(spark, folder))
    return ppi.ppi_with_fallback(cut_lineage(edges(spark, folder)), secondary)


def measured(spark: SparkSession, folder: str, k: int = model.TOP_DRUGS) -> DataFrame:
    return recommend.measured_recommendations(comparable_pairs(spark, folder), k)


def comparable_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with scores rounded before they are ranked, so that ties do not depend on the engine."""
    return pairs(spark, folder).withColumn("NormalizedScore", F.round("NormalizedScore", DIGITS))


def stored_measured(spark: SparkSession, folder: str, k: int = model.TOP_DRUGS) -> DataFrame:
    """The recommendations written once, as the training job does, for views that read them several times."""
    return cut_lineage(measured(spark, folder, k))


def nested(spark: SparkSession, folder: str, k: int = model.TOP_DRUGS) -> DataFrame:
    return model.nested_recommendations(measured(spark, folder, k))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("TargetID").distinct()


def drugs(spark: SparkSession, folder: str) -> DataFrame:
    return canonical(spark, folder).select("DrugID").distinct()


def stored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Training pairs written once, for steps that read them several times."""
    return cut_lineage(integrate.training_pairs(pairs(spark, folder)))


def label_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    drug_labels = cut_lineage(model.label_index(rows, "DrugID", "drug_idx"))
    return drug_labels, cut_lineage(model.label_index(rows, "TargetID", "target_idx"))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    training, test = model.split_pairs(stored_pairs(spark, folder))
    return evaluate.baseline_predictions(training, test, DIGITS)


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    proteins = payloads.parse_protein_json(fixtures.protein_payload(spark, folder))
    return disease.target_annotation(proteins.select(F.col("accession").alias("TargetID")), proteins)


def keyed_targets(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(disease.with_gene_key(annotated(spark, folder), gene_ids(spark, folder)))


def gene_ids(spark: SparkSession, folder: str) -> DataFrame:
    return payloads.gene_id_from_search(fixtures.gene_search_payload(spark, folder))


def associations(spark: SparkSession, folder: str) -> DataFrame:
    return disease.associations_by_gene(fixtures.gene_disease(spark, folder))


def stored_associations(spark: SparkSession, folder: str) -> DataFrame:
    """Written once, for views that join, count and look them up."""
    return cut_lineage(associations(spark, folder))


def compound_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.compound_cid(spark, folder), fixtures.compound_xref(spark, folder)


def leads(spark: SparkSession, folder: str) -> DataFrame:
    by_cid, by_xref = compound_tables(spark, folder)
    properties = fixtures.compound_property(spark, folder)
    return compounds.lead_compound(stored_measured(spark, folder), by_cid, by_xref, properties)


def _stored(df: DataFrame, name: str, *cluster_by: str) -> DataFrame:
    path = staging_path(df.sparkSession, name)
    tables.save_table(df, path, cluster_by=cluster_by)
    return tables.load_table(df.sparkSession, path)


def _affinity_files(spark: SparkSession, folder: str) -> str:
    path = staging_path(spark, "affinity")
    for source, df in fixtures.source_frames(spark, folder):
        df.write.csv(f"{path}/{source.file}", header=True, sep=files.SEPARATORS[source.format])
    return path


# --- scans, sources, sinks -----------------------------------------------------------


@query
def read_affinity(spark: SparkSession, folder: str) -> DataFrame:
    found = files.available_sources(spark, _affinity_files(spark, folder))
    return integrate.union_sources(
        [
            integrate.tag_source(integrate.canonical_affinity(df, s.drug_col, s.target_col, s.score_col), s.name)
            for s, df in found
        ]
    )


@query
def available_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the sources whose file is there; one file is left out."""
    path = staging_path(spark, "some_sources")
    for source, df in fixtures.source_frames(spark, folder):
        if source.name != "Ki":
            df.write.csv(f"{path}/{source.file}", header=True, sep=files.SEPARATORS[source.format])
    found = [integrate.tag_source(df.select(), s.name) for s, df in files.available_sources(spark, path)]
    return integrate.union_sources(found).groupBy("Source").agg(F.count(F.lit(1)).alias("rows"))


@query
def source_registry(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.load_sources(files.available_sources(spark, _affinity_files(spark, folder)))


@query
def read_ppi(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "links")
    fixtures.raw_ppi(spark, folder).write.csv(path, header=True, sep=files.SEPARATORS["ssv"])
    links = files.read_ppi(spark, path)
    return links.select("protein1", "protein2", F.col("combined_score").try_cast("bigint").alias("combined_score"))


@query
def load_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_stored(edges(spark, folder), "ppi_edges", "ProteinA", "ProteinB"))


@query
def save_table(spark: SparkSession, folder: str) -> DataFrame:
    stored = _stored(pairs(spark, folder), "integrated_interactions")
    return rounded(stored.withColumn("Sources", F.concat_ws(",", "Sources")))


@query
def bucketed_store(spark: SparkSession, folder: str) -> DataFrame:
    """Recommended drugs with what is measured of them, from two tables stored in equal buckets."""
    by_target = tables.Buckets(("TargetID",), int(spark.conf.get("spark.sql.shuffle.partitions")))
    measured_pairs = tables.save_bucketed(pairs(spark, folder), staging_path(spark, "bucketed_pairs"), by_target)
    predicted = tables.save_bucketed(nested(spark, folder), staging_path(spark, "bucketed_predictions"), by_target)
    return rounded(recommend.measured_evidence(predicted, measured_pairs))


@query
def export_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "predictions_csv")
    tables.export_csv(recommend.ranked_recommendations(nested(spark, folder)), path)
    schema = "TargetID STRING, Rank INT, DrugID STRING, PredictedScore DOUBLE, predictions STRING"
    return spark.read.schema(schema).csv(path, header=True, escape='"')


@query
def prediction_for_target(spark: SparkSession, folder: str) -> DataFrame:
    stored = _stored(nested(spark, folder), "predicted_interactions", "TargetID")
    found = tables.prediction_for_target(stored, LOOKUP_TARGET)
    return found.select("TargetID", _recommendation_text().alias("recommendations"))


@query
def predictions_of_drug(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of one drug, from recommendations stored by target with a Bloom filter of the drugs."""
    path = staging_path(spark, "ranked")
    ranked = recommend.ranked_recommendations(nested(spark, folder, LONG_LIST))
    tables.save_table(ranked, path, cluster_by=("TargetID", "Rank"), bloom={"DrugID": BLOOM_DRUGS})
    return tables.predictions_of_drug(tables.load_table(spark, path), LOOKUP_DRUG)


# --- projections, filters, predicates --------------------------------------------------


@query
def canonical_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return canonical(spark, folder).drop("Source")


@query
def tag_source(spark: SparkSession, folder: str) -> DataFrame:
    tagged = [
        integrate.tag_source(df.select(F.col(s.drug_col).alias("DrugID")), s.name)
        for s, df in fixtures.source_frames(spark, folder)
    ]
    return integrate.union_sources(tagged)


@query
def valid_affinity(spark: SparkSession, folder: str) -> DataFrame:
    return valid(spark, folder)


@query
def training_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(integrate.training_pairs(pairs(spark, folder)))


@query
def ppi_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ppi.ppi_confidence(fixtures.raw_ppi(spark, folder)))


@query
def human_targets(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.human_targets(targets(spark, folder))


@query
def list_targets(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.list_targets(measured(spark, folder))


@query
def drop_cold_start(spark: SparkSession, folder: str) -> DataFrame:
    training, test = model.split_pairs(stored_pairs(spark, folder))
    return rounded(model.drop_cold_start(test, training))


@query
def binarize_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.binarize_label(baseline(spark, folder)))


def checked_raw(spark: SparkSession, folder: str) -> DataFrame:
    raw = fixtures.raw_text_affinity(spark, folder)
    return integrate.checked_affinity(raw, "drug_id", "target_id", "affinity", F.col("source").alias("Source"))


@query
def reject_report(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of each source: valid ones and those that break each rule first."""
    return integrate.reject_report(checked_raw(spark, folder))


@query
def rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    rejects = integrate.rejected_rows(checked_raw(spark, folder))
    return rejects.select("Source", "Rule", "DrugID", "TargetID", "ScoreText")


# --- scalar functions --------------------------------------------------------------------


@query
def pscale(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scored(spark, folder).select("DrugID", "TargetID", "Source", "RawScore", "AffinityScore"))


@query
def affinity_type(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("DrugID", "TargetID", "Source", "AffinityType")


@query
def pscale_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.pscale_curve_support(valid(spark, folder), digits=9))


@query
def strong_binders(spark: SparkSession, folder: str) -> DataFrame:
    strong = integrate.strong_binders(normalized(spark, folder), DATA_CUT)
    return rounded(strong.select("DrugID", "TargetID", "Source", "AffinityScore"))


@query
def rounded_score(spark: SparkSession, folder: str) -> DataFrame:
    # unmeasured rows show what a missing score turns into
    rows = canonical(spark, folder)
    return rows.select("DrugID", "TargetID", "Source", scores.rounded_score(F.col("RawScore")).alias("score"))


@query
def display_label(spark: SparkSession, folder: str) -> DataFrame:
    ids = canonical(spark, folder).select("DrugID", "TargetID").distinct()
    target, drug = F.col("TargetID"), F.col("DrugID")
    return ids.select(
        "DrugID",
        "TargetID",
        labels.display_label(target, labels.TARGET_LABEL).alias("target_label"),
        labels.display_label(drug, labels.DRUG_LABEL).alias("drug_label"),
        labels.display_label(target, labels.TARGET_LABEL, ellipsis="").alias("neighbor_label"),
        labels.display_label(drug, labels.COMPOUND_NAME, ellipsis="").alias("compound_label"),
    )


@query
def numeric_id(spark: SparkSession, folder: str) -> DataFrame:
    return drugs(spark, folder).withColumn("is_numeric", labels.numeric_id(F.col("DrugID")))


@query
def edge_strength(spark: SparkSession, folder: str) -> DataFrame:
    neighbors = ppi.ppi_neighbors(edges(spark, folder))
    return rounded(network.edge_strength(measured(spark, folder), neighbors))


@query
def disease_tier(spark: SparkSession, folder: str) -> DataFrame:
    rows = associations(spark, folder)
    return rounded(rows.select("Gene", "Disease", "Score", scores.disease_tier(F.col("Score")).alias("Tier")))


# --- windows, ranks, top-k ----------------------------------------------------------------


@query
def minmax_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(normalized(spark, folder))


@query
def topk_drugs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(measured(spark, folder))


@query
def ranked_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.ranked_recommendations(nested(spark, folder))


@query
def ppi_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ppi.ppi_neighbors(edges(spark, folder), targets(spark, folder)))


@query
def lead_compound(spark: SparkSession, folder: str) -> DataFrame:
    return leads(spark, folder)


@query
def lead_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Lead, properties and rule of five of each target in one row."""
    properties = fixtures.compound_property(spark, folder)
    found = compounds.compound_properties(leads(spark, folder).drop("Rank"), properties)
    return rounded(compounds.lipinski_screen(found))


@query
def top_diseases(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(disease.top_diseases(associations(spark, folder)))


@query
def cumulative_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return profile.cumulative_pairs(profile.pairs_by_source(pairs(spark, folder)))


@query
def top_scores_head(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.top_scores_head(recommend.ranked_recommendations(nested(spark, folder, LONG_LIST)))


# --- aggregations ---------------------------------------------------------------------------


@query
def integrated_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(pairs(spark, folder).withColumn("Sources", F.concat_ws(",", "Sources")))


@query
def incremental_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Three loads, the last with a source that moves and one that is split, integrated from stored sums."""
    rows = scored(spark, folder)
    late = F.col("Source") == "Ki"
    split = (F.col("Source") == "KIBA") & (F.length("DrugID") % 2 == 0)
    path = staging_path(spark, "partial_scores")
    for part in (~late & ~split, split, late):
        tables.save_table(integrate.partial_scores(rows.filter(part)), path, mode="append")
    done = integrate.pairs_of_partials(tables.load_table(spark, path))
    return rounded(done.withColumn("Sources", F.concat_ws(",", "Sources")))


@query
def dedup_report(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.dedup_report(pairs(spark, folder))


@query
def overview_stats(spark: SparkSession, folder: str) -> DataFrame:
    latest = evaluate.latest_metrics(fixtures.metrics_history(spark, folder), "run_ts", "run_id")
    return rounded(profile.overview_stats(pairs(spark, folder), edges(spark, folder), latest))


@query
def source_choices(spark: SparkSession, folder: str) -> DataFrame:
    """Every choice of sources: its exact counts, and whether stored sketches of two loads come near them."""
    rows = valid(spark, folder)
    path = staging_path(spark, "sketches")
    for part in (F.length("DrugID") % 2 == 0, F.length("DrugID") % 2 == 1):
        tables.save_table(profile.source_sketches(rows.filter(part)), path, mode="append")
    names = source_names()
    chosen = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("Source")) for i, n in enumerate(names))))
    numbered = spark.range(1, 2 ** len(names)).select(F.col("id").alias("choice"), chosen.alias("s"))
    choices = numbered.filter(F.expr("shiftright(choice, s.i) & 1 = 1")).select("choice", "s.Source")
    near = profile.distinct_of_choices(tables.load_table(spark, path), choices)
    for column in ("DrugID", "TargetID"):
        exact = profile.exact_of_choices(rows, choices, column).withColumnRenamed(column, f"{column}_exact")
        off = F.abs(F.col(column) - F.col(f"{column}_exact"))
        close = off <= 4 * profile.SKETCH_ERROR * F.col(f"{column}_exact") + 1
        near = near.join(exact, "choice").withColumn(f"{column}_near", close).drop(column)
    return near


@query
def pairs_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.pairs_by_source(pairs(spark, folder)))


@query
def nested_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return nested(spark, folder).select("TargetID", _recommendation_text().alias("recommendations"))


@query
def recommendation_count(spark: SparkSession, folder: str) -> DataFrame:
    proteins = fixtures.protein(spark, folder).select(F.col("accession").alias("TargetID"))
    return recommend.recommendation_count(proteins, measured(spark, folder))


@query
def disease_tier_counts(spark: SparkSession, folder: str) -> DataFrame:
    return disease.disease_tier_counts(keyed_targets(spark, folder), associations(spark, folder))


@query
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    scores_of_pairs = comparable_pairs(spark, folder).select("TargetID", "DrugID", F.col("NormalizedScore").alias("score"))
    return rounded(recommend.score_histogram(cut_lineage(scores_of_pairs)))


@query
def latest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.latest_metrics(fixtures.metrics_history(spark, folder), "run_ts", "run_id"))


@query
def source_quality(spark: SparkSession, folder: str) -> DataFrame:
    # written once, as the integration job does: the quality of a source is read in several passes
    stored_rows = integrate.minmax_by_source(_stored(scored(spark, folder), "scored"))
    return rounded(profile.source_quality(canonical(spark, folder), stored_rows, digits=DIGITS))


# --- set operations and lookups ------------------------------------------------------------


@query
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    return integrate.load_sources(fixtures.source_frames(spark, folder))


@query
def ppi_edges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(edges(spark, folder))


@query
def ppi_undirected(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ppi.ppi_undirected(edges(spark, folder)))


@query
def ppi_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(edges_with_fallback(spark, folder))


@query
def target_ppi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ppi.target_ppi(targets(spark, folder), edges(spark, folder)))


@query
def target_annotation(spark: SparkSession, folder: str) -> DataFrame:
    proteins = payloads.parse_protein_json(fixtures.protein_payload(spark, folder))
    # neighbours of the secondary source are looked up under their id and under an unknown one
    known = targets(spark, folder)
    unknown = known.select(F.concat(F.lit("X"), "TargetID").alias("TargetID"))
    return disease.target_annotation(known.unionByName(unknown), proteins)


@query
def disease_associations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(disease.disease_associations(keyed_targets(spark, folder), stored_associations(spark, folder)))


@query
def disease_associations_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """From the payloads to the view: parsed associations under the gene ids that were looked up."""
    parsed = payloads.parse_disease_json(fixtures.disease_payload(spark, folder))
    ids = gene_ids(spark, folder)
    under_keys = parsed.join(ids, "gene_symbol", "left").select(
        disease.gene_key(F.col("gene_id"), F.col("gene_symbol")).alias("gene_key"),
        F.col("gene_symbol").alias("Gene"),
        "Disease",
        "Score",
        "Source",
    )
    return rounded(disease.disease_associations(keyed_targets(spark, folder), cut_lineage(under_keys)))


@query
def ppi_fallback_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """From the payloads to the view: parsed partners where a protein has no local edge."""
    parsed = payloads.parse_ppi_json(fixtures.ppi_payload(spark, folder))
    confident = parsed.filter(F.col("ConfidenceScore") >= ppi.CONFIDENCE)
    return rounded(ppi.ppi_with_fallback(cut_lineage(edges(spark, folder)), confident))


@query
def resolve_compound_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """From the payloads to the view: one parsed record per compound id."""
    parsed = payloads.parse_compound_json(fixtures.compound_payload(spark, folder)).select(
        "drug_id", "smiles", F.col("name").alias("title"), F.lit(None).cast("string").alias("iupac_name")
    )
    return compounds.resolve_compound(drugs(spark, folder), parsed, parsed.limit(0)).drop("via")


@query
def resolve_compound(spark: SparkSession, folder: str) -> DataFrame:
    return compounds.resolve_compound(drugs(spark, folder), *compound_tables(spark, folder))


@query
def compound_properties(spark: SparkSession, folder: str) -> DataFrame:
    resolved = compounds.resolve_compound(drugs(spark, folder), *compound_tables(spark, folder))
    properties = fixtures.compound_property(spark, folder)
    return rounded(compounds.compound_properties(resolved.select("DrugID", "smiles"), properties))


@query
def network_edges(spark: SparkSession, folder: str) -> DataFrame:
    neighbors = ppi.ppi_neighbors(edges_with_fallback(spark, folder))
    return rounded(network.network_edges(stored_measured(spark, folder), neighbors))


@query
def network_nodes(spark: SparkSession, folder: str) -> DataFrame:
    neighbors = ppi.ppi_neighbors(edges_with_fallback(spark, folder))
    return network.network_nodes(network.network_edges(stored_measured(spark, folder), neighbors))


# --- model -------------------------------------------------------------------------------------


def _fitted(spark: SparkSession, folder: str) -> model.Recommender:
    """The trained model; what its steps shuffled, and the pairs it was made of, are gone."""
    path = staging_path(spark, "pairs")
    with shuffles_go(spark):
        tables.save_table(integrate.training_pairs(pairs(spark, folder)), path, compression="zstd")
    return model.fit_recommender(tables.load_table(spark, path), encoded=lambda: drop_staged(spark, path))


def _encoded_recommendations(rows: DataFrame, by_drug: DataFrame, by_target: DataFrame) -> DataFrame:
    """Measured recommendations under indices, in the shape the trained model returns."""
    encoded = model.index_ids(
        recommend.measured_recommendations(rows.withColumn("NormalizedScore", F.round("NormalizedScore", DIGITS))),
        by_drug,
        by_target,
    )
    entry = F.struct("Rank", F.col("drug_idx").cast("int").alias("drug_idx"), F.col("score").alias("rating"))
    in_order = F.array_sort(F.collect_list(entry))
    recommendations = F.transform(in_order, lambda r: F.struct(r["drug_idx"].alias("drug_idx"), r["rating"].alias("rating")))
    return encoded.groupBy(F.col("target_idx").cast("int").alias("target_idx")).agg(
        recommendations.alias("recommendations")
    )


@query
def index_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_pairs(spark, folder)
    return rounded(model.index_ids(rows, *label_tables(rows)))


@query
def growing_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Both label tables after three loads; ids of earlier loads keep their index."""
    rows = stored_pairs(spark, folder)
    found = []
    for side, idx, other in (("DrugID", "drug_idx", "TargetID"), ("TargetID", "target_idx", "DrugID")):
        load = F.ascii(F.substring(other, -1, 1)) % 3
        labels = cut_lineage(model.label_index(rows.filter(load == 0), side, idx))
        for k in (1, 2):
            labels = cut_lineage(model.extend_labels(labels, rows.filter(load == k), side, idx))
        found.append(labels.select(F.lit(side).alias("side"), F.col(side).alias("id"), F.col(idx).alias("idx"), "rows"))
    return found[0].unionByName(found[1])


@query
def split_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(model.mark_split(integrate.training_pairs(pairs(spark, folder))))


@query
def train_als(spark: SparkSession, folder: str) -> DataFrame:
    fitted = _fitted(spark, folder)

    def factors(side: str, table: DataFrame, names: DataFrame, idx: str, name: str) -> DataFrame:
        squares = F.aggregate("features", F.lit(0.0), lambda total, x: total + x * x)
        named = table.withColumn(idx, F.col("id").cast("long")).join(names, idx)
        return named.select(
            F.lit(side).alias("side"),
            F.col(name).alias("id"),
            F.size("features").alias("factors"),
            F.sqrt(squares).alias("norm"),
        )

    user = factors("drug", fitted.model.userFactors, fitted.drug_labels, "drug_idx", "DrugID")
    item = factors("target", fitted.model.itemFactors, fitted.target_labels, "target_idx", "TargetID")
    unsolved = model.drug_residuals(fitted.model, fitted.training, fitted.params).filter(
        F.col("residual") > RESIDUAL * F.col("rows")
    )
    wrong = unsolved.join(fitted.drug_labels, "drug_idx").select(F.lit("drug").alias("side"), F.col("DrugID").alias("id"))
    marked = user.unionByName(item).join(wrong.withColumn("wrong", F.lit(True)), ["side", "id"], "left")
    return marked.select("side", "id", "factors", (F.col("wrong").isNull() & (F.col("norm") > 0)).alias("solved"))


@query
def train_als_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each target's factors solve their equations for the drugs of the iteration before."""
    fitted = _fitted(spark, folder)
    before = model.train_als(fitted.training, replace(fitted.params, iterations=fitted.params.iterations - 1))
    found = model.target_residuals(fitted.model, before, fitted.training, fitted.params)
    solved = (F.col("residual") <= RESIDUAL * F.col("rows")).alias("solved")
    return found.join(fitted.target_labels.select("target_idx", "TargetID"), "target_idx").select("TargetID", "rows", solved)


@query
def score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every scored pair, and whether its score is what the trained model itself computes."""
    fitted = _fitted(spark, folder)
    # one after the other, as each of them moves every row with its factors
    with shuffles_go(spark):
        ours = cut_lineage(fitted.predictions().select("DrugID", "TargetID", "NormalizedScore", "prediction"))
        expected = F.col("prediction").alias("expected")
        theirs = cut_lineage(fitted.model.transform(fitted.test).select("DrugID", "TargetID", expected))
    same = F.abs(F.col("prediction") - F.col("expected")) < 1e-4
    return rounded(
        ours.join(theirs, ["DrugID", "TargetID"], "left").select(
            "DrugID", "TargetID", "NormalizedScore", F.coalesce(same, F.lit(False)).alias("is_product")
        )
    )


@query
def rmse(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.rmse(baseline(spark, folder)))


@query
def aupr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.aupr(evaluate.binarize_label(baseline(spark, folder))))


@query
def flatten_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_pairs(spark, folder)
    return rounded(model.flatten_recommendations(_encoded_recommendations(rows, *label_tables(rows))))


@query
def decode_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_pairs(spark, folder)
    by_drug, by_target = label_tables(rows)
    flat = model.flatten_recommendations(_encoded_recommendations(rows, by_drug, by_target))
    return rounded(model.decode_ids(flat, by_drug, by_target))


@query
def metrics_record(spark: SparkSession, folder: str) -> DataFrame:
    """The settings, and whether Spark's own evaluators give the recorded metrics."""
    fitted = _fitted(spark, folder)
    with shuffles_go(spark):
        predictions = cut_lineage(fitted.predictions())
    rmse = RegressionEvaluator(metricName="rmse", labelCol="NormalizedScore").evaluate(predictions)
    curve = BinaryClassificationEvaluator(
        metricName="areaUnderPR", labelCol="TrueLabel", rawPredictionCol="prediction", numBins=0
    ).evaluate(evaluate.binarize_label(predictions))
    with shuffles_go(spark):
        record = evaluate.metrics_record(predictions, fitted.params)
    return record.select(
        *(c for c in record.columns if c not in ("rmse", "aupr", "timestamp")),
        (F.abs(F.col("rmse") - rmse) < 1e-9).alias("rmse_recomputed"),
        (F.abs(F.col("aupr") - curve) < 1e-9).alias("aupr_recomputed"),
    )


@query
def score_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(recommend.score_trend(recommend.ranked_recommendations(nested(spark, folder, LONG_LIST))))


@query
def als_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Per target the entries, and whether they are the best products of the factors, in order."""
    fitted = _fitted(spark, folder)
    by_rank = F.posexplode(F.transform("recommendations", lambda r: F.struct(r["DrugID"].alias("d"), r["score"].alias("s"))))
    with shuffles_go(spark):
        listed = (
            fitted.recommendations()
            .select("TargetID", F.size("recommendations").alias("entries"), by_rank)
            .select("TargetID", "entries", (F.col("pos") + 1).alias("Rank"), "col.*")
        )
        top, _ = retrieval.bounded_top(fitted.model.userFactors, fitted.model.itemFactors)
        best = model.decode_ids(top, fitted.drug_labels, fitted.target_labels).withColumn(
            "Rank", F.row_number().over(Window.partitionBy("TargetID").orderBy(F.desc("score"), "DrugID"))
        )
    # factors are single precision: drugs within the last digits may change places
    near = F.abs(F.col("s") - F.col("score")) < 1e-4
    return (
        listed.join(best.select("TargetID", "Rank", "score"), ["TargetID", "Rank"], "left")
        .groupBy("TargetID")
        .agg(
            F.max("entries").alias("entries"),
            F.coalesce(F.bool_and(near), F.lit(False)).alias("are_best"),
            (F.count_distinct("d") == F.max("entries")).alias("all_different"),
        )
    )


@query
def bounded_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """The best drugs of every target by the product of factors that the tables give."""
    drug, target = fixtures.drug_factors(spark, folder), fixtures.target_factors(spark, folder)
    top, _ = retrieval.bounded_top(drug, target, size=FACTOR_BLOCK)
    return rounded(top.select("target_idx", "drug_idx", F.col("Rank").cast("int").alias("Rank"), "score"))


@query
def bounded_reach(spark: SparkSession, folder: str) -> DataFrame:
    """How many of all blocks of drugs each target needs for its best ones."""
    drug, target = fixtures.drug_factors(spark, folder), fixtures.target_factors(spark, folder)
    return retrieval.bounded_top(drug, target, size=FACTOR_BLOCK)[1]


# --- payloads ----------------------------------------------------------------------------------


@query
def parse_protein_json(spark: SparkSession, folder: str) -> DataFrame:
    return payloads.parse_protein_json(fixtures.protein_payload(spark, folder))


@query
def parse_ppi_json(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(payloads.parse_ppi_json(fixtures.ppi_payload(spark, folder)))


@query
def parse_disease_json(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(payloads.parse_disease_json(fixtures.disease_payload(spark, folder)))


@query
def parse_compound_json(spark: SparkSession, folder: str) -> DataFrame:
    return payloads.parse_compound_json(fixtures.compound_payload(spark, folder))


@query
def gene_id_from_search(spark: SparkSession, folder: str) -> DataFrame:
    return gene_ids(spark, folder)


def checked_payloads(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Payloads of a kind, some broken, with the reason."""
    rows, *key = {
        "protein": (fixtures.protein_payload, "accession"),
        "ppi": (fixtures.ppi_payload, "ProteinA", "page"),
        "gene_search": (fixtures.gene_search_payload, "gene_symbol"),
        "disease": (fixtures.disease_payload, "gene_symbol", "page"),
        "compound": (fixtures.compound_payload, "drug_id"),
    }[kind]
    is_list = payloads.KINDS[kind][0] == payloads.OBJECTS
    return payloads.checked_payloads(fixtures.broken_payloads(rows(spark, folder), is_list, *key), kind)


@query
def payload_report(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected payloads of every kind, by reason."""
    return integrate.union_sources(
        [payloads.payload_report(checked_payloads(spark, folder, kind), kind) for kind in payloads.KINDS]
    )


@query
def rejected_payloads(spark: SparkSession, folder: str) -> DataFrame:
    rejects = payloads.rejected_payloads(checked_payloads(spark, folder, "compound"))
    return rejects.select("drug_id", "reason")


@query
def accepted_proteins(spark: SparkSession, folder: str) -> DataFrame:
    """The proteins whose payload is sound, parsed."""
    return payloads.parse_protein_json(payloads.accepted_payloads(checked_payloads(spark, folder, "protein")))


# --- screening and status -------------------------------------------------------------------


@query
def lipinski_screen(spark: SparkSession, folder: str) -> DataFrame:
    screened = compounds.lipinski_screen(fixtures.compound_property(spark, folder))
    return screened.select("smiles", "passes", "violations")


@query
def property_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compounds.property_profile(fixtures.compound_property(spark, folder)))


@query
def disease_status(spark: SparkSession, folder: str) -> DataFrame:
    return disease.disease_status(keyed_targets(spark, folder), associations(spark, folder))


@query
def valid_structure(spark: SparkSession, folder: str) -> DataFrame:
    return compounds.valid_structure(drugs(spark, folder), fixtures.compound_property(spark, folder))
