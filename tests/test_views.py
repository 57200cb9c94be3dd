"""Recommendation, network, compound and disease views on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligatable.functions import labels, payloads, scores
from ligatable.operators import compounds, disease, model, network, profile, recommend

SCORED = "TargetID STRING, DrugID STRING, score DOUBLE"
PROPERTY = "smiles STRING, mol_weight DOUBLE, logp DOUBLE, h_donors INT, h_acceptors INT, tpsa DOUBLE, rotatable_bonds INT"
COMPOUND = "drug_id STRING, smiles STRING, title STRING, iupac_name STRING"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "score, tier",
    [(0.0, None), (0.01, "Low"), (0.2, "Low"), (0.21, "Medium"), (0.4, "Medium"), (0.6, "High"), (0.61, "Very High"),
     (1.0, "Very High"), (1.01, None), (None, None)],
)
def test_tier_bounds(spark, score, tier):
    assert one(spark, scores.disease_tier(F.lit(score).cast("double"))) == tier


def test_labels(spark):
    assert one(spark, labels.display_label(F.lit("123456789012"), 12)) == "123456789012"
    assert one(spark, labels.display_label(F.lit("1234567890123"), 12)) == "123456789012…"
    assert one(spark, labels.numeric_id(F.lit(" 42 "))) is True
    assert one(spark, labels.numeric_id(F.lit("4x"))) is False
    assert one(spark, labels.numeric_id(F.lit(None).cast("string"))) is False
    assert one(spark, scores.rounded_score(F.lit(None).cast("double"))) == 0.0


def test_ranks_follow_score_then_id_and_not_array_order(spark, rows):
    df = spark.createDataFrame([("t", "b", 2.0), ("t", "a", 2.0), ("t", "c", 3.00004), ("t", "d", 1.0)], SCORED)
    top = model.topk_drugs(df, 3)
    assert rows(top, "Rank", "DrugID") == [(1, "c"), (2, "a"), (3, "b")]
    shuffled = spark.sql("SELECT 't' AS TargetID, array(struct('x' AS DrugID, 1f AS score), struct('y' AS DrugID, 2f AS score)) AS recommendations")
    assert rows(recommend.ranked_recommendations(shuffled), "Rank", "DrugID", "PredictedScore") == [(1, "y", 2.0), (2, "x", 1.0)]
    nested = model.nested_recommendations(top).collect()[0]
    assert [r.DrugID for r in nested.recommendations] == ["c", "a", "b"]
    assert nested.recommendations[0].asDict() == {"DrugID": "c", "score": 3.00004}


def test_topk_cuts_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([("t", "b", 2.0)], SCORED)
    plan = model.topk_drugs(df.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_trend_matches_polyfit_and_needs_three_points(spark):
    y = [5.0, 4.2, 4.1, 3.0, 2.9, 2.95, 1.0]
    ranked = [("t", i + 1, s) for i, s in enumerate(y)] + [("u", 1, 2.0), ("u", 2, 1.0), ("v", 1, 3.0), ("v", 2, 1.0), ("v", 3, 2.0)]
    df = spark.createDataFrame(ranked, "TargetID STRING, Rank INT, PredictedScore DOUBLE")
    got = {(r.TargetID, r.Rank): r.Trend for r in recommend.score_trend(df).collect()}
    x = np.arange(1, len(y) + 1)
    assert np.allclose([got[("t", int(i))] for i in x], np.polyval(np.polyfit(x, y, 2), x))
    assert np.allclose([got[("v", i)] for i in (1, 2, 3)], [3.0, 1.0, 2.0])
    assert got[("u", 1)] is None


def test_histogram_keeps_the_highest_score_and_equal_scores(spark):
    df = spark.createDataFrame([("t", f"d{i}", float(i)) for i in range(31)] + [("u", "a", 2.0), ("u", "b", 2.0)], SCORED)
    got = recommend.score_histogram(df).collect()
    t = {r.bin: r["count"] for r in got if r.TargetID == "t"}
    expected, _ = np.histogram(np.arange(31.0), bins=15)
    assert [t[i + 1] for i in range(15)] == expected.tolist()
    assert [(r.bin, r["count"]) for r in got if r.TargetID == "u"] == [(1, 2)]


def test_human_filter_falls_back_to_all(spark, rows):
    mixed = spark.createDataFrame([("P12345",), ("ENSG1",), ("P1",)], "TargetID STRING")
    assert rows(recommend.human_targets(mixed)) == [("P12345",)]
    assert rows(recommend.human_targets(mixed.filter("TargetID != 'P12345'"))) == [("ENSG1",), ("P1",)]


def test_target_list_and_counts(spark, rows):
    recs = spark.createDataFrame([("b", "d", 1.0), ("a", "d", 1.0), ("b", "e", 1.0)], SCORED)
    assert [r.TargetID for r in recommend.list_targets(recs, 1).collect()] == ["a"]
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "TargetID STRING")
    assert rows(recommend.recommendation_count(targets, recs)) == [("a", 1), ("b", 2), ("c", 0)]


def test_network(spark, rows):
    recs = spark.createDataFrame([("target-longer", "drug-long-id", 0.2, 1), ("target-longer", "x", 5.0, 6)], SCORED + ", Rank INT")
    neighbors = spark.createDataFrame(
        [("target-longer", "neighbor-is-long", 0.9), ("other", "n", 0.9)], "TargetID STRING, NeighborID STRING, ConfidenceScore DOUBLE"
    )
    edges = network.network_edges(recs, neighbors)
    assert rows(edges, "kind", "node", "strength", "width") == [
        ("drug", "drug-long-id", 1.0, 1.0), ("ppi", "neighbor-is-long", pytest.approx(2.7), pytest.approx(1.35)),
    ]
    assert rows(network.network_nodes(edges), "kind", "label") == [
        ("drug", "drug-long-…"[:10] + "…"), ("ppi", "neighbor-is-"), ("target", "target-longe…"),
    ]


@pytest.fixture()
def chemistry(spark):
    cid = spark.createDataFrame([("1", "S1", "", "iupac1"), ("2", "S2", "Two", None), ("9", None, "n", "n")], COMPOUND)
    xref = spark.createDataFrame([("2", "X2", "other", None), ("3", "S3", None, None), ("9", "S9", "Nine", None)], COMPOUND)
    known = spark.createDataFrame([(s, 400.0, 2.0, 1, 1, 10.0, 1) for s in ("S1", "S3", "CCO", "77")], PROPERTY)
    return cid, xref, known


def test_compounds_resolve_by_id_then_cross_reference(spark, rows, chemistry):
    cid, xref, _ = chemistry
    drugs = spark.createDataFrame([("1",), ("2",), ("3",), ("9",), ("4",), ("CCO",), (" 1 ",)], "DrugID STRING")
    assert rows(compounds.resolve_compound(drugs, cid, xref)) == [
        (" 1 ", "S1", "iupac1", "cid"), ("1", "S1", "iupac1", "cid"), ("2", "S2", "Two", "cid"), ("3", "S3", None, "xref"),
        ("4", None, None, None), ("9", "S9", "Nine", "xref"), ("CCO", None, None, None),
    ]


def test_lead_is_the_first_usable(spark, rows, chemistry):
    recs = [("t", "2", 1), ("t", "3", 2), ("t", "CCO", 3), ("u", "4", 1), ("u", "77", 2), ("u", "zz", 3), ("u", "CCO", 4), ("v", "CCO", 1)]
    df = spark.createDataFrame(recs, "TargetID STRING, DrugID STRING, Rank INT")
    # S2 is no known structure, 77 is numeric; of three drugs, rank 4 comes too late
    found = [("t", 2, "3", "Compound 3", "S3"), ("u", 4, "CCO", "CCO", "CCO"), ("v", 1, "CCO", "CCO", "CCO")]
    assert rows(compounds.lead_compound(df, *chemistry)) == found
    assert rows(compounds.lead_compound(df, *chemistry, first=3)) == [found[0], found[2]]


def test_lookup_rows_that_repeat_multiply_nothing(spark, rows, chemistry):
    cid, xref, known = (t.unionByName(t) for t in chemistry)
    other = spark.createDataFrame([("1", "S0", "zero", None)], COMPOUND)
    drugs = spark.createDataFrame([("1",), ("3",)], "DrugID STRING")
    resolved = compounds.resolve_compound(drugs, cid.unionByName(other), xref)
    assert rows(resolved) == [("1", "S0", "zero", "cid"), ("3", "S3", None, "xref")]
    assert compounds.compound_properties(resolved, known).count() == 2


def test_ids_may_have_white_space_around(spark, rows, chemistry):
    drugs = spark.createDataFrame([("1\t",), ("\r\n2\r\n",), ("3\n4",)], "DrugID STRING")
    found = compounds.resolve_compound(drugs, *chemistry[:2])
    assert rows(found, "smiles") == [(None,), ("S1",), ("S2",)]


def test_screen_needs_all_four(spark):
    df = spark.createDataFrame(
        [("in", 500.0, 5.0, 5, 10, 1.0, 1), ("heavy", 500.1, 1.0, 1, 1, 1.0, 1), ("gap", None, 1.0, 1, 1, 1.0, 1)], PROPERTY
    )
    got = {r.smiles: (r.passes, r.violations) for r in compounds.lipinski_screen(df).collect()}
    assert got == {"in": (True, 0), "heavy": (False, 1), "gap": (False, 1)}
    assert compounds.property_profile(df).count() == 15


def test_properties_keep_unknown_compounds(spark, chemistry):
    df = spark.createDataFrame([("a", "S1"), ("b", None), ("c", "none")], "DrugID STRING, smiles STRING")
    got = {r.DrugID: r.mol_weight for r in compounds.compound_properties(df, chemistry[2]).collect()}
    assert got == {"a": 400.0, "b": None, "c": None}


def parse(spark, fn, *texts):
    return fn(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, payload STRING")).orderBy("id").collect()


def test_protein_payload_fallbacks(spark):
    full = """{"organism": {"scientificName": "Homo sapiens", "taxonId": 9606},
      "proteinDescription": {"recommendedName": {"fullName": {"value": "R"}}, "submittedNames": [{"fullName": {"value": "S"}}]},
      "genes": [{"geneName": {"value": ""}, "synonyms": [{"value": "SYN"}, {"value": "B"}]}]}"""
    submitted = '{"proteinDescription": {"submittedNames": [{"fullName": {"value": "S"}}]}, "genes": []}'
    got = [(r.protein_name, r.organism, r.is_human, r.gene_symbol) for r in parse(spark, payloads.parse_protein_json, full, submitted, "{}")]
    assert got == [("R", "Homo sapiens", True, "SYN"), ("S", "Unknown", False, None), ("Unknown", "Unknown", False, None)]


def test_disease_payload_rules(spark):
    items = ['{"disease_name": "", "disease": "D", "score": 0, "gda_score": 0.3, "source": "", "sourceName": "N"}', '{"score": 0}', '{"diseaseId": "C1", "score": 0.5}']
    got = parse(spark, payloads.parse_disease_json, f"[{','.join(items)}]")
    assert [(r.Position, r.Disease, r.Score, r.Source) for r in got] == [
        (1, "D", 0.3, "N"), (2, "Unknown", None, "DisGeNET"), (3, "C1", 0.5, "DisGeNET"),
    ]
    assert len(parse(spark, payloads.parse_disease_json, "[" + ",".join(['{"score": 1}'] * 40) + "]")) == 40


def test_other_payloads(spark):
    ppi = spark.createDataFrame([("a", '[{"preferredName_B": "N", "stringId_B": "i", "score": 900}, {"stringId_B": "i"}, {}]')], "ProteinA STRING, payload STRING")
    assert [(r.ProteinB, r.ConfidenceScore) for r in payloads.parse_ppi_json(ppi).collect()] == [("N", 0.9), ("i", 0.0), ("", 0.0)]
    genes = parse(spark, payloads.gene_id_from_search, '[{"ncbi_id": 0, "geneid": 12}, {"ncbi_id": 5}]', "[]", '[{"ncbiId": "7"}]')
    assert [r.gene_id for r in genes] == ["12", None, "7"]
    found = parse(
        spark, payloads.parse_compound_json,
        '{"PropertyTable": {"Properties": [{"IsomericSMILES": "C", "Title": "", "IUPACName": "i"}, {"IsomericSMILES": "D"}]}}',
        '{"PropertyTable": {"Properties": []}}', "{}",
    )
    assert [(r.smiles, r.name) for r in found] == [("C", "i"), (None, None), (None, None)]


@pytest.fixture()
def genetics(spark):
    proteins = spark.createDataFrame(
        [("h1", "A", "Homo", "G1", True), ("h2", "B", "Homo", None, True), ("h3", "C", "Homo", "G3", True), ("m", "D", "Mus", "G1", False), ("h4", "E", "Homo", "G4", True)],
        "accession STRING, protein_name STRING, organism STRING, gene_symbol STRING, is_human BOOLEAN",
    )
    targets = spark.createDataFrame([(t,) for t in ("h1", "h2", "h3", "h4", "m", "unknown")], "TargetID STRING")
    ids = spark.createDataFrame([("G1", "101"), ("G3", None)], "gene_symbol STRING, gene_id STRING")
    rows = [("101", "G1", "x", 0.2, "s"), ("101", "G1", "y", None, "s"), ("101", "G1", "z", 0.9, "s"), ("G4", "G4", "w", None, "s")]
    found = spark.createDataFrame(rows, "gene_key STRING, Gene STRING, Disease STRING, Score DOUBLE, Source STRING")
    return disease.with_gene_key(disease.target_annotation(targets, proteins), ids), found


def test_disease_outcomes(rows, genetics):
    keyed, found = genetics
    assert rows(disease.disease_status(keyed, found), "TargetID", "status") == [
        ("h1", "ok"), ("h2", "no_gene"), ("h3", "no_associations"), ("h4", "ok"), ("m", "not_human"), ("unknown", "not_human"),
    ]
    joined = disease.disease_associations(keyed, found)
    assert rows(joined, "TargetID", "Source", "Gene") == [
        ("h1", "s", "G1"), ("h1", "s", "G1"), ("h1", "s", "G1"), ("h2", "UniProt", "—"), ("h3", "DisGeNET (no records)", "G3"),
        ("h4", "s", "G4"), ("m", "Not applicable", "—"), ("unknown", "Not applicable", "—"),
    ]


def test_tier_counts_keep_empty_tiers(rows, genetics):
    assert rows(disease.disease_tier_counts(*genetics)) == [("h1", "High", 0), ("h1", "Low", 1), ("h1", "Medium", 0), ("h1", "Very High", 1)]


def test_top_diseases_skip_missing_scores(spark, rows, genetics):
    assert rows(disease.top_diseases(genetics[1]), "Rank", "Disease") == [(1, "z"), (2, "x")]
    many = spark.createDataFrame([("g", "G", f"d{i:03d}", i / 100, "s") for i in range(60)], genetics[1].schema)
    assert rows(disease.top_diseases(many), "Rank", "Disease")[0] == (1, "d059")
    assert disease.top_diseases(many).count() == 12
    assert disease.top_diseases(many, 40).count() == 40


def test_curve_and_profile(spark, rows):
    curve = profile.pscale_curve(spark).orderBy("point").collect()
    assert len(curve) == 300 and curve[0].pscale == 10.0 and curve[-1].pscale == pytest.approx(4.0)
    assert [r.is_strong for r in curve] == [r.pscale >= 6.52 for r in curve]
    valid = spark.createDataFrame([("Kd", 0.001), ("Kd", 1e9), ("Ki", 0.1), ("Davis", 5.0)], "Source STRING, RawScore DOUBLE")
    support = {r.point: r.measurements for r in profile.pscale_curve_support(valid).collect() if r.measurements}
    assert support == {0: 2, 299: 1}
    pairs = spark.createDataFrame([(["Kd", "Davis"],), (["Davis"],)], "Sources ARRAY<STRING>")
    shares = profile.pairs_by_source(pairs)
    assert rows(profile.cumulative_pairs(shares)) == [(1, "Davis", 2, 2), (4, "Kd", 1, 3)]


def test_overview_shows_no_zero_metric(spark):
    pairs = spark.createDataFrame([("a", "t"), ("b", "t")], "DrugID STRING, TargetID STRING")
    latest = spark.createDataFrame([(0.0, 0.5)], "rmse DOUBLE, aupr DOUBLE")
    r = profile.overview_stats(pairs, spark.range(3), latest).collect()[0]
    assert tuple(r) == (1, 2, 3, None, 0.5)
    empty = profile.overview_stats(pairs, spark.range(3), latest.limit(0)).collect()[0]
    assert (empty.rmse, empty.aupr) == (None, None)


def test_sketches_of_loads_merge(spark):
    """Sketches stored by load give what one sketch of all rows gives; sources that share values count them once."""
    rows = spark.range(9000).selectExpr(
        "IF(id < 6000, 'Kd', 'Ki') AS Source", "CAST(id % 5000 AS STRING) AS DrugID", "CAST(id % 7 AS STRING) AS TargetID"
    )
    choices = spark.createDataFrame([(1, "Kd"), (2, "Ki"), (3, "Kd"), (3, "Ki"), (4, "Davis")], "choice LONG, Source STRING")
    loads = [profile.source_sketches(rows.filter(f"id % 3 = {k}")) for k in range(3)]
    merged = profile.distinct_of_choices(loads[0].unionByName(loads[1]).unionByName(loads[2]), choices)
    found = {r.choice: r for r in merged.collect()}
    whole = {r.choice: r for r in profile.distinct_of_choices(profile.source_sketches(rows), choices).collect()}
    exact = {r.choice: r.DrugID for r in profile.exact_of_choices(rows, choices, "DrugID").collect()}
    assert exact == {1: 5000, 2: 3000, 3: 5000} and set(found) == set(exact)
    for k, n in exact.items():
        assert found[k].DrugID == pytest.approx(n, rel=4 * profile.SKETCH_ERROR)
        assert found[k].DrugID == pytest.approx(whole[k].DrugID, rel=0.01)
        assert found[k].TargetID == 7
    assert profile.distinct_of_choices(profile.source_sketches(rows.limit(0)), choices).count() == 0
