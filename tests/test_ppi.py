from ligatable.operators import ppi

EDGE = "ProteinA STRING, ProteinB STRING, ConfidenceScore DOUBLE"


def test_threshold_scale_and_text_input(spark, rows):
    links = spark.createDataFrame([("a", "b", "700"), ("a", "c", "699"), ("a", "d", "x")], "protein1 STRING, protein2 STRING, combined_score STRING")
    assert rows(ppi.ppi_confidence(links)) == [("a", "b", 0.7)]


def test_cut_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("'a' AS protein1", "'b' AS protein2", "id * 100 AS combined_score").write.parquet(str(tmp_path / "l"))
    plan = ppi.ppi_confidence(spark.read.parquet(str(tmp_path / "l")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(combined_score,700)" in plan


def test_duplicates_and_directions(spark, rows):
    edges = spark.createDataFrame([("a", "b", 0.8), ("a", "b", 0.9), ("b", "a", 0.95)], EDGE)
    once = ppi.ppi_edges(edges)
    assert rows(once) == [("a", "b", 0.9), ("b", "a", 0.95)]
    assert rows(ppi.ppi_undirected(once)) == [("a", "b", 0.95)]


def test_neighbors_are_distinct_ranked_and_cut_after_merging(spark):
    edges = [("t", f"n{i:02d}", 0.7 + i / 100) for i in range(20)] + [(f"n{i:02d}", "t", 0.7 + i / 100) for i in range(20)]
    got = ppi.ppi_neighbors(spark.createDataFrame(edges, EDGE)).filter("TargetID = 't'").orderBy("NeighborRank").collect()
    assert [r.NeighborID for r in got] == [f"n{i:02d}" for i in range(19, 7, -1)]


def test_fallback_only_where_there_is_no_local_edge(spark, rows):
    local = spark.createDataFrame([("a", "b", 0.8)], EDGE)
    secondary = spark.createDataFrame(
        [("a", "x", 0.9), ("b", "x", 0.9), ("c", "a", 0.9)] + [("d", f"n{i:02d}", 0.7 + i / 100) for i in range(30)], EDGE
    )
    both = ppi.ppi_with_fallback(local, secondary)
    assert rows(both.filter("ProteinA != 'd'")) == [("a", "b", 0.8, "local"), ("c", "a", 0.9, "secondary")]
    assert both.filter("ProteinA = 'd'").count() == 30
    # the edge of c does not make c a neighbour of a
    assert rows(ppi.ppi_neighbors(both).filter("TargetID = 'a'"), "NeighborID") == [("b",)]


def test_target_on_either_side_with_id_map(spark, rows):
    edges = spark.createDataFrame([("e1", "e2", 0.8), ("e3", "e1", 0.9), ("e1", "e1", 0.7)], EDGE)
    targets = spark.createDataFrame([("t",), ("e2",)], "TargetID STRING")
    id_map = spark.createDataFrame([("t", "e1")], "TargetID STRING, ProteinID STRING")
    assert rows(ppi.target_ppi(targets, edges, id_map), "TargetID", "ProteinA", "ProteinB") == [
        ("e2", "e1", "e2"), ("t", "e1", "e1"), ("t", "e1", "e2"), ("t", "e3", "e1"),
    ]
