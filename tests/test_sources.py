import csv

import pytest

from ligatable.operators import integrate
from ligatable.sources import files, tables
from ligatable.sources.registry import SOURCES


def write(path, text):
    path.write_text(text)
    return path


def test_tab_and_comma_files_keep_ids_as_text(spark, tmp_path, rows):
    write(tmp_path / "davis_all.csv", "compound_iso_smiles,target_sequence,affinity\nCCO,MKV,5.5\n")
    write(tmp_path / "Kd_bind.tsv", "affinity\tdrug_id\ttarget_id\textra\n12.5\t007\tP1\tx\nabc\t8\tP2\tx\n")
    found = files.available_sources(spark, str(tmp_path))
    assert [s.name for s, _ in found] == ["Davis", "Kd"]
    assert rows(integrate.load_sources(found), "DrugID", "TargetID", "RawScore", "Source") == [
        ("007", "P1", 12.5, "Kd"),
        ("CCO", "MKV", 5.5, "Davis"),
    ]


def test_missing_sources_are_skipped_but_not_all(spark, tmp_path, caplog):
    with pytest.raises(ValueError, match="none of the affinity sources"):
        files.available_sources(spark, str(tmp_path))
    assert len([r for r in caplog.records if "skipped" in r.message]) == len(SOURCES)


def test_affinity_file_without_its_columns_is_refused(spark, tmp_path):
    write(tmp_path / "Ki_bind.tsv", "drug\ttarget_id\taffinity\n1\tP\t3\n")
    with pytest.raises(ValueError, match="drug_id"):
        files.available_sources(spark, str(tmp_path))


def test_ppi_header_check_and_missing_file(spark, tmp_path, rows):
    assert files.read_ppi(spark, str(tmp_path / "none.txt")) is None
    bad = write(tmp_path / "bad.txt", "protein1 protein2 score\nA B 900\n")
    with pytest.raises(ValueError, match="combined_score"):
        files.read_ppi(spark, str(bad))
    good = write(tmp_path / "good.txt", "protein1 protein2 combined_score\nA B 900\n")
    assert rows(files.read_ppi(spark, str(good))) == [("A", "B", "900")]


def test_lookup_reaches_the_scan(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('T', id) AS TargetID", "id AS v")
    tables.save_table(df, str(tmp_path / "t"), cluster_by=["TargetID"])
    found = tables.prediction_for_target(tables.load_table(spark, str(tmp_path / "t")), "T7")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(TargetID,T7)" in plan
    assert [r.v for r in found.collect()] == [7]


def test_save_overwrites_in_other_formats(spark, tmp_path):
    for n in (5, 3):
        tables.save_table(spark.range(n), str(tmp_path / "j"), fmt="orc")
    assert tables.load_table(spark, str(tmp_path / "j"), "orc").count() == 3


def test_folder_whose_files_differ_in_their_header_is_refused(spark, tmp_path):
    folder = tmp_path / "Kd_bind.tsv"
    folder.mkdir()
    write(folder / "a.tsv", "drug_id\ttarget_id\taffinity\nD0\tT0\t4\n")
    write(folder / "b.tsv", "target_id\taffinity\tdrug_id\nT1\t5\tD1\n")
    with pytest.raises(Exception, match="header"):
        files.read_affinity(spark, str(folder), "tsv").collect()


def test_scores_that_are_no_number_spoil_nothing(spark, rows):
    raw = spark.createDataFrame(
        [("d", "t", s) for s in ("1", "3", "NaN", "Infinity", "-Infinity", "x", "")], "DrugID STRING, TargetID STRING, s STRING"
    )
    valid = integrate.valid_affinity(integrate.canonical_affinity(raw, "DrugID", "TargetID", "s"))
    assert rows(valid, "RawScore") == [(1.0,), (3.0,)]
    scaled = integrate.minmax_by_source(integrate.score_affinity(integrate.tag_source(valid, "Davis")))
    assert rows(scaled, "NormalizedScore") == [(1.0,), (5.0,)]


def test_export_is_read_back_by_a_csv_reader(spark, tmp_path):
    ids = ['C"1', "C\\C=C", 'a,b"', "\\\"x,", "plain"]
    ranked = spark.createDataFrame(
        [("T", i, d, 1.5) for i, d in enumerate(ids)], "TargetID STRING, Rank INT, DrugID STRING, PredictedScore DOUBLE"
    )
    tables.export_csv(ranked, str(tmp_path / "x"))
    found = []
    for part in (tmp_path / "x").glob("*.csv"):
        with part.open(newline="") as f:
            found += [r["DrugID"] for r in csv.DictReader(f)]
    assert sorted(found) == sorted(ids)
    assert sorted(r.DrugID for r in files.read_affinity(spark, str(tmp_path / "x"), "csv").collect()) == sorted(ids)


def test_export_has_few_files_for_many_targets(spark, tmp_path):
    ranked = spark.range(100_000).selectExpr("concat('9606.ENSP000', id) TargetID", "1 Rank", "'d' DrugID", "1.0D PredictedScore")
    tables.export_csv(ranked, str(tmp_path / "x"))
    assert 1 <= len(list((tmp_path / "x").rglob("*.csv"))) <= 10


def test_export_names_targets_by_their_first_characters(spark, tmp_path):
    ranked = spark.createDataFrame(
        [("ABCDEFGHIJKLMN", 1, "d", 1.0), ("ABCDEFGHIJKLXX", 1, "e", 2.0), ("S", 1, "f", 3.0)],
        "TargetID STRING, Rank INT, DrugID STRING, PredictedScore DOUBLE",
    )
    tables.export_csv(ranked, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").rglob("*.csv"))
    assert "TargetID,Rank,DrugID,PredictedScore,predictions" in text
    assert "ABCDEFGHIJKLMN,1,d,1.0,ABCDEFGHIJKL" in text and "ABCDEFGHIJKLXX,1,e,2.0,ABCDEFGHIJKL" in text
