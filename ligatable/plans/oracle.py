"""SQL twins of the registered queries, over the same tables.

``TABLES`` holds named sub-selects with the names they build on; ``TWINS`` the final
selects. ``sql_for`` puts the needed sub-selects in front as common table expressions.
"""

from __future__ import annotations

import re


def _target(key: str) -> str:
    pad = "lpad(CAST({k} AS string), CAST(greatest({w}, length(CAST({k} AS string))) AS INTEGER), '0')"
    other, human = pad.format(k=key, w=8), pad.format(k=key, w=5)
    return f"CASE WHEN {key} % 3 = 2 THEN concat('ENSG', {other}) ELSE concat('P', {human}) END"


def _drug(key: str) -> str:
    text = f"CAST({key} AS string)"
    return f"CASE WHEN {key} % 5 = 0 THEN concat('CC(=O)N', {text}) ELSE {text} END"


def _four(score: str) -> str:
    """Half-up at four digits on the decimal value, as Spark rounds."""
    return f"CAST(round(CAST({score} AS DECIMAL(18, 6)), 4) AS DOUBLE)"


def _best(score: str) -> str:
    return f"round({score}, 6) DESC"


ORDER_OF_SOURCE = (
    "CASE Source WHEN 'Davis' THEN 1 WHEN 'KIBA' THEN 2 WHEN 'IC50' THEN 3 "
    "WHEN 'Kd' THEN 4 WHEN 'Ki' THEN 5 ELSE 6 END"
)
TYPE_OF_ORDER = (
    "CASE first_source WHEN 1 THEN 'Davis' WHEN 2 THEN 'KIBA' WHEN 3 THEN 'pIC50' "
    "WHEN 4 THEN 'pKd' WHEN 5 THEN 'pKi' ELSE 'pEC50' END"
)
TIER = (
    "CASE WHEN Score <= 0 THEN NULL WHEN Score <= 0.2 THEN 'Low' WHEN Score <= 0.4 THEN 'Medium' "
    "WHEN Score <= 0.6 THEN 'High' WHEN Score <= 1.0 THEN 'Very High' END"
)
RECOMMENDATION_TEXT = (
    "string_agg(DrugID || ':' || CAST(CAST(score AS DECIMAL(10, 6)) AS VARCHAR), ',' ORDER BY score DESC, DrugID)"
)
STRENGTH = (
    "CASE kind WHEN 'drug' THEN greatest(score * 4.0, 1.0) ELSE greatest(score * 3.0, 0.5) END AS strength, "
    "CASE kind WHEN 'drug' THEN greatest(score * 2.0, 1.0) ELSE greatest(score * 1.5, 0.5) END AS width"
)


def _top_measured(k: int) -> str:
    return f"""
    SELECT TargetID, DrugID, score, CAST(rk AS INTEGER) AS Rank FROM (
        SELECT TargetID, DrugID, round(NormalizedScore, 6) AS score,
               row_number() OVER (PARTITION BY TargetID ORDER BY {_best('NormalizedScore')}, DrugID) AS rk
        FROM pairs) t
    WHERE rk <= {k}"""


TABLES: dict[str, str] = {
    "raw_affinity": f"""
    SELECT {_drug('l_partkey')} AS drug_id, {_target('l_suppkey')} AS target_id,
           CAST(CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN 0.0 WHEN l_quantity = 3 THEN -1.0
                ELSE l_extendedprice END AS DOUBLE) AS affinity,
           CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Davis' WHEN 'AO' THEN 'KIBA' WHEN 'NF' THEN 'IC50'
                WHEN 'NO' THEN 'Kd' WHEN 'RF' THEN 'Ki' ELSE 'EC50' END AS source
    FROM lineitem""",
    "canonical": """
    SELECT drug_id AS DrugID, target_id AS TargetID, affinity AS RawScore, source AS Source FROM raw_affinity""",
    "valid": """
    SELECT * FROM canonical WHERE DrugID IS NOT NULL AND TargetID IS NOT NULL AND RawScore > 0""",
    "scored": """
    SELECT *, CASE WHEN Source IN ('Davis', 'KIBA') THEN RawScore ELSE 9.0 - log10(RawScore) END AS AffinityScore,
           CASE WHEN Source IN ('Davis', 'KIBA') THEN Source ELSE concat('p', Source) END AS AffinityType
    FROM valid""",
    "normalized": """
    SELECT s.*, CASE WHEN high = low THEN 3.0 ELSE (AffinityScore - low) / (high - low) * 4.0 + 1.0 END AS NormalizedScore
    FROM scored s JOIN (SELECT Source, min(AffinityScore) AS low, max(AffinityScore) AS high FROM scored GROUP BY Source) e
      ON s.Source = e.Source""",
    "pairs": f"""
    SELECT DrugID, TargetID, NormalizedScore, AffinityScore, {TYPE_OF_ORDER} AS AffinityType, Sources, SourceCount,
           EvidenceRows
    FROM (SELECT DrugID, TargetID, avg(NormalizedScore) AS NormalizedScore, avg(AffinityScore) AS AffinityScore,
                 min({ORDER_OF_SOURCE}) AS first_source, string_agg(DISTINCT Source, ',' ORDER BY Source) AS Sources,
                 count(DISTINCT Source) AS SourceCount, count(*) AS EvidenceRows
          FROM normalized GROUP BY DrugID, TargetID) g""",
    "protein_links": """
    SELECT x, y, (least(x, y) * 37 + greatest(x, y) * 101) % 1001 AS sc FROM (
        SELECT a AS x, b AS y FROM picked WHERE a <> b UNION SELECT b, a FROM picked WHERE a <> b) e""",
    "picked": """
    SELECT l_suppkey AS a, (l_partkey * 7 + l_linenumber) % (SELECT max(s_suppkey) + 1 FROM supplier) AS b FROM lineitem""",
    "raw_ppi": f"""
    SELECT {_target('x')} AS protein1, {_target('y')} AS protein2, sc AS combined_score FROM (
        SELECT x, y, sc FROM protein_links WHERE x % 10 <> 9 AND y % 10 <> 9
        UNION ALL
        SELECT x, y, greatest(sc - 50, 0) FROM protein_links WHERE x % 10 <> 9 AND y % 10 <> 9 AND (x + y) % 4 = 0) d""",
    "raw_ppi_secondary": f"""
    SELECT {_target('x')} AS protein1, {_target('y')} AS protein2, sc AS combined_score
    FROM protein_links WHERE x % 10 = 9""",
    "confident": """
    SELECT protein1 AS ProteinA, protein2 AS ProteinB, combined_score / 1000.0 AS ConfidenceScore
    FROM raw_ppi WHERE combined_score / 1000.0 >= 0.70""",
    "edges": """
    SELECT ProteinA, ProteinB, max(ConfidenceScore) AS ConfidenceScore FROM confident GROUP BY ProteinA, ProteinB""",
    "fallback_edges": """
    SELECT ProteinA, ProteinB, ConfidenceScore, 'local' AS Origin FROM edges
    UNION ALL
    SELECT ProteinA, ProteinB, ConfidenceScore, 'secondary' FROM (
        SELECT protein1 AS ProteinA, protein2 AS ProteinB, combined_score / 1000.0 AS ConfidenceScore
        FROM raw_ppi_secondary WHERE combined_score >= 700) s
    WHERE ProteinA NOT IN (SELECT ProteinA FROM edges UNION SELECT ProteinB FROM edges)""",
    "local_neighbors": """
    SELECT TargetID, NeighborID, ConfidenceScore, CAST(rk AS INTEGER) AS NeighborRank FROM (
        SELECT *, row_number() OVER (PARTITION BY TargetID ORDER BY ConfidenceScore DESC, NeighborID) AS rk FROM (
            SELECT TargetID, NeighborID, max(ConfidenceScore) AS ConfidenceScore FROM (
                SELECT ProteinA AS TargetID, ProteinB AS NeighborID, ConfidenceScore FROM edges
                UNION ALL SELECT ProteinB, ProteinA, ConfidenceScore FROM edges) b
            GROUP BY TargetID, NeighborID) m) r
    WHERE rk <= 12""",
    "all_neighbors": """
    SELECT TargetID, NeighborID, ConfidenceScore FROM local_neighbors
    UNION ALL
    SELECT ProteinA, ProteinB, ConfidenceScore FROM (
        SELECT *, row_number() OVER (PARTITION BY ProteinA ORDER BY ConfidenceScore DESC, ProteinB) AS rk
        FROM fallback_edges WHERE Origin = 'secondary') s
    WHERE rk <= 12""",
    "targets": "SELECT DISTINCT TargetID FROM pairs",
    "drugs": "SELECT DISTINCT DrugID FROM canonical",
    "measured": _top_measured(5),
    "measured_long": _top_measured(25),
    "split": """
    SELECT DrugID, TargetID, NormalizedScore,
           CAST(concat('0x', substring(md5(concat(DrugID, '|', TargetID)), 1, 7)) AS BIGINT) % 100 < 80 AS is_training
    FROM pairs""",
    "baseline": """
    SELECT t.DrugID, t.TargetID, t.NormalizedScore, m.prediction
    FROM split t JOIN (SELECT TargetID, round(avg(NormalizedScore), 6) AS prediction FROM split WHERE is_training
                       GROUP BY TargetID) m ON t.TargetID = m.TargetID
    WHERE NOT t.is_training""",
    "drug_labels": """
    SELECT DrugID, row_number() OVER (ORDER BY count(*) DESC, DrugID) - 1 AS drug_idx FROM pairs GROUP BY DrugID""",
    "target_labels": """
    SELECT TargetID, row_number() OVER (ORDER BY count(*) DESC, TargetID) - 1 AS target_idx FROM pairs
    GROUP BY TargetID""",
    "protein": f"""
    SELECT {_target('s_suppkey')} AS accession,
           CASE WHEN r_name IN ('EUROPE', 'ASIA') THEN 9606 ELSE 10090 END AS taxon_id, r_name AS organism,
           CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS recommended_name,
           CASE WHEN s_suppkey % 14 = 0 THEN NULL ELSE concat('sub ', s_name) END AS submitted_name,
           CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('GENE', CAST(s_suppkey AS string)) END AS gene_primary,
           CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE concat('SYN', CAST(s_suppkey AS string)) END AS gene_synonym
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "parsed_protein": """
    SELECT accession, coalesce(recommended_name, submitted_name, 'Unknown') AS protein_name, organism,
           taxon_id = 9606 AS is_human, coalesce(gene_primary, gene_synonym) AS gene_symbol
    FROM protein""",
    "gene_ids": """
    SELECT concat('GENE', CAST(s_suppkey AS string)) AS gene_symbol,
           CASE WHEN s_suppkey % 2 = 0 THEN CAST(100000 + s_suppkey AS string) END AS gene_id
    FROM supplier""",
    "gene_disease": """
    SELECT l_suppkey, l_partkey,
           concat(CASE WHEN l_suppkey % 6 = 1 THEN 'LOST' ELSE 'GENE' END, CAST(l_suppkey AS string)) AS gene_symbol,
           CASE WHEN l_suppkey % 2 = 0 THEN 100000 + l_suppkey ELSE NULL END AS ncbi_id,
           CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('disease ', CAST(l_partkey AS string)) END AS disease_name,
           concat('C', CAST(l_partkey AS string)) AS disease_id,
           CAST(CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE max(l_discount) * 10 END AS DOUBLE) AS score,
           CAST(CASE WHEN l_partkey % 22 = 0 THEN 0.5 ELSE NULL END AS DOUBLE) AS gda_score,
           CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'CURATED' END AS source
    FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "associations": """
    SELECT coalesce(CAST(ncbi_id AS string), gene_symbol) AS gene_key, gene_symbol AS Gene,
           coalesce(disease_name, disease_id) AS Disease, coalesce(nullif(score, 0), gda_score) AS Score,
           coalesce(source, 'DisGeNET') AS Source
    FROM gene_disease""",
    "keyed": """
    SELECT accession AS TargetID, protein_name, organism, p.gene_symbol, is_human,
           CASE WHEN is_human AND p.gene_symbol IS NOT NULL THEN coalesce(gene_id, p.gene_symbol) END AS gene_key
    FROM parsed_protein p LEFT JOIN gene_ids g ON p.gene_symbol = g.gene_symbol""",
    "status": """
    SELECT *, CASE WHEN NOT is_human THEN 'not_human' WHEN gene_key IS NULL THEN 'no_gene'
                   WHEN gene_key NOT IN (SELECT gene_key FROM associations) THEN 'no_associations' ELSE 'ok' END AS status
    FROM keyed""",
    "messages": """
    SELECT *, CASE status
        WHEN 'not_human' THEN concat(protein_name, ' is not human (', organism, '); associations cover human genes')
        WHEN 'no_gene' THEN concat('no gene symbol for human protein ', TargetID)
        WHEN 'no_associations' THEN concat('no disease associations for gene ', gene_symbol) END AS message
    FROM status""",
    "compound_cid": """
    SELECT CAST(p_partkey AS string) AS drug_id, concat('CC(=O)N', CAST(p_partkey AS string)) AS smiles,
           p_name AS title, concat('iupac-', CAST(p_partkey AS string)) AS iupac_name
    FROM part WHERE p_partkey % 3 = 0""",
    "compound_xref": """
    SELECT concat(CASE WHEN p_partkey % 3 = 2 THEN 'x' ELSE '' END, CAST(p_partkey AS string)) AS drug_id, concat('CC(=O)N', CAST(p_partkey AS string)) AS smiles,
           CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE NULL END AS title,
           concat('iupac-', CAST(p_partkey AS string)) AS iupac_name
    FROM part WHERE p_partkey % 3 <> 0""",
    "compound_property": """
    SELECT concat('CC(=O)N', CAST(p_partkey AS string)) AS smiles, CAST(300 + p_size * 6 AS DOUBLE) AS mol_weight,
           CAST(p_partkey % 80 AS DOUBLE) / 10 AS logp, p_partkey % 8 AS h_donors, p_partkey % 14 AS h_acceptors,
           CAST(p_size AS DOUBLE) * 2.5 AS tpsa, p_partkey % 12 AS rotatable_bonds
    FROM part""",
    "resolved": """
    SELECT d.DrugID, CASE WHEN numeric THEN coalesce(c.smiles, x.smiles) END AS smiles,
           CASE WHEN NOT numeric THEN NULL WHEN c.smiles IS NOT NULL THEN coalesce(c.title, c.iupac_name)
                ELSE coalesce(x.title, x.iupac_name) END AS name,
           CASE WHEN NOT numeric THEN NULL WHEN c.smiles IS NOT NULL THEN 'cid' WHEN x.smiles IS NOT NULL THEN 'xref'
                END AS via
    FROM (SELECT DrugID, regexp_full_match(DrugID, '[0-9]+') AS numeric FROM drugs) d
    LEFT JOIN compound_cid c ON d.DrugID = c.drug_id LEFT JOIN compound_xref x ON d.DrugID = x.drug_id""",
    "metrics_history": """
    SELECT event_type AS algorithm, value AS rmse, value / 100 AS aupr, ts AS run_ts, event_id AS run_id FROM events""",
    "latest": """
    SELECT * FROM metrics_history ORDER BY run_ts DESC, run_id DESC LIMIT 1""",
    "raw_text": f"""
    SELECT CASE WHEN l_quantity <> 7 THEN {_drug('l_partkey')} END AS DrugID,
           CASE WHEN l_quantity NOT IN (7, 8) OR l_partkey % 2 = 0 THEN {_target('l_suppkey')} END AS TargetID,
           CASE l_quantity WHEN 2 THEN '0.0' WHEN 3 THEN '-1.0' WHEN 4 THEN 'n/a' WHEN 5 THEN 'Infinity' WHEN 6 THEN 'NaN'
                WHEN 1 THEN NULL ELSE 'price' END AS kind, CAST(l_extendedprice AS VARCHAR) AS price,
           CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Davis' WHEN 'AO' THEN 'KIBA' WHEN 'NF' THEN 'IC50'
                WHEN 'NO' THEN 'Kd' WHEN 'RF' THEN 'Ki' ELSE 'EC50' END AS Source
    FROM lineitem""",
    "ruled": """
    SELECT *, CASE WHEN DrugID IS NULL THEN 'drug_id_missing' WHEN TargetID IS NULL THEN 'target_id_missing'
                   WHEN kind IS NULL THEN 'score_missing' WHEN kind = 'n/a' THEN 'score_not_a_number'
                   WHEN kind IN ('Infinity', 'NaN') THEN 'score_not_finite'
                   WHEN kind IN ('0.0', '-1.0') THEN 'score_not_positive' END AS Rule
    FROM raw_text""",
    "payload_keys": f"""
    SELECT 'protein' AS kind, accession AS key FROM parsed_protein
    UNION ALL SELECT 'gene_search', concat('GENE', CAST(s_suppkey AS VARCHAR)) FROM supplier
    UNION ALL SELECT 'compound', drug_id FROM compound_cid UNION ALL SELECT 'compound', drug_id FROM compound_xref
    UNION ALL SELECT DISTINCT 'disease', concat(gene_symbol, '|', CAST(l_partkey // 100 AS VARCHAR)) FROM gene_disease
    UNION ALL SELECT DISTINCT 'ppi', concat({_target('x')}, '|', CAST(y // 100 AS VARCHAR))
              FROM protein_links WHERE x % 10 = 9""",
    "payload_reasons": """
    SELECT kind, key, CASE substring(md5(key), 1, 1) WHEN '0' THEN 'not JSON' WHEN '1' THEN 'wrong shape'
                           WHEN '2' THEN 'missing' WHEN '3' THEN 'missing' WHEN '4' THEN 'not JSON' ELSE 'accepted' END AS reason
    FROM payload_keys""",
    "drug_factors": """
    SELECT p_partkey AS d, w * (p_size - 25) / 64 AS d1, w * (p_partkey % 7 - 3) / 64 AS d2,
           w * (p_partkey % 11 - 5) / 64 AS d3, w * (p_partkey % 13 - 6) / 64 AS d4
    FROM (SELECT *, CAST(p_partkey % 50 + 1 AS DOUBLE) AS w FROM part) p""",
    "target_factors": """
    SELECT s_suppkey AS t, (s_nationkey - 12) / 64.0::DOUBLE AS t1, (s_suppkey % 5 - 2) / 64.0::DOUBLE AS t2,
           (s_suppkey % 9 - 4) / 64.0::DOUBLE AS t3, (s_suppkey % 3 - 1) / 64.0::DOUBLE AS t4
    FROM supplier""",
    "products": """
    SELECT t, d, t1 * d1 + t2 * d2 + t3 * d3 + t4 * d4 AS score FROM target_factors CROSS JOIN drug_factors""",
    "drug_blocks": """
    SELECT d, length, CAST(floor((row_number() OVER (ORDER BY length DESC, d) - 1) / 64) AS BIGINT) AS block
    FROM (SELECT d, sqrt(d1 * d1 + d2 * d2 + d3 * d3 + d4 * d4) AS length FROM drug_factors) l""",
    "source_pairs": """
    SELECT Source, count(*) AS pairs FROM (SELECT DISTINCT DrugID, TargetID, Source FROM normalized) d GROUP BY Source""",
    "star": """
    SELECT TargetID, 'drug' AS kind, DrugID AS node, score FROM measured
    UNION ALL
    SELECT TargetID, 'ppi', NeighborID, ConfidenceScore FROM all_neighbors
    WHERE TargetID IN (SELECT TargetID FROM measured)""",
}

_PAIRS = """SELECT DrugID, TargetID, round(NormalizedScore, 6) AS NormalizedScore,
       round(AffinityScore, 6) AS AffinityScore, AffinityType, Sources, SourceCount, EvidenceRows FROM pairs"""
_RANKED = f"SELECT TargetID, Rank, DrugID, {_four('score')} AS PredictedScore FROM "
_SOURCE_TYPE = "SELECT DrugID, TargetID, Source, "
_VALID = "SELECT DrugID, TargetID, RawScore, Source FROM valid"
_TIERS = "(VALUES ('Low'), ('Medium'), ('High'), ('Very High')) tiers(Tier)"

TWINS: dict[str, str] = {
    "read_affinity": "SELECT DrugID, TargetID, RawScore, Source FROM canonical",
    "source_registry": _VALID,
    "read_ppi": "SELECT protein1, protein2, combined_score FROM raw_ppi",
    "load_table": "SELECT ProteinA, ProteinB, round(ConfidenceScore, 6) AS ConfidenceScore FROM edges",
    "save_table": _PAIRS,
    "bucketed_store": """
    SELECT m.TargetID, Rank, m.DrugID, score, SourceCount, EvidenceRows
    FROM measured m JOIN pairs p ON m.TargetID = p.TargetID AND m.DrugID = p.DrugID""",
    "export_csv": f"SELECT *, substring(TargetID, 1, 12) AS predictions FROM ({_RANKED} measured) r",
    "prediction_for_target": f"""
    SELECT TargetID, {RECOMMENDATION_TEXT} AS recommendations FROM measured WHERE TargetID = 'P00007' GROUP BY TargetID""",
    "canonical_affinity": "SELECT DrugID, TargetID, RawScore FROM canonical",
    "tag_source": "SELECT DrugID, Source FROM canonical",
    "valid_affinity": _VALID,
    "training_pairs": "SELECT DrugID, TargetID, round(NormalizedScore, 6) AS NormalizedScore FROM pairs",
    "ppi_confidence": "SELECT ProteinA, ProteinB, round(ConfidenceScore, 6) AS ConfidenceScore FROM confident",
    "human_targets": """
    SELECT TargetID FROM (SELECT TargetID, length(TargetID) = 6 AND substring(TargetID, 1, 1) IN ('P', 'Q', 'O') AS human
                          FROM targets) t
    WHERE human OR NOT EXISTS (SELECT 1 FROM targets
                               WHERE length(TargetID) = 6 AND substring(TargetID, 1, 1) IN ('P', 'Q', 'O'))""",
    "list_targets": "SELECT DISTINCT TargetID FROM measured",
    "drop_cold_start": """
    SELECT DrugID, TargetID, round(NormalizedScore, 6) AS NormalizedScore FROM split
    WHERE NOT is_training AND DrugID IN (SELECT DrugID FROM split WHERE is_training)
      AND TargetID IN (SELECT TargetID FROM split WHERE is_training)""",
    "binarize_label": """
    SELECT DrugID, TargetID, round(NormalizedScore, 6) AS NormalizedScore, prediction,
           CASE WHEN NormalizedScore >= 3.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS TrueLabel FROM baseline""",
    "pscale": _SOURCE_TYPE + "RawScore, round(AffinityScore, 6) AS AffinityScore FROM scored",
    "affinity_type": _SOURCE_TYPE + "AffinityType FROM scored",
    "pscale_curve": """
    SELECT point, round(nm, 6) AS nanomolar, round(9.0 - log10(nm), 6) AS pscale, 9.0 - log10(nm) >= 6.52 AS is_strong,
           coalesce(n, 0) AS measurements
    FROM (SELECT range AS point, pow(10.0, -1 + range * 6 / 299.0) AS nm FROM range(300)) c
    LEFT JOIN (SELECT CAST(greatest(least(floor((round(log10(RawScore), 9) + 1) * 299 / 6 + 0.5), 299), 0) AS BIGINT) AS place,
                      count(*) AS n
               FROM valid WHERE Source IN ('IC50', 'Kd', 'Ki', 'EC50') GROUP BY place) m ON c.point = m.place""",
    "strong_binders": _SOURCE_TYPE
    + """round(AffinityScore, 6) AS AffinityScore FROM normalized
    WHERE Source IN ('IC50', 'Kd', 'Ki', 'EC50') AND AffinityScore >= 5.0""",
    "rounded_score": _SOURCE_TYPE + f"{_four('coalesce(RawScore, 0)')} AS score FROM canonical",
    "display_label": """
    SELECT DISTINCT DrugID, TargetID,
           CASE WHEN length(TargetID) > 12 THEN concat(substring(TargetID, 1, 12), '…') ELSE TargetID END AS target_label,
           CASE WHEN length(DrugID) > 10 THEN concat(substring(DrugID, 1, 10), '…') ELSE DrugID END AS drug_label,
           substring(TargetID, 1, 12) AS neighbor_label, substring(DrugID, 1, 30) AS compound_label
    FROM canonical""",
    "numeric_id": "SELECT DrugID, regexp_full_match(trim(DrugID), '[0-9]+') AS is_numeric FROM drugs",
    "edge_strength": f"""
    SELECT TargetID, kind, node, round(score, 6) AS score, round(strength, 6) AS strength, round(width, 6) AS width
    FROM (SELECT *, {STRENGTH} FROM (
        SELECT TargetID, 'drug' AS kind, DrugID AS node, score FROM measured
        UNION ALL SELECT TargetID, 'ppi', NeighborID, ConfidenceScore FROM local_neighbors) e) s""",
    "disease_tier": f"SELECT Gene, Disease, round(Score, 6) AS Score, {TIER} AS Tier FROM associations",
    "minmax_by_source": """
    SELECT DrugID, TargetID, RawScore, round(AffinityScore, 6) AS AffinityScore,
           round(NormalizedScore, 6) AS NormalizedScore, AffinityType, Source FROM normalized""",
    "topk_drugs": "SELECT TargetID, DrugID, score, Rank FROM measured",
    "ranked_recommendations": _RANKED + "measured",
    "ppi_neighbors": """
    SELECT TargetID, NeighborID, round(ConfidenceScore, 6) AS ConfidenceScore, NeighborRank FROM local_neighbors
    WHERE TargetID IN (SELECT TargetID FROM targets)""",
    "lead_compound": """
    SELECT TargetID, Rank, DrugID, CompoundName, smiles FROM (
        SELECT *, row_number() OVER (PARTITION BY TargetID ORDER BY Rank) AS first FROM (
            SELECT m.TargetID, m.Rank, m.DrugID, substring(m.DrugID, 1, 30) AS CompoundName, m.DrugID AS smiles
            FROM measured m WHERE m.DrugID IN (SELECT smiles FROM compound_property)
            UNION ALL
            SELECT m.TargetID, m.Rank, m.DrugID, coalesce(nullif(r.name, ''), concat('Compound ', m.DrugID)), r.smiles
            FROM measured m JOIN resolved r ON m.DrugID = r.DrugID
            WHERE r.smiles IN (SELECT smiles FROM compound_property)) u) f
    WHERE first = 1""",
    "top_diseases": """
    SELECT gene_key, Gene, Disease, round(Score, 6) AS Score, Source, CAST(rk AS INTEGER) AS Rank FROM (
        SELECT *, row_number() OVER (PARTITION BY gene_key ORDER BY Score DESC, Disease, Source) AS rk
        FROM associations WHERE Score IS NOT NULL) t
    WHERE rk <= 12""",
    "cumulative_pairs": f"""
    SELECT CAST({ORDER_OF_SOURCE} AS INTEGER) AS position, Source, pairs,
           CAST(sum(pairs) OVER (ORDER BY {ORDER_OF_SOURCE}) AS BIGINT) AS cumulative FROM source_pairs""",
    "top_scores_head": _RANKED + "measured_long WHERE Rank <= 10",
    "integrated_pairs": _PAIRS,
    "incremental_pairs": _PAIRS,
    "dedup_report": "SELECT CAST(sum(EvidenceRows) AS BIGINT) AS rows_before, count(*) AS pairs_after FROM pairs",
    "overview_stats": """
    SELECT count(DISTINCT TargetID) AS unique_targets, count(*) AS integrated_pairs,
           (SELECT count(*) FROM edges) AS ppi_edges,
           (SELECT round(nullif(rmse, 0), 6) FROM latest) AS rmse, (SELECT round(nullif(aupr, 0), 6) FROM latest) AS aupr
    FROM pairs""",
    "source_choices": f"""
    SELECT choice, CAST(sum(n) FILTER (WHERE side = 'd') AS BIGINT) AS DrugID_exact, true AS DrugID_near,
           CAST(sum(n) FILTER (WHERE side = 't') AS BIGINT) AS TargetID_exact, true AS TargetID_near
    FROM (SELECT range AS choice FROM range(1, 64)) c
    JOIN (SELECT side, bits, count(*) AS n
          FROM (SELECT side, id, bit_or(1 << (CAST({ORDER_OF_SOURCE} AS INTEGER) - 1)) AS bits
                FROM (SELECT 'd' AS side, DrugID AS id, Source FROM valid
                      UNION ALL SELECT 't', TargetID, Source FROM valid) v GROUP BY side, id) m
          GROUP BY side, bits) b ON (choice & bits) <> 0
    GROUP BY choice""",
    "pairs_by_source": """
    SELECT Source, pairs, round(pairs / (SELECT sum(pairs) FROM source_pairs), 6) AS share FROM source_pairs""",
    "nested_recommendations": f"SELECT TargetID, {RECOMMENDATION_TEXT} AS recommendations FROM measured GROUP BY TargetID",
    "recommendation_count": """
    SELECT accession AS TargetID, count(m.TargetID) AS recommendations
    FROM protein LEFT JOIN measured m ON accession = m.TargetID GROUP BY accession""",
    "disease_tier_counts": f"""
    SELECT t.TargetID, t.Tier, count(s.Score) AS Count
    FROM (SELECT DISTINCT TargetID, gene_key, Tier
          FROM keyed JOIN associations USING (gene_key), {_TIERS}
          WHERE Score IS NOT NULL) t
    LEFT JOIN (SELECT gene_key, Score, {TIER} AS Tier FROM associations) s
      ON t.gene_key = s.gene_key AND t.Tier = s.Tier
    GROUP BY t.TargetID, t.Tier""",
    "score_histogram": """
    SELECT TargetID, bin, round(low + (high - low) * (bin - 1) / 15, 6) AS bin_low,
           round(low + (high - low) * bin / 15, 6) AS bin_high, count(*) AS count
    FROM (SELECT TargetID, low, high,
                 CAST(CASE WHEN high > low THEN least(floor((score - low) * 15 / (high - low)), 14) ELSE 0 END + 1 AS INTEGER)
                     AS bin
          FROM (SELECT TargetID, score, min(score) OVER (PARTITION BY TargetID) AS low,
                       max(score) OVER (PARTITION BY TargetID) AS high
                FROM (SELECT TargetID, round(NormalizedScore, 6) AS score FROM pairs) s) w) b
    GROUP BY TargetID, bin, low, high""",
    "latest_metrics": """
    SELECT algorithm, round(rmse, 6) AS rmse, round(aupr, 6) AS aupr, run_ts, run_id FROM latest""",
    "source_quality": """
    SELECT c.Source, round(coverage, 6) AS coverage, round(reliability, 6) AS reliability,
           round(normalizability, 6) AS normalizability
    FROM (SELECT Source, count(*) FILTER (WHERE RawScore > 0) * 100.0 / count(*) AS coverage
          FROM canonical GROUP BY Source) c
    LEFT JOIN (SELECT Source, count(*) FILTER (WHERE round(abs(s - mean), 6) <= 1.0) * 100.0 / count(*) AS reliability
               FROM (SELECT DrugID, TargetID, Source, avg(NormalizedScore) AS s FROM normalized
                     GROUP BY DrugID, TargetID, Source) x
               JOIN (SELECT DrugID, TargetID, NormalizedScore AS mean FROM pairs WHERE SourceCount > 1) p
                 USING (DrugID, TargetID)
               GROUP BY Source) r ON c.Source = r.Source
    LEFT JOIN (SELECT n.Source, count(*) FILTER (WHERE AffinityScore BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
                      * 100.0 / count(*) AS normalizability
               FROM normalized n JOIN (SELECT Source, quantile_cont(AffinityScore, 0.25) AS q1,
                                              quantile_cont(AffinityScore, 0.75) AS q3
                                       FROM normalized GROUP BY Source) q ON n.Source = q.Source
               GROUP BY n.Source) z ON c.Source = z.Source""",
    "union_sources": _VALID,
    "ppi_edges": "SELECT ProteinA, ProteinB, round(ConfidenceScore, 6) AS ConfidenceScore FROM edges",
    "ppi_undirected": """
    SELECT least(ProteinA, ProteinB) AS ProteinA, greatest(ProteinA, ProteinB) AS ProteinB,
           round(max(ConfidenceScore), 6) AS ConfidenceScore
    FROM edges GROUP BY ALL""",
    "ppi_with_fallback": """
    SELECT ProteinA, ProteinB, round(ConfidenceScore, 6) AS ConfidenceScore, Origin FROM fallback_edges""",
    "target_ppi": """
    SELECT TargetID, ProteinA, ProteinB, round(ConfidenceScore, 6) AS ConfidenceScore
    FROM targets JOIN edges ON TargetID = ProteinA OR TargetID = ProteinB""",
    "target_annotation": """
    SELECT TargetID, coalesce(protein_name, 'Unknown') AS protein_name, coalesce(organism, 'Unknown') AS organism,
           gene_symbol, coalesce(is_human, FALSE) AS is_human
    FROM (SELECT TargetID FROM targets UNION SELECT concat('X', TargetID) FROM targets) t
    LEFT JOIN parsed_protein ON TargetID = accession""",
    "disease_associations": """
    SELECT TargetID, 'ok' AS status, gene_symbol AS Gene, Disease, round(Score, 6) AS Score, Source
    FROM keyed JOIN associations USING (gene_key)
    UNION ALL
    SELECT TargetID, status, CASE WHEN status = 'no_associations' THEN gene_symbol ELSE '—' END, message, NULL,
           CASE status WHEN 'not_human' THEN 'Not applicable' WHEN 'no_gene' THEN 'UniProt'
                ELSE 'DisGeNET (no records)' END
    FROM messages WHERE status <> 'ok'""",
    "resolve_compound": "SELECT DrugID, smiles, name, via FROM resolved",
    "compound_properties": """
    SELECT DrugID, r.smiles, round(mol_weight, 2) AS mol_weight, round(logp, 2) AS logp, h_donors, h_acceptors,
           round(tpsa, 2) AS tpsa, rotatable_bonds
    FROM resolved r LEFT JOIN compound_property p ON r.smiles = p.smiles""",
    "network_edges": f"""
    SELECT TargetID, kind, node, round(score, 6) AS score, round(strength, 6) AS strength, round(width, 6) AS width
    FROM (SELECT *, {STRENGTH} FROM star) s""",
    "network_nodes": """
    SELECT TargetID, kind, node,
           CASE WHEN kind = 'target' AND length(node) > 12 THEN concat(substring(node, 1, 12), '…')
                WHEN kind = 'drug' AND length(node) > 10 THEN concat(substring(node, 1, 10), '…')
                ELSE substring(node, 1, 12) END AS label
    FROM (SELECT TargetID, kind, node FROM star UNION SELECT TargetID, 'target', TargetID FROM star) n""",
    "index_ids": """
    SELECT p.DrugID, p.TargetID, round(NormalizedScore, 6) AS NormalizedScore, CAST(drug_idx AS DOUBLE) AS drug_idx,
           CAST(target_idx AS DOUBLE) AS target_idx
    FROM pairs p JOIN drug_labels d ON p.DrugID = d.DrugID JOIN target_labels t ON p.TargetID = t.TargetID""",
    "growing_labels": " UNION ALL ".join(
        f"""
    SELECT '{side}' AS side, {side} AS id, row_number() OVER (ORDER BY first_load, first_rows DESC, {side}) - 1 AS idx, rows
    FROM (SELECT {side}, min(load) AS first_load, arg_min(n, load) AS first_rows, CAST(sum(n) AS BIGINT) AS rows
          FROM (SELECT {side}, ascii(right({other}, 1)) % 3 AS load, count(*) AS n FROM pairs GROUP BY ALL) l
          GROUP BY {side}) s"""
        for side, other in (("DrugID", "TargetID"), ("TargetID", "DrugID"))
    ),
    "split_pairs": """
    SELECT DrugID, TargetID, round(NormalizedScore, 6) AS NormalizedScore, is_training FROM split""",
    "rmse": "SELECT round(sqrt(avg(pow(NormalizedScore - prediction, 2))), 6) AS rmse FROM baseline",
    "aupr": """
    SELECT round(sum(hits * (tp / n + coalesce((tp - hits) / nullif(n - cnt, 0), tp / n)) / 2) / max(tp), 6) AS aupr
    FROM (SELECT hits, cnt, CAST(sum(hits) OVER w AS DOUBLE) AS tp, CAST(sum(cnt) OVER w AS DOUBLE) AS n
          FROM (SELECT prediction, count(*) FILTER (WHERE NormalizedScore >= 3.0) AS hits, count(*) AS cnt
                FROM baseline GROUP BY prediction) p
          WINDOW w AS (ORDER BY prediction DESC)) c""",
    "flatten_recommendations": """
    SELECT CAST(target_idx AS INTEGER) AS target_idx, CAST(drug_idx AS INTEGER) AS drug_idx, score
    FROM measured m JOIN drug_labels d ON m.DrugID = d.DrugID JOIN target_labels t ON m.TargetID = t.TargetID""",
    "decode_ids": "SELECT TargetID, DrugID, score FROM measured",
    "score_trend": f"""
    SELECT p.TargetID, Rank, PredictedScore, round(a + b * u + c * u * u, 6) AS Trend
    FROM (SELECT *, (t1 - s3 * c) / s2 AS b, (t0 - s2 * c) / n AS a
          FROM (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c
                FROM (SELECT TargetID, CAST(count(*) AS DOUBLE) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3,
                             sum(u * u * u * u) AS s4, sum(PredictedScore) AS t0, sum(u * PredictedScore) AS t1,
                             sum(u * u * PredictedScore) AS t2
                      FROM points GROUP BY TargetID HAVING count(*) >= 3) m) k) f
    RIGHT JOIN points p ON p.TargetID = f.TargetID""",
    "train_als": """
    SELECT 'drug' AS side, DrugID AS id, 20 AS factors, TRUE AS solved FROM split WHERE is_training GROUP BY DrugID
    UNION ALL
    SELECT 'target', TargetID, 20, TRUE FROM split WHERE is_training GROUP BY TargetID""",
    "train_als_targets": """
    SELECT TargetID, count(*) AS rows, TRUE AS solved FROM split WHERE is_training GROUP BY TargetID""",
    "score_pairs": """
    SELECT DrugID, TargetID, round(NormalizedScore, 6) AS NormalizedScore, TRUE AS is_product FROM split
    WHERE NOT is_training AND DrugID IN (SELECT DrugID FROM split WHERE is_training)
      AND TargetID IN (SELECT TargetID FROM split WHERE is_training)""",
    "metrics_record": """
    SELECT 'ALS-explicit' AS algorithm, CAST(20 AS BIGINT) AS rank, CAST(0.05 AS DOUBLE) AS regParam,
           CAST(15 AS BIGINT) AS maxIter, FALSE AS implicitPrefs, CAST(10 AS BIGINT) AS drugBlocks,
           CAST(10 AS BIGINT) AS targetBlocks, TRUE AS rmse_recomputed, TRUE AS aupr_recomputed""",
    "als_recommendations": """
    SELECT TargetID, CAST(least(5, (SELECT count(DISTINCT DrugID) FROM split WHERE is_training)) AS INTEGER) AS entries,
           TRUE AS are_best, TRUE AS all_different
    FROM split WHERE is_training GROUP BY TargetID""",
    "bounded_recommendations": """
    SELECT t AS target_idx, d AS drug_idx, CAST(rk AS INTEGER) AS Rank, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, d) AS rk FROM products) r WHERE rk <= 5""",
    "bounded_reach": """
    SELECT s.t AS target_idx, count(b.block) AS blocks, (SELECT count(DISTINCT block) FROM drug_blocks) AS "of"
    FROM (SELECT t, sqrt(t1 * t1 + t2 * t2 + t3 * t3 + t4 * t4) AS length, least FROM target_factors JOIN (
              SELECT t, min(score) AS least FROM (
                  SELECT t, score, row_number() OVER (PARTITION BY t ORDER BY score DESC) AS rk
                  FROM products JOIN drug_blocks USING (d) WHERE block = 0) f WHERE rk <= 5 GROUP BY t) k USING (t)) s
    LEFT JOIN (SELECT block, max(length) AS high FROM drug_blocks GROUP BY block) b
      ON s.length * b.high * (1 + 1e-9) + 1e-9 >= s.least
    GROUP BY s.t""",
    "reject_report": """
    SELECT Source, count(*) AS raw_rows, count(*) FILTER (Rule IS NULL) AS valid_rows,
           count(*) FILTER (Rule = 'drug_id_missing') AS drug_id_missing,
           count(*) FILTER (Rule = 'target_id_missing') AS target_id_missing,
           count(*) FILTER (Rule = 'score_missing') AS score_missing,
           count(*) FILTER (Rule = 'score_not_a_number') AS score_not_a_number,
           count(*) FILTER (Rule = 'score_not_finite') AS score_not_finite,
           count(*) FILTER (Rule = 'score_not_positive') AS score_not_positive
    FROM ruled GROUP BY Source""",
    "rejected_rows": """
    SELECT Source, Rule, DrugID, TargetID, CASE WHEN kind = 'price' THEN price ELSE kind END AS ScoreText
    FROM ruled WHERE Rule IS NOT NULL""",
    "payload_report": "SELECT kind, reason, count(*) AS payloads FROM payload_reasons GROUP BY kind, reason",
    "rejected_payloads": """
    SELECT key AS drug_id, reason FROM payload_reasons WHERE kind = 'compound' AND reason <> 'accepted'""",
    "accepted_proteins": """
    SELECT accession, protein_name, organism, is_human, gene_symbol FROM parsed_protein
    WHERE accession IN (SELECT key FROM payload_reasons WHERE kind = 'protein' AND reason = 'accepted')""",
    "predictions_of_drug": f"SELECT * FROM ({_RANKED} measured_long) r WHERE DrugID = '17'",
    "available_sources": """
    SELECT Source, count(*) AS rows FROM canonical WHERE Source <> 'Ki' GROUP BY Source""",
    "lead_screen": """
    SELECT l.TargetID, l.DrugID, l.CompoundName, l.smiles, round(mol_weight, 2) AS mol_weight, round(logp, 2) AS logp,
           h_donors, h_acceptors, round(tpsa, 2) AS tpsa, rotatable_bonds,
           mol_weight <= 500 AND logp <= 5 AND h_donors <= 5 AND h_acceptors <= 10 AS passes,
           (mol_weight > 500)::INTEGER + (logp > 5)::INTEGER + (h_donors > 5)::INTEGER + (h_acceptors > 10)::INTEGER
               AS violations
    FROM (LEAD) l JOIN compound_property p ON l.smiles = p.smiles""",
    "disease_associations_parsed": "ASSOCIATED",
    "ppi_fallback_parsed": f"""
    SELECT ProteinA, ProteinB, round(ConfidenceScore, 6) AS ConfidenceScore, 'local' AS Origin FROM edges
    UNION ALL
    SELECT {_target('x')}, {_target('y')}, round(sc / 1000.0, 6)::DOUBLE, 'secondary'
    FROM protein_links WHERE x % 10 = 9 AND y % 9 <> 0 AND sc >= 700
      AND {_target('x')} NOT IN (SELECT ProteinA FROM edges UNION SELECT ProteinB FROM edges)""",
    "resolve_compound_parsed": "SELECT DrugID, smiles, name FROM resolved",
    "parse_protein_json": "SELECT accession, protein_name, organism, is_human, gene_symbol FROM parsed_protein",
    "parse_ppi_json": f"""
    SELECT {_target('x')} AS ProteinA, {_target('y')} AS ProteinB,
           round(CASE WHEN y % 9 = 0 THEN 0 ELSE sc END / 1000.0, 6)::DOUBLE AS ConfidenceScore
    FROM protein_links WHERE x % 10 = 9""",
    "parse_disease_json": """
    SELECT gene_symbol, page, CAST(rk AS INTEGER) AS Position, coalesce(disease_name, disease_id) AS Disease,
           round(coalesce(nullif(score, 0), gda_score), 6) AS Score, coalesce(source, 'DisGeNET') AS Source
    FROM (SELECT *, l_partkey // 100 AS page,
                 row_number() OVER (PARTITION BY l_suppkey, l_partkey // 100 ORDER BY l_partkey) AS rk
          FROM gene_disease) p""",
    "parse_compound_json": """
    SELECT drug_id, smiles, coalesce(title, iupac_name) AS name
    FROM (SELECT * FROM compound_cid UNION ALL SELECT * FROM compound_xref) c""",
    "gene_id_from_search": "SELECT gene_symbol, gene_id FROM gene_ids",
    "lipinski_screen": """
    SELECT smiles, violations = 0 AS passes, CAST(violations AS INTEGER) AS violations
    FROM (SELECT smiles, (mol_weight > 500)::INTEGER + (logp > 5)::INTEGER + (h_donors > 5)::INTEGER
                 + (h_acceptors > 10)::INTEGER AS violations FROM compound_property) s""",
    "property_profile": """
    SELECT smiles, 'Mol. Weight' AS property, mol_weight AS value FROM compound_property
    UNION ALL SELECT smiles, 'LogP', logp FROM compound_property
    UNION ALL SELECT smiles, 'H-Bond Donors', CAST(h_donors AS DOUBLE) FROM compound_property
    UNION ALL SELECT smiles, 'H-Bond Acceptors', CAST(h_acceptors AS DOUBLE) FROM compound_property
    UNION ALL SELECT smiles, 'TPSA (Å²)', tpsa FROM compound_property""",
    "disease_status": "SELECT TargetID, gene_symbol, status, message FROM messages",
    "valid_structure": """
    SELECT DrugID FROM drugs WHERE NOT regexp_full_match(DrugID, '[0-9]+')
      AND DrugID IN (SELECT smiles FROM compound_property)""",
}

TWINS["lead_screen"] = TWINS["lead_screen"].replace("LEAD", TWINS["lead_compound"])
TWINS["disease_associations_parsed"] = TWINS["disease_associations"]

TABLES["points"] = f"""
    SELECT TargetID, Rank, {_four('score')} AS PredictedScore, Rank - avg(Rank) OVER (PARTITION BY TargetID) AS u
    FROM measured_long"""


def _needed(text: str, found: list[str]) -> list[str]:
    """Names of sub-selects that ``text`` reads, each after the ones it builds on."""
    for name, body in TABLES.items():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def sql_for(name: str) -> str:
    text = TWINS[name]
    tables = ",\n".join(f"{t} AS ({TABLES[t]})" for t in _needed(text, []))
    return f"WITH {tables}\n{text}" if tables else text


def all_sql() -> dict[str, str]:
    return {name: sql_for(name) for name in TWINS}
