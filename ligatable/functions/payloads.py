"""Nested JSON payloads to flat columns, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligatable.functions.labels import non_empty

HUMAN_TAXON = 9606
UNKNOWN = "Unknown"
DISEASE_SOURCE = "DisGeNET"

# Field names of the payloads.
PROTEIN_SCHEMA = """
    organism STRUCT<scientificName: STRING, taxonId: BIGINT>,
    proteinDescription STRUCT<
        recommendedName: STRUCT<fullName: STRUCT<value: STRING>>,
        submittedNames: ARRAY<STRUCT<fullName: STRUCT<value: STRING>>>>,
    genes ARRAY<STRUCT<geneName: STRUCT<value: STRING>, synonyms: ARRAY<STRUCT<value: STRING>>>>
"""
PPI_SCHEMA = "ARRAY<STRUCT<preferredName_B: STRING, stringId_B: STRING, score: DOUBLE>>"
GENE_SEARCH_SCHEMA = "ARRAY<STRUCT<ncbi_id: STRING, geneid: STRING, ncbiId: STRING>>"
DISEASE_SCHEMA = """ARRAY<STRUCT<
    disease_name: STRING, diseaseName: STRING, disease: STRING, diseaseId: STRING,
    score: DOUBLE, gda_score: DOUBLE, source: STRING, sourceName: STRING>>"""
COMPOUND_SCHEMA = """
    PropertyTable STRUCT<Properties: ARRAY<STRUCT<IsomericSMILES: STRING, Title: STRING, IUPACName: STRING>>>
"""

# What a payload is at its top.
OBJECT, OBJECTS = "^OBJECT<", "^ARRAY<(OBJECT|VOID)"
#: Top and fields of each kind of payload.
KINDS: dict[str, tuple[str, str]] = {
    "protein": (OBJECT, PROTEIN_SCHEMA),
    "ppi": (OBJECTS, PPI_SCHEMA),
    "gene_search": (OBJECTS, GENE_SEARCH_SCHEMA),
    "disease": (OBJECTS, DISEASE_SCHEMA),
    "compound": (OBJECT, COMPOUND_SCHEMA),
}
MISSING, NOT_JSON, WRONG_SHAPE, WRONG_FIELDS = "missing", "not JSON", "wrong shape", "wrong fields"


def payload_reason(payload: Column, kind: str) -> Column:
    """Why a payload cannot be parsed as ``kind``, or null: the first of four tests that fails.

    Blank text is missing. JSON is taken strictly, to its last character. An object may not stand
    where a list of objects is due, nor the other way. Fields that are not known are no fault.
    """
    shape, schema = KINDS[kind]
    # the parser ends with the first value: only one whole value parses inside both kinds of brackets
    listed = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}")))
    value = F.try_variant_get(named, "$.v", "variant")
    return (
        F.when(~F.coalesce(payload.rlike(r"\S"), F.lit(False)), MISSING)
        .when(listed.isNull() | named.isNull(), NOT_JSON)
        .when(~F.schema_of_variant(value).rlike(shape), WRONG_SHAPE)
        .when(F.from_json(payload, schema).isNull(), WRONG_FIELDS)
    )


def checked_payloads(payloads: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Add ``reason``: rows without go to the parser of ``kind``, the others to a table of rejects."""
    return payloads.withColumn("reason", payload_reason(F.col(payload), kind))


def accepted_payloads(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason")


def rejected_payloads(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def payload_report(checked: DataFrame, kind: str) -> DataFrame:
    """Payloads by reason; the accepted ones stand under ``accepted``."""
    reason = F.coalesce("reason", F.lit("accepted")).alias("reason")
    return checked.groupBy(reason).agg(F.count(F.lit(1)).alias("payloads")).select(F.lit(kind).alias("kind"), "reason", "payloads")


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def parse_protein_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Replace the payload by protein name, organism, human flag and gene symbol."""
    entry = F.from_json(payload, PROTEIN_SCHEMA)
    names = F.col("_p.proteinDescription")
    gene = _first(F.col("_p.genes"))
    return (
        payloads.withColumn("_p", entry)
        .withColumn(
            "protein_name",
            F.coalesce(
                names["recommendedName"]["fullName"]["value"],
                _first(names["submittedNames"])["fullName"]["value"],
                F.lit(UNKNOWN),
            ),
        )
        .withColumn("organism", F.coalesce(F.col("_p.organism.scientificName"), F.lit(UNKNOWN)))
        .withColumn("is_human", F.coalesce(F.col("_p.organism.taxonId") == HUMAN_TAXON, F.lit(False)))
        .withColumn(
            "gene_symbol",
            F.coalesce(non_empty(gene["geneName"]["value"]), _first(gene["synonyms"])["value"]),
        )
        .drop("_p", payload)
    )


def parse_ppi_json(
    payloads: DataFrame, protein: str = "ProteinA", payload: str = "payload", divisor: float = 1000.0
) -> DataFrame:
    """One edge per array element, the confidence brought to [0, 1] by ``divisor``."""
    return payloads.select(
        F.col(protein).alias("ProteinA"), F.explode(F.from_json(payload, PPI_SCHEMA)).alias("_e")
    ).select(
        "ProteinA",
        F.coalesce("_e.preferredName_B", "_e.stringId_B", F.lit("")).alias("ProteinB"),
        (F.coalesce("_e.score", F.lit(0.0)) / divisor).alias("ConfidenceScore"),
    )


def disease_name(*alternatives: Column) -> Column:
    """First alternative that is neither null nor empty."""
    return F.coalesce(*(non_empty(a) for a in alternatives), F.lit(UNKNOWN))


def disease_score(score: Column, alternative: Column) -> Column:
    """A score of 0 counts as missing and gives way to the alternative."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), alternative)


def disease_source(*alternatives: Column) -> Column:
    return F.coalesce(*(non_empty(a) for a in alternatives), F.lit(DISEASE_SOURCE))


def parse_disease_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """All associations of each payload, ``Position`` counting from 1."""
    kept = [c for c in payloads.columns if c != payload]
    items = F.from_json(payload, DISEASE_SCHEMA)
    d = F.col("_d")
    return payloads.select(*kept, F.posexplode(items).alias("_pos", "_d")).select(
        *kept,
        (F.col("_pos") + 1).alias("Position"),
        disease_name(d["disease_name"], d["diseaseName"], d["disease"], d["diseaseId"]).alias("Disease"),
        disease_score(d["score"], d["gda_score"]).alias("Score"),
        disease_source(d["source"], d["sourceName"]).alias("Source"),
    )


def parse_compound_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Structure and name from the first property record."""
    first = _first(F.from_json(payload, COMPOUND_SCHEMA)["PropertyTable"]["Properties"])
    return (
        payloads.withColumn("_c", first)
        .withColumn("smiles", F.col("_c.IsomericSMILES"))
        .withColumn("name", compound_name(F.col("_c.Title"), F.col("_c.IUPACName")))
        .drop("_c", payload)
    )


def compound_name(title: Column, iupac: Column) -> Column:
    return F.coalesce(non_empty(title), iupac)


def gene_id_from_search(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Gene id of the first search hit; null where the search found none."""
    hit = _first(F.from_json(payload, GENE_SEARCH_SCHEMA))
    ids = (F.nullif(non_empty(hit[c]), F.lit("0")) for c in ("ncbi_id", "geneid", "ncbiId"))
    return payloads.withColumn("gene_id", F.coalesce(*ids)).drop(payload)
