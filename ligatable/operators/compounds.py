"""Structures, properties and the rule-of-five screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligatable.functions.labels import COMPOUND_NAME, non_empty, numeric_id, trimmed
from ligatable.functions.payloads import compound_name
from ligatable.operators.skew import one_per, salted_join

# Property column, its display name, digits (None for whole numbers).
PROPERTIES: tuple[tuple[str, str, int | None], ...] = (
    ("mol_weight", "Mol. Weight", 2),
    ("logp", "LogP", 2),
    ("h_donors", "H-Bond Donors", None),
    ("h_acceptors", "H-Bond Acceptors", None),
    ("tpsa", "TPSA (Å²)", 2),
    ("rotatable_bonds", "Rotatable Bonds", None),
)
# Upper limits of the screen; all four must hold.
LIMITS = {"mol_weight": 500, "logp": 5, "h_donors": 5, "h_acceptors": 10}
PROFILE_LENGTH = 5


def resolve_compound(drugs: DataFrame, by_cid: DataFrame, by_xref: DataFrame) -> DataFrame:
    """Structure and name of each distinct drug id, by compound id and then by cross-reference.

    Ids that are not numeric are not looked up. The name comes from the table that
    gave the structure. Of several rows for one id the smallest structure counts.
    """
    ids = drugs.select("DrugID").distinct()
    key = F.when(numeric_id(F.col("DrugID")), trimmed(F.col("DrugID")))

    def lookup(table: DataFrame, side: str) -> DataFrame:
        found = table.filter(non_empty(F.col("smiles")).isNotNull()).select(
            F.col("drug_id").alias("_key"),
            F.col("smiles").alias(f"{side}_smiles"),
            compound_name(F.col("title"), F.col("iupac_name")).alias(f"{side}_name"),
        )
        return one_per(found, "_key", f"{side}_smiles", f"{side}_name")

    # ids that are not looked up stay out of the joins: as null keys they would meet in one task
    numeric = ids.withColumn("_key", key).filter(F.col("_key").isNotNull())
    found = numeric.join(lookup(by_cid, "cid"), "_key", "left").join(lookup(by_xref, "xref"), "_key", "left")
    by_first = F.col("cid_smiles").isNotNull()
    resolved = found.select(
        "DrugID",
        F.coalesce("cid_smiles", "xref_smiles").alias("smiles"),
        F.when(by_first, F.col("cid_name")).otherwise(F.col("xref_name")).alias("name"),
        F.when(by_first, "cid").when(F.col("xref_smiles").isNotNull(), "xref").alias("via"),
    )
    nothing = F.lit(None).cast("string")
    other = ids.filter(key.isNull()).select(
        "DrugID", nothing.alias("smiles"), nothing.alias("name"), nothing.alias("via")
    )
    return resolved.unionByName(other)


def valid_structure(drugs: DataFrame, properties: DataFrame) -> DataFrame:
    """Distinct ids that are structures themselves: not empty, not numeric, known to the compound table."""
    ids = drugs.select("DrugID").distinct()
    usable = (trimmed(F.col("DrugID")) != "") & ~numeric_id(F.col("DrugID"))
    known = properties.select(F.col("smiles").alias("DrugID")).distinct()
    return ids.filter(usable).join(known, "DrugID", "left_semi")


def lead_compound(
    recommendations: DataFrame,
    by_cid: DataFrame,
    by_xref: DataFrame,
    properties: DataFrame,
    first: int | None = None,
) -> DataFrame:
    """Per target the best of its drugs that has a usable structure, or of its ``first``.

    Each distinct drug is resolved once; the candidates then fetch the result, salted,
    since one drug may be a candidate of very many targets. ``recommendations`` are read
    several times: pass a stored table.
    """
    taken = recommendations if first is None else recommendations.filter(F.col("Rank") <= first)
    candidates = taken.select("TargetID", "Rank", "DrugID")
    direct = valid_structure(candidates, properties).select(
        "DrugID", F.col("DrugID").alias("smiles"), F.substring("DrugID", 1, COMPOUND_NAME).alias("name")
    )
    resolved = resolve_compound(candidates, by_cid, by_xref).filter(F.col("smiles").isNotNull())
    known = properties.select("smiles").distinct()
    looked_up = resolved.join(known, "smiles", "left_semi").select(
        "DrugID",
        "smiles",
        F.coalesce(non_empty(F.col("name")), F.concat(F.lit("Compound "), F.col("DrugID"))).alias("name"),
    )
    usable = salted_join(candidates, direct.unionByName(looked_up), "DrugID")
    best = F.min(F.struct("Rank", "DrugID", "name", "smiles"))
    return usable.groupBy("TargetID").agg(best.alias("l")).select(
        "TargetID", "l.Rank", "l.DrugID", F.col("l.name").alias("CompoundName"), "l.smiles"
    )


def compound_properties(compounds: DataFrame, properties: DataFrame) -> DataFrame:
    """Attach the property row of each compound's ``smiles``; unknown compounds keep nulls.

    Of several rows for one structure the smallest counts.
    """
    rounded = [
        (F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c, _, digits in PROPERTIES
    ]
    return salted_join(compounds, one_per(properties.select("smiles", *rounded), "smiles"), "smiles", "left").select(
        *compounds.columns, *(c for c, _, _ in PROPERTIES)
    )


def lipinski_screen(properties: DataFrame) -> DataFrame:
    """Add ``passes`` (all four limits hold) and ``violations``; a missing property is a violation."""

    def kept(name: str) -> Column:
        return F.coalesce(F.col(name) <= LIMITS[name], F.lit(False)).cast("int")

    met = sum((kept(name) for name in LIMITS), start=F.lit(0))
    return properties.withColumns({"passes": met >= len(LIMITS), "violations": F.lit(len(LIMITS)) - met})


def property_profile(properties: DataFrame) -> DataFrame:
    """The first five properties of each compound in long form."""
    shown = PROPERTIES[:PROFILE_LENGTH]
    wide = properties.select("smiles", *(F.col(c).cast("double").alias(title) for c, title, _ in shown))
    titles = [F.col(f"`{title}`") for _, title, _ in shown]
    return wide.unpivot("smiles", titles, "property", "value")
