"""The given star-schema tables read as affinity, network and annotation tables.

``FIXTURES.md`` fixes the mapping. Every function reads whole tables and only adds
expressions, aggregates and equi-joins, so the work grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligatable.sources.registry import SOURCES, AffinitySource

# Which flag pair of a line item stands for which source.
FLAGS = {("A", "F"): "Davis", ("A", "O"): "KIBA", ("N", "F"): "IC50", ("N", "O"): "Kd", ("R", "F"): "Ki"}
OTHER_FLAG = "EC50"
PAGE = 100


# Columns of the given tables. Stated, so that planning opens no file.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _text(key: Column) -> Column:
    return key.cast("string")


def _padded(key: Column, width: int) -> Column:
    # never shorter than the key itself, so that large keys stay apart
    text = _text(key)
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def target_id(key: Column) -> Column:
    other = F.concat(F.lit("ENSG"), _padded(key, 8))
    return F.when(key % 3 == 2, other).otherwise(F.concat(F.lit("P"), _padded(key, 5)))


def structure(key: Column) -> Column:
    return F.concat(F.lit("CC(=O)N"), _text(key))


def drug_id(key: Column) -> Column:
    return F.when(key % 5 == 0, structure(key)).otherwise(_text(key))


def raw_affinity(spark: SparkSession, folder: str) -> DataFrame:
    source = F.when(F.lit(False), F.lit(None).cast("string"))
    for (returned, status), name in FLAGS.items():
        source = source.when((F.col("l_returnflag") == returned) & (F.col("l_linestatus") == status), F.lit(name))
    quantity = F.col("l_quantity")
    affinity = (
        F.when(quantity == 1, F.lit(None).cast("double"))
        .when(quantity == 2, 0.0)
        .when(quantity == 3, -1.0)
        .otherwise(F.col("l_extendedprice"))
    )
    return table(spark, folder, "lineitem").select(
        drug_id(F.col("l_partkey")).alias("drug_id"),
        target_id(F.col("l_suppkey")).alias("target_id"),
        affinity.alias("affinity"),
        source.otherwise(F.lit(OTHER_FLAG)).alias("source"),
    )


def raw_text_affinity(spark: SparkSession, folder: str) -> DataFrame:
    """The affinity rows as text, some more of them broken: no number, not finite, or without an id."""
    quantity = F.col("l_quantity")
    score = (
        F.when(quantity == 2, "0.0")
        .when(quantity == 3, "-1.0")
        .when(quantity == 4, "n/a")
        .when(quantity == 5, "Infinity")
        .when(quantity == 6, "NaN")
        .when(quantity != 1, F.col("l_extendedprice").cast("string"))
    )
    source = F.concat("l_returnflag", "l_linestatus")
    named = F.create_map(*(F.lit(x) for flags, name in FLAGS.items() for x in ("".join(flags), name)))
    return table(spark, folder, "lineitem").select(
        F.when(quantity != 7, drug_id(F.col("l_partkey"))).alias("drug_id"),
        F.when(~quantity.isin(7, 8) | (F.col("l_partkey") % 2 == 0), target_id(F.col("l_suppkey"))).alias("target_id"),
        score.alias("affinity"),
        F.coalesce(F.try_element_at(named, source), F.lit(OTHER_FLAG)).alias("source"),
    )


def broken_payloads(payloads: DataFrame, is_list: bool, *key: str) -> DataFrame:
    """Some payloads cut short, of the other shape, missing or blank, by the hash of their key."""
    digit = F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, 1)
    text = F.col("payload")
    other = F.concat(F.lit('{"items":'), text, F.lit("}")) if is_list else F.concat(F.lit("["), text, F.lit("]"))
    changed = (
        F.when(digit == "0", text.substr(F.lit(1), F.length(text) - 1))
        .when(digit == "1", other)
        .when(digit == "2", F.lit(None).cast("string"))
        .when(digit == "3", " ")
        .when(digit == "4", F.concat(text, F.lit("}")))
        .otherwise(text)
    )
    return payloads.withColumn("payload", changed)


def source_frames(spark: SparkSession, folder: str) -> list[tuple[AffinitySource, DataFrame]]:
    """The same rows as one table per registered source, under that source's column names."""
    raw = raw_affinity(spark, folder)
    return [
        (
            s,
            raw.filter(F.col("source") == s.name).select(
                F.col("drug_id").alias(s.drug_col),
                F.col("target_id").alias(s.target_col),
                F.col("affinity").alias(s.score_col),
            ),
        )
        for s in SOURCES
    ]


def _protein_links(spark: SparkSession, folder: str) -> DataFrame:
    """Both directions of links between a supplier and a supplier picked by part and line."""
    # one row of one number, brought in as a scalar subquery
    modulus = table(spark, folder, "supplier").agg((F.max("s_suppkey") + 1).alias("m")).scalar()
    picked = (F.col("l_partkey") * 7 + F.col("l_linenumber")) % modulus
    links = (
        table(spark, folder, "lineitem")
        .select(F.col("l_suppkey").alias("x"), picked.alias("y"))
        .filter(F.col("x") != F.col("y"))
    )
    both = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    score = (F.least("x", "y") * 37 + F.greatest("x", "y") * 101) % 1001
    return links.select(both.alias("e")).select("e.x", "e.y").distinct().withColumn("sc", score)


def _has_local_links(key: str) -> Column:
    return F.col(key) % 10 != 9


def raw_ppi(spark: SparkSession, folder: str) -> DataFrame:
    local = _protein_links(spark, folder).filter(_has_local_links("x") & _has_local_links("y"))
    weaker = F.greatest(F.col("sc") - 50, F.lit(0))
    copies = F.when((F.col("x") + F.col("y")) % 4 == 0, F.array(F.col("sc"), weaker)).otherwise(F.array("sc"))
    return local.select("x", "y", F.explode(copies).alias("sc")).select(
        target_id(F.col("x")).alias("protein1"),
        target_id(F.col("y")).alias("protein2"),
        F.col("sc").alias("combined_score"),
    )


def raw_ppi_secondary(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _protein_links(spark, folder)
        .filter(~_has_local_links("x"))
        .select(
            target_id(F.col("x")).alias("protein1"),
            target_id(F.col("y")).alias("protein2"),
            F.col("sc").alias("combined_score"),
        )
    )


def _paged_json(rows: DataFrame, keys: list[str], order: str, item: Column) -> DataFrame:
    """One JSON array per key; the keys include a page, which bounds the array."""
    pages = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))).alias("r"))
    return pages.select(*keys, F.to_json(F.transform("r", lambda r: r["v"])).alias("payload"))


def ppi_payload(spark: SparkSession, folder: str) -> DataFrame:
    """The secondary links as JSON, at most ``PAGE`` partners each; some fields are left out."""
    links = _protein_links(spark, folder).filter(~_has_local_links("x"))
    partner = target_id(F.col("y"))
    item = F.struct(
        F.when(F.col("y") % 4 != 0, partner).alias("preferredName_B"),
        partner.alias("stringId_B"),
        F.when(F.col("y") % 9 != 0, F.col("sc")).alias("score"),
    )
    rows = links.select(target_id(F.col("x")).alias("ProteinA"), F.floor(F.col("y") / PAGE).alias("page"), "y", "sc")
    return _paged_json(rows, ["ProteinA", "page"], "y", item)


def protein(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("s_suppkey"), F.col("s_name")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, folder, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            target_id(key).alias("accession"),
            F.when(F.col("r_name").isin("EUROPE", "ASIA"), 9606).otherwise(10090).alias("taxon_id"),
            F.col("r_name").alias("organism"),
            F.when(key % 7 != 0, name).alias("recommended_name"),
            F.when(key % 14 != 0, F.concat(F.lit("sub "), name)).alias("submitted_name"),
            F.when(key % 5 != 0, F.concat(F.lit("GENE"), _text(key))).alias("gene_primary"),
            F.when(key % 10 != 0, F.concat(F.lit("SYN"), _text(key))).alias("gene_synonym"),
        )
    )


def protein_payload(spark: SparkSession, folder: str) -> DataFrame:
    """The protein rows as nested JSON; absent names are absent fields."""

    def valued(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value")))

    def full_name(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(valued(c).alias("fullName")))

    entry = F.struct(
        F.struct(F.col("organism").alias("scientificName"), F.col("taxon_id").alias("taxonId")).alias("organism"),
        F.struct(
            full_name("recommended_name").alias("recommendedName"),
            F.array_compact(F.array(full_name("submitted_name"))).alias("submittedNames"),
        ).alias("proteinDescription"),
        F.array(
            F.struct(
                valued("gene_primary").alias("geneName"),
                F.array_compact(F.array(valued("gene_synonym"))).alias("synonyms"),
            )
        ).alias("genes"),
    )
    return protein(spark, folder).select("accession", F.to_json(entry).alias("payload"))


def _gene_disease_keys(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.max("l_discount").alias("discount"))
    )


def _gene_disease_columns() -> dict[str, Column]:
    gene, part = F.col("l_suppkey"), F.col("l_partkey")
    return {
        # a sixth of the genes goes by symbols that no protein has
        "gene_symbol": F.concat(F.when(gene % 6 == 1, "LOST").otherwise("GENE"), _text(gene)),
        "ncbi_id": F.when(gene % 2 == 0, gene + 100000),
        "disease_name": F.when(part % 4 != 0, F.concat(F.lit("disease "), _text(part))),
        "disease_id": F.concat(F.lit("C"), _text(part)),
        "score": F.when(part % 11 != 0, F.col("discount") * 10),
        "gda_score": F.when(part % 22 == 0, F.lit(0.5)),
        "source": F.when(part % 3 != 0, F.lit("CURATED")),
    }


def gene_disease(spark: SparkSession, folder: str) -> DataFrame:
    columns = _gene_disease_columns()
    return _gene_disease_keys(spark, folder).select(*(c.alias(name) for name, c in columns.items()))


def disease_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Associations as JSON, one page of at most ``PAGE`` consecutive parts per gene.

    The alternate field names change with the part, so each of them is met.
    """
    c, part = _gene_disease_columns(), F.col("l_partkey")
    item = F.struct(
        F.when(part % 2 == 0, c["disease_name"]).alias("disease_name"),
        F.when(part % 2 == 1, c["disease_name"]).alias("diseaseName"),
        F.when(part % 8 == 0, F.lit("")).alias("disease"),
        c["disease_id"].alias("diseaseId"),
        c["score"].alias("score"),
        c["gda_score"].alias("gda_score"),
        F.when(part % 2 == 0, c["source"]).alias("source"),
        F.when(part % 2 == 1, c["source"]).alias("sourceName"),
    )
    rows = _gene_disease_keys(spark, folder).select(
        "l_suppkey", "l_partkey", "discount", c["gene_symbol"].alias("gene_symbol"), F.floor(part / PAGE).alias("page")
    )
    return _paged_json(rows, ["gene_symbol", "page"], "l_partkey", item)


def gene_search_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Search answer per gene; the id moves between its alternate fields, odd genes have none."""
    gene = F.col("s_suppkey")
    ncbi = F.when(gene % 2 == 0, gene + 100000)
    hit = F.struct(
        F.when(gene % 6 == 0, ncbi).alias("ncbi_id"),
        F.when(gene % 6 == 2, ncbi).when(gene % 6 == 4, 0).alias("geneid"),
        F.when(gene % 6 == 4, ncbi).alias("ncbiId"),
    )
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("GENE"), _text(gene)).alias("gene_symbol"), F.to_json(F.array(hit)).alias("payload")
    )


def _compounds(spark: SparkSession, folder: str, rows: Column, title: Callable[[Column], Column]) -> DataFrame:
    """Parts that leave 2 on division by 3 stand under ids that no drug has."""
    key = F.col("p_partkey")
    return (
        table(spark, folder, "part")
        .filter(rows)
        .select(
            F.concat(F.when(key % 3 == 2, "x").otherwise(""), _text(key)).alias("drug_id"),
            structure(key).alias("smiles"),
            title(key).alias("title"),
            F.concat(F.lit("iupac-"), _text(key)).alias("iupac_name"),
        )
    )


def compound_cid(spark: SparkSession, folder: str) -> DataFrame:
    return _compounds(spark, folder, F.col("p_partkey") % 3 == 0, lambda key: F.col("p_name"))


def compound_xref(spark: SparkSession, folder: str) -> DataFrame:
    return _compounds(spark, folder, F.col("p_partkey") % 3 != 0, lambda key: F.when(key % 2 == 0, F.col("p_name")))


def compound_payload(spark: SparkSession, folder: str) -> DataFrame:
    """Both compound tables as JSON property records."""
    record = F.struct(
        F.col("smiles").alias("IsomericSMILES"), F.col("title").alias("Title"), F.col("iupac_name").alias("IUPACName")
    )
    body = F.struct(F.struct(F.array(record).alias("Properties")).alias("PropertyTable"))
    rows = compound_cid(spark, folder).unionByName(compound_xref(spark, folder))
    return rows.select("drug_id", F.to_json(body).alias("payload"))


def compound_property(spark: SparkSession, folder: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        structure(key).alias("smiles"),
        (size * 6 + 300).cast("double").alias("mol_weight"),
        ((key % 80).cast("double") / 10).alias("logp"),
        (key % 8).alias("h_donors"),
        (key % 14).alias("h_acceptors"),
        (size.cast("double") * 2.5).alias("tpsa"),
        (key % 12).alias("rotatable_bonds"),
    )


def metrics_history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("algorithm"),
        F.col("value").alias("rmse"),
        (F.col("value") / 100).alias("aupr"),
        F.col("ts").alias("run_ts"),
        F.col("event_id").alias("run_id"),
    )


def _factors(rows: DataFrame, key: Column, weight: Column, *numbers: Column) -> DataFrame:
    """Multiples of 1/64, so that products and their sums are exact."""
    return rows.select(key.alias("id"), F.array(*((weight * n).cast("double") / 64 for n in numbers)).alias("features"))


def drug_factors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    numbers = (F.col("p_size") - 25, key % 7 - 3, key % 11 - 5, key % 13 - 6)
    return _factors(table(spark, folder, "part"), key, key % 50 + 1, *numbers)


def target_factors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    numbers = (F.col("s_nationkey") - 12, key % 5 - 2, key % 9 - 4, key % 3 - 1)
    return _factors(table(spark, folder, "supplier"), key, F.lit(1), *numbers)
