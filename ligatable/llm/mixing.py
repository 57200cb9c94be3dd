"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligatable.llm.common import SPACES
from ligatable.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
#: Hash bins of a source. All documents but those of one bin are repeated whole.
BINS = 4096
#: Sources whose plan, of some 50 bytes each, is broadcast.
FEW_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def _digits(doc_id: Column, start: int, n: int) -> Column:
    """``n`` hex digits of the id's md5 as a number; a null id counts as empty."""
    md5 = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(md5, start, n), 16, 10).cast("long")


def source_targets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2.0
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights``, repeated, and share
    ``share`` of all sizes. No target exceeds ``epochs`` times its source; the excess
    is reshared by weight until none is above. That comes to rest at the level ``x``
    with ``sum(least(cap, weight * x)) = total``: in the order in which sources fill
    up, the first one that need not fill up fixes ``x``. If all caps together are
    below the total, every source gets its cap. The table has one row per source.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    weighed = totals.withColumn("w", F.element_at(pattern, place.cast("int"))).withColumn(
        "cap", F.col("source_size") * F.lit(float(epochs))
    )
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.lit(float(share)) * F.sum("source_size").over(whole)
    levels = weighed.withColumn(
        "x",
        (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    # x rises while sources fill up, and falls from the first one that does not
    level = F.max("x").over(whole)
    return levels.select(
        "source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target")
    )


def mix_plan(sized: DataFrame, **target_options: object) -> DataFrame:
    """Per source: its target, whole repetitions, and the bin where an extra one ends.

    ``sized`` has ``source, size, bin``. Sizes are summed by source and bin, at most
    ``BINS`` rows a source, so a source with a third of all rows shrinks before any
    shuffle. Documents in bins below ``cut`` are repeated once more, those in ``cut``
    by the fraction ``part``, so that the taken words meet the target.
    """
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    totals = bins.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(totals, **target_options).withColumn(
        "whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    )
    upto = Window.partitionBy("source").orderBy("bin")
    running = bins.withColumn("upto", F.sum("n").over(upto)).withColumnRenamed("source", "of")
    extra = F.col("target") - F.col("whole") * F.col("source_size")
    cut = F.min(F.when(F.col("upto") > F.col("extra"), F.struct("bin", "upto", "n")))
    return (
        targets.withColumn("extra", extra)
        .join(running, F.col("source").eqNullSafe(F.col("of")))
        .groupBy("source", "source_size", "target", "whole", "extra")
        .agg(cut.alias("at"))
        .select(
            F.col("source").alias("of"),
            "source_size",
            "target",
            "whole",
            F.coalesce(F.col("at.bin"), F.lit(BINS)).alias("cut"),
            F.coalesce((F.col("extra") - (F.col("at.upto") - F.col("at.n"))) / F.col("at.n"), F.lit(0.0)).alias("part"),
        )
    )


def mix_quotas(docs: DataFrame, keep: Sequence[str] = (), **target_options: object) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the columns in ``keep``.

    ``docs`` needs ``doc_id, text, source``. Size is the number of words of the whole
    text (null and empty: 0, and nothing is taken). A source is repeated
    ``target / source_size`` times: every document that many whole times, and those
    with the smallest id hashes once more, until the target is met; documents of the
    one bin where it ends take a part. The draw is seeded by ``doc_id``: reruns agree,
    rows that repeat an id get the same decision, and null ids share one draw. No
    document exceeds the cap. Sources that are null form one source. Other columns are
    not read, whatever their names. No documents give no rows.
    """
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        _digits(F.col("doc_id"), 1, 3).alias("bin"),
        (_digits(F.col("doc_id"), 4, 6) / F.lit(float(16**6))).alias("u"),
        F.struct(*(F.col(c) for c in keep)).alias("kept") if keep else F.lit(None).cast("int").alias("kept"),
    )
    plan = cut_lineage(mix_plan(sized.select("source", "size", "bin"), **target_options))
    # a plan of few sources goes to the documents; with more, documents meet it by source,
    # where adaptive execution splits a source with very many of them
    if plan.count() <= FEW_SOURCES:
        plan = F.broadcast(plan)
    size, part = F.col("size"), F.floor(F.col("part") * F.col("size") + F.col("u"))
    extra = F.when(F.col("bin") < F.col("cut"), size).when(F.col("bin") == F.col("cut"), part).otherwise(F.lit(0))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")))
    return joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("whole") * size + extra).cast("long").alias("taken"),
        *((F.col(f"kept.{c}").alias(c)) for c in keep if c != "doc_id"),
    )


def mixed_documents(docs: DataFrame, **target_options: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, repeated, plus ``repeat`` (from 1).

    A whole repetition is the row as it is. A part is a run of the text's words that
    starts at a place drawn from the id and goes on at the beginning after the end,
    joined by single spaces. ``docs`` needs the columns of ``documents``.
    """
    columns = list(docs.columns)
    carried = docs.select(
        "doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    )
    quotas = mix_quotas(carried, keep=("row",), **target_options)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    copies = (
        quotas.withColumn("rest", rest)
        .filter(F.col("taken") > 0)
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    )
    words = F.regexp_extract_all(F.col("row.text"), F.lit(SPACES), F.lit(0))
    start = (_digits(F.col("row.doc_id"), 10, 6) % F.col("size") + 1).cast("int")
    run = F.slice(F.concat(words, words), start, F.col("rest").cast("int"))
    is_part = (F.col("rest") > 0) & (F.col("repeat") * F.col("size") > F.col("taken"))
    text = F.when(is_part, F.array_join(run, " ")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.length(F.col("_text")).cast("long")}
    out = copies.withColumn("_text", text)
    return out.select(
        *(
            (F.col("_text") if c == "text" else changed["n_chars"] if c == "n_chars" else F.col(f"row.`{c}`")).alias(c)
            for c in columns
            if c != "repeat"
        ),
        "repeat",
    )
