"""Queries over documents: containers (p8), source mixes (p9), visual forms (p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import looks, mixing, packing
from .tokens import token_sizes


def _sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return token_sizes(read_table(spark, d, "documents").select("doc_id", *columns, "text"), "text")


# ---- p8: containers ------------------------------------------------------------------------------------------------


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "containers").select("container_id", "label", F.col("capacity_tokens").alias("capacity"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = [r["capacity"] for r in _containers(spark, d).select("capacity").distinct().limit(packing.MOST_KINDS + 1).collect()]  # pack() refuses more
    packed = packing.pack(_sizes(spark, d), "doc_id", "tokens", capacities)
    return packed.join(F.broadcast(_containers(spark, d)), "capacity")


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that is larger, for each kind of container."""
    return _packed(spark, d).select("container_id", "grp", "bin", "doc_id", "piece", "pieces", "tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens held and the part of the room that is filled, per kind of container."""
    bins = _packed(spark, d).groupBy("container_id", "label", "capacity", "grp", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    total = bins.groupBy("container_id", "label", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"))
    return total.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the assignments: documents placed, containers too full, documents cut without need or in part."""
    packed = _packed(spark, d)
    full = packed.groupBy("container_id", "capacity", "grp", "bin").agg(F.sum("tokens").alias("tokens")).groupBy("container_id").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("too_full"))
    each = packed.groupBy("container_id", "capacity", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("pieces"))
    whole = each.groupBy("container_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut_without_need"), F.count_if(F.col("n") != F.col("pieces")).alias("in_part")
    )
    return whole.join(F.broadcast(full), "container_id")  # one row a kind of container


# ---- p9: mixes -----------------------------------------------------------------------------------------------------


def _targets(spark: SparkSession, d: str) -> list[mixing.Target]:
    rows = read_table(spark, d, "mix_targets").limit(mixing.MOST_SOURCES + 1).collect()  # mix() refuses more
    return [mixing.Target(r["source"], r["target_share"], r["max_repeats"]) for r in sorted(rows, key=lambda r: r["source"])]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix in the order they are to be read."""
    return mixing.mix(_sizes(spark, d, "source"), "doc_id", "source", "tokens", _targets(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return mixing.shares(p9_mix(spark, d), "tokens", _targets(spark, d))


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix: no document used more often than it may, none twice in a pass, none of another source."""
    limits = spark.createDataFrame([(t.source, t.max_repeats) for t in _targets(spark, d)], "source string, max_repeats int")
    used = p9_mix(spark, d).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pass").alias("passes"))
    own = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("own"))
    met = used.join(own, "doc_id").join(F.broadcast(limits), "source", "right")  # one row a target
    return met.groupBy("source").agg(F.expr("count_if(n > max_repeats) AS too_often"), F.expr("count_if(n <> passes) AS twice_in_a_pass"), F.expr("count_if(own <> source) AS of_another"))


# ---- p10: visual forms ---------------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts differ as stored but look the same."""
    pairs = looks.lookalikes(read_table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form."""
    return looks.normalize(read_table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "form")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of texts that look the same."""
    return looks.classes(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"p8_assignments": p8_assignments, "p8_fill": p8_fill, "p8_sound": p8_sound, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_sound": p9_sound, "p10_found": p10_found, "p10_forms": p10_forms, "p10_classes": p10_classes}

_FORMS = f"SELECT doc_id, text, {looks.form_sql('text')} AS form FROM documents"
SQL = {
    "p8_sound": """SELECT container_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS documents, 0 AS too_full, 0 AS cut_without_need, 0 AS in_part FROM containers""",
    "p9_sound": "SELECT source, 0 AS too_often, 0 AS twice_in_a_pass, 0 AS of_another FROM mix_targets",
    "p10_found": f"""WITH forms AS MATERIALIZED ({_FORMS} WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p10_classes": f"""WITH forms AS MATERIALIZED ({_FORMS} WHERE text IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, min(doc_id) OVER (PARTITION BY form, text) AS variant_id, n AS variants
        FROM forms JOIN (SELECT form, count(DISTINCT text) AS n FROM forms GROUP BY form) USING (form)""",
    "p10_forms": f"SELECT doc_id, form FROM ({_FORMS})",
}
