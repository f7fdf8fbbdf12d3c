"""Connected components of models that share dependencies (A8, consolidated shares)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featshare.session import materialize


def model_components(models: DataFrame, deps: DataFrame) -> DataFrame:
    """(model_name, component): models linked by shared dependencies, directly or through
    others, carry one component, the smallest model name among them; a model without a
    dependency is its own.

    Every user of a dependency is linked to the smallest one. Then, round by round, every model
    with a smaller neighbour joins the smallest of them, pointers are followed to their ends by
    doubling, and the links are carried over to the models that are left: at least half of the
    linked ones are gone after two rounds, and links inside a joined group go with them, so the
    rounds shrink and all of them together cost a small multiple of the first. The joins hold one
    row per dependency or model on one side, so a dependency that a third of all models use is
    split by the skew-join rule. Rounds are written to the shared folder; one emptiness test per
    round or doubling reaches the driver.
    """
    return _components(*_graph(models, deps))


def _graph(models: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct models, and their distinct (model, dependency) pairs; each evaluated once."""
    nodes = materialize(models.select("model_name").distinct(), "component-models")
    edges = deps.where("dep_name is not null").select(
        "model_name", F.struct("dep_type", "dep_name").alias("dep")).distinct()
    return nodes, materialize(edges.join(nodes, "model_name", "left_semi"), "component-edges")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    # written, because only a join of two plain shuffles is split when one key is hot
    of_dep = materialize(edges.groupBy("dep").agg(F.min("model_name").alias("low")), "dep-labels")
    links = materialize(edges.join(of_dep, "dep").where("model_name > low").select(
        F.col("model_name").alias("high"), "low"), "links")
    labels = nodes.withColumn("component", F.col("model_name"))
    while not links.isEmpty():
        ends = _ends(materialize(links.groupBy("high").agg(F.min("low").alias("low")), "pointers"))
        labels = _follow(labels, "component", ends)
        carried = _follow(_follow(links, "high", ends), "low", ends).where("high <> low")
        links = materialize(carried.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low"))
                            .distinct(), "links")
    return labels


def _follow(rows: DataFrame, col: str, pointers: DataFrame) -> DataFrame:
    """``rows`` with ``col`` replaced by the model it points to, if it points to one."""
    p = pointers.select(F.col("high").alias(col), F.col("low").alias("_to"))
    return rows.join(p, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")


def _ends(pointers: DataFrame) -> DataFrame:
    """Pointers (high to low, one per model) followed to the models that point nowhere."""
    while True:
        p = pointers.select(F.col("high").alias("low"), F.col("low").alias("_to"))
        further = materialize(pointers.join(p, "low", "left").select(
            "high", F.coalesce("_to", "low").alias("low"), F.col("_to").isNotNull().alias("moved")), "pointers")
        pointers = further.select("high", "low")
        if further.where("moved").isEmpty():
            return pointers


def consolidated_share(models: DataFrame, deps: DataFrame) -> DataFrame:
    """One consolidated, deduplicated share per component: (component, object_type,
    object_name, n_models), the models themselves and every dependency of theirs once, with
    the number of the component's models that need it."""
    nodes, edges = _graph(models, deps)
    labels = materialize(_components(nodes, edges), "labels")
    own = labels.select("component", F.lit("MODEL").alias("object_type"), F.col("model_name").alias("object_name"))
    used = edges.join(labels, "model_name").select(
        "component", F.col("dep.dep_type").alias("object_type"), F.col("dep.dep_name").alias("object_name"))
    return own.unionByName(used).groupBy("component", "object_type", "object_name").agg(
        F.count(F.lit(1)).alias("n_models"))
