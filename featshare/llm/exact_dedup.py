"""Exact dedup by content-defined chunk recipes (built-in functions only).

A text is cut where its own content says so: after ``MIN_CHUNK`` characters a chunk ends at
the first place whose neighbours match ``CUT`` (about one place in a thousand, so that equal
passages fall into equal chunks again soon after a difference), at ``MAX_CHUNK`` at the
latest. Every text is cut once. Chunks
are deduplicated to 64-bit identifiers, and the distinct (identifier, SHA-256 of the chunk)
pairs verify them: an identifier that stands for two different chunks is reported, and
documents that hold it carry their whole text beside the recipe. Documents are then equal when
their ordered identifier lists are; no shuffle carries text, unless an identifier clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

MIN_CHUNK = 512
MAX_CHUNK = 8192
#: white space between chosen letters
CUT = r"(?<=[nst.,]\s)(?=[aeiou][nrst][a-f])"


def chunk_list(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text, in order; their concatenation is the text."""
    cut = rf"(?s).{{{least},{most}}}?(?:{CUT}|\z)|.{{{most}}}|.+"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _identifier(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def clashes(recipes: DataFrame) -> DataFrame:
    """Identifiers (column ``id``) that stand for more than one chunk: empty unless the hash
    collides. Chunks are told apart by their SHA-256, each distinct pair once per task."""
    pairs = recipes.select(F.explode(F.arrays_zip("recipe", "digests")).alias("x"))
    return (pairs.select(F.col("x.recipe").alias("id"), F.col("x.digests").alias("digest")).distinct()
            .groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` (the key), ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256`` and ``n_chunks``. Of texts equal after lower-casing A-Z, the
    row with the largest key stays.

    Null text counts as empty and equals it. Null keys lose against any other key; a group
    of null keys only has a null keep_id and keeps its rows. Rows that repeat key and text
    count in group_size and share one kept flag. Empty input gives no rows. Other columns
    are ignored. ``bits`` shortens identifiers (tests use it to force clashes).
    """
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    ids = F.transform(F.col("__chunks"), lambda c: _identifier(c, bits))
    digests = F.transform(F.col("__chunks"), lambda c: F.unhex(F.sha2(c.cast("binary"), 256)))
    cut = written(
        docs.select(F.col(key).alias("doc_id"), norm.alias("__norm"))
        .select("doc_id", F.sha2(F.col("__norm").cast("binary"), 256).alias("text_sha256"),
                chunk_list(F.col("__norm")).alias("__chunks"))
        .select("doc_id", "text_sha256", ids.alias("recipe"), digests.alias("digests")), "recipes")
    bad = written(clashes(cut), "clashes")
    recipes = cut.drop("digests").withColumn("exact", F.lit(""))
    if not bad.isEmpty():  # the hash collided: those documents are compared by their text too
        held = (recipes.select("text_sha256", F.explode("recipe").alias("id")).join(bad, "id", "left_semi")
                .select("text_sha256").distinct())
        whole = (docs.select(norm.alias("exact"))
                 .select(F.sha2(F.col("exact").cast("binary"), 256).alias("text_sha256"), "exact")
                 .join(held, "text_sha256", "left_semi").distinct())
        recipes = (recipes.drop("exact").join(whole, "text_sha256", "left")
                   .withColumn("exact", F.coalesce("exact", F.lit(""))))
    same = ["recipe", "exact"]
    groups = recipes.groupBy(*same).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return recipes.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns as they are."""
    gone = (exact_dedup(docs, key, text).where("not kept")
            .select(F.col("doc_id").alias("__key"), F.col("text_sha256").alias("__sha")).distinct())
    sha = F.sha2(ascii_lower(F.coalesce(docs[text], F.lit(""))).cast("binary"), 256)
    return docs.join(gone, docs[key].eqNullSafe(gone["__key"]) & (sha == gone["__sha"]), "left_anti")
