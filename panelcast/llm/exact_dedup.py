"""Exact deduplication by content-defined chunk recipes.

A text is cut where its content says so (after sentence marks, within a least and
a largest length), each distinct chunk gets a verified identifier, and two texts
are equal exactly when their ordered identifier lists are.  Only chunks cross the
network with their characters, and only once; whole documents never do.

Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_sized

BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def chunks(norm: Column, least: int = 512, most: int = 4096) -> Column:
    """Content-defined chunks: end after ``.``, ``!`` or ``?`` once ``least`` characters are in, at ``most`` at the latest."""
    return F.regexp_extract_all(norm, F.lit(f"(?s).{{{least},{most}}}?[.!?]|.{{1,{most}}}"), F.lit(0))


def verified_exceptions(cut_up: DataFrame) -> DataFrame:
    """Chunk texts that share their 64-bit digest with another chunk text, numbered.

    ``cut_up`` has ``chunks``.  Returns ``(digest, chunk, nth)``; every digest that is
    not listed stands for one text only, which is what makes it a verified identifier.
    The texts meet once, to be told apart; after that only digests are counted, and
    texts are fetched again for clashing digests alone.
    """
    each = cut_up.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("digest"), "chunk")
    clashing = cut(each.distinct().groupBy("digest").count().where("count > 1").select("digest"), "chunk-clashes")
    if clashing.isEmpty():
        return clashing.select("digest", F.lit("").alias("chunk"), F.lit(0).alias("nth"))
    texts = each.join(clashing, "digest", "left_semi").groupBy("digest").agg(F.collect_set("chunk").alias("texts"))
    return cut(texts.select("digest", F.posexplode(F.array_sort("texts")).alias("nth", "chunk")), "chunk-clash-texts")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ASCII white space.  Of equal texts the
    row with the most code points in its original text stays, then the smallest id.
    Null and empty texts are one group.  Rows with a null id form groups like any
    other row (a null id sorts last).  Repeated rows with one id each give a row and
    count in ``group_size``; ``kept`` is true for rows whose id is ``keep_id``.  An
    empty table gives an empty result.  Columns besides id and text are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    norm = base.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
        normalised(F.col("text")).alias("norm"),
    )
    odd = verified_exceptions(norm.select(chunks(F.col("norm")).alias("chunks")))

    recipes = norm.select(
        "doc_id",
        "n_chars",
        F.sha2("norm", 256).alias("text_sha256"),
        chunks(F.col("norm")).alias("chunks"),
    )
    if odd.isEmpty():
        ident = F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("digest"), F.lit(0).alias("nth")))
        listed = recipes.select("doc_id", "n_chars", "text_sha256", ident.alias("recipe"))
    else:
        listed = _with_exceptions(recipes, odd)

    listed = cut(listed, "chunk-recipes")  # digests only: texts are read once more at most
    # the longest original text first, then the smallest id, null last
    order = F.struct(
        (-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")
    )
    groups = (
        listed.select("recipe", order.alias("o"))
        .groupBy("recipe")
        .agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("recipe", F.col("o.i").alias("keep_id"), "group_size")
    )
    groups = cut(groups, "copy-groups")
    joined = join_sized(listed, groups, ["recipe"], "group_size", F.monotonically_increasing_id(), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .alias("kept"),
        "text_sha256",
    )


def _with_exceptions(recipes: DataFrame, odd: DataFrame) -> DataFrame:
    """Recipes where the listed chunk texts carry their number beside the digest."""
    rows = recipes.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "text_sha256", "chunks"
    )
    rows = cut(rows, "chunked-texts")
    each = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).select(
        "row", "at", F.xxhash64("chunk").alias("digest"), "chunk"
    )
    hit = each.join(odd, ["digest", "chunk"]).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "nth"))).alias("nths")
    )
    ident = F.transform(
        "chunks",
        lambda c, i: F.struct(
            F.xxhash64(c).alias("digest"), F.coalesce(F.element_at("nths", i), F.lit(0)).alias("nth")
        ),
    )
    return rows.join(hit, "row", "left").select("doc_id", "n_chars", "text_sha256", ident.alias("recipe"))
