"""Page layout: nested shapes laid flat, and tokens of a page joined into lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shape_text(text: Column) -> Column:
    """Paragraph and cell marks become line breaks; no blanks at the ends; null counts as empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\r\\x07]+", "\n"), "\\A\\s+|\\s+\\z", "")


def flat_shapes(shapes: DataFrame) -> DataFrame:
    """(doc, id, page, top, left, depth, text) of all shapes with text, from (doc, id, parent, page, left, top, text).

    A shape's place is relative to its parent (null: the page), at any depth; its page is that of the outermost shape.
    Shapes without text have no row, but those inside them do; a shape whose parent isn't there, or is its own ancestor,
    hangs nowhere and goes. Places are rounded half to even, to hundredths. Order by page, top, left.
    """
    spark = shapes.sparkSession
    rows = shapes.select("doc", "id", "parent", "page", F.col("left").cast("double").alias("left"), F.col("top").cast("double").alias("top"), shape_text(F.col("text")).alias("text"))
    if spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000") == "1000000":
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a level of the tree may have any number of shapes
    tree = spark.sql(
        """WITH RECURSIVE placed AS (
             SELECT doc, id, page, `left`, top, 0 AS depth, text FROM {rows} WHERE parent IS NULL
             UNION ALL
             SELECT /*+ MERGE(s, p) */ s.doc, s.id, p.page, p.`left` + s.`left`, p.top + s.top, p.depth + 1, s.text FROM {rows} s JOIN placed p ON s.doc = p.doc AND s.parent = p.id
           ) SELECT * FROM placed""",
        rows=rows,
    )
    return tree.where("text <> ''").select("doc", "id", "page", F.bround("top", 2).alias("top"), F.bround("left", 2).alias("left"), "depth", "text")


def token_lines(tokens: DataFrame, gap: float = 3.0, column: float | None = None) -> DataFrame:
    """(doc, page, col, line, top, text) of tokens (doc, page, x, y, text): tokens whose heights are chained by gaps of at
    most ``gap`` make a line, read from left to right.

    With ``column`` a page is cut into two columns at that x where no token's x lies within ``gap`` of it and both sides
    have tokens; each column has lines of its own, the left one first. Pages are windows; blank tokens go.
    """
    page = Window.partitionBy("doc", "page")
    solid = tokens.where(F.length(F.btrim(F.col("text"))) > 0)
    if column is None:
        placed = solid.withColumn("col", F.lit(0))
    else:
        cut = (F.min(F.abs(F.col("x") - column)).over(page) > gap) & (F.min("x").over(page) < column) & (F.max("x").over(page) > column)
        placed = solid.withColumn("_cut", cut).withColumn("col", (F.col("_cut") & (F.col("x") > column)).cast("int")).drop("_cut")
    down = Window.partitionBy("doc", "page", "col").orderBy("y", "x", "text")
    opens = F.coalesce(F.col("y") - F.lag("y").over(down) > gap, F.lit(True))
    numbered = placed.withColumn("_new", opens.cast("int")).withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "text"))), lambda t: F.btrim(t["text"]))
    return numbered.groupBy("doc", "page", "col", "line").agg(F.min("y").alias("top"), F.array_join(words, " ").alias("text"))
