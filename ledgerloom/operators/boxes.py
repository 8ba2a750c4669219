"""Boxes of two detections matched one to one by their overlap.

Candidates meet on a grid that follows the size of boxes. Two boxes whose intersection is at least ``least`` (0.5 or more) of their union
are at most twice as wide or high as each other, so their sizes' powers of two differ by one at most, and their centres lie closer than half the
larger side, so they are in the same or in adjoining cells of a grid of the larger power's sides.

Matching is greedy by overlap: of all pairs of a document the one with the largest overlap first (then the earlier first box,
then the earlier second one). A pair that is the best of both its boxes is taken by that order whatever else happens, so
each round takes all of these in all documents at once and drops their boxes' other pairs; rounds follow chains of ever better pairs.

Grid and rounds are for documents with many boxes. Where all pairs are few (``PAIRS``), boxes meet by their document alone and its
pairs are folded in their order inside one row, so nothing is copied over cells or written between rounds.

Boxes with nulls, without area or without end take no part; ids are unique in a document and a detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fuzzy import Tables

SIDES = ["x1", "y1", "x2", "y2"]
PAIRS = 4096  # boxes of one detection times those of the other, up to which a document is one row's work


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with area."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    return both / (area(a) + area(b) - both)


def sound(df: DataFrame) -> DataFrame:
    """Boxes with area and end."""
    return df.select("doc", "id", *[F.col(c).cast("double").alias(c) for c in SIDES]).where("x2 > x1 and y2 > y1 and x2 - x1 < double('infinity') and y2 - y1 < double('infinity')")


def candidates(first: DataFrame, second: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc, p, t, iou): pairs of boxes ``(doc, id, x1, y1, x2, y2)`` of a document with at least this overlap, each once."""
    if not 0.5 <= least <= 1:
        raise ValueError("cells are complete from 0.5 on")
    power = lambda c: F.floor(F.log2(c)).cast("int")
    cell = lambda middle, p: F.floor(middle / F.pow(F.lit(2.0), p)).cast("long")
    span = lambda df, a, b, low, high: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda d: power(F.col(b) - F.col(a)) + d)

    def keyed(df: DataFrame, name: str, spread: int) -> DataFrame:
        """A box under its own powers and the next ones; ``spread`` also under the cells around, which the other side leaves out."""
        near = F.sequence(F.lit(-spread), F.lit(spread))
        d = df.withColumn("px", F.explode(span(df, "x1", "x2", 0, 1))).withColumn("py", F.explode(span(df, "y1", "y2", 0, 1)))
        d = d.withColumn("gx", F.explode(F.transform(near, lambda k: cell((F.col("x1") + F.col("x2")) / 2, F.col("px")) + k))).withColumn("gy", F.explode(F.transform(near, lambda k: cell((F.col("y1") + F.col("y2")) / 2, F.col("py")) + k)))
        return d.select("doc", "px", "py", "gx", "gy", F.struct("id", *SIDES).alias(name))

    met = keyed(sound(first), "a", 0).join(keyed(sound(second), "b", 1), ["doc", "px", "py", "gx", "gy"])
    # of the powers both are under, the larger one's own counts
    own = lambda side, p: F.col(p) == F.greatest(power(F.col(f"a.{side}2") - F.col(f"a.{side}1")), power(F.col(f"b.{side}2") - F.col(f"b.{side}1")))
    fields = lambda s: {c: F.col(f"{s}.{c}") for c in SIDES}
    pairs = met.where(own("x", "px") & own("y", "py")).select("doc", F.col("a.id").alias("p"), F.col("b.id").alias("t"), overlap(fields("a"), fields("b")).alias("iou"))
    return pairs.where(F.col("iou") >= least)


def matched_rows(first: DataFrame, second: DataFrame, least: float = 0.5) -> DataFrame:
    """The matching of documents with few boxes: all pairs of a document folded, the largest overlap first."""
    side = lambda df, name: sound(df).select("doc", F.struct("id", *SIDES).alias(name))
    fields = lambda s: {c: F.col(f"{s}.{c}") for c in SIDES}
    pairs = side(first, "a").join(side(second, "b").hint("merge"), "doc").select("doc", F.col("a.id").alias("p"), F.col("b.id").alias("t"), overlap(fields("a"), fields("b")).alias("iou")).where(F.col("iou") >= least)
    ranked = pairs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("less"), "p", "t"))).alias("x"))
    clash = lambda taken, x: F.exists(taken, lambda y: (y["p"] == x["p"]) | (y["t"] == x["t"]))
    taken = F.aggregate("x", F.slice("x", 1, 0), lambda m, x: F.when(clash(m, x), m).otherwise(F.array_append(m, x)))
    return ranked.select("doc", F.explode(taken).alias("x")).select("doc", "x.p", "x.t", (-F.col("x.less")).alias("iou"))


def matched(first: DataFrame, second: DataFrame, least: float = 0.5, pairs: int = PAIRS) -> DataFrame:
    """(doc, p, t, iou): the greedy one-to-one matching of two detections; documents of more than ``pairs`` pairs go by grid and rounds."""
    counted = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    large = counted(first, "a").join(counted(second, "b").hint("merge"), "doc").where(F.col("a") * F.col("b") > pairs).select("doc")
    large = Tables(first.sparkSession).write(large)
    if large.isEmpty():
        return matched_rows(first, second, least)
    few = lambda df: df.join(large, "doc", "left_anti")
    many = lambda df: df.join(large, "doc", "left_semi")
    return matched_rows(few(first), few(second), least).unionByName(matched_rounds(many(first), many(second), least))


def matched_rounds(first: DataFrame, second: DataFrame, least: float = 0.5) -> DataFrame:
    """The matching of documents with many boxes, in rounds."""
    tables = Tables(first.sparkSession)
    left, taken = tables.write(candidates(first, second, least)), []
    best = F.max(F.struct("iou", (-F.col("p")).alias("p"), (-F.col("t")).alias("t")))
    while not left.isEmpty():
        of = lambda side: left.groupBy("doc", side).agg(best.alias("b")).select("doc", (-F.col("b.p")).alias("p"), (-F.col("b.t")).alias("t"), F.col("b.iou").alias("iou"))  # noqa: B023, E731
        now = tables.write(of("p").join(of("t").select("doc", "p", "t"), ["doc", "p", "t"]))
        taken.append(now)
        left = tables.write(left.join(now.select("doc", "p"), ["doc", "p"], "left_anti").join(now.select("doc", "t"), ["doc", "t"], "left_anti"))
    out = left.select("doc", "p", "t", "iou")
    for t in taken:
        out = out.unionByName(t)
    return out
