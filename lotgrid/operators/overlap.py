"""Overlapping boxes: pairs by grid cells, greedy removal of duplicates over tile seams, greedy matching to truth.

Boxes are rows with site, ord (their order within the site, without ties), tile and corners x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CORNERS, iou

CELL = 32
#: Contested boxes of a site up to which it is resolved by one fold over an array; larger sites go round by round.
FOLD_ROWS = 20_000


def _celled(boxes: DataFrame, keys: list[str], prefix: str, carry: list[str], cell: int) -> DataFrame:
    """A row for each grid cell that a box touches, columns named with the prefix."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cells = boxes.withColumn("_gx", F.explode(span("x0", "x1"))).withColumn("_gy", F.explode(span("y0", "y1")))
    return cells.select(*keys, "_gx", "_gy", *[F.col(c).alias(prefix + c) for c in (*carry, *CORNERS)])


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], carry_left: list[str], carry_right: list[str], threshold: float, extra: Column | None = None, cell: int = CELL) -> DataFrame:
    """Pairs (a_*, b_*) with equal keys, IoU >= threshold and `extra`, with column iou.

    An equi-join on keys and grid cell. Boxes that share several cells meet in the one that holds the upper left corner
    of their intersection, so no distinct is needed.
    """
    a, b = _celled(left, keys, "a_", carry_left, cell), _celled(right, keys, "b_", carry_right, cell)
    here = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("_gx")) & (F.floor(F.greatest("a_y0", "b_y0") / cell) == F.col("_gy"))
    met = a.join(b, [*keys, "_gx", "_gy"]).where(here if extra is None else here & extra)
    return met.withColumn("iou", iou("a_", "b_")).where(F.col("iou") >= threshold).drop("_gx", "_gy")


def earlier_overlaps(boxes: DataFrame, threshold: float = 0.5, same_tile: bool = False) -> DataFrame:
    """site, ord and nb, the earlier boxes that it overlaps (of other tiles, unless same_tile). Only boxes that have some."""
    order = F.col("b_ord") < F.col("a_ord")
    extra = order if same_tile else order & (F.col("a_tile") != F.col("b_tile"))
    pairs = overlap_pairs(boxes, boxes, ["site"], ["ord", "tile"], ["ord", "tile"], threshold, extra)
    return pairs.groupBy("site", F.col("a_ord").alias("ord")).agg(F.array_sort(F.collect_list("b_ord")).alias("nb"))


def greedy_dropped(contested: DataFrame) -> DataFrame:
    """site, ord of the boxes that overlap an earlier box that itself stays: a fold in order over the contested boxes.

    A box that has no earlier neighbour stays, so it never enters; dropped numbers are carried, as a box is dropped if
    some earlier neighbour isn't among them.
    """
    folded = contested.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "nb"))).alias("xs"))
    dropped = F.expr("aggregate(xs, transform(filter(xs, x -> false), x -> x.ord), (d, x) -> IF(size(array_except(x.nb, d)) > 0, concat(d, array(x.ord)), d))")
    return folded.select("site", F.explode(dropped).alias("ord"))


def greedy_dropped_by_rounds(contested: DataFrame) -> DataFrame:
    """The same without holding a site in one row: boxes are decided once all their earlier neighbours are."""
    edges = contested.select("site", "ord", F.explode("nb").alias("before")).checkpoint()
    state = contested.select("site", "ord", F.lit(None).cast("boolean").alias("gone")).checkpoint()
    while state.where("gone IS NULL").limit(1).count():
        earlier = state.select("site", F.col("ord").alias("before"), "gone", F.lit(True).alias("entered"))
        seen = edges.join(earlier, ["site", "before"], "left")
        stays = F.when(F.col("entered").isNull(), True).otherwise(~F.col("gone"))
        now = seen.groupBy("site", "ord").agg(F.bool_or(stays).alias("hit"), F.bool_or(F.col("entered").isNotNull() & F.col("gone").isNull()).alias("open"))
        fresh = F.when(F.col("hit"), True).when(~F.col("open"), False)
        state = state.join(now, ["site", "ord"]).select("site", "ord", F.coalesce("gone", fresh).alias("gone")).checkpoint()
    return state.where("gone").select("site", "ord")


def seam_duplicates(boxes: DataFrame, threshold: float = 0.5, same_tile: bool = False, by_rounds: bool = False) -> DataFrame:
    """boxes with kept: false for one that overlaps an earlier kept box of another tile (any tile with same_tile).

    by_rounds resolves sites of any size without folding them in one row; it needs a checkpoint folder.
    """
    contested = earlier_overlaps(boxes, threshold, same_tile)
    gone = (greedy_dropped_by_rounds if by_rounds else greedy_dropped)(contested).withColumn("gone", F.lit(True))
    return boxes.join(gone, ["site", "ord"], "left").withColumn("kept", F.col("gone").isNull()).drop("gone")


def unique_counts(boxes: DataFrame, threshold: float = 0.5, same_tile: bool = False) -> DataFrame:
    """By site: truth_sum (all boxes), uniques and dups. Only sites with contested boxes are folded; no box is joined back."""
    gone = greedy_dropped(earlier_overlaps(boxes, threshold, same_tile)).groupBy("site").agg(F.count("*").alias("dups"))
    every = boxes.groupBy("site").agg(F.count("*").alias("truth_sum"))
    out = every.join(gone, "site", "left").withColumn("dups", F.coalesce("dups", F.lit(0).cast("long")))
    return out.withColumn("uniques", F.col("truth_sum") - F.col("dups")).select("site", "truth_sum", "dups", "uniques")


def greedy_match(preds: DataFrame, truth: DataFrame, keys: list[str], order: list[Column], threshold: float = 0.5) -> DataFrame:
    """preds with is_tp and gt: each in `order` takes the unused truth box of its key that it overlaps most.

    preds: keys, det (number within the key), corners; truth: keys, gt, corners. Of equal IoU the later truth box wins.
    Only predictions that overlap some truth box enter the fold.
    """
    pairs = overlap_pairs(preds, truth, keys, ["det"], ["gt"], threshold)
    wants = pairs.groupBy(*keys, F.col("a_det").alias("det")).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("i"), (-F.col("b_gt")).alias("g")))).alias("c"))
    ranked = preds.join(wants, [*keys, "det"]).select(*keys, F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.col("det").alias("det"), F.expr("transform(c, x -> -x.g)").alias("g")).alias("p"))
    lists = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    fold = """aggregate(ps, named_struct('used', transform(filter(ps, p -> false), p -> p.g[0]), 'out', transform(filter(ps, p -> false), p -> named_struct('det', p.det, 'gt', p.g[0]))),
      (s, p) -> CASE WHEN size(array_except(p.g, s.used)) > 0
        THEN named_struct('used', concat(s.used, array(array_except(p.g, s.used)[0])), 'out', concat(s.out, array(named_struct('det', p.det, 'gt', array_except(p.g, s.used)[0])))) ELSE s END, s -> s.out)"""
    hits = lists.select(*keys, F.explode(F.expr(fold)).alias("m")).select(*keys, "m.det", "m.gt")
    return preds.join(hits, [*keys, "det"], "left").withColumn("is_tp", F.col("gt").isNotNull().cast("int"))
