"""Mix sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame and SQL functions only.

1. Each source's target in words: a share of the whole by weight, at most CAP times the source's own size, what is over
   shared again by weight (water-filling in one pass over the sources sorted by size over weight).
2. A source's documents are permuted by a hash into blocks of about BLOCK_DOCS documents (at most MAX_BLOCKS blocks a
   source, so no window over blocks grows without bound). Whole passes and a run of permuted blocks reach the target;
   of the block that the target cuts and the blocks after it (CUT_BLOCKS in all), permuted documents are taken as long as
   they fit. So what a source lacks is less than any document that these blocks leave out.
3. Each draw of a block is a unit. The exact unit counts of the sources are split among the output shards by a binary
   tree: at each node the left half gets a multivariate-hypergeometric draw of the node's counts, the right half the
   rest. A shard then takes the next disjoint run of each source's permuted units and orders its rows by a hash (mixed_shards()).

All random numbers come from md5 of the seed and keys, so reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import attach, spare_names, written
from .text import hash60, n_words

#: Fixed values of the mix: weights by rank of the source, share of all words, times a document may be taken.
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2
BLOCK_DOCS, MAX_BLOCKS, CUT_BLOCKS, SHARDS = 64, 65_536, 8, 64

#: One draw from a hypergeometric distribution by inversion: of `pool` units `marked` are marked and `take` are drawn.
#: The terms, each made from the one before, run from 12 standard deviations below the mean to 12 above (over all of a
#: small range); what lies beyond has less mass than a double can tell from 0. Names differ by more than case, which
#: SQL ignores.
_SPAN = "(12 * sqrt(greatest(take * (marked / pool) * (1 - marked / pool) * (pool - take) / greatest(pool - 1, 1), 0)) + 12)"
_TERMS = """aggregate(sequence(least_k, most_k), named_struct('w', 1D, 'z', 0D, 'x', CAST(-1 AS BIGINT)),
  (t, k) -> named_struct(
    'w', t.w * CAST(marked - k AS DOUBLE) * CAST(take - k AS DOUBLE) / (CAST(k + 1 AS DOUBLE) * CAST(pool - marked - take + k + 1 AS DOUBLE)),
    'z', t.z + t.w,
    'x', CASE WHEN t.x < 0 AND t.z + t.w >= {goal} THEN k ELSE t.x END), t -> {out})"""


def _hypergeometric(marked: str, pool: str, take: str, uniform: str) -> str:
    """SQL for one draw; names are bound one after the other through one-element arrays."""
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    total = _TERMS.format(goal="1e308D", out="t.z")
    body = let("goal", f"({uniform}) * {total}", _TERMS.format(goal="goal", out="CASE WHEN t.x < 0 THEN most_k ELSE t.x END"))
    body = let("most_k", f"least(take, marked, CAST(ceil(take * (marked / pool) + {_SPAN}) AS BIGINT))", body)
    body = let("least_k", f"greatest(CAST(0 AS BIGINT), take + marked - pool, CAST(floor(take * (marked / pool) - {_SPAN}) AS BIGINT))", body)
    body = let("pool", pool, let("take", take, let("marked", marked, body)))
    return f"CASE WHEN {pool} <= 0 OR {take} <= 0 OR {marked} <= 0 THEN CAST(0 AS BIGINT) ELSE {body} END"


def _split(seed: int) -> str:
    """SQL for what the left half of a node gets of each source: lo, hi are its shards, q its counts by source."""
    u = f"(CAST(conv(substring(md5(concat_ws('|', {seed}, lo, hi, j)), 1, 13), 16, 10) AS DOUBLE) + 0.5D) / 4503599627370496D"
    draw = _hypergeometric("q[j]", "s.rest", "s.want", u)
    return f"""aggregate(sequence(0, size(q) - 1),
      named_struct('rest', total, 'want', (total * ((hi - lo) DIV 2)) DIV (hi - lo), 'left', CAST(array() AS ARRAY<BIGINT>)),
      (s, j) -> transform(array({draw}), x -> named_struct('rest', s.rest - q[j], 'want', s.want - x, 'left', concat(s.left, array(x))))[0],
      s -> s.left)"""


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: one row with q, an array of counts by source. Rows (shard, q): exact counts for each output shard."""
    tree = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for _ in range((shards - 1).bit_length()):
        tree = tree.withColumn("total", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x))
        tree = tree.withColumn("left", F.expr(f"CASE WHEN hi - lo > 1 THEN {_split(seed)} END"))
        tree = tree.withColumn("mid", F.expr("lo + (hi - lo) DIV 2"))
        tree = tree.selectExpr(
            "explode(CASE WHEN hi - lo > 1 THEN array(named_struct('lo', lo, 'hi', mid, 'q', left), "
            "named_struct('lo', mid, 'hi', hi, 'q', zip_with(q, left, (x, y) -> x - y))) ELSE array(named_struct('lo', lo, 'hi', hi, 'q', q)) END) AS node"
        ).select("node.*")
    return tree.select(F.col("lo").alias("shard"), "q")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: skey, source, docs, source_size, one row a source. Adds rank (by code point, null last), target."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * CAP).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(SHARE) * F.sum("source_size").over(every) - before) / open_weight
    ranked = ranked.withColumn("level", level)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    target = F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))
    return ranked.withColumn("target", target).drop("weight", "most", "ratio", "level")


def _greedy(rows: str, room: str) -> str:
    """SQL: the numbers of the rows that fit, taken in order while there is room."""
    return f"""aggregate({rows}, named_struct('room', {room}, 'ids', CAST(array() AS ARRAY<BIGINT>)),
      (s, x) -> CASE WHEN x.size <= s.room THEN named_struct('room', s.room - x.size, 'ids', concat(s.ids, array(x.uid))) ELSE s END,
      s -> s.ids)"""


def alike() -> Column:
    """A hash of id, source and text; which of them is null counts."""
    return F.xxhash64(*[x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c).cast("string"))])


def plan_mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies, shards, uid.

    size counts words (null text: 0). copies is how often the row is taken (0 to CAP), taken = copies * size, shards
    has the output shard of each copy. A null source is a source of its own, ranked last. Empty texts have size 0 and
    are taken as often as their block. Rows repeated in full are told apart by their place in the input; which of
    them is taken makes no difference. An empty table gives no rows.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), alike().alias("alike"))
    base = base.select("doc_id", "source", "size", key.alias("skey"), hash60(F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("alike"))).alias("h"), "alike", F.monotonically_increasing_id().alias("uid"))
    base = written(base, "mix-sizes")
    sizes = base.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    goals = source_targets(sizes)
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("extra", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    goals = goals.withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long"))
    goals = written(goals.drop("source"), "mix-goals")
    rows = attach(base.drop("source"), goals, "skey", F.xxhash64("uid"))
    rows = written(rows.withColumn("block", F.pmod(F.col("h"), F.col("blocks"))).select("doc_id", "size", "skey", "h", "alike", "uid", "block", "source_size", "target"), "mix-rows")

    blocks = attach(rows.groupBy("skey", "block").agg(F.sum("size").alias("words")), goals, "skey", F.xxhash64("block"))
    blocks = blocks.withColumn("perm", hash60(F.lit(seed), F.col("skey"), F.col("block")))
    run = Window.partitionBy("skey").orderBy("perm", "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("upto", F.sum("words").over(run)).withColumn("room", F.col("extra") - (F.col("upto") - F.col("words")))
    blocks = blocks.withColumn("nth", F.sum((F.col("words") > F.col("room")).cast("long")).over(run))
    left = F.max(F.when(F.col("words") > F.col("room"), F.col("room"))).over(Window.partitionBy("skey"))
    cut = F.coalesce((F.col("words") > F.col("room")) & (F.col("nth") <= CUT_BLOCKS) & (left > 0), F.lit(False))
    blocks = blocks.withColumn("whole", F.col("passes") + (F.col("words") <= F.col("room")).cast("long")).withColumn("cut", cut).withColumn("room", left)
    blocks = written(blocks.select("skey", "block", "perm", "rank", "whole", "cut", "room"), "mix-blocks")

    units = blocks.withColumn("draw", F.explode(_draws()))
    order = Window.partitionBy("skey").orderBy("draw", hash60(F.lit(seed), F.col("perm"), F.col("draw")), "block")
    units = units.select("skey", "block", "draw", "rank", F.row_number().over(order).alias("place"))
    counts = units.groupBy("rank").agg(F.count("*").alias("n"))
    every = goals.select("rank").join(counts, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))
    quotas = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: x["n"]).alias("q"))
    leaves = split_quotas(quotas.where(F.size("q") > 0), shards, seed)
    leaves = written(leaves.select("shard", F.posexplode("q").alias("rank", "n")), "mix-leaves")
    ends = F.sum("n").over(Window.partitionBy("rank").orderBy("shard"))
    places = leaves.withColumn("end", ends).where("n > 0").select("rank", "shard", F.explode(F.expr("sequence(end - n + 1, end)")).alias("place"))
    dealt = units.join(places, ["rank", "place"]).groupBy("skey", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "shard"))), lambda x: x["shard"]).alias("all_shards"))
    decided = blocks.join(dealt, ["skey", "block"], "left")

    cuts = written(blocks.where("cut").select("skey", "block", "perm", "room"), "mix-cuts")
    inside = rows.join(cuts.withColumnRenamed("block", "_block").withColumnRenamed("skey", "_skey"), (F.col("skey") == F.col("_skey")) & (F.col("block") == F.col("_block")))
    picked = inside.groupBy("_skey", "room").agg(F.array_sort(F.collect_list(F.struct("perm", "_block", "h", "doc_id", "size", "uid"))).alias("rows"))
    picked = picked.select(F.explode(F.expr(_greedy("rows", "room"))).alias("uid"), F.lit(1).alias("one"))
    out = rows.join(decided.select("skey", "block", "whole", "all_shards"), ["skey", "block"]).join(picked, "uid", "left")
    out = out.withColumn("copies", (F.col("whole") + F.coalesce("one", F.lit(0))).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.expr("slice(coalesce(all_shards, array()), 1, copies)").alias("shards"), "alike", "uid")


def _draws() -> Column:
    """The draws of a block, 1 to whole plus one if it is cut; none for a block that isn't drawn."""
    n = (F.col("whole") + F.col("cut").cast("long")).cast("int")
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))


def mixed_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows of mixed() in its order, with one more column, _shard (more underscores if docs has that), their output shard.

    Rows and decisions meet by a hash of id, source and text and the row's rank among those alike in it (rows alike in all
    three may be interchanged): both are dealt together by that hash, once, so null ids and repeated ids are spread.
    Ranges of (shard, hash) are then dealt to tasks, so that a large shard is split over several.
    """
    key, size, taken, side, rank, draw, shard = spare_names(docs.columns, "_key", "_size", "_taken", "_side", "_rank", "_draw", "_shard")
    plan = plan_mix(docs, shards, seed).select(F.col("alike").alias(key), F.col("shards").alias(taken), F.col("uid").alias(size), F.lit(1).alias(side))
    rows = docs.withColumns({key: alike(), size: F.monotonically_increasing_id(), side: F.lit(0)})
    # Dealt by the hash alone, which serves both windows: texts move once here.
    both = rows.unionByName(plan, allowMissingColumns=True).repartition(key)
    both = both.withColumn(rank, F.row_number().over(Window.partitionBy(key, side).orderBy(size)))
    both = both.withColumn(taken, F.max(taken).over(Window.partitionBy(key, rank))).where(F.col(side) == 0)
    out = both.select("*", F.posexplode(taken).alias(draw, shard))
    order = hash60(F.lit(seed), F.col("doc_id"), F.col(key), F.col(rank), F.col(draw))
    return out.orderBy(shard, order, key, rank, draw).select(*[F.col(f"`{c}`") for c in docs.columns], shard)


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix itself: each row of docs as often as plan_mix() takes it, in shards, ordered by a hash inside each.

    The columns stay as they are, whatever their names. Rows with a null id, source or text are mixed as any others (a text
    without words as often as its block is drawn); rows alike in every way are each taken; an empty table stays empty.
    """
    return mixed_shards(docs, shards, seed).select(*[F.col(f"`{c}`") for c in docs.columns])
