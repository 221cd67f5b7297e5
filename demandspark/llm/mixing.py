"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of up to ``BLOCK`` words. Each source owes the mix an exact number of
words: whole passes over its blocks, and a part of one more pass over them in the order of a hash, the
last block cut to the word. That fixes the quota of draws of every source. A binary tree then deals the
quotas to output shards: at each node the draws of the left half are a multivariate-hypergeometric
sample of the node's, drawn source by source by inverse transform from hashed uniform numbers, so every
source is spread over the shards as a random shuffle of all draws would spread it, while no shuffle of
all draws is needed. Every shard takes its own disjoint run of each source's permuted draws and orders
its draws by another hash.

Places in the permuted order come from sums over hash ranges (in two levels), so a source with a third of
all rows is spread over as many tasks as its blocks need. A block is taken because its place lies in some
shard's run: draws are the join of places and runs. Only sizes, never texts, are shuffled to plan the mix.
All of it is DataFrame and SQL functions.

Defined cases: a null text has no word; a null source is a source of its own, last in order. Equal rows
(same id, source and text) are drawn from separately. Documents without words take part with ``taken``
0. If there is no word at all, all targets are 0; empty tables give empty results. Further columns are
ignored while planning and carried through by :func:`mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.tables import SPACES, stored

BLOCK = 256
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Blocks of one hash range, and draws of one output shard, on average at most.
RANGE_BLOCKS, SHARD_DRAWS = 512, 65536
#: Places of the permuted order that share a join key; ranges in a group (as bits).
STRETCH, GROUP_BITS = 4096, 12
SEED = 20_240_501
KEY = ["doc_id", "source", "size", "mark"]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per distinct document: ``doc_id, source, size, mark`` (hash of the text) and ``copies``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("mark"),
    )
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, number`` (its place from 0), ``source_size`` and ``target`` in words.

    Sources fill in proportion to their weights up to ``most`` times their size: those that stop early
    (least room for their weight) come first, and the level of the rest follows from what is left.
    """
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)) + 1)
    rows = sums.select("source", "source_size", place.alias("number"), weight.cast("double").alias("weight"))
    room = (F.lit(most) * F.col("source_size")).cast("double")
    everything = Window.partitionBy()
    earlier = Window.orderBy(room / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        room.alias("room"),
        F.row_number().over(Window.orderBy(room / F.col("weight"), "number")).alias("turn"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(room).over(earlier), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))).alias("sharing"),
    )
    level = F.col("left") / F.col("sharing")
    stops = F.col("room") <= level * F.col("weight")
    first = F.min(F.when(~stops, F.struct("turn", level.alias("level")))).over(everything)
    rows = rows.select("*", stops.alias("stops"), first["level"].alias("level"))
    target = F.when(F.col("stops"), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    return rows.select("source", "number", "source_size", target.alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, marked: Column, taken: Column, u: Column) -> Column:
    """How many marked ones are among ``taken`` of ``total``, by inverse transform of ``u``.

    Probabilities follow from their ratios, outward from the mode to 9 standard deviations.
    """
    mode = F.floor((taken + 1).cast("double") * (marked + 1) / (total + 2)).cast("long")
    share = marked.cast("double") / F.greatest(total, F.lit(1))
    given = F.struct(
        total.cast("double").alias("total"), marked.cast("double").alias("marked"), taken.cast("double").alias("taken"), u.alias("u"),
        F.greatest(F.lit(0).cast("long"), taken + marked - total).alias("low"), F.least(taken, marked).alias("high"),
        mode.alias("mode"), F.ceil(F.sqrt(taken * share * (1 - share)) * 9 + 10).cast("long").alias("reach"),
    )

    def ratio(g: Column, k: Column) -> Column:  # probability of k + 1 over that of k
        return (g["marked"] - k) * (g["taken"] - k) / ((k + 1) * (g["total"] - g["marked"] - g["taken"] + k + 1))

    def ranges(g: Column) -> Column:
        mode = F.least(F.greatest(g["mode"], g["low"]), g["high"])
        ups = F.sequence(mode, F.least(g["high"], mode + g["reach"]))
        downs = F.sequence(mode, F.greatest(g["low"], mode - g["reach"]), F.lit(-1).cast("long"))
        return F.struct(mode.alias("mode"), ups.alias("ups"), F.slice(downs, 2, F.size(downs)).alias("downs"))

    def walk(g: Column, r: Column, start: Column, goal: Column) -> Column:
        """Adds up weights relative to the mode's, upward and then downward; ``at`` is where ``goal`` is reached."""
        state = lambda w, mass, at: F.struct(w.alias("w"), mass.alias("sum"), at.alias("at"))

        def merge(step):
            def one(a: Column, k: Column) -> Column:
                return let(step(a, k.cast("double")), lambda w: state(
                    w, a["sum"] + w, F.when((a["at"] < 0) & (a["sum"] + w >= goal), k).otherwise(a["at"])))

            return one

        up = merge(lambda a, k: F.when(k == r["mode"], F.lit(1.0)).otherwise(a["w"] * ratio(g, k - 1)))
        down = merge(lambda a, k: a["w"] / ratio(g, k))
        risen = F.aggregate(r["ups"], state(F.lit(1.0), start, F.lit(-1).cast("long")), up)
        return let(risen, lambda a: F.aggregate(r["downs"], state(F.lit(1.0), a["sum"], a["at"]), down))

    def drawn(g: Column) -> Column:
        zero, never = F.lit(0.0), F.lit(float("inf"))
        return let(ranges(g), lambda r: let(
            walk(g, r, zero, never)["sum"], lambda mass: let(
                walk(g, r, zero, g["u"] * mass)["at"], lambda at: F.when(at < 0, r["mode"]).otherwise(at))))

    return let(given, drawn)


def split_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """``shard, counts``: how many draws of each source (in the order of ``number``) every shard gets.

    ``quotas`` has ``number, quota``. ``shards`` is a power of two; their sizes differ by one at most.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda s: s["quota"])
    nodes = quotas.agg(listed.alias("counts"), F.coalesce(F.sum("quota"), F.lit(0)).alias("all")).select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), "counts", "all"
    )
    for _ in range(int(math.log2(shards))):
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        bound = lambda k: F.floor(F.col("all") * k / F.lit(shards)).cast("long")
        capacity = bound(middle) - bound(F.col("low"))
        start = F.struct(
            F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
            capacity.alias("room"),
            F.array().cast("array<bigint>").alias("out"),
        )

        def merge(a: Column, marked: Column) -> Column:
            u = uniform(F.col("low"), F.col("high"), F.size(a["out"]))
            return let(hypergeometric(a["total"], marked, a["room"], u), lambda drawn: F.struct(
                (a["total"] - marked).alias("total"), (a["room"] - drawn).alias("room"),
                F.concat(a["out"], F.array(drawn)).alias("out")))

        nodes = nodes.withColumn("left", F.aggregate("counts", start, merge)["out"]).withColumn("middle", middle)
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        nodes = nodes.select("all", F.inline(F.array(
            F.struct("low", F.col("middle").alias("high"), F.col("left").alias("counts")),
            F.struct(F.col("middle").alias("low"), "high", right.alias("counts")))))
    return nodes.select(F.col("low").alias("shard"), "counts")


def draws(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, shards: int | None = None) -> DataFrame:
    """Every draw of a block: the document (``KEY`` and ``copy``), ``source_size, target``, ``block``,
    ``pass``, ``words`` taken from its start, ``shard`` and ``turn`` (the order within the shard).
    Documents of which nothing is drawn keep one row with ``pass`` null and 0 words."""
    sizes = stored(sizes, "sizes")
    plan = stored(targets(sizes, weights, most), "targets")
    words, largest = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("source_size"), F.lit(0))).first()
    count = sizes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    blocks_most = words // BLOCK + count
    bits = max(1, math.ceil(math.log2(1 + blocks_most / RANGE_BLOCKS)))
    shards = shards or 1 << max(3, math.ceil(math.log2(1 + blocks_most / SHARD_DRAWS)))

    owed = plan.select(
        F.col("source").alias("of"), "number", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long").alias("passes"),
    ).withColumn("rest", (F.round("target") - F.col("passes") * F.col("source_size")).cast("long"))
    rows = sizes.join(owed, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    blocks = rows.withColumn("block", F.explode_outer(F.expr(f"IF(size > 0, sequence(0, CAST((size - 1) DIV {BLOCK} AS int)), null)")))
    held = F.when(F.col("block").isNull(), 0).otherwise(F.least(F.lit(BLOCK), F.col("size") - BLOCK * F.col("block")))
    mixed_up = F.xxhash64(F.lit(SEED), *KEY, "copy", "block")
    blocks = blocks.select("*", held.alias("held"), mixed_up.alias("h"))
    blocks = blocks.withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    full = F.col("block").isNotNull()
    sums = blocks.groupBy("number", "range").agg(F.sum("held").alias("range_words"), F.count(F.when(full, 1)).alias("range_blocks"))
    sums = before_ranges(stored(sums, "ranges"))
    inside = Window.partitionBy("number", "range").orderBy("h", *KEY, "copy", "block")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "*", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("words_here"),
        F.coalesce(F.count(F.when(full, 1)).over(earlier), F.lit(0)).alias("blocks_here"),
    )
    blocks = blocks.join(sums, ["number", "range"])
    part = F.col("rest") - F.col("words_before") - F.col("words_here")
    blocks = blocks.withColumn("part", F.greatest(F.lit(0), F.least("held", part)))
    blocks = blocks.withColumn("place", F.col("blocks_before") + F.col("blocks_here"))
    blocks = stored(blocks.drop("range", "words_before", "words_here", "blocks_before", "blocks_here", "rest", "h"), "blocks")

    taken = F.when(F.col("block").isNull(), 0).otherwise(F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0))
    quotas = blocks.groupBy("number").agg(F.sum(taken).alias("quota"), F.max("source_blocks").alias("source_blocks"))
    quotas = plan.select("number").join(quotas, "number", "left").select(
        "number", F.coalesce("quota", F.lit(0).cast("long")).alias("quota"), F.coalesce("source_blocks", F.lit(0).cast("long")).alias("source_blocks")
    )
    quotas = stored(quotas, "quotas")
    runs = shard_runs(quotas, shards)
    # every place of the permuted order, pass by pass, that a shard's run can reach
    reach = blocks.where(full).join(quotas.select("number", "quota"), "number")
    turn = F.col("pass") * F.col("source_blocks") + F.col("place")
    reach = reach.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes"))).withColumn("at", turn)
    reach = reach.withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("long"))
    met = (reach["number"] == runs["of"]) & (reach["stretch"] == runs["part_of"]) & (reach["at"] >= runs["start"]) & (reach["at"] < runs["end"])
    drawn = reach.join(runs, met).select(
        *KEY, "copy", "source_size", "target", "block", "pass",
        F.when(F.col("pass") < F.col("passes"), F.col("held")).otherwise(F.col("part")).alias("words"),
        "shard", F.xxhash64(F.lit(SEED + 1), "number", "at").alias("turn"),
    )
    none = F.lit(None)
    rest = blocks.where(~F.coalesce(full, F.lit(False)) | (taken == 0)).select(
        *KEY, "copy", "source_size", "target", "block", none.cast("long").alias("pass"), F.lit(0).cast("long").alias("words"),
        none.cast("int").alias("shard"), none.cast("long").alias("turn"),
    )
    return drawn.unionByName(rest)


def before_ranges(sums: DataFrame) -> DataFrame:
    """Words and blocks of a source before each of its hash ranges, in two levels: no task sorts all
    ranges of a source, only groups of ranges and the ranges of one group."""
    group = F.shiftright("range", GROUP_BITS).alias("group")
    totals = sums.groupBy("number", group).agg(F.sum("range_words").alias("w"), F.sum("range_blocks").alias("b"))
    earlier = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = totals.select(
        "number", "group", zero("w", earlier).alias("w_before"), zero("b", earlier).alias("b_before"),
        F.sum("b").over(Window.partitionBy("number")).alias("source_blocks"),
    )
    inner = Window.partitionBy("number", "group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("group", group).select("*", zero("range_words", inner).alias("w_here"), zero("range_blocks", inner).alias("b_here"))
    return placed.join(totals, ["number", "group"]).select(
        "number", "range", (F.col("w_before") + F.col("w_here")).alias("words_before"), (F.col("b_before") + F.col("b_here")).alias("blocks_before"), "source_blocks"
    )


def shard_runs(quotas: DataFrame, shards: int) -> DataFrame:
    """What the tree deals: for each shard and source its run ``start`` to ``end`` (excluded) of the source's
    permuted draws, once for every stretch of ``STRETCH`` places that it meets, as a key for joins."""
    dealt = split_tree(quotas.select("number", "quota"), shards).select("shard", F.posexplode("counts").alias("number", "n"))
    end = F.sum("n").over(Window.partitionBy("number").orderBy("shard"))  # a row a shard
    runs = dealt.select("number", "shard", "n", end.alias("end")).where("n > 0").withColumn("start", F.col("end") - F.col("n"))
    first, last = (F.floor(c / STRETCH).cast("long") for c in (F.col("start"), F.col("end") - 1))
    runs = runs.select(F.col("number").alias("of"), "shard", "start", "end", F.explode(F.sequence(first, last)).alias("part_of"))
    return stored(runs, "runs")


def shard_files(drawn: DataFrame, path: str) -> None:
    """Write the draws as one folder a shard, each in its shuffled order."""
    rows = drawn.where("pass IS NOT NULL").repartition("shard").sortWithinPartitions("shard", "turn")
    rows.write.partitionBy("shard").parquet(path)


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs``, with ``n_draws``, the first and last
    shard whose runs hold its words, and ``dealt``, a digest of shard, turn and words of all its draws."""
    drawn = draws(sized(docs), **options)
    return drawn.groupBy(*KEY, "copy").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").cast("long").alias("taken"),
        F.count("pass").alias("n_draws"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"),
        F.bit_xor(F.when(F.col("pass").isNotNull(), F.xxhash64("shard", "turn", "words"))).alias("dealt"),
    ).select("doc_id", "size", "source_size", "target", "taken", "n_draws", "first_shard", "last_shard", "dealt")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: each row once for every pass that takes some of it,
    with the blocks taken (in their order) as its text.

    Texts meet the pieces that the shards drew by one hash of id, source, size and text; whole rows are
    never grouped. Equal rows, which are few or equal in all that matters, are numbered first.
    """
    names = docs.columns
    sizes = stored(sized(docs), "sizes")
    key = F.xxhash64(*(F.col(f"key_{k}") for k in KEY))
    rows = docs.select(
        F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("key_doc_id"), F.col("source").cast("string").alias("key_source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[^{SPACES}]+")).cast("long").alias("key_size"),
        F.xxhash64("text").alias("key_mark"), F.xxhash64(*names).alias("order"),
    ).withColumn("key_of", key)
    repeated = stored(sizes.where("copies > 1").select(F.xxhash64(*KEY).alias("key_of")).distinct(), "repeated")
    numbered = Window.partitionBy("key_of").orderBy("order")
    rows = rows.join(repeated, "key_of", "left_anti").withColumn("key_copy", F.lit(1)).unionByName(
        rows.join(repeated, "key_of", "left_semi").withColumn("key_copy", F.row_number().over(numbered))
    )
    parts = draws(sizes, **options).where("words > 0").groupBy(*KEY, "copy", "pass").agg(
        F.array_sort(F.collect_list(F.struct("block", "words"))).alias("pieces"), F.sum("words").alias("taken")
    )
    parts = parts.select(
        F.xxhash64(*KEY).alias("part_of"), F.struct(*KEY, "copy").alias("part_key"), F.struct("pieces", "taken").alias("part")
    )
    whole = F.struct(*(F.col(f"key_{k}").alias(k) for k in KEY), F.col("key_copy").alias("copy"))
    met = rows.join(parts, (F.col("key_of") == F.col("part_of")) & whole.eqNullSafe(F.col("part_key")))
    words = F.regexp_extract_all("row.text", F.lit(f"[^{SPACES}]+[{SPACES}]*"), 0)
    cut = F.array_join(
        F.transform("part.pieces", lambda p: F.array_join(F.slice("part_words", p["block"] * BLOCK + 1, p["words"].cast("int")), "")), ""
    )
    met = met.withColumn("part_words", F.when(F.col("part.taken") < F.col("key_size"), words))
    text = F.when(F.col("part.taken") < F.col("key_size"), cut).otherwise(F.col("row.text"))
    return met.select(*(text.alias(c) if c == "text" else F.col(f"row.{c}") for c in names))
