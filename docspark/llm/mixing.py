"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, release, stored


def n_words(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII blanks; 0 for null."""
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(F.when(squeezed == "", 0).otherwise(F.char_length(squeezed) - F.char_length(F.translate(squeezed, " ", "")) + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): water-filling of ``share`` x all words by weight, no source above ``most`` x its size.

    ``sizes`` has a row per source.  Sources in code-point order, null last, get the weights in turn.  With the caps in order of
    cap / weight, the level is the first at which what is left by weight fits under the next cap.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    along = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    weighed = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(W.partitionBy())
    return weighed.withColumn("final", final["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("final")), F.col("cap")).alias("target"), "rank")


def sainte_lague(claims: DataFrame, within: list[str], claim: str, seats: str, tie: list[str], rank_at_once: int = 1 << 17) -> DataFrame:
    """Adds ``quota``: the integer seats of each row, by highest quotients claim / (2 k + 1) within each group; ``seats`` is a column, one value a group.

    A threshold t beats the quotients of floor((claim / t + 1) / 2) seats a row.  With n claimants, t = sum / (2 seats - n) grants no seat that the method
    doesn't and t = sum / (2 seats + n) misses none, so two seats a claimant, not all seats, are left to rank.  A group that has more of them than ``rank_at_once``
    has its bracket narrowed by sums over 31 thresholds at a time, until it is small or ties keep it from shrinking.  Equal quotients go by ``tie``.
    A claim of 0 or null gets nothing.
    """
    keys = list(dict.fromkeys([*within, *tie]))
    group = F.struct(*within) if within else F.lit(0)
    rows = claims.where(F.col(claim) > 0).select(*keys, F.col(claim).cast("double").alias("_c"), F.col(seats).cast("long").alias("_s"), group.alias("_g"))
    won = lambda t: F.floor((F.col("_c") / t + 1) / 2)
    sums = rows.groupBy("_g").agg(F.sum("_c").alias("_sum"), F.count("*").alias("_n"), F.max("_c").alias("_top"), F.max("_s").alias("_s"))
    spare = 2 * F.col("_s") - F.col("_n")
    bracket = sums.select("_g", "_s", (F.col("_sum") / (2 * F.col("_s") + F.col("_n"))).alias("_low"), F.when(spare > 0, F.col("_sum") / spare).otherwise(2 * F.col("_top")).alias("_high"), (2 * F.col("_n")).alias("_open"))
    bracket = stored(bracket.where("_s > 0"), "brackets")
    before = None
    while (most := bracket.agg(F.max("_open")).first()[0] or 0) > rank_at_once and most != before:
        before = most
        steps = [F.col("_low") * F.pow(F.col("_high") / F.col("_low"), F.lit(k / 32)) for k in range(33)]
        counts = rows.join(bracket.select("_g", "_low", "_high"), "_g").groupBy("_g").agg(*[F.sum(won(t)).alias(f"_n{k}") for k, t in enumerate(steps)])
        at = F.array(*[F.struct(F.col(f"_n{k}").alias("n"), t.alias("t")) for k, t in enumerate(steps)])  # thresholds rise, counts fall
        both = bracket.join(counts, "_g").withColumn("_least", F.element_at(F.filter(at, lambda x: x["n"] >= F.col("_s")), -1)).withColumn("_most", F.element_at(F.filter(at, lambda x: x["n"] <= F.col("_s")), 1))
        low, high = F.coalesce("_least.t", "_low"), F.coalesce("_most.t", "_high")
        bracket = stored(both.select("_g", "_s", low.alias("_low"), high.alias("_high"), (F.coalesce("_least.n", F.col("_n0")) - F.coalesce("_most.n", F.col("_n32"))).alias("_open")), "brackets")
    # One seat of slack on either side, as the thresholds are rounded.
    based = rows.drop("_s").join(bracket, "_g").withColumn("_base", F.greatest(won(F.col("_high")) - 1, F.lit(0)).cast("long")).withColumn("_last", won(F.col("_low")).cast("long") + 1)
    based = stored(based.select(*keys, "_c", "_g", "_s", "_base", "_last"), "claims")
    left = based.groupBy("_g").agg((F.max("_s") - F.sum("_base")).alias("_left"))
    quotients = based.select(*keys, "_c", "_g", F.explode(F.sequence("_base", "_last")).alias("_k")).join(left, "_g")
    order = W.partitionBy("_g").orderBy((F.col("_c") / (2 * F.col("_k") + 1)).desc(), *tie)
    more = quotients.withColumn("_rank", F.row_number().over(order)).where("_rank <= _left").groupBy(*keys).agg(F.count("*").alias("_more"))
    same = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}{c}") for c in keys], *[c for c in df.columns if c not in keys])
    match = lambda tag: [F.col(c).eqNullSafe(F.col(f"{tag}{c}")) for c in keys]
    got = claims.join(same(based.select(*keys, "_base"), "_b_"), match("_b_"), "left").join(same(more, "_m_"), match("_m_"), "left")
    return got.select(*claims.columns, (F.coalesce("_base", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("quota"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shard_words: int = 1 << 20, seed: int = 7) -> DataFrame:
    """How many words of each document a mix takes: doc_id, size, source_size, target, taken (and the document's source).

    1. Sizes: words per document and source.  2. Targets: ``source_targets``.  3. Each source is dealt by a seeded hash into shards of about
    ``shard_words`` words, a shard's documents stand in seeded order, and its words are cut into blocks of ``block`` words.
    4. Sainte-Laguë gives the mix's blocks to sources by their targets, then each source's blocks to its shards by their words: integer quotas.
    5. A shard takes every block quota // blocks times, and the blocks that a seeded hash ranks first once more.
    A document's ``taken`` is the words of its blocks, repeats counted; no block is taken more than ``most`` (rounded down) times.
    A shard, not a source, is what a task gets, so a source that holds a third of all rows has a third of all shards.  The table of sources itself is
    sorted in one task: sources are names of a collection (thousands at most), not hosts or documents.

    Null text or text without words: size 0, taken 0.  A null source is a source of its own, last in order.  Rows that repeat an id are
    documents of their own unless all of id, source and size agree; those share what is taken of them evenly (the first copy gets the odd word).  An empty table gives an
    empty result; a mix of 0 words takes nothing, and so does one whose targets sum to less than half a block (they are rounded to whole blocks).
    """
    out = _apportioned(docs, id_col, text_col, source_col, weights, share, most, block, shard_words, seed)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = F.floor(F.col("got") / F.col("copies")) + F.when(F.col("copy") <= F.col("got") % F.col("copies"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", F.least(each, F.col("size") * int(most)).cast("long").alias("taken"), "source")


def _apportioned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, block: int, shard_words: int, seed: int) -> DataFrame:
    """What is taken of each distinct (doc_id, source, size): copies, got (the words taken of all copies) and spans, the taken blocks
    {first, end, times} in word places, the second copy's words after the first's."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    words = stored(words, "sizes")
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, most)
    targets = stored(targets.withColumn("seats", F.round(F.sum("target").over(W.partitionBy()) / block)), "sources")
    by_source = stored(sainte_lague(targets, [], "target", "seats", ["rank"]).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))), "targets")
    # One row per distinct (id, source, size); repeats of it are counted and follow each other in the shard.
    units = words.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    src = by_source.select(F.col("source").alias("_source"), "rank", "source_size", "target", F.col("quota").alias("source_quota"), "shards")
    placed = units.join(src, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards")).cast("int"))
    placed = placed.withColumn("stop", F.sum(F.col("size") * F.col("copies")).over(W.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")))
    placed = stored(placed.withColumn("start", F.col("stop") - F.col("size") * F.col("copies")), "shards")
    release(words, targets, by_source)
    shards = stored(placed.groupBy("rank", "shard", "source_quota").agg(F.max("stop").alias("shard_size")).where("shard_size > 0"), "shard-sizes")
    shards = sainte_lague(shards, ["rank"], "shard_size", "source_quota", ["shard"]).withColumn("blocks", F.ceil(F.col("shard_size") / block))
    shards = shards.withColumn("quota", F.least("quota", F.col("blocks") * int(most)))
    # Blocks of a shard: ranked by a seeded hash; the first (quota mod blocks) are taken once more than the others.
    cut = shards.select("rank", "shard", "quota", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    place = F.row_number().over(W.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "shard", "block"), "block"))
    times = cut.withColumn("times", F.floor(F.col("quota") / F.col("blocks")) + (place <= F.col("quota") % F.col("blocks")).cast("long")).where("times > 0").select("rank", "shard", "block", "times")
    pieces = placed.where("stop > start").select("rank", "shard", "doc_id", "size", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("block"))
    inside = F.least("stop", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    first = F.greatest("start", F.col("block") * block) - F.col("start")
    span = F.struct(first.cast("long").alias("first"), (first + inside).cast("long").alias("end"), F.col("times").cast("long").alias("times"))
    got = pieces.join(times, ["rank", "shard", "block"]).groupBy("rank", "doc_id", "size").agg(F.sum(inside * F.col("times")).alias("got"), F.array_sort(F.collect_list(span)).alias("spans"))
    got = got.select(*[F.col(c).alias(f"_g_{c}") for c in ("rank", "doc_id", "size")], "got", "spans")
    same = [F.col("rank") == F.col("_g_rank"), F.col("doc_id").eqNullSafe(F.col("_g_doc_id")), F.col("size") == F.col("_g_size")]
    return placed.join(got, same, "left").select("doc_id", "source", "size", "source_size", "target", "copies", F.coalesce("got", F.lit(0)).alias("got"), "spans")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shard_words: int = 1 << 20, seed: int = 7) -> DataFrame:
    """Documents of the mix of ``mix_sources``, with what a training run reads of each: n_times, taken, spans; those not taken go.

    ``spans`` (array of {first, end, times}, ordered, in words of the document, end exclusive) are the taken blocks.  Of its ``n_times`` passes over a document, pass p
    reads the spans whose ``times`` is p at least; that is ``taken`` words in all, and they sum to the source's target as its blocks do.
    Rows are joined by id, source and size, nulls equal; those that agree in all three get the blocks of one copy each, in an order
    by their text.  Columns of ``docs`` by the names n_times, taken and spans are replaced.
    """
    new = {"n_times", "taken", "spans"}
    key = lambda i, source, size: F.struct(i.alias("i"), source.alias("s"), size.alias("n"))  # noqa: E731  nulls inside a struct are equal
    units = _apportioned(docs, id_col, text_col, source_col, weights, share, most, block, shard_words, seed).where("got > 0")
    # Both keys have fields of the same types, nulls included, so that rows are shuffled by them once.
    # Names of its own, as ``docs`` may have any.
    row, copy, unit, size, blocks = (fresh(docs, x) for x in ("_row", "_copy", "_unit", "_size", "_blocks"))
    units = units.select(key(F.col("doc_id"), F.col("source"), F.coalesce("size", F.lit(0).cast("long"))).alias(unit), F.col("size").alias(size), F.col("spans").alias(blocks))
    rows = docs.select(*[c for c in docs.columns if c.lower() not in new], key(F.col(id_col), F.col(source_col).cast("string"), n_words(F.col(text_col))).alias(row))
    rows = rows.withColumn(copy, F.row_number().over(W.partitionBy(row).orderBy(F.xxhash64(F.col(text_col)))))
    joined = rows.join(units.hint("merge"), F.col(row) == F.col(unit))
    from_, to = (F.col(copy) - 1) * F.col(size), F.col(copy) * F.col(size)
    own = F.transform(blocks, lambda x: F.struct((F.greatest(x["first"], from_) - from_).alias("first"), (F.least(x["end"], to) - from_).alias("end"), x["times"].alias("times")))
    joined = joined.withColumn("spans", F.filter(own, lambda x: x["first"] < x["end"])).where(F.size("spans") > 0)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["first"]) * x["times"])
    n_times = F.array_max(F.transform("spans", lambda x: x["times"]))
    return joined.select(*[c for c in docs.columns if c.lower() not in new], n_times.alias("n_times"), taken.alias("taken"), "spans")
