"""Mixing sources to target weights in whole blocks.

Documents are dealt by id into shards of a source, so many that a shard holds some SHARD_BLOCKS blocks at
least; a shard's words, in id order, are cut into blocks of nearly equal word counts. Blocks are apportioned
by the highest quotients seats / (2k + 1), where the seats of a source are its target in blocks of its own
size: first to sources, then to the shards of each source. A shard takes all its
blocks as often as its quota allows and the rest in the order of a seeded hash, so a run can be
repeated. What a document gives is the overlap of its words with the taken blocks.

The only rows kept per source are its shards, of which there are at most the square root of the
number of documents; sorting is per shard or per source over shards, never over all documents.

Defined results: null and wordless texts have size 0 and give nothing; a null source is a source
of its own, last in order; equal rows may share the taken words in any order; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.words import ANSI_WORDS, n_words
from lexmill.session import cut_lineage

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 64
SHARD_BLOCKS = 16
SEED = 17
SOURCE = ["no_source", "source"]


def hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source with source_size -> also rank and target.

    Sources are ordered by name, null last; weights repeat in that order. Targets share all words by
    weight; a target stops at repeats * source_size and the excess goes to the others by weight. That
    is a common level per weight: with sources in the order of limit / weight, those whose limit lies
    below the level of the rest stop.
    """
    everyone = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everyone.orderBy(*SOURCE)).cast("long"))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, len(weights)) + 1).cast("int"))
    limited = ranked.select("*", weight.alias("weight"), (F.col("source_size") * repeats).alias("limit"))
    by_ratio = everyone.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    judged = limited.select("*", F.sum("source_size").over(everyone).alias("total"),
                            F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("stopped"),
                            F.sum("weight").over(onward).alias("open_weight"))
    stops = judged.withColumn("stops", F.col("limit") * F.col("open_weight") <= (F.col("total") - F.col("stopped")) * F.col("weight"))
    shared = stops.select(*SOURCE, "source_size", "rank", "limit", "weight", "stops", (
        F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(everyone), F.lit(0))).alias("left_over"),
        F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everyone).alias("left_weight"))
    return shared.select(*SOURCE, "source_size", "rank", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(
        (F.col("weight") * F.col("left_over")).cast("double") / F.col("left_weight")).alias("target"))


def apportion(parties: DataFrame, by: list[str], order: list[str], weight: str, cap: str, seats: str) -> DataFrame:
    """Adds quota: seats go one by one to the highest weight / (2k + 1) among parties of a group, at most cap each.

    Caps may turn seats away only by rounding, which `targets` sees to. Then quotas lie near their proportional share, so only quotients near it are compared: with p parties the
    divisor moves by less than 5p / seats of itself (rounding, and seats that caps turn away).
    """
    group = Window.partitionBy(*by)
    share = F.when(F.sum(weight).over(group) > 0, F.floor(F.col(weight) * F.col(seats) / F.sum(weight).over(group))).otherwise(0)
    near = parties.withColumn("_share", share).withColumn("_near", F.when(F.col(seats) > 0, F.ceil(
        F.lit(5.0) * F.count(F.lit(1)).over(group) * F.col("_share") / F.col(seats))).otherwise(0) + 3)
    bounds = near.withColumn("_low", F.greatest(F.lit(0), F.least(F.col(cap), F.col("_share") - F.col("_near")))).withColumn(
        "_high", F.least(F.col(cap), F.col("_share") + F.col("_near"))).withColumn(
        "_rest", F.col(seats) - F.sum("_low").over(group))
    open_seats = bounds.filter((F.col("_high") > F.col("_low")) & (F.col(weight) > 0)).select(
        *by, *order, weight, "_rest", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    quotient = F.col(weight) / (2 * F.col("_k") + 1)
    place = F.row_number().over(group.orderBy(quotient.desc(), *order, "_k"))
    keys = list(dict.fromkeys([*by, *order]))
    won = open_seats.withColumn("_place", place).filter("_place <= _rest").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return bounds.join(won, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop(
        "_share", "_near", "_low", "_high", "_rest", "_won")


def sized(docs: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    name = F.col(source).cast("string")
    return docs.select(F.col(id_column).alias("doc_id"), F.isnull(name).cast("int").alias("no_source"),
                       F.coalesce(name, F.lit("")).alias("source"), n_words(F.col(text)).alias("size"),
                       row_hash(F.col(text)).alias("row_hash"))


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mixed_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        repeats: int = REPEATS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, no_source, source, row_hash, size, source_size, target and taken of each row."""
    sizes = cut_lineage(sized(docs, id_column, text, source))
    n_cells = max(1, int(sizes.count() ** 0.5))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    celled = sizes.withColumn("cell", F.pmod(hash32(key), F.lit(n_cells)).cast("long"))
    cell, shard = [*SOURCE, "cell"], [*SOURCE, "shard"]
    cells = celled.groupBy(*cell).agg(F.sum("size").alias("words")).withColumn("_own", F.sum("words").over(Window.partitionBy(*SOURCE)))
    cells = cut_lineage(cells.withColumn("shard", F.expr(f"cell * greatest(1L, least({n_cells}L, _own div {block_words * SHARD_BLOCKS})) div {n_cells}")))
    dealt = celled.join(cells.select(*cell, "shard"), cell)
    blocks_of = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor((F.col("words") + block_words // 2) / block_words))).otherwise(0)
    shards = cells.groupBy(*shard).agg(F.sum("words").alias("words")).withColumn("blocks", blocks_of.cast("long"))
    sources = targets(shards.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights, repeats)
    blocks = shards.groupBy(*SOURCE).agg(F.sum("blocks").alias("source_blocks"))
    needed = F.when(F.col("source_size") > 0, F.col("target") * F.col("source_blocks") / F.col("source_size")).otherwise(0.0)
    per_source = sources.join(blocks, SOURCE).withColumn("_all", F.lit(0)).withColumn("_needed", needed).withColumn(
        "_seats", F.round(F.sum("_needed").over(Window.partitionBy("_all"))).cast("long")).withColumn("_cap", F.col("source_blocks") * repeats)
    source_quota = apportion(per_source, ["_all"], ["rank"], "_needed", "_cap", "_seats").select(
        *SOURCE, "source_size", "target", F.col("quota").alias("source_quota"))
    per_shard = shards.join(source_quota, SOURCE).withColumn("_cap", F.col("blocks") * repeats)
    plan = cut_lineage(apportion(per_shard, SOURCE, ["shard"], "blocks", "_cap", "source_quota").select(
        *shard, "words", "blocks", "quota", "source_size", "target"))
    extra = taken_once_more(plan, seed)
    in_shard = Window.partitionBy(*shard).orderBy("doc_id", "size", "row_hash")
    placed = dealt.select("*", F.row_number().over(in_shard).alias("place"),
                          F.sum("size").over(in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("end"))
    on = placed.join(plan, shard).select("*", (F.col("end") - F.col("size")).alias("start"))
    first = F.expr("((start + 1) * blocks - 1) div words")
    last = F.expr("(end * blocks - 1) div words")
    parts = on.filter("size > 0").select(*shard, "place", "start", "end", "words", "blocks", "quota",
                                         F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.expr("least(end, ((block + 1) * words) div blocks) - greatest(start, (block * words) div blocks)")
    times = F.expr("quota div blocks") + F.coalesce("once_more", F.lit(0))
    given = parts.join(extra, [*shard, "block"], "left").groupBy(*shard, "place").agg(F.sum(overlap * times).alias("taken"))
    return on.join(given, [*shard, "place"], "left").select(
        "doc_id", *SOURCE, "row_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words that the mix takes."""
    return mixed_rows(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


#: Parts of one copy that `copies` counts in.
UNIT = 1 << 30


def copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
           repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, no_source, source, row_hash, rows, size, whole and more of the rows with words, equal rows in one.

    Each row stays whole + 1 times if it is among the more of its rows, whole times if not. A source gives target / source_size
    of a copy of each row: the whole part to all, the remainder wherever its running sum passes a whole number, from a
    seeded start on. The sum runs through the sizes of the source (a bit more a step), in each through its shards, in these by
    size and seeded hash, so copies of long and of short texts keep to it as well. Per source only (step, shard) sums are sorted.
    """
    groups = cut_lineage(sized(docs, id_column, text, source).filter("size > 0").groupBy("doc_id", *SOURCE, "row_hash").agg(
        F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")))
    n_shards = F.lit(1 + int(groups.count() ** 0.5) // 8)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = groups.select("*", F.length(F.bin("size")).alias("step"), F.pmod(hash32(key), n_shards).alias("shard"))
    sums = cut_lineage(dealt.groupBy(*SOURCE, "step", "shard").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("size")).alias("words")))
    share = F.col("target") / F.col("source_size")
    start = F.shiftright(hash32(F.concat_ws("|", F.lit(str(seed)), "no_source", "source")), 2)
    rates = targets(sums.groupBy(*SOURCE).agg(F.sum("words").alias("source_size")), weights, repeats).select(
        *SOURCE, F.floor(share).alias("whole"), F.floor((share - F.floor(share)) * UNIT + 0.5).alias("part"), start.alias("start"))
    so_far = Window.partitionBy(*SOURCE).orderBy("step", "shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = sums.select(*SOURCE, "step", "shard", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before")).join(rates, SOURCE)
    in_cell = Window.partitionBy(*SOURCE, "step", "shard").orderBy("size", F.xxhash64(F.lit(seed), key, "row_hash"), "doc_id", "row_hash")
    placed = dealt.withColumn("end", F.sum("rows").over(in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(
        cells, [*SOURCE, "step", "shard"]).withColumn("end", F.col("before") + F.col("end"))
    return placed.select("doc_id", *SOURCE, "row_hash", "rows", "size", "whole", F.expr(
        f"(start + end * part) div {UNIT} - (start + (end - rows) * part) div {UNIT}").alias("more"))


def repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs, each row as often as its source's target asks for, so that the words of each source come to its target.

    Whole rows stand in for blocks here. A target is missed by about one text of the source, whatever the sizes (see `copies`).
    Rows equal in id, source and text share their copies evenly, to one copy.
    """
    taken = cut_lineage(copies(docs, id_column, text, source, **options).filter("whole > 0 OR more > 0").select(
        F.col("doc_id").alias("_id"), F.col("no_source").alias("_no"), F.col("source").alias("_source"), F.col("row_hash").alias("_hash"),
        F.col("rows").alias("_rows"), F.col("whole").alias("_whole"), F.col("more").alias("_more")))
    row = F.col("row")
    packed = docs.select(F.struct("*").alias("row"))
    name = row[source].cast("string")
    on = row[id_column].eqNullSafe(F.col("_id")) & (F.isnull(name).cast("int") == F.col("_no")) & (
        F.coalesce(name, F.lit("")) == F.col("_source")) & (row_hash(row[text]) == F.col("_hash"))
    chosen = packed.join(taken.filter("_rows = 1"), on).select("row", (F.col("_whole") + F.col("_more")).alias("_times"))
    several = taken.filter("_rows > 1")
    if not several.isEmpty():
        equal = Window.partitionBy("_id", "_no", "_source", "_hash").orderBy("_hash")
        chosen = chosen.unionByName(packed.join(several, on).withColumn("_place", F.row_number().over(equal)).select(
            "row", (F.col("_whole") + (F.col("_place") <= F.col("_more")).cast("int")).alias("_times")))
    chosen = chosen.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy"))
    return chosen.select(*[row[c].alias(c) for c in docs.columns])


def taken_once_more(plan: DataFrame, seed: int) -> DataFrame:
    """The blocks of each shard that are taken once more than the others: the first by seeded hash."""
    shard = [*SOURCE, "shard"]
    listed = plan.filter("blocks > 0 AND quota % blocks > 0").select(*shard, F.expr("quota % blocks").alias("more"),
                                                                    F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), "no_source", "source", F.col("shard").cast("string"), F.col("block").cast("string")))
    place = F.row_number().over(Window.partitionBy(*shard).orderBy(ticket, "block"))
    return listed.withColumn("_place", place).filter("_place <= more").select(*shard, "block", F.lit(1).alias("once_more"))


#: The same mix in SQL of the checking engine.
MIX_SQL = f"""
WITH d0 AS (SELECT doc_id, CAST(source IS NULL AS INT) AS no_source, coalesce(source, '') AS source,
                  CAST(len({ANSI_WORDS.format(text="text")}) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
                    % greatest(1, CAST(floor(sqrt((SELECT count(*) FROM documents))) AS BIGINT)) AS cell FROM documents),
nc AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS n_cells FROM documents),
d AS (SELECT d0.*, cell * greatest(1, least(n_cells, CAST(sum(size) OVER (PARTITION BY no_source, source) AS BIGINT) // {BLOCK_WORDS * SHARD_BLOCKS})) // n_cells AS shard FROM d0, nc),
sh AS (SELECT *, CASE WHEN words > 0 THEN greatest(1, (words + {BLOCK_WORDS // 2}) // {BLOCK_WORDS}) ELSE 0 END AS blocks
       FROM (SELECT no_source, source, shard, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL)),
s0 AS (SELECT *, row_number() OVER (ORDER BY no_source, source) AS rank
       FROM (SELECT no_source, source, CAST(sum(words) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) AS source_blocks
             FROM sh GROUP BY ALL)),
s1 AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (rank - 1) % {len(WEIGHTS)}] AS weight, {REPEATS} * source_size AS lim FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total,
              coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
              sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s1),
s3 AS (SELECT *, lim * open_weight <= (total - stopped) * weight AS stops FROM s2),
s4 AS (SELECT *, CASE WHEN stops THEN CAST(lim AS DOUBLE)
                      ELSE CAST(weight * (total - coalesce(sum(lim) FILTER (stops) OVER (), 0)) AS DOUBLE)
                           / sum(weight) FILTER (NOT stops) OVER () END AS target FROM s3),
nd AS (SELECT rank, source_blocks, CASE WHEN source_size > 0 THEN target * source_blocks / source_size ELSE 0.0 END AS needed FROM s4),
q1 AS (SELECT rank, k FROM (SELECT *, row_number() OVER (ORDER BY needed / (2 * k + 1) DESC, rank, k) AS place
                            FROM (SELECT rank, needed, unnest(range({REPEATS} * source_blocks)) AS k FROM nd WHERE needed > 0))
       WHERE place <= (SELECT round(sum(needed)) FROM nd)),
s5 AS (SELECT s4.*, coalesce(n, 0) AS source_quota FROM s4 LEFT JOIN (SELECT rank, count(*) AS n FROM q1 GROUP BY rank) USING (rank)),
q2 AS (SELECT no_source, source, shard, count(*) AS n
       FROM (SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY CAST(blocks AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS place
             FROM (SELECT no_source, source, shard, blocks, source_quota, unnest(range({REPEATS} * blocks)) AS k
                   FROM sh JOIN s5 USING (no_source, source)))
       WHERE place <= source_quota GROUP BY ALL),
pl AS (SELECT no_source, source, shard, words, blocks, coalesce(n, 0) AS quota, source_size, target
       FROM sh JOIN s5 USING (no_source, source) LEFT JOIN q2 USING (no_source, source, shard)),
ex AS (SELECT no_source, source, shard, block, 1 AS once_more
       FROM (SELECT *, row_number() OVER (PARTITION BY no_source, source, shard
                     ORDER BY md5(concat_ws('|', '{SEED}', no_source, source, shard, block)), block) AS place
             FROM (SELECT no_source, source, shard, quota % blocks AS more, unnest(range(blocks)) AS block
                   FROM pl WHERE blocks > 0 AND quota % blocks > 0)) WHERE place <= more),
p AS (SELECT *, pos - size AS start FROM (
        SELECT *, row_number() OVER w AS place,
               CAST(sum(size) OVER (PARTITION BY no_source, source, shard ORDER BY doc_id NULLS FIRST, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS pos
        FROM d WINDOW w AS (PARTITION BY no_source, source, shard ORDER BY doc_id NULLS FIRST, size)) JOIN pl USING (no_source, source, shard)),
g AS (SELECT no_source, source, shard, place,
             sum((least(pos, ((block + 1) * words) // blocks) - greatest(start, (block * words) // blocks))
                 * (quota // blocks + coalesce(once_more, 0))) AS taken
      FROM (SELECT *, unnest(range(((start + 1) * blocks - 1) // words, (pos * blocks - 1) // words + 1)) AS block FROM p WHERE size > 0)
      LEFT JOIN ex USING (no_source, source, shard, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM p LEFT JOIN g USING (no_source, source, shard, place)"""
