"""Merkle manifest of a table: a hash tree per group, one over the groups, and a proof for every row.

A leaf is the digest of a row's fields, each `-` if null, else its UTF-8 length, a colon and its value. The
leaves of a group ascend by id; every sixteen consecutive nodes become the digest of their joined hex
digests until one is left, the group's root, and the roots of all groups, ordered by group, give the root.

How: each row gets its rank within its group, whose base-16 digits say where it stands on every level. Rows
of one block of 4,096 ranks are dealt together once; there the digit columns are grouped away one after the
other, each grouping nesting the structs of the one before. A block is one row of bounded size, and its root
is a row of the next pass over blocks of blocks, so no row holds a whole group. Back from the top, each
block meets the path of its own root in one grouping, and transforms of the nested structs, exploded, give
every child its path. Nothing is joined there.

Defined results: rows with equal ids are ordered by their leaf, rows equal in all fields get equal results;
null ids come first, a null group is a group of its own and comes first; a null or empty text is a leaf like
any other; a group of one row has its leaf as root and no siblings; an empty table gives an empty result;
columns that are not named have no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.words import let
from lexmill.session import cut_lineage

ARITY = 16
#: Digit columns grouped away within one block.
LEVELS = 3
BLOCK = ARITY ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows of fields read alike."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp, hash, load) with at, the place in the group from 0, and size, the nodes of the group.

    Rows are dealt by ranges of (grp, order), so a large group is spread over tasks; a row's place is its
    place in its task's rows plus what earlier tasks hold of its group.
    """
    spread = cut_lineage(nodes).repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    dealt = cut_lineage(spread.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)))
    runs = dealt.groupBy("grp", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("grp")
    before = F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("grp").alias("_grp"), F.col("part").alias("_part"), "first", F.coalesce(before, F.lit(0)).alias("before"),
                       F.sum("n").over(of_group).alias("size"))
    placed = dealt.join(runs, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("part") == F.col("_part")))
    return placed.select("grp", (F.col("pos") - F.col("first") + F.col("before")).alias("at"), "size", "hash", "load")


def rolled(nodes: DataFrame) -> DataFrame:
    """One row per block: grp, block, size and kid, the struct of its root with all below it nested.

    A level above the root of a small group passes its only node on unchanged.
    """
    digits = [f"d{k}" for k in range(1, LEVELS)]
    made = nodes.select("grp", F.expr(f"at div {BLOCK}").alias("block"), "size",
                        *[F.expr(f"at div {ARITY ** k} % {ARITY}").alias(d) for k, d in enumerate(digits, 1)],
                        F.struct(F.expr(f"at % {ARITY}").alias("digit"), "hash", "load").alias("kid")).repartition("grp", "block")
    for level in range(1, LEVELS + 1):
        left = digits[level - 1:]
        made = made.groupBy("grp", "block", "size", *left).agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        digest = F.when(F.col("size") > ARITY ** (level - 1), F.sha2(F.array_join("kids.hash", ""), 256)).otherwise(F.get("kids.hash", F.lit(0)))
        digit = F.col(left[0]) if left else F.lit(0).cast("long")
        made = made.select("grp", "block", "size", *left[1:], F.struct(digit.alias("digit"), digest.alias("hash"), "kids").alias("kid"))
    return made


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The block tables of each pass, lowest first; the last has one row per group."""
    passes = []
    while True:
        passes.append(cut_lineage(rolled(nodes)))
        most = passes[-1].agg(F.max("size")).first()[0]
        if most is None or most <= BLOCK:
            return passes
        nodes = passes[-1].select("grp", F.col("block").alias("at"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"),
                                  F.col("kid.hash").alias("hash"), F.lit(None).cast("int").alias("load"))


def step(hashes: Column, i: Column) -> Column:
    """What stands left and right of node i in its run, as joined digests."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
                    F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("right"))


def opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """grp, at, hash, load and up for every node of the blocks; above has grp, block and up, the path of each block's root.

    up holds what the caller put there besides path, the steps from the node to the root.
    """
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = blocks.select("grp", "block", "size", "kid", none(above, "up")).unionByName(
        above.select("grp", "block", none(blocks, "size"), none(blocks, "kid"), "up"))
    rows = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "kid", "up")])
    rows = rows.select("grp", F.col("block").alias("at"), "size", "kid", "up")
    for level in range(LEVELS, 0, -1):
        grown = lambda hashes, i: F.when(F.col("size") > ARITY ** (level - 1), F.concat(  # noqa: E731, B023
            F.array(step(hashes, i)), F.col("up.path"))).otherwise(F.col("up.path"))
        kids = let(F.col("kid.kids.hash"), lambda hashes: F.transform(
            F.col("kid.kids"), lambda kid, i: F.struct(kid.alias("kid"), F.col("up").withField("path", grown(hashes, i)).alias("up"))))
        rows = rows.select("grp", "at", "size", F.inline(kids)).select(
            "grp", (F.col("at") * ARITY + F.col("kid.digit")).alias("at"), "size", "kid", "up")
    return rows.select("grp", "at", F.col("kid.hash").alias("hash"), F.col("kid.load").alias("load"), "up")


def descended(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest pass with their paths; above has those of the last pass."""
    for k, blocks in enumerate(reversed(passes)):
        nodes = opened(blocks, above)
        if k + 1 < len(passes):
            above = nodes.select("grp", F.col("at").alias("block"), "up")
    return nodes


def manifest(docs: DataFrame, id_column: str = "doc_id", group: str = "source", fields: list[str] = FIELDS,
             carried: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, carried and path, an array of (left, right), the digests beside the row's node
    on each level from the leaf to the root. carried is a column of docs that goes with its row."""
    carried = F.lit(None).cast("string") if carried is None else carried
    leaves = docs.select(F.col(group).cast("string").alias("grp"), leaf(*[F.col(c) for c in fields]).alias("hash"), F.col(id_column).alias("id"),
                         F.struct(F.col(id_column).alias("doc_id"), carried.alias("carried")).alias("load"))
    trees = climbed(ranked(leaves, ["id", "hash"]))
    groups = trees[-1].select(F.lit(0).alias("grp"), F.col("kid.hash").alias("hash"), F.struct(F.col("grp").alias("group")).alias("load"))
    top = climbed(ranked(groups, ["load"]))
    text, path = "string", "array<struct<left:string,right:string>>"
    start = top[-1].select("grp", "block", F.struct(F.col("kid.hash").alias("root"), F.lit(None).cast(text).alias("subroot"),
                                                    F.array().cast(path).alias("path")).alias("up"))
    subroots = cut_lineage(descended(top, start).select(F.col("load.group").alias("grp"), F.lit(0).cast("long").alias("block"),
                                                        F.col("up").withField("subroot", F.col("hash")).alias("up")))
    return descended(trees, subroots).select("load.doc_id", F.col("hash").alias("leaf"), "up.subroot", "up.root", "load.carried", "up.path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda digest, at: F.sha2(F.concat(at["left"], digest, at["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def lowered(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def tamper_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    Of rows whose crc32 of the id is divisible by five the capitals A-Z are lower-cased after the manifest
    was made; their leaf is computed anew and folded along the stored path.
    """
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    again = F.when(touched, leaf(*[lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]))
    made = manifest(docs, carried=again)
    proved = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                         folded(F.coalesce("carried", "leaf"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


_ENCODED = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_ENCODED.format(c) for c in FIELDS) + ")"
_BAD_LEAF = "sha256(" + " || ".join(_ENCODED.format(
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in FIELDS) + ")"

#: The CRC is eight shifts per character; both trees grow level by level, then each leaf climbs both.
MANIFEST_SQL = f"""
WITH RECURSIVE c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda ch: [CAST(ascii(ch) + 1 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, greatest(b - 1, 0)) >> 1, 3988292384 * (xor(a, greatest(b - 1, 0)) & 1))), 4294967295) % 5 = 0 AS touched FROM documents),
l AS (SELECT row_number() OVER () AS r, doc_id, source, {_LEAF} AS leaf, CASE WHEN touched THEN {_BAD_LEAF} ELSE {_LEAF} END AS again FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t(source, lvl, pos, hash, n) AS (SELECT source, 0, pos, leaf, n FROM k
  UNION ALL SELECT source, lvl + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lvl, pos // 16, n),
s AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, hash, n) AS (SELECT 0, pos, subroot, n FROM s
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, pos // 16, n),
runs AS (SELECT 0 AS tree, source, lvl, pos // 16 AS run, list(hash ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY source, lvl, pos // 16
  UNION ALL SELECT 1, NULL, lvl, pos // 16, list(hash ORDER BY pos) FROM u WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (SELECT tree, source, lvl, run, i, array_to_string(hs[1:i], '') AS lft, array_to_string(hs[i + 2:], '') AS rgt
  FROM (SELECT *, unnest(range(0, len(hs))) AS i FROM runs)),
a(r, source, lvl, pos, n, hash, proof) AS (SELECT r, source, 0, pos, n, again, '' FROM k
  UNION ALL SELECT r, a.source, a.lvl + 1, a.pos // 16, (n + 15) // 16, sha256(lft || hash || rgt), proof || lft || rgt
  FROM a JOIN steps p ON p.tree = 0 AND p.source IS NOT DISTINCT FROM a.source AND p.lvl = a.lvl AND p.run = a.pos // 16 AND p.i = a.pos % 16),
b(r, lvl, pos, n, hash, proof) AS (SELECT r, 0, s.pos, s.n, hash, proof FROM a JOIN s ON s.source IS NOT DISTINCT FROM a.source WHERE a.n = 1
  UNION ALL SELECT r, b.lvl + 1, b.pos // 16, (n + 15) // 16, sha256(lft || hash || rgt), proof || lft || rgt
  FROM b JOIN steps p ON p.tree = 1 AND p.lvl = b.lvl AND p.run = b.pos // 16 AND p.i = b.pos % 16)
SELECT k.doc_id, k.leaf, s.subroot, u.hash AS root, sha256(b.proof) AS proof_sha256, b.hash AS folded_root, b.hash = u.hash AS verified
FROM k JOIN s ON s.source IS NOT DISTINCT FROM k.source JOIN b ON b.r = k.r AND b.n = 1 JOIN u ON u.n = 1"""
