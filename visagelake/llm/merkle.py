"""Merkle manifest of a dataset: a digest per row, a tree per source, and a tree over the sources.

Nodes are numbered in each tree and gathered in aligned blocks of 3 ** LEVELS. A block keeps each of its levels as one
string of hex digests: the parents are the digests of its substrings of three digests' width, and the siblings of a node
are the substrings before and after it in its run. The tops of blocks are the nodes of the next tier, up to one block a
tree; the proofs go down the tiers again. Rows meet nothing but their own block, and blocks only a node of the tier above.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visagelake.operators import tables

#: Children of a node.
FAN = 3
#: Levels that a block holds above its nodes.
LEVELS = 4
SPAN = FAN**LEVELS
#: Hex digits of a digest.
WIDTH = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to which side tables are broadcast, if their bytes allow it.
BROADCAST_ROWS = 200_000


def field(value: Column) -> Column:
    """A value with the bytes of its text in front, so that no two rows of fields read alike; null is `-`."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def parents(level: Column) -> Column:
    """The level above one: a digest of every FAN digests, fewer in the last run."""
    run = FAN * WIDTH
    runs = F.ceil(F.length(level) / run).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "")


def siblings(levels: Column, at: Column) -> Column:
    """(before, after) of the node at a position of a block, on each of its levels."""
    out = []
    for k in range(LEVELS):
        place = F.floor(at / FAN**k)
        first = F.floor(place / FAN)
        inside = (place - first * FAN).cast("int")
        level, begin = F.get(levels, F.lit(k)), (first * FAN * WIDTH + 1).cast("int")
        before = F.substring(level, begin, inside * WIDTH)
        after = F.substring(level, begin + (inside + 1) * WIDTH, (FAN - 1 - inside) * WIDTH)
        out.append(F.struct(before.alias("before"), after.alias("after")))
    return F.slice(F.array(*out), F.lit(1), F.size(levels) - 1)


def fold(node: Column, proof: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(proof, node, lambda low, s: F.sha2(F.concat(s["before"], low, s["after"]), 256))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos, their place from 0 in their tree, and size, the rows of that tree: ranges of (tree, order) are
    sorted and counted, and the counts are summed per tree, a row for each range that it spans."""
    keys = [tree, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "inside": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    dealt = tables.save(dealt, "ordered")
    runs = dealt.groupBy(tree, "part").agg(F.count("*").alias("n"), F.min("inside").alias("first"))
    whole = Window.partitionBy(tree)
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("first")
    offsets = tables.save(runs.select(tree, "part", before.alias("shift"), F.sum("n").over(whole).alias("size")), "offsets")
    return dealt.join(tables.small(offsets, BROADCAST_ROWS), [tree, "part"]).withColumn("pos", F.col("inside") + F.col("shift")).drop("part", "inside", "shift")


def blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, block, size, items, levels) of nodes (tree, pos, size, node, more): items are the nodes in order, with the
    columns in more; levels the strings of the block's levels, up to one node where the tree has no other block."""
    item = F.struct("pos", "node", *more)
    found = nodes.groupBy("tree", "size", F.floor(F.col("pos") / SPAN).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    steps = sum((F.col("size") > FAN**k).cast("int") for k in range(LEVELS))
    lowest = F.array(F.array_join(F.col("items.node"), ""))
    levels = F.aggregate(F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), steps), lowest, lambda have, _: F.concat(have, F.array(parents(F.element_at(have, -1)))))
    return tables.save(found.select("tree", "block", "size", "items", levels.alias("levels")), "blocks")


def raised(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks over nodes, lowest first, and (tree, root) of all trees."""
    tiers, roots = [blocks(nodes, *more)], None
    while True:
        last = tiers[-1].withColumn("top", F.element_at("levels", -1))
        ended = last.where(F.col("size") <= SPAN).select("tree", F.col("top").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        left = last.where(F.col("size") > SPAN)
        if left.isEmpty():
            return tiers, tables.save(roots, "roots")
        tiers.append(blocks(left.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / SPAN).alias("size"), F.col("top").alias("node"))))


def lowered(tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The items of the lowest tier with their proof and what ends holds: ends (tree, above, ...) gives the siblings above
    each tree's root."""
    ahead, kept = None, [c for c in ends.columns if c not in ("tree", "above")]
    for k in reversed(range(len(tiers))):
        ended = tiers[k].where(F.col("size") <= SPAN).select("tree", "block").join(tables.small(ends, BROADCAST_ROWS), "tree")
        ahead = tables.save(ended if ahead is None else ended.unionByName(ahead), "above")
        found = tiers[k].join(tables.small(ahead, BROADCAST_ROWS), ["tree", "block"])
        proof = lambda at: F.concat(siblings(F.col("levels"), at), F.col("above"))
        items = F.transform("items", lambda x, at: F.struct(x.alias("item"), proof(at).alias("above")))
        out = found.select("tree", *kept, F.explode(items).alias("x")).select("tree", *kept, "x.item.*", "x.above")
        ahead = out.select("tree", F.col("pos").alias("block"), "above", *kept)
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", other: Column | None = None) -> DataFrame:
    """Digest and proof of every row: (id_col, leaf, other, subroot, root, proof).

    A leaf covers the given columns, null or not. The rows of a source, a null source among them, ascend by id, nulls
    first; rows of one id go by their leaf, and equal rows are leaves of their own, each with its own siblings. A tree of one
    leaf is that leaf. An empty table has no rows. Texts of any length are digested once; columns that are not named are
    not read, so none can clash. other: a digest of the row to carry along, to be folded with the proof; null if not given.
    """
    source = F.col(source_col).cast("string")
    tree = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))
    given = F.lit(None).cast("string") if other is None else other
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf(*map(F.col, columns)).alias("node"), given.alias("other")).withColumn("tie", F.monotonically_increasing_id())
    leaves = numbered(tables.save(rows, "leaves"), "tree", ["id", "node", "tie"])
    tiers, subroots = raised(leaves, "id", "other")
    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    upper, roots = raised(numbered(sources, "tree", ["source"]), "source")
    none = F.array().cast("array<struct<before: string, after: string>>")
    proofs = lowered(upper, roots.select("tree", none.alias("above"), "root"))
    ends = tables.save(proofs.select(F.col("source").alias("tree"), "above", F.col("node").alias("subroot"), "root"), "sources")
    return lowered(tiers, ends).select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "other", "subroot", "root", F.col("above").alias("proof"))


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents of which those with an even checksum
    of their id have lost the line ends of their text since; a null id has none."""
    id_, cut = F.col("doc_id"), F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))
    lost = (F.crc32(id_.cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text").cast("string"), F.lit("\n"))
    found = manifest(docs, other=F.when(lost, leaf(*(cut if c == "text" else F.col(c) for c in COLUMNS))))
    told = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    folded = found.select("doc_id", "leaf", "subroot", "root", F.sha2(told, 256).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, base: str) -> str:
    return f"""{name}(level, tree, pos, node, n) AS ({base}
  UNION ALL SELECT level + 1, tree, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, tree, pos // 3, n)"""


def _steps(rows: str, tree: str, at: int) -> str:
    place = "(a.pos // CAST(power(3, t.level) AS BIGINT))"
    return f"""SELECT a.row, {at} + t.level AS step, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < {place}), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > {place}), '') AS after
  FROM {rows} a JOIN {tree} t ON t.tree = a.tree AND t.n > 1 AND t.pos // 3 = {place} // 3 GROUP BY a.row, t.level"""


ORACLE = f"""WITH RECURSIVE h AS (
  SELECT *, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS cut, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]), lambda a, i: xor(a >> 1, 3988292384::UBIGINT * (a & 1)))), 4294967295::UBIGINT) AS crc
  FROM documents),
d AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id, leaf) AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
{_tree("low", "SELECT 0, tree, pos, leaf, n FROM d")},
s AS (SELECT tree AS source, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree("high", "SELECT 0, '', pos, node, n FROM s")},
up AS (SELECT d.row, '' AS tree, s.pos FROM d JOIN s ON s.source = d.tree),
steps AS ({_steps("d", "low", 0)} UNION ALL {_steps("up", "high", 1000)}),
proofs AS (SELECT row, string_agg(before || after, '' ORDER BY step) AS told, list(before || '|' || after ORDER BY step) AS proof FROM steps GROUP BY row),
folded AS (SELECT d.doc_id, d.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(told, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN crc % 2 = 0 THEN cut ELSE leaf END, coalesce(proof, [])), lambda low, s: sha256(split_part(s, '|', 1) || low || split_part(s, '|', 2))) AS folded_root
  FROM d JOIN s ON s.source = d.tree JOIN (SELECT node FROM high WHERE n = 1) r ON true LEFT JOIN proofs p ON p.row = d.row)
SELECT *, folded_root = root AS verified FROM folded"""
