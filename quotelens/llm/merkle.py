"""A hash tree over the rows of a table, with a proof for every row.

Rows are leaves, in the order of their id within a group. Every ``2`` consecutive
nodes become the hash of their joined digests until one is left; the groups' roots,
in the order of the groups, are the leaves of one more such tree.

Built by nested structs: a node's place within its block is a column per binary
digit, and the digits are grouped away one after the other, the children's structs
nesting in the parent's. All these groupings share the partitioning by block, so
there is one shuffle for a block's whole height. A block is ``2 ** DEPTH`` nodes, so
no row grows with the table; the roots of the blocks are the nodes of the next tier.
Proofs come out of the nested blocks by transform and explode. What a tier's nodes
have above them is handed down as a row beside each block and grouped away with it,
as one more digit would be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.operators.ranking import sequence_index
from quotelens.sources.staging import Staging

#: Levels of a block: it holds 1,024 nodes at most.
DEPTH = 10

#: Columns of the corpus's rows that a leaf covers, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """The hash of a row: each value as ``-`` if null, else its length in bytes, ``:``, itself."""
    coded = [
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        for v in (v.cast("string") for v in values)
    ]
    return digest(*coded)


def _digits() -> list[str]:
    return [f"digit_{i}" for i in range(DEPTH)]


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (group, place, node struct with its hash ``h``) as one nested struct per block.

    A node of a block's upper level has ``h``, its ``kids`` and whether it was
    ``hashed``: an only child at the left end is the whole tree, so it stays as it is.
    """
    digits = _digits()
    placed = nodes.select(
        "group",
        F.shiftright("place", DEPTH).alias("block"),
        *[F.shiftright("place", i).bitwiseAND(1).alias(d) for i, d in enumerate(digits)],
        "node",
    ).repartition("group", "block")
    for i, d in enumerate(digits):
        above = digits[i + 1 :]
        kids = F.transform(F.array_sort(F.collect_list(F.struct(d, "node"))), lambda k: k["node"])
        grouped = placed.groupBy("group", "block", *above).agg(kids.alias("kids"))
        elsewhere = F.col("block") > 0
        for higher in above:
            elsewhere = elsewhere | (F.col(higher) > 0)
        hashed = elsewhere | (F.size("kids") > 1)
        h = F.when(hashed, digest(F.concat_ws("", "kids.h"))).otherwise(F.col("kids")[0]["h"])
        placed = grouped.select(
            "group", "block", *above, F.struct(h.alias("h"), hashed.alias("hashed"), "kids").alias("node")
        )
    return placed


def _proofs(node: Column, levels: int, above: Column) -> Column:
    """The nodes below ``node``, each with the siblings of every level up to the root, nearest first."""
    if not levels:
        return F.array(F.struct(node.alias("node"), above.alias("path")))
    hashes = node["kids"]["h"]

    def below(kid: Column, i: Column) -> Column:
        sides = F.struct(
            F.concat_ws("", F.slice(hashes, F.lit(1), i)).alias("left"),
            F.concat_ws("", F.slice(hashes, i + 2, F.size(hashes))).alias("right"),
        )
        own = F.when(node["hashed"], F.array(sides)).otherwise(F.array().cast(PATH))
        return _proofs(kid, levels - 1, F.concat(own, above))

    return F.flatten(F.transform(node["kids"], below))


PATH = "array<struct<left:string,right:string>>"


def _emit(blocks: DataFrame, handed: Sequence[str]) -> DataFrame:
    """A row per node of the blocks: its struct, its path and what its block was handed."""
    found = blocks.select("group", "block", *handed, F.explode(_proofs(F.col("node"), DEPTH, F.col("path"))).alias("found"))
    return found.select("group", *handed, "found.node", "found.path")


def _hand_down(blocks: DataFrame, rows: DataFrame, handed: Sequence[str]) -> DataFrame:
    """Blocks with the path and the handed columns of their node one tier up.

    Both are rows of one table, told apart by their nulls, and grouped by block.
    """
    kinds = dict(blocks.dtypes)
    nothing = F.lit(None)
    one = rows.select("group", "block", *handed, "path", nothing.cast(kinds["node"]).alias("node"))
    two = blocks.select(
        "group", "block", *[nothing.cast(dict(rows.dtypes)[c]).alias(c) for c in handed], nothing.cast(PATH).alias("path"), "node"
    )
    return one.unionByName(two).groupBy("group", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in (*handed, "path", "node")]
    )


def _tiers(nodes: DataFrame, count: int, staging: Staging, name: str) -> list[DataFrame]:
    """The blocks of every tier, from the leaves up to one block per group."""
    tiers = []
    while True:
        tiers.append(staging.table(_blocks(nodes), f"{name}_{len(tiers)}"))
        count = -(-count // 2**DEPTH)
        if count <= 1:
            return tiers
        nodes = tiers[-1].select(
            "group", F.col("block").alias("place"), F.struct(F.col("node.h").alias("h"), "block").alias("node")
        )


def _descend(tiers: list[DataFrame], rows: DataFrame, handed: Sequence[str]) -> DataFrame:
    """The leaves below the top blocks, whose paths and handed columns ``rows`` has."""
    for i, blocks in reversed(list(enumerate(tiers))):
        rows = _emit(_hand_down(blocks, rows, handed), handed)
        if i:
            rows = rows.select("group", F.col("node.block").alias("block"), *handed, "path")
    return rows


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def prove(
    docs: DataFrame,
    staging: Staging,
    columns: Sequence[str] = LEAF_COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    carry: Sequence[str] = (),
) -> DataFrame:
    """A row per row of ``docs``: ``group``, ``order``, the ``carry`` columns and its proof.

    ``leaf``, ``subroot`` (its group's), ``root``, and ``path``: an array of the
    siblings ``left`` and ``right`` of it on every level, joined, from the leaf up.

    A null group is a group, the first. Rows without an id come first in theirs.
    Rows of one id are ordered by their leaves; equal rows are each a leaf. Empty
    text and null differ. An empty table gives no rows. Columns not named are not
    read; they may have any names. ``staging`` holds a table per tier until deleted.
    """
    held = [*dict.fromkeys([order, *carry])]
    kept = [f"held_{c}" for c in held]
    rows = docs.select(
        F.col(group).alias("group"),
        F.struct(
            leaf(*[F.col(c) for c in columns]).alias("h"), *[F.col(c).alias(k) for c, k in zip(held, kept)]
        ).alias("node"),
    )
    # Nulls last is the order of numbering; here they are first, so the null flag leads.
    number = rows.withColumns({"some": F.col(f"node.{kept[0]}").isNotNull(), "by": F.col(f"node.{kept[0]}"), "tie": F.col("node.h")})
    placed = sequence_index(number, ["group"], "some", out="place", tie_breakers=["by", "tie"], staging=staging, one_task_bytes=0)
    placed = staging.table(placed.select("group", "place", "node"), "leaves")
    most = placed.agg(F.max("place")).first()[0]
    tiers = _tiers(placed, (most or 0) + 1, staging, "blocks")
    # One block per group is left. A group's name is an output, so it is kept in the node.
    tops = tiers[-1].select(
        F.lit(0).alias("group"),
        F.col("group").isNotNull().alias("some"),
        F.col("group").alias("by"),
        F.struct(F.col("node.h").alias("h"), F.col("group").alias("name")).alias("node"),
    )
    tops = sequence_index(tops, ["group"], "some", out="place", tie_breakers=["by"], staging=staging, one_task_bytes=0)
    tops = staging.table(tops.select("group", "place", "node"), "subroots")
    groups = tops.agg(F.max("place")).first()[0]
    crown = _tiers(tops, (groups or 0) + 1, staging, "crown")
    start = crown[-1].select("group", "block", F.col("node.h").alias("root"), F.array().cast(PATH).alias("path"))
    above = _descend(crown, start, ["root"]).select(
        F.col("node.name").alias("group"),
        F.lit(0).cast("long").alias("block"),
        F.col("node.h").alias("subroot"),
        "root",
        "path",
    )
    found = _descend(tiers, staging.table(above, "above"), ["subroot", "root"])
    return found.select(
        F.col("group").alias(group),
        *[F.col(f"node.{k}").alias(c) for c, k in zip(held, kept) if c != group],
        F.col("node.h").alias("leaf"),
        "subroot",
        "root",
        "path",
    )


#: One row in so many is tampered with.
TAMPERED = 7


def audit(docs: DataFrame, staging: Staging) -> DataFrame:
    """The proofs of the corpus, and the root that a tampered row would give.

    A row is tampered with where 7 divides the CRC-32 of its id in decimal: one is
    added to ``n_chars``. A row without an id is not, and a null count stays null,
    so such a row still verifies.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    more = F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    given = docs.select(*LEAF_COLUMNS)
    tampered = leaf(*[more if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS])
    found = prove(given.withColumn("tampered", tampered), staging, carry=["tampered"])
    siblings = F.flatten(F.transform("path", lambda s: F.array(s["left"], s["right"])))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"),
        fold(F.col("tampered"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def audit_sql() -> str:
    """:func:`audit` in DuckDB."""
    def coded(count: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({count} AS VARCHAR)", "text"]
        return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)

    return f"""
WITH RECURSIVE rows_ AS (
    SELECT *, sha256({coded("n_chars")}) AS leaf,
           list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(
                   CAST(ascii(c) AS BIGINT), [256::BIGINT, 256, 256, 256, 256, 256, 256, 256])))),
               lambda c, x: CASE WHEN x < 256 THEN xor(c, x)
                            ELSE xor(c >> 1, (c & 1) * 3988292384::BIGINT) END) AS crc
    FROM documents
), leaves AS (
    SELECT *, CASE WHEN xor(crc, 4294967295) % {TAMPERED} = 0 THEN sha256({coded("n_chars + 1")}) ELSE leaf END AS start,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           row_number() OVER () AS k
    FROM rows_
), trees AS (
    SELECT 0 AS level, lang, place, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
    UNION ALL
    SELECT level + 1, lang, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
    FROM trees WHERE n > 1 GROUP BY level, lang, place // 2, n
), subroots AS (
    SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM trees WHERE n = 1
), crown AS (
    SELECT 0 AS level, place, h, n FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2
    FROM crown WHERE n > 1 GROUP BY level, place // 2, n
), steps AS (
    SELECT l.k, t.level, l.place >> t.level AS at, s.h
    FROM leaves l JOIN (SELECT DISTINCT lang, level FROM trees WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN trees s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.place = xor(l.place >> t.level, 1)
    UNION ALL
    SELECT l.k, r.height + t.level, r.place >> t.level, s.h
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
    CROSS JOIN (SELECT DISTINCT level FROM crown WHERE n > 1) t
    LEFT JOIN crown s ON s.level = t.level AND s.place = xor(r.place >> t.level, 1)
), folds AS (
    SELECT k, 0 AS level, start AS h FROM leaves
    UNION ALL
    SELECT f.k, f.level + 1, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN s.at % 2 = 1 THEN sha256(s.h || f.h)
                                  ELSE sha256(f.h || s.h) END
    FROM folds f JOIN steps s ON s.k = f.k AND s.level = f.level
), proofs AS (
    SELECT k, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY k
)
SELECT l.doc_id, l.leaf, r.h AS subroot, top.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = top.h AS verified
FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
CROSS JOIN (SELECT h FROM crown WHERE n = 1) top
JOIN (SELECT k, arg_max(h, level) AS h FROM folds GROUP BY k) f ON f.k = l.k
LEFT JOIN proofs p ON p.k = l.k
"""
