"""A Merkle manifest of a dataset: digests of every row, of every group's tree, and one root over all groups.

A row's leaf is the SHA-256 of its fields. The leaves of a group, in order, are hashed two by two
until one is left, its subroot (a last one without a partner is hashed alone); the subroots, ordered
by group, give the root in the same way. Digests are lowercase hex text, and that text is hashed.

The tree is built ``HOP`` levels at a time: ``2 ** HOP`` neighbouring nodes meet in one row and give
their ancestor ``HOP`` levels above. What is stored is one row for every node of these levels, linked
to that ancestor as its parent, with the siblings passed on the way to it; the lowest of them are the
leaves. A recursive query starts with every leaf and climbs along the parent links, appends
the siblings and folds the claimed leaf with them; whoever holds a leaf, its siblings and the root
can repeat that without the data. The leaves' own rows bring the first ``HOP`` levels with them, so
what the climb joins has a thousandth of the rows. Nodes of the levels that have few rows, which
many leaves pass, are broadcast behind a count of their rows; any other node is passed by a small
share of the leaves.

Edge cases: a null field is written as ``-``, any other with its length, so no two rows read alike;
a null group is a group of its own and comes first; rows of one group with equal or null ids are
ordered by their leaf (null ids first), and equal rows are leaves of their own; a group of one row
has that leaf as subroot, one group alone its subroot as root; an empty table gives an empty result.
Other input columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .numbering import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels from a stored node to its stored parent.
HOP = 10
#: Levels of the trees with this many rows at most (some 8 MB) are broadcast.
BROADCAST_ROWS = 16_384
#: The tree over the subroots.
TOP = -1

_NODE_COLUMNS = ("tree", "level", "place", "parent_tree", "parent_level", "parent_place", "siblings")
_NODES = "tree long, level int, place long, parent_tree long, parent_level int, parent_place long, siblings array<binary>"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: id, tree, place, leaf, claimed, and its parent and siblings; ``nodes``: the node rows above them; ``groups``: group, tree, rows, subroot."""
    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None
    #: Levels of the tree over the subroots.
    height: int


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields."""
    texts = [v.cast("string") for v in values]
    return _digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _levels(nodes: Column, height: Column) -> Column:
    """The given nodes and the levels above them, as far as ``height``."""
    def above(last: Column) -> Column:
        pairs = F.sequence(F.lit(0), ((F.size(last) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: _digest(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit(""))))

    return F.aggregate(F.sequence(F.lit(1), height), F.array(nodes), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _blocks(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Neighbouring nodes in one row, ``2 ** HOP`` at most, with the levels above them; of nodes that are not their tree's root."""
    met = rows.where("left > 0").groupBy("tree", F.shiftright("place", HOP).alias("above")).agg(
        F.sort_array(F.collect_list(F.struct("place", "hash", *keep))).alias("met"), F.first("left").alias("left"))
    height = F.least(F.lit(HOP), F.col("left"))
    return written(met.select("*", height.alias("height"), _levels(F.col("met.hash"), height).alias("levels")), "merkle-levels")


def _nodes(blocks: DataFrame, level: int, up: bool, keep: Sequence[str] = ()) -> DataFrame:
    """A row for every node of the blocks: its place, parent and siblings. With ``up`` a tree's root is its leaf in the tree over the subroots, at the tree's number."""
    last = (F.col("left") == F.col("height")) & F.lit(up)
    levels, met = F.col("levels"), F.col("met")

    def node(at: Column) -> Column:
        own = F.get(met, at)
        siblings = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda k: F.unhex(F.get(F.get(levels, k), F.call_function("shiftright", at, k).bitwiseXOR(F.lit(1)))))
        return F.struct(*[own[c].alias(c) for c in ("place", "hash", *keep)], siblings.alias("siblings"))

    each = F.inline(F.transform(F.sequence(F.lit(0), F.size(met) - 1), node))
    return blocks.select(
        "tree", F.lit(level).alias("level"), F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("parent_tree"),
        F.when(last, F.lit(0)).otherwise(F.lit(level) + F.col("height")).alias("parent_level"),
        F.when(last, F.col("tree")).otherwise(F.col("above")).alias("parent_place"), each)


def _ancestors(blocks: DataFrame) -> DataFrame:
    """``(tree, place, hash, left)``: the node above each block."""
    return blocks.select("tree", F.col("above").alias("place"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), (F.col("left") - F.col("height")).alias("left"))


def _built(rows: DataFrame, level: int, up: bool) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of the trees from ``level`` on, and the trees' roots ``(tree, hash)``; ``rows`` has tree, place, hash and the levels ``left`` to the root."""
    nodes, roots = [], rows.where("left = 0").select("tree", "hash")
    while not rows.where("left > 0").isEmpty():
        blocks = _blocks(rows)
        nodes.append(_nodes(blocks, level, up).select(*_NODE_COLUMNS))
        rows, level = _ancestors(blocks), level + HOP
        roots = roots.union(rows.where("left = 0").select("tree", "hash"))
    return nodes, roots


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the binary digits of n - 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def manifest(docs: DataFrame, claims: Mapping[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang",
             fields: Sequence[str] = FIELDS) -> Manifest:
    """The manifest of ``docs``. ``claims`` gives, for some fields, the values that are to be verified in place of the true ones."""
    claims = dict(claims or {})
    true = leaf([F.col(c) for c in fields])
    claimed = leaf([claims.get(c, F.col(c)) for c in fields])
    # Texts are read once, here; from now on a row is its digests.
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), true.alias("leaf"), claimed.alias("claimed")).select(
        "id", "grp", F.unhex("leaf").alias("leaf"), F.when(F.col("claimed") != F.col("leaf"), F.unhex("claimed")).alias("claimed")), "merkle-rows")
    counted = written(placed(rows.groupBy("grp").agg(F.count("*").alias("rows")), [], ["grp"], "merkle-groups").withColumnRenamed("place", "tree"), "merkle-trees")
    ordered = placed(rows, ["grp"], ["id", "leaf"], "merkle-ordered")
    text = lambda c: F.lower(F.hex(c))
    low = ordered.join(counted.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).select(
        "tree", "place", text("leaf").alias("hash"), _height(F.col("rows")).alias("left"), "id", text("claimed").alias("claimed"))
    blocks = _blocks(low, ["id", "claimed"])
    alone = low.where("left = 0").select("*", F.lit(TOP).cast("long").alias("parent_tree"), F.lit(0).alias("parent_level"), F.col("tree").alias("parent_place"),
                                         F.array().cast("array<binary>").alias("siblings"))
    columns = ["id", "tree", "place", F.col("hash").alias("leaf"), "claimed", "parent_tree", "parent_level", "parent_place", "siblings"]
    leaves = written(_nodes(blocks, 0, True, ["id", "claimed"]).select(*columns).union(alone.select(*columns)), "merkle-leaves")
    nodes, subroots = _built(_ancestors(blocks).union(low.where("left = 0").select("tree", "place", "hash", "left")), HOP, True)
    groups = written(counted.join(subroots, "tree").select("grp", "tree", "rows", F.col("hash").alias("subroot")), "merkle-subroots")
    trees = groups.count()
    height = (trees - 1).bit_length() if trees else 0
    above, root = _built(groups.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("subroot").alias("hash"), F.lit(height).alias("left")), 0, False)
    spark = docs.sparkSession
    stored = spark.createDataFrame([], _NODES)
    for part in nodes + above:
        stored = stored.union(part)
    found = root.first()  # one row
    return Manifest(leaves, written(stored, "merkle-nodes"), groups, found["hash"] if found else None, height)


def _fold(digest: str, place: str, siblings: str) -> str:
    """SQL of a digest folded with the siblings on its way up: the lowest bit of a place says on which side a sibling stands."""
    return f"""aggregate({siblings}, named_struct('digest', {digest}, 'place', {place}), (f, s) -> named_struct('digest', sha2(
        CASE WHEN s IS NULL THEN f.digest WHEN f.place % 2 = 1 THEN concat(lower(hex(s)), f.digest) ELSE concat(f.digest, lower(hex(s))) END, 256),
        'place', f.place div 2), f -> f.digest)"""


_CLIMB = """
WITH RECURSIVE climb(id, leaf, tree_of, tree, level, place, folded, siblings) AS (
    SELECT id, leaf, tree, parent_tree, parent_level, parent_place, {first}, filter(siblings, s -> s IS NOT NULL) FROM {leaves}
    UNION ALL
    SELECT id, leaf, tree_of, parent_tree, parent_level, parent_place, {next}, concat(siblings, filter(up, s -> s IS NOT NULL))
    FROM (
        SELECT /*+ BROADCAST(h) */ c.id, c.leaf, c.tree_of, c.place, c.folded, c.siblings, {parent}
        FROM climb c {joins})
    WHERE up IS NOT NULL)
SELECT id, leaf, tree_of AS tree, folded, siblings FROM climb WHERE tree = {top} AND level = {height}
"""


def climbed(held: Manifest) -> DataFrame:
    """For every leaf ``(id, leaf, tree, folded, siblings)``: its siblings up to the root, and what the claimed leaf folds to there."""
    spark = held.leaves.sparkSession
    top = F.col("tree") == TOP
    # A few rows: one per stored level.
    sizes = held.nodes.groupBy(top.alias("top"), "level").count().collect()
    high = F.lit(False)
    for r in sizes:
        if r["count"] <= BROADCAST_ROWS:
            high = high | ((top == F.lit(r["top"])) & (F.col("level") == r["level"]))
    kinds = {"h": held.nodes.where(high)}
    if any(r["count"] > BROADCAST_ROWS for r in sizes):
        kinds["n"] = held.nodes.where(~high)
    views = {k: f"merkle_{k}_{uuid.uuid4().hex}" for k in ("leaves", *kinds)}
    held.leaves.createOrReplaceTempView(views["leaves"])
    for k, rows in kinds.items():
        rows.createOrReplaceTempView(views[k])
    either = lambda c: f"coalesce({', '.join(f'{k}.{c}' for k in kinds)})"
    sql = _CLIMB.format(
        top=TOP, height=held.height, leaves=views["leaves"], first=_fold("coalesce(claimed, leaf)", "place", "siblings"), next=_fold("folded", "place", "up"),
        parent=", ".join([*[f"{either(c)} AS {c}" for c in ("parent_tree", "parent_level", "parent_place")], f"{either('siblings')} AS up"]),
        joins=" ".join(f"LEFT JOIN {views[k]} {k} ON c.tree = {k}.tree AND c.level = {k}.level AND c.place = {k}.place" for k in kinds))
    # The rows that a recursive query may return are limited unless told otherwise; here they are the rows of the dataset.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(sql), "merkle-climbed")
    finally:
        spark.conf.set(limit, before)
        for v in views.values():
            spark.catalog.dropTempView(v)


def verified(held: Manifest) -> DataFrame:
    """Every leaf with its proof and whether what is claimed of it agrees with the root: id, grp, leaf, subroot, root, siblings, folded_root, verified."""
    return climbed(held).join(held.groups.select("tree", "grp", "subroot"), "tree").select(
        "id", "grp", "leaf", "subroot", F.lit(held.root).alias("root"), "siblings",
        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(held.root)).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    added = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)
    held = manifest(docs, {"n_chars": F.when(tampered, added.cast("string")).otherwise(F.col("n_chars").cast("string"))})
    proof = F.sha2(F.array_join(F.transform("siblings", lambda s: F.lower(F.hex(s))), ""), 256)
    return verified(held).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def _sql_field(value: str, name: str | None = None) -> str:
    return f"CASE WHEN {name or value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _sql_leaf(n_chars: str) -> str:
    fields = " || ".join(f"({_sql_field(n_chars if c == 'n_chars' else c)})" for c in FIELDS)
    return f"sha256({fields})"


#: Reflected CRC-32 of the decimal id, byte by byte and bit by bit.
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""


def _sql_levels(name: str, base: str) -> str:
    """Every node of every tree: (grp, level, place, hash)."""
    return f"""{name}(grp, level, place, hash) AS (
    {base}
    UNION ALL
    SELECT grp, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}) WHERE n > 1 GROUP BY grp, level, place // 2)"""


def _sql_climb(name: str, nodes: str, base: str) -> str:
    """Climbs the levels of one tree."""
    return f"""{name}(row_no, grp, level, place, folded, siblings) AS (
    {base}
    UNION ALL
    SELECT c.row_no, c.grp, c.level + 1, c.place // 2,
        sha256(CASE WHEN s.hash IS NULL THEN c.folded WHEN c.place % 2 = 1 THEN s.hash || c.folded ELSE c.folded || s.hash END),
        c.siblings || coalesce(s.hash, '')
    FROM {name} c
    JOIN (SELECT grp, max(level) AS height FROM {nodes} GROUP BY grp) t ON t.grp IS NOT DISTINCT FROM c.grp AND c.level < t.height
    LEFT JOIN {nodes} s ON s.grp IS NOT DISTINCT FROM c.grp AND s.level = c.level AND s.place = xor(c.place, 1))"""


OP12_SQL = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, lang AS grp, {_sql_leaf('n_chars')} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_SQL_CRC} % 7 = 0 THEN {_sql_leaf('(n_chars + 1)')} END AS changed
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER () AS row_no, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
{_sql_levels('low', 'SELECT grp, 0::BIGINT, place, leaf FROM leaves')},
subroots AS (
    SELECT grp, hash, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place
    FROM (SELECT *, max(level) OVER (PARTITION BY grp) AS height FROM low) WHERE level = height),
{_sql_levels('top', "SELECT 'top', 0::BIGINT, place, hash FROM subroots")},
{_sql_climb('below', 'low', "SELECT row_no, grp, 0::BIGINT, place, coalesce(changed, leaf), '' FROM leaves")},
{_sql_climb('above', 'top', '''SELECT b.row_no, 'top', 0::BIGINT, s.place, b.folded, b.siblings
    FROM (SELECT *, max(level) OVER (PARTITION BY row_no) AS height FROM below) b JOIN subroots s ON s.grp IS NOT DISTINCT FROM b.grp
    WHERE b.level = b.height''')},
ended AS (SELECT * FROM (SELECT *, max(level) OVER (PARTITION BY row_no) AS height FROM above) WHERE level = height),
root AS (SELECT hash FROM top ORDER BY level DESC LIMIT 1)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(e.siblings) AS proof_sha256, e.folded AS folded_root, e.folded = r.hash AS verified
FROM leaves l JOIN subroots s ON s.grp IS NOT DISTINCT FROM l.grp JOIN ended e ON e.row_no = l.row_no CROSS JOIN root r
"""
