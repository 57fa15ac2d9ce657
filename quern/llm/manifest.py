"""A Merkle manifest of a table: leaves, roots, proofs, and what a changed row does to them.

Every row is a leaf, the sha256 of its columns.  The leaves of a language stand in id order
and every eight neighbours are hashed to one node, level by level, up to the root of the
language; these roots are hashed likewise to the root of the table.

Places are dealt by range partitions, so a language may span any number of tasks.  Leaves
are then cut in aligned blocks of 4,096 (four levels of eight), each of which is one Arrow
table that an executor hands to DuckDB: ordered ``string_agg`` and ``sha256``, a query a
level.  Spark combines the roots of blocks in blocks again, until one node a language is
left, and the same for the languages.  On the way back every block is joined with the path of
its own root, so only digests are shuffled and the text of a proof is never stored.
"""

from __future__ import annotations

import functools

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, crc_sql, stored
from quern.operators.ranks import positions

FAN, BLOCK_LEVELS = 8, 4
_PATH = "lefts array<string>, rights array<string>"


@functools.cache
def _engine() -> duckdb.DuckDBPyConnection:
    """One connection a Python worker; a block is some thousand rows, so little memory is due."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def _levels(n: int, most: int) -> int:
    """Levels from n nodes to one, or ``most`` of them."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


def _nodes_sql(levels: int) -> str:
    """CTEs n0 (pos, h, ..), n1 (pos, run, h) .. over the Arrow table ``block``; ``run`` is the
    text that was hashed."""
    out = ["n0 AS (SELECT * REPLACE (lower(hex(h)) AS h) FROM block)"]
    for k in range(1, levels + 1):
        out.append(f"n{k} AS (SELECT pos, run, sha256(run) AS h FROM (SELECT pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS run FROM n{k - 1} GROUP BY pos // {FAN}))")
    return "WITH " + ", ".join(out)


def _siblings_sql(levels: int) -> tuple[list[str], list[str], str]:
    """What stands left and right of a leaf's ancestors, and the joins that find it."""
    lefts, rights, joins = [], [], ["FROM n0"]
    for k in range(1, levels + 1):
        own = f"(n0.pos // {FAN ** (k - 1)}) % {FAN}"
        joins.append(f"JOIN n{k} ON n{k}.pos = n0.pos // {FAN**k}")
        lefts.append(f"substr(n{k}.run, 1, 64 * ({own}))")
        rights.append(f"substr(n{k}.run, 64 * ({own}) + 65)")
    return lefts, rights, " ".join(joins)


def _query(block: pa.Table, sql: str, values: list | None = None) -> pa.Table:
    con = _engine()
    con.register("block", block)
    try:
        return con.sql(sql, params=values or []).to_arrow_table()
    finally:
        con.unregister("block")


def _climb(nodes: DataFrame, fan_levels: int) -> DataFrame:
    """(t, pos, n, h): a node for each block of (t, pos, n, h)."""
    width = FAN**fan_levels

    def run(key: tuple, block: pa.Table) -> pa.Table:
        t, n, at = (k.as_py() for k in key)
        levels = _levels(n, fan_levels)
        root = _query(block.select(["pos", "h"]), f"{_nodes_sql(levels)} SELECT unhex(h) AS h FROM n{levels}").column("h")
        return pa.table({"t": pa.array([t], pa.string()), "pos": pa.array([at], pa.int64()), "n": pa.array([-(-n // width)], pa.int64()), "h": pa.array(root.to_pylist(), pa.binary())})

    return nodes.withColumn("at", F.floor(F.col("pos") / width)).groupBy("t", "n", "at").applyInArrow(run, "t string, pos long, n long, h binary")


def _descend(nodes: DataFrame, above: DataFrame, fan_levels: int) -> DataFrame:
    """(t, pos, lefts, rights): the path of every node, from those of the blocks' roots."""

    def run(block: pa.Table, path: pa.Table) -> pa.Table:
        levels = _levels(block.column("n")[0].as_py(), fan_levels)
        lefts, rights, joins = _siblings_sql(levels)
        up = [path.column(c)[0].as_py() for c in ("lefts", "rights")]
        sql = f"{_nodes_sql(levels)} SELECT t, n0.pos AS pos, [{', '.join(lefts)}]::VARCHAR[] || ?::VARCHAR[] AS lefts, [{', '.join(rights)}]::VARCHAR[] || ?::VARCHAR[] AS rights {joins}"
        return _query(block, sql, up)

    keyed = nodes.withColumn("at", F.floor(F.col("pos") / FAN**fan_levels)).groupBy("t", "at")
    return keyed.cogroup(above.groupBy("t", "pos")).applyInArrow(run, f"t string, pos long, {_PATH}")


def _stages(nodes: DataFrame, most: int, fan_levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, and so on to one node a tree."""
    out = [nodes]
    while len(out) == 1 or most > 1:
        out.append(stored(_climb(out[-1].select("t", "pos", "n", "h"), fan_levels), "nodes"))
        most = -(-most // FAN**fan_levels)
    return out


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, columns)).cast("binary"), 256))


def manifest(
    docs: DataFrame,
    changed: Column | None = None,
    new_text: Column | None = None,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    text_col: str = "text",
    fan_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Leaf, root of the language, root, and proof of every row, and the root that the proof
    gives when the rows where ``changed`` holds have ``new_text``.

    Returns a row per input row: ``id_col``, leaf, subroot, root, proof_sha256 (of the siblings'
    digests, level by level from the leaf up, left to right), folded_root, verified.  By default
    no row is changed.  A null is a value of its own in every column: null languages are one
    group, before all others, and null ids stand before other ids.  Rows with the same id stand
    in the order of their leaves, equal rows next to each other.  Texts are hashed whole; other
    columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    altered = [new_text if c == text_col and new_text is not None else F.col(c) for c in columns]
    leaf = _digest([F.col(c) for c in columns])
    tree = F.when(F.col(group_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(group_col).cast("string")))
    odd = F.lit(None).cast("binary") if changed is None else F.when(changed, _digest(altered))
    leaves = docs.select(F.col(id_col).alias("id"), tree.alias("t"), leaf.alias("h"), odd.alias("odd"))
    leaves = positions(leaves, ["t"], ["id", "h"], "pos", "n")
    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)

    stages = _stages(leaves, most, fan_levels)
    tops = positions(stages[-1].select(F.col("t").alias("name"), "h"), [], ["name"], "pos", "n").withColumn("t", F.lit(""))
    outer = _stages(tops, tops.count(), fan_levels)
    root = bytes(outer[-1].first()["h"]).hex()
    none = F.array().cast("array<string>")
    path = outer[-1].select("t", "pos", none.alias("lefts"), none.alias("rights"))
    for nodes in reversed(outer[:-1]):
        path = _descend(nodes.select("t", "pos", "n", "h"), path, fan_levels)
    names = tops.select("pos", F.col("name").alias("t"), F.lower(F.hex("h")).alias("subroot"))
    above = stored(path.drop("t").join(names, "pos").select("t", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot"), "paths")
    subroots = above.select("t", "subroot")
    for nodes in reversed(stages[1:-1]):
        step = _descend(nodes.select("t", "pos", "n", "h"), above.select("t", "pos", "lefts", "rights"), fan_levels)
        above = stored(step.join(subroots, "t"), "paths")

    def prove(block: pa.Table, path: pa.Table) -> pa.Table:
        levels = _levels(block.column("n")[0].as_py(), fan_levels)
        lefts, rights, joins = _siblings_sql(levels)
        up = [path.column(c)[0].as_py() for c in ("lefts", "rights")]
        fold = "coalesce(lower(hex(n0.odd)), n0.h)"
        for left, right in zip(lefts + ["?"] * len(up[0]), rights + ["?"] * len(up[1]), strict=True):
            fold = f"sha256({left} || {fold} || {right})"
        # parameters are numbered as they stand: the outermost level's left comes first
        values = [*reversed(up[0]), *up[1]]
        inside = " || ".join(["''", *[x for pair in zip(lefts, rights, strict=True) for x in pair]])
        outside = "".join(x for pair in zip(*up, strict=True) for x in pair)
        found = f"SELECT n0.id AS id, n0.h AS leaf, {fold} AS folded_root, sha256({inside} || ?) AS proof_sha256 {joins}"
        sql = f"{_nodes_sql(levels)} SELECT id, leaf, ?::VARCHAR AS subroot, ?::VARCHAR AS root, proof_sha256, folded_root, folded_root = ? AS verified FROM ({found})"
        return _query(block, sql, [path.column("subroot")[0].as_py(), root, root, *values, outside])

    keyed = leaves.withColumn("at", F.floor(F.col("pos") / FAN**fan_levels)).groupBy("t", "at")
    found = keyed.cogroup(above.groupBy("t", "pos")).applyInArrow(prove, schema)
    return found.withColumnRenamed("id", id_col)


def lower_thirds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """A change to test proofs with: texts in lower case where 3 divides the crc32 of the id."""
    picked = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return picked, F.when(F.col(text_col).isNotNull(), ascii_lower(F.col(text_col)))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _tree_sql(name: str, base: str) -> str:
    """Recursive CTEs: name (t, k, pos, n, h), all nodes over base (t, pos, n, h); name_run, the
    text hashed to each; ``k`` counts levels."""
    return f"""{name}(t, k, pos, n, h) AS (
  SELECT t, 0, pos, n, h FROM {base}
  UNION ALL
  SELECT t, k + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY t, k, pos // 8),
{name}_run AS (SELECT t, k, pos // 8 AS up, string_agg(h, '' ORDER BY pos) AS run FROM {name} WHERE n > 1 GROUP BY t, k, pos // 8)"""


def _fold_sql(name: str, tree: str, base: str) -> str:
    """name (rid, t, k, pos, f, proof): base folded up the tree, level by level."""
    own = "substr(run, 1, 64 * (pos % 8))", "substr(run, 64 * (pos % 8) + 65)"
    return f"""{name}(rid, t, k, pos, f, proof) AS (
  SELECT rid, t, 0, pos, f, proof FROM {base}
  UNION ALL
  SELECT rid, z.t, z.k + 1, pos // 8, sha256({own[0]} || f || {own[1]}), proof || {own[0]} || {own[1]}
  FROM {name} z JOIN {tree}_run r ON r.t = z.t AND r.k = z.k AND r.up = z.pos // 8)"""


_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SQL = (
    crc_sql("SELECT DISTINCT doc_id::VARCHAR AS key FROM documents WHERE doc_id IS NOT NULL")
    + f""",
x AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, 'n') AS t, sha256({" || ".join(map(_field_sql, _COLUMNS))}) AS h,
             sha256({" || ".join(map(_field_sql, _COLUMNS[:-1]))} || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS odd, coalesce(crc % 3 = 0, false) AS changed
      FROM documents LEFT JOIN crc ON key = doc_id::VARCHAR),
leaf AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM x),
{_tree_sql("doc", "leaf")},
sub AS (SELECT t AS name, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM doc WHERE n = 1),
top AS (SELECT '' AS t, pos, n, subroot AS h FROM sub),
{_tree_sql("lang", "top")},
start AS (SELECT rid, t, pos, CASE WHEN changed THEN odd ELSE h END AS f, '' AS proof FROM leaf),
{_fold_sql("one", "doc", "start")},
middle AS (SELECT rid, '' AS t, sub.pos, f, proof FROM one JOIN sub ON name = t QUALIFY k = max(k) OVER (PARTITION BY rid)),
{_fold_sql("two", "lang", "middle")},
done AS (SELECT rid, f, proof FROM two QUALIFY k = max(k) OVER (PARTITION BY rid))
SELECT doc_id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM leaf JOIN done USING (rid) JOIN sub ON name = t, (SELECT h AS root FROM lang WHERE n = 1)
"""
)
