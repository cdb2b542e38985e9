"""Merkle manifest of a dataset: leaves, a root for each source, one root over all.

A row's leaf is the SHA-256 of its fields, each with its length.  The leaves of a
source, in the order of the ids, are the lowest level of a tree with FAN children a
node; the sources' roots, in the order of their names, are that of the tree above.

Spark ranks the leaves in their source (a shuffle by ranges), cuts each source into
aligned buckets of SPAN leaves and deals whole buckets to blocks.  A block goes to
DuckDB inside the executor as an Arrow table: each level is one query, an ordered
string_agg and a sha256 by run of FAN nodes.  The roots of the buckets are the
leaves of the next tier, which goes the same way, until one node a source is left.
Proofs come back down: a step is what stands left and right of a node in its run,
the steps of a bucket's root within the outer tree are worked out once a bucket and
joined to its leaves, whose inner steps the same queries give.

A hot source is cut like others; a block holds about SPAN nodes whatever the sources'
sizes; the driver sees the number of nodes of a tier and the root.

Defined cases: null fields are leaves' `-`; a null source is a source of its own and
comes first; a null doc_id comes first in its source and is never tampered with;
rows that repeat an id follow in the order of their leaves; extra columns are no
part of a leaf; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import table
from gistmill.llm.order import ranked

FAN = 16
LEVELS = 3  # of a bucket
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "grp string, r long, n long, h string"
_STEPS = "grp string, r long, steps array<string>"
_PROOFS = "grp string, r long, proof_sha256 string, folded string"


def leaf(fields: dict[str, Column]) -> Column:
    """SHA-256 (hex) of the fields in their order: `-` for null, else the number of
    UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


@cache
def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.execute("SET enable_progress_bar = false")
    return con


def _levels(nodes: pa.Table, fan: int, levels: int):
    """An engine with the tables l0.. (grp, b, r, n, h: the nodes of each level of the
    buckets, b the bucket) and s0.. (grp, r, step: what stands left and right of a
    node in its run, with a colon between).  A level ends a source once its bucket
    has one node and no others follow."""
    con = _engine()
    con.register("nodes", nodes)
    con.execute(f"CREATE OR REPLACE TEMP TABLE l0 AS SELECT grp, r // {fan**levels} AS b, r, n, h FROM nodes")
    con.unregister("nodes")
    for k in range(levels):
        run = f"PARTITION BY grp, r // {fan} ORDER BY r"
        con.execute(
            f"""CREATE OR REPLACE TEMP TABLE s{k} AS SELECT grp, r,
              coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || ':' ||
              coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
            FROM l{k} WHERE n > {fan**k}"""
        )
        con.execute(
            f"""CREATE OR REPLACE TEMP TABLE l{k + 1} AS
            SELECT grp, b, r // {fan} AS r, n, sha256(string_agg(h, '' ORDER BY r)) AS h FROM l{k} WHERE n > {fan**k} GROUP BY grp, b, r // {fan}, n
            UNION ALL SELECT grp, b, r, n, h FROM l{k} WHERE n <= {fan**k}"""
        )
    return con


def _inner_steps(fan: int, levels: int) -> str:
    """SQL for the steps of every node of l0, from the lowest level up."""
    picked = ", ".join(f"s{k}.step" for k in range(levels))
    joins = " ".join(f"LEFT JOIN s{k} ON s{k}.grp = l0.grp AND s{k}.r = l0.r // {fan**k}" for k in range(levels))
    return f"SELECT l0.*, list_filter([{picked}], lambda x: x IS NOT NULL) AS inner_steps FROM l0 {joins}"


def _arrow(con, query: str, schema: pa.Schema) -> pa.Table:
    return con.sql(query).to_arrow_table().cast(schema)


_ROOT_ARROW = pa.schema([("grp", pa.string()), ("r", pa.int64()), ("n", pa.int64()), ("h", pa.string())])
_STEP_ARROW = pa.schema([("grp", pa.string()), ("r", pa.int64()), ("steps", pa.list_(pa.string()))])
_PROOF_ARROW = pa.schema([("grp", pa.string()), ("r", pa.int64()), ("proof_sha256", pa.string()), ("folded", pa.string())])


def _roots(fan: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(nodes: pa.Table) -> pa.Table:
        con = _levels(nodes.select(["grp", "r", "n", "h"]), fan, levels)
        return _arrow(con, f"SELECT grp, b AS r, n, h FROM l{levels}", _ROOT_ARROW)

    return run


def _with_outer(nodes: pa.Table, outer: pa.Table, fan: int, levels: int):
    con = _levels(nodes.select(["grp", "r", "n", "h"]), fan, levels)
    con.register("outer_arrow", outer.select(["grp", "r", "steps"]))
    con.execute("CREATE OR REPLACE TEMP TABLE above AS SELECT grp, r AS b, steps FROM outer_arrow")
    con.unregister("outer_arrow")
    return con


def _steps(fan: int, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        con = _with_outer(nodes, outer, fan, levels)
        return _arrow(con, f"SELECT grp, r, list_concat(inner_steps, steps) AS steps FROM ({_inner_steps(fan, levels)}) JOIN above USING (grp, b)", _STEP_ARROW)

    return run


def _proofs(fan: int, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The digest of a leaf's steps, and the root that they give with the leaf (or,
    where a leaf was altered, with that)."""

    def run(nodes: pa.Table, outer: pa.Table) -> pa.Table:
        con = _with_outer(nodes, outer, fan, levels)
        con.register("altered_arrow", nodes.select(["grp", "r", "altered"]))
        con.execute("CREATE OR REPLACE TEMP TABLE altered AS SELECT * FROM altered_arrow WHERE altered IS NOT NULL")
        con.unregister("altered_arrow")
        folded = "list_reduce(all_steps, lambda x, step: sha256(split_part(step, ':', 1) || x || split_part(step, ':', 2)), coalesce(altered, h))"
        return _arrow(
            con,
            f"""SELECT grp, r, sha256(replace(array_to_string(all_steps, ''), ':', '')) AS proof_sha256, {folded} AS folded
            FROM (SELECT grp, r, h, altered, list_concat(inner_steps, steps) AS all_steps
                  FROM ({_inner_steps(fan, levels)}) JOIN above USING (grp, b) LEFT JOIN altered USING (grp, r))""",
            _PROOF_ARROW,
        )

    return run


class Forest:
    """The trees of all groups: `nodes` has grp, r (rank in the group), n (nodes of the
    group) and h.  Tiers are written tables; `roots` has grp and h."""

    def __init__(self, nodes: DataFrame, *, fan: int = FAN, levels: int = LEVELS):
        self.fan, self.levels, self.span = fan, levels, fan**levels
        self.tiers, self.blocks, roots = [], [], None
        while True:
            count = nodes.count()
            self.tiers.append(nodes)
            self.blocks.append(max(1, -(-count // self.span)))
            made = table(self._dealt(nodes, -1, bucket=F.floor(F.col("r") / self.span)).applyInArrow(_roots(fan, levels), _NODES), "buckets")
            done = made.where(F.col("n") <= self.span).select("grp", "h", F.lit(len(self.tiers) - 1).alias("tier"))
            roots = done if roots is None else roots.unionByName(done)
            nodes = made.where(F.col("n") > self.span).withColumn("n", F.ceil(F.col("n") / self.span))
            if nodes.isEmpty():
                break
        self.roots = table(roots, "roots")

    def _dealt(self, rows: DataFrame, tier: int, *, bucket: Column):
        """Rows by block: whole buckets, about `span` nodes a block."""
        return rows.withColumn("block", F.pmod(F.xxhash64("grp", bucket), F.lit(self.blocks[tier]))).groupBy("block")

    def _down(self, tier: int, nodes: DataFrame, outer: DataFrame, run, schema: str) -> DataFrame:
        nodes = self._dealt(nodes, tier, bucket=F.floor(F.col("r") / self.span))
        return nodes.cogroup(self._dealt(outer, tier, bucket=F.col("r"))).applyInArrow(run, schema)

    def outer(self, above: DataFrame) -> DataFrame:
        """grp, r (bucket), steps: the steps of the lowest tier's bucket roots, where
        `above` (grp, steps) has those of the groups' roots."""
        found = None
        for tier in reversed(range(len(self.tiers))):
            here = self.roots.where(F.col("tier") == tier).select("grp", F.lit(0).cast("long").alias("r")).join(above, "grp")
            if found is not None:
                here = here.unionByName(self._down(tier + 1, self.tiers[tier + 1], found, _steps(self.fan, self.levels), _STEPS))
            found = table(here, "outer")
        return found

    def steps(self, above: DataFrame) -> DataFrame:
        """grp, r, steps of every node of the lowest tier."""
        return self._down(0, self.tiers[0], self.outer(above), _steps(self.fan, self.levels), _STEPS)

    def proofs(self, above: DataFrame) -> DataFrame:
        """grp, r, proof_sha256, folded of every node; nodes have a column `altered`."""
        return self._down(0, self.tiers[0], self.outer(above), _proofs(self.fan, self.levels), _PROOFS)


def manifest(docs: DataFrame, *, tampered: Column | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Rows where `tampered` holds (none by default) are verified as if the letters A-Z
    of their text had been lower-cased after the manifest was made.
    """
    fields = {c: F.col(c) for c in FIELDS}
    lowered = fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    altered = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(lowered))
    # a null source is "-", which comes before "=" and any name
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    leaves = table(docs.select("doc_id", grp.alias("grp"), leaf(fields).alias("h"), altered.alias("altered")), "leaves")
    placed = ranked(leaves, [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("altered")], "grp")
    placed = table(placed.withColumnsRenamed({"rank": "r", "rows": "n"}), "placed")

    trees = Forest(placed, fan=fan, levels=levels)
    names = ranked(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), [F.asc("name")], "grp").withColumnsRenamed({"rank": "r", "rows": "n"})
    top = Forest(table(names, "names"), fan=fan, levels=levels)
    root = (top.roots.select("h").first() or [None])[0]

    spark = docs.sparkSession
    nothing = spark.range(1).select(F.lit("").alias("grp"), F.array().cast("array<string>").alias("steps"))
    above = top.steps(nothing).join(top.tiers[0].select("grp", "r", "name"), ["grp", "r"]).select(F.col("name").alias("grp"), "steps")
    proofs = trees.proofs(table(above, "above"))

    out = placed.join(proofs, ["grp", "r"]).join(trees.roots.select("grp", F.col("h").alias("subroot")), "grp")
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", F.col("folded").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def fifth(doc_id: Column) -> Column:
    """Whether 5 divides the CRC-32 of the id as a decimal number; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _oracle_tree(name: str, source: str, fan: int, levels: int) -> str:
    """CTEs `name`0.. up to `name``levels`: nodes (grp, r, n, h) of each level."""
    out = [f"{name}0 AS (SELECT grp, r, n, h FROM {source})"]
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT grp, r // {fan} AS r, n, sha256(string_agg(h, '' ORDER BY r)) AS h FROM {name}{k} WHERE n > {fan**k} GROUP BY ALL"
            f" UNION ALL SELECT grp, r, n, h FROM {name}{k} WHERE n <= {fan**k})"
        )
    return ",\n".join(out)


def _oracle_steps(name: str, fan: int, levels: int) -> str:
    """CTE `name`_steps: left and right siblings of every node, by level."""
    levels_sql = []
    for k in range(levels):
        run = f"PARTITION BY grp, r // {fan} ORDER BY r"
        levels_sql.append(
            f"SELECT {k} AS level, grp, r, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,"
            f" coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k} WHERE n > {fan**k}"
        )
    return f"{name}_steps AS (" + "\nUNION ALL ".join(levels_sql) + ")"


def oracle(*, fan: int = FAN, levels: int = 6, top_levels: int = 4) -> str:
    """The same in DuckDB SQL, for at most fan ** levels rows a source and
    fan ** top_levels sources."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joined = " || ".join(field.format(c) for c in FIELDS)
    lowered = " || ".join(field.format(text if c == "text" else c) for c in FIELDS)
    bits = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte))"
    crc = f"xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, byte: {bits}, 4294967295::BIGINT))"
    steps = []
    for k in range(levels):
        steps.append(f"SELECT d.id, s.level AS nth, lft, rgt FROM ranks d JOIN t_steps s ON s.level = {k} AND s.grp = d.grp AND s.r = d.r // {fan**k}")
    for k in range(top_levels):
        steps.append(f"SELECT d.id, {levels} + s.level AS nth, lft, rgt FROM ranks d JOIN tops p ON p.name = d.grp JOIN u_steps s ON s.level = {k} AND s.r = p.r // {fan**k}")
    union = "\nUNION ALL ".join(steps)
    return f"""
WITH leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '-') AS grp, sha256({joined}) AS h,
    CASE WHEN {crc} % 5 = 0 THEN sha256({lowered}) END AS altered FROM documents),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_oracle_tree("t", "ranks", fan, levels)},
{_oracle_steps("t", fan, levels)},
tops AS (SELECT '' AS grp, grp AS name, row_number() OVER (ORDER BY grp) - 1 AS r, count(*) OVER () AS n, h FROM t{levels}),
{_oracle_tree("u", "tops", fan, top_levels)},
{_oracle_steps("u", fan, top_levels)},
steps AS ({union}),
proofs AS (SELECT id, string_agg(lft || rgt, '' ORDER BY nth) AS proof, list(lft || ':' || rgt ORDER BY nth) AS all_steps FROM steps GROUP BY id),
folded AS (
  SELECT doc_id, d.h AS leaf, p.h AS subroot, (SELECT h FROM u{top_levels}) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(coalesce(all_steps, []), lambda x, step: sha256(split_part(step, ':', 1) || x || split_part(step, ':', 2)), coalesce(altered, d.h)) AS folded_root
  FROM ranks d LEFT JOIN proofs USING (id) JOIN tops p ON p.name = d.grp)
SELECT *, folded_root = root AS verified FROM folded"""
