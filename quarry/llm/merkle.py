"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups' roots.

A node is the SHA-256 (lower-case hex) of the hex texts of the two nodes below it; the last
node of a level may stand alone and is hashed alone. Groups are ordered bytewise (null
first), rows by id, equal ids by leaf.

1. Rows take their place in their group by range partitions (`quarry.operators.order`), so a
   group that holds most rows is spread.
2. Blocks of 2**bits rows are reduced in tasks of their own. What remains of a tree with
   several blocks is a small top tree: at most about 2**TOP_BITS nodes for all trees together.
3. The driver builds the top trees and broadcasts them; executors append the rest of each
   row's path and fold rows up to the root.

A path is bytes: for each level 0 (alone), or 1 or 2 (sibling on the right or left) and the
sibling's 32 bytes. Only ids and digests are shuffled. Defined cases: a null field is `-`; a
table without rows has no manifest rows; a lone leaf is its group's root; rows that repeat
have equal leaves and a place each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Shipped, crc_sql, stored
from quarry.operators.order import numbered
from quarry.operators.retrieve import small

LEAST_BITS, TOP_BITS = 8, 17
#: Rows given on at once.
_ROWS = 4096


def leaf(*fields: Column) -> Column:
    """Hash of a row's fields: each `-` if null, else its UTF-8 byte count, a colon and its text."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.encode(F.concat(*[one(c.cast("string")) for c in fields]), "utf-8"), 256)


def _above(level: list[str]) -> list[str]:
    return [sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]


def levels_of(nodes: list[str], least: int = 0) -> list[list[str]]:
    """All levels from the nodes to the one that remains; at least so many reductions are made."""
    out = [nodes]
    while len(out[-1]) > 1 or len(out) <= least:
        out.append(_above(out[-1]))
    return out


def path_of(raw: list[list[bytes]], i: int) -> bytes:
    """The path of node i through the levels below the last one."""
    out = []
    for level in raw[:-1]:
        other = i ^ 1
        out.append((b"\x01" if other > i else b"\x02") + level[other] if other < len(level) else b"\x00")
        i >>= 1
    return b"".join(out)


def siblings(path: bytes) -> Iterator[tuple[int, str]]:
    """Side and hex digest ('' without a sibling) for each level."""
    at = 0
    while at < len(path):
        side = path[at]
        yield side, path[at + 1 : at + 33].hex() if side else ""
        at += 33 if side else 1


def fold(node: str, path: bytes) -> str:
    """The root that a node and its path lead to."""
    for side, other in siblings(path):
        node = sha256((other + node if side == 2 else node + other).encode()).hexdigest()
    return node


def _raw(levels: list[list[str]]) -> list[list[bytes]]:
    return [list(map(bytes.fromhex, x)) for x in levels]


def _reducer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            several = table.column("size")[0].as_py() > 1 << bits
            levels = levels_of(table.column("leaf").to_pylist(), bits if several else 0)
            raw, root = _raw(levels), levels[-1][0]
            for i in range(0, table.num_rows, _ROWS):
                part = table.slice(i, _ROWS).combine_chunks().to_batches()[0]
                paths = [path_of(raw, j) for j in range(i, i + part.num_rows)]
                columns = [*part.columns, pa.array(paths, pa.binary()), pa.array([root] * part.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "path", "top"])

        for b in batches:
            begins = np.flatnonzero(b.column("pos").to_numpy() % (1 << bits) == 0).tolist()
            for start, end in zip([0, *begins], [*begins, b.num_rows], strict=True):
                if start in begins and held:
                    yield from done()
                    held = []
                if end > start:
                    held.append(b.slice(start, end - start))
        if held:
            yield from done()

    return run


def _tops(blocks: DataFrame) -> dict[str, tuple[list[list[bytes]], str]]:
    """Levels and root of the top tree of each tree with several blocks."""
    found: dict[str, dict[int, str]] = {}
    for r in blocks.collect():
        found.setdefault(r["tree"], {})[r["block"]] = r["top"]
    built = {t: levels_of([x[b] for b in sorted(x)]) for t, x in found.items()}
    return {t: (_raw(x), x[-1][0]) for t, x in built.items()}


def prove(nodes: DataFrame, order: list[str], bits: int | None = None) -> tuple[DataFrame, Shipped]:
    """nodes (tree, leaf, ...) with size, block, path and top: paths to the block's root; and the top trees.

    nodes must be stored. bits: rows of a block as a power of two; by default so many that the top trees stay small.
    """
    n = nodes.count()
    bits = max(LEAST_BITS, max(n - 1, 1).bit_length() - TOP_BITS) if bits is None else bits
    placed = numbered(nodes, order, ["tree"], "pos", "size").withColumn("block", F.shiftright("pos", bits))
    dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    made = stored(dealt.mapInArrow(_reducer(bits), f"{kinds}, path binary, top string"), "merkle")
    blocks = made.where((F.col("size") > 1 << bits) & (F.col("pos") % (1 << bits) == 0)).select("tree", "block", "top")
    return made, Shipped(nodes.sparkSession, _tops(blocks))


def _finisher(tops: Shipped, names: list[str]):
    """Whole paths and roots of rows whose paths end at their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tops.value
        for b in batches:
            paths, roots = [], []
            for tree, block, path, top in zip(*[b.column(c).to_pylist() for c in ("tree", "block", "path", "top")], strict=True):
                raw, root = known.get(tree, (None, top))
                paths.append(path + path_of(raw, block) if raw else path)
                roots.append(root)
            kept = [b.column(c) for c in names if c not in ("path", "top")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(paths, pa.binary()), pa.array(roots, pa.string())], [*[c for c in names if c not in ("path", "top")], "path", "top"])

    return run


def _finished(made: DataFrame, tops: Shipped) -> DataFrame:
    names = [c for c in made.columns if c not in ("path", "top")]
    kinds = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in names)
    return made.mapInArrow(_finisher(tops, made.columns), f"{kinds}, path binary, top string")


def manifest(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """rows (id, tree, leaf, ...) with subroot, root and path, from the leaf to the root over all trees.

    tree is a string without nulls whose order is that of the groups.
    """
    made, tops = prove(stored(rows, "leaves"), ["id", "leaf"], bits)
    firsts = _finished(made.where("pos = 0"), tops).select("tree", F.col("top").alias("leaf"))
    groups, over = prove(stored(firsts.withColumns({"group": F.col("tree"), "tree": F.lit("")}), "subroots"), ["group"], bits)
    ends = _finished(groups, over).select(F.col("group").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("rest"), F.col("top").alias("root"))
    out = _finished(made, tops).drop("top", "pos", "size", "block").join(F.broadcast(ends) if small(ends) else ends, "tree")
    return out.withColumn("path", F.concat("path", "rest")).drop("rest")


def verify(proven: DataFrame, claimed: str = "leaf") -> DataFrame:
    """proven with proof_sha256 (of the siblings, in order), folded_root (from the claimed leaf) and verified."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proven.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            proofs = [sha256("".join([x for _, x in siblings(p)]).encode()).hexdigest() for p in paths]
            folded = [fold(x, p) for x, p in zip(b.column(claimed).to_pylist(), paths, strict=True)]
            right = [x == y for x, y in zip(folded, b.column("root").to_pylist(), strict=True)]
            columns = [*b.columns, pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(right, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "proof_sha256", "folded_root", "verified"])

    return proven.mapInArrow(run, f"{kinds}, proof_sha256 string, folded_root string, verified boolean")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_rows(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, claimed) of documents: claimed is the leaf with some fields replaced."""
    now = {c: F.col(c) for c in FIELDS}
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("lang")))
    return docs.select(F.col("doc_id").alias("id"), tree.alias("tree"), leaf(*now.values()).alias("leaf"), leaf(*(now | (claimed or {})).values()).alias("claimed"))


def tampered(docs: DataFrame) -> dict[str, Column]:
    """One added to n_chars where 7 divides the checksum of the id's decimal text; nulls stay."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))}


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: Levels of all trees of `base` (tree, idx, h, n): the rows of a level are reduced by pairs until one is left.
def _levels_sql(base: str) -> str:
    return f"""SELECT tree, 0 AS lv, idx, h, n FROM {base}
UNION ALL SELECT tree, lv + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, lv, n, idx // 2"""


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS tree, {_leaf_sql('n_chars')} AS leaf,
  {_leaf_sql('(n_chars + CASE WHEN ' + crc_sql('CAST(doc_id AS VARCHAR)') + ' % 7 = 0 THEN 1 ELSE 0 END)')} AS claimed FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM d WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),
one AS MATERIALIZED (WITH RECURSIVE t AS ({_levels_sql('r')}) SELECT * FROM t),
s AS MATERIALIZED (SELECT '' AS tree, tree AS grp, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM one WHERE n = 1),
two AS MATERIALIZED (WITH RECURSIVE t AS ({_levels_sql('s')}) SELECT * FROM t),
steps AS (SELECT r.tree, r.idx, lv, r.idx // (1 << lv) AS at, a.h AS other, a.idx AS place FROM r JOIN one AS a ON a.tree = r.tree AND a.n > 1 AND a.idx = xor(r.idx // (1 << lv), 1)
  UNION ALL SELECT r.tree, r.idx, 100 + lv, s.idx // (1 << lv), a.h, a.idx FROM r JOIN s ON s.grp = r.tree JOIN two AS a ON a.n > 1 AND a.idx = xor(s.idx // (1 << lv), 1)),
depth AS (SELECT r.tree, r.idx, lv FROM r JOIN (SELECT DISTINCT tree, lv FROM one WHERE n > 1) AS o ON o.tree = r.tree UNION ALL SELECT r.tree, r.idx, 100 + lv FROM r, (SELECT DISTINCT lv FROM two WHERE n > 1)),
walk AS MATERIALIZED (SELECT d.tree, d.idx, row_number() OVER (PARTITION BY d.tree, d.idx ORDER BY d.lv) AS k, s.other, s.place < s.at AS on_left FROM depth AS d LEFT JOIN steps AS s ON s.tree = d.tree AND s.idx = d.idx AND s.lv = d.lv),
f AS (SELECT tree, idx, CAST(1 AS BIGINT) AS k, claimed AS h FROM r UNION ALL SELECT f.tree, f.idx, f.k + 1, sha256(CASE WHEN w.other IS NULL THEN f.h WHEN w.on_left THEN w.other || f.h ELSE f.h || w.other END) FROM f JOIN walk AS w ON w.tree = f.tree AND w.idx = f.idx AND w.k = f.k),
g AS (SELECT tree, idx, arg_max(h, k) AS folded_root FROM f GROUP BY ALL),
p AS (SELECT tree, idx, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof_sha256 FROM walk GROUP BY ALL)
SELECT r.doc_id, r.leaf, s.h AS subroot, e.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, g.folded_root, g.folded_root = e.h AS verified
FROM r JOIN s ON s.grp = r.tree JOIN (SELECT h FROM two WHERE n = 1) AS e ON true JOIN g ON g.tree = r.tree AND g.idx = r.idx LEFT JOIN p ON p.tree = r.tree AND p.idx = r.idx
"""
