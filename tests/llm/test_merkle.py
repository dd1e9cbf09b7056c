"""The Merkle manifest against a plain tree, with blocks of any size, and its edge cases."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and for each node its siblings as (side, hash) and the levels where it stood alone as (0, '')."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((0, "") if (i ^ 1) >= len(nodes) else (1 if i ^ 1 > i else 2, nodes[i ^ 1]))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row of documents, by loops; a list, since rows may repeat."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: h(field(i), field(source), field(lang), field(n), field(text))
    groups = {}
    for i, text, lang, source, n in rows:
        changed = n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups.setdefault(lang, []).append((i, leaf(i, text, lang, source, n), leaf(i, text, lang, source, changed)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[g] = plain_tree([r[1] for r in groups[g]])
    if not order:
        return []
    root, over = plain_tree([built[g][0] for g in order])
    out = []
    for g, rest in zip(order, over, strict=True):
        for (i, first, claimed), path in zip(groups[g], built[g][1], strict=True):
            whole, node = path + rest, claimed
            for side, other in whole:
                node = h(other, node) if side == 2 else h(node, other)
            out.append((i, first, built[g][0], root, h(*[x for _, x in whole]), node, node == root))
    return out


def found(df, bits=None):
    got = merkle.verify(merkle.manifest(merkle.document_rows(df, merkle.tampered(df)), bits), "claimed")
    return sorted(map(str, map(tuple, got.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("id", "tree", "leaf", "claimed", "path", "top", "root", "pos", "size", "block", "position", "_part")})


@pytest.mark.parametrize(("n", "bits"), [(1, 1), (3, 1), (64, 3), (91, 1), (200, None)])
def test_any_block_size_gives_the_plain_tree(spark, n, bits):
    rng = random.Random(n)
    rows = [(rng.randrange(10 * n), f"text {k}", rng.choice(["en"] * 6 + ["de", None]), "s", k) for k in range(n)]
    assert found(table(spark, rows), bits) == sorted(map(str, plain(rows)))


EDGES = [
    (1, "one", "en", "s", 3), (1, "one", "en", "s", 3), (1, "other text", "en", None, None), (None, "no id", "en", "s", 5), (None, None, None, None, None),
    (2, "", "", "", 0), (3, "é日本𝄞\n\x00", "zz", "s", -5), (4, "word " * 200_000, "Z", "s", 2**63 - 1), (7, "x", "é", "s", 1), (-8, "y", "en", "s", 2**63 - 1),
]


def test_edges(spark):
    assert found(table(spark, EDGES)) == sorted(map(str, plain(EDGES)))
    assert found(table(spark, EDGES), 1) == sorted(map(str, plain(EDGES)))
    assert found(table(spark, EDGES).limit(0)) == []


def test_many_groups(spark):
    """More groups than rows in most of them: the tree over the groups is cut into blocks too."""
    rows = [(k, "t", f"g{k % 150}", "s", k) for k in range(400)]
    assert found(table(spark, rows), 2) == sorted(map(str, plain(rows)))


def test_any_change_is_told(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(40)]
    df = table(spark, rows)
    other = merkle.document_rows(df, {"text": F.when(F.col("doc_id") == 11, F.lit("forged")).otherwise(F.col("text"))})
    got = merkle.verify(merkle.manifest(other, 2), "claimed")
    assert [r["id"] for r in got.where("NOT verified").collect()] == [11]
