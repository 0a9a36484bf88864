"""The Merkle manifest against a tree built in one piece."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sedge.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Levels from the leaves to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, i, node):
    """(siblings, node at the top) of leaf i if it were ``node``."""
    siblings = []
    for nodes in levels[:-1]:
        run, at = nodes[i - i % 8 : i - i % 8 + 8], i % 8
        siblings += run[:at] + run[at + 1 :]
        node = h(*run[:at], node, *run[at + 1 :])
        i //= 8
    return siblings, node


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for g in names}
    trees = {g: tree([leaf(r, r[1]) for r in order[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    root = top[-1][0]
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(order[g]):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            inner, node = climb(trees[g], i, leaf(r, text))
            outer, folded = climb(top, at, node)
            out.append((r[0], leaf(r, r[1]), trees[g][-1][0], root, h(*inner, *outer), folded, folded == root))
    return sorted(out, key=str)


def rows(n, langs, seed=1):
    rng = random.Random(seed)
    made = [(i, rng.choice(["Some Text é", "low", "漢字 A", "", None, "X" * 5000]), rng.choice(langs), rng.choice(["web", None, ""]), rng.choice([None, 7, -1])) for i in range(n)]
    return made + [made[-1], made[-1], (None, "Null Id", langs[0], None, 1), (None, None, None, None, None)]


def altered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))


@pytest.mark.parametrize(("n", "langs", "height"), [(700, ["en", "de", None, "", "é", "en "], 1), (90, [f"l{i:02}" for i in range(40)], 1)])
def test_proofs(spark, n, langs, height):
    made = rows(n, langs)
    found = merkle.proofs(spark.createDataFrame(made, DDL), claimed={"text": altered()}, height=height)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, h(r.path), r.folded_root, r.folded_root == r.root) for r in found.collect()]
    assert sorted(got, key=str) == brute(made)


def test_manifest_columns_clash_and_empty(spark):
    made = rows(20, ["en", None])
    names = f"{DDL}, part string, Pos long, node string, block string, claimed string"
    out = merkle.manifest(spark.createDataFrame([(*r, "a", 1, "b", "c", "d") for r in made], names))
    assert out.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r)[:7] for r in out.collect()], key=str) == brute(made)
    empty = merkle.manifest(spark.createDataFrame([], DDL))
    assert empty.count() == 0 and empty.columns == out.columns


def test_any_change_of_a_field_shows(spark):
    docs = spark.createDataFrame(rows(30, ["en"]), DDL)
    root = merkle.proofs(docs).first().root
    assert merkle.proofs(docs).where("folded_root <> root").count() == 0
    assert merkle.proofs(docs.withColumn("n_chars", F.expr("if(doc_id = 3, 9, n_chars)"))).first().root != root
    # Length prefixes keep fields apart.
    assert merkle.proofs(docs.withColumn("source", F.lit("ab")).withColumn("lang", F.lit("c"))).first().root != merkle.proofs(docs.withColumn("source", F.lit("a")).withColumn("lang", F.lit("bc"))).first().root


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 511, 513, 4096])
def test_traversal_is_logarithmic(n, monkeypatch):
    leaves = [f"{i:064x}".encode() for i in range(n)]
    levels = tree([x.decode() for x in leaves])
    made, late = [], []
    begin, finish = merkle.Treehash.__init__, merkle.Treehash.finish
    monkeypatch.setattr(merkle.Treehash, "__init__", lambda self, *a: (begin(self, *a), made.append(self))[0])
    monkeypatch.setattr(merkle.Treehash, "finish", lambda self: (late.append(not self.done()), finish(self))[1])
    height, most = merkle.steps(n), 0
    for i, path in enumerate(merkle.traverse(leaves, height)):
        assert path.decode() == "".join(climb(levels, i, "")[0])
        live = made[-2 * height - 1 :] if height else []
        most = max([most, *(sum(map(len, t.waiting)) for t in live)])
    assert most <= 7 * height and not any(late[height:])  # all later runs were ready in time


def test_a_hot_group_spreads(spark, monkeypatch):
    """Two thirds null ids and one text in one group: no range holds much more than its share."""
    staged = []
    stage = merkle.common.stage
    monkeypatch.setattr(merkle.common, "stage", lambda df, name: (staged.append(stage(df, name)), staged[-1])[1])
    monkeypatch.setattr(merkle, "RANGE_BYTES", 500)  # a number of ranges, which adaptive execution leaves alone
    made = spark.range(3000).selectExpr("'=en' part", "if(id % 3 = 0, id, null) doc_id", "unhex('00') node")
    numbered = merkle._numbered(merkle.common.keyed(made, "row"), "doc_id", "node", "row")
    assert sorted(r.pos for r in numbered.select("pos").collect()) == list(range(3000))
    ranges = staged[-1].groupBy(F.shiftright("seq", 33)).count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 1500
