import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from waymark.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    values = [None if v is None else str(v) for v in row]
    return sha(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(leaves, arity=16):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def steps(levels, at, arity=16):
    """(siblings left, siblings right) level by level."""
    for level in levels[:-1]:
        run = level[at - at % arity : at - at % arity + arity]
        yield run[: at % arity], run[at % arity + 1 :]
        at //= arity


def plain_rows(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree(map(plain_leaf, by[s]))
    top = plain_tree([trees[s][-1][0] for s in order])
    root = top[-1][0]
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            way = [*steps(trees[s], i), *steps(top, k)]
            node = plain_leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in way:
                node = sha(*left, node, *right)
            yield r[0], plain_leaf(r), trees[s][-1][0], root, sha(*(x for left, right in way for x in left + right)), node, node == root


def some_rows(n, seed=1):
    r = random.Random(seed)
    sources = [None, "", "a", "A", "é", "日", "=x", *["hot"] * 9]
    texts = ["", None, "Some TEXT", "no capitals", "É Ü ÀB", "x" * 9000 + "Y"]
    rows = [(i, r.choice(sources), r.choice(["en", None]), r.randint(0, 9) or None, r.choice(texts)) for i in range(n)]
    if n > 20:
        rows += [rows[3], rows[3], (None, "a", None, None, None), (None, "a", "x", 1, "T"), (7, "hot", "y", 2, "Z"), (8, "alone", "y", 2, "Zz")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [1, 2, 16, 17, 700])
@pytest.mark.parametrize("fewest", [3, 100, 10_000])
def test_rows_equal_plain_trees(spark, tmp_path, monkeypatch, n, fewest):
    monkeypatch.setattr(merkle, "FEWEST", fewest)
    monkeypatch.setattr(merkle, "MOST", max(fewest, 20))
    rows = some_rows(n)
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.op11_merkle(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(plain_rows(rows), key=str)


def test_merging_is_associative():
    r = random.Random(5)
    for n in (1, 2, 16, 17, 255, 300, 4097):
        leaves = [r.randbytes(32) for _ in range(n)]
        want = plain_tree([d.hex() for d in leaves])[-1][0]
        cut = sorted({0, n, *r.choices(range(n), k=6)})
        parts = [merkle.resolve({(0, i): leaves[i] for i in range(a, b)}, n)[0] for a, b in zip(cut, cut[1:], strict=False)]
        assert all(len(p) <= 100 for p in parts)
        r.shuffle(parts)
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i : i + 2] = [merkle.resolve(parts[i] | parts[i + 1], n)[0]]
        assert [d.hex() for d in parts[0].values()] == [want]


def test_proofs_can_be_checked_alone(spark):
    rows = [(i, "a.b" if i % 3 else "c", f"text {i}", b"old") for i in range(60)]
    docs = spark.createDataFrame(rows, "`the.id` long, source string, text string, leaf binary")
    got = merkle.manifest(docs, ["the.id", "text"], order="the.id", keep=["the.id", "source", "leaf"], arity=4).orderBy("`the.id`").collect()
    assert got[0].asDict().keys() == {"the.id", "source", "leaf", "subroot", "root", "proof", "folded_root"}
    own = [r for r in got if r.source == "c"]  # 20 leaves: runs of 4 of 5 of 2, then one of 2 of the sources
    for i, r in enumerate(own):
        shape = [(4, i % 4), (4 if i < 16 else 1, i // 4 % 4), (2, i // 16), (2, 1)]
        assert merkle.verified(r.leaf, r.proof, shape, r.root) and r.folded_root == r.root
        assert not merkle.verified(own[i - 1].leaf, r.proof, shape, r.root)
        assert not merkle.verified(r.leaf, r.proof + b"x" * 32, shape, r.root)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, text string"), ["text"]).collect() == []


def test_query_equals_sql(spark):
    from tests import oracle
    from waymark.llm import queries

    sf = "/root/testdata/sf0.01"
    assert oracle.differences(merkle.op11_merkle(spark, sf), oracle.connect(sf), queries.ORACLE["op11_merkle"]) == ""
