"""The Merkle manifest against trees built by hand."""

import hashlib
import random
import zlib

import pytest

from loomlog.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, proof int, _key string, c0 string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """(root, siblings as (left, right) by level for each node)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(paths)):
            run, k = nodes[at[i] // 3 * 3 : at[i] // 3 * 3 + 3], at[i] % 3
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            at[i] //= 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[3] is None else "=" + r[3], []).append(r)
    keys = sorted(groups, key=str.encode)
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
    subs = [tree([leaf_of(r, r[1]) for r in groups[k]]) for k in keys]
    root, up = tree([s[0] for s in subs])
    out = []
    for k, (sub, paths), above in zip(keys, subs, up, strict=True):
        for r, path in zip(groups[k], paths, strict=True):
            whole = path + above
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node = leaf_of(r, text)
            for a, b in whole:
                node = h(a, node, b)
            out.append((r[0], leaf_of(r, r[1]), sub, root, h(*[a + b for a, b in whole]), node, node == root))
    return sorted(out, key=str)


def row(i, text, source, lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "x", 1, "y", "z")


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle(spark, str(tmp_path)).collect()
    return sorted([tuple(r) for r in got], key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [4], [1, 1], [10, 1, 28, 2, 3, 9, 82]])
def test_trees_of_all_shapes(spark, tmp_path, sizes):
    rng = random.Random(len(sizes))
    ids = rng.sample(range(10_000), sum(sizes))
    rows = [row(ids.pop(), "a\nb" * rng.randint(0, 3), f"s{k}") for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(rows)
    assert query(spark, tmp_path, rows) == by_hand(rows)


def test_nulls_repeats_long_texts_and_source_order(spark, tmp_path):
    rows = [row(None, None, None), row(None, "a\nb", None), row(7, "\n", ""), row(7, "\n", ""), row(7, "x", ""), row(-5, "é\nü", "Z"), row(3, "日本", "a", None), row(4, "y" * 3_000_000 + "\n", "é"), row(9, "", "a")]
    assert query(spark, tmp_path, rows) == by_hand(rows)


def test_a_hot_source_and_equal_rows_are_spread_over_partitions(spark, tmp_path):
    rows = [row(5, "same\ntext", "hot") for _ in range(300)] + [row(i, f"t\n{i}", "hot") for i in range(200)] + [row(i, "c", f"s{i}") for i in range(20)]
    assert query(spark, tmp_path, rows) == by_hand(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_manifest_keeps_columns_and_gives_siblings(spark):
    leaves = spark.createDataFrame([(i, "g" if i < 5 else None, h(str(i)), i * 2) for i in range(9)], "doc_id long, source string, leaf string, _idx int")
    got = {r.doc_id: r for r in merkle.manifest(leaves).collect()}
    low, paths = tree([h(str(i)) for i in range(5)])
    other, _ = tree([h(str(i)) for i in range(5, 9)])
    assert got[3].subroot == low and got[8].subroot == other and got[3].root == h(other, low) and got[3]._idx == 6
    assert [tuple(p) for p in got[3].proof] == [*paths[3], (other, "")]


def test_sql_on_nulls_and_ties(spark, duck, tmp_path):
    rows = [row(None, "a\n", None), row(2, None, "b"), row(2, "q\n", "b"), row(3, "z\nz", "b"), row(11, "z\nz", "b"), row(12, "z", "c")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    sql = merkle.oracle().replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted([tuple(r) for r in merkle.op12_merkle(spark, str(tmp_path)).collect()], key=str) == sorted(duck.execute(sql).fetchall(), key=str)
