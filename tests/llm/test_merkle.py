"""The Merkle manifest against a plain recursion over sorted rows."""

import hashlib
import zlib

import pytest

from rubricon.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest binary, block int, id int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Rows of a tree from its leaves to its root."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i:i + 8])) for i in range(0, len(rows[-1]), 8)])
    return rows


def way(rows, at):
    out = []
    for row in rows[:-1]:
        start = at // 8 * 8
        out.append(("".join(row[start:at]), "".join(row[at + 1:start + 8])))
        at //= 8
    return out


def brute(records):
    """Multiset of ``(doc_id, leaf, subroot, root, proof, folded, verified)``."""
    trees = {}
    for r in records:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in order:
        rs = sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        built[t] = rs, climb([leaf(r[0], r[3], r[2], r[4], r[1]) for r in rs])
    top = climb([built[t][1][-1][0] for t in order])
    out = []
    for i, t in enumerate(order):
        rs, rows = built[t]
        for j, (d, text, lang, source, n, *_) in enumerate(rs):
            path = way(rows, j) + way(top, i)
            node = rows[0][j]
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None:
                node = leaf(d, source, lang, n, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            for before, after in path:
                node = sha(before + node + after)
            out.append((d, rows[0][j], rows[-1][0], top[-1][0], sha("".join(b + a for b, a in path)), node, node == top[-1][0]))
    return sorted(map(repr, out))


def run(spark, records, parts=3):
    docs = spark.createDataFrame(records, SCHEMA).repartition(parts)
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in got.collect())


def rec(i, text, lang, source="s"):
    return (i, text, lang, source, len(text or ""), "t", 5, b"x", 1, 2)


def test_against_recursion(spark):
    langs = ["en"] * 6 + ["fr", "Zz", "é", None, ""]
    records = [rec(7 * i - 300, f"Text Ä {i}" if i % 5 else None, langs[i % 11], "src" if i % 4 else None) for i in range(1900)]
    records += [rec(None, "no id", "en"), rec(None, "No id", "en"), rec(10 ** 12, "", "solo"), rec(3, "A" * 400_000, "en")]
    records += [records[5]] * 40 + [rec(7, "other text, same id", "en")]
    got = run(spark, records)
    assert got == brute(records)
    assert 0 < sum("False" in r for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513])
def test_borders_of_runs_and_superblocks(spark, n):
    records = [rec(i, f"T{i}", "en") for i in range(n)]
    assert run(spark, records) == brute(records)


def test_many_trees(spark):
    records = [rec(i, f"T{i}", f"l{i % 600:03d}") for i in range(1300)]
    assert run(spark, records) == brute(records)


def test_hot_key(spark):
    records = [rec(4, "Same", "en")] * 1200
    assert run(spark, records, 5) == brute(records)


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_fold_to_the_root(spark):
    docs = spark.createDataFrame([rec(i, f"T{i}", "en" if i % 3 else "fr") for i in range(100)], SCHEMA)
    for r in merkle.manifest(docs).collect():
        node, at = r["leaf"], 0
        for before, after in zip(r["places"][::2], r["places"][1::2]):
            part = r["proof"][64 * at:64 * (at + before + after)]
            node, at = sha(part[:64 * before] + node + part[64 * before:]), at + before + after
        assert node == r["root"] == r["folded_root"] and 64 * at == len(r["proof"])
