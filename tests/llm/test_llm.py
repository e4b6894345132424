"""Corpus operators against brute force on a small fixture with nulls, empty and long texts, ties,
repeated rows and clashing extra columns."""

import base64
import contextlib
import hashlib
import pathlib
import random
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rubricon.llm import byte_bpe, embed_join, licenses, line_dedup, minhash, packing, pitman_yor, quality, simhash, toxicity, wordgrams
from rubricon.llm.chunks import Encoder
from rubricon.llm.common import components
from rubricon.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from rubricon.session import checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, start int, node int, piece string"


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma,", "Tau.", "éta"]) + str(rnd.randrange(30)) for _ in range(n))


def rows():
    rnd = random.Random(4)
    passage = "\n".join(words(rnd, 20) for _ in range(3))
    texts = [words(rnd, rnd.randrange(1, 200)) for _ in range(40)]
    texts += [None, "", "   ", "one", passage, "intro " + words(rnd, 10) + "\n" + passage + "\n" + words(rnd, 10), texts[0], texts[0],
              "\n".join(["same line again here"] * 40), "x" * 5000, words(rnd, 6000), "a　b \x1c<|endoftext|>\r\n\tÉ漢🙂",
              "Foo. Released under the MIT License.\nbar", texts[3] + " extra"]
    out = [(i, t, "en", "s", len(t or ""), "h", 1, 2, "p") for i, t in enumerate(texts)]
    out += [out[1], out[1], (None, "no id " + words(rnd, 5), None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by_label, by_root = defaultdict(set), defaultdict(set)
    for r in got:
        by_label[r["label"]].add(r["node"])
    for x in {x for e in edges if e[0] != e[1] for x in e}:
        by_root[find(x)].add(x)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, WORD_VOCABULARY).collect()
    t = Tokenizer.from_file(WORD_VOCABULARY)
    want = Counter()
    for r in rows():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for i in range(0, len(ids), 4 * 2048):
            want[(r[0], i // 4, ids[i:i + 4 * 2048])] += 1
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got) == want
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(none, WORD_VOCABULARY).count() == 0


def test_packing_plan_uses_every_piece():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 50, 20_000):
        counts = np.bincount(rnd.integers(1, 513, n), minlength=513)
        used = np.zeros(513, np.int64)
        patterns = packing.plan(counts)
        for pattern, times in patterns:
            assert sum(pattern) <= 512
            used += times * np.bincount(pattern, minlength=513)
        assert (used == counts).all()
    total = sum(times for _, times in patterns)
    assert (counts * np.arange(513)).sum() / 512 / total > 0.98


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    data = rows()
    prints = [brute_fingerprint(r[1]) for r in data]
    label = list(range(len(data)))
    for _ in data:
        for i, a in enumerate(prints):
            label[i] = min(label[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    first = {k: min((data[i][0] for i in range(len(data)) if label[i] == k and data[i][0] is not None), default=None) for k in set(label)}
    want = Counter((r[0], p, first[k]) for r, p, k in zip(data, prints, label))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(k for k in first.values() if k is not None)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("max_bits", [0, 2, 4])
def test_simhash_links_lose_nothing(spark, max_bits):
    rnd = random.Random(max_bits)
    base = [rnd.getrandbits(64) for _ in range(10)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    label = {r["node"]: r["label"] for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits)).collect()}
    group = list(range(len(fps)))
    for _ in fps:
        group = [min(group[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= max_bits) for a in fps]
    for i, a in enumerate(signed):
        for j, b in enumerate(signed):
            assert (label.get(a, a) == label.get(b, b)) == (group[i] == group[j])


def test_simhash_segments_cover_all_bits():
    assert len(simhash.flip_masks(4, 1)) == 65
    with pytest.raises(ValueError):
        simhash.flip_masks(3, 1)


def labelled(spark, docs):
    """A fixture with clear labels: toxic words in some texts, junk in others."""
    rnd = random.Random(9)
    out, labels = [], []
    for i in range(240):
        toxic, junk = i % 5 == 0, i % 7 == 0
        w = words(rnd, 60).split()
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zorgblat", "quuxfest", "zorgblatter"]))
        out.append((1000 + i, " ".join(x + "@@#$%" if junk else x for x in w), "en", "s", 1, "h", 1, 2, "p"))
        labels.append((1000 + i, int(not junk), int(toxic)))
    every = spark.createDataFrame(out, SCHEMA).unionByName(docs)
    return every, spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, none):
    every, labels = labelled(spark, docs)
    model = toxicity.train(every, labels, ~toxicity.held_out())
    got = toxicity.score(every, model).collect()
    assert len(got) == every.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in got if r["doc_id"] in truth and truth[r["doc_id"]] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held)
    assert len(held) > 30 and right / len(held) > 0.9
    kept = toxicity.keep_ordinary(every, model)
    assert kept.columns == every.columns
    assert kept.count() == sum(r["score"] < toxicity.THRESHOLD for r in got)
    assert toxicity.score(none, model).count() == 0
    untrained = toxicity.train(every, labels.where("false"), F.lit(True))
    assert {r["score"] for r in toxicity.score(every, untrained).collect()} == {0.0}


def test_quality(spark, docs, none):
    every, labels = labelled(spark, docs)
    fitted = quality.train(every, labels)
    got = quality.classify(every, fitted).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[d] == bool(q) for d, q in truth.items() if d is not None and q is not None and d >= 1000)
    assert all(r["perplexity"] is None and r["kept"] for r in got if r["doc_id"] in (40, 41, 42))
    left = quality.keep_good(every, fitted)
    assert left.columns == every.columns and left.count() == sum(r["kept"] for r in got)
    assert quality.classify(none, fitted).count() == 0
    nothing = quality.train(every, labels.where("false"))
    assert quality.keep_good(every, nothing).count() == every.count() == quality.classify(every, nothing).where("kept").count()


def limits(docs, fitted):
    """Threshold of each language; None: the pooled one."""
    return {r["lang"]: r["threshold"] for r in quality.thresholds(quality.classify(docs, fitted), fitted).collect()}


def test_word_order_counts(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["north wind", "green apple", "slow river"]) for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    fitted = quality.train(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    salad = " ".join(["apple wind river north slow green"] * 13)
    ordered, mixed = fitted.perplexities([texts[0], salad], fitted.scores())
    limit = limits(docs, fitted)["en"]
    assert mixed > 1.1 * ordered and mixed > limit >= ordered
    marked = [(i, t + (" slow apple" * 3 if i % 2 else " slow river green apple"), i % 2) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(marked, "doc_id long, text string, toxic int")
    model = toxicity.train(rows, rows, F.lit(True))
    together, apart = model.score(["slow apple " * 5, "slow river green apple " * 5], model.words())
    assert together > apart
    words = [w.encode() for w in "a bc def ghij klmno a p".split()]
    whole = b"\0" * 4 + b" ".join(words) + b" "
    keys = [int.from_bytes(whole[i:i + 5], "big") for i in range(len(whole) - 4)]
    pieces = [x for x in [*wordgrams.heads_of(words, 5), *(wordgrams.rest_of(w, 5) for w in words)] if x]
    assert sorted(wordgrams.keys_of(pieces, 5)[0].tolist()) == sorted(keys)             # every byte of the text once, in its place


def test_quality_thresholds_of_all_languages(spark, monkeypatch):
    rnd = random.Random(2)
    data = [(i, " ".join(rnd.choice("aeiou") * 2 + rnd.choice("rst" if i % 9 else "bcdfghjklm") for _ in range(30)), "en" if i % 9 else "fr") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    fitted = quality.train(docs, labels, max_rows=80)
    smallest = labels.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(80).collect()
    learnt = {r["doc_id"] for r in smallest if (r["h"] >> 20) % 4}
    got = [r for r in quality.classify(docs, fitted).collect() if r["doc_id"] not in learnt]     # also those outside the sample
    found = limits(docs, fitted)
    pooled = np.quantile([r["perplexity"] for r in got], quality.QUANTILE)
    for lang in ("en", "fr"):
        own = [r["perplexity"] for r in got if r["lang"] == lang]
        n, m = len(own), quality.MIN_ROWS
        want = quality.MARGIN * np.quantile(own, quality.QUANTILE) ** (n / (n + m)) * pooled ** (m / (n + m))
        assert found[lang] == pytest.approx(want)
    assert found[None] == pytest.approx(quality.MARGIN * pooled)
    monkeypatch.setattr(quality, "BRACKETED", 200)                      # ranks found between sketched ends
    monkeypatch.setattr(quality, "SKETCH", 100)
    assert limits(docs, fitted) == pytest.approx(found)


def test_quality_probabilities_sum_to_one(spark, docs):
    every, labels = labelled(spark, docs)
    model = quality.train(every, labels).model
    for context in (0, int.from_bytes(b"\0\0al", "big"), int.from_bytes(b"\0\0\0a", "big"), int.from_bytes(b"zzzz", "big")):
        assert model.prob((context << 8) | np.arange(256)).sum() == pytest.approx(1, abs=1e-4)


def test_minhash(docs, none):
    got = {r["doc_id"]: r for r in minhash.edited_likeness(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    data = sorted({r[0]: r for r in rows() if r[0] is not None}.values())
    words_of = lambda t: [w for w in re.split(r"[ \x09-\x0D]+", t.lower()) if w]

    def shingles(t):
        w = words_of(t)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    errors = []
    for r, after in zip(data, data[1:] + data[:1]):
        t, n = r[1] or "", after[1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        g = got[r[0]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, g["near_edited"]), (n, g["near_next"])):
            a, b = shingles(t), shingles(other)
            truth = len(a & b) / len(a | b) if a and b else float(not a and not b)
            assert 0 <= near <= 1
            errors.append(near - truth)
            if t == other:
                assert near == 1
    assert np.mean(np.abs(errors)) < 0.04 and abs(np.mean(errors)) < 0.02
    same = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(docs).collect()}
    assert same[0] == same[46] == same[47] and same[40] == same[41] == same[42] == "" and len(same[0]) == 2 * minhash.BINS
    assert minhash.edited_likeness(docs).count() == len(rows())
    assert minhash.edited_likeness(none).count() == 0


@pytest.mark.parametrize("tile", [embed_join.TILE, 40])
def test_embeddings(spark, tile):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((60, 16))
    many = [base[0] + rnd.standard_normal(16) * 0.12 for _ in range(150)]
    vectors = [*base, *many, *[base[1]] * 5, *(b + rnd.standard_normal(16) * 0.2 for b in base)]
    data = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    n = len(data)
    data += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0] * 15 + [None], 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [float("inf")] * 16, 0),
             (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [1.0, 2.0], 0), (None, data[0][1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = embed_join.near_duplicates(df, tile=tile).collect()
    assert len(got) == len(data)
    x = np.array([d[1] for d in data[:n]] + [data[0][1]], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    label = np.arange(n + 1)
    for _ in range(n):
        label = np.array([label[row].min() for row in linked])
    by_id = {r["vec_id"]: r for r in got}
    for i in range(n):
        r = by_id[i]
        assert (r["n_links"], r["component_id"], r["kept"]) == (linked[i].sum() - 1, label[i], label[i] == i)
    assert by_id[None]["component_id"] == label[0]
    for i in range(n, n + 6):
        assert (by_id[i]["n_links"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True)
    assert (by_id[n + 7]["n_links"], by_id[n + 7]["component_id"]) == (1, n + 6)
    assert embed_join.near_duplicates(df.limit(0)).count() == 0


def brute_links(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    label = np.arange(len(x))
    while True:
        low = np.where(linked, label[None, :], len(x)).min(axis=1)
        if (low == label).all():
            return linked.sum(axis=1) - 1, label
        label = low


def test_embeddings_over_many_blobs(spark):
    """Clusters wider than the threshold, repeated vectors in many places, and three lengths at once."""
    rnd = np.random.default_rng(11)
    tables = []
    for dim in (3, 32, 64):
        base = rnd.standard_normal((400, dim))
        wide = base[:20].repeat(20, axis=0) + rnd.standard_normal((400, dim)) * 0.2
        x = np.concatenate([base, wide, base[:50], base[:50], np.abs(rnd.standard_normal((30, 1))) * base[0]]).astype(np.float32)
        x[-1, dim // 2:] = 0
        tables.append(x[rnd.permutation(len(x))])
    data = [(1_000_000 * k + i, [float(c) for c in v], 0) for k, x in enumerate(tables) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(7)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_join.near_duplicates(df, tile=300).collect()}
    assert len(got) == len(data)
    for k, x in enumerate(tables):
        count, label = brute_links(x.astype(np.float64))
        assert [got[1_000_000 * k + i] for i in range(len(x))] == [(c, 1_000_000 * k + m, m == i) for i, (c, m) in enumerate(zip(count, label, strict=True))]


def test_embeddings_disk(spark, tmp_path):
    """Shuffled and staged bytes held at any time stay within four times those of the vectors, whatever the number of blobs."""
    def size(folder):
        total = 0
        for f in pathlib.Path(folder).rglob("*"):
            with contextlib.suppress(OSError):                  # a file may go meanwhile
                total += f.stat().st_size if f.is_file() else 0
        return total

    rnd = np.random.default_rng(12)
    x = rnd.standard_normal((30_000, 64)).astype(np.float32)
    x[6000:7000] = x[:1000] + rnd.standard_normal((1000, 64)).astype(np.float32) * np.float32(0.05)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x)})).write.option("parquet.enable.dictionary", "false").parquet(path)
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), checkpoint_dir(spark)]
    before, most, over = sum(map(size, folders)), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], sum(map(size, folders)))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = embed_join.near_duplicates(spark.read.parquet(path), tile=4000).agg({"n_links": "sum", "vec_id": "count"}).first()
    finally:
        over.set()
        watcher.join()
    assert got["count(vec_id)"] == len(x) and got["sum(n_links)"] == 2000
    assert most[0] - before < 4 * size(path), (most[0] - before, size(path))


def test_licenses(docs, none):
    got = licenses.scan(docs).collect()
    assert [(r["license"], r["start"], r["differing_words"]) for r in got] == [("MIT-notice", 5, 0)]
    made = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = licenses.scan_text(f"Some words before.\n{text}\nMore words.", made.longest, lambda b: licenses.found_in_block(b, made))
        assert name in {f[0] for f in found}, name
    changed = "Released under an MIT License."
    assert [f[0] for f in licenses.scan_text("We licensed the house. Copyright holders dance.", 90, lambda b: licenses.found_in_block(b, made))] == []
    assert all(f[4] > 0 for f in licenses.scan_text(changed, 90, lambda b: licenses.found_in_block(b, made)))
    assert licenses.scan(none).count() == 0


def test_licenses_are_told_apart():
    made = licenses.Templates(licenses.TEMPLATES)
    scan = lambda text, m=made: [r[0] for r in licenses.scan_text(text, m.longest, lambda b: licenses.found_in_block(b, m))]
    for name, text in licenses.TEMPLATES.items():                    # a license without its template is no other license
        assert scan(f"Intro.\n{text}\nEnd.") == [name]
        others = licenses.Templates({n: t for n, t in licenses.TEMPLATES.items() if n.removesuffix("-long") != name.removesuffix("-long")})
        assert scan(text, others) in ([], ["Apache-2.0-notice"] if name == "Apache-2.0" else [])
    header = licenses.TEMPLATES["LGPL-3.0-header"]
    assert scan(header.replace("This program", "This tool")) == ["LGPL-3.0-header"]
    assert scan(header.replace("version 3", "version 4")) == []
    assert scan("This work is licensed under a Creative Commons Attribution-ShareAlike 2.5 Generic License.") == []


def test_pitman_yor(docs, none, monkeypatch):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    got = pitman_yor.score(docs.withColumn("held", held), "held").collect()
    data = [(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1,
             re.findall(rb"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode()) + [b"\n"]) for r in rows()]
    count = Counter(w for _, h, t in data if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter((i, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(np.log10((count[w] + .5) / (n + .5 * (v + 1))) for w in t), 6)) for i, h, t in data)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    real = pitman_yor.score(docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held", held), "held").where("held_out").collect()
    assert sum(r["score"] for r in real) > sum(r["base_score"] for r in real)
    monkeypatch.setattr(pitman_yor, "BLOCK", 500)           # texts span blocks
    again = pitman_yor.score(docs.withColumn("held", held), "held").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 2)) for r in again) == Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 2)) for r in got)
    assert pitman_yor.score(none.withColumn("held", F.lit(False)), "held").count() == 0


def test_pitman_yor_is_a_distribution():
    known = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 30).astype(np.uint64))
    rnd = np.random.default_rng(1)
    pair = np.unique(rnd.integers(0, 30, 200) * pitman_yor.CONTEXTS + rnd.integers(0, 5, 200))
    pair = np.union1d(pair, np.arange(30) * pitman_yor.CONTEXTS)
    count = rnd.integers(1, 200, len(pair))
    x = pitman_yor.Shard(0, pitman_yor.pack_rising(known), pitman_yor.pack(pair.astype("<u8")), pitman_yor.pack(count.astype("<u8")))
    customers = np.bincount(x.ctx, x.count, pitman_yor.CONTEXTS).astype(np.int64)
    totals = pitman_yor.Totals(30, customers, np.bincount(x.ctx, minlength=pitman_yor.CONTEXTS), 0.6, 0.7)
    *_, (_, tables) = x.sweeps(totals, 1, 3)
    assert (tables >= 1).all() and (tables <= x.count).all()
    totals.tables.append(np.bincount(x.ctx, tables, pitman_yor.CONTEXTS).astype(np.int64))
    parent = totals.root_predictive(x.root_customers(tables), 1)
    assert parent.sum() + totals.unseen(1) == pytest.approx(1)
    for u in range(6):
        mine = x.ctx == u
        own = np.bincount(x.word[mine], (x.count - totals.d * tables)[mine], 30)
        back = (pitman_yor.STRENGTH + totals.d * totals.tables[1][u]) / (pitman_yor.STRENGTH + customers[u])
        assert (own / (pitman_yor.STRENGTH + customers[u]) + back * parent).sum() + back * totals.unseen(1) == pytest.approx(1)


def test_pitman_yor_context_is_the_whole_word(spark):
    texts = ["redab left", "blueab right"] * 20 + ["other words here", "left or right"]
    asked = ["redab left", "redab right", "redac left"]
    known = sorted({w for t in texts for w in t.split()})
    every = " ".join(f"redab {w}" for w in [*known, "never"]) + " redab"          # the last one stands before the end token
    data = [(i, t, False) for i, t in enumerate(texts)] + [(100 + i, t, True) for i, t in enumerate([*asked, every])]
    docs = spark.createDataFrame(data, "doc_id long, text string, held boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, "held").collect()}
    assert got[100] > got[101] + 0.3                # both contexts end alike, only one was ever followed by "left"
    table = pitman_yor.blocks_of(docs, "held", 8).where("shard >= 0").cache()
    shards = table.select("shard", "block", "words", "n_ctx", "keys", "ctx", "count").groupBy("shard").applyInPandas(pitman_yor.gather_shard, pitman_yor.SHARD_SCHEMA).cache()
    answers = {(r["block"], r["shard"]): pitman_yor.unpack(r["p"], "<f4") for r in pitman_yor.answer(shards, *pitman_yor.fit(shards)).collect()}
    key = pitman_yor.context_keys(np.array([xxhash.xxh64_intdigest(b"redab")], np.uint64), np.array([pitman_yor.class_of(b"redab")], np.uint64))[0]
    p = {}
    for r in table.collect():
        words, ctx = np.repeat(pitman_yor.unpack_rising(r["words"]), pitman_yor.unpack(r["n_ctx"], "<u4")), pitman_yor.unpack(r["keys"], "<u8")[pitman_yor.unpack(r["ctx"], "<u4")]
        p |= {w: v for w, c, v in zip(words.tolist(), ctx, answers[r["block"], r["shard"]].tolist(), strict=True) if c == key}
    assert len(p) == len(known) + 2 and sum(p.values()) == pytest.approx(1, abs=1e-5)


def brute_lines(data, least):
    windows = defaultdict(set)
    for key, text in data:
        lines = [(i, x.strip(" ")) for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        size = [x.count(" ") + 1 for _, x in lines]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(size[i:j + 1]) >= least:
                    windows[tuple(x for _, x in lines[i:j + 1])].add((key, lines[i][0], lines[j][0]))
    gone = defaultdict(set)
    for places in windows.values():
        first = min(places)
        for key, a, b in places:
            if key != first[0] or a > first[2]:
                gone[key] |= set(range(a, b + 1))
    return gone


def test_line_dedup(spark, docs, none):
    rnd = random.Random(5)
    pool = [words(rnd, rnd.randrange(1, 25)) for _ in range(12)] + ["", " "]
    data = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    gone = brute_lines(data, 30)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, 30).collect()}
    for i, t in data:
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i]["lines_deleted"] == len(gone[i])
    out = line_dedup.dedup_lines(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    whole = dict((r[0], r[1]) for r in rows())
    assert texts[40] is None and texts[44] == whole[44] and texts[45] == whole[45].split("\n")[0] + "\n" + whole[45].split("\n")[-1]
    assert texts[48] == "\n".join(["same line again here"] * 13)       # one window of a repetition stays
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_counts_words(spark):
    line = lambda sep, n, k=0: sep.join(f"w{k + i}" for i in range(n))
    data = [(0, line("\t", 60)), (1, "own\n" + line("\t", 60) + "\t"),                    # tabs between words, a trailing one
            (2, "two" + " " * 60 + "words"), (3, "other\ntwo" + " " * 60 + "words"),        # two words are no passage
            (4, line(" ", 30, 100) + "\n" + line(" ", 30, 200)), (5, line(" ", 30, 100) + "\r\n" + line(" ", 30, 200) + "\r\nown"),
            (6, "".join(map(chr, range(0x4e00, 0x4e00 + 60)))), (7, "own\n" + "".join(map(chr, range(0x4e00, 0x4e00 + 60)))),
            (8, "short\n" + "漢字" * 10), (9, "漢字" * 10)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i: r["lines_deleted"] for i, r in got.items() if r["lines_deleted"]} == {1: 1, 5: 2, 7: 1}
    assert got[1]["text"] == "own" and got[5]["text"] == "own" and got[7]["text"] == "own" and got[5]["lines_left"] == 1


def test_byte_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows():
        ids = tk.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, byte_bpe.round_trip(docs, BYTE_VOCABULARY).collect())) == want
    encoded = byte_bpe.encode(docs, BYTE_VOCABULARY)
    text = dict((r[0], r[1]) for r in rows())
    for r in encoded.collect():
        assert len(r["ids"]) == len(r["byte_starts"]) == len(r["char_starts"])
        data = (text[r["doc_id"]] or "").encode()
        assert all(len(data[:b].decode(errors="ignore")) in (c, c - 1) for b, c in zip(r["byte_starts"], r["char_starts"]))
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in byte_bpe.decode(encoded, BYTE_VOCABULARY).collect()}[51] == text[51]
    assert byte_bpe.round_trip(none, BYTE_VOCABULARY).count() == 0


def test_chunks_equal_whole_tokenizers():
    rnd = random.Random(7)
    marks = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "'s", "'", "1", "٣", "<|endoftext|>", "漢", "é", "Σ", "İ", "\r\n", "🙂", "\x85", "　", " ", "\xa0", "ﬁ", "don't"]
    texts = ["".join(rnd.choices(marks, k=rnd.randrange(14))) for _ in range(5000)]
    for path, keep, ordinary in ((BYTE_VOCABULARY, True, True), (WORD_VOCABULARY, False, False)):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = ordinary
        got = Encoder(path, keep, ordinary, remembered=300).encode(pa.array(texts))
        assert all(g.tolist() == t.encode(x, add_special_tokens=False).ids for g, x in zip(got, texts))


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    pieces = out.collect()
    assert pieces and {r["doc_id"] for r in pieces} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    total = Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, repeated and long texts, rows without id, no labels, and columns named like the stages' own."""
    import corpus_pipeline

    extra = "__rid long, lines_deleted string, lines_left int, perplexity double, __gone int, LINES string"
    data = [(*r[:5], 7, "x", 3, 0.5, 1, "y") for r in rows()]
    for name, given in (("some", data), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(given, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, sf)
            assert out.columns == docs.columns, stage
            kept = out.collect()
            assert len(kept) <= docs.count() and all((r["__rid"], r["lines_deleted"], r["lines_left"], r["perplexity"], r["LINES"]) == (7, "x", 3, 0.5, "y") for r in kept), stage
            if stage in ("quality", "toxicity"):
                assert len(kept) == docs.count()
            docs = spark.createDataFrame(kept, docs.schema)
        texts = [r["text"] for r in docs.collect()]
        assert len(texts) == len(set(texts))                                # one of each group of copies
        pieces = corpus_pipeline.run(spark, sf).collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_own_columns_survive(docs):
    for f in (line_dedup.dedup_lines, simhash.keep_one):
        marked = docs.withColumn("__rid", F.lit(7)).withColumn("__n", F.lit(8)).withColumn("lines_deleted", F.lit("a")).withColumn("__lines_deleted", F.lit("b"))
        out = f(marked)
        assert len(set(out.columns)) == len(out.columns) and out.columns[:len(marked.columns)] == marked.columns
        assert {(r["__rid"], r["__n"], r["lines_deleted"], r["__lines_deleted"]) for r in out.collect()} == {(7, 8, "a", "b")}


def test_words_as_arrays():
    texts = ["Ab a\x0bbcd  EFGHI  x xx éß é", "", None, " \t ", "a a a b", "b", "na\0ïve q\r\n", "i"] * 2
    for lower, once in ((False, True), (True, False)):
        got = wordgrams.Words(pa.array(["cut", *texts]).slice(1), 5, lower, once)
        each = [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in texts]
        first = [[w for i, w in enumerate(ws) if not once or i == 0 or w != ws[i - 1]] for ws in each]
        assert got.same.tolist() == [len(a) - len(b) for a, b in zip(each, first, strict=True)]
        assert [(t, got.distinct[c], n) for t, c, n in zip(got.text, got.code, got.size, strict=True)] == [(i, w, len(w)) for i, ws in enumerate(first) for w in ws]
        heads = [h for ws in first for h in wordgrams.heads_of(ws, 5)]
        keys, real = wordgrams.grams_of_heads(got.head, 5)
        assert keys[real].tolist() == wordgrams.keys_of(heads, 5)[0].tolist()
        value = lambda keys: (keys % 1009).astype(float)
        want = [value(wordgrams.keys_of([h], 5)[0]).sum() for h in heads]
        for remembered in (3, 1000):
            scores = wordgrams.HeadScores(5, value, remembered)
            assert [scores.of(got.head[i:]).tolist() for i in (8, 0, 3, 0)] == [want[i:] for i in (8, 0, 3, 0)]
    assert wordgrams.Words([], 5).n == 0 == len(wordgrams.Words([None], 5).head)


def test_quality_counts_all_trusted(spark, docs, monkeypatch):
    """Counts come from every trusted text of three quarters, however many there are, and a model in parts scores the same."""
    rnd = random.Random(5)
    texts = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 7) for _ in range(4)), "en") for i in range(21_000)], "doc_id long, text string, lang string")
    fitted = quality.train(texts, texts.select("doc_id", F.lit(1).alias("quality")))
    seen = texts.where(F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(4)) > 0)
    assert fitted.unseen.count() == texts.count() - seen.count()
    assert sorted(r[0] for r in texts.join(fitted.unseen, "doc_id", "left_anti").select("doc_id").collect()) == sorted(r[0] for r in seen.select("doc_id").collect())
    every, labels = labelled(spark, docs)
    extra = every.withColumn("ROW", F.lit(1))
    whole = quality.train(every, labels)
    outcome = lambda fitted: sorted(repr((r["doc_id"], r["lang"], r["kept"], r["perplexity"] and round(r["perplexity"], 6), r["threshold"] and round(r["threshold"], 6)))
                                    for r in quality.classify(every, fitted).collect())
    want, left = outcome(whole), sorted(map(repr, quality.keep_good(extra, whole).collect()))
    monkeypatch.setattr(quality, "MAX_GRAMS", 200)
    cut = quality.train(every, labels)
    assert cut.parts > 2 and len(cut.model.levels[-1].key) < len(whole.model.levels[-1].key)
    assert outcome(cut) == want and sorted(map(repr, quality.keep_good(extra, cut).collect())) == left


def test_packing_workers_give_memory_back(docs, monkeypatch):
    tidied = []
    monkeypatch.setattr(packing, "tidied", lambda run: tidied.append(run) or run)
    few = docs.limit(20)
    got = sorted(map(repr, packing.cut_tokens(few, WORD_VOCABULARY).drop("num").collect()))
    monkeypatch.setattr(packing, "STRETCH", 10)
    assert sorted(map(repr, packing.cut_tokens(few, WORD_VOCABULARY).drop("num").collect())) == got and len(tidied) == 2


def test_workers_give_memory_back_after_every_stretch(spark, monkeypatch):
    """Scoring, counting and fingerprinting release freed memory between stretches and at the end of a task, also where the toxicity curve is described."""
    from rubricon.llm import common

    frame = type(spark.range(1))
    calls, runs, real = [], [], frame.mapInArrow

    def mapped(self, run, schema, *more, **named):
        runs.append((run, self.schema))
        return real(self, run, schema, *more, **named)

    monkeypatch.setattr(frame, "mapInArrow", mapped)
    docs = spark.createDataFrame([(i, f"good words number {i} of {'vile ' * (i % 2)}texts") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    toxicity.score(docs, model)
    toxicity.keep_ordinary(docs, model)
    simhash.fingerprints(docs)
    assert len(runs) == 6                               # two counts, the description, score, filter, fingerprints
    monkeypatch.setattr(common, "release_freed", lambda: calls.append(1))
    monkeypatch.setattr(toxicity, "STRETCH", 20)
    monkeypatch.setattr(wordgrams, "COUNTED", 20)
    text = [f"good words number {i}" for i in range(5)]
    columns = {"doc_id": pa.array(range(5)), "text": pa.array(text), "cls": pa.array([0, 1, 0, 1, 0], pa.int32())}
    for run, schema in runs:
        calls.clear()
        assert list(run(iter([pa.record_batch([columns[c] for c in schema.names], names=schema.names)])))
        stretches = 1 if run is runs[-1][0] else 5      # simhash takes longer stretches
        assert len(calls) == stretches + 1
