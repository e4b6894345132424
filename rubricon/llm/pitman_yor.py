"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are words (A-Z lower-cased, runs of bytes other than ASCII blanks) and one end token for each text.  The
context restaurant of a token is chosen by the whole token before it; its parent is the class restaurant of all contexts
with the same last two bytes, whose parent is the root restaurant.  The root's own base is the open vocabulary: a root
table is a word of its own, and what the root keeps for new tables is the probability of "a word that training has not
seen".  Known words and that one event sum to one in every context.  A context that training has not seen answers as its class.

Seating is sampled by sweeps.  A sweep seats the customers of every dish of every word and class restaurant anew, given the
parent's predictive probability and the restaurant's number of tables after the sweep before: the first customer opens
a table, each later one opens another with its Chinese-restaurant probability (after ``ONE_BY_ONE`` customers in batches
that grow geometrically).  Tables opened are the parent's customers.  Predictive probabilities are averaged
over the sweeps after ``BURN_IN``.

Where the work happens:

1. Texts become blocks of about ``BLOCK`` tokens.  A block keeps its distinct ``(word, context)`` pairs, sorted by word hash,
   and its tokens as pair numbers; a long text may span blocks.  Shards and blocks are written once, into buckets, so that no later step shuffles them.
2. Pairs with their training counts go to the shard that owns the range of the word's hash: one row for each block and
   shard, so a frequent word arrives once from each block and no key is hot.  A shard holds all counts of its words, in all contexts.
3. Sweeps run over shards in parallel.  Each context has an owner (a range of its key); after a sweep every shard sends its
   tables of a context as one number to the owner, which returns the sums, so no context is hot.  They and the seating
   are staged between sweeps; the driver sees only the totals of the classes (at most 65,536 rows).
4. Shards answer each block with one probability for each pair and one count for each word; blocks add up their tokens.

Defined results: null text is the empty text (the end token alone); repeated rows are scored and, in training, counted each; a row
with a null id is not held out and learns like any other; an empty table gives an empty result; without training
rows every word is unknown (base: V = N = 0; model: probability 1 of an unseen word).  Words are told apart by 64-bit hashes,
contexts by 48 bits of it and their exact last two bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rubricon.llm.chunks import slices
from rubricon.llm.common import give_back, shipped, staged, tidied, tidied_group, whole_text
from rubricon.session import checkpoint_dir

BLOCK = 1_500_000
SWEEPS = 3
BURN_IN = 1
STRENGTH = 1.0
ONE_BY_ONE = 64
END = b"\n"                      # no word holds a blank
CONTEXTS = 1 << 16


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_rising(a: np.ndarray) -> bytes:
    """An array of rising unsigned 64-bit numbers as compressed differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """Writes ``df`` once into ``n`` buckets of ``key`` in the shared checkpoint folder; grouping the result by ``key`` moves no row of it."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).sortBy(key).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")             # the files stay
    return out


class Vocabulary(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def class_of(word: bytes) -> int:
    return (word[-2] << 8 if len(word) > 1 else 0) | word[-1]


def context_keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """64-bit keys of whole words as contexts: the high 48 bits of the hash and the exact class."""
    return (hashes & ~np.uint64(CONTEXTS - 1)) | classes


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Contiguous ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Block:
    """Tokens of consecutive texts, until there are enough."""

    def __init__(self):
        self.vocabulary, self.tokens, self.before, self.segments, self.size = Vocabulary(), [], [], [], 0
        self.end = self.vocabulary[END]

    def add(self, uid: int, doc_id, held: bool, words: list[bytes], before: bytes, last: bool) -> None:
        ids = list(map(self.vocabulary.__getitem__, words))
        if last:
            ids.append(self.end)
        if not ids:
            return
        self.tokens.append(np.array(ids, np.int64))
        self.before.append(self.vocabulary[before])
        self.segments.append((uid, doc_id, held, len(ids)))
        self.size += len(ids)

    def rows(self, block: int, shards: int):
        """The block's own row (shard -1) and one row for each shard that owns some of its words."""
        words = list(self.vocabulary)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        by_hash = np.argsort(hashes)
        context = context_keys(hashes, np.fromiter(map(class_of, words), np.uint64, len(words)))[by_hash]
        rank = np.empty(len(words), np.int64)
        rank[by_hash] = np.arange(len(words))
        length = np.array([s[3] for s in self.segments], np.int64)
        token = np.concatenate(self.tokens)
        previous = np.concatenate([[0], token[:-1]])
        previous[np.concatenate([[0], np.cumsum(length)[:-1]])] = self.before
        key = rank[token] * len(words) + rank[previous]
        pairs, number = np.unique(key, return_inverse=True)
        learns = np.repeat(np.array([not s[2] for s in self.segments]), length)
        count = np.bincount(number[learns], minlength=len(pairs))
        uid, doc_id, held, _ = zip(*self.segments, strict=True)
        yield {"block": block, "shard": -1, "tokens": pack(number.astype("<u4")), "uid": list(uid), "doc_id": list(doc_id),
               "held": list(held), "length": length.tolist()}
        word, first = np.unique(pairs // len(words), return_index=True)     # a word may stand only before a segment
        sorted_hashes = hashes[by_hash][word]
        owner = shard_of(sorted_hashes, shards).astype(np.int64)
        n_ctx = np.diff(np.append(first, len(pairs)))
        pair_owner = np.repeat(owner, n_ctx)
        for s in np.unique(owner):
            w, p = owner == s, pair_owner == s
            used, of_used = np.unique(pairs[p] % len(words), return_inverse=True)
            yield {"block": block, "shard": int(s), "words": pack_rising(sorted_hashes[w]), "n_ctx": pack(n_ctx[w].astype("<u4")),
                   "keys": pack(context[used]), "ctx": pack(of_used.astype("<u4")), "count": pack(count[p].astype("<u4"))}


SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("tokens", pa.binary()), ("uid", pa.list_(pa.int64())),
                    ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("length", pa.list_(pa.int64())),
                    ("words", pa.binary()), ("n_ctx", pa.binary()), ("keys", pa.binary()), ("ctx", pa.binary()), ("count", pa.binary())])
SPARK_SCHEMA = ("block long, shard int, tokens binary, uid array<long>, doc_id array<long>, held array<boolean>, length array<long>, "
                "words binary, n_ctx binary, keys binary, ctx binary, count binary")


def blocks_of(docs: DataFrame, held: str, shards: int) -> DataFrame:
    """Block and shard rows of all texts; ``held`` is the boolean column of texts to score only."""
    def run(batches):
        part = TaskContext.get().partitionId() << 33
        block, n_blocks, uid = Block(), 0, part

        def flush():
            nonlocal block, n_blocks
            rows = list(block.rows(part + n_blocks, shards)) if block.size else []
            block, n_blocks = Block(), n_blocks + 1
            for r in rows:
                yield pa.RecordBatch.from_pylist([r], SCHEMA)

        for b in batches:
            texts = b.column(2).to_pylist()
            ids, out = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts):
                for doc_id, is_held, text in zip(ids[i:j], out[i:j], texts[i:j], strict=True):
                    words, before, at = text.encode().lower().split(), END, 0
                    while True:
                        take = words[at:at + max(1, BLOCK - block.size)]
                        at += len(take)
                        block.add(uid, doc_id, bool(is_held), take, before, at == len(words))
                        before = take[-1] if take else before
                        if block.size >= BLOCK:
                            yield from flush()
                        if at == len(words):
                            break
                    uid += 1
        yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(held), F.lit(False)).alias("held"), whole_text().alias("text"))
    return rows.mapInArrow(tidied(run), SPARK_SCHEMA)


def gather_shard(group):
    """All requests of a shard and the sum of its counts, as one row."""
    import pandas as pd

    group = group.sort_values("block")
    key_hash, ctx, count = [], [], []
    for r in group.itertuples():
        w, n = unpack_rising(r.words), unpack(r.n_ctx, "<u4")
        key_hash.append(np.repeat(w, n))
        ctx.append(unpack(r.keys, "<u8")[unpack(r.ctx, "<u4")])
        count.append(unpack(r.count, "<u4"))
    sizes = np.cumsum([len(c) for c in ctx])[:-1]
    h, n = np.concatenate(key_hash), np.concatenate(count)
    contexts, c = np.unique(np.concatenate(ctx), return_inverse=True)
    known = np.unique(h[n > 0])
    pair, at = np.unique(np.searchsorted(known, h[n > 0]) * len(contexts) + c[n > 0], return_inverse=True)
    total = np.bincount(at, n[n > 0], len(pair)).astype(np.int64)
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "known": [pack_rising(known)], "contexts": [pack_rising(contexts)],
                         "n_pairs": [pack(np.bincount(pair // len(contexts), minlength=len(known)).astype("<u4"))],
                         "pair_ctx": [pack((pair % len(contexts)).astype("<u4"))], "total": [pack(total.astype("<u8"))],
                         "blocks": [group["block"].tolist()], "req_words": [group["words"].tolist()], "req_n": [group["n_ctx"].tolist()],
                         "req_ctx": [[pack(x.astype("<u4")) for x in np.split(c, sizes)]]})


OWN = ["block", "tokens", "uid", "doc_id", "held", "length"]
OWN_SCHEMA = "block long, tokens binary, uid array<long>, doc_id array<long>, held array<boolean>, length array<long>"


def gathered(rows: DataFrame, n_shards: int) -> DataFrame:
    """The shards, with their numbers, and the blocks' own rows, under negative ones, as a table in buckets of ``shard``.

    Requests are shuffled to their shards straight from the texts, without a copy of them on disk besides; a block's own row goes along.
    """
    asked = ["block", "words", "n_ctx", "keys", "ctx", "count"]
    schema = to_arrow_schema(StructType.fromDDL(f"{SHARD_SCHEMA}, {OWN_SCHEMA}"))

    def gather(key, group):
        if key[0].as_py() < 0:
            some = {c: group.column(c) for c in ["shard", *OWN]}
        else:
            done = gather_shard(group.select(["shard", *asked]).to_pandas()).iloc[0]
            some = {c: pa.array([done[c]], schema.field(c).type) for c in done.index}
        n = len(some["shard"])
        give_back()
        return pa.table([some[f.name].cast(f.type) if f.name in some else pa.nulls(n, f.type) for f in schema], schema=schema)

    own = (-1 - F.pmod(F.xxhash64("block"), F.lit(2 ** 31 - 1))).cast("int")         # several blocks may share a number
    cells = rows.withColumn("shard", F.when(F.col("shard") >= 0, F.col("shard")).otherwise(own))
    return bucketed(cells.groupBy("shard").applyInArrow(gather, f"{SHARD_SCHEMA}, {OWN_SCHEMA}"), n_shards, "shard")


STATE = ["shard", "known", "contexts", "n_pairs", "pair_ctx", "total"]
SHARD_SCHEMA = ("shard int, known binary, contexts binary, n_pairs binary, pair_ctx binary, total binary, blocks array<long>, "
                "req_words array<binary>, req_n array<binary>, req_ctx array<binary>")
# what a sweep leaves: each shard's seating (owner -1) and its tables for the owners of its contexts (owner 0 and up)
SWEEP_SCHEMA = ("shard int, owner int, customers binary, tables binary, class_customers binary, class_tables binary, "
                "class array<long>, class_n array<long>, class_t array<long>, ones array<long>, twos array<long>, words long")
REPLY_SCHEMA = "shard int, owner int, sweep int, customers binary, tables binary, class_customers binary, class_tables binary"


class Totals:
    """What all shards share: for each class its customers and tables after each sweep; the root's customers; the discounts."""

    def __init__(self, n_words: int, customers: np.ndarray, tables: np.ndarray, d: float, d_root: float, d_word: float = 0.5):
        self.n_words, self.d, self.d_root, self.d_word = n_words, d, d_root, d_word
        self.customers = [customers]
        self.tables = [tables]                      # before the first sweep: one table for each dish

    def root(self, sweep: int) -> float:
        return float(self.tables[sweep].sum())

    def root_predictive(self, root_customers: np.ndarray, sweep: int) -> np.ndarray:
        return np.maximum(root_customers - self.d_root, 0.0) / (STRENGTH + self.root(sweep))

    def unseen(self, sweep: int) -> float:
        return (STRENGTH + self.d_root * self.n_words) / (STRENGTH + self.root(sweep))


def seat(customers: np.ndarray, pull: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables after seating ``customers`` (sorted, most first) of each dish; ``pull`` is the restaurant's weight
    for a new table times the parent's probability of the dish."""
    tables = np.ones(len(customers), np.int64)
    n, batch = 1, 1
    while len(customers) and customers[0] > n:
        m = int(np.searchsorted(-customers, -n, "left"))              # dishes with more than n customers
        batch = 1 if n < ONE_BY_ONE else max(1, n // 4)
        p = pull[:m] / (pull[:m] + np.maximum(n - d * tables[:m], 1 - d))
        tables[:m] += rng.random(m) < p if batch == 1 else rng.binomial(np.minimum(batch, customers[:m] - n), p)
        n += batch
    return tables


class Shard:
    """The dishes of the class restaurants that one shard owns, with their seating."""

    def __init__(self, number: int, known: bytes, pair: bytes, total: bytes):
        self.number, self.known = number, unpack_rising(known)
        self.pair = unpack(pair, "<u8").astype(np.int64)
        self.count = unpack(total, "<u8").astype(np.int64)
        self.word, self.ctx = self.pair // CONTEXTS, self.pair % CONTEXTS

    def root_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, tables, len(self.known))

    def reseat(self, totals: Totals, s: int, tables: np.ndarray, count: np.ndarray, rng) -> np.ndarray:
        """Tables of each pair after sweep ``s``, given those before it."""
        parent = totals.root_predictive(self.root_customers(tables), s - 1)[self.word]
        return seat_all(count, (STRENGTH + totals.d * totals.tables[s - 1][self.ctx]) * np.maximum(parent, 1e-12), totals.d, rng)

    def sweeps(self, totals: Totals, up_to: int, seed: int):
        """Tables of each pair after sweeps 0 (one table each) to ``up_to``, with fixed customers."""
        tables = np.ones(len(self.pair), np.int64)
        yield 0, tables
        for s in range(1, up_to + 1):
            tables = self.reseat(totals, s, tables, self.count, np.random.default_rng([seed, self.number, s]))
            yield s, tables


def seat_all(customers: np.ndarray, pull: np.ndarray, d: float, rng) -> np.ndarray:
    order = np.argsort(-customers, kind="stable")
    tables = np.empty(len(customers), np.int64)
    tables[order] = seat(customers[order], pull[order], d, rng)
    return tables


class Words:
    """The dishes of the word restaurants that one shard owns; their parents are the class restaurants ``classes``."""

    def __init__(self, r):
        self.number, self.known, self.contexts = int(r["shard"]), unpack_rising(r["known"]), unpack_rising(r["contexts"])
        self.word = np.repeat(np.arange(len(self.known)), unpack(r["n_pairs"], "<u4"))
        self.ctx = unpack(r["pair_ctx"], "<u4").astype(np.int64)
        self.count = unpack(r["total"], "<u8").astype(np.int64)
        self.class_of = (self.contexts & np.uint64(CONTEXTS - 1)).astype(np.int64)
        pair, self.parent = np.unique(self.word * CONTEXTS + self.class_of[self.ctx], return_inverse=True)
        self.classes = Shard(self.number, r["known"], pack(pair.astype("<u8")), pack(np.zeros(len(pair), "<u8")))

    def class_customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.parent, tables, len(self.classes.pair)).astype(np.int64)

    def class_predictive(self, totals: Totals, s: int, customers: np.ndarray, tables: np.ndarray, base: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Predictive probabilities in ``classes`` of dishes with these customers, tables and root probabilities."""
        return ((customers - totals.d * tables + (STRENGTH + totals.d * totals.tables[s][classes]) * base)
                / (STRENGTH + totals.customers[s][classes]))

    def reseat(self, totals: Totals, s: int, of_context: np.ndarray, customers: np.ndarray, tables: np.ndarray, seed: int):
        """``(word tables, class customers, class tables)`` after sweep ``s``; ``of_context`` are all tables of each context."""
        rng, x = np.random.default_rng([seed, self.number, s]), self.classes
        base = totals.root_predictive(x.root_customers(tables), s - 1)[x.word]
        parent = self.class_predictive(totals, s - 1, customers, tables, base, x.ctx)[self.parent]
        own = seat_all(self.count, (STRENGTH + totals.d_word * of_context[self.ctx]) * np.maximum(parent, 1e-12), totals.d_word, rng)
        customers = self.class_customers(own)
        return own, customers, x.reseat(totals, s, tables, customers, rng)

    def rows(self, own: np.ndarray, customers: np.ndarray, tables: np.ndarray, owners: int, first: bool) -> list[dict]:
        """The seating and the totals it adds to, as rows of ``SWEEP_SCHEMA``."""
        x = self.classes
        classes, at = np.unique(x.ctx, return_inverse=True)
        per_word = x.root_customers(np.ones(len(x.pair)))
        n_of = lambda k: [int((v == k).sum()) for v in (self.count, customers, per_word)]
        out = [{"shard": self.number, "owner": -1, "tables": pack(own.astype("<u4")), "class_customers": pack(customers.astype("<u4")),
                "class_tables": pack(tables.astype("<u4")), "class": classes.tolist(), "class_n": np.bincount(at, customers, len(classes)).astype(np.int64).tolist(),
                "class_t": np.bincount(at, tables, len(classes)).astype(np.int64).tolist(), "ones": n_of(1), "twos": n_of(2), "words": len(self.known)}]
        of_context = np.bincount(self.ctx, own, len(self.contexts)).astype("<u4")
        n = np.bincount(self.ctx, self.count, len(self.contexts)).astype("<u8") if first else None
        for owner, i, j in ranges(self.contexts, owners):
            out.append({"shard": self.number, "owner": owner, "customers": pack(n[i:j]) if first else None, "tables": pack(of_context[i:j])})
        return out


def ranges(contexts: np.ndarray, owners: int):
    """``(owner, from, to)`` of the stretches of sorted contexts that have one owner."""
    owner = shard_of(contexts, owners).astype(np.int64)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(owner)], strict=True):
        yield int(owner[i]), int(i), int(j)


def _discount(n1: float, n2: float) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 + n2 else 0.5


def _frame(rows: list[dict]):
    import pandas as pd

    names = [c.split()[0] for c in SWEEP_SCHEMA.split(", ")]
    return pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)


def routes_of(shards: DataFrame, owners: int) -> DataFrame:
    """``(owner, shard, at)``: which of the owner's contexts a shard asks for, in the shard's order."""
    def split(batches):
        for b in batches:
            for r in b.to_pylist():
                contexts = unpack_rising(r["contexts"])
                for owner, i, j in ranges(contexts, owners):
                    yield pa.RecordBatch.from_pylist([{"owner": owner, "shard": r["shard"], "ctx": pack_rising(contexts[i:j])}],
                                                     pa.schema([("owner", pa.int32()), ("shard", pa.int32()), ("ctx", pa.binary())]))

    def number(group):
        import pandas as pd

        ctx = [unpack_rising(x) for x in group["ctx"]]
        at = np.split(np.unique(np.concatenate(ctx), return_inverse=True)[1], np.cumsum([len(x) for x in ctx])[:-1])
        return pd.DataFrame({"owner": group["owner"], "shard": group["shard"], "at": [pack(x.astype("<u4")) for x in at]})

    asks = shards.select("shard", "contexts").mapInArrow(split, "owner int, shard int, ctx binary")
    return staged(asks.groupBy("owner").applyInPandas(number, "owner int, shard int, at binary"))


def replies(routes: DataFrame, swept: DataFrame, sweep: int) -> DataFrame:
    """For each shard and owner the sums over all shards of its contexts' tables (and customers), and the shard's own seating."""
    def add(routes, sent):
        import pandas as pd

        both = routes.merge(sent, on=["owner", "shard"])
        at = [unpack(x, "<u4") for x in both["at"]]
        where = np.concatenate(at) if at else np.zeros(0, np.int64)
        out = {"shard": both["shard"], "owner": both["owner"], "sweep": sweep, "class_customers": None, "class_tables": None}
        for col, dtype in (("customers", "<u8"), ("tables", "<u4")):
            if sweep and col == "customers":
                out[col] = None
                continue
            total = np.bincount(where, np.concatenate([unpack(x, dtype) for x in both[col]]) if at else None).astype("<u8")
            out[col] = [pack(total[x]) for x in at]
        return pd.DataFrame(out)[[c.split()[0] for c in REPLY_SCHEMA.split(", ")]]

    sums = routes.groupBy("owner").cogroup(swept.where("owner >= 0").select("owner", "shard", "customers", "tables").groupBy("owner")).applyInPandas(add, REPLY_SCHEMA)
    seating = swept.where("owner = -1").select("shard", "owner", F.lit(sweep).alias("sweep"), "customers", "tables", "class_customers", "class_tables")
    return staged(sums.unionByName(seating))


def _per_context(replies, sweep: int, col: str = "tables") -> np.ndarray:
    got = replies[(replies["sweep"] == sweep) & (replies["owner"] >= 0)].sort_values("owner")
    return np.concatenate([unpack(x, "<u8") for x in got[col]]).astype(np.int64)


def _seating(replies, sweep: int, *cols: str) -> list[np.ndarray]:
    r = replies[(replies["sweep"] == sweep) & (replies["owner"] < 0)].iloc[0]
    return [unpack(r[c], "<u4").astype(np.int64) for c in cols]


def _class_totals(swept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of each class (at most 65,536 rows)."""
    customers, tables = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64)
    each = swept.where("owner = -1").select(F.explode(F.arrays_zip("class", "class_n", "class_t")).alias("x")).select("x.*")
    for r in each.groupBy("class").agg(F.sum("class_n").alias("n"), F.sum("class_t").alias("t")).collect():
        customers[r["class"]], tables[r["class"]] = r["n"], r["t"]
    return customers, tables


def _sweep(s: int, shared, owners: int, seed: int):
    def run(own, told):
        x = Words(own.iloc[0])
        seated = x.reseat(shared(), s, _per_context(told, s - 1), *_seating(told, s - 1, "class_customers", "class_tables"), seed)
        return _frame(x.rows(*seated, owners, False))

    return run


def fit(shards: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 8) -> tuple[Totals, DataFrame]:
    """Runs the sweeps; returns the shared totals and, for each shard, customers and sampled tables of its contexts with its seating."""
    owners = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = shards.select(*STATE)

    def first(batches):
        for b in batches:
            for r in b.to_pylist():
                x = Words(r)
                own = np.ones(len(x.count), np.int64)
                for row in x.rows(own, x.class_customers(own), np.ones(len(x.classes.pair), np.int64), owners, True):
                    yield pa.RecordBatch.from_pylist([row], schema)

    schema = to_arrow_schema(StructType.fromDDL(SWEEP_SCHEMA))
    routes = routes_of(shards, owners)
    swept = staged(state.mapInArrow(first, SWEEP_SCHEMA))
    n = swept.where("owner = -1").agg(F.sum("words"), *[F.sum(F.get(c, F.lit(k))) for k in range(3) for c in ("ones", "twos")]).first()
    d_word, d, d_root = (_discount(n[1 + 2 * k] or 0, n[2 + 2 * k] or 0) for k in range(3))
    totals = Totals(n[0] or 0, *_class_totals(swept), d, d_root, d_word)
    got = [replies(routes, swept, 0)]
    for s in range(1, sweeps + 1):
        told = got[-1].select("shard", "owner", "sweep", F.when(F.col("owner") >= 0, F.col("tables")).alias("tables"), "class_customers", "class_tables")
        swept = staged(state.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(
            _sweep(s, shipped(shards.sparkSession, totals), owners, seed), SWEEP_SCHEMA))
        customers, tables = _class_totals(swept)
        totals.customers.append(customers)
        totals.tables.append(tables)
        got.append(replies(routes, swept, s))
    told = got[0].where("owner >= 0").withColumn("tables", F.lit(None).cast("binary")) if sweeps else got[0]
    for s in range(1, sweeps + 1):
        if s > burn_in or s == sweeps:
            told = told.unionByName(got[s])
    return totals, told


def answer(shards: DataFrame, totals: Totals, told: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """``(block, shard, p, n_ctx, c)``: the averaged predictive probability of each requested pair, and each word's count."""
    shared = shipped(shards.sparkSession, totals)

    def find(keys, wanted):
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def pick(values, at, there):
        return np.where(there, values[at], 0) if len(values) else np.zeros(len(at))

    def run(own, told):
        import pandas as pd

        totals, r = shared(), own.iloc[0]
        x = Words(r)
        y = x.classes
        n_contexts = len(x.contexts)
        pair = x.word * n_contexts + x.ctx
        customers = _per_context(told, 0, "customers")
        samples = [(s, _per_context(told, s), *_seating(told, s, "tables", "class_customers", "class_tables"))
                   for s in range(sweeps + 1) if s > burn_in or s == sweeps]
        per_word = np.bincount(x.word, x.count, len(x.known)).astype(np.int64)
        out = []
        for block, words, n, ctx in zip(r["blocks"], r["req_words"], r["req_n"], r["req_ctx"], strict=True):
            w, k, u = unpack_rising(words), unpack(n, "<u4"), unpack(ctx, "<u4").astype(np.int64)
            at, is_known = find(x.known, w)
            c = pick(per_word, at, is_known)
            word, known, classes = np.repeat(at, k), np.repeat(is_known, k), x.class_of[u]
            j, seen = find(pair, word * n_contexts + u)
            i, class_seen = find(y.pair, word * CONTEXTS + classes)
            seen, class_seen = seen & known, class_seen & known
            p = np.zeros(len(u))
            for s, of_context, tables, class_customers, class_tables in samples:
                base = np.where(known, pick(totals.root_predictive(y.root_customers(class_tables), s), word, known), totals.unseen(s))
                parent = x.class_predictive(totals, s, pick(class_customers, i, class_seen), pick(class_tables, i, class_seen), base, classes)
                mine = pick(x.count - totals.d_word * tables, j, seen)
                p += (mine + (STRENGTH + totals.d_word * of_context[u]) * parent) / (STRENGTH + customers[u])
            out.append({"block": block, "shard": int(r["shard"]), "p": pack((p / len(samples)).astype("<f4")), "n_ctx": n, "c": pack(c.astype("<u8"))})
        return pd.DataFrame(out)

    return shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(tidied_group(run, 2), "block long, shard int, p binary, n_ctx binary, c binary")


def add_up(blocks: DataFrame, answers: DataFrame, n_tokens: int, n_words: int) -> DataFrame:
    """Sums of each text's part in each block, ``(uid, doc_id, held_out, n, known, base, score)``."""
    def run(own, replies):
        import pandas as pd

        replies = replies.sort_values("shard")
        r = own.iloc[0]
        p = np.log10(np.concatenate([unpack(x, "<f4") for x in replies["p"]]).astype(float))
        c = np.concatenate([unpack(x, "<u8") for x in replies["c"]])
        n_ctx = np.concatenate([unpack(x, "<u4") for x in replies["n_ctx"]])
        base = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        token = unpack(r["tokens"], "<u4")
        length = np.array(r["length"])
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        sums = lambda per_pair: np.add.reduceat(per_pair[token], first)
        return pd.DataFrame({"uid": r["uid"], "doc_id": pd.array(r["doc_id"], "Int64"), "held_out": r["held"], "n": length,
                             "known": sums(np.repeat((c > 0).astype(np.int64), n_ctx)), "base": sums(np.repeat(base, n_ctx)), "score": sums(p)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        tidied_group(run, 2), "uid long, doc_id long, held_out boolean, n long, known long, base double, score double")


def tokens_learnt(blocks: DataFrame) -> int:
    learnt = blocks.select(F.explode(F.arrays_zip("held", "length")).alias("x"))
    return learnt.where("not x.held").agg(F.sum("x.length")).first()[0] or 0


def score(docs: DataFrame, held: str, sweeps: int = SWEEPS, seed: int = 8) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row; texts whose boolean column
    ``held`` holds teach nothing.  Scores are log10 probabilities."""
    spark = docs.sparkSession
    n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = gathered(blocks_of(docs, held, n_shards), n_shards)
    shards, own = table.where("shard >= 0").drop(*OWN), table.where("shard < 0").select(*OWN)
    totals, told = fit(shards, sweeps, seed=seed)
    n_tokens = tokens_learnt(own)
    parts = add_up(own, answer(shards, totals, told, sweeps), n_tokens, totals.n_words)
    whole = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n").alias("n_tokens"),
                                     F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
