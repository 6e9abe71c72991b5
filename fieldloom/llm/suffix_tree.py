"""LM scoring by a probabilistic suffix tree over words.

Words that make up more than ``LEAST`` of the training tokens are symbols of
their own, all others are the symbol RARE, within which words follow their
overall frequency; so the alphabet and the contexts of each length are fewer
than 1 / LEAST, whatever the corpus. A context of up to ``DEPTH`` symbols whose
share of the tokens is above ``LEAST`` joins the tree if its next-symbol
distribution diverges from that of its longest suffix in the tree: the mean
log ratio of the two, each occurrence left out of its own estimate, must reach
``DIVERGENCE`` bits. Distributions are smoothed with their suffix's, down to
add-one counts of words: P(w|s) = (c(s,w) + STRENGTH * P(w|suffix)) / (n(s) +
STRENGTH). A text's score is the sum over its tokens of the log10 probability
in the state of the longest suffix that the tree has.

Texts are read twice: to count words, then to write them as symbols, in pages
of some documents. All else works on pages. Counts of next symbols are tables
made by shuffles of what each task gathered. Pages that one task wrote form
blocks of about ``BLOCK`` tokens; a block has a dictionary of its rare words. It
asks for these and for the distinct transitions that it needs, gets them back by
joins, and is scored with them. In a text that was learnt from, the transition
out of the longest state was counted, so only that one is asked for.

Bounds: 1 / LEAST symbols, and contexts of each length, on the driver and in
each task; a block's pages and answers in a task. A text is one page at least.

Defined cases: a null text is empty and has one token, its end. A null id is
not held out. Repeated ids are rows like any other. Without training tokens
all probabilities come from the add-one base over an empty count. Only the named
columns are read, so that others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import keys as K
from fieldloom.llm.common import read
from fieldloom.plans.storage import saved

#: Symbols and contexts must have a share of the training tokens above this; 2**-16 lets a symbol fit 16 bits.
LEAST = 2.0**-16
DEPTH = 3
DIVERGENCE = 0.02
STRENGTH = 200.0
#: Key of the token that ends each text; words have mixed keys, so no word is it but by chance.
END = np.uint64(0x5851F42D4C957F2D)
#: Tokens whose keys a task gathers before it counts them.
GATHER = 1 << 20
#: Tokens of a block, at least, but for the last of a task.
BLOCK = 1 << 22


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end after the words of each text, and where each text's tokens begin."""
    keys, bounds = K.word_keys(texts)
    return np.insert(keys, bounds[1:], END), bounds + np.arange(len(bounds))


class _Counts:
    """Counts of 64-bit keys, merged whenever many have gathered."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.size = 0
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.size += len(keys)
        if self.size > GATHER:
            self.merge()

    def merge(self) -> None:
        if self.size:
            new = np.concatenate(self.raw)
            self.raw, self.size = [], 0
            new.sort()
            edge = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            n = np.diff(np.concatenate([edge, [len(new)]]))
            new = new[edge]
            if len(self.keys):  # two sorted runs
                at = np.minimum(np.searchsorted(self.keys, new), len(self.keys) - 1)
                old = self.keys[at] == new
                self.n[at[old]] += n[old]
                spot = np.searchsorted(self.keys, new[~old])
                self.keys, self.n = np.insert(self.keys, spot, new[~old]), np.insert(self.n, spot, n[~old])
            else:
                self.keys, self.n = new, n

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        self.merge()
        if len(self.keys) > least:
            for lo in range(0, len(self.keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(self.keys[lo : lo + (1 << 16)].view(np.int64)), pa.array(self.n[lo : lo + (1 << 16)])], names=["key", "n"])
            self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of words, at most a few million at once."""
    counts = _Counts()
    for b in batches:
        texts = b["text"].to_pylist()
        for lo, hi in K.chunks(texts):
            counts.add(tokens(texts[lo:hi])[0])
            yield from counts.flush(GATHER)
    yield from counts.flush()


class Slots:
    """Places of 64-bit keys, found through two tables of hashed bits; the few keys that have a slot in neither are searched."""

    _ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(8, int(2 * max(1, len(keys))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.tables, left = [], np.arange(len(keys), dtype=np.int32)
        for odd in self._ODD:
            t = np.zeros(1 << bits, np.int32)
            at = (keys[left] * odd) >> self.shift
            t[at] = left
            self.tables.append(t)
            left = left[t[at] != left]
        order = np.argsort(keys[left])
        self.rest, self.rest_at = keys[left][order], left[order]

    def find(self, want: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 where there is none."""
        if not len(self.keys) or not len(want):
            return np.full(len(want), -1, np.int32)
        out = self.tables[0][(want * self._ODD[0]) >> self.shift]
        miss = np.flatnonzero(self.keys[out] != want)
        if len(miss):
            some = want[miss]
            again = self.tables[1][(some * self._ODD[1]) >> self.shift]
            lost = self.keys[again] != some
            again[lost] = -1
            if len(self.rest):
                i = np.minimum(np.searchsorted(self.rest, some), len(self.rest) - 1)
                again = np.where(self.rest[i] == some, self.rest_at[i], again)
            out[miss] = again
        return out


@dataclass
class Alphabet:
    keys: np.ndarray  # of the words that are symbols
    counts: np.ndarray
    total: int
    distinct: int

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        """1 + the place of each token's key, 0 if rare."""
        if not hasattr(self, "_slots"):
            self._slots = Slots(self.keys)
        return (self._slots.find(tokens) + 1).astype(np.uint16)

    def base(self, count):
        return (count + 1) / (self.total + self.distinct + 1)


def alphabet_of(texts: DataFrame, least: float = LEAST) -> tuple[Alphabet, DataFrame]:
    """The symbols, and the counts ``(key, n)`` of all words, of rows of binary ``text``."""
    words = saved(texts.select("text").mapInArrow(_counted_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = words.where(F.col("n") > least * total).orderBy("key").toPandas()  # fewer than 1 / least rows
    return Alphabet(often["key"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64), total, distinct), words


_ZSTD = "zstd"


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec=_ZSTD, asbytes=True)


def _unpacked(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec=_ZSTD, asbytes=True), kind)


def encode(docs: DataFrame, alphabet: Alphabet, learns: str, id_cols: tuple[str, ...] = ("doc_id",), block_tokens: int = BLOCK) -> DataFrame:
    """Texts as symbols. Written rows are pages, or parts of a block's dictionary of rare words.

    A page: ``block``, lists of the ids, of ``lens`` in tokens and of the column
    ``learns``, ``symbols``, and ``rare``: each rare token's place in the dictionary.
    A part: ``block``, ``words`` and the place ``first`` of the first of them.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(alphabet)
    kinds = [docs.schema[c].dataType.simpleString() for c in id_cols]
    own = [f"id{i}" for i in range(len(id_cols))]
    rows = docs.select(*[F.col(c).alias(o) for c, o in zip(id_cols, own, strict=True)], F.coalesce(F.col(learns), F.lit(False)).alias("learns"), F.coalesce("text", F.lit(b"")).alias("text"), F.spark_partition_id().alias("part"))
    names = ["block", *own, "lens", "learns", "symbols", "rare", "words", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, pages, size, number = sent.value, [], 0, 0

        def block(part: int) -> Iterator[pa.RecordBatch]:
            at = (part << 24) + number
            every = np.concatenate([rare for *_, rare in pages])
            words, place = np.unique(every, return_inverse=True)
            place, done = place.astype(np.uint32), 0
            for ids, lens, learns, symbols, rare in pages:
                mine = _packed(place[done : done + len(rare)])
                done += len(rare)
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                blobs = [pa.array([x], pa.binary()) for x in (symbols, mine)]
                yield pa.RecordBatch.from_arrays([pa.array([at]), *map(one, ids), one(lens), one(learns), *blobs, pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64())], names=names)
            for lo in range(0, len(words), 1 << 16):
                w = pa.array(words[lo : lo + (1 << 16)].view(np.int64))
                none = [pa.nulls(1, x.type) for x in (*map(one, ids), one(lens), one(learns), *blobs)]
                yield pa.RecordBatch.from_arrays([pa.array([at]), *none, one(w), pa.array([lo])], names=names)

        part = 0
        for b in batches:
            texts = b["text"].to_pylist()
            part = b["part"][0].as_py() if len(texts) else part
            for lo, hi in K.chunks(texts):
                t, bounds = tokens(texts[lo:hi])
                s = alphabet.symbols(t)
                ids = [c.slice(lo, hi - lo) for c in b.columns[: len(own)]]
                pages.append((ids, pa.array(np.diff(bounds).astype(np.int32)), b["learns"].slice(lo, hi - lo), _packed(s), t[s == 0]))
                size += len(t)
                if size >= block_tokens:
                    yield from block(part)
                    pages, size, number = [], 0, number + 1
        if pages:
            yield from block(part)

    lists = "".join(f", {o} array<{k}>" for o, k in zip(own, kinds, strict=True))
    return saved(rows.mapInArrow(run, f"block long{lists}, lens array<int>, learns array<boolean>, symbols binary, rare binary, words array<long>, first long"), "pages")


def _page(b, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each text begins, and which positions are of texts that were learnt from."""
    lens = b["lens"][i].values.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    s = _unpacked(b["symbols"][i].as_py(), int(bounds[-1]), np.uint16).astype(np.uint64)
    return s, bounds, np.repeat(b["learns"][i].values.to_numpy(zero_copy_only=False), lens)


def _steps(symbols: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``depth`` tokens of their text before them, and the number of that context."""
    at = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    i = np.flatnonzero(at >= depth)
    context = np.zeros(len(i), np.uint64)
    for d in range(depth, 0, -1):
        context = (context << np.uint64(16)) | symbols[i - d]
    return i, context


@dataclass
class Tree:
    alphabet: Alphabet
    rare: float  # probability of the symbol RARE at the root
    states: list  # by depth from 1: (contexts, log10 of the weight of the suffix's distribution)
    moves: DataFrame  # (key, lp): log10 P(symbol | state) where counted, in single precision


#: Tell the depths of transitions apart; the first differ in their highest bits, where shorter contexts have none.
_DEPTHS = (0x1B873593CC9E2D51, 0x4CF5AD432745937F, 0x52DCE729E6546B64, 0x38495AB51FE6A05C)


def learn(pages: DataFrame, alphabet: Alphabet, least: float = LEAST, depth: int = DEPTH, divergence: float = DIVERGENCE, strength: float = STRENGTH) -> Tree:
    """The tree of the pages' texts that are to be learnt from."""
    spark = pages.sparkSession
    pages = pages.where("lens IS NOT NULL").select("lens", "learns", "symbols")
    total, k = alphabet.total, len(alphabet.keys)
    root = alphabet.base(alphabet.counts) if k else np.zeros(0)
    rare = max(1.0 - float(root.sum()), 1e-12)
    parents = spark.createDataFrame([(i, float(p)) for i, p in enumerate([rare, *root])], "short long, p double")
    states, moves = [], []
    end = int(alphabet.symbols(np.array([END]))[0])
    # contexts of one symbol; RARE is one too. What follows an end is another text
    ones = np.arange(k + 1)
    counts = np.concatenate([[total - int(alphabet.counts.sum())], alphabet.counts])
    frequent = pd.DataFrame({"context": ones, "total": counts})[(counts > least * total) & (ones != end)]
    context, symbol = F.shiftrightunsigned("key", 16), F.col("key").bitwiseAND(F.lit(0xFFFF))
    for d in range(1, depth + 1):
        if not len(frequent):
            break
        known = spark.sparkContext.broadcast(frequent["context"].to_numpy(np.int64).view(np.uint64))

        def transitions(batches: Iterator[pa.RecordBatch], d=d, known=known) -> Iterator[pa.RecordBatch]:
            slots, found = Slots(known.value), _Counts()
            for b in batches:
                for j in range(b.num_rows):
                    s, bounds, learns = _page(b, j)
                    i, c = _steps(s, bounds, d)
                    good = learns[i]
                    good[good] = slots.find(c[good]) >= 0
                    found.add((c[good] << np.uint64(16)) | s[i[good]])
                    yield from found.flush(GATHER)
            yield from found.flush()

        rows = pages.mapInArrow(transitions, "key long, n long").withColumn("short", F.col("key").bitwiseAND(F.lit((1 << 16 * d) - 1)))
        # tasks have counted already; dealt by the shorter transition once, counts are summed and meet their parents
        rows = (rows if d == 1 else rows.repartition("short")).groupBy("short", "key").agg(F.sum("n").alias("c")).withColumn("context", context)
        rows = rows.join(F.broadcast(spark.createDataFrame(frequent, "context long, total long")), "context")  # fewer than 1 / least rows
        rows = saved(rows.join(F.broadcast(parents) if d == 1 else parents, "short").select("key", "c", "total", F.col("p").cast("float").alias("p")), "moves")  # at first bounded by the alphabet
        n, c, p = F.col("total"), F.col("c"), F.col("p").cast("double")
        own = (c + strength * p) / (n + strength)
        gain = c * F.log2((c - 1 + strength * p) / (n - 1 + strength) / p)
        kept = rows.groupBy(context.alias("context"), "total").agg(F.sum(gain).alias("gain")).where(F.col("gain") >= divergence * F.col("total")).select("context", "total").toPandas()
        states.append((kept["context"].to_numpy(np.int64).view(np.uint64), np.log10(strength / (kept["total"].to_numpy(float) + strength))))
        mark = F.broadcast(spark.createDataFrame(kept[["context"]].assign(kept=True), "context long, kept boolean"))
        marked = rows.withColumn("context", context).join(mark, "context", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
        parents = marked.select(F.col("key").alias("short"), F.when(F.col("kept"), own).otherwise(p).cast("float").alias("p"))
        moves.append(marked.where("kept").select(F.col("key").bitwiseXOR(F.lit(_DEPTHS[d])).alias("key"), F.log10(own).cast("float").alias("lp")))
        # a context and its next symbol are a context of one more; its count is below that of its parts, which are contexts too
        frequent = rows.where((c > least * total) & (symbol != end)).select(F.col("key").alias("context"), c.alias("total")).toPandas()
    table = spark.createDataFrame([], "key long, lp float")
    for m in moves:
        table = table.unionByName(m)
    return Tree(alphabet, rare, states, table)


def _needed(slots: list[Slots], symbols: np.ndarray, bounds: np.ndarray, learns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per depth: positions whose context is a state, keys of their transitions, and the states' places.

    Of texts that were learnt from only the longest state of a position.
    """
    found, longest = [], np.zeros(len(symbols), np.int8)
    for d, s in enumerate(slots, 1):
        i, c = _steps(symbols, bounds, d)
        at = s.find(c)
        hit = at >= 0
        i, c, at = i[hit], c[hit], at[hit]
        longest[i] = d
        found.append((i, ((c << np.uint64(16)) | symbols[i]) ^ np.uint64(_DEPTHS[d]), at))
    out = []
    for d, (i, key, at) in enumerate(found, 1):
        use = (longest[i] == d) | ~learns[i]
        out.append((i[use], key[use], at[use]))
    return out


def score(pages: DataFrame, tree: Tree, words: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), kinds: tuple[str, ...] = ("long",)) -> DataFrame:
    """``n_tokens, n_known, base_score, score`` beside the ids of all encoded texts."""
    sent = pages.sparkSession.sparkContext.broadcast((tree.alphabet, tree.rare, tree.states))
    texts = pages.where("lens IS NOT NULL")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = [Slots(c) for c, _ in sent.value[2]]
        block, want, size = None, [], 0

        def asks() -> Iterator[pa.RecordBatch]:
            u = np.unique(np.concatenate(want)).view(np.int64) if want else np.zeros(0, np.int64)
            for lo in range(0, len(u), 1 << 16):
                part = u[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part)], names=["block", "key"])

        for b in batches:
            blocks = b["block"].to_numpy()
            for j in range(b.num_rows):
                if blocks[j] != block:
                    yield from asks()
                    block, want, size = int(blocks[j]), [], 0
                new = [k for _, k, _ in _needed(slots, *_page(b, j))]
                want += new
                size += sum(map(len, new))
                if size > GATHER:
                    want, size = [np.unique(np.concatenate(want))], 0
        yield from asks()

    asked = texts.select("block", "lens", "learns", "symbols").mapInArrow(ask, "block long, key long")
    answers = asked.join(tree.moves, "key").select("block", F.lit(-1).cast("long").alias("word"), "key", "lp")
    rare = pages.where("words IS NOT NULL").select("block", "first", F.posexplode("words").alias("at", "key"))
    counted = rare.join(words, "key").select("block", (F.col("first") + F.col("at")).alias("word"), F.col("n").alias("key"), F.lit(0.0).cast("float").alias("lp"))
    own = [f"id{i}" for i in range(len(id_cols))]

    def answer(_, left: pa.Table, right: pa.Table) -> pa.Table:
        alphabet, rare, states = sent.value
        word, key = right["word"].to_numpy(), right["key"].to_numpy()
        moved = word < 0
        keys, lps = key[moved].view(np.uint64), right["lp"].to_numpy()[moved].astype(float)
        moves, slots = Slots(keys), [Slots(c) for c, _ in states]
        counts = np.zeros(int(word.max(initial=-1)) + 1)
        counts[word[~moved]] = key[~moved]
        often = np.concatenate([[0.0], np.log10(alphabet.base(alphabet.counts.astype(float)))])
        out, ids = [], []
        for j in range(left.num_rows):
            s, bounds, learns = _page(left, j)
            low = np.flatnonzero(s == 0)
            place = _unpacked(left["rare"][j].as_py(), len(low), np.uint32)
            n = np.where(place < len(counts), counts[np.minimum(place, max(len(counts) - 1, 0))], 0.0) if len(counts) else np.zeros(len(low))
            base = often[s]
            base[low] = np.log10(alphabet.base(n))
            known = np.ones(len(s), np.int64)
            known[low] = n > 0
            lp = base.copy()
            within = base - np.log10(rare)  # of a rare word among all rare ones
            for (i, move, at), (_, weight) in zip(_needed(slots, s, bounds, learns), states, strict=True):
                k = moves.find(move)
                hit = k >= 0
                lp[i] = np.where(hit, (lps[k] if len(lps) else 0.0) + np.where(s[i] == 0, within[i], 0), lp[i] + weight[at])
            out.append((np.diff(bounds), np.add.reduceat(known, bounds[:-1]), np.add.reduceat(base, bounds[:-1]), np.add.reduceat(lp, bounds[:-1])))
            ids.append([left[o][j].values for o in own])
        cols = [pa.concat_arrays(c) for c in zip(*ids, strict=True)] + [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        del moves, slots, word, key, keys, lps, counts
        pa.default_memory_pool().release_unused()  # a worker goes on to other tasks
        return pa.table(cols, names=[*id_cols, "n_tokens", "n_known", "base_score", "score"])

    both = texts.select("block", *own, "lens", "learns", "symbols", "rare").groupBy("block").cogroup(answers.unionByName(counted).groupBy("block"))
    lists = "".join(f"`{c}` {k}, " for c, k in zip(id_cols, kinds, strict=True))
    return both.applyInArrow(answer, f"{lists}n_tokens long, n_known long, base_score double, score double")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a tree learnt from those that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), (~held).alias("learns"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    alphabet, words = alphabet_of(docs.where("learns"))
    pages = encode(docs, alphabet, "learns", ("doc_id", "held_out"))
    tree = learn(pages, alphabet)
    out = score(pages, tree, words, ("doc_id", "held_out"), (docs.schema["doc_id"].dataType.simpleString(), "boolean"))
    return out.withColumn("train_tokens", F.lit(alphabet.total).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
