"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text.

The model is an interpolated n-gram model over characters, ``ORDER`` long, one
for each language, trained on trusted documents (labelled of good quality). A
model is a set of tables: for each n-gram that was seen, the surprise of its
last character in bits, and for each context the bits that backing off costs.
They are made, and stay, as tables sharded by n-gram; no model is brought to
the driver. A document's score is its mean surprise in bits per character:
tasks count the n-grams of their documents, a row for each n-gram of up to
``CHUNK_DOCS`` documents with the counts in each, and joins of these counts
with the tables of all orders give the sum for each document. A document is
rejected above a quantile of its language's trusted documents that no model was
trained on. Likely words said again and again surprise no n-gram model, so the
share of words that repeat the word before is held against a quantile in the
same way.

One of ``HOLD`` trusted documents is held out; of the others, training takes at
most ``TRAIN_DOCS`` per language, those with the least hashes. Every language
with ``LEAST`` long trusted texts that are held out has a model and a limit of
its own. All others, and nulls, share one model trained on trusted text of any
language, and one limit of that model's scores.

Characters are code points, but for capitals and digits, which are one symbol
each; those from U+3000 on are told apart by their lowest 12 bits.

Bounds: a chunk's n-grams on a worker; a side of a join is broadcast only if it
was counted to have at most ``SENT_ROWS`` rows, and shuffled otherwise. A text
is read in pieces of ``PIECE`` characters.

Defined cases: null and empty texts have no surprise but that of their end and
are kept. Texts of fewer than ``SHORT`` characters get a limit farther from the
median by the square root of ``SHORT`` / characters; for all others it is the
quantile itself. Without trusted documents that training leaves, all are kept.
Null and repeated ids are rows like any other; a label counts for all rows of
its id. Only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, read
from fieldloom.plans.storage import release, saved

ORDER = 4
TRAIN_DOCS = 2000
#: One of this many trusted documents isn't trained on; languages with fewer than LEAST such texts have no limit of their own.
HOLD, LEAST = 4, 20
#: Quantiles of trusted documents beyond which a document is rejected, and what is always allowed.
QUANTILE, REPEATS = 0.998, 0.25
#: Characters from which on the threshold holds as it is.
SHORT = 400
#: A discount is at least this, so that something is left for what wasn't seen.
FLOOR = 0.05
#: Bits of a character's symbol; ORDER symbols and a document's place in its chunk fit 64 bits.
BITS = 14
#: Documents and characters whose n-grams are counted together.
CHUNK_DOCS, CHUNK_CHARS = 256, 1 << 18
PIECE = 1 << 20
#: Rows up to which a table is broadcast in a join.
SENT_ROWS = 2_000_000

#: Symbols: 0 stands before and after a text.
_UPPER, _DIGIT, _CONTROL = 1, 2, 3
_FAR = 0x3000


def _symbols_below() -> np.ndarray:
    table = np.arange(_FAR, dtype=np.uint64)
    for i in range(_FAR):
        c = chr(i)
        if i <= _CONTROL:
            table[i] = _CONTROL
        elif c.isupper():
            table[i] = _UPPER
        elif c.isdigit():
            table[i] = _DIGIT
    return table


_SYMBOL = _symbols_below()


def symbols(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    far = a >= _FAR
    if far.any():
        return np.where(far, _FAR + (a & 0xFFF), _SYMBOL[np.where(far, 0, a)]).astype(np.uint64)
    return _SYMBOL[a]


def grams(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """Numbers of the n-grams that end at each character and at the end of the text, a piece at a time."""
    for lo in range(0, len(text) + 1, PIECE):
        s = symbols(text[max(0, lo - order + 1) : lo + PIECE])
        s = np.concatenate([np.zeros(max(0, order - 1 - lo), np.uint64), s, np.zeros(1 if lo + PIECE > len(text) else 0, np.uint64)])
        g = s[: len(s) - order + 1]
        for i in range(1, order):
            g = (g << np.uint64(BITS)) | s[i : len(s) - order + 1 + i]
        yield g


def repeats(text: str) -> tuple[int, int]:
    """Words that equal the one before, and words that have one before."""
    w = text.split()
    return sum(map(operator.eq, w, w[1:])), max(0, len(w) - 1)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of a sorted array begin, and how long they are."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.concatenate([at, [len(x)]]))


def _counted(order: int):
    """Counts of n-grams by language and under "", of a bounded number of characters at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}

        def count(model: str) -> pa.RecordBatch:
            g = np.sort(np.concatenate(waiting.pop(model)))
            at, n = _runs(g)
            return pa.RecordBatch.from_arrays([pa.array([model] * len(at), pa.string()), pa.array(g[at].view(np.int64)), pa.array(n)], names=["model", "gram", "c"])

        for b in batches:
            for model, text in zip(b["model"].to_pylist(), b["text"], strict=True):
                for g in grams(text.as_py(), order):
                    for x in {model, ""}:
                        waiting.setdefault(x, []).append(g)
                        if sum(map(len, waiting[x])) > PIECE:
                            yield count(x)
        for model in [*waiting]:
            yield count(model)

    return run


@dataclass
class Model:
    order: int
    #: By order from 1: seen n-grams ``(model, gram, bits)`` and contexts ``(model, context, bits)`` of backing off.
    tables: list[tuple[DataFrame, DataFrame]]


def _shorter(gram: Column, n: int) -> Column:
    """The last ``n`` characters of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << BITS * n) - 1))


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """Models from rows ``(model, text)``; all rows count for the model "" too."""
    counts = trusted.mapInArrow(_counted(order), "model string, gram long, c long").groupBy("model", "gram").agg(F.sum("c").alias("c"))
    levels = [saved(counts, "grams")]
    for n in range(order - 1, 0, -1):
        # shorter n-grams count the characters that they continue
        levels.insert(0, saved(levels[0].groupBy("model", _shorter(F.col("gram"), n).alias("gram")).agg(F.count("*").alias("c")), "grams"))
    tables: list[tuple[DataFrame, DataFrame]] = []
    for n, level in enumerate(levels, 1):
        f = lambda k: F.count_if(F.col("c") == k).cast("double")
        y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
        off = lambda k: F.greatest(F.lit(FLOOR), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.lit(1.0), F.col(f"n{k}"))))
        discounts = level.groupBy("model").agg(*[f(k).alias(f"n{k}") for k in (1, 2, 3, 4)]).select("model", *[off(k).alias(f"d{k}") for k in (1, 2, 3)])
        rows = level.join(discounts, "model").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("context", F.shiftright("gram", BITS))
        totals = saved(rows.groupBy("model", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back")), "contexts")
        own = (F.col("c") - F.col("d")) / F.col("total")
        rows = rows.join(totals, ["model", "context"])
        if n == 1:
            p = own + F.col("back") * 2.0**-BITS
        else:
            below = tables[-1][0].select("model", F.col("gram").alias("short"), F.col("bits").alias("below"))
            rows = rows.withColumn("short", _shorter(F.col("gram"), n - 1)).join(below, ["model", "short"])
            p = own + F.col("back") * F.pow(F.lit(2.0), -F.col("below"))
        seen = saved(rows.select("model", "gram", (-F.log2(p)).alias("bits")), "seen")
        tables.append((seen, totals.select("model", "context", (-F.log2("back")).alias("bits"))))
        release(level)
    return Model(order, tables)


def _chunked(order: int):
    """For each document a row with its words, and for each n-gram of a chunk the documents that have it with its counts."""
    names = ["model", "gram", "rows", "counts", "row", "chars", "repeats", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, models, texts = b["row"].to_numpy(), b["model"].to_pylist(), b["text"]
            size = pc.utf8_length(texts).to_numpy()
            order_ = sorted(range(len(models)), key=models.__getitem__)
            words: list[tuple[int, int]] = [(0, 0)] * len(models)
            lo = 0
            while lo < len(order_):
                hi, chars = lo, 0
                while hi < len(order_) and hi - lo < CHUNK_DOCS and models[order_[hi]] == models[order_[lo]] and (hi == lo or chars + size[order_[hi]] <= CHUNK_CHARS):
                    chars += size[order_[hi]]
                    hi += 1
                packed: list[np.ndarray] = []
                found: list[tuple[np.ndarray, np.ndarray]] = []

                def flush(packed=packed, found=found) -> None:
                    x = np.sort(np.concatenate(packed))
                    packed.clear()
                    at, n = _runs(x)
                    found.append((x[at], n))

                for place, i in enumerate(order_[lo:hi]):
                    t = texts[i].as_py()
                    words[i] = repeats(t)
                    for g in grams(t, order):
                        packed.append((g << np.uint64(8)) | np.uint64(place))
                        if len(g) >= PIECE:
                            flush()
                if packed:
                    flush()
                mine = rows[order_[lo:hi]]
                for x, n in found:
                    key = x >> np.uint64(8)
                    at, _ = _runs(key)
                    ends = pa.array(np.concatenate([at, [len(x)]]), pa.int32())
                    k = len(at)
                    arrays = [pa.array([models[order_[lo]]] * k, pa.string()), pa.array(key[at].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(mine[(x & np.uint64(255)).astype(np.int64)])), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(k, pa.int64()) for _ in range(4))], names=names)
                lo = hi
            k = len(rows)
            of = [pa.array([w[j] for w in words], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32())), b["row"], pa.array(size, pa.int64()), *of], names=names)

    return run


def score(model: Model, texts: DataFrame) -> DataFrame:
    """``(row, bits, chars, repeats)`` for each number of ``(row, model, text)``; rows of one number must be equal."""
    kinds = "model string, gram long, rows array<long>, counts array<int>, row long, chars long, repeats long, words long"
    rows = texts.select("row", "model", "text").mapInArrow(_chunked(model.order), kinds)
    bits: Column = F.lit(float(BITS))
    for n, (seen, contexts) in enumerate(model.tables, 1):
        # rows of documents have neither model nor gram and meet nothing
        seen = bounded(seen, SENT_ROWS).select(F.col("model").alias(f"m{n}"), F.col("gram").alias(f"g{n}"), F.col("bits").alias(f"bits{n}"))
        contexts = bounded(contexts, SENT_ROWS).select(F.col("model").alias(f"k{n}"), F.col("context").alias(f"c{n}"), F.col("bits").alias(f"back{n}"))
        short = _shorter(F.col("gram"), n)
        rows = rows.join(seen, (F.col("model") == F.col(f"m{n}")) & (short == F.col(f"g{n}")), "left")
        rows = rows.join(contexts, (F.col("model") == F.col(f"k{n}")) & (F.shiftright(short, BITS) == F.col(f"c{n}")), "left")
        bits = F.coalesce(F.col(f"bits{n}"), F.coalesce(F.col(f"back{n}"), F.lit(0.0)) + bits)
    rows = rows.select(bits.alias("bits"), "row", "chars", "repeats", "words", F.explode_outer(F.arrays_zip("rows", "counts")).alias("in"))
    rows = rows.select(F.coalesce("in.rows", "row").alias("row"), "chars", "repeats", "words", F.coalesce("in.counts", F.lit(0)).alias("n"), "bits")
    # texts that are there several times have their sums as often, and the same mean
    out = rows.groupBy("row").agg((F.sum(F.col("n") * F.col("bits")) / F.sum("n")).alias("bits"), *[F.max(c).alias(c) for c in ("chars", "repeats", "words")])
    return out.select("row", "bits", "chars", F.when(F.col("words") > 0, F.col("repeats") / F.col("words")).otherwise(0.0).alias("repeats"))


@dataclass
class Classifier:
    model: Model
    limits: DataFrame  # (model, middle, top, most); model "" holds for all languages without one of their own

    def decide(self, rows: DataFrame) -> DataFrame:
        """Adds ``limit`` and ``kept`` to scored rows."""
        limits = self.limits.select(F.col("model").alias("__model"), *[F.col(c).alias(f"__{c}") for c in ("middle", "top", "most")])
        d = rows.join(bounded(limits, SENT_ROWS), F.col("model") == F.col("__model"), "left")
        wide = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(SHORT)) / F.greatest(F.lit(1), F.col("chars"))))
        limit = F.col("__middle") + (F.col("__top") - F.col("__middle")) * wide
        kept = F.coalesce((F.col("bits") <= limit) & ((F.col("repeats") <= F.col("__most")) | (F.col("chars") < 20)), F.lit(True)) | (F.col("chars") == 0)
        return d.select(*rows.columns, limit.alias("limit"), kept.alias("kept"))


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, train_docs: int = TRAIN_DOCS, order: int = ORDER) -> tuple[Classifier, DataFrame]:
    """Learn from documents ``(doc_id, lang, text)`` whose label ``(doc_id, quality)`` is 1.

    Returns the classifier and all rows, scored: ``doc_id, lang, text_hash, model, bits, chars, repeats``.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "lang", text.alias("text"), F.coalesce("lang", F.lit("")).alias("language"))
    meta = docs.select("doc_id", "language", (F.length("text") >= SHORT).alias("long")).join(good, "doc_id").groupBy("doc_id", "language").agg(F.max("long").alias("long"))
    least = Window.partitionBy("language").orderBy(F.xxhash64("doc_id"), "doc_id")
    meta = saved(meta.withColumn("fit", F.row_number().over(least) % HOLD != 2), "trusted")
    # a language has a model of its own only if that gets a limit from texts it has not seen
    own = meta.where("language <> '' AND long AND NOT fit").groupBy("language").agg(F.count("*").alias("held")).where(F.col("held") >= LEAST)
    own = saved(own.select("language", F.col("language").alias("model")), "own")
    own = bounded(own, SENT_ROWS)
    model_of = F.coalesce("model", F.lit("")).alias("model")
    meta = saved(meta.join(own, "language", "left").select("doc_id", "language", "long", "fit", model_of), "trusted")
    within = Window.partitionBy("model").orderBy(F.xxhash64("doc_id"), "doc_id")
    fits = meta.where("fit").select("doc_id", "model").distinct().withColumn("no", F.row_number().over(within))
    sample = saved(fits.where(F.col("no") <= train_docs).select("doc_id", "model"), "sample")
    model = train(docs.join(bounded(sample, SENT_ROWS), "doc_id").select("model", "text"), order)

    # limits come from trusted documents that no model has seen; those of languages with a model are judged by the shared one too
    unseen = meta.where("long").join(sample.select("doc_id").distinct(), "doc_id", "left_anti")
    unseen = saved(unseen.groupBy("doc_id").agg(F.lit(True).alias("unseen")), "unseen")
    every = docs.join(own, "language", "left").join(bounded(unseen, SENT_ROWS), "doc_id", "left")
    every = every.select("doc_id", "lang", "text", model_of, F.coalesce("unseen", F.lit(False)).alias("unseen"))
    twice = F.when(F.col("unseen") & (F.col("model") != ""), F.array("model", F.lit(""))).otherwise(F.array("model"))
    every = every.select("doc_id", "lang", "unseen", F.col("model").alias("chosen"), F.explode(twice).alias("model"), "text")
    # a score depends on model and text alone, so their hash numbers the rows alike in both readings
    every = every.withColumn("text_hash", F.xxhash64("text")).withColumn("row", F.xxhash64("model", "text"))
    rows = saved(every.drop("text").join(saved(score(model, every), "scores"), "row"), "scored")

    judged = rows.where(F.col("unseen") & (F.col("chars") >= SHORT))
    # with too few texts to have one beyond the quantile, it is taken from their mean and deviation
    z = NormalDist().inv_cdf(quantile)
    at = lambda q: F.percentile_approx("bits", q, 10000)
    few = F.count("*") * (1 - quantile) < 1
    top = F.when(few, F.greatest(at(quantile), F.avg("bits") + z * F.coalesce(F.stddev("bits"), F.lit(0.0)))).otherwise(at(quantile))
    most = F.greatest(F.lit(REPEATS), F.percentile_approx("repeats", quantile, 10000))
    found = [at(0.5).alias("middle"), top.alias("top"), most.alias("most"), F.count("*").alias("n")]
    each = judged.where("model <> ''").groupBy("model").agg(*found).where(F.col("n") >= LEAST)
    # all others: the limit of what they have together if that is enough, else that of all languages
    shared = judged.where("model = ''")
    together = shared.where("chosen = ''").agg(*found).where(F.col("n") >= LEAST).withColumn("first", F.lit(0))
    rest = together.unionByName(shared.agg(*found).where("n > 0").withColumn("first", F.lit(1))).orderBy("first").limit(1).drop("first")
    limits = saved(each.unionByName(rest.withColumn("model", F.lit(""))).drop("n"), "limits")
    return Classifier(model, limits), rows.where("model = chosen").drop("chosen", "unseen", "row")


def kept_documents(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that were not rejected; a decision holds for all rows of one language and text."""
    bad = saved(decided.where("NOT kept").select(F.col("lang").alias("__lang"), F.col("text_hash").alias("__hash")).distinct(), "rejected")
    same = docs["lang"].eqNullSafe(F.col("__lang")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__hash"))
    return docs.join(bounded(bad, SENT_ROWS), same, "left_anti")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, its limit and the decision for each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    c, rows = fit(docs, read(spark, sf_dir, "labels"))
    return c.decide(rows).select("doc_id", "lang", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "repeats", "limit", "kept")
