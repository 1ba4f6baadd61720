"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy over the whole corpus.

Words are lower-cased. The network sees the WINDOW words on either side of a
masked one and gives the distribution of its number: the corpus's OWN most
frequent words have a number each, all others are hashed to the rest of
BUCKETS. The distribution is a softmax over classes and one over the SIDE
numbers of the class, both of which look at the neighbours, so it is normalised
over all numbers. Words stay apart, however many: within a number a word has its own frequency,
P(word | number) = n(word) / n(number), by word_counts(), a distributed table of all of them.
A document's score is the sum of the logarithms of all its words' conditional
probabilities.

Words that make up 1 / SHARE of the corpus or more are broadcast, so at most
SHARE words; all rarer ones are joined with the table. Which way a word goes
changes no result.

Counts and training cover every document. A hash of id and text deals the
documents out to blocks of about BLOCK words, whatever partitions they come in,
and gives their order there. A round trains some blocks, each from the same
net, and averages the nets by their number of words. Rounds have GROUP blocks;
a small corpus is passed over until it has had LEAST rounds, and a corpus of
over MOST * GROUP blocks has more blocks a round, not more rounds. Sums are
formed in tasks, so the driver gets one model of fixed size a round.
Null and empty texts have no words: n_tokens and pll are 0 and the mean is null.
Repeated rows and null ids are scored like any other; an empty corpus gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batched, id_text, pairs, shared_path

#: Numbers of a class, and classes; all numbers, those of one word, and the one that stands for no neighbour.
SIDE, CLASSES = 64, 64
BUCKETS = SIDE * CLASSES
OWN = BUCKETS * 3 // 4
PAD = BUCKETS
WIDTH, WINDOW = 8, 2
#: Words that are trained on at once, and that are laid end to end or scored at once.
BATCH, STEP = 1 << 14, 1 << 15
RATE, LARGE, ROUNDS = 0.12, 5.0, 1
SLICES = 32
#: Words of a block, blocks of a round, and the least and greatest number of rounds.
BLOCK, GROUP, LEAST, MOST = 1 << 19, 24, 4, 32
#: Distinct words that a task counts before it hands them on.
HELD = 1 << 17
#: Words at least as frequent as one in so many are broadcast.
SHARE = 1 << 18
_OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def hashed(word: bytes) -> int:
    """The number of a word that has none of its own."""
    return OWN + zlib.crc32(word) % (BUCKETS - OWN)


def strips(rows: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(keys, lengths, words): documents laid end to end with padding between; words of a long one stay together."""
    gap = np.full(WINDOW, PAD)
    keys, sizes, words, held = [], [], [gap], 0
    for key, own in rows:
        keys.append(key)
        sizes.append(len(own))
        words += (own, gap)
        held += len(own) + WINDOW
        if held >= STEP:
            yield keys, np.array(sizes), np.concatenate(words)
            keys, sizes, words, held = [], [], [gap], 0
    if keys:
        yield keys, np.array(sizes), np.concatenate(words)


def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(first column, number of each word) of rows whose second column is codes."""
    for batch in batches:
        for key, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield key, np.frombuffer(codes.as_py(), np.uint16).astype(np.int64)


class Classes:
    """Numbers' places in the order of frequency, which is also that of classes, and their log-probabilities in the corpus."""

    def __init__(self, counts: np.ndarray):
        mass = counts + 0.5
        order = np.argsort(-mass, kind="stable")
        self.place = np.empty(BUCKETS + 1, np.int64)
        self.place[order] = np.arange(BUCKETS)
        self.place[PAD] = PAD
        each = (mass[order] / mass.sum()).reshape(CLASSES, SIDE)
        self.prior = np.log(each.sum(1))
        self.within = np.log(each) - self.prior[:, None]
        self.share = -np.log(np.maximum(counts, 1))


def start(classes: Classes) -> dict[str, np.ndarray]:
    """The network before learning, which gives the corpus frequencies whatever the neighbours. The last column of out and turn is for a constant input."""
    rng = np.random.default_rng(11)
    net = {
        "embed": rng.normal(0, 0.3, (BUCKETS + 1, WIDTH)),
        "place": np.ones((len(_OFFSETS), WIDTH)),
        "hidden": np.zeros(WIDTH),
        "out": np.c_[np.zeros((CLASSES, WIDTH)), classes.prior],
        "turn": np.c_[np.zeros((BUCKETS, WIDTH)), classes.within.ravel()],
    }
    net |= {f"{k}^2": np.full(v.shape, 1e-4) for k, v in net.items()}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _forward(net: dict[str, np.ndarray], words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours, their rows of embed, and the hidden values with a constant beside them."""
    near = np.stack([words[at + k] for k in _OFFSETS])
    h = np.ones((len(at), WIDTH + 1), np.float32)
    rows = net["embed"].take(near, 0)
    np.tanh(np.einsum("jid,jd->id", rows, net["place"]) + net["hidden"], out=h[:, :WIDTH])
    return near, rows, h


def _summed(weights: np.ndarray) -> np.ndarray:
    """Weights with ones in place of the constant's: exp(z) @ these gives the pull on h and, last, the sum."""
    out = weights.copy()
    out[:, -1] = 1
    return out


def _runs(numbers: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts, and the end."""
    return np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True])


def _pull(h: np.ndarray, weights: np.ndarray, summed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the whole distribution adds to the gradients of minus log-likelihood by h and by weights."""
    z = h @ weights.T
    e = np.exp(z, out=z)
    both = e @ summed
    total = both[:, -1:].copy()
    both /= total
    return both, e.T @ (h / total)


def _total(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = h @ weights.T
    return np.exp(z, out=z) @ np.ones(len(weights), np.float32)


def _sums(places: np.ndarray, columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """A row for each of n places: the sums of the columns there."""
    return np.stack([np.bincount(places, c, n) for c in columns], 1).astype(np.float32)


def _step(net: dict[str, np.ndarray], name: str, grad: np.ndarray, rate: float) -> None:
    """A step against the gradient, smaller where there have been large ones. No weight gets so large that exp() overflows."""
    net[f"{name}^2"] += grad * grad
    net[name] -= rate * grad / np.sqrt(net[f"{name}^2"])
    np.clip(net[name][..., :WIDTH], -LARGE, LARGE, out=net[name][..., :WIDTH])


def learn(net: dict[str, np.ndarray], words: np.ndarray, rate: float = RATE) -> None:
    """One pass over a strip of places in the order of frequency."""
    every = np.flatnonzero(words != PAD)
    for first in range(0, len(every), BATCH):
        at = every[first : first + BATCH]
        at = at[np.argsort(words[at], kind="stable")]
        true = words[at]
        near, rows, h = _forward(net, words, at)
        out, turn = net["out"], net["turn"]
        summed, g_turn = _summed(turn), np.zeros_like(turn)
        kind = true // SIDE
        dh, g_out = _pull(h, out, _summed(out))
        dh -= out.take(kind, 0)
        dh -= turn.take(true, 0)
        ends = _runs(kind)
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            c = int(kind[a]) * SIDE
            more, g_turn[c : c + SIDE] = _pull(h[a:b], turn[c : c + SIDE], summed[c : c + SIDE])
            dh[a:b] += more
        g_out[kind[ends[:-1]]] -= np.add.reduceat(h, ends[:-1])
        ends = _runs(true)[:-1]
        g_turn[true[ends]] -= np.add.reduceat(h, ends)
        size = np.float32(1 / len(at))
        h = h[:, :-1]
        dh = dh[:, :-1] * (1 - h * h) * size
        _step(net, "place", np.einsum("jid,id->jd", rows, dh), rate)
        _step(net, "hidden", dh.sum(0), rate)
        _step(net, "embed", _sums(near.ravel(), np.concatenate([dh.T * p[:, None] for p in net["place"]], 1), BUCKETS + 1), rate)
        _step(net, "out", g_out * size, rate)
        _step(net, "turn", g_turn * size, rate)


def log_likelihood(net: dict[str, np.ndarray], words: np.ndarray) -> np.ndarray:
    """log P(number | its neighbours) at each place of a strip, 0 for padding; numbers as places in the order of frequency."""
    found = np.zeros(len(words))
    every = np.flatnonzero(words != PAD)
    for first in range(0, len(every), STEP):
        at = every[first : first + STEP]
        at = at[np.argsort(words[at], kind="stable")]
        true = words[at]
        _, _, h = _forward(net, words, at)
        kind = true // SIDE
        said = np.einsum("id,id->i", h, net["out"].take(kind, 0) + net["turn"].take(true, 0))
        total = _total(h, net["out"])
        ends = _runs(kind)
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            c = int(kind[a]) * SIDE
            total[a:b] *= _total(h[a:b], net["turn"][c : c + SIDE])
        said -= np.log(total)
        found[at] = said
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word occurs in the corpus, without a limit on their number."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        held = Counter()
        for _, text in pairs(batches):
            held.update(words_of(text))
            if len(held) >= HELD:
                yield from batched(held.items(), schema, lambda row: len(row[0]))
                held.clear()
        yield from batched(held.items(), schema, lambda row: len(row[0]))

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """The numbers of broadcast words; the most frequent ones have their own. None for others."""

    def __init__(self, frequent: list[tuple[bytes, int]]):
        ordered = sorted(frequent, key=lambda x: (-x[1], x[0]))
        super().__init__((w, i if i < OWN else hashed(w)) for i, (w, _) in enumerate(ordered))
        self.logs = dict(zip(self, np.log([n for _, n in ordered]).tolist(), strict=True))
        self.own = ordered[:OWN]

    def __missing__(self, word):
        return None


def number_counts(words: DataFrame, numbers: Numbers) -> np.ndarray:
    """How often each number occurs, from word_counts()."""
    found = words.groupBy(F.expr(f"{OWN} + crc32(word) % {BUCKETS - OWN}").alias("number")).agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[found["number"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    for i, (word, n) in enumerate(numbers.own):
        out[i] = n
        out[hashed(word)] -= n
    return out


def encode(docs: DataFrame, numbers: Numbers, place: np.ndarray) -> DataFrame:
    """doc_id, mark (a hash of id and text), codes (the place of each word's number, two bytes), known (sum of log n of broadcast words), rest (all other words, repeats included)."""
    shared = docs.sparkSession.sparkContext.broadcast((numbers.own, dict(numbers), numbers.logs, place))
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("codes", pa.binary()), ("known", pa.float64()), ("rest", pa.list_(pa.binary()))])

    def run(batches):
        _, number, logs, place = shared.value
        code = {w: int(place[n]) for w, n in number.items()}

        def rows():
            for batch in batches:
                for (doc_id, text), mark in zip(pairs([batch]), batch.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    codes = [*map(code.get, words)]
                    rest = []
                    if None in codes:
                        for i, c in enumerate(codes):
                            if c is None:
                                rest.append(words[i])
                                codes[i] = int(place[hashed(words[i])])
                    known = sum(map(logs.get, words)) if not rest else sum(x for x in map(logs.get, words) if x is not None)
                    yield doc_id, mark, np.array(codes, np.uint16).tobytes(), float(known), rest

        yield from batched(rows(), schema, lambda row: len(row[2]) + sum(map(len, row[4])) + 8 * len(row[4]))

    return docs.withColumn("mark", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, mark long, codes binary, known double, rest array<binary>")


def _flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def rounds_of(total: int, block: int = BLOCK, group: int = GROUP, most: int = MOST) -> tuple[int, int]:
    """(blocks, rounds of a pass) for a corpus of `total` words."""
    blocks = max(1, -(-total // block))
    return blocks, min(-(-blocks // group), most)


def deal(rows: DataFrame, blocks: int, rounds: int, path: str) -> None:
    """Write encoded rows with key, block and round: all of a block in one file, in order, and a file for one round's blocks.

    Texts without words, which may be very many and equal, are dealt out by key.
    """
    named = rows.withColumn("key", F.monotonically_increasing_id())
    block = F.expr(f"cast(pmod(IF(octet_length(codes) = 0, key, mark), {blocks}) as int)")
    dealt = named.withColumn("block", block).withColumn("round", F.expr(f"cast(block % {rounds} as int)"))
    dealt.repartition(blocks, "block").sortWithinPartitions("round", "block", "mark", "codes").write.partitionBy("round").parquet(path)


def train(rows: DataFrame, net: dict[str, np.ndarray], rounds: int, passes: int = ROUNDS, least: int = LEAST) -> dict[str, np.ndarray]:
    """The network after `passes` over every row (block, codes, round), or as many as `least` rounds need."""
    spark = rows.sparkSession
    schema = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
    for step in range(max(passes, -(-least // rounds)) * rounds):
        shared = spark.sparkContext.broadcast(net)

        def fit(batches, shared=shared):
            begun = shared.value
            at, own, n = None, None, 0

            def told():
                if n:
                    flat = np.array_split(_flat(own).astype(np.float64) * n, SLICES)
                    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES), pa.array([x.astype(np.float32).tobytes() for x in flat])], schema=schema)

            for key, part in groupby(coded(batches), lambda row: row[0]):
                if key != at:
                    yield from told()
                    at, own, n = key, {k: v.copy() for k, v in begun.items()}, 0
                for _, sizes, words in strips((0, codes) for _, codes in part):
                    learn(own, words)
                    n += int(sizes.sum())
            yield from told()

        def add(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for k, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    have = sums.setdefault(k, [0, 0.0])
                    have[0] += n
                    have[1] = have[1] + np.frombuffer(blob, np.float32).astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[0] for v in sums.values()]), pa.array([(v[1] / v[0]).astype(np.float32).tobytes() for v in sums.values()])], schema=schema)

        ddl = "slice int, n long, sums binary"
        now = rows.where(F.col("round") == step % rounds).select("block", "codes")
        parts = now.mapInArrow(fit, ddl).repartition("slice").mapInArrow(add, ddl).collect()
        shared.destroy()
        if parts:
            net = _shaped(np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(parts, key=lambda r: r["slice"])]), net)
    return net


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = ROUNDS, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, pll (sum of conditional log-probabilities, natural) and mean_logp of every row; `passes` is the least number of passes."""
    spark = df.sparkSession
    docs = id_text(df, id_col, text_col)
    table, coding = shared_path(spark, "words"), shared_path(spark, "codes")
    word_counts(docs).write.parquet(table)
    words = spark.read.parquet(table)
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    numbers = Numbers([(bytes(r["word"]), r["n"]) for r in words.where(F.col("n") * share >= total).collect()])
    classes = Classes(number_counts(words, numbers))
    blocks, rounds = rounds_of(total, block)
    deal(encode(docs, numbers, classes.place), blocks, rounds, coding)
    rows = spark.read.schema("doc_id long, codes binary, known double, rest array<binary>, key long, block int, round int").parquet(coding)
    net = train(rows, start(classes), rounds, passes) if total else start(classes)
    shared = spark.sparkContext.broadcast((net, classes.share[np.argsort(classes.place[:BUCKETS])]))
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("near", pa.float64()), ("doc_id", pa.int64()), ("known", pa.float64())])

    def run(batches):
        net, share = shared.value

        def found():
            held: list = []

            def noted():
                for batch in batches:
                    held.extend(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
                    yield batch

            for keys, sizes, codes in strips(coded(noted())):
                each = log_likelihood(net, codes)
                inside = codes != PAD
                each[inside] += share[codes[inside]]
                total = np.r_[0, np.cumsum(each)]
                first = WINDOW + np.cumsum(sizes + WINDOW) - (sizes + WINDOW)
                sums = total[first + sizes] - total[first]
                for key, n, s, (doc_id, known) in zip(keys, sizes.tolist(), sums.tolist(), held[: len(keys)], strict=True):
                    yield key, n, s if n else 0.0, doc_id, known
                del held[: len(keys)]

        yield from batched(found(), schema, lambda row: 40)

    near = rows.select("key", "codes", "doc_id", "known").mapInArrow(run, "key long, n_tokens long, near double, doc_id long, known double")
    rest = rows.select(F.col("key").alias("of"), F.explode("rest").alias("word")).join(words, "word").groupBy("of").agg(F.sum(F.log("n")).alias("rest"))
    pll = (F.col("near") + F.col("known") + F.coalesce("rest", F.lit(0.0))).alias("pll")
    both = near.join(rest, near["key"] == rest["of"], "left").select("doc_id", "n_tokens", pll)
    return both.select("doc_id", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_logp"))
