"""Mixing sources to target weights by blocks of words.

The words of a source, document after document, are packed into blocks of
BLOCK words. The mix is a row of output shards of SHARD slots; each shard draws
how many of its slots each source gets from a multinomial distribution, alone
and from its own seed. The slots of a source are numbered over all shards, and
a pseudorandom permutation of the source's block numbers, another one each
time round, says which block a slot takes. Slots and blocks meet by number.

What the draws give a source beyond its quota goes to sources that are below
theirs, and a source's last slot takes only part of its block, so that a
source's words are its target, rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtext.llm.common import BLANK_CLASS, ROW, WORD_CLASS, documents, row_name, staged

#: Weights of the sources in order, repeating; words of the mix by those of the table; times a document is used at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
#: Words of a block, slots of a shard.
BLOCK, SHARD = 1024, 1024
SEED = 11
#: More sources than this are an error: their sizes and weights are known to every task.
MOST_SOURCES = 100_000


class Source(NamedTuple):
    """``blocks``: of its words; ``quota``: slots it gets; ``cut``: words of the last of them."""

    name: str | None
    size: int
    target: float
    blocks: int
    quota: int
    cut: int


class Permutation:
    """A pseudorandom permutation of 0 .. n - 1 that needs no table: a Feistel
    network on the next even number of bits, walked on until it lands below n."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.keys = [xxhash.xxh64_intdigest(f"{key}:{r}") for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: int) -> np.ndarray:
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & low
        for key in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
        return a << h | b

    def __call__(self, i: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._pass(np.asarray(i, np.uint64), back)
        while (far := out >= self.n).any():
            out[far] = self._pass(out[far], back)
        return out.astype(np.int64)

    def place_of(self, value: int) -> int:
        """The index that is mapped to ``value``."""
        return int(self(np.array([value]), back=True)[0])


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> list[float]:
    """Words for each source: ``share`` of all words by weight; no source above
    ``most`` times its size, what is over is shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    rest = min(sum(sizes) * share[0] / share[1], float(most * sum(sizes)))
    while open_:
        unit = rest / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = w[i] * unit
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        full = set(full)
        open_ = [i for i in open_ if i not in full]
    return out


def permutation(source: Source, turn: int, seed: int) -> Permutation:
    """Of the source's blocks, the ``turn``-th time round."""
    name = "null" if source.name is None else f"={source.name}"
    return Permutation(source.blocks, xxhash.xxh64_intdigest(f"{seed}:{turn}:{name}"))


def plan(sizes: list[tuple[str | None, int]], block: int, seed: int, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> list[Source]:
    """Sources by name (code points, null last) with their targets and quotas.
    The quota counts full turns over the source's blocks, then the blocks of
    the turn in which the target is reached; one block, the last, may be short."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    out = []
    for (name, size), target in zip(ordered, targets([s for _, s in ordered], weights, share, most)):
        blocks = -(-size // block)
        words = min(round(target), most * size)
        source = Source(name, size, target, blocks, 0, 0)
        if words:
            turn, rest = divmod(words - 1, size)
            rest, short = rest + 1, size - (blocks - 1) * block
            at = permutation(source, turn, seed).place_of(blocks - 1)
            if rest <= at * block:
                n, before = -(-rest // block), 0
            elif rest <= at * block + short:
                n, before = at + 1, 0
            else:
                n, before = -(-(rest + block - short) // block), block - short
            source = source._replace(quota=turn * blocks + n, cut=rest - ((n - 1) * block - before))
        out.append(source)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, id_key, text_key, size, copies): words of each whole
    text; rows equal in id, source and text are one row with their number."""
    # every maximal run of word characters leaves one character
    size = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), f"{WORD_CLASS}+", "x"), f"{BLANK_CLASS}+", ""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *row_name("doc_id", "text"), size.cast("long").alias("size"))
    return staged(rows.groupBy("doc_id", "source", *ROW, "size").agg(F.count(F.lit(1)).alias("copies")), "sized")


def sources_of(rows: DataFrame) -> list[tuple[str | None, int]]:
    """Every source and its words."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [(r.source, r["size"]) for r in found]


def laid(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """(doc_id, id_key, text_key, size, copy, source_no, start): a row for each
    row of the table; ``start`` is the source's words before it.

    A source is dealt into chunks by digest, as many as the root of the rows of
    the table: a source with most of the rows is summed up by many tasks, and
    neither a chunk nor the list of chunks is long."""
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "name string, source_no int")
    rows = rows.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    chunks = 1 + isqrt(rows.count())
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*ROW), F.lit(chunks)))
    words = F.col("size") * F.col("copies")
    before = lambda part, order: F.sum("words").over(Window.partitionBy(*part).orderBy(*order)) - F.col("words")
    sums = rows.groupBy("source_no", "chunk").agg(F.sum(words).alias("words")).withColumn("base", before(["source_no"], ["chunk"])).drop("words")
    part = ["source_no", "chunk"]
    rows = rows.withColumn("words", words).withColumn("inside", before(part, [*ROW, "size"])).drop("words")
    rows = rows.join(sums, part).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return staged(rows.select("doc_id", *ROW, "size", "copy", "source_no", (F.col("base") + F.col("inside") + F.col("copy") * F.col("size")).alias("start")), "laid")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of ``rows`` and (block, first, at, length): a row for each block
    that a document has words in: its first word there, counted in the
    document, its place in the block, and its words there."""
    out = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return out.select("*", (begin - F.col("start")).alias("first"), (begin - F.col("block") * block).alias("at"), (end - begin).alias("length"))


def _shards(spark: SparkSession, sources: list[Source], shard: int, seed: int) -> DataFrame:
    """(shard, source_no, n): the draws; the last shard may have fewer slots."""
    quotas = np.array([s.quota for s in sources], np.int64)
    total = int(quotas.sum())
    p = quotas / max(1, total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for j in b.column("id").to_pylist():
                n = np.random.Generator(np.random.Philox(key=[seed, j])).multinomial(min(shard, total - j * shard), p)
                rows += [(j, int(i), int(n[i])) for i in np.flatnonzero(n)]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64()))], ["shard", "source_no", "n"])

    return spark.range(-(-total // shard)).mapInArrow(work, "shard long, source_no int, n long")


def slots(spark: SparkSession, sources: list[Source], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(source_no, block, turn, words, shard, slot): each slot of the mix with
    the block it takes and how many of the block's words, null for all.

    Draws are numbered by a running sum over groups of shards, as many as the
    root of the shards, and one within each. What lies beyond a source's quota is dropped from the draws, and the
    slots that sources lack, about the square root of all, fill shards of their
    own at the end; their rows are as many as sources and such shards."""
    last = -(-sum(s.quota for s in sources) // shard)
    drawn = staged(_shards(spark, sources, shard, seed), "drawn").withColumn("group", F.expr(f"shard div {1 + isqrt(last)}"))
    sums = drawn.groupBy("source_no", "group").agg(F.sum("n").alias("n"))
    base = sums.select("source_no", "group", (F.sum("n").over(Window.partitionBy("source_no").orderBy("group")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("source_no", "group").orderBy("shard")) - F.col("n")
    known = spark.createDataFrame([(i, s.quota) for i, s in enumerate(sources)], "source_no int, quota long")
    rows = drawn.withColumn("inside", inside).join(base, ["source_no", "group"]).join(F.broadcast(known), "source_no")
    rows = rows.select("source_no", "shard", (F.col("base") + F.col("inside")).alias("before"), "n", "quota")
    rows = rows.withColumn("n", F.least("n", F.col("quota") - F.col("before"))).where("n > 0").drop("quota")
    got = {r.source_no: r.n for r in sums.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    extra, place = [], 0
    for i, s in enumerate(sources):
        have = min(s.quota, got.get(i, 0))
        while have < s.quota:
            n = min(s.quota - have, shard - place % shard)
            extra.append((i, last + place // shard, have, n))
            have, place = have + n, place + n
    if extra:
        rows = rows.unionAll(spark.createDataFrame(extra, "source_no int, shard long, before long, n long"))
    # each row becomes as many as n: its few bytes say nothing about how many tasks it needs
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    rows = rows.withColumn("slot", F.sum("n").over(Window.partitionBy("shard").orderBy("source_no")) - F.col("n"))
    rows = rows.withColumn("of", F.sum("n").over(Window.partitionBy("shard")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], Permutation] = {}
        for b in batches:
            out = [[] for _ in range(6)]
            for i, j, before, n, slot, of in zip(*(b.column(c).to_pylist() for c in ("source_no", "shard", "before", "n", "slot", "of"))):
                s = sources[i]
                g = np.arange(before, before + n)
                turn, index = np.divmod(g, s.blocks)
                block = np.empty(n, np.int64)
                for t in np.unique(turn).tolist():
                    if (i, t) not in made:
                        made[i, t] = permutation(s, t, seed)
                    block[turn == t] = made[i, t](index[turn == t])
                words = np.where(g == s.quota - 1, s.cut, -1)
                # where the source's slots lie in the shard
                lies = Permutation(of, xxhash.xxh64_intdigest(f"{seed}:shard:{j}"))(np.arange(slot, slot + n))
                for column, x in zip(out, (np.full(n, i), block, turn, words, np.full(n, j), lies)):
                    column.append(x)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            arrays = [pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], mask=cols[3] < 0), pa.array(cols[4]), pa.array(cols[5])]
            yield pa.RecordBatch.from_arrays(arrays, ["source_no", "block", "turn", "words", "shard", "slot"])

    return rows.mapInArrow(work, "source_no int, block long, turn int, words long, shard long, slot long")


class Mix(NamedTuple):
    """``rows``: every row of the table, see ``laid``; ``mixed``: (shard, slot,
    at, source_no, block, turn) and the names (doc_id, id_key, text_key, copy, start),
    ``first`` word and ``length`` of each piece of a document in the mix."""

    sources: list[Source]
    rows: DataFrame
    mixed: DataFrame


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST,
        block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """(doc_id, text, source, ...) to the mix.

    Sources are weighed in order of their names by code point, null last; the
    empty name is a source of its own. A document's words are in the mix
    ``most`` times at most. Null and empty texts have no words and no piece;
    null ids and repeated rows are laid each for itself; other columns are
    ignored; no rows or no words give no piece. The same table and seed give
    the same mix, however the table is split."""
    rows = sized(docs)
    sources = plan(sources_of(rows), block, seed, weights, share, most)
    rows = laid(rows, sources)
    # the slots grow with the table: never broadcast, whatever their estimate
    taken = slots(docs.sparkSession, sources, shard, seed).hint("merge").join(pieces(rows, block), ["source_no", "block"])
    length = F.least("length", F.coalesce(F.col("words") - F.col("at"), F.col("length")))
    names = ["source_no", "block", "turn", "doc_id", *ROW, "copy", "start", "first"]
    return Mix(sources, rows, taken.where("words is null or at < words").select("shard", "slot", "at", *names, length.alias("length")))


def texts(docs: DataFrame, mixed: Mix, block: int = BLOCK) -> DataFrame:
    """(shard, slot, text): the words of each slot of ``mix(docs)``, joined by
    spaces. Documents are cut into their blocks' pieces where they lie; a slot
    has no more words than a block."""
    whole = docs.select("text", *row_name("doc_id", "text")).dropDuplicates(ROW)
    whole = whole.select(*ROW, F.filter(F.split("text", f"{BLANK_CLASS}+"), lambda w: w != "").alias("words"))
    rows = mixed.rows.where("size > 0").select(*ROW, "source_no", "start", "size").join(whole, ROW)
    begin = lambda b: F.greatest(b * block, F.col("start"))
    end = lambda b: F.least((b + 1) * block, F.col("start") + F.col("size"))
    cut = lambda b: F.slice("words", (begin(b) - F.col("start") + 1).cast("int"), (end(b) - begin(b)).cast("int"))
    blocks = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    parts = rows.select("source_no", "start", F.explode(F.transform(blocks, lambda b: F.struct(b.alias("block"), cut(b).alias("words")))).alias("part"))
    parts = parts.select("source_no", "start", "part.block", "part.words")
    found = mixed.mixed.select("source_no", "start", "block", "shard", "slot", "at", "length").join(parts, ["source_no", "start", "block"])
    part = F.struct("at", F.array_join(F.slice("words", F.lit(1), F.col("length").cast("int")), " ").alias("text"))
    lists = found.groupBy("shard", "slot").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return lists.select("shard", "slot", F.array_join(F.col("parts.text"), " ").alias("text"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    taken = out.mixed.groupBy("source_no", "start").agg(F.sum("length").alias("taken"))
    # a row with words is named by its source and start
    taken = taken.select(F.col("source_no").alias("s"), F.col("start").alias("b"), "taken")
    rows = out.rows.join(taken, (F.col("size") > 0) & (F.col("source_no") == F.col("s")) & (F.col("start") == F.col("b")), "left")
    known = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(out.sources)], "source_no int, source_size long, target double")
    rows = rows.join(F.broadcast(known), "source_no")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
