"""Word vectors: skip-gram with hierarchical softmax, one pass over the words, and texts as the mean of their words' vectors.

The vocabulary is ordered by count, ties by hash; a Huffman code over all counts gives every word its path. Sentences are
dealt over tasks, each of which learns from runs of its own sentences that touch up to ``ROWS`` vectors. Every run begins with
the same vectors (they follow from word and seed) and lowers its rate from the given one to almost none; a word's vector is
the mean over the runs that moved it. More partitions train faster, one is the most accurate.

In a run, ``BLOCK`` words in sequence meet the words around them and the nodes of their paths in three matrix products. Pairs
of a block see the vectors as they were before it.

Vectors are never on the driver and never all in one task: they are averaged by blocks of words, stored, and go to the parts
of the texts that have their words. The driver and every task hold the hashes of the vocabulary and its tree (20 bytes a word).

Defined results: words are known by 64-bit hashes; rare words count in the length of a text only; a text without known words
has a vector of zeros; equal texts have equal vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.plans.runtime import new_path, stored

ROWS = 400_000  # vectors of words and nodes that a run touches
RUN = 1 << 22  # words of a task, about
STEP = 8192  # words that are laid out at once
BLOCK = 4  # words that are learned from at once
SURE = 6.0  # scores from here on teach nothing
SENTENCE = 1000  # words of a sentence; longer ones are cut
AVERAGED = 1 << 16  # vectors that are averaged at once
PART_WORDS = 1 << 24  # words of a part of the texts, about
PART_TEXTS = 1 << 15
SUMMED = 1 << 14  # words whose vectors are added up at once


# ---- vocabulary ----------------------------------------------------------------------------------------------

class Vocabulary:
    """Words by number, the most frequent first."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.lexsort((hashes, -counts))
        self.counts = counts[order]
        by_hash = np.argsort(hashes[order])
        self.hashes, self.number = hashes[order][by_hash], by_hash.astype(np.int32)

    def coded(self, column: pa.Array) -> pa.ListArray:
        """Lists of hashes as lists of numbers, without unknown words."""
        flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        known = self.hashes[at] == flat
        kept = np.append(0, np.cumsum(known))[offsets]
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(self.number[at[known]]))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, right) of each node of the code's tree: words first, then inner nodes, the root, without a parent, last."""
    n = len(counts)
    parent, right = np.full(2 * n - 1, -1, np.int32), np.zeros(2 * n - 1, bool)
    node, size, new = np.arange(n)[::-1], counts[::-1].astype(np.int64), n
    while len(node) > 1:
        k = int(np.searchsorted(size, size[0] + size[1]))  # whatever is merged from now on is not below these
        k -= k % 2
        made = np.arange(new, new + k // 2)
        parent[node[:k:2]] = parent[node[1:k:2]] = made
        right[node[1:k:2]] = True
        node, size, new = np.append(node[k:], made), np.append(size[k:], size[:k:2] + size[1:k:2]), new + k // 2
        order = np.argsort(size, kind="stable")
        node, size = node[order], size[order]
    return parent, right


# ---- learning ------------------------------------------------------------------------------------------------

def first_vectors(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Uniform in plus and minus half of 1 / size, by word, place and seed."""
    out = np.empty((len(words), size), np.float32)
    place = np.arange(size, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for lo in range(0, len(words), STEP):
        x = words[lo:lo + STEP].astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + place * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        out[lo:lo + STEP] = ((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)
    return out


def paths(words: np.ndarray, parent: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, node, code): the inner nodes above each word, and on which side of them it is."""
    owner, node = np.arange(len(words)), words
    found = []
    while len(node):
        up = parent[node]
        owner, node, up = owner[up >= 0], node[up >= 0], up[up >= 0]
        found.append((owner, up, right[node]))
        node = up
    owner, up, code = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(owner, kind="stable")
    return np.append(0, np.cumsum(np.bincount(owner, minlength=len(words)))), up[order], code[order]


def learned(words: np.ndarray, sentence: np.ndarray, parent: np.ndarray, right: np.ndarray, size: int, window: int, rate: float,
            seed: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, moved, vectors) after one pass over a run of words, given with their sentences."""
    own, at = np.unique(words, return_inverse=True)
    start, point, code = paths(own, parent, right)
    nodes, point = np.unique(point, return_inverse=True)
    vectors, outer = first_vectors(own, size, seed), np.zeros((len(nodes), size), np.float32)
    moved = np.zeros(len(own), bool)
    reach = np.random.default_rng([seed, number]).integers(1, window + 1, len(words))
    padded = np.concatenate([np.full(window, -1), sentence, np.full(window, -1)])
    for s in range(0, len(words), STEP):
        e = min(s + STEP, len(words))
        step = np.float32(max(rate * (1 - s / (len(words) + 1)), rate * 1e-4))
        centres = np.arange(e - s)
        center, context = [], []
        for d in [x for x in range(-window, window + 1) if x]:
            met = np.flatnonzero((reach[s:e] >= abs(d)) & (padded[s + window + d:e + window + d] == sentence[s:e]))
            center.append(met)
            context.append(at[met + (s + d)])
        center, context = np.concatenate(center), np.concatenate(context)
        if not len(center) or not len(nodes):
            continue
        moved[context] = True
        blocks = np.arange((e - s - 1) // BLOCK + 2)
        rows, row = np.unique(center // BLOCK * len(own) + context, return_inverse=True)
        around = np.bincount(row * BLOCK + center % BLOCK, minlength=len(rows) * BLOCK).reshape(-1, BLOCK).astype(np.float32)
        row_at, rows = np.searchsorted(rows, blocks * len(own)), rows % len(own)
        n = start[at[s:e] + 1] - start[at[s:e]]
        step_of = np.repeat(centres, n)
        taken = np.arange(len(step_of)) + np.repeat(start[at[s:e]] - np.cumsum(n) + n, n)
        cols, col = np.unique(step_of // BLOCK * len(nodes) + point[taken], return_inverse=True)
        cell = col * BLOCK + step_of % BLOCK
        above = np.bincount(cell, minlength=len(cols) * BLOCK).reshape(-1, BLOCK).astype(np.float32)
        left = np.bincount(cell, weights=~code[taken], minlength=len(cols) * BLOCK).reshape(-1, BLOCK).astype(np.float32)
        col_at, cols = np.searchsorted(cols, blocks * len(nodes)), cols % len(nodes)
        around *= step
        for a, z, b, y in zip(row_at[:-1].tolist(), row_at[1:].tolist(), col_at[:-1].tolist(), col_at[1:].tolist()):
            if a == z:
                continue
            own_rows, own_cols = rows[a:z], cols[b:y]
            inputs, outputs = vectors[own_rows], outer[own_cols]
            g = inputs @ outputs.T
            unsure = np.abs(g) < SURE
            np.clip(g, -SURE, SURE, out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            g *= around[a:z] @ above[b:y].T  # so often is the node above a word that has the row's word around it
            np.subtract(around[a:z] @ left[b:y].T, g, out=g)
            g *= unsure
            change = g.T @ inputs
            inputs += g @ outputs
            outputs += change
            vectors[own_rows] = inputs
            outer[own_cols] = outputs
    return own, moved, vectors


def runs(batches: Iterator[pa.RecordBatch], parent: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, sentence) of runs of sentences that touch about ``most`` vectors."""
    n = (len(parent) + 1) // 2
    seen = np.zeros(len(parent), bool)
    words, lengths, touched = [], [], 0

    def run() -> tuple[np.ndarray, np.ndarray]:
        length = np.concatenate(lengths)
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        cut = (place % SENTENCE == 0).cumsum()  # every sentence, and every cut of one, begins at such a place
        return np.concatenate(words), cut

    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            column = batch.column(0).slice(lo, 64)
            flat, length = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            words.append(flat)
            lengths.append(length[length > 0])
            node = np.unique(flat)
            while len(node):
                node = node[~seen[node]]
                seen[node] = True
                touched += len(node)
                node = np.unique(parent[node])
                node = node[node >= n]
            if touched >= most:
                yield run()
                seen[:] = False
                words, lengths, touched = [], [], 0
    if touched:
        yield run()


def lists(flat: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // max(1, size) + 1, dtype=np.int32) * size), pa.array(flat))


def averaged(rows: pa.Table, size: int) -> pa.Table:
    """(word, vector): the mean over the runs that moved the word, or else the vector it began with."""
    word, moved = rows["word"].to_numpy(), rows["moved"].to_numpy()
    order = np.lexsort((rows["run"].to_numpy(), word))
    word, first = np.unique(word[order], return_index=True)
    n = np.add.reduceat(moved[order].astype(np.int64), first)
    counts = moved[order] | np.repeat(n == 0, np.diff(np.append(first, len(order))))
    vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)
    kept, first = order[counts], np.append(0, np.cumsum(np.add.reduceat(counts.astype(np.int64), first)))
    mean = np.add.reduceat(vectors[kept], first[:-1], axis=0, dtype=np.float64) / np.diff(first)[:, None]
    return pa.table([pa.array(word), lists(mean.astype(np.float32).ravel(), size)], ["word", "vector"])


# ---- stages --------------------------------------------------------------------------------------------------

class Settings(HasInputCol, HasOutputCol, HasSeed, HasStepSize):
    vectorSize = Param(Params._dummy(), "vectorSize", "numbers of a vector", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "least count of a word", TypeConverters.toInt)
    windowSize = Param(Params._dummy(), "windowSize", "words on either side", TypeConverters.toInt)
    numPartitions = Param(Params._dummy(), "numPartitions", "least number of tasks that learn", TypeConverters.toInt)

    def hashed(self) -> Column:
        return F.transform(self.getInputCol(), lambda word: F.xxhash64(word)).alias("hashes")


class WordVectors(Estimator, Settings, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol: str = "kept", outputCol: str = "features", vectorSize: int = 100, minCount: int = 5, windowSize: int = 5,
                 numPartitions: int = 1, stepSize: float = 0.025, seed: int = 42):
        super().__init__()
        self._setDefault(inputCol="kept", outputCol="features", vectorSize=100, minCount=5, windowSize=5, numPartitions=1, stepSize=0.025, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, docs: DataFrame) -> WordVectorsModel:
        spark = docs.sparkSession
        path = new_path(spark, "word-vectors")
        counts = tx.exploded(docs.select(self.hashed()), "hashes", "hash").groupBy("hash").agg(F.count("*").alias("n"))
        counts.where(F.col("n") >= self.getOrDefault("minCount")).write.parquet(f"{path}/words")
        vocabulary = read_vocabulary(spark, path)
        parent, right = huffman(vocabulary.counts)
        held = spark.sparkContext.broadcast((vocabulary, parent, right))
        size, window, rate, seed, most = self.getOrDefault("vectorSize"), self.getOrDefault("windowSize"), self.getStepSize(), self.getSeed(), ROWS
        tasks = max(self.getOrDefault("numPartitions"), math.ceil(int(vocabulary.counts.sum()) / RUN))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, parent, right = held.value
            for number, (words, sentence) in enumerate(runs(batches, parent, most)):
                number += TaskContext.get().partitionId() << 32
                word, moved, vectors = learned(words, sentence, parent, right, size, window, rate, seed, number)
                for lo in range(0, len(word), 4096):
                    part = vectors[lo:lo + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(word[lo:lo + 4096]), pa.array(np.full(len(part), number, np.int64)), pa.array(moved[lo:lo + 4096]), lists(part.ravel(), size)],
                        ["word", "run", "moved", "vector"])

        coded = coded_texts(docs.select(self.hashed()), held).repartition(tasks)
        found = coded.mapInArrow(learn, "word int, run long, moved boolean, vector array<float>")
        block = F.floor(F.col("word") / max(1, AVERAGED // tasks))
        found.groupBy(block).applyInArrow(lambda rows: averaged(rows, size), "word int, vector array<float>").write.parquet(f"{path}/vectors")
        model = WordVectorsModel()
        model._resetUid(self.uid)
        self._copyValues(model)
        return model._set(path=path)


def read_vocabulary(spark, path: str) -> Vocabulary:
    words = spark.read.parquet(f"{path}/words").toArrow()
    if not words.num_rows:
        raise ValueError("no word is frequent enough for the vocabulary")
    return Vocabulary(words["hash"].to_numpy(), words["n"].to_numpy())


def coded_texts(hashed: DataFrame, held) -> DataFrame:
    """The last column, lists of hashes, as lists of word numbers named ``words``."""
    *keep, _ = hashed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], held.value[0].coded(part.columns[-1])], [*keep, "words"])

    return hashed.mapInArrow(run, ", ".join([*(f"{c} {hashed.schema[c].dataType.simpleString()}" for c in keep), "words array<int>"]))


def summed(texts: pa.Table, given: pa.Table, size: int) -> pa.Table:
    """(a, b, vector): the texts' means, from the vectors of all their words."""
    word = given["word"].to_numpy()
    order = np.argsort(word)
    word, vectors = word[order], given["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)
    column = texts["words"].combine_chunks()
    flat, length = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(column)), length)
    out = np.zeros((len(column), size))
    for lo in range(0, len(flat), SUMMED):
        at, own = order[np.searchsorted(word, flat[lo:lo + SUMMED])], row[lo:lo + SUMMED]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] += np.add.reduceat(vectors[at], first, axis=0, dtype=np.float64)
    out /= np.maximum(1, texts["n"].to_numpy())[:, None]
    return pa.table([texts["a"], texts["b"], lists(out.astype(np.float32).ravel(), size)], ["a", "b", "vector"])


class VectorsWriter(MLWriter):
    def __init__(self, model: WordVectorsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name in ("words", "vectors"):
            self.sparkSession.read.parquet(f"{self.model.getOrDefault('path')}/{name}").write.parquet(f"{path}/{name}")


class VectorsReader(MLReader):
    def load(self, path: str) -> WordVectorsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = WordVectorsModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._set(path=path)


class WordVectorsModel(Model, Settings, MLReadable, MLWritable):
    """The vectors stored under ``path``: ``words`` (hash, n) and ``vectors`` (word, vector)."""

    path = Param(Params._dummy(), "path", "folder of the vocabulary and the vectors", TypeConverters.toString)

    def vectors(self, spark) -> DataFrame:
        return spark.read.schema("word int, vector array<float>").parquet(f"{self.getOrDefault('path')}/vectors")

    def _transform(self, docs: DataFrame) -> DataFrame:
        """The vectors of the distinct texts are made at once and joined to the rows by two hashes of their words."""
        spark, size = docs.sparkSession, self.getOrDefault("vectorSize")
        held = spark.sparkContext.broadcast((read_vocabulary(spark, self.getOrDefault("path")),))
        text = F.col(self.getInputCol())
        keys = [F.xxhash64(text).alias("a"), F.hash(text).alias("b")]
        texts = stored(coded_texts(docs.select(*keys, F.size(text).alias("n"), self.hashed()), held).dropDuplicates(["a", "b"]), "coded")
        total, rows = texts.agg(F.sum(F.size("words")), F.count("*")).first()
        parts = max(self.getOrDefault("numPartitions"), math.ceil((total or 0) / PART_WORDS), math.ceil(rows / PART_TEXTS))
        dealt = texts.withColumn("part", F.pmod("a", F.lit(parts)).cast("int"))

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.empty(0, np.int64)
            for batch in batches:
                words = batch.column(1)
                pair = np.repeat(batch.column(0).to_numpy().astype(np.int64) << 32, words.value_lengths().to_numpy()) + words.flatten().to_numpy()
                found = np.union1d(found, pair)
            yield pa.RecordBatch.from_arrays([pa.array((found >> 32).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32))], ["part", "word"])

        wanted = dealt.select("part", "words").mapInArrow(distinct, "part int, word int").distinct()
        given = wanted.join(self.vectors(spark), "word").select("part", "word", "vector")
        found = stored(dealt.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(
            lambda mine, theirs: summed(mine, theirs, size), "a long, b int, vector array<float>"), "text-vectors")
        left = docs.withColumns({"__a": keys[0], "__b": keys[1]}).join(found.toDF("__a", "__b", "__vector"), ["__a", "__b"], "left")
        return left.select(*docs.columns, array_to_vector(F.col("__vector").cast("array<double>")).alias(self.getOutputCol()))

    def write(self) -> VectorsWriter:
        return VectorsWriter(self)

    @classmethod
    def read(cls) -> VectorsReader:
        return VectorsReader()
