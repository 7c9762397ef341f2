"""Quality classifier: random-indexing word vectors pooled by document, a two-layer network, calibrated probabilities.

Tokens are runs of letters (lower-cased), digits or other marks, with a mark for capitals; they are hashed into BUCKETS.
Every bucket has a sparse random index vector (SPARSE entries of +1 or -1, from the hash). A bucket's word
vector is the sum of its neighbours' index vectors (WINDOW on either side) over all texts, scaled to length 1, beside its own index vector; a document pools the means of its tokens' vectors, and simple shape
numbers of the text. A network with one hidden layer is trained in numpy with a part of the rows held
back, on which a temperature is fitted that divides the logit before the sigmoid.

The network's training rows are a bounded sample (TRAIN_DOCS) of labelled documents, whole texts; neighbour sums,
which need no label, are taken over all documents and added up by tasks into BUCKETS x DIM numbers. Defined cases: null and empty texts have zero vectors and get a score
as any other; labels that are null or not 0 or 1 are left out; repeated labels of a document are averaged
and count as 1 from one half on; with no label, or with labels of one kind, the score is the smoothed share of
label 1; rows with equal ids are scored as rows of their own; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIM, SPARSE, WINDOW = 1 << 15, 48, 6, 2
TRAIN_DOCS = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
#: Every HOLD-th training row is held back for the temperature and for stopping.
HOLD = 5
SLICE = 2 << 20
#: Tokens whose neighbour sums are held at once.
PIECE = 1 << 16

#: Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other mark; bytes of other scripts count as letters.
KIND = np.full(256, 3, np.uint8)
KIND[C.WHITE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SHAPES = 15


def index_vectors(seed: int = 9) -> np.ndarray:
    r = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.float32)
    at = np.argsort(r.random((BUCKETS, DIM)), axis=1)[:, :SPARSE]
    out[np.arange(BUCKETS)[:, None], at] = r.choice([-1.0, 1.0], (BUCKETS, SPARSE))
    return out


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all tokens, token offsets of the rows, shape numbers of the rows."""
    n_rows = len(offsets) - 1
    shape = np.zeros((n_rows, SHAPES), np.float32)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(n_rows + 1, np.int64), shape
    kind = KIND[raw]
    cut = np.ones(len(raw), bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(raw))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    hashes = C.span_hash(C.prefix_hash(C.LOWER[raw]), starts, ends)
    caps = np.concatenate(([0], np.cumsum(UPPER[raw])))
    letters = kind[starts] == 1
    shouted = letters & (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    hashes = np.where(shouted, hashes ^ C.MIX_A, hashes)
    bucket = (C.mix(hashes) % C.U64(BUCKETS)).astype(np.int32)
    at = np.searchsorted(starts, offsets, side="left")
    n = np.maximum(np.diff(at), 1).astype(np.float64)
    size = np.diff(offsets)

    def share(flags, of, bounds=at):
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[bounds[1:]] - total[bounds[:-1]]) / of

    some = np.maximum(size, 1)
    row = np.repeat(np.arange(n_rows), np.diff(at))
    pair = np.unique(row.astype(np.int64) * BUCKETS + bucket)
    distinct = np.bincount(pair // BUCKETS, minlength=n_rows)
    together = row[1:] == row[:-1]  # neighbours in one row
    inside = row[1:] == row[:-1]  # neighbours of one row
    bigram = np.unique((row[:-1][inside].astype(np.uint64) << C.U64(40)) ^ (C.mix(hashes[:-1][inside] * C.U64(3) + hashes[1:][inside]) >> C.U64(24)))
    bigrams = np.bincount((bigram >> C.U64(40)).astype(np.int64), minlength=n_rows)
    shape[:, 0] = np.log1p(size)
    shape[:, 1] = np.log1p(np.diff(at))
    shape[:, 2] = share(kind[starts] == 3, n)
    shape[:, 3] = share(kind[starts] == 2, n)
    shape[:, 4] = share(shouted, n)
    shape[:, 5] = share(UPPER[raw], some, offsets)
    shape[:, 6] = share(kind == 3, some, offsets)
    shape[:, 7] = share(kind == 0, some, offsets)
    shape[:, 8] = share(raw == 10, some, offsets) * 10
    shape[:, 9] = share((ends - starts) * letters, n) / 8
    shape[:, 10] = share((ends - starts > 12) & letters, n)
    shape[:, 11] = distinct / n
    shape[:, 12] = np.minimum(bigrams / n, 2)
    shape[:, 13] = size == 0
    again = np.zeros(len(row), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    shape[:, 14] = share(again, n)
    return bucket, at, shape


def pool(bucket: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each row's tokens, in pieces that bound the temporaries."""
    out = np.zeros((len(at) - 1, vectors.shape[1]))
    step = 1 << 15
    for a in range(0, len(bucket), step):
        b = min(a + step, len(bucket))
        clip = np.clip(at, a, b) - a
        rows = np.flatnonzero(np.diff(clip))
        out[rows] += np.add.reduceat(vectors[bucket[a:b]], clip[rows], axis=0, dtype=np.float64)
    return out / np.maximum(np.diff(at), 1)[:, None]


def beside(vectors: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each token, the sum of its neighbours' vectors in the same row."""
    out = np.zeros_like(vectors)
    for d in range(1, min(WINDOW, len(row) - 1) + 1):
        same = (row[d:] == row[:-d]).astype(vectors.dtype)[:, None]
        out[:-d] += vectors[d:] * same
        out[d:] += vectors[:-d] * same
    return out


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Index vectors beside the scaled sums of the neighbours' index vectors: BUCKETS x 2 DIM. The sums are whole numbers in doubles, so their order doesn't matter."""
    index = index_vectors()

    def run(batches):
        index = index_vectors().astype(np.int8)
        total = np.zeros((BUCKETS, DIM))
        some = False
        for big in batches:
            for b in C.slices(big, "text", SLICE):
                bucket, at, _ = tokens(*C.text_buffer(b.column("text")))
                some |= len(bucket) > 0
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for lo in range(0, len(bucket), PIECE):
                    hi = min(lo + PIECE, len(bucket))
                    a, z = max(lo - WINDOW, 0), min(hi + WINDOW, len(bucket))
                    near = beside(index[bucket[a:z]], row[a:z])[lo - a : hi - a]
                    order = np.argsort(bucket[lo:hi].astype(np.uint16), kind="stable")  # a radix sort
                    ids, first = C.runs(bucket[lo:hi][order])
                    total[ids] += np.add.reduceat(near[order], first[: len(ids)], axis=0, dtype=np.int32)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array([total[k * (BUCKETS // 64) : (k + 1) * (BUCKETS // 64)].tobytes() for k in range(64)], pa.binary())], ["part", "v"])

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("part").to_pylist(), b.column("v").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "v"])

    schema = "part int, v binary"
    rows = texts.select("text")
    # two levels of sums: each task reads the square root of the tasks' number of parts, not all of them
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    first = rows.mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition(64 * salts, "part", "salt").select("part", "v").mapInArrow(add_up, schema)
    found = first.repartition(64, "part").mapInArrow(add_up, schema).toArrow()
    context = np.zeros((64, BUCKETS // 64 * DIM))
    for k, v in zip(found["part"].to_pylist(), found["v"].to_pylist()):
        context[k] = np.frombuffer(v, np.float64)
    context = context.reshape(BUCKETS, DIM)
    context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return np.concatenate((index / np.sqrt(SPARSE), context), axis=1).astype(np.float32)


class Network:
    """Inputs (standardised), one hidden layer with tanh, a logit and a temperature; trained by Adam."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        self.share = (y.sum() + 1) / (len(y) + 2)
        self.plain = len(y) < 10 or y.min() == y.max()
        self.temperature = 1.0
        if self.plain:
            return
        r = np.random.default_rng(seed)
        held = np.arange(len(y)) % HOLD == 0
        self.mean, self.spread = x[~held].mean(0), x[~held].std(0) + 1e-3
        z = ((x - self.mean) / self.spread).astype(np.float32)
        n = z.shape[1]
        w = [(r.standard_normal((n, HIDDEN)) / np.sqrt(n)).astype(np.float32), np.zeros(HIDDEN, np.float32), (r.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        train = np.flatnonzero(~held)
        best, self.w = np.inf, w
        for _ in range(EPOCHS):
            order = r.permutation(train)
            for a in range(0, len(order), BATCH):
                i = order[a : a + BATCH]
                h = np.tanh(z[i] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = ((p - y[i]) / len(i)).astype(np.float32)
                dh = d[:, None] * w[2] * (1 - h * h)
                grads = [z[i].T @ dh + DECAY * w[0], dh.sum(0), h.T @ d + DECAY * w[2], d.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            loss = self._loss(self._logit(z[held], w), y[held], 1.0)
            if loss < best:
                best, self.w = loss, [a.copy() for a in w]
        logit = self._logit(z[held], self.w)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(grid[np.argmin([self._loss(logit, y[held], g) for g in grid])])

    @staticmethod
    def _logit(z, w):
        return np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]

    @staticmethod
    def _loss(logit, y, temperature):
        s = np.clip(logit / temperature, -30, 30)
        return float(np.mean(np.log1p(np.exp(s)) - y * s))

    def fold(self, vectors: np.ndarray) -> np.ndarray:
        """Word vectors times the first layer: as pooling is linear, pooling these gives the layer's share of the pooled vectors."""
        d = vectors.shape[1]
        return vectors[:, :1] if self.plain else ((vectors / self.spread[:d]) @ self.w[0][:d]).astype(np.float32)

    def predict(self, folded: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Probabilities from pooled folded vectors and shape numbers."""
        if self.plain:
            return np.full(len(shape), self.share)
        d = len(self.mean) - shape.shape[1]
        rest = ((shape.astype(np.float64) - self.mean[d:]) / self.spread[d:]) @ self.w[0][d:] + self.w[1]  # doubles: no trace of a row's neighbours
        hidden = np.tanh(folded + rest - (self.mean[:d] / self.spread[:d]) @ self.w[0][:d])
        logit = hidden @ self.w[2] + self.w[3]
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30).astype(np.float64)))


def _features(b, vectors: np.ndarray) -> np.ndarray:
    bucket, at, shape = tokens(*C.text_buffer(b.column("text")))
    return np.concatenate((pool(bucket, at, vectors), shape), axis=1)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, Network]:
    """Word vectors and the network, from documents joined with their labels."""
    truth = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = C.bounded_sample(truth.join(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi"), ["id"], train_docs)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most train_docs ids
    rows = C.materialise(rows.dropDuplicates(["id"]), "quality-train")
    vectors = word_vectors(docs.select(F.col(text).alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for big in batches:
            for b in C.slices(big, "text", SLICE):
                x = _features(b, shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "y", "x"])

    found = rows.mapInArrow(run, "id string, y int, x binary").orderBy("id").toArrow()
    x = np.array([np.frombuffer(v.as_py(), np.float32) for v in found["x"]]) if found.num_rows else np.zeros((0, 2 * DIM + SHAPES), np.float32)
    y = found["y"].to_numpy().astype(np.float32)
    C.discard(rows)
    return vectors, Network(x, y)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score and predicted to the kept columns (default: all)."""
    keep = C.kept(docs.columns if keep is None else keep, ["score", "predicted"])
    schema = docs.select(*keep).limit(0).selectExpr("*", "0D score", "0 predicted").schema
    shared = docs.sparkSession.sparkContext.broadcast((network.fold(vectors), network))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        folded, network = shared.value
        for big in batches:
            for b in C.slices(big, "__text", SLICE):
                bucket, at, shape = tokens(*C.text_buffer(b.column("__text")))
                p = network.predict(pool(bucket, at, folded), shape)
                yield pa.RecordBatch.from_arrays([*[b.column(n).cast(arrow.field(n).type) for n in keep], pa.array(p.astype(np.float64)), pa.array((p >= 0.5).astype(np.int32))], schema=arrow)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = C.crc_mod("doc_id", 3) == 1
    vectors, network = fit(docs, labels.where(~out))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), vectors, network, keep=["doc_id", "held_out"])
