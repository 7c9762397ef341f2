"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end a text. The prediction is the sum of the vectors of the CONTEXT tokens
before, each scaled by its position; an output scores by its product with the prediction plus a bias. Outputs have two
levels. On the first, the most frequent words and the end are outputs of their own, other words share classes by
their last bytes. On the second, each class has an output for each of its WORDS most frequent words and one for
its remaining words, among which a word has its smoothed share of the training counts, with a place for unknown
words. So up to 10,000 words have vectors of their own and the others a factor learned for their class.
Batched matrix products give all scores of a level, which a softmax normalises, so probabilities of all known words and
the unknown places add up to 1.

Counts are gathered over all training texts. The vectors are trained in numpy by NCE on both levels: a short start on a
bounded sample, then a pass over all training texts, dealt to shards by a hash of the row, in an order that the hash
fixes. Every shard goes on from the start on its own tokens; its changes are averaged by row of each matrix, weighted
by how often the shard met that row. So the result doesn't depend on how Spark partitions the input (but for rounding).
The most frequent words' counts are broadcast (TOP of them at most); tokens beyond them are joined with the counts by a
shuffle, so none is left out.

Words are counted by 64-bit hashes. Defined cases: null and empty texts are one end token; with no training text all
tokens are unknown (base score 0); rows with equal or null ids are scored as rows of their own; ties among
frequent words go to the smaller hash; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: First level: words of their own, and classes of the others. Second level: words of a class, before the one of its remaining words.
OWN, SHARED, WORDS = 47, 80, 127
FIRST, SECOND = OWN + 1 + SHARED, WORDS + 1
#: Words need so many tokens for an output of their own on the second level.
LEAST = 5
#: Words that contexts tell apart, and groups of the others.
KNOWN_CONTEXTS, OTHER_CONTEXTS = 1 << 12, 256
CONTEXT, DIM, BATCH = 3, 16, 1024
#: Drawn outputs a minibatch, and a block of tokens of one class; tokens of a minibatch, of a segment, of a block.
NOISE, NOISE_WORDS, MINIBATCH, SEGMENT, BLOCK = 16, 4, 4096, 64, 32
TOP = 1 << 18
SMOOTH = 0.1
SAMPLE_DOCS, SAMPLE_EPOCHS, RATE = 500, 4, 0.07
#: Tokens of a shard; beyond MOST_SHARDS shards they hold more, so that parameters sent stay bounded.
SHARD_TOKENS, MOST_SHARDS = 1 << 20, 8192
SLICE = 2 << 20
#: Tokens a partition of the join of rare tokens with their counts.
JOIN_TOKENS = 1 << 20
END = C.U64(0xE0D0E0D0E0D0E0D1)
BLANK = KNOWN_CONTEXTS + OTHER_CONTEXTS  # the context before a text's first token


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and suffix hashes of all tokens, rows one after the other, and the n + 1 offsets of the rows."""
    raw, offsets = C.text_buffer(column)
    raw = C.LOWER[raw]
    starts, ends, rows = C.words(raw, offsets)
    n_rows, n = len(offsets) - 1, len(starts)
    hashes = np.full(n + n_rows, END)
    suffix = np.full(n + n_rows, END)
    at = np.arange(n) + rows  # each row's end token stands after its words
    if n:
        hashes[at] = C.span_hash(C.prefix_hash(raw), starts, ends)
        tail = raw[ends - 1].astype(C.U64)
        for k in (2, 3):
            inside = ends - k >= starts
            tail |= np.where(inside, raw[np.maximum(ends - k, 0)], 0).astype(C.U64) << C.U64(8 * (k - 1))
        suffix[at] = C.mix(tail)
    count = np.bincount(rows, minlength=n_rows) + 1
    return hashes, suffix, np.concatenate(([0], np.cumsum(count)))


def log_chosen(scores: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its chosen column; the scores are overwritten."""
    scores -= scores.max(1, keepdims=True)
    mine = scores[np.arange(len(scores)), chosen].astype(np.float64)
    np.exp(scores, out=scores)
    return mine - np.log(scores.sum(1))


@dataclass
class Model:
    """Parameters, and what of the counts tasks need (all bounded)."""

    top_keys: np.ndarray  # sorted
    top_counts: np.ndarray
    top_own: np.ndarray  # output of its own on the first level, or -1
    top_word: np.ndarray  # output in its class, or WORDS
    top_context: np.ndarray  # or -1
    tokens: int  # N
    words: int  # V
    rest_tokens: np.ndarray  # by class, of the words without an output of their own
    rest_words: np.ndarray
    open_words: np.ndarray  # SHARED x SECOND: outputs that exist
    r: np.ndarray = None  # context vectors
    c: np.ndarray = None  # position scales
    u: np.ndarray = None  # vectors of the first level, the bias last
    v: np.ndarray = None  # of the second level, SHARED * SECOND rows
    counts: DataFrame = field(default=None, repr=False)

    def look_up(self, hashes: np.ndarray, suffix: np.ndarray):
        """Count (-1: beyond the top), first output, second output (-1: none) and context of each token."""
        uniq, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        cls = OWN + 1 + (suffix[where] % C.U64(SHARED)).astype(np.int32)
        context = KNOWN_CONTEXTS + ((suffix[where] >> C.U64(32)) % C.U64(OTHER_CONTEXTS)).astype(np.int32)
        word = np.full(len(uniq), WORDS, np.int32)
        count = np.full(len(uniq), -1)
        if len(self.top_keys):
            spot = np.minimum(np.searchsorted(self.top_keys, uniq), len(self.top_keys) - 1)
            here = self.top_keys[spot] == uniq
            count = np.where(here, self.top_counts[spot], -1)
            word = np.where(here, self.top_word[spot], word)
            cls = np.where(here & (self.top_own[spot] >= 0), self.top_own[spot], cls)
            context = np.where(here & (self.top_context[spot] >= 0), self.top_context[spot], context)
        cls[uniq == END] = OWN
        second = np.where(cls > OWN, (cls - OWN - 1) * SECOND + word, -1)
        return count[inverse], cls[inverse].astype(np.int32), second[inverse].astype(np.int32), context[inverse].astype(np.int32)

    def predict(self, near: np.ndarray) -> np.ndarray:
        return sum(self.r[near[:, k]] * self.c[k] for k in range(CONTEXT))

    def first_scores(self, q: np.ndarray) -> np.ndarray:
        return q @ self.u[:, :-1].T + self.u[:, -1]

    def second_scores(self, q: np.ndarray, k: int) -> np.ndarray:
        """Of class k's words and, last, its remaining words."""
        v = self.v[k * SECOND : (k + 1) * SECOND]
        return q @ v[:, :-1].T + np.where(self.open_words[k], v[:, -1], -1e30).astype(np.float32)

    def log_share(self, count: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of words with these counts among the remaining words of class k (a count of 0: the unknown place)."""
        return np.log(count + SMOOTH) - np.log(self.rest_tokens[k] + SMOOTH * (self.rest_words[k] + 1))

    def log_tokens(self, count: np.ndarray, cls: np.ndarray, second: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token."""
        q = np.empty((len(cls), DIM), np.float32)
        out = np.empty(len(cls))
        for a in range(0, len(cls), BATCH):
            b = min(a + BATCH, len(cls))
            q[a:b] = self.predict(near[a:b])
            out[a:b] = log_chosen(self.first_scores(q[a:b]), cls[a:b])
        deep = np.flatnonzero(second >= 0)
        deep = deep[np.argsort((cls[deep] - OWN - 1).astype(np.uint8), kind="stable")]  # a radix sort
        bounds = np.searchsorted(cls[deep], np.arange(OWN + 1, FIRST + 1))
        for k in range(SHARED):
            for a in range(bounds[k], bounds[k + 1], BATCH // 2):
                i = deep[a : min(a + BATCH // 2, bounds[k + 1])]
                out[i] += log_chosen(self.second_scores(q[i], k), second[i] - k * SECOND)
        rest = deep[second[deep] % SECOND == WORDS]
        out[rest] += self.log_share(count[rest], cls[rest] - OWN - 1)
        return out


def contexts(context: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The CONTEXT context numbers before each token (nearest first), BLANK before a row's start."""
    n = len(context)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    out = np.full((n, CONTEXT), BLANK, np.int32)
    for k in range(1, CONTEXT + 1):
        ok = np.flatnonzero(place >= k)
        out[ok, k - 1] = context[ok - k]
    return out


class Trainer:
    """NCE with Adagrad on minibatches of short segments of text; drawn outputs are shared, on the second level by BLOCK tokens of a class."""

    def __init__(self, start, noise: np.ndarray, words: np.ndarray, seed: int):
        self.start = start
        self.r, self.c, self.u, self.v = (x.copy() for x in start)
        self.log_kq = np.log(NOISE * noise).astype(np.float32)
        self.noise, self.rng = noise, np.random.default_rng(seed)
        self.log_kw = np.log(np.maximum(NOISE_WORDS * words, 1e-30)).astype(np.float32)
        self.ladder = np.concatenate([k + np.cumsum(w) for k, w in enumerate(words.reshape(SHARED, SECOND))])
        self.gr, self.gc, self.gu, self.gv = (np.ones(x.shape, np.float32) for x in start)
        self.nr, self.nu, self.nv = (np.zeros(len(x)) for x in (self.r, self.u, self.v))
        self.seen = 0

    @staticmethod
    def _add(param, total, met, ids, grads):
        order = np.argsort(ids.astype(np.int16), kind="stable")  # a radix sort
        rows, first = C.runs(ids[order])
        g = np.add.reduceat(grads[order], first, axis=0)
        total[rows] += g * g
        param[rows] += RATE * g / np.sqrt(total[rows])
        met[rows] += np.diff(np.append(first, len(ids)))

    def train(self, context: np.ndarray, cls: np.ndarray, second: np.ndarray, at: np.ndarray) -> None:
        """One pass over texts given by their tokens and offsets."""
        n, rows = len(cls), len(at) - 1
        if not n:
            return
        spot = np.arange(n) + CONTEXT * (np.repeat(np.arange(rows), np.diff(at)) + 1)  # CONTEXT blanks before each text
        size = -(-(n + CONTEXT * (rows + 1)) // SEGMENT) * SEGMENT + CONTEXT
        padded = np.full(size, BLANK, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for to, x in zip(padded, (context, cls, second)):
            to[spot] = x
        starts = self.rng.permutation(np.arange(CONTEXT, size, SEGMENT))
        for a in range(0, len(starts), MINIBATCH // SEGMENT):
            where = starts[a : a + MINIBATCH // SEGMENT, None] + np.arange(-CONTEXT, SEGMENT)
            self.step(*(x[where] for x in padded))

    def step(self, context: np.ndarray, cls: np.ndarray, second: np.ndarray) -> None:
        """Segments x positions, the first CONTEXT of which are only contexts."""
        seen = self.r[context]
        parts = [seen[:, CONTEXT - k : seen.shape[1] - k] for k in range(1, CONTEXT + 1)]
        all_q = sum(x * c for x, c in zip(parts, self.c))
        here = cls[:, CONTEXT:] >= 0
        q, cls, second = all_q[here], cls[:, CONTEXT:][here], second[:, CONTEXT:][here]
        n = len(cls)
        if not n:
            return
        drawn = self.rng.choice(FIRST, NOISE, p=self.noise)
        up, un = self.u[cls], self.u[drawn]
        pos = np.einsum("nd,nd->n", q, up[:, :-1]) + up[:, -1] - self.log_kq[cls]
        neg = q @ un[:, :-1].T + un[:, -1] - self.log_kq[drawn]
        dp = 1 / (1 + np.exp(np.clip(pos, -30, 30)))  # gradient of log sigmoid
        dn = -1 / (1 + np.exp(np.clip(-neg, -30, 30)))
        dq = dp[:, None] * up[:, :-1] + dn @ un[:, :-1]
        met = np.zeros((n, FIRST), np.float32)
        met[np.arange(n), cls] = dp
        g = np.concatenate((met.T @ q, np.bincount(cls, dp, FIRST).astype(np.float32)[:, None]), axis=1)
        np.add.at(g, drawn, np.concatenate((dn.T @ q, dn.sum(0)[:, None]), axis=1))
        self.gu += g * g
        self.u += RATE * g / np.sqrt(self.gu)
        self.nu += np.bincount(cls, minlength=FIRST) + np.bincount(drawn, minlength=FIRST)
        deep = np.flatnonzero(second >= 0)
        if len(deep):
            deep = deep[np.argsort(second[deep].astype(np.int16), kind="stable")]
            dq[deep] += self.words(q[deep], second[deep])
        every = np.zeros((*here.shape, DIM), np.float32)
        every[here] = dq
        gc = np.stack([np.einsum("bld,bld->d", x, every) for x in parts])
        back = np.zeros_like(seen)
        for k in range(1, CONTEXT + 1):
            back[:, CONTEXT - k : seen.shape[1] - k] += every * self.c[k - 1]
        self._add(self.r, self.gr, self.nr, context.ravel(), back.reshape(-1, DIM))
        self.gc += gc * gc
        self.c += RATE * gc / np.sqrt(self.gc)
        self.seen += n

    def words(self, q: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The second level's part of a step, tokens sorted by output; its gradient by the predictions."""
        cls = second // SECOND
        count = np.bincount(cls, minlength=SHARED)
        blocks = -(-count // BLOCK)
        spot = np.arange(len(cls)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(count) - count), count)
        of = np.repeat(np.arange(SHARED), blocks)
        drawn = np.searchsorted(self.ladder, of[:, None] + self.rng.random((len(of), NOISE_WORDS)), side="right")
        drawn = np.minimum(drawn, (of * SECOND + WORDS)[:, None])
        v, vn = self.v[second], self.v[drawn]
        dp = 1 / (1 + np.exp(np.clip(np.einsum("nd,nd->n", q, v[:, :-1]) + v[:, -1] - self.log_kw[second], -30, 30)))
        full = np.zeros((len(of) * BLOCK, DIM), np.float32)
        full[spot] = q
        full = full.reshape(-1, BLOCK, DIM)
        held = np.zeros(len(of) * BLOCK, np.float32)
        held[spot] = 1
        neg = full @ vn[..., :-1].transpose(0, 2, 1) + (vn[..., -1] - self.log_kw[drawn])[:, None]
        dn = -held.reshape(-1, BLOCK, 1) / (1 + np.exp(np.clip(-neg, -30, 30)))
        dq = dp[:, None] * v[:, :-1] + (dn @ vn[..., :-1]).reshape(-1, DIM)[spot]
        g = np.empty((len(second) + drawn.size, DIM + 1), np.float32)
        g[: len(second), :-1], g[: len(second), -1] = q * dp[:, None], dp
        g[len(second) :, :-1], g[len(second) :, -1] = (dn.transpose(0, 2, 1) @ full).reshape(-1, DIM), dn.sum(1).ravel()
        self._add(self.v, self.gv, self.nv, np.concatenate((second, drawn.ravel())), g)
        return dq

    def changes(self) -> np.ndarray:
        """Changes since the start, each times its weight, then the weights: one flat array, to be added up."""
        weights = self.nr, np.full(CONTEXT, float(self.seen)), self.nu, self.nv
        moved = [((x - x0) * w[:, None]).ravel() for x, x0, w in zip((self.r, self.c, self.u, self.v), self.start, weights)]
        return np.concatenate((*moved, *weights))


def averaged(start, total: np.ndarray):
    """The start moved by summed changes() over their weights."""
    sizes = [x.size for x in start] + [len(x) for x in start]
    parts = np.split(total, np.cumsum(sizes)[:-1])
    n = len(start)
    return [(x + (m.reshape(x.shape) / np.maximum(w, 1)[:, None])).astype(np.float32) for x, m, w in zip(start, parts[:n], parts[n:])]


def _shards(batches):
    """(shard, texts) in pieces of SLICE bytes, or a single text; rows come sorted by shard and piece borders don't depend on batches."""
    held, shard, size = [], None, 0
    for b in batches:
        if not b.num_rows:
            continue
        length, of = np.diff(C.text_buffer(b.column("text"))[1]).tolist(), b.column("shard").to_pylist()
        at = 0
        for i in range(b.num_rows):
            if of[i] != shard or (size and size + length[i] > SLICE):
                held.append(b.column("text").slice(at, i - at))
                if size or any(map(len, held)):
                    yield shard, pa.chunked_array(held)
                held, shard, size, at = [], of[i], 0, i
            size += length[i]
        held.append(b.column("text").slice(at))
    if any(map(len, held)):
        yield shard, pa.chunked_array(held)


def count_tokens(texts: DataFrame) -> DataFrame:
    """key, shared (the class of other words) and n of all tokens; every task adds up its own before the shuffle."""

    def run(batches):
        C.keep_memory()
        keys, shared, n = np.zeros(0, C.U64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for big in batches:
            for b in C.slices(big, "text", SLICE):
                hashes, suffix, _ = tokens(b.column("text"))
                uniq, where, count = np.unique(hashes, return_index=True, return_counts=True)
                keys, shared, n = np.concatenate((keys, uniq)), np.concatenate((shared, (suffix[where] % C.U64(SHARED)).astype(np.int32))), np.concatenate((n, count))
                uniq, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
                keys, shared, n = uniq, shared[where], np.bincount(inverse, n).astype(np.int64)
            if len(keys) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shared), pa.array(n)], ["key", "shared", "n"])
                keys, shared, n = keys[:0], shared[:0], n[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(shared), pa.array(n)], ["key", "shared", "n"])

    found = texts.select("text").mapInArrow(run, "key long, shared int, n long")
    return found.groupBy("key").agg(F.first("shared").alias("shared"), F.sum("n").alias("n"))


def fit(train: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 3) -> Model:
    spark = train.sparkSession
    texts = train.select(F.col(text).alias("text"), F.col(doc_id).alias("id"))
    counts = C.materialise(count_tokens(texts), "lm-counts")
    whole = counts.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    top = counts.orderBy(F.desc("n"), "key").limit(TOP).toArrow()
    keys, n = top["key"].to_numpy().view(C.U64), top["n"].to_numpy().astype(np.int64)
    words = keys != END
    place = np.cumsum(words) - 1
    own = np.where(words & (place < OWN), place, -1)
    context = np.where(words & (place < KNOWN_CONTEXTS), place, -1)
    cls = top["shared"].to_numpy().astype(np.int64)
    second = words & (own < 0)
    by = np.flatnonzero(second)[np.argsort(cls[second], kind="stable")]  # by class, frequent ones first
    rank = np.zeros(len(keys), np.int64)
    rank[by] = np.arange(len(by)) - np.searchsorted(cls[by], cls[by], side="left")
    word = np.where(second & (rank < WORDS) & (n >= LEAST), rank, WORDS)
    by_class = counts.groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    rest_n, rest_v = np.zeros(SHARED), np.zeros(SHARED)
    rest_n[by_class["shared"].to_numpy()], rest_v[by_class["shared"].to_numpy()] = by_class["n"].to_numpy(), by_class["v"].to_numpy()
    named = ~second | (word < WORDS)
    rest_n -= np.bincount(cls[named], n[named], SHARED)
    rest_v -= np.bincount(cls[named], minlength=SHARED)
    share = np.zeros((SHARED, SECOND))
    here = second & (word < WORDS)
    share[cls[here], word[here]] = n[here]
    share[:, WORDS] = rest_n + 1
    first = np.zeros(FIRST)
    first[own[own >= 0]], first[OWN], first[OWN + 1 :] = n[own >= 0], n[~words].sum(), share.sum(1) - 1
    order = np.argsort(keys)
    model = Model(keys[order], n[order], own[order], word[order], context[order], int(whole["N"] or 0), int(whole["V"]), rest_n, rest_v, share > 0, counts=None)

    rng = np.random.default_rng(seed)
    noise = (first + 1.0) / (first + 1.0).sum()
    shares = (share / share.sum(1, keepdims=True)).ravel()
    init = lambda rows: rng.standard_normal((rows, DIM)) * 0.1
    start = [
        init(BLANK + 1).astype(np.float32), np.full((CONTEXT, DIM), 1.0 / CONTEXT, np.float32),
        np.concatenate((init(FIRST), np.log(noise)[:, None]), axis=1).astype(np.float32),
        np.concatenate((init(SHARED * SECOND), np.log(np.maximum(shares, 1e-9))[:, None]), axis=1).astype(np.float32),
    ]
    sample = C.bounded_sample(texts, ["id", "text"], SAMPLE_DOCS).withColumn("h", F.xxhash64("id", "text")).orderBy("h").select("text").toArrow()["text"]
    if len(sample):
        hashes, suffix, at = tokens(sample)
        _, cls, second, ctx = model.look_up(hashes, suffix)
        trainer = Trainer(start, noise, shares, seed)
        for _ in range(SAMPLE_EPOCHS):
            trainer.train(ctx, cls, second, at)
        start = [trainer.r, trainer.c, trainer.u, trainer.v]
    shared = spark.sparkContext.broadcast((model, start, noise, shares))

    def learn(batches):
        C.keep_memory()
        m, start, noise, shares = shared.value
        trainer, mine, total = None, None, 0
        for shard, column in _shards(batches):
            if shard != mine:
                total = total + trainer.changes() if trainer else total
                trainer, mine = Trainer(start, noise, shares, seed + 1 + shard), shard
            hashes, suffix, at = tokens(column)
            _, cls, second, ctx = m.look_up(hashes, suffix)
            trainer.train(ctx, cls, second, at)
        if trainer:
            flat = (total + trainer.changes()).astype(np.float32)
            parts = [flat[k : k + 4096].tobytes() for k in range(0, len(flat), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["part", "v"])

    def add_up(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("part").to_pylist(), b.column("v").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(v, np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "v"])

    n_shards = min(MOST_SHARDS, max(1, model.tokens // SHARD_TOKENS))
    rows = texts.withColumn("h", F.xxhash64("id", "text")).select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "h", "text")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "h").select("shard", "text")
    schema = "part int, v binary"
    sums = rows.mapInArrow(learn, schema).repartition("part").mapInArrow(add_up, schema).toArrow()
    if sums.num_rows:
        ranked = sorted(zip(sums["part"].to_pylist(), sums["v"].to_pylist()))
        start = averaged(start, np.concatenate([np.frombuffer(v) for _, v in ranked]))
    model.r, model.c, model.u, model.v = start
    model.counts = counts
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) to the kept columns (default: all)."""
    keep = C.kept(docs.columns if keep is None else keep, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    counts, model.counts = model.counts, None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model.counts = counts
    kept = docs.select(*keep)
    schema = kept.limit(0).selectExpr("*", "0L n_tokens", "0L __known", "0D __base", "0D __score", "cast(null as array<long>) __rare").schema
    log10e = 1 / np.log(10)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        C.keep_memory()
        arrow = to_arrow_schema(schema)
        m = shared.value
        base_below = np.log10(m.tokens + SMOOTH * (m.words + 1))
        for big in batches:
            for b in C.slices(big, "__text", SLICE):
                hashes, suffix, at = tokens(b.column("__text"))
                count, cls, second, ctx = m.look_up(hashes, suffix)
                rare = count < 0  # count 1 - SMOOTH adds 0 here; the join adds what they have
                count = np.where(rare, 1 - SMOOTH, count)
                token = m.log_tokens(count, cls, second, contexts(ctx, at)) * log10e
                above = np.log10(count + SMOOTH)
                first = at[:-1]
                known = np.add.reduceat((~rare & (count > 0)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                base = np.add.reduceat(above - base_below, first) if len(first) else np.zeros(0)
                total = np.add.reduceat(token, first) if len(first) else np.zeros(0)
                rare_at = np.concatenate(([0], np.cumsum(rare)))[at].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(rare_at), pa.array(hashes[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[b.column(n).cast(arrow.field(n).type) for n in keep], pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(total), lists.cast(arrow.field("__rare").type)], schema=arrow)

    part = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
    part = C.materialise(part.withColumn("__row", F.monotonically_increasing_id()), "lm-scores")
    parts = model.tokens // JOIN_TOKENS + 1
    rare = part.select("__row", F.explode("__rare").alias("key")).repartition(parts, "key").join(counts.select("key", "n").repartition(parts, "key"), "key", "left")
    rest = rare.groupBy("__row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("__more"), F.count("n").alias("__more_known"))
    full = part.drop("__rare").join(rest, "__row", "left")
    more = F.coalesce("__more", F.lit(0.0))
    return full.select(
        *keep, "n_tokens", (F.col("__known") + F.coalesce("__more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + more).alias("base_score"), (F.col("__score") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = C.crc_mod("doc_id", 10) == 0
    model = fit(docs.where(~out))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
