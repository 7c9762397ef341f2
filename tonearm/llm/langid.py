"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased (A-Z) UTF-8 with each white-space run as one blank; n-grams of 1 to 4 bytes are
hashed into 2**BITS buckets. Training counts buckets by language over a bounded sample of labelled
documents (whole texts); the smoothed log-probability matrix, languages x buckets, is broadcast and
each batch is scored by gathering its rows and summing by document.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; ties go to the
language that sorts first; with no labelled text at all every document is `und`; repeated rows are
scored alike; beyond EVIDENCE n-grams the evidence is scaled to that number, so the posterior of long texts stays apart from 0 and 1; columns other than those named are never read. Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 15
ORDERS = (1, 2, 3, 4)
#: At most so many labelled documents train the model: those with the smallest hashed ids.
TRAIN_DOCS = 24_000
#: Additive smoothing of bucket counts.
SMOOTH = 0.5
#: n-grams after which evidence no longer sharpens the posterior: neighbouring n-grams overlap and repeat.
EVIDENCE = 400
#: Numbers of the matrix that is broadcast: beyond 512 languages, n-grams are hashed into fewer buckets.
MOST_CELLS = 1 << 24
PIECE = 1 << 18

_FOLD = C.LOWER.copy()
_FOLD[C.WHITE] = 32


def _grams(raw: np.ndarray, bits: int = BITS):
    """Yields (positions, buckets) of each order over one piece of folded bytes."""
    value = C._byte_values[raw]
    h = value.copy()
    for n in ORDERS:
        if n > 1:
            h = (h[:-1] * C.U64(C.MULT)) + value[n - 1 :] if len(h) else h
        if len(h) == 0:
            return
        yield n, (((h ^ C.U64(n)) * C.MIX_A) >> C.U64(64 - bits)).astype(np.int32)


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """(folded bytes without repeated blanks, row offsets) for pieces of at most PIECE bytes; a long row is cut with an overlap."""
    folded = _FOLD[raw]
    keep = np.ones(len(folded), bool)
    if len(folded):
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        keep[offsets[:-1][offsets[:-1] < len(folded)]] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return folded[keep], at[offsets]


def _sum_rows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[ends] - total[starts]


def _score(raw: np.ndarray, offsets: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probabilities (rows x languages) and n-grams of each row. matrix: buckets x languages."""
    text, at = _pieces(raw, offsets)
    n_rows, n_langs = len(at) - 1, matrix.shape[1]
    out, grams = np.zeros((n_rows, n_langs)), np.zeros(n_rows, np.int64)
    for n in ORDERS:
        grams += np.maximum(np.diff(at) - (n - 1), 0)
    for begin in range(0, len(text), PIECE):
        part = text[begin : begin + PIECE + max(ORDERS) - 1]
        first = max(0, int(np.searchsorted(at, begin, side="right")) - 1)
        last = min(n_rows, int(np.searchsorted(at, min(begin + PIECE, len(text)), side="left")))
        lo = np.clip(at[first:last] - begin, 0, PIECE)
        hi_full = at[first + 1 : last + 1] - begin
        for n, buckets in _grams(part, matrix.shape[0].bit_length() - 1):
            hi = np.minimum(np.clip(hi_full - (n - 1), 0, min(PIECE, len(buckets))), len(buckets))
            lo_n = np.minimum(lo, hi)
            out[first:last] += _sum_rows(matrix[buckets], lo_n, hi)
    return out, grams


def _count(raw: np.ndarray, offsets: np.ndarray, label: np.ndarray, n_langs: int, bits: int = BITS) -> np.ndarray:
    text, at = _pieces(raw, offsets)
    counts = np.zeros((n_langs, 1 << bits), np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    size = 1 << bits
    for begin in range(0, len(text), PIECE):
        part, rows = text[begin : begin + PIECE + max(ORDERS) - 1], row[begin : begin + PIECE + max(ORDERS) - 1]
        for n, buckets in _grams(part, bits):
            m = min(PIECE, len(buckets))
            same = rows[:m] == rows[n - 1 : n - 1 + m]
            key = label[rows[:m][same]].astype(np.int64) * size + buckets[:m][same]
            counts += np.bincount(key, minlength=n_langs * size).reshape(n_langs, size)
    return counts


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their log-probability matrix, buckets x languages, with a uniform prior.

    The sample is bounded by train_docs; counting runs as a Spark job and each task sends bucket counts,
    summed before the driver sees languages x 2**BITS numbers.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("id"))
    spread = C.bounded_sample(rows, ["id", "text"], train_docs)
    sample = C.materialise(spread.select("text", "lang"), "langid-train")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most train_docs
    bits = min(BITS, (MOST_CELLS // max(len(langs), 1)).bit_length() - 1)
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32)
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = None
        for big in batches:
            for b in C.slices(big, "text"):
                label = np.array([index[x] for x in b.column("lang").to_pylist()], np.int64)
                part = _count(*C.text_buffer(b.column("text")), label, len(langs), bits)
                total = part if total is None else total + part
        if total is not None:
            at, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[at, bucket])], ["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << bits))
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    C.discard(sample)
    p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * (1 << bits))
    return langs, np.ascontiguousarray(np.log(p).T.astype(np.float32))


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (posterior of the best language) to the kept columns (default: all)."""
    keep = C.kept(docs.columns if keep is None else keep, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = docs.select(*[f.name for f in fields]).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    names = [f.name for f in fields]

    def score(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        table = shared.value
        for big in batches:
            for b in C.slices(big, "__text"):
                sums, grams = _score(*C.text_buffer(b.column("__text")), table) if langs else (np.zeros((b.num_rows, 1)), np.zeros(b.num_rows))
                lettered = np.asarray(b.column("__letter").fill_null(False)) & (grams > 0) & bool(langs)
                scaled = sums * (np.minimum(grams, EVIDENCE) / np.maximum(grams, 1))[:, None]
                scaled -= scaled.max(1, keepdims=True)
                p = np.exp(scaled)
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                pred = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())]
                value = np.where(lettered, p[np.arange(len(p)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*[b.column(n).cast(arrow.field(n).type) for n in names], pa.array(pred, arrow.field("lang_pred").type), pa.array(value)], schema=arrow)

    letter = F.col(text).rlike(r"\p{L}")
    return docs.select(*names, F.col(text).alias("__text"), letter.alias("__letter")).mapInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = C.crc_mod("doc_id", 5) == 0
    langs, matrix = fit(docs.where(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), langs, matrix, keep=["doc_id", "held_out"])


#: The stage drops what has no language, or none that is likelier than this.
LEAST_SCORE = 0.5


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is not recognised go; the others keep their rows as they are."""
    langs, matrix = fit(docs)
    inner = C.shielded(docs)
    found = identify(inner, langs, matrix).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*inner.columns).toDF(*docs.columns)
