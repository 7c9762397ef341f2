"""Cross-tokenizer alignment: where the tokens of two tokenizers meet, and which id pairs overlap how often in the corpus.

A is a byte-level BPE vocabulary, B a SentencePiece model. Per batch, cumsum gives the byte offset at which each token ends,
intersect1d the common cuts, searchsorted the group of each token; overlaps are ranges of B tokens for each A token,
which repeat expands to links. Distinct id pairs of a document count once.

Documents are dealt into blocks of about BLOCK bytes as they are read. A block's pairs are summed before they leave their task,
so a pair costs a row a block, not a row a document. Two salted stages of sums give the counts over the corpus: first
by pair and salt, then by pair. Counts return to the blocks by a join on the pair and meet their documents by block, a
bounded group; a pair that every block holds is split by Spark's skew join. Nothing of the corpus is broadcast but the highest
count of each A id, as many rows as A's vocabulary has.

A's text is encoded by the library whose merges are fastest, built from A's own vocabulary file; a test compares it with the file's
own library on every code point. Where it gives up (runs of blanks of a million characters) the file's own library takes
over.

Defined cases: a text that is null, empty, or whose joined A or B bytes aren't a blank and the text (one that holds
U+2581) has no tokens: zeros and the empty digest; repeated rows and rows with equal or null ids are rows of their own;
texts of any length are encoded whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .sentencepieces import ragged

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How the byte-level vocabulary cuts text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded at once, and of a block.
SLICE, BLOCK = 2 << 20, 16 << 20
SALTS = 16


def byte_symbols() -> dict[str, int]:
    """The byte behind each symbol of a byte-level vocabulary: printable ones are themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Encodes by a byte-level BPE vocabulary file; special tokens are plain text."""

    def __init__(self, text: str):
        import tiktoken

        self.text, self.plain = text, None
        made = json.loads(text)
        special = {t["content"] for t in made.get("added_tokens", [])}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in special}
        self.size = max(ranks.values()) + 1
        self.raw = [b""] * self.size
        for t, i in ranks.items():
            self.raw[i] = t
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        """By the file's own library."""
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_str(self.text)
            self.plain.encode_special_tokens = True
        return self.plain.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # its panics aren't Exceptions
            if type(e).__name__ != "PanicException":
                raise
            return self.slow(text)


class Pieces:
    """Encodes by a SentencePiece model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        self.raw = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


class Bytes:
    """Bytes of each id, flat."""

    def __init__(self, raw: list[bytes]):
        self.n = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.at[ids], self.n[ids])]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(n.sum())), np.concatenate(([0], np.cumsum(n)))


class Aligner:
    def __init__(self, a_file: str, b_file: bytes):
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self.a_bytes, self.b_bytes = Bytes(self.a.raw), Bytes(self.b.raw)
        ids = range(max(self.a.size, self.b.size))
        self.shown = [f"{i}{sep}".encode() for sep in (",", "|", ";", "") for i in ids]
        self.ids = len(ids)

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Tokens, groups and links of each text; at_* are the n + 1 offsets of the rows."""
        texts = [" " + t if t else "" for t in texts]
        raw, at = C.text_buffer(pa.array(texts, pa.large_string()))
        a, a_at = _flat([self.a.encode(t) if t else [] for t in texts])
        b, b_at = _flat(self.b.encode([t[1:] for t in texts]))
        size = np.diff(at)
        ok = size > 0
        for ids, id_at, of in ((a, a_at, self.a_bytes), (b, b_at, self.b_bytes)):
            ends = np.concatenate(([0], np.cumsum(of.n[ids])))[id_at]
            ok &= np.diff(ends) == size
        for ids, id_at, of in ((a, a_at, self.a_bytes), (b, b_at, self.b_bytes)):
            wrong = of.joined(ids[np.repeat(ok, np.diff(id_at))]) != raw[np.repeat(ok, size)]
            if wrong.any():
                ends = np.cumsum(size[ok])
                ok[np.flatnonzero(ok)[np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right"))]] = False
        if not ok.all():
            n_a, n_b = np.diff(a_at), np.diff(b_at)
            a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
            a_at, b_at, at = (np.concatenate(([0], np.cumsum(np.where(ok, n, 0)))) for n in (n_a, n_b, size))
        ends_a, ends_b = np.cumsum(self.a_bytes.n[a]), np.cumsum(self.b_bytes.n[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # a group's tokens of B from the one that goes on where A's starts to the one that holds A's last byte
        low = np.searchsorted(ends_b, ends_a - self.a_bytes.n[a], "right")
        count = np.searchsorted(ends_b, ends_a, "left") - low + 1
        link_row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(a_at)), count)
        code = np.repeat(a.astype(np.int64) * self.b.size, count) + b[ragged(low, count)]
        links = np.concatenate(([0], np.cumsum(count)))[a_at]
        order = np.sort(link_row * np.int64(self.a.size * self.b.size) + code)  # the pairs of each row, sorted
        pair, first = C.runs(order)
        row, code = np.divmod(pair, self.a.size * self.b.size)
        return {
            "a": a, "a_at": a_at, "b": b, "b_at": b_at, "group_a": group_a, "group_b": group_b, "n_groups": np.diff(np.searchsorted(cuts, at, "right")), "n_links": np.diff(links),
            "codes": code, "times": np.diff(np.append(first, len(order))), "pair_at": np.searchsorted(row, np.arange(len(texts) + 1)),
        }

    def digests(self, x: dict[str, np.ndarray]) -> list[str]:
        """sha256 of each row's groups: A's ids, |, B's ids; groups parted by semicolons."""
        a, b, ga, gb = x["a"], x["b"], x["group_a"], x["group_b"]
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        sep_a, sep_b = np.where(last(ga), 1, 0), np.where(last(gb), 2, 0)
        sep_b[x["b_at"][1:][np.diff(x["b_at"]) > 0] - 1] = 3
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.searchsorted(gb, ga, "left")] = a + sep_a * self.ids
        out[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = b + sep_b * self.ids
        at = (x["a_at"] + x["b_at"]).tolist()
        show = self.shown.__getitem__
        return [hashlib.sha256(b"".join(map(show, out[s:e].tolist()))).hexdigest() if e > s else "" for s, e in zip(at[:-1], at[1:])]


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values).cast(kind.value_type)).cast(kind)


#: What encode() can add for each document.
OUTPUTS = {"ids_a": "array<int>", "ids_b": "array<int>", "group_a": "array<int>", "group_b": "array<int>", "groups_sha256": "string"}
COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, block bigint, codes array<bigint>, times array<int>, pairs array<bigint>, docs array<int>"


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids_a", "ids_b", "group_a", "group_b"), a_file: str = A_FILE, b_file: str = B_FILE, block: int = BLOCK) -> DataFrame:
    """A row a document: its counts, its distinct id pairs (codes: A's id times B's size plus B's id; times: its links of
    each) and the outputs asked for (ids, and each token's group from 0). A row a block, without a document: its pairs and in how many of its documents each is."""
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as f, open(b_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # the vocabulary files
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(COUNTS).fields, *[T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs]])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        kind = lambda n: arrow.field(n).type
        C.keep_memory()
        aligner = Aligner(*files.value)
        number, held, bytes_held = TaskContext.get().partitionId() << 32, [], 0

        def summary():
            codes = np.concatenate([c for c, _ in held]) if held else np.zeros(0, np.int64)
            n = np.concatenate([d for _, d in held]) if held else np.zeros(0, np.int64)
            codes, where = np.unique(codes, return_inverse=True)
            n = np.bincount(where, n, len(codes)).astype(np.int64)
            row = {f.name: pa.nulls(1, f.type) for f in arrow} | {"block": pa.array([number], pa.int64()), "pairs": _lists(codes, np.array([0, len(codes)]), kind("pairs")), "docs": _lists(n, np.array([0, len(codes)]), kind("docs"))}
            return pa.RecordBatch.from_arrays([row[f.name] for f in arrow], schema=arrow)

        for big in batches:
            for s in C.slices(big, "text", SLICE):
                x = aligner.align(s.column("text").to_pylist())
                n = s.num_rows
                out = {f.name: pa.nulls(n, f.type) for f in arrow}
                out["doc_id"] = s.column("doc_id")
                out |= {"n_a": pa.array(np.diff(x["a_at"])), "n_b": pa.array(np.diff(x["b_at"])), "n_groups": pa.array(x["n_groups"]), "n_links": pa.array(x["n_links"]), "block": pa.array(np.full(n, number))}
                out |= {"codes": _lists(x["codes"], x["pair_at"], kind("codes")), "times": _lists(x["times"], x["pair_at"], kind("times"))}
                for side in "ab":
                    if f"ids_{side}" in out:
                        out[f"ids_{side}"] = _lists(x[side], x[f"{side}_at"], kind(f"ids_{side}"))
                    if f"group_{side}" in out:
                        group, at = x[f"group_{side}"], x[f"{side}_at"]
                        first = np.cumsum(x["n_groups"]) - x["n_groups"]
                        out[f"group_{side}"] = _lists(group - np.repeat(first, np.diff(at)), at, kind(f"group_{side}"))
                if "groups_sha256" in out:
                    out["groups_sha256"] = pa.array(aligner.digests(x), pa.string())
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)
                held.append(np.unique(x["codes"], return_counts=True))
                bytes_held += s.column("text").nbytes
                if bytes_held >= block:
                    yield summary()
                    number, held, bytes_held = number + 1, [], 0
        if held:
            yield summary()

    return rows.mapInArrow(run, schema)


def pair_counts(encoded: DataFrame, b_size: int, salts: int = SALTS) -> DataFrame:
    """pair, a, n (documents that hold it) and best (no pair of its A id has a higher n), by two salted stages of sums."""
    each = encoded.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    parts = each.select(F.col("p.pairs").alias("pair"), F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), F.col("p.docs").cast("long").alias("n"))
    sums = parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = C.materialise(sums.withColumn("a", F.floor(F.col("pair") / b_size)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most A's vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of encode() with n_best and count_sum in place of their pairs."""
    each = encoded.where("pairs is not null").select("block", F.explode("pairs").alias("pair"))
    back = each.join(counts.select("pair", "n", "best"), "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    rows = encoded.where("codes is not null").drop("pairs", "docs")
    names = [c for c in rows.columns if c not in ("block", "codes", "times")]
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        pair, n, best = (right.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        left = left.combine_chunks()
        codes, times = left.column("codes").combine_chunks(), left.column("times").combine_chunks()
        at = np.concatenate(([0], np.cumsum(codes.value_lengths().to_numpy())))
        spot, times = np.searchsorted(pair, codes.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[at])
        return left.select(names).append_column("n_best", pa.array(total(best[spot] * times))).append_column("count_sum", pa.array(total(n[spot] * times)))

    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(meet, schema)


def alignment(docs: DataFrame, outputs: tuple[str, ...] = ("ids_a", "ids_b", "group_a", "group_b"), **options) -> DataFrame:
    """Each document's doc_id, n_a, n_b, n_groups, n_links, outputs, n_best and count_sum."""
    b_size = len(Pieces(open(options.get("b_file", B_FILE), "rb").read()).raw)
    encoded = C.materialise(encode(docs, outputs=outputs, **options), "aligned")
    return scored(encoded, C.materialise(pair_counts(encoded, b_size), "pairs"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment(C.table(spark, sf_dir, "documents"), outputs=("groups_sha256",))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
