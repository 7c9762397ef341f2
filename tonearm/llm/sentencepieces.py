"""SentencePiece encoding and decoding by suffix-array matching.

A batch is cut into units that no piece can cross (before a blank that follows something else, and around
characters that stand in no longer piece). New distinct units are concatenated and indexed by a suffix array
over the first bytes, as many as the longest piece has; every piece finds its range of occurrences by binary
search. Each occurrence is an edge (start, length in characters, piece); edges go to a table by start, and
the path is relaxed over them: for a BPE model in rounds, each merging a unit's best neighbouring pair whose
joint edge exists (best score, then leftmost), which is what the public library's merges do. Ids of units
are kept for the task's later batches, up to a bound.

Models: BPE with byte fallback, identity normalisation and a dummy prefix; others raise ValueError.
Defined cases: null and empty texts give no ids, and decode to the empty text; U+2581 counts as a blank, so
such a text doesn't round-trip (round_trip is false), as in the library; repeated rows are encoded alike;
texts and units of any length are taken whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units kept by a task; beyond it the store starts anew.
STORE_UNITS = 600_000
#: Longer units are merged with a heap instead of rounds.
ROUND_CHARS = 96
SLICE = 2 << 20
MATCH = 1 << 19
NONE = np.int32(1 << 30)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """What encoding needs of a model: pieces by falling score, their bytes and ids."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(sp.serialized_model_proto())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("identity normalisation with a dummy prefix is needed")
        found, self.bytes_of = [], [b""] * sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                raw = piece.replace("▁", " ").encode()
                self.bytes_of[i] = raw
                if not sp.is_unused(i):
                    found.append((-sp.get_score(i), i, raw, len(piece)))
        found.sort()
        self.raw = [x[2] for x in found]
        self.ids = np.array([x[1] for x in found], np.int32)
        self.chars = np.array([x[3] for x in found], np.int32)
        scores = np.array([x[0] for x in found])
        self.rank = np.searchsorted(np.unique(scores), scores).astype(np.int64)
        self.width = max(map(len, self.raw))
        self.most_chars = int(self.chars.max())
        if any(b" " in r.lstrip(b" ") for r in self.raw):
            raise ValueError("a piece has a blank after another character")
        joined = {c for r, n in zip(self.raw, self.chars.tolist()) if n > 1 for c in r}
        self.isolated = np.array([c < 128 and c != 32 and c not in joined for c in range(256)])
        self.low = np.array(self.raw, f"S{self.width}")
        self.high = np.array([r + b"\xff" * (self.width - len(r)) for r in self.raw], f"S{self.width}")
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_at = np.concatenate(([0], np.cumsum(lengths)))


def match(p: Pieces, text: np.ndarray, char_starts: np.ndarray) -> np.ndarray:
    """edges[i, n - 1]: the piece of n characters at character i, or NONE. Units in text end with 0xFF."""
    safe = np.where(text == 0, np.uint8(0xFE), text)
    padded = np.concatenate((safe, np.full(p.width, 0xFF, np.uint8)))
    keys = np.lib.stride_tricks.sliding_window_view(padded, p.width)[char_starts]
    keys = np.ascontiguousarray(keys).view(f"S{p.width}").ravel()
    suffixes = np.argsort(keys)
    ordered = keys[suffixes]
    lo, hi = np.searchsorted(ordered, p.low, "left"), np.searchsorted(ordered, p.high, "right")
    count = hi - lo
    start = suffixes[ragged(lo, count)]
    piece = np.repeat(np.arange(len(p.raw), dtype=np.int32), count)
    edges = np.full((len(char_starts), p.most_chars), NONE, np.int32)
    edges[start, p.chars[piece] - 1] = piece
    return edges


def _heap_merge(p: Pieces, edges: np.ndarray, first: int, last: int) -> np.ndarray:
    """Symbol lengths (0 inside a symbol) of one long unit of characters first .. last."""
    n = last - first
    length, before = [1] * n, list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = i + length[i]
        if j < n and (whole := length[i] + length[j]) <= p.most_chars:
            piece = int(edges[first + i, whole - 1])
            if piece != NONE:
                heapq.heappush(heap, (int(p.rank[piece]), i, length[i], length[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if length[i] != a or i + a >= n or length[i + a] != b:
            continue
        length[i], length[i + a] = a + b, 0
        after = i + a + b
        if after < n:
            before[after] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array(length, np.int32)


def relax(p: Pieces, edges: np.ndarray, unit_at: np.ndarray) -> np.ndarray:
    """Symbol lengths by character (0 inside a symbol). unit_at: first character of each unit and the end."""
    sizes = np.diff(unit_at)
    out = np.zeros(unit_at[-1], np.int32)
    for u in np.flatnonzero(sizes > ROUND_CHARS).tolist():
        out[unit_at[u] : unit_at[u + 1]] = _heap_merge(p, edges, int(unit_at[u]), int(unit_at[u + 1]))
    live = np.flatnonzero((sizes <= ROUND_CHARS) & (sizes > 0))
    start = ragged(unit_at[live], sizes[live])
    length = np.ones(len(start), np.int64)
    unit = np.repeat(np.arange(len(live)), sizes[live])
    never = np.int64(1) << np.int64(62)

    def pair_keys(j: np.ndarray) -> np.ndarray:
        """Rank and place of the merge of symbols j and j + 1."""
        key = np.full(len(j), never)
        ok = np.flatnonzero((j >= 0) & (j + 1 < len(start)))
        ok = ok[unit[j[ok]] == unit[j[ok] + 1]]
        whole = length[j[ok]] + length[j[ok] + 1]
        fits = whole <= p.most_chars
        ok, whole = ok[fits], whole[fits]
        piece = edges[start[j[ok]], whole - 1]
        has = piece != NONE
        key[ok[has]] = p.rank[piece[has]]
        return key

    key = pair_keys(np.arange(len(start)))
    while len(start):
        _, first = C.runs(unit)
        spot = np.where(key == never, never, (key << np.int64(24)) | np.arange(len(start)))
        best = np.minimum.reduceat(spot, first)
        done = best == never
        if done.any():
            ends = np.append(first[1:], len(start))
            over = np.repeat(done, ends - first)
            out[start[over]] = length[over]
            keep = ~over
            start, length, unit, key = start[keep], length[keep], unit[keep], key[keep]
            if not len(start):
                break
            _, first = C.runs(unit)
            spot = np.where(key == never, never, (key << np.int64(24)) | np.arange(len(start)))
            best = np.minimum.reduceat(spot, first)
        j = best & np.int64((1 << 24) - 1)
        length[j] += length[j + 1]
        keep = np.ones(len(start), bool)
        keep[j + 1] = False
        start, length, unit, key = start[keep], length[keep], unit[keep], key[keep]
        j = j - np.arange(len(j))  # one symbol went from each unit before
        key[j] = pair_keys(j)
        left = j - 1
        left = left[left >= 0]
        key[left] = pair_keys(left)
    return out


class Encoder:
    """Encodes batches; keeps the ids of units it has seen."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.n, self.flat = np.zeros(0, C.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encode_units(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number of each unit, in pieces of about MATCH bytes."""
        ids, counts, a = [], [], 0
        sizes = np.cumsum(ends - starts)
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + MATCH, "right")))
            x, n = self._encode_block(text, starts[a:b], ends[a:b])
            ids.append(x)
            counts.append(n)
            a = b
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode_block(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, n = self.p, ends - starts
        joined = np.full(int(n.sum()) + len(n), 0xFF, np.uint8)
        to = np.cumsum(n + 1) - (n + 1)
        joined[ragged(to, n)] = text[ragged(starts, n)]
        is_start = ((joined & 0xC0) != 0x80) & (joined != 0xFF)
        char_at = np.flatnonzero(is_start)
        number = np.concatenate(([0], np.cumsum(is_start)))
        unit_at = np.append(number[to], len(char_at))
        edges = match(p, joined, char_at)
        length = relax(p, edges, unit_at)
        symbol = np.flatnonzero(length)
        piece = edges[symbol, length[symbol] - 1]
        known = piece != NONE
        char_bytes = np.diff(np.append(char_at, len(joined)))
        char_bytes[unit_at[1:] - 1] -= 1  # the separator
        size = np.where(known, 1, char_bytes[symbol])
        out = np.zeros(int(size.sum()), np.int32)
        at = np.cumsum(size) - size
        out[at[known]] = p.ids[piece[known]]
        raw = symbol[~known]
        out[ragged(at[~known], size[~known])] = p.byte_ids[joined[ragged(char_at[raw], size[~known])]]
        unit_of = np.searchsorted(unit_at, symbol, "right") - 1
        return out, np.bincount(unit_of, weights=size, minlength=len(n)).astype(np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows and the n + 1 offsets of the rows in them."""
        p = self.p
        text, at = blanks(raw, offsets)
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(text), bool)
        cut[at[:-1][at[:-1] < len(text)]] = True
        cut[1:] |= (text[1:] == 32) & (text[:-1] != 32)
        alone = p.isolated[text]
        cut |= alone
        cut[1:] |= alone[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(text))
        hashes = np.zeros(len(starts), C.U64)
        a = 0
        while a < len(starts):  # in pieces, to bound the rolling hash's arrays
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + MATCH, "left")))
            prefix = C.prefix_hash(text[starts[a] : ends[b - 1]])
            hashes[a:b] = C.span_hash(prefix, starts[a:b] - starts[a], ends[a:b] - starts[a])
            a = b
        uniq, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, uniq)
        have = (spot < len(self.hashes)) & (self.hashes[np.minimum(spot, len(self.hashes) - 1)] == uniq) if len(self.hashes) else np.zeros(len(uniq), bool)
        if len(self.hashes) + (~have).sum() > STORE_UNITS and len(self.hashes):
            self._clear()
            have = np.zeros(len(uniq), bool)
        if (~have).any():
            fresh = np.flatnonzero(~have)
            ids, count = self._encode_units(text, starts[where[fresh]], ends[where[fresh]])
            hashes_all = np.concatenate((self.hashes, uniq[fresh]))
            order = np.argsort(hashes_all, kind="stable")
            new_at = len(self.flat) + np.cumsum(count) - count
            self.hashes = hashes_all[order]
            self.at = np.concatenate((self.at, new_at))[order]
            self.n = np.concatenate((self.n, count))[order]
            self.flat = np.concatenate((self.flat, ids))
        spot = np.searchsorted(self.hashes, uniq)[inverse]
        count = self.n[spot]
        ids = self.flat[ragged(self.at[spot], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.searchsorted(starts, at, "left")]


def blanks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text with U+2581 as a blank and a blank before each row that isn't empty, and the new offsets."""
    mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, np.int64)
    if len(mark):
        keep = np.ones(len(raw), bool)
        keep[mark + 1] = keep[mark + 2] = False
        raw = raw.copy()
        raw[mark] = 32
        kept = np.concatenate(([0], np.cumsum(keep)))
        raw, offsets = raw[keep], kept[offsets]
    filled = np.diff(offsets) > 0
    extra = np.concatenate(([0], np.cumsum(filled)))
    at = offsets + extra
    text = np.full(len(raw) + int(extra[-1]), 32, np.uint8)
    body = np.ones(len(text), bool)
    body[at[:-1][filled]] = False
    text[body] = raw
    return text, at


def decode_ids(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows and their offsets: pieces joined, less the dummy prefix."""
    sizes = np.diff(p.flat_at)[ids]
    text = p.flat[ragged(p.flat_at[ids], sizes)]
    at = np.concatenate(([0], np.cumsum(sizes)))[offsets]
    drop = np.zeros(len(text), bool)
    first = at[:-1][np.diff(at) > 0]
    drop[first] = text[first] == 32
    left = np.concatenate(([0], np.cumsum(~drop)))
    return text[~drop], left[at]


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """Adds n_tokens, ids and round_trip (decoding the ids gives the very text) to the kept columns (default: all)."""
    keep = C.kept(docs.columns if keep is None else keep, ["n_tokens", "ids", "round_trip"])
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))  # as large as the model's vocabulary
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        p = shared.value
        encoder = Encoder(p)
        for big in batches:
            for b in C.slices(big, "__text", SLICE):
                raw, offsets = C.text_buffer(b.column("__text"))
                ids, at = encoder.encode(raw, offsets)
                back, back_at = decode_ids(p, ids, at)
                same = np.diff(back_at) == np.diff(offsets)
                if same.all():
                    wrong = np.concatenate(([0], np.cumsum(back != raw)))
                    same = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    same &= np.array([np.array_equal(back[back_at[i] : back_at[i + 1]], raw[offsets[i] : offsets[i + 1]]) for i in range(len(same))], bool)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[b.column(n).cast(arrow.field(n).type) for n in keep], pa.array(np.diff(at)), lists.cast(arrow.field("ids").type), pa.array(same)], schema=arrow)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ids: str = "ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """Adds the text of an array of ids. A null or empty array, and null or unknown ids, add no text; bytes that aren't UTF-8 become U+FFFD."""
    tokens = tokens.select(*C.kept(tokens.columns, [to]))
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces(model))
    schema = T.StructType([*tokens.schema.fields, T.StructField(to, T.StringType())])
    names = tokens.columns

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        p = shared.value
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                lists = [[k for k in x or () if k is not None and 0 <= k < len(p.bytes_of)] for x in part.column(names.index(ids)).to_pylist()]
                flat = np.array([k for x in lists for k in x], np.int64)
                text, at = decode_ids(p, flat, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))
                out = [text[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(lists))]
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns, arrow)], pa.array(out, arrow.field(to).type)], schema=arrow)

    return tokens.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents as token ids."""
    return encode(docs, keep=[c for c in docs.columns if c != "text"])
