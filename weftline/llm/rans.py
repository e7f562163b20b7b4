"""Token ids in range asymmetric numeral systems (rANS), static and interleaved.

The corpus is tokenised in ascending id order into segments of whole documents. One frequency table, counted over all
ids, is shared by all segments. A segment's ids are cut into blocks of ``BLOCK`` symbols; each block is coded on its
own over ``LANES`` interleaved states, so blocks can be decoded in parallel and any of them alone.

Layout of a segment (little endian)::

    magic 'RANS' | u8 version | u8 scale bits | u16 lanes | u32 block symbols | u32 blocks | u64 symbols | u32 table crc
    per block, the checkpoints: u64 byte offset of its data | u32 symbols | u32 crc32 of its ids as little endian u32
    per block, the data: u64 state of each lane | u32 words, in the order in which the decoder takes them

Segments are rows of Parquet files (shard, seq, doc_ids, doc_tokens, payload); the frequency table is a table beside
them. Shards are ranges of ids, so (shard, seq) is the order of the corpus, and a document's start is the sum of what
stands before it: a window over shards, one over the segments of a shard, one sum within the segment.

Tokenising works on distinct words: the tokenizer's rules never join across white space, so the distinct words of a
batch are encoded once and their ids copied to every place. Pieces of words stay in a bounded cache.

Lengths of documents stand beside a segment's payload, in the columns of its row.

Defined results: a null text is empty and has the end id alone. Very long texts make segments of their own. Repeated ids all keep their rows, side by side, as
range partitioning goes by (id, place in the input); null ids come first. Ids above 65,535 are not supported. A
payload that does not match its checksums raises. Empty tables give empty ones. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import coded, cut, drop, lean, partitions, slices, split_words, starts, written

END = 1
BLOCK, LANES, SCALE = 32768, 32, 20
SEGMENT = 1 << 20
CACHE_PIECES = 300_000
_HEADER, _POINT = struct.Struct("<4sBBHIIQI"), struct.Struct("<QII")
_LOW = np.uint64(1 << 31)


class Table:
    """Quantised frequencies: they sum to 2**SCALE, and every id that occurs has at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies in proportion to ``counts``. What rounding leaves over goes to, or comes from, the most frequent."""
    counts = counts.astype(np.float64)
    whole, total = 1 << scale, counts.sum()
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * whole / total)), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    spare, i = whole - int(freq.sum()), 0
    while spare:
        s = order[i % len(order)]
        change = spare if spare > 0 else -min(-spare, int(freq[s]) // 2)
        freq[s] += change if freq[s] else 0
        spare -= change if freq[s] else 0
        i += 1
    return freq


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A segment's payload. All its full blocks are coded side by side, LANES states each."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    data, points = [], []
    full = n // BLOCK
    if full:
        data += _encode_blocks(ids[: full * BLOCK].reshape(full, BLOCK), table)
    if full < blocks:
        data += _encode_blocks(ids[full * BLOCK :].reshape(1, -1), table)
    offset = 0
    for k, d in enumerate(data):
        own = ids[k * BLOCK : (k + 1) * BLOCK]
        points.append(_POINT.pack(offset, len(own), zlib.crc32(own.astype("<u4").tobytes())))
        offset += len(d)
    return b"".join([_HEADER.pack(b"RANS", 1, SCALE, LANES, BLOCK, blocks, n, table.crc), *points, *data])


def _encode_blocks(rows: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of equal length. Symbol i of a block belongs to lane i % LANES."""
    k, n = rows.shape
    steps = -(-n // LANES)
    padded = np.zeros((k, steps * LANES), np.int64)
    padded[:, :n] = rows
    live = (np.arange(steps * LANES) < n).reshape(steps, LANES)
    symbols = padded.reshape(k, steps, LANES)
    state = np.full((k, LANES), _LOW, np.uint64)
    words, taken = np.zeros((steps, k, LANES), np.uint32), np.zeros((steps, k, LANES), bool)
    shift, scale = np.uint64(63 - SCALE), np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t]
        f = table.freq[s]
        if not live[t].all():
            f = np.where(live[t], f, np.uint64(1))
        over = state >= f << shift
        over &= live[t]
        words[t], taken[t] = state & np.uint64(0xFFFFFFFF), over
        x = np.where(over, state >> np.uint64(32), state)
        q = x // f
        x = (q << scale) + (x - q * f) + table.start[s]
        state = x if live[t].all() else np.where(live[t], x, state)
    return [state[b].astype("<u8").tobytes() + words[:, b][taken[:, b]].astype("<u4").tobytes() for b in range(k)]


def decode(payload: bytes, table: Table) -> np.ndarray:
    """The ids of a whole segment, its blocks decoded side by side."""
    return np.concatenate([np.zeros(0, np.uint16), *decode_blocks(payload, table)])


def decode_blocks(payload: bytes, table: Table, wanted: list[int] | None = None) -> list[np.ndarray]:
    """The ids of the wanted blocks (all by default)."""
    magic, version, scale, lanes, _, blocks, _, crc = _HEADER.unpack_from(payload)
    if magic != b"RANS" or version != 1 or scale != SCALE or lanes != LANES:
        raise ValueError("not a segment of this format")
    if crc != table.crc:
        raise ValueError("the frequency table is not the one that the segment was coded with")
    points = [_POINT.unpack_from(payload, _HEADER.size + i * _POINT.size) for i in range(blocks)]
    base = _HEADER.size + blocks * _POINT.size
    ends = [*(p[0] for p in points[1:]), len(payload) - base]
    out: dict[int, np.ndarray] = {}
    todo = range(blocks) if wanted is None else wanted
    for n in {points[i][1] for i in todo}:
        same = [i for i in todo if points[i][1] == n]
        found = _decode_blocks([payload[base + points[i][0] : base + ends[i]] for i in same], n, table)
        for i, ids in zip(same, found, strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != points[i][2]:
                raise ValueError(f"block {i} does not match its checksum")
            out[i] = ids
    return [out[i] for i in todo]


def _decode_blocks(data: list[bytes], n: int, table: Table) -> np.ndarray:
    k, steps = len(data), -(-n // LANES)
    state = np.stack([np.frombuffer(d, "<u8", LANES) for d in data]).astype(np.uint64)
    words = [np.frombuffer(d, "<u4", offset=8 * LANES) for d in data]
    at = starts(np.array([len(w) for w in words]))[:-1]
    words = np.concatenate([*words, np.zeros(LANES + 1, np.uint32)]).astype(np.uint64)
    out = np.zeros((k, steps, LANES), np.uint16)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(steps):
        live = n - t * LANES
        slot = state & mask
        s = table.symbol[slot]
        out[:, t] = s
        x = table.freq[s] * (state >> scale) + slot - table.start[s]
        under = x < _LOW
        if live < LANES:
            under[:, live:] = False
        if under.any():
            place = np.cumsum(under, axis=1)
            get = np.minimum(at[:, None] + place - 1, len(words) - 1)
            x = np.where(under, (x << np.uint64(32)) | words[get], x)
            at = at + place[:, -1]
        if live < LANES:
            x[:, live:] = state[:, live:]
        state = x
    if (state != _LOW).any():
        raise ValueError("a block's states do not end where they began")
    return out.reshape(k, -1)[:, :n]


#: Words whose normal form and cut are plain: ASCII, and letters of Latin-1.
_PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
#: The tokenizer's own cut, on lower-cased plain words, and a character that plain words lack.
_PIECE, _CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+", "\x1f"


class WordCoder:
    """Token ids of words. Distinct words are cut into the tokenizer's pieces, and distinct pieces are coded by its model.

    That is for tokenizers that lower-case and cut as ``_PIECE`` does, for which some words are tried at the start; other
    tokenizers, and words that are not plain, go through the whole tokenizer. The most pieces that are kept from batch to
    batch is CACHE_PIECES; the others are coded again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(special) or "^$"
        self.pieces, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint16)
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        tried = ["It's", "DON'T", "they're,", "ab12c.", "ÉtÉß!", "x-y_z", "!''ll", "<a>", "1.5%", "we've'd", "no.", "øl"]
        ids, at, n = self.plain(pa.array(tried))
        self.by_piece = [ids[a : a + k].tolist() for a, k in zip(at, n, strict=True)] == [list(x) for x in self.whole(tried)]

    def whole(self, words: list[str]) -> list[list[int]]:
        out = []
        for a in range(0, len(words), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + 4096], add_special_tokens=False)]
        return out

    def piece(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each of the distinct pieces where its ids begin in it and how many they are."""
        place = np.asarray(pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1), dtype=np.int64)
        unknown = place < 0
        fresh = pieces.filter(pa.array(unknown))
        ids = [self.piece(x) for x in fresh.to_pylist()]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        at = starts(length)[:-1] + len(self.pool)
        pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint16)])
        begin, n = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        begin[unknown], n[unknown] = at, length
        begin[~unknown], n[~unknown] = self.at[place[~unknown]], self.length[place[~unknown]]
        room = max(0, CACHE_PIECES - len(self.pieces))
        if room and len(fresh):
            kept = int(length[:room].sum())
            self.pieces, self.pool = pa.concat_arrays([self.pieces, fresh.slice(0, room)]), pool[: len(self.pool) + kept]
            self.at, self.length = np.concatenate([self.at, at[:room]]), np.concatenate([self.length, length[:room]])
        return pool, begin, n

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the plain words, in turn, and for each where they begin and how many they are."""
        parts = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words), _PIECE, r"\0" + _CUT), _CUT)
        flat = parts.flatten()
        word = np.repeat(np.arange(len(words)), np.asarray(pc.list_value_length(parts), dtype=np.int64))
        full = np.asarray(pc.greater(pc.binary_length(flat), 0))
        word = word[full]
        code, distinct = coded(flat.filter(pa.array(full)))
        pool, begin, n = self.of_pieces(distinct)
        ids = gather(pool, begin[code], n[code])
        length = np.bincount(word, weights=n[code], minlength=len(words)).astype(np.int64)
        return ids, starts(length)[:-1], length

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for each of the distinct words where its ids begin in it and how many they are."""
        is_plain = np.zeros(len(words), bool)
        if self.by_piece:
            is_plain = np.asarray(pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring_regex(words, self.special))))
        ids, at, length = self.plain(words.filter(pa.array(is_plain)))
        odd = self.whole(words.filter(pa.array(~is_plain)).to_pylist())
        begin, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[is_plain], n[is_plain] = at, length
        n[~is_plain] = np.fromiter(map(len, odd), np.int64, len(odd))
        begin[~is_plain] = starts(n[~is_plain])[:-1] + len(ids)
        return np.concatenate([ids, np.fromiter(chain.from_iterable(odd), np.uint16)]), begin, n


def gather(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin there and are so long, one after another."""
    first = starts(n)
    return pool[np.arange(int(first[-1])) + np.repeat(begin - first[:-1], n)]


_CODERS: dict[str, WordCoder] = {}


def coder_of(path: str) -> WordCoder:
    """A worker's coder, with what it has learned in earlier tasks."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def tokenise(texts: pa.Array, coder: WordCoder) -> tuple[np.ndarray, np.ndarray]:
    """All ids, the end id after each text, and how many each text has."""
    words, n = split_words(texts)
    code, distinct = coded(words)
    pool, at, length = coder.encode(distinct)
    each = length[code]
    text = np.repeat(np.arange(len(n)), n)
    tokens = np.bincount(text, weights=each, minlength=len(n)).astype(np.int64) + 1
    ids = np.full(int(tokens.sum()), END, np.uint16)
    said = np.ones(len(ids), bool)
    said[np.cumsum(tokens) - 1] = False
    ids[said] = gather(pool, at[code], each)
    return ids, tokens


def segments(docs: DataFrame, tokenizer: str) -> DataFrame:
    """shard, seq, doc_ids, doc_tokens, ids (raw u16): runs of whole documents in ascending id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        for batch in slices(batches, most=6 << 20):
            ids, tokens = tokenise(batch.column(1), coder_of(tokenizer))
            at, cuts = starts(tokens), [0]
            for i in range(1, len(at)):
                if at[i] - at[cuts[-1]] >= SEGMENT or i == len(at) - 1:
                    cuts.append(i)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()),
                        pa.array([seq], pa.int64()),
                        pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.column(0).type)),
                        pa.array([tokens[a:b].tolist()], pa.list_(pa.int64())),
                        pa.array([ids[at[a] : at[b]].astype("<u2").tobytes()], pa.binary()),
                    ],
                    ["shard", "seq", "doc_ids", "doc_tokens", "ids"],
                )
                seq += 1

    rows = docs.select("doc_id", "text").withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    return cut(rows.mapInArrow(lean(run), f"shard long, seq long, doc_ids array<{kind}>, doc_tokens array<long>, ids binary"), "segments")


def frequencies(raw: DataFrame) -> np.ndarray:
    """How often each id occurs in all segments. A task sends one count for each id that it saw: at most 65,536."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=1 << 16)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for i, n in raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``docs`` into ``path``/segments and ``path``/table."""
    spark = docs.sparkSession
    with written() as superseded:
        raw = segments(docs, tokenizer)
    freq = quantise(frequencies(raw))
    table = spark.sparkContext.broadcast(freq)  # 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(table.value)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = np.frombuffer(one.column(4)[0].as_buffer(), "<u2")
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([encode(ids, shared)], pa.binary())], [*batch.schema.names[:4], "payload"])

    kind = raw.schema["doc_ids"].dataType.simpleString()
    raw.mapInArrow(lean(run), f"shard long, seq long, doc_ids {kind}, doc_tokens array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(freq.tolist()) if n], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    drop(spark, superseded)


def read_table(spark, path: str) -> np.ndarray:
    freq = np.zeros(1 << 16, np.int64)
    for i, n in spark.read.parquet(f"{path}/table").collect():  # at most 65,536 rows
        freq[i] = n
    return freq


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if wanted) ids (raw u32) of every document, in no order, from the files."""
    table = spark.sparkContext.broadcast(read_table(spark, path))
    rows = spark.read.parquet(f"{path}/segments")
    tokens = rows.select("shard", "seq", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = tokens.groupBy("shard").agg(F.sum("n").alias("n")).select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    order = Window.partitionBy("shard").orderBy("seq")
    begins = tokens.withColumn("begin", F.sum("n").over(order) - F.col("n")).join(shards, F.col("shard") == F.col("s")).select("s", F.col("seq").alias("q"), (F.col("base") + F.col("begin")).alias("begin"))
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(table.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column(4)[i].as_py(), shared).astype("<u4")
                tokens = np.array(batch.column(3)[i].as_py(), np.int64)
                at, doc_ids = starts(tokens), batch.column(2)[i].values
                for a in range(0, len(tokens), 512):
                    b = min(len(tokens), a + 512)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(b - a, batch.column(0)[i].as_py())),
                            pa.array(np.full(b - a, batch.column(1)[i].as_py())),
                            pa.array(at[a:b]),
                            doc_ids.slice(a, b - a),
                            pa.array(tokens[a:b]),
                            pa.array([ids[at[k] : at[k + 1]].tobytes() for k in range(a, b)], pa.binary()),
                        ],
                        ["shard", "seq", "offset", "doc_id", "n_tokens", "ids"],
                    )

    found = rows.select("shard", "seq", "doc_ids", "doc_tokens", "payload").mapInArrow(lean(run), f"shard long, seq long, offset long, doc_id {kind}, n_tokens long, ids binary")
    found = found.withColumn("ids_crc32", F.crc32("ids"))
    found = (found if with_ids else found.drop("ids")).join(begins, (F.col("shard") == F.col("s")) & (F.col("seq") == F.col("q")))
    return found.select("doc_id", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
