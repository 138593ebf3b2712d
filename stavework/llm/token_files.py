"""Token-id files, coded by an adaptive context-mixing range coder.

Ids of whole documents are gathered into segments of about ``SEGMENT`` ids, and a segment is cut into blocks of ``BLOCK`` ids.
A block starts with an empty model, has a checksum of its own, and can be decoded alone. An id (its rank among the block's
distinct ids) is predicted by a mixture of three distributions: of order 0, adaptive counts of the ids that the other two
missed; of order 1 and order 2, the id that followed the last one, or the last two, and how sure that is. The three weights
are learnt from the hits so far of contexts of the same surety. In order of rank the mixture's sums are those of order 0, scaled,
with a step at each of the two predicted ids, so an id has one interval, which drives a range coder of 16-bit words with carries.

A block is cut into lanes of ``STEPS`` ids. All lanes share the block's model and take their steps side by side as numpy
arrays, each with its own coder state; what a step shows is learnt after the step, the counts and weights at intervals.

A file is a Parquet file of segments in order, in a folder in order of partitions; the column ``data`` holds a segment's bytes:
``SVTC``, version, number of documents and ids, ids of the documents (with a bit each for null), their lengths, and the blocks.
A block has its numbers of ids and of distinct ids, the CRC-32 of its ids, the distinct ids (differences, deflated), and for every lane
the number of code words, then the code words. Numbers are little-endian; ids have up to 32 bits.

Cases: a null or empty text has the end id alone; repeated rows are written each; null document ids come first; an empty
table makes no segments and an empty result; further columns are ignored, whatever their names; damage is an error.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import byte_characters, without_gc
from .common import shared_folder, table

MAGIC, VERSION, BLOCK, STEPS, SEGMENT, END = b"SVTC", 2, 1 << 21, 512, 1 << 22, 1
HEAD, BLOCK_HEAD = "<HIQ", "<IIII"
#: Bits of a whole interval, of a surety, and of the order-2 table; steps between two renewals. The order-0 sums have at
#: least LEAST bits fewer than the interval, so that the least order-0 weight, 0.02, gives every id a share; a block has no more ids than that.
TOTAL, SURE, TABLE, RENEW, LEAST = 28, 3, 18, 128, 7
#: Bits of the coder's state and of a code word. The range is at least 2 ** (CODE - WORD), and a share of 1 at least 2 ** 4 of it.
CODE, WORD = 48, 16
PART_BYTES = 64 << 20
#: Words, and pieces, that a worker keeps.
CACHE_SIZE = 250_000
#: Words whose characters are composed and have a lower case of one character, and the tokenizer's pattern for such words in lower case.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+").findall  # of words in lines
TEXTS = 2048


class Mixer:
    """The model of one block."""

    def __init__(self, symbols: int, lanes: int):
        self.next1, self.next2 = np.zeros(symbols, np.int64), np.zeros(1 << TABLE, np.int64)  # predicted id, and how sure it is
        self.counts, self.order0 = np.zeros(symbols, np.int64), min(TOTAL - LEAST, symbols.bit_length() + 6)
        n = 2 << 2 * SURE
        self.seen, self.right1, self.right2 = np.full(n, 1.0), np.full(n, 0.3), np.full(n, 0.3)
        self.last, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.due, self.log = 0, 1, []
        sure, hit = np.divmod(np.arange(2 << SURE), 2)
        self.changed = np.where(hit == 1, np.minimum(sure + 1, (1 << SURE) - 1), sure >> 1)
        self.renew()

    def renew(self) -> None:
        """Order-0 sums and the weights from what was counted so far."""
        n, sums = len(self.counts), np.cumsum(self.counts + 1)
        self.sums = np.concatenate([[0], np.arange(1, n + 1) + sums * ((1 << self.order0) - n) // sums[-1]])
        two = np.minimum(0.96 * self.right2 / self.seen, 0.98)
        one = np.minimum(0.96 * self.right1 / self.seen, 0.98 - two)
        self.weight2, self.weight1 = ((x * (1 << TOTAL)).astype(np.int64) for x in (two, one))
        self.weight0 = (1 << TOTAL) - self.weight1 - self.weight2
        self.slots = None

    def predict(self, a: int) -> None:
        """The predictions and weights of the first a lanes."""
        last = self.last[:a]
        self.at2 = (last * 2656615937 + self.last2[:a] * 30011 >> 5) & ((1 << TABLE) - 1)
        one, two = self.next1.take(last, mode="clip"), self.next2.take(self.at2, mode="clip")
        self.sure1, self.sure2, self.p1, self.p2 = one & ((1 << SURE) - 1), two & ((1 << SURE) - 1), one >> SURE, two >> SURE
        self.context = ((self.sure2 << SURE | self.sure1) << 1) | (self.p1 == self.p2)
        self.w0, self.w1, self.w2 = (w.take(self.context, mode="clip") for w in (self.weight0, self.weight1, self.weight2))

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of these ids in the mixture, of 2 ** TOTAL."""
        start = self.sums.take(x, mode="clip") * self.w0 >> self.order0
        size = (self.sums.take(x + 1, mode="clip") * self.w0 >> self.order0) - start
        self.hit1, self.hit2 = self.p1 == x, self.p2 == x
        size += self.w1 * self.hit1
        size += self.w2 * self.hit2
        start += self.w1 * (self.p1 < x)
        start += self.w2 * (self.p2 < x)
        return start, size

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold v: the steps of both predicted ids are taken out of v, then order 0 is searched."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.counts), dtype=np.int32), np.diff(self.sums))
        low1, low2 = (self.sums.take(p, mode="clip") * self.w0 >> self.order0 for p in (self.p1, self.p2))
        low2 += self.w1 * (self.p1 < self.p2)
        v = np.maximum(np.minimum(v, low2), v - self.w2)
        v = np.maximum(np.minimum(v, low1), v - self.w1)
        return self.slots.take((((v + 1 << self.order0) - 1) / self.w0).astype(np.int64), mode="clip").astype(np.int64)  # exact: under 2 ** 49 by 2 ** 28

    def update(self, x: np.ndarray) -> None:
        for at, of, p, sure, hit in ((self.last[: len(x)], self.next1, self.p1, self.sure1, self.hit1), (self.at2, self.next2, self.p2, self.sure2, self.hit2)):
            of[at] = np.where(hit | (sure > 0), p, x) << SURE | self.changed.take(sure << 1 | hit, mode="clip")
        self.log.append((self.context, self.hit1, self.hit2, x))
        self.last2[: len(x)] = self.last[: len(x)]
        self.last[: len(x)] = x
        self.step += 1
        if self.step == self.due:
            context, hit1, hit2, x = (np.concatenate(part) for part in zip(*self.log))
            n = len(self.seen)
            self.seen += np.bincount(context, minlength=n)
            self.right1 += np.bincount(context[hit1 & ~hit2], minlength=n)
            self.right2 += np.bincount(context[hit2], minlength=n)
            self.counts += np.bincount(x[~(hit1 | hit2)], minlength=len(self.counts))
            self.log, self.due = [], min(2 * self.due, self.due + RENEW)
            self.renew()


def carry(out: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the words before these places, and to those before them where they overflow."""
    at = at - 1
    while len(at):
        out[at] += np.uint16(1)
        at = at[out[at] == 0] - 1


def encode_block(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code words of a block, and how many each lane has. ranks: at least one; every rank up to the largest occurs."""
    n, steps = len(ranks), min(len(ranks), STEPS)
    lanes = -(-n // steps)
    rows = np.zeros(lanes * steps, np.int64)
    rows[:n] = ranks
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    mixer, width = Mixer(int(ranks.max()) + 1, lanes), 2 * steps + 4
    out, begin = np.zeros(lanes * width, np.uint16), np.arange(lanes) * width
    at, low, size = begin.copy(), np.zeros(lanes, np.int64), np.full(lanes, 1 << CODE, np.int64)
    for t in range(steps):
        a = lanes if t < n - (lanes - 1) * steps else lanes - 1
        mixer.predict(a)
        start, part = mixer.interval(rows[t, :a])
        unit = size[:a] >> TOTAL
        start *= unit
        start += low[:a]
        part *= unit
        over = np.flatnonzero(start >> CODE)
        carry(out, at[over])
        start[over] &= (1 << CODE) - 1
        while True:  # twice at most; all write a word, but only those with a short range keep it
            short = part < 1 << CODE - WORD
            if not short.any():
                break
            out[at[:a]] = start >> CODE - WORD
            at[:a] += short
            shift = short.astype(np.int64) << 4
            start = start << shift & (1 << CODE) - 1
            part <<= shift
        low[:a], size[:a] = start, part
        mixer.update(rows[t, :a])
    low += (1 << WORD) - 1  # two words tell a number of the range, whatever follows them
    over = np.flatnonzero(low >> CODE)
    carry(out, at[over])
    for shift in (CODE - WORD, CODE - 2 * WORD):
        out[at] = low >> shift & (1 << WORD) - 1
        at += 1
    n_words = at - begin
    return np.concatenate([out[b:e] for b, e in zip(begin, at)]), n_words


def decode_block(words: np.ndarray, n_words: np.ndarray, symbols: int, n: int) -> np.ndarray:
    """The n ranks of a block."""
    steps, lanes = min(n, STEPS), len(n_words)
    mixer = Mixer(symbols, lanes)
    words = np.concatenate([words, np.zeros(3, np.uint16)]).astype(np.int64)
    at = np.cumsum(n_words) - n_words
    code = words[at] << CODE - WORD | words[at + 1] << CODE - 2 * WORD | words[at + 2]
    at, size, out = at + 3, np.full(lanes, 1 << CODE, np.int64), np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        a = lanes if t < n - (lanes - 1) * steps else lanes - 1
        mixer.predict(a)
        unit, rest = size[:a] >> TOTAL, code[:a]
        x = mixer.find(np.minimum((rest / unit).astype(np.int64), (1 << TOTAL) - 1))  # exact: 48 bits by 20
        start, part = mixer.interval(x)
        start *= unit
        part *= unit
        rest = rest - start
        while True:
            short = part < 1 << CODE - WORD
            if not short.any() or not part.all():
                break
            shift = short.astype(np.int64) << 4
            rest = rest << shift | words.take(at[:a], mode="clip") & -(shift >> 4)
            at[:a] += short
            part <<= shift
        code[:a], size[:a] = rest, part
        out[t, :a] = x
        mixer.update(x)
    return out.T.ravel()[:n]


def pack_block(ids: np.ndarray) -> bytes:
    """ids: at least one, of up to 32 bits."""
    if int(ids.max()) < 1 << 22:
        known = np.bincount(ids) > 0
        distinct, ranks = np.flatnonzero(known), (np.cumsum(known) - 1)[ids]
    else:
        distinct, ranks = np.unique(ids, return_inverse=True)
    code, n_words = encode_block(ranks)
    alphabet = zlib.compress(np.diff(distinct.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes())
    return struct.pack(BLOCK_HEAD, len(ids), len(distinct), zlib.crc32(ids.astype("<u4").tobytes()), len(alphabet)) + alphabet + n_words.astype("<u2").tobytes() + code.astype("<u2").tobytes()


def unpack_block(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The ids of the block that begins there, and its end; an error if they are not those that were packed."""
    try:
        n, symbols, crc, size = struct.unpack_from(BLOCK_HEAD, data, at)
        at += struct.calcsize(BLOCK_HEAD)
        distinct = np.cumsum(np.frombuffer(zlib.decompress(data[at : at + size]), "<u4"), dtype=np.uint32)
        at += size
        n_words = np.frombuffer(data, "<u2", -(-n // min(n, STEPS)), at).astype(np.int64)
        at += 2 * len(n_words)
        code = np.frombuffer(data, "<u2", int(n_words.sum()), at)
        if not 0 < symbols == len(distinct) <= n <= BLOCK or n_words.min() < 2:
            raise ValueError("a block's head is damaged")
        ids = distinct[decode_block(code, n_words, symbols, n)]
    except (struct.error, zlib.error, IndexError, ZeroDivisionError) as e:
        raise ValueError("a block is damaged") from e
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block is damaged")
    return ids, at + 2 * len(code)


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment."""
    head = MAGIC + struct.pack(HEAD, VERSION, len(doc_ids), len(ids))
    known = np.packbits(np.array([x is not None for x in doc_ids], bool)).tobytes()
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known, lengths.astype("<i8").tobytes(), *blocks])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their lengths, and all ids of a segment; checks every block."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    version, n_docs, n_ids = struct.unpack_from(HEAD, data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not supported")
    at = 4 + struct.calcsize(HEAD)
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    known = np.unpackbits(np.frombuffer(data, "u1", -(-n_docs // 8), at + 8 * n_docs))[:n_docs]
    at += 8 * n_docs + -(-n_docs // 8)
    lengths, at, blocks, n = np.frombuffer(data, "<i8", n_docs, at), at + 8 * n_docs, [np.zeros(0, np.uint32)], 0
    while n < n_ids:
        block, at = unpack_block(data, at)
        blocks.append(block)
        n += len(block)
    return [int(x) if k else None for x, k in zip(doc_ids, known)], lengths, np.concatenate(blocks)


class Growing:
    """An array that grows at its end."""

    def __init__(self, values: np.ndarray):
        self.size, self.room = 0, np.zeros(1024, values.dtype)
        self.add(values)

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            self.room = np.resize(self.room, 2 * (self.size + len(values)))
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)


class WordEncoder:
    """Ids of texts word by word: the tokenizer's pieces never hold white space, so a word's ids are its own, and a worker keeps those
    of the words that it has met twice in some texts.

    A word of plain Latin letters, digits and signs is cut by the tokenizer's own pattern here, and only its pieces go to the tokenizer's
    model, since lower case and composed characters need nothing else; any other word goes through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives every task one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.shown = np.arange(256, dtype="<u4")  # the code point that shows a byte; ends of lines stay
        for c, b in byte_characters().items():
            if b != 0x0A:
                self.shown[b] = ord(c)
        self.model = Tokenizer(self.tokenizer.model)  # pieces in lines, as their bytes are shown, which are never white space
        self.model.pre_tokenizer = WhitespaceSplit()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}  # of the words met so far; the ids of all of them lie in one array
        self.no_pieces()
        self.flat, self.begin, self.size = Growing(np.zeros(0, np.uint32)), Growing(np.zeros(1, np.int64)), Growing(np.zeros(1, np.int64))

    def no_pieces(self) -> None:
        self.pieces: dict[str, int] = {"\n": 0}  # the end of a word has no ids
        self.piece_flat, self.piece_begin, self.piece_size = Growing(np.zeros(0, np.uint32)), Growing(np.zeros(1, np.int64)), Growing(np.zeros(1, np.int64))

    def learn(self, pieces: list[str]) -> None:
        """The ids of these pieces, new ones, from the tokenizer's model."""
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            lines = "\n".join(part)
            shown = lines if lines.isascii() else self.shown[np.frombuffer(lines.encode(), np.uint8)].tobytes().decode("utf-32-le")
            e = self.model.encode(shown, add_special_tokens=False)
            size = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            self.pieces.update(zip(part, range(len(self.pieces), len(self.pieces) + len(part))))
            self.piece_begin.add(self.piece_flat.size + np.cumsum(size) - size)
            self.piece_flat.add(np.array(e.ids, np.uint32))
            self.piece_size.add(size)

    def of_plain(self, word: str) -> list[int]:
        return self.of_lines([word])[0].tolist()

    def of_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain words, and how many each has."""
        pieces = PIECES("\n".join(words).lower() + "\n")
        of = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(of < 0).tolist()
        if missing:
            self.learn(list(dict.fromkeys([pieces[i] for i in missing])))
            of[missing] = [self.pieces[pieces[i]] for i in missing]
        n = self.piece_size.room[of]
        stops = np.cumsum(n)
        ids = self.piece_flat.room[np.repeat(self.piece_begin.room[of] - stops + n, n) + np.arange(stops[-1])]
        return ids, np.diff(stops[of == 0], prepend=0)

    def encoded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these words, and how many each has."""
        if len(self.pieces) > CACHE_SIZE:
            self.no_pieces()
        plain = np.fromiter([PLAIN(w) is not None for w in fresh], bool, len(fresh))
        rest = [fresh[i] for i in np.flatnonzero(~plain).tolist()]
        others = [e.ids for i in range(0, len(rest), 20_000) for e in self.tokenizer.encode_batch_fast(rest[i : i + 20_000], add_special_tokens=False)]
        size = np.zeros(len(fresh), np.int64)
        size[~plain] = [len(x) for x in others]
        if plain.any():
            ids, size[plain] = self.of_lines(fresh if plain.all() else [fresh[i] for i in np.flatnonzero(plain).tolist()])
        else:
            ids = np.zeros(0, np.uint32)
        out, mine = np.zeros(int(size.sum()), np.uint32), np.repeat(plain, size)
        out[mine] = ids
        out[~mine] = np.fromiter(chain.from_iterable(others), np.uint32, len(out) - len(ids))
        return out, size

    def keep(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        if len(self.number) + len(words) > CACHE_SIZE:
            self.forget()
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.begin.add(self.flat.size + np.cumsum(size) - size)
        self.flat.add(flat)
        self.size.add(size)

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end, and how many each text has."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        distinct, indices = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()  # much faster than to_pylist()
        of = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        flat, begin, size = self.flat.room[: self.flat.size], self.begin.room[of], self.size.room[of]
        missing = np.flatnonzero(of < 0)
        if len(missing):
            fresh = [distinct[i] for i in missing.tolist()]
            new, new_size = self.encoded(fresh)
            new_begin = np.cumsum(new_size) - new_size
            begin[missing], size[missing], flat = len(flat) + new_begin, new_size, np.concatenate([flat, new])
            again = np.bincount(indices, minlength=len(distinct))[missing] > 1  # most words that these texts have once don't come again
            self.keep([fresh[i] for i in np.flatnonzero(again).tolist()], new[np.repeat(again, new_size)], new_size[again])
        n = size[indices]
        stops = np.cumsum(n)
        ids = flat[np.repeat(begin[indices] - stops + n, n) + np.arange(len(n) and stops[-1])]
        ends = np.append(0, stops)[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]  # of each text, among the ids without ends
        return np.insert(ids, ends, np.uint32(END)), np.diff(ends, prepend=0) + 1


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Encodes all texts and writes them to the folder in ascending order of doc_id, in partitions of about PART_BYTES of text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART_BYTES))
    # Rows that share an id, or have none, are dealt by their texts and then by where they were read.
    spread = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ordered = spread.repartitionByRange(n, "doc_id", "h", "at").sortWithinPartitions("doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        encoder = word_encoder(tokenizer_path)
        doc_ids, lengths, ids, total = [], [], [], 0

        def segment() -> pa.RecordBatch:
            data = pack(doc_ids, np.concatenate(lengths), np.concatenate(ids))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["part", "segment", "n_ids", "data"])

        with without_gc():
            for batch in batches:
                for i in range(0, batch.num_rows, TEXTS):
                    rows = batch.slice(i, TEXTS)
                    new, n_each = encoder(rows.column(1))
                    doc_ids += rows.column(0).to_pylist()
                    lengths.append(n_each)
                    ids.append(new)
                    total += len(new)
                    if total >= SEGMENT:
                        yield segment()
                        number += 1
                        doc_ids, lengths, ids, total = [], [], [], 0
            if doc_ids:
                yield segment()

    ordered.mapInArrow(run, "part int, segment int, n_ids long, data binary").write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 of every document, from the files."""
    files = spark.read.parquet(folder)
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a partition
    first = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    starts = sizes.join(first, "part").select("part", "segment", (F.col("before") + F.sum("n_ids").over(W.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("segment_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc_ids, lengths, ids = unpack(data.as_py())
                ends = np.cumsum(lengths)
                wide = ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(ends - lengths, ends)]
                n = len(doc_ids)
                yield pa.record_batch([pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"])

    found = files.select("part", "segment", "data").mapInArrow(run, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(spark, folder)


QUERIES = {"op8_token_id_files": op8_token_id_files}
ORACLES: dict[str, str] = {}
