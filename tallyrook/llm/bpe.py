"""BPE through a table of distinct words."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, release, small_batches

#: The letters, numbers and white space of Latin-1, and how byte-level BPE splits
#: such a text into words. What can start alike keeps the tokenizer's order.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
WORDS = f" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words that the tokenizer encodes in one call, which makes an object of a kilobyte for each.
AT_ONCE = 4_096
#: Characters of text in a block, unless one text has more.
BLOCK = 4 << 20


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it
    prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file's content, which tasks get by value: its size does not depend on data."""

    content: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return Vocabulary(f.read())

    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.content)
        t.no_truncation()
        t.no_padding()
        return t

    def splitter(self):
        """The tokenizer's splitter of texts, without its table of words."""
        from tokenizers import Tokenizer

        plain = json.loads(self.content) | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        return Tokenizer.from_str(json.dumps(plain)).pre_tokenizer

    def specials(self) -> dict[str, int]:
        return {a["content"]: a["id"] for a in json.loads(self.content)["added_tokens"]}

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's begin, with the end."""
        own, special, chars = json.loads(self.content)["model"]["vocab"], self.specials(), _byte_chars()
        table = {i: bytes(chars[c] for c in p) for p, i in own.items() if p not in special}
        table |= {i: p.encode() for p, i in special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Splitter:
    """Splits a text as the tokenizer does. Special tokens are words of their own. Texts in
    Latin-1, which are most, go through a regular expression, others through the tokenizer's own
    slower splitter."""

    def __init__(self, vocabulary: Vocabulary):
        self.find = re.compile(WORDS).findall
        special = [re.escape(s) for s in sorted(vocabulary.specials(), key=len, reverse=True)]
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        self.own = vocabulary.splitter()

    def part(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.find(text)
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.part(text)
        return [w for i, p in enumerate(self.special.split(text)) if p for w in ([p] if i % 2 else self.part(p))]


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of each, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_parts(parts: list[bytes]) -> bytes:
    sizes = _pack(np.fromiter(map(len, parts), np.uint32, len(parts)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack_parts(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(_unpack(data[4 : 4 + n])).tolist()
    flat = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


def _blocks(batches: Iterator[pa.RecordBatch], splitter: Splitter) -> Iterator[tuple[int, pa.Array, list[np.ndarray], list[str]]]:
    """(block, ids, each text's words as places, the distinct words): a block is a run of
    documents of (_id, _text) up to BLOCK characters, over batches of any size, and frequent words
    come first, as small places compress."""
    part, block, held = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    codes: list[np.ndarray] = []
    seen: defaultdict = defaultdict()
    seen.default_factory = seen.__len__

    def full() -> tuple[int, pa.Array, list[np.ndarray], list[str]]:
        often = np.bincount(np.concatenate(codes), minlength=len(seen))
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(seen), np.uint32)
        place[order] = np.arange(len(seen), dtype=np.uint32)
        words = list(seen)
        return (part << 32) + block, pa.concat_arrays(ids), [place[c] for c in codes], [words[i] for i in order.tolist()]

    for b in batches:
        start = 0
        for i, cell in enumerate(b.column(1)):
            text = cell.as_py()
            if codes and held + len(text) > BLOCK:
                ids.append(b.column(0).slice(start, i - start))
                yield full()
                start, block, held = i, block + 1, 0
                ids.clear()
                codes.clear()
                seen.clear()
            w = splitter(text)
            codes.append(np.fromiter(map(seen.__getitem__, w), np.uint32, len(w)))
            held += len(text)
        ids.append(b.column(0).slice(start))
    if codes:
        yield full()


def _encoded(tokenizer, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word, ids), a few words at a time."""
    for i in range(0, len(words), AT_ONCE):
        part = words[i : i + AT_ONCE]
        for w, g in zip(part, tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False)):
            yield w, np.array(g.ids, "<u4").tobytes()


def _dealt(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(bucket, which of the words, their checksum): a word's bucket follows from the word alone."""
    at = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(at, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(words) else []:
        yield int(at[part[0]]), part, zlib.crc32(b"\0".join(words[i] for i in part.tolist()))


def _word_table(docs: DataFrame, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    """(block, bucket, mark, ids): the ids of each block's words, a row for each bucket of them.

    Each block deals its distinct words into buckets by hash, packed. A bucket meets in one task,
    which encodes each distinct word once and sends its ids to all blocks that asked. The words
    themselves stay in the block; mark is their checksum.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, words in _blocks(batches, Splitter(vocabulary)):
            raw = [w.encode() for w in words]
            rows = [(k, m, _pack_parts([raw[i] for i in part.tolist()])) for k, part, m in _dealt(raw, buckets)]
            columns = [pa.array([block] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "mark", "words"])
        release()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known, now = vocabulary.tokenizer(), {}, None
        for b in batches:
            out = []
            for bucket, data in zip(b["bucket"].to_pylist(), b["words"]):
                if bucket != now:
                    known, now = {}, bucket
                words = _unpack_parts(data.as_py())
                known.update(_encoded(tokenizer, [w for w in words if w not in known]))
                out.append(_pack_ids([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays([b["block"], b["bucket"], b["mark"], pa.array(out, pa.binary())], ["block", "bucket", "mark", "ids"])
        del tokenizer, known
        release()

    named = docs.mapInArrow(name, "block long, bucket int, mark long, words binary")
    return named.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(encode, "block long, bucket int, mark long, ids binary")


def _pack_ids(ids: list[bytes]) -> bytes:
    sizes = _pack(np.fromiter((len(i) // 4 for i in ids), np.uint32, len(ids)))
    return len(sizes).to_bytes(4, "little") + sizes + _pack(np.frombuffer(b"".join(ids), "<u4"))


def _unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(how many ids each word has, the ids of all)."""
    n = int.from_bytes(data[:4], "little")
    return _unpack(data[4 : 4 + n]).astype(np.int64), _unpack(data[4 + n :])


def _runs_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes, one run after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_tokens, ids, decoded), one row for each of docs: ids as little-endian unsigned
    32-bit integers, and the text that they decode to.

    Words are split where the texts are read, once to build the table of distinct words and
    once to look them up; that costs less than to store and shuffle the texts. What is shuffled is a
    word per block instead of one per occurrence, and each text as places in its block's list. The
    ids join the places, and each id its piece. Should the rows of a block differ between the two
    readings, a checksum tells, and its words are encoded where they are needed, so results never
    depend on it. A block's table is bounded by BLOCK or its one longer text; there are four buckets of
    words for each task that reads, so a bucket does not grow with the input. Null texts count as
    empty, which have no ids; ids may be null or repeat; other columns do not matter; an empty table
    stays empty.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.load(path)
    id_type = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("_id"), body(text_col).alias("_text"))
    buckets = 4 * max(1, slim.rdd.getNumPartitions())
    placed = T.StructType([T.StructField("block", T.LongType()), T.StructField("_id", id_type), T.StructField("codes", T.BinaryType()), T.StructField("list", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, codes, words in _blocks(batches, Splitter(vocabulary)):
            n, listed = len(ids), pa.array([_pack_parts([w.encode() for w in words])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), ids, pa.array([_pack(c) for c in codes], pa.binary()), pa.nulls(n, pa.binary())], placed.names)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, ids.type), pa.nulls(1, pa.binary()), listed], placed.names)
        release()

    schema = T.StructType([T.StructField("_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    once: dict = {}  # a task's own, as it gets this function by value

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not once:
            once["pieces"] = vocabulary.pieces()
        piece, begin = once["pieces"]
        texts = left.filter(pc.is_null(left["list"]))
        words = [w for data in left["list"].drop_null() for w in _unpack_parts(data.as_py())]
        sent = {(k, m): i for k, m, i in zip(right["bucket"].to_pylist(), right["mark"].to_pylist(), right["ids"])}
        order, sizes, flat = [], [], []
        for k, part, m in _dealt(words, buckets):
            if (k, m) in sent:
                n, ids = _unpack_ids(sent[k, m].as_py())
            else:
                n, ids = _unpack_ids(_pack_ids([i for _, i in _encoded(vocabulary.tokenizer(), [words[w] for w in part.tolist()])]))
            order.append(part)
            sizes.append(n)
            flat.append(ids)
        none = [np.zeros(0, np.int64)]
        order, sizes, tokens = np.concatenate([*none, *order]).astype(np.int64), np.concatenate([*none, *sizes]).astype(np.int64), np.concatenate([np.zeros(0, np.uint32), *flat])
        # each word's ids, and the bytes of their pieces
        n_ids, n_bytes = np.empty((2, len(words)), np.int64)
        id_at, byte_at = np.empty((2, len(words)), np.int64)
        n_ids[order], id_at[order] = sizes, np.cumsum(sizes) - sizes
        width = begin[tokens.astype(np.int64) + 1] - begin[tokens]
        raw, upto = piece[_runs_of(begin[tokens], width)], np.concatenate([[0], np.cumsum(width)])
        byte_at[order] = upto[id_at[order]]
        n_bytes[order] = upto[id_at[order] + n_ids[order]] - byte_at[order]
        out, decoded = [], []
        for c in texts["codes"]:
            at = _unpack(c.as_py())
            out.append(tokens[_runs_of(id_at[at], n_ids[at])].astype("<u4").tobytes())
            decoded.append(raw[_runs_of(byte_at[at], n_bytes[at])].tobytes().decode("utf-8", "replace"))
        columns = [texts["_id"], pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary()), pa.array(decoded, pa.string())]
        done = pa.Table.from_arrays(columns, schema.names)
        del words, sent, flat, out, decoded, columns, raw
        release()
        return done

    return slim.mapInArrow(place, placed).groupBy("block").cogroup(_word_table(slim, vocabulary, buckets).groupBy("block")).applyInArrow(join, schema)


def id_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def report(encoded: DataFrame) -> DataFrame:
    """The digest columns of op8."""
    return encoded.select(F.col("_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
