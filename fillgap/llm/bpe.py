"""BPE encoding and decoding through a table of distinct words.

Words repeat, so each distinct one is encoded once. Every part of the input makes blocks: the words of a block are
numbered by frequency, its documents become sequences of these numbers, packed into bytes, and its dictionary goes into
the table of words. There equal words of all blocks meet, each is encoded once, and the ids go back to the blocks that
have the word, by number. A block joins its documents with its words by position, and the ids with the pieces of the
vocabulary for the decoded text. Texts are never shuffled; what is shuffled is a byte or two a word.

Blocks are made twice, once for the dictionaries and once for the documents. Numbers follow from the set of rows of a
block alone, and a fingerprint of its dictionary is part of a block's name: should an input not repeat itself, the
documents find no words and the job fails instead of mixing words up.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fillgap.llm.hashing import SpanHasher

BLOCK_CHARS = 32 << 20  # a block ends after so many characters; its last document is whole
CHUNK_CHARS = 1 << 20  # so many are split at once
BATCH_CHARS = 4 << 20  # of a block's results that leave a task together

#: Text of these characters is in normal form C, and one look at a character tells what it is.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xB1\xB4-\xB8\xBA\xBB\xBF-\xFF]*")
#: Endings that are words of their own; text with one takes the tokenizer's own way.
ENDINGS = re.compile(r"'(?:s|t|re|ve|m|ll|d)", re.IGNORECASE)

GAP = re.compile(r"\s")

LETTER, DIGIT, SPACE, OTHER = range(4)
KINDS = np.array([SPACE if chr(c).isspace() else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else OTHER for c in range(256)], np.uint8)


def word_ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of letters, single digits, runs of anything else but space."""
    kinds = KINDS[codes]
    new = np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT), [True])) if len(codes) else np.array([True])
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    words = kinds[starts] != SPACE
    return starts[words], ends[words]


class Words:
    """Splits texts into words as the tokenizer does before its merges."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not ("'" in text and ENDINGS.search(text)) and (self.marks is None or "<" not in text or not self.marks.search(text))

    def split(self, text: str) -> list[str]:
        """The tokenizer's own way, for any text."""
        out: list[str] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(part)
            else:
                part = self.tokenizer.normalizer.normalize_str(part)
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out


class Block:
    """Documents as runs of word numbers, and the words by number; a word gets its number where it first occurs.

    Texts are split chunk by chunk and not kept: what a block holds is four bytes a word and its distinct words.
    """

    def __init__(self, hasher: SpanHasher):
        self.hasher, self.chars = hasher, 0
        self.ids, self.lengths, self.runs, self.names = [], [], [], []
        self.known, self.number_of = np.empty(0, np.uint64), np.empty(0, np.int32)  # hashes in order, and their words' numbers
        self.waiting, self.held = [], 0

    def add(self, i, text: str | None, words: Words) -> None:
        text = text or ""
        self.ids.append(i)
        self.chars += len(text)
        if not words.plain(text):
            self._flush()
            parts = words.split(text)
            self.lengths.append(len(parts))
            for k in range(0, len(parts), CHUNK_CHARS // 8):
                self._number_parts(parts[k : k + CHUNK_CHARS // 8])
        elif len(text) > CHUNK_CHARS:
            self._flush()
            self.lengths.append(sum(int(self._number_plain([part])[0]) for part in _chunks(text.lower())))
        else:
            self.waiting.append(text.lower())
            self.held += len(text)
            if self.held > CHUNK_CHARS:
                self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self.lengths += self._number_plain(self.waiting).tolist()
            self.waiting, self.held = [], 0

    def _number_plain(self, texts: list[str]) -> np.ndarray:
        """Numbers the words of texts of PLAIN characters; how many each text has."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("latin-1"), np.uint8)
        starts, ends = word_ends(codes)
        self._number(joined, codes, starts, ends)
        return np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))

    def _number_parts(self, parts: list[str]) -> None:
        """Numbers words that are split already."""
        joined = "\n".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        self._number(joined, codes, starts, starts + sizes)

    def _number(self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        distinct, first, which = np.unique(self.hasher(codes, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == distinct[old]
        new, numbers = np.flatnonzero(~old), np.empty(len(distinct), np.int32)
        numbers[old] = self.number_of[at[old]]
        numbers[new] = np.arange(len(self.names), len(self.names) + len(new))
        self.names += [joined[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        self.known = np.insert(self.known, at[new], distinct[new])
        self.number_of = np.insert(self.number_of, at[new], numbers[new])
        self.runs.append(numbers[which])

    def numbered(self):
        """(dictionary by falling frequency, its fingerprint, an iterator over the documents' word numbers)."""
        self._flush()
        flat = np.concatenate(self.runs) if self.runs else np.empty(0, np.int32)
        self.runs, n = [flat], len(self.names)
        counts = np.bincount(flat, minlength=n).tolist()
        order = sorted(range(n), key=lambda i: (-counts[i], self.names[i]))
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        names = [self.names[i] for i in order]
        mark = 0
        for name in names:
            mark = zlib.crc32(name.encode("utf-8", "surrogatepass") + b"\n", mark)
        edges = np.cumsum([0, *self.lengths]).tolist()
        return names, mark, (rank[flat[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True))


def _chunks(text: str) -> Iterator[str]:
    """A very long text in parts of about CHUNK_CHARS that end at a space, so that no word is parted."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + CHUNK_CHARS)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end


def packed(numbers) -> bytes:
    """Little-endian groups of seven bits, the top bit set where more follow."""
    v = np.asarray(numbers, np.uint32)
    if not len(v):
        return b""
    groups = np.stack([(v >> s) & 0x7F for s in (0, 7, 14, 21, 28)], axis=1).astype(np.uint8)
    length = 1 + sum((v >= (1 << s)).astype(np.int64) for s in (7, 14, 21, 28))
    groups |= (np.arange(5) < (length - 1)[:, None]).astype(np.uint8) << 7
    return groups[np.arange(5) < length[:, None]].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(b[:-1] < 128) + 1))
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * place), starts)


def _blocks(rows: Iterator[pa.RecordBatch], path: str):
    """Block by block: (block, dictionary, ids, word numbers of each document)."""

    def key(part: int, k: int, mark: int) -> int:
        return (mark & 0x7FFFFFFF) << 32 | part << 10 | k

    words, hasher, part, k = Words(path), SpanHasher(), TaskContext.get().partitionId(), 0
    block = Block(hasher)
    for batch in rows:
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            block.add(i.as_py(), text.as_py(), words)
            if block.chars >= BLOCK_CHARS:
                names, mark, docs = block.numbered()
                yield key(part, k, mark), names, block.ids, docs
                k, block = k + 1, Block(hasher)
    if block.ids:
        names, mark, docs = block.numbered()
        yield key(part, k, mark), names, block.ids, docs


def _dictionaries(path: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, _, _ in _blocks(rows, path):
            for s in range(0, len(names), 50_000):
                n = names[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(n), pa.int64()), pa.array(range(s, s + len(n)), pa.int32()), pa.array(n, pa.string())], names=["block", "number", "word"])

    return run


def _documents(path: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, ids, docs in _blocks(rows, path):
            for s in range(0, len(ids), 1_000):
                some = ids[s : s + 1_000]
                coded = [packed(x) for x in islice(docs, len(some))]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int64()), pa.array(coded, pa.binary())], names=["block", "doc_id", "numbers"])

    return run


def id_type(tokenizer: Tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _encoded(path: str):
    """Ids of words that come in order, so that equal words stand together and each is encoded once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, ids = Tokenizer.from_file(path), None, b""
        kind = id_type(tokenizer)
        for batch in rows:
            out = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, np.array(tokenizer.encode(word, add_special_tokens=False).ids, kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "number", "ids"])

    return run


def _pieces(path: str) -> tuple[np.ndarray, str]:
    """The vocabulary's pieces by id, and how ids are stored."""
    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    pieces = np.full(max(vocabulary.values(), default=0) + 1, "", object)
    pieces[list(vocabulary.values())] = list(vocabulary)
    return pieces, id_type(tokenizer)


def _put_together(path: str, texts: bool):
    """Join a block's documents with its words by number, and the ids with the pieces of the vocabulary."""
    kept: list = []  # a task's copy of the vocabulary

    def out(ids, n_tokens, all_ids, decoded) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(all_ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not kept:
            kept.extend(_pieces(path))
        pieces, kind = kept[0], np.dtype(kept[1])
        n = words.num_rows
        digits = [str(i) for i in range(len(pieces))]
        counts, ids, says = np.zeros(n, np.int64), np.full(n, "", object), np.full(n, "", object)
        for number, data in zip(words["number"], words["ids"], strict=True):
            own = np.frombuffer(data.as_py(), kind).tolist()
            k = number.as_py()
            counts[k], ids[k], says[k] = len(own), " ".join([digits[i] for i in own]), " ".join([pieces[i] for i in own])
        batches, rows, held = [], ([], [], [], []), 0
        for i, some in zip(docs["doc_id"], docs["numbers"], strict=True):
            numbers = unpacked(some.as_py())
            if len(numbers) and not n:
                raise RuntimeError("a block's words differ between two reads of the input; write the input to a table first")
            a, b = " ".join(ids[numbers].tolist()), " ".join(says[numbers].tolist())
            if not texts:
                a, b = hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode("utf-8", "replace")).hexdigest()
            for column, value in zip(rows, (i.as_py(), int(counts[numbers].sum()), a, b), strict=True):
                column.append(value)
            held += len(a) + len(b)
            if held > BATCH_CHARS:
                batches.append(out(*rows))
                rows, held = ([], [], [], []), 0
        return pa.Table.from_batches([*batches, out(*rows)])

    return run


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Input: doc_id, text; other columns are ignored. ``path`` is a tokenizer file that every executor can read; text of
    PLAIN characters has to split into runs of letters, single digits and runs of other characters. Output, one row for
    every input row: doc_id, n_tokens, ids (decimal, joined by one space), decoded (what decode() gives, special tokens
    kept); with ``digests`` ids and decoded are the lowercase hex SHA-256 of these texts. Null text counts as empty, and
    an empty text has no ids and decodes to ''. Null ids and repeated rows are documents of their own; no rows give no
    rows. A block's words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = rows.mapInArrow(_dictionaries(path), "block long, number int, word string")
    known = dictionary.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(path), "block long, number int, ids binary")
    packed_docs = rows.mapInArrow(_documents(path), "block long, doc_id long, numbers binary")
    both = packed_docs.groupBy("block").cogroup(known.groupBy("block"))
    return both.applyInArrow(_put_together(path, not digests), "doc_id long, n_tokens long, ids string, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded from rows of doc_id, pos, id: ids join with their pieces, which meet again in order of pos."""
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    pieces = encoded.sparkSession.createDataFrame(sorted((i, p) for p, i in vocabulary.items()), "id int, piece string")
    each = encoded.select("doc_id", "pos", "id").join(F.broadcast(pieces), "id")  # as large as the vocabulary
    met = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("t"))
    return met.select("doc_id", F.array_join(F.transform("t", lambda x: x["piece"]), " ").alias("decoded"))
