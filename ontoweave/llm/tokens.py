"""Token-id output as directly addressable codes: any token of a file is read without decoding its neighbours."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import lean, pieces
from .common import fresh_path, open_fs

MAGIC = b"OWDAC001"
#: Bits of a chunk, and of the blocks of a bitmap between two entries of its rank directory.
CHUNK_BITS, RANK_BITS = 8, 512
#: A file is closed once it has this many tokens; documents are never split.
FILE_TOKENS = 1 << 22

_ENCODERS: dict[str, Encoder] = {}


# ---- the format -----------------------------------------------------------------------------------------------------
def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (chunks, continuation bitmap, rank directory) of ids (uint32). Level k holds bits 8k to 8k+7 of the ids that
    reach it; a set bit says that the id goes on in the next level, at the place that the number of set bits before it
    gives; the directory has that number at the start of each block of 512 bits."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        levels.append(((rest & (1 << CHUNK_BITS) - 1).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")))
        rest = more[on]
        if not len(rest):
            return levels


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: list[int]) -> bytes:
    """A file: magic, then little-endian u64 (tokens, documents, levels), per level u64 chunks and its three arrays, then
    per document i64 id, u8 (1: id is null) and u64 end, then u32 crc32 of all that."""
    levels = encode(ids)
    out = [MAGIC, np.array([len(ids), len(doc_ids), len(levels)], "<u8").tobytes()]
    for chunks, bits, ranks in levels:
        out += [np.array([len(chunks), len(bits), len(ranks)], "<u8").tobytes(), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    out += [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array(ends, "<u8").tobytes()]
    body = b"".join(out)
    return body + zlib.crc32(body).to_bytes(4, "little")


class TokenFile:
    """A file in memory or mapped: token(i) and tokens(start, end) address it directly; doc_ids, starts and ends tell the documents."""

    def __init__(self, data: bytes, check: bool = True):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC or check and zlib.crc32(view[:-4]) != int.from_bytes(view[-4:], "little"):
            raise ValueError("not a token file, or a damaged one")
        at = 8

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(view, kind, n, at)
            at += got.nbytes
            return got

        self.n_tokens, n_docs, n_levels = map(int, take(3, "<u8"))
        self.levels = []
        for _ in range(n_levels):
            a, b, c = map(int, take(3, "<u8"))
            self.levels.append((take(a, "u1"), take(b, "u1"), take(c, "<u4")))
        ids, null = take(n_docs, "<i8"), take(n_docs, "u1")
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.ends = take(n_docs, "<u8").astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if n_docs else self.ends

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block, bit = divmod(i, RANK_BITS)
        first = block * RANK_BITS // 8
        whole, over = divmod(bit, 8)
        ones = int(np.bitwise_count(bits[first : first + whole]).sum())
        return int(ranks[block]) + ones + (int(bits[first + whole]) & (1 << over) - 1).bit_count()

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        got = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            got |= int(chunks[i]) << CHUNK_BITS * level
            if not int(bits[i >> 3]) >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return got

    def tokens(self, start: int, end: int) -> np.ndarray:
        """ids (uint32) from start to end, exclusive."""
        start, end = max(0, start), min(end, self.n_tokens)
        got = np.zeros(max(0, end - start), np.uint32)
        where = np.arange(len(got))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(where):
                break
            got[where] |= chunks[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            on = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start] > 0
            where = where[on]
            start, end = self._rank(bits, ranks, start), 0
            end = start + len(where)
        return got


# ---- tokenizing -----------------------------------------------------------------------------------------------------
#: Latin letters, all of which composition leaves alone and whose lower case has one letter, and a run of punctuation.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class Encoder:
    """The ids of whole texts, the same as the tokenizer's own.

    Where the tokenizer composes, lower-cases and splits so that no token spans white space or both letters and
    punctuation, and marks word ends, the distinct words of some texts are encoded once, in one call, bare of punctuation
    and lower-cased if they are plain, and dealt out to the places where they stand. Texts that hold one of its added
    tokens, and all texts of other tokenizers, are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.added = [x["content"] for x in made.get("added_tokens") or []]
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers") or []]
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = made["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and "[\\p{L}]+" in cuts[0]["pattern"].get("Regex", "") and "[^\\s\\p{L}\\p{N}]+" in cuts[0]["pattern"]["Regex"] and not cuts[1]["use_regex"]
        if self.by_word:
            self.bare = Tokenizer.from_str(json.dumps(made | {"normalizer": None, "added_tokens": [], "pre_tokenizer": cuts[1]}))
            vocab = self.whole.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, the texts' lengths)"""
        got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64)

    def _bare(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_whole of plain lower-case words, whose ends the ids tell."""
        if not stems:
            return self._whole(stems)
        ids = np.array(self.bare.encode_batch_fast([stems], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(at, prepend=0)) if len(at) == len(stems) else self._whole(stems)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """_whole of distinct words without blanks."""
        cut = pc.extract_regex(words, PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(cut.field("stem").filter(cut.is_valid())).dictionary_encode()
        tails = cut.field("tail").filter(cut.is_valid()).dictionary_encode()
        parts = [self._bare(stems.dictionary.to_pylist()), self._whole([*tails.dictionary.to_pylist(), *words.filter(pc.invert(cut.is_valid())).to_pylist()]), self._whole([""])]
        n_stems, n_tails, n = len(stems.dictionary), len(tails.dictionary), len(words)
        none = n_stems + n_tails + int((~plain).sum())
        first, second = np.empty(n, np.int64), np.full(n, none)
        first[plain], second[plain] = stems.indices.to_numpy(), n_stems + tails.indices.to_numpy()
        first[~plain] = n_stems + n_tails + np.arange(none - n_stems - n_tails)
        got = _lists(*map(np.concatenate, zip(*parts, strict=True))).take(pa.array(np.column_stack([first, second]).ravel()))
        return got.flatten().to_numpy(), np.diff(got.offsets.to_numpy()[::2])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, their lengths); null is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            return self._whole(texts.to_pylist())
        odd = np.zeros(len(texts), bool)
        for x in self.added:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        got = _lists(*self._distinct(coded.dictionary)).take(coded.indices)
        ids, lengths = got.flatten().to_numpy(), np.diff(got.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()])
        for i in np.flatnonzero(odd):
            own, at = self._whole([texts[i].as_py()])[0], lengths[:i].sum()
            ids, lengths[i] = np.concatenate([ids[:at], own, ids[at:]]), len(own)
        return ids, lengths


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64()), pa.array(ids.astype(np.uint32, copy=False)))


def encoder(tokenizer_path: str) -> Encoder:
    """The worker's Encoder of a tokenizer file."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


# ---- writing and reading --------------------------------------------------------------------------------------------
def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of all texts under path (in the shared folder) in ascending order of id_col, and a manifest row for
    each file (part, seq, file, n_docs, n_tokens) as Parquet under path/manifest, which is returned.

    Rows are range-sorted by id, so the files in order of (part, seq) hold all documents in order. A file gets its name
    by a rename once it is whole, and the name and bytes depend on the rows alone, so a task that runs again, or twice at
    once, does no harm; only files of the manifest count. Null ids come first; rows of one id are ordered by their text's
    hash; null and empty texts have the end id alone; an empty table gives an empty manifest; further columns are
    ignored."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")
    open_fs(path)[0].create_dir(open_fs(path)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode_texts = encoder(tokenizer_path)
        fs, base = open_fs(path)
        parts, ids, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.dac"
            temp = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp, compression=None) as f:
                f.write(pack(np.concatenate(parts), ids, np.cumsum(np.concatenate(lengths)).tolist()))
            fs.move(temp, f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(ids), "n_tokens": held}], schema=schema)

        for b in batches:
            for piece in pieces(b, 1):
                got, sizes = encode_texts(piece.column(1))
                if end_id is not None:
                    got, sizes = np.insert(got, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
                parts.append(got)
                lengths.append(sizes)
                ids += piece.column(0).to_pylist()
                held += len(got)
                if held >= file_tokens:
                    yield flush()
                    parts, ids, lengths, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows.mapInArrow(lean(run), "part int, seq int, file string, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document of the files under path: id, start (ids of all documents before it), n_tokens, ids_crc32
    (unsigned, of its ids as little-endian u32) and file. The running sum goes over a row per file."""
    manifest = spark.read.parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", before.alias("first")).repartition(n, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    got = TokenFile(f.read())
                ids = got.tokens(0, got.n_tokens)
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(got.starts, got.ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(got.doc_ids, pa.int64()), pa.array(got.starts + first), pa.array(got.ends - got.starts), pa.array(crc, pa.int64()), pa.array([name] * len(crc), pa.string())], names=[id_col, "start", "n_tokens", "ids_crc32", "file"])

    return files.mapInArrow(lean(run), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, file string")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None, **options) -> DataFrame:
    """write_tokens, then read_tokens of the same files; path: a new one in the shared folder unless given."""
    path = path or fresh_path(docs.sparkSession, "tokens", keep=True)
    write_tokens(docs, path, tokenizer_path, end_id, **options)
    return read_tokens(docs.sparkSession, path, options.get("id_col", "doc_id"))
