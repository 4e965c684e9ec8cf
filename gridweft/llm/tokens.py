"""Token ids as ORC: run-length encoded ids, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, scratch_path, table
from gridweft.llm.textkit import ragged, tidy

#: Texts in which a blank follows a blank are encoded whole, all others word by word.
BLANK_PAIR = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}][\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Bytes of text that are encoded together.
GROUP_BYTES = 1 << 22
CALL_WORDS = 10_000
CACHE_WORDS = 700_000
#: Signs that the pre-tokenizer never joins to letters or digits before them.
SIGNS = ".,;:!?&%$#*|)"
#: A word of Latin letters, perhaps after a space.
PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def _byte_level() -> dict[int, str]:
    """Each character up to U+024F as the visible characters that stand for its bytes."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    stands = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(stands[b] for b in chr(c).encode()) for c in range(0x250)}


BYTE_LEVEL = _byte_level()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(array: pa.Array) -> list[str]:
    """The same as to_pylist without an Arrow scalar for each string."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Byte-level BPE with one library call for each distinct word.

    The pre-tokenizer of byte-level BPE attaches a single space to the word that follows, so a
    text without two blanks in a row splits before each space into parts that are encoded
    independently; the ids are those of the whole text. It also cuts signs from the letters or
    digits before them, so a part's tail of signs is encoded on its own. Texts with adjacent
    blanks go to the library whole. Words met before are looked up; past ``CACHE_WORDS`` of them
    the memory starts anew, which changes no result.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(texts), CALL_WORDS):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + CALL_WORDS], add_special_tokens=False)]
        return out

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of single words; one of letters alone is a single pre-token and goes straight to the model."""
        tokenize, plain = self.tokenizer.model.tokenize, PLAIN.fullmatch
        out: list[list[int]] = [[]] * len(words)
        rest = []
        for k, w in enumerate(words):
            if plain(w):
                out[k] = [x.id for x in tokenize(w.translate(BYTE_LEVEL))]
            else:
                rest.append(k)
        for k, x in zip(rest, self.ids([words[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def places(self, words: list[str]) -> np.ndarray:
        """Where the pool has each of these words, which all differ; new ones are given a place."""
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            listed = [words[k] for k in new.tolist()]
            found = self.word_ids(listed)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            place[new] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.known.update(zip(listed, place[new].tolist(), strict=True))
            self.starts, self.counts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts]), np.concatenate([self.counts, counts])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))])
        return place

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.asarray(pc.match_substring_regex(texts, BLANK_PAIR))
        parts = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts), " ")
        offsets = np.asarray(parts.offsets, dtype=np.int64)
        coded = parts.flatten().dictionary_encode()
        index = np.asarray(coded.indices, dtype=np.int64)
        # a text's first part has no space before it
        n = len(coded.dictionary)
        heads, head_index = np.unique(index[offsets[:-1]], return_inverse=True)
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        listed = pa.concat_arrays([pc.binary_join_element_wise(space, coded.dictionary, empty), coded.dictionary.take(pa.array(heads))])
        index[offsets[:-1]] = n + head_index
        cores = pc.utf8_rtrim(listed, SIGNS)
        split = np.asarray(pc.and_(pc.less(pc.binary_length(cores), pc.binary_length(listed)), pc.match_substring_regex(cores, r"[\p{L}\p{N}]$")))
        words = pc.if_else(pa.array(split), cores, listed).dictionary_encode()
        tails = pc.struct_field(pc.extract_regex(listed.filter(pa.array(split)), f"(?P<tail>[{re.escape(SIGNS)}]+)$"), "tail").cast(pa.large_string()).dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.forget()
        place = self.places(_strings(words.dictionary))[np.asarray(words.indices)]
        tail = np.full(len(listed), -1, dtype=np.int64)
        tail[split] = self.places(_strings(tails.dictionary))[np.asarray(tails.indices)]
        # ids of each distinct part in a row, then those of whole texts and the end
        extra = self.ids(texts.filter(pa.array(whole)).to_pylist()) + ([[end]] if end is not None else [])
        tail_count = np.where(tail >= 0, self.counts[tail], 0)
        runs = np.stack([self.starts[place], self.starts[tail]], axis=1).reshape(-1)
        sizes = np.stack([self.counts[place], tail_count], axis=1).reshape(-1)
        extra_count = np.fromiter(map(len, extra), np.int64, len(extra))
        pool = np.concatenate([self.pool[ragged(runs, sizes)], np.fromiter(chain.from_iterable(extra), np.int32, int(extra_count.sum()))])
        counts = np.concatenate([self.counts[place] + tail_count, extra_count])
        starts = np.cumsum(counts) - counts
        index[offsets[:-1][whole]] = len(listed) + np.arange(int(whole.sum()))
        if end is not None:
            index = np.insert(index, offsets[1:], len(starts) - 1)
            offsets = offsets + np.arange(len(offsets))
        upto = np.concatenate([[0], np.cumsum(counts[index])])
        return pool[ragged(starts[index], counts[index])], upto[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder for each worker process, which later tasks find with the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_groups(batch: pa.RecordBatch, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(docs: DataFrame, path: str, end: int | None) -> DataFrame:
    """doc_id, start_in_part, n_tokens, tokens in the order of the input's partitions."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = encoder_for(path), 0
        for batch in batches:
            for group in text_groups(batch):
                ids, offsets = encoder.encode(group.column("text"), end)
                yield pa.RecordBatch.from_arrays(
                    [group.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))],
                    names=["doc_id", "start_in_part", "n_tokens", "tokens"],
                )
                start += int(offsets[-1])

    return docs.select(F.col("doc_id").cast("long"), clear_text().alias("text")).mapInArrow(tidy(encode), "doc_id long, start_in_part long, n_tokens long, tokens array<int>")


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end: int | None = 2, stripe_bytes: int = 16 << 20) -> None:
    """Write the token ids of every document to ORC files in ascending doc_id order.

    Documents are range-partitioned by doc_id, so that each file holds one range in order, with
    the text moved once and the much larger ids never. Stripes are the units of parallel reads;
    row indexes and Bloom filters on doc_id let a lookup skip stripes and row groups. Ids are
    encoded by ORC's integer run-length encoding. A null text is empty and has the end id alone;
    documents that repeat a doc_id all get rows, and those of null doc_id come first. A partition
    is one file (offsets count from its start), so that no limit of records a file holds here. An
    empty table makes a table without rows; other columns are ignored.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = encoded(ordered, path or vocabulary_path(), end).write
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(stripe_bytes), "compression": "zstd", "maxRecordsPerFile": "0"}
    writer.options(**options).orc(out)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The documents of a token table; with doc_ids, stripes that hold none of them are skipped."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(*doc_ids))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, read stripe by stripe in parallel."""
    part = F.col("_metadata.file_path").alias("part")
    sizes = spark.read.orc(path).select(part, "doc_id", "n_tokens").groupBy("part").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("size"))
    # a row for each file
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("first_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            offsets, ids = np.asarray(tokens.offsets, dtype=np.int64), np.asarray(tokens.values).astype("<u4")
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("start_in_part"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )

    rows = spark.read.orc(path).select(part, "doc_id", "start_in_part", "tokens").mapInArrow(tidy(digest), "part string, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "part").select("doc_id", (F.col("start_in_part") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op2_tokens_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)
