"""Repeated byte strings by minimiser sampling, which replaces prefix doubling.

Ranks of a suffix at every byte are 16 bytes for each byte of text, more than the disk allows
(``doubled`` does that and is the plain check of this module). Ranking starts here from sampled
suffixes that lose no repeat: every string of ``length`` bytes holds the same minimiser (of its
``GRAM``-byte substrings the one of least hash) wherever it occurs.

Each round sorts (rank, context) of pieces; a piece stands for strings that start at consecutive
bytes. Its rank is a hash of bytes that all of these strings hold, so that a unique rank drops
them all; its context is a hash of all bytes of these strings, so that equal contexts are repeats
of the first. What is neither is cut finer for the next round:

1. all strings of a minimiser, ranked by its GRAM bytes,
2. blocks of up to ``BLOCK`` of these strings, ranked by the bytes that a block shares,
3. single strings.

Ranks are 64-bit hashes, so that equal strings get equal ranks in any partition without a global
renumbering; a rank alone never decides on a removal, a second hash must agree.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, stored, table
from gridweft.llm.textkit import U64, Rolling, chunks, mix, ragged, tidy

LENGTH = 100
GRAM = 32
#: Bytes of a chunk: of a passage that recurs everywhere, one row a chunk is shuffled.
REPEATS_CHUNK = 1 << 21
#: Strings of a block, the pieces of the second round.
BLOCK = 12
#: Rows of null doc_id come after all others: the last id, and a bit that no other row number has.
LAST_ID = (1 << 63) - 1
NULL_ROW = 1 << 62


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(rank, context rank, text, first string, number of strings, bytes from it to the gram) of each minimiser.

    A minimiser stands for the consecutive strings of ``length`` bytes whose least gram it is; the
    context is all bytes of these strings. Equal hashes go to the first gram.
    """
    empty = tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64, np.int64))
    n = len(raw)
    if n < length:
        return empty
    rolling = Rolling(raw)
    h = rolling.fixed(gram)
    bits = max(1, int(n).bit_length())
    x = (h & U64(~((1 << bits) - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=U64)
    span, step = length - gram + 1, 1
    while 2 * step <= span:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    if step < span:
        x = np.minimum(x[: len(x) - (span - step)], x[span - step :])
    least = (x & U64((1 << bits) - 1)).astype(np.int64)
    # strings that lie within one text
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    at = ragged(offsets[:-1], size)
    if not len(at):
        return empty
    text = np.repeat(np.arange(len(size)), size)
    by = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (by[1:] != by[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    lo, anchor = at[first], by[first]
    context = mix(rolling.slices(lo, lo + count - 1 + length) + (anchor - lo).astype(U64))
    return h[anchor], context, text[first], lo - offsets[text[first]], count, anchor - lo


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(id, row, text) of every row, ordered by (id, row) as by doc_id; and the column that names a row.

    Where doc_id is unique, it is the name and ``row`` is 0. Otherwise the texts are stored with a
    number of each row, so that rows that share a doc_id stay apart; rows of null doc_id are last.
    """
    texts = docs.select(F.col("doc_id").cast("long"), clear_text().alias("text"))
    if texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return texts.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("row"), "text"), "id"
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    row = F.when(F.col("doc_id").isNull(), F.col("row").bitwiseOR(F.lit(NULL_ROW))).otherwise(F.col("row"))
    return texts.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), row.alias("row"), "text"), "row"


def scattered(ids: np.ndarray, rows: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Ranks that deal rows evenly whose fate is known, so that they crowd no task."""
    return mix(mix(ids.astype(U64) + mix(rows)) * U64(0x9E3779B97F4A7C15) + lo.astype(U64))


PIECE = "rank long, context long, id long, row long, lo long, n long, at int, known boolean"


def piece_batch(rank: np.ndarray, context: np.ndarray, ids: np.ndarray, rows: np.ndarray, lo: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Pieces of a chunk, in the order of their texts and places, as rows of ``PIECE``.

    Of equal contexts within a chunk only the first has to meet those of other chunks; the others
    are known to repeat it, and neighbours among them become one row. A passage that recurs
    everywhere thus sends one row a chunk.
    """
    known = later(rank ^ mix(context), ids, rows, lo)
    joins = np.zeros(len(lo), dtype=bool)
    joins[1:] = known[1:] & known[:-1] & (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1]) & (lo[1:] == lo[:-1] + n[:-1])
    first = np.flatnonzero(~joins)
    n = np.add.reduceat(n, first) if len(first) else n
    rank, context, ids, rows, lo, at, known = (x[first] for x in (rank.copy(), context, ids, rows, lo, at, known))
    rank[known] = scattered(ids[known], rows[known], lo[known])
    return pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(np.where(known, 0, context.view(np.int64))), pa.array(ids), pa.array(rows), pa.array(lo), pa.array(n), pa.array(at.astype(np.int32)), pa.array(known)], names=["rank", "context", "id", "row", "lo", "n", "at", "known"])


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The strings of each minimiser as a row of ``PIECE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy() for c in ("id", "row"))
            for a, _, raw, offsets in chunks(batch.column("text"), REPEATS_CHUNK):
                rank, context, text, lo, count, at = anchors(raw, offsets, length, gram)
                yield piece_batch(rank, context, ids[a + text], rows[a + text], lo, count, at)

    return texts.select("id", "row", "text").mapInArrow(tidy(run), PIECE)


def later(key: np.ndarray, ids: np.ndarray, numbers: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether the same key stands at an earlier (id, row, position)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), dtype=bool)
    if same.any():
        # sort only what is shared by position
        shared = np.zeros(len(k), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        rows = order[shared]
        rows = rows[np.lexsort((lo[rows], numbers[rows], ids[rows], key[rows]))]
        out[rows[1:]] = key[rows[1:]] == key[rows[:-1]]
    return out


_PLACE = ["id", "row", "lo", "n", "at"]


class _Sorted:
    """Walks sorted (rank, context) rows batch by batch; keeps one row between batches."""

    def __init__(self) -> None:
        self.rank = self.context = None
        self.held: pa.Table | None = None

    def settle(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        known = batch.column("known")
        yield self.marked(pa.Table.from_batches([batch.filter(known)]).select(_PLACE), 1)
        batch = batch.filter(pc.invert(known))
        rank, context = batch.column("rank").to_numpy(), batch.column("context").to_numpy()
        new_rank, new_context = np.ones(len(rank), dtype=bool), np.ones(len(rank), dtype=bool)
        new_rank[1:] = rank[1:] != rank[:-1]
        new_context[1:] = new_rank[1:] | (context[1:] != context[:-1])
        if self.rank is not None and len(rank):
            new_rank[0] = rank[0] != self.rank
            new_context[0] = new_rank[0] or context[0] != self.context
        rows = pa.Table.from_batches([batch]).select(_PLACE)
        again, other = ~new_context, new_context & ~new_rank
        run = np.cumsum(new_rank)
        shared = np.zeros(run[-1] + 1 if len(run) else 1, dtype=bool)
        shared[run[other]] = True
        if self.held is not None and shared[0]:
            yield self.marked(self.held, 2)
            self.held = None
        yield self.marked(rows.filter(pa.array(again)), 1)
        yield self.marked(rows.filter(pa.array(other | (new_rank & shared[run]))), 2)
        if len(rank):
            starts = np.flatnonzero(new_rank)
            if len(starts):
                self.held = None if shared[run[-1]] else rows.slice(int(starts[-1]), 1)
            self.rank, self.context = rank[-1], context[-1]

    @staticmethod
    def marked(rows: pa.Table, kind: int) -> pa.Table:
        return rows.append_column("kind", pa.array(np.full(rows.num_rows, kind, np.int32)))


def settled(rows: DataFrame) -> DataFrame:
    """(id, row, lo, n, at, kind) of pieces of shared rank: 1 repeats a context, 2 is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Sorted()
        for batch in batches:
            for part in walk.settle(batch):
                if part.num_rows:
                    yield from part.combine_chunks().to_batches()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "rank").sortWithinPartitions("rank", "context", "id", "row", "lo").mapInArrow(tidy(run), "id long, row long, lo long, n long, at int, kind int")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, offsets, ids, rows, text of each piece, lo, n, at) of chunks of texts (id, row, text, los, ns, ats)."""
    for batch in batches:
        batch = batch.filter(batch.column("los").is_valid())
        ids, rows = (batch.column(c).to_numpy() for c in ("id", "row"))
        for a, b, raw, offsets in chunks(batch.column("text"), REPEATS_CHUNK):
            lists = [batch.column(c).slice(a, b - a) for c in ("los", "ns", "ats")]
            lo, n, at = (np.asarray(x.flatten(), dtype=np.int64) for x in lists)
            text = np.repeat(np.arange(b - a), np.diff(np.asarray(lists[0].offsets)))
            order = np.lexsort((lo, text))
            yield raw, offsets, ids[a:b], rows[a:b], text[order], lo[order], n[order], at[order]


def block_rows(texts: DataFrame, length: int) -> DataFrame:
    """The strings of open pieces in blocks, as rows of ``PIECE``.

    Strings are dealt to blocks by their distance from the minimiser, which is the same wherever
    a string occurs. The rank is that of the bytes that all strings of a whole block hold, and of
    the block's number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offsets, ids, rows, text, lo, n, at in listed(batches):
            # strings of a piece lie at - n + 1 to at bytes before the minimiser
            most, least = at // BLOCK, (at - n + 1) // BLOCK
            count = most - least + 1
            of = np.repeat(np.arange(len(lo)), count)
            block = ragged(-most, count) * -1
            anchor, far = (lo + at)[of], np.minimum(at[of], block * BLOCK + BLOCK - 1)
            near = np.maximum((at - n + 1)[of], block * BLOCK)
            first, last = anchor - far, anchor - near
            base = offsets[text[of]]
            rolling = Rolling(raw)
            core = rolling.slices(base + anchor - block * BLOCK, base + anchor - block * BLOCK - BLOCK + 1 + length)
            context = mix(rolling.slices(base + first, base + last + length) + far.astype(U64))
            yield piece_batch(mix(core + block.astype(U64)), context, ids[text[of]], rows[text[of]], first, last - first + 1, far)

    return texts.select("id", "row", "text", "los", "ns", "ats").mapInArrow(tidy(run), PIECE)


def single_rows(texts: DataFrame, length: int) -> DataFrame:
    """The strings of open pieces one by one, as rows of ``PIECE``; their context is a second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, offsets, ids, rows, text, lo, n, _ in listed(batches):
            place = ragged(lo + offsets[text], n)
            of = np.repeat(text, n)
            rank, context = (Rolling(x).slices(place, place + length) for x in (raw, ~raw))
            yield piece_batch(rank, context, ids[of], rows[of], place - offsets[of], np.ones(len(place), np.int64), np.zeros(len(place), np.int64))

    return texts.select("id", "row", "text", "los", "ns", "ats").mapInArrow(tidy(run), PIECE)


def _removed(size: int, lo: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def trimmed(texts: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """Cut the strings that texts (id, row, text, los, ns) list: sizes, spans, hash and, if asked, what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, los, ns in zip(batch.column("text").cast(pa.large_binary()), batch.column("los"), batch.column("ns"), strict=True):
                raw = text.as_buffer()
                if not los.is_valid:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw.to_pybytes() if keep_text else None))
                    continue
                x = np.frombuffer(raw, np.uint8)
                gone = _removed(len(x), np.asarray(los.values), np.asarray(ns.values), length)
                left = x[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
            yield pa.RecordBatch.from_arrays(columns[: len(names) - (not keep_text)], names=names[: len(names) - (not keep_text)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * keep_text
    doc_id = F.when(F.col("row") < NULL_ROW, F.col("id"))
    return texts.select(doc_id.alias("doc_id"), "text", "los", "ns").mapInArrow(tidy(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes).

    Every byte under a string of ``length`` bytes that also starts earlier (a smaller doc_id, an
    earlier row of the same doc_id, or earlier in the same text) is removed; strings are taken from
    the input as it is and never cross texts. Null texts are empty; texts shorter than ``length``
    stay. Bytes are cut, so what is left need not be valid UTF-8. Rows that repeat a doc_id are texts of their own, in the order
    in which Spark numbers the rows; rows of null doc_id come last, in that order too.
    """
    gram = max(1, min(GRAM, length // 2))
    texts, key = numbered(docs)
    columns = {"lo": "los", "n": "ns", "at": "ats"}
    lists = lambda df, names: df.groupBy(key).agg(*[F.collect_list(c).alias(columns[c]) for c in names])
    # the same left join each time, so that one exchange of the texts serves all
    still = lambda df: texts.join(lists(df.where("kind = 2"), columns), key, "left")
    rounds = [stored(settled(anchor_rows(texts, length, gram)), "repeats")]
    if length > BLOCK:
        rounds.append(stored(settled(block_rows(still(rounds[0]), length)), "repeats"))
    rounds.append(settled(single_rows(still(rounds[-1]), length)))
    gone = functools.reduce(DataFrame.unionAll, [x.where("kind = 1").select("id", "row", "lo", "n") for x in rounds])
    return trimmed(texts.join(lists(gone, ("lo", "n")), key, "left"), length, keep_text)


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
