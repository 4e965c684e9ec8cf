"""Near-duplicate documents by SetSketch registers, banding, joint estimates and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, stored, table
from gridweft.llm.graph import components
from gridweft.llm.textkit import LOWER, U64, Rolling, chunks, mix, ragged, tidy, words

#: Registers of a sketch and how many of them a band takes. At a similarity of 0.8 a pair shares
#: no band with probability (1 - 0.8**4)**32 = 5e-8.
REGISTERS = 128
BAND = 4
#: Base of the exponentially spaced register values, and their rate.
SKETCH_BASE = 1.02
SKETCH_RATE = 20.0
MAX_VALUE = (1 << 16) - 1
#: Estimates have a standard deviation of 0.035 here; pairs estimated lower than this are no links.
SLACK = 0.2
#: Members of a cell that are compared with each other in one piece of work.
BLOCK_ROWS = 512


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk; a shorter text is one shingle."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    h = Rolling(raw).slices(starts, ends)
    rolled = h.copy()
    for j in range(1, min(width, len(h))):
        rolled[: len(h) - j] = mix(rolled[: len(h) - j] * U64(3) + h[j:])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            x = U64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x], U64) * U64(5) + w)[0]
            out.append(np.array([x], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def sketch(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set, a row of uint16; zeros for an empty set.

    Each element sends points to registers at the times of a Poisson process of rate m, which
    gives each register an exponential time from each element; a register keeps its least time,
    rounded down on a scale of powers of SKETCH_BASE. Points past the time by which all registers
    of a set are filled are never made: a set of n elements makes about m (ln m + 3) + n of them.
    Sketches of two sets merge to that of their union by the greater value of each register.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    times = np.full((len(sets), m), np.inf)
    todo, horizon = np.flatnonzero(sizes), (np.log(m) + 3) / np.maximum(sizes, 1)
    while len(todo):
        h = np.concatenate([sets[i] for i in todo])
        of = np.repeat(todo, sizes[todo])
        t = np.zeros(len(h))
        k = 0
        while len(h):
            k += 1
            x = mix(h + U64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> U64(11)).astype(float) + 0.5) * 2.0**-53) / m
            go = t < horizon[of]
            h, of, t, x = h[go], of[go], t[go], x[go]
            np.minimum.at(times.reshape(-1), of * m + (x & U64(m - 1)).astype(np.int64), t)
        todo = todo[np.isinf(times[todo]).any(axis=1)]
        horizon[todo] *= 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.floor(1 - np.log(times * SKETCH_RATE) / np.log(SKETCH_BASE)) + MAX_VALUE // 2
    value[sizes == 0] = 0
    return np.clip(value, 0, MAX_VALUE).astype(np.uint16)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches by joint maximum likelihood.

    With sizes known, the counts of greater, smaller and equal registers are multinomial; their
    probabilities depend on the similarity alone. The best of 101 similarities is taken.
    """
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - above - below
    u = nx / (nx + ny)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[:, None]
    most = np.minimum(u / v, v / u)
    j = np.minimum(grid, most)
    p = lambda z: -np.log1p(-np.maximum(z, 0) * (SKETCH_BASE - 1) / SKETCH_BASE) / np.log(SKETCH_BASE)
    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    likelihood = above * np.log(np.maximum(more, tiny)) + below * np.log(np.maximum(less, tiny)) + equal * np.log(np.maximum(1 - more - less, tiny))
    return j[likelihood.argmax(axis=0), np.arange(len(u))]


def set_signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets agree, different ones don't."""
    sums = [(int(mix(s).sum(dtype=U64)), int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64))) for s in sets]
    both = np.array(sums, dtype=U64).reshape(-1, 2).view(np.int64)
    return both[:, 0], both[:, 1]


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _registers(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, m)


def text_print(text: str = "text") -> Column:
    return F.xxhash64(clear_text(text))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print (a hash of the text as it is), n, s1, s2 and registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                sets = shingles(raw, offsets, width)
                s1, s2 = set_signature(sets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("print").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), _binary(sketch(sets))], names=["doc_id", "print", "n", "s1", "s2", "registers"])

    return docs.select(F.col("doc_id").cast("long"), text_print().alias("print"), clear_text().alias("text")).mapInArrow(tidy(run), "doc_id long, print long, n long, s1 long, s2 long, registers binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, rep): a row for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _registers(batch.column("registers"), REGISTERS).astype(U64).reshape(-1, REGISTERS // BAND, BAND)
            key = np.broadcast_to(mix(np.arange(REGISTERS // BAND, dtype=U64)), x.shape[:2])
            for j in range(BAND):
                key = mix(key * U64(7) + x[:, :, j])
            rep = np.repeat(np.asarray(batch.column("rep")), x.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "registers").mapInArrow(tidy(run), "key long, rep long")


def estimated(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches (na, ra), (nb, rb) are estimated at ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_registers(batch.column(c), REGISTERS) for c in ("ra", "rb"))
            nx, ny = (np.asarray(batch.column(c), dtype=float) for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(x, y, nx, ny) >= least))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tidy(run), "a long, b long")


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=U64)


def linked(common: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (nx + ny - common)


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets (sa, sb) that are links on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = _set(a.as_py()), _set(b.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(linked(common, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the rows (doc_id, print) in wanted (doc_id, print, rep): the full sets, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                sets = shingles(raw, offsets, width)
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), text_print().alias("print"), clear_text().alias("text"))
    return texts.join(wanted, ["doc_id", "print"]).select("rep", "text").mapInArrow(tidy(run), "rep long, shingles binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; only the run at hand is kept."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        piece = piece if rest is None else pa.concat_tables([rest, piece])
        new = np.zeros(piece.num_rows, dtype=bool)
        for k in keys:
            x = piece[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for c in cuts:
            yield piece.slice(at, c - at).combine_chunks()
            at = c
        rest = piece.slice(at)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def block_rows(members: DataFrame) -> DataFrame:
    """Deal the members of each cell into pieces of work (cell, left, right).

    Members not linked with the cell's pivot (stray) are compared with all other members. Both
    sides are cut into blocks of about BLOCK_ROWS; side 0 rows of block ``left`` meet side 1 rows
    of block ``right``, so that no piece grows with its cell.
    """
    sizes = stored(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("stray").alias("n_stray")).where("n_stray > 0 AND n_all > 1"), "sizes")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), (blocks(n) - 1).cast("long"))
    rows = members.join(sizes, "cell").withColumn("h", F.xxhash64("rep"))
    left, right = F.pmod("h", blocks("n_stray")), F.pmod("h", blocks("n_all"))
    a = rows.where("stray").select("cell", left.alias("left"), F.explode(upto("n_all")).alias("right"), F.lit(0).alias("side"), "rep", "component")
    b = rows.select("cell", F.explode(upto("n_stray")).alias("left"), right.alias("right"), F.lit(1).alias("side"), "rep", "component")
    return a.unionAll(b)


_PIECE = ["cell", "left", "right"]
_PIECE_TYPE = "cell long, left long, right long, side int, rep long, component long"


def dealt(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *_PIECE).sortWithinPartitions(*_PIECE, "side", "rep")


def promising(rows: DataFrame, least: float) -> DataFrame:
    """Of each piece of work the rows with a partner in another component that may be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grouped(batches, _PIECE):
            side, comp = piece["side"].to_numpy(), piece["component"].to_numpy()
            n, regs = piece["n"].to_numpy().astype(float), _registers(piece["registers"], REGISTERS)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            keep = np.zeros(len(side), dtype=bool)
            for i in a:
                other = b[comp[b] != comp[i]]
                if len(other):
                    # the cheap bound first: shared registers and sizes
                    hit = other[((regs[other] == regs[i]).sum(axis=1) >= (least - 0.1) * REGISTERS) & (np.minimum(n[other], n[i]) >= least * np.maximum(n[other], n[i]))]
                    if len(hit):
                        hit = hit[estimate(np.broadcast_to(regs[i], (len(hit), REGISTERS)), regs[hit], np.full(len(hit), n[i]), n[hit]) >= least]
                        keep[hit] = True
                        keep[i] |= len(hit) > 0
            if keep.any():
                yield from piece.filter(pa.array(keep)).select([*_PIECE, "side", "rep", "component"]).to_batches()

    return dealt(rows).mapInArrow(tidy(run), _PIECE_TYPE)


def cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components within pieces of work, one for each row and component.

    Each row's full set is counted against the posting lists of all sets on the other side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in grouped(batches, _PIECE):
            side, comp, rep = (piece[c].to_numpy() for c in ("side", "component", "rep"))
            sets = [_set(x) for x in piece["shingles"].to_pylist()]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            size = np.array([len(sets[k]) for k in b], dtype=np.int64)
            value = np.concatenate([sets[k] for k in b])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], np.repeat(np.arange(len(b)), size)[order]
            found = []
            for i in a:
                lo, hi = np.searchsorted(value, sets[i], "left"), np.searchsorted(value, sets[i], "right")
                common = np.bincount(owner[ragged(lo, hi - lo)], minlength=len(b))
                ok = np.flatnonzero(linked(common, size, len(sets[i]), percent) & (comp[b] != comp[i]))
                _, one = np.unique(comp[b[ok]], return_index=True)
                found += [(rep[i], rep[b[k]]) for k in ok[one]]
            if found:
                x = np.array(found, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return dealt(rows).mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``width``-word shingles have 100 * intersection >= percent * union
    are linked; component_id is the smallest doc_id that links reach, and that document is kept.

    1. Rows with equal sets collapse to the smallest doc_id (by set sums; no pair is made).
    2. Sketches of these representatives (numbered, as doc_ids may repeat) are banded; a bucket's
       most connected member becomes the pivot of a cell, and all members are compared with it
       alone: estimate, then full sets.
    3. Members that aren't linked with their cell's pivot are compared with the cell's others in
       blocks of bounded size, sketches first; only rows, never pairs, leave that step, and of
       the links found on full sets one for each row and component.
    4. Components of all links.

    A text with fewer words is one shingle; one without words (null or empty too) has none and
    is linked with nothing. Rows of null doc_id are linked with nothing and kept. Rows that
    repeat a doc_id are texts of their own that share it: links of one are not links of the
    other, and component_id is the smallest doc_id that a row's own links reach. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows, names = labelled_rows(docs, width, percent)
    out = rows.select("doc_id", "n", "s1", "s2").join(names.select("n", "s1", "s2", "least"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def pivots_of(members: DataFrame) -> DataFrame:
    """(cell, rep): each bucket's most connected member as the pivot of the others.

    members has (key, rep). Buckets meet only partial aggregates and joins on them, so that a hot
    one is never gathered in a task. What grows with the buckets is merged, not broadcast.
    """
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = stored(members.join(sizes.hint("merge"), "key"), "buckets")
    reach = shared.groupBy("rep").agg(F.sum("size").alias("reach"))  # a rep is in no more buckets than there are bands
    ranked = stored(shared.select("key", "rep").join(reach.hint("merge"), "rep"), "ranked")
    top = stored(ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("rep")).alias("rep"))).alias("top")).select("key", (-F.col("top.rep")).alias("cell")), "tops")
    return stored(ranked.join(top.hint("merge"), "key").select("cell", "rep").where("cell <> rep").distinct(), "cells")


def labelled_rows(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with print, n, s1, s2; sets (n, s1, s2) with component and least, its smallest doc_id)."""
    least = percent / 100 - SLACK
    rows = stored(sketched(docs, width), "sketches")
    equal = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
    first = F.min(F.struct("doc_id", "print")).alias("first")
    # a set's number is stored with it, so that it stays
    reps = equal.agg(first, F.first("registers").alias("registers")).withColumn("rep", F.monotonically_increasing_id())
    reps = stored(reps.select("rep", "first.doc_id", "first.print", "n", "s1", "s2", "registers"), "representatives")
    cells = pivots_of(band_keys(reps))

    sketches = reps.select("rep", "n", "registers")
    pairs = (
        cells.join(sketches.select("rep", F.col("n").alias("nb"), F.col("registers").alias("rb")), "rep")
        .join(sketches.select(F.col("rep").alias("cell"), F.col("n").alias("na"), F.col("registers").alias("ra")), "cell")
        .select(F.col("cell").alias("a"), F.col("rep").alias("b"), "na", "nb", "ra", "rb")
    )
    star = stored(estimated(pairs, least), "star")
    in_cells = cells.select("rep").unionAll(cells.select("cell")).distinct()
    sets = stored(sets_of(docs, reps.join(in_cells, "rep").select("doc_id", "print", "rep"), width).dropDuplicates(["rep"]), "sets")
    side = lambda k, s: sets.select(F.col("rep").alias(k), F.col("shingles").alias(s))
    links = stored(verified(star.join(side("b", "sb"), "b").join(side("a", "sa"), "a"), percent), "links")
    first = components(links)

    named = lambda df, key: df.join(first.withColumnRenamed("id", key), key, "left")
    labelled = named(cells, "rep").withColumn("component", F.coalesce("component", "rep"))
    home = first.select(F.col("id").alias("cell"), F.col("component").alias("home"))
    # stored, so that sizes of cells are counted apart from the joins and a hot cell can be split
    labelled = stored(labelled.join(home, "cell", "left").withColumn("stray", F.col("component") != F.coalesce("home", "cell")), "labelled")
    work = block_rows(labelled).join(sketches, "rep")
    hopeful = stored(promising(work, least), "promising")
    more = cross_links(hopeful.join(sets, "rep"), percent)
    final = components(links.unionAll(more)).select(F.col("id").alias("rep"), "component")

    names = reps.select("n", "s1", "s2", "rep", "doc_id").join(final, "rep", "left").select("n", "s1", "s2", "doc_id", F.coalesce("component", "rep").alias("component"))
    names = stored(names, "components")
    # only sets with links need their component's smallest doc_id
    smallest = stored(names.groupBy("component").agg(F.min("doc_id").alias("least")), "smallest")
    return rows, names.join(smallest.hint("merge"), "component").select("n", "s1", "s2", "component", "least")


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest doc_id.

    Rows are told apart by doc_id and a hash of the text, so that a doc_id that repeats with
    another text drops nothing; of rows equal in both, and of rows of a group that share its
    smallest doc_id, one stays. Texts without words and rows of null doc_id all stay. An empty
    table stays empty; other columns may have any names.
    """
    rows, names = labelled_rows(docs, width, percent)
    members = stored(rows.where("doc_id IS NOT NULL").join(names.select("n", "s1", "s2", "component"), ["n", "s1", "s2"]).select("doc_id", "print", "component"), "members")
    # each group's first row: a component, a (doc_id, print), and how many rows have that
    counted = members.groupBy("component", "doc_id", "print").agg(F.count(F.lit(1)).alias("n"))
    first = stored(counted.groupBy("component").agg(F.min(F.struct("doc_id", "print", "n")).alias("first"), F.sum("n").alias("size")).where("size > 1").select("component", "first.*"), "firsts")
    grouped_rows = members.join(first.withColumnsRenamed({"doc_id": "first_id", "print": "first_print"}), "component")
    dropped = stored(grouped_rows.where("doc_id <> first_id OR print <> first_print").select("doc_id", "print").distinct(), "dropped")
    keyed = docs.withColumns({"__near_row_id": F.col("doc_id").cast("long"), "__near_row_print": text_print()})
    at = lambda df: [keyed["__near_row_id"] == df["doc_id"], keyed["__near_row_print"] == df["print"]]
    several = first.where("n > 1").select("doc_id", "print")
    kept = keyed.join(dropped, at(dropped), "left_anti")
    if several.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(several, [kept["__near_row_id"] == several["doc_id"], kept["__near_row_print"] == several["print"]], "left_semi").dropDuplicates(["__near_row_id", "__near_row_print"])
    rest = kept.join(several, [kept["__near_row_id"] == several["doc_id"], kept["__near_row_print"] == several["print"]], "left_anti")
    return rest.unionAll(once).select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
