"""SentencePiece encoding and decoding: exact N-best segmentation over the piece lattice."""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, table
from gridweft.llm.textkit import ragged, text_bytes, tidy
from gridweft.llm.tokens import text_groups, vocabulary_path

MARK = "▁".encode()
#: Stands for a mark that the text itself holds: bytes that no UTF-8 text has, one for each of its.
PLAIN_MARK = b"\xf8\xf9\xfa"
#: Bytes of distinct words that one lattice holds.
LATTICE_BYTES = 1 << 16
#: Bytes of text that are encoded together.
PIECES_BYTES = 1 << 19
N_BEST = 4
#: How far below the worst piece a byte scores.
BYTE_PENALTY = 10.0
CACHE_WORDS = 100_000


class Pieces:
    """The pieces of a model as a trie over bytes, with scores and the bytes they decode to."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [b""] * n
        self.byte_id = np.full(256, -1, dtype=np.int64)
        self.score = np.zeros(n)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.text[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = piece.encode()
                # a mark inside a word never comes from a blank
                if MARK not in raw.lstrip(MARK):
                    self.text[i], self.score[i] = raw.replace(MARK, b" "), model.get_score(i)
                    normal.append((raw, i))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no pieces for bytes")
        self.byte_id[list(PLAIN_MARK)] = self.byte_id[list(MARK)]
        self.score[self.byte_id] = min((self.score[i] for _, i in normal), default=0.0) - BYTE_PENALTY
        children: list[dict[int, int]] = [{}]
        found: dict[int, int] = {}
        for raw, i in normal:
            node = 0
            for b in raw:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            found[node] = i
        inner = [k for k, c in enumerate(children) if c]
        number = np.zeros(len(children), dtype=np.int32)
        number[inner] = np.arange(len(inner))
        leaves = [k for k, c in enumerate(children) if not c]
        number[leaves] = np.arange(len(inner), len(children))
        self.inner = len(inner)
        self.next = np.full((len(inner), 256), -1, dtype=np.int32)
        for k in inner:
            for b, c in children[k].items():
                self.next[number[k], b] = number[c]
        self.piece = np.full(len(children), -1, dtype=np.int32)
        for node, i in found.items():
            self.piece[number[node]] = i

    @cached_property
    def decoded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all pieces, start, length)."""
        length = np.array([len(x) for x in self.text], dtype=np.int64)
        return np.frombuffer(b"".join(self.text), dtype=np.uint8), np.cumsum(length) - length, length

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that was encoded: pieces in a row without the blank put before the first."""
        pool, start, length = self.decoded
        return pool[ragged(start[ids], length[ids])].tobytes()[1:]

    def edges(self, raw: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all edges of the lattices of words that stand one after another."""
        out = []
        lead = (raw & 0xC0) != 0x80
        char_end = np.append(np.flatnonzero(lead), len(raw))
        width = np.zeros(len(raw), dtype=np.int64)
        width[char_end[:-1]] = np.diff(char_end)
        at = np.flatnonzero(lead).astype(np.int32)
        state, step = np.zeros(len(at), dtype=np.int32), 0
        single = np.zeros(len(raw), dtype=bool)
        while len(at):
            state = self.next[state, raw[at + step]]
            ok = state >= 0
            at, state, step = at[ok], state[ok], step + 1
            piece = self.piece[state]
            hit = piece >= 0
            out.append((at[hit], at[hit] + step, piece[hit]))
            one = at[hit]
            single[one[width[one] == step]] = True
            go = (state < self.inner) & (at + step < len(raw))
            at, state = at[go], state[go]
            go = word_of[at + step] == word_of[at]
            at, state = at[go], state[go]
        # a character that is no piece falls back to its bytes
        bare = np.repeat(~single[at0] if len(at0 := char_end[:-1]) else np.zeros(0, bool), np.diff(char_end))
        b = np.flatnonzero(bare)
        out.append((b, b + 1, self.byte_id[raw[b]].astype(np.int32)))
        start, end, piece = (np.concatenate([x[k] for x in out], dtype=np.int32) for k in range(3))
        return start, end, piece


class Lattice:
    """Viterbi scores of a batch of words in both directions, vectorised across the words."""

    def __init__(self, pieces: Pieces, words: list[bytes] | tuple[np.ndarray, np.ndarray]):
        """words: a list of them, or the bytes of all in a row and the size of each."""
        self.pieces = pieces
        raw, size = words if isinstance(words, tuple) else (np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words], dtype=np.int64))
        # word w has len + 1 nodes from node[w]
        byte_at = np.cumsum(size) - size
        self.first = byte_at + np.arange(len(size))
        self.last = self.first + size
        word_of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        s, e, self.piece = pieces.edges(raw, word_of)
        self.word = word_of[s]
        offset = (s - byte_at[self.word]).astype(np.int32)
        order = np.lexsort((e, offset)).astype(np.int32)
        s, e, offset, self.piece, self.word = s[order], e[order], offset[order], self.piece[order], self.word[order]
        del order
        self.start, self.end = s + self.word, e + self.word
        self.weight = pieces.score[self.piece]
        n = len(raw) + len(size)
        self.forward = np.full(n, -np.inf)
        self.forward[self.first] = 0
        cuts = np.flatnonzero(np.diff(offset)) + 1 if len(offset) else np.zeros(0, int)
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(offset)), strict=True):
            np.maximum.at(self.forward, self.end[a:b], self.forward[self.start[a:b]] + self.weight[a:b])
        self.backward = np.full(n, -np.inf)
        self.backward[self.last] = 0
        for a, b in zip(np.append(0, cuts)[::-1], np.append(cuts, len(offset))[::-1], strict=True):
            np.maximum.at(self.backward, self.start[a:b], self.backward[self.end[a:b]] + self.weight[a:b])
        # of equally good predecessors the farthest, hence the longest piece
        tight = np.flatnonzero(self.forward[self.start] + self.weight == self.forward[self.end])
        tight = tight[np.lexsort((-self.start[tight], self.end[tight]))]
        self.by = np.full(n, -1, dtype=np.int64)
        self.by[self.end[tight]] = tight

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words in a row, count, score and distance to the second best of each)."""
        node, words, steps, kept = self.last.copy(), np.arange(len(self.last)), [], np.zeros(len(self.piece), dtype=bool)
        rows = []
        while len(words):
            go = node > self.first[words]
            words, node = words[go], node[go]
            edge = self.by[node]
            rows.append(words)
            steps.append(edge)
            kept[edge] = True
            node = self.start[edge]
        edge = np.concatenate([*steps, np.zeros(0, np.int64)])
        word = np.concatenate([*rows, np.zeros(0, np.int64)])
        edge = edge[np.lexsort((self.start[edge], word))]
        ids = self.piece[edge]
        count = np.bincount(word, minlength=len(self.last))
        score = self.forward[self.last]
        second = np.full(len(self.last), -np.inf)
        rest = np.flatnonzero(~kept)
        np.maximum.at(second, self.word[rest], self.forward[self.start[rest]] + self.weight[rest] + self.backward[self.end[rest]])
        return ids, count, score, score - second

    @cached_property
    def incoming(self) -> tuple[np.ndarray, np.ndarray]:
        """(edges in order of their ends, where those of each node begin)."""
        order = np.argsort(self.end, kind="stable")
        return order, np.searchsorted(self.end[order], np.arange(len(self.forward) + 1))

    def n_best(self, word: int, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word by A* from its end.

        Forward Viterbi scores are the exact cost of the way that is left, so that hypotheses leave
        the queue in the order of their full scores and the first n that reach the start are the n
        best; of equal scores the one nearest to the start goes first. Hypotheses stand for disjoint
        sets of segmentations, each with one of its score, so that a queue of as many as are still
        wanted is enough. Paths share their tails: memory grows with n times the length.
        """
        order, into = self.incoming
        first, last = int(self.first[word]), int(self.last[word])
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-float(self.forward[last]), last, 0, 0.0, None)]
        out: list[tuple[float, list[int]]] = []
        made = 0
        while queue and len(out) < n:
            total, node, _, tail, path = queue.pop(0)
            if node == first:
                ids = []
                while path is not None:
                    piece, path = path
                    ids.append(piece)
                out.append((-total, ids))
                continue
            edges = order[into[node] : into[node + 1]]
            start = self.start[edges]
            tails = self.weight[edges] + tail
            full = self.forward[start] + tails
            wanted = n - len(out)
            bound = -queue[wanted - 1][0] if len(queue) >= wanted else -np.inf
            for k in np.flatnonzero((full > bound) if bound > -np.inf else np.isfinite(full)).tolist():
                made += 1
                insort(queue, (-float(full[k]), int(start[k]), made, float(tails[k]), (int(self.piece[edges[k]]), path)))
            del queue[wanted:]
        return out


def n_best(pieces: Pieces, word: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a word with their scores, best first."""
    return Lattice(pieces, [word]).n_best(0, n)


def portions(place: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of words that one lattice holds; place: where each word begins, and the end."""
    at = 0
    while at < len(place) - 1:
        end = max(at + 1, int(np.searchsorted(place, place[at] + LATTICE_BYTES, side="right")) - 1)
        yield at, end
        at = end


def combined(base: float, lists: list[list[float]], n: int) -> list[float]:
    """The n best sums when each list, best first, may give any of its scores in place of its first."""
    best = [base]
    for scores in lists:
        best = sorted((b + s - scores[0] for b in best for s in scores), reverse=True)[:n]
    return best


class Encoder:
    def __init__(self, path: str, n: int = N_BEST):
        self.pieces, self.n = Pieces(path), n
        self.cache: dict[bytes, list[float]] = {}

    def learn(self, words: list[bytes]) -> None:
        """Keep the scores of the n best segmentations of each word, searched in lattices of many words."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        place = np.cumsum([0, *map(len, new)])
        for at, end in portions(place):
            lattice = Lattice(self.pieces, new[at:end])
            for k, w in enumerate(new[at:end]):
                self.cache[w] = [s for s, _ in lattice.n_best(k, self.n)]

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words with their leading marks, first word of each text).

        A word starts at each blank that follows something else, so that no piece reaches from
        one word into the next.
        """
        if pc.any(pc.match_substring(texts, "  ")).as_py():
            rows = []
            for x in texts.to_pylist():
                parts, run = [], ""
                for p in x.split(" "):
                    run += " "
                    if p:
                        parts.append(run + p)
                        run = ""
                rows.append([*parts, run] if run else parts)
            lists = pa.array(rows, pa.large_list(pa.large_string()))
            return lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        empty = pa.scalar("", pa.large_string())
        return pc.binary_join_element_wise(empty, flat, pa.scalar(" ", pa.large_string())), np.asarray(lists.offsets, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
        """(ids of all texts, offsets of the texts in them, scores of each text's n best)."""
        flat, text_first = self.words(texts.cast(pa.large_string()).fill_null(""))
        coded = flat.dictionary_encode()
        raw, place = text_bytes(escaped(coded.dictionary))
        word = lambda k: raw[place[k] : place[k + 1]].tobytes()
        ids, counts, scores, gaps = [], [], [], []
        for at, end in portions(place):
            i, c, s, g = Lattice(self.pieces, (raw[place[at] : place[end]], np.diff(place[at : end + 1]))).best()
            ids.append(i)
            counts.append(c)
            scores.append(s)
            gaps.append(g)
        pool = np.concatenate([*ids, np.zeros(0, np.int32)])
        count, score, gap = (np.concatenate([*x, np.zeros(0)]) for x in (counts, scores, gaps))
        count = count.astype(np.int64)
        starts = np.cumsum(count) - count
        index = np.asarray(coded.indices, dtype=np.int64)
        out = pool[ragged(starts[index], count[index])]
        upto = np.concatenate([[0], np.cumsum(count[index])])
        total = np.concatenate([[0.0], np.cumsum(score[index])])
        offsets = upto[text_first]
        base = total[text_first[1:]] - total[text_first[:-1]]
        # only the n - 1 words that lose least can be other than their best
        text_of = np.repeat(np.arange(len(texts)), np.diff(text_first))
        order = np.lexsort((gap[index], text_of))
        chosen = []
        for k in range(len(texts)):
            least = index[order[text_first[k] : min(text_first[k] + self.n - 1, text_first[k + 1])]]
            chosen.append([word(w) for w in least[np.isfinite(gap[least])]])
        self.learn([w for some in chosen for w in some])
        best = [combined(float(b), [self.cache[w] for w in some], self.n) for b, some in zip(base, chosen, strict=True)]
        return out, offsets, best


def escaped(words: pa.Array) -> pa.Array:
    """Words as the lattice sees them: blanks, which only lead, as marks; marks of the text as plain bytes."""
    raw = words.cast(pa.large_binary())
    if pc.any(pc.match_substring(raw, MARK)).as_py():
        raw = pc.replace_substring(raw, MARK, PLAIN_MARK)
    return pc.replace_substring(raw, b" ", MARK)


def encode_documents(docs: DataFrame, path: str | None = None, n: int = N_BEST, ids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, best_scores and round_trip of every whole text.

    best_scores are those of the ``n`` best segmentations (fewer, if there are fewer), best first,
    under the sum of the model's piece scores; ids are those of the best one. round_trip says
    whether decoding these ids gives the text byte by byte. A null text is an empty one: its only
    piece is the blank that precedes every text; a text without blanks is one word, whose lattice
    is held as a whole (about 400 bytes for each of its bytes). Rows that repeat a doc_id, or have
    none, are texts of their own; an empty table gives an empty result; columns that are not named
    here are ignored. With ``ids`` the ids are returned too, and the columns
    of docs in ``keep`` follow as they are.
    """
    path = path or vocabulary_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, n)
        for batch in batches:
            for group in text_groups(batch, PIECES_BYTES):
                texts = group.column("text").cast(pa.large_string())
                out, offsets, best = encoder.encode(texts)
                raw = memoryview(out.astype("<u4")).cast("B")
                bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in bounds]
                same = [encoder.pieces.decode(out[a:b]) == x.as_buffer().to_pybytes() for (a, b), x in zip(bounds, texts.cast(pa.large_binary()), strict=True)]
                columns = [group.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array(same)]
                names = ["doc_id", "n_pieces", "ids_crc32", "best_scores", "round_trip"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*columns, *(group.column(c) for c in keep)], names=[*names, *keep])

    schema = "doc_id long, n_pieces long, ids_crc32 long, best_scores array<double>, round_trip boolean" + ", ids array<int>" * ids + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("doc_id").cast("long"), clear_text().alias("text"), *keep).mapInArrow(tidy(run), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_documents(table(spark, sf_dir, "documents"))
    score = lambda k: F.try_element_at("best_scores", F.lit(k))
    return rows.select("doc_id", "n_pieces", "ids_crc32", score(1).alias("best_score"), score(2).alias("second_score"), score(N_BEST).alias("last_score"), "round_trip")
