"""Toxicity: Levenshtein automata over a lexicon trie, with scores for the context of a match."""

from __future__ import annotations

import unicodedata
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import bounded_sample, fold, held_out, stored, table
from gridweft.llm.textkit import Rolling, chunks, tidy

THRESHOLD = 0.5
#: Shortest word, in characters, of which a misspelling counts.
FUZZY_LENGTH = 5
#: Log-likelihood ratio that a term must reach: chance exceeds it once in 2e7 terms.
SIGNIFICANT = 30.0
#: Share of clean texts, and how many at least, that make a word near a term harmless.
HARMLESS_RATE, HARMLESS_TEXTS = 1 / 2000, 2
#: Bytes before and after a match that decide between quotation and abuse.
WINDOW = 60
MISS, EXACT, FUZZY = 0, 1, 2

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсхуіјѕкмтнвѵԁһӏαοιορυνκτ", "aeopcxyijskmthbvdhlaoiopuvkt", strict=True))
#: Characters above are no letters.
KNOWN_CODES = 0x20000


@cache
def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a letter, is a blank, letter without accent or of the Latin script) of each code point."""
    letter, blank, fold = np.zeros(KNOWN_CODES, bool), np.zeros(KNOWN_CODES, bool), np.arange(KNOWN_CODES, dtype=np.int64)
    for k in range(KNOWN_CODES):
        c = chr(k)
        kind = unicodedata.category(c)[0]
        letter[k], blank[k] = kind in "LM", kind in "ZC"
        if k >= 128 and kind == "L":
            base = [x for x in unicodedata.normalize("NFKD", LOOKALIKES.get(c, c)) if not unicodedata.combining(x)]
            if len(base) == 1:
                fold[k] = ord(LOOKALIKES.get(base[0], base[0]).lower())
    return letter, blank, fold


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of UTF-8 bytes, where each starts and, last, the end)."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    x = np.append(raw, np.zeros(3, np.uint8)).astype(np.int64)
    lead = x[at]
    codes = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        rows = np.flatnonzero(lead >= low)
        code = lead[rows] & mask
        for k in range(1, size):
            code = (code << 6) | (x[at[rows] + k] & 0x3F)
        codes[rows] = code
    return np.minimum(codes, KNOWN_CODES - 1), np.append(at, len(raw))


#: Quotation marks as they start in UTF-8: ASCII, and the leads of the curly and angular ones.
_QUOTE = np.zeros(256, dtype=bool)
_QUOTE[ord('"')] = True
#: Words of direct address (fixed values).
ADDRESS = ("you", "your", "du", "dich", "tu", "te", "vous", "usted")


class Automaton:
    """A deterministic automaton of all words within one edit of a lexicon.

    The lexicon is a trie; a state of the search is a trie node with the edits spent so far
    (the Levenshtein automaton's state), and sets of such states are made deterministic once.
    Stems accept whatever follows and take no edits; a word shorter than ``FUZZY_LENGTH`` takes
    none either. A word of any length costs a table look-up for each character up to the point at
    which no term can be reached any more.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), edits: int = 1):
        terms, stems = list(terms), list(stems)
        self.lexicon, self._folded = (terms, stems), None
        children: list[dict[int, int]] = [{}]
        ends: dict[int, str] = {}

        def insert(term: str, kind: str) -> None:
            node = 0
            for b in map(ord, term):
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            ends[node] = "stem" if kind == "stem" or ends.get(node) == "stem" else kind

        for x in terms:
            if x:
                insert(x, "long" if len(x) >= FUZZY_LENGTH else "short")
        for x in stems:
            if x:
                insert(x, "stem")
        used = sorted({b for c in children for b in c})
        self.symbol = np.zeros(max(used, default=0) + 2, dtype=np.int64)  # 0: a character of no term
        self.symbol[used] = np.arange(1, len(used) + 1)

        def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            queue = deque(states)
            while queue:
                node, spent = queue.popleft()
                if spent < edits:
                    for child in children[node].values():  # a character of the term is left out
                        if (child, spent + 1) not in states:
                            states.add((child, spent + 1))
                            queue.append((child, spent + 1))
            return frozenset(s for s in states if not any((s[0], e) in states for e in range(s[1])))

        def kind_of(states: frozenset[tuple[int, int]]) -> int:
            if any(e == 0 and n in ends for n, e in states):
                return EXACT
            return FUZZY if any(ends.get(n) == "long" for n, _ in states) else MISS

        start = closed({(0, 0)})
        number = {frozenset(): 0, start: 1}
        rows, kinds, queue = [[0] * (len(used) + 1), []], [MISS, kind_of(start)], deque([start])
        absorbing = None
        while queue:
            states = queue.popleft()
            row = []
            for b in [None, *used]:
                nxt: set[tuple[int, int]] = set()
                for node, spent in states:
                    if b in children[node]:
                        nxt.add((children[node][b], spent))
                    if spent < edits:
                        nxt.add((node, spent + 1))
                        nxt.update((c, spent + 1) for c in children[node].values())
                if any(e == 0 and ends.get(n) == "stem" for n, e in nxt):
                    if absorbing is None:
                        absorbing = len(rows)
                        rows.append([absorbing] * (len(used) + 1))
                        kinds.append(EXACT)
                    row.append(absorbing)
                    continue
                key = closed(nxt)
                if key not in number:
                    number[key] = len(rows)
                    rows.append([])
                    kinds.append(kind_of(key))
                    queue.append(key)
                row.append(number[key])
            rows[number[states]] = row
        self.table = np.array(rows, dtype=np.int32)
        self.kinds = np.array(kinds, dtype=np.int8)
        self.absorbing = -1 if absorbing is None else absorbing

    @property
    def folded(self) -> Automaton:
        """The automaton of the terms without accents; this one if they have none."""
        if self._folded is None:
            terms, stems = (list(map(folded, x)) for x in self.lexicon)
            self._folded = self if (terms, stems) == self.lexicon else Automaton(terms, stems)
        return self._folded

    def match(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """MISS, EXACT or FUZZY for each word of a chunk."""
        state = np.ones(len(starts), dtype=np.int32)
        active, j, last = np.arange(len(starts)), 0, len(self.symbol) - 1
        while len(active):
            s = self.table[state[active], self.symbol[np.minimum(raw[starts[active] + j], last)]]
            state[active] = s
            j += 1
            active = active[(s != 0) & (s != self.absorbing) & (starts[active] + j < ends[active])]
        return self.kinds[state]


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    #: Hashes of words near a term that clean texts use.
    harmless: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: PRIOR_WEIGHTS.copy())

    def automaton(self) -> Automaton:
        out = Automaton(self.terms, self.stems)
        out.folded  # made here once, not in each task
        return out


#: Weights before any label is seen: matches outside and inside quotation, misspelt ones outside
#: and inside, matches near direct address, intercept.
PRIOR_WEIGHTS = np.array([4.0, 1.0, 4.0, 0.5, 1.0, -2.5])


def folded(term: str) -> str:
    return "".join(chr(code_tables()[2][min(ord(c), KNOWN_CODES - 1)]) for c in term)


def found(codes: np.ndarray, first: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, EXACT or FUZZY) of all matches in texts that start at the code points ``first``.

    Words are runs of letters. Two that one digit or sign parts are tried as one word too: the
    edit may be in that character. A word that is a term but for accents or look-alike letters, or
    within an edit of one without them, is a misspelling.
    """
    letter, blank, fold = code_tables()
    inside = np.concatenate([[False], letter[codes], [False]])
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = first[(first > 0) & (first < len(codes))]
    opens[cut] |= inside[cut + 1]
    closes[cut - 1] |= inside[cut]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    plain = fold[codes]

    def kinds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        kind = automaton.match(codes, a, b)
        rest = np.flatnonzero(kind == MISS)
        kind[rest[automaton.folded.match(plain, a[rest], b[rest]) != MISS]] = FUZZY
        return kind

    kind = kinds(starts, ends)
    text = np.searchsorted(first, starts, side="right")
    pair = np.flatnonzero((starts[1:] == ends[:-1] + 1) & (text[1:] == text[:-1]) & (kind[1:] == MISS) & (kind[:-1] == MISS))
    pair = pair[~blank[codes[ends[pair]]]]
    joined = kinds(starts[pair], ends[pair + 1])
    a, b, kind = (np.concatenate(x) for x in ((starts, starts[pair]), (ends, ends[pair + 1]), (kind, joined)))
    hits = np.flatnonzero(kind)
    hits = hits[np.argsort(a[hits], kind="stable")]
    return a[hits], b[hits], kind[hits]


def context_features(raw: np.ndarray, offsets: np.ndarray, automaton: Automaton, harmless: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each text, text of each misspelt match, its word's hash)."""
    n_texts = len(offsets) - 1
    out = np.zeros((n_texts, len(PRIOR_WEIGHTS)))
    out[:, -1] = 1
    codes, byte = code_points(raw)
    starts, ends, kind = found(codes, np.searchsorted(byte, offsets[:-1]), automaton)
    if not len(kind):
        return out, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = byte[starts], byte[ends]
    text = np.searchsorted(offsets, a, side="right") - 1
    low, high = offsets[text], offsets[text + 1]
    fuzzy = kind == FUZZY
    hashes = np.zeros(len(kind), np.uint64)
    if fuzzy.any():
        hashes[fuzzy] = np.array([_word_hash(raw[x:y].tobytes()) for x, y in zip(a[fuzzy], b[fuzzy], strict=True)], np.uint64)
        keep = ~fuzzy | ~np.isin(hashes, harmless)
        a, b, text, low, high, fuzzy, hashes = (x[keep] for x in (a, b, text, low, high, fuzzy, hashes))
    quote = _QUOTE[raw]
    # U+2018 to U+201F, and U+00AB, U+00BB
    quote[:-2] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] >= 0x98) & (raw[2:] <= 0x9F)
    quote[:-1] |= (raw[:-1] == 0xC2) & ((raw[1:] == 0xAB) | (raw[1:] == 0xBB))
    quotes = np.concatenate([[0], np.cumsum(quote)])
    before = quotes[a] - quotes[np.maximum(a - WINDOW, low)]
    after = quotes[np.minimum(b + WINDOW, high)] - quotes[b]
    quoted = (before > 0) & (after > 0)
    addressed = np.array([_addressed(raw[max(x - WINDOW, lo) : min(y + WINDOW, hi)].tobytes()) for x, y, lo, hi in zip(a, b, low, high, strict=True)], dtype=bool)
    for k, mask in enumerate((~fuzzy & ~quoted, ~fuzzy & quoted, fuzzy & ~quoted, fuzzy & quoted, addressed & ~quoted)):
        out[:, k] = np.log1p(np.bincount(text[mask], minlength=n_texts))
    return out, text[fuzzy], hashes[fuzzy]


def _word_hash(word: bytes) -> np.uint64:
    raw = np.frombuffer(word, np.uint8)
    return Rolling(raw).slices(np.array([0]), np.array([len(raw)]))[0]


_ADDRESS = {x.encode() for x in ADDRESS}


def _addressed(window: bytes) -> bool:
    return not _ADDRESS.isdisjoint(window.split())


def mine(docs: DataFrame, support: int = 5, ratio: float = 20.0, share: float = 0.02, stem_lengths: tuple[int, int] = (4, 8)) -> tuple[list[str], list[str]]:
    """(words, stems) that toxic documents use far more often than clean ones do.

    docs has text and toxic. A term must be in ``support`` toxic documents, be ``ratio`` times as
    frequent there, and so by more than chance (``SIGNIFICANT``); clean documents with it may be a
    ``share`` of the toxic ones. Of stems the shortest that qualifies stands for all that continue
    it. Counts are aggregated by Spark; as docs is a bounded sample, so are the terms.
    """
    low, high = stem_lengths
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))
    stems = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.least(F.lit(low), F.length(w)), F.least(F.lit(high), F.length(w))), lambda i: F.substr(w, F.lit(1), i)))))
    rows = docs.select("toxic", tokens.alias("words")).withColumn("stems", stems)
    pairs = rows.select("toxic", F.explode(F.concat(F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(True).alias("whole"))), F.transform("stems", lambda w: F.struct(w.alias("term"), F.lit(False).alias("whole"))))).alias("t"))
    sums = pairs.groupBy("t.term", "t.whole").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("clean"))
    n = {r["toxic"]: r["n"] for r in docs.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lift = ((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    both, n_bad, n_clean = F.col("bad") + F.col("clean"), n.get(1, 0), n.get(0, 0)
    part = lambda k, m: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) * (n_bad + n_clean) / (both * max(m, 1)))).otherwise(0.0)
    surprise = 2 * (part("bad", n_bad) + part("clean", n_clean))
    terms = sums.where((F.col("bad") >= support) & (F.col("clean") <= share * F.col("bad")) & (lift >= ratio) & (F.length("term") >= low)).where(surprise >= SIGNIFICANT).orderBy(F.desc("bad"), "term").collect()
    qualified = {r["term"] for r in terms if not r["whole"]}
    shortest = [x for x in sorted(qualified, key=lambda x: (len(x), x)) if not any(x[:k] in qualified for k in range(low, len(x)))]
    rank = {r["term"]: r["bad"] for r in terms}
    return [r["term"] for r in terms if r["whole"]], sorted(shortest, key=lambda x: (-rank[x], x))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 4000, clean: int = 8000) -> Model:
    """Learn terms, harmless near words and context weights from a bounded sample of labelled rows.

    The sample holds about ``toxic`` and ``clean`` rows, chosen by a hash of doc_id. Weights are a
    logistic fit that is drawn towards ``PRIOR_WEIGHTS`` where the labels say nothing.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = bounded_sample(labels.where("toxic = 1"), toxic, n.get(1, 0)).unionAll(bounded_sample(labels.where("toxic = 0"), clean, n.get(0, 0)))
    sample = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # toxic + clean rows of two numbers
    sample = stored(sample, "labelled")  # read several times; the corpus is scanned once for it
    model = Model(*mine(sample))
    if not model.terms and not model.stems:
        return model
    x, y, near = _sampled(sample, model)
    model.harmless = harmless_words(near, y)
    x, y, _ = _sampled(sample, model)
    w = PRIOR_WEIGHTS.copy()
    if len(y):
        pull = np.full(len(w), 2.0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + pull * (w - PRIOR_WEIGHTS)
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
    model.weights = w if np.isfinite(w).all() else PRIOR_WEIGHTS.copy()
    return model


def harmless_words(near: list[list[int]], toxic: np.ndarray) -> np.ndarray:
    """Hashes of words near a term that clean texts use at a rate, and toxic ones not far more often."""
    clean, bad = (Counter(h for row, y in zip(near, toxic.tolist(), strict=True) if bool(y) == k for h in row) for k in (False, True))
    n_bad = toxic.sum()
    n_clean = len(toxic) - n_bad
    least = max(HARMLESS_TEXTS, HARMLESS_RATE * n_clean)
    return np.array([h for h, c in clean.items() if c >= least and bad[h] * n_clean <= 20 * c * n_bad], np.int64).astype(np.uint64)


def _sampled(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """(features, labels, hashes of misspelt words of each text) of the bounded sample."""
    width = len(PRIOR_WEIGHTS)
    automaton = model.automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text")):
                x, text, near = context_features(raw, offsets, automaton, model.harmless)
                lists = [[] for _ in range(b - a)]
                for i, h in zip(text.tolist(), near.astype(np.int64).tolist(), strict=True):
                    if h not in lists[i]:
                        lists[i].append(h)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int64()))], names=["toxic", "x", "near"])

    rows = sample.select(F.lower("text").alias("text"), F.col("toxic").cast("int")).mapInArrow(tidy(run), "toxic int, x array<double>, near array<long>").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, width)
    return x, np.array(rows["toxic"].to_pylist(), dtype=float), rows["near"].to_pylist()


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text.

    A null text counts as empty and scores like any text without a term. Rows that repeat a doc_id
    or have none are scored each by its own text; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    weights, harmless, automaton = model.weights, model.harmless, model.automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [context_features(raw, offsets, automaton, harmless)[0] @ weights for _, _, raw, offsets in chunks(batch.column("text"))]
            s = 1 / (1 + np.exp(-np.clip(np.concatenate([*parts, np.zeros(0)]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0), labels.where(fold(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0), "score", "predicted")
