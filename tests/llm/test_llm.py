"""Each operator against brute force, and over awkward rows: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import binascii
import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridweft.llm import exact, knn, langid, mixing, near, pieces, quality, repeats, tokens, toxicity
from gridweft.llm.common import table
from gridweft.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept boolean, rank int, n long"


def awkward_rows():
    long = "".join(f"word{k * 7919 % 1009} " for k in range(30_000))
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    texts = [None, "", " ", "\t\n ", "a", "a b", "A B", "one two three", "one  two\nthree", "x" * 400, long, long, "été ▁ naïve \U0001f600 <|endoftext|> 'tis", "a\n\n  b   c ", "?!.,"]
    for k in range(12):
        words = list(base)
        for j in rng.integers(0, 120, k):
            words[j] = f"e{k}{j}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 3
    return [(k, x, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, None, k, None, 1, None) for k, x in enumerate(texts)]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = awkward_rows()
    return spark.createDataFrame([*rows, rows[7], rows[16]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_exact(spark, awkward, nothing):
    norm = defaultdict(list)
    for k, x in texts_of(awkward):
        norm[re.sub(r"[\x20\x09-\x0D]+", " ", x)].append(k)
    want = sorted((k, min(g), len(g), i == 0, hashlib.sha256(x.encode()).hexdigest()) for x, g in norm.items() for i, k in enumerate(sorted(g)))
    assert sorted(map(tuple, exact.exact_dedup(awkward).collect())) == want
    assert exact.exact_dedup(nothing).count() == 0 and exact.without_copies(nothing).count() == 0
    kept = exact.without_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in norm.values())


#: Ids that repeat with equal and with other texts, and null ids.
SHARED_IDS = [(1, "A"), (5, "A"), (5, "B"), (2, "C"), (2, "C"), (None, "C"), (None, "D"), (None, "D"), (9, "E"), (9, "E"), (3, None), (4, ""), (None, None)]


def test_exact_with_shared_and_null_ids(spark):
    rows = SHARED_IDS
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups = defaultdict(list)
    for k, x in rows:
        groups[x or ""].append(k)
    want = []
    for x, g in groups.items():
        ids = sorted(g, key=lambda k: (k is None, k))
        want += [(k, ids[0], len(ids), i == 0, hashlib.sha256(x.encode()).hexdigest()) for i, k in enumerate(ids)]
    assert sorted(map(str, (tuple(r) for r in exact.exact_dedup(df).collect()))) == sorted(map(str, want))
    got = sorted((r.text or "", str(r.doc_id)) for r in exact.without_copies(df).collect())
    assert got == sorted((x, str(sorted(g, key=lambda k: (k is None, k))[0])) for x, g in groups.items())


def test_near_with_shared_and_null_ids(spark):
    """Texts that share an id are told apart; of each group one row stays."""
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a), (5, f"{a} zz"), (5, b), (7, f"{b} yy"), (2, "C"), (2, "C"), (None, a), (None, None), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect()), key=str)
    want = [(1, 36, 1, True), (5, 37, 1, False), (5, 36, 5, True), (7, 37, 5, False), (2, 1, 2, True), (2, 1, 2, True), (None, 36, None, True), (None, 0, None, True), (8, 0, 8, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)
    kept = sorted((str(r.doc_id), r.text or "") for r in near.without_near_copies(df).collect())
    assert kept == sorted([("1", a), ("5", b), ("2", "C"), ("None", a), ("None", ""), ("8", ""), ("8", "")])


def test_tokens(spark, awkward, nothing, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    path = str(tmp_path / "t")
    tokens.write_tokens(awkward, path)
    want, start = [], 0
    for k, x in sorted(texts_of(awkward)):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.token_digest(spark, path).collect())) == want
    one = tokens.read_tokens(spark, path, [6]).collect()
    assert [r.doc_id for r in one] == [6] and t.decode(list(one[0].tokens)[:-1]) == "A B"
    tokens.write_tokens(nothing, str(tmp_path / "e"))
    assert tokens.token_digest(spark, str(tmp_path / "e")).count() == 0


def near_truth(rows, width):
    sets = {}
    for k, x in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x[1]))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in product(sets, sets):
        if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i in sets:
        least[find(i)] = min(least[find(i)], rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)], rows[i][0] == least[find(i)]) for i in sets)


@pytest.mark.parametrize("width", [4, 5])
def test_near(spark, awkward, nothing, width):
    assert sorted(map(tuple, near.near_duplicates(awkward, width).collect())) == near_truth(texts_of(awkward), width)
    assert near.near_duplicates(nothing).count() == 0
    assert near.without_near_copies(awkward).columns == awkward.columns


def test_shingles_of_a_chunk_of_few_words():
    """A chunk that holds one short text: its set is the one it has among long texts."""
    for width, n in product((4, 5), (1, 2, 3, 4, 5, 6)):
        text, rest = " ".join("abcdef"[:n]).encode(), b"some other text of more than five words"
        alone = near.shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)
        both = near.shingles(np.frombuffer(text + rest, np.uint8), np.array([0, len(text), len(text + rest)]), width)
        assert len(alone) == 1 and len(alone[0]) == max(1, n - width + 1) and (alone[0] == both[0]).all(), (width, n)


def test_near_in_small_blocks(spark, monkeypatch):
    """A hot group whose members mostly aren't linked with its pivot, in blocks of three rows."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in rng.choice(150, k % 9, replace=False):
            words[j] = f"e{k}x{j}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near.near_duplicates(df, 4).collect())) == near_truth(rows, 4)


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2400]), np.sort(pool[600:])
    ka, kb, both = near.sketch([a, b, np.sort(pool)])
    assert (np.maximum(ka, kb) == both).all()
    j = near.estimate(ka[None], kb[None], np.array([2400.0]), np.array([2400.0]))[0]
    assert abs(j - 0.6) < 0.2
    assert not near.sketch([np.zeros(0, np.uint64)]).any()


def repeats_truth(rows, length):
    seen, out = set(), []
    for k, x in sorted(rows):
        b = x.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((k, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats(spark, nothing, monkeypatch):
    rng = np.random.default_rng(0)
    alphabet = "ab"
    passage = "".join(rng.choice(list("abcdefgh"), 180))
    rows = [(k, "".join(rng.choice(list(alphabet), n))) for k, n in enumerate([0, 3, 99, 100, 150, 900])]
    rows += [(10 + k, "".join(rng.choice(list("xyz"), 40)) + passage[k : 180 - k] + "é" * (k * 30)) for k in range(6)]
    rows += [(30, "q" * 700), (31, "qr" * 300), (32, None), (33, passage * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [(k, x or "") for k, x in rows]
    for length, chunk in ((100, 1 << 21), (100, 300), (12, 1 << 21)):
        monkeypatch.setattr(repeats, "REPEATS_CHUNK", chunk)
        assert sorted(map(tuple, repeats.remove_repeats(df, length).collect())) == repeats_truth(plain, length)
    assert repeats.remove_repeats(nothing).count() == 0


def test_repeats_of_shared_and_null_ids(spark):
    """The first of the rows that hold a passage keeps it, whatever ids they share."""
    rng = np.random.default_rng(8)
    a, b, c, d = ("".join(rng.choice(list("abcdefgh"), n)) for n in (300, 400, 700, 250))
    rows = [(7, a), (7, a), (7, b), (7, b + c), (8, "x" + c), (9, d), (2**63 - 1, d + "é"), (None, d), (None, c + a), (None, c + a), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, repeats.remove_repeats(df).collect()), key=str)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    want = repeats_truth([(at, rows[k][1] or "") for at, k in enumerate(order)], 100)
    assert got == sorted(((rows[order[k]][0], *rest) for k, *rest in want), key=str)
    assert [r.n_removed for r in repeats.remove_repeats(df.limit(2)).collect()] in ([0, 300], [300, 0])
    # more partitions: which of equal rows comes first is open, but one of them keeps its text
    spread = repeats.remove_repeats(spark.createDataFrame([(k % 3 or None, a) for k in range(12)], "doc_id long, text string").repartition(4))
    assert sorted(r.n_removed for r in spread.collect()) == [0] + [300] * 11


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for k in range(300)]
    rows += [(k, rows[5][1]) for k in range(300, 340)]  # ties
    rows += [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, rank int")
    from pyspark.sql import functions as F

    clean = {k: np.floor(256 * np.array(v, float)).astype(int) for k, v in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (k for k in clean if k % 50 == 0):
        best = sorted((-int(clean[q] @ x), k) for k, x in clean.items() if k != q)[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    for pivots in (1, 16):
        got = knn.top_k(df, F.col("vec_id") % 50 == 0, n_pivots=pivots)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert knn.top_k(df.limit(0), F.lit(True)).count() == 0
    # rows that share an id are candidates for each other, and each query among them has its own best
    twin = spark.createDataFrame([(0, rows[1][1]), (0, rows[2][1]), (3, rows[1][1]), (None, rows[1][1])], "vec_id long, embedding array<float>")
    a, b = clean[1], clean[2]
    own, across, other = int(a @ a), int(a @ b), int(b @ b)
    want = [*((0, r + 1, i, s) for r, (s, i) in enumerate(sorted([(own, 3), (across, 0)], key=lambda x: (-x[0], x[1])))), *((0, r + 1, i, s) for r, (s, i) in enumerate(sorted([(across, 0), (across, 3)], key=lambda x: (-x[0], x[1]))))]
    assert other and sorted(map(tuple, knn.top_k(twin, F.col("vec_id") == 0).collect())) == sorted(want)
    assert knn.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_bounds_spare_cells(spark, monkeypatch):
    """Where vectors lie in clusters, queries meet few cells; the result is that of all of them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 4, (20, 8))
    rows = [(k, [float(x) for x in centres[k % 20] + rng.normal(0, 0.02, 8)]) for k in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []
    needed = knn.needed_cells
    monkeypatch.setattr(knn, "needed_cells", lambda *x: met.append(needed(*x)) or met[-1])
    got = knn.top_k(df, F.col("vec_id") % 50 == 0, n_pivots=200)
    x = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    want = []
    for q in range(0, 1000, 50):
        best = sorted((-int(x[q] @ x[k]), k) for k in range(1000) if k != q)[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert met[0].count() < 20 * 200 / 4


def test_mixing(spark, awkward, nothing):
    weights = [5, 3, 1, 7]
    slots = mixing.pfair_period(weights)
    order = sorted((t, i) for i, s in enumerate(slots) for t in s)
    assert [t for t, _ in order] == list(range(16))
    seen = np.zeros(4)
    for t, i in order:
        seen[i] += 1
        assert (np.abs(seen - np.array(weights) * (t + 1) / 16) < 1).all()
    got = mixing.mix(awkward, {"s0": 3, "s1": 2}, block_docs=2).collect()
    assert len(got) == awkward.count() and len({(r.slot, r.position) for r in got}) == len(got)
    assert mixing.mix(nothing, {}).count() == 0
    whole = mixing.mixed(awkward, {"s0": 3})
    assert whole.columns == awkward.columns and sorted(map(str, whole.collect())) == sorted(map(str, awkward.collect()))
    with pytest.raises(ValueError):
        mixing.mix(awkward, {"s0": 0})


def all_segmentations(p, raw):
    byte_ids = set(p.byte_id.tolist())
    by_text = {x: i for i, x in enumerate(p.text) if x and i not in byte_ids}
    out = []

    def go(at, ids, score):
        if at == len(raw):
            out.append((score, ids))
        for end in range(at + 1, len(raw) + 1):
            i = by_text.get(raw[at:end].replace(pieces.MARK, b" "))
            if i is not None:
                go(end, [*ids, i], score + p.score[i])

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


def test_n_best_is_exact():
    p = pieces.Pieces(tokens.vocabulary_path("piece_bpe_32k.model"))
    for word in ("▁the", "▁token", "▁abcab", "▁", "▁▁in"):
        want = all_segmentations(p, word.encode())
        got = pieces.n_best(p, word.encode(), 6)
        best = [s for s, _ in want[:6]]
        assert [s for s, _ in got][: len(best)] == best
        ids, count, score, gap = pieces.Lattice(p, [word.encode()]).best()
        assert score[0] == best[0] and (len(best) < 2 or score[0] - gap[0] >= best[1])
    assert pieces.combined(10.0, [[5.0, 4.0], [3.0, 1.0]], 3) == [10.0, 9.0, 8.0]


def test_pieces(spark, awkward, nothing):
    rows = pieces.encode_documents(awkward, ids=True).collect()
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_pieces for r in rows)
    assert all(list(r.best_scores) == sorted(r.best_scores, reverse=True) for r in rows)
    assert pieces.encode_documents(nothing).count() == 0
    # n best of a whole text of several words
    e = pieces.Encoder(tokens.vocabulary_path("piece_bpe_32k.model"), 4)
    lists = [[s for s, _ in pieces.n_best(e.pieces, w, 4)] for w in ("▁in".encode(), "▁the".encode(), "▁end".encode())]
    want = sorted((sum(x) for x in product(*lists)), reverse=True)[:4]
    assert e.encode(pa.array(["in the end"]))[2][0] == want


def test_best_scores_of_short_texts_among_others():
    """The n best of each text by full enumeration of its own words, whatever texts follow."""
    texts = ["in", "in the end", "", None, "the", "a b", "end of the day", ""]
    e = pieces.Encoder(tokens.vocabulary_path("piece_bpe_32k.model"), 4)
    for order in (texts, texts[::-1]):
        for x, got in zip(order, e.encode(pa.array(order, pa.string()))[2], strict=True):
            lists = [[s for s, _ in all_segmentations(e.pieces, f"▁{w}".encode())] for w in (x or "").split(" ")]
            want = sorted((sum(s) for s in product(*lists)), reverse=True)[:4]
            assert got == pytest.approx(want), x


def test_automaton_equals_edit_distance():
    terms, stems = ["idiot", "clown", "scum"], ["vequ"]
    a = toxicity.Automaton(terms, stems)

    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (c != e))
        return d[-1]

    words = {"idiot", "idiots", "idot", "iidiot", "odiot", "idoit", "scum", "scu", "vequ", "vequxyz", "veq", "clwn", "clownss", "", "x"}
    words |= {w[:k] + c + w[k + j :] for w in terms for k in range(len(w)) for c in ("", "z", "o") for j in (0, 1, 2)}
    for w in filter(None, words):
        want = toxicity.EXACT if w in terms or w.startswith("vequ") else toxicity.FUZZY if any(len(t) >= 5 and distance(w, t) <= 1 for t in terms) else toxicity.MISS
        raw = np.frombuffer(w.encode(), np.uint8)
        assert a.match(raw, np.array([0]), np.array([len(raw)]))[0] == want, w


def test_misspellings_by_characters():
    """One wrong character of any kind, in any place; signs between words part them as before."""
    m = toxicity.Model(["idiot", "stupid", "réeux"], [])
    near = ["id1ot", "st*pid", "idiöt", "idiоt", "іdіоt", "reeux", "réeu", "id-iot", "1diot", "ídïót", "rééux", "stüpïdd"]
    far = ["id 1ot", "st**pid", "st pid", "id\niot", "xx1ot", "日本語"]
    same = ["idiot", "idiot-stupid", "l'idiot", "idiot…", "(stupid)", "réeux2"]
    texts = [x.encode() for x in near + far + same]
    x, text, _ = toxicity.context_features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), m.automaton(), m.harmless)
    kind = ["exact" if r[0] else "near" if r[2] else "none" for r in x]
    assert kind == ["near"] * len(near) + ["none"] * len(far) + ["exact"] * len(same)
    assert text.tolist() == list(range(len(near)))


def test_lexicon_is_not_cut(spark):
    """More than 200 terms, each in less than a hundredth of the toxic documents."""
    letters = "bcdfghjk"
    rows = [(1, f"common text {letters[k // 64 % 8]}{letters[k // 8 % 8]}{letters[k % 8]}rude") for k in range(256) for _ in range(30)]
    rows += [(0, "common text")] * 8000
    terms, _ = toxicity.mine(spark.createDataFrame(rows, "toxic int, text string"))
    assert len(terms) == 256


def test_near_words_are_muted_by_rate():
    near = [[5], [5], [7], [5, 9], [9], *([[]] * 3000), [9], [9]]
    toxic = np.array([0, 0, 0, 0, 1, *([0] * 3000), 1, 1], float)
    assert toxicity.harmless_words(near, toxic).tolist() == [5]


def test_quotation_scores_less_than_abuse():
    m = toxicity.Model(["idiot"], [])
    texts = [b"you are an idiot, really", 'the word “idiot” comes from greek'.encode(), b"you idiott here", b"nothing at all"]
    offsets = np.cumsum([0, *map(len, texts)])
    x, _, _ = toxicity.context_features(np.frombuffer(b"".join(texts), np.uint8), offsets, m.automaton(), m.harmless)
    s = x @ m.weights
    assert s[0] > 0 > s[1] > s[3] and s[2] > 0


def test_classifiers(spark, awkward, nothing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for model in (quality.learned(nothing, empty), quality.learned(awkward, empty), quality.learned(awkward, empty.union(spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, None)], empty.schema)))):
        got = quality.score(awkward, model).collect()
        assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(nothing, model).count() == 0
    assert quality.score(awkward, model, keep=True).columns == awkward.columns
    tox = toxicity.fit(awkward, empty)
    assert [r.predicted for r in toxicity.score(awkward, tox).collect()] == [0] * awkward.count()
    lang = langid.fit(awkward)
    got = {r.doc_id: r.lang_pred for r in langid.predict(awkward, lang).collect()}
    assert got[0] == got[1] == got[14] == "und" and got[4] == "en"
    assert {r.lang_pred for r in langid.predict(awkward, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, lang).count() == 0


def test_risk_depends_on_means_over_all_rows(spark):
    """Sums over many tasks are those of all rows, and the fit is the least of the risk itself."""
    rng = np.random.default_rng(6)
    rows = [(k, [float(np.float32(v)) for v in rng.random(quality.WIDTH) * (1 + (k % 3 == 0))]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, x array<float>").repartition(7)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 150, 3)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    x = np.array([v for _, v in rows])
    assert np.allclose(model.mean, quality._expand(x).mean(axis=0))
    z = model.design(x)
    p = z[:150:3]

    def risk(w, prior):
        loss = lambda m: ((1 - m) ** 2).mean() / 4
        return prior * loss(p @ w) + max(0.0, loss(-(z @ w)) - prior * loss(-(p @ w))) + quality.PENALTY * (w[1:] @ w[1:]) / 4

    for prior in (model.prior, 0.9):
        w = quality.fit_risk(p.mean(axis=0), p.T @ p / len(p), z.mean(axis=0), z.T @ z / len(z), prior)
        assert all(risk(w, prior) <= risk(w + rng.normal(0, s, len(w)), prior) + 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(50))
    assert quality.estimate_prior(np.array([0, 10.0]), np.array([60.0, 40.0])) == pytest.approx(0.4)


def test_long_text_in_pieces(spark):
    """The sums of a text read in pieces are those of the whole."""
    rng = np.random.default_rng(9)
    w = rng.normal(size=(3, len(langid.ORDERS) * langid.BUCKETS + 1)).astype(np.float32)
    w[:, -1] = 0
    raw = np.frombuffer(("héllo wörld 日本 😀 abc " * 300).encode(), np.uint8)
    ends = np.array([0, len(raw)])
    whole, letters = langid.text_sums(raw, ends, w)
    for limit in (50, 777, 1000):
        parts, n = langid.text_sums(raw, ends, w, limit)
        assert np.allclose(whole, parts) and n == letters


def test_long_word_in_little_memory():
    """A word of 100,000 letters: the best score is Viterbi's, and what the search holds stays small."""
    import tracemalloc

    p = pieces.Pieces(tokens.vocabulary_path("piece_bpe_32k.model"))
    word = "▁".encode() + bytes(np.random.default_rng(1).choice(list(b"abcdefghijklmnopqrstuvwxyz"), 100_000).astype(np.uint8))
    tracemalloc.start()
    found = pieces.n_best(p, word, 4)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert found[0][0] == pieces.Lattice(p, [word]).best()[2][0] and len(found) == 4


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in table(spark, d, "labels").collect()}
    docs = {r.doc_id: r.lang for r in table(spark, d, "documents").select("doc_id", "lang").collect()}
    q = [(r.predicted, labels[r.doc_id].quality) for r in QUERIES["op6_quality"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in q]) > 0.93
    x = [(r.predicted, labels[r.doc_id].toxic) for r in QUERIES["op8_toxicity"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in x]) > 0.93
    n = [(r.lang_pred, docs[r.doc_id]) for r in QUERIES["op9_language_id"](spark, d).collect() if r.held_out]
    assert np.mean([a == b for a, b in n]) > 0.97


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got = QUERIES[name](spark, DATA).toPandas()
    want = c.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[2]
    assert corpus_pipeline.run(spark, DATA).count() == sizes[-1]


def test_weights_place_the_pipelines_rows(spark, monkeypatch, tmp_path):
    """The last two stages, with files between them: rows by (slot, position) take turns by weight."""
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"text {k}", "en", f"src{k % 3}", 6) for k in range(240)], "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    orders = []
    for i, weights in enumerate(({"src0": 3, "src1": 1, "src2": 1}, {"src0": 1, "src1": 1, "src2": 4})):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        corpus_pipeline.mixture(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        rows = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / str(i))), DATA).collect()
        rows.sort(key=lambda r: (r.mix_slot, r.mix_position))
        turn = {t: s for s, slots in enumerate(mixing.pfair_period([weights[f"src{s}"] for s in range(3)])) for t in slots}
        assert [r.doc_id % 3 for r in rows] == [turn[r.mix_slot % sum(weights.values())] for r in rows]
        shuffled = [sorted((k for k in range(240) if k % 3 == s), key=lambda k: hashlib.md5(f"mix{k}".encode()).hexdigest()) for s in range(3)]
        assert all([r.doc_id for r in rows if r.doc_id % 3 == s] == shuffled[s] for s in range(3))
        orders.append([(r.mix_slot, r.mix_position, r.doc_id) for r in rows])
    assert orders[0] != orders[1] and len(orders[0]) == len({x[:2] for x in orders[0]}) == 240
