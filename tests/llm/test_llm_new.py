"""Whitening, packing and periodic runs against plain versions, and their odd inputs."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import SF, sha

from loci.llm import packing, periodic, queries, whitening

SCHEMA = "doc_id long, text string, key string, start long, runs string, `_row` string, n long"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "k", 7, "r", "x", 9) for i, t in rows], SCHEMA)


# --- whitening -------------------------------------------------------------------------------------------------


def plain_grid(vector):
    return tuple(math.floor(64 * c) + 1_000_000 for c in vector)


def check_whitening(rows, vectors, most=16):
    """``rows`` are by_component rows; ``vectors`` the (id, vector) that should remain."""
    ints = [(i, plain_grid(v)) for i, v in vectors]
    fitted = sorted({x for _, x in ints})
    n, dim = len(fitted), len(fitted[0])
    sums = [sum(x[d] for x in fitted) for d in range(dim)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fitted])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == len(vectors) * min(most, dim)
    deviation = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in ints)
    white = defaultdict(dict)
    for r in rows:
        assert r.n == n
        white[r.component][r.vec_id] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9, abs=1e-15)
    assert Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == deviation
    for k, of in white.items():
        gaps = [abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1]
        if values[k - 1] < 1e-9 * values[0] or min(gaps, default=1) < 1e-6 * values[0]:
            continue
        want = {i: (np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ axes[:, k - 1]) / math.sqrt(values[k - 1]) for i, x in ints}
        sign = 1 if sum(of[i] * want[i] for i in of) > 0 else -1
        assert all(of[i] == pytest.approx(sign * want[i], abs=1e-8) for i in of)


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_whitening_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = queries.op11_whitening(spark, folder).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check_whitening(rows, vectors)
    assert {r.identity_error for r in rows}.pop() < 1e-9


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, n string, Whitened string, `_row` string"
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], schema)


def test_whitening_drops_unusable_vectors_and_counts_copies_once(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 3 + d) for d in range(5)]) for i in range(60)]
    good = [(i, np.array(v, dtype=np.float32).tolist()) for i, v in good]
    good += [(100, good[0][1]), (0, good[0][1]), (None, good[1][1])] + [(200 + i, good[2][1]) for i in range(50)]
    bad = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (303, [1.0, 1.0, float("inf"), 1.0, 1.0]), (304, []), (305, [1.0, 2.0])]
    out = whitening.whiten(vectors(spark, good + bad))
    assert out.columns == ["vec_id", "embedding", "_row", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(whitening.by_component(out).collect(), good)


def test_whitening_without_variance_and_without_rows(spark):
    rows = whitening.by_component(whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0])] * 3))).collect()
    assert len(rows) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, None, None)}
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(40)]  # one direction only
    rows = whitening.by_component(whitening.whiten(vectors(spark, flat))).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1}
    assert {r.explained for r in rows if r.component > 1} == {0.0} and rows[0].identity_error < 1e-9
    assert whitening.by_component(whitening.whiten(vectors(spark, [(1, None)]))).collect() == []


def test_whitening_of_far_entries(spark):
    rows = whitening.whiten(vectors(spark, [(i, [1e30 * (-1) ** i, float(i)]) for i in range(8)])).collect()
    assert len(rows) == 8 and {r.deviation for r in rows} == {None} and rows[0].identity_error < 1e-4
    model = whitening.Whitening(8, [0, 0], np.ones(2), np.eye(2), 2.0)
    x = np.array([[1 << 61, 3], [2, 1]])
    assert model.centred(x).tolist() == [[1 << 64, 24], [16, 8]] and model.deviations(model.centred(x)) == [None, 320]


@pytest.mark.parametrize("seed", range(4))
def test_eigenpairs_of_close_and_equal_values(seed):
    rng = np.random.default_rng(seed)
    for values in ([5, 5, 5, 3, 3, 1, 0, 0], [1] * 20, [1, 1 + 1e-15, 1 + 1e-12, 1 - 1e-9] + [0.5] * 16, np.exp(-np.arange(40.0)), [0, 0, 0], [7]):
        q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
        m = q @ np.diag(np.array(values, dtype=float)) @ q.T
        m = (m + m.T) / 2
        e, v = whitening.leading_eigenpairs(m, 16)
        want = np.sort(np.array(values, dtype=float))[::-1][:16]
        assert np.abs(e - want).max() < 1e-13 * 10 and np.abs(v @ v.T - np.eye(len(e))).max() < 1e-12
        assert np.abs(m @ v.T - v.T * e).max() < 1e-13 * 10
        for shift in (0.3, 0.7, 2.0):
            assert whitening.positive_count(m, shift) == (np.array(values) > shift).sum()


# --- packing ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def check_pieces(tokenizer, docs, pieces, size=4096):
    """``pieces`` with their bytes' crc must give each document once, in gapless sequences; returns (tokens, padding)."""
    want = Counter()
    ids_of = defaultdict(list)
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] += len(ids)
        ids_of[i].append(np.array(ids, dtype="<u4"))
    got, by_sequence = Counter(), defaultdict(list)
    for p in pieces:
        assert p.length > 0
        got[p.doc_id] += p.length
        fits = [x for x in ids_of[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
        assert fits and p.start + p.length <= p.doc_tokens
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert got == want
    padding = 0
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
        padding += 0 if end & (end - 1) == 0 else size - end
    return sum(want.values()), padding


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_packing_query(spark, tokenizer, sf):
    folder = f"/root/testdata/sf{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    tokens, padding = check_pieces(tokenizer, docs, queries.op12_packing(spark, folder).collect())
    assert padding < 0.002 * tokens


ODD = [(1, None), (None, ""), (None, "a text without an id."), (2, "same"), (2, "same"), (3, "word " * 30_000), (4, "x" * 9000), (5, " \t\n\x1c\x85 　"), (6, "É ́a <|endoftext|>b 123's. "), (7, "no. ends! here? " * 4000)]


def test_packing_odd_rows(spark, tokenizer):
    docs = odd(spark, ODD).coalesce(1)
    pieces = packing.pack(docs)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = pieces.collect()
    tokens, padding = check_pieces(tokenizer, ODD, rows)
    assert padding < 0.01 * tokens
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert order == [i for i, _ in ODD]  # order-preserving
    whole = packing.sequences(pieces, pad_id=49407).collect()
    assert {len(r.ids) for r in whole} <= {4096} | {1 << k for k in range(12)} and sum(r.n_pad for r in whole) == padding
    report = packing.padding(pieces).first()
    assert (report.n_tokens, report.n_padding, report.n_sequences) == (tokens, padding, len(whole))
    assert packing.pack(docs.limit(0)).collect() == [] and packing.padding(packing.pack(docs.limit(0))).first().n_tokens == 0


def test_packing_in_small_blocks_and_sizes(spark, tokenizer, monkeypatch):
    ends = packing.sentence_ends(open(packing.vocabulary_path(), encoding="utf-8").read())
    monkeypatch.setattr(packing, "BLOCK", 2000)
    rng = np.random.default_rng(5)
    for size in (256, 512):
        packer = packing.Packer(ends, size, 0)
        docs = [rng.integers(0, 49000, rng.integers(1, 3000)).astype("<u4") for _ in range(60)]
        pieces = [p for k, d in enumerate(docs) for p in packer.add(k, d)] + list(packer.finish())
        for k, d in enumerate(docs):
            mine = [p for p in pieces if p[0] == k]
            assert np.array_equal(np.concatenate([p[7] for p in mine]), d) and [p[1] for p in mine] == np.cumsum([0, *[p[2] for p in mine]])[:-1].tolist()
        assert max(sum(p[2] for p in pieces if p[5] == n) for n in {p[5] for p in pieces}) <= size


def least_cost(at, penalty, size):
    """The plan's cost by looking at every pair of cuts."""
    cost = [0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n > size:
                continue
            if j == len(at) - 1:
                step = packing.tail_cost(n, size)[0]
            else:
                power = n & (n - 1) == 0 and n >= packing.LEAST_POWER
                step = (0 if power else size - n) + packing.SEQUENCE_COST + penalty[j]
            cost[j] = min(cost[j], cost[i] + step)
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    doc_ends = np.cumsum(rng.integers(1, 700, 20))
    sentences = np.unique(rng.integers(1, doc_ends[-1] + 1, 60))
    at, penalty = packing.candidates(doc_ends, sentences)
    assert at[0] == 0 and at[-1] == doc_ends[-1] and np.diff(at).max() <= packing.STRIDE
    size = 1024
    cuts = packing.plan(at, penalty, size)
    known = dict(zip(at.tolist(), penalty.tolist()))
    windows = list(zip([0, *cuts], cuts))
    assert cuts[-1] == at[-1] and all(0 < b - a <= size for a, b in windows)
    tail = next(k for k, (a, b) in enumerate(windows) if all(x not in known or k + 1 + n == len(windows) for n, (_, x) in enumerate(windows[k:]))) if windows else 0
    cost = 0
    for a, b in windows[:tail]:
        n = b - a
        cost += (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else size - n) + packing.SEQUENCE_COST + known[b]
    least = least_cost(at.tolist(), penalty.tolist(), size)
    best = min(cost_to + packing.tail_cost(int(at[-1]) - a, size)[0] for a, cost_to in prefix_costs(windows, known, size) if at[-1] - a <= size)
    assert best == least


def prefix_costs(windows, known, size):
    """(start of a possible last window, cost of the windows before it) along a plan."""
    cost = 0
    for a, b in windows:
        yield a, cost
        if b not in known:
            return
        n = b - a
        cost += (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else size - n) + packing.SEQUENCE_COST + known[b]


# --- periodic runs ---------------------------------------------------------------------------------------------


def plain_runs(words):
    """Every run by its definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text, looped=True):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if looped and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query(spark, rows):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect())
    assert got == sorted(plain_digest(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 5


def test_periodic_runs_of_random_batches():
    rng = random.Random(8)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            words = []
            for _ in range(rng.randint(0, 5)):
                if rng.random() < 0.5:
                    words += [rng.choice("abc") for _ in range(rng.randint(0, 12))]
                else:
                    words += [rng.choice("ab") for _ in range(rng.randint(1, 9))] * rng.randint(1, 9)
            texts.append(words)
        codes = np.array([n * 3 + "abc".index(w) for n, t in enumerate(texts) for w in t], dtype=np.int64)
        assert periodic.batch_runs(codes, [len(t) for t in texts]) == [plain_runs(t) for t in texts]


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 100):
        values = rng.permutation(n)
        tree = periodic.WaveletTree(values, n)
        low = rng.integers(0, n, 200).astype(np.int32)
        high = np.minimum(n, low + rng.integers(1, n + 1, 200)).astype(np.int32)
        than = rng.integers(0, n, 200).astype(np.int32)
        k = (rng.integers(0, n, 200) % (high - low)).astype(np.int32)
        assert tree.smaller(low, high, than).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, than)]
        assert tree.kth(low, high, k).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(low, high, k)]


def test_periodic_odd_rows(spark):
    long = " ".join(["a", "b", "c"] * 40_000)
    texts = [(1, None), (None, None), (None, "q " * 9), (2, ""), (3, " \t\n"), (4, "x\x1cy　z " * 7), (4, "x\x1cy　z " * 7), (5, "ab " * 5), (9, "one two\n" * 3), (8, "one two\n" * 4)]
    out = periodic.periodic_runs(odd(spark, [*texts, (6, long)]))
    assert out.columns == ["doc_id", "text", "key", "start", "_row", "n", "runs", "collapsed"]
    got = Counter(tuple(r) for r in periodic.digests(out.where("doc_id IS NULL OR doc_id <> 6")).collect())
    assert got == Counter(plain_digest(i, t, looped=False) for i, t in texts)
    one = out.where("doc_id = 6").first()
    assert [tuple(r) for r in one.runs] == [(0, 120_000, 3)] and one.collapsed == "a b c"
    looped = periodic.digests(periodic.periodic_runs(periodic.with_loops(odd(spark, texts))))
    assert Counter(tuple(r) for r in looped.collect()) == Counter(plain_digest(i, t) for i, t in texts)
    assert periodic.periodic_runs(odd(spark, texts).limit(0)).count() == 0


def test_many_distinct_words_do_not_matter(monkeypatch):
    monkeypatch.setattr(periodic, "REMEMBERED", 3)
    monkeypatch.setattr(periodic, "BATCH", 20)
    texts = [" ".join(f"w{i % (2 + n)}" for i in range(30)) for n in range(9)] + [" ".join(map(str, range(50)))]
    got = list(periodic.scan_texts(iter(texts), periodic.Words()))
    assert [r for r, _ in got] == [plain_runs(t.split()) for t in texts]


def test_words_have_the_ids_of_the_whole_text(tokenizer, monkeypatch):
    rng = random.Random(4)
    letters = "abcXYZÀÉßöøįİıŉσΣς中é́ 　\x1c\x85 \n\t.,'’!?<|>-_0129²½ｆﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["'s it's 'S It'S (that's) o'clock' ''ve", "<|endoftext|> a<|startoftext|>b <|endoftext|", "ÀÉ, (öø) İstanbul. straße! ﬁn _a_ a_b", "!!' 'll' \"Don't\" x²"]
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    words = packing.Words(open(packing.vocabulary_path(), encoding="utf-8").read())
    for i in range(0, len(texts), 40):
        for text, ids in zip(texts[i : i + 40], words.encode(texts[i : i + 40])):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
