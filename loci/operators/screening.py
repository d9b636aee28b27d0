"""Which texts can have a similar one at all: k-mers are counted as packed numbers, not carried as rows.

K-mers of whole tables take many times the room of the texts. Here a task
sorts the digests of a block of texts and sends what lies between neighbours,
with the place of the text in its block: three or four bytes a k-mer. What
comes back is a count a text. The answer errs on one side only: a text that
has a partner is never left out, others rarely stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_LETTERS = 3 << 18  # letters and texts of one block
BLOCK_TEXTS = 1 << 16
SLICE = 1 << 22  # k-mers counted by one task
RANGE = 1 << 24  # digests are cut by their upper 24 bits


def can_match(texts: DataFrame, k: int, min_share: float, within: Sequence[str] = ()) -> DataFrame:
    """Numbers of the texts that may share ``min_share`` of their k-mers with another one.

    ``texts`` has ``no``, ``residues`` and the columns of ``within``, and gives
    the same rows whenever it is read. A pair above the threshold has that share
    of the k-mers of either side in common. Digests below a fixed bound are
    looked at, and a text's k-mers above it taken as shared: a part of
    1 - share / 2 of them is enough to tell, and no text can be lost.
    """
    letters = texts.agg(F.coalesce(F.sum(F.length("residues")), F.lit(0))).first()[0]
    part = 1 - min_share / 2
    limit = max(1, math.ceil(part * RANGE))
    slices = max(1, math.ceil(letters * part / SLICE))
    shift = 64 - min(56, max(31, int(letters).bit_length() + 5))
    salt = F.xxhash64(*within) if within else F.lit(0).cast("bigint")
    packed = texts.select("no", salt.alias("salt"), "residues").mapInArrow(
        _packer(k, limit, slices, shift), "slice int, block long, codes binary, texts binary"
    )
    counted = packed.groupBy("slice").applyInPandas(_counter(), "block long, places binary, counts binary, texts binary")
    return counted.groupBy("block").applyInPandas(_decider(min_share), "no long")


def _packer(k: int, limit: int, slices: int, shift: int):
    """Blocks of texts as one row for each slice of the digests that they touch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bounds = np.array([-(-s * limit // slices) for s in range(slices + 1)], dtype=np.uint64) << np.uint64(40)
        made = 0

        def block(nos: list, texts: list, salts: list):
            nonlocal made
            of = (TaskContext.get().partitionId() << 32) | made
            made += 1
            x, text = _digests(texts, salts, k)
            n = np.bincount(text, minlength=len(texts))
            kept = int(np.searchsorted(x, bounds[-1]))
            x, text = x[:kept], text[:kept]
            seen = np.bincount(text, minlength=len(texts))
            about = np.concatenate([np.array(nos, dtype="<i8"), n.astype("<i8"), seen.astype("<i8")]).tobytes()
            cuts = np.searchsorted(x, bounds)
            home = of % slices
            out = []
            for s in range(slices):
                a, b = cuts[s], cuts[s + 1]
                if a == b and s != home:
                    continue
                at = x[a:b] >> np.uint64(shift)
                steps = np.diff(at, prepend=bounds[s] >> np.uint64(shift))
                out.append((s, of, _planes(steps) + _planes(text[a:b]), about if s == home else None))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["slice", "block", "codes", "texts"]
            )

        nos, texts, salts, letters = [], [], [], 0
        for batch in batches:
            for no, salt, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                t = text.as_py() or ""
                if len(t) < k:
                    continue
                if texts and (letters + len(t) > BLOCK_LETTERS or len(texts) >= BLOCK_TEXTS):
                    yield block(nos, texts, salts)
                    nos, texts, salts, letters = [], [], [], 0
                nos.append(no.as_py())
                texts.append(t)
                salts.append(salt.as_py())
                letters += len(t)
        if texts:
            yield block(nos, texts, salts)

    return run


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digests(texts: list[str], salts: list[int], k: int):
    """Distinct pairs of the digest of a k-mer and the place of its text, in the order of the digests."""
    import numpy as np

    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) for p in points])
    line = np.concatenate(points).astype(np.uint64)
    n = max(len(line) - k + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ line[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    whole = np.arange(n) + k <= np.cumsum(sizes)[text]  # not across two texts
    text = text[whole]
    x = _mixed(h[whole] ^ _mixed(np.array(salts, dtype=np.int64).view(np.uint64))[text])
    order = np.argsort(x, kind="stable")
    x, text = x[order], text[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    return x[first], text[first]


def shared_kmers(pairs: DataFrame) -> DataFrame:
    """Pairs of texts (a, b, two texts, k) with their numbers of k-mers and of those in both (a, b, shared, n_a, n_b)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            last, of_last = None, None
            for left, right, k in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                right, k = right.as_py(), k.as_py()
                if right != last:  # pairs come in the order of their second text
                    last, of_last = right, _digests([right], [0], k)[0]
                x = _digests([left.as_py()], [0], k)[0]
                at = np.minimum(np.searchsorted(of_last, x), max(len(of_last) - 1, 0))
                out.append((int((of_last[at] == x).sum()) if len(of_last) else 0, len(x), len(of_last)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r[i] for r in out], pa.int64()) for i in range(3)]], names=["a", "b", "shared", "n_a", "n_b"]
            )

    return pairs.mapInArrow(run, "a long, b long, shared long, n_a long, n_b long")


def _planes(values) -> bytes:
    """Numbers below 2^32 byte by byte, lowest first, without the bytes that are zero in all: what shuffles compress well."""
    import numpy as np

    split = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T)
    used = max([i + 1 for i in range(4) if split[i].any()], default=0)
    return bytes([used]) + len(values).to_bytes(4, "little") + split[:used].tobytes()


def _numbers(data: bytes, at: int = 0):
    """Numbers that ``_planes`` wrote at a place, and the place behind them."""
    import numpy as np

    used, n = data[at], int.from_bytes(data[at + 1 : at + 5], "little")
    out = np.zeros((n, 4), dtype="u1")
    out[:, :used] = np.frombuffer(data, "u1", used * n, at + 5).reshape(used, n).T
    return out.view("<u4").ravel(), at + 5 + used * n


def _counter():
    """For each block of a slice: its texts with k-mers that come again in the slice, and how many."""

    def run(rows):
        import numpy as np
        import pandas as pd

        values, places = [], []
        for codes in rows["codes"]:
            steps, behind = _numbers(codes)
            values.append(np.cumsum(steps, dtype=np.uint64))
            places.append(_numbers(codes, behind)[0])
        lengths = [len(v) for v in values]
        line = np.concatenate(values)
        order = np.argsort(line, kind="stable")
        same = line[order][1:] == line[order][:-1]
        again = np.zeros(len(line), dtype=bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        out = [np.unique(p[a], return_counts=True) for p, a in zip(places, np.split(again, np.cumsum(lengths)[:-1]), strict=True)]
        return pd.DataFrame({"block": rows["block"], "places": [_planes(p) for p, _ in out], "counts": [_planes(c) for _, c in out], "texts": rows["texts"]})

    return run


def _decider(min_share: float):
    """Numbers of the texts of a block whose shared k-mers may reach the threshold."""

    def run(rows):
        import numpy as np
        import pandas as pd

        about = np.frombuffer(next(t for t in rows["texts"] if t is not None), "<i8").reshape(3, -1)
        no, n, seen = about
        shared = np.zeros(len(no), dtype=np.int64)
        for places, counts in zip(rows["places"], rows["counts"], strict=True):
            shared[_numbers(places)[0]] += _numbers(counts)[0]
        return pd.DataFrame({"no": no[shared + (n - seen) >= n * min_share - 1e-6]})

    return run
