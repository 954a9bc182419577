import numpy as np
import pytest
import xxhash

from quillgraph.llm import simhash as S


def brute(texts, words=3, threshold=2):
    def fp(text):
        import re

        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        parts = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not parts:
            return 0
        shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [fp(t) for t in texts]


def joined(ids, prints, threshold=2):
    best = {k: {k} for k in range(len(ids))}
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= threshold and best[i] is not best[j]:
                merged = best[i] | best[j]
                for k in merged:
                    best[k] = merged
    return [min((ids[k] for k in best[i] if ids[k] is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(1)
    base = " ".join(f"w{rng.integers(900)}" for _ in range(3000))
    texts = [None, "", "  ", "One", "one two", "One Two three four", "É ünï x y z", base, base + " tail", base.replace("w1 ", "w2 ", 1), base, "y" * 50000]
    ids = [5, 3, 9, 1, 2, 4, 8, 20, 11, 12, 20, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string")
    got = sorted((r.fingerprint, r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(df).collect())
    prints = brute(texts)
    want = sorted((f"{f:016x}", i or -1, c or -1) for f, i, c in zip(prints, ids, joined(ids, prints)))
    assert got == want
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = sorted(r.doc_id or -1 for r in S.drop_duplicates(df).collect())
    assert kept == sorted({c or -1 for c in joined(ids, prints)})
    assert S.drop_duplicates(df).columns == df.columns


@pytest.mark.parametrize("crowd", [4, 1 << 16])
def test_every_link_is_found(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "HOME_ROWS", crowd)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    rows = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            rows.append(x)
    rows += [int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(a)][:600]
    prints = np.array(rows, np.uint64)
    ids = list(range(len(rows)))
    df = spark.createDataFrame(list(zip(ids, prints.view(np.int64).tolist())), "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in S.clusters(df).collect()}
    assert [got[i] for i in ids] == joined(ids, rows)


def test_anchors_cover():
    """Any fingerprint within the threshold of another reaches its home."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for k in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1 << int(b))
        rows, at, home = S.anchors(x, 2)
        homes = dict(zip(rows[home].tolist(), at[home].tolist()))
        assert len(homes) == len(x)
        rows, at, _ = S.anchors(y, 2)
        reached = {}
        for r, a in zip(rows.tolist(), at.tolist()):
            reached.setdefault(r, set()).add(a)
        assert all(homes[k] in reached[k] for k in range(len(x)))
