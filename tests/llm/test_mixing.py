import hashlib
import re

import pytest

from quillgraph.llm import mixing as M


def brute(rows, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing; documents sorted by position, taken while they fit."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in sources}
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(sizes))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * total[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= over
    taken = [0] * len(rows)
    for s in sources:
        whole = min(most, int(target[s] // total[s])) if total[s] else 0
        rest, mine = target[s] - whole * total[s], {}
        for k, (i, t, source) in enumerate(rows):
            if source == s:
                at = int(hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16)
                mine.setdefault(at, []).append(k)
                taken[k] = whole * sizes[k]
        so_far = 0
        for k in (k for at in sorted(mine) for k in mine[at] if sizes[k]):  # of equal rows, one after the other
            if so_far >= rest or (so_far + sizes[k] > rest and so_far + sizes[k] - rest >= rest - so_far):
                break
            taken[k] += sizes[k]
            so_far += sizes[k]
    return [(i if i is not None else -1, n, total[s], round(target[s], 6), x) for (i, _, s), n, x in zip(rows, sizes, taken)]


CASES = {
    "usual": [(k, "w " * (k * 7 % 50), f"s{k % 5}") for k in range(400)],
    "hot": [(k, "w " * (k % 9 + 1), "big" if k % 3 else f"s{k % 4}") for k in range(300)],
    "odd": [(None, None, None), (None, "a b", None), (1, "a b c", "x"), (1, "a b c", "x"), (2, "", "empty"), (3, None, "empty"), (4, "w " * 30000, "long"), (5, "ü é", "É")],
    "equal rows": [(7, "w " * 36, "a")] * 100 + [(k, "w " * 5, f"s{k % 3}") for k in range(40)] + [(8, "w w w", "s2")] * 50 + [(None, None, "s1")] * 9,
    "only equal rows": [(7, "w " * 40, "a")] * 300 + [(1, "w", "b")] * 11,
    "one": [(1, "a b c d", "x")],
    "empty texts": [(1, "", "x"), (2, None, "y")],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(i, t, s, 1, "z") for i, t, s in rows], "doc_id long, text string, source string, size int, at string")
    found = M.mix(df).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source_size, round(r.target, 6), r.taken) for r in found)
    assert got == sorted(brute(rows))
    assert all(r.taken <= 3 * r.size for r in found)
    mixed = M.repeated(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in found)


def test_targets_are_met_within_a_document(spark):
    for name in ("usual", "hot", "equal rows", "only equal rows"):
        df = spark.createDataFrame(CASES[name], "doc_id long, text string, source string").repartition(7)
        for x in M.mix(df).groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect():
            assert abs(x["sum(taken)"] - x.target) <= x["max(size)"]


def test_budgets_are_nested(spark):
    df = spark.createDataFrame([(k, "w " * (k % 11), f"s{k % 3}") for k in range(300)], "doc_id long, text string, source string")
    small, large = ({r.doc_id: r.copies for r in M.mix(df, share=s).collect()} for s in (0.3, 0.6))
    assert all(small[k] <= large[k] for k in small) and small != large


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).count() == 0 and M.repeated(df).count() == 0
