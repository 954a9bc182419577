import corpus_pipeline as P
import public_tokenizers
import sentencepiece
from test_line_dedup import brute as lines
from test_mixing import brute as mixed
from test_simhash import brute as prints
from test_simhash import joined

from quillgraph.llm import quality
from quillgraph.session import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # lines and texts that repeat, so that every stage has something to do
    extra = docs.limit(30).selectExpr("doc_id + 1000 as doc_id", "concat(text, '\\nA line that many share') as text", "lang", "source", "n_chars")
    copies = docs.limit(20).selectExpr("doc_id + 2000 as doc_id", "text", "lang", "source", "n_chars")
    docs = written(docs.unionByName(extra).unionByName(copies), "test")
    names, own = docs.columns, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "copies", "mix", "encode"]
    for name, stage in P.STAGES:
        before = docs.toPandas()
        docs = written(stage(spark, docs, FOLDER), "test")
        after = docs.toPandas()
        rows = [tuple(r) for r in after.itertuples(index=False)]
        if name != "encode":
            assert docs.columns == names
        if name == "quality":
            found = quality.classified(spark.createDataFrame(before), spark.read.parquet(f"{FOLDER}/labels.parquet")).toPandas()
            good = set(found[found.predicted == 1].doc_id)
            assert 0 < len(good) < len(before)
            assert sorted(rows) == sorted(tuple(r) for r in before[before.doc_id.isin(good)].itertuples(index=False))
        if name == "lines":
            want = [t for t, _, _ in lines(before.text.tolist(), 10)]
            assert dict(zip(after.doc_id, after.text)) == dict(zip(before.doc_id, want))
            assert (after.n_chars == after.text.str.len()).all() and len(after) == len(before)
            assert sum(after.n_chars) < sum(before.n_chars)
        if name == "copies":
            ids = before.doc_id.tolist()
            want = set(joined(ids, prints(before.text.tolist())))
            assert sorted(after.doc_id) == sorted(want) and len(want) < len(ids)
        if name == "mix":
            taken = {i: x // n if n else None for i, n, _, _, x in mixed(list(zip(before.doc_id, before.text, before.source)))}
            count = after.doc_id.value_counts()
            assert all(count.get(i, 0) == n for i, n in taken.items() if n is not None)
        if name == "encode":
            texts = dict(zip(before.doc_id, before.text))
            assert len(after) == len(before)
            assert all(list(r.ids) == own.encode(texts[r.doc_id]) and r.round_trip and r.parity for r in after.itertuples())


def test_run_is_the_stages_in_turn(spark):
    assert P.run(spark, FOLDER).count() > 50


def test_odd_rows_pass_every_stage(spark):
    """Null ids, texts, sources and languages, repeated rows, empty and long texts; then no rows at all."""
    long = "A fairly ordinary sentence of words. " * 8000
    rows = [(None, None, None, None, None), (None, "", None, "s", 0), (7, "same text", "en", "s", 9), (7, "same text", "en", "s", 9), (7, "other text", "en", None, 10), (8, long, "en", "t", len(long)), (9, long, None, "t", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in P.STAGES:
            now = written(stage(spark, now, FOLDER), "odd")
            if name != "encode":
                assert now.columns == docs.columns
        assert now.count() == 0 or not start.isEmpty()
    # each stage on its own input
    assert P.STAGES[1][1](spark, docs, FOLDER).count() == len(rows)
    kept = P.STAGES[2][1](spark, docs, FOLDER).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(-1, ""), (7, "same text"), (7, "other text"), (8, long)])
    assert {(r.text or "")[:9] for r in P.STAGES[3][1](spark, docs, FOLDER).collect()} <= {(r[1] or "")[:9] for r in rows}
    assert P.STAGES[4][1](spark, docs, FOLDER).count() == len(rows)


def test_columns_of_any_name_come_out_as_they_went_in(spark):
    """Names that the operators use inside, with values of their own."""
    extra = (
        "_row _text _fingerprint _shingled _gone _mix_copies _mix_copy _mix_source _measured _encoded n_lines n_dropped n_tokens ids row fingerprint "
        "at copies size rows take edge whole root least anchor salt bytes hashes gone score statistics c0 c1 c9 from part place nth k"
    ).split()
    texts = ["same words in two documents\nof one group"] * 2 + [f"document {k} has {k * 17} words of its own\nand a line" for k in range(12)]
    rows = [(k, t, "en", f"s{k % 2}", len(t), *(f"{k}-{c}" for c in extra)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in P.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "encode":
            assert out.count() == len(rows)
            continue
        assert out.columns == docs.columns
        found = out.collect()
        assert found or name == "quality"
        for r in found:
            assert tuple(r)[5:] == rows[r.doc_id][5:]
