import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import token_count as T

HARD = ["", " ", "Don't stop, we'll  go on", "ΟΔΟΣ ΣΣ", "İstanbul ǅ", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z ", "naïve café é 1234 ½ ٣", "日本語 🎉👩‍👩‍👧 \U0001f600", "!!!??? --- ...", "a" * 3000, "\n\n\t  \n", "<|endoftext|", "ab\u0000c"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parity_with_the_library(name):
    library, counter = Tokenizer.from_file(public_tokenizers.path(name)), T.load(public_tokenizers.path(name))
    rng = random.Random(5)
    alphabet = "abcdefghij THE er ing 'sSΣİ.,!?-\n\t0189éßñ ​中<|>"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(500)]
    for text in texts:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 30000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in T.count_tokens(df, path).collect())
    assert got == [(-1, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (3, 150000, 30000, True)]
    assert T.count_tokens(df.limit(0), path).count() == 0


def test_whole_documents_agree(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(path)
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(docs, path).collect()} == want
