"""Token counts of byte-pair encodings, without ever forming a token.

A word's symbols are a doubly linked list; a heap holds the ranks of adjacent
pairs. The lowest-ranked pair is popped and merged, its neighbours' new pairs are
pushed, and stale entries are skipped. The number of tokens is the number of
symbols at the start minus the merges. The vocabulary file gives the merges,
the normaliser and the pre-tokeniser pattern; files of another make than the
two kinds described in ``load`` are refused.

Words repeat, so each worker keeps the counts of the short words that it has
met, up to ``CACHE_BYTES`` of them; beyond that it starts anew. Nothing is
shuffled.

Edge cases: a null text counts as an empty one, 0 tokens; a special token's
string inside a text is one token, as in the library's default; texts of any
length are counted whole; equal rows stay as they are; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import parts

#: Characters of the words whose counts a worker keeps, and the longest word kept.
CACHE_BYTES, LONGEST = 8 << 20, 256
#: Unicode white space; the pattern language's own \s differs between engines.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairMerger:
    """Merges by rank over one word's symbols; only their number is returned."""

    def __init__(self, merges: list, word_end: str):
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(merges)}
        self.word_end = word_end

    def count(self, symbols: list[str]) -> int:
        n, ranks = len(symbols), self.ranks
        text, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get((text[k], text[k + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if text[k] is None or j >= n or ranks.get((text[k], text[j])) != rank:
                continue  # one of the two has been merged since
            text[k], text[j] = text[k] + text[j], None
            after[k] = m = after[j]
            merges += 1
            if m < n:
                before[m] = k
                if (r := ranks.get((text[k], text[m]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (p := before[k]) >= 0 and (r := ranks.get((text[p], text[k]))) is not None:
                heapq.heappush(heap, (r, p))
        return n - merges


class _Known(dict):
    """Counts of words met before."""

    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger, self.letters, self.held = merger, _byte_letters(), 0

    def __missing__(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.merger.word_end
        n = self.merger.count(symbols)
        if len(word) <= LONGEST:
            self[word] = n
            self.held += len(word)
        return n

    def trim(self) -> None:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


class Counter:
    """Counts tokens of whole texts for one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain rank-merged byte-level vocabularies are counted")
        steps = lambda x, inner: [] if not x else x[inner] if x["type"] == "Sequence" else [x]
        self.normal = []
        for step in steps(spec.get("normalizer"), "normalizers"):
            if step["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
                self.normal.append(lambda t, form=step["type"]: unicodedata.normalize(form, t))
            elif step["type"] == "Lowercase":
                # letter by letter: Python alone writes a sigma at a word's end another way
                self.normal.append(lambda t: t.replace("Σ", "σ").lower())
            elif step["type"] == "Replace" and "Regex" in step["pattern"]:
                self.normal.append(lambda t, p=_pattern(step["pattern"]["Regex"]), by=step["content"]: p.sub(lambda _: by, t))
            else:
                raise ValueError(f"unknown normaliser {step}")
        self.words, self.prefix = None, False
        for step in steps(spec.get("pre_tokenizer"), "pretokenizers"):
            if step["type"] == "Split" and step["behavior"] == "Removed" and step["invert"]:
                self.words = _pattern(step["pattern"]["Regex"])
            elif step["type"] == "ByteLevel":
                self.prefix = step["add_prefix_space"]
                if step.get("use_regex", True):
                    self.words = _pattern(BYTE_LEVEL)
            else:
                raise ValueError(f"unknown pre-tokeniser {step}")
        special = [t["content"] for t in spec.get("added_tokens", []) if not t["normalized"]]
        if len(special) < len(spec.get("added_tokens", [])) or any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only special tokens that match as they stand are handled")
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.first = {t[0] for t in special}
        self.known = _Known(PairMerger(model["merges"], model.get("end_of_word_suffix") or ""))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found, pieces = 0, [text]
        if any(c in text for c in self.first):
            pieces = self.special.split(text)
            found = len(pieces) - 1
        for part in pieces:
            for step in self.normal:
                part = step(part)
            if self.prefix and part and part[0] != " ":
                part = " " + part
            known = self.known
            found += sum(map(known.__getitem__, self.words.findall(part) if self.words else [part] if part else []))
        self.known.trim()
        return found


#: Fixed value: the pattern of the byte-level pre-tokeniser's own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _pattern(source: str):
    """The pattern with Unicode white space spelled out, inside brackets or not."""
    out, inside, k = [], False, 0
    while k < len(source):
        two = source[k : k + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out.append(two[0])
            k -= 1
        k += 2
    return regex.compile("".join(out))


@cache
def load(path: str) -> Counter:
    """The counter for a byte-level vocabulary file of the ``tokenizers`` library.

    Two makes are handled: words ended by a suffix, and words led by their space.
    """
    with open(path, encoding="utf-8") as f:
        return Counter(json.load(f))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    ``vocabulary``: the file's path, the same on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in parts(batches, "text"):
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sized = base.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
