"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file's protobuf is parsed here, and its parts rebuilt as a tokeniser:
the normaliser (its compiled character map, extra white space, the dummy
prefix), the metaspace marker, the unigram scores or the merges that BPE scores
imply, and byte fallback. Encoding runs multithreaded in batches of distinct
chunks: where no piece has the marker after another character, no token spans
such a border, so a text may be cut in front of every run of markers, and a
chunk that repeats is encoded once per worker. Models without that property are
encoded text by text. Every chunk is verified against the SentencePiece library
itself; ``parity`` says, for each text, whether all its chunks agree, and ``round_trip`` whether its ids
decode to it again.

Edge cases: a null text has null ids, 0 tokens and decodes to null; an empty one
has no ids; unknown characters become byte pieces (or the unknown piece, which
doesn't decode to the same text); repeated rows stay; an empty table gives an
empty result; texts of any length are encoded whole; other columns pass through,
and those of the names added here are replaced.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from quillgraph.llm.common import parts, place, positional, release

MARK = "▁"
#: Characters of chunks that a worker remembers, beyond which it starts anew; a single text may exceed it while it is encoded.
CACHE_BYTES = 4 << 20
#: The piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file says; field numbers are fixed values of its format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0" * 4))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                model.kind = trainer.get(3, UNIGRAM)
                model.suffix, model.byte_fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
            elif number == 3:
                normal = dict(_fields(value))
                model.charsmap = normal.get(2, b"")
                model.dummy_prefix, model.remove_extra, model.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        return model

    def ids(self, kind: int) -> list[int]:
        return [k for k, (_, _, t) in enumerate(self.pieces) if t == kind]

    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two others, by score, then by position in the vocabulary."""
        place = {p: k for k, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        ways = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
                ways += [(-score, place[piece], place[a], place[b], a, b) for a, b in cuts if a in place and b in place]
        return [(a, b) for *_, a, b in sorted(ways)]


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.model = m = Model.parse(data)
        if m.kind not in (UNIGRAM, BPE) or not m.escape or m.suffix:
            raise ValueError("only unigram and BPE models with a leading marker are rebuilt")
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        unknown = m.ids(UNKNOWN)[0]
        if m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, m.byte_fallback)
        else:
            core = models.BPE({p: k for k, (p, _, _) in enumerate(m.pieces)}, m.merges(), unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        self.tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, t in m.pieces if t == USER])
        strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        self.chunked = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in m.pieces if t in (NORMAL, USER))
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: With the dummy prefix every chunk starts with the marker, which is left out of its name.
        self.lead = MARK if m.dummy_prefix and self.chunked else ""
        self.plain = self.lead and not m.charsmap and not m.remove_extra
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.differ: set[str] = set()
        self.spelled = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in m.pieces]

    def chunks(self, text: str) -> list[str]:
        """The text cut in front of every run of markers, each without the leading marker ``lead``."""
        if not text:
            return []
        if self.plain:  # nothing to normalise: words between single spaces are the chunks
            words = text.split(" ")
            if "" not in words and MARK not in text:
                return words
        normal = self.normalizer.normalize_str(text)
        found = self.cut.findall(normal) if self.chunked else [normal] if normal else []
        return [c[len(self.lead) :] for c in found]

    def learn(self, chunks: set[str]) -> None:
        """Encode what is new, on all threads, and compare it with the library of the model."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.differ.clear()
            self.held = 0
        new = [c for c in chunks if c not in self.known]
        for k in range(0, len(new), 1 << 13):
            names = new[k : k + (1 << 13)]
            part = [self.lead + c for c in names]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            theirs = self._reference(part)
            self.known.update((c, struct.pack(f"<{len(a)}i", *a)) for c, a in zip(names, ours))
            self.differ.update(c for c, a, b in zip(names, ours, theirs) if a != b)
            self.held += sum(map(len, names)) + 8 * len(names)
            del ours, theirs
        if len(new) > 1 << 12:
            release()  # what the encoding threads have left

    def _reference(self, chunks: list[str]) -> list[list[int]]:
        """The model's own library on chunks; its dummy prefix stands for one leading marker."""
        prefix = " " if self.model.dummy_prefix else ""
        found = self.own.encode([c.replace(MARK, " ").removeprefix(prefix) for c in chunks], num_threads=1)
        if prefix and MARK in chunks:  # of a space at a text's end: by itself it can't be told from an empty text
            word, more = self.own.encode(["a", "a "])
            found = [(more[len(word) :] if more[: len(word)] == word else None) if c == MARK else ids for c, ids in zip(chunks, found)]
        return found

    def encode(self, texts: list[str | None]) -> tuple[list[bytes | None], list[bool]]:
        """Ids of every text as packed 32-bit numbers, and whether they have been found to agree."""
        cut = [None if t is None else self.chunks(t) for t in texts]
        self.learn(set().union(*(c for c in cut if c)))
        known, differ = self.known.__getitem__, self.differ
        return [None if c is None else b"".join(map(known, c)) for c in cut], [not differ or not c or differ.isdisjoint(c) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of the pieces put together; bytes that are no UTF-8 are left to the library."""
        spelled = b"".join([self.spelled[k] for k in ids.tolist()])
        try:
            return spelled[self.model.dummy_prefix and spelled[:1] == b" " :].decode()
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@cache
def load(path: str, threads: int = 2) -> Codec:
    """``threads``: of one worker's encoding, set before the library starts its own."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    return Codec(path)


def encode(docs: DataFrame, model: str, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ids (array<int>), n_tokens, parity and round_trip.

    ``model``: the file's path on every machine. ``round_trip``: whether the ids
    decode to the text itself, found in the same pass.
    """
    added, inside = ("ids", "n_tokens", "parity", "round_trip"), positional(docs)
    names = [c for c in (columns if columns is not None else docs.columns) if c.lower() not in added]
    keep = [place(docs, c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for part in parts(batches, "given"):
            texts = part.column("given").to_pylist()
            packed, parity = codec.encode(texts)
            same = [p is None or codec.decode(np.frombuffer(p, "<i4")) == t for p, t in zip(packed, texts)]
            lengths = np.array([len(p or b"") // 4 for p in packed], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            nulls = pa.array(np.array([p is None for p in packed], bool))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(p or b"" for p in packed), "<i4")), mask=nulls)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, pa.array(lengths), pa.array(parity, pa.bool_()), pa.array(same, pa.bool_())], [*keep, *added])

    base = inside.select(*keep, F.col(place(docs, text)).cast("string").alias("given"))
    schema = T.StructType([*base.schema.fields[:-1], *T._parse_datatype_string("ids array<int>, n_tokens long, parity boolean, round_trip boolean").fields])
    return base.mapInArrow(run, schema).toDF(*names, *added)


def decode(docs: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text that its ids stand for; null ids give null."""
    inside, names = positional(docs), [c for c in docs.columns if c.lower() != name.lower()]
    keep = [place(docs, c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            column = batch.column("given")
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [codec.decode(values[a:b]) if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "made"])

    base = inside.select(*keep, F.col(place(docs, ids)).cast("array<int>").alias("given"))
    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("made", T.StringType())])).toDF(*names, name)
