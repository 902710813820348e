"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; pieces, scores and flags rebuild the
normaliser, the white-space marker, the unigram lattice or the merge list, and
byte fallback. verify_parity compares with the sentencepiece package.

Encoding splits a normalised text where no piece can cross: before a marker
that follows another character (only if no piece has one inside) and around
line ends (only if no piece holds one). Distinct chunks are encoded in
multithreaded batches and remembered, so the whole text's ids are exact. Of
unigram lattices with equal scores the backend's is taken, which may be
another one than the package's.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pick, pieces, use_cache

MARK = "▁"
#: Chunks remembered by a worker before its cache is emptied; longer ones are not kept.
CACHE_CHUNKS, CACHE_CHARS = 250_000, 48
#: New chunks in one string.
JOINED = 32
#: Fixed values of the public model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_TEXT = " \u2047 ".encode()
PROBES = ["", " ", "Hello world", "  two  spaces ", "tab\tand\nline", "naïve über 漢字 \U0001f642", "a" * 70, "<s> </s> <unk> <0x0A>", "x▁y"]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; length-delimited and fixed values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                n, at = _varint(data, at)
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire}")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls([])
        for number, value in fields(data):
            if number == 1:
                got = dict(fields(value))
                score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
                m.pieces.append((got.get(1, b"").decode(), score, got.get(3, NORMAL)))
            elif number == 2:
                got = dict(fields(value))
                m.kind, m.byte_fallback, m.unk_id = got.get(3, UNIGRAM), bool(got.get(35, 0)), got.get(40, 0)
            elif number == 3:
                got = dict(fields(value))
                m.charsmap, m.dummy_prefix = got.get(2, b""), bool(got.get(3, 1))
                m.squeeze, m.escape = bool(got.get(4, 1)), bool(got.get(5, 1))
        if m.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {m.kind} is not supported")
        return m


class Codec:
    """Encoder and decoder of one model; build it once per worker."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Regex, Tokenizer, models, normalizers

        self.model = m = PieceModel.parse(data)
        text = [p for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)]
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
        mark = MARK if m.escape else " "
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(mark))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        self.plain = not m.charsmap and not m.squeeze
        unk = m.pieces[m.unk_id][0]
        if m.kind == UNIGRAM:
            body = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
        else:
            body = models.BPE(vocab={p: k for k, (p, _, _) in enumerate(m.pieces)}, merges=self._merges(), unk_token=unk, fuse_unk=True, byte_fallback=m.byte_fallback)
        self.backend = Tokenizer(body)
        self.bytes_of = [self._piece_bytes(p, kind, mark) for p, _, kind in m.pieces]
        across = any(re.search(f"[^{mark}]{mark}", p) for p in text) or not m.escape
        lines = any("\n" in p for p in text)
        if across:
            self.split = (lambda s: [s]) if lines else re.compile(r"\n|[^\n]+").findall
        else:
            self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        ends = [k for k, (p, _, kind) in enumerate(m.pieces) if kind == BYTE and p == "<0x0A>"]
        self.line_end = ends[0] if m.byte_fallback and not lines and not across and len(ends) == 1 else None
        #: chunk -> its ids as packed int32
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _piece_bytes(piece: str, kind: int, mark: str) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else UNKNOWN_TEXT if kind == UNKNOWN else piece.replace(mark, " ").encode()

    def _merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two, best piece first."""
        score = {p: (s, k) for k, (p, s, kind) in enumerate(self.model.pieces) if kind in (NORMAL, USER_DEFINED)}
        ways = [(-s, score[p[:i]][1], score[p[i:]][1], p[:i], p[i:]) for p, (s, _) in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
        return [(a, b) for *_, a, b in sorted(ways)]

    def normalize(self, text: str) -> str:
        if not self.plain:
            return self.normalizer.normalize_str(text) if text else ""
        if not text:
            return ""
        text = " " + text if self.model.dummy_prefix else text
        return text.replace(" ", MARK) if self.model.escape else text

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as int32, offsets of the texts)."""
        chunks = [self.split(self.normalize(t or "")) for t in texts]
        use_cache(self.cache, CACHE_CHUNKS)
        long: dict[str, bytes] = {}
        new = list(dict.fromkeys(c for c in chain.from_iterable(chunks) if c not in self.cache))
        for c, coded in zip(new, self._encode_new(new)):
            (self.cache if len(c) <= CACHE_CHARS else long)[c] = coded
        get = self.cache.__getitem__ if not long else lambda c: self.cache.get(c) or long[c]
        coded = [b"".join(map(get, own)) for own in chunks]
        return np.frombuffer(b"".join(coded), np.int32), np.cumsum([0, *(len(c) // 4 for c in coded)])

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of each chunk, by one multithreaded call. Where no piece holds a line
        end, its byte piece parts several chunks of one string, which costs less a chunk."""
        if self.line_end is None:
            coded = [e.ids for e in self.backend.encode_batch_fast(chunks, add_special_tokens=False)]
            return [struct.pack(f"={len(x)}i", *x) for x in coded]
        plain = [c for c in chunks if c != "\n"]
        joined = ["\n".join(plain[at : at + JOINED]) for at in range(0, len(plain), JOINED)]
        out = []
        for k, e in enumerate(self.backend.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            at = 0
            for end in [*np.flatnonzero(ids == self.line_end).tolist(), len(ids)]:
                out.append(ids[at:end].tobytes())
                at = end + 1
            assert len(out) == min(len(plain), (k + 1) * JOINED)
        if len(plain) < len(chunks):
            out.insert(chunks.index("\n"), struct.pack("=i", self.line_end))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each whole text; null and empty texts give no ids."""
        flat, ends = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id sequences, without the dummy prefix and without control pieces."""
        get, cut = self.bytes_of.__getitem__, self.model.dummy_prefix
        out = [b"".join(map(get, x)).decode("utf-8", "replace") for x in ids]
        return [t[1:] if cut and t.startswith(" ") else t for t in out]


def verify_parity(data: bytes, texts: list[str]) -> list[str]:
    """Those of the texts whose ids differ from the sentencepiece package's."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts, num_threads=1)
    return [t for t, a, b in zip(texts, Codec(data).encode(texts), theirs) if a != b]


_CODECS: dict[int, Codec] = {}


def encode_documents(docs: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """All columns of docs and those of this operator: token_ids array<int>, n_tokens int,
    round_trip boolean (decoding gives the normalised text back).

    Null and empty texts have no tokens and round-trip; whole texts are encoded,
    whatever their length; rows stay as they are, repeats included; an input
    column of one of these names is replaced; an empty table gives an empty
    result. The model file is read by the driver alone and broadcast (its size
    is that of a vocabulary); a model whose probes differ from the sentencepiece
    package's raises ValueError.
    """
    with open(model_path or default_model(), "rb") as f:
        data = f.read()
    if wrong := verify_parity(data, PROBES):
        raise ValueError(f"no parity on {wrong}")
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(data)

    @F.arrow_udf("struct<token_ids:array<int>,round_trip:boolean>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hash(sent.value)
        if key not in _CODECS:
            _CODECS[key] = Codec(sent.value)
        codec = _CODECS[key]
        for rows in pieces(texts, 1 << 20):  # a text has some chunks for each word
            flat, ends = codec.encode_flat(rows)
            back = codec.decode([flat[a:b].tolist() for a, b in zip(ends, ends[1:])])
            want = [t or "" for t in rows] if codec.plain else [codec.normalize(t or "").replace(MARK, " ")[codec.model.dummy_prefix :] for t in rows]
            same = [a == b or a == b.replace(MARK, " ") for a, b in zip(back, want)]
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(same, pa.bool_())], names=["token_ids", "round_trip"])

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    made = {"token_ids": F.col("__piece.token_ids"), "n_tokens": F.size("__piece.token_ids"), "round_trip": F.col("__piece.round_trip")}
    with_codes = plain.withColumn("__piece", encode(F.col(f"c{docs.columns.index(text)}")))
    keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n.lower() not in made]
    return with_codes.select(*keep, *(c.alias(n) for n, c in made.items()))


def encoded(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip of every row."""
    return encode_documents(pick(docs, "doc_id", "text"), model_path).drop("text")
