"""Encoding and decoding with a byte-pair vocabulary of the SentencePiece format, by vectorised merge rounds.

Texts are cut into chunks where no piece of the vocabulary can reach across, and distinct chunks are encoded together: their characters
lie in one flat numpy array of symbols with the number of their segment. In each round every segment merges its pair of the best rank,
from the left, all segments at once, and the arrays are compacted; segments without a pair leave. A longer piece may outrank a shorter
one in such vocabularies: where it does, a segment's round ends early, which keeps the result exact. Long segments are merged in chunks
whose cuts are then mended, so rounds stay few at any length (`merges`). Characters outside the vocabulary become byte pieces.

Only models that change nothing but spaces before cutting (identity normalisation, dummy prefix) and have neither user-defined
nor unused pieces are taken; others are refused when loaded.

Defined results: null text counts as empty and has no ids. Repeated rows are treated alike. Extra columns pass through `encoded`. An
empty table gives an empty result. Whole texts are encoded; memory of a task grows with its longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import table
from usagemill.llm.merges import Merger

SPACE = "▁"
#: Chunks that a task remembers, and their greatest length.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 40


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary, read through the library, with own encoding and decoding."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        names = [library.id_to_piece(i) for i in range(size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        if any(library.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        for probe in ("", " ", "  a  b ", "ﬁÅ \t\n x", "é①​"):
            if library.decode(library.encode(probe)) != probe or (probe and not library.encode_as_pieces(probe)[0].startswith(SPACE)):
                raise ValueError("models that change more than spaces are not supported")
        # symbols: the pieces, then characters that occur in pieces only
        self.symbol = {p: i for i, p in enumerate(names) if not special[i]}
        for c in sorted({c for p in self.symbol for c in p} - self.symbol.keys()):
            self.symbol[c] = len(names) + len(self.symbol)
        self.width = max(self.symbol.values()) + 1
        order = {s: r for r, s in enumerate(sorted({-library.get_score(i) for i in range(size)}))}
        rank = {i: order[-library.get_score(i)] for i in range(size)}
        pairs, touching = {}, set()
        for p, i in self.symbol.items():
            if i < size:
                touching.update(p[k : k + 2] for k in range(len(p) - 1))
                for k in range(1, len(p)):
                    if (a := self.symbol.get(p[:k])) is not None and (b := self.symbol.get(p[k:])) is not None:
                        pairs[a, b] = (rank[i], i)
        self.merger = Merger(pairs, self.width)
        self.touching = np.array(sorted(self.symbol[x[0]] * self.width + self.symbol[x[1]] for x in touching), np.int64)
        self.unknown, self.size = library.unk_id(), size
        self.byte = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.falls_back = all(library.is_byte(i) for i in self.byte)
        self.bytes = [b"" if library.is_control(i) else b" \xe2\x81\x87 " if library.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if library.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.control = {i for i in range(size) if library.is_control(i)}
        self.is_byte = np.array([library.is_byte(i) for i in range(size)])
        inner = "".join(re.escape(c) for c in sorted({c for x in touching for c in x} - {SPACE}))
        across = any(x[0] != SPACE and x[1] == SPACE for x in touching)
        self.chunks = re.compile("(?s:.+)" if across else f"{SPACE}+[{inner}]*|[{inner}]+|[^{inner}{SPACE}]")
        self.known: dict[str, tuple[bytes, str]] = {}

    # ---- encoding

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each chunk, as bytes and in decimal."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        distinct, inverse = np.unique(code, return_inverse=True)
        symbol = np.array([self.symbol.get(chr(c), -1) for c in distinct.tolist()], np.int64)[inverse]
        start = np.zeros(len(code), bool)
        ends = np.cumsum([len(c) for c in chunks])
        start[np.append(0, ends[:-1])] = True
        pair = np.where((symbol[:-1] >= 0) & (symbol[1:] >= 0), symbol[:-1] * self.width + symbol[1:], -1)
        near = self.touching[np.minimum(np.searchsorted(self.touching, pair), len(self.touching) - 1)] == pair
        start[1:] |= ~near
        merged, places = self.merger.merge(symbol, np.cumsum(start) - 1)
        odd = np.flatnonzero((merged < 0) | (merged >= self.size))
        if len(odd):  # characters without a piece of their own
            fallback = [self._bytes_of(int(code[p])) for p in places[odd].tolist()]
            times = np.ones(len(merged), int)
            times[odd] = [len(x) for x in fallback]
            out = np.repeat(merged, times)
            at = np.repeat(np.cumsum(times)[odd] - times[odd], times[odd])
            out[at + np.concatenate([np.arange(len(x)) for x in fallback])] = np.concatenate(fallback)
            merged, places = out, np.repeat(places, times)
        cuts = np.searchsorted(places, ends).tolist()
        raw, decimal = merged.astype("<i4").tobytes(), list(map(str, merged.tolist()))
        return [(raw[4 * a : 4 * b], ",".join(decimal[a:b])) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _bytes_of(self, code: int) -> list[int]:
        return [self.byte[b] for b in chr(code).encode("utf-8", "replace")] if self.falls_back else [self.unknown]

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text the bytes of its ids, as 32-bit numbers, and its ids in decimal, joined by commas."""
        cut = [self.chunks.findall((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        if new := list({c for own in cut for c in own if c not in known}):
            known |= zip(new, self._encode_chunks(new), strict=True)
        out = []
        for own in cut:
            found = [known[c] for c in own]
            out.append((b"".join([x[0] for x in found]), ",".join([x[1] for x in found])))
        for c in new:
            if len(c) > REMEMBERED_LENGTH:
                del known[c]
        return out

    # ---- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces end to end, marks as spaces but for the first, byte pieces as UTF-8; each byte that fits none is U+FFFD."""
        own = ids.tolist()
        if not self.control.isdisjoint(own):  # a control id parts the bytes before and after it
            at = [-1, *[k for k, i in enumerate(own) if i in self.control], len(own)]
            parts = [self._decode(own[a + 1 : b]) for a, b in zip(at, at[1:], strict=False)]
            first = next((i for i in own if self.bytes[i]), None)
            return self._unmarked("".join(parts), first)
        return self._unmarked(self._decode(own), own[0] if own else None)

    def _unmarked(self, text: str, first: int | None) -> str:
        """text without the space of its first piece's mark."""
        marked = first is not None and not self.is_byte[first] and first != self.unknown
        return text[1:] if marked and text.startswith(" ") else text

    def _decode(self, own: list[int]) -> str:
        raw = b"".join(map(self.bytes.__getitem__, own))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "surrogateescape").translate(_LONE)


_LONE = {0xDC00 + b: "�" for b in range(256)}
_OWN: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This process's vocabulary of a file."""
    if path not in _OWN:
        _OWN[path] = Pieces(path)
    return _OWN[path]


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids: the text's ids."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces(path)
        for texts in batches:
            yield pd.Series([np.frombuffer(x, "<i4") for i in range(0, len(texts), 256) for x, _ in own.encode(texts.iloc[i : i + 256].fillna("").tolist())], dtype=object)

    return docs.withColumn(ids, encode(F.col(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the column text: the text of the ids; null for null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces(path)
        for rows in batches:
            yield pd.Series([None if r is None else own.decode(np.asarray(r)) for r in rows], dtype=object)

    return docs.withColumn(text, decode(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs (doc_id, text), encoded and decoded in one pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = pieces(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for texts in batches:
            rows = []
            for i in range(0, len(texts), 256):
                for raw, decimal in own.encode(texts.iloc[i : i + 256].fillna("").tolist()):
                    ids = np.frombuffer(raw, "<i4")
                    rows.append((len(ids), sha(decimal.encode()), sha(own.decode(ids).encode("utf-8", "replace"))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
