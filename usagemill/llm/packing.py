"""Lexical retrieval packing: windows are filled with documents that resemble their first one.

1. Texts become token ids. Some megabytes of texts are cut into the tokenizer's pre-tokens at once, by classes of characters. Distinct ones are encoded
   together in vectorised merge rounds and remembered, and texts take their ids by number; texts with characters outside a list of plain ones go through the tokenizer whole. Ids are written as a table of bytes.
2. Document frequencies of tokens and the mean length are counted over all documents. They are bounded by the vocabulary.
3. Documents are placed by content: a document's slot is its most telling token that another document has too, with a hash of its second
   one. Slots in their order are cut into shards of about SHARD_TOKENS tokens, by the slots' numbers of tokens, which are bounded by the
   vocabulary; a slot with more is dealt over several shards. Shards don't depend on how the rows were partitioned.
4. A shard has an inverted index of its documents. From a seed document, BM25 over all of the seed's tokens ranks the documents that
   aren't used yet, and they are appended greedily until the window is full. Used ones leave the index when they are half of it. A document that a window's end cuts continues in the
   next window and is its seed.
5. What TAILS shards leave at their ends is packed together. What is left then is cut into sequences whose lengths are powers of two,
   which need no padding.

Ids are shuffled once, and every id lies in exactly one piece. A shard holds about SHARD_TOKENS tokens or a single document. A
document's neighbours in other shards are out of its reach.

Defined results: null and empty texts have only the closing id. Repeated rows are packed as often as they occur. A null doc_id is
carried along. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions.tables import new_path, removed
from usagemill.llm.common import table, written
from usagemill.llm.merges import Merger

WINDOW, CLOSING = 4096, 2
SHARD_TOKENS = 2_000_000
#: Slots a token, and shards whose ends are packed together.
SUBSLOTS, TAILS = 8, 256
#: BM25's constants.
K1, B = 1.2, 0.75
#: Pre-tokens that a task remembers, and their greatest length.
REMEMBERED, REMEMBERED_LENGTH = 350_000, 60
#: Bytes of texts that are encoded together; a longer text is encoded alone.
PART_BYTES = 4_000_000

#: Letters and numbers of the plain characters: ASCII, Latin-1 and Latin Extended A without the dotted capital I.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-įı-ſ]*")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: Classes of characters. Numbers are pre-tokens of one character, runs of letters and of others are one each.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of each plain character."""
    out = np.full(0x180, _OTHER, np.uint8)
    for of, pattern in ((_SPACE, r"\s"), (_LETTER, f"[{_LETTERS}]"), (_NUMBER, f"[{_NUMBERS}]")):
        out[[c for c in range(len(out)) if re.fullmatch(pattern, chr(c))]] = of
    return out


_CLASSES = _classes()
_BYTE_CLASSES = np.append(_CLASSES[:128], np.full(128, _OTHER, np.uint8))


def pre_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of lower-case plain texts in UTF-8, and for each text how many there are up to its end.

    They are runs of a class of characters, single numbers, and 's 't 're 've 'm 'll 'd where an apostrophe stands alone before letters.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    of = _BYTE_CLASSES[data]
    lead = np.flatnonzero(data >= 0xC0)  # plain characters have one or two bytes
    of[lead] = of[lead + 1] = _CLASSES[(data[lead] & np.uint16(0x1F)) << np.uint16(6) | data[lead + 1] & np.uint16(0x3F)]
    starts = of == _NUMBER
    starts[:1] = True
    starts[1:] |= of[1:] != of[:-1]
    starts[lead + 1] = False
    mark = np.flatnonzero(data == ord("'"))
    mark = mark[starts[mark] & (of[mark + 1] == _LETTER)]
    one, two = data[mark + 1], data[mark + 1] * np.uint32(256) + data[mark + 2]
    for own, length in ((mark[np.isin(one, list(b"stmd"))], 2), (mark[np.isin(two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])], 3)):
        starts[own + 1], starts[own + length] = False, True
    at = np.flatnonzero(starts)
    length, solid = np.diff(np.append(at, len(data))), of[at] != _SPACE
    at, length = at[solid], length[solid]
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[of != _SPACE])])
    return parts, np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))


class Encoder:
    """Texts to ids, as little-endian bytes of unsigned 16-bit numbers (32-bit for a larger vocabulary)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = re.compile("|".join(map(re.escape, (x.content for x in self.library.get_added_tokens_decoder().values()))) or "(?!)")
        self.known: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Merger({(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}, max(vocabulary.values()) + 1)
        signs = byte_signs()
        self.inner = np.array([vocabulary[c] for c in signs], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in signs], np.int64)

    def _new(self, parts: list[bytes]) -> Iterator[bytes]:
        """The ids of pre-tokens."""
        length = np.array([len(r) for r in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(length)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        merged, places = self.merger.merge(symbol, np.repeat(np.arange(len(parts)), length))
        cuts = np.searchsorted(places, ends).tolist()
        out, size = merged.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        return (out[a * size : b * size] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct pre-tokens."""
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in parts if w in self.known}
        known = self.known
        if new := [w for w in parts if w not in known]:
            known |= zip(new, self._new(new), strict=True)
        out = [known[w] for w in parts]
        for w in new:
            if len(w) > REMEMBERED_LENGTH:
                del known[w]
        return out

    def encoded(self, texts: list[str], end: bytes = b"") -> pa.Array:
        """The ids of each text, followed by `end`."""
        plain = [_PLAIN.fullmatch(t) is not None and not self.special.search(t) for t in texts]
        whole = self._bytes([t for t, p in zip(texts, plain, strict=True) if not p])
        parts, upto = pre_tokens([t.lower().encode() if p else b"" for t, p in zip(texts, plain, strict=True)])
        coded = parts.dictionary_encode()
        _, offsets, data = coded.dictionary.buffers()
        cuts, data = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        ids = self._of([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        # a text is its pre-tokens and a last part: the end, with all ids before it if the library made them
        last = np.full(len(texts), len(ids))
        last[~np.array(plain, bool)] += np.arange(1, len(whole) + 1)
        at = upto + np.arange(len(texts))
        number, inner = np.empty(len(parts) + len(texts), np.int32), np.ones(len(parts) + len(texts), bool)
        number[at], inner[at] = last, False
        number[inner] = coded.indices.to_numpy()
        laid = pa.array([*ids, end, *(x + end for x in whole)], pa.binary()).take(pa.array(number))
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, np.int32)[at + 1]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.append(np.int32(0), ends)), data])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoded(texts).to_pylist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokens(docs: DataFrame, path: str, closing: int = CLOSING) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): the ids' bytes with the closing id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([closing], own.dtype).tobytes()
        for batch in batches:
            texts = batch["text"].fill_null("")
            part = np.cumsum(pc.binary_length(texts).to_numpy()) // PART_BYTES
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], own.encoded(texts[a:b].to_pylist(), end)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document that has some, in order, and how often each occurs; 32-bit numbers are sorted faster than 16-bit ones."""
    own = ids.astype(np.uint32)
    own.sort()
    new = np.ones(len(own) + 1, bool)
    np.not_equal(own[1:], own[:-1], out=new[1:-1])
    at = new.nonzero()[0]
    return own[at[:-1]].astype(ids.dtype), at[1:] - at[:-1]


def frequencies(encoded: DataFrame, dtype: str, vocabulary: int) -> tuple[np.ndarray, int, float]:
    """Documents that have each id, documents, and mean length; added up over all documents, bounded by the vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows, length = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for ids in batch["ids"]:
                own = np.frombuffer(ids, dtype)
                found[distinct(own)[0]] += 1
                rows, length = rows + 1, length + len(own)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"id": np.append(at, [-1, -2]), "n": np.append(found[at], [rows, length])})

    sums = encoded.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    of = dict(zip(sums["id"].tolist(), sums["n"].tolist(), strict=True))
    out = np.zeros(vocabulary, np.int64)
    for i, n in of.items():
        if i >= 0:
            out[i] = n
    rows = of.get(-1, 0)
    return out, rows, of.get(-2, 0) / max(rows, 1)


class Shard:
    """An inverted index over some documents that ranks unused ones for a seed."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        terms, docs, weights = [], [], []
        for i, ids in enumerate(documents):
            found, counts = distinct(ids)
            weight = counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(ids) / max(mean_length, 1))) * idf[found]
            terms.append(found)
            docs.append(np.full(len(found), i))
            weights.append(weight.astype(np.float32).astype(float))  # sums are of doubles
        self.terms, self.size = terms, len(idf)
        self.unused, self.next, self.left = np.ones(len(documents), bool), 0, len(documents)
        term, doc, weight = np.concatenate(terms), np.concatenate(docs), np.concatenate(weights)
        order = np.argsort(term, kind="stable")
        self._index(term[order], doc[order], weight[order])

    def _index(self, term: np.ndarray, docs: np.ndarray, weights: np.ndarray) -> None:
        self.term, self.docs, self.weights = term, docs, weights
        self.ends, self.indexed = np.searchsorted(term, np.arange(self.size + 1)), self.left

    def use(self, document: int) -> None:
        self.unused[document] = False
        self.left -= 1
        if 2 * self.left < self.indexed:
            live = self.unused[self.docs]
            self._index(self.term[live], self.docs[live], self.weights[live])

    def first_unused(self) -> int:
        while self.next < len(self.unused) and not self.unused[self.next]:
            self.next += 1
        return self.next if self.next < len(self.unused) else -1

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a token with the seed, best first; ties in the shard's order."""
        spans = [slice(a, b) for a, b in zip(self.ends[self.terms[seed]].tolist(), self.ends[self.terms[seed].astype(np.int64) + 1].tolist(), strict=True)]
        docs = np.concatenate([self.docs[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weights[s] for s in spans]), minlength=len(self.unused))
        score[~self.unused] = 0
        some = np.flatnonzero(score)
        return some[np.argsort(-score[some], kind="stable")]


def _order(documents: list[np.ndarray], idf: np.ndarray, mean_length: float, room: int) -> Iterator[int]:
    """The documents of a shard in the order in which they are packed; room is what the open window has left."""
    shard, seed = Shard(documents, idf, mean_length), -1
    while True:
        if seed < 0:
            seed = shard.first_unused()
            if seed < 0:
                return
            shard.use(seed)
            yield seed
            room -= len(documents[seed])
        if room <= 0:
            room = room % WINDOW or WINDOW
        last = -1
        for n in shard.neighbours(seed).tolist():
            shard.use(n)
            yield n
            room -= len(documents[n])
            if room <= 0:
                last = n
                break
        seed = last


class Packer:
    """Lays ids end to end in windows; keeps the pieces of the window that is still open."""

    def __init__(self, first_sequence: int, dtype: str) -> None:
        self.sequence, self.dtype = first_sequence, dtype
        self.open: list[tuple] = []
        self.used = 0

    def _piece(self, doc_id, start: int, ids: np.ndarray, total: int, offset: int) -> tuple:
        return (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset)

    def add(self, doc_id, ids: np.ndarray, first: int = 0, total: int | None = None) -> Iterator[tuple]:
        """ids are those of a document of `total` ids from its id `first` on."""
        start, total = 0, len(ids) if total is None else total
        while start < len(ids):
            part = ids[start : start + WINDOW - self.used]
            self.open.append((doc_id, first + start, part, total))
            start, self.used = start + len(part), self.used + len(part)
            if self.used == WINDOW:
                yield from self._close(WINDOW)

    def _close(self, length: int) -> Iterator[tuple]:
        """A sequence of the first `length` ids of the open window."""
        offset, rest = 0, []
        for doc_id, start, part, total in self.open:
            own = part[: length - offset]
            if len(own):
                yield self._piece(doc_id, start, own, total, offset)
                offset += len(own)
            if len(own) < len(part):
                rest.append((doc_id, start + len(own), part[len(own) :], total))
        self.sequence, self.open, self.used = self.sequence + 1, rest, self.used - length

    def finish(self) -> Iterator[tuple]:
        """The open window as sequences whose lengths are powers of two."""
        while self.used:
            yield from self._close(1 << (self.used.bit_length() - 1))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def placed(encoded: DataFrame, dtype: str, counts: np.ndarray, idf: np.ndarray, mean_length: float, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, unnamed, ids, slot, content, shard) of a written table (doc_id, ids), from a table of its own."""

    shared = idf * (counts > 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots, contents = [], []
            for ids in batch["ids"]:
                own = np.frombuffer(ids, dtype)
                found, n = distinct(own)
                weight = n * (K1 + 1) / (n + K1 * (1 - B + B * len(own) / max(mean_length, 1))) * shared[found]
                first = second = int(weight.argmax())
                if len(weight) > 1:
                    weight[first] = -1
                    second = int(weight.argmax())
                slots.append(int(found[first]) * SUBSLOTS + int(found[second]) * 0x9E3779B1 % (1 << 32) % SUBSLOTS)
                contents.append(zlib.crc32(ids))
            yield batch.assign(n=[len(x) // np.dtype(dtype).itemsize for x in batch["ids"]], slot=slots, content=contents)

    named = F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed")  # pandas would make a long with nulls a float
    rows = written(encoded.select(*named, "ids").mapInPandas(place, "doc_id long, unnamed boolean, ids binary, n long, slot long, content long"))
    sums = rows.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    size = np.zeros(len(idf) * SUBSLOTS, np.int64)
    size[sums["slot"]] = sums["n"]
    first, step = np.cumsum(size) - size, max(shard_tokens // 2, 1)

    @F.pandas_udf("long")
    def shard(slot: pd.Series, salt: pd.Series) -> pd.Series:
        own = size[slot.to_numpy()]
        return pd.Series((first[slot.to_numpy()] + np.where(own > step, own * (salt.to_numpy() / 1e6), 0).astype(np.int64)) // step)

    salt = F.pmod(F.xxhash64("doc_id", "content"), F.lit(1_000_000))
    return rows.select("doc_id", "unnamed", "ids", "slot", "content", shard("slot", salt).alias("shard"))


def _frame(rows: list[tuple], shard: int | None, left: list[tuple], dtype: str) -> pd.DataFrame:
    """Rows of PIECES, and the parts (doc_id, start, ids, total) of a shard's open window."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    parts = [(i, start, len(ids), None, total, shard, at, ids.astype(dtype).tobytes()) for at, (i, start, ids, total) in enumerate(left)]
    frame = pd.DataFrame([(*r, None) for r in rows] + parts, columns=[*names, "ids"])
    return frame.astype(dict.fromkeys(names, "Int64"))


def packed(shards: DataFrame, dtype: str, idf: np.ndarray, mean_length: float) -> DataFrame:
    """PIECES of what `placed` gives."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, names_of = -1, [], []

        def shard() -> pd.DataFrame:
            packer = Packer(at << 24, dtype)
            out = [p for i in _order(ids, idf, mean_length, WINDOW) for p in packer.add(names_of[i], ids[i])]
            return _frame(out, at, packer.open, dtype)

        for batch in batches:
            for doc_id, unnamed, own, of in zip(batch["doc_id"].tolist(), batch["unnamed"].tolist(), batch["ids"], batch["shard"].tolist(), strict=True):
                if of != at and ids:
                    yield shard()
                    ids, names_of = [], []
                at = of
                names_of.append(None if unnamed else doc_id)
                ids.append(np.frombuffer(own, dtype))
        if ids:
            yield shard()

    def pack_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, packer = -1, None
        for batch in batches:
            out: list[tuple] = []
            columns = (batch[c].tolist() for c in ("doc_id", "unnamed", "ids", "start", "doc_tokens", "sequence_id"))
            for doc_id, unnamed, own, start, total, of in zip(*columns, strict=True):
                if of // TAILS != group:
                    out += packer.finish() if packer else []
                    group, packer = of // TAILS, Packer(1 << 62 | (of // TAILS) << 24, dtype)
                out += packer.add(None if unnamed else doc_id, np.frombuffer(own, dtype), start, total)
            yield _frame(out, None, [], dtype).drop(columns="ids")
        if packer:
            yield _frame(list(packer.finish()), None, [], dtype).drop(columns="ids")

    order = ["shard", "slot", "content", "unnamed", "doc_id"]
    dealt = shards.repartition("shard").sortWithinPartitions(*order)
    first = written(dealt.mapInPandas(pack, PIECES + ", ids binary"))
    named = F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed")
    ends = first.where("ids IS NOT NULL").select(*named, "ids", "start", "doc_tokens", "sequence_id", "offset", F.floor(F.col("sequence_id") / TAILS).alias("group"))
    last = ends.repartition("group").sortWithinPartitions("group", "sequence_id", "offset").mapInPandas(pack_ends, PIECES)
    return first.where("ids IS NULL").drop("ids").unionByName(last)


def pack_documents(docs: DataFrame, path: str, closing: int = CLOSING, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces (PIECES) of docs (doc_id, text) in windows of WINDOW ids."""
    own, spark = encoder(path), docs.sparkSession
    dtype, texts = own.dtype, new_path(spark)
    encoded = written(tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, closing), texts)
    counts, rows, mean_length = frequencies(encoded, dtype, own.library.get_vocab_size())
    idf = np.log1p((rows - counts + 0.5) / (counts + 0.5)).astype(np.float32)
    shards = placed(encoded, dtype, counts, idf, mean_length, shard_tokens)
    removed(spark, texts)  # its ids are in the table of placed documents
    return packed(shards, dtype, idf, mean_length)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
