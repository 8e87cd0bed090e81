"""Encoding and decoding with a byte-level pair vocabulary, through a table of distinct words.

1. Spark splits texts into words with the vocabulary's pattern. Words of up to BLOCK_WORDS in a row of one task are a block: its distinct
   words are numbered, and a document is the numbers of its words. Both go to a table that is bucketed by block.
2. The blocks' words are dealt and sorted by word, which makes them the table of distinct words with their places. Each distinct word is
   encoded once, by vectorised merge rounds over many words at once, and its ids go to the word's blocks.
3. Decoding is a join of ids with the table of pieces, which is broadcast, as it is as large as the vocabulary; pieces are laid end to end by position.
   `decoded` joins the ids of any table so, `digests` the ids of each block's words.
4. In their block, documents take the ids and the decoded bytes of their words by position. Documents don't move: their bucket is where
   the words go to. What is shuffled are the distinct words of each block, once by word and once by block.

A word that is in every block has one row for each block of millions of words, and is streamed over. A task holds one block.

Spark's classes of characters are those of the Java that it runs on. Texts with characters that this Java doesn't know are split by the
tokenizers library itself. Vocabularies that do more than splitting and merging are refused when loaded.

Defined results: null text counts as empty and has no ids. Strings of special tokens in a text become their ids, as in the library. Repeated
rows are treated alike. Extra columns pass through `encoded`; one that has the name of its result is refused. An empty table gives an empty
result. Whole texts are encoded; memory of a task grows with its longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.functions.tables import new_path
from usagemill.llm.common import table
from usagemill.llm.merges import Merger
from usagemill.llm.packing import byte_signs

#: Words and bytes of words of a block, but for a single longer text.
BLOCK_WORDS, BLOCK_BYTES = 1 << 23, 1 << 29
#: Words that are merged together.
AT_ONCE = 20_000
#: Bits of a word's number in its block, and of a block's in its task.
NO_BITS, COUNT_BITS = 24, 15

# The pattern of byte-level vocabularies, with its white space spelled out.
_SPACE = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Characters that the Java at hand doesn't know.
UNKNOWN = r"\p{Cn}"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A vocabulary's file: pieces, special tokens, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model, added, cut = own["model"], own["added_tokens"], own["pre_tokenizer"] or {}
        plain = own["normalizer"] is None and own["post_processor"] is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("vocabularies that do more than byte-level splitting and merging are not supported")
        self.path, self.names = path, model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.dtype = "<u2" if max([*self.names.values(), *self.special.values()]) < 1 << 16 else "<u4"
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

    def pieces(self) -> list[tuple[int, bytes]]:
        """(id, its bytes)."""
        of = {c: b for b, c in enumerate(byte_signs())}
        own = {i: bytes(of[c] for c in name) for name, i in self.names.items() if i not in self.special.values()}
        return sorted((own | {i: s.encode() for s, i in self.special.items()}).items())

    def special_pattern(self) -> str | None:
        return "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or None


class Encoder:
    """Words to the bytes of their ids."""

    def __init__(self, path: str) -> None:
        own = Vocabulary(path)
        names = own.names
        self.special, self.dtype = own.special, np.dtype(own.dtype)
        self.merger = Merger({(names[a], names[b]): (rank, names[a + b]) for rank, (a, b) in enumerate(own.merges)}, max(names.values()) + 1)
        self.first = np.array([names[c] for c in byte_signs()], np.int64)

    def encode(self, words: list[str]) -> list[bytes]:
        raw = [b"" if w in self.special else w.encode() for w in words]
        length = np.array([len(r) for r in raw])
        symbol = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        merged, places = self.merger.merge(symbol, np.repeat(np.arange(len(raw)), length)) if len(symbol) else (symbol, symbol)
        cuts = np.searchsorted(places, np.append(0, np.cumsum(length))) * self.dtype.itemsize
        out = merged.astype(self.dtype).tobytes()
        special = lambda w: np.array([self.special[w]], self.dtype).tobytes()
        return [out[a:b] if r else special(w) for w, r, a, b in zip(words, raw, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- splitting


def words_of(text: Column, special: str | None = None) -> Column:
    """The words of a text, end to end the text again; strings of special tokens are words of their own and part the words about them."""
    cut = lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    if special is None:
        return cut(text)
    between, marks = F.transform(F.split(text, special, -1), cut), F.transform(F.regexp_extract_all(text, F.lit(f"({special})"), F.lit(1)), lambda s: F.array(s))
    parted = F.flatten(F.zip_with(between, marks, lambda b, m: F.concat(b, F.coalesce(m, F.array().cast("array<string>")))))
    return F.when(text.rlike(special), parted).otherwise(cut(text))


def _library_words(path: str, texts: pa.Array) -> list[list[str] | None]:
    from tokenizers import Tokenizer

    own, special = Tokenizer.from_file(path).pre_tokenizer, Vocabulary(path).special_pattern()
    cut = lambda t: [t[a:b] for _, (a, b) in own.pre_tokenize_str(t)]
    parts = lambda t: [w for i, part in enumerate(re.split(f"({special})", t) if special else [t]) for w in ([part] if i % 2 else cut(part))]
    return [None if t is None else parts(t) for t in texts.to_pylist()]


#: Columns of the bytes of documents' numbers, from the lowest on; apart they pack well.
PLANES = ["low", "mid", "high", "top"]


def _numbers(own: pa.Table) -> Iterator[list[int]]:
    """The numbers of the documents' words."""
    for planes in zip(*[own[p].to_pylist() for p in PLANES], strict=True):
        yield np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1).view("<u4").ravel().tolist()


def blocks(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A table bucketed by block, of (block, no, word) for each distinct word of a block and (block, PLANES, doc) for each row of docs; doc has the columns `keep`, or all."""
    spark, special = docs.sparkSession, Vocabulary(path).special_pattern()
    whole = F.coalesce(F.col(text), F.lit(""))
    unknown = whole.rlike(UNKNOWN)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.when(~unknown, words_of(whole, special)).alias("words"), F.when(unknown, whole).alias("unknown"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held, size, room = TaskContext.get().partitionId(), 0, [], 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            coded = pa.chunked_array([w for _, w, _ in held]).dictionary_encode()  # its parts share a dictionary
            docs_, lengths = [d for d, _, _ in held], [n for _, _, n in held]
            held.clear()
            known = coded.chunk(coded.num_chunks - 1).dictionary
            code, size = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]), len(known)
            del coded
            if size >= 1 << NO_BITS or count >= 1 << COUNT_BITS:
                raise ValueError("a text with too many distinct words, or a task with too many blocks")
            order = np.argsort(-np.bincount(code, minlength=size), kind="stable")  # frequent words have small numbers
            number = np.empty(size, "<u4")
            number[order] = np.arange(size)
            own, ends = number[code].view(np.uint8).reshape(-1, 4), np.cumsum(np.concatenate(lengths))
            planes = [pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own[:, k]))]) for k in range(len(PLANES))]
            at, doc, by_word = np.int64(task) << COUNT_BITS | count, pa.concat_arrays(docs_), pc.sort_indices(known)
            del code, own
            same, none = (lambda n: pa.array(np.full(n, at))), (lambda kind, n: pa.array([None] * n, kind))
            yield pa.RecordBatch.from_arrays([same(size), pa.array(number[by_word.to_numpy()].astype(np.int32)), known.take(by_word), *[none(pa.binary(), size)] * len(PLANES), none(doc.type, size)], names)
            yield pa.RecordBatch.from_arrays([same(len(doc)), none(pa.int32(), len(doc)), none(pa.string(), len(doc)), *planes, doc], names)

        for batch in batches:
            doc, words = batch.column(0), batch.column(1)
            if words.null_count:
                words = pa.array([u if w is None else w for w, u in zip(words.to_pylist(), _library_words(path, batch.column(2)), strict=True)], pa.list_(pa.string()))
            length, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(int), words.flatten()
            ends = np.cumsum(length)
            at = 0
            while at < len(doc):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_WORDS - size, "right")))
                first, last = (ends[at - 1] if at else 0), ends[to - 1]
                part = flat.slice(first, last - first)
                held.append((doc.slice(at, to - at), part, length[at:to]))
                size, room, at = size + last - first, room + part.get_total_buffer_size() * (last - first) // max(len(flat), 1), to
                if size >= BLOCK_WORDS or at < len(doc) or room >= BLOCK_BYTES:
                    yield from block()
                    count, size, room = count + 1, 0, 0
            del doc, words, flat
        if held:
            yield from block()
        pa.default_memory_pool().release_unused()

    names = ["block", "no", "word", *PLANES, "doc"]
    schema = f"block long, no int, word string, {', '.join(f'{p} binary' for p in PLANES)}, doc {rows.schema['doc'].dataType.simpleString()}"
    name, where = f"blocks_{uuid.uuid4().hex}", new_path(spark, "blocks")
    out = rows.mapInArrow(numbered, schema)
    out.write.format("parquet").option("compression", "zstd").option("path", where).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog only: its files are in the shared folder
    return found


# ---- encoding


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary as a table, its pieces as bytes."""
    return spark.createDataFrame(Vocabulary(path).pieces(), "id int, piece binary")


def decoded(rows: DataFrame, keys: list[str], path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """(keys, text) of rows whose keys are unique: the text of their ids, through a join with the pieces; null for null ids.

    Ids outside the vocabulary are left out, as by the library. Bytes that are no UTF-8 become U+FFFD.
    """
    joined = _joined(rows, keys, path, ids).drop(ids)

    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return joined.withColumn(text, read("_bytes")).drop("_bytes")


def _joined(rows: DataFrame, keys: list[str], path: str, ids: str) -> DataFrame:
    """(keys, ids, _bytes): the pieces of the rows' ids, end to end; null for null ids."""
    placed = rows.select(*keys, F.col(ids).isNull().alias("_none"), F.posexplode_outer(ids).alias("_at", "_id"))
    own = pieces(rows.sparkSession, path).withColumnsRenamed({"id": "_id", "piece": "_piece"})
    known = placed.join(F.broadcast(own), "_id", "left")  # as many rows as the vocabulary has
    part = F.when(F.col("_at").isNotNull(), F.struct("_at", "_id", "_piece"))
    laid = known.groupBy(*keys).agg(F.first("_none").alias("_none"), F.array_sort(F.collect_list(part)).alias("_parts"))
    whole = F.unhex(F.array_join(F.transform("_parts", lambda p: F.coalesce(F.hex(p["_piece"]), F.lit(""))), ""))
    given = lambda c: F.when(~F.col("_none"), c)
    return laid.select(*keys, given(F.transform("_parts", lambda p: p["_id"])).alias(ids), given(whole).alias("_bytes"))


def _words_encoded(table_: DataFrame, path: str) -> DataFrame:
    """(block, no, ids): the ids of the blocks' words, dealt by block."""
    short = max(i for i, _ in Vocabulary(path).pieces()) < 0xD800  # then an id is a character, and ids travel as UTF-16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, known = encoder(path), None, b""
        for batch in batches:
            coded = batch.column(0).dictionary_encode()  # equal words lie side by side
            words = coded.dictionary.to_pylist()
            new = words[1:] if words and words[0] == last else words
            ids = ([known] if len(new) < len(words) else []) + [x for i in range(0, len(new), AT_ONCE) for x in own.encode(new[i : i + AT_ONCE])]
            last, known = words[-1] if words else last, ids[-1] if ids else known
            if short:
                lists = pa.array(ids, pa.binary())
            else:
                lists = pa.ListArray.from_arrays(np.cumsum([0, *[len(x) // own.dtype.itemsize for x in ids]]).astype(np.int32), np.frombuffer(b"".join(ids), own.dtype).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists.take(coded.indices)], ["place", "ids"])

    parts = int(table_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.shiftleft("block", NO_BITS).bitwiseOR(F.col("no").cast("long")).alias("place")
    places = table_.where("word IS NOT NULL").select("word", place).repartition(parts, "word").sortWithinPartitions("word", "place")
    block, no = F.shiftright("place", NO_BITS), F.col("place").bitwiseAND((1 << NO_BITS) - 1).cast("int")
    dealt = places.mapInArrow(encode, f"place long, ids {'binary' if short else 'array<int>'}").repartition(parts, block.alias("block"))
    ids = F.transform(F.split(F.decode("ids", "UTF-16LE"), ""), lambda c: F.ascii(c)) if short else F.col("ids")
    return dealt.select(block.alias("block"), no.alias("no"), ids.alias("ids"))


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids: the text's ids."""
    if ids in docs.columns:
        raise ValueError(f"docs has a column {ids} already")
    table_ = blocks(docs, path, text)
    kind = table_.schema["doc"].dataType

    def placed(own: pa.Table, words: pa.Table) -> pa.Table:
        known = [np.array(x, np.int32) for x in words["ids"].take(pc.sort_indices(words["no"])).to_pylist()]
        found = [np.concatenate([known[i] for i in at] or [np.zeros(0, np.int32)]) for at in _numbers(own)]
        return pa.table({"doc": own["doc"], "ids": pa.array(found, pa.list_(pa.int32()))})

    own = table_.where("word IS NULL").select(F.col("block").alias("of"), *PLANES, "doc")
    joined = own.groupBy("of").cogroup(_words_encoded(table_, path).groupBy("block")).applyInArrow(placed, f"doc {kind.simpleString()}, ids array<int>")
    return joined.select("doc.*", F.col("ids").alias(ids))


class Pieces:
    """The table of pieces on the tasks' side of a join by id: the bytes of the pieces, end to end, and where each one starts."""

    def __init__(self, rows: DataFrame) -> None:
        found = sorted((r.id, bytes(r.piece)) for r in rows.collect())  # as many as the vocabulary has
        self.bytes = np.frombuffer(b"".join(p for _, p in found), np.uint8)
        length = np.zeros(found[-1][0] + 1, np.int64)
        length[[i for i, _ in found]] = [len(p) for _, p in found]
        self.ends = np.cumsum(length)
        self.length = length

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The pieces of ids end to end, cut after the ids that `ends` counts."""
        length = self.length[ids]
        to = np.cumsum(length)
        raw = self.bytes[np.repeat(self.ends[ids] - to, length) + np.arange(to[-1] if len(to) else 0)].tobytes()
        cuts = np.append(0, to)[ends].tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs (doc_id, text). The table of pieces is broadcast, and joined with the ids of each block's words."""
    table_ = blocks(docs, path, keep=["doc_id"])
    slim = table_.select("block", "no", "word", *PLANES, F.col("doc.doc_id").alias("doc_id"))
    known = docs.sparkSession.sparkContext.broadcast(Pieces(pieces(docs.sparkSession, path)))

    def placed(own: pa.Table, words: pa.Table) -> pa.Table:
        lists = words["ids"].combine_chunks().take(pc.sort_indices(words["no"]))
        size, text, decimal = pc.list_value_length(lists).to_numpy(zero_copy_only=False), [], []
        for at in range(0, len(lists), AT_ONCE):
            flat, ends = lists.slice(at, AT_ONCE).flatten().to_numpy(zero_copy_only=False), np.cumsum(size[at : at + AT_ONCE])
            text += known.value.joined(flat, ends)
            digits = list(map(str, flat.tolist()))
            decimal += [",".join(digits[a:b]).encode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        del lists, words
        rows = []
        for at in _numbers(own):
            out = b"".join([text[i] for i in at]).decode("utf-8", "replace").encode()
            rows.append((int(size[at].sum()) if at else 0, hashlib.sha256(b",".join([decimal[i] for i in at])).hexdigest(), hashlib.sha256(out).hexdigest()))
        pa.default_memory_pool().release_unused()
        n, ids, decoded_ = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"doc_id": own["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded_, pa.string())})

    own = slim.where("word IS NULL").select(F.col("block").alias("of"), *PLANES, "doc_id")
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return own.groupBy("of").cogroup(_words_encoded(slim, path).groupBy("block")).applyInArrow(placed, schema)


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
