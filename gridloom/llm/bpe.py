"""BPE encoding and decoding by tree concatenation.

Texts up to ``leaf_chars`` are encoded where they are read. A longer text is cut into leaves
that are encoded as rows of their own, so several tasks share one text; the leaves' ids are then
joined pairwise like a tree. At each join a window around the cut is encoded again and grows until
its ids meet the left side's and the right side's ids at tokens that both have in the same place.

Why that is exact: a byte-pair encoding is valid if and only if each two neighbours are the encoding
of their concatenation. Where two encodings share a token at the same place, what precedes it can be
taken from one and what follows from the other: each pair of neighbours then stands in one of the
two. The meeting token must also lie clear of the window's ends, whose pre-tokens the cut may change.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, forget, memory, text_or_empty

#: Texts longer than this many characters are cut into leaves.
LEAF_CHARS = 16_384
#: Pieces of text a worker remembers the ids of, in either of two generations.
CACHE_PIECES = 250_000
#: Rows that are encoded at once: the more, the fewer times Python sees a piece.
ENCODE_ROWS = 2048

_PIECE = re.compile(r"\s*\S+|\s+")
_CUT = "\x1e"
#: Texts that plain rules do not cut: white space beside white space or other than space and line end.
_ODD = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that follow a letter and end at white space: a pre-token of their own.
_MARKS = r"(\pL)([^\pL\pN\s']+)( |\n|$)"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizers library's ids of whole texts, with a memory of repeated pieces.

    A text is cut only where its pre-tokens end whatever surrounds them: before white space that
    follows a character, behind a single line end, and between a word and the marks before a space.
    A text that holds an added token's content is not cut at all.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = memory({})  # ids of pieces
        self.older: dict[str, bytes] = memory({})  # the generation before
        self._bytes: list[bytes] | None = None
        self._texts: list[str] | None = None

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; new ones are encoded together."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = self.older, self.known
            self.known.clear()
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (ids := older.get(pieces[i])) is None:
                new.append(i)
            else:
                out[i] = known[pieces[i]] = ids
        for i, ids in zip(new, self.plain([pieces[i] for i in new])):
            out[i] = known[pieces[i]] = array("I", ids).tobytes()
        return out

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): ids[offsets[i]:offsets[i + 1]] are those of text i, as the library gives them.

        Arrow cuts the texts and numbers the distinct pieces, so Python sees each distinct piece of a
        batch once. Odd texts are cut by a pattern and put together from their own pieces; texts with
        added tokens are encoded as they are and not remembered.
        """
        uncut = np.zeros(len(texts), bool)
        for content in self.added:
            uncut |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False).astype(bool)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(bool) | uncut
        cut = pc.replace_substring_regex(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), _MARKS, r"\1" + _CUT + r"\2\3")
        cut = pc.replace_substring(pc.replace_substring(cut, "\n", _CUT + "\n" + _CUT), " ", _CUT + " ")
        lists = pc.split_pattern(cut, _CUT)
        coded = lists.flatten().dictionary_encode()
        at = lists.offsets.to_numpy().astype(np.int64)
        code = coded.indices.to_numpy().astype(np.int64)
        special = {i: _PIECE.findall(texts[i].as_py()) for i in np.flatnonzero(odd & ~uncut).tolist()}
        pieces = coded.dictionary.to_pylist()
        extra = list(set().union(*special.values()).difference(pieces))
        entries = self.look_up(pieces + extra)
        if special:
            ids_of = dict(zip(pieces + extra, entries))
            code[at[[*special]]] = len(entries) + np.arange(len(special))
            entries += [b"".join(map(ids_of.__getitem__, x)) for x in special.values()]
        if uncut.any():
            rows = np.flatnonzero(uncut)
            code[at[rows]] = len(entries) + np.arange(len(rows))
            entries += [array("I", x).tobytes() for x in self.plain([texts[i].as_py() for i in rows.tolist()])]
        ids, starts = np.frombuffer(b"".join(entries), "<u4"), np.cumsum([0, *map(len, entries)]) // 4
        lens = np.diff(starts)[code]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts[code] - (ends - lens), lens) + np.arange(total)
        return ids[where], np.concatenate([[0], ends])[at]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_texts(pa.array(texts, pa.string()))

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        ids, at = self.encode_array(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; added tokens stand for themselves."""
        if self._bytes is None:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(printable)]
            back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
            added = self.tokenizer.get_added_tokens_decoder()
            names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
            self._bytes = [x.encode() if i in added else bytes(back[c] for c in x) for i, x in enumerate(names)]
        return self._bytes

    def decode(self, ids: np.ndarray) -> str:
        table = self.token_bytes()
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> str:
        if self._texts is None:
            self._texts = [str(i) for i in range(self.tokenizer.get_vocab_size())]
        texts = self._texts
        return ",".join([texts[i] for i in ids.tolist()])

    # ---- tree concatenation ----

    #: Tokens at a window's outer end that must agree before a side counts as met.
    CLEAR = 4

    def join(self, left: np.ndarray, right: np.ndarray, first_window: int = 16) -> np.ndarray:
        """Ids of two neighbouring texts' concatenation from the ids of each."""
        if not len(left) or not len(right):
            return left if len(left) else right
        table, width = self.token_bytes(), first_window
        while True:
            a, b = left[-width:], right[:width]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            raw = b"".join([table[i] for i in (*a.tolist(), *b.tolist())])
            try:
                mid = np.array(self.plain([raw.decode("utf-8")])[0], np.uint32)
            except UnicodeDecodeError:  # an end of the window lies inside a character
                mid = np.empty(0, np.uint32)
            head, tail = agreeing(mid, a), agreeing(mid[::-1], b[::-1])
            if len(mid) and (all_left or head > self.CLEAR) and (all_right or tail > self.CLEAR):
                head, tail = (0 if all_left else head), (0 if all_right else tail)
                return np.concatenate([left[: 0 if all_left else len(left) - len(a) + head], mid[head : len(mid) - tail], right[len(right) if all_right else len(b) - tail :]])
            if all_left and all_right:
                raise ValueError("ids that do not decode to text")
            width *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """Pairwise joins, level by level."""
        parts = [x for x in parts if len(x)] or [np.empty(0, np.uint32)]
        while len(parts) > 1:
            pairs = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(pairs) * 2 :]
        return parts[0]


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    return n if same.all() else int(np.argmin(same))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file; the memory of pieces lives as long as the worker."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    enc = _encoders[path]
    forget(enc.known, enc.older)
    return enc


def regrouped(batches: Iterator[pa.RecordBatch], rows: int = ENCODE_ROWS, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def leaves(text: str, leaf_chars: int) -> list[str]:
    """Halves of halves until none is longer than ``leaf_chars``."""
    if len(text) <= leaf_chars:
        return [text]
    mid = len(text) // 2
    return leaves(text[:mid], leaf_chars) + leaves(text[mid:], leaf_chars)


def as_binary(enc: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    return [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    leaf_chars: int = LEAF_CHARS,
    finish: Callable[[Encoder, list[np.ndarray]], list[pa.Array]] = as_binary,
    columns: str = "ids binary",
) -> DataFrame:
    """(id, ids binary) per row, or the ``columns`` that ``finish`` makes of the ids where they are encoded.

    Null text counts as empty; empty text has no ids. Rows that repeat an id stay apart. Long
    texts travel by row number, which is derived from the scan and so the same when recomputed.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in regrouped(batches):
            yield pa.RecordBatch.from_arrays([b.column("id"), *finish(enc, enc.encode_texts(b.column("text")))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, key, text in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist()):
                parts = leaves(text, leaf_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([key] * n, b.column("id").type), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["row", "id", "leaf", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = as_binary(enc, enc.encode_texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("leaf"), *ids], ["row", "id", "leaf", "ids"])

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            whole_ids = [enc.concatenate([np.frombuffer(x["ids"], "<u4") for x in parts]) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *finish(enc, whole_ids)], names)

    kind = src.schema["id"].dataType.simpleString()
    names = ["id", *[x.split()[0] for x in columns.split(", ")]]
    short = src.where(F.length("text") <= leaf_chars).mapInArrow(whole, f"id {kind}, {columns}")
    long = src.withColumn("row", F.monotonically_increasing_id()).where(F.length("text") > leaf_chars)
    parts = long.mapInArrow(cut, f"row long, id {kind}, leaf int, text string").repartition(F.col("row"), F.col("leaf"))
    coded = parts.mapInArrow(encode_leaves, f"row long, id {kind}, leaf int, ids binary")
    joined = coded.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("leaf", "ids"))).alias("parts"))
    return short.unionByName(joined.select("id", "parts").mapInArrow(tree, f"id {kind}, {columns}"))


def decode_documents(coded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(id, ids) -> (id, text); special tokens are written out."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return coded.select("id", "ids").mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, made where its ids are.

    Null text is empty (no ids, the hash of nothing); rows that repeat an id or are equal are a row each; an
    empty table gives none; other columns are not read.
    """

    def digest(enc: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(enc.decimals(x)) for x in ids], pa.string()), pa.array([sha(enc.decode(x)) for x in ids], pa.string())]

    return encode_documents(docs, tokenizer=tokenizer, leaf_chars=leaf_chars, finish=digest, columns="n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", "doc_id")
