"""Shortest-pack-first packing over the histogram of piece lengths.

Texts are tokenised and cut into pieces of at most `size` ids; lengths are placed longest first, each into the open
packs with the most room, updating counts of packs, not single packs; the placements (length, ranks from-to ->
sequences from-to, offset) are then joined back to the pieces by their rank among pieces of equal length.

The histogram has at most `size` bins, so the driver's work has a fixed bound. Null and empty texts have the end id
alone. Repeated rows, and rows of equal or null ids, are packed each for itself. Ranks follow (bucket, id, start), so ties
are broken the same way. Very long texts are tokenised whole and cut into pieces. An empty table has no pieces. Extra
columns are dropped, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.llm.common import private, saved, shards

SIZE, END = 4096, 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The letters of Latin-1, lower-case. Of plain texts (these letters in both cases, ASCII but controls, and line ends) the
#: vocabulary's normaliser only lower-cases; what may hold a special token is not plain.
_LETTERS = "\u00df-\u00f6\u00f8-\u00ff"
_NOT_PLAIN = f"[^ -~\n\u00c0-\u00d6\u00d8-\u00de{_LETTERS}]|<\\|"
#: Fixed value: what the vocabulary's word pattern takes from lower-case plain text beside runs of letters.
_NO_LETTERS = f"('(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \na-z0-9{_LETTERS}]+)"
#: The vocabulary spells a byte with a character; printable ones stand for themselves, the others follow 255 in order.
_PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
_SPELLING = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_SPELLED = {c: "".join(chr(_SPELLING[b]) for b in chr(c).encode()) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
#: Bytes of text that are tokenised at once, or one longer text.
_TEXT_BYTES = 4 << 20
_TOKENIZERS: dict[str, tuple] = {}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins what it parts, so a text's ids are those of its parts in order. A
    plain text is cut into the vocabulary's words by Arrow functions, and each distinct word is encoded by the
    vocabulary's model; another text is cut at white space, and its parts go through the whole tokenizer. The memo of
    parts is emptied when it passes `most` entries or 12 characters an entry, so its memory stays bounded.
    """

    def __init__(self, path: str, most: int = 250_000):
        if path not in _TOKENIZERS:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            _TOKENIZERS[path] = Tokenizer(whole.model), whole
        self.most, self.size, self.memos, (self.model, self.whole) = most, 0, ({}, {}), _TOKENIZERS[path]

    def _learn(self, parts: list[str], plain: bool) -> None:
        memo = self.memos[not plain]
        for i in range(0, len(parts), 20_000):
            some = parts[i : i + 20_000]
            if plain:
                got = self.model.encode([w if w.isascii() else w.translate(_SPELLED) for w in some], is_pretokenized=True, add_special_tokens=False)
            else:
                got = self.whole.encode(some, is_pretokenized=True, add_special_tokens=False)
            word = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
            data, ends = np.array(got.ids, "<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(some)), "right")).tolist()
            memo.update(zip(some, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        self.size += sum(map(len, parts))

    def _cut(self, parts: pa.ListArray, plain: bool) -> Iterator[bytes]:
        """Ids by text, given its parts."""
        flat = parts.flatten().dictionary_encode()
        names, memo = flat.dictionary.to_pylist(), self.memos[not plain]
        if sum(map(len, self.memos)) > self.most or self.size > 12 * self.most:
            self.size = 0
            for m in self.memos:
                m.clear()
        memo[""] = b""
        self._learn([n for n in names if n not in memo], plain)
        found = list(map(memo.__getitem__, names))
        ids = list(map(found.__getitem__, flat.indices.to_numpy().tolist()))
        ends = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            yield b"".join(ids[a:b])

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text in order; nulls are empty. Texts are taken a few at a time."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - 1).clip(0) // _TEXT_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for first, last in zip(edges, edges[1:], strict=False):
            some = texts.slice(first, last - first)
            odd = pc.match_substring_regex(some, _NOT_PLAIN)
            plain = pc.replace_substring_regex(pc.utf8_lower(some.filter(pc.invert(odd))), _NO_LETTERS, r" \1 ")
            streams = [self._cut(pc.split_pattern(pc.replace_substring(x, "\n", " "), " "), x is plain) for x in (plain, some.filter(odd)) if len(x)]
            if len(streams) == 2:
                for is_odd in odd.to_pylist():
                    yield next(streams[is_odd])
            elif streams:
                yield from streams[0]


def encoded(text: Column, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> Column:
    """struct<doc_tokens, pieces array<struct<start, length, ids_crc32[, ids]>>> of each text."""

    @F.arrow_udf("doc_tokens long, pieces array<struct<start: long, length: long, ids_crc32: long" + (", ids: binary" * with_ids) + ">>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tail, step, encoder = end.to_bytes(4, "little"), 4 * size, Encoder(path)
        for texts in batches:
            tokens, counts, rows = [], [], []
            for data in encoder.ids(texts):
                data += tail
                cut = [(i, data[i : i + step]) for i in range(0, len(data), step)]
                tokens.append(len(data) // 4)
                counts.append(len(cut))
                rows += [(i // 4, len(x) // 4, zlib.crc32(x)) + (x,) * with_ids for i, x in cut]
            kinds = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())]
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays(columns, list(kinds)))
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), found], ["doc_tokens", "pieces"])

    return pieces.asNondeterministic()(text)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) of all pieces of the histogram."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids -> runs (first sequence, count)
    free: list[int] = []  # keys of room, ascending
    out, opened = [], 0

    def give(space: int, first: int, count: int) -> None:
        if space and not room[space]:
            bisect.insort(free, space)
        if space:
            room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if free and free[-1] >= length:
                space = free[-1]
                first, count = room[space].pop()
                if not room[space]:
                    free.pop()
                n = min(left, count)
                if n < count:
                    give(space, first + n, count - n)
            else:
                # enough packs that the rest of this length, at as many to a pack as fit, finds room
                space, first, n = size, opened, -(-left // (size // length))
                opened += n
            out.append((length, rank, n, first, size - space))
            give(space - length, first, n)
            rank, left = rank + n, left - n
    return out


def pack(
    docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the ids
    (little-endian 32-bit)."""
    spark = docs.sparkSession
    cells, one = private("cells"), private("one")
    kept = ["start", "length", "ids_crc32"] + ["ids"] * with_ids
    buckets = shards(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), tokenizer or default_tokenizer(), size, end, with_ids).alias(cells))
    rows = rows.select("doc_id", f"{cells}.doc_tokens", F.explode(f"{cells}.pieces").alias(one)).select("doc_id", "doc_tokens", *[f"{one}.{x}" for x in kept])
    rows = saved(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))))
    counts = rows.groupBy("length", "bucket").count()
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = spark.createDataFrame(
        shortest_pack_first(histogram, size) or [(0, 0, 0, 0, 0)], "length long, first_rank long, n long, first_sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("k", F.row_number().over(inside)).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("k") - 1)
    placed = ranked.join(F.broadcast(places), "length").where("rank >= first_rank and rank < first_rank + n")
    return placed.select("doc_id", *kept, "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
