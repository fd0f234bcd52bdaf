"""LM scoring with an n-gram model held in Elias-Fano trie shards.

The model is a bigram model with Dirichlet smoothing towards the unigrams: p(w|v) = (c(vw) + m p(w)) / (c(v) + m) and
p(w) = (c(w) + 1) / (N + V + 1). Log probabilities of seen pairs are stored, quantised to 16 bits, in the trie; an
unseen pair backs off to m p(w) / (c(v) + m).

The model grows with the corpus, so no machine holds it whole: a batch of documents sends its distinct words, then its
distinct pairs, to shards by key (each key once a batch, so that a hot word is no hot group; a context's successors are
spread over several shards). A shard adds up the counts, builds its memory-mapped levels, answers each batch's pairs by
context-relative successor search, and the answers go back to the batch.

Null and empty texts are the end token alone. Very long texts are scored whole. Repeated rows, and rows of equal or null
ids, are scored each for itself. With no training row every count is 0; ties need no rule. An empty table gives no rows.
Extra columns are dropped, whatever their names. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import WordHashes, chunks, hashes_of, mixed, packed, saved, shards, texts_of, unpacked
from newslake.llm.elias_fano import TrieShard

#: The end token's hash; no word is empty, so none has the text it stands for.
END = WordHashes()[b""]
_BATCH_TOKENS = 3 << 19


@dataclass(frozen=True)
class Model:
    """mass: m of the smoothing; spread: over how many shards a context's successors are dealt; step: codes per decade."""

    mass: float = 200.0
    spread: int = 16
    step: int = 4096


def _wide(x: np.ndarray) -> bytes:
    """64-bit numbers by byte position, compressed: the zero high bytes of small ones vanish."""
    return packed(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T))


def _narrow(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


_BATCH = "batch long, ids binary, held binary, sizes binary, tokens binary, words binary, counts binary"


def _batches(docs: DataFrame) -> DataFrame:
    """Documents by batches: tokens as ranks of the batch's distinct words by frequency (so that most are small numbers and
    pack tightly); the words' hashes ascending, and their counts, which give the ranks."""

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, number = WordHashes(), TaskContext.get().partitionId() << 32
        for part in parts:
            ids = pc.fill_null(part.column(0), 0).to_numpy()
            # bit 0: held out, bit 1: no id
            flags = part.column(1).to_numpy(zero_copy_only=False) + 2 * part.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, held in chunks(texts_of(part.column(2)), lower=True, most=_BATCH_TOKENS):
                sizes = np.array([len(w) + 1 for w in held], np.int64)
                h = np.full(int(sizes.sum()), END, np.uint64)
                inside = np.ones(len(h), bool)
                inside[np.cumsum(sizes) - 1] = False
                h[inside] = hashes_of([w for row in held for w in row], seen)
                words, tokens = np.unique(h, return_inverse=True)
                counts = np.bincount(tokens, minlength=len(words))
                rank = np.empty(len(words), np.int64)
                rank[_by_frequency(counts)] = np.arange(len(words))
                rows = slice(first, first + len(held))
                out = [number, packed(ids[rows]), packed(flags[rows].astype(np.uint8)), packed(sizes), _wide(rank[tokens]), _wide(np.diff(words, prepend=np.uint64(0))), _wide(counts)]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[x.split()[0] for x in _BATCH.split(", ")])

    return docs.mapInArrow(gather, _BATCH)


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """Places of words, the most frequent first, ties in their order."""
    return np.argsort(-counts, kind="stable")


class _Batch:
    def __init__(self, row):
        flags = unpacked(row.held, np.uint8)
        self.ids = pd.arrays.IntegerArray(unpacked(row.ids, np.int64).copy(), flags & 2 > 0)
        self.held, self.sizes = flags & 1 > 0, unpacked(row.sizes, np.int64)
        self.words = np.cumsum(_narrow(row.words), dtype=np.uint64)
        self.tokens = _by_frequency(_narrow(row.counts).astype(np.int64)).astype(np.uint32)[_narrow(row.tokens)]
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def shard_bounds(self, ways: int) -> list[int]:
        return [0, *np.searchsorted(self.words, np.array([(i << 64) // ways for i in range(1, ways)], np.uint64)).tolist(), len(self.words)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (previous, word) of the batch as word * previous codes ascending, each token's place among them, and
        training counts. A document's first token follows the end token."""
        end = np.searchsorted(self.words, np.uint64(END))
        before = np.r_[np.uint32(end), self.tokens[:-1]] if len(self.tokens) else self.tokens
        before[np.r_[0, np.cumsum(self.sizes)[:-1]]] = end
        code = before.astype(np.uint64) * np.uint64(len(self.words)) + self.tokens
        pairs, place = np.unique(code, return_inverse=True)
        return pairs, place, np.bincount(place[~self.held[self.row]], minlength=len(pairs))


_MESSAGE = "shard long, batch long, x binary, y binary, z binary, more binary"


def _rows(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _word_messages(batches: DataFrame, ways: int) -> DataFrame:
    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                b = _Batch(row)
                count = np.bincount(b.tokens[~b.held[b.row]], minlength=len(b.words))
                cut = b.shard_bounds(ways)
                delta = np.diff(b.words, prepend=np.uint64(0))
                out = []
                for s, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                    if j > i:
                        d = delta[i:j].copy()
                        d[0] = b.words[i]
                        out.append((s, row.batch, _wide(d), _wide(count[i:j]), b"", b""))
                yield _rows(out, _MESSAGE)

    return batches.mapInPandas(send, _MESSAGE)


_ANSWER = "batch long, kind long, shard long, x binary, y binary, total long, types long"


def _word_answers(messages: DataFrame, ways: int) -> DataFrame:
    """By batch and shard: places (ascending, as differences) of the batch's words among the shard's, and their training
    counts; kind -1 has a shard's totals."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(_narrow(x), dtype=np.uint64) for x in group.x]
        counts = np.concatenate([_narrow(x) for x in group.y]).astype(np.int64)
        words, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(words)).astype(np.int64)
        shard, at, out = int(group.shard.iloc[0]), 0, []
        for batch, k in zip(group.batch, keys, strict=True):
            mine = place[at : at + len(k)]
            out.append((batch, 0, shard, _wide(np.diff(mine, prepend=0)), _wide(total[mine]), 0, 0))
            at += len(k)
        out.append((-1, -1, shard, b"", b"", int(total.sum()), int(np.count_nonzero(total))))
        return _rows(out, _ANSWER)

    return messages.groupBy("shard").applyInPandas(answer, _ANSWER)


def _known(answers: pd.DataFrame, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ids (place * ways + shard) and counts of a batch's words in their order."""
    rows = answers[answers.kind == 0].sort_values("shard")
    ids = [np.cumsum(_narrow(x), dtype=np.uint64) * np.uint64(ways) + np.uint64(s) for x, s in zip(rows.x, rows.shard, strict=True)]
    return np.concatenate(ids), np.concatenate([_narrow(x) for x in rows.y]).astype(np.int64)


def _shard_of(v: np.ndarray, w: np.ndarray, ways: int, spread: int) -> np.ndarray:
    return (mixed(v * np.uint64(spread) + w % np.uint64(spread)) % np.uint64(ways)).astype(np.int64)


def _pair_messages(batches: DataFrame, answers: DataFrame, ways: int, model: Model) -> DataFrame:
    def send(batch: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        b = _Batch(batch.iloc[0])
        ids, counts = _known(words, ways)
        pairs, _, n = b.pairs()
        v, w = (pairs // np.uint64(len(b.words))).astype(np.int64), (pairs % np.uint64(len(b.words))).astype(np.int64)
        order, cut = _dealt(ids[v], ids[w], ways, model)
        v, w, n, out = v[order], w[order], n[order], []
        for s, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
            if j > i:
                out.append((s, int(batch.batch.iloc[0]), _wide(np.diff(ids[v[i:j]], prepend=np.uint64(0))), _wide(ids[w[i:j]]), _wide(n[i:j]), _wide(np.stack([counts[v[i:j]], counts[w[i:j]]]).ravel()[_training(n[i:j])])))
        return _rows(out, _MESSAGE)

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(send, _MESSAGE)


def _training(n: np.ndarray) -> np.ndarray:
    """Places, in counts of contexts followed by counts of words, of pairs with training counts; others need none."""
    seen = np.flatnonzero(n)
    return np.r_[seen, seen + len(n)]


def _dealt(v: np.ndarray, w: np.ndarray, ways: int, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of ids by (shard, v, w), and where each shard begins."""
    shard = _shard_of(v, w, ways, model.spread)
    order = np.lexsort((w, v, shard))
    return order, np.searchsorted(shard[order], np.arange(ways + 1))


def _pair_answers(messages: DataFrame, total: int, types: int, model: Model) -> DataFrame:
    """By batch and shard: codes of the batch's pairs; and with kind 2 the shard's levels, the model itself."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        asked = [(np.cumsum(_narrow(x), dtype=np.uint64), _narrow(y)) for x, y in zip(group.x, group.y, strict=True)]
        n = [_narrow(x).astype(np.int64) for x in group.z]
        seen = [x > 0 for x in n]
        v, w = (np.concatenate([a[i][s] for a, s in zip(asked, seen, strict=True)]) for i in (0, 1))
        both = [_narrow(x).astype(np.float64).reshape(2, -1) for x in group.more]
        cv, cw, c = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]), np.concatenate([x[s] for x, s in zip(n, seen, strict=True)])
        order = np.lexsort((w, v))
        v, w, cv, cw, c = v[order], w[order], cv[order], cw[order], c[order]
        edge = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.empty(0, np.int64)
        c = np.add.reduceat(c, edge) if len(edge) else c
        p = (c + model.mass * (cw[edge] + 1) / (total + types + 1)) / (cv[edge] + model.mass)
        codes = np.clip(1 + np.rint(-np.log10(p) * model.step), 1, 65535) if len(edge) else np.zeros(0)
        data = TrieShard.build(v[edge], w[edge], codes)
        trie, shard = TrieShard.mapped(data), int(group.shard.iloc[0])
        out = [(batch, 1, shard, packed(trie.lookup(a, b)), b"", 0, 0) for batch, (a, b) in zip(group.batch, asked, strict=True)]
        return _rows([*out, (-1, 2, shard, data, b"", 0, 0)], _ANSWER)

    return messages.groupBy("shard").applyInPandas(answer, _ANSWER)


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, held_out: Column, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scores, levels): a row of _SCORE per row of docs, learnt from the rows that held_out does not mark; and the
    trie's levels by shard."""
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out, F.lit(False)), F.coalesce(F.col(text_col), F.lit("")))
    batches = saved(_batches(rows))
    # a shard's part grows with the session's setting or, where that is small, with the batches
    ways = max(shards(docs.sparkSession), -(-batches.count() // 4))
    words = saved(_word_answers(_word_messages(batches, ways), ways))
    sums = words.where("kind = -1").agg(F.sum("total"), F.sum("types")).first()
    total, types = int(sums[0] or 0), int(sums[1] or 0)
    words = words.where("kind = 0")
    answers = _pair_answers(_pair_messages(batches, words, ways, model), total, types, model)

    def score(batch: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b = _Batch(batch.iloc[0])
        ids, counts = _known(found, ways)
        pairs, place, _ = b.pairs()
        v, w = (pairs // np.uint64(len(b.words))).astype(np.int64), (pairs % np.uint64(len(b.words))).astype(np.int64)
        order, _ = _dealt(ids[v], ids[w], ways, model)
        codes = np.empty(len(pairs), np.uint16)
        codes[order] = np.concatenate([unpacked(x, np.uint16) for x in found[found.kind == 1].sort_values("shard").x])
        base = np.log10((counts + 1) / (total + types + 1))
        backoff = base[w] + np.log10(model.mass / (counts[v] + model.mass))
        logs = np.where(codes > 0, -(codes.astype(np.float64) - 1) / model.step, backoff)
        sums = lambda x: np.bincount(b.row, weights=x, minlength=len(b.sizes))
        return pd.DataFrame({
            "doc_id": b.ids, "held_out": b.held, "n_tokens": b.sizes, "n_known": sums(counts[b.tokens] > 0).astype(np.int64),
            "train_tokens": total, "base_score": sums(base[b.tokens]), "score": sums(logs[place]),
        })

    found = words.union(answers.where("kind = 1"))
    scores = batches.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(score, _SCORE)
    return scores, answers.where("kind = 2").select("shard", F.col("x").alias("levels"))
