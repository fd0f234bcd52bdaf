"""N-gram Jaccard join by token-combination prefixes, and its connected components.

A document's tokens are its distinct five-word shingles. Tokens are ordered globally: rare ones first (class 1, at
most `frequent` documents have them) by document frequency, then frequent ones (class 2) by subclass. A prefix is extended until any
partner must have one class-1 token of it, or two tokens of one subclass; so single tokens are indexed for class 1,
pairs within a subclass for class 2. Sizes are dealt into buckets of which only neighbours can be partners; the number
of subclasses follows the bucket, and a node has the pairs of its own bucket's order and of the next smaller one's.
Candidates are verified by exact overlap.

Steps: equal texts are one node, sent once by each batch of documents that has it (so a hot text is no hot group);
batches send their nodes' token hashes, packed, to shards; a shard keeps the tokens that two or more nodes have, with their frequency (each batch that
has a node counts it), and sends them back by batch. Tokens of one node only can match nothing: they only lengthen the prefix, and a node with enough of
them is out of the join. Links inside a list of equal signatures are found by comparing its members with one hub, then,
across components that are still apart, each node with its nearest candidate, then all candidates that are left, in
tasks that merge components as they find links; so no list is expanded into all pairs. Every link is inside a component,
so links are then counted by comparing all nodes of each component, in tasks that return one sum a node.

Defined results: null, empty and blank texts have no shingles and no links; fewer words than five make one shingle;
equal rows are one component; ties in a hub go to the smallest node. Rows with equal ids and different texts are
different documents under one label. Very long texts are compared whole. An empty table gives no rows. Extra columns are
dropped by similar_groups and kept by keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import WordHashes, chunks, hashes_of, mixed, packed, private, saved, shards, texts_of, tidy, unpacked, windows

from newslake.operators.similarity import components


@dataclass(frozen=True)
class Join:
    """percent: of the union that the intersection must be; frequent: more nodes than this make a token frequent;
    per_subclass: tokens of a bucket's smallest set for each subclass."""

    width: int = 5
    percent: int = 75
    frequent: int = 8
    per_subclass: int = 3


#: Of a shingle's hash, as tokens: in two sets of 20,000, one common by chance has odds of 1 in 10 million.
_BITS = 52


def shingle_sets(held: list[list[bytes]], width: int, seen: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by hash and row."""
    sizes = np.array([len(w) for w in held], np.int64)
    words = [w for row in held for w in row]
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(held)), sizes)
    h = hashes_of(words, seen)
    key = windows(h, width)
    inside = np.flatnonzero(row[: len(key)] == row[width - 1 :]) if len(key) else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    whole = [windows(h[starts[i] : starts[i] + sizes[i]], int(sizes[i]))[0] ^ np.uint64(sizes[i]) for i in short]
    row, key = np.concatenate([row[inside], short]), np.concatenate([key[inside], np.array(whole, np.uint64)])
    order = np.lexsort((row, key)) if len(short) else np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[first], key[first]


#: Bytes of text for each shard of tokens, at most.
_SHARD_BYTES = 16 << 20

_MESSAGE = "shard long, batch long, nodes binary, rows binary, keys binary"


def _messages(nodes: DataFrame, rules: Join, ways: int) -> DataFrame:
    """Packed (row in batch, token) lists by shard, ascending by token; and one row a batch, at shard -1 - batch, with
    the batch's nodes and set sizes."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, number = WordHashes(), TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in _MESSAGE.split(", ")]
        for part in batches:
            ids = part.column(0).to_numpy()
            ids, once = np.unique(ids, return_index=True)
            for first, held in chunks(texts_of(part.column(1), once), lower=True):
                row, key = shingle_sets(held, rules.width, seen)
                key >>= np.uint64(64 - _BITS)
                node = ids[first : first + len(held)]
                count = np.bincount(row, minlength=len(held))
                out = [(-1 - number, number, packed(node), packed(count), b"")]
                cut = np.searchsorted(key, np.array([(i << _BITS) // ways for i in range(1, ways)], np.uint64))
                bounds = [0, *cut.tolist(), len(key)]
                for s in range(ways):
                    a, b = bounds[s], bounds[s + 1]
                    if b > a:
                        delta = np.diff(key[a:b], prepend=np.uint64(0))
                        out.append((s, number, b"", packed(_columns(row[a:b].astype(np.uint32))), packed(_columns(delta))))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)

    return nodes.select("node", "text").mapInArrow(send, _MESSAGE)


def _columns(x: np.ndarray) -> np.ndarray:
    """Numbers by byte position, so that the zero high bytes of small ones compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)


def _small(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpacked(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _delta_keys(data: bytes) -> np.ndarray:
    x = np.ascontiguousarray(unpacked(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64)


_SHARED = "batch long, nodes binary, rows binary, keys binary, counts binary"


def _shared_tokens(messages: DataFrame) -> DataFrame:
    """By batch: the tokens that two nodes or more have, with the number of nodes that have them."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        out = [(b, n, r, b"", b"") for s, b, n, r in zip(group.shard, group.batch, group.nodes, group.rows, strict=True) if s < 0]
        group = group[group.shard >= 0]
        if len(group):
            rows = [_small(x) for x in group.rows]
            keys = np.concatenate([_delta_keys(x) for x in group["keys"]])
            batch = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
            rows, ids = np.concatenate(rows), group.batch.to_numpy()
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            count = np.diff(np.r_[edge, len(ranked)])
            many = np.repeat(count > 1, count)
            count = np.repeat(count, count)[many].astype(np.uint32)
            pick, ranked = order[many], ranked[many]
            owner = batch[pick]
            by = np.argsort(owner, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else []:
                out.append((ids[owner[part[0]]], b"", packed(_columns(rows[pick[part]])), packed(_columns(np.diff(ranked[part], prepend=np.uint64(0)))), packed(_columns(count[part]))))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _SHARED.split(", ")])

    return messages.groupBy("shard").applyInPandas(keep, _SHARED)


_NODE = "node long, size long, own long, signatures array<long>, tokens binary, bits binary"
#: Of a node's bitmap: each token flips one bit, so two bitmaps differ in no more bits than the sets in tokens.
_BITMAP = 1024
#: Members of a list that are compared at once; a longer list is dealt into blocks, and pairs of blocks into tasks.
_BLOCK = 1500
_LIST = ["sign", "i", "j"]
#: Candidates that are verified together; a link found among them spares the rest of its component.
_AT_ONCE = 32
#: Of a component whose links are counted: nodes and tokens of a block, so that two blocks fit a task's memory.
_COUNT_NODES, _COUNT_TOKENS = 2000, 1 << 21


def _signatures(shared: DataFrame, rules: Join) -> DataFrame:
    """One row a node: its set size, and for nodes that can have partners the signatures and shared tokens (sorted)."""

    def signed(group: pd.DataFrame) -> pd.DataFrame:
        head = group[[len(x) > 0 for x in group.nodes]].iloc[0]
        nodes, sizes = unpacked(head.nodes, np.int64), unpacked(head.rows, np.int64)
        rest = group[[len(x) == 0 for x in group.nodes]]
        found = [(_small(r), _delta_keys(k), _small(c)) for r, k, c in zip(rest.rows, rest["keys"], rest.counts, strict=True)]
        row, key, count = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint32), np.empty(0, np.uint64), np.empty(0, np.uint32))
        order = np.lexsort((key, count, row))
        row, key, count = row[order], key[order], count[order]
        starts = np.searchsorted(row, np.arange(len(nodes) + 1))
        out = []
        for i, (node, n) in enumerate(zip(nodes.tolist(), sizes.tolist(), strict=True)):
            a, b = starts[i], starts[i + 1]
            # tokens that no other node has come first in the order and match nothing
            need = n - -(-rules.percent * n // 100) + 1 - (n - (b - a))
            found = (_prefix(key[a:b], count[a:b], n, need, rules), packed(_columns(np.diff(np.sort(key[a:b]), prepend=np.uint64(0)))), _bitmap(key[a:b])) if n and need > 0 else (None, None, None)
            out.append((node, n, n - int(b - a), *found))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _NODE.split(", ")])

    return shared.groupBy("batch").applyInPandas(signed, _NODE)


def _bitmap(key: np.ndarray) -> bytes:
    odd = np.bincount((mixed(key) % np.uint64(_BITMAP)).astype(np.int64), minlength=_BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _dealt(members: DataFrame, tasks: int, blocks: Column | None = None) -> DataFrame:
    """Rows of lists (sign, n members, node, ...) by pairs of blocks i, j of a list, each pair in a task."""
    blocks = F.ceil(F.col("n") / _BLOCK).cast("long") if blocks is None else blocks
    rows = members.withColumn("block", F.pmod("node", blocks)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    return rows.withColumn("task", F.pmod(F.xxhash64("sign", "i", "j"), F.lit(tasks)))


def _candidates(group: pd.DataFrame, component: np.ndarray, rules: Join) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows by list and pair of blocks: a row and the later ones of its list, of other components, that the sizes and
    bitmaps don't rule out, with the least share of their tokens that differs. The caller may merge components between
    the steps.

    With s common tokens, sets of m and n tokens differ in m + n - 2 s; a link needs s >= percent (m + n) / (100 + percent).
    """
    sign, i, j, size, own, block = (group[c].to_numpy() for c in ("sign", "i", "j", "size", "own", "block"))
    bits = np.frombuffer(b"".join(group.bits), "<u8").reshape(len(group), -1)
    edge = np.flatnonzero(np.r_[True, (sign[1:] != sign[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    for a, b in zip(edge, np.r_[edge[1:], len(group)], strict=True):
        for x in range(a, b - 1):
            if (component[x:b] == component[x]).all():
                continue
            y = np.arange(x + 1, b)
            y = y[(component[y] != component[x]) & ((i[x] == j[x]) | (block[y] != block[x]))]
            small, large = np.minimum(size[y], size[x]), np.maximum(size[y], size[x])
            y = y[100 * small >= rules.percent * large]
            if len(y):
                # tokens of one node only are not in the bitmaps, and differ for sure
                differ = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64) + own[y] + own[x]
                both = size[y] + size[x]
                near = (100 + rules.percent) * differ <= (100 - rules.percent) * both
                if near.any():
                    yield x, y[near], differ[near] / both[near]


class _Sets(dict):
    """node -> its sorted tokens, unpacked when asked for; emptied when large, so that a task's memory stays bounded."""

    def __init__(self, data: dict[int, bytes]):
        super().__init__()
        self.data, self.held = data, 0

    def __missing__(self, node: int) -> np.ndarray:
        if self.held > 8 << 20:
            self.clear()
            self.held = 0
        found = self[node] = _delta_keys(self.data[node])
        self.held += len(found)
        return found


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Of a sorted set and others, none of them empty: the sizes of the intersections."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum([len(x) for x in others])[:-1]])


def _nearest(members: DataFrame, rules: Join, tasks: int) -> DataFrame:
    """Of lists as for _across: each node's candidate (a, b) of the least share, over all lists; ties by node."""

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(_LIST, kind="stable")
        node = group.node.to_numpy()
        share, other = np.full(len(group), np.inf), np.zeros(len(group), np.int64)
        for x, y, s in _candidates(group, group.component.to_numpy(), rules):
            k = int(np.argmin(s))
            if s[k] < share[x]:
                share[x], other[x] = s[k], node[y[k]]
            less = s < share[y]
            share[y[less]], other[y[less]] = s[less], node[x]
        found = pd.DataFrame({"node": node, "other": other, "share": share})[np.isfinite(share)]
        return found.sort_values(["node", "share", "other"]).drop_duplicates("node")

    found = _dealt(members, tasks).groupBy("task").applyInPandas(nearest, "node long, other long, share double")
    found = found.groupBy("node").agg(F.min(F.struct("share", "other")).alias("m"))
    return found.select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct()


def _across(members: DataFrame, able: DataFrame, rules: Join, tasks: int) -> DataFrame:
    """Of lists (sign, n members, node, size, own tokens, component, bits): verified links (a, b) that join the
    components of a list's members.

    First each task names the nodes that have a candidate; then it gets the sets of these nodes, once each, and
    compares them. A link merges two components in the task, and members of one component are not compared any
    more; so a task returns fewer links than it has components, however many pairs are alike.
    """

    def named(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(_LIST, kind="stable")
        found = np.zeros(len(group), bool)
        for x, y, _ in _candidates(group, group.component.to_numpy(), rules):
            found[x] = True
            found[y] = True
        return group.loc[found, ["task", "node"]].drop_duplicates()

    def linked(group: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(_LIST, kind="stable")
        node, size, component = group.node.to_numpy(), group["size"].to_numpy(), group.component.to_numpy().copy()
        tokens, out = _Sets(dict(zip(sets.node, sets.tokens, strict=True))), []
        for x, y, _ in _candidates(group, component, rules) if len(group) else ():
            while len(y):
                some, y = y[:_AT_ONCE], y[_AT_ONCE:]
                common = _overlaps(tokens[node[x]], [tokens[node[k]] for k in some])
                for k in some[100 * common >= rules.percent * (size[some] + size[x] - common)]:
                    if component[k] != component[x]:
                        component[component == component[k]] = component[x]
                        out.append((node[x], node[k]))
                y = y[component[y] != component[x]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = _dealt(members, tasks)
    names = saved(rows.groupBy("task").applyInPandas(named, "task long, node long"))
    sets = names.join(able.select("node", "tokens"), "node")
    rows = rows.join(names, ["task", "node"], "left_semi")
    return rows.groupBy("task").cogroup(sets.groupBy("task")).applyInPandas(linked, "a long, b long").distinct()


def _buckets(n: int, percent: int) -> list[tuple[int, int]]:
    """(bucket, its least size) of a set of n tokens and of the next smaller bucket; partners are in one or neighbours."""
    k, low, before = 0, 1, None
    while (high := low * 100 // percent + 1) <= n:
        k, low, before = k + 1, high, (k, low)
    return [(k, low)] + ([before] if before else [])


def _prefix(key: np.ndarray, count: np.ndarray, n: int, need: int, rules: Join) -> list[int]:
    """Signatures that cover `need` more tokens of a set of n, given its shared tokens by frequency."""
    single = int(np.searchsorted(count, rules.frequent, "right"))
    signs = [key[: min(single, need)]]
    need -= single
    if need > 0 and n == 1:
        signs.append(mixed(key + np.uint64(1)))  # only the same one-token set can match
    elif need > 0:
        for bucket, low in _buckets(n, rules.percent):
            sub = mixed(key[single:] + np.uint64(bucket)) % np.uint64(max(1, low // rules.per_subclass))
            order = np.lexsort((key[single:], count[single:], sub))
            token, sub, left, at = key[single:][order], sub[order], need, 0
            while left > 0 and at < len(token):
                end = int(np.searchsorted(sub, sub[at], "right"))
                take = token[at : min(end, at + left + 1)]
                first, second = np.triu_indices(len(take), 1)
                pair = mixed(np.minimum(take[first], take[second])) + np.maximum(take[first], take[second])
                signs.append(mixed(pair + np.uint64(bucket)))
                left -= len(take) - 1
                at = end
            assert left <= 0, "a prefix must cover what a partner may lack"
    return np.concatenate(signs).view(np.int64).tolist()


def _verified(pairs: DataFrame, nodes: DataFrame, rules: Join) -> DataFrame:
    """Of pairs (a, b), those whose sets meet the threshold."""

    @F.pandas_udf("long")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        last: tuple = (None, None)
        out = []
        for p, q in zip(x, y, strict=True):
            if p != last[0]:
                last = (p, _delta_keys(p))
            both = np.concatenate([last[1], _delta_keys(q)])
            both.sort(kind="stable")
            out.append(int(np.count_nonzero(both[1:] == both[:-1])))
        return pd.Series(out, dtype="int64")

    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("tokens").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("tokens").alias("y"))
    rows = pairs.join(right, "b").join(left, "a")
    # a partner is at least percent of the other's size
    rows = rows.where(f"100 * least(m, n) >= {rules.percent} * greatest(m, n)").withColumn("common", overlap("x", "y"))
    return rows.where(f"100 * common >= {rules.percent} * (m + n - common)").select("a", "b")


def _lists(signed: DataFrame) -> DataFrame:
    """(sign, hub, n, node): the nodes of each signature that two or more have, with the smallest one and their number.

    Signatures with the same nodes (the tokens of one shared passage, say) are one list: the same hub, number and hash
    over the nodes' hashes. Counted before they are shuffled, so that a signature most nodes have is no hot group.
    """
    posted = signed.where("signatures is not null").select("node", F.explode("signatures").alias("sign")).distinct()
    lists = posted.groupBy("sign").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
    lists = lists.where("n > 1").groupBy("hub", "n", "who").agg(F.min("sign").alias("sign")).drop("who")
    return posted.join(lists, "sign").select("sign", "hub", "n", "node")


def _apart(posted: DataFrame, group: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Lists whose members are still in several components."""
    label = posted.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = label.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return label.join(apart.select("sign"), "sign", "left_semi").drop("hub").join(bitmaps, "node")


def _linked_rows(sets: list[np.ndarray], size: np.ndarray, copies: np.ndarray, side: np.ndarray | None, rules: Join) -> np.ndarray:
    """For each of the sets, the copies of the others that it is linked to; with sides, of those of the other side only.

    Sets are compared by their common tokens alone: each one's tokens call up all later holders of the same tokens.
    """
    n, out = len(sets), np.zeros(len(sets), np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in sets])
    key = np.concatenate(sets)
    order = np.argsort(key, kind="stable")  # of one token, holders ascend
    key, holder = key[order], owner[order]
    ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    last = np.repeat(ends, np.diff(np.r_[0, ends]))
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    stop = last[place]
    bounds = np.r_[0, np.cumsum([len(x) for x in sets])]
    for x in range(n - 1):
        a, b = place[bounds[x] : bounds[x + 1]] + 1, stop[bounds[x] : bounds[x + 1]]
        runs = b - a
        total = int(runs.sum())
        if total:
            at = np.repeat(a - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(total)
            common = np.bincount(holder[at], minlength=n)
            hit = (common > 0) & (100 * common >= rules.percent * (size + size[x] - common))
            if side is not None:
                hit &= side != side[x]
            out[x] += copies[hit].sum()
            out[hit] += copies[x]
    return out


def _counted(flat: DataFrame, able: DataFrame, rules: Join, tasks: int) -> DataFrame:
    """(node, linked): the rows of other nodes that a node's rows are linked to, of flat (node, size, component, copies,
    grouped: whether it has links).

    Components are dealt by pairs of blocks of their nodes, so that a large one is spread over tasks; sets come last, by
    node. The two nodes of a component of two are linked, so these are not compared.
    """

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([*_LIST, "node"], kind="stable")
        sign, i, j, size, node, rows, block = (part[c].to_numpy() for c in ("sign", "i", "j", "size", "node", "copies", "block"))
        edge = np.flatnonzero(np.r_[True, (sign[1:] != sign[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(part) else []
        linked = np.zeros(len(part), np.int64)
        data = part.tokens.to_numpy()
        for a, b in zip(edge, np.r_[edge[1:], len(part)].astype(np.int64), strict=True):
            sets = [_delta_keys(x) for x in data[a:b]]
            linked[a:b] = _linked_rows(sets, size[a:b], rows[a:b], None if i[a] == j[a] else block[a:b], rules)
        return pd.DataFrame({"node": node, "linked": linked})

    group = flat.where("grouped").select("node", "size", "copies", F.col("component").alias("sign"))
    sums = group.groupBy("sign").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.sum("copies").alias("held"))
    rows = saved(group.join(sums, "sign"))
    pairs = rows.where("n = 2").select("node", (F.col("held") - F.col("copies")).alias("linked"))
    blocks = F.greatest(F.ceil(F.col("n") / _COUNT_NODES), F.ceil(F.col("all") / _COUNT_TOKENS)).cast("long")
    large = _dealt(rows.where("n > 2").drop("held"), tasks, blocks).join(able.select("node", "tokens"), "node")
    found = large.groupBy("task").applyInPandas(counted, "node long, linked long")
    return pairs.union(found).groupBy("node").agg(F.sum("linked").alias("linked"))


def _grouped(docs: DataFrame, rules: Join, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, node); their nodes (node, size, component: a node, least doc_id, copies, grouped: whether they have
    links); and the sets of nodes that can have links."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    members = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    nodes = members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # a shard's part grows with the session's setting or, where that is small, with the texts
    size = members.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ways = max(2 * shards(spark), -(-size // _SHARD_BYTES))
    signed = saved(_signatures(_shared_tokens(_messages(members, rules, ways)), rules))
    sizes = signed.groupBy("node").agg(F.first("size").alias("size"))
    # a node that several batches have comes from each of them, alike
    able = signed.where("tokens is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    bitmaps = signed.where("bits is not null").groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "own", "bits")))
    posted = saved(_lists(signed))
    stars = posted.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(_verified(stars, able, rules))
    # of lists whose members are in several components, first each node's nearest candidate, then all that are left
    tasks = 4 * shards(spark)
    links = saved(links.union(_verified(_nearest(_apart(posted, components(links, saved), bitmaps), rules, tasks), able, rules)))
    links = saved(links.union(_across(_apart(posted, components(links, saved), bitmaps), able, rules, tasks)).distinct())
    group = components(links, saved)
    # empty sets (size 0) stay apart
    flat = nodes.join(sizes, "node").join(group, "node", "left").withColumn("grouped", F.col("component").isNotNull())
    return members.select("doc_id", "node"), saved(flat.withColumn("component", F.coalesce("component", "node"))), able


def similar_groups(docs: DataFrame, rules: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (the
    number of other rows that the row is linked to, those of its own text among them; 0 without shingles)."""
    with tidy(docs.sparkSession):
        members, flat, able = _grouped(docs, rules, id_col, text_col)
        degree = saved(_counted(flat, able, rules, 4 * shards(docs.sparkSession)))
    # a component's label is the smallest doc_id of its nodes; of empty sets, each row its own
    smallest = flat.groupBy("component").agg(F.min("least").alias("component_id"))
    flat = flat.join(smallest, "component").join(degree, "node", "left")
    count = F.when(F.col("size") == 0, 0).otherwise(F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long")
    rows = members.join(flat.select("node", "size", "component_id", count.alias("n_links")), "node")
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), "n_links")


def keep_one(docs: DataFrame, rules: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (nulls last), and of its texts the one of least hash.

    Rows are told apart by id and text, so equal ids and null ids lose nothing else; of rows with equal id and text any one
    stays. Rows without shingles all stay. Columns unchanged.
    """
    name, label = private("node"), private("id")
    with tidy(docs.sparkSession):
        _, flat, _ = _grouped(docs, rules, id_col, text_col)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("m")
    kept = flat.where("size > 0").groupBy("component").agg(best).select(F.col("m.node").alias(name), F.col("m.least").alias(label))
    blank = ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(~blank).withColumn(name, F.xxhash64(F.col(text_col))).join(kept, name)
    rows = rows.where(F.col(id_col).eqNullSafe(F.col(label))).dropDuplicates([name])
    return rows.select(*docs.columns).union(docs.where(blank))
