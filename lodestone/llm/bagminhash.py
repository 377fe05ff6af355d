"""Near-duplicate documents by BagMinHash over multisets of word shingles.

Similarity is the weighted Jaccard of the multisets of five-word shingles (a text of one to four words is
one shingle); documents with at least SIMILARITY are linked, and a class is what links connect.

1. Signatures. For each distinct shingle and each dyadic block [0,1), [1,2), [2,4), [4,8) ... of its count a
   Poisson process runs with a rate proportional to the block's size. Its points carry a time, a signature
   component and a location in the block; a point counts if its location lies under the count, so a block
   that is covered in part is thinned and counts up to c cost log c processes. Component k holds the
   identity of the earliest point: two documents agree on it with probability equal to their similarity.
   Processes stop at the time by which all components of the document have a point.
2. Identical multisets collapse first, by a 128-bit content key (map-side combined), into one text, which gets a
   number of its own, in the order of the smallest doc_ids.
3. Bands. ROWS components make a band key; BANDS of them catch a pair at the threshold but for
   (1 - 0.8^4)^20 = 3e-5, and more similar ones still more surely.
4. Links. First each bucket offers its smallest member, the hub, to all others: one pair a member, distinct
   over buckets, checked exactly on the multisets. Only buckets whose members these links leave in more than
   one component go on. Of those with at most SMALL members the remaining pairs are checked one by one. The
   members of a larger one are dealt into blocks of about BLOCK texts and BLOCK_SHINGLES shingles; each pair of
   blocks is one group, small whatever the bucket's size, in which a matrix product counts what all pairs have
   in common and which answers with a spanning forest. So every pair that shares a band is checked or already
   connected, and no group's pairs are ever rows.
5. Components by smallest label with pointer jumping, on tables in the shared folder.

Hot keys: copies are gone before banding, and hubs come from map-side combined minima. Where many rows meet one
row of a key (copies and their class, neighbours and their hub's label), the keys' counts are known: the hot ones,
of which there can only be few, are broadcast, the others shuffle (common.join_counted). Nothing is collected. A
bucket of n mutually unlinked texts costs n^2 / BLOCK rows of block input, spread over as many groups.

Defined cases: null and empty texts are alone in their class (with those of the same doc_id); texts without words
but with other characters match only equal texts; null doc_ids are left out. Rows that repeat a doc_id are rows of
their own: each is in the class of its text. A text of any length is one multiset; a pair of texts and a block of
them must fit in a task's memory. An empty table gives no rows. Extra columns are not read; ``keep_one`` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_rows, discard, join_counted, named, ready, sized, written
from lodestone.llm.words import mix, raw, tokens, windows
from lodestone.scratch import numbered

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
M = BANDS * ROWS
#: Largest bucket whose pairs are checked singly; members and shingles (on average) of a block of a larger one.
SMALL, BLOCK, BLOCK_SHINGLES = 8, 256, 1 << 20
_G = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Points drawn at once, over all processes that still run.
DRAW = 1 << 16


def multisets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each element, element, count), elements in order within a row."""
    for t in tokens(col):
        n = len(t.offsets) - 1
        each = np.diff(t.offsets)
        h, row, _ = windows(t.hashes, t.offsets, SHINGLE)
        for k in range(1, SHINGLE):
            short = np.flatnonzero(each == k)
            if len(short):
                one = np.full(len(short), k, np.uint64)
                for j in range(k):
                    one = mix(one * _G + t.hashes[t.offsets[short] + j])
                h, row = np.concatenate([h, one]), np.concatenate([row, short])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield t.first, n, row[at], h[at], np.diff(np.append(at, len(h)))


def sign(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """rows x M identities (uint32) of the earliest points; rows without elements get zeros."""
    best = np.full((rows, M), _NONE)
    total = np.bincount(row, count, rows)
    blocks = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # blocks that begin under the count
    which = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    b_row, b_count = np.repeat(row, blocks), np.repeat(count, blocks).astype(np.float64)
    start = np.where(which > 0, 2.0 ** np.maximum(which - 1, 0), 0.0)
    length = np.maximum(start, 1.0)
    cover = np.minimum(b_count - start, length)
    seed = mix(np.repeat(element, blocks) + (which.astype(np.uint64) + np.uint64(1)) * _G)
    limit = (np.log(M) + 6) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        on = np.flatnonzero(todo[b_row])
        s, r, size, part, x, drawn = seed[on], b_row[on], length[on], cover[on], np.zeros(len(on)), 0
        while len(s):
            width = int(min(max(DRAW // len(s), 1), 256))
            steps = np.arange(drawn + 1, drawn + width + 1, dtype=np.uint64)
            z = mix(s[:, None] + steps * _G)
            gaps = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * M)[:, None]
            gaps[:, 0] += x
            t = np.cumsum(gaps, axis=1)
            z = mix(z ^ _G)
            good = (t <= limit[r][:, None]) & ((z >> np.uint64(32)).astype(np.float64) * 2.0**-32 * size[:, None] < part[:, None])
            i, j = np.nonzero(good)
            mark = (t[i, j].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(z[i, j]) & np.uint64(0xFFFFFFFF))
            np.minimum.at(best.reshape(-1), r[i] * M + (z[i, j] & np.uint64(0xFFFFFFFF)).astype(np.int64) % M, mark)
            drawn += width
            last = t[:, -1]
            go = last <= limit[r]
            if drawn > 8 and go.any():  # a document whose components are all set needs nothing later than the latest
                live = np.unique(r[go])
                worst = best[live].max(axis=1)
                done = worst != _NONE
                latest = (worst[done] >> np.uint64(32)).astype(np.uint32).view(np.float32).astype(np.float64)
                limit[live[done]] = np.minimum(limit[live[done]], latest * (1 + 1e-6))
                go = last <= limit[r]
            s, r, size, part, x = s[go], r[go], size[go], part[go], last[go]
        todo &= (best == _NONE).any(axis=1)
        limit[todo] *= 2
    best[total == 0] = 0
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS keys (int64); a key holds its band's number."""
    s = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for k in range(ROWS):
        key = mix(key * _G + s[:, :, k])
    return key.view(np.int64)


def content_keys(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """rows x 2 sums of hashes over the elements with their counts."""
    out = np.zeros((rows, 2), np.uint64)
    each = np.bincount(row, minlength=rows)
    full = np.flatnonzero(each)
    if len(full):
        starts = (np.cumsum(each) - each)[full]
        for k in range(2):
            out[full, k] = np.add.reduceat(mix(mix(element + np.uint64(k + 1)) + count.astype(np.uint64) * _G), starts)
    return mix(out)


def _keyed(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple]:
    """(first row, rows, keys, whether without words, row of each element, element, count) for groups of rows.

    A text without words has its bytes as content; the empty one has its doc_id.
    """
    data, offsets = raw(texts)
    for first, n, row, element, count in multisets(texts):
        key, own = content_keys(row, element, count, n), ids[first : first + n]
        bare = np.bincount(row, minlength=n) == 0
        for i in np.flatnonzero(bare):
            text = data[offsets[first + i] : offsets[first + i + 1]]
            if len(text):
                pad = np.zeros(-(-len(text) // 8) * 8, np.uint8)
                pad[: len(text)] = text
                w = mix(pad.view(np.uint64) + (np.arange(len(pad) // 8, dtype=np.uint64) + np.uint64(len(text))) * _G)
                key[i] = mix(np.array([w.sum(dtype=np.uint64), (w * w).sum(dtype=np.uint64)]))
            else:
                key[i] = np.array([own[i], -1]).astype(np.int64).view(np.uint64)
        yield first, n, np.ascontiguousarray(key.T).view(np.int64), bare, row, element, count


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the content key), bands array<bigint>, null for a text without words."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, n, key, bare, row, element, count in _keyed(ids, batch.column(1)):
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sign(row, element, count, n)).ravel()), BANDS).cast(pa.list_(pa.int64()))
                bands = pc.if_else(pa.array(~bare), bands, pa.scalar(None, bands.type))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + n]), pa.array(key[0]), pa.array(key[1]), bands], ["doc_id", "k1", "k2", "bands"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, size, set binary) for texts (node, doc, k1, k2): the multiset as sorted hashes of (shingle, occurrence).

    Only documents whose doc_id one of the texts names are read again, and of these the rows with its content.
    """
    wanted = docs.select("doc_id", "text").join(sized(nodes.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, key, _, row, element, count in _keyed(batch.column(0).to_numpy(), batch.column(1)):
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                h, own = mix(np.repeat(element, count) + nth.astype(np.uint64) * _G), np.repeat(row, count)
                at = np.searchsorted(own, np.arange(n + 1))
                sets = [np.sort(h[at[i] : at[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(np.diff(at)), pa.array(sets, pa.binary())], ["k1", "k2", "size", "set"])

    sets = wanted.mapInArrow(run, "k1 bigint, k2 bigint, size bigint, set binary").dropDuplicates(["k1", "k2"])
    return sets.join(nodes.select(F.col("node").alias("id"), "k1", "k2"), ["k1", "k2"]).select("id", "size", "set")


def _linked(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets reach the similarity."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_sets(docs, texts.select("node", "doc", "k1", "k2").join(sized(ids), "node")), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common >= SIMILARITY * (len(both) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    got = written(both.mapInArrow(run, "a bigint, b bigint"), "links")
    discard(sets)
    return got


def _rooted(up: DataFrame) -> DataFrame:
    """(node, parent, ..) with the parent's parent, and so on, as parent: pointer jumping, in as many steps as the depth has bits."""
    while True:
        heads = up.groupBy("parent").agg(F.count("*").alias("rows")).join(up.select(F.col("node").alias("parent"), F.col("parent").alias("its")), "parent")
        step = written(join_counted(up, heads, ["parent"], "rows").select("node", "na", "nb", F.col("its").alias("parent"), (F.col("its") != F.col("parent")).alias("moved")), "up")
        moved = not step.where("moved").isEmpty()
        discard(up)
        up = step.drop("moved")
        if not moved:
            return up


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of a link the smallest node that links connect it to.

    Each round takes every node to the end of the chain of its smallest neighbours and keeps of the links only those
    between such ends, so that a round has at most half the nodes of the one before and a star is done at once.
    """
    edges, rounds = written(links.select("a", "b").where("a <> b").distinct(), "edges"), []
    while True:
        one, none = F.lit(1), F.lit(0)
        ways = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), one.alias("na"), none.alias("nb"))
        ways = ways.union(edges.select(F.col("b"), F.col("a"), none, one))
        up = ways.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
        rounds.append(up := _rooted(written(up, "up")))
        a = up.where("na > 0").select(F.col("node").alias("a"), F.col("parent").alias("x"), "na")
        b = up.where("nb > 0").select(F.col("node").alias("b"), F.col("parent").alias("y"), "nb")
        left = join_counted(join_counted(edges, a, ["a"], "na"), b, ["b"], "nb").where("x <> y")
        left = written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(edges)
        edges = left
        if edges.isEmpty():
            break
    labels = rounds[0].select("node", F.col("parent").alias("label"))
    for up in rounds[1:]:
        ends = labels.groupBy("label").agg(F.count("*").alias("rows")).join(up.select(F.col("node").alias("label"), F.col("parent").alias("its")), "label", "left")
        labels = join_counted(labels, ends, ["label"], "rows").select("node", F.coalesce("its", "label").alias("label"))
    return labels


def _forest(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links between these documents connect (within a side only if there is one side)."""
    n = len(nodes)
    size = np.array([len(x) for x in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for at in range(0, column.max() + 1, 8192):  # columns are in order
            own = slice(np.searchsorted(column, at), np.searchsorted(column, at + 8192))
            m = np.zeros((n, 8192), np.float32)
            m[owner[own], column[own] - at] = 1
            common += m @ m.T
    link = common >= SIMILARITY * (size[:, None] + size[None, :] - common)
    if len(np.unique(side)) > 1:
        link &= side[:, None] != side[None, :]
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    other = np.flatnonzero(root != np.arange(n))
    return nodes[root[other]], nodes[other]


def _blocks(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """Links (a, b) within large buckets, from rows (key, node, set) and each bucket's number of blocks (key, nb)."""
    rows = rows.join(sized(dealt), "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("nb")).cast("int"))
    rows = rows.select("key", "node", "own", "set", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "own", "set")

    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        a, b = _forest(node, group.column("own").to_numpy(), sets)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables in the shared folder: (doc_id, k1, k2) of each row with a doc_id, and of each content key
    (k1, k2, n rows, class_id, keeper: the doc_id that stands for the class if it is with this text, else null)."""
    signed = written(signatures(docs), "signed")
    # one text for each content key, the bands of which are the same in all its rows
    texts = written(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("bands").alias("bands")), "texts")
    # texts are numbered in the order of their doc_ids: by these themselves, unless several texts have the same one
    if texts.groupBy("doc").count().where("count > 1").isEmpty():
        texts = texts.withColumn("node", F.col("doc"))
    else:
        texts = written(numbered(texts.orderBy("doc", "k1", "k2"), "node"), "texts")
    buckets = texts.where("bands is not null").select(F.explode("bands").alias("key"), "node")
    shared = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("n")).where("hub < top")
    live = written(buckets.join(shared.select("key", "hub", "n"), "key"), "live")
    pairs = written(live.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = _linked(pairs, texts, docs)
    labels = components(links)
    now = live.join(labels, "node", "left").select("key", "n", "node", F.coalesce("label", "node").alias("label"))
    unclear = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    now = written(now.join(unclear, "key"), "unclear")
    discard(live)
    small = now.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("m"))
    each = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["label"] != x["label"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    rest = written(small.select(F.explode(each).alias("p")).select("p.a", "p.b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = _linked(rest, texts, docs)
    large = now.where(F.col("n") > SMALL).select("key", "n", "node")
    sets = written(_sets(docs, texts.select("node", "doc", "k1", "k2").join(sized(large.select("node").distinct()), "node")), "sets")
    load = large.join(sets.select(F.col("id").alias("node"), "size"), "node").groupBy("key").agg(F.max("n").alias("n"), F.sum("size").alias("size"))
    dealt = load.select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    block = written(_blocks(large.select("key", "node").join(sets.select(F.col("id").alias("node"), "set"), "node"), dealt), "links")
    found = links.union(more).union(block)
    if not (more.isEmpty() and block.isEmpty()):
        labels = components(found)
    linked = texts.select("node", "k1", "k2", "doc").join(labels, "node")
    best = linked.groupBy("label").agg(F.min(F.struct("doc", "k1", "k2")).alias("best"), F.count("*").alias("rows"))
    own = join_counted(linked, best, ["label"], "rows").select("node", F.col("best.doc").alias("class"), (F.col("best") == F.struct("doc", "k1", "k2")).alias("first"))
    classed = texts.select("node", "k1", "k2", "n", "doc").join(own, "node", "left")
    classed = written(classed.select("k1", "k2", "n", F.coalesce("class", "doc").alias("class_id"), F.when(F.coalesce("first", F.lit(True)), F.col("doc")).alias("keeper")), "classed")
    for x in (pairs, rest, now, sets, found, texts):
        discard(x)
    return signed.select("doc_id", "k1", "k2"), classed


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: one row for each row of ``docs`` with a doc_id; class_id is the smallest doc_id of its class.

    Only where that doc_id is on several rows with different texts can two classes have the same name.
    """
    rows, classed = text_classes(docs)
    return join_counted(rows, classed.drop("keeper"), ["k1", "k2"]).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with its columns; rows without doc_id stay.

    It is the row with the smallest doc_id of the class; of rows that have this doc_id and texts of the class, one
    with the least content key, and of those with the same content the one whose columns have the least hash.
    """
    rows, classed = text_classes(docs)
    fate = join_counted(rows, classed.drop("class_id"), ["k1", "k2"]).select("doc_id", F.coalesce(F.col("keeper") == F.col("doc_id"), F.lit(False)).alias("stays"))
    ids = written(fate.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("stays").alias("stays")).where("rows > 1 or not stays"), "fates")
    names = docs.columns
    kept = docs.join(sized(ids.select("doc_id")), "doc_id", "left_anti").select(*map(named, names))
    twice = ids.where("rows > 1 and stays").select("doc_id")
    if twice.isEmpty():
        return kept
    # rows that share their doc_id: by their content, which is computed again for them alone
    again = docs.join(sized(twice), "doc_id", "left_semi").select(*map(named, names))
    again = by_rows(again, names, [F.col("doc_id"), F.col("text")], "_k1 bigint, _k2 bigint", lambda: _content)
    again = again.toDF(*(f"c{i}" for i in range(len(names))), "k1", "k2").withColumn("doc", F.col(f"c{names.index('doc_id')}"))
    right = classed.where("keeper is not null").select("k1", "k2", F.col("keeper").alias("doc"))
    columns = [f"c{i}" for i in range(len(names))]
    again = again.join(right, ["doc", "k1", "k2"], "left_semi").groupBy("doc", "k1", "k2").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return kept.unionAll(again.select("row.*"))


def _content(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    key = [k for _, _, k, *_ in _keyed(ids.to_numpy(), texts)]
    both = np.concatenate(key, axis=1) if key else np.zeros((2, 0), np.int64)
    return [pa.array(both[0]), pa.array(both[1])]
