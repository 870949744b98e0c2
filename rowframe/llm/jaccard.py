"""Near-duplicate join on word shingles by a MinHash LSH forest, with exact verification.

*Classes.*  Equal texts are one class (grouped by a digest, combined before the shuffle); only its least document goes on.
*Forest.*  Every class has ``TREES`` signatures of ``DEEPEST`` MinHash values; a tree is the trie of its signatures, kept
as sorted prefixes. A pair of similarity s shares d values in a tree with probability s^d, and so meets in the forest at
depth d with probability 1 - (1 - s^d)^TREES. The join starts at the deepest prefixes, where little but true links meet,
verifies what meets, and weighs every link by its chance of having been met: that says how much of all links the depth
gives. While it is less than ``RECALL``, prefixes are shortened to the longest at which it should be enough, and at
``CUT`` at the last, where even a pair at the threshold is met with that probability.
*Candidates.*  Classes under one trie node belong together. A sender connects what meets among its own classes and sends
one class of a node on, so a node that a third of all classes hold costs one entry a sender; senders and buckets of nodes
give forests of edges, whose connected components are the candidate groups. No pairs are emitted.
*Verification.*  A group of at most ``TILE`` classes meets in one task, and its exact similarities come from one matrix of
intersection counts. Of a larger group every class meets only the group's centre, in tiles that each have a copy of the
centre's text; what goes on is the class's difference from the centre. With R the centre, a = |R - A|, x = |A - R|
and u = q a + p x for the threshold p / q, two classes with u + u' <= (q - p) |R| are linked whatever their differences
are, which a histogram of u counts without comparing any pair. Only pairs beyond that bound compare their differences,
in tiles of ``TILE_BYTES`` of classes of like u; pairs of tiles that the bound settles, or that lie too far apart in
their distance from the centre, are left out. Each class gets its number of links; the links' own components are the
near-duplicate groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowframe.llm import blocks as B
from rowframe.llm import text as X
from rowframe.llm.components import components
from rowframe.llm.durable import durable
from rowframe.llm.rows import brought_back, release, set_aside
from rowframe.ship import ship

#: Words of a shingle, threshold, trees, deepest prefix, share of all links aimed at.
SHINGLE, THRESHOLD, TREES, DEEPEST, RECALL = 5, Fraction(4, 5), 30, 8, 0.9999
#: Classes that are compared whole in one task, bytes of differences in a tile, and what one class counts there at least.
TILE, TILE_BYTES, LEAST_BYTES = 256, 1 << 19, 512
#: Below this many texts, a shingle's pairs are listed; above, they come from a matrix product.
LISTED = 32
#: Classes that a sender of trie nodes holds, and trie nodes of a bucket, about.
SENDER_ROWS, BUCKET_NODES, BUCKETS_MOST = 65536, 1 << 19, 32768
#: Candidates up to which their rows are picked out by a broadcast instead of a shuffle of all texts.
BROADCAST_ROWS = 1 << 17
#: Bins of similarity between the threshold and 1.
BINS = 20


def met(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair meets under a node of that depth."""
    return 1 - (1 - similarity**depth) ** trees


def cut_depth(threshold: Fraction = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets with the wanted probability."""
    depth = DEEPEST
    while depth > 1 and met(float(threshold), depth, trees) < recall:
        depth -= 1
    return depth


def next_depth(links: np.ndarray, depth: int, threshold: Fraction, recall: float = RECALL) -> int:
    """The depth that the links found ask for: ``depth`` itself if it gives the wanted share of all links.

    links: numbers by similarity, in BINS equal bins from the threshold to 1. Each link stands for 1 / met() of its kind;
    without any, the shortest prefix is asked for.
    """
    floor = cut_depth(threshold, recall=recall)
    low = float(threshold)
    s = low + (1 - low) * np.arange(BINS) / BINS
    every = links / np.array([met(v, depth) for v in s])
    for d in range(depth, floor, -1):
        if every.sum() and (every * [met(v, d) for v in s]).sum() >= recall * every.sum():
            return d
    return min(floor, depth)


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each shingle; a document of fewer words, but not none, is one shingle."""
    hashes = X.window_hashes(words, width, 3)
    inside = X.windows_in_one_document(doc, width)
    hashes, owner = hashes[inside], doc[: len(inside)][inside]
    size = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        at = np.searchsorted(doc, short)
        own = []
        for d, a in zip(short.tolist(), at.tolist(), strict=True):
            own.append(X.window_hashes(words[a : a + size[d]], int(size[d]), 3)[0])
        hashes, owner = np.concatenate((hashes, np.array(own, np.uint64))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def _text_shingles(column, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = X.utf8(column)
    for i, j in X.slabs(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, doc = X.word_bounds(part, offsets[i : j + 1] - offsets[i], X.SPACE_BYTES)
        yield i, j, *shingles(X.word_hashes(part, starts, ends), doc, j - i, width)


def _sign(width: int, trees: int, depth: int):
    rng = np.random.default_rng(97)
    factors = rng.integers(1, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    masks = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((trees * depth, batch.num_rows), np.uint16)
            empty = np.ones(batch.num_rows, bool)
            for i, _, hashes, owner in _text_shingles(batch.column(2), width):
                if not len(owner):
                    continue
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                rows = owner[first] + i
                empty[rows] = False
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                turned = np.empty_like(short)
                for k in range(trees * depth):
                    np.bitwise_xor(short, masks[k], out=turned)
                    np.multiply(turned, factors[k], out=turned)
                    least = np.minimum.reduceat(turned, first)
                    values[k, rows] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
            signature = [None if e else v.tobytes() for e, v in zip(empty.tolist(), np.ascontiguousarray(values.T), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signature, pa.binary())], names=["doc", "digest", "signature"])
        release()

    return sign


_SENT = "bucket int, payload binary"


def node_keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """A key of each row's node at ``depth`` in each tree (rows, trees): a hash of the tree and the prefix.

    signatures: (rows, trees, DEEPEST) values. Nodes of equal keys by accident are only candidates too many.
    """
    key = np.broadcast_to(np.arange(1, signatures.shape[1] + 1, dtype=np.uint64), signatures.shape[:2]).copy()
    for k in range(depth):
        key = X.mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, :, k])
    return key


def _joined(keys: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the least node connected with each, and edges (node, that least node) of all other nodes.

    Members of one key are connected, and so are keys with a member in common.
    """
    order = np.argsort(keys, kind="stable")
    keys, member = keys[order], member[order]
    first, size = _runs(keys)
    nodes, own = np.unique(member, return_inverse=True)
    label = least_connected(len(nodes), own, np.repeat(own[first], size))
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return keys[first], nodes[label[own[first]]], np.stack((nodes[far], nodes[label[far]]))


def _meet_at_sender(depth: int, n_buckets: int):
    """Connects members of trie nodes within a sender's rows; sends to a node's bucket the least it is connected with."""

    def send(nodes: list[np.ndarray], signatures: list[bytes]) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, TREES, DEEPEST)
        keys = node_keys(values, depth)
        keys, least, edges = _joined(keys.ravel(), np.repeat(np.concatenate(nodes), TREES))
        buckets, cuts = B.bucket_cuts(keys, n_buckets)
        payloads = [edges.tobytes()] + [keys[a:b].tobytes() + least[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([-1, *buckets.tolist()], pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, signatures, n = [], [], 0
        for batch in batches:
            nodes.append(batch.column(0).to_numpy(zero_copy_only=False))
            signatures += batch.column(1).to_pylist()
            n += batch.num_rows
            if n >= SENDER_ROWS:
                yield send(nodes, signatures)
                nodes, signatures, n = [], [], 0
        if n:
            yield send(nodes, signatures)
        release()

    return meet


def _meet_in_bucket(rows: pa.Table) -> pa.Table:
    parts = rows["payload"].to_pylist()
    _, _, edges = _joined(*B.unpacked(parts, [len(p) // 16 for p in parts], np.uint64, np.int64))
    return pa.table({"a": pa.array(edges[0]), "b": pa.array(edges[1])})


def _unpack_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            edges = np.frombuffer(payload, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each one's component, for edges between the numbers a and b below n."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label, least.copy())
        while True:
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
        if (least == label).all():
            return label
        label = least


def _candidate_groups(classes: DataFrame, n_classes: int, depth: int) -> DataFrame:
    """node, root: the classes that meet another under a node of that depth, by the least of their component."""
    n_buckets = int(min(BUCKETS_MOST, max(16, n_classes * TREES // BUCKET_NODES)))
    sent = durable(classes.select("node", "signature").mapInArrow(_meet_at_sender(depth, n_buckets), _SENT))
    here = sent.where("bucket = -1").select("payload").mapInArrow(_unpack_edges, "a long, b long")
    across = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet_in_bucket, "a long, b long")
    return components(here.unionAll(across), n_classes)


# ------------------------------------------------------------------------------------------------- exact verification


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(sorted_values)))


def intersections(hashes: np.ndarray, owner: np.ndarray, n: int, left: int | None = None) -> np.ndarray:
    """How many hashes each two of n texts share; hashes and owner: distinct (hash, text) pairs.

    With ``left``, only pairs of one of the first ``left`` texts and one of the others count: a matrix (left, n - left).
    """
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    _, count = _runs(hashes)
    lo = 0 if left is None else left
    out = np.zeros((n if left is None else left, n - lo), np.float32)
    wide = np.repeat(count > LISTED, count)
    few_hash, few_owner = hashes[~wide], owner[~wide]
    for step in range(1, LISTED):
        same = few_hash[step:] == few_hash[:-step] if step < len(few_hash) else np.zeros(0, bool)
        if not same.any():
            break
        a, b = few_owner[:-step][same], few_owner[step:][same]
        if left is not None:
            across = (a < left) & (b >= left)
            a, b = a[across], b[across]
        np.add.at(out, (a, b - lo), 1)
    if left is None:
        out += out.T
    which = np.cumsum(np.concatenate(([0], hashes[wide][1:] != hashes[wide][:-1]))) if wide.any() else np.zeros(0, np.int64)
    texts = owner[wide]
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, 512):
        a, b = np.searchsorted(which, (at, at + 512))
        held = np.zeros((min(512, int(which[-1]) + 1 - at), n), np.float32)
        held[which[a:b] - at, texts[a:b]] = 1
        out += held[:, : out.shape[0]].T @ held[:, lo:]
    return out


def _shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text) pairs of a column of texts, by text."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, _, h, o in _text_shingles(column, width):
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        hashes.append(h[new])
        owner.append(o[new] + i)
    return np.concatenate(hashes), np.concatenate(owner)


def _binned(similarity: np.ndarray, threshold: Fraction) -> np.ndarray:
    low = float(threshold)
    return np.bincount(np.clip(((similarity - low) / (1 - low) * BINS).astype(np.int64), 0, BINS - 1), minlength=BINS)


#: links, label: of classes compared whole; u to difference: of classes of larger groups; bins: links by similarity.
_CHECKED = "node long, root long, links long, label long, u long, far double, own long, removed long, centre long, difference binary, bins array<long>"
_CHECKED_ARROW = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("label", pa.int64()), ("u", pa.int64()), ("far", pa.float64()), ("own", pa.int64()), ("removed", pa.int64()), ("centre", pa.int64()), ("difference", pa.binary()), ("bins", pa.list_(pa.int64()))])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node of a partition: rows that repeat do not meet in one task."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        new = ~np.isin(nodes, seen)
        seen = np.union1d(seen, nodes[new])
        yield batch.take(pa.array(np.sort(first[new])))
    release()


def _check(width: int, threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def whole(nodes: np.ndarray, root: int, hashes: np.ndarray, owner: np.ndarray) -> pa.Table:
        n = len(nodes)
        size = np.bincount(owner, minlength=n)
        shared = intersections(hashes, owner, n)
        linked = (p + q) * shared >= p * (size[:, None] + size[None])
        np.fill_diagonal(linked, False)
        a, b = np.nonzero(np.triu(linked))
        bins = _binned(shared[a, b] / (size[a] + size[b] - shared[a, b]), threshold)
        none = [None] * n
        return pa.table([nodes, [root] * n, linked.sum(axis=1), nodes[least_connected(n, a, b)], none, none, none, none, none, none, [bins, *none[1:]]], schema=_CHECKED_ARROW)

    def by_centre(nodes: np.ndarray, root: int, hashes: np.ndarray, owner: np.ndarray) -> pa.Table:
        """Differences of a tile's classes from the centre, which stands among them."""
        at = int(np.flatnonzero(nodes == root)[0])
        centre = hashes[owner == at]
        bounds = np.searchsorted(owner, np.arange(len(nodes) + 1))
        out = [[], [], [], [], []]
        bins = np.zeros(BINS, np.int64)
        for k in range(len(nodes)):
            own = hashes[bounds[k] : bounds[k + 1]]
            difference = np.setxor1d(own, centre, assume_unique=True)
            removed = (len(difference) + len(centre) - len(own)) // 2
            added = len(difference) - removed
            u, far = q * removed + p * added, len(difference) / (len(centre) + added)
            if u <= (q - p) * len(centre) and k != at:
                bins += _binned(np.array([1 - far]), threshold)
            for column, value in zip(out, (u, far, len(own), removed, difference.tobytes()), strict=True):
                column.append(value)
        n, none = len(nodes), [None] * len(nodes)
        return pa.table([nodes, [root] * n, none, none, *out[:4], [len(centre)] * n, out[4], [bins, *none[1:]]], schema=_CHECKED_ARROW)

    def check(rows: pa.Table) -> pa.Table:
        nodes = rows["node"].to_numpy()
        nodes, keep = np.unique(nodes, return_index=True)
        rows = rows.take(pa.array(keep))
        root, tiles = rows["root"][0].as_py(), rows["tiles"][0].as_py()
        hashes, owner = _shingle_sets(rows["text"], width)
        if tiles == 1:
            return whole(nodes, root, hashes, owner)
        made = by_centre(nodes, root, hashes, owner)
        return made if rows["tile"][0].as_py() == 0 else made.filter(pa.array(nodes != root))

    return check


def _settle(rows: pa.Table) -> pa.Table:
    """(root, u, bound, n, bytes) of one group -> place of each u in order, and how many classes it is surely linked with."""
    rows = rows.sort_by("u")
    u, n, size = (rows[c].to_numpy() for c in ("u", "n", "bytes"))
    bound = rows["bound"][0].as_py()
    until = np.concatenate(([0], np.cumsum(n)))
    sure = until[np.searchsorted(u, bound - u, side="right")] - (2 * u <= bound)
    return pa.table({"root": rows["root"], "u": rows["u"], "start": pa.array(np.cumsum(size) - size), "bytes": rows["bytes"], "sure": pa.array(sure)})


def _tile_pairs(threshold: Fraction):
    apart = 1 - float(threshold) + 1e-9

    def pairs(rows: pa.Table) -> pa.Table:
        """The pairs of one group's tiles that neither bound settles: a row for each tile of each pair."""
        rows = rows.sort_by("place")
        place, most, near, far = (rows[c].to_numpy() for c in ("place", "u_most", "near", "far"))
        bound, one, two = rows["bound"][0].as_py(), [], []
        for k in range(len(place)):
            open_ = (most[k] + most[k:] > bound) & (near[k:] - far[k] <= apart) & (near[k] - far[k:] <= apart)
            other = place[k:][open_]
            one.append(np.full(len(other), place[k]))
            two.append(other)
        one, two = np.concatenate(one), np.concatenate(two)
        unlike = one != two
        ends = np.concatenate((one, two[unlike]))
        return pa.table({"root": pa.array(np.full(len(ends), rows["root"][0].as_py())), "place": pa.array(ends), "one": pa.array(np.concatenate((one, one[unlike]))), "two": pa.array(np.concatenate((two, two[unlike])))})

    return pairs


def _compare(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def compare(rows: pa.Table) -> pa.Table:
        """node, links, label, bins: the links of a pair of tiles that the bound does not settle."""
        one, two = rows["one"][0].as_py(), rows["two"][0].as_py()
        rows = rows.sort_by([("place", "ascending"), ("node", "ascending")])
        nodes, u, own, removed = (rows[c].to_numpy() for c in ("node", "u", "own", "removed"))
        n = len(nodes)
        left = int((rows["place"].to_numpy() == one).sum()) if one != two else None
        blobs = rows["difference"].to_pylist()
        owner = np.repeat(np.arange(n), [len(b) // 8 for b in blobs])
        a, b = (np.arange(n), np.arange(n)) if left is None else (np.arange(left), np.arange(left, n))
        centre = rows["centre"][0].as_py()
        shared = intersections(np.frombuffer(b"".join(blobs), np.uint64), owner, n, left)
        shared += (centre - removed[a])[:, None] - removed[b][None]
        linked = (p + q) * shared >= p * (own[a][:, None] + own[b][None])
        linked &= u[a][:, None] + u[b][None] > (q - p) * centre
        if left is None:
            np.fill_diagonal(linked, False)
        links = np.zeros(n, np.int64)
        links[a] += linked.sum(axis=1)
        if left is not None:
            links[b] += linked.sum(axis=0)
        x, y = np.nonzero(linked if left is not None else np.triu(linked))
        bins = _binned(shared[x, y] / (own[a][x] + own[b][y] - shared[x, y]), threshold)
        label = least_connected(n, a[x], b[y])
        return pa.table([nodes, links, nodes[label], [bins, *[None] * (n - 1)]], schema=_COMPARED_ARROW)

    return compare


_COMPARED = "node long, links long, label long, bins array<long>"
_COMPARED_ARROW = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("label", pa.int64()), ("bins", pa.list_(pa.int64()))])


def _binned_links(df: DataFrame) -> np.ndarray:
    """How many links were found in each bin of similarity: BINS numbers."""
    return np.array([v or 0 for v in df.where("bins IS NOT NULL").agg(*[F.sum(F.get("bins", F.lit(k))) for k in range(BINS)]).first()], float)


def _verified(base: DataFrame, classes: DataFrame, groups: DataFrame, width: int, threshold: Fraction) -> tuple[DataFrame, np.ndarray]:
    """node, links, label (any class of its component, the least one of it if it has links) for the classes in groups; and the links by similarity."""
    sizes = durable(groups.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1"))
    few = sizes.count() <= BROADCAST_ROWS
    sized = groups.join(F.broadcast(sizes) if few else sizes, "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = durable(sized.join(classes.select("node", F.col("rep").alias("doc"), "digest"), "node"))
    small = own.count() <= BROADCAST_ROWS
    texts = base.join(F.broadcast(own) if small else own, ["doc", "digest"]).select("node", "root", "tiles", "text").mapInArrow(_once, "node long, root long, tiles int, text string")
    # a centre has a copy in every tile of its group
    places = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    checked = durable(texts.withColumn("tile", F.explode(places)).groupBy("root", "tile").applyInArrow(_check(width, threshold), _CHECKED))
    done, found = checked.where("u IS NULL").select("node", "links", "label"), _binned_links(checked)
    if not checked.where("u IS NOT NULL").limit(1).count():
        return done, found

    p, q = threshold.numerator, threshold.denominator
    weight = F.greatest(F.octet_length("difference"), F.lit(LEAST_BYTES)).cast("long")
    large = checked.where("u IS NOT NULL").withColumn("bound", (q - p) * F.col("centre"))
    settled = durable(large.groupBy("root", "u", "bound").agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).groupBy("root").applyInArrow(_settle, "root long, u long, start long, bytes long, sure long"))
    placed = durable(large.join(settled, ["root", "u"]).withColumn("place", F.floor((F.col("start") + F.pmod(F.xxhash64("node"), F.col("bytes"))) / TILE_BYTES).cast("long")).drop("bins", "links", "label"))
    tiles = placed.groupBy("root", "place", "bound").agg(F.max("u").alias("u_most"), F.min("far").alias("near"), F.max("far").alias("far"))
    pairs = durable(tiles.groupBy("root").applyInArrow(_tile_pairs(threshold), "root long, place long, one long, two long"))
    needed = placed.select("node", "root", "u", "own", "removed", "centre", "difference", "place").join(pairs, ["root", "place"])
    compared = durable(needed.groupBy("root", "one", "two").applyInArrow(_compare(threshold), _COMPARED))
    # a class within the bound of the centre, whose own u is 0, is linked with it
    edges = compared.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(placed.where("u <= bound").select(F.col("node").alias("a"), F.col("root").alias("b")))
    more = compared.groupBy("node").agg(F.sum("links").alias("more"))
    linked = placed.select("node", "sure").join(more, "node", "left").join(components(edges, placed.count()), "node", "left")
    return done.unionAll(linked.select("node", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("label"))), found + _binned_links(compared)


# ------------------------------------------------------------------------------------------------------------ the join


FAR = (1 << 63) - 1


def _keys(id_column: str, text_column: str) -> tuple[Column, Column, Column]:
    """A row's id (a null one is the largest), its text's digest, and its text (null: empty)."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(FAR)), F.unhex(F.md5(text.cast("binary"))), text


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc, digest, text of each row."""
    return docs.select(*[c.alias(n) for c, n in zip(_keys(id_column, text_column), ("doc", "digest", "text"), strict=True)])


def _wordy(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _classes(base: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """The distinct texts with words: digest, rep (least id), copies, n_links, group, first.

    Within the forest, groups and tiles a text goes by a hash of its digest, so texts that share an id stay apart. group
    is a hash that the texts share that links connect; first is its text of the least id (rep, digest).
    """
    ship(base.sparkSession)
    signed = base.mapInArrow(_sign(width, TREES, DEEPEST), "doc long, digest binary, signature binary").where("signature IS NOT NULL")
    classes = durable(signed.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature")).withColumn("node", F.xxhash64("digest")))
    n_classes, depth = classes.count(), DEEPEST
    while True:
        done, links = _verified(base, classes, _candidate_groups(classes, n_classes, depth), width, threshold)
        last, depth = depth, next_depth(links, depth, threshold)
        if depth == last:
            break
    found = durable(classes.select("digest", "node", "rep", "copies").join(done, "node", "left").select("digest", "rep", "copies", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("label", "node").alias("group")))
    first = found.groupBy("group").agg(F.min(F.struct("rep", "digest")).alias("first"))
    return durable(found.join(first, "group"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row for each row of ``docs``.

    class_id is the least id of the group that links and equality connect; n_links counts the other distinct texts of
    similarity >= threshold, n_copies the other rows of equal text. A null or wordless text is a class of its own. A null
    id counts as the largest one (and shows as null). Rows that repeat are copies of each other. Texts are read whole,
    however long. An empty table gives an empty result. Other columns are left behind, whatever their names.
    """
    base = _rows(docs, id_column, text_column)
    classes = _classes(base, width, threshold)
    rows = base.select("doc", F.when(_wordy(F.col("text")), F.col("digest")).alias("digest"))
    rows = rows.join(classes.select("digest", F.col("first.rep").alias("class_id"), "n_links", (F.col("copies") - 1).alias("n_copies")), "digest", "left")
    shown = lambda c: F.when(c < FAR, c)
    return rows.select(shown(F.col("doc")).alias("doc_id"), shown(F.coalesce("class_id", "doc")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with the columns it came with; wordless rows all stay.

    It is the one of the least id, of an id that no other text has if there is one. Of rows that repeat one stays. An
    empty table stays empty; names of columns do not matter.
    """
    base = _rows(docs, "doc_id", "text")
    classes = _classes(base, SHINGLE, THRESHOLD)
    rows = durable(base.select("doc", "digest", _wordy(F.col("text")).alias("wordy")))
    best = classes.where("digest = first.digest").select(F.col("rep").alias("doc"), "digest")
    shared = durable(rows.groupBy("doc").agg((F.min("digest") < F.max("digest")).alias("shared")).where("shared"))
    if shared.limit(1).count():
        own = rows.where("wordy").join(shared, "doc", "left").join(classes.select("digest", "group"), "digest")
        best = own.groupBy("group").agg(F.min(F.struct(F.coalesce("shared", F.lit(False)), "doc", "digest")).alias("b")).select("b.doc", "b.digest")
    kept = durable(rows.where("wordy").join(best, ["doc", "digest"]).groupBy("doc", "digest").agg(F.count("*").alias("rows")))
    bare = rows.where("NOT wordy").select("doc", "digest").distinct()
    keys = kept.select("doc", "digest", F.lit(False).alias("bare")).unionAll(bare.select("doc", "digest", F.lit(True)))
    doc, digest, _ = _keys("doc_id", "text")
    stays = set_aside(docs, "doc_id", "text").select(doc.alias("doc"), digest.alias("digest"), "__own").join(keys, ["doc", "digest"])
    if kept.where("rows > 1").limit(1).count():
        stays = stays.where("NOT bare").dropDuplicates(["doc", "digest"]).unionByName(stays.where("bare"))
    return brought_back(stays, docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: five-word shingles, similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
