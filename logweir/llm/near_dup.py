"""Near duplicates by MinHash bands and odd sketches.

128 MinHash samples of a text's five-word shingles give 32 band keys of four samples each, and fold into an odd sketch:
a bitmap of 512 bits, each sample flipping one. The population count of two sketches' XOR estimates how many samples
differ, precisely where they are few, so pairs in a bucket that can't reach the threshold fall out before full sets are
compared. Texts with equal word sequences are one text first. A bucket's members are compared with its pivot, in rounds:
a text meets one pivot, then two more, then four, and those that are by then in its component fall out unseen. Only where
a bucket's members still belong to different components is every such pair looked at: by sketches in each bucket, which
joins near ones to families, then by full sets in blocks of a family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, dropped, mix, signed, table, tidy, windows_hash, written
from .graph import components, merged

SHINGLE, SAMPLES, ROWS, BITS = 5, 128, 4, 512
#: A pair at 0.75 has about 57 differing bits, with a deviation of 9; beyond this many it is not compared.
MOST_BITS = 108
#: Members of a bucket that are compared with one another at once.
BLOCK = 2048
#: Rows and bytes of text in a block of a family of near texts.
BLOCK_ROWS, BLOCK_BYTES = 128, 512 << 10

_U32 = np.uint32
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(_U32)
_TIMES = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(_U32) | _U32(1)


def shingles(w: Words) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: fewer than five words are one shingle, no words none."""
    hashes = windows_hash(w.hashes, SHINGLE)
    whole, _ = w.whole()
    first = w.first
    return [np.unique(hashes[first[i] : first[i + 1] - SHINGLE + 1]) if n >= SHINGLE else whole[i : i + 1] if n else whole[:0] for i, n in enumerate(w.counts)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SAMPLES minima for each non-empty set."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(_U32)
    heads = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), _U32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((flat ^ _FLIP[i]) * _TIMES[i], heads)
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """BITS // 64 words for each row of minima."""
    place = (mix(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
    bits = np.zeros((len(minima), BITS), np.uint8)
    rows = np.arange(len(minima))
    for i in range(SAMPLES):
        bits[rows, place[:, i]] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    key = np.zeros((len(minima), SAMPLES // ROWS), np.uint64)
    for r in range(ROWS):
        key = mix(key ^ (minima[:, r::ROWS].astype(np.uint64) + np.uint64((r + 1) << 33)))
    return signed(mix(key ^ np.arange(SAMPLES // ROWS, dtype=np.uint64)))


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for b in batches:
        for lo, hi, w in chunks(b.column(1), lower=True):
            sets = shingles(w)
            long = np.flatnonzero(w.counts >= SHINGLE)
            bands: list = [None] * (hi - lo)
            sketches: list = [None] * (hi - lo)
            if len(long):
                minima = signatures([sets[i] for i in long])
                for i, keys, bits in zip(long, band_keys(minima), odd_sketches(minima), strict=True):
                    bands[i], sketches[i] = keys, bits
            high, low = w.whole()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).slice(lo, hi - lo), "n_words": pa.array(w.counts.astype(np.int64)), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "high": pa.array(signed(high)), "low": pa.array(signed(low)), "bands": pa.array(bands, longs), "sketch": pa.array(sketches, longs)})


def _confirm(percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = [s for _, _, w in chunks(b.column(2), lower=True) for s in shingles(w)]
            c = [s for _, _, w in chunks(b.column(3), lower=True) for s in shingles(w)]
            same = []
            for x, y in zip(a, c, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def differing(x: str, y: str) -> Column:
    """Bits that differ between two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _forest(group: pa.Table) -> pa.Table:
    """Of the pairs between the two blocks of a bucket whose components differ and whose sketches are near, as many as connect them."""
    ids, comp = group["doc_id"].to_numpy(), group["component"].to_numpy()
    side = group["side"].to_numpy()
    bits = np.stack(group["sketch"].to_pylist()).astype(np.int64).view(np.uint64) if len(group) else np.zeros((0, 8), np.uint64)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    root = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    for i in left:
        near = right[(root[right] != root[i]) & (comp[right] != comp[i])]
        near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(1) <= MOST_BITS]
        while len(near):
            out.append((ids[i], ids[near[0]]))
            root[root == root[near[0]]] = root[i]
            near = near[root[near] != root[i]]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _settle(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between the components of two blocks of a family, as many as join those that have any; by full sets."""
        ids, comp, side = (group[c].to_numpy() for c in ("doc_id", "component", "side"))
        sets = [s for _, _, w in chunks(group["text"], lower=True) for s in shingles(w)]
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        head = np.cumsum(size) - size
        flags = np.zeros(int(dense.max()) + 1, bool)
        values, counts = np.unique(comp, return_counts=True)
        most = values[np.argmax(counts)]
        parent: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        for mine, others in ((side != 1, side != 0), (side == 1, side == 0)):
            other = np.flatnonzero(others)
            if not len(other):
                continue
            flat = np.concatenate([dense[head[k] : head[k] + size[k]] for k in other])
            starts = np.cumsum(size[other]) - size[other]
            for i in np.flatnonzero(mine & (comp != most)):
                own = dense[head[i] : head[i] + size[i]]
                flags[own] = True
                both = np.add.reduceat(flags[flat], starts, dtype=np.int64)
                flags[own] = False
                for k in other[(100 * both >= percent * (size[i] + size[other] - both)) & (comp[other] != comp[i])]:
                    x, y = _root(parent, int(comp[i])), _root(parent, int(comp[k]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((ids[i], ids[k]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id and kept.

    Letters A-Z are lower-cased. Texts are linked when 100 * intersection >= percent * union of their shingle sets, which
    is confirmed on the full sets (as 64-bit hashes); a pair at 0.75 meets in no band with a chance of 5 in a million.
    Null, empty and blank texts are linked with nothing and kept, as are rows without an id. Rows that repeat an id are
    one document: its links are those of all its texts, and each of its rows comes out once, with its own n_shingles.
    Other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signs = written(docs.mapInArrow(_sign, "doc_id long, n_words long, n_shingles long, high long, low long, bands array<long>, sketch array<long>"), "signatures")
    named = signs.where((F.col("n_words") > 0) & F.col("doc_id").isNotNull())
    text_key = ["high", "low", "n_words"]
    groups = written(named.groupBy(*text_key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"), "copygroups")
    copies = written(named.select("doc_id", *text_key).join(groups, text_key).where("doc_id > rep").distinct(), "copies")
    reps = named.where("bands IS NOT NULL").join(copies.drop("rep"), ["doc_id", *text_key], "left_anti")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").select("key")
    members = written(keys.join(shared, "key").distinct(), "members")
    near = written(reps.select("doc_id", "sketch").join(members.select("doc_id").distinct(), "doc_id").distinct(), "sketches")
    buckets = written(members.join(near, "doc_id"), "buckets")
    held = written(docs.join(near.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "text"]), "heldtexts")
    dropped(members)
    labels = _pivot_rounds(buckets, near, held, percent)
    families = components(_bucket_forest(_unsettled(buckets, labels)))
    labels = merged(labels, written(_settled(families, labels, held, percent), "links"))
    # An id with several texts, some of them copies: its links are also those of the texts that they copy.
    several = named.groupBy("doc_id").agg(F.min(F.struct("high", "low")).alias("x"), F.max(F.struct("high", "low")).alias("y")).where("x <> y").select("doc_id")
    across = written(copies.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "across")
    if not across.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(across))
    out = signs.select("doc_id", "n_shingles", *text_key).join(copies, ["doc_id", *text_key], "left").withColumn("of", F.coalesce("rep", "doc_id"))
    out = out.join(labels, F.col("of") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "of"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _pivot_rounds(buckets: DataFrame, near: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all near texts after each was compared with its buckets' pivots, but for those already in its component.

    open: a row for each text with the pivots that are still to be looked at, at most one for each band.
    """
    pivots = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "sketch")).alias("p")).select("key", F.col("p.doc_id").alias("pivot"), F.col("p.sketch").alias("pivot_sketch"))
    pairs = buckets.join(pivots, "key").where((F.col("doc_id") > F.col("pivot")) & (differing("sketch", "pivot_sketch") <= MOST_BITS))
    open_ = written(pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set("pivot")).alias("pivots")), "open")
    labels = written(near.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).distinct(), "labels")
    first = held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    most = 1
    while not open_.isEmpty():
        now = open_.select(F.col("doc_id").alias("b"), F.explode(F.slice("pivots", 1, most)).alias("a"))
        full = now.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
        links = written(full.mapInArrow(_confirm(percent), "a long, b long"), "links")
        labels = merged(labels, links)
        rest = open_.where(F.size("pivots") > most).select("doc_id", F.explode(F.slice("pivots", F.lit(most + 1), F.size("pivots"))).alias("pivot"))
        rest = rest.join(labels.select(F.col("id").alias("pivot"), F.col("component").alias("other")), "pivot").groupBy("doc_id").agg(F.collect_set(F.struct("other", "pivot")).alias("found"))
        rest = rest.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id").select("doc_id", F.expr("sort_array(transform(filter(found, x -> x.other <> component), x -> x.pivot))").alias("pivots"))
        left = written(rest.where(F.size("pivots") > 0), "open")
        dropped(open_, links)
        open_, most = left, 2 * most
    return labels


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with components and the number of blocks, of the buckets that hold more than one component."""
    now = written(members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id"), "members")
    keys = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return now.join(keys.where("lo < hi").select("key", "blocks"), "key")


def _bucket_forest(members: DataFrame) -> DataFrame:
    """Near pairs of different components that connect each bucket; a bucket is cut into blocks, and each two blocks are one group."""
    cut = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.select("key", "doc_id", "sketch", "component", "block", other)
    grouped = cut.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "sketch", "component", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    return grouped.groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long")


def _settled(families: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between components of one family. Small components share blocks, a large one has blocks of its own, and each
    two blocks but those of one component are compared in one group, so that no pair becomes a row unless it is a link."""
    family = families.select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    members = written(family.join(labels.withColumnRenamed("id", "doc_id"), "doc_id").join(texts, "doc_id"), "family")
    load = F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.octet_length("text")) / BLOCK_BYTES).alias("load")
    parts = members.groupBy("family", "component").agg(load)
    small = parts.where("load <= 1").groupBy("family").agg(F.ceil(F.sum("load")).cast("long").alias("shared"))
    parts = written(parts.join(small, "family", "left").select("family", "component", F.ceil("load").alias("own"), F.coalesce("shared", F.lit(1)).alias("shared")), "parts")
    block = F.when(F.col("own") > 1, F.concat_ws("-", F.col("component"), F.pmod(F.xxhash64("doc_id"), F.col("own")))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.col("shared")))).alias("block")
    owner = F.when(F.col("own") > 1, F.col("component")).alias("owner")
    members = written(members.join(parts, ["family", "component"]).select("family", "component", "doc_id", "text", block, owner), "blocks")
    blocks = members.select("family", "block", "owner").distinct()
    first = blocks.select("family", F.col("block").alias("i"), F.col("owner").alias("owner_i"))
    second = blocks.select("family", F.col("block").alias("j"), F.col("owner").alias("owner_j"))
    pairs = first.join(second, "family").where("i <= j AND coalesce(owner_i <> owner_j, true)").select("family", "i", "j")
    sides = pairs.select("family", F.col("i").alias("block"), "i", "j", F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("side"))
    sides = written(sides.union(pairs.where("i < j").select("family", F.col("j").alias("block"), "i", "j", F.lit(1).alias("side"))), "sides")
    return members.join(sides, ["family", "block"]).select("family", "i", "j", "doc_id", "component", "text", "side").groupBy("family", "i", "j").applyInArrow(_settle(percent), "a long, b long")


def op4_odd_sketch_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted; components as reachable ids.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c.c >= 75 * (a.n + b.n - c.c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, least(x, min(y)) AS component FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""
