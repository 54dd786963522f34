"""Near dedup by HyperMinHash.

1. Each text becomes its set of five-word shingles (64-bit hashes). Every shingle enters
   a sketch of REGISTERS buckets; a bucket keeps its least hash as leading-zero count
   and ten mantissa bits, 16 bits in all. So that short texts fill the buckets too, a
   shingle enters under several seeds (64 below SHORT shingles, 8 from there on; the
   Jaccard index stays what it was). Texts whose size lies within the threshold of SHORT carry
   both sketches, so any two linked texts have one in common.
2. Texts with the same words are one: copies follow their representative, the least doc_id.
3. BANDS runs of ROWS compressed registers are hashed; representatives that agree in a
   band are candidates. A bucket gives an edge from each member to its hub, the member that meets the
   most others over all bands, so all candidates of a bucket are in one cluster; no bucket emits its pairs.
4. Each text is compared with one hub, that with which it shares the most bands. Texts that are linked
   this way are one component already, and pairs within a component need no look: what is left
   are pairs of texts of one cluster and of different components.
5. Clusters with several components are compared within tasks: a pair goes on if the collision-corrected
   estimate from its registers is within SIGMAS standard errors of the threshold, and is linked if
   100 * intersection >= percent * union holds on the full shingle sets. A task emits at
   most an edge for each of its members (a spanning forest). Clusters beyond BLOCK texts are cut
   by size class (linked sets differ by at most the threshold in size) and within a class into
   blocks, those of the cluster's largest component apart from the rest; each pair of blocks that may
   hold links is a task, and no pair of blocks of the largest component is one.
6. Connected components of the links of steps 4 and 5 give the groups.

What step 5 costs follows the texts outside of a cluster's largest component: a family of n texts
that resemble each other, none enough for a link, takes n * n / BLOCK copies of a text.

A linked pair at 0.85 shares no band with probability (1 - 0.85^6)^42, about 2e-9; one at 0.80 with
probability (1 - 0.80^6)^42, about 3e-6. The gate of step 5 loses another 1e-9 of the pairs at the
threshold (a normal tail beyond SIGMAS), so about 3e-9 in all at 0.85.

Nulls: a null or empty text, or one without words, has an empty set and is linked with
nothing. Null doc_ids: their texts are linked as others are; a group without any id has the
component_id null, and drop_near_copies keeps one text of it. Very long texts are processed whole. Repeated
rows and equal texts share a group; rows equal in id and text stay or go together. Rows that
share a doc_id but not the text are judged, and dropped, each by its own text. An empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import connected_components
from .shared import meet

WORDS = 5
#: Least Jaccard index of a link, in hundredths, where a caller gives none.
PERCENT = 85
REGISTERS, ROWS = 252, 6
BANDS = REGISTERS // ROWS
SHORT, SEEDS = 64, {"a": 64, "b": 8}
MANTISSA, EMPTY = 10, 0xFFFF
SIGMAS = 6.0
BLOCK, BLOCK_SHINGLES = 512, 400_000

U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Shingler:
    """Texts to sets of shingle hashes. Word hashes are kept between calls, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(shared.LOWER).split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        n = len(words)
        if not n:
            return np.empty(0, U64)
        if len(self.known) > 100_000:
            self.known.clear()
        known, h = self.known, np.empty(n, U64)
        try:
            h[:] = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h[:] = [known[w] for w in words]
        size = min(n, WORDS)
        out = np.full(n - size + 1, U64(size))
        for k in range(size):
            out = _mix(out * U64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
        return np.unique(out)


def sketch(shingles: np.ndarray, seeds: int) -> np.ndarray:
    """REGISTERS uint16: leading zeros << MANTISSA | mantissa of each bucket's least hash; EMPTY."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    offsets = (np.arange(1, seeds + 1, dtype=U64) * U64(0xD1342543DE82EF95))[:, None]
    step = max(1, 65536 // seeds)
    filled = np.zeros(REGISTERS, bool)
    for at in range(0, len(shingles), step):
        h = _mix(shingles[None, at : at + step] + offsets).ravel()
        bucket = ((h >> U64(32)) * U64(REGISTERS) >> U64(32)).astype(np.int64)
        np.minimum.at(least, bucket, h.astype(np.uint32))
        filled[bucket] = True
    return np.where(filled, compress(least), np.uint16(EMPTY))


def compress(least: np.ndarray) -> np.ndarray:
    """A 32-bit fraction to leading zeros and the bits after its leading one."""
    x = least.astype(np.float64) + 0.5
    exponent = np.floor(np.log2(x)).astype(np.int64)
    exponent = np.maximum(exponent, -1)
    zeros = 31 - exponent
    mantissa = np.floor((x / np.exp2(exponent.astype(np.float64)) - 1.0) * (1 << MANTISSA)).astype(np.int64)
    return ((zeros << MANTISSA) | np.clip(mantissa, 0, (1 << MANTISSA) - 1)).astype(np.uint16)


def _collide(la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Chance that two unrelated buckets, holding la and lb hashes on average, agree in their compressed value."""
    total, out = la + lb, np.zeros(np.broadcast(la, lb).shape)
    each = 2.0**-MANTISSA * la * lb / total
    for z in range(33):  # one term at a time: all 33 at once took a gigabyte for two full blocks
        lo = 2.0 ** -(z + 1.0)
        out += lo * each * (np.exp(-total * lo) - np.exp(-total * 2 * lo))
    return out


def estimate(regs: np.ndarray, other: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all rows of regs against all of other."""
    if len(regs) * len(other) <= 1024:
        a, b = regs[:, None, :], other[None, :, :]
        full = (a != EMPTY) | (b != EMPTY)
        used, same = full.sum(axis=2), (full & (a == b)).sum(axis=2)
    else:
        same = np.zeros((len(regs), len(other)), np.int16)
        used = np.zeros((len(regs), len(other)), np.int16)
        for k in range(REGISTERS):
            a, b = regs[:, k, None], other[None, :, k]
            full = (a != EMPTY) | (b != EMPTY)
            used += full
            same += full & (a == b)
    p = _collide(la[:, None], lb[None, :])
    share = same / np.maximum(used, 1)
    return np.clip((share - p) / (1 - p), 0, 1)


def prepare(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the word sequence, reg_a and reg_b (null where a text has no such sketch)."""
    ratio = percent / 100
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            size, digest, reg = [], [], {"a": [], "b": []}
            for t in b.column("text"):
                words = shingler.words(t.as_py())
                s = shingler.shingles(words)
                n = len(s)
                size.append(n)
                digest.append(hashlib.sha256(b" ".join(words)).digest() if n else None)
                reg["a"].append(sketch(s, SEEDS["a"]).tobytes() if 0 < n <= SHORT / ratio else None)
                reg["b"].append(sketch(s, SEEDS["b"]).tobytes() if n >= SHORT * ratio else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(reg["a"], pa.binary()), pa.array(reg["b"], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "digest", "reg_a", "reg_b"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, digest binary, reg_a binary, reg_b binary"
    )


def band_rows(nodes: DataFrame) -> DataFrame:
    """(band, node): a hash of each band of registers that has a filled one."""
    width, parts = 2 * ROWS, []
    for k, name in enumerate(("reg_a", "reg_b")):
        registers = F.col(name)
        cut = F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("i"), F.substr(registers, i * width + 1, F.lit(width)).alias("v"))
        )
        piece = F.explode(F.when(registers.isNotNull(), cut))
        rows = nodes.select("node", piece.alias("p")).where(F.col("p.v") != F.lit(b"\xff" * width))
        parts.append(rows.select(F.xxhash64(F.lit(k), "p.i", "p.v").alias("band"), "node"))
    return parts[0].unionByName(parts[1])


def _links(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], regs: dict[str, list[bytes | None]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among the texts given that join different groups."""
    n = len(ids)
    if len(np.unique(groups)) < 2:
        return []
    size = np.array([len(s) for s in sets], np.float64)
    hopeful = np.zeros((n, n), bool)
    for name, seeds in SEEDS.items():
        at = np.array([k for k in range(n) if regs[name][k] is not None])
        if len(at) < 2:
            continue
        table = np.frombuffer(b"".join(regs[name][k] for k in at), np.uint16).reshape(len(at), REGISTERS)
        load = size[at] * seeds / REGISTERS
        guess = estimate(table, table, load, load)
        # The error for the buckets that the smaller set can have filled.
        held = REGISTERS * (1 - np.exp(-np.minimum(load[:, None], load[None, :])))
        limit = percent / 100
        error = np.sqrt(limit * (1 - limit) / np.maximum(1, np.minimum(held, np.minimum(size[at][:, None], size[at][None, :]))))
        hopeful[np.ix_(at, at)] |= guess >= limit - SIGMAS * error
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    hopeful &= 100 * small >= percent * large
    hopeful &= groups[:, None] != groups[None, :]
    left, right = np.nonzero(np.triu(hopeful, 1))
    if not len(left):
        return []
    linked = _verify(sets, size, left, right, percent)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left[linked].tolist(), right[linked].tolist(), strict=True):
        if (ra := root(a)) != (rb := root(b)):
            parent[rb] = ra
            out.append((int(ids[a]), int(ids[b])))
    return out


def _verify(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """100 * intersection >= percent * union on full sets: pair by pair, or, where the
    pairs are many, by products of 0/1 matrices over the shingles that two texts share."""
    if len(left) <= 8 * len(sets):
        both = np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(left, right, strict=True)], np.float64)
    else:
        use = np.unique(np.concatenate((left, right)))
        place = {int(k): i for i, k in enumerate(use)}
        values, which, times = np.unique(np.concatenate([sets[k] for k in use]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(use)), [len(sets[k]) for k in use])
        twice = times[which] > 1
        which, owner = (np.cumsum(times > 1) - 1)[which[twice]], owner[twice]
        order = np.argsort(which, kind="stable")
        which, owner = which[order], owner[order]
        shared_by = np.zeros((len(use), len(use)), np.float32)
        for at in range(0, int((times > 1).sum()), 2048):
            lo, hi = np.searchsorted(which, [at, at + 2048])
            has = np.zeros((len(use), 2048), np.float32)
            has[owner[lo:hi], which[lo:hi] - at] = 1
            shared_by += has @ has.T
        index = np.array([place[int(k)] for k in range(len(sets)) if k in place] or [0])
        spot = np.full(len(sets), -1)
        spot[use] = index
        both = shared_by[spot[left], spot[right]].astype(np.float64)
    return 100 * both >= percent * (size[left] + size[right] - both)


def hub_links(texts: DataFrame, edges: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): of each node and the hub it shares the most bands with, those that are linked; texts(node, text),
    edges(u, v) from a node to a hub. Rows go by hub, hubs first; a large hub's nodes are dealt to several tasks."""
    spark = texts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = edges.groupBy("u", "v").agg(F.count("*").alias("n")).groupBy("u").agg(F.max(F.struct("n", (-F.col("v")).alias("m"), "v")).alias("b"))
    best = shared.materialise(best.select(F.col("u").alias("node"), F.col("b.v").alias("hub")), "best")
    # A hub is dealt to as many tasks as it has partitions' shares of the nodes: at most `parts` more rows than hubs.
    hubs = best.groupBy("hub").agg(F.ceil(F.count("*") * F.lit(parts) / F.lit(max(1, best.count()))).cast("int").alias("salts"))
    hubs = shared.materialise(hubs, "hubs")
    large = F.broadcast(hubs.where("salts > 1"))  # fewer than `parts`
    salt = F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0)).cast("int")
    members = best.join(large, "hub", "left").select("hub", salt.alias("salt"), F.lit(1).alias("kind"), "node")
    firsts = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
    rows = members.unionByName(firsts).join(texts, "node")
    rows = rows.select("hub", "salt", "kind", "node", "text").repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, held = Shingler(), None, None
        for b in batches:
            found: list[tuple[int, int]] = []
            for hub, kind, node, text in zip(*(b.column(c) for c in ("hub", "kind", "node", "text")), strict=True):
                s = shingler.shingles(shingler.words(text.as_py()))
                if not kind.as_py():
                    now, held = hub.as_py(), s
                elif now == hub.as_py():
                    small, large = sorted((len(s), len(held)))
                    if 100 * small >= percent * large:
                        both = np.intersect1d(s, held, assume_unique=True).size
                        if 100 * both >= percent * (small + large - both):
                            found.append((node.as_py(), now))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def verified_links(texts: DataFrame, nodes: DataFrame, clusters: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): spanning links of each task, between texts of different groups; nodes as near_dedup
    makes them, texts(node, text), clusters(node, cluster), groups(node, component)."""
    spark = nodes.sparkSession
    step = -float(np.log(percent / 100)) * (1 + 1e-9)
    members = nodes.select("node", "n_shingles", "reg_a", "reg_b").join(clusters, "node").join(groups, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    members = members.withColumn("class", F.floor(F.log(F.col("n_shingles").cast("double")) / step).cast("int"))
    members = shared.materialise(members, "members")
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("cluster").agg(F.count("*").alias("c"), F.max(F.struct("n", "component")).alias("b"), F.sum("n").alias("n"))
    open_ = shared.materialise(open_.where("c > 1").select("cluster", F.col("b.component").alias("bulk"), "n"), "open")
    # Clusters of one component are done; the rest meet their largest component.
    marked = meet(members, open_, "cluster", members.count()).withColumn("of_bulk", F.col("component") == F.col("bulk")).drop("bulk")
    marked = shared.materialise(marked, "marked")
    # A cluster's classes are at most a few dozens (the logarithm of a text's length).
    classes = marked.groupBy("cluster", "class", "of_bulk").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    cut = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    plan = classes.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("w").alias("weight"),
        *(F.map_from_entries(F.collect_list(F.when(side, F.struct("class", cut)))).alias(name) for name, side in (("bulk", F.col("of_bulk")), ("rest", ~F.col("of_bulk")))),
    )
    plan = shared.materialise(plan.withColumn("whole", (F.col("n") <= BLOCK) & (F.col("weight") <= BLOCK_SHINGLES)).drop("weight"), "plan")
    own = F.when(F.col("of_bulk"), F.try_element_at("bulk", F.col("class"))).otherwise(F.try_element_at("rest", F.col("class")))

    def task(far: int, side: str) -> Column:
        """The tasks that a text shares with the blocks of a side, of the class `far` from its own."""
        c, b, mine = F.col("class"), F.col("block"), F.when(F.col("of_bulk"), F.lit("bulk")).otherwise(F.lit("rest"))
        each = F.filter(F.sequence(F.lit(-1), F.coalesce(F.try_element_at(side, c + far), F.lit(0)) - 1), lambda j: j >= 0)

        def name(j: Column) -> Column:
            a, z = F.struct(c.alias("c"), mine.alias("s"), b.alias("b")), F.struct((c + far).alias("c"), F.lit(side).alias("s"), j.alias("b"))
            return F.xxhash64("cluster", F.least(a, z), F.greatest(a, z))

        return F.transform(each, name)

    against_rest = F.concat(*(task(far, "rest") for far in (-1, 0, 1)))
    against_bulk = F.concat(*(task(far, "bulk") for far in (-1, 0, 1)))
    tasks = F.when(F.col("whole"), F.array(F.xxhash64("cluster"))).when(F.col("of_bulk"), against_rest).otherwise(F.concat(against_rest, against_bulk))
    planned = meet(marked, plan, "cluster", marked.count()).withColumn("block", F.pmod(F.xxhash64("node"), own).cast("int"))
    planned = planned.select("node", "component", "reg_a", "reg_b", tasks.alias("tasks")).where(F.size("tasks") > 0)
    rows = planned.join(texts, "node").select(F.explode("tasks").alias("task"), "node", "component", "text", "reg_a", "reg_b")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "task").sortWithinPartitions("task", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        task, ids, owners, sets, regs = None, [], [], [], {"a": [], "b": []}
        found: list[tuple[int, int]] = []

        def done() -> None:
            if len(ids) > 1:
                found.extend(_links(np.array(ids, np.int64), np.array(owners, np.int64), sets, regs, percent))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
            found.clear()
            return out

        for b in batches:
            for t, i, c, text, ra, rb in zip(*(b.column(c) for c in ("task", "node", "component", "text", "reg_a", "reg_b")), strict=True):
                if t.as_py() != task:
                    done()
                    task, ids, owners, sets, regs = t.as_py(), [], [], [], {"a": [], "b": []}
                ids.append(i.as_py())
                owners.append(c.as_py())
                sets.append(shingler.shingles(shingler.words(text.as_py())))
                regs["a"].append(ra.as_py())
                regs["b"].append(rb.as_py())
            if found:
                yield flush()
        done()
        if found:
            yield flush()

    return rows.mapInArrow(run, "u long, v long")


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    return _judged(docs, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _judged(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (tells rows of one doc_id apart), n_shingles, component_id and component_key
    (the id and key of the text that stays of a group; null without words)."""
    all_rows = shared.materialise(prepare(docs, percent), "sketches")
    # A node is a text: copies follow it. Rows of one digest agree in all that first() takes.
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("stays")
    nodes = all_rows.where("digest IS NOT NULL").groupBy("digest").agg(stays, F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_shingles", "reg_a", "reg_b")))
    nodes = shared.materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = shared.materialise(band_rows(nodes), "bands")
    edges, held = _hub_edges(bands)
    edges = shared.materialise(edges, "candidates")
    clusters = shared.materialise(connected_components(edges).withColumnRenamed("component", "cluster"), "clusters")
    texts = shared.materialise(_texts(docs, nodes.join(clusters.select("node"), "node", "left_semi")), "texts")
    near = shared.materialise(hub_links(texts, edges, percent), "links")
    some = shared.materialise(connected_components(near), "groups")
    more = verified_links(texts, nodes, clusters, some, percent)
    groups = connected_components(some.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    groups = shared.materialise(groups.join(nodes.select("node", "stays"), "node"), "groups")
    shared.discard(bands, held, edges, clusters, texts, near, some)
    least = groups.groupBy("component").agg(F.min("stays").alias("least"), F.count("*").alias("n"))
    least = meet(groups.select("node", "component"), least, "component", groups.count()).select("node", "least")
    labels = nodes.select("digest", "node", "n", "stays").join(least, "node", "left").select("digest", "n", F.coalesce("least", "stays").alias("of"))
    rows = all_rows.select("doc_id", "text_key", "n_shingles", "digest")
    empty = rows.where("digest IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_key"))
    rows = meet(rows.where("digest IS NOT NULL"), labels, "digest", all_rows.count())
    return rows.select("doc_id", "text_key", "n_shingles", F.col("of.doc_id").alias("component_id"), F.col("of.text_key").alias("component_key")).unionByName(empty)


def _hub_edges(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v): each member of a bucket and the bucket's hub; and a table that this reads. The hub is the member that meets
    most others over all its bands: of copies of one text that were each changed elsewhere, the text itself."""
    buckets = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
    buckets = shared.materialise(buckets, "buckets")
    held = shared.materialise(meet(bands, buckets, "band", buckets.agg(F.sum("n")).first()[0] or 0), "held")
    shared.discard(buckets)
    scores = held.groupBy("node").agg(F.sum("size").alias("score"))
    best = F.max(F.struct("score", (-F.col("node")).alias("minus"), "node"))
    hubs = held.join(scores, "node").groupBy("band").agg(best.alias("b"), F.count("*").alias("n")).select("band", F.col("b.node").alias("hub"), "n")
    edges = meet(held.select("band", "node"), hubs, "band", held.count()).where("node <> hub")
    return edges.select(F.col("node").alias("u"), F.col("hub").alias("v")), held


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes, from the row that stands for each; repeated rows bring a text once."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.xxhash64(doc_id, F.xxhash64("text")).alias("row"), doc_id.alias("id"), "text")
    wanted = nodes.select(F.xxhash64("stays.doc_id", "stays.text_key").alias("row"), F.col("stays.doc_id").alias("node_id"), F.col("stays.text_key").alias("key"), "node")
    met = rows.join(wanted, "row").where(F.col("id").eqNullSafe(F.col("node_id")) & (F.xxhash64("text") == F.col("key")))
    return met.groupBy("row", "node").agg(F.first("text").alias("text")).select("node", "text")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that near_dedup drops; all columns. Of a group without ids one text stays."""
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("doc_id").isNotNull() | (F.col("text_key") == F.col("component_key")))
    gone = _judged(docs, percent).where(~F.coalesce(same, F.lit(True)) & F.col("component_key").isNotNull())
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text_key"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text_key"]), "left_anti")
