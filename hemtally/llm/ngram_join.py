"""N-gram Jaccard join by count vectors: group counts are points, summed minima bound overlaps, survivors are verified."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, components, discard, stored, text_hash
from .words import mix, shingle_sets

#: Coordinates of a document's point.
COORDINATES = 256
#: The logarithm of how many cells count the keys of all documents.
CELL_BITS = 20
#: The logarithm of how many marks tell the tasks whose sets are wanted: 4 MB.
MARK_BITS = 25
#: Points in a leaf of the tree, and members of a bucket that one task joins at once; sets that one task compares with a common one.
LEAF = 16
BLOCK = 512
#: Members of a family of buckets that is joined as one; larger ones are joined bucket by bucket.
FAMILY = 4096


class Similarity:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def difference(self, n: int) -> int:
        """Most elements in which a set of size n differs from any set linked with it."""
        largest = n * self.den // self.num
        return max(n + b - 2 * int(self.overlap(n, b)) for b in {n, largest, max(n, largest - 1)})


def group_keys(s: np.ndarray, similarity: Similarity) -> list[np.ndarray]:
    """Keys of a sorted set of hashes, in lists of which `choose` takes some, such that two different linked sets have one in common.

    Hashes are dealt to G groups by their size, G a function of the set's size class (powers of two; a set near the upper end of a class
    also gives a list for the next, where larger partners may be); a list has the content of each group that holds anything. Linked sets differ in at most
    D elements, so at most D groups of a set are not equal in the other. A set with too few groups for that gives its single elements as a list too.
    """
    n, lists, few = len(s), [], False
    d = similarity.difference(n)
    if d == 0:
        return []
    level = int(n).bit_length() - 1
    levels = [level] + [level + 1] * (n * similarity.den >= (2 << level) * similarity.num)
    for lv in levels:
        groups = max(2, int((1 << lv) * 2.3 * (1 - similarity.num / similarity.den)) + 3)
        g = ((s >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)  # grows with s
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        content = np.add.reduceat(mix(s ^ np.uint64(0xA24BAED4963EE407)), first)
        tag = np.uint64((lv + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)
        lists.append(mix(content + mix(g[first] + tag)))
        few = few or len(first) <= d
    return [*lists, mix(s + np.uint64(0x5851F42D4C957F2D))] if few else lists


def choose(lists: list[np.ndarray], n: int, counts: np.ndarray, similarity: Similarity) -> np.ndarray:
    """The rarest D + 1 keys of each list by `counts`, all of a list with fewer.

    In one order of all keys, the first key that two linked sets share has at most D before it in either list, so both choose it.
    """
    d = similarity.difference(n)
    out = []
    for keys in lists:
        if len(keys) > d + 1 and len(keys) < n:
            keys = keys[np.lexsort((keys, counts[(keys >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))[: d + 1]]
        out.append(keys)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def key_counts(described: DataFrame) -> np.ndarray:
    """How many of all documents' keys fall into each of 2 ** CELL_BITS cells: of fixed size, whatever the input."""
    cells, chunk = 1 << CELL_BITS, 1 << (CELL_BITS - 6)

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.int64)
        for rows in frames:
            keys = [k for lists in rows["keys"] for k in lists]
            if keys:
                np.add.at(total, (np.concatenate(keys).view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        for i in range(0, cells, chunk):
            part = total[i : i + chunk]
            if part.any():
                yield pd.DataFrame({"chunk": [i], "some": [TaskContext.get().partitionId() % 32], "counts": [part.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "counts": [total.tobytes()]})

    counted = described.select("keys").mapInPandas(count, "chunk int, some int, counts binary")
    counted = counted.groupBy("chunk", "some").applyInPandas(add, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    out = np.zeros(cells, np.int64)
    for r in counted.collect():  # 2 ** CELL_BITS numbers
        out[r["chunk"] : r["chunk"] + chunk] = np.frombuffer(r["counts"], np.int64)
    return out


def chosen_keys(described: DataFrame, similarity: Similarity) -> DataFrame:
    """(key, sid): what decides which sets meet."""
    counts = described.sparkSession.sparkContext.broadcast(key_counts(described).astype(np.uint32))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            keys = [choose([k.view(np.uint64) for k in lists], n, counts.value, similarity) for lists, n in zip(rows["keys"], rows["n"])]
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "sid": np.repeat(rows["sid"].to_numpy(np.int64), [len(k) for k in keys])})

    return described.filter("sid is not null").select("keys", "n", "sid").mapInPandas(run, "key long, sid long")


def describe(documents: DataFrame, k: int, similarity: Similarity, id_col: str, text_col: str) -> DataFrame:
    """(id, th, sid, n, keys, point) per document: its text's hash, its set's identity and size, lists of keys and counts; sid null without words."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks(frames, "text"):
            sets = shingle_sets(rows["text"].tolist(), k)
            yield pd.DataFrame({
                "id": rows["id"], "th": rows["th"], "sid": pd.array([identity(s) for s in sets], "Int64"), "n": [len(s) for s in sets],
                "keys": [[x.view(np.int64) for x in group_keys(s, similarity)] if len(s) else [] for s in sets],
                "point": [point(s) for s in sets],
            })

    kind = documents.schema[id_col].dataType
    # as text, since pandas makes whole numbers beside nulls floating
    rows = documents.select(F.col(id_col).cast("string").alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    done = rows.mapInPandas(run, "id string, th long, sid long, n long, keys array<array<long>>, point binary")
    return done.withColumn("id", F.col("id").cast(kind))


def identity(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def point(s: np.ndarray) -> bytes:
    """How many elements fall into each of the groups."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=COORDINATES).astype("<u4").tobytes()


def may_link(a: np.ndarray, b: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Whether the summed coordinate minima of points (rows) reach the overlap that their sizes need."""
    na, nb = a.sum(-1, dtype=np.int64), b.sum(-1, dtype=np.int64)
    return np.minimum(a, b).sum(-1, dtype=np.int64) >= similarity.overlap(na, nb)


class RTree:
    """Points packed into leaves of LEAF, sorted by size and then by their fullest directions; a leaf keeps its largest and smallest corner."""

    def __init__(self, points: np.ndarray):
        points = points.astype(np.int64)
        size = points.sum(1)
        spread = np.argsort(-points.var(0))[:2]
        strips = np.argsort(size, kind="stable")
        width = max(LEAF, int(np.sqrt(len(points) * LEAF)))
        parts = [strips[i : i + width] for i in range(0, len(points), width)]
        self.order = np.concatenate([p[np.lexsort((points[p][:, spread[1]], points[p][:, spread[0]]))] for p in parts])
        self.points, self.size = points[self.order], size[self.order]
        begins = np.arange(0, len(points), LEAF)
        self.begins, self.ends = begins, np.append(begins[1:], len(points))
        self.top = np.maximum.reduceat(self.points, begins)
        self.least, self.most = np.minimum.reduceat(self.size, begins), np.maximum.reduceat(self.size, begins)

    def pairs(self, other: RTree, similarity: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (of the points given) that the bound leaves; of two leaves only if their corners leave any."""
        for leaf in range(len(self.begins)):
            # No pair of the leaves overlaps more than the minima of their corners; the smallest sizes need the least.
            bound = np.minimum(self.top[leaf], other.top).sum(1)
            reach = (bound >= similarity.overlap(self.least[leaf], other.least)) & (
                other.most * similarity.den >= self.least[leaf] * similarity.num
            ) & (self.most[leaf] * similarity.den >= other.least * similarity.num)
            a = np.arange(self.begins[leaf], self.ends[leaf])
            for o in np.flatnonzero(reach):
                b = np.arange(other.begins[o], other.ends[o])
                ok = may_link(self.points[a][:, None, :], other.points[b][None, :, :], similarity)
                i, j = np.nonzero(ok)
                yield self.order[a[i]], other.order[b[j]]


def verified(documents: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, similarity: Similarity, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of set identities that link: their sets are made again from one text each and intersected.

    The pairs of one b are dealt into blocks of BLOCK; a block's task meets b's set first and then the others', one after another, so a set travels once
    per block and a b with a third of all sets is many blocks.
    """
    pairs = stored(pairs, "pairs")
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    one = pairs.join(size, "b").select(F.col("a").alias("sid"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("nth"))
    hub = size.select(F.col("b").alias("sid"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("nth"))
    wanted = one.unionByName(hub).join(nodes.select("sid", "rep"), "sid")
    wanted = stored(wanted.select(F.xxhash64("rep.id").alias("ih"), F.col("rep.th").alias("th"), "sid", "b", "block", "nth"), "wanted")
    marks = documents.sparkSession.sparkContext.broadcast(marked(wanted.select("ih", "th").distinct()))
    texts = documents.select(F.xxhash64(id_col).alias("ih"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))

    def make(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = _cells(frame)
            for rows in chunks([frame[(marks.value[at >> 3] >> (at & 7) & 1).astype(bool)]], "text"):
                yield rows[["ih", "th"]].assign(s=[s.tobytes() for s in shingle_sets(rows["text"].tolist(), k)])

    def check(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for rows in frames:
            found = []
            for b, nth, a, s in zip(rows["b"], rows["nth"], rows["sid"], rows["s"]):
                s = np.frombuffer(s, np.uint64)
                if nth == 0:
                    now, own = b, s
                    continue
                x, y = (own, s) if len(own) < len(s) else (s, own)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if common * similarity.den >= similarity.num * (len(x) + len(y) - common):
                    found.append((a, now))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # a repeated row of a representative would only repeat a comparison
    sets = texts.mapInPandas(make, "ih long, th long, s binary").join(wanted, ["ih", "th"]).select("b", "block", "nth", "sid", "s")
    sets = sets.repartition("b", "block").sortWithinPartitions("b", "block", "nth")
    links = stored(sets.mapInPandas(check, "a long, b long").distinct(), "verified")
    for table in (pairs, wanted):
        discard(table)
    return links


def _cells(rows: pd.DataFrame) -> np.ndarray:
    """Which mark stands for a representative, by the hashes of its id and text."""
    both = rows["ih"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows["th"].to_numpy(np.int64).view(np.uint64)
    return (mix(both) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def marked(wanted: DataFrame) -> np.ndarray:
    """2 ** MARK_BITS marks, one for each (ih, th): of fixed size, whatever the input. What has no mark is not wanted, so its set is neither made nor sent."""
    size, chunk = 1 << (MARK_BITS - 3), 1 << (MARK_BITS - 9)

    def mark(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(size << 3, bool)
        for rows in frames:
            marks[_cells(rows)] = True
        data = np.packbits(marks, bitorder="little")
        for i in range(0, size, chunk):
            if data[i : i + chunk].any():
                yield pd.DataFrame({"chunk": [i], "some": [TaskContext.get().partitionId() % 32], "marks": [data[i : i + chunk].tobytes()]})

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in rows["marks"]])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "marks": [data.tobytes()]})

    found = wanted.mapInPandas(mark, "chunk int, some int, marks binary")
    found = found.groupBy("chunk", "some").applyInPandas(either, "chunk int, marks binary").groupBy("chunk").applyInPandas(either, "chunk int, marks binary")
    out = np.zeros(size, np.uint8)
    for r in found.collect():  # 2 ** MARK_BITS bits
        out[r["chunk"] : r["chunk"] + chunk] = np.frombuffer(r["marks"], np.uint8)
    return out


def _bounded(pairs: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs whose points leave a link possible."""

    def check(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                p, q = (np.frombuffer(b"".join(rows[c]), "<u4").reshape(-1, COORDINATES) for c in ("pa", "pb"))
                yield rows.loc[may_link(p, q, similarity), ["a", "b"]]

    of = nodes.select("sid", "n", "point")
    both = pairs.join(of.toDF("a", "na", "pa"), "a").join(of.toDF("b", "nb", "pb"), "b")
    near = (F.col("na") * similarity.den >= F.col("nb") * similarity.num) & (F.col("nb") * similarity.den >= F.col("na") * similarity.num)
    return both.filter(near).select("a", "b", "pa", "pb").mapInPandas(check, "a long, b long")


def _across(members: DataFrame, similarity: Similarity) -> DataFrame:
    """Pairs of members of a bucket with different labels that the bound leaves; `members`: (key, sid, label, point).

    A bucket beyond BLOCK members is dealt into blocks, and any two blocks meet in a task of their own.
    """
    size = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "key").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "label", "point")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        points = np.frombuffer(b"".join(rows["point"]), "<u4").reshape(-1, COORDINATES)
        sid, label, own = rows["sid"].to_numpy(), rows["label"].to_numpy(), rows["own"].to_numpy()
        left, right = own == rows["i"].iloc[0], own == rows["j"].iloc[0]
        found = []
        if left.any() and right.any():
            p, q = np.flatnonzero(left), np.flatnonzero(right)
            a_tree = RTree(points[p])
            for i, j in a_tree.pairs(a_tree if left is right else RTree(points[q]), similarity):
                i, j = p[i], q[j]
                ok = label[i] != label[j]
                found.append(np.stack([np.maximum(sid[i], sid[j])[ok], np.minimum(sid[i], sid[j])[ok]], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    # dealt out explicitly, as rows that are partitioned by key already would leave all blocks of a bucket in one task
    return dealt.repartition("key", "i", "j").groupBy("key", "i", "j").applyInPandas(join, "a long, b long").distinct()


def near_duplicates(
    documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document (id, n_shingles, component_id): documents link whose sets of k-word shingles have a Jaccard similarity >= num / den.

    A-Z is lower-cased; words stand between ASCII white space. Fewer than k words are one shingle; a null or blank text has none and is linked with
    nothing. component_id is the smallest id reachable by links, the own id included; rows with a null id take part, and their component_id is
    null where no member has an id. One row per input row.

    1. Each text is read once for its set's identity, size, point (COORDINATES group counts) and lists of keys (`group_keys`). Copies share an identity
       and are one node from here on; counting them is combined before the shuffle. All documents' keys are counted in a table of fixed size, and every set
       keeps its rarest keys (`choose`), so that boilerplate brings nothing together that has rarer parts.
    2. Nodes that share a key form a bucket. Every node is compared with the smallest node that it meets in any bucket: by size and by the summed minima of
       their points, then exactly. These links make components. In buckets that still hold several, members are compared with the bucket's smallest one.
       Sets are made again from the texts that are wanted, and only they are shuffled.
    3. Buckets whose members even now lie in several components are joined inside by an R-tree over the points, those that overlap as one (`_families`);
       pairs within a component are skipped, what the bound leaves is verified exactly. The links of 2 and 3 make the components.

    No pair of linked sets is lost: they share a bucket, and there either have one component or are compared. Nothing is capped; a group of
    near copies costs its members about once in 2, and pairs are made only across components in 3.
    """
    similarity = Similarity(num, den)
    known = stored(describe(documents, k, similarity, id_col, text_col), "described")
    with_set = known.filter("sid is not null")
    nodes = with_set.groupBy("sid").agg(
        F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("point").alias("point")
    )
    nodes = stored(nodes, "nodes")
    described = stored(known.select("id", "sid", "n"), "sets-of")
    dealt = stored(chosen_keys(known, similarity), "keys")
    discard(known)
    buckets = dealt.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high")
    buckets = stored(buckets.select("key", "low"), "buckets")
    members = stored(dealt.join(buckets, "key").distinct(), "members")
    discard(dealt)
    discard(buckets)

    def linked(pairs: DataFrame) -> DataFrame:
        return verified(documents, _bounded(pairs, nodes, similarity), nodes, k, similarity, id_col, text_col)

    first = members.groupBy("sid").agg(F.min("low").alias("low")).filter("low < sid")
    tried = stored(first.select(F.col("sid").alias("a"), F.col("low").alias("b")), "tried")
    links = linked(tried)
    held = _mixed(members, components(links))
    more = held.filter("sid <> low and label <> low_label").select(F.col("sid").alias("a"), F.col("low").alias("b")).distinct()
    more = stored(more.join(tried, ["a", "b"], "left_anti"), "more")
    links = stored(links.unionByName(linked(more)), "links")
    held = _mixed(members, components(links))
    inside = _families(held)
    known_pairs = tried.unionByName(more).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = _across(inside.join(nodes.select("sid", "point"), "sid"), similarity).join(known_pairs, ["a", "b"], "left_anti")
    label = components(links.unionByName(linked(rest)))

    reached = nodes.join(label.withColumnRenamed("node", "sid"), "sid").groupBy("label").agg(F.min("least").alias("component"))
    reached = label.join(reached, "label").select(F.col("node").alias("sid"), "component")
    group = stored(nodes.join(reached, "sid", "left").select("sid", F.coalesce("component", "least").alias("component")), "groups")
    for table in (nodes, members, tried, more, links, held, inside):
        discard(table)
    return described.join(group, "sid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def _families(held: DataFrame) -> DataFrame:
    """(key, sid, label): groups in which any two members of a mixed bucket meet that have not met its smallest one only.

    Near copies share many buckets of slightly different members. So buckets that have members in common are one group, as long as that has at most FAMILY
    members; beyond, each bucket is a group, each distinct set of members once. A bucket of two has nothing left to compare.
    """
    once = held.groupBy("key").agg(
        F.count("*").alias("c"), F.sum(F.xxhash64("sid") % (1 << 40)).alias("s"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("x")
    )
    once = stored(once.filter("c > 2").groupBy("c", "s", "x").agg(F.min("key").alias("key")).select("key"), "once")
    rows = stored(held.join(once, "key").select("key", "sid", "low", "label"), "rows")
    family = components(rows.filter("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))).toDF("sid", "family")
    size = family.groupBy("family").agg(F.count("*").alias("size"))
    family = stored(family.join(size, "family"), "family")
    group = F.when(F.col("size") <= FAMILY, F.xxhash64("family", F.lit("family"))).otherwise(F.col("key"))
    groups = stored(rows.join(family, "sid").select(group.alias("key"), "sid", "label").distinct(), "inside")
    for table in (once, rows, family):
        discard(table)
    return groups


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, sid, low, label, low_label) of the buckets whose members lie in several components."""
    of = label.select(F.col("node").alias("sid"), "label")
    own = members.join(of, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    own = stored(own.join(of.toDF("low", "low_label"), "low", "left").withColumn("low_label", F.coalesce("low_label", "low")), "labelled")
    several = own.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l <> h").select("key")
    out = stored(own.join(stored(several, "several"), "key"), "held")
    discard(own)
    return out


def keep_one(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents` whose id is their component's, repeated rows once; rows with a null id cannot be told apart and stay."""
    groups = near_duplicates(documents, k, num, den, id_col, text_col)
    kept = groups.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    first = documents.join(kept, documents[id_col] == F.col("_kept"), "left_semi").dropDuplicates([id_col, text_col])
    return first.unionByName(documents.filter(F.col(id_col).isNull()))
