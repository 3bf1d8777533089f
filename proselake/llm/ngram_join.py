"""N-gram Jaccard join: linked texts and their components, by a prefix tree over ordered shingle sets.

1.  One pass over the texts makes every set's size and 128-bit signature, and counts shingles in a table of
    fixed size. Texts with equal sets are one class from here on, so copies are never paired.
2.  All sets are ordered alike: by counted frequency, then by hash. Of a set of n shingles only the first
    n - ceil(t * n) + 1 are sent out; two sets that link share one of them at least.
3.  Shingles that only one class has go; a set's shingles before a shared one then count only if they are shared
    themselves, which bounds overlaps tightly. Within each shingle's classes, neighbours by size and every class
    with the one that lost fewest shingles are verified first: large groups of near copies join by a number of pairs
    linear in their rows. A shingle of very many classes is dealt out by class, and the hubs of its parts are tried with one of them.
4.  What still lies in different components is put into prefix trees, one for each family of sets that shared
    shingles connect; only a family of very many rows is dealt out by shingle. Paths share overlaps; a pair of subtrees is dropped when no two sets in it can reach the threshold with
    the shingles that remain. Pairs that pass are verified as well.

Every verification counts the exact intersection of both texts' shingles, so no approximate step decides a link.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, cut, maybe_broadcast, shingle_sets, shingles, signature, utf8
from .graph import connected_components

#: Counters of the frequency table: 2**20 of 4 bytes, whatever the corpus.
SKETCH_BITS = 20
_PART = 1 << 14
#: Rows up to which a list of ids is broadcast, and fewer if the schema's rows are wide.
BROADCAST_ROWS = 1 << 20
#: Classes of one shingle whose neighbours and hub are found in one task; beyond it they are salted.
TOKEN_ROWS = 50_000
#: Pairs of one hub that one task verifies; a hub of more is copied to as many tasks as it needs.
HUB_PAIRS = 10_000
#: Shingle rows that one prefix tree holds on average.
TREE_ROWS = 50_000


def _profiles(width: int, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for a, sets, edge in shingle_sets(batch.column(1), width):
                hi, lo = signature(sets, edge)
                n = len(edge) - 1
                counts += np.bincount((sets & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
                digest = batch.column(2).slice(a, n) if keyed else pa.nulls(n, pa.binary())
                none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(np.diff(edge)), pa.array(hi), pa.array(lo), digest, *none],
                    names=["doc_id", "n", "hi", "lo", "text_key", "part", "counts"],
                )
        if counts.any():
            parts = [p.astype(np.uint32).tobytes() for p in counts.reshape(-1, _PART)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(len(parts), pa.binary()), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())],
                names=["doc_id", "n", "hi", "lo", "text_key", "part", "counts"],
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_buffer(), np.uint32)
            total[part] = total[part] + x if part in total else x.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.clip(max=2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())],
            names=["part", "counts"],
        )


def _prefixes(width: int, num: int, den: int, table):
    """Rows (token, class, size << 32 | position) of every class's prefix, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = table.value, set()
        for batch in batches:
            for _, sets, edge in shingle_sets(batch.column(0), width):
                _, lo = signature(sets, edge)
                count = frequency[(sets & np.uint64(len(frequency) - 1)).astype(np.int64)]
                tokens, classes, places = [], [], []
                for i, key in enumerate(lo.tolist()):
                    a, b = edge[i], edge[i + 1]
                    if a == b or key in seen:
                        continue
                    seen.add(key)
                    n = int(b - a)
                    k = n - -(-num * n // den) + 1
                    tokens.append(sets[a:b][np.argsort(count[a:b], kind="stable")[:k]])
                    classes.append(np.full(k, key, np.int64))
                    places.append((n << 32) + np.arange(k, dtype=np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(places))],
                        names=["token", "class", "place"],
                    )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class, those whose token another class has too; holds back one row."""
    held, with_last = np.zeros((3, 0), np.int64), False
    for batch in batches:
        x = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
        x = x[:, new]
        like_next = x[0, :-1] == x[0, 1:]
        keep = like_next.copy()
        keep[1:] |= like_next[:-1]
        if len(keep):
            keep[0] |= with_last
            with_last = bool(like_next[-1])
        out, held = x[:, :-1][:, keep], x[:, -1:]
        if out.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["token", "class", "place"])
    if with_last:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["token", "class", "place"])


class _Node:
    __slots__ = ("children", "depth", "ends", "high", "low", "near", "parent", "rest")

    def __init__(self, parent: _Node | None):
        self.parent, self.children, self.ends = parent, {}, []
        self.low, self.high = 1 << 62, 0  # sizes in the subtree
        self.near, self.rest = 0, 0  # most shingles up to and behind this one, in any set of the subtree


def tree_pairs(rows: list[tuple[int, int, int, int, int, int]], num: int, den: int) -> set[tuple[int, int]]:
    """Pairs of classes of different components that share a token and can reach num / den.

    rows: (token, class, size, position, shared shingles before it, component). Each class's tokens, by position,
    are a path of the tree; a token's nodes are chained. For two nodes of a token (or one with itself) all sets
    below both share it: they hold at most ``near`` common shingles up to it and ``rest`` behind it, which drops
    whole subtrees.
    """
    paths = defaultdict(list)
    size, part = {}, {}
    for token, key, n, place, before, component in rows:
        paths[key].append((place, token, before))
        size[key], part[key] = n, component
    root, chain = _Node(None), defaultdict(list)
    for key, path in paths.items():
        node, n = root, size[key]
        for place, token, before in sorted(path):
            step = node.children.get(token)
            if step is None:
                step = node.children[token] = _Node(node)
                chain[token].append(step)
            step.low, step.high = min(step.low, n), max(step.high, n)
            step.near, step.rest = max(step.near, before + 1), max(step.rest, n - place - 1)
            node = step
        node.ends.append(key)

    place_of = {(key, token): (before, place) for key, path in paths.items() for place, token, before in path}

    def below(node: _Node) -> dict[int, list[int]]:
        """The classes of a subtree by component: only pairs across components are looked at."""
        out, stack = defaultdict(list), [node]
        while stack:
            x = stack.pop()
            for key in x.ends:
                out[part[key]].append(key)
            stack += x.children.values()
        return out

    def can(near: int, rest: int, smaller: int, larger: int) -> bool:
        return den * smaller >= num * larger and (num + den) * (near + rest) >= num * (smaller + larger)

    found: set[tuple[int, int]] = set()
    for token, nodes in chain.items():
        members = [below(x) for x in nodes]
        for i, u in enumerate(nodes):
            for j in range(i, len(nodes)):
                v = nodes[j]
                if den * min(u.high, v.high) < num * max(u.low, v.low):
                    continue
                if (num + den) * (min(u.near, v.near) + min(u.rest, v.rest)) < num * (u.low + v.low):
                    continue
                for x, first in members[i].items():
                    for y, second in members[j].items():
                        if x == y or (i == j and x > y):
                            continue
                        for a, b in product(first, second):
                            pair = (a, b) if a < b else (b, a)
                            if pair in found:
                                continue
                            (s, p), (t, q), m, n = place_of[a, token], place_of[b, token], size[a], size[b]
                            if can(min(s, t) + 1, min(m - p, n - q) - 1, min(m, n), max(m, n)):
                                found.add(pair)
    return found


def _trees(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        found = tree_pairs(rows, num, den)
        if found:
            a, b = np.array(sorted(found), dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _packed(width: int):
    """(class, compressed lower-cased text) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, sets, edge in shingle_sets(batch.column(0), width):
                _, lo = signature(sets, edge)
                texts = [pack(LOWER[data[at[i] : at[i + 1]]].tobytes()) for i in range(a, a + len(lo))]
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(texts, pa.binary())], names=["class", "packed"])

    return run


def _verified(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple[int, np.ndarray] | None = None

        def sets(packed: list) -> list[np.ndarray]:
            texts = [unpack(x) for x in packed]
            at = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
            s, edge = shingles(np.frombuffer(b"".join(texts), np.uint8), at, width)
            return [s[edge[i] : edge[i + 1]] for i in range(len(texts))]

        for batch in batches:
            keep = []
            a, b, pa_, pb = (c.to_pylist() for c in batch.columns)
            for i in range(0, len(a), 64):
                right = sets(pb[i : i + 64])
                for k, y in zip(range(i, min(i + 64, len(a))), right, strict=True):
                    if last is None or last[0] != a[k]:
                        last = (a[k], sets([pa_[k]])[0])
                    x = last[1]
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def _verify(texts: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of ``a long, b long`` those whose exact shingle sets reach num / den."""
    wanted = pairs.select(F.col("a").alias("lo")).unionByName(pairs.select(F.col("b").alias("lo"))).distinct()
    ids = cut(reps.join(wanted, "lo").select(F.col("rep").alias("__rep")).distinct())
    held = texts.join(maybe_broadcast(ids.where("__rep IS NOT NULL"), BROADCAST_ROWS), F.col("__id") == F.col("__rep"), "left_semi")
    if ids.where("__rep IS NULL").limit(1).count():  # sets that only rows without an id have
        held = held.unionByName(texts.where("__id IS NULL"))
    packed = cut(held.select("__text").mapInArrow(_packed(width), "class long, packed binary").dropDuplicates(["class"]))
    left = packed.select(F.col("class").alias("a"), F.col("packed").alias("x"))
    right = packed.select(F.col("class").alias("b"), F.col("packed").alias("y"))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("salts")).where("salts > 1")  # hubs: few, a row for each HUB_PAIRS pairs at most
    salts = maybe_broadcast(cut(salts), BROADCAST_ROWS)
    dealt = pairs.join(salts, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).alias("salt"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    both = dealt.join(right, "b").join(left.join(salts, "a", "left").select("a", "x", copies), ["a", "salt"]).select("a", "b", "x", "y")
    return both.mapInArrow(_verified(width, num, den), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, keyed: bool = False) -> DataFrame:
    """``doc_id, n_shingles long, component_id``: each row's set size and the smallest id that links reach.

    Words are lower-cased (A-Z) runs of anything but the six ASCII white-space characters. A set holds the distinct
    ``width``-word shingles, or the whole sequence if there are fewer words. Two rows link when
    den * intersection >= num * union. Null, empty and wordless texts have size 0 and link with nothing; equal
    texts always link otherwise. ``keyed`` adds ``text_key``, the text's md5, and ``group``, a number of the component (null
    without a set). Rows whose id is null link like others; a component without any id has a null one. Very long texts are read whole, an empty
    table gives an empty one. Repeated rows give repeated rows. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    key = [F.unhex(F.md5(F.col("__text").cast("binary")))] if keyed else []
    made = cut(texts.select("*", *key).mapInArrow(_profiles(width, keyed), "doc_id long, n long, hi long, lo long, text_key binary, part int, counts binary"))
    profiles = made.where("part IS NULL").select("doc_id", "n", "hi", "lo", "text_key")
    sums = made.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(_summed, "part int, counts binary")
    frequency = np.zeros(1 << SKETCH_BITS, np.uint32)
    for part, counts in sums.collect():  # 64 rows of 64 KB
        frequency[part * _PART : (part + 1) * _PART] = np.frombuffer(counts, np.uint32)
    table = spark.sparkContext.broadcast(frequency)

    reps = cut(profiles.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    sent = texts.select("__text").mapInArrow(_prefixes(width, num, den, table), "token long, class long, place long")
    shared = cut(sent.repartition("token").sortWithinPartitions("token", "class").mapInArrow(_shared, "token long, class long, place long"))

    shared = shared.select("token", "class", F.expr("place >> 32").alias("n"), F.expr("place & 4294967295").alias("p"))
    before = F.row_number().over(Window.partitionBy("class").orderBy("p")) - 1
    shared = cut(shared.withColumn("s", before.cast("long")))

    salts = shared.groupBy("token").agg(F.ceil(F.count("*") / TOKEN_ROWS).alias("salts")).where("salts > 1")  # few: one for each TOKEN_ROWS rows at most
    salted = shared.join(maybe_broadcast(cut(salts), BROADCAST_ROWS), "token", "left")
    salted = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("class"), F.col("salts")), F.lit(0)))
    near = Window.partitionBy("token", "salt").orderBy("n", "class")
    whole = Window.partitionBy("token", "salt")
    one = F.struct("n", "p", "s", "class")
    least = F.struct((F.col("p") - F.col("s")).alias("lost"), one.alias("at"))
    sided = salted.withColumn("hub", F.min(least).over(whole).getField("at")).withColumn("next", F.lag(one).over(near))
    hubs = salted.where("salts IS NOT NULL").groupBy("token", "salt").agg(F.min(least).alias("least"))
    across = hubs.join(hubs.groupBy("token").agg(F.min("least.at").alias("top")), "token").select("least.at.*", F.array("top").alias("o"))
    tried = sided.select("n", "p", "s", "class", F.array("hub", "next").alias("o")).unionByName(across)
    tried = tried.select("n", "p", "s", "class", F.explode("o").alias("o")).where("o IS NOT NULL AND o.class <> class")
    reach = (F.least("s", "o.s") + F.least(F.expr("n - p"), F.expr("o.n - o.p"))) * (num + den)
    tried = tried.where((F.least("n", "o.n") * den >= F.greatest("n", "o.n") * num) & (reach >= (F.col("n") + F.col("o.n")) * num))
    pairs = cut(tried.select(F.least("class", "o.class").alias("a"), F.greatest("class", "o.class").alias("b")).distinct())
    links = cut(_verify(texts, reps, pairs, width, num, den))
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    known = shared.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    known = cut(known)
    mixed = known.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    rest = cut(known.join(mixed, "token", "left_semi").select("token", "class", "n", "p", "s", "component"))
    hubs = rest.groupBy("token").agg(F.min("class").alias("v"))
    families = connected_components(rest.join(hubs, "token").select(F.col("class").alias("u"), "v").distinct())
    rest = cut(rest.join(families.select(F.col("node").alias("class"), F.col("component").alias("family")), "class"))
    parts_of = rest.groupBy("family").agg(F.ceil(F.count("*") / TREE_ROWS).alias("parts"))
    dealt = rest.join(parts_of, "family").withColumn("part", F.pmod(F.xxhash64("token"), F.col("parts")))
    trees = max(1, -(-rest.count() // TREE_ROWS))
    dealt = dealt.repartition(trees, "family", "part").select("token", "class", "n", "p", "s", "component")
    more = dealt.mapInArrow(_trees(num, den), "a long, b long").distinct()
    more = cut(more.join(pairs, ["a", "b"], "left_anti"))
    edges = links.unionByName(_verify(texts, reps, more, width, num, den))

    found = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = cut(reps.join(found, F.col("lo") == F.col("node"), "left").select("hi", "lo", "rep", F.coalesce("component", "lo").alias("group")))
    least = classes.groupBy("group").agg(F.min("rep").alias("found"))
    classes = classes.join(least, "group").select("hi", "lo", "found", "group")
    return profiles.join(classes, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"), *(["text_key", "group"] if keyed else [])
    )


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of every component the row with its smallest doc_id, all columns; see jaccard_components.

    Rows without shingles stay. Repeated rows of one id and text are one row. Of a component whose rows all have no id
    the one with the smallest md5 of its text stays. An empty table gives an empty one; other columns are carried.
    """
    every = cut(jaccard_components(docs, width=width, num=num, den=den, keyed=True))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = every.where("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_key")
    kept = kept.unionByName(every.where("group IS NULL").select("doc_id", "text_key")).toDF("__id", "__key").distinct()
    kept = maybe_broadcast(cut(kept), BROADCAST_ROWS)
    keyed = docs.withColumn("__own", F.unhex(F.md5(F.col("text").cast("binary"))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("__own").eqNullSafe(F.col("__key"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__own"]).drop("__own")
