"""Removal of every byte that a string of ``length`` bytes covers which starts at two places at least.

1.  Every window of ``length`` bytes names the leftmost smallest hash of its ``gram``-byte strings as its anchor;
    equal windows name equal anchors at equal offsets. About two anchors fall into each length - gram + 1 bytes.
2.  Anchors are counted by their gram. Only texts that hold a gram of two places or more go on, with the bytes
    around these anchors: all windows that name one, and no others.
3.  Equal contexts are compared once. Within each gram's contexts, buckets are refined: the first are those of equal grams; sorting on (bucket here,
    bucket one gram later) gives buckets of two grams, and the same step on these gives four, reused until
    ``length`` bytes are told apart. A window whose last bucket holds two or more is repeated.
4.  A gram of very many places is dealt out in parts. Each part settles what repeats inside it and passes on the
    contexts that show some window for the first time; a second refinement compares these across parts.

Texts that are equal as a whole are found by digest and take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, cut, powers, prefix_hash, splitmix, utf8

#: Contexts of one gram that one part holds on average.
PART_CONTEXTS = 1000
#: Bytes of contexts that one refinement works on, grams kept whole.
REFINE_BYTES = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_SLICE = 1 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, text number, anchor, windows before it, windows after it) of texts data[at[i]:at[i + 1]]."""
    for low in range(0, max(0, len(data) - length + 1), _SLICE):
        held = data[low : low + _SLICE + length - 1]
        _, inverse = powers(len(held) + 1)
        c = prefix_hash(held)
        h = splitmix((c[gram:] - c[:-gram]) * inverse[: len(held) - gram + 1])
        tagged = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        least = _sliding_min(tagged, length - gram + 1)
        start = np.arange(low, low + len(least))
        text = np.searchsorted(at[1:], start, side="right")
        ok = start + length <= at[1:][np.minimum(text, len(at) - 2)]
        p, text, chosen = np.flatnonzero(ok), text[ok], (least[ok] & _PLACE).astype(np.int64)
        if not len(p):
            continue
        edge = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1))))
        last = np.concatenate((edge[1:], [len(p)])) - 1
        a = chosen[edge]
        yield h[a].view(np.int64), text[edge], a + low - at[text[edge]], a - p[edge], p[last] - a


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, b in blocks(at):
                keys = [hashlib.md5(data[at[i] : at[i + 1]], usedforsecurity=False).digest() for i in range(a, b)]
                fresh = np.zeros(b - a, bool)
                for i, key in enumerate(keys):
                    fresh[i] = key not in seen
                    seen.add(key)
                named = pa.array(keys, pa.binary())
                for h, text, place, left, right in anchors(data[at[a] : at[b]], at[a : b + 1] - at[a], length, gram):
                    ok = fresh[text]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[ok]), named.take(pa.array(text[ok])), *(pa.array(x[ok].astype(np.int32)) for x in (place, left, right))],
                        names=["gram", "key", "place", "left", "right"],
                    )

    return run


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            lists = batch.column(2)
            of = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            gram, place, left, right, salt = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            begin = place - left
            for a in range(0, len(of), 4096):
                b = min(a + 4096, len(of))
                held = [data[at[i] + s : at[i] + e].tobytes() for i, s, e in zip(of[a:b], begin[a:b], (place + right)[a:b] + length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[a:b]), pa.array(salt[a:b]), batch.column(0).take(pa.array(of[a:b])), pa.array(begin[a:b].astype(np.int32)), pa.array(held, pa.binary())],
                    names=["gram", "salt", "key", "begin", "held"],
                )

    return run


def _buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket number of each key, counted in sorted order, and whether its bucket holds others."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.cumsum(new) - 1
    many = np.bincount(number) > 1
    out = np.empty(len(s), np.int64)
    out[order] = number
    return out, many[out]


def refine(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start of a ``length``-byte window inside data[at[i]:at[i + 1]]: whether it is repeated, and its bucket.

    Starts that are no window's are false and -1. ``length`` has to be gram times a power of two.
    """
    n = len(data)
    size = np.diff(at)
    room = np.repeat(at[1:], size) - np.arange(n)  # bytes to the context's end
    _, inverse = powers(n + 1)
    c = prefix_hash(data)
    live = np.flatnonzero(room >= gram)
    number = np.full(n, -1, np.int64)
    got, many = _buckets(splitmix((c[live + gram] - c[live]) * inverse[live]))
    live, got = live[many], got[many]
    number[live] = got
    width = gram
    while width < length:
        live = live[room[live] >= 2 * width]
        later = number[live + width]
        live, later = live[later >= 0], later[later >= 0]
        got, many = _buckets((number[live].astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64))
        live, got = live[many], got[many]
        number = np.full(n, -1, np.int64)
        number[live] = got
        width *= 2
    repeated = np.zeros(n, bool)
    repeated[live] = True
    return repeated, number


def _settle(length: int, gram: int, pass_on: bool):
    """Repeated spans of each context, of rows sorted by gram and salt; with pass_on also contexts for the next round."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        one = {k: table.column(k).combine_chunks() for k in table.column_names}
        data, at = utf8(one["held"])
        size, data = np.diff(at), data[at[0] : at[-1]]
        c, (_, inverse), at = prefix_hash(data), powers(len(data) + 1), at - at[0]
        digest = splitmix((c[at[1:]] - c[at[:-1]]) * inverse[at[:-1]] + size.astype(np.uint64))
        _, rep, same, copies = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        data, at = utf8(one["held"].take(pa.array(rep)))
        repeated, number = refine(data, at, length, gram)
        of = np.repeat(np.arange(len(rep)), np.diff(at))
        window = np.repeat(at[1:], np.diff(at)) - np.arange(len(data)) >= length
        repeated |= window & (copies[of] > 1)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], repeated.view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2] - 1  # a run ends inside its context, whose last bytes start no window
        runs = np.bincount(of[first], minlength=len(rep))
        n = runs[same]
        ctx = np.repeat(np.arange(len(same)), n)
        k = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(runs) - runs)[same], n)
        begin = one["begin"].to_numpy()[ctx] - at[same[ctx]]
        none = [pa.nulls(len(ctx), t) for t in (pa.int64(), pa.binary())]
        spans = [pa.array((begin + x).astype(np.int32)) for x in (first[k], last[k] + length)]
        yield pa.RecordBatch.from_arrays([one["key"].take(pa.array(ctx)), *spans, *none], names=["key", "start", "end", "gram", "held"])
        if pass_on:
            keep = np.zeros(len(rep), bool)
            keep[of[_firsts(number)]] = True
            keep[of[window & ((number < 0) | ~repeated)]] = True
            kept = rep[keep & (one["salt"].to_numpy()[rep] >= 0)]
            if len(kept):
                take = {k: one[k].take(pa.array(kept)) for k in ("key", "begin", "gram", "held")}
                yield pa.RecordBatch.from_arrays(
                    [take["key"], take["begin"], pa.nulls(len(kept), pa.int32()), take["gram"], take["held"]], names=["key", "start", "end", "gram", "held"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            gram, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
            if rows:
                new[0] = (rows[-1].column(0)[-1].as_py(), rows[-1].column(1)[-1].as_py()) != (gram[0], salt[0])
            _, at = utf8(batch.column(4))
            done = 0
            for cut_at in np.flatnonzero(new).tolist():
                if held + at[cut_at] - at[done] >= REFINE_BYTES:
                    if cut_at > done:
                        rows.append(batch.slice(done, cut_at - done))
                    yield from work(rows)
                    rows, held, done = [], 0, cut_at
            if done < len(gram):
                rows.append(batch.slice(done))
                held += int(at[-1] - at[done])
        if rows:
            yield from work(rows)

    return run


def _firsts(number: np.ndarray) -> np.ndarray:
    """The first place of each bucket number that is not negative."""
    place = np.flatnonzero(number >= 0)
    first = np.full(int(number.max(initial=-1)) + 1, len(number), np.int64)
    np.minimum.at(first, number[place], place)
    return first[first < len(number)]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        rows = []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text, runs = data[at[i] : at[i + 1]].tobytes(), []
            for s in sorted((x["start"], x["end"]) for x in spans):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            rest, last = hashlib.sha256(), 0
            for s, e in runs:
                rest.update(text[last:s])
                last = e
            rest.update(text[last:])
            rows.append((sum(e - s for s, e in runs), len(runs), rest.hexdigest(), [list(r) for r in runs]))
        if rows:
            removed, spans, sha, runs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(runs, pa.list_(pa.list_(pa.int64())))],
                names=["key", "n_removed", "n_spans", "kept_sha256", "runs"],
            )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs``: what repeats of ``length`` bytes take from each text.

    Texts are UTF-8 bytes, null as empty; matches stay inside one row's text and may overlap, also with
    themselves. ``runs`` lists the removed [start, end) byte ranges, maximal and in order. Rows with equal texts of
    ``length`` bytes or more lose everything, repeated rows included; shorter texts lose nothing. Null ids are
    carried. Other columns are neither read nor returned.
    """
    if length < gram or length % gram or (length // gram) & (length // gram - 1):
        raise ValueError("length has to be gram times a power of two")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"))
    long_ones = texts.where(F.octet_length("__text") >= length)
    key = F.unhex(F.md5(F.col("__text").cast("binary")))
    profile = cut(texts.select("doc_id", key.alias("key"), F.octet_length("__text").cast("long").alias("n_bytes"), F.unhex(F.sha2("__text", 256)).alias("sha")))
    classes = profile.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"))

    found = cut(long_ones.select("__text").mapInArrow(_anchor_rows(length, gram), "gram long, key binary, place int, left int, right int"))
    place = F.xxhash64("key", "place")
    often = found.groupBy("gram").agg(F.count("*").alias("count"), F.min(place).alias("a"), F.max(place).alias("b"))
    often = cut(often.where("a <> b").select("gram", "count"))
    parts = F.ceil(F.col("count") / PART_CONTEXTS).cast("int")
    salt = F.when(parts > 1, F.pmod(F.xxhash64("key", "place"), parts).cast("int")).otherwise(F.lit(-1))
    lists = found.join(often, "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "place", "left", "right", salt.alias("salt"))).alias("places"))
    lists = lists.join(classes.select("key", "rep"), "key")
    named = long_ones.select(key.alias("key"), "doc_id", "__text")
    held = cut(named.join(lists, "key").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "__text", "places"))

    schema = "gram long, salt int, key binary, begin int, held binary"
    spans = "key binary, start int, end int, gram long, held binary"
    contexts = held.mapInArrow(_contexts(length), schema)
    dealt = contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    first = cut(dealt.mapInArrow(_settle(length, gram, True), spans))
    over = first.where("gram IS NOT NULL").select("gram", F.lit(-1).alias("salt"), "key", F.col("start").alias("begin"), "held")
    second = over.repartition("gram").sortWithinPartitions("gram").mapInArrow(_settle(length, gram, False), spans)
    runs = first.where("gram IS NULL").select("key", "start", "end").unionByName(second.select("key", "start", "end"))
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    taken = held.select("key", "__text").dropDuplicates(["key"]).join(runs, "key")
    taken = cut(taken.mapInArrow(_cut_out, "key binary, n_removed long, n_spans long, kept_sha256 string, runs array<array<bigint>>"))

    known = cut(classes.join(taken, "key", "left").drop("rep"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    partly = F.col("n_removed").isNotNull()
    return profile.join(known, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).when(partly, F.col("kept_sha256")).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("runs", F.array().cast("array<array<bigint>>"))).alias("runs"),
    )
