"""Near duplicates by DartMinHash signatures.

A document is the weighted set of its shingles of ``WORDS`` words, the weight
being how often a shingle occurs.  Darts fall on the plane of weight and rank
at rate one, by hashes of the shingle alone; a dart hits a document if its
weight lies below the shingle's weight.  Each dart belongs to one of ``HASHES``
coordinates, and a coordinate's value is the hitting dart of lowest rank.  Only
ranks below a bound are thrown, chosen so that about HASHES * (ln HASHES + 3)
darts hit; a document with an empty coordinate gets twice the bound.  Two
documents agree in a coordinate with the probability of their weighted Jaccard
similarity.

Documents with the same weighted shingles are one class from the start, and
its smallest document stands for it.  Signatures are cut into ``BANDS`` bands
of of ``ROWS`` values, and documents that share a band meet in Spark; of buckets
with the same documents one is looked at.  A task compares all documents of a
bucket exactly, by products of their incidence with the shingles, and hands on
links of similarity ``SIMILARITY`` or more that join each group, one fewer than
it has documents, never all pairs.  A bucket of more than ``CROWD`` documents is
dealt out by document in ``DEALS`` ways, otherwise in each band.  Documents of
it that no chain of links joins then are compared as well: all outside its
largest group with all others, a block of two parts in one task.  So every two
documents that share a bucket are joined if they are similar.  Connected
components of the links are the classes.  Similar documents fail to share any
band with a probability of (1 - s^5)^25, which is 5e-5 at s = 0.8.

Defined results: texts of one to four words have one shingle; texts without a
word are alone in their class; rows of equal id and text share one fate; a null
id sorts first; long texts are shingled whole; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import SpanHash, Texts, U64, chunks, lean, mix, partitions, saved, with_groups, within, words
from wattline.llm.components import components
from wattline.llm.repeats import DOC, NULL_ID, keyed_documents

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Documents of a bucket that are compared in one task; names of shingles at a time.
CROWD = 2048
TILE = 2048
#: Ways in which a larger bucket is dealt out before its parts are compared with one another.
DEALS = 2

_GOLD = U64(0x9E3779B97F4A7C15)
_RANK_BITS = 30  # of a rank's fraction in a signature value
_NONE = ~U64(0)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk's documents in order: document, hash, weight."""
    w = words(t)
    count = np.diff(w.first)
    doc, k = within(np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1)))
    start = w.first[doc] + k
    h = SpanHash(w.hash).of(start, start + np.minimum(count[doc], WORDS)) if len(doc) else np.zeros(0, U64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


_tables: dict[float, np.ndarray] = {}


def _poisson(rate: int) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts in a region of area ``rate``."""
    if rate not in _tables:
        k = np.arange(int(rate + 12 * math.sqrt(rate) + 24))
        logs = k * math.log(rate) - rate - np.append(0, np.cumsum(np.log(np.maximum(k[1:], 1))))
        _tables[rate] = np.cumsum(np.exp(logs))
    return _tables[rate]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(float) * 2.0 ** -53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, hashes: int = HASHES) -> np.ndarray:
    """The values (n, hashes) of documents given by their shingles; rows of
    documents without shingles hold _NONE."""
    out = np.full((n, hashes), _NONE)
    total = np.bincount(doc, weight, n)
    bound = hashes * (math.log(hashes) + 3) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.isin(doc, todo) if len(todo) < n else slice(None)
        _throw(out, doc[mine], h[mine], weight[mine], bound)
        todo = todo[(out[todo] == _NONE).any(1)]
        out[todo] = _NONE
        bound[todo] *= 2
    return out


def _throw(out: np.ndarray, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> None:
    """Region (v, r) holds weights 2^v - 1 to 2^(v+1) - 1 and ranks likewise."""
    flat, hashes = out.reshape(-1), out.shape[1]
    limit = bound[doc]
    r = 0
    while (sel_r := np.flatnonzero(limit > 2 ** r - 1)).size:
        v = 0
        while (sel := sel_r[weight[sel_r] > 2 ** v - 1]).size:
            with np.errstate(over="ignore"):
                seed = mix(h[sel] + U64(1 + 64 * v + r) * _GOLD)
                which, k = within(np.searchsorted(_poisson(2 ** (v + r)), _unit(seed), side="right"))
                dart = mix(seed[which] + (k + 1).astype(U64) * _GOLD)
                other = mix(dart ^ U64(0x5851F42D4C957F2D))
            at = sel[which]
            rank = (2 ** r - 1) + 2 ** r * _unit(dart)
            hit = rank < limit[at]
            if v:
                hit &= (2 ** v - 1) + 2 ** v * ((other & U64(0xFFFFFFFF)).astype(float) * 2.0 ** -32) < weight[at]
            at, rank, dart, other = at[hit], rank[hit], dart[hit], other[hit]
            place = ((other >> U64(32)) * U64(hashes) >> U64(32)).astype(np.int64)
            value = ((rank * 2.0 ** _RANK_BITS).astype(U64) << U64(24)) | (dart & U64(0xFFFFFF))
            np.minimum.at(flat, doc[at] * hashes + place, value)
            v += 1
        r += 1


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit name for each band of each signature."""
    s = sig.reshape(len(sig), BANDS, ROWS)
    h = np.tile(mix(np.arange(1, BANDS + 1)), (len(sig), 1))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h * _GOLD + s[:, :, k])
    return h


def _signed(docs: DataFrame) -> DataFrame:
    """doc, ver, alt, the digest of the weighted shingles (a, b; null without
    shingles), and the bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch, "text"):
                doc, h, weight = shingles(t)
                n = len(t)
                sums = []
                for salt in (1, 2):
                    c = np.zeros(len(h) + 1, U64)
                    with np.errstate(over="ignore"):
                        np.cumsum(mix(h ^ mix(np.array([salt], U64))) * weight.astype(U64), out=c[1:])
                        at = np.searchsorted(doc, np.arange(n + 1))
                        sums.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                none = np.bincount(doc, minlength=n) == 0
                sig = signatures(doc, h, weight, n)
                b = bands(sig).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k)[t.rows] for k in DOC], pa.array(sums[0], mask=none),
                     pa.array(sums[1], mask=none),
                     pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), b.ravel())],
                    [*DOC, "a", "b", "bands"])

    return docs.select(*DOC, "text").mapInArrow(lean(run), f"{_ME}, a long, b long, bands array<long>")


def _named_shingles(docs: DataFrame) -> DataFrame:
    """doc, ver, alt, and the weighted shingles as sorted 32-bit names, one for
    each occurrence; once for rows of equal id and text, which ``docs`` has in
    one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            new = []
            for key in zip(*[batch.column(k).to_pylist() for k in DOC]):
                new.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for t in chunks(batch, "text"):
                doc, h, weight = shingles(t)
                of, k = within(weight)
                with np.errstate(over="ignore"):
                    name = mix(h[of] + k.astype(U64) * _GOLD) >> U64(32)
                owner = doc[of]
                name = np.sort((owner.astype(U64) << U64(32)) | name).astype(np.uint32)
                at = np.searchsorted(owner, np.arange(len(t) + 1))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k)[t.rows] for k in DOC],
                     pa.array([name[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                    [*DOC, "names"])

    return docs.mapInArrow(lean(run), f"{_ME}, names binary")


def common(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each document of ``left`` has in common with each of
    ``right`` (default: of ``left``), by products of their incidence with TILE
    shingles at a time."""
    sets = left if right is None else left + right
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    keep = np.bincount(flat)[flat] > 1  # those of one document alone don't count
    flat, owner = np.unique(flat[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    for lo in range(0, int(flat[-1]) + 1 if len(flat) else 0, TILE):
        a, b = np.searchsorted(flat, (lo, lo + TILE))
        m = np.zeros((len(sets), TILE), np.float32)
        m[owner[a:b], flat[a:b] - lo] = 1
        out += m[:len(left)] @ (m if right is None else m[len(left):]).T
    return out


def linked(names: list[np.ndarray], threshold: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join all documents of a bucket that chains of similar pairs
    join, one fewer than documents in each group; and each document's first."""
    m = len(names)
    size = np.array([len(x) for x in names], float)
    first = np.arange(m)
    links: list[tuple[int, int]] = []
    # similarity >= t  <=>  (1 + t) * common >= t * (sum of sizes)
    near = lambda both, i, of: (1 + threshold) * np.asarray(both, float) >= threshold * (size[i] + size[of]) - 1e-6
    if m == 2:
        if near(len(np.intersect1d(*names, assume_unique=True)), 0, 1):
            return [(0, 1)], np.zeros(2, int)
        return links, first
    tiles = [np.arange(lo, min(lo + CROWD, m)) for lo in range(0, m, CROWD)]
    for of in tiles:
        both = common([names[i] for i in of])
        todo = np.ones(len(of), bool)
        for root in range(len(of)):
            if not todo[root]:
                continue
            todo[root] = False
            queue = [root]
            while queue:
                i = queue.pop()
                new = np.flatnonzero(todo & near(both[i], of[i], of))
                todo[new] = False
                first[of[new]] = of[root]
                links += [(int(of[i]), int(of[j])) for j in new]
                queue += new.tolist()
    for k, left in enumerate(tiles):  # groups of different tiles
        for right in tiles[:k]:
            both = common([names[i] for i in left], [names[i] for i in right])
            i, j = np.nonzero(near(both, left[:, None], right[None, :]))
            groups = np.unique(np.column_stack([first[left[i]], first[right[j]]]), axis=0, return_index=True)[1]
            for g in groups:
                x, y = int(left[i[g]]), int(right[j[g]])
                a, b = first[x], first[y]
                if a != b:
                    first[first == max(a, b)] = min(a, b)
                    links.append((y, x))
    return links, first


def crossed(left: list[np.ndarray], right: list[np.ndarray], group_left: list, group_right: list,
            threshold: float) -> list[tuple[int, int]]:
    """Links (index in left, index in right) that join all groups which a
    similar pair of a document of ``left`` and one of ``right`` joins."""
    code = {g: k for k, g in enumerate(dict.fromkeys([*group_left, *group_right]))}
    a, b = (np.array([code[g] for g in x]) for x in (group_left, group_right))
    size = [np.array([len(x) for x in side], float) for side in (left, right)]
    both = common(left, right)
    i, j = np.nonzero(((1 + threshold) * both.astype(float) >= threshold * (size[0][:, None] + size[1][None, :]) - 1e-6)
                      & (a[:, None] != b[None, :]))
    one = np.unique(np.column_stack([a[i], b[j]]), axis=0, return_index=True)[1]
    root = list(range(len(code)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for x, y in zip(i[one].tolist(), j[one].tolist()):
        p, q = find(a[x]), find(b[y])
        if p != q:
            root[max(p, q)] = min(p, q)
            links.append((x, y))
    return links


_ME = ", ".join(f"{k} long" for k in DOC)
_LINKS = f"{_ME}, " + ", ".join(f"other_{k} long" for k in DOC)


def _buckets(rows: DataFrame, keys: list[str], order: list[str], links_of: Callable[[list[tuple], list[np.ndarray]], list]
             ) -> DataFrame:
    """Links between the documents of each bucket; ``links_of`` gets their rows
    (``order``) and names, and returns pairs of indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: tuple | None = None
        ids: list[tuple] = []
        names: list[np.ndarray] = []
        at = order.index("doc")

        def close() -> Iterator[pa.RecordBatch]:
            links = links_of(ids, names) if len(ids) > 1 else []
            if links:
                out = [(*ids[j][at:at + 3], *ids[i][at:at + 3]) for i, j in links]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 [*DOC, *[f"other_{k}" for k in DOC]])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*keys, *order)]
            for k, row in enumerate(zip(*cols)):
                if row[:len(keys)] != bucket:
                    yield from close()
                    bucket, ids, names = row[:len(keys)], [], []
                ids.append(row[len(keys):])
                names.append(np.frombuffer(batch.column("names")[k].as_buffer(), np.uint32))
        yield from close()

    return (rows.select(*keys, *order, "names").repartition(partitions(rows.sparkSession), *keys)
            .sortWithinPartitions(*keys, *order).mapInArrow(lean(run), _LINKS))


def _linked(members: DataFrame, threshold: float) -> DataFrame:
    return _buckets(members, ["band", "name", "part"], DOC, lambda ids, names: linked(names, threshold)[0])


def _crossed(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links between the two parts of each block, or in its only part."""
    def links_of(ids: list[tuple], names: list[np.ndarray]) -> list[tuple[int, int]]:
        cut = sum(x[0] == 0 for x in ids)
        group = [x[4:] for x in ids]
        lo = cut if cut < len(ids) else 0
        if not cut:
            return []
        return [(i, lo + j) for i, j in crossed(names[:cut], names[lo:], group[:cut], group[lo:], threshold)]

    return _buckets(blocks, ["band", "name", "x", "y"], ["side", *DOC, *[f"root_{k}" for k in DOC]], links_of)


def _blocks(crowds: DataFrame, root: DataFrame) -> DataFrame:
    """The documents of crowded buckets, each once for each block (x, y) of two
    parts it is compared in.  The largest group of a bucket needs no comparison
    in itself, and a bucket that is one group needs none."""
    of = root.select("v.*", F.col("root").alias("r"))
    grouped = saved(crowds.join(of, DOC, "left").withColumn("r", F.coalesce("r", F.struct(*DOC))))
    size = grouped.groupBy("band", "name", "r").agg(F.count(F.lit(1)).alias("m"))
    main = (size.groupBy("band", "name").agg(F.max(F.struct("m", "r")).alias("top"), F.sum("m").alias("n"))
            .where("n > top.m").select("band", "name", F.col("top.r").alias("main"),
                                       F.ceil((F.col("n") - F.col("top.m")) / CROWD).cast("int").alias("others"),
                                       F.ceil(F.col("top.m") / CROWD).cast("int").alias("mains")))
    inside = F.col("r") == F.col("main")
    deal = F.hash(*DOC, "band", F.lit(DEALS))
    part = F.when(inside, F.col("others") + F.pmod(deal, F.col("mains"))).otherwise(F.pmod(deal, F.col("others")))
    met = F.sequence(F.lit(0), F.when(inside, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    return grouped.join(main, ["band", "name"]).withColumn("part", part).withColumn("k", F.explode(met)).select(
        "band", "name", F.least("part", "k").alias("x"), F.greatest("part", "k").alias("y"),
        (F.col("part") > F.col("k")).cast("int").alias("side"), *DOC, *[F.col(f"r.{k}").alias(f"root_{k}") for k in DOC])


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` of keyed_documents; returns doc, ver, alt, class_doc, class_ver,
    class_alt, one row per document."""
    me = F.struct(*DOC)
    signed = saved(_signed(docs))
    stands = saved(signed.where("a is not null").groupBy("a", "b").agg(
        F.min(me).alias("rep"), F.min_by("bands", me).alias("bands")))
    banded = stands.select("rep.*", F.posexplode("bands").alias("band", "name"))
    # buckets with the same documents (as near copies have in many bands) are looked at once
    shared = (banded.groupBy("band", "name").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*DOC)).alias("x"))
              .where("n > 1").groupBy("n", "x").agg(F.min(F.struct("band", "name")).alias("one")).select("one.*", "n"))
    members = saved(banded.join(shared.hint("shuffle_hash"), ["band", "name"]))
    need = members.select(*DOC).distinct()
    todo = docs.select(*DOC, "text").repartition(partitions(docs.sparkSession), *DOC).join(need.hint("shuffle_hash"), DOC)
    names = saved(_named_shingles(todo))
    parts = F.ceil(F.col("n") / CROWD)
    deals = F.array(*[k * parts + F.pmod(F.hash(*DOC, "band", F.lit(k)), parts) for k in range(DEALS)])
    dealt = members.withColumn("part", F.explode(F.when(F.col("n") > CROWD, deals).otherwise(F.array(F.lit(-1).cast("long")))))
    pairs = lambda links: links.select(
        F.struct(*[F.col(f"other_{k}").alias(k) for k in DOC]).alias("a"), me.alias("b"))
    root = components(pairs(_linked(dealt.join(names, DOC), similarity)))
    crowds = members.where(F.col("n") > CROWD).select("band", "name", *DOC)
    if not crowds.isEmpty():
        more = pairs(_crossed(_blocks(crowds, root).join(names, DOC), similarity))
        root = components(root.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    by_rep = stands.select("a", "b", "rep").join(root.select(F.col("v").alias("rep"), "root"), "rep", "left").select(
        "a", "b", F.coalesce("root", "rep").alias("rep"))
    return signed.select(*DOC, "a", "b").join(by_rep, ["a", "b"], "left").select(
        *DOC, *[F.coalesce(F.col(f"rep.{k}"), F.col(k)).alias(f"class_{k}") for k in DOC])


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class),
    class_size, and whether the document stands for its class."""
    found = saved(near_classes(keyed_documents(df, id_col, text_col, [id_col]), similarity))
    its = [f"class_{k}" for k in DOC]
    size = saved(found.groupBy(*its).agg(F.count(F.lit(1)).alias("class_size")))
    name = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return with_groups(found, size, its, "class_size").select(
        name("doc").alias(id_col), name("class_doc").alias("class_id"), "class_size", _stands().alias("kept"))


def _stands() -> Column:
    return reduce(and_, [F.col(k) == F.col(f"class_{k}") for k in DOC])


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stand for their class, with the columns of ``df``."""
    docs = keyed_documents(df, id_col, text_col, [c for c in df.columns if c != text_col])
    gone = near_classes(docs, similarity).where(~_stands()).select(*DOC).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), DOC, "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                         for c in df.columns])
