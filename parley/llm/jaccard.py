"""Operator 1: set-similarity join of documents on word shingles, by token-combination prefixes.

Every document becomes the set of its 5-word shingles (64-bit hashes). One global order puts shingles that were not seen
to be frequent first, and among those the ones with most uncommon words. A document of n shingles can miss at most n - ceil(0.8 n) of them in a partner, so a prefix with one
more shares a token with every partner. Frequent tokens are weak evidence: they are dealt into G groups and indexed as
pairs of one group, and the prefix is extended until n - ceil(0.8 n) + 1 matches count even when the first token of each
group counts for nothing. Rare tokens are indexed alone. That argument needs ceil(0.8 n) > G, so there are spaces by size,
each with a G of its own, and a document enters each space in which a partner could look for it.

Candidates of one index entry are not paired with each other. A hub is compared with the others, the links merge
components, and only entries that still hold several components go on: to another hub, or, once that is little work, to
all pairs between different components. The number of common entries bounds the overlap of a pair from above; sets are
fetched and compared only where that bound allows a link. So no link that could change a component is skipped, and a group of thousands of
near copies costs one comparison a member.

Defined cases: a null or wordless text is the empty set and links with nothing (n_shingles 0, its own component); equal
sets are one node, so copies are never compared; a repeated doc_id is a document a row; a null doc_id takes part and never
is a component's name unless it has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: (above, up to, groups of frequent tokens; 0: every token alone). A space serves sizes up to 1 / threshold times its end.
SPACES = ((0, 100, 0), (100, 1_000, 64), (1_000, 10_000, 640), (10_000, None, 6_400))
#: Frequent shingles kept at most, broadcast as 12 bytes each.
FREQUENT = 1 << 18
#: Shingles that a task counts at once when it looks for frequent ones, and the local count that makes a candidate.
COUNTED, CANDIDATE = 2_000_000, 3
#: Common words kept at most, broadcast as 8 bytes each; a task proposes those that are one in so many of its words.
COMMON, ONE_IN = 1 << 14, 20_000
#: Sets of one entry that are listed in one row at most, about.
BLOCK = 512
#: Bits of the filter over documents that are compared: 16 for each, this many (16 MB) at most.
FILTER_BITS = 1 << 27
#: Index entries that a task deals out at once, shingles of all sets for each part that entries are dealt into, and how many
#: sets of one task must share an entry to be told apart from the part's own work.
DEALT, PART, HOT = 1_000_000, 4_000_000, 64
#: Pairs within entries that are listed without further hubs: so many an entry, or so many in all.
PAIRS, LITTLE = 64, 200_000


def shingle_sets(words: np.ndarray, at: np.ndarray, n: int, common: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's sorted set, and for each shingle how many of its words are not common."""
    odd = np.arange(len(words) + 1)
    if common is not None and len(common):
        odd[1:] = np.cumsum(common[np.minimum(np.searchsorted(common, words), len(common) - 1)] != words)
    for a, b in zip(at[:-1], at[1:], strict=True):
        own, k = words[a:b], min(n, b - a)
        if not k:
            yield own, own.astype(np.int64)
            continue
        items, first = np.unique(C.ngram_hashes(own, k), return_index=True)
        yield items, odd[a + first + k] - odd[a + first]


def set_id(items: np.ndarray) -> int:
    if not len(items):
        return 0
    return int(C.mix(np.array([np.add.reduce(C.mix(items ^ np.uint64(0x5DEECE66D))) + np.uint64(len(items))], np.uint64)).view(np.int64)[0])


def prefix_signatures(items: np.ndarray, odd: np.ndarray, hot_hash: np.ndarray, hot_rank: np.ndarray, percent: int, spaces=SPACES) -> tuple[np.ndarray, int, int]:
    """The index entries of one sorted set, over all spaces in which a partner could be found; how many items lie behind
    the shortest prefix, and in how many groups of frequent tokens the prefixes lie."""
    n, out, shortest, most = len(items), [], len(items), 0
    need = n - (percent * n + 99) // 100 + 1
    rank = np.zeros(n, np.int64)
    if len(hot_hash):
        at = np.minimum(np.searchsorted(hot_hash, items), len(hot_hash) - 1)
        rank = np.where(hot_hash[at] == items, hot_rank[at], 0)
    if rank.any():
        order = np.lexsort((items, -odd, rank))
    else:
        order = np.argsort((np.uint64(7) - odd.astype(np.uint64)) << np.uint64(61) | items >> np.uint64(3), kind="stable")
    tokens, frequent = items[order], rank[order] > 0
    for k, (low, high, groups) in enumerate(spaces):
        if n <= low or (high is not None and percent * n > 100 * high):
            continue
        salt = np.uint64(0x1000193 * (k + 1))
        if not groups or not frequent.any():
            out.append(C.mix(tokens[:need] + salt))
            shortest = min(shortest, need)
            continue
        group = np.where(frequent, (tokens % np.uint64(groups)).astype(np.int64), -1)
        counts = np.ones(n, np.int64)
        first = np.unique(group, return_index=True)[1]
        counts[first[group[first] >= 0]] = 0
        end = int(np.searchsorted(np.cumsum(counts), need)) + 1
        head, group = tokens[:end], group[:end]
        out.append(C.mix(head[group < 0] + salt))
        hot, g = head[group >= 0], group[group >= 0]
        shortest, most = min(shortest, end), max(most, len(np.unique(g)))
        by = np.argsort(g, kind="stable")
        hot, g = hot[by], g[by]
        for step in range(1, int(np.bincount(g).max()) if len(g) else 0):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            a, b = hot[:-step][same], hot[step:][same]
            out.append(C.mix(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(a, b) + salt * np.uint64(31)))
    return np.concatenate(out), n - shortest, most


def _scan(n: int, carry: tuple[str, ...]) -> Callable:
    """A row for each document, and counts of shingles seen several times in one task."""

    def run(frames):
        C.release()
        pool, texts, size, seen = [], [], 0, set()

        def flush():
            for kind, parts in ((1, pool), (2, texts)):
                values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))
                keep = counts >= (CANDIDATE if kind == 1 else max(1, counts.sum() / ONE_IN))
                yield pd.DataFrame({"doc_id": pd.array([None] * int(keep.sum()), "Int64"), "n": pd.array(counts[keep], "Int64"), "sid": values[keep].view(np.int64), "kind": np.int32(kind), **{c: 0 for c in carry}})

        for part in C.text_slices(frames, "text"):
            sids, sizes = [], []
            words, at = C.word_hashes(part["text"].tolist())
            texts.append(words)
            for items, _ in shingle_sets(words, at, n):
                sids.append(set_id(items))
                sizes.append(len(items))
                if len(items) and sids[-1] not in seen:
                    seen.add(sids[-1])
                    pool.append(items)
            size += len(words)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "n": pd.array(sizes, "Int64"), "sid": np.array(sids, np.int64), "kind": np.int32(0), **{c: part[c].array for c in carry}})
            if size >= COUNTED:
                yield from flush()
                pool, texts, size, seen = [], [], 0, set()
        yield from flush()

    return run


def _entries(n: int, percent: int, hot, parts: int) -> Callable:
    """A row for each set, and its index entries (sig, sid) packed for the part that owns them. Of an entry that more than HOT
    sets of a task share, the part gets two; the others need no owner to be known as shared and go to part -1."""

    def run(frames):
        C.release()
        hot_hash, hot_rank, common = hot.value
        seen: set[int] = set()
        pool, size = [], 0

        def flush():
            sids = np.repeat(np.array([sid for sid, _ in pool], np.int64), [len(x) for _, x in pool])
            sigs = np.concatenate([x for _, x in pool])
            order = np.argsort(sigs)
            sigs, sids = sigs[order], sids[order]
            first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            sizes = np.diff(np.append(first, len(sigs)))
            own = (np.repeat(sizes, sizes) <= HOT) | (np.arange(len(sigs)) - np.repeat(first, sizes) < 2)
            owner, at = np.unique((sigs[own] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), return_index=True)
            spans = list(zip(at, [*at[1:], int(own.sum())], strict=True))
            rows = [(int(p), sigs[own][a:b].tobytes(), sids[own][a:b].tobytes()) for p, (a, b) in zip(owner, spans, strict=True)]
            if not own.all():
                rows.append((-1, sigs[~own].tobytes(), sids[~own].tobytes()))
            return pd.DataFrame(rows, columns=["part", "sigs", "sids"]).assign(sid=0, n=0, rest=0, groups=0)

        for part in C.text_slices(frames, "text"):
            rows = []
            for items, odd in shingle_sets(*C.word_hashes(part["text"].tolist()), n, common):
                if len(items) and (sid := set_id(items)) not in seen:
                    seen.add(sid)
                    sigs, rest, groups = prefix_signatures(items, odd, hot_hash, hot_rank, percent)
                    rows.append((-2, b"", b"", sid, len(items), rest, groups))
                    pool.append((sid, sigs))
                    size += len(sigs)
            yield pd.DataFrame(rows, columns=["part", "sigs", "sids", "sid", "n", "rest", "groups"])
            if size >= DEALT:
                yield flush()
                pool, size = [], 0
        if size:
            yield flush()

    return run


def _owned(f: pd.DataFrame) -> pd.DataFrame:
    """The entries of a part that two sets or more share."""
    sigs, sids = (np.frombuffer(b"".join(f[c]), np.int64) for c in ("sigs", "sids"))
    order = np.lexsort((sids, sigs))
    sigs, sids = sigs[order], sids[order]
    fresh = np.ones(len(sigs), bool)
    fresh[1:] = (sigs[1:] != sigs[:-1]) | (sids[1:] != sids[:-1])
    sigs, sids = sigs[fresh], sids[fresh]
    same = sigs[1:] == sigs[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(sigs) else np.empty(0, bool)
    return pd.DataFrame({"sig": sigs[several], "sid": sids[several]})


def _unpacked(frames):
    for f in frames:
        sigs, sids = (np.frombuffer(b"".join(f[c]), np.int64) for c in ("sigs", "sids"))
        yield pd.DataFrame({"sig": sigs, "sid": sids})


def _slot(docs: np.ndarray, bits: int) -> np.ndarray:
    return C.mix(docs.view(np.uint64)) & np.uint64(bits - 1)


def _sets(n: int, needed, bits: int) -> Callable:
    """The sets of the documents that stand for a node which is compared (and of a few others, which find no pair)."""

    def run(frames):
        C.release()
        for f in frames:
            some = f[C.has_bit(needed.value, _slot(f["doc_id"].fillna(0).to_numpy(np.int64), bits))]
            for part in C.text_slices([some], "text"):
                own = zip(part["doc_id"].fillna(0).to_numpy(np.int64), shingle_sets(*C.word_hashes(part["text"].tolist()), n), strict=True)
                yield pd.DataFrame([(set_id(items), doc, items.view(np.int64)) for doc, (items, _) in own if len(items)], columns=["sid", "doc", "items"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of (a, b), by large and small stars."""
    edges = C.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = C.materialize(small, "edges")
        C.remove(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, hub_rounds: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    return _rooted(docs, words, percent, hub_rounds).select("doc_id", "n_shingles", "component_id")


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their components: of each the one with the least id (null
    last), by hash of the text among equal ids, and exactly one whatever repeats. Wordless rows all stay."""
    row = next(c for c in ("_row" + "_" * k for k in range(len(docs.columns) + 1)) if c.lower() not in {x.lower() for x in docs.columns})
    numbered = C.materialize(docs.select("*", F.monotonically_increasing_id().alias(row)), "numbered")
    own = numbered.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("_hash"), F.col(row).alias("_at"))
    rows = _rooted(own, carry=("_hash", "_at"))
    first = rows.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_at")).alias("first")).select(F.col("first._at").alias(row))
    kept = first.union(rows.filter("n_shingles = 0").select(F.col("_at").alias(row)))
    return numbered.join(C.materialize(kept, "kept"), row, "left_semi").select(*docs.columns)


def _rooted(docs: DataFrame, words: int = 5, percent: int = 80, hub_rounds: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, root (the component's set; null for wordless rows), carried long columns of docs."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    scan = C.materialize(docs.mapInPandas(_scan(words, carry), ", ".join(["doc_id long, n long, sid long, kind int", *(f"{c} long" for c in carry)])), "scan")
    docs = docs.select("doc_id", "text")
    rows = scan.filter("kind = 0").drop("kind")
    top = {}
    for kind, most in ((1, FREQUENT), (2, COMMON)):
        counts = scan.filter(F.col("kind") == kind).groupBy("sid").agg(F.sum("n").alias("c"))
        kept = counts.filter(F.col("c") >= C.frequency_floor(counts, "c", most)).toArrow().to_pandas()
        hashes = kept["sid"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(hashes)
        top[kind] = hashes[by], kept["c"].to_numpy(np.int64)[by]
    hot = sc.broadcast((*top[1], top[2][0]))

    nodes = C.materialize(rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n")), "nodes")
    parts = 1 + int(nodes.agg(F.sum("n")).first()[0] or 0) // PART
    nodes = nodes.drop("n")
    entries = C.materialize(docs.mapInPandas(_entries(words, percent, hot, parts), "part long, sigs binary, sids binary, sid long, n int, rest int, groups int"), "entries")
    hot.destroy()
    packed = entries.select("part", "sigs", "sids")
    owned = packed.filter("part >= 0").groupBy("part").applyInPandas(_owned, "sig long, sid long")
    shared = owned.union(packed.filter("part = -1").select("sigs", "sids").mapInPandas(_unpacked, "sig long, sid long")).repartition("sid").distinct()
    about = entries.filter("part = -2").groupBy("sid").agg(*[F.max(c).alias(c) for c in ("n", "rest", "groups")])
    shared = shared.withColumn("central", F.count("*").over(Window.partitionBy("sid"))).join(about.select("sid", "n"), "sid")
    left = C.materialize(shared.select("sig", "sid", "central", "n", F.col("sid").alias("root")), "left")
    info = left.groupBy("sid").agg(F.collect_list("sig").alias("sigs")).join(about, "sid")
    info = C.materialize(info.join(nodes.select("sid", F.coalesce("first_id", F.lit(0)).alias("doc")), "sid"), "info")
    C.remove(entries)

    def of(side: str, *cols: str) -> DataFrame:
        return info.select(*[F.col(c).alias(f"{c}_{side}") for c in ("sid", "doc", *cols)])

    links = spark.createDataFrame([], "a long, b long")
    near = F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * percent
    least = _fewest(*[F.col(f"{c}_{x}") for c in ("n", "rest", "groups") for x in "ab"], percent, F.greatest, F.least, F.ceil)
    ends = ("sid_a", "doc_a", "sid_b", "doc_b")
    for turn in range(hub_rounds + 1):
        per_root = left.groupBy("sig", "root").agg(F.count("*").alias("k"))
        per_sig = per_root.groupBy("sig").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("k").alias("k"))
        todo = per_sig.agg(F.sum("pairs"), F.sum("k")).first()
        if not todo[1]:
            break
        last = turn == hub_rounds or (turn > 0 and todo[0] <= max(PAIRS * todo[1], LITTLE))
        if last:  # a pair that was not compared yet still has all its common entries here
            pairs = _met(left, info, percent).withColumns({"root_a": F.lit(0).cast("long"), "root_b": F.lit(0).cast("long")})
            pairs = pairs.join(of("b"), "sid_b").join(of("a"), "sid_a")
        else:
            hubs = left.groupBy("sig").agg(F.max(F.struct("central", "sid", "n", "root")).alias("hub")).select("sig", F.col("hub.sid").alias("sid_b"), F.col("hub.n").alias("n_b"), F.col("hub.root").alias("root_b"))
            met = left.join(hubs, "sig").filter((F.col("root") != F.col("root_b")) & near)
            met = met.groupBy(F.col("sid").alias("sid_a"), F.col("root").alias("root_a"), "sid_b", "root_b").agg(F.count("*").alias("k"))
            if turn == 0:  # a set meets only the hub of most of its entries, which joins up the bulk of a family by one pair a set
                met = met.groupBy("sid_a", "root_a").agg(F.max(F.struct("k", "sid_b", "root_b")).alias("m")).select("sid_a", "root_a", "m.sid_b", "m.root_b")
            pairs = met.drop("k").join(of("a", "n", "rest", "groups", "sigs"), "sid_a").join(of("b", "n", "rest", "groups", "sigs"), "sid_b")
            pairs = pairs.filter(F.size(F.array_intersect("sigs_a", "sigs_b")) >= least)
        pairs = C.materialize(pairs.select(*ends, "root_a", "root_b"), "pairs")
        both = pairs.select(F.col("doc_a").alias("doc")).union(pairs.select("doc_b")).distinct()
        count = both.count()
        if count:
            bits = min(FILTER_BITS, 1 << max(16, (16 * count - 1).bit_length()))
            needed = sc.broadcast(C.build_bits(both, bits, lambda f, bits=bits: _slot(f["doc"].to_numpy(np.int64), bits)))
            sets = C.materialize(docs.mapInPandas(_sets(words, needed, bits), "sid long, doc long, items array<long>"), "sets")
            needed.destroy()
            found = C.materialize(_verified(pairs, sets, percent), "links")
            links = links.union(found.select("a", "b"))
            C.remove(sets)
        C.remove(pairs)
        if last:
            break
        left = _open(left, hubs if turn else None, found if count else None)
    roots = components(links)
    linked = roots.join(nodes, F.col("node") == F.col("sid")).groupBy("root").agg(F.min("first_id").alias("least"))
    roots = roots.join(linked, "root").select(F.col("node").alias("sid"), "root", "least")
    nodes = nodes.join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("least", "first_id").alias("component_id"))
    nodes = C.materialize(nodes, "roots")  # what follows reads it several times, and long plans fill the driver
    joined = rows.join(nodes, (rows["sid"] == nodes["sid"]) & (rows["n"] > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root", *carry)


def _fewest(n_a, n_b, rest_a, rest_b, groups_a, groups_b, percent: int, largest, smallest, ceil):
    """How many entries two sets of a link have in common at least."""
    return ceil((n_a + n_b) * percent / (100 + percent) - 1e-6) - largest(rest_a, rest_b) - smallest(groups_a, groups_b)


def _met(left: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """sid_a, sid_b: pairs of near size and different roots with enough common entries for a link. The sets of an entry are
    listed in blocks, so that a pair is a number in a list, not a row for each entry that it shares."""
    own = left.drop("n").join(info.select("sid", "n", "rest", "groups"), "sid")
    sized = own.join(left.groupBy("sig").agg(F.count("*").alias("size")), "sig")
    block = F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / BLOCK)).alias("block")
    fields = ("sid", "n", "rest", "groups")
    lists = sized.select("sig", "root", *fields, block).groupBy("sig", "block").agg(F.collect_list(F.struct("root", *fields)).alias("others"))
    fits = F.filter("others", lambda o: (o["root"] > F.col("root")) & (F.least("n", o["n"]) * 100 >= F.greatest("n", o["n"]) * percent))
    met = own.join(lists, "sig").select(*fields, fits.alias("met")).filter(F.size("met") > 0)
    met = met.select(*fields, *[F.col("met").getField(c).alias(f"met_{c}") for c in fields])

    def count(frames):
        C.release()
        for f in frames:
            for n, rest, groups, sid, *met in f[["n", "rest", "groups", "sid", *(f"met_{c}" for c in fields)]].itertuples(index=False):
                other, n_b, rest_b, groups_b = (np.concatenate([np.asarray(x, np.int64) for x in own]) for own in met)
                other, at, common = np.unique(other, return_index=True, return_counts=True)
                enough = common >= _fewest(n, n_b[at], rest, rest_b[at], groups, groups_b[at], percent, np.maximum, np.minimum, np.ceil)
                yield pd.DataFrame({"sid_a": sid, "sid_b": other[enough]})

    each = met.groupBy("sid").agg(*[F.max(c).alias(c) for c in fields[1:]], *[F.collect_list(f"met_{c}").alias(f"met_{c}") for c in fields])
    return each.mapInPandas(count, "sid_a long, sid_b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, and their roots; hot sides are split by adaptive skew joins."""
    left, right = (sets.select(F.col("sid").alias(f"sid_{x}"), F.col("doc").alias(f"doc_{x}"), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = pairs.join(left, ["sid_a", "doc_a"]).join(right, ["sid_b", "doc_b"])
    found = both.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"), "root_a", "root_b", F.size(F.array_intersect("items_a", "items_b")).alias("c"), (F.size("items_a") + F.size("items_b")).alias("s"))
    return found.filter(100 * F.col("c") >= percent * (F.col("s") - F.col("c"))).select("a", "b", "root_a", "root_b").distinct()


def _open(left: DataFrame, hubs: DataFrame | None, found: DataFrame | None) -> DataFrame:
    """The entries without their hubs that were compared with all others, where one signature still holds several roots.
    Roots that the new links join take the least root two links away: perhaps not yet the component's, so that more pairs are
    compared than need be, never fewer."""
    rest = left if hubs is None else left.join(hubs.select("sig", F.col("sid_b").alias("sid")), ["sig", "sid"], "left_anti")
    if found is not None:
        both = found.select(F.col("root_a").alias("u"), F.col("root_b").alias("v")).union(found.select("root_b", "root_a")).distinct()
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        low = both.join(low.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("low").alias("low"))
        rest = rest.join(low.withColumnRenamed("u", "root"), "root", "left").withColumn("root", F.coalesce("low", "root")).drop("low")
    rest = C.materialize(rest, "left")
    mixed = rest.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("sig")
    return C.materialize(rest.join(mixed, "sig").select("sig", "sid", "central", "n", "root"), "left")
