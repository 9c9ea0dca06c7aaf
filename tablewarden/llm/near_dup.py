"""Near-duplicate documents: a chosen-path set similarity join over word shingles, then exact confirmation.

1. Every text gives its distinct 5-word shingles as 64-bit hashes, a digest of the set, a few whole min-wise tokens to branch by and one byte of
   each of 128 tokens to estimate by.  Documents with equal sets are one class from here on, so thousands of copies cost one row.
2. Independent trees branch the classes by chosen min-wise tokens: a node holds the classes that agree on all tokens along its path.
   A node of at most ``LEAF`` classes is compared exhaustively; a larger one branches again, by ``FAN`` chosen tokens of its tree and level at once,
   down to ``DEPTH`` levels, if its branches together need fewer comparisons than it does.  Any other large node, and what is still large at the
   last level, is dealt in pairs of blocks, so every pair is compared all the same.
3. A node compares min-wise estimates and returns only a spanning forest of the pairs whose estimate lies within ``MARGIN`` of the
   threshold; the forests' components are candidate clusters, which hold both ends of every link.
4. The texts of clustered classes (a fixed-size bitmap of ids keeps all others from being moved) meet in their cluster, full shingle sets are
   intersected (in pairs of blocks again), and a spanning forest of the confirmed links is kept.

A pair at the threshold s meets in a tree unless its tokens differ at the root or, where the node is large, all FAN tokens of a level do.  With
q = (1-s) + s (1 - (1 - (1-s)^FAN)^DEPTH) for one tree, q^TREES is missed at most: below 3e-6 for 0.8 however often nodes branch, 2.6e-6 if none does.
The estimate drops such a pair with a chance below 2e-6, so both together miss below 5e-6.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import mix, slices, word_hashes, written

SHINGLE = 5
TOKENS = 128                  # min-wise tokens for each set
TREES = 8
LEAF = 4_000                  # classes that a node may hold to be compared exhaustively
FAN = 4                       # chosen tokens for each further branching of a large node
DEPTH = 3
PATH = TREES * (1 + FAN * DEPTH)  # tokens to branch by: no two trees share one
BITS = 1 << 22                # of the bitmap of clustered ids
BLOCK = 1_000                 # classes in a block where a group has to be dealt in pairs of blocks
MARGIN = 0.18                 # 5 standard deviations of an estimate from 128 tokens at similarity 0.8

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20260101)
_A = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text in ascending order, and how many each text has."""
    words, owner, _, _ = word_hashes([t.translate(_LOW) for t in texts], _SPACE)
    n = np.bincount(owner, minlength=len(texts))
    if not len(words):
        return words, n
    with np.errstate(over="ignore"):
        grams = np.zeros(len(words), dtype=np.uint64)
        for k in range(SHINGLE):                       # grams[i] covers the words i to i+4 that exist
            grams[:len(words) - k] += mix(words[k:] + np.uint64(k * 0x51ED270B))
        keep = np.zeros(len(words), dtype=bool)
        keep[:max(0, len(words) - SHINGLE + 1)] = owner[SHINGLE - 1:] == owner[:len(words) - SHINGLE + 1] if len(words) >= SHINGLE else False
        firsts = np.cumsum(n) - n
        for t in np.flatnonzero((n > 0) & (n < SHINGLE)):  # the whole sequence is one shingle
            i = firsts[t]
            grams[i] = sum((mix(words[i + k:i + k + 1] + np.uint64(k * 0x51ED270B))[0] for k in range(n[t])), np.uint64(n[t]))
            keep[i] = True
    grams, owner = mix(grams[keep]), owner[keep]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(texts))


def _profiles(batches):
    """doc_id, n, digest (two sums), the tokens to branch by and the sketch of each text."""
    import pyarrow as pa

    for t in slices(batches):
        sets, n = shingle_sets([x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()])
        full = np.flatnonzero(n)
        tokens = np.zeros((len(n), TOKENS), dtype=np.uint64)
        sums = np.zeros((len(n), 2), dtype=np.uint64)
        if len(full):
            starts = (np.cumsum(n) - n)[full]
            with np.errstate(over="ignore"):
                for k in range(TOKENS):
                    tokens[full, k] = np.minimum.reduceat(sets * _A[k] + _B[k], starts)
                sums[full, 0] = np.add.reduceat(mix(sets), starts)
                sums[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0x5DEECE66D)), starts)
        yield pa.RecordBatch.from_arrays([
            t["doc_id"].combine_chunks(), pa.array(n.astype(np.int64)), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * PATH), pa.array(tokens[:, :PATH].reshape(-1).view(np.int64))),
            pa.array([r.tobytes() for r in mix(tokens).astype(np.uint8)], type=pa.binary())], names=["doc_id", "n", "s1", "s2", "path", "sketch"])


def _forest(m: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of 0..m-1 that is not the smallest of its component, with that smallest: a spanning forest as stars."""
    root = np.arange(m)
    if len(a):
        while True:                                      # hook roots to smaller roots, then shorten the paths
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    child = np.flatnonzero(root != np.arange(m))
    return root[child], child


def _runs(batches, columns: int = 1):
    """Tables, each of all neighbouring rows with equal first ``columns``."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if not rest.num_rows:
            continue
        keys = [rest[c].to_numpy() for c in range(columns)]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if len(cuts):
            yield rest.slice(0, cuts[-1]), np.concatenate([[0], cuts[:-1], [cuts[-1]]])
            rest = rest.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _estimated(least: float, low: float):
    """Of each node (rows sorted by node): the spanning forest of the pairs whose estimate may reach the threshold."""
    import pyarrow as pa

    def rows_of(table):
        ids, n, half = table["id"].to_numpy(), table["n"].to_numpy(), table["half"].to_numpy()
        sig = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
        return ids, n, half, sig

    def compare(sig, n, left, right, half):
        """Indices (a, b) of passing pairs between the index lists left and right."""
        out_a, out_b = [], []
        for i in left:
            others = right[right > i] if half is None else right
            r = (np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]))
            others = others[r]
            if len(others):
                hit = others[(sig[others] == sig[i]).sum(axis=1) >= low * TOKENS]
                out_a += [i] * len(hit)
                out_b.append(hit)
        return np.array(out_a, dtype=np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64)

    def run(batches):
        for table, cuts in _runs(batches):
            ids, n, half, sig = rows_of(table)
            lefts, rights = [], []
            sizes = np.diff(cuts)
            for first in cuts[:-1][sizes == 2]:
                lefts.append(first)
            if lefts:                                     # nodes of two classes, all at once
                a = np.array(lefts)
                ok = (np.minimum(n[a], n[a + 1]) >= least * np.maximum(n[a], n[a + 1])) & ((sig[a] == sig[a + 1]).sum(axis=1) >= low * TOKENS)
                a = a[ok]
                lefts, rights = [ids[a]], [ids[a + 1]]
            for first, m in zip(cuts[:-1][sizes > 2], sizes[sizes > 2]):
                s, k, h = sig[first:first + m], n[first:first + m], half[first:first + m]
                every = np.arange(m)
                a, b = compare(s, k, every, every, None) if h[0] < 0 else compare(s, k, every[h == 0], every[h == 1], h)
                root, child = _forest(m, a, b)
                lefts.append(ids[first + root])
                rights.append(ids[first + child])
            if lefts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], names=["a", "b"])

    return run


def _confirmed(percent: int):
    """Of each cluster, or pair of its blocks (rows sorted by group): the spanning forest of the links that hold on the texts' full shingle sets."""
    import pyarrow as pa

    def run(batches):
        for table, cuts in _runs(batches):
            for first, last in zip(cuts[:-1], cuts[1:]):
                part = table.slice(first, last - first)
                ids, half = part["id"].to_numpy(), part["half"].to_numpy()
                sets, n = shingle_sets([x or b"" for x in part["text"].cast(pa.large_binary()).to_pylist()])
                m = len(ids)
                flat, codes = np.unique(sets, return_inverse=True)
                owner = np.repeat(np.arange(m), n)
                shared = np.bincount(codes, minlength=len(flat)) > 1
                keep = shared[codes]
                renumber = np.cumsum(shared) - 1
                columns, owner = renumber[codes[keep]], owner[keep]
                out_a, out_b = [], []
                common = np.zeros((m, m), dtype=np.float32)
                width = 8192
                order = np.argsort(columns, kind="stable")
                columns, owner = columns[order], owner[order]
                for lo in range(0, int(shared.sum()), width):    # products of 0/1 blocks count the shared shingles
                    x, y = np.searchsorted(columns, [lo, lo + width])
                    dense = np.zeros((m, width), dtype=np.float32)
                    dense[owner[x:y], columns[x:y] - lo] = 1
                    common += dense @ dense.T
                common = np.rint(common).astype(np.int64)
                for i in range(m - 1):
                    j = np.arange(i + 1, m)
                    if half[0] >= 0:
                        j = j[half[j] != half[i]]
                    hit = j[100 * common[i, j] >= percent * (n[i] + n[j] - common[i, j])]
                    out_a += [i] * len(hit)
                    out_b.append(hit)
                root, child = _forest(m, np.array(out_a, dtype=np.int64), np.concatenate(out_b) if out_b else np.zeros(0, np.int64))
                if len(root):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids[child])], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, group: str, n_of: str, block: int) -> DataFrame:
    """Rows of groups, where a group above ``block`` is dealt in pairs of blocks: columns group, half (-1: compare all; 0, 1: across)."""
    joined = rows.join(sizes.select(group, F.ceil(F.col(n_of) / block).cast("int").alias("_blocks")), group)
    mine = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    deals = F.when(F.col("_blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(-1).alias("half")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(
            F.least(mine, o).alias("x"), F.greatest(mine, o).alias("y"), F.when(o == mine, F.lit(-1)).when(mine < o, F.lit(0)).otherwise(F.lit(1)).alias("half"))))
    out = joined.withColumn("_deal", F.explode(deals))
    return out.select(F.xxhash64(group, "_deal.x", "_deal.y").alias("group"), "id", F.col("_deal.half").alias("half"),
                      *[c for c in rows.columns if c not in (group, "id")])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root): the smallest id that each id of ``edges`` (a, b) reaches.  Alternating large-star and small-star rounds, each written once."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), name)
        # done when every id has one edge, and no root is itself an id with an edge
        again = after.select("u", F.lit(1).alias("child")).unionByName(after.select(F.col("v").alias("u"), F.lit(0).alias("child")).distinct())
        if again.groupBy("u").count().where("count > 1").isEmpty():
            return after.select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = after


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n, s1, s2), (one row per different non-empty shingle set: id, n, path, sketch); both written."""
    profiles = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _profiles, "doc_id bigint, n bigint, s1 bigint, s2 bigint, path array<bigint>, sketch binary"), "profiles")
    named = profiles.where("n > 0 AND doc_id IS NOT NULL")
    owners = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    # the tokens of a class are those of its smallest document
    mine = owners.select("id", F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
    reps = named.join(mine, F.col("doc_id") == F.col("id")).where("n = _n AND s1 = _s1 AND s2 = _s2").select("id", "n", "path", "sketch").dropDuplicates(["id", "n", "path"])
    return profiles.select("doc_id", "n", "s1", "s2"), written(reps, "classes")


def candidate_edges(reps: DataFrame, percent: int, trees: int = TREES, leaf: int = LEAF, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Edges (a, b) whose components hold both ends of every pair of classes that reaches ``percent``."""
    token = lambda k: F.get("path", k)
    level = reps.select("id", F.posexplode(F.array(*[F.xxhash64(F.lit(t), token(F.lit(t))) for t in range(trees)])).alias("tree", "node"))
    leaves = []
    for d in range(depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("_held")).where("_held > 1")
        large = sizes.where(F.col("_held") > leaf)
        if d == depth or large.isEmpty():
            leaves.append(_dealt(level.select("node", "id"), sizes, "node", "_held", leaf))
            break
        at = (F.col("tree") * depth + d) * fan + trees         # every tree has tokens of its own for every level
        inside = level.join(large, "node").join(reps.select("id", "path"), "id")
        branched = written(inside.select("id", "tree", F.col("node").alias("parent"), "_held", F.explode(F.array(
            *[F.xxhash64("node", F.lit(k), token(at + k)) for k in range(fan)])).alias("node")), "level")
        # a node branches only where its branches together need fewer comparisons than it does
        costs = branched.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("_n"), F.first("_held").alias("_held"))
        costs = costs.groupBy("parent").agg(F.sum(F.col("_n") * F.col("_n")).alias("_cost"), F.first("_held").alias("_held"))
        split = written(costs.where(F.col("_cost") < F.col("_held") * F.col("_held")).select("parent"), "split")
        whole = sizes.join(split.withColumnRenamed("parent", "node"), "node", "left_anti")
        leaves.append(_dealt(level.select("node", "id"), whole, "node", "_held", leaf))
        level = branched.join(split, "parent", "left_semi").select("id", "tree", "node")
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)
    filled = nodes.join(reps.select("id", "n", "sketch"), "id")
    grouped = filled.select("group", "id", "half", "n", "sketch").repartition("group").sortWithinPartitions("group", "half")
    return grouped.mapInArrow(_estimated(percent / 100, percent / 100 - MARGIN), "a bigint, b bigint").distinct()


def _within(ids: DataFrame, id_: Column) -> Column:
    """Whether a bitmap of ``BITS`` bits, made of the hashed ids, holds this id: true for every one of them and for few others."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = [0] * (BITS // 64)
    for r in ids.select(bit("id").alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(b, 64)))")).alias("v")).collect():
        words[r["w"]] = r["v"]                            # BITS / 64 rows at most
    table = F.from_json(F.lit(str(words)), "array<bigint>")
    return F.getbit(F.get(table, F.shiftright(bit(id_), 6).cast("int")), F.pmod(bit(id_), F.lit(64)).cast("int")) == 1


def resolve(docs: DataFrame, percent: int = 80, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is that document).

    A link is 100 x intersection >= ``percent`` x union of the shingle sets.  A null, empty or blank text has no shingles and is linked with
    nothing; below five words the whole sequence is the one shingle.  A row with a null doc_id is not linked, has a null component_id
    and is kept.  Repeated rows of a doc_id are each returned; extra columns are ignored; an empty table gives an empty result.
    """
    profiles, reps = classes(docs)
    clusters = components(written(candidate_edges(reps, percent, leaf=leaf), "candidates"), "clusters")
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "cluster")
    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    texts = named.where(_within(clusters, F.col("id"))).join(clusters, "id")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_held"))
    dealt = _dealt(texts, sizes, "cluster", "_held", block).repartition("group").sortWithinPartitions("group", "half", "id")
    links = written(dealt.select("group", "id", "half", "text").mapInArrow(_confirmed(percent), "a bigint, b bigint"), "links")
    roots = components(links, "roots")
    owners = profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"))
    owners = owners.join(roots, "id", "left").select("n", "s1", "s2", F.coalesce("root", "id").alias("component_id"))
    linked = profiles.where("n > 0 AND doc_id IS NOT NULL").join(owners, ["n", "s1", "s2"])
    alone = profiles.where("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    out = linked.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, with all their columns.

    Rows with a null doc_id stay; of repeated rows of one doc_id one stays.
    """
    gone = resolve(docs, percent).where("NOT kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))
