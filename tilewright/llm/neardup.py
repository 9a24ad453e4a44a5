"""Near-duplicates by a MinHash LSH forest, with every link confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.tokens import arrow_schema, only, slices
from tilewright.plans.components import connected_components
from tilewright.plans.order import prefix_sum
from tilewright.plans.staging import Staged

#: Signature orders, and hashes of the shallowest region: a pair at 0.8 misses all orders once in about 40,000.
TREES, DEPTH = 20, 4
HASHES = TREES * DEPTH
#: Depths that a dense region may go to.
LADDER = (4, 6, 8, 12, 16, 24, 40)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return (r.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32), r.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


FACTORS, SHIFTS = _multipliers()
PLACES = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept in the Python worker; emptied when it has half a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def make_room() -> None:
    """Empty this Python worker's other caches."""
    only(_HASHES)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words split at ASCII white space.

    A text of fewer words gives its whole sequence as one shingle, one without words an empty set.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(h))
    total = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * PLACES[i]
    if len(h) < words:
        total += np.array([len(h)], dtype=np.uint64) * PLACES[-1]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of random orders of the shingles."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, (h[i : i + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=low)
    return low


SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
    ]
)


def text_key(text: str = "text") -> Column:
    """A digest of the text, so that a verdict finds its own row where ids are null or repeated; null for a null text."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def sketches(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit digest of the set, and the signature as big-endian bytes (null for empty sets)."""

    def run(batches):
        make_room()
        for batch in slices(batches):
            out = []
            for doc_id, text, key in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = shingle_set(text, words)
                out.append((doc_id, key, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).astype(">u4").tobytes()) if len(s) else (doc_id, key, 0, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow_schema(SKETCH).types, strict=True)], names=SKETCH.names)

    return docs.select(F.col("doc_id").cast("long"), "text", text_key()).mapInArrow(run, SKETCH)


def _prefix(tree: Column, depth: int) -> Column:
    """Key of a region: the first ``depth`` hashes in a tree's order, which starts at its own hashes and goes round."""
    twice = F.concat("signature", "signature")
    return F.xxhash64(tree, F.lit(depth), twice.substr(tree * (4 * DEPTH) + 1, F.lit(4 * depth)))


def forest(reps: DataFrame) -> DataFrame:
    """(rep, tree, region) for every class representative and signature order, at the shallowest depth."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    return reps.select("rep", "n_shingles", "signature", trees.alias("tree")).withColumn("region", _prefix(F.col("tree"), DEPTH))


PLACED = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "edge", "tree", "region", "rep", "before")])


def neighbours(reps: DataFrame, staged: Staged) -> DataFrame:
    """(rep, before): longest-common-prefix neighbours: in each order, each representative and the one sorted before it in its region.

    Regions are counted by their keys alone; signatures go only to regions of two or more, a small part of all. The
    orders are sorted as one, by range, so a region of any size lies over many tasks; the first and last row of every
    task are compared afterwards.
    """
    keyed = forest(reps).select("rep", F.col("tree").cast("long").alias("tree"), "region")
    shared = keyed.groupBy("tree", "region").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    placed = keyed.join(shared, ["tree", "region"]).join(reps.select("rep", "signature"), "rep")
    key = F.concat("signature", "signature").substr((F.col("tree") * (4 * DEPTH) + 1).cast("int"), F.lit(4 * HASHES))
    order = ["tree", "region", "key", "rep"]
    dealt = placed.withColumn("key", key).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            if not len(rows):
                continue
            above = np.concatenate([[[-1, 0, 0]] if last is None else last, rows[:-1]])
            before = np.where((above[:, :2] == rows[:, :2]).all(axis=1), above[:, 2], -1)
            edge = np.zeros(len(rows), dtype=np.int64)
            edge[0] = last is None
            last = rows[-1:]
            yield made(part, edge, rows, before)
        if last is not None:
            yield made(part, np.array([2]), last, np.array([-1]))

    def made(part, edge, rows, before):
        columns = [np.full(len(rows), part), edge, *rows.T, before]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=PLACED.names)

    rows = staged(dealt.select("tree", "region", "rep").mapInArrow(run, PLACED), "placed")
    inside = rows.where("before >= 0").select("rep", "before")
    # two rows for each task
    ends = Window.orderBy("part", "edge")
    bounds = rows.where("edge > 0").select("*", *[F.lag(c).over(ends).alias(f"_{c}") for c in ("part", "tree", "region", "rep")])
    across = bounds.where("part <> _part and tree = _tree and region = _region").select("rep", F.col("_rep").alias("before"))
    return inside.unionByName(across).distinct()


def _block_pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, grp): every two of a cluster's blocks meet in one group, so all its pairs are compared.

    ``rows`` has (rep, component), ``sizes`` (component, blocks).
    """
    dealt = rows.join(sizes, "component").withColumn("slot", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    met = dealt.select("rep", "component", "slot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return met.select("rep", F.format_string("p%d-%d-%d", "component", F.least("slot", "other"), F.greatest("slot", "other")).alias("grp"))


def _deep_regions(reps: DataFrame, rows: int, max_shingles: int, staged: Staged) -> DataFrame:
    """(rep, grp) for crowded clusters: in each order the shallowest region that holds few enough documents.

    What no depth divides is nearly the same text throughout: it is cut along its sorted order into
    runs that share one document with the next, so nothing is left out. The order is a global one, sorted by range.
    """
    left = staged(forest(reps).drop("region"), "deep")
    found = None
    for depth in LADDER:
        keyed = left.withColumn("region", _prefix(F.col("tree"), depth))
        sizes = keyed.groupBy("tree", "region").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        fits = (F.col("n") <= rows) & (F.col("s") <= max_shingles)
        settled = keyed.join(sizes.where(fits & (F.col("n") > 1)).select("tree", "region"), ["tree", "region"])
        settled = settled.select("rep", F.format_string("t%d-%d-%d", "tree", F.lit(depth), "region").alias("grp"))
        found = settled if found is None else found.unionByName(settled)
        left = staged(keyed.join(sizes.where(~fits).select("tree", "region"), ["tree", "region"]).drop("region"), "deep")
        if left.isEmpty():
            return found
    # a run holds a million units, of rows or of shingles
    unit = 2_000_000
    weight = F.greatest(F.lit(-(-unit // rows)).cast("long"), F.ceil(F.col("n_shingles") * unit / max_shingles))
    keyed = left.withColumn("region", _prefix(F.col("tree"), LADDER[-1])).withColumn("weight", weight)
    placed = prefix_sum(keyed.select("rep", "tree", "region", "signature", "weight"), ["tree", "region", "signature", "rep"], F.col("weight"), "at")
    first = placed.groupBy("tree", "region").agg(F.min("at").alias("first"))
    own = placed.join(first, ["tree", "region"]).withColumn("at", F.col("at") - F.col("first"))
    run, after = F.expr(f"at div {unit // 2}"), F.expr(f"(at + weight) div {unit // 2}")
    both = own.select("rep", "tree", "region", F.explode(F.array_distinct(F.array(run, after))).alias("run"))
    return found.unionByName(both.select("rep", F.format_string("r%d-%d-%d", "tree", "region", "run").alias("grp")))


def _rest_against_all(crowded: DataFrame, linked: DataFrame, rows: int, max_shingles: int, staged: Staged) -> DataFrame:
    """(rep, grp) of block pairs: what regions left outside a cluster's largest component, against the whole cluster.

    ``crowded`` has (rep, n_shingles, component), ``linked`` (node, component). Every pair with one end outside the
    largest component meets in one block pair, so no link is lost however dense the cluster is.
    """
    known = crowded.join(linked.select(F.col("node").alias("rep"), F.col("component").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = staged(known, "crowded")
    largest = known.groupBy("component", "root").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("root", F.struct(F.col("n"), -F.col("root"))).alias("main"))
    marked = known.join(largest, "component").withColumn("rest", F.col("root") != F.col("main"))

    def blocks(inside) -> Column:
        return _blocks(F.sum(inside.cast("int")), F.coalesce(F.sum(F.when(inside, F.col("n_shingles"))), F.lit(0)), rows, max_shingles)

    counts = marked.groupBy("component").agg(blocks(F.lit(True)).alias("all_blocks"), blocks(F.col("rest")).alias("rest_blocks")).where("rest_blocks > 0")
    dealt = marked.join(counts, "component")
    slot = F.xxhash64("rep", F.lit(1))
    whole = dealt.select("rep", "component", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("r"), F.pmod(slot, F.col("all_blocks")).cast("int").alias("a"))
    rest = dealt.where("rest").select("rep", "component", F.pmod(slot, F.col("rest_blocks")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("a"))
    return whole.unionByName(rest).select("rep", F.format_string("b%d-%d-%d", "component", "r", "a").alias("grp")).distinct()


def _blocks(n: Column, shingles: Column, rows: int, max_shingles: int) -> Column:
    """Blocks of a cluster, of which two fill a task."""
    return F.ceil(F.greatest(n / (rows / 2), shingles / (max_shingles / 2))).cast("int")


LINKS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("root", T.LongType())])


def link_group(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set of a group the least id that links of at least ``percent`` Jaccard reach inside it.

    All intersections come from products of 0/1 matrices over the shingles that two sets or more share, some columns at a time.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], number[column[shared]]
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(64, min(8192, (1 << 24) // n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        x = np.zeros((n, width), dtype=np.float32)
        x[owner[a:b], column[a:b] - low] = 1.0
        both += x @ x.T
    root = list(range(n))
    # ascending ids: the first of a component is its least
    rank = np.argsort(np.array(ids), kind="stable")
    done = np.zeros(n, dtype=bool)
    for first in rank.tolist():
        if done[first]:
            continue
        done[first], todo = True, [first]
        while todo:
            i = todo.pop()
            inter = both[i].astype(np.int64)
            near = np.flatnonzero((100 * inter >= percent * (sizes[i] + sizes - inter)) & ~done)
            done[near] = True
            for j in near.tolist():
                root[j] = first
            todo.extend(near.tolist())
    return [ids[r] for r in root]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, max_group: int = 4096, task_rows: int = 512, max_shingles: int = 4_000_000, keys: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach), kept.

    Two documents link if their sets of ``words``-word shingles have a Jaccard similarity of at least ``percent``
    hundredths. Documents of equal sets are one class, represented by its least id. Each class has its place in
    TREES sorted signature orders; neighbours with a common prefix of DEPTH hashes or more chain into clusters. All sets of a
    cluster are intersected exactly, in tasks of about ``task_rows`` classes and ``max_shingles`` shingles: a cluster of up to so many in one
    of them, one of up to ``max_group`` classes in blocks, every two of which meet. A larger one is divided, order by order, into
    regions as deep as it takes for each to be as small as a task, and their links are joined; then what is still outside the largest
    component of such a cluster is compared with all of it in blocks. A pair of similarity s is in different clusters with a
    probability below (1 - s**4)**20.

    Null texts and texts without words have empty sets: they link with nothing and are kept. Rows with a null
    doc_id come back with themselves as component null and kept. Repeated ids give repeated rows, each with the verdict on
    its own text: texts under one id are classes of their own, and where such texts lead a component together, only
    the class with the lesser digest is kept. With ``keys`` each row also has ``text_key`` and ``set_key``. An empty table gives no rows.
    Other columns are left out. Tables staged on the way are deleted, but for the sketches and classes that the result reads.
    """
    with Staged() as staged:
        return _near_duplicates(docs, words, percent, max_group, task_rows, max_shingles, keys, staged)


def _near_duplicates(docs: DataFrame, words: int, percent: int, max_group: int, task_rows: int, max_shingles: int, keys: bool, staged: Staged) -> DataFrame:
    marks = staged.keep(staged(sketches(docs, words), "sketches"))
    classes = marks.where("set_key is not null and doc_id is not null").groupBy("set_key")
    classes = classes.agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # a class has a number of its own, since one id can have several; it is fixed by being written
    reps = staged.keep(staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes"))
    clusters = staged(connected_components(neighbours(reps, staged), "rep", "before"), "clusters")
    sizes = clusters.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = staged(sizes.withColumn("blocks", _blocks(F.col("n"), F.col("s"), task_rows, max_shingles)), "sizes")
    one, some = F.col("blocks") <= 2, F.col("blocks") <= 2 * -(-max_group // task_rows)
    rows = clusters.withColumnRenamed("node", "rep")
    groups = rows.join(sizes.where(one).select("component"), "component").select("rep", F.format_string("c%d", "component").alias("grp"))
    middle, large = sizes.where(~one & some), sizes.where(~some)
    if not middle.isEmpty():
        groups = groups.unionByName(_block_pairs(rows, middle.select("component", "blocks")))
    crowded = None
    if not large.isEmpty():
        crowded = staged(rows.join(large.select("component"), "component").join(reps, "rep"), "dense")
        groups = groups.unionByName(_deep_regions(crowded.select(*reps.columns), task_rows, max_shingles, staged))
    groups = staged(groups, "groups")

    def sets(batches):
        make_room()
        for batch in slices(batches):
            made = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(m) for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], names=["least", "set_key", "shingles"])

    members = reps.join(rows.select("rep"), "rep").select("rep", "least", "set_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), "text").join(members.select("least"), "least", "left_semi")
    made = texts.mapInArrow(sets, "least long, set_key binary, shingles binary")
    # where an id is repeated, each of its classes takes part
    full = staged(made.join(members, ["least", "set_key"]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")

    def settle(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_pylist()
        root = link_group(ids, [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()], percent)
        return pa.table({"rep": pa.array(ids, pa.int64()), "root": pa.array(root, pa.int64())})

    def settled(dealt: DataFrame) -> DataFrame:
        return staged(full.join(dealt, "rep").groupBy("grp").applyInArrow(settle, LINKS), "links")

    links = settled(groups)
    if crowded is not None:
        so_far = connected_components(links, "rep", "root")
        links = links.unionByName(settled(_rest_against_all(crowded.select("rep", "n_shingles", "component"), so_far, task_rows, max_shingles, staged)))
    final = connected_components(links, "rep", "root")
    placed = reps.select("set_key", "least", "rep").join(final, F.col("rep") == F.col("node"), "left").select("set_key", "least", F.coalesce("component", "rep").alias("component"))
    leads = placed.groupBy("component").agg(F.min(F.struct("least", "set_key")).alias("lead"))
    roots = placed.join(leads, "component").select("set_key", F.col("lead.least").alias("component_id"), (F.col("set_key") == F.col("lead.set_key")).alias("leads"))
    out = marks.drop("signature").join(roots, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = component.eqNullSafe(F.col("doc_id")) & (F.col("doc_id").isNull() | F.coalesce("leads", F.lit(True)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *(["text_key", "set_key"] if keys else []))
