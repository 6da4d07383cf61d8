"""Operator 8: near-duplicates by consistent weighted sampling.

A document is the set of its shingles of ``WORDS`` words, each weighted by its
count in the text times the damped inverse document frequency of its bucket.
Improved consistent weighted sampling draws ``BANDS * ROWS`` shingles, so that
two documents draw the same one with a probability of their weighted Jaccard
similarity.  Documents that agree in all rows of a band meet in a bucket, and
the exact weighted Jaccard similarity of those brought together decides.

Texts with equal words are one node.  A bucket is never expanded into pairs: it
is cut into slices of bounded size, and within a slice, with a few pivots that
all slices of the bucket share, all similarities are a product of matrices, of
which only a tree of links leaves the task.  Alternating large and small stars
join the links to components.  That settles buckets of one slice.  In larger
ones, those members that are not of the bucket's largest component then meet
all others, again slice by slice; before that, those of very large buckets are
left out whose shingles that occur in other components too weigh too little
for a link.  So no link between members of a bucket is lost, and what is moved
and measured follows the members outside the largest component, not all pairs.

Document frequencies are counted over all documents in a table of fixed size
(2 ** ``DF_BITS`` buckets), which bounds what is broadcast; a bucket's share of
documents does not depend on the size of the corpus.

Defined results: null and empty texts have no words and are one class, as are
all texts with the same words; texts shorter than a shingle have the one of all
their words; equal rows stay rows of one class; a class is shown by its smallest
doc_id that is not null (null only if it has no other), which several classes
may share where ids repeat or are null, and told from all others by its root,
the smallest digest of its texts' words; an empty table gives no rows; other
columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, normal_words, staged, summed, temporaries, texts_of

WORDS = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 4
DF_BITS = 17
#: How much a shingle that no other document has outweighs one that all have: edits to a text
#: with thousands of copies are rare shingles among frequent ones, and must not part it from them.
DAMPED = 0.25
_NUMBERS = BANDS * ROWS
#: Shingles that are drawn from at once.
_AT_ONCE = 32_768
#: Members and shingles of a bucket that one task holds at once: it is cut into slices of no more.
SLICE = 256
SLICE_CODES = 2_000_000
#: Members of a bucket that meet all of its slices at once.
PIVOTS = 8
#: Slices beyond which those members are left out that can be linked with no other component.
PEELED = 4
#: Levels of weight that are columns of a matrix at once.
_LEVELS = 4096
#: Nodes up to which a list of them is broadcast; beyond, it is joined.
BROADCAST_NODES = 200_000


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a text's shingles, ascending, and their counts."""
    if not words:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = max(1, len(ids) - WORDS + 1)
    code = np.zeros(n, "u8")
    for k in range(min(WORDS, len(ids))):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(code ^ (code >> np.uint64(31)), return_counts=True)


class Sampler:
    """Improved consistent weighted sampling.

    Per shingle and sample the hash picks r and c of Gamma(2, 1) and a uniform
    beta from tables of quantiles; t = floor(ln w / r + beta), and the shingle
    with the least ln c - r (t - beta + 1) is drawn, together with t.
    """

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        rng = np.random.default_rng(20)
        self.r = rng.gamma(2, 1, 1 << 12).astype("f4") + np.float32(1e-3)
        self.c = np.log(rng.gamma(2, 1, 1 << 16)).astype("f4")
        self.beta = rng.random(1 << 12).astype("f4")

    def weights(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (counts * self.idf[(codes >> np.uint64(64 - DF_BITS)).astype("i8")]).astype("f4")

    def signatures(self, codes: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Drawn numbers of documents given end to end: a row each, a column a sample."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        logs = np.log(weights)
        out = np.empty((len(lengths), _NUMBERS), "u8")
        for k in range(_NUMBERS):
            h = (codes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            r, beta = self.r[h >> np.uint64(52)], self.beta[(h >> np.uint64(40)) & np.uint64(0xFFF)]
            t = np.floor(logs / r + beta)
            a = self.c[(h >> np.uint64(24)) & np.uint64(0xFFFF)] - r * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, starts)
            hits = np.flatnonzero(a == np.repeat(least, lengths))
            drawn = hits[np.searchsorted(hits, starts)]
            out[:, k] = codes[drawn] + t[drawn].astype("i8").astype("u8") * np.uint64(0xD6E8FEB86659FD93)
        return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One number a band."""
    out = np.zeros((len(signatures), BANDS), "u8")
    for row in range(ROWS):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + signatures[:, row::ROWS]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out + np.arange(BANDS, dtype="u8")) * np.uint64(0x94D049BB133111EB)


def document_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bucket of shingles, from all documents."""
    size = 1 << DF_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size + 1)
        for batch in batches:
            for text in texts_of(batch):
                codes, _ = shingles(normal_words(text))
                places = (codes >> np.uint64(64 - DF_BITS)).astype("i8")  # ascending, as codes are
                total[places[np.flatnonzero(np.diff(places, prepend=-1))]] += 1
                total[size] += 1
        return total

    counts = summed(docs.select("text"), count, size + 1)
    n = max(1.0, counts[size])
    rarity = np.log1p(n / np.maximum(counts[:size], 1.0)) / np.log1p(n)
    return (1 + DAMPED * rarity).astype("f4")


def _members(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, text_hash, node (a digest of its words), the bands and the number of shingles of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("size", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]):
        sampler = Sampler(shared.value)
        rows, parts, n = [], [], 0

        def made():
            lengths = np.array([len(c) for c, _ in parts])
            full = np.flatnonzero(lengths)
            bands: list[list[int]] = [[] for _ in rows]
            if len(full):
                codes = np.concatenate([c for c, _ in parts])
                found = _bands(sampler.signatures(codes, np.concatenate([w for _, w in parts]), lengths[full])).view("i8").tolist()
                for k, b in zip(full.tolist(), found):
                    bands[k] = b
            ids, hashes, nodes = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, hashes, nodes, bands, lengths), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")]
            for doc_id, text_hash, text in zip(*columns):
                words = normal_words(text)
                codes, counts = shingles(words)
                rows.append((doc_id, text_hash, xxhash.xxh3_128_digest(b" ".join(words))))
                parts.append((codes, sampler.weights(codes, counts)))
                n += len(codes)
                if n >= _AT_ONCE or len(rows) >= 4096:
                    yield made()
                    rows, parts, n = [], [], 0
        if rows:
            yield made()

    return docs.mapInArrow(draw, "doc_id long, text_hash long, node binary, bands array<long>, size long")


def _contents(docs: DataFrame, wanted: DataFrame, idf: np.ndarray) -> DataFrame:
    """Hashes and weights of the shingles of the nodes in ``wanted`` (node, doc_id, text_hash)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # of fixed size
    wanted = wanted.select("node", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("of_id")) & (docs.text_hash == F.col("of_hash"))).select("node", "text")

    def weigh(batches: Iterator[pa.RecordBatch]):
        sampler = Sampler(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, parts = batch.slice(at, 256), []
                for text in some.column("text").to_pylist():
                    codes, counts = shingles(normal_words(text))
                    parts.append((codes.tobytes(), sampler.weights(codes, counts).tobytes()))
                yield pa.RecordBatch.from_pydict({"node": some.column("node"), "codes": pa.array([p[0] for p in parts], pa.binary()), "weights": pa.array([p[1] for p in parts], pa.binary())})

    # Equal rows of one node give its contents more than once.
    return found.mapInArrow(weigh, "node binary, codes binary, weights binary").dropDuplicates(["node"])


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two ascending lists of hashes and their weights."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    both = float(np.minimum(wa[same], wb[at[same]]).sum(dtype="f8"))
    total = float(wa.sum(dtype="f8") + wb.sum(dtype="f8")) - both
    return both / total if total > 0 else 1.0


def overlaps(codes: list[np.ndarray], weights: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sums of the lesser weights of common shingles, of each of ``rows`` with all others.

    The distinct weights of a shingle are its levels; who has a weight has all
    levels up to it, and the sum of what two have in common, each level counting
    for what it adds, is the lesser weight.  So a product of matrices gives it.
    """
    out = np.zeros((len(rows), len(codes)))
    who = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    code, weight = np.concatenate(codes), np.concatenate(weights).astype("f8")
    order = np.lexsort((weight, code))
    who, code, weight = who[order], code[order], weight[order]
    new_code = np.diff(code, prepend=~code[:1]) != 0
    number = np.cumsum(new_code) - 1
    several = np.bincount(number)[number] > 1
    who, code, weight = who[several], code[several], weight[several]
    if not len(who):
        return out
    new_code = np.diff(code, prepend=~code[:1]) != 0
    new_level = new_code | (np.diff(weight, prepend=-1) != 0)
    level = np.cumsum(new_level) - 1
    begins = level[new_code][np.cumsum(new_code) - 1]  # of each entry's shingle, the first level
    adds = (weight - np.where(new_code, 0, np.concatenate([[0], weight[:-1]])))[new_level]
    times = level - begins + 1
    if times.max() > 1:
        each = np.repeat(np.arange(len(who)), times)
        level = begins[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        who = who[each]
        order = np.argsort(level, kind="stable")
        who, level = who[order], level[order]
    for low in range(0, len(adds), _LEVELS):
        first, last = np.searchsorted(level, [low, low + _LEVELS])
        part = adds[low : low + _LEVELS]
        has = np.zeros((len(codes), len(part)))
        has[who[first:last], level[first:last] - low] = 1
        out += (has[rows] * part) @ has.T
    return out


def _joined(near: np.ndarray, rows: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each part the least that it is joined with, where ``near[r, k]`` links node rows[r] with node k."""
    root = np.arange(part.max() + 1)
    while True:
        at = root[part]
        least = np.minimum(np.where(near, at, len(root)).min(axis=1), at[rows])
        new = root.copy()
        np.minimum.at(new, part[rows], least)
        np.minimum.at(new, part, np.where(near, least[:, None], len(root)).min(axis=0))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(nodes: list[bytes], parts: list[bytes], rows: np.ndarray, codes: list[np.ndarray], weights: list[np.ndarray], reach: float) -> list[tuple[bytes, bytes]]:
    """Pairs that join all parts of a block which links between ``rows`` and its nodes join: a tree, not all pairs."""
    number: dict[bytes, int] = {}
    part = np.array([number.setdefault(p, len(number)) for p in parts])
    if len(number) < 2 or not len(rows):
        return []
    both = overlaps(codes, weights, rows)
    total = np.array([w.sum(dtype="f8") for w in weights])
    root = _joined(both >= (1 - reach) * (total[rows, None] + total - both), rows, part)
    one = {p: node for p, node in zip(part.tolist()[::-1], nodes[::-1])}
    return [(one[k], one[r]) for k, r in enumerate(root.tolist()) if k != r]


def _linked(cells: DataFrame, contents: DataFrame, reach: float) -> DataFrame:
    """a and b of what is joined in cells (bucket, i, j, node, part, row), each of bounded size.

    A cell's rows, which ``row`` marks, are measured against all nodes of it.
    """

    def measure(batches: Iterator[pa.RecordBatch]):
        key, held = None, []

        def made():
            nodes, parts, marks, codes, weights = zip(*held)
            found = block_links(list(nodes), list(parts), np.flatnonzero(marks), [np.frombuffer(c, "u8") for c in codes], [np.frombuffer(w, "f4") for w in weights], reach)
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "part", "row", "codes", "weights")]
            for bucket, i, j, *rest in zip(*columns):
                if (bucket, i, j) != key:
                    if held:
                        yield made()
                    key, held = (bucket, i, j), []
                held.append(rest)
        if held:
            yield made()

    keys = ["bucket", "i", "j"]
    full = cells.join(contents, "node").select(*keys, "node", "part", "row", "codes", "weights")
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(measure, "a binary, b binary")


def _meeting(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, doc_id, text_hash) that share a bucket, and bucket, node and slices of each.

    Of buckets with the same members one stays.  A bucket has as many slices as
    keep each within ``SLICE`` members and ``SLICE_CODES`` shingles.
    """
    size = F.col("size") if "size" in members.columns else F.lit(0)
    least = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    nodes = members.filter(F.size("bands") > 0).groupBy("node").agg(least.alias("row"), F.first("bands").alias("bands"), F.first(size).alias("size"))
    placed = staged(nodes.select("node", "row", "size", F.explode("bands").alias("bucket")), "placed")
    sets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("codes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    kept = sets.filter("n > 1").groupBy("n", "codes", "x", "y").agg(F.min("bucket").alias("bucket"))
    slices = F.ceil(F.greatest(F.col("n") / SLICE, F.col("codes") / SLICE_CODES, F.lit(1.0))).cast("int")
    kept = staged(kept.select("bucket", "n", slices.alias("slices")), "buckets")
    meeting = staged(dealt(placed, kept, "bucket", "n").select("bucket", "slices", "node", "row"), "meeting")
    return meeting.select("node", "row.doc_id", "row.text_hash").distinct(), meeting.select("bucket", "slices", "node")


def links(members: DataFrame, docs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """a and b, its component's smallest node, for all that meet in buckets and are joined by the similarity.

    members: doc_id, text_hash, node, bands and, if known, size, the number of
    the node's shingles.
    """
    reach = 1 - similarity + 1e-9
    with temporaries(docs.sparkSession) as kept:
        wanted, meeting = _meeting(members)
        contents = staged(_contents(docs, wanted, idf), "contents")
        found = components(_linked(_sliced(meeting), contents, reach))
        cells = _crossed(meeting.filter("slices > 1"), found, contents, reach)
        if cells is not None:
            found = components(found.unionByName(_linked(cells, contents, reach)))
        return kept(found)


def _sliced(meeting: DataFrame) -> DataFrame:
    """Cells of the slices of all buckets; a bucket's pivots are in each of its slices."""
    of = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    several = meeting.filter("slices > 1")
    pivots = several.groupBy("bucket", "slices", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(PIVOTS)).alias("slot")).agg(F.min("node").alias("node"))
    everywhere = pivots.select("bucket", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"), "node")
    rows = meeting.select("bucket", of.alias("i"), "node").unionByName(everywhere)
    return rows.select("bucket", "i", F.lit(0).alias("j"), "node", F.col("node").alias("part"), F.lit(True).alias("row"))


def _crossed(rows: DataFrame, found: DataFrame, contents: DataFrame, reach: float) -> DataFrame | None:
    """Cells in which those that are not of their bucket's largest component meet all others; None if there are none."""
    if rows.isEmpty():
        return None
    named = found.select(F.col("a").alias("of"), F.col("b").alias("root"))
    rows = rows.join(named, F.col("node") == F.col("of"), "left").select("bucket", "slices", "node", F.coalesce("root", "node").alias("part"))
    rows = _apart(staged(rows, "parts"))
    many = rows.filter(F.col("slices") > PEELED)
    if not many.isEmpty():
        rows = _apart(staged(rows.filter(F.col("slices") <= PEELED).unionByName(_able(many, contents, reach)), "able"))
    if rows.isEmpty():
        return None
    apart = rows.filter("apart")
    counts = staged(apart.groupBy("bucket").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("across"), F.count("*").alias("n")), "counts")
    placed = dealt(rows, counts, "bucket", "n")
    i, j = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("across")).cast("int"), F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    as_rows = placed.filter("apart").select("bucket", i.alias("i"), every("slices").alias("j"), "node", "part", F.lit(True).alias("row"))
    as_columns = placed.select("bucket", every("across").alias("i"), j.alias("j"), "node", "part", F.lit(False).alias("row"))
    return as_rows.unionByName(as_columns)


def _apart(rows: DataFrame) -> DataFrame:
    """Of buckets with several components the rows, and whether each is apart from the bucket's largest."""
    sizes = rows.groupBy("bucket", "part").agg(F.count("*").alias("m"))
    each = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.count("*").alias("parts"), F.sum("m").alias("n")).filter("parts > 1")
    placed = dealt(rows.select("bucket", "slices", "node", "part"), staged(each.select("bucket", "largest", "n"), "largest"), "bucket", "n")
    return staged(placed.select("bucket", "slices", "node", "part", (F.col("part") != F.col("largest")).alias("apart")), "apart")


def _able(rows: DataFrame, contents: DataFrame, reach: float) -> DataFrame:
    """Rows without those that can be linked with no other component.

    A node has at most the weight of those shingles in common with others that
    occur in another component too.
    """

    def spread(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for node, part, codes, weights in zip(*[batch.column(c).to_pylist() for c in ("node", "part", "codes", "weights")]):
                own = np.frombuffer(codes, "i8")
                yield pa.RecordBatch.from_pydict({"node": pa.array([node] * len(own), pa.binary()), "part": pa.array([part] * len(own), pa.binary()), "code": pa.array(own), "weight": pa.array(np.frombuffer(weights, "f4").astype("f8"))})

    each = staged(contents.join(rows.select("node", "part").distinct(), "node").select("node", "part", "codes", "weights").mapInArrow(spread, "node binary, part binary, code long, weight double"), "codes")
    common = each.groupBy("code").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).filter("x != y").select("code", "n")
    total = each.groupBy("node").agg(F.sum("weight").alias("total"))
    shared = dealt(each, staged(common, "common"), "code", "n").groupBy("node").agg(F.sum("weight").alias("common"))
    able = total.join(shared, "node").filter(F.col("common") >= (1 - reach) * F.col("total")).select("node")
    return rows.join(able, "node", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """a and b, its component's smallest node, for every node with an edge that isn't itself the smallest."""
    now = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == tuple(state):
            return now.toDF("a", "b")
        before = tuple(state)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        # Large star: of each node, the larger neighbours go to the least.
        large = now.join(least, F.col("v") == F.col("of")).select("u", F.col("m").alias("v"))
        # Small star: of each node, itself and the smaller neighbours go to the least.
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        small = large.join(lower, F.col("u") == F.col("of")).select("v", "m").filter("v != m").union(lower.select("of", "m")).toDF("u", "v").distinct()
        now = staged(small, "stars")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, class_id, class_size and root, the class's smallest node, of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    idf = document_weights(rows)
    members = staged(_members(rows, idf), "members")
    roots = links(members, rows, idf, similarity).toDF("of", "root")
    # Nodes first: copies of a text are as one, so that a large group meets as few rows as it has texts.
    nodes = members.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = nodes.join(roots, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("root"), "least", "n")
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = rooted.select("node", "root").join(named, "root").select(F.col("node").alias("of"), "class_id", "class_size", "root")
    return members.join(by_node, F.col("node") == F.col("of")).select("doc_id", "text_hash", "class_id", "class_size", "root")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, whole, of which one of each class stays.

    That with the smallest doc_id; of rows that share it the smallest hash of
    the text, then that of all columns (but maps), and of equal rows one.
    """
    found = classes(docs, similarity)
    # Two classes never have a text in common, so a doc_id and a hash of the text name the row of one of them.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    first = found.groupBy("root").agg(least.alias("row"))
    key = lambda c: [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")), F.col(c).isNull()]
    names = ["_textloom_id", "_textloom_null", "_textloom_hash"]
    wanted = first.select(*(c.alias(n) for c, n in zip([*key("row.id"), F.col("row.hash")], names)))
    keyed = docs.withColumns(dict(zip(names, [*key("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))])))
    hashed = F.xxhash64(*(f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    rows = keyed.join(wanted, names).groupBy(*names).agg(F.min_by(F.struct(*(f"`{c}`" for c in docs.columns)), hashed).alias("row"))
    return rows.select("row.*")
