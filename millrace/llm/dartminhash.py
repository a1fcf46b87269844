"""Near-duplicate documents by DartMinHash signatures of word shingles.

A document is a weighted set: its shingles of five words, weighted by how often
they occur. Every shingle has a plane of weight by rank. The plane is cut into
cells of area one (weight bands 0-1, 1-2, 2-4, ...; the wider the band, the
lower the cell), and the shingle's hash throws a Poisson(1) number of darts into
each cell. A document sees the darts below its weights; each dart belongs to
one of K coordinates, and the dart of least rank is the coordinate's value. Two
documents agree on a coordinate with the probability of their weighted Jaccard
similarity, and about K ln K darts fill all coordinates whatever the document's
length (T. Christiani, "DartMinHash: Fast Sketching for Weighted Sets", 2020).

Coordinates are joined in bands. Documents of one band value are candidates;
each is compared only with leaders of its bucket (the least id and the one that
shares most buckets), not with all. Links are verified by the exact similarity.
What the leaders leave open is settled in cells: members of a bucket that holds
several classes meet in blocks, and pairs across classes are open unless their
sizes rule the similarity out or their signatures agree so little that a linked
pair would do so once in 10^9 times. A cell verifies its open pairs and gives the
links that join classes, so what leaves it is at most a link a member, whatever
the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idset
from .anchors import Rolling, mix
from .common import documents, given_ids, table, written
from .repeats import packed, texts_of, unpacked, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Members of a bucket that meet as many others at once.
BLOCK = 512
#: Rows of small cells that are handed on together.
GATHERED = 2_000
#: Most sets of equal documents that are broadcast, the largest ones.
HOT_SETS = 10_000
#: Chance that the signatures of a linked pair agree less than is asked of a pair of a block.
MISS = 1e-9
#: Shingles of the texts of a cell that are held at once.
HELD = 20_000_000

#: Cumulative probabilities of a Poisson(1) number.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1, 16)))))
_U = np.uint64


def shingles(text: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and how often each occurs; fewer words than `size` are one shingle."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    rolling = Rolling(words)
    whole = rolling.grams(size) if n >= size else rolling.spans(np.array([0]), np.array([n]))
    return np.unique(whole, return_counts=True)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def darts(element: np.ndarray, weight: np.ndarray, highest: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, rank) of all darts of ranks below `highest` under the elements' weights."""
    ids, ranks = [], []
    band, low = 0, 0
    while len(element):
        width = max(low, 1)  # bands 0-1, 1-2, 2-4, 4-8, ...
        cells = max(1, int(np.ceil(highest * width)))
        cell = mix(np.repeat(element, cells) + mix(np.tile(np.arange(cells, dtype=_U), len(element)) * _U(64) + _U(band)))
        count = np.searchsorted(_POISSON, _unit(mix(cell ^ _U(0xA5A5A5A5))))
        total = int(count.sum())
        number = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(np.repeat(cell, count) + number.astype(_U) * _U(0x9E3779B97F4A7C15))
        level = np.repeat(np.tile(np.arange(cells), len(element)), count)
        rank = (level + _unit(mix(dart ^ _U(0x5BD1E995)))) / width
        seen = rank < highest
        if low:
            height = low + width * _unit(mix(dart ^ _U(0x27D4EB2F)))
            seen &= height < np.repeat(np.repeat(weight, cells), count)
        ids.append(dart[seen])
        ranks.append(rank[seen])
        low += width
        band += 1
        more = weight > low
        element, weight = element[more], weight[more]
    return np.concatenate(ids), np.concatenate(ranks)


def signature(element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Values of the k coordinates of a non-empty weighted set."""
    highest = (k * np.log(k) + 2 * k) / weight.sum()
    while True:
        dart, rank = darts(element, weight, highest)
        dart = dart[np.argsort(rank, kind="stable")]
        coordinate, at = np.unique(mix(dart ^ _U(0x85EBCA6B)) % _U(k), return_index=True)
        if len(coordinate) == k:
            return dart[at]
        highest *= 2


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, low, high, bands, weight, marks): digest of the weighted set, the band values, the set's size and a byte of each coordinate; documents without words have none."""

    def sketch(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, low, high, values, weights, marks = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                element, weight = shingles(text)
                if not len(element):
                    continue
                both = element + mix(weight.astype(_U))
                low.append(np.add.reduce(mix(both)))
                high.append(np.add.reduce(mix(both ^ _U(0xC2B2AE3D27D4EB4F))))
                ids.append(doc_id)
                coordinate = signature(element, weight, bands * rows).reshape(bands, rows)
                value = np.arange(bands, dtype=_U)
                for r in range(rows):
                    value = mix(value * _U(0x9E3779B97F4A7C15) + coordinate[:, r])
                values.append(value.view(np.int64))
                weights.append(int(weight.sum()))
                marks.append(coordinate.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(low, dtype=_U).view(np.int64)), pa.array(np.array(high, dtype=_U).view(np.int64)), pa.array(values, pa.list_(pa.int64())), pa.array(weights, pa.int64()), pa.array(marks, pa.binary())],
                ["doc_id", "low", "high", "bands", "weight", "marks"],
            )

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, low long, high long, bands array<long>, weight long, marks binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - least
    return least / whole if whole else 0.0


def verified(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are at least so similar."""

    def judge(batches):
        for batch in batches:
            out, last, held = [], None, None
            for a, b, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), unpacked(batch.column(3)), strict=True):
                if a != last:
                    last, held = a, shingles(left)
                s = similarity(held, shingles(right))
                if s >= least:
                    out.append((a, b, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    texts = packed(docs, idset.bitmap(ends))
    by_b = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "packed": "right"}), "b")
    both = by_b.join(texts.withColumnsRenamed({"doc_id": "a", "packed": "left"}), "a")
    return both.select("a", "b", "left", "right").mapInArrow(judge, "a long, b long, similarity double")


def agreeing(k: int, least: float, miss: float = MISS) -> int:
    """Coordinates of k that a pair of that similarity agrees on at least, but for a chance of `miss`."""
    below, t = 0.0, 0
    while t < k and (below := below + math.comb(k, t) * least**t * (1 - least) ** (k - t)) < miss:
        t += 1
    return t


CELL = ["bucket", "one", "two"]
MEMBER = "bucket long, one long, two long, block long, rep long, label long, weight long, marks binary, bands array<long>"


class Cell:
    """Members of one bucket, of two of its blocks (or one): which pairs of them are still open.

    Open are pairs of different labels whose sizes allow the similarity, whose
    signatures agree enough, and that meet in no band before this one, so that a
    pair is open in one bucket only.
    """

    def __init__(self, rows: pa.RecordBatch | pa.Table, least: float, agree: int):
        bucket, self.one, self.two, self.block, self.rep, self.label, self.weight = (rows.column(c).to_numpy() for c in range(7))
        self.marks = np.stack(list(texts_of(rows.column(7))))
        self.bands = np.stack(rows.column(8).to_numpy(zero_copy_only=False))
        self.least, self.agree = least, agree
        self.band = int(np.flatnonzero(self.bands[0] == bucket[0])[0])

    def open_pairs(self):
        """(i, [j, ...], [agreement, ...]) for each member i with open pairs."""
        rows = np.arange(len(self.rep))
        left, right = rows[self.block == self.one[0]], rows[self.block == self.two[0]]
        for i in left:
            to = right[self.rep[right] > self.rep[i]] if self.one[0] == self.two[0] else right
            to = to[self.label[to] != self.label[i]]
            to = to[np.minimum(self.weight[to], self.weight[i]) >= (self.least - 1e-9) * np.maximum(self.weight[to], self.weight[i])]
            alike = (self.marks[to] == self.marks[i]).sum(axis=1)
            first = np.argmax(self.bands[to] == self.bands[i], axis=1)
            keep = (alike >= self.agree) & (first == self.band)
            if keep.any():
                yield i, to[keep], alike[keep]


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell at a time, of batches sorted by cell."""
    held: list[pa.RecordBatch] = []
    last: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        cuts = (np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and (begin or key[0].tolist() != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
        last = key[-1].tolist()
    if held:
        yield pa.Table.from_batches(held)


def open_members(members: DataFrame, least: float, agree: int, block: int | None = None) -> DataFrame:
    """MEMBER rows of the members with open pairs, in the cells where they are open; members: (bucket, rep, label, n, weight, marks, bands).

    A bucket is cut into blocks, and every two of them (and each with itself) are
    a cell of its own, so no task holds a bucket.
    """

    def rows(batches):
        kept, n = [], 0
        for table_ in by_cell(batches):
            table_ = table_.combine_chunks()
            mine = np.zeros(table_.num_rows, dtype=bool)
            for i, to, _ in Cell(table_, least, agree).open_pairs():
                mine[i] = True
                mine[to] = True
            if mine.any():
                kept.append(table_.filter(pa.array(mine)))
                n += int(mine.sum())
            if n >= GATHERED:
                yield from pa.concat_tables(kept).combine_chunks().to_batches()
                kept, n = [], 0
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    block = block or BLOCK
    own = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / block)).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("other")
    dealt = members.withColumn("block", own).select("*", other)
    placed = dealt.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "label", "weight", "marks", "bands")
    return placed.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(rows, MEMBER)


def cell_links(docs: DataFrame, members: DataFrame, least: float, agree: int) -> DataFrame:
    """(a, b, similarity): links that join the labels of `open_members`, at most one less than a cell has members.

    A cell's open pairs are verified by the exact similarity, the most agreeing
    ones first; a pair whose labels are joined by then needs none.
    """

    def rows(batches):
        for table_ in by_cell(batches):
            table_ = table_.combine_chunks()
            cell, blobs = Cell(table_, least, agree), table_.column(9)
            pairs = [(-n, i, j) for i, to, alike in cell.open_pairs() for j, n in zip(to.tolist(), alike.tolist(), strict=True)]
            parent: dict[int, int] = {}
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            size, out = 0, []

            def top(x: int, parent=parent) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            for _, i, j in sorted(pairs):
                a, b = top(int(cell.label[i])), top(int(cell.label[j]))
                if a == b:
                    continue
                for k in (i, j):
                    if k not in sets:
                        if size > HELD:
                            sets.clear()
                            size = 0
                        sets[k] = shingles(next(unpacked([blobs[k]])))
                        size += len(sets[k][0])
                if i not in sets:  # cleared for j
                    sets[i] = shingles(next(unpacked([blobs[i]])))
                s = similarity(sets[i], sets[j])
                if s >= least:
                    parent[max(a, b)] = min(a, b)
                    out.append((*sorted((int(cell.rep[i]), int(cell.rep[j]))), s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    texts = packed(docs, idset.bitmap(members.select(F.col("rep").alias("doc_id"))))
    held = members.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select(*[c.split()[0] for c in MEMBER.split(", ")], "packed")
    return held.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(rows, "a long, b long, similarity double")


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges between different classes, their ends renamed by (id, to) where a name is given."""
    for end in ("a", "b"):
        to = names.select(F.col("id").alias(end), F.col("to").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, label): the least id of each linked id's connected component, of the links and those `before` stands for.

    Edges are contracted: every class takes the name of its least neighbour, or
    that one's, and so on; edges inside a class go and equal ones become one.
    So a large class costs its edges once and not once per step.
    """
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    if before is None:
        labels = written(ids.withColumn("label", F.col("id")), "labels")
        edges = written(links.select("a", "b").distinct(), "edges")
    else:
        new = ids.join(before, "id", "left_anti").withColumn("label", F.col("id"))
        labels = written(before.select("id", "label").union(new), "labels")
        edges = written(_renamed(links.select("a", "b"), before.select("id", F.col("label").alias("to"))), "edges")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        names = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("to")), "names")
        while True:  # a name's own name, until none changes
            next_ = names.select(F.col("id").alias("to"), F.col("to").alias("then"))
            jumped = written(names.join(next_, "to").select("id", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")), "names")
            names = jumped.select("id", "to")
            if not jumped.where("moved").limit(1).count():
                break
        labels = written(labels.join(names.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        edges = written(_renamed(edges, names), "edges")
    return labels


def near_duplicates(df: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: (doc_id, class_id), class_id the least id linked to it, directly or through others.

    Documents with equal weighted shingle sets (copies, too) stand for one
    another. Null, empty and blank texts have no shingle and stay alone; texts of
    one to four words are one shingle. Repeated rows and null ids: see `common`
    (a class with the null id has a null class_id). Empty tables give empty results.
    """
    docs = documents(df)
    return given_ids(near_classes(docs, least, bands, rows), docs, "doc_id", "class_id")


def near_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`near_duplicates` of what `documents` returns, under its inner ids."""
    sketched = written(sketches(docs, bands, rows), "sketches")
    sets = ["low", "high"]
    reps = sketched.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *[F.min(c).alias(c) for c in ("bands", "weight", "marks")])
    each = reps.select("rep", F.explode("bands").alias("bucket"))
    filled = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(each.join(filled, "bucket"), "members")
    shared = members.groupBy("rep").agg(F.sum("n").alias("shared"))
    members = written(members.join(shared, "rep"), "members")
    hub = F.max_by("rep", F.struct(F.col("shared"), -F.col("rep")))
    leaders = members.groupBy("bucket").agg(F.array_distinct(F.array(F.min("rep"), hub)).alias("leaders"))
    pairs = members.join(leaders, "bucket").select("rep", F.explode("leaders").alias("leader")).where("rep != leader")
    led = written(pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), "pairs")
    labels = classes(written(verified(docs, led, least), "verified"))

    now = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label"))
    mixed = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    meeting = now.join(mixed, "bucket").join(reps.select("rep", "weight", "marks", "bands"), "rep")
    agree = agreeing(bands * rows, least)
    open_ = written(open_members(meeting, least, agree), "open")
    if open_.limit(1).count():
        more = written(cell_links(docs, open_, least, agree), "verified")
        if more.limit(1).count():
            labels = classes(more, labels)

    rep_of = written(reps.select(*sets, "rep", "copies").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(*sets, "copies", F.coalesce("label", "rep").alias("class_id")), "reps")
    classed = copies_classed(sketched.select("doc_id", *sets), rep_of, sets)
    alone = docs.select("doc_id").join(classed, "doc_id", "left")
    return alone.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def copies_classed(copies: DataFrame, rep_of: DataFrame, sets: list[str]) -> DataFrame:
    """(doc_id, class_id) of every document of a set; the sets of very many documents are broadcast, so that none is one task.

    Those are the sets with at least one in HOT_SETS of all documents, so HOT_SETS at most.
    """
    hot = max(1000, -(-copies.count() // HOT_SETS))
    few = rep_of.where(F.col("copies") >= hot).select(*sets, "class_id")
    met_few = copies.join(F.broadcast(few), sets, "left")
    rest = met_few.where("class_id is null").drop("class_id").join(rep_of.where(F.col("copies") < hot).select(*sets, "class_id"), sets)
    return met_few.where("class_id is not null").select("doc_id", "class_id").union(rest.select("doc_id", "class_id"))


def op4_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of distinct weighted sets that share a shingle, and the least id that links reach.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS n FROM d, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS t(i) GROUP BY doc_id, s),
sets AS (SELECT doc_id, md5(string_agg(s || '=' || n, chr(10) ORDER BY s)) AS h, sum(n) AS total FROM sh GROUP BY doc_id),
rep AS MATERIALIZED (SELECT h, min(doc_id) AS rep, any_value(total) AS total FROM sets GROUP BY h),
rs AS MATERIALIZED (SELECT rep, total, s, n FROM rep JOIN sh ON doc_id = rep),
link AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM rs a JOIN rs b ON a.s = b.s AND a.rep < b.rep AND least(a.total, b.total) >= 0.79 * greatest(a.total, b.total)
  GROUP BY a.rep, b.rep, a.total, b.total HAVING sum(least(a.n, b.n)) / (a.total + b.total - sum(least(a.n, b.n)))::DOUBLE >= 0.8),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, a AS to_ FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.to_ = both_ways.a),
label AS (SELECT id, min(to_) AS label FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(label, rep, d.doc_id) AS class_id FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (h) LEFT JOIN label ON label.id = rep
"""
