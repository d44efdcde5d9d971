"""Near copies by exact Jaccard similarity of five-word shingles, of rows whose similarity is `LEAST` or more and of chains of such rows.

A text is the set of the 64-bit hashes of its shingles; equal sets are one node from the start. Candidates are found by SimHash:
sets whose fingerprints differ in 3 or fewer bits, by the index of `simhash`. These bits miss many pairs of 0.8, so MinHash bands find the others: a
pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS, that is 99.7 % at 0.8. Each set is compared exactly
with the smallest it shares a band with, then sets that are still apart with the smallest of the band that shows it. Bands whose sets
are one group by then hold nothing more. The sets of the other bands, such as texts around a common passage, are joined exactly by
prefix filters: shingles are ordered from rare to frequent, a set is filed under so many of its rarest that two sets of 0.8 must
meet, and sets that share just what many share do not. Groups are known by labels, posting lists of one label are left out unseen.
All pairs are verified, and only verified links are closed transitively.

Texts stay where they are: a filter of bounded size picks the rows whose sets are needed, and the rows that may have to go.

Defined results: null, empty and wordless texts have the empty set and are copies of each other; a text of fewer than five
words is one shingle. A row is known by its id and text, so rows that share an id but not a text are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, map_texts, materialise
from .components import components
from .simhash import majority, near_links, shingle_digests

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 8
_RNG = np.random.default_rng(5)
FACTORS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OF_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)
#: Sets compared with one other in one task.
PART_SETS = 1024
#: Parts of a band.
PARTS = 16
#: Bits of the filters of rows: at most 2^18 words of 64 bits, whatever the number of rows.
WORDS = 1 << 18
#: Buckets in which the frequency of shingles is counted; it only decides their order.
BUCKETS = 1 << 18


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.frombuffer(shingle_digests((text or "").encode().lower().split(), size), ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for the empty set, whose rows are equal anyway."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(high), 128):
        np.minimum(least, (high[start : start + 128, None] * FACTORS).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * MIX).sum(axis=1, dtype=np.uint64) + OF_BAND
    return keys.view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def prints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of its set), bands, fp (SimHash fingerprint of the set) of every row."""
    inputs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            prints = majority(np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64))
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array([_node(s) for s in sets], pa.int64()), keys, pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "bands", "fp"])

    return map_texts(inputs, "text", work, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, mark long, node long, bands array<long>, fp long")


def _stars(bands_of: DataFrame) -> DataFrame:
    """(node, least): each node that shares a band with a smaller one, and smaller nodes of its bands; `bands_of`: node, bands.

    A band is dealt in `PARTS` parts, so that one of very many sets is no single task; each set meets the smallest of its part, and
    the smallest of each part the smallest of all.
    """
    filed = bands_of.select(F.explode("bands").alias("key"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    own = filed.withColumn("least", F.min("node").over(Window.partitionBy("key", "part")))
    inside = own.where("node <> least").groupBy("node").agg(F.min("least").alias("least"))
    heads = filed.groupBy("key", "part").agg(F.min("node").alias("node"))
    tops = heads.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    across = heads.join(tops, "key").where("node <> least").select("node", "least")
    return inside.union(across).groupBy("node").agg(F.min("least").alias("least"))


def _alike_prints(prints_of: DataFrame) -> DataFrame:
    """(node, least): a forest over nodes whose fingerprints differ in 3 or fewer bits; `prints_of`: node, fp."""
    prints = materialise(prints_of.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    same = prints_of.join(prints.where("n > 1"), "fp").where("node <> least").select("node", "least")
    links = near_links(prints.select("fp"))
    for end in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}")), end)
    across = links.select(F.greatest("node_a", "node_b").alias("node"), F.least("node_a", "node_b").alias("least"))
    return same.union(across)


def _open_bands(bands_of: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, least) of the bands whose sets have different labels, and (key, node, root) of their members; `bands_of`: node, bands."""
    filed = bands_of.join(labels, "node").select(F.explode("bands").alias("key"), "node", "root")
    keys = materialise(
        filed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("node", "root")).alias("first")).where("low <> high")
        .select("key", F.col("first.node").alias("least"), F.col("first.root").alias("least_root"))
    )
    return keys, filed.join(keys.select("key"), "key", "left_semi")


def _near(pairs: DataFrame, sets: DataFrame, least: float, part_sets: int) -> DataFrame:
    """(node, least, near) of each pair of sets (node, least)."""
    parts = pairs.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / part_sets).cast("int").alias("parts"))
    heads = parts.select("least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts").join(sets.withColumnRenamed("node", "least"), "least")
    members = pairs.join(parts, "least").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sets, "node")
    both = heads.select("least", "part", F.lit(0).alias("kind"), F.col("least").alias("node"), "hashes").union(members.select("least", "part", F.lit(1), "node", "hashes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            nodes, leasts, near = [], [], []
            for first, kind, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("least", "kind", "node", "hashes"))):
                own = np.frombuffer(hashes, np.uint64)
                if kind == 0:
                    head = own
                    continue
                small, large = sorted((own, head), key=len)
                common = 0
                if len(small) >= least * len(large) - 1e-9:
                    at = np.searchsorted(large, small)
                    common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                nodes.append(node)
                leasts.append(first)
                near.append(common >= least * (len(own) + len(head) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(leasts, pa.int64()), pa.array(near, pa.bool_())], ["node", "least", "near"])

    return both.repartition("least", "part").sortWithinPartitions("least", "part", "kind").mapInArrow(work, "node long, least long, near boolean")


def _labelled(pairs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("node", "least")) -> DataFrame:
    """pairs with label_<column> of both sides; labels: node, root."""
    for c in columns:
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("root").alias(f"label_{c}")), c)
    return pairs


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after links (node, least): only labels meet, so what is linked already costs nothing."""
    apart = _labelled(links.select("node", "least"), labels).where("label_node <> label_least")
    roots = components(apart, "label_node", "label_least").select(F.col("root").alias("new"), F.col("node").alias("root"))
    return materialise(labels.join(roots, "root", "left").select("node", F.coalesce("new", "root").alias("root")))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for hashes in batch.column("hashes").to_pylist():
                np.add.at(counts, (np.frombuffer(hashes, np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
        here = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(counts[here])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = sets.select("hashes").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _pairs(sets: DataFrame, least: float) -> DataFrame:
    """(node, least): pairs of sets (node, label, n, hashes) of different labels that may be as similar as `least`."""
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))  # BUCKETS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for node, label, hashes in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "hashes"))):
                own = np.frombuffer(hashes, np.uint64)
                n = len(own)
                often = counts[(own % np.uint64(BUCKETS)).astype(np.int64)]
                # the smaller of two sets meets the other's first shingles with fewer of its own
                asks, filed = n - int(np.ceil(least * n - 1e-9)) + 1, n - int(np.ceil(2 * least / (1 + least) * n - 1e-9)) + 1
                order = np.lexsort((own, often))[:asks]
                is_filed = np.arange(len(order)) < filed
                kept = often[order] > 1  # a bucket of one has no second set
                order, is_filed, at = order[kept], is_filed[kept], np.flatnonzero(kept)
                m = len(order)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(own[order].view(np.int64)), pa.array(np.full(m, node)), pa.array(np.full(m, label)), pa.array(np.full(m, n)), pa.array(at), pa.array(is_filed)], ["shingle", "node", "label", "n", "at", "filed"])

    rows = sets.mapInArrow(work, "shingle long, node long, label long, n long, at long, filed boolean")
    # lists of one set or of one linked group hold no pair
    lists = rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("filed").alias("filed")).where("low <> high AND filed").select("shingle")
    rows = materialise(rows.join(materialise(lists), "shingle", "left_semi"))
    filed = rows.where("filed").select("shingle", *(F.col(c).alias(f"{c}_f") for c in ("node", "label", "n", "at")))
    # the first shingle that two similar sets share leaves enough behind it in both
    enough = F.least(F.col("n") - F.col("at"), F.col("n_f") - F.col("at_f")) >= least / (1 + least) * (F.col("n") + F.col("n_f")) - 1e-9
    alike = (F.col("label") != F.col("label_f")) & (F.col("n_f") <= F.col("n")) & (F.col("n_f") >= least * F.col("n") - 1e-9)
    met = rows.join(filed, "shingle").where(alike & enough)
    return met.select(F.greatest("node", "node_f").alias("node"), F.least("node", "node_f").alias("least")).distinct()


def _keyed(rows: DataFrame, doc_id: Column, mark: Column, keys: list[str]) -> DataFrame:
    """With columns that are equal for rows of the same id, null included, and the same text."""
    return rows.withColumns(dict(zip(keys, (doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), mark))))


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(word, bits): a filter of the rows' keys in at most WORDS rows, so that it can go to every task."""
    h = _hash(keys)
    place = rows.select(F.pmod(F.shiftright(h, 6), F.lit(WORDS)).alias("word"), F.pmod(h, F.lit(64)).cast("int").alias("bit"))
    return place.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _marked(rows: DataFrame, keys: list[str], words: DataFrame, name: str) -> DataFrame:
    """With a column that is true for every row whose keys are in the filter, and for few others; no row moves."""
    h, word, bits = _hash(keys), fresh("word"), fresh("bits")
    small = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))  # at most WORDS rows of 16 bytes
    met = rows.join(small, F.pmod(F.shiftright(h, 6), F.lit(WORDS)) == F.col(word), "left")
    bit = F.call_function("shiftright", F.col(bits), F.pmod(h, F.lit(64)).cast("int")).bitwiseAND(1)
    return met.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(word, bits)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_sets: int = PART_SETS) -> DataFrame:
    """doc_id, mark, component (a node) of every row."""
    found = materialise(prints(docs, doc_id, text))
    distinct = found.groupBy("node").agg(F.first("bands").alias("bands"))
    alike = _alike_prints(found.groupBy("node").agg(F.first("fp").alias("fp")))
    first = materialise(alike.union(_stars(distinct)).distinct())
    # one row for each candidate set, with its text
    candidates = materialise(first.select("node").union(first.select("least")).distinct())
    one = found.select("node", "doc_id", "mark").join(candidates, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("row"))
    keys, maybe = [fresh("key") for _ in range(3)], fresh("maybe")
    picked = _keyed(one, F.col("row.doc_id"), F.col("row.mark"), keys).select(*keys)
    inputs = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), F.col("doc_id"), F.xxhash64("text"), keys)
    # texts do not move: the filter lets through what was picked and little else, and a set tells its node
    texts = _marked(inputs, keys, _words(picked, keys), maybe).where(maybe).select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "hashes"])

    made = map_texts(texts, "text", work, "node long, n long, hashes binary")
    sets = materialise(made.join(candidates, "node", "left_semi").dropDuplicates(["node"]))
    hashes, labels = sets.drop("n"), candidates.select("node", F.col("node").alias("root"))
    # most sets are near one of like fingerprint or the smallest of all their bands; other pairs are compared only if that left them apart
    labels = _joined(labels, materialise(_near(first, hashes, LEAST, part_sets)).where("near"))
    of_candidates = materialise(distinct.join(candidates, "node"))
    open_keys, members = _open_bands(of_candidates, labels)
    apart = members.join(open_keys, "key").where("root <> least_root").select("node", "least").distinct()
    second = materialise(apart.join(first, ["node", "least"], "left_anti"))
    labels = _joined(labels, materialise(_near(second, hashes, LEAST, part_sets)).where("near"))
    # bands that still hold sets of different groups
    _, members = _open_bands(of_candidates, labels)
    mixed = members.select("node", F.col("root").alias("label")).distinct()
    pairs = materialise(_pairs(materialise(mixed.join(sets, "node").select("node", "label", "n", "hashes")), LEAST))
    labels = _joined(labels, materialise(_near(pairs, hashes, LEAST, part_sets)).where("near"))
    roots = labels.withColumnRenamed("root", "component")
    return found.join(roots, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns as they were: that with the smallest id, a row without id only if none has one."""
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    rows = materialise(near_copies(docs, doc_id, text).groupBy("component", row.alias("row")).agg(F.count(F.lit(1)).alias("times")))
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    keys, maybe = [fresh("key") for _ in range(3)], fresh("maybe")
    known = _keyed(rows.join(first, "component"), F.col("row.doc_id"), F.col("row.mark"), keys)
    # rows that go, and rows that are there several times; all others stay where they are
    doubtful = materialise(known.where("row <> first OR times > 1").select(*keys, (F.col("row") == F.col("first")).alias("stays")))
    marked = _marked(_keyed(docs, F.col(doc_id), F.xxhash64(text), keys), keys, _words(doubtful, keys), maybe)
    stays = fresh("stays")
    tested = marked.where(maybe).join(doubtful.withColumnRenamed("stays", stays), keys, "left")
    again = tested.where(F.col(stays)).dropDuplicates(keys)
    return marked.where(~F.col(maybe)).select(*docs.columns).union(tested.where(F.col(stays).isNull()).select(*docs.columns)).union(again.select(*docs.columns))
