"""N-gram Jaccard join: which documents have nearly the same set of word n-grams, without building their pairs.

The product of the document by n-gram incidence matrix with its transpose counts the n-grams any two documents share.
It is built only where a link is possible, in blocks, and all bounds follow from set sizes, so no link is lost:

1. Equal sets are one class. A class is addressed by a 64-bit hash of its set.
2. Screening. Linked sets share ``c`` of the first ``n - need(n) + c`` n-grams in the order of their hashes, c a tenth of the
   size. These meet in hash buckets; a class whose n-grams meet too few others cannot be linked and is out.
3. The n-grams of the remaining classes are counted. In the order of these counts (rare first), linked sets share one of the
   first ``n - need(n) + 1``; n-grams of one class only make up the first places. What is left are the entries of the
   matrix at which a product has to start.
4. Stars. In every column the class with the fewest rare n-grams is the pivot; its row is multiplied with the rows of the
   others, a block of rows at a time, and pairs whose count stays below the bound of their sizes are discarded. So a group of
   any number of near copies costs one product for each.
5. Crossing pairs. Only columns that still hold several components can link more; their pairs across components that the
   sizes and places allow are multiplied too.

Words are the stretches between ASCII white space, A-Z lower-cased; a document with fewer words than ``size`` has its whole
sequence as its one n-gram. N-grams are 64-bit hashes.

Defined results: a null text or one without words has an empty set, belongs to no class and is its own component; repeated
ids and rows are rows of their own, in one class if their sets are equal; null ids take part, and a component of null ids
only has a null id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base, components

SIZE = 4
#: A link: LINK[1] * shared >= LINK[0] * union.
LINK = (85, 100)
#: n-grams that a screening bucket holds about, at least and at most, and that a task gathers before it deals them out. Beyond
#: 100 000 buckets they grow, so that what one task gives to one bucket does not shrink to single n-grams.
BUCKET, MOST_IN_BUCKET = 2_000_000, 16_000_000
FLUSH = 1_000_000
LEAST_BUCKETS = 32


def ngram_sets(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of all distinct n-grams, ordered by text and hash, and the number of n-grams of each text."""
    dictionary, codes, offsets = base.words(column)
    texts = len(offsets) - 1
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    words = base.hash_words(pc.ascii_lower(dictionary))[codes]
    odd = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(size)]
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total += words[i:n + i] * odd[i]
        text = np.repeat(np.arange(texts), counts)
        inside = np.arange(n) + size <= offsets[text[:n] + 1]
        total, owner = total[inside] + np.uint64(size), text[:n][inside]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            place = np.concatenate([np.arange(c) for c in counts[short]])
            mine = np.repeat(offsets[:-1][short], counts[short]) + place
            first = np.concatenate(([0], np.cumsum(counts[short])[:-1]))
            whole = np.add.reduceat(words[mine] * np.array(odd)[place], first) + counts[short].astype(np.uint64)
            total, owner = np.concatenate((total, whole)), np.concatenate((owner, short))
        hashes = base.mix(total)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[keep], hashes[keep]
    return owner, hashes, np.bincount(owner, minlength=texts)


def set_addresses(owner: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit address of each text's set; 0 for the empty one."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = sizes > 0
    if full.any():
        with np.errstate(over="ignore"):
            first = (np.cumsum(sizes) - sizes)[full]
            out[full] = base.mix(np.add.reduceat(base.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first) + sizes[full].astype(np.uint64))
    return out.view(np.int64)


def need(n, link: tuple[int, int] = LINK):
    """Shared n-grams that a set of ``n`` needs with any other set."""
    return -(-n * link[0] // link[1])


def common(n):
    """Of the screened n-grams, those that have to meet."""
    return np.maximum(1, n // 10)


_SCREEN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bucket", pa.int32()),
                     ("payload", pa.binary())])
_SCREEN_COLUMNS = "doc_id bigint, text_hash bigint, n bigint, cls bigint, bucket int, payload binary"


def _screen(size: int, link: tuple[int, int], buckets: int):
    """A row for each document, and rows of screened n-grams for the buckets.

    Payload: 32 bits of each n-gram and the number of its class within the payload, then the classes.
    """
    def deal(keys: list, classes: list):
        key, cls = np.concatenate(keys), np.concatenate(classes)
        spread = base.mix(key)
        bucket = (spread & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        short, cls, bucket = (spread[order] >> np.uint64(32)).astype("<u4"), cls[order], bucket[order].astype(np.int32)
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        numbers, payloads = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            names, own = np.unique(cls[a:b], return_inverse=True)
            numbers.append(int(bucket[a]))
            payloads.append(np.int64(b - a).tobytes() + short[a:b].tobytes() + own.astype("<u4" if len(names) > 65_535 else "<u2").tobytes()
                            + names.astype("<i8").tobytes())
        none = pa.nulls(len(numbers), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], schema=_SCREEN)

    def run(batches):
        keys, classes, held = [], [], 0
        for batch in batches:
            owner, hashes, sizes = ngram_sets(batch.column("text"), size)
            address = set_addresses(owner, hashes, sizes)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(address),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SCREEN)
            once = np.zeros(n, dtype=bool)
            once[np.unique(address, return_index=True)[1]] = True
            place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
            use = once[owner] & (place < (sizes - need(sizes, link) + common(sizes))[owner])
            keys.append(hashes[use])
            classes.append(address[owner[use]])
            held += int(use.sum())
            if held >= FLUSH:
                yield deal(keys, classes)
                keys, classes, held = [], [], 0
        if held:
            yield deal(keys, classes)
    return run


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    keys = np.frombuffer(payload, "<u4", n, 8)
    wide = (len(payload) - 8 - 8 * n) // 8 > 65_535 and (len(payload) - 8 - 8 * n) % 8 == 0
    width = 4 if wide else 2
    own = np.frombuffer(payload, f"<u{width}", n, 8 + 4 * n)
    return keys, np.frombuffer(payload, "<i8", offset=8 + (4 + width) * n)[own]


def _meet(batches):
    """For each class of a bucket the number of its n-grams that another class has too. Buckets come one after another."""
    def close(keys: list, classes: list):
        key, cls = np.concatenate(keys), np.concatenate(classes)
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[keep], cls[keep]
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        names, counts = np.unique(cls[shared], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], names=["cls", "met"])
    now, keys, classes = None, [], []
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            if bucket != now and keys:
                yield close(keys, classes)
                keys, classes = [], []
            now = bucket
            key, cls = unpack(payload)
            keys.append(key)
            classes.append(cls)
    if keys:
        yield close(keys, classes)


def _rows_of_matrix(size: int):
    """(cls, n, hashes) of the texts whose set has the expected address."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            owner, hashes, sizes = ngram_sets(batch.column("text"), size)
            address = set_addresses(owner, hashes, sizes)
            right = address == batch.column("cls").to_numpy()
            keep = right[owner]
            offsets = np.concatenate(([0], np.cumsum(sizes[right]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(address[right]), pa.array(sizes[right], pa.int64()), lists], schema=schema)
    return run


def _products(link: tuple[int, int]):
    """Rows (a, b, n_a, n_b, set_a, set_b): the row of ``a`` times a block of rows ``b``; links only.

    Blocks are the rows of one batch with the same ``a``. The n-grams of the block that ``a`` has are found by binary search
    and counted for each row; counts below the bound of the sizes are discarded.
    """
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            left, right = batch.column("set_a"), batch.column("set_b")
            ends = right.offsets.to_numpy()
            values = right.values.to_numpy()
            begins = np.append(np.flatnonzero(np.diff(a, prepend=a[0] - 1 if len(a) else 0) != 0), len(a))
            counts = np.zeros(len(a), dtype=np.int64)
            for first, stop in zip(begins[:-1], begins[1:]):
                row = np.sort(left[int(first)].values.to_numpy())
                block = values[ends[first]:ends[stop]]
                at = np.minimum(np.searchsorted(row, block), max(0, len(row) - 1))
                hits = np.concatenate(([0], np.cumsum(row[at] == block if len(row) else np.zeros(len(block), bool))))
                counts[first:stop] = hits[ends[first + 1:stop + 1] - ends[first]] - hits[ends[first:stop] - ends[first]]
            linked = link[1] * counts >= link[0] * (n_a + n_b - counts)
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])
    return run


def _possible(n_a: str, n_b: str, at_a: str, at_b: str, link: tuple[int, int]) -> Column:
    """Whether sets of these sizes can link if their first common n-gram is at these places."""
    bound = f"ceil({link[0]} * ({n_a} + {n_b}) / {link[0] + link[1]}D)"
    return F.expr(f"{at_a} <= {n_a} - {bound} and {at_b} <= {n_b} - {bound}")


def _verified(pairs: DataFrame, rows: DataFrame, link: tuple[int, int]) -> DataFrame:
    right = rows.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("set_b"))
    left = rows.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("set_a"))
    full = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "set_a", "set_b")
    return base.written(full.mapInArrow(_products(link), "a bigint, b bigint").distinct(), "links")


def _held(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """One text of each class: that of its row with this id and text hash, once if the row is repeated."""
    # What is screened in grows with the corpus: it is never broadcast, so the plan is the same at every size.
    found = rows.hint("merge").join(alive.hint("merge"), ["holder", "text_hash"])
    return found.dropDuplicates(["holder", "text_hash", "cls"]).select("cls", "text")


def link_documents(docs: DataFrame, size: int = SIZE, link: tuple[int, int] = LINK, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, cls (address of its set), component_id."""
    spark = base.set_up(docs.sparkSession)
    lowest = F.lit(-(2 ** 63))
    rows = base.documents(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    screens = volume // 26  # about one screened n-gram in 26 bytes
    buckets = max(LEAST_BUCKETS, screens // min(MOST_IN_BUCKET, max(BUCKET, screens // 100_000)))
    screened = base.written(rows.mapInArrow(_screen(size, link, buckets), _SCREEN_COLUMNS), "screened")
    members = screened.filter("bucket is null").select("doc_id", "text_hash", "n", "cls")
    classes = base.written(members.filter("n > 0").groupBy("cls").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("smallest"), F.min(F.coalesce("doc_id", lowest)).alias("holder"),
        F.min_by("text_hash", F.coalesce("doc_id", lowest)).alias("text_hash")), "classes")
    dealt = screened.filter("bucket is not null").select("bucket", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = dealt.mapInArrow(_meet, "cls bigint, met bigint").groupBy("cls").agg(F.sum("met").alias("met"))
    # The smallest set that may link; one less must meet, as two n-grams of a class may be the same in the buckets.
    other = F.ceil(F.col("n") * link[0] / float(link[1]))
    alive = classes.join(met, "cls").filter(F.col("met") >= F.greatest(F.lit(1), F.floor(other / 10) - 1)).select("cls", "holder", "text_hash")
    alive = base.written(alive, "screened-in")
    texts = _held(rows.select(F.coalesce("doc_id", lowest).alias("holder"), "text_hash", "text"), alive)
    matrix = base.written(texts.mapInArrow(_rows_of_matrix(size), "cls bigint, n bigint, hashes array<bigint>"), "matrix")
    cells = matrix.select("cls", "n", F.explode("hashes").alias("h"))
    counts = base.written(cells.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "columns")
    shared = cells.join(counts, "h").groupBy("cls", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("cells"))
    # The n-grams of one class alone come first; what they leave of the prefix are the entries.
    shared = shared.withColumn("alone", F.col("n") - F.size("cells")).withColumn(
        "reach", F.col("n") - F.ceil(F.col("n") * link[0] / float(link[1])) + 1 - F.col("alone")).filter("reach > 0")
    shared = base.written(shared.select("cls", "n", "alone", F.slice("cells.h", F.lit(1), F.col("reach").cast("int")).alias("prefix"),
                                        F.col("cells.h").alias("shared")), "rows")
    base.discard(matrix)
    entries = shared.select("cls", "n", "alone", F.posexplode("prefix").alias("i", "h")).select("h", "cls", "n", (F.col("alone") + F.col("i")).alias("at"))
    entries = base.written(entries, "entries")
    pivots = base.written(entries.groupBy("h").agg(F.min(F.struct("at", "cls", "n")).alias("p"), F.count("*").alias("many")).filter("many > 1")
                          .select("h", F.col("p.cls").alias("a"), F.col("p.n").alias("m"), F.col("p.at").alias("from")), "pivots")
    star = entries.join(pivots, "h").filter("a <> cls").filter(_possible("m", "n", "from", "at", link)).select("a", F.col("cls").alias("b")).distinct()
    links = _verified(star, shared, link)
    root = components.connected(links)
    labelled = base.written(entries.join(root, entries.cls == root.node, "left").select("h", "cls", "n", "at", F.coalesce("root", "cls").alias("root")), "labelled")
    mixed = base.written(labelled.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h"), "mixed")
    open_ = labelled.join(mixed, "h")
    x, y = open_.alias("x"), open_.alias("y")
    crossing = x.join(y, F.expr("x.h = y.h and x.root < y.root")).filter(_possible("x.n", "y.n", "x.at", "y.at", link)).select(
        F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    more = _verified(crossing, shared, link)
    if not more.isEmpty():
        first, root = root, components.connected(links.unionByName(more))
        base.discard(first)
    named = classes.select("cls", "smallest").join(root, classes.cls == root.node, "left").select("cls", "smallest", F.coalesce("root", "cls").alias("root"))
    named = base.written(named, "named")
    # Only linked classes meet here; a component of very many classes is reduced before the shuffle.
    least = base.written(named.groupBy("root").agg(F.min("smallest").alias("component_id")), "component-ids")
    final = base.written(named.join(least, "root").select("cls", "component_id"), "class-components")
    base.discard(classes, alive, counts, shared, entries, pivots, links, labelled, mixed, more, root, named, least)
    out = members.join(final, "cls", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls", F.when(F.col("n") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, link: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, in the columns of ``docs``: the smallest id (null last), of equal ids the smallest text hash.

    Rows with an empty set are linked with nothing and all stay.
    """
    found = link_documents(docs, size, link, doc_id, text)
    lowest = F.lit(-(2 ** 63))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", lowest).alias("doc"), "text_hash")
    linked = found.filter("n_shingles > 0").groupBy(F.coalesce("component_id", lowest).alias("c")).agg(F.min(row).alias("k")).select("k.doc", "k.text_hash")
    doc, mark = base.fresh(docs, "doc"), base.fresh(docs, "hash")
    keep = base.written(linked.distinct().select(F.col("doc").alias(doc), F.col("text_hash").alias(mark)), "kept")
    whole = docs.withColumn(doc, F.coalesce(F.col(doc_id).cast("bigint"), lowest)).withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    kept = whole.dropDuplicates([doc, mark]).join(keep, [doc, mark])  # repeated rows become one before the shuffle
    empty = docs.filter(F.coalesce(~F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return kept.select(*docs.columns).unionByName(empty)
