"""Near duplicates by BagMinHash: weighted-Jaccard signatures of shingle bags.

A document is the bag of its five-word shingles. For every shingle, Poisson
processes run over dyadic intervals of its discretised weight; points beyond
the weight are thinned out and the first point of each signature place wins.
So two signatures agree in a place with a probability equal to the weighted
Jaccard similarity of the bags. Bands of places propose pairs, an exact count
of the multiset overlap decides, and links are joined to classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_tables, whole_text, write_table

#: Words of a shingle and the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and places of a band: a pair of similarity 0.8 meets in one with probability 1 - 5e-5.
BANDS, ROWS = 25, 5
PLACES = BANDS * ROWS
#: Places that must agree before two members of an open bucket are compared
#: exactly: five standard deviations below what 0.8 gives.
AGREE = int(PLACES * (SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / PLACES) ** 0.5))
#: Members and items of a block of an open group, shingles signed at a time, words kept by a worker.
BLOCK, BLOCK_ITEMS, BATCH, KNOWN = 256, 1 << 20, 300_000, 500_000
#: Hash values by which items are counted: 4 MB.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS

#: Ids up to which a set of wanted documents is broadcast: some 24 bytes each, 24 MB.
BROADCAST_IDS = 1_000_000
#: Texts that may hold more than this part of all rows each; they are broadcast.
HOT_TEXTS = 10_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of a text's shingles with their counts; words part at the six ASCII white space characters."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words, known = text.encode("utf-8", "replace").split(), self.known
        if len(known) > KNOWN:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        width = min(SHINGLE, len(h))
        if not width:
            return h, np.zeros(0, np.int64)
        n = len(h) - width + 1
        total = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            total = total * _GOLD + h[k : k + n]
        return np.unique(_mix(total), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash signatures of a list of bags: one row of ``PLACES`` numbers each, zeros for an empty bag.

    Interval 0 is [0, 1), interval j is [2**(j-1), 2**j). An element runs the
    process of each interval that its weight reaches into, with a rate
    proportional to the interval's length; each point draws a place and a
    weight in the interval and counts if that is below the element's. All
    processes advance together, one point a round, and one stops when its
    time is past the latest first point of its document.
    """
    sizes = np.array([len(h) for h, _ in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    seed = np.concatenate([h for h, _ in bags] or [np.zeros(0, np.uint64)])
    weight = np.concatenate([n for _, n in bags] or [np.zeros(0, np.int64)]).astype(np.int64)
    parts = [(doc, seed, weight, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while len(at := np.flatnonzero(weight > low)):
        parts.append((doc[at], _mix(seed[at] ^ np.uint64(low)), weight[at], np.full(len(at), low), np.full(len(at), low)))
        low *= 2
    doc, seed, weight, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.full(len(bags) * PLACES, np.inf)
    owner = np.zeros(len(bags) * PLACES, np.uint32)
    for at in range(0, len(doc), BATCH):  # a long text takes no more memory than many short ones
        part = slice(at, at + BATCH)
        _advance(doc[part], seed[part], weight[part], low[part], width[part], first, owner)
    return owner.reshape(-1, PLACES)


def _advance(doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, low: np.ndarray, width: np.ndarray, first: np.ndarray, owner: np.ndarray) -> None:
    """Run the processes of some elements to their end; ``first`` and ``owner`` take the first points."""
    time = np.zeros(len(doc))
    step = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(doc):
            step += np.uint64(1)
            draw = _mix(seed + step * _GOLD)
            time = time - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (width * PLACES)
            more = _mix(draw ^ _GOLD)
            place = doc * PLACES + (more % np.uint64(PLACES)).astype(np.int64)
            counts = low + ((more >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64) < weight
            at, when, who = place[counts], time[counts], (draw[counts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            np.minimum.at(first, at, when)
            won = first[at] == when
            owner[at[won]] = who[won]
            latest = first.reshape(-1, PLACES).max(axis=1)
            alive = time < latest[doc]
            doc, seed, weight, low, width, time = (x[alive] for x in (doc, seed, weight, low, width, time))


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One number for each band of each signature."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signed), BANDS)).copy()
    for k in range(ROWS):
        keys = _mix(keys * _GOLD + signed[:, k::ROWS].astype(np.uint64))
    return keys.astype(np.int64)


def text_node(text_col: str = "text") -> Column:
    """The number of a text, null read as empty: 64 bits of its digest, so that texts without id and other texts of an id have their own."""
    return F.xxhash64(whole_text(text_col))


def sign_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, node, digest, keys), one for each row of ``docs``; keys, one for each band, is null for a text without words."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_node(text_col).alias("node"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()

        def signed(ids: list, nodes: list, digests: list, bags: list) -> pa.RecordBatch:
            found = signatures(bags)
            full = [bool(len(h)) for h, _ in bags]
            keys = [k if f else None for k, f in zip(band_keys(found).tolist(), full, strict=True)]
            return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "node": pa.array(nodes, pa.int64()), "digest": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

        for batch in batches:
            ids, nodes, digests, bags, held = [], [], [], [], 0
            for i, node, text in zip(*(batch.column(c).to_pylist() for c in ("id", "node", "text")), strict=True):
                ids.append(i)
                nodes.append(node)
                digests.append(xxhash.xxh3_128_digest(text.encode("utf-8", "replace")))
                bags.append(shingler.bag(text))
                held += len(bags[-1][0])
                if held >= BATCH:
                    yield signed(ids, nodes, digests, bags)
                    ids, nodes, digests, bags, held = [], [], [], [], 0
            if ids:
                yield signed(ids, nodes, digests, bags)

    return rows.mapInArrow(run, "id long, node long, digest binary, keys array<long>")


def bag_similarity(left: str, right: str) -> float:
    """Multiset Jaccard similarity of the shingles of two texts; 0 if neither has words."""
    return _similarity(_counted(left), _counted(right))


def _counted(text: str) -> Counter:
    words = text.encode("utf-8", "replace").split()
    width = min(SHINGLE, len(words))
    return Counter(zip(*(words[k:] for k in range(width)), strict=False)) if width else Counter()


def _similarity(left: Counter, right: Counter) -> float:
    if len(right) < len(left):
        left, right = right, left
    both = sum(min(n, right[s]) for s, n in left.items() if s in right)
    either = left.total() + right.total() - both
    return both / either if either else 0.0


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts, in ``texts`` (id, text), are similar enough.

    Joined to the texts of a first, so that what is shuffled twice is the
    text of the many a and not copies of the text of a shared b. Both joins
    are of a kind whose large keys Spark splits.
    """
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, Counter()  # rows come in the order of b
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if b != last:
                    last, bag = b, _counted(b)
                keep.append(_similarity(_counted(a), bag) >= SIMILARITY)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Rows (id, label) for all ids in ``links`` (a, b): label is the least id that links lead to.

    Alternates the large-star and small-star steps until nothing changes;
    each round is written to the shared folder. A hub's links are reduced by
    partial minima, and the joins on hubs are of a kind that Spark splits.
    """
    spark = links.sparkSession
    pairs = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(), "links")
    state = None
    while True:
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).head()
        if mark == state:
            return pairs.select(F.col("big").alias("id"), F.col("small").alias("label")).union(pairs.select("small", "small")).distinct() if mark[0] else spark.createDataFrame([], "id long, label long")
        state, last = mark, pairs
        both = pairs.select(F.col("big").alias("u"), F.col("small").alias("v")).union(pairs.select("small", "big"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        small = large.join(least, "big").select(F.col("small").alias("big"), F.col("m").alias("small")).where("big <> small")
        pairs = write_table(small.union(least.select("big", "m")).distinct(), "links")
        drop_tables(last)


def bag_items(texts: DataFrame) -> DataFrame:
    """Rows (id, signature, items) of ``texts`` (id, text): a bag as a sorted set of 64-bit numbers, one for each occurrence of a shingle.

    The overlap of two bags is the number of items that both hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bags = [shingler.bag(text) for text in part.column("text").to_pylist()]
                items = []
                for h, n in bags:
                    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    items.append(np.sort(_mix(np.repeat(h, n) + nth.astype(np.uint64) * _GOLD)).astype("<u8").tobytes())
                signed = [x.tobytes() for x in signatures(bags).astype("<u4")]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "signature": pa.array(signed, pa.binary()), "items": pa.array(items, pa.binary())})

    return texts.mapInArrow(run, "id long, signature binary, items binary")


def _texts_of(docs: DataFrame, wanted: DataFrame, *, text_col: str) -> DataFrame:
    """Rows (id, text) of the texts numbered in ``wanted`` (id).

    They are counted; up to ``BROADCAST_IDS`` their numbers are broadcast, so
    that only the texts wanted are shuffled, beyond that all texts are.
    """
    ids = write_table(wanted.select("id").distinct(), "wanted-ids")
    few = ids.count() <= BROADCAST_IDS
    mine = docs.select(text_node(text_col).alias("id"), whole_text(text_col).alias("text"))
    found = write_table(mine.join(F.broadcast(ids) if few else ids, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")), "texts-of-pairs")
    drop_tables(ids)
    return found


def item_counts(items: DataFrame) -> np.ndarray:
    """Roughly how often items occur in ``items`` (items): counts by ``SLOTS`` hash values, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = b"".join(batch.column("items").slice(at, BLOCK).to_pylist())
                counts += np.bincount(_slot(np.frombuffer(part, "<u8")), minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int64()), "n": pa.array(counts[used])})

    got = items.select("items").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return counts


def _slot(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rare_items(items: DataFrame) -> DataFrame:
    """Rows (id, item): of each bag of ``items`` (id, items) the rarest ones, so many that two similar bags have one of them in common.

    A bag of n items shares at least ``SIMILARITY`` * n with any similar one,
    so the first common item, in one order for all bags, is among the first
    n - SIMILARITY * n + 1 of both. Any order is right; the one from rare
    to frequent, by ``item_counts``, makes small groups.
    """
    sent = items.sparkSession.sparkContext.broadcast(np.minimum(item_counts(items), 2**32 - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part, found = batch.slice(at, BLOCK), []
                for x in part.column("items").to_pylist():
                    x = np.frombuffer(x, "<u8")
                    most = len(x) - math.ceil(SIMILARITY * len(x) - 1e-9) + 1
                    found.append(x[np.lexsort((x, sent.value[_slot(x)]))[:most]])
                ids = np.repeat(part.column("id").to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "item": pa.array(np.concatenate(found).astype(np.int64))})

    return items.select("id", "items").mapInArrow(run, "id long, item long")


def with_partners(members: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``members`` (band, key, id, label), in buckets of two labels or more, whose bag has one of its ``rare_items`` in common with a bag of another label.

    No similar pair of different labels is lost. Texts that share a long
    passage and else differ are left out here, however many they are.
    """
    labelled = members.select("id", "label").distinct()
    rare = write_table(rare_items(items).join(labelled, "id"), "rare-items")
    shared = rare.groupBy("item").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("item")
    met = rare.join(shared, "item").select("id").distinct()
    left = write_table(members.join(met, "id"), "members-with-partners")
    drop_tables(rare)
    still = left.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("band", "key", "n")
    found = write_table(left.join(write_table(still, "still-open"), ["band", "key"]), "open-buckets")
    drop_tables(left)
    return found


def open_links(members: DataFrame, items: DataFrame) -> DataFrame:
    """Links (a, b) between different labels of ``members`` (band, key, id, label), as many as join them and no more; ``items`` is what ``bag_items`` gives.

    Only members ``with_partners`` are looked at. Their bucket is dealt to
    blocks by the number and size of its bags; each pair of blocks is one
    small task, whatever the bucket's size, and no member is left out. There,
    pairs whose signatures agree in ``AGREE`` places are compared exactly by
    their items, the most alike first, unless they are joined by then. A pair
    is looked at in the first band that it shares.
    """
    held = with_partners(members, items)
    sizes = items.select("id", (F.octet_length("items") / 8).alias("size"))
    weighed = held.join(sizes, "id").groupBy("band", "key").agg(F.sum("size").alias("size"), F.max("n").alias("n"))
    blocks = write_table(weighed.select("band", "key", F.ceil(F.least(F.col("n"), F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_ITEMS))).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = held.join(blocks, ["band", "key"]).select("band", "key", "id", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label").join(items, "id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, band = len(group), int(group["band"].iloc[0])
        signed = np.frombuffer(b"".join(map(bytes, group["signature"])), "<u4").reshape(n, PLACES)
        keys = band_keys(signed)
        bags = [np.frombuffer(bytes(x), "<u8") for x in group["items"]]
        sizes, ids = np.array([len(x) for x in bags]), group["id"].to_numpy()
        firsts: dict[int, int] = {}
        root = [firsts.setdefault(int(x), k) for k, x in enumerate(group["label"])]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        top = np.array(root)
        pairs = []
        for k in range(n - 1):
            agree = (signed[k + 1 :] == signed[k]).sum(axis=1)
            low, high = np.minimum(sizes[k + 1 :], sizes[k]), np.maximum(sizes[k + 1 :], sizes[k])
            met = np.argmax(keys[k + 1 :] == keys[k], axis=1) == band
            for x in np.flatnonzero((agree >= AGREE) & (low >= SIMILARITY * high) & met & (top[k + 1 :] != top[k])):
                pairs.append((-int(agree[x]), k, k + 1 + int(x)))
        found = []
        for _, a, b in sorted(pairs):
            if (left := find(a)) != (right := find(b)):
                both = len(np.intersect1d(bags[a], bags[b], assume_unique=True))
                if both >= SIMILARITY * (sizes[a] + sizes[b] - both):
                    root[left] = right
                    found.append((ids[a], ids[b]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = write_table(dealt.groupBy("band", "key", "i", "j").applyInPandas(run, "a long, b long"), "open-links")
    drop_tables(held, blocks)
    return links


def duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, digest, class_id), one for each row of ``docs``: ``class_id`` is the least id of its class.

    Equal texts are one class; different texts are linked if the similarity
    of their bags is at least ``SIMILARITY``, and links are followed. A text
    of less than five words is one shingle. Texts without words (null, empty,
    blank) are alike only if equal. What is linked are texts, whatever their
    ids: rows with a null id take part like all others, and texts that share
    an id are each of their own class. If no row of a class has an id,
    ``class_id`` is null.

    Every member of a bucket is first compared to the bucket's pivot, the one
    that meets most others over all its buckets and so is likely the original
    of its copies: as many pairs as members. A bucket stays open if its other
    members are of more than one class by then; only there further pairs are
    looked at, see ``open_links``.
    """
    return _labelled(docs, id_col=id_col, text_col=text_col).select("id", "digest", "class_id")


def _labelled(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, node, label, class_id, hot): ``label`` is the least number of the texts of a class, ``hot`` tells a text of very many copies."""
    signed = write_table(sign_documents(docs, id_col=id_col, text_col=text_col), "signatures")
    copies = write_table(signed.groupBy("digest", "node").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "copies")
    single = signed.where("keys is not null").groupBy("node").agg(F.min_by("keys", "digest").alias("keys"))
    single = write_table(single.select(F.col("node").alias("id"), "keys"), "representatives")
    members = single.select("id", F.posexplode("keys").alias("band", "key"))
    # A table that is written before it is joined lets Spark broadcast it if it is small and split hot keys if it is not.
    buckets = write_table(members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    held = write_table(members.join(buckets, ["band", "key"]), "bucket-members")
    near = held.groupBy("id").agg(F.sum("n").alias("near"))
    pivots = write_table(held.join(near, "id").groupBy("band", "key").agg(F.min(F.struct((-F.col("near")).alias("far"), "id")).alias("p")).select("band", "key", F.col("p.id").alias("pivot")), "pivots")
    others = write_table(held.join(pivots, ["band", "key"]).where("id <> pivot").select("band", "key", "id", "pivot"), "other-members")
    stars = write_table(others.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), "star-pairs")

    texts = _texts_of(docs, stars.select(F.col("a").alias("id")).union(stars.select("b")), text_col=text_col)
    links = write_table(verified(stars, texts), "links-found")
    labels = write_table(components(links), "labels")
    seen = write_table(others.join(labels, "id", "left").select("band", "key", "id", F.coalesce("label", "id").alias("label")), "labelled-members")
    is_open = write_table(seen.groupBy("band", "key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("band", "key"), "open-keys")
    left = write_table(seen.join(is_open, ["band", "key"]), "open-members")
    used = [single, buckets, held, pivots, others, stars, links, seen, is_open, left, texts]
    if not left.isEmpty():
        texts = _texts_of(docs, left, text_col=text_col)
        items = write_table(bag_items(texts), "open-bags")
        more = open_links(left, items)
        used += [texts, items, more, labels]
        labels = write_table(components(links.union(more)), "labels")
    linked = write_table(copies.join(labels.withColumnRenamed("id", "node"), "node").select("digest", "label", "first"), "linked")
    least = linked.groupBy("label").agg(F.min("first").alias("class_id"))
    linked_to = write_table(linked.select("digest", "label").join(least, "label"), "classes")
    drop_tables(*used, labels, linked)
    # A text that holds this share of all rows or more is hot: there are at most HOT_TEXTS of them, which are broadcast.
    from_copies = F.greatest(F.lit(2), F.ceil(F.lit(signed.count() / HOT_TEXTS)))
    class_id = F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("class_id"))
    classes = copies.join(linked_to, "digest", "left").select("digest", F.coalesce("label", "node").alias("label"), class_id.alias("class_id"), (F.col("copies") >= from_copies).alias("hot"))
    classes = write_table(classes, "class-of-text")
    rows, hot, rest = signed.select("id", "node", "digest"), classes.where("hot"), classes.where("not hot")
    of_hot = rows.join(F.broadcast(hot), "digest")
    of_rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")
    return of_hot.unionByName(of_rest).select("id", "node", "digest", "label", "class_id", "hot")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class: that of the least id, or of the least text if none has an id.

    Repeated rows of the kept document are reduced to one, the least as JSON
    if other columns differ. Rows are found again by their id and text, so
    that no other row of the id comes along. Null and empty texts are one
    class; an empty table gives no rows.
    """
    marked = _labelled(docs, id_col=id_col, text_col=text_col).groupBy("label", "id", "node").agg(F.count("*").alias("rows"), F.max("hot").alias("hot"))
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node", "rows", "hot")).alias("k")
    kept = marked.groupBy("label").agg(least).select(F.col("k.id").alias("kept_id"), F.col("k.node").alias("kept_node"), F.col("k.rows").alias("rows"), F.col("k.hot").alias("hot"))
    kept = write_table(kept, "kept")
    columns = docs.columns
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_node(text_col).alias("node"), F.struct(*[docs[c] for c in columns]).alias("row"))
    meets = (F.col("node") == F.col("kept_node")) & F.col("id").eqNullSafe(F.col("kept_id"))
    if kept.count() <= BROADCAST_IDS:
        joined = rows.join(F.broadcast(kept), meets)
    else:  # rows are dealt by text; the few hot texts are not
        hot = F.broadcast(kept.where("hot"))
        joined = rows.join(hot, meets).unionByName(rows.join(hot.select(F.col("kept_node").alias("node")), "node", "left_anti").join(kept.where("not hot"), meets))
    joined = joined.select("id", "node", "row", "rows")
    once = joined.where("rows = 1").select("row")
    one = joined.where("rows > 1").groupBy("id", "node").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(one).select("row.*")
