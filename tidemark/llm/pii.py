"""Personal data: detection by form and information-theoretic sanitisation.

Entities (addresses, numbers) are found by form. Terms of the same document
may reveal one: from the whole corpus, the pointwise mutual information of term
and entity is compared to the information content of the entity. A term that
discloses nearly all of it is removed, one that discloses much is
generalised.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from tidemark.llm.shared import whole_text, write_table

#: Kinds in the order in which spans are listed; the last two are added by the method.
KINDS = ("email", "ip", "card", "phone")
REMOVE, GENERALISE = "remove", "generalise"

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its first digit only: a match from a later one would also match from there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term is any run of letters and digits: short names and account numbers are terms too.
_TERM = re.compile(r"[^\W_]+")

#: Least distinct texts that hold term and entity together.
LEAST_TEXTS = 3
#: Share of the entity's information from which a term is generalised, and removed.
GENERALISE_FROM, REMOVE_FROM = 0.7, 0.9
#: Slots of the filter through which terms are counted: 2**20 bits, whatever the corpus.
SLOTS = 1 << 20
#: Slots of the filter through which disclosing pairs are found again: 2 MB.
PAIR_SLOTS = 1 << 24


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses, each found from its @: linear in the text, however long its words."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points by kind, then start."""
    spans = [("email", *s) for s in _emails(text)]
    if "." in text:
        spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


def _key(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """Numbers of the distinct entities of a text, in the order of their spans."""
    return list(dict.fromkeys(_key(f"{kind}:{text[start:end].lower()}") for kind, start, end in spans))


def terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """All terms of a text with start and end; terms that touch a span are left out."""
    taken = sorted((s, e) for _, s, e in spans)
    k, reach = 0, 0  # ``reach`` is the greatest end of the spans that start before the term's end
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a:
            yield m[0].lower(), a, b


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, digest, counts, base, entities, text, carried), one for each row of ``docs``; ``digest`` is of the text.

    ``digest`` and ``text`` are null where there is no entity: only the texts
    that hold one are read again. ``carried`` holds the columns in ``carry``.
    """
    rows = docs.select(docs[id_col].alias("id"), whole_text(text_col).alias("text"), F.struct(*[docs[c] for c in carry] or [F.lit(0).alias("none")]).alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) if s else None for t, s in zip(texts, spans, strict=True)], pa.binary()),
                    *(pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in KINDS),
                    pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in spans], pa.string()),
                    pa.array([entities(t, s) for t, s in zip(texts, spans, strict=True)], pa.list_(pa.int64())),
                    pa.array([t if s else None for t, s in zip(texts, spans, strict=True)], pa.string()),
                    batch.column("carried"),
                ],
                names=["id", "digest", *(f"n_{k}" for k in KINDS), "base", "entities", "text", "carried"],
            )

    schema = StructType().add(rows.schema["id"]).add("digest", "binary")
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base", "string").add("entities", ArrayType(LongType())).add("text", "string").add(rows.schema["carried"])
    return rows.mapInArrow(run, schema)


def _bits(slots: DataFrame, size: int) -> np.ndarray:
    """A filter of ``size`` bits, set at the numbers of the column ``slot``."""
    bits = np.zeros(size, bool)
    bits[slots.distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits)


def term_pairs(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (entity, term, places, n_both) of the entities in ``wanted``, over whole texts.

    ``n_both`` counts the rows of ``held`` (digest, entities, text) that hold both and ``places`` their distinct texts.
    A row's pairs are distinct and are dealt by both, so that an entity of many rows is dealt by its terms.
    """
    sent = held.sparkSession.sparkContext.broadcast(_bits(wanted.select(F.pmod("entity", F.lit(SLOTS)).cast("int").alias("slot")), SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for digest, mine, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "entities", "text")), strict=True):
                if near := [e for e in mine if mask[e % SLOTS]]:
                    found = sorted({t for t, _, _ in terms(text, base_spans(text))})
                    for e in near:
                        yield pa.RecordBatch.from_pydict({"entity": pa.array([e] * len(found), pa.int64()), "term": pa.array(found, pa.string()), "digest": pa.array([digest] * len(found), pa.binary())})

    rows = held.select("digest", "entities", "text").mapInArrow(run, "entity long, term string, digest binary")
    both = rows.groupBy("entity", "term", "digest").agg(F.count("*").alias("m")).groupBy("entity", "term").agg(F.count("*").alias("places"), F.sum("m").alias("n_both"))
    return both.where(F.col("places") >= LEAST_TEXTS).join(wanted.select("entity"), "entity", "left_semi")


def occurrences(held: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows (id, digest, start, end, share): every place in ``held`` of a term that discloses an entity of the same text."""
    pairs = shares.select("entity", "term").mapInArrow(_pair_slots, "slot int")
    sent = held.sparkSession.sparkContext.broadcast(_bits(pairs, PAIR_SLOTS))
    fields = f"id {held.schema['id'].dataType.simpleString()}, digest binary, entity long, term string, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for k, (digest, mine, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("digest", "entities", "text")), strict=True)):
                places: dict[str, list[tuple[int, int]]] = {}
                for t, a, b in terms(text, base_spans(text)):
                    places.setdefault(t, []).append((a, b))
                found = [(e, t, a, b) for e in mine for t, spans in places.items() if mask[_pair_slot(e, t)] for a, b in spans]
                if found:
                    e, t, a, b = zip(*found, strict=True)
                    ids = pa.concat_arrays([batch.column("id").slice(k, 1)]).take(pa.array([0] * len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([digest] * len(found), pa.binary()), pa.array(e, pa.int64()), pa.array(t, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        names=["id", "digest", "entity", "term", "start", "end"],
                    )

    rows = held.select("id", "digest", "entities", "text").mapInArrow(run, fields)
    return rows.join(shares, ["entity", "term"]).select("id", "digest", "start", "end", "share")


def count_terms(docs: DataFrame, wanted: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Rows (term, n): the number of rows of ``docs`` that hold each term of ``wanted``.

    The terms themselves may be many; what goes to the tasks is one bit for
    each of ``SLOTS`` hash values, and a shuffle join sorts out chance hits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select("term").distinct().mapInArrow(_slots, "slot int"), SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(sent.value).astype(bool)
        known: dict[str, bool] = {}
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for term in {t.lower() for t in set(_TERM.findall(text))}:
                    if (hit := known.get(term)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[term] = bool(mask[_slot(term)])
                    if hit:
                        counts[term] = counts.get(term, 0) + 1
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})

    texts = docs.select(whole_text(text_col).alias("text"))
    counted = texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(wanted.select("term").distinct(), "term", "left_semi")


def _slot(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) % SLOTS


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"slot": pa.array([_slot(t) for t in batch.column("term").to_pylist()], pa.int32())})


def _pair_slot(entity: int, term: str) -> int:
    return xxhash.xxh3_64_intdigest(term, seed=entity & (1 << 64) - 1) % PAIR_SLOTS


def _pair_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("entity").to_pylist(), batch.column("term").to_pylist(), strict=True)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([_pair_slot(e, t) for e, t in pairs], pa.int32())})


def disclosures(found: DataFrame, docs: DataFrame, *, text_col: str = "text") -> DataFrame | None:
    """Rows (entity, term, share): how much of an entity's information each of its terms discloses.

    ``share`` is pmi(term, entity) / information(entity), over the rows of
    ``docs`` and whole texts. A pair needs ``LEAST_TEXTS`` distinct texts, so
    that copies of one text prove nothing; an entity with fewer has no such
    pair and is left out before pairs are made. None if no pair has them.
    """
    n = docs.count()
    seen = found.select("digest", F.explode("entities").alias("entity")).groupBy("entity", "digest").agg(F.count("*").alias("m"))
    often = seen.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("m").alias("n_entity"))
    often = write_table(often.where((F.col("texts") >= LEAST_TEXTS) & (F.col("n_entity") < n)).select("entity", "n_entity"), "pii-entities")
    if often.isEmpty():
        return None
    pairs = write_table(term_pairs(found, often), "pii-pairs")
    if pairs.isEmpty():
        return None
    information = F.lit(math.log2(max(n, 2))) - F.log2("n_entity")
    share = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity"))) / information
    joined = pairs.join(count_terms(docs, pairs, text_col=text_col), "term").join(often, "entity")
    return write_table(joined.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE_FROM), "pii-shares")


def sanitise_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base, carried, spans, added), one for each row of ``docs``.

    ``base`` and ``spans`` list kind:start:end, joined by commas, by kind as
    listed and then start; ``added`` counts the terms to remove or to
    generalise, which are listed after the base kinds. Null and empty texts
    have no spans. Repeated rows are treated alike: the spans that the method
    adds are found by id and digest of the text. A text without an entity
    gets none; in one with an entity, every place of its terms is listed.
    What is shuffled are pairs of terms and entities that recur, and no texts.
    """
    found = write_table(detect(docs, id_col=id_col, text_col=text_col, carry=carry), "pii")
    held = found.where("digest is not null").drop("carried")
    shares = disclosures(held, docs, text_col=text_col)
    base = ("id", *(f"n_{k}" for k in KINDS), "base", "carried")
    if shares is None:
        return found.select(*base, F.col("base").alias("spans"), F.lit(0).cast("long").alias("added"))
    kind = F.when(F.max("share") >= REMOVE_FROM, REMOVE).otherwise(GENERALISE)
    marked = occurrences(held, shares).groupBy("id", "digest", "start", "end").agg(kind.alias("kind"))
    order = F.struct((F.col("kind") == GENERALISE).alias("late"), "start", "end", "kind")
    added = marked.groupBy("id", "digest").agg(F.array_sort(F.collect_list(order)).alias("more"))
    joined = found.drop("text", "entities").join(added.withColumnsRenamed({"id": "added_id", "digest": "added_digest"}), F.col("id").eqNullSafe(F.col("added_id")) & (F.col("digest") == F.col("added_digest")), "left")
    listed = F.transform(F.coalesce("more", F.array().cast("array<struct<late:boolean,start:long,end:long,kind:string>>")), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base"), listed), lambda x: x != ""), ",")
    return joined.select(*base, spans.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("added"))


def sanitised(text: str, spans: str) -> str:
    """``text`` without the personal data in ``spans``: entities become their kind, terms to remove vanish in ``[removed]``, others become their sort."""
    places = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, b, kind in places:
        if a >= at:
            term = text[a:b]
            sort = "number" if any(map(str.isdigit, term)) else "name" if term[:1].isupper() else "word"
            out += [text[at:a], f"[{'removed' if kind == REMOVE else sort if kind == GENERALISE else kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows of ``docs`` with the texts that ``sanitised`` gives, and their length in ``length_col``; rows without spans are unchanged, null stays null."""
    columns = docs.columns
    judged = sanitise_spans(docs, id_col=id_col, text_col=text_col, carry=tuple(columns)).select("carried", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sanitised(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(texts, pa.string())], names=["carried", "clean"])

    touched = judged.where("spans <> ''").select("carried", F.col(f"carried.`{text_col}`").alias("text"), "spans")
    clean = touched.mapInArrow(run, StructType().add(judged.schema["carried"]).add("clean", "string"))
    kept = {c: F.col(f"carried.`{c}`").alias(c) for c in columns}
    new = kept | {c: x.alias(c) for c, x in ((text_col, F.col("clean")), (length_col, F.char_length("clean").cast("long"))) if c in columns}
    return judged.where("spans = ''").select(*kept.values()).unionByName(clean.select(*new.values()))


def sha256_hex(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)
