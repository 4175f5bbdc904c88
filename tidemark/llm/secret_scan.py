"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by form. Their hashes are counted over the corpus by
distinct repositories and owners: a value that many owners hold is a copied
example, one that is bound to few owners looks live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import whole_text, write_table

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The forms of the base kinds, in the order in which spans are listed.
BASE = (
    ("assign", _ASSIGN, 12),
    ("access", "AKIA[A-Z0-9]{14,}", 18),
    ("hex", "[0-9a-f]{16,}", 16),
)
#: Forms that the method adds: prefixed keys of services, private key headers, long mixed strings.
WIDER = (
    ("vendor", r"\b(?:gh[opsu]_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|SG\.)[A-Za-z0-9_.-]{16,}", 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*", 27),
    ("mixed", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{24,}+", 24),
)
#: Owners from which a value is a copied example, and repositories from which it is one if more than one owner holds it.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 5, 100
#: Items that one fold with an array as its state takes; code points of a page of a text.
CHUNK, PAGE = 256, 1024


def _gathered(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """An array of type ``kind``, one element for each of ``items``, made by a fold from left to right.

    ``step`` takes the state (of ints) and an item and gives the next state
    and the element. Spark copies what a fold holds at each step; so a first
    fold passes the state alone and keeps it for each chunk of items, and
    each chunk's elements are gathered by a fold of its own. The items are
    bound to a variable of ``transform``, which evaluates them once.
    """
    none = F.array().cast(f"array<{kind}>")
    now = lambda values: F.struct(*(values[k].cast("int").alias(k) for k in state))

    def over(x: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int"))
        part = lambda c: F.slice(x, c * CHUNK + 1, CHUNK)
        passed = lambda a, c: F.struct(F.aggregate(part(c), a["now"], lambda s, i: now(step(s, i)[0])).alias("now"), F.concat(a["starts"], F.array(a["now"])).alias("starts"))
        begin = F.struct(now(state).alias("now"), F.array().cast(f"array<struct<{','.join(f'{k}:int' for k in state)}>>").alias("starts"))
        starts = F.aggregate(chunks, begin, passed, lambda a: a["starts"])

        def held(a: Column, i: Column) -> Column:
            after, element = step(a["now"], i)
            return F.struct(now(after).alias("now"), F.concat(a["out"], F.array(element.cast(kind))).alias("out"))

        return F.flatten(F.zip_with(starts, chunks, lambda s, c: F.aggregate(part(c), F.struct(s.alias("now"), none.alias("out")), held, lambda a: a["out"])))

    return F.transform(F.array(items), over)[0]


def _with_spans(df: DataFrame, name: str, pattern: str, least: int) -> DataFrame:
    """Adds the array column ``name`` of structs (start, end, value): matches of ``pattern`` whose value is long enough.

    The matches and the gaps between them, which ``split`` gives, alternate;
    so their lengths add up to the starts, in code points. A value is what
    follows the name and its sign, or the whole match.
    """
    found, gaps = F.col(f"{name}_found"), F.col(f"{name}_gaps")
    has = F.size(found) > 0
    df = df.withColumn(f"{name}_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"{name}_gaps", F.when(has, F.split("text", pattern, -1)))
    value = (lambda m: F.regexp_extract(m, pattern, 2)) if name == "assign" else (lambda m: m)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("match")))

    def placed(at: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = at["at"] + x["gap"]
        return {"at": start + x["size"]}, F.struct(start.alias("start"), (start + x["size"]).alias("end"), value(x["match"]).alias("value"))

    kind = "struct<start:int,end:int,value:string>"
    spans = F.filter(_gathered(pairs, {"at": F.lit(0)}, placed, kind), lambda s: F.char_length(s["value"]) >= least)
    return df.withColumn(name, F.coalesce(F.when(has, spans), F.array().cast(f"array<{kind}>"))).drop(f"{name}_found", f"{name}_gaps")


def _tagged(name: str, rank: int) -> Column:
    return F.transform(
        name,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind"), F.sha2(s["value"].cast("binary"), 256).alias("hash")),
    )


_SPAN = "struct<start:int,rank:int,end:int,kind:string,hash:string>"


def _apart(spans: Column) -> Column:
    """The wider spans of a sorted array of all spans that overlap no base span and none of a kind listed before their own.

    One fold from each side: the first knows how far earlier spans reach, the
    second where later ones start.
    """
    first, kinds = len(BASE), [f"k{r}" for r in range(len(BASE), len(BASE) + len(WIDER) - 1)]
    marked = _SPAN[:-1] + ",meets:boolean>"

    def fold(items: Column, far: int, crosses: Callable[[Column, Column], Column], held: Callable[[Column, Column], Column]) -> Column:
        def step(a: Column, x: Column) -> tuple[dict[str, Column], Column]:
            meets = crosses(a["base"], x)
            for r, k in enumerate(kinds, first):
                meets = meets | ((x["rank"] > r) & crosses(a[k], x))
            after = {"base": F.when(x["rank"] < first, held(a["base"], x)).otherwise(a["base"])}
            after |= {k: F.when(x["rank"] == r, held(a[k], x)).otherwise(a[k]) for r, k in enumerate(kinds, first)}
            return after, F.struct(*(x[f].alias(f) for f in ("start", "rank", "end", "kind", "hash")), (x["meets"] | ((x["rank"] >= first) & meets)).alias("meets"))

        return _gathered(items, dict.fromkeys(["base", *kinds], F.lit(far)), step, marked)

    fresh = F.transform(spans, lambda s: F.struct(*(s[f].alias(f) for f in ("start", "rank", "end", "kind", "hash")), F.lit(False).alias("meets")))
    ahead = fold(fresh, 0, lambda reach, x: reach > x["start"], lambda reach, x: F.greatest(reach, x["end"]))
    behind = fold(F.reverse(ahead), 2**31 - 1, lambda begin, x: begin < x["end"], lambda begin, x: F.least(begin, x["start"]))
    kept = F.filter(behind, lambda s: (s["rank"] >= first) & ~s["meets"])
    return F.reverse(F.transform(kept, lambda s: F.struct(*(s[f].alias(f) for f in ("start", "rank", "end", "kind", "hash")))))


def find_candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, owner, repo, digest, carried, base, wider), one for each row of ``docs``.

    ``base`` and ``wider`` are arrays of (start, rank, end, kind, hash) by
    start and then kind; a wider match that overlaps a base span, or one of a kind
    listed before its own, is left out.
    ``digest`` tells rows of equal ids with different texts apart. Without
    ``repo_col`` each document counts as a repository.
    """
    repo = docs[repo_col or id_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("id"), docs[owner_col].cast("string").alias("owner"), repo.alias("repo"),
        F.struct(*[docs[c] for c in carry] or [F.lit(0).alias("none")]).alias("carried"), whole_text(text_col).alias("text"),
    )
    for name, pattern, least in BASE + WIDER:
        rows = _with_spans(rows, name, pattern, least)
    base = F.array_sort(F.concat(*(_tagged(name, k) for k, (name, _, _) in enumerate(BASE))))
    wider = F.array_sort(F.concat(*(_tagged(name, k) for k, (name, _, _) in enumerate(WIDER, len(BASE)))))
    rows = rows.withColumn("base", base).withColumn("wider", wider)
    apart = F.when(F.size("wider") > 0, _apart(F.array_sort(F.concat("base", "wider")))).otherwise(F.col("wider"))
    return rows.select("id", "owner", "repo", F.xxhash64("text").alias("digest"), "carried", "base", apart.alias("wider"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Rows (hash, repos, owners): in how many repositories and by how many owners each value is held.

    Counted in three steps, each with partial sums before its shuffle, so
    that a value in a third of all documents makes no hot task. A null owner
    or repository counts as one of its own.
    """
    spans = candidates.select("owner", "repo", F.explode(F.concat("base", "wider")).alias("s")).select("owner", "repo", "s.hash")
    repos = spans.groupBy("hash", "owner", "repo").count()
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def judge_candidates(candidates: DataFrame) -> DataFrame:
    """``candidates`` (written once) with ``live`` and ``example``: its spans by what ownership says of their values.

    Documents without a candidate take no part in the joins, so that hardly
    any text is shuffled where ``carried`` holds it. The verdicts of a document are gathered by id and digest; rows alike in both are alike in
    all spans, so repeated rows get the same.
    """
    spans = candidates.where(F.size(F.concat("base", "wider")) > 0).select("id", "digest", F.explode(F.concat("base", "wider")).alias("s")).distinct()
    counted = spans.join(ownership(candidates).select(F.col("hash").alias("of"), "owners", "repos"), F.col("s.hash") == F.col("of"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repos") >= EXAMPLE_REPOS))
    verdicts = counted.groupBy("id", "digest").agg(
        F.array_sort(F.collect_list(F.when(~copied, F.col("s")))).alias("live"), F.array_sort(F.collect_list(F.when(copied, F.col("s")))).alias("example")
    )
    verdicts = verdicts.withColumnsRenamed({"id": "of_id", "digest": "of_digest"})
    has = F.size(F.concat("base", "wider")) > 0
    busy = candidates.where(has).join(verdicts, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))).drop("of_id", "of_digest")
    none = F.array().cast(f"array<{_SPAN}>")
    return candidates.where(~has).withColumn("live", none).withColumn("example", none).unionByName(busy)


def scan_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: id, counts and digest of the base kinds, ``spans``, ``n_live`` and ``n_example``.

    ``spans`` lists kind:start:end by start and then kind: every base span,
    and the wider matches whose value looks live. Null and empty texts have
    none and the digest of the empty string; a null id is an id of its own.
    """
    judged = judge_candidates(write_table(find_candidates(docs, **options), "secrets"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = F.filter("live", lambda s: s["rank"] >= len(BASE))
    every = F.array_sort(F.concat("base", added))
    return judged.select(
        "id", *(count(name) for name, _, _ in BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("example").cast("long").alias("n_example"),
    )


def redact_documents(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """All rows of ``docs`` with every secret replaced; documents without one are unchanged.

    A value that looks live becomes ``[secret]``, a widely copied one
    ``[example secret]``. Overlapping spans are replaced together. The text
    is cut at the spans by position; null stays null.
    """
    columns = docs.columns
    held = write_table(find_candidates(docs, text_col=text_col, carry=tuple(columns), **options), "secret-docs")
    judged = judge_candidates(held)
    tag = lambda s, what: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(what).alias("tag"))
    marks = F.array_sort(F.concat(F.transform("live", lambda s: tag(s, "[secret]")), F.transform("example", lambda s: tag(s, "[example secret]"))))
    judged = judged.withColumn("marks", marks)
    text = F.col(f"carried.{text_col}")

    def cleaned(pages: Column) -> Column:
        """The text, which ``pages`` holds in parts of ``PAGE`` code points: a piece is cut from its own pages, wherever it is."""

        def cut(a: Column, s: Column) -> tuple[dict[str, Column], Column]:
            first, last = F.floor(a["at"] / PAGE).cast("int"), F.floor(s["start"] / PAGE).cast("int")
            piece = F.substring(F.array_join(F.slice(pages, first + 1, last - first + 1), ""), a["at"] % PAGE + 1, s["start"] - a["at"])
            return {"at": F.greatest(a["at"], s["end"])}, F.when(s["start"] >= a["at"], F.concat(piece, s["tag"])).otherwise("")

        pieces = _gathered(F.col("marks"), {"at": F.lit(0)}, cut, "string")
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform("marks", lambda s: s["end"])) + 1, F.lit(2**31 - 1)))

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    clean = F.when(F.size("marks") > 0, F.transform(F.array(pages), cleaned)[0]).otherwise(text)
    fixed = judged.select("carried", clean.alias("clean"))
    out = [F.col("clean").alias(c) if c == text_col else F.char_length("clean").cast("long").alias(c) if c == length_col else F.col(f"carried.`{c}`").alias(c) for c in columns]
    return fixed.select(*out)
