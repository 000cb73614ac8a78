"""Personal data and what reveals it, by information-theoretic sanitisation; DataFrame functions only.

Base spans (e-mail, IP, card, phone) are the protected entities: each value, and each kind as a class of values.
Corpus co-occurrence tells how much a term gives an entity away. For a value the terms within CONTEXT code points of
it count, for a kind all terms of the texts that hold one; what base spans cover is no term. Of `n` texts with the
term `both` hold the entity, and P(entity | term) is estimated as (both + PRIOR * P(entity)) / (n + PRIOR), so few
texts are weak evidence. The term then discloses the share 1 + log2 P(entity | term) / IC(entity) of the entity's
information IC = -log2 P(entity). Terms at or over GENERALISE are exchanged for the class of their form (word, name,
number or code), those at or over REMOVE go, wherever they stand in the corpus. Evidence must come from two contexts
of a value, or from two values of a kind: a copied text is no new evidence.

Patterns are scanned in forms without nested repetition, in which a separator between two characters of the kind is
first exchanged for one reserved character. They match exactly what the plain patterns match, in linear time and
without deep recursion on very long runs. Places in a text are sums of lengths, and parts are cut from its UTF-32
form, where each code point has its place, so that the work of a text with very many spans stays linear, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, cut, table, text_or_empty, written

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
#: Code points on either side of an entity that are its context.
CONTEXT = 80
#: Texts that the entity's own share is worth as evidence.
PRIOR = 2.0
GENERALISE = 0.8
REMOVE = 0.98

_JOINT = "\ue001"  # stands for a separator within a match; the character itself is first read as U+FFFD
_LOCAL = f"A-Za-z0-9._%+{_JOINT}-"
_PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9{_JOINT}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?=(?:{_JOINT}?[0-9]){{16}})[0-9][0-9{_JOINT}]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_JOINTS = {"email": r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "card": r"(?<=[0-9])[ -](?=[0-9])"}
_POSSIBLE = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9][ ().0-9-]{7}"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

_SPAN = "struct<kind: string, start: bigint, end: bigint, value: string>"
_NO_WORD = r"[^\p{L}\p{N}]"
#: Running sums are taken in blocks of so many numbers.
_BLOCK = 256


def _let(value: Column, use) -> Column:
    """use(value), with `value` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running_sums(numbers: Column) -> Column:
    """array<bigint> of the sums up to each number, in blocks, as a growing array is copied at each step."""
    empty = F.array().cast("array<bigint>")

    def sums(a: Column) -> Column:
        step = lambda held, x: F.struct((held["at"] + x).alias("at"), F.array_append(held["out"], held["at"] + x).alias("out"))
        return F.aggregate(a, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda held: held["out"])

    def whole(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda i: sums(F.slice(a, i, F.lit(_BLOCK))))

        def shifted(b: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), sums(F.transform(b, lambda x: F.element_at(x, -1))))
            return F.flatten(F.zip_with(b, F.slice(before, 1, F.size(b)), lambda x, d: F.transform(x, lambda y: y + d)))

        return _let(blocks, shifted)

    return _let(numbers, lambda a: F.when(F.size(a) == 0, empty).when(F.size(a) <= _BLOCK, sums(a)).otherwise(whole(a)))


def _part(utf32: Column, start: Column, end: Column) -> Column:
    """Code points `start` to `end` of a text in UTF-32."""
    return F.decode(F.substring(utf32, (4 * start + 1).cast("int"), (4 * F.greatest(end - start, F.lit(0))).cast("int")), "UTF-32")


def _rewritten(text: Column, spans: Column, put) -> Column:
    """`text` with put(span) in place of each of `spans`, which are in order and apart."""

    def pieces(held: Column) -> Column:
        end = lambda i: F.coalesce(F.get(held["spans"], i)["end"], F.lit(0).cast("long"))
        each = F.transform(held["spans"], lambda x, i: F.concat(_part(held["utf32"], end(i - 1), x["start"]), put(x)))
        rest = _part(held["utf32"], end(F.size(held["spans"]) - 1), F.octet_length(held["utf32"]) / 4)
        return F.concat(F.array_join(each, ""), rest)

    return _let(F.struct(F.encode(text, "UTF-32").alias("utf32"), spans.alias("spans")), pieces)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<_SPAN> of one kind in order, in code points, end exclusive."""
    scanned = text
    if kind in _JOINTS:
        scanned = F.regexp_replace(F.translate(text, _JOINT, "\ufffd"), _JOINTS[kind], _JOINT)
    gaps, values = F.split(scanned, _PATTERN[kind], -1), F.regexp_extract_all(scanned, F.lit(_PATTERN[kind]), F.lit(0))

    def placed(held: Column) -> Column:
        lengths = F.zip_with(F.slice(held["gaps"], 1, F.size(held["values"])), held["values"], lambda g, v: (F.length(g) + F.length(v)).cast("long"))

        def span(v: Column, end: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))

        return F.zip_with(held["values"], _running_sums(lengths), span)

    spans = _let(F.struct(gaps.alias("gaps"), values.alias("values")), placed)
    return F.when(text.rlike(_POSSIBLE[kind]), F.filter(spans, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.lower(s["value"]))


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), rf"{_NO_WORD}+")), "")


def _near(text: Column, spans: Column) -> Column:
    """For each span its entity, context and the terms around it: array<struct<entity, context, terms>>; `text` without spans."""

    def around(held: Column) -> Column:
        def of(s: Column) -> Column:
            first, last = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["end"] + CONTEXT, F.octet_length(held["utf32"]) / 4)
            before, after = _part(held["utf32"], first, s["start"]), _part(held["utf32"], s["end"], last)
            # a word that touches the edge of the context may be cut, so it is no term
            before = F.when(first > 0, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
            after = F.when(last < F.octet_length(held["utf32"]) / 4, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
            return F.struct(_entity(s).alias("entity"), F.xxhash64(before, after).alias("context"), F.array_union(_terms(before), _terms(after)).alias("terms"))

        return F.transform(held["spans"], of)

    return _let(F.struct(F.encode(text, "UTF-32").alias("utf32"), spans.alias("spans")), around)


def _with_base(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as _doc, with doc_id, _k (the text's hash), base (array<_SPAN>), and for rows with spans
    outside (the text with spaces in place of spans) and near."""
    found = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", text_or_empty().alias("_t")).withColumns({f"_{k}": base_spans(F.col("_t"), k) for k in KINDS})
    outside = F.col("_t")
    for k in KINDS:  # spans of one kind are apart, those of different kinds may overlap
        outside = F.when(F.size(f"_{k}") > 0, _rewritten(outside, F.col(f"_{k}"), lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))).otherwise(outside)
    found = found.select("_doc", "doc_id", F.xxhash64("_t").alias("_k"), F.concat(*(F.col(f"_{k}") for k in KINDS)).alias("base"), outside.alias("_o"))
    found = found.select("_doc", "doc_id", "_k", "base", F.when(F.size("base") > 0, F.col("_o")).alias("outside"))
    return found.select("*", F.when(F.size("base") > 0, _near(F.col("outside"), F.col("base"))).alias("near"))


def _outside() -> Column:
    return F.coalesce("outside", "_doc.text", F.lit(""))


def disclosure(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosed, sure) of the terms that surely disclose at least `generalise` of an entity's
    information, and of each such term (term, sure) the most.

    An entity is `kind:value`, or a kind alone. `disclosed` takes the plain share of texts, `sure` the one shrunk
    towards the entity's own. Counts are over all rows of `docs`; a term counts once a row. All terms are counted
    before any is compared, so the work follows the text, whatever the entities.
    """
    holding = found.where("near is not null")
    near = holding.select("_row", F.explode("near").alias("n")).select("_row", "n.entity", "n.context", F.explode("n.terms").alias("term"))
    of_values = (
        near.groupBy("entity", "term", "_row").agg(F.min("context").alias("context"))
        .groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("context").alias("a"), F.max("context").alias("b"))
    )
    kinds = F.explode(F.array_distinct(F.transform("base", lambda s: s["kind"]))).alias("entity")
    first = F.xxhash64(F.array_min(F.transform(F.filter("base", lambda s: s["kind"] == F.col("entity")), _entity))).alias("value")
    by_kind = holding.select(kinds, "base", _terms(_outside()).alias("terms")).select("entity", first, "terms").select("entity", "value", F.explode("terms").alias("term"))
    of_kinds = by_kind.groupBy("entity", "term").agg(F.count("*").alias("both"), F.min("value").alias("a"), F.max("value").alias("b"))
    pairs = of_values.union(of_kinds).where("a <> b").drop("a", "b")
    named = F.array_distinct(F.concat(F.transform("base", _entity), F.transform("base", lambda s: s["kind"])))
    entities = found.select(F.explode(named).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    by_term = found.select(F.explode(_terms(_outside())).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    own = F.col("n_entity") / F.lit(float(max(docs.count(), 1)))
    share = lambda p: F.when(own < 1, 1 + F.log2(F.least(p, F.lit(1.0))) / -F.log2(own))
    told = pairs.join(by_term, "term").join(entities, "entity").select(
        "entity", "term", share(F.col("both") / F.col("n_term")).alias("disclosed"), share((F.col("both") + PRIOR * own) / (F.col("n_term") + PRIOR)).alias("sure")
    )
    told = cut(told.where(F.col("sure") >= generalise))
    return told, told.groupBy("term").agg(F.max("sure").alias("sure"))


def _with_spans(docs: DataFrame, generalise: float, remove: float) -> DataFrame:
    """Rows of _with_base with _row and terms: array<struct<kind, start, end, action>> in order, null if none."""
    found = written(_with_base(docs).withColumn("_row", F.monotonically_increasing_id()))
    _, told = disclosure(docs, found, generalise)
    size = told.agg(F.sum(F.octet_length("term") + 24)).first()[0]
    told = checked_broadcast(told.select("term", F.when(F.col("sure") >= remove, "remove").otherwise("generalise").alias("action")), size)
    rows = found.select("_row", _terms(_outside()).alias("terms")).select("_row", F.explode("terms").alias("term"))
    rows = cut(rows.join(told, "term").select("_row").distinct())
    # only texts with such a term are taken apart again
    texts = found.select("_row", _outside().alias("text")).join(checked_broadcast(rows, 16 * rows.count()), "_row", "left_semi")
    pieces = texts.select("_row", F.split("text", _NO_WORD, -1).alias("pieces")).select("_row", "pieces", _running_sums(F.transform("pieces", lambda w: (F.length(w) + 1).cast("long"))).alias("ends"))
    placed = F.filter(F.zip_with("pieces", "ends", lambda w, end: F.struct(w.alias("word"), (end - 1 - F.length(w)).alias("start"), (end - 1).alias("end"))), lambda x: x["word"] != "")
    hits = pieces.select("_row", F.explode(placed).alias("w")).select("_row", F.lower("w.word").alias("term"), "w.start", "w.end").join(told, "term")
    spans = F.sort_array(F.collect_list(F.struct(F.col("start"), F.col("end"), F.col("action"))))
    terms = hits.groupBy("_row").agg(F.transform(spans, lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"], t["end"], t["action"])).alias("terms"))
    return found.join(terms, "_row", "left")


def find_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, _k (the text's hash), base and spans of every row of `docs`: base spans and those of disclosing terms.

    A span is (kind, start, end, action); terms never touch a base span. Null texts count as empty, empty texts have
    no spans, repeated rows have the same spans each, ids may be null or repeat, an empty table gives an empty one.
    """
    base = F.transform("base", lambda b: F.struct(b["kind"], b["start"], b["end"], F.lit("generalise").alias("action")))
    joined = _with_spans(docs.select("doc_id", "text"), generalise, remove)
    return joined.select("doc_id", "_k", "base", F.concat(base, F.coalesce("terms", F.array().cast("array<struct<kind: string, start: bigint, end: bigint, action: string>>"))).alias("spans"))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Pipeline stage: `docs` with each base span exchanged for its kind, and each disclosing term for the class of
    its form, or removed; n_chars is counted anew.

    All rows and columns stay; texts without spans, and null ones, stay as they are.
    """
    own = docs.columns
    found = _with_spans(docs, generalise, remove)
    rows = found.select("_row", F.col("_doc.text").alias("_text"), "base", "terms", "_doc")
    # overlapping spans of different kinds: the later one gives way to the part that is left
    several = F.transform("base", lambda b: F.struct(b["start"], b["end"], b["kind"], F.lit("generalise").alias("action")))
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<kind: string, start: bigint, end: bigint, action: string>>")), lambda t: F.struct(t["start"], t["end"], t["kind"], t["action"]))
    spans = rows.where((F.size("base") > 0) | F.col("terms").isNotNull()).select("_row", F.explode(F.concat(several, terms)).alias("s")).select("_row", "s.*")
    before = F.max("end").over(Window.partitionBy("_row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("start", F.greatest("start", F.coalesce(before, F.lit(0)))).where("start < end")
    spans = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "action"))).alias("_spans"))
    marked = rows.join(spans, "_row", "left")

    def put(held: Column):
        def of(s: Column) -> Column:
            word = _part(held, s["start"], s["end"])
            form = F.when(word.rlike(r"^\p{N}+$"), "NUMBER").when(word.rlike(r"\p{N}"), "CODE").when(word.rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
            return F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.when(s["kind"] == TERM, form).otherwise(F.upper(s["kind"])), F.lit("]")))

        return of

    new = _let(F.encode("_text", "UTF-32"), lambda utf32: _rewritten(F.col("_text"), F.col("_spans"), put(utf32)))
    marked = marked.withColumn("_new", F.when(F.col("_spans").isNotNull(), new))
    out = {c: F.col(f"_doc.`{c}`") for c in own} | {"text": F.coalesce("_new", "_text")}
    if "n_chars" in own:
        out["n_chars"] = F.when(F.col("_new").isNull(), out["n_chars"]).otherwise(F.length("_new").cast("long"))
    return marked.select(*(c.alias(name) for name, c in out.items()))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op2_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document; see `find_spans` for nulls, repeated rows and empty tables."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
