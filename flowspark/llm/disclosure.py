"""Personal data, and the words around it that give it away.

Entities are e-mail addresses, IP addresses, card and phone numbers, found by fixed patterns.  Which
terms reveal an entity is estimated from the corpus: of all occurrences of term t in all documents,
n(t), so many lie within ``window`` words of entity e, n(t, e).  An observer who reads t is left with
IC(e) - PMI(t; e) = log2(n(t) / n(t, e)) bits about e.  A term that co-occurs with e in ``support`` or
more different contexts (copies of a passage are one) is removed near e where at most ``remove`` bits
are left, and generalised where at most ``generalise`` are.

Only terms near an entity of the same document are judged, so documents without entities have no
spans, and the work grows with the entities found; the counts n(t) cover every word of every document.

Defined cases: null text is empty and has no spans; the rows of a repeated (doc_id, text) stand side
by side with equal spans, and each counts; doc_id is passed through, null or not; spans are in code
points, end exclusive; spans of one kind do not overlap, terms overlap no base span; extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import ascii_lower, is_small, materialized, maybe_broadcast

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds.
REMOVED, GENERALISED = "term", "general"
SPAN = "struct<kind:string,start:bigint,end:bigint>"
NEAR = "struct<entity:bigint,term:string,start:bigint,end:bigint,context:bigint>"
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_NEAR = pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("context", pa.int64())])
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits that it could take whole, so the search skips there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SEPARATORS = str.maketrans("", "", "\x20-")
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{2,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain.tld: a local part ends at its first @, so only the signs before each @ are looked at."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            out.append((start, free))
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled, and the others sum to tens."""
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = found.translate(_SEPARATORS)
    return 16 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _number(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _entity(kind: str, found: str) -> int:
    return _number(kind, found.translate(_LOWER) if kind == "email" else "".join(_DIGIT.findall(found)) if kind in ("card", "phone") else found)


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int) -> list[tuple[int, str, int, int, int]]:
    """``entity, term, start, end, context`` of the terms within ``window`` terms of an entity; a term
    that several occurrences of one entity reach counts once, in the first one's context."""
    covered, edge = [], -1
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a > edge:
            covered.append([a, b])
        else:
            covered[-1][1] = max(covered[-1][1], b)
        edge = covered[-1][1]
    begins = [a for a, _ in covered]
    terms = []
    for m in _TERM.finditer(text.translate(_LOWER)):
        k = bisect_left(begins, m.end()) - 1
        if k < 0 or covered[k][1] <= m.start():
            terms.append((m.start(), m.end(), m[0]))
    starts, ends = [t[0] for t in terms], [t[1] for t in terms]
    out, seen = [], set()
    for kind, a, b in spans:
        entity = _entity(kind, text[a:b])
        left, right = bisect_right(ends, a), bisect_left(starts, b)
        own = range(max(0, left - window), min(len(terms), right + window))
        context = _number(" ".join(terms[i][2] for i in own), str(left - own.start))
        for i in own:
            if (entity, i) not in seen:
                seen.add((entity, i))
                out.append((entity, terms[i][2], terms[i][0], terms[i][1], context))
    return out


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def find(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, text_hash, base, near`` of every row."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                near = [near_terms(t, b, window) if b else [] for t, b in zip(texts, base)]
                spans = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in b] for b in base], pa.list_(_ARROW_SPAN))
                terms = pa.array([[dict(zip(("entity", "term", "start", "end", "context"), s)) for s in n] for n in near], pa.list_(_ARROW_NEAR))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), spans, terms], ["doc_id", "text_hash", "base", "near"])

    out = f"doc_id {_id_type(docs)}, text_hash long, base array<{SPAN}>, near array<{NEAR}>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, out)


def revealing_terms(docs: DataFrame, found: DataFrame, *, support: int, remove: float, generalise: float) -> DataFrame:
    """``entity, term, bits, kind``: what is left to know about the entity once the term is read."""
    near = found.select(F.explode("near").alias("r")).select("r.*")
    pairs = near.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    pairs = materialized(pairs.select("entity", "term", "n"), "disclosure-pairs")
    asked = pairs.select("term").distinct()
    words = docs.select(F.explode(F.split(ascii_lower(F.col("text")), _NOT_WORD)).alias("term"))
    if is_small(asked):
        words = words.join(F.broadcast(asked), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("all"))
    bits = pairs.join(counts, "term").withColumn("bits", F.log2(F.col("all") / F.col("n")))
    kind = F.when(F.col("bits") <= remove, REMOVED).otherwise(GENERALISED)
    return bits.where(F.col("bits") <= generalise).select("entity", "term", "bits", kind.alias("kind"))


def disclosures(docs: DataFrame, *, window: int = 10, support: int = 3, remove: float = 1.0, generalise: float = 2.0) -> DataFrame:
    """``doc_id, text_hash, base, terms``: spans of entities, and those of the terms that reveal them near by.

    A term that several entities call for is removed if one of them removes it.
    """
    found = materialized(find(docs, window), "disclosure-found")
    revealing = materialized(revealing_terms(docs, found, support=support, remove=remove, generalise=generalise), "disclosure-terms")
    near = found.select("doc_id", "text_hash", F.explode("near").alias("r")).select("doc_id", "text_hash", "r.entity", "r.term", "r.start", "r.end")
    marked = near.join(maybe_broadcast(revealing), ["entity", "term"])
    marked = marked.groupBy("doc_id", "text_hash", "start", "end").agg(F.max("kind").alias("kind"))  # "term" is the greater name
    terms = marked.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("_terms"))
    joined = found.join(terms, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "text_hash", "base", F.coalesce("_terms", F.array().cast(f"array<{SPAN}>")).alias("terms"))


def _shape(term: str) -> str:
    return "[number]" if term.isdigit() else "[Name]" if term[:1].isupper() else "[word]"


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text``: entities become their kind in brackets, removed terms nothing, generalised ones
    their shape.  Where spans overlap, the first (at one start the longest) stands."""
    keys = spans.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.concat("base", "terms").alias("spans")).dropDuplicates(["_d", "_h"])
    rows = docs.select("doc_id", "text").join(keys, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_h")))

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, free = [], 0
                for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= free:
                        kind, own = s["kind"], text[s["start"] : s["end"]]
                        parts += [text[free : s["start"]], _shape(own) if kind == GENERALISED else "" if kind == REMOVED else f"[{kind}]"]
                        free = s["end"]
                out.append("".join([*parts, text[free:]]) if text is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {_id_type(docs)}, text string")
