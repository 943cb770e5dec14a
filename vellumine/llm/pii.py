"""Personal data: base patterns, and terms that disclose a protected entity.

The base kinds (email, ip, card, phone) are found in one linear pass each. A base value
names protected entities on three levels: the value itself, its group (the domain of an
email, the network of an ip, the issuer of a card, the area of a phone) and its kind, so a
value that is too rare to count still has its group's and kind's terms. Over the whole
corpus the method counts the distinct texts that hold an entity, those that hold a term
(a word outside the base spans, anywhere in the text), and those that hold both:
IC(e) = -log(df(e) / N), PMI = log(df(t, e) N / (df(t) df(e))), and the term's share of
the entity's information is PMI / IC. A term at or above the disclosure threshold is
generalised to ``<term>`` in every text that holds the entity, and removed if it gives all
away. A term after which a certain value follows more often than not (df(t, e) / df(t) of
``GIVEN`` or more) is covered in all other texts as well. Counts are over distinct texts,
so copies prove nothing, and ``SUPPORT`` of them are needed.

Cases: a null text counts as empty and has no span. Repeated rows stay repeated, with
the same spans. Null ids are kept. An empty table gives an empty result. Columns that
clash with the result's names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import BROADCAST_BYTES, carried, distinct_texts, restored, salted_join, sized_join
from vellumine.shared import cut, fresh

KINDS = ("email", "ip", "card", "phone")
#: A term discloses an entity when it gives away at least this share of its information.
DISCLOSURE = 0.8
#: Distinct texts in which term and entity must stand together before their counts are trusted.
SUPPORT = 3
#: Share of a term's texts that hold a value from which the term is covered where the value is not.
GIVEN = 0.5
#: Levels of an entity.
VALUE, GROUP, KIND = 0, 1, 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A term, for Python and for the JVM.
WORD = r"\p{L}{2,}"
_WORD = regex.compile(WORD)


def _terms(text: Column) -> Column:
    """The distinct terms of a text: words as they stand, then in small letters, as ``outside`` takes them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part runs back from the ``@`` as far as its characters go, but not into an earlier match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))



def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in their order, then by start."""
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def entities(kind: str, value: str) -> list[str]:
    """The entities that a base value names, from the value to its kind; the first character is the level."""
    plain = value.lower() if kind == "email" else _NOT_DIGIT.sub("." if kind == "ip" else "", value)
    group = plain.rsplit("@", 1)[1] if kind == "email" else plain.rsplit(".", 1)[0] if kind == "ip" else plain[:6]
    return [f"{VALUE}:{kind}:{plain}", f"{GROUP}:{kind}:{group}", f"{KIND}:{kind}"]


def named(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    return sorted({e for kind, a, b in spans for e in entities(kind, text[a:b])})


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that no span overlaps."""
    taken, k = sorted((a, b) for _, a, b in spans), 0
    reach = 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            yield m[0].lower(), a, b


def holders(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """copy (a hash of the text), entities, terms (distinct words outside the spans) of the distinct texts with a base span."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for copy, t in zip(b["_copy"], b["_text"], strict=True):
                if spans := base_spans(t):
                    rows.append((copy, named(t, spans), sorted({w for w, _, _ in outside(t, spans)})))
            yield pd.DataFrame(rows, columns=["copy", "entities", "terms"])

    source = docs.select(F.xxhash64(text).alias("_copy"), F.col(text).alias("_text"))
    return source.mapInPandas(run, "copy long, entities array<string>, terms array<string>").dropDuplicates(["copy"])


def disclosing_terms(docs: DataFrame, *, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """entity, term, n_both, n_entity, n_term, share, given: the terms that give away at least ``disclosure`` of an entity's information."""
    held = cut(holders(docs, text=text), "holders")
    counts = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    counts = cut(counts, "entities")
    pairs = sized_join(held.select("terms", F.explode("entities").alias("entity")), counts.select("entity"), "entity", row_bytes=200)
    together = pairs.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    together = cut(together.where(F.col("n_both") >= support), "together")
    total = F.lit(float(max(docs.where(F.col(text) != "").select(F.xxhash64(text)).distinct().count(), 1)))
    words = distinct_texts(docs, text).select(F.explode(_terms(F.col("text"))).alias("term"))
    asked = cut(together.select("term").distinct(), "asked-terms")
    whole = sized_join(words, asked, "term", "left_semi", row_bytes=200).groupBy("term").agg(F.count("*").alias("n_term"))
    counted = sized_join(together.join(whole, "term", "left"), counts, "entity", row_bytes=200).withColumn("n_term", F.greatest("n_term", "n_both"))
    information = F.greatest(F.log(total / F.col("n_entity")), F.lit(1e-9))
    pmi = F.log(F.col("n_both") * total / (F.col("n_term") * F.col("n_entity")))
    shares = counted.select("entity", "term", "n_both", "n_entity", "n_term", (pmi / information).alias("share"), (F.col("n_both") / F.col("n_term")).alias("given"))
    return shares.where(F.col("share") >= disclosure - 1e-12)


def _disclosed(text: str, spans: list[tuple[str, int, int]], shares: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, share) of the terms of ``shares`` that stand in the text, outside its spans."""
    return [(a, b, shares[w]) for w, a, b in outside(text, spans) if w in shares] if shares else []


class _Model:
    """The disclosing terms by entity, and those that are covered in every text."""

    def __init__(self, rows: pd.DataFrame):
        self.of: dict[str, list[tuple[str, float]]] = {}
        self.everywhere: dict[str, float] = {}
        for entity, term, share, given in rows[["entity", "term", "share", "given"]].itertuples(index=False):
            self.of.setdefault(entity, []).append((term, share))
            if entity.startswith(f"{VALUE}:") and given >= GIVEN:
                self.everywhere[term] = max(share, self.everywhere.get(term, 0.0))

    def shares(self, held: list[str]) -> dict[str, float]:
        if not any(e in self.of for e in held):
            return self.everywhere
        out = dict(self.everywhere)
        for e in held:
            for term, share in self.of.get(e, ()):
                out[term] = max(share, out.get(term, 0.0))
        return out


def _of_texts(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """copy, own (term, share): what to cover in each distinct text that has such terms."""
    held = holders(docs, text=text).select("copy", F.explode("entities").alias("entity"), "terms").join(terms, "entity").where(F.array_contains("terms", F.col("term"))).select("copy", "term", "share")
    everywhere = terms.where(F.startswith("entity", F.lit(f"{VALUE}:")) & (F.col("given") >= GIVEN)).groupBy("term").agg(F.max("share").alias("share"))
    words = distinct_texts(docs, text).select("copy", F.explode(_terms(F.col("text"))).alias("term"))
    found = held.unionByName(words.join(everywhere, "term").select("copy", "term", "share")).groupBy("copy", "term").agg(F.max("share").alias("share"))
    return found.groupBy("copy").agg(F.collect_list(F.struct("term", "share")).alias("own"))


def _marked(docs: DataFrame, key: str, text: str, disclosure: float, support: int, limit: int) -> tuple[DataFrame, str, Any]:
    """``docs`` with a new column, its name, and a function (text, that column) -> base spans, disclosed terms.

    Terms of at most ``limit`` bytes go to the tasks as they are. More are joined to the texts by
    the text's hash, both sides salted.
    """
    terms = cut(disclosing_terms(docs, text=text, disclosure=disclosure, support=support), "disclosing")
    size = terms.agg(F.sum(F.octet_length("entity") + F.octet_length("term") + 200)).first()[0] or 0
    none = F.array().cast("array<struct<term:string,share:double>>")
    name, copy = fresh(docs, stem="own"), fresh(docs, stem="copy")
    if size <= limit:
        shared = docs.sparkSession.sparkContext.broadcast(_Model(terms.toPandas()))
        source = docs.withColumn(name, none)
    else:
        shared = None
        own = cut(_of_texts(docs, terms, text).select(F.col("copy").alias(copy), F.col("own").alias(name)), "own-terms")
        source = salted_join(docs.withColumn(copy, F.xxhash64(text)), own, copy, F.col(key)).withColumn(name, F.coalesce(name, none)).drop(copy)

    def look(t: str | None, given: Any) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float]]]:
        spans = base_spans(t)
        if not t:
            return spans, []
        shares = shared.value.shares(named(t, spans) if spans else []) if shared is not None else {x["term"]: x["share"] for x in given}
        return spans, _disclosed(t, spans, shares)

    return source, name, look


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, kinds, starts, ends of the base spans, and disclosed: array of (start, end, share) of the added terms.

    One row per row of ``docs``.
    """
    source, name, look = _marked(docs.select(carried(key).alias("_id"), F.col(text).alias("_text")), "_id", "_text", disclosure, support, limit)
    schema = "doc_id string, kinds array<int>, starts array<int>, ends array<int>, disclosed array<struct<start:int,end:int,share:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, own in zip(b["_text"], b[name], strict=True):
                spans, more = look(t, own)
                rows.append(([KINDS.index(s[0]) for s in spans], [s[1] for s in spans], [s[2] for s in spans], [{"start": x, "end": y, "share": v} for x, y, v in more]))
            out = pd.DataFrame(rows, columns=["kinds", "starts", "ends", "disclosed"])
            out.insert(0, "doc_id", b["_id"])
            yield out

    return restored(source.mapInPandas(run, schema), "doc_id")


def _cover(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced; where spans overlap, the earlier and longer one covers all."""
    out, at = [], 0
    for start, end, new in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with personal data replaced by ``<email>`` and so on; disclosing terms become ``<term>``, or go when they disclose all.

    All rows and columns stay. Only texts with a span are rewritten; a column n_chars then follows them.
    """
    source, name, look = _marked(docs, key, text, disclosure, support, limit)

    @F.pandas_udf("string")
    def covered(texts: pd.Series, owns: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, owns, strict=True):
            spans, more = look(t, own)
            cuts = [(a, b, f"<{kind}>") for kind, a, b in spans] + [(a, b, "" if v >= 1 - 1e-9 else "<term>") for a, b, v in more]
            out.append(_cover(t, cuts) if cuts else None)
        return pd.Series(out, dtype=object)

    new = fresh(source, stem="new")
    out = source.withColumn(new, covered(F.col(text), F.col(name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)))
    return out.withColumn(text, F.coalesce(new, F.col(text))).select(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """The contract's columns from ``personal_data``: counts, digest of the base spans, all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    base = F.array_join(F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", F.get(names, s["kinds"]), s["starts"], s["ends"])), ",")
    terms = F.array_join(F.transform("disclosed", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])), ",")
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit("")))
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
