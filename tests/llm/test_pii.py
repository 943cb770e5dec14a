import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import DOCS, awkward, clashing
from vellumine.llm import pii


def plain(text):
    """The contract's patterns, one by one."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+_%0123456789 ()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_fixed():
    for text in ("a@b.c.d@e.f", "x 4111 1111 1111 1111.", "1.2.3.4.5.6.7.8 300.1.1.1", "+1 (555) 123-4567, ++1 22", "a@b@c.de", None, ""):
        assert pii.base_spans(text) == (plain(text) if text else [])
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_disclosing_terms(spark):
    rows = [(i, f"word{i} call zorblax at 10.0.0.7 soon filler{i} more{i}", "en", "s", 1) for i in range(6)]
    rows += [(100 + i, f"plain soon text call number {i} words{i}", "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    found = pii.report(pii.personal_data(docs)).collect()
    told = [r for r in found if r["doc_id"] < 100]
    assert all(r["n_ip"] == 1 and "term:" in r["spans"] for r in told)
    assert all(r["spans"] == "" for r in found if r["doc_id"] >= 100)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zorblax" not in clean[0] and "10.0.0.7" not in clean[0] and "call" in clean[0]
    assert clean[150] == rows[6 + 50][1]


def brute_force(texts):
    """(entity, term) -> share over distinct texts, by the definition."""
    held = {t: {e for k, a, b in plain(t) for e in pii.entities(k, t[a:b])} for t in set(texts)}
    words = {}
    for t, _ in held.items():
        masked = list(t)
        for _, a, b in plain(t):
            masked[a:b] = " " * (b - a)
        words[t] = set(re.findall(r"[^\W\d_]{2,}", "".join(masked).lower()))
    n = len(held)
    out = {}
    for e in {e for es in held.values() for e in es}:
        of = [t for t in held if e in held[t]]
        for w in {w for t in of for w in words[t]}:
            both = sum(w in words[t] for t in of)
            df = sum(w in set(re.findall(r"[^\W\d_]{2,}", t.lower())) for t in held)
            share = math.log(both * n / (max(df, both) * len(of))) / max(math.log(n / len(of)), 1e-9)
            if both >= pii.SUPPORT and share >= pii.DISCLOSURE - 1e-12:
                out[e, w] = share
    return out


def crowd(spark):
    r = random.Random(3)
    values = ["ann@mail1.example.com", "bob@mail1.example.com", "cy@mail2.example.org", "10.0.0.7", "10.0.0.9", "192.168.1.5", "+1 (555) 123-4567"]
    rows = []
    for i in range(240):
        text = " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[r.randrange(26)]}{'aeiou'[r.randrange(5)]}" for _ in range(r.randrange(12)))
        if i % 4 == 0:
            v = values[r.randrange(len(values))]
            text = f"{text} near{chr(97 + values.index(v))} {v} both{'m' if '@' in v else 'n'}"
        rows.append((i, text if i % 9 else text + " nearb", "en", "s", 1))
    return rows + [(1000 + k, t, *rest) for k, (_, t, *rest) in enumerate(rows[:40])]


def test_shares_by_brute_force(spark):
    rows = crowd(spark)
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing_terms(docs).collect()}
    want = brute_force([t for _, t, *_ in rows if t])
    assert got.keys() == want.keys() and len({e[0] for e, _ in got}) == 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_shuffled_terms_equal_broadcast_ones(spark):
    docs = spark.createDataFrame(crowd(spark), DOCS)
    a, b = (sorted((r["doc_id"], r["spans"]) for r in pii.report(pii.personal_data(docs, limit=x)).collect()) for x in (1 << 26, 0))
    assert a == b and sum("term:" in s for _, s in a) > 20
    a, b = (sorted((r["doc_id"], r["text"]) for r in pii.sanitise(docs, limit=x).collect()) for x in (1 << 26, 0))
    assert a == b


def test_term_without_the_value(spark):
    rows = [(i, f"{c} about zorblax and 10.0.0.7 here", "en", "s", 1) for i, c in enumerate(("one", "two", "six", "ten"))]
    rows += [(50, "news of zorblax again", "en", "s", 1)] + [(100 + i, f"about text here and w{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "s", 1) for i in range(150)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, DOCS)).collect()}
    assert clean[50] == "news of <term> again" and clean[0].startswith("one about <term> and <ip>") and clean[101] == rows[6][1]


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "call zorblax at 10.0.0.7 soon", "en", "s", 1) for i in range(9)], DOCS)
    assert {r["spans"] for r in pii.report(pii.personal_data(docs)).collect()} == {"ip:16:24"}


def test_awkward_rows(spark):
    rows = pii.report(pii.personal_data(clashing(spark))).collect()
    assert len(rows) == 10
    assert [r["n_email"] for r in rows if r["doc_id"] == 7] == [1]
    out = pii.sanitise(clashing(spark))
    assert out.count() == 10 and out.columns == clashing(spark).columns
    seven = out.where("doc_id = 7").first()
    assert seven["text"] == "write to <email> or <phone> now" and seven["n_chars"] == len(seven["text"])
    assert pii.report(pii.personal_data(awkward(spark).limit(0))).count() == 0
