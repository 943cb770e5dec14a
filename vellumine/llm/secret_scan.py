"""Secrets: patterns propose, a random forest takes false positives away.

Candidates are values given to a name such as ``token`` or ``password``, values of known
shapes, and long runs of key characters that hold digits. The forest judges each by its
length, its character transitions, how far dictionary words cover it, whether it stands
in a path or URL, and the words beside it. The dictionary is counted over the whole
corpus: words in at least ``COMMON`` of the texts, which bounds their number by the mean
text's distinct words over ``COMMON``.

The forest is trained from labelled findings (left, candidate, right, label). Unless the
caller gives some, ``findings`` draws ``FINDINGS`` of them: keys, tokens and passwords
as they are written in code and notes, and the digests, identifiers, numbers, paths,
placeholders and words that scanners confuse with them.

Cases: null and empty texts have no candidates. Null ids are kept. Overlapping
candidates count once: announced and shaped ones before runs, the longest of those that start first. Repeated rows give repeated
findings. Empty tables give empty results. Extra columns are left out.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import carried, restored

#: Share of the texts in which a dictionary word stands.
COMMON = 0.001
#: Labelled findings that are drawn; trees, their depth, features tried at a node, rows at a leaf.
FINDINGS = 6_000
TREES, DEPTH, TRIED, LEAF = 40, 9, 5, 4
THRESHOLD = 0.5
#: Characters of a value at least.
LEAST = 6
#: Characters on either side that are looked at.
CONTEXT = 48

# Words that announce a secret, and shapes of well-known keys.
ANNOUNCE = "api_key apikey api-key access_key accesskey secret_key secret token access_token auth_token password passwd pwd passphrase credential credentials private_key client_secret bearer auth authorization".split()
SHAPES = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"sk_(?:live|test)_[0-9A-Za-z]{16,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
_GIVEN = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(ANNOUNCE, key=len, reverse=True))) + r")(?![a-z0-9])[\"']?\s{0,3}(?:[:=]+>?|\bis\b|\s)\s{0,3}[\"']?([^\s\"'`<>,;()]{6,})")
_SHAPE = re.compile("|".join(SHAPES))
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_NAMED = re.compile(r"[A-Za-z_-]+=+(?=[^=])")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_KIND = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}
_HEX = frozenset(string.hexdigits)
_ANNOUNCING = frozenset(w for a in ANNOUNCE for w in re.split("[_-]", a)) | {"key"}
# Words that say that a value is something else.
_OTHERWISE = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision blob uuid guid etag id version isbn doi order invoice example sample dummy test placeholder image data url href src".split())


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points, in order, none overlapping.

    Values that are announced or have a known shape come first; a run of key characters
    counts where none of these stands, from behind a name that is given with ``=`` in it.
    """
    if not text:
        return []
    out: list[tuple[int, int]] = []
    for start, end in sorted([m.span(1) for m in _GIVEN.finditer(text)] + [m.span() for m in _SHAPE.finditer(text)], key=lambda s: (s[0], -s[1])):
        end = _trimmed(text, start, end)
        if end - start >= LEAST and (not out or start >= out[-1][1]):
            out.append((start, end))
    taken, k = list(out), 0
    for m in _RUN.finditer(text):
        start, end = m.start() + (n.end() if (n := _NAMED.match(m[0])) else 0), m.end()
        end = _trimmed(text, start, end)
        value = text[start:end]
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if len(value) >= LEAST and (k == len(taken) or end <= taken[k][0]) and _DIGIT.search(value) and _LETTER.search(value):
            out.append((start, end))
    return sorted(out)


def _trimmed(text: str, start: int, end: int) -> int:
    while end > start and text[end - 1] in ".!?:*#$%&|":
        end -= 1
    return end


FEATURES = ("length", "entropy", "changes", "digits", "upper", "hexadecimal", "kinds", "vowels", "longest_repeat", "covered", "slashes", "dots", "dashes", "in_path", "quoted", "assigned", "announced", "otherwise", "shaped")


def features(left: str, value: str, right: str, dictionary: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = [_KIND.get(c, 3) for c in value]
    counts = Counter(value)
    low, changes = value.lower(), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    covered = sum(len(w) for w in _WORD.findall(low) if w in dictionary)
    repeat = max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=0)
    before = re.split(r"[\W_]+", left.lower())[-5:]
    after = re.split(r"[\W_]+", right.lower())[:3]
    around = [w for w in before + after if w]
    return [
        math.log(n),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        changes / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        float(all(c in _HEX for c in value)),
        float(len(set(kinds))),
        sum(low.count(v) for v in "aeiou") / n,
        repeat / n,
        covered / n,
        value.count("/") / n,
        value.count(".") / n,
        value.count("-") / n,
        float(bool(re.search(r"(?:[\w.-]/|://|[?&][\w-]+=)\S*$", left))),
        float(left[-1:] in "\"'" and left != ""),
        float(bool(re.search(r"[:=]\s*[\"']?$", left))),
        float(sum(w in _ANNOUNCING for w in around)),
        float(sum(w in _OTHERWISE for w in around)),
        float(bool(_SHAPE.fullmatch(value))),
    ]


def findings(dictionary: frozenset[str], n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, candidate, right, label), half of them secrets."""
    r = random.Random(seed)
    words = sorted(w for w in dictionary if len(w) < 12) or ["alpha", "beta", "gamma"]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    alnum, hexes, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"

    def secret() -> tuple[str, str]:
        value = r.choice(
            [
                lambda: chars(hexes, r.choice((32, 40, 64))),
                lambda: chars(alnum, r.randint(16, 48)),
                lambda: chars(b64, r.choice((24, 40, 44))) + r.choice(("", "=")),
                lambda: chars(alnum + "!@%^*-_", r.randint(8, 20)),
                lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + chars(alnum, 36),
                lambda: "sk_live_" + chars(alnum, 24),
            ]
        )()
        name = r.choice(ANNOUNCE)
        quote = r.choice(('"', "'", ""))
        written = f"{name}{r.choice((' = ', '=', ': ', ' '))}{quote}"
        if r.random() < 0.15:
            written, value = written.upper(), value.upper()
        return f"{some(3)} {written}", value

    def other() -> tuple[str, str]:
        kind = r.randrange(9)
        if kind == 0:
            return f"{some(2)} {r.choice(('sha256', 'md5', 'commit', 'checksum', 'etag'))}: ", chars(hexes, r.choice((32, 40, 64)))
        if kind == 1:
            u = chars(hexes, 32)
            return f"{some(2)} {r.choice(('id', 'uuid', 'guid'))}=", "-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:]))
        if kind == 2:
            return f"{some(3)} https://{r.choice(words)}.example.com/", f"{r.choice(words)}/{chars(string.digits, 6)}/{r.choice(words)}-{r.choice(words)}"
        if kind == 3:
            return f"{r.choice(ANNOUNCE)} = \"", r.choice(("your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme", "<password>", "REPLACE_WITH_TOKEN", "********", "${SECRET_KEY}", "example-token-123"))
        if kind == 4:
            return f"the {r.choice(ANNOUNCE)} ", r.choice(words) + r.choice(words)
        if kind == 5:
            return f"{some(3)} data:image/png;base64,", chars(b64, 60)
        if kind == 6:
            return f"{some(3)} ", chars(string.digits, 4) + r.choice(words) + chars(string.digits, 12)
        if kind == 7:
            return f"{some(3)} ", f"{r.choice(words)}_{r.choice(words)}_{r.choice(words)}_{r.randint(0, 99)}"
        return f"{some(2)} {r.choice(ANNOUNCE)} {some(1)} ", r.choice(words) + "-" + r.choice(words) + str(r.randint(1, 9))

    return [(*(secret() if i % 2 else other()), r.choice(('"', "'", "")) + " " + some(2), i % 2) for i in range(n)]


def grow(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[list[tuple]]:
    """A forest: each tree is a list of (feature, cut, left, right) or (-1, share of secrets)."""
    rng = np.random.default_rng(seed)

    def build(rows: np.ndarray, depth: int, tree: list[tuple]) -> int:
        at = len(tree)
        tree.append(())
        share = y[rows].mean()
        best = None
        if depth < DEPTH and len(rows) >= 2 * LEAF and 0 < share < 1:
            for f in rng.choice(x.shape[1], TRIED, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, ones = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(rows))
                left, right = ones[:-1], ones[-1] - ones[:-1]
                gini = 2 * left * (1 - left / n) + 2 * right * (1 - right / (len(rows) - n))
                gini[(v[1:] <= v[:-1]) | (n < LEAF) | (len(rows) - n < LEAF)] = np.inf
                k = int(gini.argmin())
                if np.isfinite(gini[k]) and (best is None or gini[k] < best[0]):
                    best = (gini[k], f, (v[k] + v[k + 1]) / 2)
        if best is None:
            tree[at] = (-1, float(share))
            return at
        below = x[rows, best[1]] <= best[2]
        a = build(rows[below], depth + 1, tree)
        b = build(rows[~below], depth + 1, tree)
        tree[at] = (int(best[1]), float(best[2]), a, b)
        return at

    forest = []
    for _ in range(TREES):
        tree: list[tuple] = []
        build(rng.integers(0, len(x), len(x)), 0, tree)
        forest.append(tree)
    return forest


def vote(forest: list[list[tuple]], row: list[float]) -> float:
    total = 0.0
    for tree in forest:
        node = tree[0]
        while node[0] >= 0:
            node = tree[node[2] if row[node[0]] <= node[1] else node[3]]
        total += node[1]
    return total / len(forest)


def dictionary_of(docs: DataFrame, *, text: str = "text", common: float = COMMON) -> frozenset[str]:
    """Lower-cased words of at least three letters that stand in at least ``common`` of the texts."""
    n = docs.where(F.col(text) != "").count()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]{3,})"), 1))).alias("word"))
    common_words = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(2.0, n * common)).select("word")
    return frozenset(common_words.toArrow()["word"].to_pylist())


def train(given: list[tuple[str, str, str, int]], dictionary: frozenset[str]) -> list[list[tuple]]:
    x = np.array([features(a, b, c, dictionary) for a, b, c, _ in given])
    return grow(x, np.array([label for *_, label in given], float))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, score, secret (whether the forest keeps the candidate): one row per candidate.

    ``labelled`` may give findings (left, candidate, right, label); those with the ``FINDINGS`` smallest hashes are used.
    """
    dictionary = dictionary_of(docs, text=text)
    given = findings(dictionary) if labelled is None else [tuple(r) for r in labelled.select("left", "candidate", "right", "label").orderBy(F.xxhash64("left", "candidate", "right", "label"), "left", "candidate", "right").limit(FINDINGS).collect()]
    model: dict[str, Any] = {"words": dictionary, "forest": train(given, dictionary)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, forest = shared.value["words"], shared.value["forest"]
        for b in batches:
            rows = []
            for i, t in zip(b["_id"], b["_text"], strict=True):
                for start, end in candidates(t):
                    score = vote(forest, features(t[max(0, start - CONTEXT) : start], t[start:end], t[end : end + CONTEXT], words))
                    rows.append((i, start, end, score, score >= threshold))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score", "secret"])

    found = docs.select(carried(key).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, "doc_id string, start int, end int, score double, secret boolean")
    return restored(found, "doc_id")


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` with each span replaced by ``<secret>``."""
    if text is None:
        return None
    for start, end in sorted(spans, reverse=True):
        text = f"{text[:start]}<secret>{text[end:]}"
    return text
