"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: of
the parsed expression, what every match must hold (`required`). Every Arrow batch of documents is one segment of the
index: the postings of the rules' trigrams are built from the segment's bytes,
the queries intersect and unite them, and only the candidates are verified with
the expression. A rule without a mandatory trigram scans every text. Segments
never leave their task, so nothing is shuffled and a lost executor costs its
own segments.

Defined results: a null text is an empty one, which holds no secret; matches of
one kind never overlap; a text of any length is scanned whole; rows are
independent, so ties, repeated rows and other columns change nothing.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, in_chunks, text_or_empty, tidied


@dataclass(frozen=True)
class Rule:
    """kind; expression; group whose length counts; least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base kinds of the contract, then public token formats.
RULES = (
    Rule("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


#: Alternatives that a query or a run of literals may have; beyond them it asks for less, and verification decides.
MOST = 64

#: Of a query: alternatives of trigrams that must all occur. None asks for nothing.
Query = list[frozenset[bytes]] | None


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None or len(a) + len(b) > MOST else list(dict.fromkeys(a + b))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return list(dict.fromkeys(x | y for x in a for y in b))


def _trigrams(strings: set[bytes]) -> Query:
    """Asks for the trigrams of one of the strings."""
    if any(len(x) < 3 for x in strings):
        return None
    return [frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in sorted(strings)]


def _characters(op, arg, flags: int) -> set[bytes] | None:
    """What a node of one character matches, A-Z lower-cased; None if that is much or not known."""
    if op is sre.LITERAL:
        points = [arg]
    elif op is sre.IN and all(o is sre.LITERAL or (o is sre.RANGE and x[1] - x[0] < 16) for o, x in arg):
        points = [c for o, x in arg for c in ([x] if o is sre.LITERAL else range(x[0], x[1] + 1))]
    else:
        return None
    found = {chr(c).encode("utf-8", "surrogatepass").lower() for c in points}
    if flags & re.IGNORECASE and not flags & re.ASCII:
        # Letters outside ASCII that fold to these: long s, Kelvin sign, dotted and dotless i.
        if any(c > 127 or chr(c).lower() in "ski" for c in points):
            return None
    return found if len(found) <= 8 else None


def required(nodes, flags: int) -> tuple[set[bytes] | None, Query]:
    """What a parsed expression matches, if that is a few strings; and the query that any text with a match satisfies."""
    query: Query = None
    exact: set[bytes] = {b""}  # what the last nodes match together
    finite = True

    def stop() -> None:
        nonlocal query, exact, finite
        query, exact, finite = _both(query, _trigrams(exact)), {b""}, False

    for op, arg in nodes:
        strings: set[bytes] | None = None
        inner: Query = None
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            strings = {b""}
        elif op in (sre.LITERAL, sre.IN):
            strings = _characters(op, arg, flags)
        elif op is sre.SUBPATTERN:
            _, add, drop, sub = arg
            strings, inner = required(sub, (flags | add) & ~drop)
        elif op is sre.ATOMIC_GROUP:
            strings, inner = required(arg, flags)
        elif op is sre.BRANCH:
            parts = [required(sub, flags) for sub in arg[1]]
            strings = set().union(*(x for x, _ in parts)) if all(x is not None for x, _ in parts) else None
            inner = parts[0][1]
            for _, q in parts[1:]:
                inner = _either(inner, q)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, sub = arg
            once, inner = required(sub, flags)
            if least == 0:
                inner = None
            if once is not None and most <= 1:
                strings = once | {b""} if least == 0 else once
            elif once is not None and least:
                for _ in range(min(least, 3)):
                    joint = {x + y for x in exact for y in once}
                    if len(joint) > MOST:
                        break
                    exact = joint
                else:
                    if least == most <= 3:
                        continue
        if strings is not None and len(strings) <= MOST:
            joint = {x + y for x in exact for y in strings}
            if len(joint) > MOST:
                stop()
                joint = strings
            exact = joint
        else:
            stop()
            query = _both(query, inner)
    if not finite:
        stop()
        return None, query
    return exact, _trigrams(exact)


def trigram_query(rule: Rule) -> list[list[bytes]] | None:
    """Alternatives of trigrams that must all occur, lower-cased, derived from the rule's expression; None if it has no mandatory trigram."""
    parsed = re._parser.parse(rule.pattern)
    query = required(parsed, parsed.state.flags)[1]
    return None if query is None else [sorted(x) for x in query]


class SegmentIndex:
    """Postings of the given trigrams over one list of texts (case of A-Z ignored)."""

    def __init__(self, texts: list[bytes], trigrams: list[bytes]):
        self.postings: dict[bytes, np.ndarray] = {t: np.zeros(0, np.int64) for t in trigrams}
        if not texts or not trigrams:
            return
        number = _trigram_numbers(tuple(trigrams))
        for lo, hi in in_chunks(texts):
            buf = np.frombuffer(b"\0\0".join(texts[lo:hi]).lower() + b"\0\0\0", np.uint8)
            begins = np.cumsum([0, *(len(t) + 2 for t in texts[lo : hi - 1])])
            code = (buf[:-2].astype(np.uint32) << np.uint32(16)) | (buf[1:-1].astype(np.uint32) << np.uint32(8)) | buf[2:]
            found = number[code]
            at = np.flatnonzero(found)
            doc = np.searchsorted(begins, at, "right") - 1 + lo
            for n, docs in _lists(np.unique(doc + (found[at].astype(np.int64) << 32))):
                self.postings[trigrams[n - 1]] = np.append(self.postings[trigrams[n - 1]], docs)

    def candidates(self, query: list[list[bytes]]) -> np.ndarray:
        hits: list[np.ndarray] = []
        for needed in query:
            lists = sorted((self.postings[t] for t in needed), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = both[np.isin(both, other, assume_unique=True)] if len(both) else both
            hits.append(both)
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)


def _lists(keys: np.ndarray):
    """Sorted keys (trigram number << 32 | text), a list of texts for each number."""
    edges = [0, *(np.flatnonzero(np.diff(keys >> 32)) + 1).tolist(), len(keys)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield int(keys[a] >> 32), keys[a:b] & 0xFFFFFFFF


@lru_cache(8)
def _trigram_numbers(trigrams: tuple[bytes, ...]) -> np.ndarray:
    number = np.zeros(1 << 24, np.min_scalar_type(len(trigrams)))
    for i, t in enumerate(trigrams):
        number[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1
    return number


def scan_segment(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its secrets as (start, rule number, end) in code points, sorted."""
    queries = [trigram_query(r) for r in rules]
    needed = sorted({t for q in queries if q for alternative in q for t in alternative})
    index = SegmentIndex([t.encode("utf-8", "surrogatepass") for t in texts], needed)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        expression = re.compile(rule.pattern)
        for i in range(len(texts)) if query is None else index.candidates(query):
            for m in expression.finditer(texts[i]):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for found in out:
        found.sort()
    return out


def _joined(found, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)


_SCAN_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    base = [k for k, r in enumerate(rules) if r.base]

    def run(batches):
        for batch in batches:
            found = scan_segment(batch.column(1).to_pylist(), rules)
            counts = {kind: [sum(rules[k].kind == kind for _, k, _ in f) for f in found] for kind in ("assign", "access", "hex")}
            digests = [hashlib.sha256(_joined([x for x in f if x[1] in base], rules).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in ("assign", "access", "hex")), pa.array(digests, pa.string()), pa.array([_joined(f, rules) for f in found], pa.string())],
                names=[f.name for f in _SCAN_SCHEMA],
            )

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(tidied(run), _SCAN_SCHEMA)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by [kind]; n_chars, if there, follows the text. A null text stays null."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = names.index("text")
            texts = batch.column(at).to_pylist()
            found = scan_segment([t or "" for t in texts], rules)
            new = []
            for text, spans in zip(texts, found, strict=True):
                parts, here = [], 0
                for a, k, b in spans:
                    if a >= here:
                        parts += [text[here:a], f"[{rules[k].kind}]"]
                    here = max(here, b)
                new.append(None if text is None else "".join([*parts, text[here:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.column(at).type)
            if "n_chars" in names:
                c = names.index("n_chars")
                columns[c] = pa.array([old if t is None or not f else len(t) for old, t, f in zip(columns[c].to_pylist(), new, found, strict=True)], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded_batches(docs).mapInArrow(tidied(run), docs.schema)
