r"""Secret scans by a trigram inverted index. DataFrame functions only.

Each rule's expression is turned into a Boolean query over trigrams that every
match must hold. The index has a row (trigram, document) for each trigram that
some rule asks for; a conjunction's postings are intersected by document, the
conjunctions of a rule are united, and only the candidates are searched with
the expression. A rule without mandatory trigrams searches every text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small

LIMIT = 64  # strings that a part of an expression may stand for


@dataclass(frozen=True)
class Rule:
    """kind; an expression for Java and RE2; the group that holds the secret, and its least length in characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds. The hex run is greedy, so a least length may stand in the expression.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + MORE


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(clauses: set[frozenset[str]]) -> list[frozenset[str]] | None:
    """Without clauses that another implies; None if one is empty, as it asks for nothing."""
    return None if frozenset() in clauses else sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams, one of which every text with a match holds; None: any text may match."""
    parser = re._parser
    needs: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        if found := _least({_grams(s) for s in strings}):
            needs.append(found)

    def strings_of(items) -> tuple[set[str], bool]:
        """The strings that may end what was read since the last unbounded part, and whether they are all of it."""
        here, whole = {""}, True
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more, fixed = {chr(arg).lower()}, True
            elif name == "IN" and str(arg[0][0]) != "NEGATE" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
                chars = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if str(o) == "RANGE" else [a])}
                more, fixed = (chars, True) if len(chars) <= 6 else (None, False)
            elif name == "SUBPATTERN":
                more, fixed = strings_of(arg[-1])
            elif name == "BRANCH":
                parts = [strings_of(x) for x in arg[1]]
                more, fixed = (set().union(*(p for p, _ in parts)), True) if all(f for _, f in parts) else (None, False)
            elif name == "MAX_REPEAT" and arg[:2] == (0, 1):
                more, fixed = strings_of(arg[2])
                more = more | {""} if fixed else None
            else:
                more, fixed = None, False
            if not fixed or more is None or len(here) * len(more) > LIMIT:
                flush(here)
                here, whole = {""}, False
                if fixed and more is not None and len(more) <= LIMIT:
                    here = more
            else:
                here = {a + b for a, b in product(here, more)}
        return here, whole

    last, _ = strings_of(parser.parse(pattern))
    flush(last)
    if not needs:
        return None
    best = [reduce(frozenset.union, c) for c in product(*needs)] if len(needs) > 1 and reduce(lambda n, x: n * len(x), needs, 1) <= LIMIT else max(needs, key=lambda x: min(map(len, x)))
    return _least(set(best))


def index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """Postings (doc_id, gram): which of the trigrams stand in the lower-cased text."""
    low = docs.select(F.col("doc_id").alias("doc_id"), F.lower("text").alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(there).alias("gram"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the kinds of which one conjunction is complete. One row per trigram of the rules is broadcast; their number is fixed with the rules."""
    rows = [(kind, n, g, 1 << i, (1 << len(c)) - 1) for kind, clauses in queries.items() for n, c in enumerate(clauses) for i, g in enumerate(sorted(c))]
    wanted = postings.sparkSession.createDataFrame(rows, "kind string, clause int, gram string, bit long, complete long")
    met = postings.join(F.broadcast(wanted), "gram").groupBy("doc_id", "kind", "clause", "complete").agg(F.bit_or("bit").alias("bits")).filter("bits = complete")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(rule: Rule, at: int, text: str = "text") -> str:
    """SQL: array of struct(start, at, end, kind) of the leftmost non-overlapping matches that are long enough, by code point.

    The text is split at the matches; each start is the length of what stands before.
    """
    p = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    kind = "struct<start: bigint, at: int, end: bigint, kind: string>"
    one = f"named_struct('start', acc.pos + char_length(m.g), 'at', {at}, 'end', acc.pos + char_length(m.g) + char_length(m.m), 'kind', '{rule.kind}')"
    step = f"named_struct('pos', acc.pos + char_length(m.g) + char_length(m.m), 'out', if(char_length(m.v) >= {rule.least}, concat(acc.out, array(cast({one} AS {kind}))), acc.out))"
    zero = f"named_struct('pos', 0L, 'out', cast(array() AS array<{kind}>))"
    state = f"struct<pos: bigint, out: array<{kind}>>"
    found = f"regexp_extract_all({text}, '{p}', 0)"
    value = found if rule.group == 0 else f"regexp_extract_all({text}, '{p}', {rule.group})"
    parts = f"arrays_zip({found} AS m, {value} AS v, slice(split({text}, '{p}', -1), 1, size({found})) AS g)".replace(" AS m", "").replace(" AS v", "").replace(" AS g", "")
    named = f"transform({parts}, z -> named_struct('m', z['0'], 'v', z['1'], 'g', z['2']))"
    return f"CASE WHEN rlike({text}, '{p}') THEN aggregate({named}, cast({zero} AS {state}), (acc, m) -> cast({step} AS {state}), acc -> acc.out) ELSE cast(array() AS array<{kind}>) END"


def _join(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. Equal or null ids share candidates, never spans: each row's own text
    is searched. Columns other than doc_id and text are ignored; an empty table gives no rows. Candidates are sent to the texts if
    they were counted to be few, else both are shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    found = saved(candidates(index(docs, grams), queries).withColumnRenamed("doc_id", "_id"), "candidates")
    rows = docs.join(small(found), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    empty = "cast(array() AS array<struct<start: bigint, at: int, end: bigint, kind: string>>)"
    each = {r.kind: F.expr(f"CASE WHEN array_contains(kinds, '{r.kind}') THEN {spans_of(r, i)} ELSE {empty} END" if r.kind in queries else spans_of(r, i)) for i, r in enumerate(rules)}
    rows = rows.select("doc_id", *[c.alias(f"s_{k}") for k, c in each.items()])
    base = [r.kind for r in rules if r.base]
    rows = rows.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in base], F.sort_array(F.concat(*[f"s_{k}" for k in base])).alias("b"), F.sort_array(F.concat(*[f"s_{k}" for k in each])).alias("a"))
    return rows.select("doc_id", *[f"n_{k}" for k in base], F.sha2(_join("b"), 256).alias("base_sha256"), _join("a").alias("spans"))


def oracle(rules: Sequence[Rule] = RULES) -> str:
    """The same spans by searching every text with every rule."""
    q = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(rules):
        p = q(r.pattern)
        ms, vs, gs = f"regexp_extract_all(text, '{p}')", f"regexp_extract_all(text, '{p}', {r.group})", f"string_split_regex(text, '{p}')"
        parts.append(f"SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, unnest(range(1, len({ms}) + 1)) AS k, {ms} AS ms, {vs} AS vs, {gs} AS gs FROM d")
    flat = "SELECT doc_id, rule, kind, k, len(vs[k]) AS n, list_sum(list_transform(gs[1:k], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: len(x))), 0)::BIGINT AS s, len(ms[k]) AS l FROM (" + " UNION ALL ".join(parts) + ")"
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    base = [(i, r) for i, r in enumerate(rules) if r.base]
    span = "string_agg(kind || ':' || s || ':' || (s + l), ',' ORDER BY s, rule)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({flat}), x AS (SELECT * FROM f WHERE n >= CASE rule {least} END),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE rule = {i}) AS n_{r.kind}" for i, r in base)}, {span} FILTER (WHERE rule IN ({", ".join(str(i) for i, _ in base)})) AS b, {span} AS a FROM x GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for _, r in base)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
