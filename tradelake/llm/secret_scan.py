"""Secret scan over a trigram inverted index; DataFrame functions only.

Each rule is a regular expression.  From its parse tree follows a Boolean query of lower-case
trigrams that every matching text holds.  The index lists, for each trigram that some query names,
the documents that hold it.  The postings of a document meet in one bit mask (the intersection);
rules whose query the mask satisfies are verified on the text with their regular expression.  A rule
without a mandatory trigram (``hex``) scans every text.

Matches are leftmost, non-overlapping, kind by kind; a match that fails its rule's length test
is dropped.  Offsets are code points, end exclusive, and come from the lengths of the pieces
between matches.

Defined results: null and empty texts have no spans; equal rows get equal results; empty tables
give no rows; a text with very many matches is spread over rows before its offsets are summed;
only id and text are read.
"""

from __future__ import annotations

import re._parser as regex_tree  # the parse tree of the standard library's patterns
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

MASK_BITS = 62


@dataclass(frozen=True)
class Rule:
    """``group``: the part of a match whose length must reach ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds in order; assign, access and hex are the base kinds, the others are added.
# [0-9a-f]+ of 24 and more is the same as {24,}, as runs of the class are taken whole.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s/:@]+:[^\s/:@]+@"),  # only the scheme needs a bound for linear time
]
BASE = ("assign", "access", "hex")

# --- Boolean trigram queries: True, a trigram, ("and", parts) or ("or", parts)

Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings_query(strings: set[str]) -> Query:
    """One of the strings occurs: all trigrams of one of them."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _alternatives(op, arg, limit: int) -> set[str] | None:
    """The strings an item stands for, lower-cased, if they are few."""
    if op is regex_tree.LITERAL:
        return {chr(arg).lower()}
    if op is regex_tree.IN:
        out = set()
        for kind, value in arg:
            if kind is regex_tree.LITERAL:
                out.add(chr(value).lower())
            elif kind is regex_tree.RANGE and value[1] - value[0] < limit:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= limit else None
    if op is regex_tree.SUBPATTERN:
        return _sequence(arg[3], limit)[0]
    if op is regex_tree.BRANCH:
        parts = [_sequence(b, limit)[0] for b in arg[1]]
        return None if None in parts or len(out := set().union(*parts)) > limit else out
    if op in (regex_tree.MAX_REPEAT, regex_tree.MIN_REPEAT) and arg[:2] == (0, 1):
        inner = _sequence(arg[2], limit)[0]
        return None if inner is None or len(inner) >= limit else inner | {""}
    return None


def _sequence(items, limit: int) -> tuple[set[str] | None, Query]:
    """(all strings of the sequence if few, query of the sequence)."""
    run, whole, found = {""}, True, []
    for op, arg in items:
        options = _alternatives(op, arg, limit)
        if options is not None and len(run) * len(options) <= limit:
            run = {a + b for a in run for b in options}
            continue
        found.append(_strings_query(run))
        whole = False
        run = options if options is not None else {""}
        if options is None:
            if op is regex_tree.SUBPATTERN:
                found.append(_sequence(arg[3], limit)[1])
            elif op is regex_tree.BRANCH:
                found.append(_any([_sequence(b, limit)[1] for b in arg[1]]))
            elif op in (regex_tree.MAX_REPEAT, regex_tree.MIN_REPEAT) and arg[0] > 0:
                found.append(_sequence(arg[2], limit)[1])
    found.append(_strings_query(run))
    return (run if whole else None), _all(found)


def trigram_query(pattern: str, limit: int = 16) -> Query:
    """Query that the lower-cased text of every match satisfies; True if no trigram is mandatory."""
    return _sequence(regex_tree.parse(pattern), limit)[1]


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*(trigrams(p) for p in query[1]))


# --- the index and the scan

#: 128 bits that name a row's id and text.
ROW = ["row_key", "row_check"]


def _row(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("row_key"), F.xxhash64(F.lit(1), id_col, text_col).alias("row_check")]


def _masks(names: list[str]) -> dict[str, tuple[int, int]]:
    return {t: (i // MASK_BITS, 1 << (i % MASK_BITS)) for i, t in enumerate(names)}


def _satisfied(query: Query, masks: dict) -> Column:
    if isinstance(query, str):
        word, bit = masks[query]
        return F.col(f"m{word}").bitwiseAND(bit) != 0
    out = None
    for part in query[1]:
        c = _satisfied(part, masks)
        out = c if out is None else out & c if query[0] == "and" else out | c
    return out


def build_index(texts: DataFrame, names: list[str]) -> DataFrame:
    """Postings: trigram, row, written.  ``texts``: row, text.  The outer transform lower-cases a text
    once for all trigrams."""
    wanted = F.array(*[F.lit(t) for t in names])
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return pinned(texts.select(*ROW, F.explode(F.get(held, F.lit(0))).alias("trigram")), "trigram-postings")


def candidates(postings: DataFrame, rules: list[Rule], queries: dict[str, Query], names: list[str]) -> DataFrame:
    """row, kinds: the rules whose query the document's postings satisfy."""
    masks = _masks(names)
    bits = F.create_map(*[x for t, (_, b) in masks.items() for x in (F.lit(t), F.lit(b))])[F.col("trigram")]
    words = F.create_map(*[x for t, (w, _) in masks.items() for x in (F.lit(t), F.lit(w))])[F.col("trigram")]
    bit = postings.select(*ROW, bits.alias("bit"), words.alias("word"))
    n = 1 + max(w for w, _ in masks.values())
    held = bit.groupBy(*ROW).agg(
        *[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(n)]
    )
    kinds = F.array_compact(
        F.array(*[F.when(_satisfied(queries[r.kind], masks), F.lit(r.kind)) for r in rules if queries[r.kind] is not True])
    )
    return pinned(held.select(*ROW, kinds.alias("kinds")).where("size(kinds) > 0"), "secret-candidates")


def _pieces(rule: Rule) -> Column:
    """The text between matches, the matches and the tested group, in order."""
    text, p = F.col("text"), F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    tested = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    return F.transform(
        F.arrays_zip(between.alias("between"), whole.alias("whole"), tested.alias("tested")),
        lambda x: F.struct(
            F.length(x["between"]).cast("long").alias("before"),
            F.length(x["whole"]).cast("long").alias("size"),
            (F.length(x["tested"]) >= rule.least).alias("good"),
        ),
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """row_key and row_check (of id and text), kind, start, end of every secret."""
    rules = RULES if rules is None else rules
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    names = sorted(set().union(*(trigrams(q) for q in queries.values())))
    texts = docs.select(*_row(id_col, text_col), F.col(text_col).alias("text"))
    texts = texts.where("text <> ''")
    if names:
        found = candidates(build_index(texts, names), rules, queries, names)
        texts = texts.join(found, ROW, "left")
    else:
        texts = texts.withColumn("kinds", F.array().cast("array<string>"))
    parts = []
    for r in rules:
        asked = F.col("text").rlike(r.pattern) if queries[r.kind] is True else F.array_contains("kinds", r.kind)
        parts.append(F.when(asked, F.struct(F.lit(r.kind).alias("kind"), _pieces(r).alias("pieces"))))
    hit = texts.select(*ROW, F.explode(F.array_compact(F.array(*parts))).alias("r"))
    rows = hit.select(*ROW, "r.kind", F.posexplode("r.pieces").alias("i", "p")).select(*ROW, "kind", "i", "p.*")
    rows = rows.dropDuplicates([*ROW, "kind", "i"])
    upto = Window.partitionBy(*ROW, "kind").orderBy("i")  # one text's matches of one kind
    end = F.sum(F.col("before") + F.coalesce("size", F.lit(0))).over(upto)
    spans = rows.withColumn("end", end).where("size is not null and good")
    return spans.select(*ROW, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [r.kind for r in RULES]
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    spans = secret_spans(docs).withColumn(
        "s", F.struct("start", order.alias("at"), F.concat_ws(":", "kind", "start", "end").alias("name"))
    )
    base = F.col("kind").isin(*BASE)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["name"]), ",")
    per_text = spans.groupBy(*ROW).agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in BASE],
        joined(F.when(base, F.col("s"))).alias("base"),
        joined(F.col("s")).alias("spans"),
    )
    d = docs.select("doc_id", *_row("doc_id", "text")).join(per_text, ROW, "left")
    return d.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def oracle_sql() -> str:
    """Every rule on every text, without index; offsets from the pieces between matches."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ones = [
        f"SELECT doc_id, {i} AS kind_no, {q(r.kind)} AS kind, string_split_regex(t, {q(r.pattern)}) AS b, "
        f"regexp_extract_all(t, {q(r.pattern)}, 0) AS w, regexp_extract_all(t, {q(r.pattern)}, {r.group}) AS g, {r.least} AS least FROM d"
        for i, r in enumerate(RULES)
    ]
    union = "\nUNION ALL ".join(ones)
    base = ", ".join(q(k) for k in BASE)
    counts = ", ".join(f"count(CASE WHEN kind = {q(k)} THEN 1 END) AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({union}),
n AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM m WHERE len(w) > 0),
s AS (SELECT doc_id, kind_no, kind, length(g[i]) AS tested, least, length(w[i]) AS size,
             list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS start
      FROM n),
k AS (SELECT doc_id, kind_no, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT) AS name FROM s WHERE tested >= least)
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg(CASE WHEN kind IN ({base}) THEN name END, ',' ORDER BY start, kind_no), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY start, kind_no), '') AS spans
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
