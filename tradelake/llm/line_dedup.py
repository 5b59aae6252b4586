"""Line deduplication within one edit, by deletion neighbourhoods; DataFrame functions only.

Lines are the newline-separated parts of all texts, trimmed.  A line is dropped if an equal line,
or (from ``near_chars`` characters on) a line within one character edit, occurs earlier in the
corpus order (doc_id, null last; then line number).

Copies fold into one line first, by a 128-bit hash.  Two lines within one edit then differ in one
place: of any string cut in two at a common offset from its start (or end), one half is equal.
So lines are narrowed by rounds of halving: a line stays only where another line has the same half
and the same context, and goes on with its other half, until at most ``leaf`` characters are
left.  Of these rests every variant with one character deleted is emitted as a hashed key (with
the position for substitutions), and equal keys are joined: the key of a rest itself meets the
deletions of rests one longer.  Each line is linked to the earliest line of its keys, never to all,
and the link is verified by the edit distance of the whole lines.

Defined results: null and empty texts have no lines; blank lines are always kept and not counted;
documents with equal id and equal text are one document and get equal rows; empty tables give no
rows; long lines only take more rounds; extra columns pass through ``deduplicated_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned

BLANK = " \t\r\n\x0b\x0c"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, line_no (from 0, blank lines numbered too), line; without blank lines."""
    parts = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.posexplode(parts).alias("line_no", "line"),
    )
    return d.where("line <> ''")


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _half_keys(context: Column, rest: Column, short: Column) -> Column:
    """For a rest that may meet rests of length ``short`` and ``short`` + 1: keys of its front
    half and of its back half, with what is left besides it."""
    h = F.floor(short / 2).cast("int")
    front = F.struct(
        F.xxhash64(context, F.lit("front"), short, F.left(rest, h)).alias("context"), F.substr(rest, h + 1).alias("rest")
    )
    back = F.struct(
        F.xxhash64(context, F.lit("back"), short, F.right(rest, h)).alias("context"),
        F.left(rest, F.length(rest) - h).alias("rest"),
    )
    return F.transform(
        F.array(front, back), lambda x: F.struct(x["context"].alias("context"), x["rest"].alias("rest"), (short - h).alias("short"))
    )


def _shared(states: DataFrame) -> DataFrame:
    """States whose context at least two lines have."""
    common = states.groupBy("context").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    return states.join(common.where("a <> b").select("context"), "context", "left_semi")


def _near(distinct: DataFrame, lines: DataFrame, leaf: int) -> DataFrame:
    """h1, h2 of every line that has an earlier line within one edit.  ``distinct`` has the half
    keys of all lines long enough; ``lines`` the texts."""
    first_keys = distinct.where("keys is not null").select("h1", "h2", F.explode("keys").alias("context"))
    alive = _shared(first_keys).select("h1", "h2").distinct()
    texts = lines.join(alive, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("h1", "h2", "line")
    texts = pinned(texts.join(distinct.select("h1", "h2", "pos"), ["h1", "h2"]), "near-lines")

    n = F.length("line")
    roles = F.explode(F.array(n, n - 1)).alias("short")  # with lines as long or longer, with shorter ones
    whole = texts.select("h1", "h2", "pos", F.lit(0).cast("long").alias("context"), F.col("line").alias("rest"), roles)
    states = whole
    longest = texts.agg(F.max(n)).first()[0] or 0
    while longest > leaf:
        halves = states.where(F.col("short") > leaf - 1)
        halves = halves.withColumn("half", F.explode(_half_keys(F.col("context"), F.col("rest"), F.col("short"))))
        halves = halves.select("h1", "h2", "pos", "half.context", "half.rest", "half.short")
        done = states.where(F.col("short") <= leaf - 1)
        states = pinned(_shared(halves).select(*done.columns).unionByName(done).distinct(), "near-halves")
        longest = states.agg(F.max(F.length("rest"))).first()[0] or 0

    rest, size = F.col("rest"), F.length("rest")
    cut = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.struct(i.alias("at"), F.concat(F.left(rest, i - 1), F.substr(rest, i + 1)).alias("left")),
    )
    longer = size > F.col("short")  # the longer of two: its deletions meet the shorter rest itself
    deletions = F.transform(
        F.when(size > 0, cut).otherwise(F.array().cast("array<struct<at:int,left:string>>")),
        lambda x: F.struct(
            F.xxhash64("context", "short", F.when(longer, F.lit(0)).otherwise(x["at"]), x["left"]).alias("key"),
            F.when(longer, F.lit("long")).otherwise(F.lit("same")).alias("role"),
        ),
    )
    self_key = F.struct(F.xxhash64("context", "short", F.lit(0), rest).alias("key"), F.lit("short").alias("role"))
    variants = F.when(longer, deletions).otherwise(F.concat(deletions, F.array(self_key)))
    keyed = states.select("h1", "h2", "pos", F.explode(F.array_distinct(variants)).alias("v")).select("h1", "h2", "pos", "v.*")
    ref = F.struct("pos", "h1", "h2")
    earliest = keyed.groupBy("key").agg(
        F.min(F.when(F.col("role") == "same", ref)).alias("same"),
        F.min(F.when(F.col("role") == "short", ref)).alias("short"),
        F.min(F.when(F.col("role") == "long", ref)).alias("long"),
        F.count(F.lit(1)).alias("n"),
    )
    partner = (
        F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "short", F.col("long")).otherwise(F.col("short"))
    )
    met = keyed.join(earliest.where("n > 1").drop("n"), "key").withColumn("other", partner)
    pairs = met.where(F.col("other.pos") < F.col("pos")).select(
        "h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")
    ).distinct()
    a = texts.select("h1", "h2", "line")
    b = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("earlier"))
    found = pairs.join(a, ["h1", "h2"]).join(b, ["o1", "o2"])
    found = found.where(F.levenshtein("line", "earlier", 1).between(0, 1))
    return found.select("h1", "h2").distinct()


def line_marks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = 20, leaf: int = 64
) -> DataFrame:
    """One row for each document: doc_id, row_key, n_lines, dropped (sorted numbers of its dropped
    lines), n_near (of these, not equal to an earlier line)."""
    lines = _hashed(_lines(docs, id_col, text_col))
    n = F.length("line")
    pos = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "line_no")
    keys = F.flatten(
        F.transform(
            F.array(n, n - 1),
            lambda m: F.transform(_half_keys(F.lit(0).cast("long"), F.col("line"), m), lambda x: x["context"]),
        )
    )
    occurrences = pinned(lines.select("doc_id", "row_key", "line_no", "h1", "h2", F.when(n >= near_chars, keys).alias("keys")), "lines")
    distinct = pinned(
        occurrences.groupBy("h1", "h2").agg(F.min(pos).alias("pos"), F.first("keys").alias("keys")), "distinct-lines"
    )
    near = pinned(_near(distinct, lines.where(n >= near_chars), leaf), "near-dropped")
    first = distinct.select("h1", "h2", "pos").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    marked = occurrences.drop("keys").join(first, ["h1", "h2"])
    repeat = ~F.col("pos").eqNullSafe(pos)
    marked = marked.select(
        "doc_id", "row_key", "line_no", repeat.alias("repeat"), (~repeat & F.col("near").isNotNull()).alias("near")
    )
    marked = marked.groupBy("doc_id", "row_key").agg(  # a document's own lines
        F.count_distinct("line_no").alias("n_lines"),
        F.array_sort(F.collect_set(F.when(F.col("repeat") | F.col("near"), F.col("line_no")))).alias("dropped"),
        F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias("n_near"),
    )
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
    marked = marked.withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    out = d.join(marked, (d["row_key"] == F.col("_key")) & d["doc_id"].eqNullSafe(F.col("_id")), "left")
    return out.select(
        "doc_id", "row_key", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, n_near, dropped (line numbers, comma-joined)."""
    m = line_marks(docs)
    return m.select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "n_near",
        F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"),
    )


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the dropped lines cut out of their texts."""
    m = line_marks(docs, id_col, text_col, **options).where("size(dropped) > 0")
    m = m.select(F.col("row_key").alias("_key"), F.col("doc_id").alias("_id"), "dropped").dropDuplicates(["_key", "_id"])
    m = m.withColumnRenamed("dropped", "_dropped")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_all")  # columns of any names
    d = docs.select(row, F.xxhash64(F.col(id_col), F.col(text_col)).alias("_row"))
    field = lambda c: F.col("_all").getField(c)
    d = d.join(m, (F.col("_row") == F.col("_key")) & field(id_col).eqNullSafe(F.col("_id")), "left")
    kept = F.filter(F.split(field(text_col), "\n"), lambda x, i: ~F.array_contains("_dropped", i))
    text = F.when(F.col("_dropped").isNull(), field(text_col)).otherwise(F.array_join(kept, "\n"))
    return d.select(*[(text if c == text_col else field(c)).alias(c) for c in docs.columns])


#: Independent statement of the result: first occurrences, and pairs of lines by their distance.
ORACLE_SQL = """
WITH parts AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
         trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM documents WHERE text IS NOT NULL),
lines AS (SELECT * FROM parts WHERE line <> ''),
firsts AS (SELECT line, min((doc_id, line_no)) AS pos, length(line) AS n FROM lines GROUP BY line),
near AS (
  SELECT DISTINCT a.line FROM firsts a JOIN firsts b
    ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.pos < a.pos
  WHERE a.n >= 20 AND b.n >= 20
    AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2)
         OR right(a.line, least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) // 2))
    AND levenshtein(a.line, b.line) <= 1),
marks AS (
  SELECT l.doc_id, l.line_no, (l.doc_id, l.line_no) <> f.pos AS again, n.line IS NOT NULL AS is_near
  FROM lines l JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line)
SELECT d.doc_id, count(m.line_no) AS n_lines,
       count(CASE WHEN again OR is_near THEN 1 END) AS n_dropped,
       count(CASE WHEN NOT again AND is_near THEN 1 END) AS n_near,
       coalesce(string_agg(CASE WHEN again OR is_near THEN CAST(m.line_no AS VARCHAR) END, ',' ORDER BY m.line_no), '') AS dropped
FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
