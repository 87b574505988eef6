"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Leaves are sentences, cut after LEAF code points. A paragraph (line) hashes its leaves, a section its
paragraphs, the root its sections. A section ends where its content says so, at an empty line or after
a paragraph whose hash begins with 0 (one in sixteen), so an edit moves no border elsewhere.

The fingerprint is ``root/section:paragraph=leaf.leaf,paragraph=leaf.../section:...``: the root in full,
the rest shortened. Equal roots mean equal texts; otherwise only branches that differ hold edits.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wildtally.llm.tables import settings

LEAF = 64
# Hex digits that are shown of the hash of a leaf, paragraph or section.
SHORT = 8
# Rows of a range of ids, about, and ranges at most: their ends are all that the driver sees.
RANGE_ROWS, MAX_RANGES = 4_000, 40_000


def fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of the column ``text`` as ``name``; a null text counts as empty."""
    leaf = f"'[^.!?]{{0,{LEAF}}}[.!?]+[ ]*|[^.!?]{{1,{LEAF}}}'"
    rows = rows.withColumn("_leaves", F.expr(rf"transform(split(coalesce({text}, ''), '\\n', -1), p -> transform(regexp_extract_all(p, {leaf}, 0), s -> md5(s)))"))
    paragraph = f"concat(md5(concat_ws('', a)), IF(size(a) = 0, '-', ''), '=', concat_ws('.', transform(a, h -> left(h, {SHORT}))))"
    rows = rows.withColumn("_paragraphs", F.expr(f"transform(_leaves, a -> {paragraph})"))
    bordered = "concat_ws(',', transform(_paragraphs, q -> IF(left(q, 1) = '0' OR q LIKE '%-=', concat(q, '/'), q)))"
    rows = rows.withColumn("_sections", F.expr(f"transform(filter(split({bordered}, '/,?', -1), s -> s != ''), s -> concat(md5(s), ':', s))"))
    shown = f"regexp_replace(concat_ws('/', _sections), '([0-9a-f]{{{SHORT}}})[0-9a-f]{{{32 - SHORT}}}(-?[:=])', '$1$2')"
    root = "md5(concat_ws('', transform(_sections, s -> left(s, 32))))"
    return rows.withColumn(name, F.expr(f"concat({root}, '/', {shown})")).drop("_leaves", "_paragraphs", "_sections")


def likeness(a: str, b: str) -> Column:
    """Shared hashes of sections, paragraphs and leaves over all of two fingerprints, 0 to 1; 1 if the roots are equal."""
    parts = [f"array_distinct(split(substring({x}, 34), '[-/:,=.]+'))" for x in (a, b)]
    every, shared = f"size(array_union({parts[0]}, {parts[1]}))", f"size(array_intersect({parts[0]}, {parts[1]}))"
    return F.expr(f"IF(left({a}, 32) = left({b}, 32), 1.0D, CAST({shared} AS DOUBLE) / {every})")


def edited_sections(a: str, b: str) -> Column:
    """Positions, from 0, of the sections of fingerprint ``a`` that ``b`` does not have."""
    return F.expr(f"filter(transform(split(substring({a}, 34), '/'), (s, i) -> IF(array_contains(split(substring({b}, 34), '/'), s), NULL, i)), i -> i IS NOT NULL)")


def _band(place: str, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``place``, looked up in two steps."""
    step = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(place)))
    numbers = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    outer = below(numbers([g[-1] for g in groups]))
    return outer * step + below(F.element_at(F.array(*map(numbers, groups)), outer + 1))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint, next_text, next_fingerprint`` of every row: next in descending order of doc_id, after the last the first.

    No task sees the whole order. Ids are cut into ranges at some of their values and each range is
    sorted alone; the first row of a range also goes to the range above it, whose last row it follows.
    Rows without a doc_id come last; rows of one doc_id are in descending order of their texts. A null
    text counts as empty.
    """
    settings(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("doc_id", F.lit(-(2**63))))
    size = rows.agg(F.count("*").alias("n"), F.max("place").alias("top")).first()
    ranges = int(min(MAX_RANGES, max(1, size.n // RANGE_ROWS)))
    cuts = set() if size.top is None else {size.top}
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts |= set(rows.agg(F.percentile_approx("place", shares, 100_000).alias("cuts")).first().cuts)
    cuts = sorted(cuts)  # each occurs as a place, and is the highest of its range
    tops = rows.filter(F.col("place").isin(cuts)) if len(cuts) < 10 else rows.join(F.broadcast(docs.sparkSession.createDataFrame([(c,) for c in cuts], "place long")), "place")
    tops = tops.groupBy("place").agg(F.max("text").alias("text"))
    band = _band("place", cuts) if cuts else F.lit(0)
    above = F.pmod(band + 1, F.lit(max(1, len(cuts))))
    every = rows.select("doc_id", "text", "place", band.alias("band"), F.lit(0).alias("late")).unionByName(
        tops.select(F.lit(None).cast("long").alias("doc_id"), "text", "place", above.alias("band"), F.lit(1).alias("late"))
    )
    order = Window.partitionBy("band").orderBy("late", F.desc("place"), F.desc("text"))
    every = fingerprint(every, "text", "fingerprint")
    every = every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return every.filter("late = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edits(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) and its edited text: the last third replaced by the beginning of the next text.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; order and
    nulls as in ``with_next``. Texts under three code points are their own edit. An empty table gives no
    rows; other columns are not looked at.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.expr("CAST(n_chars DIV 3 AS INT)"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, CAST(n_chars AS INT) - third), left(next_text, third))"))
    rows = fingerprint(rows.drop("text", "next_text"), "edited", "edited_fingerprint")
    near = likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *near)


def _fingerprint_sql(text: str) -> str:
    leaf = f"'[^.!?]{{0,{LEAF}}}[.!?]+[ ]*|[^.!?]{{1,{LEAF}}}'"
    paragraph = f"concat(md5(array_to_string(a, '')), CASE WHEN len(a) = 0 THEN '-' ELSE '' END, '=', array_to_string(list_transform(a, lambda h: left(h, {SHORT})), '.'))"
    leaves = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, {leaf}), lambda s: md5(s)))"
    paragraphs = f"list_transform({leaves}, lambda a: {paragraph})"
    bordered = f"array_to_string(list_transform({paragraphs}, lambda q: CASE WHEN left(q, 1) = '0' OR q LIKE '%-=' THEN concat(q, '/') ELSE q END), ',')"
    sections = f"list_transform(list_filter(string_split_regex({bordered}, '/,?'), lambda s: s != ''), lambda s: concat(md5(s), ':', s))"
    return sections


def _shown_sql(sections: str) -> str:
    shown = f"regexp_replace(array_to_string({sections}, '/'), '([0-9a-f]{{{SHORT}}})[0-9a-f]{{{32 - SHORT}}}(-?[:=])', '\\1\\2', 'g')"
    return f"concat(md5(array_to_string(list_transform({sections}, lambda s: left(s, 32)), '')), '/', {shown})"


def _likeness_sql(a: str, b: str) -> str:
    parts = [f"list_distinct(string_split_regex(substring({x}, 34), '[-/:,=.]+'))" for x in (a, b)]
    every = f"len(list_distinct(list_concat({parts[0]}, {parts[1]})))"
    return f"CASE WHEN left({a}, 32) = left({b}, 32) THEN 1.0::DOUBLE ELSE len(list_intersect({parts[0]}, {parts[1]}))::DOUBLE / {every} END"


EDITS_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, {_fingerprint_sql("text")} AS sections FROM rows),
own AS (SELECT doc_id, text, {_shown_sql("sections")} AS fingerprint FROM cut),
after AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(fingerprint) OVER w, first_value(fingerprint) OVER w) AS next_fingerprint
    FROM own WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
made AS (SELECT *, concat(left(text, length(text) - length(text) // 3), left(next_text, length(text) // 3)) AS edited FROM after),
again AS (SELECT *, {_fingerprint_sql("edited")} AS sections FROM made),
both_ AS (SELECT *, {_shown_sql("sections")} AS edited_fingerprint FROM again)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
    {_likeness_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness_sql("fingerprint", "next_fingerprint")} AS near_next
FROM both_"""
