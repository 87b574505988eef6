"""Benchmark items in documents, verbatim or with other parameters.

Texts become templates: numbers, names and units give way to typed placeholders. Windows of template
tokens are hashed on both sides and joined. A matched window says which slot of the item stands against
which slot of the document; along one alignment the same item value must always meet the same document
value, so a re-parameterised item passes and a chance meeting of placeholders does not.

What an item's first word becomes in a document depends on the words before it there, so an item's first
window is searched for in all forms that it can take; a document's windows that begin with a capitalised
word at the start of a sentence are hashed with a name there as well. Items without a window of enough
literal words are searched for by their words.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wildtally.llm.tables import settings, written
from wildtally.operators.sizes import measured

# Tokens of a window, literal (not placeholder) ones that it needs, and windows that make a leak: 13
# tokens in a row, or the whole item if that is shorter.
WINDOW, LITERALS, NEEDED = 8, 4, 6
# Share of an alignment's slot values that have to be consistent.
CONSISTENT = 0.75
UNITS = (
    "kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mile miles ft feet foot inch inches yard yards l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent % dollar dollars usd euro euros eur cent cents pound pounds gbp degree degrees °c °f c f kb mb gb tb kmh mph km/h m/s"
)
PLACEHOLDERS = "('<num>', '<name>', '<unit>')"
# Words that begin a question or sentence: at an item's start they are no name that can be exchanged.
STARTERS = (
    "what which who whom whose when where why how if is are was were am be been do does did can could will would shall should may might must has have had "
    "the a an in on at for from of to and or but not no there this that these those here it its he his she her they their them we our us you your i my me "
    "given find calculate compute determine evaluate simplify name list explain describe complete choose select solve suppose let consider assume "
    "each every all some one two three most many after before during while because since as by with about under over between"
)
_EDGE = """.,;:!?"''()[]{}|$€£#*+-"""


def templates(rows: DataFrame, key: str) -> DataFrame:
    """``key``, the tokens ``raw`` of its text, and the template ``tmpl``, as long as ``raw``."""
    units = ", ".join(f"'{u}'" for u in UNITS.split())
    number = "({0} < ':' AND {0} >= '0')"  # begins with a digit, by the order of bytes
    rows = rows.select(key, F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), x -> x != '') AS raw"))
    rows = rows.withColumn("word", F.expr(f"""transform(raw, x -> trim(BOTH "{_EDGE.replace('"', chr(92) + '"')}" FROM x))"""))
    tmpl = f"""transform(word, (w, i) -> CASE
        WHEN w = '' THEN trim(BOTH "\\"'()[]{{}}" FROM raw[i])
        WHEN {number.format("w")} THEN '<num>'
        WHEN i > 0 AND {number.format("word[i - 1]")} AND lower(w) IN ({units}) THEN '<unit>'
        WHEN w = lower(w) THEN w
        WHEN i > 0 AND right(raw[i - 1], 1) NOT IN ('.', '!', '?', ':') THEN '<name>'
        ELSE lower(w) END)"""
    return rows.select(key, F.col("word").alias("raw"), F.expr(tmpl).alias("tmpl"))


def _windows(width: int, plain: bool, hashed: bool = False) -> str:
    """SQL of the windows (place, named, hash) of a document's ``tmpl``, or of its words in lower case if ``plain``; only the hashes if ``hashed``."""
    window = lambda named, value: value if hashed else f"struct(i AS place, {named} AS named, {value} AS hash)"
    every = f"sequence(0, size(tmpl) - {width})"
    # Element by element: the hash is that of the array, without a copy of it for each place.
    tokens = [f"{'raw' if plain else 'tmpl'}[i + {k}]" for k in range(width)]
    if plain:
        return f"IF(size(tmpl) < {width}, array(), transform({every}, i -> {window('false', _plain_hash(', '.join(f'lower({t})' for t in tokens)))}))"
    # A literal token that differs from its word was capitalised.
    capital = f"filter({every}, i -> raw[i] != tmpl[i] AND raw[i] != '' AND tmpl[i] NOT IN {PLACEHOLDERS})"
    named = ", ".join(["'<name>'", *tokens[1:]])
    return (
        f"IF(size(tmpl) < {width}, array(), concat(transform({every}, i -> {window('false', f'xxhash64({", ".join(tokens)})')}), "
        f"transform({capital}, i -> {window('true', f'xxhash64({named})')})))"
    )


def _plain_hash(words: str) -> str:
    return f"xxhash64({words}, 'words')"


def _items(benchmark: DataFrame) -> DataFrame:
    """The windows to search for, by item and place ``at``: ``hash``, template ``part``, words ``slots``.

    ``plain``: the words themselves are the template. ``fixed``: the first placeholder stands for the same word only.
    """
    items = templates(benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "item_id")
    items = items.withColumn("width", F.least(F.size("tmpl"), F.lit(WINDOW))).filter(F.col("width") >= LITERALS)
    at = F.explode(F.expr("sequence(0, size(tmpl) - width)")).alias("at")
    rows = items.select("item_id", "width", at, "raw", "tmpl").withColumn("slots", F.expr("slice(raw, at + 1, width)"))
    units, starters = (", ".join(f"'{w}'" for w in words.split()) for words in (UNITS, STARTERS))
    first = f"""CASE WHEN at > 0 OR raw[0] = '' OR tmpl[0] = '<num>' THEN array(tmpl[at])
        ELSE concat(array(lower(raw[0]), '<name>'), IF(lower(raw[0]) IN ({units}), array('<unit>'), array())) END"""
    forms = rows.withColumn("head", F.explode(F.expr(first))).withColumn("part", F.expr("concat(array(head), slice(tmpl, at + 2, width - 1))"))
    # A first word that stands for itself only counts as a literal one.
    forms = forms.withColumn("literals", F.expr(f"size(filter(part, x -> x NOT IN {PLACEHOLDERS}))"))
    forms = forms.filter(f"literals >= {LITERALS} OR literals = {LITERALS - 1} AND at = 0 AND head IN ('<name>', '<unit>')")
    fixed = f"at = 0 AND (head = '<unit>' OR head = '<name>' AND (literals < {LITERALS} OR raw[0] = lower(raw[0]) OR lower(raw[0]) IN ({starters})))"
    forms = forms.select("item_id", "width", "at", F.xxhash64("part").alias("hash"), "part", "slots", F.lit(False).alias("plain"), F.expr(fixed).alias("fixed"))
    dense = rows.join(forms.select("item_id").distinct(), "item_id", "left_anti").withColumn("part", F.expr("transform(slots, x -> lower(x))"))
    dense = dense.select("item_id", "width", "at", F.expr(_plain_hash("part")).alias("hash"), "part", "slots", F.lit(True).alias("plain"), F.lit(False).alias("fixed"))
    rows = written(forms.unionAll(dense), "forms")
    return written(rows.join(rows.groupBy("item_id").agg(F.countDistinct("at").alias("item_windows")), "item_id"), "items")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold benchmark items: ``doc_id, item_id, n_windows, item_windows, n_slots, n_changed, verbatim``.

    One row for each document and item of which at least NEEDED windows (all, if it has fewer) are
    found in consistent alignments. ``n_slots``: distinct item slot values met there, ``n_changed``:
    those that only meet another value, ``verbatim``: there are none of these. An item that is in a
    document word for word is found wherever it stands; an item without a window of LITERALS literal
    tokens only so. Rows that share a doc_id (item_id) are searched (searched for) as parts of one; rows without one are left out. Null, empty and short
    texts (under LITERALS tokens) hold nothing and are never found. An empty table on either side
    gives no rows. Other columns are not looked at.

    Runs jobs while it is called: items and matches are written to the shared folder.
    """
    settings(docs.sparkSession)
    items = _items(benchmark)
    kinds = sorted(tuple(r) for r in items.select("width", "plain").distinct().collect())  # at most two for each width up to WINDOW
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not kinds:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, item_windows long, n_slots long, n_changed long, verbatim boolean")
    hashes = F.expr(f"concat({', '.join(_windows(*k, hashed=True) for k in kinds)})")
    keys = measured(items.select("hash").distinct())
    hit = templates(texts, "doc_id").select("doc_id", F.explode(hashes).alias("hash")).join(keys, "hash", "left_semi").select("doc_id", "hash").distinct()
    hit = written(hit, "hits")
    # The few documents with a hit are cut again, now with places and slots.
    found = templates(texts.join(measured(hit.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id")
    spots = None
    for width, plain in kinds:
        spot = found.select("doc_id", "raw", "tmpl", F.explode(F.expr(_windows(width, plain))).alias("w")).select("doc_id", "raw", "tmpl", "w.*")
        form = f"slice(tmpl, place + 1, {width})"
        form = f"transform(slice(raw, place + 1, {width}), x -> lower(x))" if plain else f"IF(named, concat(array('<name>'), slice({form}, 2, {width - 1})), {form})"
        spot = spot.select("doc_id", "place", "hash", F.expr(f"slice(raw, place + 1, {width})").alias("values"), F.expr(form).alias("form"))
        spot = spot.join(keys, "hash", "left_semi")
        spots = spot if spots is None else spots.unionAll(spot)
    match = spots.join(items, "hash").filter("form = part AND NOT (fixed AND lower(slots[0]) != lower(values[0]))")
    match = written(match.select("doc_id", "item_id", "item_windows", "at", F.expr("place - at").alias("shift"), F.expr(
        f"filter(transform(part, (p, i) -> IF(NOT plain AND p IN {PLACEHOLDERS}, struct(lower(slots[i]) AS item_value, lower(values[i]) AS doc_value), NULL)), x -> x IS NOT NULL)"
    ).alias("slots")), "matches")
    line = ["doc_id", "item_id", "shift"]
    slots = match.select(*line, F.explode("slots").alias("s")).select(*line, "s.item_value", "s.doc_value")
    values = slots.groupBy(*line, "item_value").agg(F.min("doc_value").alias("lo"), F.max("doc_value").alias("hi"))
    lines = values.groupBy(*line).agg(F.avg(F.expr("IF(lo = hi, 1.0D, 0.0D)")).alias("steady"))
    bad = lines.filter(F.col("steady") < CONSISTENT).select(*line)
    good = match.join(bad, line, "left_anti")
    per_pair = good.groupBy("doc_id", "item_id").agg(F.countDistinct("at").alias("n_windows"), F.max("item_windows").alias("item_windows"))
    told = values.join(bad, line, "left_anti").groupBy("doc_id", "item_id", "item_value").agg(F.min(F.expr("IF(lo = hi AND lo = item_value, 0, 1)")).alias("changed"))
    told = told.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_slots"), F.sum("changed").alias("n_changed"))
    out = per_pair.filter(F.col("n_windows") >= F.least(F.lit(NEEDED), F.col("item_windows"))).join(told, ["doc_id", "item_id"], "left")
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return out.select("doc_id", "item_id", "n_windows", "item_windows", count("n_slots").alias("n_slots"), count("n_changed").alias("n_changed"), (count("n_changed") == 0).alias("verbatim"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no leak, with all their columns; rows without a doc_id stay."""
    gone = written(leaks(docs, benchmark).select("doc_id").distinct(), "gone")
    return docs.join(measured(gone), "doc_id", "left_anti").select(*docs.columns)
