"""Line dedup by a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens, then by its ``LEADING``
first tokens (a token with a digit is the field ``<*>``). In a leaf, a token is constant at its
place if at least ``MIN_DOCS`` lines of the leaf have it there, a line counting as often as it
occurs; all other places are fields. The leading tokens are constant by the leaf's making and say nothing: a line with
a constant place after them, and at least ``ALIKE`` of the places after them constant, has that
generalised template; any other line is its own template, with its fields masked. Templates found
in at least ``MIN_DOCS`` documents recur, and their lines are dropped from every document.

Only hashes of leaves, lines and tokens are grouped; the text of a line is moved once per
distinct line, and only for leaves that occur in enough documents to matter. Counts of documents
are of distinct pairs, so a leaf or line that a third of all lines share is folded in each task
before it is shuffled.

Defined cases: null and empty texts have no lines; blank lines are always kept; a line of no more
than ``LEADING`` tokens has no places after them and is its own template; equal rows (same id and
text) count as one document, rows without an id that have equal texts too; rows that share an id but
not their text are documents of their own; a line of any length is one line; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

LEADING, MIN_DOCS, ALIKE = 2, 3, 0.6
FIELD = "<*>"
#: Rows of hashes (some 16 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Places of dropped lines, of four bytes each, that are broadcast.
BROADCAST_PLACES = 8_000_000


def _tokens(line: Column) -> Column:
    """Tokens between white space, those with a digit masked."""
    spaced = F.when(line.rlike(r"[\t\r\f\x0B]"), F.regexp_replace(line, r"[\t\r\f\x0B]", " ")).otherwise(line)
    masked = F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(spaced)
    return F.array_remove(F.split(masked, " "), "")


def lines(rows: DataFrame) -> DataFrame:
    """(did, rid, pos, tokens, leaf, line): one row per line that is not blank; leaf and line are hashes."""
    each = rows.where("text <> ''").select(*C.KEY, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    each = each.select(*C.KEY, "pos", _tokens(F.col("raw")).alias("tokens")).where(F.size("tokens") > 0)
    leaf = F.xxhash64(F.size("tokens"), *(F.get("tokens", F.lit(k)) for k in range(LEADING)))
    return each.select(*C.KEY, "pos", "tokens", leaf.alias("leaf"), F.xxhash64("tokens").alias("line"))


def _small(df: DataFrame, places: str | None = None) -> DataFrame:
    """Broadcast a written table of hashes if its size allows: the number of its rows, and of all places in them where a row has many."""
    most = F.lit(0) if places is None else F.coalesce(F.sum(F.size(places)), F.lit(0))
    n = df.agg(F.count(F.lit(1)).alias("rows"), most.alias("places")).first()
    return F.broadcast(df) if n.rows <= BROADCAST_ROWS and n.places <= BROADCAST_PLACES else df


def _documents(pairs: DataFrame, key: str) -> DataFrame:
    """Distinct documents of each key."""
    return pairs.select(key, *C.KEY).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("docs"))


def templates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(did, rid, pos, leaf, line) of all lines, and (line, template) of the lines in leaves that occur in enough documents."""
    found = C.materialise(lines(rows).drop("tokens"), "lines")
    leaves = C.materialise(_documents(found, "leaf").where(F.col("docs") >= MIN_DOCS).select("leaf"), "leaves")
    texts = lines(rows).join(_small(leaves), "leaf", "left_semi")
    distinct = texts.groupBy("line").agg(F.min("leaf").alias("leaf"), F.min("tokens").alias("tokens"), F.count(F.lit(1)).alias("times"))
    distinct = C.materialise(distinct, "distinct")
    # a line counts as often as it occurs, up to MIN_DOCS: one document alone can't make a template recur.
    # A token at its place in a leaf is one hash, its slot; the leading tokens are constant by the leaf's making
    placed = distinct.select("line", "leaf", F.least("times", F.lit(MIN_DOCS)).alias("times"), F.posexplode(F.slice("tokens", LEADING + 1, F.greatest(F.size("tokens") - LEADING, F.lit(0)))).alias("at", "word"))
    placed = placed.select("line", "times", F.xxhash64("leaf", "at", "word").alias("slot"))
    constant = placed.groupBy("slot").agg(F.sum("times").alias("times")).where(F.col("times") >= MIN_DOCS).select("slot")
    kept = placed.select("slot", "line").join(constant, "slot").groupBy("line").agg(F.sort_array(F.collect_list("slot")).alias("constants"))
    named = distinct.select("line", "leaf", F.size("tokens").alias("n")).join(kept, "line", "left")
    # null for a line without constants, which is then its own template
    enough = F.size("constants") >= F.lit(ALIKE) * (F.col("n") - LEADING)
    template = F.when(F.col("constants").isNotNull() & enough, F.xxhash64("leaf", "constants")).otherwise(F.xxhash64("leaf", "line"))
    return found, C.materialise(named.select("line", template.alias("template")), "templates")


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_lines, n_dropped, kept), ``kept`` being the text of the other lines."""
    rows = C.keyed(docs)
    found, named = templates(rows)
    named = C.materialise(found.join(_small(named), "line").select(*C.KEY, "pos", "template"), "named")
    recurring = C.materialise(_documents(named, "template").where(F.col("docs") >= MIN_DOCS).select("template"), "recurring")
    gone = named.join(_small(recurring), "template", "left_semi").groupBy(*C.KEY).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = C.materialise(gone, "gone")
    out = rows.join(_small(gone, "gone"), C.KEY, "left")
    all_lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    out = out.select("doc_id", all_lines.alias("all"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))  # a hash set of the places: linear in the lines
    kept = F.when(F.size("gone") == 0, F.array_join("all", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("all", i + 1)), "\n"))
    return out.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))
