"""Line deduplication by a log-template tree, in DataFrame functions only.

Every line is parsed to a fixed depth: number of tokens, then the leading
tokens, with tokens that hold a digit generalised to ``<*>``.  Below that leaf
lie the masked wordings.  From ``GENERAL`` tokens on, a wording also belongs to
templates with one variable field: the tokens after the leading ones are cut to
equal strips of at most ``FIELD / 2`` tokens (at least ``2 * SEGMENTS`` strips),
and each two neighbouring strips in turn are generalised to ``<*>``.  Two lines
that differ in one field (a name, a title, a date in words) no longer than a
strip share such a template wherever the field lies, two lines of prose that
merely begin alike do not.

What recurs in several documents is boilerplate:

- a wording stays in the document with the least doc_id (its home) and is
  dropped from all others;
- a wording is *firm* if none of its templates has a wording with a lesser home;
  it stays at home whatever happens to others;
- a wording goes, at home too, if one of its templates has a firm wording with
  the least home of that template, and that home is less than its own.

So a line goes only for a line of its own template that stays: no chain of
alike lines loses its last one, and the words lost with a line are those of its
variable field, at most ``FIELD`` tokens and about a quarter of the line.  Not
found are lines that vary in two far stretches, by an inserted word (the leaf
is the token count), in the leading tokens, or by a word below ``GENERAL``
tokens.  Lines under ``SHORT`` tokens say too little to be a template and stay.

A leaf that only one document has holds nothing that recurs; only wordings of
shared leaves go on to the templates, as 64-bit keys, copies combined before
the shuffle: a line in every document is one row per task there.

Edge rows: null texts stay null and empty texts empty; a document all of whose
lines are dropped keeps its row with an empty text; rows that repeat a doc_id
count as one document, each loses its own lines; rows without doc_id are neither counted nor changed;
further columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cut, fresh

DEPTH = 3
SEGMENTS = 4
FIELD = 12
GENERAL = 10
SHORT = 3
BLANKS = " \t\r\f"


def template_keys(tokens: Column, n: Column, leaf: Column) -> Column:
    """Array of the keys of a line's templates with one variable field; empty below ``GENERAL`` tokens.

    A key is the leaf with the exclusive-or of the hashes of all strips but two
    neighbours, so a long line costs no more than its tokens.
    """
    rest = n - DEPTH
    strips = F.greatest(F.lit(2 * SEGMENTS), (2 * F.ceil(rest / FIELD)).cast("int"))

    def strip(j: Column) -> Column:
        start, end = F.floor(rest * j / strips).cast("int"), F.floor(rest * (j + 1) / strips).cast("int")
        return F.xxhash64(j, F.slice(tokens, start + DEPTH + 1, end - start))

    def without_two(hashes: Column, whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), strips - 1), lambda j: F.xxhash64(
            leaf, j, whole.bitwiseXOR(F.element_at(hashes, j)).bitwiseXOR(F.element_at(hashes, j + 1))))

    hashed = F.array(F.transform(F.sequence(F.lit(0), strips - 1), strip))
    keys = F.flatten(F.transform(hashed, lambda h: without_two(
        h, F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))))
    return F.when(n >= GENERAL, keys).otherwise(F.array().cast("array<bigint>"))


def line_templates(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A row per line: doc, ``own`` (hash of the row's text), pos (from 0), leaf, wording, and the keys of its templates."""
    # The text is hashed and split below the explode, so no line carries it.
    split = docs.where(F.col(doc).isNotNull()).select(
        F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("own"), F.split(F.col(text), "\n").alias("lines"))
    lines = split.select("doc", "own", F.posexplode("lines").alias("pos", "line"))
    line = F.trim(F.col("line"), F.lit(BLANKS))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace(line, f"[^{BLANKS}]*[0-9][^{BLANKS}]*", "<*>")).otherwise(line)
    tokens = lines.select("doc", "own", "pos", F.split(masked, f"[{BLANKS}]+").alias("tokens")).withColumn("n", F.size("tokens")).where(
        F.col("n") >= SHORT)
    leaves = tokens.withColumn("leaf", F.xxhash64("n", F.slice("tokens", 1, DEPTH)))
    return leaves.select("doc", "own", "pos", "leaf", F.xxhash64("n", "tokens").alias("wording"),
                         template_keys(F.col("tokens"), F.col("n"), F.col("leaf")).alias("keys"))


def recurring_wordings(lines: DataFrame) -> DataFrame:
    """(wording, home, goes) of the wordings that some document loses: all but ``home`` do, and that too where it ``goes``."""
    leaves = lines.groupBy("leaf").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("leaf")
    wordings = cut(lines.join(leaves, "leaf").groupBy("wording").agg(
        F.min("doc").alias("home"), F.max("doc").alias("last"), F.first("keys").alias("keys")))
    keyed = wordings.select("wording", "home", F.explode("keys").alias("key"))
    shared = (keyed.groupBy("key").agg(F.min("home").alias("least"), F.max("home").alias("most"))
              .where("least < most").select("key", "least"))
    alike = cut(keyed.join(shared, "key"))
    bound = alike.where("least < home").select("wording").distinct()
    held = alike.where("least = home").join(bound, "wording", "left_anti").select("key").distinct()
    goes = (alike.where("least < home").join(held, "key", "left_semi").select("wording").distinct()
            .withColumn("goes", F.lit(True)))
    return (wordings.select("wording", "home", "last").join(goes, "wording", "left")
            .select("wording", "home", "last", F.coalesce("goes", F.lit(False)).alias("goes"))
            .where("goes or home < last").drop("last"))


def drop_recurring_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; adds n_lines and n_dropped."""
    # Lines are parsed once; all else is read again from the checkpoint.
    parsed = cut(line_templates(docs, doc, text))
    drop = fresh(docs.columns, "_drop")
    own, whose = fresh(docs.columns, "_doc"), fresh(docs.columns, "_own")
    gone = (parsed.select("doc", "own", "pos", "wording").join(recurring_wordings(parsed), "wording").where("goes or doc <> home")
            .groupBy(F.col("doc").alias(own), F.col("own").alias(whose)).agg(F.collect_set("pos").alias(drop)))
    lines = F.split(F.col(text), "\n")
    # The split text is bound once, the positions that stay are looked up in it.
    kept = F.concat_ws("\n", F.flatten(F.transform(F.array(lines), lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop)), lambda i: ls[i]))))
    both = docs.join(gone, (F.col(doc).cast("long") == F.col(own)) & (F.xxhash64(text) == F.col(whose)), "left")
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept).alias(text)
    return both.select(*[cleaned if c.lower() == text.lower() else F.col(c) for c in docs.columns],
                       F.greatest(F.size(lines), F.lit(0)).alias("n_lines"),
                       F.greatest(F.size(F.col(drop)), F.lit(0)).alias("n_dropped"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of doc_id, text, n_lines, n_dropped; wordings and templates as lists of tokens instead of keys."""
    ctl = "' ' || chr(9) || chr(13) || chr(12)"
    return f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {table}),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls), {ctl}) AS line FROM split),
parsed AS (
  SELECT * FROM (SELECT doc_id, pos, tokens, len(tokens) AS n FROM (
    SELECT doc_id, pos, string_split_regex(regexp_replace(line, '[^ \\t\\r\\f]*[0-9][^ \\t\\r\\f]*', '<*>', 'g'), '[ \\t\\r\\f]+') AS tokens
    FROM lines)) WHERE n >= {SHORT}),
wordings AS (SELECT tokens, n, min(doc_id) AS home, greatest({2 * SEGMENTS}, 2 * ((n - {DEPTH} + {FIELD - 1}) // {FIELD})) AS strips
  FROM parsed GROUP BY tokens, n),
fields AS (SELECT tokens, home, n, strips, unnest(range(1, strips)) AS j FROM wordings WHERE n >= {GENERAL}),
keyed AS (SELECT tokens, home, {{'n': n, 'j': j, 't': list_concat(tokens[1:{DEPTH} + (n - {DEPTH}) * (j - 1) // strips],
    tokens[{DEPTH} + (n - {DEPTH}) * (j + 1) // strips + 1:])}} AS key FROM fields),
shared AS (SELECT key, min(home) AS least FROM keyed GROUP BY key HAVING min(home) < max(home)),
alike AS (SELECT tokens, home, key, least FROM keyed JOIN shared USING (key)),
bound AS (SELECT DISTINCT tokens FROM alike WHERE least < home),
held AS (SELECT DISTINCT key FROM alike a WHERE least = home AND NOT EXISTS (SELECT 1 FROM bound b WHERE b.tokens = a.tokens)),
goes AS (SELECT DISTINCT tokens FROM alike JOIN held USING (key) WHERE least < home),
gone AS (SELECT p.doc_id, list(DISTINCT p.pos) AS drops FROM parsed p JOIN wordings w ON p.tokens = w.tokens
  LEFT JOIN goes g ON p.tokens = g.tokens WHERE p.doc_id <> w.home OR g.tokens IS NOT NULL GROUP BY p.doc_id)
SELECT s.doc_id,
  CASE WHEN drops IS NULL THEN text ELSE coalesce(array_to_string(
    list_transform(list_filter(range(len(ls)), lambda p: NOT list_contains(drops, p)), lambda p: ls[p + 1]), chr(10)), '') END AS text,
  CAST(len(ls) AS INTEGER) AS n_lines, CAST(coalesce(len(drops), 0) AS INTEGER) AS n_dropped
FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id"""
