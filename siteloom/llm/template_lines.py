"""Line deduplication by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .carry import carried

_BLANKS = r"[ \t\x0B\f\r]+"
_FIELD = r"(^| )[^ 0-9]*+[0-9][^ ]*+"  # a token with a digit; begins at a token's start, so one pass


def _n_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _lines(text: Column) -> Column:
    """Lines of a text with single blanks. Most texts have no other ones, which plain searches tell fast."""
    odd = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\f")]
    single = F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace(text, _BLANKS, " ")).otherwise(text)
    return F.transform(F.split(single, "\n", -1), lambda x: F.trim(x))


def _masked(line: Column, similarity: float) -> Column:
    """The line with ``<*>`` for each token that holds a digit, or as it stands where too few others would be left."""

    def chosen(pair: Column) -> Column:
        mask = pair["mask"]
        fields = (F.length(mask) - F.length(F.replace(mask, F.lit("<*>")))) / 3
        return F.when(fields > (1 - similarity) * _n_tokens(mask), pair["line"]).otherwise(mask)

    pair = F.array(F.struct(line.alias("line"), F.regexp_replace(line, _FIELD, "$1<*>").alias("mask")))
    # an array of one, so that the mask is computed once and used three times
    return F.when(line.rlike("[0-9]"), F.transform(pair, chosen)[0]).otherwise(line)


def _leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(_n_tokens(line), F.regexp_replace(F.substring_index(line, " ", depth), _FIELD, "$1<*>"))


def template_lines(
    docs: DataFrame, min_docs: int = 2, min_variable: int = 3, depth: int = 3, similarity: float = 0.5, percent: int = 1
) -> DataFrame:
    """Drop lines that recur in other documents, as they stand or as a template with variable fields.

    A line's tokens that hold a digit are variable fields (in a line where less than ``similarity`` of the tokens
    would be left, none is). A line found in ``min_docs`` documents, its fields apart, is dropped from all but the
    document of least doc_id among them, so what is merely copied survives once.

    Fields without a digit come from a tree of fixed depth: lines are sorted by their number of tokens, then by
    ``depth`` leading tokens. In a leaf of ``min_variable`` documents a token behind the leading ones is fixed when at
    least ``min_variable`` and at least ``percent`` % of the leaf's different lines have it at its position, else variable.
    Lines of a leaf with the same fixed tokens at the same positions have one template, so a leaf holds as many as it needs;
    one with less than ``similarity`` of those positions fixed is none. A template found in ``min_variable`` documents is
    dropped from all but the first, too.

    Hashes, ids and positions are shuffled to count, texts once to drop lines from them; only lines of leaves with
    several different ones are masked again. Counts are combined before the shuffle, so a line of a third of all documents
    is one small row per task. Lines are told apart by 64-bit hashes; lines to drop are named by position, so the
    last pass is linear in a text's lines.

    Returns the columns of ``docs`` with the kept lines as text, plus n_lines and n_dropped (long); columns of these two
    names are replaced, all others kept whatever their names. Empty lines stay. A null text stays null with no lines. Rows
    that repeat a doc_id are one document, and so are rows without one, which are never the first unless all are. An
    empty table gives no rows.
    """
    return carried(docs, ("n_lines", "n_dropped"), lambda rows: _drop_lines(rows, min_docs, min_variable, depth, similarity, percent))


def _drop_lines(rows: DataFrame, min_docs: int, min_variable: int, depth: int, similarity: float, percent: int) -> DataFrame:
    # rows without id, or with the same one, are told apart by their text
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    own = F.transform(_lines(F.col("text")), lambda x: F.when(x != "", F.struct(F.xxhash64(_masked(x, similarity)).alias("line"), _leaf(x, depth).alias("leaf"))))
    # the outer form: else Spark derives a test for empty arrays, which would mask every line again
    spots = keyed.select("doc_id", "hash", F.posexplode_outer(own).alias("pos", "l")).where("l is not null").select("doc_id", "hash", "pos", "l.*")
    spots = cut_lineage(spots, "lines")

    ids = [F.count("*").alias("n_docs"), F.min("doc_id").alias("first")]
    lines = spots.select("doc_id", "line", "leaf").distinct().groupBy("line", "leaf").agg(*ids)
    lines = cut_lineage(lines, "counts")
    # a leaf of a single masked line says nothing new; a document counts once for each of its lines there
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n_lines"), F.sum("n_docs").alias("n_docs"))
    leaves = cut_lineage(leaves.where((F.col("n_lines") > 1) & (F.col("n_docs") >= min_variable)).select("leaf", "n_lines"), "leaves")

    raw = F.transform(_lines(F.col("text")), lambda x: F.when(x != "", F.struct(x.alias("text"), _leaf(x, depth).alias("leaf"))))
    raw = rows.select(F.explode_outer(raw).alias("l")).where("l is not null").select("l.*").join(leaves.select("leaf"), "leaf", "left_semi")
    mask = F.col("mask")
    raw = raw.select("leaf", _masked(F.col("text"), similarity).alias("mask")).where(_n_tokens(mask) > depth).distinct()
    tokens = raw.select("leaf", F.xxhash64("mask").alias("line"), F.posexplode(F.split("mask", " ")).alias("pos", "token"))
    tokens = cut_lineage(tokens.where(F.col("pos") >= depth), "tokens")
    counts = tokens.where("token <> '<*>'").groupBy("leaf", "pos", "token").agg(F.count("*").alias("n")).join(leaves, "leaf")
    fixed = counts.where((F.col("n") >= min_variable) & (F.col("n") * 100 >= F.col("n_lines") * percent)).select("leaf", "pos", "token", F.lit(True).alias("fixed"))
    known = tokens.join(fixed, ["leaf", "pos", "token"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    spelt = F.array_sort(F.collect_list(F.when(F.col("fixed"), F.struct("pos", "token"))))
    patterns = known.groupBy("leaf", "line").agg(spelt.alias("spelt"), F.avg(F.col("fixed").cast("int")).alias("share"))
    patterns = patterns.where(F.col("share") >= similarity).select("line", F.xxhash64("leaf", "spelt").alias("pattern"))
    patterns = cut_lineage(patterns, "patterns")
    grouped = spots.select("doc_id", "line").join(patterns, "line").select("doc_id", "pattern").distinct()
    grouped = grouped.groupBy("pattern").agg(*ids).where(F.col("n_docs") >= min_variable).select("pattern", F.col("first").alias("pattern_first"))

    # decided once per distinct line, so the rows of a hot leaf need not meet
    decided = lines.select("line", F.when(F.col("n_docs") >= min_docs, F.col("first")).alias("line_first"), (F.col("n_docs") >= min_docs).alias("recurs"))
    decided = decided.join(patterns.join(grouped, "pattern").select("line", "pattern_first"), "line", "left")
    decided = decided.where(F.col("recurs") | F.col("pattern_first").isNotNull())
    judged = spots.select("doc_id", "hash", "pos", "line").join(decided, "line")
    again = [~F.col("doc_id").eqNullSafe(F.col(c)) & F.col(c).isNotNull() for c in ("line_first", "pattern_first")]
    dropped = judged.where(again[0] | again[1]).select("doc_id", "hash", "pos").distinct()
    dropped = dropped.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("of")).agg(F.array_sort(F.collect_list("pos")).alias("dropped"))
    out = keyed.join(dropped, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("hash").eqNullSafe(F.col("of")), "left")
    every = F.split("text", "\n", -1)
    # the stretches between dropped lines, joined
    ends = F.concat("dropped", F.array(F.size(every)))
    begins = F.concat(F.array(F.lit(0)), F.transform("dropped", lambda p: p + 1))
    kept = F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda s: F.slice(F.col("every"), s["a"] + 1, s["b"] - s["a"])))
    out = out.withColumn("every", every)
    changed = F.col("dropped").isNotNull()
    new = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("every")).cast("long")
    n_dropped = F.when(changed, F.size("dropped")).otherwise(0).cast("long")
    return out.select("row", new.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def template_lines_sql(
    source: str = "documents", min_docs: int = 2, min_variable: int = 3, depth: int = 3, similarity: float = 0.5, percent: int = 1
) -> str:
    """The same rows in DuckDB's SQL: doc_id, text, n_lines, n_dropped; ids must be distinct and not null."""
    line = r"trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g'), ' ')"
    field = r"'(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g'"
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM {source}
), placed AS (
  SELECT doc_id, spot, raw, CASE WHEN (length(mask) - length(replace(mask, '<*>', ''))) / 3
    > {1 - similarity} * (length(mask) - length(replace(mask, ' ', '')) + 1) THEN line ELSE mask END AS mask,
    length(line) - length(replace(line, ' ', '')) + 1 AS n,
    regexp_replace(array_to_string(list_slice(string_split(line, ' '), 1, {depth}), ' '), {field}) AS lead
  FROM (SELECT *, regexp_replace(line, {field}) AS mask FROM (SELECT doc_id, spot, line AS raw, {line} AS line FROM lines))
), pairs AS (SELECT DISTINCT doc_id, mask, n, lead FROM placed WHERE mask <> ''),
recurring AS (SELECT mask, min(doc_id) AS first FROM pairs GROUP BY mask HAVING count(*) >= {min_docs}),
leaves AS (
  SELECT n, lead, count(DISTINCT mask) AS n_lines FROM pairs GROUP BY n, lead
  HAVING count(*) >= {min_variable} AND count(DISTINCT mask) > 1 AND n > {depth}
), tokens AS (
  SELECT n, lead, n_lines, mask, unnest(string_split(mask, ' ')) AS token, generate_subscripts(string_split(mask, ' '), 1) AS pos
  FROM (SELECT DISTINCT mask, n, lead FROM pairs) JOIN leaves USING (n, lead)
), fixed AS (
  SELECT n, lead, pos, token FROM tokens WHERE pos > {depth} AND token <> '<*>' GROUP BY n, lead, pos, token, n_lines
  HAVING count(*) >= {min_variable} AND count(*) * 100 >= n_lines * {percent}
), patterns AS (
  SELECT n, lead, mask, string_agg(t.pos || ' ' || t.token, ' ' ORDER BY t.pos) FILTER (WHERE f.pos IS NOT NULL) AS pattern
  FROM tokens t LEFT JOIN fixed f USING (n, lead, pos, token) WHERE t.pos > {depth} GROUP BY n, lead, mask
  HAVING avg(CASE WHEN f.pos IS NOT NULL THEN 1 ELSE 0 END) >= {similarity}
), templates AS (
  SELECT n, lead, pattern, min(doc_id) AS first FROM pairs JOIN patterns USING (n, lead, mask)
  GROUP BY n, lead, pattern HAVING count(DISTINCT doc_id) >= {min_variable}
), judged AS (
  SELECT p.*, coalesce(p.doc_id <> r.first, false) OR coalesce(p.doc_id <> t.first, false) AS dropped
  FROM placed p LEFT JOIN recurring r ON p.mask = r.mask LEFT JOIN patterns s ON p.mask = s.mask AND p.n = s.n AND p.lead = s.lead
  LEFT JOIN templates t ON s.n = t.n AND s.lead = t.lead AND s.pattern = t.pattern
), kept AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY spot) FILTER (WHERE NOT dropped), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM judged GROUP BY doc_id
)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, d.text) END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM {source} d LEFT JOIN kept k USING (doc_id)"""
