"""Full-text search and line reconstruction over documents and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import fulltext, trigrams
from leafmill.operators import text as ops
from leafmill.plans import query, table
from leafmill.sources import shared

_TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY token")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its document and term frequency."""
    return ops.frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TOKENS.format('text')}, 'licensed')")
def fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a token."""
    return ops.matching(table(spark, sf_dir, "documents"), "text", "licensed").select("doc_id")


@query(r"""SELECT conv_id, turn, len(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}])The(?:$|[^\p{L}\p{N}])'))::INT AS hits FROM conversations WHERE regexp_matches(text, '(?:^|[^\p{L}\p{N}])The(?:$|[^\p{L}\p{N}])') ORDER BY conv_id, turn LIMIT 50""")
def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-sensitive whole-word search with max_hits, which is the feature."""
    found = ops.search(table(spark, sf_dir, "conversations"), "text", "The", case_sensitive=True, whole_word=True)
    return found.select("conv_id", "turn", "hits").orderBy("conv_id", "turn").limit(50)


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{2}|@mail')")
def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that match a pattern."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{3}-[0-9]{2}|@mail")).select("doc_id")


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE lang NOT IN ('de', 'es') UNION ALL SELECT doc_id, 'marked passage ' || lang FROM documents WHERE lang = 'es'),
t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM d) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY token""")
def fts_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies after German documents were deleted and Spanish ones rewritten."""
    d = table(spark, sf_dir, "documents")
    new = d.where("lang = 'es'").select("doc_id", F.concat(F.lit("marked passage "), "lang").alias("text"))
    now = ops.synced(d.select("doc_id", "text"), d.where("lang = 'de'").select("doc_id"), new, "doc_id")
    return ops.frequencies(now, "doc_id", "text")


@query(r"""SELECT doc_id, count(*) FILTER (trim(s) <> '') AS lines, count(*) FILTER (trim(s) = '') AS blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY doc_id""")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document without those that are blank."""
    parts = F.split("text", "\n")
    blank = F.size(F.filter(parts, lambda s: F.trim(s) == ""))
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(parts) - blank).cast("long").alias("lines"), blank.cast("long").alias("blank"))


_CHARS = """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CASE WHEN o_orderkey % 11 = 0 THEN chr(10) ELSE substr(o_orderpriority, 3, 1) END AS c,
 (o_orderkey % 40 * 6)::DOUBLE AS l, (o_orderkey % 3 * 4)::DOUBLE AS b, (o_orderkey % 40 * 6 + 60)::DOUBLE AS r, (o_orderkey % 3 * 4 + 10)::DOUBLE AS t FROM orders"""


@query(f"""WITH RECURSIVE ch AS MATERIALIZED ({_CHARS}),
fold(k, i, c, line, open, l, b, r, t) AS (SELECT o_custkey, i, c, 1, c <> chr(10), l, b, r, t FROM ch WHERE i = 1
UNION ALL SELECT k, j, d, CASE WHEN joins OR d = chr(10) THEN line ELSE line + 1 END, d <> chr(10), CASE WHEN joins THEN least(l, nl) ELSE nl END, CASE WHEN joins THEN least(b, nb) ELSE nb END, CASE WHEN joins THEN greatest(r, nr) ELSE nr END, CASE WHEN joins THEN greatest(t, nt) ELSE nt END
FROM (SELECT f.*, n.i AS j, n.c AS d, n.l AS nl, n.b AS nb, n.r AS nr, n.t AS nt, n.c <> chr(10) AND f.open AND least(f.t - f.b, n.t - n.b) > 0 AND least(f.t, n.t) - greatest(f.b, n.b) > 0.5 * least(f.t - f.b, n.t - n.b) AND NOT n.r < f.l AS joins FROM fold f JOIN ch n ON n.o_custkey = f.k AND n.i = f.i + 1)),
whole AS (SELECT k, line, string_agg(c, '' ORDER BY i) AS text FROM fold WHERE c <> chr(10) GROUP BY 1, 2 HAVING trim(string_agg(c, '')) <> ''),
hull AS (SELECT k, line, min(l) AS "left", min(b) AS bottom, max(r) AS "right", max(t) AS top FROM (SELECT f.k, f.line, n.l, n.b, n.r, n.t FROM fold f JOIN ch n ON n.o_custkey = f.k AND n.i = f.i WHERE n.c <> chr(10)) GROUP BY 1, 2)
SELECT k AS o_custkey, (row_number() OVER (PARTITION BY k ORDER BY line) - 1)::INT AS line, text, "left", bottom, "right", top FROM whole JOIN hull USING (k, line)""")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines out of placed characters: an order's priority letter, or a line break, at a place that its keys give."""
    left, bottom = (F.col("o_orderkey") % 40 * 6).cast("double"), (F.col("o_orderkey") % 3 * 4).cast("double")
    letter = F.when(F.col("o_orderkey") % 11 == 0, "\n").otherwise(F.substring("o_orderpriority", 3, 1))
    chars = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("place"), letter.alias("c"), left.alias("left"), bottom.alias("bottom"), (left + 60).alias("right"), (bottom + 10).alias("top"))
    return ops.placed_lines(chars, ["o_custkey"], "place")


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\x00]', '', 'g')) AS hash, trim(split_part(text, chr(10), 1)) AS title FROM documents")
def decoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text through UTF-16LE and back without NUL, and the trimmed first line as its title."""
    back = F.replace(F.decode(F.encode("text", "UTF-16LE"), "UTF-16LE"), F.lit("\x00"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(back, 256).alias("hash"), F.trim(F.substring_index(back, "\n", 1)).alias("title"))


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as first indexed, and the changed ones before and after: French ones come in, German ones go, Spanish ones are rewritten."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rewritten = d.where("lang = 'es'").select("doc_id", F.concat(F.lit("marked passage "), "lang").alias("text"))
    return d.where("lang <> 'fr'").drop("lang"), d.where("lang IN ('de', 'es')").drop("lang"), d.where("lang = 'fr'").drop("lang").unionByName(rewritten)


_NOW = "SELECT doc_id, text FROM documents WHERE lang NOT IN ('de', 'es') UNION ALL SELECT doc_id, 'marked passage ' || lang FROM documents WHERE lang = 'es'"


@query(f"""WITH d AS ({_NOW}), t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM d) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY token""")
def fts_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies after a batch of inserts, deletes and updates, merged into the stored ones; only the changed texts are read for it."""
    first, old, new = _changed(spark, sf_dir)
    index = fulltext.FullTextIndex(spark, shared.new_folder(spark, "frequencies"), with_postings=False)
    index.build(first, "doc_id", "text")
    index.apply(1, old, new, "doc_id", "text")
    return index.frequencies()


#: Phrases with the most documents asked for; null asks for all.
_PHRASES = (("marked passage es", None), ("the", 40), ("of the", 25), ("licensed under", None))


def _phrase_sql() -> str:
    def of(phrase: str, most: int | None) -> str:
        terms = phrase.split()
        held = " AND ".join(f"w[p + {i}] = '{t}'" for i, t in enumerate(terms))
        hits = f"SELECT '{phrase}' AS phrase, doc_id, count(*)::INT AS hits FROM p WHERE {held} GROUP BY doc_id"
        return hits if most is None else f"SELECT * FROM ({hits} ORDER BY hits DESC, doc_id LIMIT {most})"

    return f"""WITH d AS ({_NOW}), t AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM d), p AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t) """ + " UNION ALL ".join(of(*x) for x in _PHRASES)


@query(_phrase_sql())
def fts_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases over a stored index after a batch of changes, all hits or the best few; max_hits is the feature."""
    first, old, new = _changed(spark, sf_dir)
    index = fulltext.FullTextIndex(spark, shared.new_folder(spark, "postings"))
    index.build(first, "doc_id", "text")
    index.apply(1, old, new, "doc_id", "text")
    found = [(index.phrase(p) if most is None else index.best(p, most)).select(F.lit(p).alias("phrase"), F.col("doc").alias("doc_id"), "hits") for p, most in _PHRASES]
    return reduce(DataFrame.unionByName, found)


#: A pattern with a literal, one of alternatives in any case, and one without any literal of three characters.
_PATTERNS = ("Licensed under the [A-Z]+", "(?i)(?:mit|isc) license|released under", "[0-9]{3}-[0-9]{2}|@mail")


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id FROM documents WHERE regexp_matches(text, '{p}')" for p in _PATTERNS))
def regex_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns over a trigram index: only documents with a pattern's literals are matched, all of them where it has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = trigrams.RegexIndex(spark, shared.new_folder(spark, "trigrams"))
    index.build(docs, "doc_id", "text")
    return reduce(DataFrame.unionByName, [index.search(docs, "doc_id", "text", p).select(F.lit(p).alias("pattern"), "doc_id") for p in _PATTERNS])
