"""Queries over commentary, announcements-like texts, events and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search
from ..operators.point_in_time import latest
from ..sources import views as V
from ..streaming import events as E
from .registry import query


def _sql_any(words):
    return "regexp_matches(low, '" + "|".join(words) + "')"


_KIND_SQL = "CASE WHEN low = '' THEN NULL " + " ".join(f"WHEN {_sql_any(words)} THEN '{name}'" for name, words in X.QUOTE_TYPES) + " WHEN length(low) >= 4 THEN 'philosophy' END"
_THEMES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_sql_any(words)} THEN '{name}' END" for name, words in X.THEMES) + "], lambda x: x IS NOT NULL)[1:3]"
# every character that may stand beside a code is doubled, so that two codes never share one
_CODES_SQL = "list_distinct(regexp_extract_all(regexp_replace('^' || clean || '$', '([^0-9A-Za-z.])', '\\1\\1', 'g'), '[^0-9A-Za-z.](?i:sh|sz|bj)?([0368][0-9]{5})(?i:\\.(?:sh|sz|bj))?[^0-9A-Za-z.]', 1))"


_CLEAN_SQL = f"""a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)</?(?:{"|".join(X.LINE_TAGS.split())})[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g') AS t FROM conversations),
  b AS (SELECT conv_id, turn, trim(regexp_replace(translate(t, '{X._FULL}', '{X._HALF}'), '\\s+', ' ', 'g'), '{X.END_MARKS}') AS clean FROM a), c AS (SELECT *, lower(clean) AS low FROM b)"""
_HASH_SQL = "CASE WHEN clean = '' THEN '' ELSE sha256(lower(regexp_replace(clean, '\\s+', '', 'g'))) END"


@query(f"""WITH {_CLEAN_SQL}
  SELECT conv_id, turn, CASE WHEN length(clean) <= 120 THEN clean ELSE rtrim(left(clean, 120)) || '…' END AS summary, {_HASH_SQL} AS hash, {_KIND_SQL} AS kind,
  array_to_string({_THEMES_SQL}, ',') AS themes, array_to_string({_CODES_SQL}, ',') AS codes FROM c""")
def cleaned_quotes(spark, d):
    """Conversation turns as comments: cleaned, tagged, hashed; every turn is kept.  (The SQL has no references and no sharing noise; the turns have none.)"""
    c = V.table(spark, d, "conversations").withColumn("clean", X.clean_text("text"))
    return c.select("conv_id", "turn", X.summary("clean").alias("summary"), X.content_hash("clean").alias("hash"), X.quote_type("clean").alias("kind"), F.array_join(X.themes("clean"), ",").alias("themes"), F.array_join(X.stock_codes("clean"), ",").alias("codes"))


@query("""SELECT h AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM (SELECT doc_id, CASE WHEN text = '' THEN '' ELSE sha256(lower(regexp_replace(text, '[\\s\\v\\x85\\p{Z}]+', '', 'g'))) END AS h FROM documents WHERE text IS NOT NULL) GROUP BY h HAVING count(*) > 1""")
def repeated_contents(spark, d):
    """Texts that differ in blanks and case only; the hash of a text is all that is shuffled."""
    c = V.table(spark, d, "documents").where("text is not null").select("doc_id", X.content_hash("text").alias("hash"))
    return c.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""SELECT p_partkey AS k, CASE WHEN regexp_matches(c, '^(6|5|90)') THEN c || '.SH' WHEN regexp_matches(c, '^(4|8|92)') THEN c || '.BJ' ELSE c || '.SZ' END AS ts_code FROM (SELECT p_partkey, lpad((p_partkey * 48271 % 1000000)::VARCHAR, 6, '0') AS c FROM part)""")
def normalized_codes(spark, d):
    c = F.lpad((F.col("p_partkey") * 48271 % 1000000).cast("string"), 6, "0")
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("k"), X.security_code(c).alias("ts_code"))


@query("""WITH s AS (SELECT p_partkey AS ts_code, p_name AS name, lower(p_partkey::VARCHAR) AS c, lower(p_name) AS n FROM part)
  SELECT ts_code, name, CASE WHEN starts_with(c, '12') THEN 0 WHEN contains(c, '12') THEN 1 WHEN starts_with(n, '12') THEN 2 WHEN contains(n, '12') THEN 3 END AS rank FROM s WHERE rank IS NOT NULL ORDER BY rank, ts_code LIMIT 20""")
def suggestions(spark, d):
    return search.suggest(V.table(spark, d, "part").select(F.col("p_partkey").alias("ts_code"), F.col("p_name").alias("name")), "12")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) WHERE tag <> '' GROUP BY 1")
def tag_counts(spark, d):
    return search.tag_counts(V.table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(",")).alias("tags")), "tags")


@query("""SELECT source, count(doc_id) AS documents, count_if(lang = 'en') AS english, max(doc_id) AS newest FROM documents GROUP BY 1""")
def author_counts(spark, d):
    return V.table(spark, d, "documents").groupBy("source").agg(F.count("doc_id").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.max("doc_id").alias("newest"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(text, 'License') AND lang IN ('en', 'de') AND n_chars >= 200")
def quote_search(spark, d):
    docs = V.table(spark, d, "documents")
    return search.quotes(docs, "License", ("text",), {"lang": ["en", "de"]}, since=200, time="n_chars").select("doc_id", "lang", "source")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The batch form of the stream's windows."""
    return E.flow_windows(V.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def event_sessions(spark, d):
    return E.sessions(V.table(spark, d, "events"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_events(spark, d):
    return latest(V.table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])
