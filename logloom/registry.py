"""Queries that the driver may run, each with DuckDB SQL of the same result where there is one.

All of them read whole tables. The corpora are those of plans.corpora; the SQL below builds them in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsonfields, timestamps, tokens
from .operators import access, filters, sampling, search, timeline
from .plans import corpora, storage
from .plans.query import Op
from .sources.lines import export_bytes, heads, open_lines, stats
from .streaming import tail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def with_parts(parts: str, body: str) -> str:
    return f"WITH {parts} {body}"


#: Lines of documents: none for an empty text, none after a final line feed, one carriage return less.
DOC_LINES = r"""
parts AS (SELECT doc_id AS src, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
cut AS (SELECT src, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM parts),
raws AS (SELECT src, unnest(p) AS raw, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS line FROM cut),
lines AS (SELECT src, line, raw, CASE WHEN raw LIKE '%' || chr(13) THEN raw[:length(raw) - 1] ELSE raw END AS value FROM raws)"""
EVENT_MS = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"
EVENT_JSON = EVENT_MS + """,
lines AS (SELECT 0 AS src, event_id AS line,
  '{"ts":' || ms || ',"level":"' || upper(event_type) || '","user":{"id":' || user_id || ',"tags":["a",' || (event_id % 7) || ']},"props":' || props || '}' AS value,
  ms, user_id, event_type, props, event_id FROM ev)"""
EVENT_LOG = EVENT_MS + """,
kinds AS (SELECT CAST(event_id % 4 AS INTEGER) AS src, CAST(event_id // 4 AS BIGINT) AS line, ms, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS part FROM ev),
lines AS (SELECT src, line, ms, line % 10 = 9 AS follows FROM kinds)"""


def timelines_sql(disorder: bool) -> str:
    ms = "ms + (event_id % 7) * 600000" if disorder else "ms"
    return EVENT_MS + f""",
types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS src FROM (SELECT DISTINCT event_type FROM events)),
tl AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY event_id) - 1 AS BIGINT) AS line, CAST({ms} AS BIGINT) AS ts FROM ev JOIN types USING (event_type))"""


MERGED = """keyed AS (SELECT *, max(ts) OVER (PARTITION BY src ORDER BY line) AS m FROM {t}),
merged AS (SELECT CAST(row_number() OVER (ORDER BY m, src, line) - 1 AS BIGINT) AS pos, ts, src, line FROM keyed)"""


# --- lines ---


@query(with_parts(DOC_LINES, "SELECT src, line, value FROM lines"))
def lines_split(spark, sf_dir):
    return corpora.document_lines(spark, sf_dir).select("src", "line", "value")


@query(with_parts(DOC_LINES, "SELECT src, count(*) AS lines FROM lines GROUP BY src"))
def line_count(spark, sf_dir):
    return access.line_count(corpora.document_lines(spark, sf_dir))


@query(with_parts(DOC_LINES, "SELECT src, line, value FROM lines WHERE line = 2"))
def line_at(spark, sf_dir):
    return access.line_at(corpora.document_lines(spark, sf_dir), 2).select("src", "line", "value")


@query(with_parts(DOC_LINES, "SELECT src, line, value FROM lines WHERE line >= 5"))
def lines_from(spark, sf_dir):
    return access.lines_from(corpora.document_lines(spark, sf_dir), 5).select("src", "line", "value")


@query(with_parts(DOC_LINES, """, starts AS (SELECT src, line, octet_length(encode(raw)) AS n, coalesce(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY src ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
asked AS (SELECT doc_id AS src, CAST(doc_id * 37 % 3000 AS BIGINT) AS "offset" FROM documents)
SELECT a.src, a."offset", s.line FROM asked a JOIN starts s ON a.src = s.src AND a."offset" BETWEEN s.start AND s.start + s.n""".lstrip()))
def offset_to_line(spark, sf_dir):
    lines = corpora.document_lines(spark, sf_dir)
    asked = corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") * 37 % 3000).cast("bigint").alias("offset"))
    return access.offset_to_line(lines, asked)


@query(with_parts(EVENT_LOG, """, texts AS (SELECT k.src, k.line, CASE WHEN k.line % 10 = 9 THEN '  at ' || event_type ELSE CASE k.src WHEN 0 THEN replace(stamp, ' ', 'T') || '.' || part || 'Z' WHEN 1 THEN stamp || ',' || part WHEN 2 THEN CAST(ms // 1000 AS VARCHAR) ELSE CAST(ms AS VARCHAR) END || ' ' || upper(event_type) END AS value FROM kinds k)
SELECT src, count(*) AS lines, max(line) AS last, CAST(sum((line + 1) * length(value)) AS BIGINT) AS weight FROM texts GROUP BY src"""))
def open_files(spark, sf_dir):
    """Log lines written to a file for each source, and read back with their numbers."""
    log = corpora.event_log(spark, sf_dir).select("src", "line", "value")
    root = storage.new_folder(spark, "logs")
    log.repartition("src").sortWithinPartitions("src", "line").select("src", "value").write.partitionBy("src").option("lineSep", "\n").text(root)
    lines = open_lines(spark, f"{root}/src=*/*").withColumn("src", F.regexp_extract("path", "src=([0-9]+)", 1).cast("int"))
    return lines.groupBy("src").agg(F.count("*").alias("lines"), F.max("line").alias("last"), F.sum((F.col("line") + 1) * F.char_length("value")).cast("bigint").alias("weight"))


@query("SELECT 'utf-8' AS encoding, 'utf-8' AS stored, count(*) AS lines FROM events")
def file_stats(spark, sf_dir):
    """Encoding and line count of a written file, told from its bytes."""
    root = storage.new_folder(spark, "logs")
    corpora.event_json(spark, sf_dir).select("value").write.option("lineSep", "\n").text(root)
    found = stats(open_lines(spark, f"{root}/part-*"), heads(spark, f"{root}/part-*"))
    return found.groupBy("encoding", "stored").agg(F.sum("lines").cast("bigint").alias("lines"))


# --- search ---


@query(with_parts(DOC_LINES, "SELECT src, line FROM lines WHERE regexp_matches(raw, '(?:th|ou)e[a-z]*[.,]')"))
def search_lines(spark, sf_dir):
    return search.search_lines(corpora.document_lines(spark, sf_dir), "(?:th|ou)e[a-z]*[.,]")


@query(with_parts(DOC_LINES, "SELECT src, CAST(sum(len(regexp_extract_all(raw, '(?:th|ou)e[a-z]*[.,]'))) AS BIGINT) AS total FROM lines GROUP BY src HAVING total > 0"))
def search_total(spark, sf_dir):
    return search.search_total(corpora.document_lines(spark, sf_dir), "(?:th|ou)e[a-z]*[.,]")


@query(with_parts(DOC_LINES, ", h AS (SELECT src, line, row_number() OVER (PARTITION BY src ORDER BY line) AS n FROM lines WHERE regexp_matches(raw, '[Tt]h[a-z]+ing')) SELECT src, line FROM h WHERE n <= 3"))
def search_cap(spark, sf_dir):
    return search.search_lines(corpora.document_lines(spark, sf_dir), "[Tt]h[a-z]+ing", cap=3)


@query("SELECT doc_id AS src, CAST(len(regexp_extract_all(text, '[.]\\s+[A-Z]')) AS BIGINT) AS total FROM documents WHERE total > 0")
def search_whole(spark, sf_dir):
    """A pattern that matches over line ends."""
    return search.search_total(corpora.document_lines(spark, sf_dir), r"[.]\s+[A-Z]")


@query("SELECT doc_id AS src, CAST(len(regexp_extract_all(text, '[a-z]{3}[.]\\n')) AS BIGINT) AS total FROM documents WHERE total > 0")
def search_feeds(spark, sf_dir):
    """A pattern of bounded length with a line feed at its end, which a text's last line may have too."""
    return search.search_total(corpora.document_lines(spark, sf_dir), r"[a-z]{3}[.]\n")


@query("SELECT doc_id AS src, CAST(len(regexp_extract_all(text, '\\p{Lu}\\p{Ll}{2,9}[.]?\\n\\p{Lu}')) AS BIGINT) AS total FROM documents WHERE total > 0")
def search_unicode_feeds(spark, sf_dir):
    """Unicode classes on both sides of a line feed."""
    return search.search_total(corpora.document_lines(spark, sf_dir), r"\p{Lu}\p{Ll}{2,9}[.]?\n\p{Lu}")


@query(with_parts(DOC_LINES, "SELECT src, CAST(sum(len(regexp_extract_all(raw, '\\p{L}+ [Tt]he '))) AS BIGINT) AS total FROM lines GROUP BY src HAVING total > 0"))
def search_unicode(spark, sf_dir):
    """A Unicode class within lines."""
    return search.search_total(corpora.document_lines(spark, sf_dir), r"\p{L}+ [Tt]he ")


# --- encodings, files that grow ---


def _written_files(lines: DataFrame, root: str, codecs: list[str], append: bool = False) -> None:
    """A file ``root/src`` for each source, in the encoding at its number."""
    folder = root.removeprefix("file:")

    def write(batches):
        import os

        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        now, out = None, None
        for batch in batches:
            for src, value in zip(batch["src"], batch["value"], strict=True):
                if src != now:
                    now, out = src, open(f"{folder}/{src}", "ab" if append else "wb")
                out.write((value + "\n").encode(codecs[src]))
            out.flush()
        yield pd.DataFrame({"done": [now is not None]})

    lines.select("src", "line", "value").repartition("src").sortWithinPartitions("src", "line").mapInPandas(write, "done boolean").write.format("noop").mode("overwrite").save()


ENCODED = ["utf-16le", "utf-16be", "gbk", "latin-1"]
_ENCODED_TEXT = "CASE k.src WHEN 2 THEN '错误 ' WHEN 3 THEN 'é ' ELSE '' END || event_type || ' ' || k.line"


def _encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpora.event_log(spark, sf_dir).join(corpora.events(spark, sf_dir).select("event_id", "event_type"), (F.col("line") * 4 + F.col("src")) == F.col("event_id"))
    mark = F.when(F.col("src") == 2, "错误 ").when(F.col("src") == 3, "é ").otherwise("")
    return e.select("src", "line", F.concat(mark, "event_type", F.lit(" "), F.col("line").cast("string")).alias("value"))


@query(with_parts(EVENT_LOG, f", texts AS (SELECT k.src, k.line, {_ENCODED_TEXT} AS value FROM kinds k) SELECT src, CASE src WHEN 0 THEN 'utf-16le' WHEN 1 THEN 'utf-16be' WHEN 2 THEN 'gbk' ELSE 'latin-1' END AS encoding, count(*) AS lines, max(line) AS last, CAST(sum((line + 1) * length(value)) AS BIGINT) AS weight, sum(CASE WHEN contains(value, '错误') OR contains(value, 'é') THEN 1 ELSE 0 END)::BIGINT AS marked FROM texts GROUP BY src"))
def open_encoded(spark, sf_dir):
    """Files in UTF-16 of both orders, GBK and Latin-1, told and read back."""
    root = storage.new_folder(spark, "encoded")
    _written_files(_encoded_lines(spark, sf_dir), root, ENCODED)
    src = F.regexp_extract("path", "([0-9]+)$", 1).cast("int").alias("src")
    lines = open_lines(spark, f"{root}/*").withColumn("src", src)
    told = heads(spark, f"{root}/*").select(src, "encoding")
    marked = F.contains("value", F.lit("错误")) | F.contains("value", F.lit("é"))
    found = lines.groupBy("src").agg(F.count("*").alias("lines"), F.max("line").alias("last"), F.sum((F.col("line") + 1) * F.char_length("value")).cast("bigint").alias("weight"), F.sum(marked.cast("bigint")).alias("marked"))
    return told.join(found, "src").select("src", "encoding", "lines", "last", "weight", "marked")


@query(with_parts(EVENT_LOG, f", texts AS (SELECT k.src, {_ENCODED_TEXT} AS value FROM kinds k WHERE src < 2) SELECT src, CAST(2 * sum(length(value) + 1) AS BIGINT) AS bytes FROM texts GROUP BY src"))
def export_files(spark, sf_dir):
    """The bytes of files as they are, in stretches."""
    root = storage.new_folder(spark, "export")
    _written_files(_encoded_lines(spark, sf_dir).where("src < 2"), root, ENCODED)
    found = export_bytes(spark, f"{root}/*", 10_000)
    return found.groupBy(F.regexp_extract("path", "([0-9]+)$", 1).cast("int").alias("src")).agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


def _followed(spark: SparkSession, sf_dir: str, codecs: list[str]) -> DataFrame:
    """A stream over files of all lines before each source's 1000th but one, which then get the others, after a restart of the stream."""
    lines = _encoded_lines(spark, sf_dir)
    root = storage.new_folder(spark, "grown")
    _written_files(lines.where("line < 1000"), f"{root}/in", codecs)
    paths = [f"{root}/in/{k}" for k in range(4)]

    def follow() -> None:
        q = tail.tail(spark, paths).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    follow()
    _written_files(lines.where("line >= 1000"), f"{root}/in", codecs, append=True)
    follow()
    follow()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{root}/out")
    return rows.withColumn("src", F.regexp_extract("path", "([0-9]+)$", 1).cast("int"))


@query(with_parts(EVENT_LOG, f", texts AS (SELECT k.src, k.line, {_ENCODED_TEXT} AS value FROM kinds k) SELECT src, line, value FROM texts"))
def tail_latest(spark, sf_dir):
    """Lines of files that grow while a stream reads them, in four encodings, with a restart between."""
    changes = _followed(spark, sf_dir, ENCODED)
    return tail.latest(changes).select(F.regexp_extract("path", "([0-9]+)$", 1).cast("int").alias("src"), "line", "value")


@query(with_parts(EVENT_LOG, "SELECT src, count(*) AS given, count(*) AS lines FROM kinds GROUP BY src"))
def tail_given_once(spark, sf_dir):
    """Of files in one-byte line feeds, every line is given once, whatever restarts there are."""
    return _followed(spark, sf_dir, ["utf-8", "utf-8", "gbk", "latin-1"]).groupBy("src").agg(F.count("*").alias("given"), F.countDistinct("line").alias("lines"))


@query(with_parts(EVENT_LOG, f", texts AS (SELECT k.src, k.line, {_ENCODED_TEXT} AS value FROM kinds k) SELECT src, line FROM texts WHERE contains(lower(value), 'click') AND contains(value, '12')"))
def tail_filter(spark, sf_dir):
    """The filter language on what a stream gave."""
    return filters.run_filter(_followed(spark, sf_dir, ["utf-8", "utf-8", "gbk", "latin-1"]), "CLICK 12").select("src", "line")


# --- filters ---

FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(with_parts(DOC_LINES, f"SELECT src, line FROM lines WHERE contains({FOLD.format(c='value')}, 'nthan')"))
def bare_filter(spark, sf_dir):
    return filters.run_filter(corpora.document_lines(spark, sf_dir), "NThan")


@query(with_parts(DOC_LINES, f"SELECT src, line FROM lines WHERE contains({FOLD.format(c='value')}, 'the') AND contains({FOLD.format(c='value')}, 'ing.')"))
def bare_and_filter(spark, sf_dir):
    return filters.run_filter(corpora.document_lines(spark, sf_dir), "the ING.")


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE lower(event_type) = 'click'"))
def flat_eq(spark, sf_dir):
    return filters.run_filter(corpora.event_json(spark, sf_dir), "level=Click")


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE lower(event_type) LIKE 'p%'"))
def flat_prefix(spark, sf_dir):
    return filters.run_filter(corpora.event_json(spark, sf_dir), "level=P*")


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE user_id >= 100"))
def flat_num(spark, sf_dir):
    return filters.run_filter(corpora.event_json(spark, sf_dir), "id>=100")


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE user_id < 500 AND lower(event_type) <> 'x' AND lower(event_type) LIKE 'v%' AND contains(lower(value), 'tags')"))
def flat_and(spark, sf_dir):
    return filters.run_filter(corpora.event_json(spark, sf_dir), "id<500 level=v* TAGS")


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE user_id >= 100 AND line >= 300"))
def filter_from(spark, sf_dir):
    return filters.run_filter_from(corpora.event_json(spark, sf_dir), "id>=100", 300)


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE lower(event_type) = 'click'"))
def filter_known_keys(spark, sf_dir):
    """Keys are spelled as the discovered columns are."""
    lines = corpora.event_json(spark, sf_dir)
    names = [r["name"] for r in sampling.discover_schema(lines).orderBy("ord").collect()]
    return filters.run_filter(lines, "LEVEL=click", names)


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE user_id = 42"))
def dot_path_eq(spark, sf_dir):
    return filters.run_filter(corpora.event_json(spark, sf_dir), "user.id=42")


@query(with_parts(EVENT_JSON, "SELECT src, line FROM lines WHERE user_id > 50 AND lower(event_type) = 'view'"))
def dot_path_num(spark, sf_dir):
    return filters.run_filter(corpora.event_json(spark, sf_dir), "level=VIEW user.id>50")


# --- fields ---


@query(with_parts(EVENT_JSON, "SELECT line, upper(event_type) AS level, CAST(user_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS missing FROM lines"))
def extract_field(spark, sf_dir):
    v = F.col("value")
    fields = {"level": "level", "id": "id", "missing": "absent"}
    return corpora.event_json(spark, sf_dir).select("line", *(jsonfields.extract_field(v, k).alias(n) for n, k in fields.items()))


@query(with_parts(EVENT_JSON, "SELECT line, 'Num' AS ts_kind, CAST(ms AS VARCHAR) AS ts_raw, 'Str' AS level_kind, 'Nested' AS user_kind, CAST(NULL AS VARCHAR) AS id_kind FROM lines"))
def scan_field_kind(spark, sf_dir):
    v = F.col("value")
    scanned = corpora.event_json(spark, sf_dir).select("line", *(jsonfields.scan_field(v, k).alias(k) for k in ("ts", "level", "user", "id")))
    return scanned.select("line", F.col("ts.kind").alias("ts_kind"), F.col("ts.raw").alias("ts_raw"), F.col("level.kind").alias("level_kind"), F.col("user.kind").alias("user_kind"), F.col("id.kind").alias("id_kind"))


@query(with_parts(EVENT_JSON, """SELECT line, CAST(user_id AS VARCHAR) AS id, 'a' AS tag, replace(props, ' ', '') AS props FROM lines"""))
def cell_display(spark, sf_dir):
    v = F.col("value")
    return corpora.event_json(spark, sf_dir).select("line", jsonfields.cell(v, "user", "id").alias("id"), jsonfields.cell(v, "user", "tags", "0").alias("tag"), jsonfields.cell(v, "props").alias("props"))


@query(with_parts(EVENT_JSON, """, rows AS (SELECT line, unnest([
  {'pos': 0, 'depth': 1, 'label': 'user', 'value': '{"id":' || user_id || ',"tags":["a",' || (event_id % 7) || ']}'},
  {'pos': 1, 'depth': 2, 'label': 'id', 'value': CAST(user_id AS VARCHAR)},
  {'pos': 2, 'depth': 2, 'label': 'tags', 'value': '["a",' || (event_id % 7) || ']'},
  {'pos': 3, 'depth': 3, 'label': '[0]', 'value': 'a'},
  {'pos': 4, 'depth': 3, 'label': '[1]', 'value': CAST(event_id % 7 AS VARCHAR)},
  {'pos': 5, 'depth': 1, 'label': 'props', 'value': replace(props, ' ', '')},
  {'pos': 6, 'depth': 2, 'label': json_keys(props)[1], 'value': json_extract_string(props, '$.' || json_keys(props)[1])}]) AS r FROM lines)
SELECT line, r.pos AS pos, r.depth AS depth, r.label AS label, r.value AS value FROM rows"""))
def flatten_rows(spark, sf_dir):
    rows = corpora.event_json(spark, sf_dir).select("line", F.posexplode(jsonfields.flatten(F.col("value"))).alias("pos", "row"))
    return rows.select("line", "pos", "row.depth", "row.label", "row.value")


@query(with_parts(EVENT_JSON, "SELECT line, true AS expandable FROM lines"))
def is_expandable(spark, sf_dir):
    return corpora.event_json(spark, sf_dir).select("line", jsonfields.is_expandable(F.col("value")).alias("expandable"))


@query(with_parts(EVENT_JSON, "SELECT 0 AS src, true AS is_jsonl"))
def jsonl_detect(spark, sf_dir):
    return sampling.detect_jsonl(corpora.event_json(spark, sf_dir))


@query(with_parts(EVENT_JSON, ", s AS (SELECT * FROM lines WHERE line < 512) SELECT 0 AS src, unnest([0, 1, 2, 3]) AS ord, unnest(['ts', 'level', 'user', 'props']) AS name, unnest([(SELECT CAST(greatest(4, max(length(CAST(ms AS VARCHAR)))) AS INTEGER) FROM s), (SELECT CAST(greatest(5, max(length(event_type))) AS INTEGER) FROM s), (SELECT CAST(least(32, max(length('{\"id\":' || user_id || ',\"tags\":[\"a\",' || (event_id % 7) || ']}'))) AS INTEGER) FROM s), (SELECT CAST(least(32, greatest(5, max(length(replace(props, ' ', ''))))) AS INTEGER) FROM s)]) AS width"))
def schema_columns(spark, sf_dir):
    return sampling.discover_schema(corpora.event_json(spark, sf_dir))


# --- timestamps ---


def _log_times(kind: int, column: str) -> str:
    return with_parts(EVENT_LOG, f"SELECT line, CASE WHEN NOT follows THEN {column} END AS ms FROM lines WHERE src = {kind}")


@query(_log_times(0, "ms"))
def ts_iso(spark, sf_dir):
    return corpora.event_log(spark, sf_dir).where("src = 0").select("line", timestamps.parse_iso(F.col("value")).ms.alias("ms"))


@query(_log_times(1, "ms"))
def ts_log4j(spark, sf_dir):
    return corpora.event_log(spark, sf_dir).where("src = 1").select("line", timestamps.parse_log4j(F.col("value")).ms.alias("ms"))


@query(_log_times(2, "CAST(ms // 1000 * 1000 AS BIGINT)"))
def ts_epoch(spark, sf_dir):
    return corpora.event_log(spark, sf_dir).where("src = 2").select("line", timestamps.parse_epoch(F.col("value"), 1000).ms.alias("ms"))


@query(_log_times(3, "ms"))
def ts_epoch_millis(spark, sf_dir):
    return corpora.event_log(spark, sf_dir).where("src = 3").select("line", timestamps.parse_epoch(F.col("value"), 1).ms.alias("ms"))


@query(with_parts(EVENT_LOG, "SELECT src, line, CASE WHEN src < 2 AND line % 10 < 5 THEN ms END AS ms, CASE WHEN src = 0 AND line % 10 < 5 THEN ms END AS strict FROM lines WHERE src < 2"))
def ts_text(spark, sf_dir):
    """Whole texts that are times; those with more after it aren't, nor log4j times unless these are asked for."""
    log = corpora.event_log(spark, sf_dir).where("src < 2")
    stamp = F.when(F.col("line") % 10 < 5, F.regexp_extract("value", "^([0-9T:., Z-]+) [A-Z]", 1)).otherwise(F.col("value"))
    return log.select("src", "line", timestamps.parse_time_text(stamp, fix_log4j=True).alias("ms"), timestamps.parse_time_text(stamp).alias("strict"))


@query(with_parts(EVENT_LOG, "SELECT src, line, CASE WHEN follows THEN NULL WHEN src = 2 THEN CAST(ms // 1000 * 1000 AS BIGINT) ELSE ms END AS ms FROM lines"))
def ts_prefix(spark, sf_dir):
    """Each source's lines by its own format."""
    line, src = F.col("value"), F.col("src")
    kinds = [timestamps.ISO, timestamps.LOG4J, timestamps.EPOCH_SECONDS, timestamps.EPOCH_MILLIS]
    return corpora.event_log(spark, sf_dir).select("src", "line", F.coalesce(*(F.when(src == k, timestamps.parse_prefix(line, kind).ms) for k, kind in enumerate(kinds))).alias("ms"))


@query(with_parts(EVENT_JSON, "SELECT line, ms FROM lines"))
def ts_jsonl(spark, sf_dir):
    return corpora.event_json(spark, sf_dir).select("line", timestamps.parse_jsonl_field(F.col("value"), "ts").alias("ms"))


@query(with_parts(EVENT_LOG, "SELECT src, line, CASE WHEN follows THEN NULL WHEN src = 0 THEN 'iso8601' WHEN src = 1 THEN 'log4j' WHEN src = 2 THEN 'epoch_seconds' ELSE 'epoch_millis' END AS format FROM lines"))
def probe_format(spark, sf_dir):
    return corpora.event_log(spark, sf_dir).select("src", "line", timestamps.probe_format(F.col("value")).alias("format"))


@query(with_parts(EVENT_LOG, "SELECT DISTINCT src, true AS ok, 'log_prefix' AS kind, CASE src WHEN 0 THEN 'iso8601' WHEN 1 THEN 'log4j' WHEN 2 THEN 'epoch_seconds' ELSE 'epoch_millis' END AS arg, CAST(NULL AS VARCHAR) AS failure FROM lines"))
def ts_route(spark, sf_dir):
    return sampling.detect_route(corpora.event_log(spark, sf_dir).drop("ms"))


@query(with_parts(EVENT_JSON, "SELECT 0 AS src, true AS ok, 'jsonl_field' AS kind, 'ts' AS arg, CAST(NULL AS VARCHAR) AS failure"))
def ts_route_jsonl(spark, sf_dir):
    return sampling.detect_route(corpora.event_json(spark, sf_dir))


# --- timelines ---


@query(with_parts(EVENT_LOG, ", known AS (SELECT src, line, CASE WHEN NOT follows THEN CASE WHEN src = 2 THEN ms // 1000 * 1000 ELSE ms END END AS ts FROM lines) SELECT src, line, CAST(coalesce(last_value(ts IGNORE NULLS) OVER (PARTITION BY src ORDER BY line), first_value(ts IGNORE NULLS) OVER (PARTITION BY src ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS ts FROM known"))
def timeline_fill(spark, sf_dir):
    line, src = F.col("value"), F.col("src")
    ts = F.when(src == 0, timestamps.parse_iso(line).ms).when(src == 1, timestamps.parse_log4j(line).ms).when(src == 2, timestamps.parse_epoch(line, 1000).ms).otherwise(timestamps.parse_epoch(line, 1).ms)
    return timeline.extract_timeline(corpora.event_log(spark, sf_dir), ts)


@query(with_parts(EVENT_LOG, ", known AS (SELECT src, line, CASE WHEN NOT follows THEN ms END AS ts FROM lines WHERE src IN (0, 3)) SELECT src, line, ts FROM (SELECT src, line, CAST(last_value(ts IGNORE NULLS) OVER (PARTITION BY src ORDER BY line) AS BIGINT) AS ts FROM known) WHERE line >= 105"))
def timeline_append(spark, sf_dir):
    """Times of new lines after those of a timeline's end."""
    log = corpora.event_log(spark, sf_dir).where("src IN (0, 3)")
    ts = F.when(F.col("src") == 0, timestamps.parse_iso(F.col("value")).ms).otherwise(timestamps.parse_epoch(F.col("value"), 1).ms)
    old = timeline.extract_timeline(log.where("line < 105"), ts)
    return timeline.extract_append(old, log.where("line >= 105"), ts)


@query(with_parts(timelines_sql(False) + "," + MERGED.format(t="tl"), "SELECT pos, ts, src, line FROM merged"))
def merge_sorted(spark, sf_dir):
    return timeline.build_index(corpora.timelines(spark, sf_dir))


@query(with_parts(timelines_sql(True) + "," + MERGED.format(t="tl"), "SELECT pos, ts, src, line FROM merged"))
def merge_out_of_order(spark, sf_dir):
    return timeline.build_index(corpora.timelines(spark, sf_dir, True))


@query(with_parts(timelines_sql(True) + ", seen AS (SELECT * FROM tl WHERE src <> 1)," + MERGED.format(t="seen"), "SELECT pos, ts, src, line FROM merged"))
def merge_masked(spark, sf_dir):
    return timeline.build_index_masked(corpora.timelines(spark, sf_dir, True), [True, False])


@query(with_parts(timelines_sql(True) + ", old AS (SELECT * FROM tl WHERE src <> 2 OR line % 100 < 90)," + MERGED.format(t="old") + """,
suffix AS (SELECT pos, ts, src, line, min(row(ts, src, line)) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k, 0 AS fresh FROM merged),
every AS (SELECT * FROM suffix UNION ALL SELECT 0, ts, src, line, row(ts, src, line), 1 FROM tl WHERE src = 2 AND line % 100 >= 90)""", "SELECT CAST(row_number() OVER (ORDER BY k, fresh, pos) - 1 AS BIGINT) AS pos, ts, src, line FROM every"))
def merge_insert(spark, sf_dir):
    every = corpora.timelines(spark, sf_dir, True)
    held_back = (F.col("src") == 2) & (F.col("line") % 100 >= 90)
    return timeline.insert_rows(timeline.build_index(every.where(~held_back)), every.where(held_back))


@query(with_parts(timelines_sql(True) + "," + MERGED.format(t="tl"), "SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, ts, src, line FROM merged WHERE NOT (src = 1 AND line = 5)"))
def merge_remove(spark, sf_dir):
    return timeline.remove_row(timeline.build_index(corpora.timelines(spark, sf_dir, True)), 1, 5)


@query(with_parts(timelines_sql(True) + "," + MERGED.format(t="tl"), "SELECT pos, ts, src, line FROM merged WHERE pos >= 100 AND pos < 400"))
def merge_rows(spark, sf_dir):
    return timeline.rows_between(timeline.build_index(corpora.timelines(spark, sf_dir, True)), 100, 400)


@query("SELECT 'there' AS asked, true AS held UNION ALL SELECT 'not there', false")
def merge_holds(spark, sf_dir):
    """Whether removing a row would remove one."""
    index = storage.stored(timeline.build_index(corpora.timelines(spark, sf_dir, True)))
    told = [timeline.holds_row(index, src, line).select(F.lit(asked).alias("asked"), "held") for asked, src, line in (("there", 1, 5), ("not there", 1, -5))]
    return told[0].unionByName(told[1])


@query("SELECT count(*) AS rows, 16 * count(*) AS index_bytes, 8 * count(*) AS ts_bytes FROM events")
def merge_size(spark, sf_dir):
    return timeline.index_size(timeline.build_index(corpora.timelines(spark, sf_dir)))


@query(with_parts(DOC_LINES, f"SELECT src, line, {FOLD.format(c='value')} = 'of.' AS equal FROM lines WHERE starts_with({FOLD.format(c='value')}, 'of')"))
def prefix_fold(spark, sf_dir):
    v = F.col("value")
    return corpora.document_lines(spark, sf_dir).where(tokens.matches(v, Op.PREFIX, "OF")).select("src", "line", tokens.matches(v, Op.EQ, "oF.").alias("equal"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold two words."""
    return bare_and_filter(spark, sf_dir)
