"""Registered document-ETL queries: sections, chunks, HTML, mail, slugs, hashes, timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markup, scoring, text
from gleaner.runtime import read, spread


def _exploded(rows: DataFrame, key: str, chunks: Column) -> DataFrame:
    """(key, chunk_index, content_hash, n_chars) of an array of texts."""
    out = rows.select(key, F.posexplode(chunks).alias("chunk_index", "content"))
    return out.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), text.sha256(F.col("content")).alias("content_hash"), F.length("content").cast("long").alias("n_chars"))


def _headed() -> Column:
    """A document with headings: one at its start and one for each of its lines but the first."""
    return F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n## Part\n")))


def _spaced() -> Column:
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


def split_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id", F.posexplode(text.sections(_headed())).alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), F.col("s.heading").alias("heading"), text.sha256(F.col("s.content")).alias("content_hash"))


def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")), "doc_id", text.sentence_chunks(F.col("text")))


def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")), "doc_id", text.paragraph_chunks(_spaced()))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole chunking: title, sections, paragraphs, the least length and the context prefix."""
    raw = F.concat(F.lit("---\nsource: "), F.col("source"), F.lit("\n---\n"), _headed())
    rows = spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id", text.frontmatter_parts(raw).alias("p"))
    rows = rows.select("doc_id", F.posexplode(text.document_chunks(text.title(F.lit(None).cast("string"), F.col("p.body")), F.col("p.body"))).alias("chunk_index", "c"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "c.section_context", text.sha256(F.col("c.content")).alias("content_hash"))


def frontmatter_split(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"), F.lit("\n---\n\n"), F.col("text")))
    rows = spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id", text.frontmatter_parts(raw).alias("p"))
    return rows.select("doc_id", F.col("p.yaml").alias("yaml"), text.sha256(F.col("p.body")).alias("body_hash"))


def document_title(spark: SparkSession, d: str) -> DataFrame:
    meta = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.lit("").alias("title"), F.col("source").alias("name")))).when(F.col("doc_id") % 4 == 1, F.to_json(F.struct(F.col("source").alias("identifier"))))
    return spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id", text.title(meta, _headed()).alias("title"))


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    clean = markup.strip_html(F.col("html"))
    return spread(read(spark, d, "pages").select("page_id", "html")).select("page_id", markup.is_html(F.col("html")).alias("is_html"), text.sha256(clean).alias("text_hash"), F.length(clean).cast("long").alias("n_chars"))


def _quoted() -> Column:
    return F.when(F.col("turn") % 3 == 1, F.concat(F.lit("> earlier words\n"), F.col("text"), F.lit("\nOn Mon, Jan 1, 2024 someone wrote:\n> gone\ngone too"))).otherwise(F.concat(F.col("text"), F.lit("\n  > one quoted line\nend")))


def strip_quotes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.sha256(markup.remove_quoted_replies(_quoted())).alias("text_hash"))


def mail_thread_split(spark: SparkSession, d: str) -> DataFrame:
    """Threads rendered as mail, split into messages and parsed again."""
    block = F.concat(F.lit("**From:** "), F.col("role"), F.lit("  \n**Date:** 2024-01-0"), (F.col("turn") + 1).cast("string"), F.lit("\n\n"), F.col("text"))
    bodies = read(spark, d, "conversations").select("conv_id", "turn", block.alias("block")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n---\n").alias("body"))
    parts = bodies.select("conv_id", F.posexplode(markup.thread_messages(F.col("body"))).alias("message", "part")).withColumn("m", markup.message_block(F.col("part")))
    return parts.select("conv_id", F.col("message").cast("long").alias("message"), F.col("m.from").alias("sender"), F.col("m.date").alias("date"), text.sha256(F.col("m.body")).alias("body_hash"))


def mail_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = markup.message_chunks(_spaced(), F.concat(F.lit("Note "), F.col("doc_id").cast("string")), F.col("source"), F.lit("2024-01-05"))
    rows = spread(read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")).select("doc_id", F.posexplode(chunks).alias("chunk_index", "c"))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "c.section_context", text.sha256(F.col("c.content")).alias("content_hash"))


def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.chunk_hash(F.col("text"), "model").alias("chunk_hash"))


def timestamp_priority(spark: SparkSession, d: str) -> DataFrame:
    """Seconds, milliseconds, ISO, dates, mail dates and unparseable ones, by field priority, with the file's time behind."""
    k, stamp = F.col("event_id") % 7, F.col("ts").cast("timestamp")
    meta = (
        F.when(k == 0, F.to_json(F.struct(F.date_format(stamp, "yyyy-MM-dd").alias("date"))))
        .when(k == 1, F.to_json(F.struct(F.unix_seconds(stamp).alias("createdAt"), F.lit("2020-01-01").alias("date"))))
        .when(k == 2, F.to_json(F.struct(F.unix_millis(stamp).alias("updated_at"))))
        .when(k == 3, F.to_json(F.struct(F.lit("not a time").alias("updatedAt"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))))
        .when(k == 4, F.to_json(F.struct(F.concat(F.lit("Mon, "), F.date_format(stamp, "d MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("date"))))
        .when(k == 5, F.to_json(F.struct(F.lit("2019-06-01T00:00:00Z").alias("last-reviewed"))))
    )
    return read(spark, d, "events").select("event_id", scoring.content_timestamp(meta, F.col("value") * 1000.0).alias("content_timestamp_ms"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_type", F.lit("_X!"))).alias("slug"))


def unique_slug(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.unique_slug(F.col("p_name"), F.concat(F.lit("ab-cd-"), F.col("p_partkey").cast("string"), F.lit("-xyz"))).alias("slug"))


def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.sanitize_filename(F.concat("p_brand", F.lit(':*"'), "p_name", F.lit(" \t/x"))).alias("filename"))


def relative_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/data/mirror/").otherwise("/else/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return read(spark, d, "part").select("p_partkey", text.relative_path(F.lit("/data/mirror"), path).alias("relative_path"))


def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.format_bytes(F.col("n_chars") * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(700)).alias("size"))


QUERIES = {f.__name__: f for f in (split_sections, chunk_sentences, chunk_paragraphs, chunk_documents, frontmatter_split, document_title, strip_html, strip_quotes, mail_thread_split, mail_chunks, chunk_hash, timestamp_priority, slugify, unique_slug, sanitize_filename, relative_path, format_bytes)}


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sentence_chunks(x: str) -> str:
    sentences = rf"list_filter(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_trim('s')} <> '')"
    fold = f"""list_reduce(list_transform({sentences}, lambda s: {{'o': []::VARCHAR[], 'b': s}}),
        lambda acc, e: CASE WHEN length(acc.b) + length(e.b) > 1500 AND {_trim('acc.b')} <> '' THEN {{'o': list_append(acc.o, {_trim('acc.b')}), 'b': right(acc.b, 200) || e.b}}
            ELSE {{'o': acc.o, 'b': acc.b || CASE WHEN acc.b = '' THEN '' ELSE ' ' END || e.b}} END, {{'o': []::VARCHAR[], 'b': ''}})"""
    return f"list_transform([{fold}], lambda r: list_concat(r.o, CASE WHEN {_trim('r.b')} = '' THEN []::VARCHAR[] ELSE [{_trim('r.b')}] END))[1]"


def _paragraph_chunks(x: str) -> str:
    flush = lambda a: f"list_concat({a}.o, CASE WHEN {_trim(a + '.b')} = '' THEN []::VARCHAR[] ELSE [{_trim(a + '.b')}] END)"
    paragraphs = rf"list_filter(regexp_split_to_array({x}, '\n\n+'), lambda p: {_trim('p')} <> '')"
    fold = f"""list_reduce(list_transform({paragraphs}, lambda p: {{'o': []::VARCHAR[], 'b': p}}),
        lambda a, e: CASE WHEN length(e.b) > 2000 THEN {{'o': list_concat({flush('a')}, {_sentence_chunks('e.b')}), 'b': ''}}
            WHEN length(a.b) + length(e.b) + 2 > 1500 THEN {{'o': {flush('a')}, 'b': e.b}}
            ELSE {{'o': a.o, 'b': a.b || CASE WHEN a.b = '' THEN '' ELSE chr(10) || chr(10) END || e.b}} END, {{'o': []::VARCHAR[], 'b': ''}})"""
    return f"list_transform([{fold}], lambda q: {flush('q')})[1]"


_HEADED = "'# Doc ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## Part' || chr(10))"
_SPACED = "replace(text, chr(10), chr(10) || chr(10))"
_SECTIONS = rf"""
    lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM (SELECT doc_id, {_HEADED} AS t FROM documents)),
    marked AS (SELECT *, regexp_matches(line, '^#{{1,4}}\s+.+$') AS h FROM lines),
    counted AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM marked),
    grouped AS (
        SELECT doc_id, sec, max(CASE WHEN h THEN {_trim("regexp_extract(line, '^#{1,4}\\s+(.+)$', 1)")} END) AS heading, {_trim("string_agg(CASE WHEN NOT h THEN line END, chr(10) ORDER BY pos)")} AS content
        FROM counted GROUP BY doc_id, sec
    ),
    sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section, heading, content FROM grouped WHERE content <> '')"""


def _chunk_rows(expression: str) -> str:
    return f"WITH c AS (SELECT doc_id, {expression} AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS content, unnest(range(len(x))) AS chunk_index FROM c) SELECT doc_id, chunk_index, sha256(content) AS content_hash, length(content)::BIGINT AS n_chars FROM u"


_CLEAN_HTML = "html"
for _pattern, _with in (
    ("(?s)<!--.*?-->", "''"), ("(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>", "''"), (r"(?i)<br\s*/?>", "chr(10)"), ("(?i)</(p|div|h[1-6]|li|tr|blockquote)>", "chr(10)"), ("<[^>]+>", "''"),
    ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&nbsp;", "' '"), (r"&\w+;", "''"), ("[ \\t]+", "' '"), ("\\n[ \\t]+", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"),
):
    _CLEAN_HTML = f"regexp_replace({_CLEAN_HTML}, '{_pattern}', {_with}, 'g')"
_CLEAN_HTML = _trim(_CLEAN_HTML)

_UNQUOTED = f"""
    raw AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '> earlier words' || chr(10) || text || chr(10) || 'On Mon, Jan 1, 2024 someone wrote:' || chr(10) || '> gone' || chr(10) || 'gone too'
        ELSE text || chr(10) || '  > one quoted line' || chr(10) || 'end' END AS t FROM conversations),
    kept AS (SELECT conv_id, turn, list_filter(string_split(t, chr(10)), lambda x: NOT starts_with({_trim('x')}, '>')) AS w FROM raw),
    stops AS (SELECT *, list_position(list_transform(w, lambda x: regexp_matches({_trim('x')}, '(?i)^On .+wrote:\\s*$')), true) AS p FROM kept)"""
_SLUG = "regexp_replace(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), {}), '-+$', ''), '^$', '')"

SQL = {
    "split_sections": f"WITH {_SECTIONS} SELECT doc_id, section, heading, sha256(content) AS content_hash FROM sections",
    "chunk_sentences": _chunk_rows(_sentence_chunks("text")),
    "chunk_paragraphs": _chunk_rows(_paragraph_chunks(_SPACED)),
    "chunk_documents": f"""
        WITH {_SECTIONS},
        chunks AS (SELECT doc_id, section, 'Doc ' || doc_id || CASE WHEN coalesce(heading, '') = '' THEN '' ELSE ' § ' || heading END AS section_context, {_paragraph_chunks('content')} AS x FROM sections),
        each_ AS (SELECT doc_id, section, section_context, unnest(x) AS c, unnest(range(len(x))) AS i FROM chunks)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, i) - 1 AS chunk_index, section_context, sha256('[' || section_context || '] ' || c) AS content_hash
        FROM each_ WHERE length({_trim('c')}) >= 80""",
    "frontmatter_split": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'lang: ' || lang || chr(10) || 'source: ' || source END AS yaml, CASE WHEN doc_id % 3 <> 0 THEN sha256(chr(10) || text) ELSE sha256(text) END AS body_hash FROM documents",
    "document_title": "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN source ELSE 'Doc ' || doc_id END AS title FROM documents",
    "strip_html": f"SELECT page_id, regexp_matches(html, '(?i)<(!DOCTYPE|html|head|body|div|span|table|a\\s|br|img)\\b') AS is_html, sha256({_CLEAN_HTML}) AS text_hash, length({_CLEAN_HTML})::BIGINT AS n_chars FROM pages",
    "strip_quotes": f"WITH {_UNQUOTED} SELECT conv_id, turn, sha256({_trim('array_to_string(CASE WHEN p > 0 THEN w[1:p - 1] ELSE w END, chr(10))')}) AS text_hash FROM stops",
    "mail_thread_split": f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message, role AS sender, '2024-01-0' || (turn + 1) AS date, sha256({_trim('text')}) AS body_hash FROM conversations",
    "mail_chunks": f"""
        WITH clean AS (SELECT doc_id, {_trim("array_to_string(list_filter(string_split(" + _SPACED + ", chr(10)), lambda x: NOT starts_with(" + _trim('x') + ", '>')), chr(10))")} AS t, 'Note ' || doc_id || ' § ' || source || ' @ 2024-01-05' AS ctx FROM documents),
        parts AS (SELECT doc_id, t, ctx, {_paragraph_chunks('t')} AS x FROM clean WHERE length(t) > 1500),
        each_ AS (SELECT doc_id, CASE WHEN len(x) > 1 THEN ctx || ' (part ' || i || ')' ELSE ctx END AS section_context, c, i FROM (SELECT *, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS i FROM parts)),
        every AS (SELECT doc_id, section_context, c, i FROM each_ WHERE length({_trim('c')}) >= 80 UNION ALL SELECT doc_id, ctx, t, 1 FROM clean WHERE length(t) BETWEEN 80 AND 1500)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, section_context, sha256('[' || section_context || ']' || chr(10) || c) AS content_hash FROM every""",
    "chunk_hash": "SELECT doc_id, sha256(text || chr(0) || 'model') AS chunk_hash FROM documents",
    "timestamp_priority": """
        SELECT event_id, (CASE event_id % 7 WHEN 0 THEN epoch_ms(date_trunc('day', ts)) WHEN 2 THEN epoch_us(ts) // 1000 WHEN 5 THEN 1559347200000 WHEN 6 THEN floor(value * 1000)
            ELSE epoch_ms(date_trunc('second', ts)) END)::BIGINT AS content_timestamp_ms FROM events""",
    "unique_slug": f"SELECT p_partkey, {_SLUG.format('p_name', 71)} || '-' || left('abcd' || p_partkey || 'xyz', 8) AS slug FROM part",
    "sanitize_filename": "SELECT p_partkey, left(regexp_replace(regexp_replace(p_brand || ':*\"' || p_name || ' ' || chr(9) || '/x', '[/\\\\:*?\"<>|]', '_', 'g'), '\\s+', '_', 'g'), 200) AS filename FROM part",
    "relative_path": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/' || p_partkey || '.md' ELSE '/else/' || p_brand || '/' || p_partkey || '.md' END AS relative_path FROM part",
    "format_bytes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 102.4::DOUBLE + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 104857.6::DOUBLE + 0.5) / 10) END AS size FROM (SELECT doc_id, n_chars * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 700 END AS n FROM documents)",
}
SQL["slugify"] = "SELECT p_partkey, " + _SLUG.format("p_name || ' / ' || p_type || '_X!'", 80) + " AS slug FROM part"
