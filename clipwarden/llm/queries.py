"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, curriculum, decontaminate, divergence, extraction, licenses, line_dedup, maxscore, quality, repeats, simhash, token_files, tool_calls


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT p.doc_id, p.s, p.n, k.item FROM places p JOIN windows k ON p.phrase = k.phrase AND p.n = k.n),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM (SELECT DISTINCT doc_id, s, n FROM hits)),
hit_counts AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
contamination AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
  FROM d LEFT JOIN hit_counts USING (doc_id) LEFT JOIN named USING (doc_id))
"""


@query("op1_decontaminate", CONTAMINATION_SQL.format(docs="documents") + "SELECT * FROM contamination")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rk")


@query(
    "op2_line_dedup",
    r"""
WITH v AS (
  SELECT page_id,
    regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS host,
    regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style|head)\b.*?</(script|style|head)>', chr(10), 'g') AS h
  FROM pages),
p AS (
  SELECT page_id, host, list_filter(list_transform(
    string_split_regex(h, '(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|table|tr|td|th|br|hr|body|html|blockquote|pre)\b[^>]*>|[\r\n]+'),
    lambda x: regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '^[ \t]+|[ \t]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM v),
totals AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
common AS (SELECT host, list(line) AS drop FROM seen JOIN totals USING (host)
  WHERE n >= 2 AND host_pages >= 3 AND n > 0.3 * host_pages GROUP BY host),
k AS (SELECT page_id, host, host_pages, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(drop, x), FALSE)) AS kept
  FROM p JOIN totals USING (host) LEFT JOIN common USING (host))
SELECT page_id, host, host_pages, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = line_dedup.drop_site_lines(pages, line_dedup.url_host(F.col("url")), line_dedup.html_lines(F.col("html")))
    return found.select(
        "page_id", "host", "host_pages", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256")
    )


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), tokenizer_file())


def document_path() -> "F.Column":
    """The documents as a tree: source, language, thousands; every fifth is a licence file of its folder."""
    number = F.col("doc_id")
    top, lang = F.concat(F.lit("/"), F.coalesce("source", F.lit("_"))), F.concat(F.lit("/"), F.coalesce("lang", F.lit("_")))
    folder = F.when(number % 3 == 0, top).when(number % 3 == 1, F.concat(top, lang)).otherwise(
        F.concat(top, lang, F.lit("/"), F.floor(number / 1000).cast("string"))
    )
    name = F.when(number % 5 == 0, F.lit("/LICENSE-")).otherwise(F.lit("/text-"))
    return F.concat(folder, name, number.cast("string"))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents").withColumn("path", document_path()))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality.grade_documents(docs, model)


@query(
    "op6_drop_repeats",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
first AS (SELECT phrase, min(doc_id) AS low FROM spots GROUP BY phrase HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (
  SELECT doc_id, unnest(range(s, s + 13)) AS p FROM spots JOIN first USING (phrase) WHERE low < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
  sha256(CASE WHEN len(places) = 0 THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256 FROM k
""",
)
def op6_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", repeats.removed_words(F.col("removed")).alias("n_removed"),
        F.sha2(F.array_join("kept_words", " "), 256).alias("kept_sha256"),
    )


TOOLS = {
    "configure": {"prompt": ("string", True)},
    "search": {"first": ("boolean", False), "length": ("integer", True), "text": ("string", True)},
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of people as tool calls, the turn of the assistant after one as its result.

    A call waits for the call at half its turn.  Every fourth turn gives its
    length as a fraction, which the schema rejects.
    """
    base = turns.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("text"))
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    size = F.length(F.coalesce("text", F.lit("")))
    length = F.when(F.col("turn") % 4 == 2, F.concat(size.cast("string"), F.lit(".5"))).otherwise(size.cast("string"))
    quoted = F.coalesce(tool_calls._json_string("text"), F.lit("null"))
    search = F.concat(
        F.lit('{"text": '), quoted, F.lit(', "length": '), length, F.lit(', "first": '), (F.col("turn") == 0).cast("string"), F.lit("}")
    )
    calls = base.filter(F.col("role") != "assistant").select(
        "conv", name(F.col("turn")).alias("call"), "turn",
        F.when(F.col("role") == "user", "search").when(F.col("role") == "system", "configure").otherwise(F.col("role")).alias("tool"),
        F.when(F.col("role") == "system", F.concat(F.lit('{"prompt": '), quoted, F.lit("}"))).otherwise(search).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(name(F.floor(F.col("turn") / 2)))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = base.filter(F.col("role") == "assistant").select(
        "conv", name(F.col("turn") - 1).alias("call"), "turn", F.col("text").alias("content")
    )
    return calls, results


@query(
    "op7_tool_calls",
    r"""
WITH RECURSIVE c AS (
  SELECT conv_id AS conv, 'c' || turn AS call, turn, CASE role WHEN 'user' THEN 'search' WHEN 'system' THEN 'configure' ELSE coalesce(role, '') END AS tool,
    CASE WHEN role = 'system' THEN '{"prompt":' || coalesce(to_json(text), 'null') || '}'
      ELSE '{"first":' || (turn = 0) || ',"length":' || length(coalesce(text, '')) || CASE WHEN turn % 4 = 2 THEN '.5' ELSE '' END
        || ',"text":' || coalesce(to_json(text), 'null') || '}' END AS arguments, text,
    count(*) OVER (PARTITION BY conv_id, turn) AS n_calls
  FROM conversations WHERE coalesce(role, '') <> 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY tool, coalesce(CAST(to_json(text) AS VARCHAR), 'null')) = 1),
r AS (SELECT conv_id AS conv, 'c' || (turn - 1) AS call, min(turn) AS turn, arg_min(text, text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
levels AS (
  SELECT a.conv, a.turn, 0 AS level FROM c a LEFT JOIN c b ON a.conv = b.conv AND b.turn = a.turn // 2 AND a.turn > 0 WHERE b.turn IS NULL
  UNION ALL SELECT a.conv, a.turn, l.level + 1 FROM levels l JOIN c a ON a.conv = l.conv AND a.turn // 2 = l.turn AND a.turn > 0),
p AS (SELECT *, list_concat(CASE tool
    WHEN 'configure' THEN CASE WHEN text IS NULL THEN ['prompt: not string'] ELSE [] END
    WHEN 'search' THEN list_concat(CASE WHEN turn % 4 = 2 THEN ['length: not integer'] ELSE [] END,
      CASE WHEN text IS NULL THEN ['text: not string'] ELSE [] END) ELSE ['unknown tool'] END,
    CASE WHEN n_calls > 1 THEN ['repeated call'] ELSE [] END) AS problems FROM c),
linked AS (
  SELECT coalesce(p.conv, r.conv) AS conv, coalesce(p.call, r.call) AS call, coalesce(p.turn, r.turn) AS turn, tool, level,
    CASE WHEN p.call IS NULL THEN ['no call'] ELSE problems END AS problems, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
    '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(coalesce(p.call, r.call)) || ',"name":' || coalesce(to_json(tool), 'null')
      || ',"result":' || coalesce(to_json(content), 'null') || '}' AS json
  FROM (SELECT * FROM p JOIN levels USING (conv, turn)) p FULL JOIN r ON r.conv = p.conv AND r.call = p.call)
SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY coalesce(level, 2147483647), turn, call) - 1 AS position, call, tool, level,
  len(problems) = 0 AS valid, problems, n_calls, n_results, json
FROM linked
""",
)
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    return tool_calls.format_calls(calls, results, TOOLS)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query(
    "op9_top_k",
    """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN e c ON c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
)
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_mixture")
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "positions"
    )


@query(
    "op11_source_divergence",
    r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, count(*) AS v, sum(n) AS total FROM v GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(o.n) FILTER (v.term IS NOT NULL), 0) AS total FROM g LEFT JOIN o USING (lang, source)
  LEFT JOIN v ON v.lang = o.lang AND v.term = o.term GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM v JOIN kept USING (lang)),
p AS (SELECT t.lang, t.source, v.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (t.total + 5 * kept.v) AS p
  FROM totals t JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN o ON o.lang = t.lang AND o.source = t.source AND o.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
more AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM more)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
""",
)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_file(), piece_file())


@query("op13_html_text")
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))
