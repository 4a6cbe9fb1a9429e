"""The operators' queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import bpe, extract, kdsearch, licenses, neardup, packing, quality, spelling, surrogates, toxicity, warc, whitening, winnowing

#: The key of the surrogates in the query and the pipeline; a production run passes its own.
SURROGATE_KEY = "tidewake"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.neighbour_likeness(_table(spark, sf_dir, "documents"))


def op2_kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdsearch.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, rows = quality.train_and_rows(docs, _table(spark, sf_dir, "labels"))
    return quality.score_rows(rows, model)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, scored = toxicity.train_and_score(docs, _table(spark, sf_dir, "labels"))
    return toxicity.graded(scored, model)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, length=2048).drop("ids")


def op11_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(_table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min({'n': len(v), 'v': v}).v AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def _warc_sql() -> str:
    def lit(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def sub(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {lit(pattern)}, {by}, 'g')"

    def unescaped(text: str) -> str:
        """References found by their form, looked up by name or made from their number, and put back between the other parts."""
        form = lit(r"&(#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[[:alpha:]][[:alnum:]]{1,31});")
        names = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in warc.NAMED.items()) + "}"
        code = "CASE WHEN r[2:3] IN ('#x', '#X') THEN CAST('0x' || r[4:-2] AS INTEGER) WHEN r[2] = '#' THEN CAST(r[3:-2] AS INTEGER) END"
        char = f"CASE WHEN ({code}) IS NULL THEN {names}[r[2:-2]] WHEN ({code}) = 160 THEN ' ' WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) END"
        made = f"list_transform(regexp_extract_all({text}, {form}), lambda r: coalesce({char}, r))"
        return f"array_to_string(list_transform(list_zip(string_split_regex({text}, {form}), {made}), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), '')"

    def squeezed(text: str) -> str:
        return sub(sub(sub(text, r"[ \t\r\f]+", "' '"), r" ?\n[ \n]*", "chr(10)"), r"^[ \n]+|[ \n]+$", "''")

    def urn(text: str) -> str:
        h = f"sha256({text})"
        return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"

    crlf = "chr(13) || chr(10)"
    # The rules of the markup, written apart from the operator's.
    gone = "(?is)" + "".join(rf"<{t}\b[^>]*(?:>.*?(?:</{t}\s*>|\z)|\z)|" for t in ("script", "style", "noscript", "template")) + r"<!--.*?(?:-->|\z)"
    ends = r"(?i)<(?:br|hr|/(?:p|div|li|h[1-6]|tr|article|section|title|table|ul|ol))\b[^>]*(?:>|\z)"
    tag = r"(?s)<[/!?a-zA-Z][^>]*(?:>|\z)"
    plain = squeezed(unescaped(sub(sub(sub("html", gone, "' '"), ends, "chr(10)"), tag, "''")))
    title = squeezed(unescaped(sub(r"regexp_extract(html, '(?is)<title[^>]*(?:>(.*?)(?:</title|\z)|\z)', 1)", tag, "''")))
    links = "regexp_extract_all(html, " + lit(r"(?i)<a\s[^<>]*?href=[\"']([^\"'<>\s]+)[\"']") + ", 1)"
    language = "lower(regexp_extract(regexp_extract(html, " + lit(r"(?is)\A.*?<html\b([^>]*)") + ", 1), " + lit(r"(?i)\blang=[\"']?([a-z-]+)") + ", 1))"
    fields = (
        f"'http-status-line: HTTP/1.1 200 OK' || {crlf} || 'http-header-content-type: text/html; charset=utf-8' || {crlf} || 'http-header-content-length: ' || strlen(html) || {crlf} || 'title: ' || {title} || {crlf} || 'language: ' || "
        f"{language} || {crlf} || 'outlinks: ' || len({links}) || {crlf} || array_to_string(list_transform({links}, lambda x: 'outlink: ' || x || {crlf}), '')"
    )
    line = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
            ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    header = f"'WARC/1.1' || {crlf} || " + " || ".join(f"coalesce('{k}: ' || {c} || {crlf}, '')" for k, c in line) + f" || {crlf}"
    return f"""
WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS html, {urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to FROM pages),
b AS (SELECT page_id, target_uri, refers_to, 'sha256:' || sha256(html) AS source_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {fields} AS block FROM p
  UNION ALL SELECT page_id, target_uri, refers_to, 'sha256:' || sha256(html), 'conversion', 'text/plain; charset=utf-8', {plain} FROM p),
r AS (SELECT *, '2024-01-01T00:00:00Z' AS date, {urn("warc_type || '|' || refers_to")} AS record_id, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM b)
SELECT page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest, source_digest, block, {header} AS header FROM r
"""


def _pages_sql() -> str:
    """The article of pages whose markup names it, by its tags alone; what the operator finds in such pages by their text's density."""
    form = r"'&(#[0-9]+;|[a-z]+;|amp|quot|lt|gt)'"
    names = "MAP {'amp': '&', 'quot': chr(34), 'lt': '<', 'gt': '>', 'copy': chr(169), 'middot': chr(183), 'nbsp': chr(160)}"
    char = f"CASE WHEN r[2] = '#' THEN chr(CAST(rtrim(r[3:], ';') AS INTEGER)) ELSE coalesce({names}[rtrim(r[2:], ';')], r) END"
    made = f"list_transform(regexp_extract_all(x, {form}), lambda r: {char})"
    plain = f"array_to_string(list_transform(list_zip(string_split_regex(x, {form}), {made}), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), '')"
    blocks = "string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>')"
    lines = f"list_transform(list_transform({blocks}, lambda b: regexp_replace(b, '(?s)<[^>]*>', ' ', 'g')), lambda x: trim(regexp_replace({plain}, '\\s+', ' ', 'g')))"
    return f"SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10)) AS text FROM pages)"


def _spelling_sql() -> str:
    """Words by the rule, near words by the strings that one deletion leaves, roots by recursion."""
    table = []
    for i in range(256):  # the rule of the reflected polynomial
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    low = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+')) AS run FROM documents WHERE text IS NOT NULL),
lower_runs AS (SELECT id, {low} AS run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, k, hex(encode(id || ':' || run)) AS x FROM lower_runs),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, CAST({table}[(xor(c, b) & 255) + 1] AS BIGINT)), CAST(4294967295 AS BIGINT))) AS h FROM coded),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, CAST(unnest(range(0, length(word))) AS INTEGER) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word FROM words a JOIN cut b ON a.word = b.rest UNION SELECT b.word, a.word FROM words a JOIN cut b ON a.word = b.rest),
near AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS best FROM pairs JOIN words ON word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM words LEFT JOIN near USING (word)),
way AS (SELECT word, word AS seen, 0 AS step FROM forms UNION ALL SELECT way.word, forms.form, step + 1 FROM way JOIN forms ON forms.word = way.seen WHERE forms.form IS NOT NULL),
roots AS (SELECT word, max_by(seen, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def oracle_sql() -> dict[str, str]:
    """The others need trained models, tokens, eigenvectors or paths through links. Tests hold them against brute force; the trained
    ones by held-out labels."""
    return {"op2_kd_topk": _TOP_K, "op8_warc_derivatives": _warc_sql(), "op11_text_density": _pages_sql(), "op13_spelling_variants": _spelling_sql()}
