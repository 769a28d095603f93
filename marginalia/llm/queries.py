"""The registered queries of the training-data operators and their SQL.

Each query applies an operator with production parameters to its whole table
and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, decontaminate, license, negatives, pack, pii, quality, reputation, resample, secrets, simhash, tokens, warc
from .common import new_path, ship, table
from .spans import render

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as WARC archives and read them back by byte range."""
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: base kinds and those the trained span classifier accepts."""
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id", *[_count(base, k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(render(base), 256).alias("base_sha256"), render(F.col("spans")).alias("spans")
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets over a fresh blob ledger."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), new_path(spark, "op3-ledger"))
    kinds = [r.name for r in secrets.BASE_RULES]
    base = F.filter("findings", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[_count(base, k).alias(f"n_{k}") for k in kinds], F.sha2(render(base), 256).alias("base_sha256"), render(F.col("findings")).alias("spans")
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in documents, by winnowing."""
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 1024 tokens."""
    return pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of all documents."""
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered"
    )


def op8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that several documents hold, by content-defined chunks."""
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a fresh digest cache."""
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), new_path(spark, "op9-cache"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return license.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's distribution of words."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Verdict and rule (host/path) of op12.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls; a page's outcome is that of the document whose number ends its path."""
    toxic, poor = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    outcomes = table(spark, sf_dir, "labels").filter("toxic is not null or quality is not null").select(F.col("doc_id").alias("key"), (toxic | poor).alias("bad"))
    key = F.regexp_extract(reputation.path_of(F.col("url")), r"/([0-9]+)[^/]*/?\z", 1).try_cast("long")
    found = reputation.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, key=key)
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_least", 6).alias("bad_least"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    query.__doc__ = f.__doc__
    return query


QUERIES = {f.__name__: _shipped(f) for f in (op1_warc, op2_pii, op3_secrets, op4_decontaminate, op5_pack, op6_simhash, op7_quality, op8_chunks, op9_tokens, op10_license, op11_resample, op12_urls, op13_negatives)}

def _windows_twice(k: int) -> str:
    """Starts of k-word windows that a document holds twice or more."""
    return (
        f"t{k} AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, s, hash(array_to_string(w[s : s + {k - 1}], ' ')) AS h "
        f"FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k} + 2)) AS s FROM d WHERE len(w) >= {k}))) WHERE c > 1)"
    )


def _words_in(k: int) -> str:
    return f"c{k} AS (SELECT doc_id, count(DISTINCT p) AS n{k} FROM (SELECT doc_id, unnest(range(s, s + {k})) AS p FROM t{k}) GROUP BY doc_id)"


ORACLE: dict[str, str] = {
    # the longest repeat is over 50 words if a window of 51 occurs twice
    "op7_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{_windows_twice(5)}, {_words_in(5)}, {_windows_twice(3)}, {_words_in(3)}, {_windows_twice(51)}, long AS (SELECT DISTINCT doc_id, true AS is_long FROM t51),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n5, 0)::BIGINT AS n_repeat_words, coalesce(n3, 0)::BIGINT AS n_covered, coalesce(is_long, false) AS is_long
  FROM d LEFT JOIN c5 USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_covered <= 0.65 * n_words AND NOT is_long AS kept, n_covered FROM b""",
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(html) AS payload_bytes, hex,
        array_to_string(list_transform(string_split(hex, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits,
        min(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b""",
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT DISTINCT dw.doc_id, dw.s, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op11_resample": r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS (SELECT side, r, unnest(w) AS w FROM words),
bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM each))),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM each JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT r, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM each JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT id AS doc_id, r, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)""",
    "op12_urls": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
o AS (SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
v AS (SELECT host, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare, count(bad) AS n, count(*) FILTER (WHERE bad) AS b
  FROM p LEFT JOIN o ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?\z', 1) AS BIGINT) GROUP BY host),
x AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9.]+$|^\[') AS address FROM v),
y AS (SELECT *, NOT address AND array_to_string(l[-2:], '.') IN (TWO_LABELS) AS two FROM x),
h AS (SELECT host, n, b, CASE WHEN address THEN bare WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix, CASE WHEN address THEN bare WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM y),
d AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY ALL), g AS (SELECT sum(n) AS n, sum(b) AS b FROM s),
pairs AS (SELECT 0 AS level, 'x' AS par, s.n, s.b, g.n AS pn, g.b / g.n AS q FROM s, g WHERE s.n > 0
  UNION ALL SELECT 1, s.suffix, d.n, d.b, s.n, s.b / s.n FROM d JOIN s USING (suffix) WHERE d.n > 0
  UNION ALL SELECT 2, d.suffix || '/' || d.domain, h.n, h.b, d.n, d.b / d.n FROM h JOIN d USING (suffix, domain) WHERE h.n > 0),
per AS (SELECT level, par, pn, q * (1 - q) AS v, sum(n * pow(b / n - q, 2)) AS dev, sum(n::DOUBLE * n) AS nn, count(*) - 1 AS free FROM pairs GROUP BY ALL),
sums AS (SELECT level, sum(dev - v * free) AS over, sum(v * (pn - nn / pn - free)) AS under FROM per GROUP BY level),
m AS (SELECT l AS level, CASE WHEN over > 0 AND under > 0 THEN least(greatest(under / over - 1, 1), 1000) ELSE 1000 END::DOUBLE AS m FROM range(3) r(l) LEFT JOIN sums ON level = l),
qs AS (SELECT suffix, (s.b + least(m, g.n + 2) * ((g.b + 1) / (g.n + 2))) / (s.n + least(m, g.n + 2)) AS q, s.n + least(m, g.n + 2) AS size FROM s, g, m WHERE level = 0),
qd AS (SELECT suffix, domain, (d.b + least(m, size) * q) / (d.n + least(m, size)) AS q, d.n + least(m, size) AS size FROM d JOIN qs USING (suffix), m WHERE level = 1),
qh AS (SELECT host, (h.b + least(m, size) * q) / (h.n + least(m, size)) AS mu, h.n + least(m, size) AS size FROM h JOIN qd USING (suffix, domain), m WHERE level = 2),
bound AS (SELECT host, mu, greatest(mu - 1.645::DOUBLE * sqrt(mu * (1 - mu) / (size + 1)), 0) AS low FROM qh),
rules AS (SELECT kind, rule, split_part(rule, '/', 1) AS top, substr(rule, strpos(rule, '/')) AS start FROM (VALUES RULES) t(kind, rule)),
fits AS (SELECT host, path, max_by(rule, len(rule)) AS rule, max_by(kind, len(rule)) AS kind FROM (SELECT DISTINCT host, path FROM p) q JOIN rules ON (host = top OR ends_with(host, '.' || top)) AND starts_with(path, start) GROUP BY ALL)
SELECT page_id, p.host, p.path, rule, coalesce(kind, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(mu, 6) AS bad_mean, round(low, 6) AS bad_least
FROM p JOIN bound USING (host) LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path""".replace("TWO_LABELS", ", ".join(f"'{x}'" for x in reputation.TWO_LABELS)).replace("RULES", ", ".join(f"('{k}', '{r}')" for k, r in URL_RULES)),
    "op13_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS alike, list_dot_product(a.v, o.v)::BIGINT AS score FROM r a JOIN r o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM pos JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM neg WHERE rank <= 10""",
}
