"""The registered queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, html, jaccard, media, negatives, pii, quality, substring, suffixdedup, toxicity, urls
from .common import fold, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


_RANDOM_KEYS: dict[str, str] = {}


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the rank file; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def pii_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms: the setting spark.flowkit.pii.key, so that it is in no code.

    Without the setting it is drawn at random for the Spark application and kept
    nowhere: pseudonyms then link the documents of one application alone.
    """
    app = spark.sparkContext.applicationId
    return spark.conf.get("spark.flowkit.pii.key", None) or _RANDOM_KEYS.setdefault(app, secrets.token_hex(32))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside one fold of three."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 3) == 1
    model = quality.fitted(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), quality.score(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pii.pseudonymise(pii_key(spark))("text").alias("p")).select("doc_id", "p.text", "p.n_replaced")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as MPEG audio frames, read back, with digests and features."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length("text")
    padding = F.when(size == 0, 64).otherwise(F.pmod(-size, F.lit(64)))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    stored = docs.select("doc_id", size.cast("long").alias("n_bytes"), media.store()(F.concat("text", F.unhex(F.repeat(F.lit("00"), padding.cast("int"))))).alias("media"))
    facts = {"layer": "layer", "rate": "sample_rate", "samples": "samples", "table": "vbr_frames", "checked": "crc_checked", "failed": "crc_failed", "skipped": "skipped"}
    back = stored.withColumn("m", media.read("payload", "offsets", *facts.values())("media"))
    payload = F.col("m.payload")
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(f"m.{v}").cast("string")) for k, v in facts.items()), F.concat(F.lit("frames="), F.size("m.offsets").cast("string")), F.concat(F.lit("last="), F.element_at("m.offsets", -1).cast("string")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        (F.col("m.samples") / F.col("m.sample_rate")).alias("duration_s"),
        F.col("m.offsets").alias("frame_offsets"),
    )


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside one fold of five."""
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 5) == 0
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity.score(net)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in a document, with its edit distance there."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad): the labels of the document of that number; bad if it is toxic or of low quality."""
    bad = F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page by rules and by the reputation of its host."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(spark, sf_dir), URL_RULES)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when passages of 50 words that a smaller document has are cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = substring.repeated_spans(docs, span=50)
    out = substring.with_spans(docs, spans).select("doc_id", substring.cut()("text", "spans").alias("c"))
    return out.select("doc_id", "c.n_words", "c.n_removed", F.sha2("c.kept", 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of token ids and of the decoded bytes."""
    path, pattern = tokenizer()
    out = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(path, pattern)("text").alias("e")).select("doc_id", "e.*")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language diverge in their words: pairs of sources, and each source's own terms."""
    return divergence.audit(table(spark, sf_dir, "documents"), min_documents=10, top=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each anchor and positive the rows of other labels that score from 50 to 95 % of the positive."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(rows, every=50, positives=5, negatives=3, low=(50, 100), high=(95, 100))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left when every string of 200 bytes that starts at two places or more is cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = suffixdedup.repeated_bytes(docs, span=200)
    out = suffixdedup.with_spans(docs, spans).select("doc_id", suffixdedup.cut_bytes()("text", "spans").alias("c"))
    return out.select("doc_id", "c.n_bytes", "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_media": op4_media,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_url_filters": op8_url_filters,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

def _level(level: str, above: str) -> str:
    """SQL: the concentration and the posterior means of one level, shrunk to the level above."""
    return f"""
    {level}_sums AS (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS squares, sum(bad * bad / n::DOUBLE) AS inside, count(*) AS k FROM {level}_counts WHERE n > 0),
    {level}_spread AS (SELECT *, inside - n * (bad / n) * (bad / n) - bad / n * (1 - bad / n) * (k - 1) AS extra, bad / n * (1 - bad / n) * (n - squares / n - (k - 1)) AS room FROM {level}_sums),
    {level}_strength AS (SELECT CASE WHEN n IS NULL OR bad IN (0, n) OR k < 2 OR room <= 0 OR extra <= 0 THEN 1e6 ELSE least(1e6, greatest(1, room / extra - 1)) END AS s FROM {level}_spread),
    {level}_mean AS (SELECT c.*, (c.bad + s * a.mean) / (c.n + s) AS mean FROM {level}_counts AS c JOIN {above} AS a USING (above), {level}_strength)"""


def _rules_sql() -> tuple[str, str]:
    text = verdict = ""
    for what, host, path in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        text, verdict = f"{text} WHEN {fits} THEN '{host}{path}'", f"{verdict} WHEN {fits} THEN '{what}'"
    return f"CASE{text} END", f"CASE{verdict} END"


_TWO = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
_LABELS = "string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.')"
_URL_SQL = f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    worst AS (SELECT doc_id AS page_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1)))::BIGINT AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    known AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, {_LABELS} AS labels FROM (SELECT DISTINCT page_id, host FROM parts) LEFT JOIN worst USING (page_id) GROUP BY host),
    named AS (SELECT host, n, bad, CASE WHEN array_to_string(labels[-2:], '.') IN ({_TWO}) THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix, CASE WHEN array_to_string(labels[-2:], '.') IN ({_TWO}) THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM known),
    base AS (SELECT 1 AS above, CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n)::DOUBLE ELSE 0.5 END AS mean FROM named),
    suffix_counts AS (SELECT suffix, 1 AS above, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM named GROUP BY suffix),{_level("suffix", "base")},
    domain_counts AS (SELECT domain, suffix AS above, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM named GROUP BY domain, suffix),{_level("domain", "(SELECT suffix AS above, mean FROM suffix_mean)")},
    host_counts AS (SELECT host, domain AS above, n, bad FROM named),{_level("host", "(SELECT domain AS above, mean FROM domain_mean)")}
SELECT page_id, host, path, {_rules_sql()[0]} AS rule, coalesce({_rules_sql()[1]}, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_share
FROM parts JOIN host_mean USING (host), host_strength
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_JACCARD_SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}')")} AS words FROM documents),
    shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM texts),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles AS a JOIN shingles AS b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN sizes AS a ON a.doc_id = x JOIN sizes AS b ON b.doc_id = y WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)),
    ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, y FROM reached JOIN ways ON x = other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
_SUBSTRING_SQL = f"""
WITH texts AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
    windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)),
    firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, i + k AS place FROM windows JOIN firsts USING (h), range(50) AS t(k) WHERE first < doc_id),
    counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
    placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
# bytes as pairs of hexadecimal digits; 300 windows of 400 digits at a time are cut out of a part of the text
_SUFFIX_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
    blocks AS (SELECT doc_id, from_at, digits[2 * from_at + 1:2 * from_at + 998] AS part FROM (SELECT doc_id, digits, unnest(range(0, len(digits) // 2 - 199, 300)) AS from_at FROM texts WHERE len(digits) >= 400)),
    windows AS (SELECT doc_id, from_at + j AS i, md5(part[2 * j + 1:2 * j + 400]) AS h FROM (SELECT doc_id, from_at, part, unnest(range(0, len(part) // 2 - 199)) AS j FROM blocks)),
    repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
    starts AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true)::INT AS opens FROM windows JOIN repeated USING (h)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM starts),
    spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, k),
    sided AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER w, 0) AS since, lead(a) OVER w AS following FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(digits[2 * since + 1:2 * a] || CASE WHEN following IS NULL THEN digits[2 * b + 1:] ELSE '' END, '' ORDER BY k) AS kept FROM sided JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(digits) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, digits))) AS kept_sha256 FROM texts LEFT JOIN cut USING (doc_id)
"""
_SHARE = "1 + (1000000000 * (coalesce({}, 0) + 2)) // (coalesce({}, 0) + 2 * v)"
_DIVERGENCE_SQL = f"""
WITH texts AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
    kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM texts) GROUP BY lang, term HAVING count(*) >= 10),
    vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    sources AS (SELECT DISTINCT lang, source FROM texts),
    counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM texts) JOIN kept USING (lang, term) GROUP BY lang, source, term),
    totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY lang, source),
    lang_counts AS (SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY lang, term),
    lang_totals AS (SELECT lang, sum(n)::BIGINT AS total FROM counts GROUP BY lang),
    q AS (SELECT lang, term, {_SHARE.format("n", "total")} AS q FROM lang_counts JOIN lang_totals USING (lang) JOIN vocabulary USING (lang)),
    p AS (SELECT lang, source, term, n, {_SHARE.format("n", "total")} AS p FROM sources JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN totals USING (lang, source)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM sources AS a JOIN sources AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON (sums.lang, sums.source, sums.item) = (a.lang, a.source, b.source)),
    own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM own))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
_NEGATIVES_SQL = """
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM kept AS a JOIN kept AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": _JACCARD_SQL, "op8_url_filters": _URL_SQL, "op9_substring_dedup": _SUBSTRING_SQL, "op11_source_divergence": _DIVERGENCE_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op13_suffix_array_dedup": _SUFFIX_SQL}
