"""The registered queries of this subpackage: thin contracts over the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import leaks, lines, minhash, mixing, pages, phrases, quality, search, sharding, shared, simhash, tokens, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write(table(spark, sf_dir, "documents"), shared.new_path(spark, "token-ids"), word_vocabulary())
    return tokens.read(spark, path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"), shared.new_path(spark, "warc"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=16)


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.98, most_passes=2.0)
    return mixed.select("doc_id", "source", "pass", mixing.words().alias("n_tokens"), "mix_block", "mix_order", "weight")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.fingerprints(table(spark, sf_dir, "documents"))
    printed = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", printed("fingerprint"), printed("edited_fingerprint"), "near_edited", "near_next")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, percent=50, top=2000)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_token_ids": op2_token_ids,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_vectors": op7_vectors,
    "op8_line_dedup": op8_line_dedup,
    "op9_leaks": op9_leaks,
    "op10_mixing": op10_mixing,
    "op11_fingerprints": op11_fingerprints,
    "op12_phrases": op12_phrases,
    "op13_search": op13_search,
}
ORACLES: dict[str, str] = {
    "op12_phrases": """WITH RECURSIVE d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz ') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
    w AS (SELECT lang, list_filter(string_split(p, ' '), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM (SELECT *, unnest([1, 2, 3]) AS k FROM g) WHERE i + k - 1 <= len(w) GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND a >= 10),
    s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM c
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
    m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    e AS MATERIALIZED (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k = 3 AND a >= 10),
    longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM e) GROUP BY ALL),
    kept AS (SELECT m.* FROM m LEFT JOIN longer o ON o.lang = m.lang AND o.part = m.phrase WHERE m.k = 3 OR o.most IS NULL OR 100 * o.most < 50 * m.a),
    ins AS (SELECT lang, w[2] || ' ' || w[3] AS node, min(phrase) AS before FROM e GROUP BY ALL HAVING count(*) = 1),
    outs AS (SELECT lang, w[1] || ' ' || w[2] AS node, min(phrase) AS phrase FROM e GROUP BY ALL HAVING count(*) = 1),
    links AS MATERIALIZED (SELECT lang, phrase, before FROM ins JOIN outs USING (lang, node) WHERE phrase <> before),
    walk AS (SELECT lang, phrase, phrase AS path, 0::BIGINT AS path_at FROM e ANTI JOIN links USING (lang, phrase)
      UNION ALL SELECT l.lang, l.phrase, walk.path, walk.path_at + 1 FROM walk JOIN links l ON l.lang = walk.lang AND l.before = walk.phrase),
    ring AS (SELECT lang, phrase AS start, phrase, 0::BIGINT AS at FROM links ANTI JOIN walk USING (lang, phrase)
      UNION ALL SELECT l.lang, ring.start, l.phrase, ring.at + 1 FROM ring JOIN links l ON l.lang = ring.lang AND l.before = ring.phrase WHERE l.phrase <> ring.start),
    least AS (SELECT lang, start, min(phrase) AS path FROM ring GROUP BY ALL),
    paths AS (SELECT * FROM walk UNION ALL SELECT r.lang, r.phrase, r.start, r.at FROM ring r JOIN least t ON t.lang = r.lang AND t.start = r.start AND t.path = r.start)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, path, path_at FROM kept JOIN totals USING (lang) LEFT JOIN paths USING (lang, phrase) QUALIFY rank <= 2000""",
    "op13_search": """WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
    s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
    q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
    p AS MATERIALIZED (SELECT row, doc_id, size, term, count(*) AS tf FROM (SELECT row, doc_id, len(t) AS size, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
    scores AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 50""",
    # Base32 of the SHA-1's hexadecimal digits: five of them are four letters.
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS x FROM p),
    e AS (SELECT page_id, h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((list_sum(list_transform(range(5), lambda k: (strpos('0123456789abcdef', substr(x, CAST(5 * (i // 4) + k + 1 AS BIGINT), 1)) - 1) * CAST(16 ** (4 - k) AS BIGINT)))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest FROM d),
    f AS (SELECT h, max(page_id) AS first FROM e GROUP BY h)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM e JOIN f USING (h)""",
}
