"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfwise.llm import (html_text, jaccard_join, mixing, permutation_index, piece_sampling, pii, prefix_trie, quality, ranked_search,
                           substring_dedup, token_counts, url_filter, warc)
from shelfwise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

oracle("op1_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(x="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(reach.b)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id""")

oracle("op3_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT win.doc_id, i FROM win JOIN low USING (k) WHERE low < doc_id), range(50) r(j)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
_GLOBS_SQL = " OR ".join(f"host || path LIKE '{g.replace('*', '%')}'" for g in url_filter.BLOCK_GLOBS)
oracle("op4_url_filter", f"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS x FROM pages),
h AS (SELECT page_id, {_LOWER.format(x="regexp_extract(x, '^[^/]*')")} AS host, substr(x, length(regexp_extract(x, '^[^/]*')) + 1) AS path FROM u),
r(rhost, rpath, v) AS (VALUES {_RULES_SQL}),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
        FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
g AS (SELECT *, {_GLOBS_SQL} AS glob_hit FROM h)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN glob_hit THEN 'block' ELSE 'allow' END) AS verdict, glob_hit
FROM g LEFT JOIN fit USING (page_id)""")

_TERMS = r"regexp_extract_all(" + _LOWER.format(x="coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
oracle("op11_ranked_search", f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_all, CAST(sum(len(t)) AS BIGINT) AS l_all FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_all),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50""")

_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, byte:
list_reduce(list_prepend(xor(crc, byte), range(8)), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295), 4294967295)"""
oracle("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, role, text) AS w FROM t GROUP BY conv_id),
h AS (SELECT conv_id, w, {_CRC32} % 6 AS h FROM c),
s AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, md5(CAST(to_json(s[1:d]) AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(CAST(to_json(s[1:d - 1]) AS VARCHAR)) END AS up,
             CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars, len(s) = d AS ends
      FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM s)),
n AS (SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node, d),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.up = n.node) AS n_children FROM n),
a AS (SELECT DISTINCT k.node, k.d, k.n_children, k.n_convs, k.chars, anc.node AS top, anc.d AS top_d
      FROM k JOIN p ON p.node = k.node AND p.d = k.d JOIN p anc ON anc.conv_id = p.conv_id AND anc.d <= p.d),
b AS (SELECT top, top_d, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM a GROUP BY ALL)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, b.saved_tokens, k.ends_sha256
FROM k JOIN b ON b.top = k.node AND b.top_d = k.d LEFT JOIN k u ON u.node = k.up AND u.d = k.d - 1""")

oracle("op13_warc", """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS x FROM pages),
o AS (SELECT x, min(page_id) AS original FROM p WHERE strlen(x) >= 100 GROUP BY x)
SELECT page_id, url, CAST(strlen(p.x) AS BIGINT) AS payload_bytes, sha256(p.x) AS payload_digest,
       CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > original THEN original END AS refers_to
FROM p LEFT JOIN o USING (x)""")


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under 5-word shingles at Jaccard 0.75."""
    return jaccard_join.components_of(table(spark, sf_dir, "documents"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those that the method adds."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without those that repeat 50-word passages of earlier ones."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and weakly supervised verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents"))


@query
def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with inclusion scores."""
    return piece_sampling.encode_samples(table(spark, sf_dir, "documents"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row per copy, at no more than two epochs a source."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits, counted on its segment tree."""
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, a row per node."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from archives that were written and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
