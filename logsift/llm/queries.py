"""One query per operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import langid, quality, toxicity
from logsift.llm.common import fold, labelled_sample, table
from logsift.llm.decontaminate import contaminated
from logsift.llm.lexical import ranked
from logsift.llm.linededup import dedup_lines
from logsift.llm.mixing import mixture, repeated, sized
from logsift.llm.packing import pack
from logsift.llm.prefixtrie import prefix_trie, rebuilt
from logsift.llm.simhash import near_groups
from logsift.llm.topk import top_k
from logsift.llm.tokenids import read_token_ids, write_token_ids
from logsift.llm.warc import assemble, page_captures, read_warc, write_warc
from logsift.scratch import new_path, saved

WORDS_49K = "word_bpe_49k.json"


def tokenizer(name: str = WORDS_49K) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str, parts: int, part: int) -> Column:
    return fold(doc_id, parts) == part


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), min_length=10, min_docs=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id > s.first AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer(), end_id=1, room=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def quality_model(spark: SparkSession, sf_dir: str, fit_rows: int = 3_000) -> quality.Model:
    """Fitted on labelled rows of ``documents`` that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    sample, given = labelled_sample(table(spark, sf_dir, "documents"), labels, "quality", fit_rows)
    return quality.fit(sample, fit_rows, given)


def toxicity_lexicon(spark: SparkSession, sf_dir: str, fit_rows: int = 10_000) -> toxicity.Lexicon:
    """Learned from labelled rows of ``documents`` that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    sample, given = labelled_sample(table(spark, sf_dir, "documents"), labels, "toxic", fit_rows)
    return toxicity.learn(sample, fit_rows, given=given)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), toxicity_lexicon(spark, sf_dir))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    captures = page_captures(assemble(read_warc(spark, path, payloads=False)))
    return captures.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5, scale=256)


TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=3)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


LEXICAL_SQL = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT row_number() OVER () AS d, doc_id, terms, len(terms) AS n FROM found WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs
), asked AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark
), items AS (
  SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM asked) GROUP BY q, item_id, term
), postings AS (
  SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY d, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, corpus GROUP BY term, big_n
), scored AS (
  SELECT q, item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term), corpus GROUP BY q, item_id, d, doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, d) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""
MIX_SEED = 12


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(sized(table(spark, sf_dir, "documents"), MIX_SEED).select("doc_id", "source", "size", "slice"), "sizes")
    plan = mixture(rows, weights=(5, 2, 1), share=1.5, max_epochs=2)
    return repeated(rows, plan).select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6) AS slice
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), sorted AS (
  SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS place FROM sources
), levels AS (
  SELECT place, 2.0::DOUBLE * source_size / weight AS reach,
         (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM sources) - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)) / sum(weight) OVER after AS level
  FROM sorted
  WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
  SELECT min_by(level, place) AS level FROM levels WHERE reach >= level
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(level * weight, 2.0::DOUBLE * source_size)) AS target FROM sources, chosen
), wholes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), rests AS (
  SELECT *, greatest(CAST(round(target) AS BIGINT) - whole * source_size, 0) AS rest FROM wholes
), sliced AS (
  SELECT source, slice, sum(size) AS n FROM sized GROUP BY source, slice
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY slice) AS upto FROM sliced
), cuts AS (
  SELECT r.source, min(r.slice) AS cut, min_by(CAST(t.rest - (r.upto - r.n) AS DOUBLE) / CAST(r.n AS DOUBLE), r.slice) AS part
  FROM running r JOIN rests t ON r.source IS NOT DISTINCT FROM t.source WHERE r.upto > t.rest GROUP BY r.source
)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CAST(t.whole * s.size + CASE WHEN s.slice < coalesce(c.cut, 'g') THEN s.size WHEN s.slice = c.cut THEN CAST(floor(s.size * c.part) AS BIGINT) ELSE 0 END AS BIGINT) AS taken
FROM sized s JOIN rests t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations"), group=5, ways=9))


PREFIX_TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS head
  FROM turns GROUP BY conv_id
), heads AS (
  SELECT c.conv_id, c.base, c.head, least(c.head, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), rebuilt AS (
  SELECT h.conv_id, t.place AS depth, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base WHERE t.place <= h.taken
  UNION ALL
  SELECT h.conv_id, t.place - h.head + h.taken, t.role, t.text FROM heads h JOIN turns t USING (conv_id) WHERE t.place > h.head
), hashed AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes, md5(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text) AS turn FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM heads
), prefixes AS (
  SELECT conv_id, depth, bytes, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node,
         string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM hashed
), nodes AS (
  SELECT node, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, depth
), inner_nodes AS (
  SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up, depth
), placed AS (
  SELECT n.*, coalesce(i.n_children, 0) AS n_children FROM nodes n LEFT JOIN inner_nodes i ON n.node = i.node AND n.depth = i.depth
), above AS (
  SELECT p.node AS top, p.depth AS top_depth, sum((d.n_convs - 1) * d.bytes) AS saved_tokens, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves
  FROM placed d JOIN prefixes x ON x.conv_id = d.conv_id AND x.depth <= d.depth JOIN placed p ON p.node = x.node AND p.depth = x.depth
  GROUP BY p.node, p.depth
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM placed n JOIN above a ON a.top = n.node AND a.top_depth = n.depth LEFT JOIN nodes u ON u.node = n.up AND u.depth = n.depth - 1 AND n.depth > 0
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language": op2_language,
    "op3_token_ids": op3_token_ids,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_top_k": op9_top_k,
    "op10_simhash": op10_simhash,
    "op11_lexical": op11_lexical,
    "op12_mixing": op12_mixing,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op4_line_dedup": LINE_DEDUP_SQL, "op9_top_k": TOP_K_SQL, "op11_lexical": LEXICAL_SQL, "op12_mixing": MIXING_SQL, "op13_prefix_trie": PREFIX_TRIE_SQL,
}
