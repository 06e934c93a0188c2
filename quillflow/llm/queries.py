"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import (
    bitplanes, bpe, chat, count_tree, exact_dedup, fertility, minhash, packing, prefix_trie, secret_scan, suffix_lm,
    url_rules, whitening)
from quillflow.llm.common import stored, table
from quillflow.session import shared_folder

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"

SITE_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
              ("com/fr/", "allow"), ("com/de/", "block"))


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=4)


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    out = bpe.round_trip(table(spark, folder, "documents"), bpe.vocabulary_path(WORD_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.quality_report(table(spark, folder, "documents"), bpe.vocabulary_path(PIECE_BPE))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    out = stored(chat.format_conversations(rows.union(more)), "formatted")
    return out.select("conv_id", chat.read_back().alias("r")).select("conv_id", "r.*")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), bpe.vocabulary_path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "padded_length")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), bpe.vocabulary_path(WORD_BPE)
    return secret_scan.scan(docs, secret_scan.train(docs, path), path)


def op7_suffix_lm(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_lm.score_texts(table(spark, folder, "documents"))


def op8_bitplanes(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_folder(spark, "token_ids")
    bitplanes.write_ids(table(spark, folder, "documents"), target, bpe.vocabulary_path(BYTE_BPE))
    return bitplanes.read_ids(spark, target).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"), SITE_RULES)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("text_hash")


def op11_feast(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_count_tree(spark: SparkSession, folder: str) -> DataFrame:
    return count_tree.jaccard_join(table(spark, folder, "documents"))


def op13_burst_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefix_trie.numbered(table(spark, folder, "conversations"))
    members = turns.where("place = 1").select("conv_id")
    return prefix_trie.trie(prefix_trie.rebuilt(turns), members)


QUERIES = {f.__name__: f for f in (
    op1_minhash, op2_bpe, op3_fertility, op4_chat, op5_packing, op6_secrets, op7_suffix_lm, op8_bitplanes,
    op9_url_rules, op10_exact_dedup, op11_feast, op12_count_tree, op13_burst_trie)}

_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_ESCAPED = "regexp_replace({}, '(\\\\|###|</turn>)', '\\\\\\1', 'g')"

def _linked_sql(percent: int, kept: str = "") -> str:
    """Documents with their sets of four-word shingles and components; links from {percent} % on."""
    return rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM texts
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT s.doc_id, len(s) AS n_shingles, component_id{kept} FROM sets s JOIN least l ON l.doc_id = s.doc_id"""


ORACLES = {
    "op1_minhash": _linked_sql(80, ", s.doc_id = component_id AS kept"),
    "op12_count_tree": _linked_sql(85),
    "op4_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), blocks AS (
  SELECT *, length({_ESCAPED.format('text')}) + length(regexp_replace(role, '(\\\\|###|</turn>|:)', '\\\\\\1', 'g'))
            + length('### ') + length(': ') + length('</turn>') + 1 AS size FROM rows
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sum(size)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM blocks GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars FROM whole""",
    "op9_url_rules": """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*(.*)', 1) AS rest FROM pages
), rules(rule, action) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
         ('com/fr/', 'allow'), ('com/de/', 'block')
), split AS (
  SELECT rule, action, split_part(rule, '/', 1) AS site, substr(rule, strpos(rule, '/')) AS start FROM rules
), judged AS (
  SELECT page_id, host, path, rest,
    (SELECT arg_max({'rule': rule, 'action': action}, length(rule)) FROM split
     WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)) AS best FROM parts
)
SELECT page_id, host, path, best.rule AS rule,
  CASE WHEN best IS NOT NULL THEN best.action
       WHEN host <> '' AND (
         regexp_matches(host || translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '(?s)(^([^/]*[.])?(spam-farm|ads)[.]|/wp-login[.]php|/cgi-bin/|[?]sessionid=)'))
       THEN 'block' ELSE 'allow' END AS verdict FROM judged""",
    "op10_exact_dedup": f"""
WITH digests AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM digests WINDOW w AS (PARTITION BY text_sha256)""",
    "op13_burst_trie": r"""
WITH own AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), taken AS (  -- crc32 of the decimal id, bit by bit
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                     lambda x, step: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM own
), whole AS (
  SELECT t.conv_id, list_concat(coalesce(b.turns[1:t.h], []), t.turns[t.h + 1:]) AS turns
  FROM taken t LEFT JOIN own b ON b.conv_id = t.conv_id - t.conv_id % 20
), prefixes AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM whole
), nodes AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), own_values AS (
  SELECT n.prefix, n.depth, (c.n IS NULL)::BIGINT AS leaf,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.prefix[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix
), ways AS (
  SELECT prefix, leaf, saved, unnest(range(depth + 1)) AS up FROM own_values
), subtrees AS (
  SELECT prefix[1:up] AS prefix, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM ways GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.prefix = n.prefix LEFT JOIN children c ON c.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]""",
}
