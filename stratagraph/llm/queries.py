"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import sentencepiece_bpe

    return sentencepiece_bpe.digests(sentencepiece_bpe.decode(sentencepiece_bpe.encode(table(spark, sf_dir, "documents"))))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import chat

    hard = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", r"r'\### Assistant: </turn> ok' AS text"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digests(chat.format_chat(rows))


def op4_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import avi

    return avi.features(avi.encode_media(table(spark, sf_dir, "documents")))


def op5_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import quality_cnn

    documents = table(spark, sf_dir, "documents")
    return quality_cnn.score(documents, quality_cnn.train(documents, table(spark, sf_dir, "labels")))


def op8_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm.token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op10_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op11_count_min_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import repeated_passages

    return repeated_passages.digests(repeated_passages.drop_repeats(table(spark, sf_dir, "documents")))


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import tiered_search

    return tiered_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratagraph.llm import periodic_runs

    return periodic_runs.digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), prepare=periodic_runs.made_periodic))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, length(regexp_replace(text, '<(\\*)((/?turn|/role|part)>)', '<\\\1\2', 'g')) AS text_chars,
         length(regexp_replace(role, '<(\\*)((/?turn|/role|part)>)', '<\\\1\2', 'g')) AS role_chars,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, false) AS goes_on
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN goes_on THEN 6 ELSE 6 + role_chars + 7 + 8 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


OP11_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM split),
windows AS (
  SELECT r, doc_id, word, pos, CASE WHEN count(*) OVER w = 20 THEN string_agg(word, ' ') OVER w END AS win
  FROM placed WINDOW w AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
later AS (
  SELECT r, doc_id, word, pos, win IS NOT NULL AND (doc_id, pos) > min((doc_id, pos)) OVER (PARTITION BY win) AS late FROM windows
),
gone AS (SELECT r, word, pos, max(late::INT) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS removed FROM later),
sums AS (
  SELECT r, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept FROM gone GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN sums USING (r)
"""


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
each AS (SELECT r, doc_id, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM each GROUP BY ALL),
sizes AS (SELECT r, count(*) AS n FROM each GROUP BY r),
whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
items AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark),
asked AS (SELECT i, item_id, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM items),
wanted AS (SELECT i, item_id, term, count(*) AS k FROM asked GROUP BY ALL),
scored AS (
  SELECT i, item_id, r, doc_id,
         sum(k * floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM wanted JOIN dfs USING (term) JOIN tfs USING (term) JOIN sizes USING (r), whole GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""


def _op8_sql() -> str:
    """The licence scan in DuckDB SQL: the same tables of sentences and rules, the cut written over lists of lines."""
    from stratagraph.llm import licenses as L

    known = ", ".join(f"('{text}', '{name}')" for text, name in L.KNOWN.items())
    steps, last = [], "s0"
    for k, (name, ids) in enumerate(L.RULES, 1):
        pattern = "," + ",,".join(ids) + ","
        steps.append(
            f"s{k} AS (SELECT doc_id, identifiers, replace(rest, '{pattern}', chr(2)) AS rest, "
            f"n_matches + (length(rest) - length(replace(rest, '{pattern}', ''))) // {len(pattern)} AS n_matches, "
            f"CASE WHEN contains(rest, '{pattern}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"s{k}"
    holder = r"^(?:copyright ?(?:\(c\)|©)?|\(c\)|©)[ ,:]*(?:[0-9]{4}|<year>|\[yyyy\]|\[year\])"
    mark = r"^\(?(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{2,4})[.)] "
    bare = r"regexp_replace(regexp_replace(regexp_replace(line, '[ \t\r\f]+', ' ', 'g'), '^[ #*;%<>!/-]*', ''), ' ?(\*/|-->)? ?$', '')"
    own = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
tidy AS (
  SELECT r, substr(regexp_replace(regexp_replace(chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda line: {bare}), chr(10)),
    '(?i)(spdx-license-identifier):', '\1', 'g'), '(?i)([ (,\n])(v|ver)\. ?\n?([0-9])', '\1\2 \3', 'g'), 2) AS text
  FROM docs WHERE regexp_matches(lower(text), 'licens|copyright|permission|redistribut|warrant|reserved|misrepresented|unencumbered|notice|mpl')
),
marked AS (
  SELECT r, list_transform(string_split(text, chr(10)), lambda line: CASE
    WHEN regexp_matches(line, '(?i){holder}') THEN chr(1) || coalesce(chr(10) || nullif(regexp_extract(line, '(?i){holder}.*?[., ](all rights reserved.*)$', 1), ''), '')
    WHEN regexp_matches(line, '{mark}') THEN chr(1) || regexp_replace(line, '{mark}', '')
    ELSE line END) AS lines FROM tidy
),
whole AS (
  SELECT r, regexp_replace(chr(10) || array_to_string(lines, chr(10)) || chr(10), '\n\n+', chr(1), 'g') AS text FROM marked
),
ended AS (
  SELECT r, regexp_replace(regexp_replace(regexp_replace(text, '[\n\x01](https?://[^ \n\x01]+)[\n\x01]', ' \1' || chr(1), 'g'),
    ':(?: \n|\n| )([A-Z0-9("])', chr(1) || '\1', 'g'), '[.!?][ \n\x01]', chr(1), 'g') AS text FROM whole
),
pieces AS (
  SELECT r, unnest(string_split(text, chr(1))) AS sentence, generate_subscripts(string_split(text, chr(1)), 1) AS pos FROM ended
),
hits AS (
  SELECT r, pos, name, pieces.sentence AS sentence FROM pieces LEFT JOIN known ON known.sentence = {own.format("pieces.sentence")}
),
named AS (
  SELECT r, pos, 0 AS line_no, name FROM hits WHERE name IS NOT NULL
  UNION ALL
  SELECT l.r, l.pos, l.line_no, known.name FROM (
    SELECT r, pos, unnest(string_split(sentence, chr(10))) AS line, generate_subscripts(string_split(sentence, chr(10)), 1) AS line_no FROM hits WHERE name IS NULL AND contains(sentence, chr(10))
  ) l JOIN known ON known.sentence = {own.format("l.line")}
),
lists AS (SELECT r, string_agg(name, ',' ORDER BY pos, line_no) AS identifiers FROM named GROUP BY r),
s0 AS (
  SELECT doc_id, coalesce(identifiers, '') AS identifiers, ',' || replace(coalesce(identifiers, ''), ',', ',,') || ',' AS rest,
         0::BIGINT AS n_matches, []::VARCHAR[] AS found
  FROM docs LEFT JOIN lists USING (r)
),
{", ".join(steps)}
SELECT doc_id, identifiers, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, n_matches FROM {last}
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express whole; the tests hold the others against brute-force versions."""
    return {"op3_chat_formatting": OP3_SQL, "op8_license_sentence_rules": _op8_sql(), "op11_count_min_passages": OP11_SQL, "op12_tiered_search": OP12_SQL}
