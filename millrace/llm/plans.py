"""The operators bound to the test tables, with reference SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat,
    decontaminate,
    html_text,
    jaccard,
    language_id,
    lexical_search,
    mixing,
    quality_net,
    quality_rules,
    suffix_dedup,
    token_counts,
    toxicity,
    turn_repair,
)
from millrace.llm.labels import is_held_out
from millrace.tables import load

QUALITY_THRESHOLD = 0.7

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


# The words of a text in SQL: no matter how long, nothing is cut.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX_SQL = rf"""
sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM {{docs}}),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS weight
  FROM per_source),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(source_size * 3) OVER (ORDER BY source_size::DOUBLE / weight, rank
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM ranked),
targets AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target,
         ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '-' ELSE '+' || source END), 1, 8))::BIGINT
           / 4294967296.0::DOUBLE AS start
  FROM levels),
placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id NULLS FIRST) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
         (floor(rate) + least(1, floor((rate - floor(rate)) * place + start)
                                 - floor((rate - floor(rate)) * (place - 1) + start)))::BIGINT AS copies
  FROM placed)
"""


@query(
    "op2_mix_sources",
    "WITH " + MIX_SQL.format(docs="documents") + "SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed",
)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(load(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query(
    "op8_format_chats",
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || url_encode(role) || chr(62) || chr(10))
           + length(regexp_replace(text, '<(\\*)(/?turn)', '<\1\\\2', 'g')) + length('</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
)
def format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    records = chat.turns_to_records(rows.unionByName(probe))
    formatted = chat.format_chats(records).select("conv_id", "segments", "formatted")
    read = formatted.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("segments")).alias("taught"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("taught").cast("bigint").alias("loss_chars"),
        F.sha2("taught", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query(
    "op9_quality_rules",
    rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words, row_number() OVER () AS id FROM documents),
each AS (
  SELECT id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) >= 8),
windows AS (
  SELECT id, i, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s,
         count(*) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS width FROM each),
repeated AS (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS n FROM windows WHERE width = 8),
steps AS (
  SELECT id, least(8, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - i, 8)) AS step FROM repeated WHERE n > 1),
covered AS (SELECT id, sum(step)::BIGINT AS n FROM steps GROUP BY id),
lines AS (
  SELECT id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
         coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word
  FROM w JOIN lines USING (id) LEFT JOIN covered USING (id)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 5 * n_capitals > 2 * word_chars OR 5 * n_dup_lines > n_words
         OR 2 * n_digits > word_chars OR longest_word > 1000 AS ruled_out FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ruled_out AS kept FROM judged""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.report_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op10_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op5_quality_classifier")
def classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_net.fit_model(docs, load(spark, sf_dir, "labels"))
    return quality_net.score(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@query("op6_toxicity")
def classify_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_model(docs, load(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain)
    return scored.select(
        "doc_id", "p_group_1", "p_group_2", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic")
    )


@query("op3_decontaminate")
def find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, load(spark, sf_dir, "benchmark"))


@query("op4_html_extraction")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    text = html_text.extract(pages, html_text.fit_model(pages))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op7_jaccard_join")
def join_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _letters(v: str, cost: int, letter: str, line: str = "''") -> str:
    """SQL for a derivation ``v`` (cost, audit, chr(1), repaired lines) with one more edit."""
    return (
        f"CASE WHEN {v} IS NOT NULL THEN printf('%012d', substr({v}, 1, 12)::BIGINT + {cost})"
        f" || substr({v}, 13, strpos({v}, chr(1)) - 13) || '{letter}' || substr({v}, strpos({v}, chr(1))) || {line} END"
    )


def _steps(letter: str, froms: str) -> str:
    """SQL for the lightest way to read a row that may stay as ``letter``."""
    role = {"u": "user", "a": "assistant"}[letter]
    ways = []
    for v in froms.split():
        kept, new = "chr(2) || role || ':' || text", f"chr(2) || '{role}:' || text"
        for extra, when in ((0, "NOT truncated"), (5, "truncated")):
            ways.append(f"CASE WHEN NOT gone AND {when} AND initial = '{letter}' THEN {_letters(v, extra, 'K', kept)} END")
            ways.append(f"CASE WHEN NOT gone AND {when} AND initial <> '{letter}' THEN {_letters(v, extra + 1, 'R', new)} END")
    return ", ".join(ways)


def _inserted(v: str, role: str) -> str:
    return _letters(v, 5, "I", f"chr(2) || '{role}:'")


#: The same states from left to right, a row of every conversation at a time.
REPAIR_SQL = rf"""
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)),
             lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crcs),
damaged AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS unended,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous
  FROM ordered),
turns AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND unended AS truncated,
         i > 1 AND previous || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank,
         count_if(again AND NOT blank)::BIGINT AS duplicate, count_if(truncated)::BIGINT AS truncated,
         count_if(illegal)::BIGINT AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, v0, NULL::VARCHAR AS v1, v2, {_inserted("v2", "assistant")} AS v3
  FROM (SELECT conv_id, v0, {_inserted("v0", "user")} AS v2 FROM (SELECT conv_id, '000000000000' || chr(1) AS v0 FROM faults))
  UNION ALL
  SELECT conv_id, i, v0, v1, v2, least(v3, {_inserted("v2", "assistant")}) AS v3
  FROM (
    SELECT conv_id, i, v0, v1, v3, least(v2, {_inserted("v0", "user")}, {_inserted("v1", "user")}, {_inserted("v3", "user")}) AS v2
    FROM (
      SELECT w.conv_id, t.i, {_letters("v0", 2, "D")} AS v0,
             least({_letters("v1", 2, "D")},
                   CASE WHEN NOT gone AND initial = 's' THEN CASE WHEN truncated THEN {_letters("v0", 5, "K", "chr(2) || role || ':' || text")}
                        ELSE {_letters("v0", 0, "K", "chr(2) || role || ':' || text")} END END) AS v1,
             least({_letters("v2", 2, "D")}, {_steps("u", "v0 v1 v3")}) AS v2,
             least({_letters("v3", 2, "D")}, {_steps("a", "v2")}) AS v3
      FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1))),
best AS (
  SELECT f.*, least(w.v0, w.v3) AS v FROM faults f JOIN ways w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(v, 1, 12)::BIGINT, 0) AS cost,
       coalesce(substr(v, 13, strpos(v, chr(1)) - 13), '') AS audit,
       sha256(coalesce(replace(substr(v, strpos(v, chr(1)) + 2), chr(2), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


def damage_turns(rows: DataFrame) -> DataFrame:
    """Drop, empty, cut, repeat or rename turns by the hash of their conversation and number."""
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    fate, said = F.crc32(name) % 20, F.coalesce("text", space)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        rows.withColumn("fate", fate)
        .filter("fate <> 0")
        .withColumn("copy", F.explode(copies))
        .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), text.alias("text"))
    )


@query("op11_repair_conversations", REPAIR_SQL)
def repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    repair = turn_repair.repair_turns(damage_turns(rows))
    key = turn_repair.conversation_key(F.col("conv_id"))
    ids = rows.select("conv_id").distinct().withColumn("key", key)
    report = repair.report.withColumn("key", key).drop("conv_id")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        ids.join(report, "key", "left")
        .join(turn_repair.digest_turns(repair.turns), "key", "left")
        .select(
            "conv_id",
            *zeros,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


@query("op13_language_id")
def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict_language(docs.drop("lang"), language_id.fit_model(docs))
    held_out = language_id.is_held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


# The maximal runs of term characters in SQL, only A to Z lower-cased.
_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    "op12_lexical_search",
    rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS terms, len(terms)::BIGINT AS n FROM documents WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM d),
tf AS (
  SELECT id, doc_id, n, term, count(*) AS tf FROM (SELECT id, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY term, n_docs),
q AS (
  SELECT DISTINCT item, item_id, unnest(terms) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark)),
scored AS (
  SELECT item, item_id, id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10""",
)
def search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical_search.search(index, load(spark, sf_dir, "benchmark"))
