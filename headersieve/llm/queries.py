"""One query per operator of this folder, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headersieve.llm.chat import digest_chats, format_chats, turns_of_records, turns_of_table
from headersieve.llm.collocations import mine_collocations
from headersieve.llm.decontaminate import find_contaminated
from headersieve.llm.language import fit_trees, predict_language
from headersieve.llm.lexical_search import rank_documents
from headersieve.llm.mixing import mix
from headersieve.llm.near_dup import classify
from headersieve.llm.pii import label_personal_data
from headersieve.llm.quality import BASE, rate_quality
from headersieve.llm.scoring import score_texts
from headersieve.llm.simhash import link_texts
from headersieve.llm.texts import read_table, remainder_is, words_of
from headersieve.llm.token_count import count_tokens
from headersieve.llm.toxicity import fit_grammar, labelled_sample, score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~remainder_is(F.col("doc_id"), 3, 1))
    grammar = fit_grammar(labelled_sample(docs, labels))
    held_out = remainder_is(F.col("doc_id"), 3, 1)
    return score_toxicity(docs.withColumn("held_out", held_out), grammar).drop("text")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate_quality(docs).select("doc_id", *BASE, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contaminated(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs it

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


#: A conversation that tries to pass for the marks of a template, as a record of another layout.
TRICKY = (-7, '{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"},'
              ' {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}')  # fmt: skip


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = turns_of_table(read_table(spark, sf_dir, "conversations"))
    record = spark.range(1).select(F.lit(TRICKY[0]).cast("bigint").alias("conv_id"), F.lit(TRICKY[1]).alias("record"))
    return digest_chats(format_chats(table.unionByName(turns_of_records(record))))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder_is(F.col("doc_id"), 4, 2)
    trees = fit_trees(docs.where(~held_out))
    return predict_language(docs.select("doc_id", "text", held_out.alias("held_out")), trees).drop("text")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size"))
    return mix(sized).drop("source")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, remainder_is(F.col("doc_id"), 7, 2))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_personal_data": op7_personal_data,
    "op8_language_id": op8_language_id,
    "op9_source_mixing": op9_source_mixing,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_simhash": op13_simhash,
}

#: The other queries fit models or read library vocabularies, which SQL does not; tests hold them
#: against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": r"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]'
          FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
        measured AS (
          SELECT *, length(role) + length(text) + 12
            + length(regexp_replace(role || text, '[^\\\[\]<>]', '', 'g')) AS chars FROM turns)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
            AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
            FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM measured GROUP BY conv_id""",
    "op11_lexical_search": r"""
        WITH occurrences AS (
          SELECT row, doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
        wanted AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        sizes AS (SELECT row, count(*) AS n FROM occurrences GROUP BY row),
        total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        postings AS (SELECT row, doc_id, term, count(*) AS tf FROM occurrences
          WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
        weights AS (SELECT term, CAST(floor(1000 * ln(
            CAST(2 * any_value(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM postings, total GROUP BY term),
        scored AS (
          SELECT item_id, row, doc_id,
            CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total.terms))))
              AS BIGINT) AS score
          FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), total
          GROUP BY item_id, row, doc_id)
        SELECT item_id, CAST(row_number() OVER (
            PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op12_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
        phrases AS (
          SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS words
          FROM cut, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(words) >= k),
        counted AS (SELECT lang, k, words, count(*) AS f FROM phrases GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT lang, k, words, f AS a FROM counted WHERE k > 1 AND f >= 30),
        inner_ AS (
          SELECT c.lang, c.k AS whole, c.a AS longer, unnest(list_transform(
            range(1, c.k - t.k + 2), lambda i: c.words[i:i + t.k - 1])) AS words
          FROM candidates AS c, (VALUES (2), (3)) AS t(k) WHERE t.k < c.k),
        covered AS (SELECT lang, words, max(longer) AS longer FROM inner_ GROUP BY ALL),
        kept AS (
          SELECT c.* FROM candidates AS c LEFT JOIN covered USING (lang, words)
          WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
        cuts AS (
          SELECT lang, words, a, cut, words[1:cut] AS first, words[cut + 1:] AS rest
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
        scored AS (
          SELECT cuts.lang, cuts.words, a, cut, x.f AS l, y.f AS r,
            CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
          FROM cuts JOIN counted AS x ON x.lang = cuts.lang AND x.words = first
          JOIN counted AS y ON y.lang = cuts.lang AND y.words = rest),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1)
        SELECT lang, CAST(row_number() OVER (
            PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS INTEGER) AS rank,
          array_to_string(words, ' ') AS phrase, a, l, r, n, score
        FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
