"""The registered queries of this folder: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz.llm import (
    decontaminate, exact_dedup, licenses, lm_score, piece_codec, quality, simhash, spelling, substring_dedup, tool_calls, toxicity, url_filters, vector_codes,
)
from strikehaz.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = " ".join(oracle.split())
        return plan

    return register


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op1_url_filters", """
    WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    split AS (SELECT row_number() OVER () AS n, page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fit AS (SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fit USING (n)""")
def op1_url_filters(spark, sf_dir):
    """Every page's rule and verdict."""
    return url_filters.judged(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def piece_model() -> str:
    """Path of the public vocabulary; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """Ids and decoded texts of all documents, as digests."""
    return piece_codec.encoded(table(spark, sf_dir, "documents"), piece_model(), keep=False)


@query("op3_lm_score")
def op3_lm_score(spark, sf_dir):
    """Log probability of every document under the unigram base and the bigram model."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def _license_sql() -> str:
    rows = ", ".join(f"('{name}', '{text}')" for name, text in licenses.TEMPLATES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    size = len(licenses.TEMPLATES)
    return f"""
    WITH templates(license, text) AS (VALUES {rows}),
    kinds AS (SELECT license, term, count(*) AS n FROM (SELECT license, unnest(regexp_extract_all({lower.format('text')}, '{licenses.TERM}')) AS term FROM templates) GROUP BY ALL),
    idf AS (SELECT term, ln({size + 1}e0 / (count(*) + 1)) + 1 AS idf FROM kinds GROUP BY term),
    sides AS (SELECT license, term, n * idf / sqrt(sum(n * n * idf * idf) OVER (PARTITION BY license)) AS share FROM kinds JOIN idf USING (term)),
    files AS (SELECT doc_id, coalesce(source, '') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS directory,
        CASE WHEN doc_id % 8 = 0 THEN 'COPYING.' ELSE 'text.' END || doc_id AS name, coalesce(text, '') AS text FROM documents),
    units AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), CASE WHEN doc_id % 8 = 0 THEN [text] ELSE [] END))) AS unit,
        text FROM files WHERE regexp_matches(text, '{licenses.KEYWORDS}')),
    kept AS (SELECT doc_id, unit FROM units WHERE regexp_matches(unit, '{licenses.KEYWORDS}')),
    terms AS (SELECT unit, term, count(*) AS n FROM (SELECT unit, unnest(regexp_extract_all({lower.format('unit')}, '{licenses.TERM}')) AS term
        FROM (SELECT DISTINCT unit FROM kept)) GROUP BY ALL),
    own AS (SELECT unit, term, n * coalesce(idf, ln({size + 1}e0) + 1) AS weight FROM terms LEFT JOIN idf USING (term)),
    norms AS (SELECT unit, sqrt(sum(weight * weight)) AS length FROM own GROUP BY unit),
    scores AS (SELECT unit, license, round(sum(weight * share) / any_value(length), 6) AS score FROM own JOIN sides USING (term) JOIN norms USING (unit) GROUP BY unit, license),
    ranked AS (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM kept JOIN scores USING (unit) WHERE score >= 0.6),
    marked AS (SELECT doc_id, directory, directory || '/' || name AS path, license AS own_license, score AS own_score
        FROM files LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (doc_id)),
    declared AS (SELECT directory AS ancestor, own_license AS declared FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY own_score DESC, own_license, path) AS r
        FROM marked WHERE doc_id % 8 = 0 AND own_license IS NOT NULL) WHERE r = 1),
    ancestors AS (SELECT DISTINCT directory, unnest(range(0, len(string_split(directory, '/')) + 1)) AS depth FROM marked),
    nearest AS (SELECT directory, max(depth) AS depth FROM ancestors JOIN declared ON ancestor = array_to_string(list_slice(string_split(directory, '/'), 1, depth), '/') GROUP BY directory),
    found AS (SELECT directory, ancestor, declared FROM nearest JOIN declared ON ancestor = array_to_string(list_slice(string_split(directory, '/'), 1, depth), '/'))
    SELECT doc_id, path, own_license, own_score, coalesce(own_license, declared) AS license, CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
    FROM marked LEFT JOIN found USING (directory)"""


@query("op5_license_scan", _license_sql())
def op5_license_scan(spark, sf_dir):
    """License of every document: its own, or that of the nearest directory; every eighth document is a license file."""
    files = table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.concat_ws("/", F.coalesce("source", F.lit("")), F.expr("doc_id div 1000"), F.expr("doc_id div 100"),
                    F.concat(F.when(F.col("doc_id") % 8 == 0, "COPYING.").otherwise("text."), F.col("doc_id").cast("string"))).alias("path"))
    return licenses.licenses(files, licenses.template_table(spark))


@query("op6_substring_dedup", r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS k FROM t)),
    firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, k + j AS place FROM (SELECT doc_id, k, unnest(range(0, 13)) AS j FROM windows JOIN firsts USING (g) WHERE first < doc_id)),
    places AS (SELECT doc_id, w[place] AS word, place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM t)),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""")
def op6_substring_dedup(spark, sf_dir):
    """What is left of every document without passages of 13 words that an earlier one has."""
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), keep=False)


@query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    """Benchmark items that every document holds."""
    return decontaminate.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_simhash")
def op8_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Every user turn asks the tool `answer`, the next assistant turn answers; a system turn sets the tool up.
TOOLS = [("answer", "text", "string", True), ("answer", "words", "integer", True), ("answer", "quoted", "string", False), ("setup", "text", "string", True), ("setup", "mode", "string", True)]


@query("op9_tool_calls", """
    WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id || ':' || turn AS id,
            lead(CASE WHEN role = 'assistant' THEN turn END) OVER w AS answer_turn, lead(CASE WHEN role = 'assistant' THEN coalesce(text, '') END) OVER w AS answer
        FROM (SELECT DISTINCT * FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    calls AS (SELECT *, CASE role WHEN 'user' THEN 'answer' ELSE 'setup' END AS name FROM turns WHERE role IN ('user', 'system')),
    shown AS (SELECT *, CASE WHEN role = 'system' THEN 'missing mode' WHEN strpos(text, '.') > 0 AND length(text) % 7 = 0 THEN 'words is no integer' ELSE '' END AS faults,
        CASE role WHEN 'system' THEN '{"text":' || to_json(text) || '}'
            ELSE '{' || CASE WHEN strpos(text, ',') > 0 THEN '"quoted":' || to_json(substr(text, 1, strpos(text, ',') - 1)) || ',' ELSE '' END
                || '"text":' || to_json(text) || ',"words":' || CASE WHEN strpos(text, '.') > 0 AND length(text) % 7 = 0 THEN '"many"' ELSE len(string_split(text, ' '))::VARCHAR END || '}' END AS arguments
        FROM calls)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, id) AS step, id AS call_id, turn, CASE WHEN role = 'user' THEN answer_turn END AS result_turn,
        CASE WHEN faults <> '' THEN 'invalid' WHEN role = 'user' AND answer_turn IS NOT NULL THEN 'ok' ELSE 'unanswered' END AS status, faults,
        '{"arguments":' || arguments || ',"call_id":' || to_json(id) || ',"conv_id":' || conv_id || ',"name":"' || name || '","result":'
            || CASE WHEN role = 'user' AND answer IS NOT NULL THEN to_json(answer)::VARCHAR ELSE 'null' END || '}' AS json
    FROM shown""")
def op9_tool_calls(spark, sf_dir):
    """Turns as tool calls with their results, in order, checked and as JSON."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    own = F.concat_ws(":", "conv_id", "turn")
    text = F.col("text")
    many = F.when((F.instr(text, ".") > 0) & (F.length(text) % 7 == 0), F.lit('"many"')).otherwise(F.size(F.split(text, " ")).cast("string"))
    quoted = F.when(F.instr(text, ",") > 0, F.to_json(F.struct(F.substring_index(text, ",", 1).alias("quoted"))).substr(F.lit(2), F.length(text) * 6 + 20))
    plain = F.to_json(F.struct("text"))
    asked = F.concat(F.lit('{"words":'), many, F.lit(","), plain.substr(F.lit(2), F.length(plain) - 2), F.coalesce(F.concat(F.lit(","), quoted), F.lit("}")))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", own.alias("call_id"), "turn", F.when(F.col("role") == "user", "answer").otherwise("setup").alias("name"),
        F.when(F.col("role") == "user", asked).otherwise(plain).alias("arguments"),
        F.array(F.concat_ws(":", "conv_id", F.col("turn") - 2)).alias("after"))
    results = turns.where(F.col("role") == "assistant").select("conv_id", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    answers = results.join(calls.where("name = 'answer'").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    return tool_calls.linked_calls(calls, answers, spark.createDataFrame(TOOLS, "name string, parameter string, kind string, required boolean"))


@query("op10_exact_dedup", """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)""")
def op10_exact_dedup(spark, sf_dir):
    """Groups of equal texts, the largest id staying."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max").drop("digest")


def _vector_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds written out: books_k and near_k are the codebooks and assignments before and in round k."""
    book = f"books_0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"
    steps = [book]
    for k in range(rounds + 1):
        steps.append(f"""near_{k} AS (SELECT n, part, min(d * 1000 + entry) % 1000 AS entry, min(d * 1000 + entry) // 1000 AS d
            FROM (SELECT n, p.part, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN books_{k} b ON b.part = p.part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""books_{k + 1} AS (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM books_{k} b LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS c FROM (
                SELECT near.part, near.entry, i, floor(sum(v[i]) / count(*))::BIGINT AS m FROM near_{k} near JOIN p USING (n, part), unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL) m
                ON m.part = b.part AND m.entry = b.entry)""")
    return f"""
    WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT n, vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM kept, unnest(range(0, {parts})) AS u(part)),
    {", ".join(steps)},
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books_{rounds}),
    codes AS (SELECT n, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near_{rounds} GROUP BY n)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (n), digest"""


@query("op13_vector_codes", _vector_sql())
def op13_vector_codes(spark, sf_dir):
    """Product codes of all embeddings."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def _spelling_sql() -> str:
    """Near words by equal words without one place; crc32 byte by byte from its table, which a bitwise rule gives."""
    table_step = "list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)"
    return f"""
    WITH RECURSIVE bytes AS MATERIALIZED (SELECT list({table_step} ORDER BY b) AS t FROM (SELECT b::BIGINT AS b FROM unnest(range(0, 256)) AS u(b))),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
    coded AS (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)]), 4294967295::BIGINT)) AS h FROM coded, bytes),
    changed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    without AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM words, unnest(range(0, length(word))) AS u(k)),
    near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
    formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
        FROM words LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT w.word, w.root FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NULL) USING (word)"""


@query("op12_spelling", _spelling_sql())
def op12_spelling(spark, sf_dir):
    """Words of all documents with their near words, forms and roots."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
