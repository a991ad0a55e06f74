"""Registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.llm import ann, chat, codes, langid, lm, mixing, negatives, packing, quality, secretscan, simhash, urlfilter, warc
from lodestone.llm.tables import crc_mod, read
from lodestone.session import broadcast_if_small

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/"),
]
# Page keys go on the block list if a label of their host has one of these words between hyphens.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    flags = docs.select("doc_id", "text").withColumn("held_out", held_out)
    return langid.predict(flags, model).withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.dialogues(chat.turns(read(spark, sf_dir, "conversations")))


def listed_page(host: Column, path: Column) -> Column:
    return host.rlike(rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES, listed_page)


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm.score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2)


def op6_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, max_repeats=2.0).drop("text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.train(secretscan.labelled_samples(docs)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, max_bits=3)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op11_adaptive_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    sums = found.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.rows.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.read(warc.write(pages)).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_perspectives, op3_url_filter, op4_best_two_fit, op5_deleted_interpolation, op6_block_join,
        op7_temperature_mix, op8_secret_scan, op9_simhash, op10_quality, op11_adaptive_codes, op12_warc, op13_hard_negatives,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_URL = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"


def _rule_case(value: Callable[[urlfilter.Rule], str]) -> str:
    whens = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'"
        for r in sorted(URL_RULES, key=lambda r: (len(r.name), len(r.host)), reverse=True)
    ]
    return "CASE " + " ".join(whens) + " END"


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_GRID = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_ROUNDS = 2


def _nearest(book: str) -> str:
    """The nearest entry of every part: (row, part, entry, distance)."""
    return f"""(
        SELECT n, part, d // 64 AS distance, d % 64 AS entry FROM (
            SELECT p.n, p.part, min(64 * list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + b.entry) AS d
            FROM parts p JOIN {book} b ON p.part = b.part GROUP BY p.n, p.part
        )
    )"""


def _codes_sql() -> str:
    """Every round as CTEs of its own: assignments a1, a2, ..., books b0, b1, ..."""
    steps = []
    for r in range(_ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED {_nearest(f'b{r}')}")
        if r < _ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
                SELECT part, entry, list(v ORDER BY j) AS v FROM (
                    SELECT b.part, b.entry, b.j, coalesce((s.total - ((s.total % s.n) + s.n) % s.n) // s.n, b.v) AS v
                    FROM (SELECT part, entry, unnest(v) AS v, unnest(range(len(v))) AS j FROM b{r}) b LEFT JOIN (
                        SELECT part, entry, j, sum(x)::BIGINT AS total, count(*) AS n FROM (
                            SELECT a.part, a.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS j
                            FROM a{r} a JOIN parts p ON a.n = p.n AND a.part = p.part
                        ) GROUP BY ALL
                    ) s USING (part, entry, j)
                ) GROUP BY part, entry
            )""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, {_GRID}) AS n, vec_id, label, {_GRID} AS g FROM embeddings WHERE {_FINITE}
        ), parts AS MATERIALIZED (
            SELECT n, part, g[part * (len(g) // 16) + 1 : (part + 1) * (len(g) // 16)] AS v FROM kept, range(16) t(part)
        ), b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v FROM parts WHERE n <= 64), {", ".join(steps)},
        coded AS (
            SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a{_ROUNDS} GROUP BY n
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{_ROUNDS}
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (n), digest
    """


SQL = {
    "op2_perspectives": rf"""
        WITH m AS (
            SELECT *, replace(coalesce(text, ''), '<|im_', '<\|im_') AS body,
                replace(role, '<|im_', '<\|im_') AS name
            FROM conversations
        ), people AS (
            SELECT DISTINCT conv_id, role AS participant FROM m WHERE role IS NOT NULL AND role <> 'system'
        ), heads AS (
            SELECT m.*, participant, CASE
                WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
                WHEN role = participant THEN '<|im_start|>assistant' || chr(10)
                WHEN role IS NULL THEN '<|im_start|>user' || chr(10)
                ELSE '<|im_start|>user name=' || regexp_replace(name, '\s', '_', 'g') || chr(10) END AS head
            FROM m JOIN people ON m.conv_id IS NOT DISTINCT FROM people.conv_id
        ), pieces AS (
            SELECT *, head || body || '<|im_end|>' || chr(10) AS piece,
                row_number() OVER w AS n
            FROM heads
            WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role NULLS FIRST, body)
        ), placed AS (
            SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, participant ORDER BY n
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM pieces
        )
        SELECT conv_id, participant, CAST(start // {chat.PART_CHARS} AS INT) AS part, count(*) AS n_turns,
            string_agg(piece, '' ORDER BY n) AS text,
            coalesce(string_agg(CAST(start + length(head) AS BIGINT) || ':' || CAST(start + length(piece) - 1 AS BIGINT), ','
                ORDER BY n) FILTER (WHERE role = participant), '') AS mask
        FROM placed GROUP BY ALL
    """,
    "op3_url_filter": rf"""
        WITH parts AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, {_URL}, 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                coalesce(regexp_extract(url, {_URL}, 2), '') AS path
            FROM pages
        )
        SELECT page_id, host, path, {_rule_case(lambda r: r.name)} AS rule,
            coalesce({_rule_case(lambda r: r.verdict)},
                CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(LISTED_WORDS)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts
    """,
    "op6_block_join": """
        WITH usable AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER () AS n FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
            FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.n <> c.n
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_adaptive_codes": _codes_sql(),
    "op12_warc": """
        WITH records AS (
            SELECT page_id, coalesce(html, '') AS body, row_number() OVER () AS n FROM pages
        ), placed AS (
            SELECT *, octet_length(encode(body)) AS payload_bytes,
                row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, n DESC) = 1 AS newest,
                max(page_id) OVER (PARTITION BY body) AS top
            FROM records
        )
        SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
            CASE WHEN newest OR payload_bytes < 1000 THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN newest OR payload_bytes < 1000 THEN NULL ELSE top END AS refers_to
        FROM placed
    """,
    "op13_hard_negatives": f"""
        WITH rows_ AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_GRID} AS g, row_number() OVER () AS n
            FROM embeddings WHERE label IS NOT NULL AND {_FINITE}
        ), scored AS MATERIALIZED (
            SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_sum(list_transform(list_zip(a.g, c.g), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM rows_ a JOIN rows_ c ON a.vec_id % 100 = 0 AND a.n <> c.n AND len(a.g) = len(c.g)
        ), positives AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same) WHERE place <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INT) AS rank
            FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
}
