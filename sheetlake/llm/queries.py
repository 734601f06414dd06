"""A query for each operator over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_text, jaccard_join, mixing, pii, quality_lm, secrets, spelling, topk, unigram, url_filter, vector_codes

#: A public SentencePiece vocabulary; the path is a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(_read(spark, sf_dir, "documents"))
    return clean.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(_read(spark, sf_dir, "documents"), MODEL, with_ids=False)


def op3_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.neighbour_pairs(_read(spark, sf_dir, "conversations"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = secrets.scan(_read(spark, sf_dir, "documents"))
    return clean.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(_read(spark, sf_dir, "pages"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_chat_pairs, op4_secrets, op5_topk, op6_mixing, op7_exact_dedup, op8_jaccard_join, op9_quality_lm, op10_html_text, op11_url_filter, op12_spelling, op13_vector_codes)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SAFE = "replace(coalesce({0}, {1}), '<|im_', '< |im_')"
_HEAD = f"'<|im_start|>' || {_SAFE.format('x.role', chr(39) + 'user' + chr(39))} || chr(10)"
_BODY = f"{_SAFE.format('x.text', chr(39) * 2)} || '<|im_end|>'"


def _render(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: {_HEAD} || {_BODY} || chr(10)), '')"


def _mask(turns: str) -> str:
    """Where the assistant's texts stand: after the turns before and their own head."""
    sizes = f"list_transform({turns}, lambda x: {{'head': length({_HEAD}), 'body': length({_BODY}), 'own': coalesce(x.role = 'assistant', false)}})"
    before = "CAST(coalesce(list_sum(list_transform(s[1:i - 1], lambda y: y.head + y.body + 1)), 0) AS BIGINT)"
    places = f"list_transform(list_filter(range(1, len(s) + 1), lambda i: s[i].own), lambda i: ({before} + s[i].head) || ':' || ({before} + s[i].head + s[i].body))"
    return f"(SELECT coalesce(array_to_string({places}, ','), '') FROM (SELECT {sizes} AS s))"


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)


def _lloyd(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds written out: the nearest entry of each part, then floored means."""
    def nearest(book: str) -> str:
        gap = "CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.c[i]) * (x.v[i] - b.c[i]))) AS BIGINT)"
        each = f"SELECT x.id, x.p, x.v, b.e, {gap} AS d FROM x JOIN {book} b ON x.p = b.p"
        return f"SELECT id, p, v, e, d FROM ({each}) QUALIFY row_number() OVER (PARTITION BY id, p ORDER BY d, e) = 1"

    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS ({nearest(f'b{i}')})")
        steps.append(f"""b{i + 1} AS (
            SELECT b.p, b.e, CASE WHEN n.c IS NULL THEN b.c ELSE n.c END AS c FROM b{i} b LEFT JOIN (
                SELECT p, e, list(m ORDER BY i) AS c FROM (
                    SELECT p, e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY p, e, i
                ) GROUP BY p, e
            ) n ON b.p = n.p AND b.e = n.e
        )""")
    return f"""
        WITH k AS MATERIALIZED (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS p)),
        b0 AS (SELECT p, id - 1 AS e, v AS c FROM x WHERE id <= {entries}),
        {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
        z AS MATERIALIZED ({nearest(f"b{rounds}")}),
        r AS (SELECT id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY id),
        h AS (SELECT lower(sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e))) AS codebooks_sha256 FROM b{rounds})
        SELECT k.vec_id, lower(r.code) AS code, r.error, CAST(sum(r.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN r USING (id), h
    """


#: crc32 by its rule: a table of 256 entries, each from eight steps of one byte.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))"

ORACLES = {
    "op11_url_filter": rf"""
        WITH r(host, path, verdict) AS (VALUES {_RULES}),
        u AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
        ),
        l AS (SELECT DISTINCT regexp_extract(host, '{url_filter.LISTED_HOST}', 1) AS host FROM u),
        b AS (
            SELECT u.host, u.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
            FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY 1, 2
        ),
        o AS (SELECT DISTINCT u.host FROM (SELECT DISTINCT host FROM u) u JOIN l ON l.host <> '' AND (u.host = l.host OR ends_with(u.host, '.' || l.host)))
        SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, CASE WHEN o.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM u LEFT JOIN b ON u.host = b.host AND u.path = b.path LEFT JOIN o ON u.host = o.host
    """,
    "op12_spelling": rf"""
        WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
        o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
        g AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM o GROUP BY 1, 2),
        x AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM g),
        c AS (
            SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS h
            FROM x, crc
        ),
        d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM c),
        v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
        i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        s AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM i),
        p AS MATERIALIZED (
            SELECT DISTINCT x.word, x.n, y.word AS near, y.n AS near_n FROM s x JOIN s y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT s.word, s.n, v.word, v.n FROM s JOIN v ON s.a || s.b = v.word UNION SELECT v.word, v.n, s.word, s.n FROM s JOIN v ON s.a || s.b = v.word
        ),
        q AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.near_n >= 10 * v.n THEN q.near END AS form, CASE WHEN q.near_n >= 10 * v.n THEN q.near_n END AS form_n FROM v LEFT JOIN q USING (word)),
        w(word, last, form) AS (SELECT word, word, form FROM f UNION ALL SELECT w.word, f.word, f.form FROM w JOIN f ON w.form = f.word)
        SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON f.word = w.word AND w.form IS NULL
    """,
    "op13_vector_codes": _lloyd(),
    "op3_chat_pairs": f"""
        WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, {{'role': role, 'text': text}} AS x FROM conversations WHERE conv_id IS NOT NULL),
        g AS (
            SELECT pair_id, coalesce(list(x ORDER BY turn NULLS FIRST, x.role NULLS FIRST, x.text NULLS FIRST) FILTER (side = 0), []) AS c,
                coalesce(list(x ORDER BY turn NULLS FIRST, x.role NULLS FIRST, x.text NULLS FIRST) FILTER (side = 1), []) AS r FROM t GROUP BY 1
        ),
        n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))) AS n_prefix FROM g),
        s AS (SELECT pair_id, n_prefix, c[1:n_prefix] AS p, c[n_prefix + 1:] AS c, r[n_prefix + 1:] AS r FROM n)
        SELECT pair_id, n_prefix, {_render('p')} AS prompt, {_render('c')} AS chosen, {_mask('c')} AS chosen_mask, {_render('r')} AS rejected, {_mask('r')} AS rejected_mask,
            len(list_filter(c, lambda x: x.role = 'assistant')) > 0 AND len(list_filter(r, lambda x: x.role = 'assistant')) > 0 AS usable FROM s
    """,
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)
    """,
    "op8_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM w
        ),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, s.s
    """,
}
