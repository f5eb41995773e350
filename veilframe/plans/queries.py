"""The library's queries over whole tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import names as N
from ..functions.categories import categories, category_class, category_tone, values_sql
from ..operators import anonymize as A
from ..operators import batch, crypto, filenames, history, maplink, report, restore, review, rules, segments, spans
from ..operators.detect import DETECTORS, detect, detect_native
from ..sources.files import excluded_categories, spread
from ..streaming.streams import event_windows
from . import pipelines as P

#: Categories that the test tables hold.
HERE = ("PHONE", "EMAIL", "IP_ADDRESS", "API_KEY", "PAYMENT_CARD")
EXCLUDED = ("IP_ADDRESS",)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"), key="doc_id")


def found(docs: DataFrame) -> DataFrame:
    return spans.normalize(detect(docs, categories=HERE))


def reviewed(docs: DataFrame) -> DataFrame:
    return spans.reject_excluded(found(docs), EXCLUDED)


def done(docs: DataFrame) -> P.Anonymized:
    """Spans are kept, as several outputs need them and they are far smaller than the texts they cost a scan of."""
    return P.from_spans(docs, reviewed(docs).persist(StorageLevel.MEMORY_AND_DISK))


def _pattern(category: str) -> str:
    return DETECTORS[category][0].replace("'", "''")


RAW_SQL = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, regexp_extract_all(text, '{_pattern(c)}') AS m, string_split_regex(text, '{_pattern(c)}') AS g FROM documents" for c in HERE)
LUHN_SQL = "CAST(list_sum(list_transform(range(1, length(text) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(text, length(text) - k + 1, 1) AS INTEGER) WHEN CAST(substr(text, length(text) - k + 1, 1) AS INTEGER) > 4 THEN CAST(substr(text, length(text) - k + 1, 1) AS INTEGER) * 2 - 9 ELSE CAST(substr(text, length(text) - k + 1, 1) AS INTEGER) * 2 END)) AS INTEGER) % 10 = 0"
#: spans: what is found, without overlaps; rev: with the excluded category rejected.
SPANS_SQL = f"""
WITH dim(category, ord, prefix, tone) AS (VALUES {values_sql()}),
raw AS ({RAW_SQL}),
hit AS (SELECT doc_id, category, m[i] AS text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
chk AS (SELECT doc_id, category, ord, prefix, text, s, CAST(s + length(text) AS INTEGER) AS e,
               CASE WHEN category <> 'PAYMENT_CARD' THEN 'not_applicable' WHEN {LUHN_SQL} THEN 'passed' ELSE 'failed' END AS validation
        FROM hit JOIN dim USING (category)
        WHERE category <> 'IP_ADDRESS' OR list_max(list_transform(string_split(text, '.'), lambda x: CAST(x AS INTEGER))) <= 255),
res AS (SELECT * FROM chk a WHERE NOT EXISTS (SELECT 1 FROM chk b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e
        AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND (b.ord < a.ord OR (b.ord = a.ord AND b.s < a.s)))))),
spans AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, e, category) - 1 AS INTEGER) AS idx, 'value:' || category || ':' || text AS gid FROM res),
rev AS (SELECT *, s || '-' || e || '-' || category || '-' || idx AS id, CASE WHEN category = 'IP_ADDRESS' THEN 'rejected' ELSE 'accepted' END AS status FROM spans),
grp AS (SELECT doc_id, gid, min(category) AS category, min(prefix) AS prefix, min(text) AS label, count(*) AS n, count(*) FILTER (status = 'accepted') AS n_accepted,
               count(*) FILTER (status = 'rejected') AS n_rejected, arg_min(id, idx) AS first_id, min(s) AS first_start, min(idx) AS first_idx FROM rev GROUP BY doc_id, gid),
tok AS (SELECT rev.*, token FROM rev JOIN (SELECT doc_id, gid, '[' || prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY first_start, label, first_idx) || ']' AS token
               FROM grp WHERE n_accepted > 0) USING (doc_id, gid) WHERE status = 'accepted'),
off AS (SELECT doc_id, s AS original_start, e AS original_end, CAST(s + coalesce(sum(length(token) - (e - s)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS a, token, category, text AS was FROM tok),
anon AS (SELECT d.doc_id, coalesce(p.out, '') || substr(d.text, coalesce(p.last, 0) + 1) AS anonymized_text, coalesce(p.n, 0) AS n_replaced
         FROM documents d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS out, max(e) AS last, count(*) AS n FROM
           (SELECT t.doc_id, t.s, t.e, substr(d.text, lag(t.e, 1, 0) OVER w + 1, t.s - lag(t.e, 1, 0) OVER w) || token AS piece FROM tok t JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY t.doc_id ORDER BY t.s)) GROUP BY doc_id) p USING (doc_id))
"""


# Detection


def _detect_query(name: str, category: str):
    def run(spark, sf_dir):
        return detect(documents(spark, sf_dir), categories=[category]).select("doc_id", "start", "end", "text", "validation")

    run.__name__ = name
    one = SPANS_SQL.split("res AS (")[0].rstrip().rstrip(",")
    return query(f"{one} SELECT doc_id, s AS start, e AS \"end\", text, validation FROM chk WHERE category = '{category}'")(run)


for _name, _category in (("detect_email", "EMAIL"), ("detect_ipv4", "IP_ADDRESS"), ("detect_phone", "PHONE"), ("detect_secret", "API_KEY"), ("detect_card_luhn", "PAYMENT_CARD")):
    _detect_query(_name, _category)


@query(f"{SPANS_SQL} SELECT doc_id, s AS start, e AS \"end\", text, category, validation FROM spans")
def overlap_resolved_spans(spark, sf_dir):
    return detect(documents(spark, sf_dir), categories=HERE).select("doc_id", "start", "end", "text", "category", "validation")


@query(re.sub("res AS .*", "", SPANS_SQL, flags=re.S).rstrip().rstrip(",") + " SELECT doc_id, s AS start, e AS \"end\", text, category FROM chk WHERE category = 'EMAIL'")
def detect_native_email(spark, sf_dir):
    return detect_native(documents(spark, sf_dir), DETECTORS["EMAIL"][0], "EMAIL")


@query()
def detect_all(spark, sf_dir):
    return detect(documents(spark, sf_dir))


@query(f"{SPANS_SQL} SELECT doc_id, id, text, category, 'regex' AS source, 'accepted' AS status, gid AS entity_group_id, text AS canonical_text FROM rev")
def normalize_entities(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return spans.normalize(detect(docs, categories=HERE), docs).select("doc_id", "id", "text", "category", "source", "status", "entity_group_id", "canonical_text")


@query(f"{SPANS_SQL} SELECT doc_id, id, status FROM rev")
def exclude_categories(spark, sf_dir):
    return reviewed(documents(spark, sf_dir)).select("doc_id", "id", "status")


# Groups and counts


@query(f"{SPANS_SQL} SELECT doc_id, gid AS entity_group_id, category, label, n, n_accepted, n_rejected, first_id, first_start FROM grp")
def entity_groups(spark, sf_dir):
    return spans.entity_groups(reviewed(documents(spark, sf_dir))).drop("first_idx")


@query(f"{SPANS_SQL} SELECT doc_id, gid AS entity_group_id, '[' || prefix || '_' || row_number() OVER (PARTITION BY doc_id, prefix ORDER BY first_start, label, first_idx) || ']' AS token FROM grp")
def group_tokens(spark, sf_dir):
    return spans.numbered_groups(spans.entity_groups(reviewed(documents(spark, sf_dir)))).select("doc_id", "entity_group_id", "token")


@query(f"{SPANS_SQL} SELECT category, count(*) AS n FROM rev GROUP BY category")
def category_histogram(spark, sf_dir):
    return spans.count_by_category(reviewed(documents(spark, sf_dir)))


@query(f"{SPANS_SQL} SELECT category, CAST(ord AS INTEGER) AS ord, count(*) AS n, bool_or(status = 'accepted') AS is_on, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM rev WHERE category <> 'PUBLIC_INSTITUTION' GROUP BY category, ord")
def category_legend(spark, sf_dir):
    return spans.category_legend(reviewed(documents(spark, sf_dir)))


@query(f"{SPANS_SQL} SELECT count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (lower(status) <> 'rejected') AS accepted_leniently FROM rev")
def accepted_count(spark, sf_dir):
    own = reviewed(documents(spark, sf_dir))
    counts = [keep(own).agg(F.count("*").alias(n)) for keep, n in ((spans.accepted, "accepted"), (spans.accepted_leniently, "accepted_leniently"))]
    return counts[0].join(counts[1])  # one row each


@query(f"{SPANS_SQL} SELECT DISTINCT doc_id, gid AS entity_group_id FROM rev WHERE validation = 'failed'")
def uncertain_groups(spark, sf_dir):
    return spans.uncertain_groups(reviewed(documents(spark, sf_dir)))


@query(f"{SPANS_SQL} SELECT grp.doc_id, grp.category, CAST(ord AS INTEGER) AS ord, count(*) AS n_groups, count(*) FILTER (n_accepted > 0) AS n_marked, grp.category = 'PUBLIC_INSTITUTION' AS apart FROM grp JOIN dim USING (category) GROUP BY ALL")
def category_sections(spark, sf_dir):
    return spans.category_sections(spans.entity_groups(reviewed(documents(spark, sf_dir))))


@query(f"WITH dim(category, ord, prefix, tone) AS (VALUES {values_sql()}) SELECT category, CAST(ord AS INTEGER) AS ord, prefix, tone FROM dim")
def category_dimension(spark, sf_dir):
    return categories(spark).select("category", "ord", "prefix", "tone")


@query(f"{SPANS_SQL}, c AS (SELECT d.source, gid, prefix, min((rev.doc_id, s, idx)) AS o FROM rev JOIN documents d USING (doc_id) WHERE status = 'accepted' GROUP BY ALL) SELECT source, gid AS entity_group_id, '[' || prefix || '_' || row_number() OVER (PARTITION BY source, prefix ORDER BY o) || ']' AS token FROM c")
def case_numbering(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = spans.accepted(reviewed(docs)).drop("source").join(docs.select("doc_id", "source"), "doc_id")
    return spans.case_numbering(own, case_col="source").select("source", "entity_group_id", "token")


SEED_SQL = f"""{SPANS_SQL}, c AS (SELECT d.source, gid, prefix, min((rev.doc_id, s, idx)) AS o, min(text) AS label FROM (SELECT doc_id, s, idx, gid, prefix, text, status FROM rev) rev JOIN (SELECT doc_id, source FROM documents) d USING (doc_id) WHERE status = 'accepted' GROUP BY ALL),
seed AS (SELECT source, arg_min(gid, o) AS gid FROM c WHERE prefix = 'EMAIL' GROUP BY source)
SELECT source, gid AS entity_group_id, '[EMAIL_7]' AS token FROM seed UNION ALL
SELECT c.source, c.gid, '[' || prefix || '_' || (row_number() OVER (PARTITION BY c.source, prefix ORDER BY o) + CASE WHEN prefix = 'EMAIL' AND t.source IS NOT NULL THEN 7 ELSE 0 END) || ']'
FROM c LEFT JOIN (SELECT source FROM seed) t ON t.source = c.source WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.source = c.source AND s.gid = c.gid)"""


@query(SEED_SQL)
def case_seeded_numbering(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = spans.accepted(reviewed(docs)).drop("source").join(docs.select("doc_id", "source"), "doc_id")
    first = own.filter("category = 'EMAIL'").groupBy("source").agg(F.min_by("canonical_text", F.struct("doc_id", "start", "idx")).alias("canonical_text"))
    seed = first.select("source", F.lit("[EMAIL_7]").alias("token"), F.lit("EMAIL").alias("category"), "canonical_text")
    return spans.case_numbering(own, case_col="source", seed=seed).select("source", "entity_group_id", "token")


# Anonymising


@query(f"{SPANS_SQL} SELECT doc_id, anonymized_text, CAST(n_replaced AS INTEGER) AS n_replaced FROM anon")
def anonymize_documents(spark, sf_dir):
    return done(documents(spark, sf_dir)).texts


@query(f"{SPANS_SQL} SELECT doc_id, original_start, original_end, a AS anonymized_start, CAST(a + length(token) AS INTEGER) AS anonymized_end, token, category FROM off")
def offset_map(spark, sf_dir):
    return done(documents(spark, sf_dir)).offsets


@query(f"{SPANS_SQL} SELECT doc_id, token, min(category) AS category, min(text) AS canonical_text, array_to_string(list_sort(list(DISTINCT text)), '|') AS variants FROM tok GROUP BY doc_id, token")
def replacement_map(spark, sf_dir):
    return done(documents(spark, sf_dir)).entries.withColumn("variants", F.array_join("variants", "|"))


@query(f"{SPANS_SQL} SELECT anon.doc_id, coalesce(bool_or(contains(anonymized_text, tok.text)), false) AS leaks FROM anon LEFT JOIN tok USING (doc_id) GROUP BY anon.doc_id")
def leak_check(spark, sf_dir):
    out = done(documents(spark, sf_dir))
    return A.leaks(out.texts, out.entries)


@query(f"{SPANS_SQL} SELECT d.doc_id, coalesce(nullif(count(tok.s), 0), 0) AS occurrences FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id")
def occurrence_count(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = done(docs)
    return report.occurrence_count(docs, out.offsets, out.maps)


@query(f"{SPANS_SQL}, m AS (SELECT source, doc_id, count(DISTINCT token) AS n FROM tok JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY ALL) SELECT source, arg_max(doc_id, n * 1000000000 - doc_id) AS doc_id, max(n) AS n_entries FROM m GROUP BY source")
def largest_map(spark, sf_dir):
    docs = documents(spark, sf_dir)
    maps = done(docs).maps.join(docs.select("doc_id", "source"), "doc_id")
    return A.largest_map(maps, order_col="doc_id", by="source").select("source", "doc_id", F.size("entries").cast("long").alias("n_entries"))


@query()
def pseudonymize(spark, sf_dir):
    return A.pseudonymize(done(documents(spark, sf_dir)).tokens).select("doc_id", "start", "end", "token", "label", F.to_json("fake_forms").alias("fake_forms"))


# Reports


@query(f"{SPANS_SQL} SELECT doc_id, token, arg_max(category, s) AS category, count(*) AS occurrences FROM tok GROUP BY doc_id, token")
def report_tokens(spark, sf_dir):
    return report.token_report(done(documents(spark, sf_dir)).offsets).drop("pos")


@query(f"{SPANS_SQL} SELECT doc_id, count(*) AS detected, count(*) FILTER (status = 'rejected') AS rejected, CAST(0 AS BIGINT) AS manual FROM rev GROUP BY doc_id")
def report_counts(spark, sf_dir):
    return report.count_report(reviewed(documents(spark, sf_dir)))


@query("SELECT doc_id, sha256(text) AS source_sha256 FROM documents")
def document_sha256(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("source_sha256"))


# Segments


def _between(text: str, marks: str, kind: str, n: str) -> str:
    """Segments of texts (doc_id, text) around marks (doc_id, b, e, token), ordered and free of overlaps."""
    return f"""gap AS (SELECT doc_id, b, e, token, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS p FROM ({marks})),
seg AS (SELECT doc_id, '{kind}' AS type, b, e, token FROM gap UNION ALL SELECT doc_id, 'text', p, b, NULL FROM gap WHERE b > p
        UNION ALL SELECT d.doc_id, 'text', coalesce(l, 0), length(d.x), NULL FROM ({text}) d LEFT JOIN (SELECT doc_id, max(e) AS l FROM gap GROUP BY doc_id) USING (doc_id) WHERE length(d.x) > coalesce(l, 0))
SELECT seg.doc_id, CAST(row_number() OVER (PARTITION BY seg.doc_id ORDER BY b) - 1 AS INTEGER) AS pos, type, CAST(b AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substr(d.x, CAST(b AS BIGINT) + 1, CAST(e - b AS BIGINT)) AS text, token AS {n} FROM seg JOIN ({text}) d USING (doc_id)"""


@query(f"{SPANS_SQL}, " + _between("SELECT doc_id, text AS x FROM documents", "SELECT doc_id, original_start AS b, original_end AS e, token FROM off", "replacement", "id"))
def comparison_original(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return segments.comparison_segments(docs, done(docs).offsets, "original")


@query(f"{SPANS_SQL}, " + _between("SELECT doc_id, anonymized_text AS x FROM anon", "SELECT doc_id, a AS b, a + length(token) AS e, token FROM off", "replacement", "id"))
def comparison_anonymized(spark, sf_dir):
    out = done(documents(spark, sf_dir))
    return segments.comparison_segments(out.texts, out.offsets, "anonymized", text_col="anonymized_text")


def _two_pages(docs: DataFrame) -> DataFrame:
    """Texts with blank lines between their lines, on two pages."""
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return docs.select("doc_id", F.concat(body, F.lit("\f"), body).alias("text"))


BLOCKS_SQL = """
WITH two AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
cut AS (SELECT doc_id, string_split(regexp_replace(t || chr(12) || t, '(\\f|\\n{2,})', '\\1' || chr(1), 'g'), chr(1)) AS p FROM two),
prt AS (SELECT doc_id, i AS part, p[i] AS piece FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut) WHERE p[i] <> ''),
pos AS (SELECT *, coalesce(sum(length(piece)) OVER w, 0) AS o, 1 + coalesce(sum(length(piece) - length(replace(piece, chr(12), ''))) OVER w, 0) AS page FROM prt WINDOW w AS (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chunk AS (SELECT *, unnest(range(0, (length(piece) - 1) // 5000 + 1)) AS k FROM pos),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1 AS INTEGER) AS idx, CAST(o + k * 5000 AS INTEGER) AS start, CAST(page AS INTEGER) AS page, substr(piece, k * 5000 + 1, 5000) AS text FROM chunk)
"""


@query(BLOCKS_SQL + "SELECT doc_id, idx, 'block-' || idx AS block_id, start, CAST(start + length(text) AS INTEGER) AS \"end\", page, text FROM blocks")
def split_blocks(spark, sf_dir):
    return segments.split_blocks(_two_pages(documents(spark, sf_dir)))


@query(BLOCKS_SQL + "SELECT doc_id, CAST(greatest(1, ceil(count(*) / 32)) AS INTEGER) AS pages FROM blocks GROUP BY doc_id")
def paginate_blocks(spark, sf_dir):
    return segments.paginate(segments.split_blocks(_two_pages(documents(spark, sf_dir))))


@query(BLOCKS_SQL + "SELECT b.doc_id, 'middle' AS point_id, min(idx) AS idx, CAST(min(idx) // 32 AS INTEGER) AS page_index FROM blocks b JOIN documents d ON d.doc_id = b.doc_id AND length(d.text) // 2 >= b.start AND length(d.text) // 2 < b.start + length(b.text) GROUP BY b.doc_id")
def focus_block(spark, sf_dir):
    docs = documents(spark, sf_dir)
    points = docs.select("doc_id", F.lit("middle").alias("point_id"), F.floor(F.length("text") / 2).alias("point"))
    return segments.focus_block(segments.split_blocks(_two_pages(docs)), points)


SEGMENTS_SQL = f"""{SPANS_SQL},
blk AS (SELECT doc_id, CAST(k AS INTEGER) AS idx, CAST(k * 5000 AS INTEGER) AS bs, least((k + 1) * 5000, length(text)) AS be, text FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 5000 + 1)) AS k FROM documents WHERE length(text) > 0)),
mrk AS (SELECT blk.doc_id, blk.idx, greatest(s, bs) AS b, least(e, be) AS e, id FROM blk JOIN rev ON rev.doc_id = blk.doc_id AND rev.e > bs AND rev.s < be),
gap AS (SELECT mrk.doc_id, mrk.idx, b, e, id, coalesce(lag(e) OVER (PARTITION BY mrk.doc_id, mrk.idx ORDER BY b), bs) AS p FROM mrk JOIN blk USING (doc_id, idx)),
seg AS (SELECT doc_id, idx, 'entity' AS type, b, e, id FROM gap UNION ALL SELECT doc_id, idx, 'text', p, b, NULL FROM gap WHERE b > p
        UNION ALL SELECT doc_id, idx, 'text', coalesce(l, bs), be, NULL FROM blk LEFT JOIN (SELECT doc_id, idx, max(e) AS l FROM gap GROUP BY ALL) USING (doc_id, idx) WHERE be > coalesce(l, bs))
SELECT seg.doc_id, seg.idx, CAST(row_number() OVER (PARTITION BY seg.doc_id, seg.idx ORDER BY b) - 1 AS INTEGER) AS pos, type, CAST(b AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substr(d.text, b + 1, e - b) AS text, id FROM seg JOIN documents d USING (doc_id)"""


@query(SEGMENTS_SQL)
def segment_blocks(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text", F.translate("text", "\f", " "))
    one = docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 5000).cast("int")), lambda i: F.substr(F.col("text"), i * 5000 + 1, F.lit(5000)))).alias("idx", "text")).filter("text <> ''")
    blocks = one.withColumn("start", (F.col("idx") * 5000).cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    return segments.segment_blocks(blocks, reviewed(docs))


# Restoring


@query("SELECT doc_id, text AS original_text, CAST(0 AS INTEGER) AS n_warnings FROM documents")
def deanonymize_documents(spark, sf_dir):
    out = done(documents(spark, sf_dir))
    return restore.deanonymize(out.texts, out.maps).select("doc_id", "original_text", F.size("warnings").alias("n_warnings"))


@query("SELECT doc_id, true AS equal FROM documents")
def roundtrip_equal(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = done(docs)
    return restore.deanonymize(out.texts, out.maps).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", (F.col("original_text") == F.col("text")).alias("equal"))


@query(f"{SPANS_SQL}, " + _between("SELECT doc_id, text AS x FROM documents", "SELECT doc_id, original_start AS b, original_end AS e, token FROM off", "restored", "token"))
def restored_segments(spark, sf_dir):
    out = done(documents(spark, sf_dir))
    return restore.restored_segments(out.texts, out.entries)


def _answers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anonymised texts as an assistant might return them, with their maps."""
    out = done(docs)
    texts = out.texts.select("doc_id", F.concat("anonymized_text", F.lit(" [OSOBA_9] [EMAIL 1] [email-1] [Email_1] [PKT 3a] [art. 5] [Url_3] [OSOBA_9]")).alias("text"))
    return texts, out.maps


UNRESTORABLE_SQL = f"{SPANS_SQL}, has AS (SELECT doc_id, bool_or(prefix = 'EMAIL') AS email FROM tok GROUP BY doc_id) SELECT d.doc_id, '[OSOBA_9]|[EMAIL 1]' || CASE WHEN coalesce(email, false) THEN '|[email-1]|[Email_1]' ELSE '' END AS tokens FROM documents d LEFT JOIN has USING (doc_id)"


@query(UNRESTORABLE_SQL)
def unrestorable_tokens(spark, sf_dir):
    texts, maps = _answers(documents(spark, sf_dir))
    return restore.restore_warnings(texts, maps).select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query(f"SELECT n, count(*) AS documents FROM (SELECT len(string_split(tokens, '|')) AS n FROM ({UNRESTORABLE_SQL})) GROUP BY n")
def restore_warning_count(spark, sf_dir):
    texts, maps = _answers(documents(spark, sf_dir))
    return restore.restore_warnings(texts, maps).groupBy(F.size("tokens").cast("long").alias("n")).agg(F.count("*").alias("documents"))


# Choosing maps


def _returned(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every anonymised document as a returned file, every map as a candidate within its source."""
    out = done(docs)
    where = docs.select("doc_id", F.col("source").alias("case"))
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit("_anon_v2 (3).txt"))).otherwise("answer.txt")
    files = out.texts.join(where, "doc_id").select(F.col("doc_id").alias("file_id"), "case", name.alias("file_name"), F.col("anonymized_text").alias("text"))
    maps = out.maps.join(where, "doc_id").select(F.col("doc_id").alias("map_id"), "case", (-F.col("doc_id")).alias("recency_rank"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_name"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit("_anon.txt")).alias("output_name"), F.lit(None).cast("string").alias("map_file_name"))
    entries = out.entries.join(where, "doc_id").select(F.col("doc_id").alias("map_id"), "case", "token", "category", "canonical_text", F.lit(None).cast("map<string,string>").alias("fake_forms"))
    return files, maps, entries


SCORES_SQL = f"""{SPANS_SQL}, en AS (SELECT DISTINCT t.doc_id, d.source, t.token, t.text AS v FROM (SELECT doc_id, token, min(text) AS text FROM tok GROUP BY ALL) t JOIN documents d USING (doc_id)),
sc AS (SELECT f.doc_id AS file_id, m.doc_id AS map_id, count(DISTINCT m.token) AS score FROM en f JOIN en m ON f.source = m.source AND f.token = m.token GROUP BY ALL)"""


@query(f"{SCORES_SQL} SELECT file_id, map_id, score FROM sc")
def map_scores(spark, sf_dir):
    files, _, entries = _returned(documents(spark, sf_dir))
    return maplink.map_scores(files, entries, by=("case",))


CHOOSE_SQL = f"""{SCORES_SQL},
st AS (SELECT *, CASE WHEN file_id % 2 = 0 AND file_id = map_id THEN length('doc ' || map_id) ELSE 0 END AS strength FROM sc),
top AS (SELECT * FROM (SELECT *, max(strength) OVER w AS ms, max(score) OVER w AS mx FROM st WINDOW w AS (PARTITION BY file_id)) WHERE CASE WHEN ms > 0 THEN strength = ms ELSE score = mx END),
k AS (SELECT top.file_id, top.map_id, string_agg(m.token || '=' || m.v, '|' ORDER BY m.token) AS key FROM top JOIN en m ON m.doc_id = top.map_id JOIN en f ON f.doc_id = top.file_id AND f.token = m.token GROUP BY ALL),
r AS (SELECT file_id, key, max(map_id) AS map_id FROM k GROUP BY ALL)
SELECT d.doc_id AS file_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS choice, coalesce(ids, '') AS map_ids
FROM documents d LEFT JOIN (SELECT file_id, count(*) AS n, string_agg(map_id, ',' ORDER BY map_id DESC) AS ids FROM r GROUP BY file_id) c ON c.file_id = d.doc_id"""


@query(CHOOSE_SQL)
def choose_map(spark, sf_dir):
    return maplink.choose_maps(*_returned(documents(spark, sf_dir)), by=("case",)).withColumn("map_ids", F.array_join(F.transform("map_ids", lambda x: x.cast("string")), ","))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length('doc ' || doc_id) + 1000000 ELSE length('doc ' || doc_id) END AS strength FROM documents")
def link_strength(spark, sf_dir):
    name = lambda end: F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(end))
    file = F.when(F.col("doc_id") % 2 == 0, name("_anon_restored.docx")).otherwise(name(" final.docx"))
    return table(spark, sf_dir, "documents").select("doc_id", N.link_strength(file, [name("_anon.docx"), F.lit("x"), F.lit(None).cast("string")]).alias("strength"))


@query("SELECT doc_id, 'doc ' || doc_id || ' ' || lang AS stem FROM documents")
def normalized_stem(spark, sf_dir):
    name = F.concat(F.lit("C:\\files/Doc "), F.col("doc_id").cast("string"), F.lit(" "), F.upper("lang"), F.lit("_anon_restored (2).docx"))
    return table(spark, sf_dir, "documents").select("doc_id", N.normalized_stem(name).alias("stem"))


@query(f"SELECT c.file_id, CASE choice WHEN 'none' THEN 'no_map' WHEN 'ambiguous' THEN 'ambiguous_map' ELSE 'ok' END AS outcome, CASE WHEN choice = 'found' THEN d.text END AS restored_text, CAST(NULL AS VARCHAR) AS message FROM ({CHOOSE_SQL}) c JOIN documents d ON d.doc_id = c.file_id")
def restore_files(spark, sf_dir):
    files, maps, entries = _returned(documents(spark, sf_dir))
    return P.restore_files(files, maps, entries, by=("case",))


@query(f"{SPANS_SQL} SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN n_replaced = 0 THEN 'nothing_found' ELSE 'ok' END AS outcome, CAST(n_replaced AS BIGINT) AS n_replaced FROM anon JOIN documents USING (doc_id)")
def clipboard_outcome(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return P.clipboard_outcome(docs, done(docs))


# Review


def _review_query(name: str, edits: list[tuple], sql: str):
    def run(spark, sf_dir):
        out = review.replay(reviewed(documents(spark, sf_dir)), edits)
        return out.select("doc_id", "id", "category", "status", "canonical_text", "entity_group_id")

    run.__name__ = name
    return query(f"{SPANS_SQL} SELECT doc_id, id, {sql} FROM rev")(run)


_review_query("set_category_status", [("category_status", "EMAIL", "rejected")], "category, CASE WHEN category = 'EMAIL' THEN 'rejected' ELSE status END AS status, text AS canonical_text, gid AS entity_group_id")
_review_query(
    "edit_log_replay",
    [("category_status", "PHONE", "rejected"), ("category_status", "IP_ADDRESS", "accepted"), ("category_status", "IP_ADDRESS", "rejected"), ("category_status", "API_KEY", "rejected"), ("category_status", "API_KEY", "accepted")],
    "category, CASE WHEN category IN ('PHONE', 'IP_ADDRESS') THEN 'rejected' ELSE 'accepted' END AS status, text AS canonical_text, gid AS entity_group_id",
)


@query(f"{SPANS_SQL} SELECT doc_id, id, 'CUSTOM' AS category, text AS canonical_text, 'value:CUSTOM:' || text AS entity_group_id FROM rev WHERE category = 'API_KEY' UNION ALL SELECT doc_id, id, category, text, gid FROM rev WHERE category <> 'API_KEY'")
def set_entity_category(spark, sf_dir):
    own = reviewed(documents(spark, sf_dir))
    return review.set_entity_category(own, F.col("category") == "API_KEY", "CUSTOM").select("doc_id", "id", "category", "canonical_text", "entity_group_id")


MERGE_SQL = f"""{SPANS_SQL}, f AS (SELECT doc_id, arg_min(gid, idx) AS g, arg_min(category, idx) AS c, arg_min(text, idx) AS t FROM rev GROUP BY doc_id)
SELECT rev.doc_id, id, c AS category, t AS canonical_text, g AS entity_group_id FROM rev JOIN f USING (doc_id)"""


@query(MERGE_SQL)
def merge_groups(spark, sf_dir):
    """Every group of a document merges into the one of its first span."""
    own = reviewed(documents(spark, sf_dir))
    first = own.groupBy("doc_id").agg(F.min_by("entity_group_id", "idx").alias("first__"))
    rows = review.merge_groups(own.join(first, "doc_id"), F.col("entity_group_id"), F.col("first__"))
    return rows.select("doc_id", "id", "category", "canonical_text", "entity_group_id")


@query(f"""{SPANS_SQL}, f AS (SELECT doc_id, arg_min(gid, idx) AS g, arg_max(gid, idx) AS h, arg_max(category, idx) AS c, max(idx) AS m FROM rev GROUP BY doc_id)
SELECT rev.doc_id, id, CASE WHEN gid = g THEN 'rejected' ELSE status END AS status, CASE WHEN idx = 0 THEN h ELSE gid END AS entity_group_id, CASE WHEN idx = 0 THEN c ELSE category END AS category FROM rev JOIN f USING (doc_id)""")
def first_group_rejected(spark, sf_dir):
    """The group of each document's first span is rejected, then that span joins the group of the last one."""
    own = reviewed(documents(spark, sf_dir))
    ends = own.groupBy("doc_id").agg(F.min_by("entity_group_id", "idx").alias("first__"), F.max_by("entity_group_id", "idx").alias("last__"))
    rows = review.set_group_status(own.join(ends, "doc_id"), F.col("first__"), "rejected")
    return review.assign_to_group(rows, F.col("idx") == 0, F.col("last__")).select("doc_id", "id", "status", "entity_group_id", "category")


@query(f"{SPANS_SQL} SELECT doc_id, id, category, status FROM rev UNION ALL SELECT doc_id, 'manual-0-' || least(4, length(text)) || '-CUSTOM', 'CUSTOM', 'accepted' FROM documents")
def manual_entity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ranges = docs.select("doc_id", F.lit(0).alias("start"), F.least(F.lit(4), F.length("text")).alias("end"), F.lit("CUSTOM").alias("category"), F.lit(None).cast("string").alias("group"))
    return review.add_manual(reviewed(docs), docs, ranges).select("doc_id", "id", "category", "status")


# Names and files

EXT_SQL = "(['pdf', 'TXT', 'xyz', 'md', 'docx', 'HEIC', 'rtf'])[doc_id % 7 + 1]"


def _paths(spark, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "TXT", "xyz", "md", "docx", "HEIC", "rtf")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("in/"), F.col("source"), F.lit("/a.b "), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"))


@query(f"""SELECT doc_id, lower({EXT_SQL}) AS extension, lower({EXT_SQL}) NOT IN ('xyz', 'md') AS supported,
CASE lower({EXT_SQL}) WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'heic' THEN 'image/heic' WHEN 'rtf' THEN 'application/rtf' ELSE 'application/octet-stream' END AS mime,
CASE lower({EXT_SQL}) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'heic' THEN 'image' END AS preview, CASE lower({EXT_SQL}) WHEN 'rtf' THEN 'rtf' END AS legacy, CASE lower({EXT_SQL}) WHEN 'heic' THEN 'image' END AS own_format FROM documents""")
def mime_of(spark, sf_dir):
    ext = N.extension(F.col("path"))
    return _paths(spark, sf_dir).select("doc_id", ext.alias("extension"), N.is_supported(F.col("path")).alias("supported"), N.mime_of(F.col("path")).alias("mime"), N.preview_kind(ext).alias("preview"), N.legacy_extension(F.col("path")).alias("legacy"), N.own_export_kind(ext).alias("own_format"))


@query(f"SELECT doc_id, 'in/' || source AS folder, 'a.b ' || doc_id || '.' || {EXT_SQL} AS name, 'a.b ' || doc_id AS base, 'a.b ' || doc_id || '_restored.' || lower({EXT_SQL}) AS restored FROM documents")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("doc_id", N.folder_of(p).alias("folder"), N.file_of(p).alias("name"), N.base_of(p).alias("base"), N.restored_name(p).alias("restored"))


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lower({EXT_SQL}) NOT IN ('xyz', 'md') WHEN 1 THEN lower({EXT_SQL}) IN ('txt', 'md', 'docx', 'pdf') WHEN 2 THEN lower({EXT_SQL}) NOT IN ('xyz', 'md', 'txt') ELSE false END AS applies FROM documents""")
def action_applies(spark, sf_dir):
    action = F.element_at(F.array(F.lit("anonymize"), F.lit("restore"), F.lit("ocr"), F.lit("unknown")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _paths(spark, sf_dir).select("doc_id", N.action_applies(action, F.array(F.col("path"), F.col("path"))).alias("applies"))


NAME_SQL = "CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE ' Case: ' || lang || '?  ' || source || '.final.docx' END"
SAFE_SQL = "CASE WHEN doc_id % 5 = 0 THEN 'dokument' ELSE 'Case_ ' || lang || '_ ' || source || '.final' END"


def _file_names(spark, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(F.concat(F.lit(" Case: "), "lang", F.lit("?  "), "source", F.lit(".final.docx")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", name.alias("name"))


@query(f"SELECT doc_id, {SAFE_SQL} AS base, {SAFE_SQL} || '_anon.txt' AS result, {SAFE_SQL} || '_anon_map.json' AS map FROM documents")
def safe_base_name(spark, sf_dir):
    rows = _file_names(spark, sf_dir).withColumn("base", N.safe_base_name(F.col("name")))
    return rows.select("doc_id", "base", N.result_name(F.col("base"), F.lit("txt")).alias("result"), N.result_name(F.col("base"), F.lit("json"), "map").alias("map"))


@query(f"SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS unique_name, false AS name_collision FROM (SELECT doc_id, base, row_number() OVER (PARTITION BY source, base ORDER BY doc_id) AS n FROM (SELECT doc_id, source, {SAFE_SQL} AS base FROM documents))")
def unique_base_names(spark, sf_dir):
    rows = _file_names(spark, sf_dir).withColumn("base", N.safe_base_name(F.col("name")))
    return filenames.unique_names(rows, by=["source"], order_col="doc_id").select("doc_id", "unique_name", "name_collision")


EXISTING_SQL = "SELECT DISTINCT source AS folder, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 4 ELSE 0 END AS k FROM documents"


@query(f"SELECT s.source AS folder, CASE WHEN k = 1 THEN 'report.txt' ELSE 'report (' || k || ').txt' END AS free_name FROM (SELECT DISTINCT source FROM documents) s JOIN (SELECT s.source, min(r.k) AS k FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(range(1, 1000)) AS k) r WHERE NOT EXISTS (SELECT 1 FROM ({EXISTING_SQL}) x WHERE x.folder = s.source AND x.k = r.k) GROUP BY s.source) m ON m.source = s.source")
def free_path(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("lang") == "en", "report.txt").when(F.col("lang") == "fr", "report (2).txt").when(F.col("lang") == "de", "report (4).txt").otherwise("other.txt")
    existing = docs.select(F.col("source").alias("folder"), name.alias("name")).distinct()
    wanted = docs.select(F.col("source").alias("folder"), F.lit("report.txt").alias("name")).distinct()
    return filenames.free_names(wanted, existing).select("folder", "free_name")


@query(f"{SPANS_SQL} SELECT doc_id, 'Offer ' || min(token) || ' final' AS name FROM tok GROUP BY doc_id")
def rename_with_map(spark, sf_dir):
    out = done(documents(spark, sf_dir))
    rows = out.maps.select("doc_id", "entries", F.concat(F.lit("Offer "), F.col("entries")[0]["canonical_text"], F.lit(" final")).alias("base"))
    return rows.select("doc_id", filenames.anonymize_name(F.col("base"), F.col("entries")).alias("name"))


# Rules, prompts, history, batches


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+tion')[1:20], '|') AS matches FROM documents")
def rule_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(rules.preview(F.col("text"), "[A-Z][a-z]+tion"), "|").alias("matches"))


CUSTOM_SQL = """WITH raw AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+tion') AS m, string_split_regex(text, '[A-Z][a-z]+tion') AS g FROM documents)
SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, m[i] AS text, 'CUSTOM' AS category, 'regex' AS source FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)"""


@query(CUSTOM_SQL)
def custom_rule_spans(spark, sf_dir):
    return detect(documents(spark, sf_dir), categories=["MAC_ADDRESS"], rules=[("[A-Z][a-z]+tion", "WORD")]).filter("category = 'CUSTOM'").select("doc_id", "start", "text", "category", "source")


@query("SELECT doc_id, 'Summarise {{DOC}}: ' || text || ' -- ' || text AS prompt FROM documents")
def render_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.render_prompt(F.lit("Summarise {{DOC}}: {{DOKUMENT}} -- {{DOKUMENT}}"), F.col("text")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 100 = 1 THEN 'one' WHEN doc_id % 100 % 10 BETWEEN 2 AND 4 AND doc_id % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS form, doc_id % 700 IN (400, 422) OR doc_id % 700 >= 500 AS falls_back FROM documents")
def message_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.plural_form(F.col("doc_id") % 100).alias("form"), M.export_fallback(F.col("doc_id") % 700).alias("falls_back"))


CREATED_SQL = "1704067200 + doc_id * 7919 % 7776000"
HISTORY_SQL = f"{SPANS_SQL}, h AS (SELECT d.doc_id AS id, {CREATED_SQL} AS created, 'doc ' || d.doc_id // 10 || '.txt' AS filename, (SELECT count(*) FROM rev WHERE rev.doc_id = d.doc_id AND status = 'accepted') AS entity_count FROM documents d)"


def _history(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("filename", F.concat(F.lit("doc "), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".txt")))
    out = done(docs)
    return history.sessions(docs, out.spans, out.maps, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 7776000))


@query(f"{HISTORY_SQL} SELECT id, created AS created_s, filename, 'txt' AS format, 'parsed' AS source, CAST(entity_count AS INTEGER) AS entity_count FROM h")
def history_list(spark, sf_dir):
    return history.listing(_history(spark, sf_dir)).withColumn("created_s", F.unix_seconds("created_at")).drop("created_at", "replacement_count")


@query(f"{HISTORY_SQL} SELECT id, created AS created_s FROM h ORDER BY created DESC, id DESC LIMIT 1")
def history_latest(spark, sf_dir):
    return history.latest(_history(spark, sf_dir)).select("id", F.unix_seconds("created_at").alias("created_s"))


@query(f"{HISTORY_SQL} SELECT strftime(make_timestamp(CAST(created AS BIGINT) * 1000000), '%Y-%m') AS month, count(*) AS requests, count(DISTINCT filename) AS documents FROM h GROUP BY month")
def usage_by_month(spark, sf_dir):
    return history.usage(_history(spark, sf_dir)).select(F.date_format("period", "yyyy-MM").alias("month"), "requests", "documents")


@query(f"SELECT doc_id FROM documents WHERE 1711800000 - ({CREATED_SQL}) > 30 * 86400")
def expired_maps(spark, sf_dir):
    maps = table(spark, sf_dir, "documents").select("doc_id", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 7776000).alias("saved_at"))
    return maplink.expired(maps, F.timestamp_seconds(F.lit(1711800000))).select("doc_id")


STATUS_SQL = "CASE WHEN n_chars < 200 THEN 'error' WHEN n_chars > 20000 THEN 'queued' ELSE 'done' END"


@query(f"SELECT source, count(*) FILTER (s = 'done') AS complete, count(*) FILTER (s = 'error') AS failed, count(*) AS total FROM (SELECT source, {STATUS_SQL} AS s FROM documents) GROUP BY source")
def batch_progress(spark, sf_dir):
    status = F.when(F.col("n_chars") < 200, "error").when(F.col("n_chars") > 20000, "queued").otherwise("done")
    return batch.progress(table(spark, sf_dir, "documents").withColumn("status", status), ["source"])


@query()
def batch_export(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = done(docs)
    items = out.texts.join(out.maps.select("doc_id", "entries"), "doc_id").join(docs.select("doc_id", "source", F.concat("lang", F.lit(".docx")).alias("filename")), "doc_id")
    return batch.export(items, by=["source"], order_col="doc_id")


@query(f"{SPANS_SQL} SELECT DISTINCT d.source, true AS is_encrypted, true AS equal FROM tok JOIN documents d ON d.doc_id = tok.doc_id")
def map_encrypt_roundtrip(spark, sf_dir):
    """One password for all maps of a source, so one key each: derivation is meant to be slow."""
    docs = documents(spark, sf_dir)
    maps = done(docs).maps.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sort_array(F.collect_list("document_fingerprint")).alias("m"))
    rows = crypto.encrypt_maps(maps.select("source", F.to_json("m").alias("json")), "password", salt=F.unhex(F.substr(F.md5("source"), F.lit(1), F.lit(32))), iv=F.unhex(F.substr(F.sha2("source", 256), F.lit(1), F.lit(24))), iterations=crypto.LEAST)
    return crypto.decrypt_maps(rows, "password").select("source", crypto.is_encrypted(F.col("encrypted")).alias("is_encrypted"), (F.col("decrypted") == F.col("json")).alias("equal"))


@query(f"{SPANS_SQL} SELECT DISTINCT doc_id, CAST(doc_id % 2 AS INTEGER) AS kept FROM tok WHERE doc_id % 2 = 1")
def history_delete_and_get(spark, sf_dir):
    """Sessions of odd documents after the even ones went one by one in effect: each parsed session holds entries."""
    rows = _history(spark, sf_dir)
    left = history.delete(rows, 0).filter("id % 2 = 1")
    parsed = history.parsed(left, "entries array<struct<token:string>>")
    return parsed.filter(F.size("session.entries") > 0).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("kept"))


@query("SELECT doc_id, CASE WHEN trim(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang END) = '' THEN 'Give the rule a name.' WHEN doc_id % 7 = 0 THEN 'Give the rule a label.' WHEN length(repeat('ab', CAST(doc_id % 200 AS BIGINT))) = 0 THEN 'Give the rule a pattern.' WHEN 2 * (doc_id % 200) > 256 THEN 'A pattern has at most 256 characters.' END AS problem FROM documents")
def rule_problems(spark, sf_dir):
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    named = docs.select("doc_id", F.when(k % 5 == 0, " ").otherwise(F.col("lang")).alias("name"), F.when(k % 7 == 0, "").otherwise("word").alias("label"), F.expr("repeat('ab', int(doc_id % 200))").alias("pattern"))
    return rules.problems(named).select("doc_id", "problem")


@query("SELECT doc_id, 'r' || doc_id AS name, 'a+' AS pattern, lang AS label FROM documents WHERE doc_id % 3 <> 1")
def enabled_rules(spark, sf_dir):
    """Of each document's two rules one lacks a pattern; the other is enabled, by itself or by default, or not."""
    flag = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, ',"enabled":false').otherwise(',"enabled":true')
    json = F.concat(F.lit('[{"id":"x","name":"broken","label":"y"},{"id":"'), F.col("doc_id").cast("string"), F.lit('","name":"r'), F.col("doc_id").cast("string"), F.lit('","pattern":"a+","label":"'), F.col("lang"), F.lit('"'), flag, F.lit("}]"))
    loaded = rules.load(table(spark, sf_dir, "documents").select(json.alias("json")))
    return rules.enabled(loaded).select(F.substring("name", 2, 20).cast("long").alias("doc_id"), "name", "pattern", "label")


@query("""SELECT doc_id, CASE WHEN s IS NULL THEN 'engine not reachable' WHEN s >= 500 THEN 'engine failed' WHEN s = 401 THEN 'not signed in' WHEN s = 403 THEN 'not allowed' WHEN s = 404 THEN 'not found' WHEN s = 413 THEN 'file too large'
WHEN s = 415 THEN 'format not supported' WHEN s = 422 THEN 'content not accepted' WHEN s = 429 THEN 'too many requests' ELSE 'request failed' END AS message FROM (SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN 395 + doc_id % 130 END AS s FROM documents)""")
def error_messages(spark, sf_dir):
    status = F.when(F.col("doc_id") % 11 > 0, F.lit(395) + F.col("doc_id") % 130)
    return table(spark, sf_dir, "documents").select("doc_id", M.error_message(status).alias("message"))


@query("SELECT doc_id, '[EMAIL_' || doc_id || ']|[' || upper(lang) || '_2]' AS tokens FROM documents")
def warned_tokens(spark, sf_dir):
    """Tokens that warnings name; a warning about something else names none."""
    told = lambda token: F.concat(F.lit("Unknown anonymization token "), token, F.lit(" at offset 7."))
    warnings = F.array(told(F.concat(F.lit("[EMAIL_"), F.col("doc_id").cast("string"), F.lit("]"))), F.lit("The layout was simplified [1]."), told(F.concat(F.lit("["), F.upper("lang"), F.lit("_2]"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(M.warned_tokens(warnings), "|").alias("tokens"))


# Texts of files, notices and stores


@query("SELECT doc_id, lang || '+' || source AS warnings, CASE WHEN doc_id % 2 = 0 THEN 'XMP metadata, ' || lang ELSE 'GPS position' END AS labels, CASE WHEN doc_id % 2 = 0 THEN 'Faces painted over: ' || doc_id || '. Personal data on pictures was painted over.' END AS notice FROM documents")
def notice_messages(spark, sf_dir):
    docs, even = table(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0
    header = F.concat(F.lit("%5B%22"), "lang", F.lit("+"), "source", F.lit("%22%2C7%5D"))
    codes = M.split_codes(F.when(even, F.concat(F.lit("xmp,,pdf_xmp,"), "lang")).otherwise("gps"))
    pictures = F.when(even, F.array(F.concat(F.lit("faces_masked:"), F.col("doc_id").cast("string")), F.lit("pictures_redacted"), F.lit("unknown"))).otherwise(F.array(F.lit("unknown")))
    return docs.select("doc_id", F.array_join(M.parse_warnings(header), "|").alias("warnings"), F.array_join(M.metadata_labels(codes), ", ").alias("labels"), M.picture_notice(pictures).alias("notice"))


@query("SELECT doc_id, 'Pages without text that was read: ' || array_to_string(list_transform(range(1, least(10, doc_id % 15) + 1), lambda x: CAST(x AS VARCHAR)), ', ') || CASE WHEN doc_id % 15 > 10 THEN ' and ' || (doc_id % 15 - 10) || ' more' ELSE '' END AS message FROM documents WHERE doc_id % 15 > 0")
def unread_pages(spark, sf_dir):
    pages = F.filter(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 15), lambda x: x > 0)
    return table(spark, sf_dir, "documents").select("doc_id", M.unread_pages(pages).alias("message")).filter("message IS NOT NULL")


MAP_JSON = """CASE doc_id % 5 WHEN 0 THEN '{{"entries":[{0}]}}' WHEN 1 THEN '{{"map":{{"entries":[{0},{0}]}}}}' WHEN 2 THEN '{{"entries":[{{"token":1,"canonical_text":"x","category":"PERSON"}}]}}' WHEN 3 THEN 'not json' ELSE '[]' END""".format('{"token":"[OSOBA_1]","canonical_text":"x","category":"PERSON"}')


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS strict, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS lenient FROM documents")
def parse_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(MAP_JSON).alias("json"))
    strict = maplink.parse_maps(rows).select("doc_id", "json", F.size("entries").alias("strict"))
    n = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return maplink.parse_maps(strict, strict=False).select("doc_id", n("strict"), F.when(F.col("entries").isNotNull(), F.size("entries")).alias("lenient"))


@query("SELECT source, doc_id AS map_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, CASE WHEN lang = 'en' THEN n_chars ELSE -n_chars END, doc_id) AS recency_rank FROM documents")
def map_candidates(spark, sf_dir):
    """English documents stand for maps beside the file, others for remembered ones."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("map_id"), "lang", "n_chars")
    adjacent = docs.filter("lang = 'en'").select("file_id", "map_id", F.col("n_chars").alias("idx"))
    remembered = docs.filter("lang <> 'en'").select("file_id", "map_id", F.col("n_chars").alias("saved_at"))
    return maplink.candidates(adjacent, remembered).select(F.col("file_id").alias("source"), "map_id", F.col("recency_rank").cast("long"))


@query("WITH dim(category, ord, prefix, tone) AS (VALUES " + values_sql() + ") SELECT category, CAST(ord AS INTEGER) AS ord FROM dim WHERE category IN ('EMAIL', 'PERSON', 'DATE')")
def load_exclusions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, '["EMAIL","UNKNOWN","DATE"]').when(F.col("doc_id") % 3 == 0, '["PERSON","EMAIL"]').otherwise("broken").alias("json"))
    return excluded_categories(rows)


@query("WITH dim(category, ord, prefix, tone) AS (VALUES " + values_sql() + ") SELECT category, tone, CASE WHEN category = 'PUBLIC_INSTITUTION' THEN 'highlight--public-institution' ELSE 'highlight--' || tone END AS css_class FROM dim UNION ALL SELECT 'UNKNOWN', 'gray', 'highlight--gray'")
def category_style(spark, sf_dir):
    names = categories(spark).select("category").unionByName(spark.createDataFrame([("UNKNOWN",)], "category string"))
    return names.select("category", category_tone(F.col("category")).alias("tone"), category_class(F.col("category")).alias("css_class"))


@query(f"{SPANS_SQL} SELECT doc_id, gid AS entity_group_id, CASE WHEN n_accepted > 0 THEN 'rejected' ELSE 'accepted' END AS next_status FROM grp")
def next_status(spark, sf_dir):
    groups = spans.entity_groups(reviewed(documents(spark, sf_dir)))
    return groups.select("doc_id", "entity_group_id", M.next_status(F.col("n_accepted")).alias("next_status"))


@query(f"{SPANS_SQL} SELECT doc_id, id, CASE WHEN idx = 0 THEN 'rejected' ELSE status END AS status, CASE WHEN idx = 0 THEN 'manual-group-' || id ELSE gid END AS entity_group_id FROM rev")
def first_span_apart(spark, sf_dir):
    """The first span of each document is rejected and gets a group of its own."""
    own = review.set_entity_status(reviewed(documents(spark, sf_dir)), F.col("idx") == 0, "rejected")
    return review.create_group(own, F.col("idx") == 0).select("doc_id", "id", "status", "entity_group_id")


@query(BLOCKS_SQL + ", last AS (SELECT doc_id, max(idx) // 32 AS l FROM blocks GROUP BY doc_id) SELECT doc_id, idx, start FROM blocks JOIN last USING (doc_id) WHERE idx // 32 = least(1, l)")
def second_page(spark, sf_dir):
    """Blocks of each document's second page, or of its only one."""
    return segments.page_of(segments.split_blocks(_two_pages(documents(spark, sf_dir))), 1).select("doc_id", "idx", "start")


@query("SELECT doc_id, least(n_chars % 97, n_chars % 89) AS start, greatest(n_chars % 97, n_chars % 89) AS \"end\" FROM documents WHERE n_chars % 97 <> n_chars % 89")
def selection_range(spark, sf_dir):
    chosen = segments.selection_range(F.col("n_chars") % 97, F.col("n_chars") % 89)
    return table(spark, sf_dir, "documents").select("doc_id", chosen.alias("r")).filter("r IS NOT NULL").select("doc_id", "r.start", "r.end")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unsupported' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'doc ' || doc_id || '_anon.txt' ELSE 'doc ' || doc_id || '_anon.docx' END AS output FROM documents")
def file_actions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ext = F.element_at(F.array(F.lit(".exe"), F.lit(".txt"), F.lit(".docx")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"), ext).alias("file_name"), "text")
    return P.file_action(files, "anonymize", categories=HERE).select(F.col("file_id").alias("doc_id"), "outcome", "output")


# Extra


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_window_counts(spark, sf_dir):
    """An extra: the streaming aggregation, run at rest."""
    rows = event_windows(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")

