"""One query per text operator, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.llm import decontaminate, language, near, packing, pii, quality, repeats, secrets, tiff, toxicity
from tierwalk.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@query
def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(tiff.store_texts(table(spark, sf_dir, "documents")))


@query
def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page of the stored texts."""
    return tiff.page_rows(tiff.store_texts(table(spark, sf_dir, "documents"))).drop("mean").withColumnRenamed("id", "doc_id")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    return language.by_fold(language.predict(docs, language.train(docs, ~fold)), fold)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), ~fold))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.find(table(spark, sf_dir, "documents"), k=4, least=80).drop("text_hash")


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    return toxicity.by_fold(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~fold)), fold)


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.Lexicon.read(public_tokenizers.path("byte_bpe_50k.json")))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op3_minhash"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') k FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(4, len(w)) + 2)) i) x WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
c AS MATERIALIZED (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id v, doc_id root FROM d UNION SELECT e.b, root FROM r JOIN e ON e.a = v)
SELECT d.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(root) component_id, d.doc_id = min(root) kept FROM d JOIN r ON v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLE_SQL["op9_repeats"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents),
k AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) h, md5(array_to_string(w[i:i + 19], ' ')) m FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) i) x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, i) rn FROM k) WHERE rn > 1),
p AS (SELECT doc_id, i, w[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) i) x),
q AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) kept, count(g.i) gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(gone, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN q USING (doc_id)"""

ORACLE_SQL["op10_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, {_TERMS} w FROM documents),
b AS (SELECT item_id, {_TERMS} w FROM benchmark WHERE item_id IS NOT NULL),
v AS MATERIALIZED (SELECT DISTINCT item_id, least(8, len(w)) n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') k FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(8, len(w)) + 2)) i) x WHERE len(w) > 0),
o AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k FROM d, (SELECT DISTINCT n FROM v) z, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) i) x),
h AS MATERIALIZED (SELECT doc_id, i, o.n, item_id FROM o JOIN v USING (n, k)),
t AS (SELECT doc_id, count(*) n_items, sha256(string_agg(id, ',' ORDER BY id)) digest FROM (SELECT DISTINCT doc_id, item_id::VARCHAR id FROM h) GROUP BY 1),
c AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(digest, sha256('')) items_sha256, coalesce(n_items, 0) >= 2 contaminated FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""


ORACLE_SQL["tiff_pages"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
p AS (SELECT doc_id, rpad(h, (greatest(1, ceil(length(h) / 1152)) * 1152)::INT, 'F') h FROM d),
g AS (SELECT doc_id, unnest(range(0, ceil(length(h) / 589824)::BIGINT)) page, h FROM p),
s AS (SELECT doc_id, page, substr(h, page * 589824 + 1, 589824) h FROM g)
SELECT doc_id, page::INT page, 576 width, (length(h) // 1152)::INT height, 1 samples, 8 compression, 2 predictor, false tiled, sha256(unhex(h)) sha256, NULL::VARCHAR error FROM s"""


def _pii_sql() -> str:
    """Base kinds with their places: gaps and matches add up. Added kinds look behind, which this SQL can't; tests cover them."""
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS BIGINT), 0) > 255)) = 0"),
        ("card", r"[0-9](?:[ -]?[0-9])+", "n BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN i % 2 = 1 THEN r[i]::INT ELSE r[i]::INT * 2 - CASE WHEN r[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "n BETWEEN 10 AND 15"),
    )
    found = " UNION ALL ".join(f"SELECT doc_id, {k} k, '{name}' AS name, regexp_extract_all(t, '{p}') m, string_split_regex(t, '{p}') g FROM d" for k, (name, p, _) in enumerate(kinds))
    valid = "CASE k " + " ".join(f"WHEN {k} THEN {ok}" for k, (_, _, ok) in enumerate(kinds)) + " END"
    counts = ", ".join(f"count(*) FILTER (k = {k}) n_{name}" for k, (name, _, _) in enumerate(kinds))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), f AS ({found}),
p AS (SELECT doc_id, k, name, m[j] s, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) b FROM f, LATERAL (SELECT unnest(range(1, len(m) + 1)) j) x),
v AS (SELECT *, reverse(regexp_replace(s, '[^0-9]', '', 'g')) r, length(regexp_replace(s, '[^0-9]', '', 'g')) n FROM p),
w AS (SELECT doc_id, k, b::BIGINT b, name || ':' || b::BIGINT || ':' || (b + length(s))::BIGINT line FROM v WHERE {valid}),
a AS (SELECT doc_id, {counts}, string_agg(line, ',' ORDER BY b, k) spans FROM w GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{n}, 0) n_{n}" for n, _, _ in kinds)}, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN a USING (doc_id)"""


ORACLE_SQL["op1_pii"] = _pii_sql()
