"""One query per operator over the whole of its table, with SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import logframe as lf
from logframe.llm.common import Scratch
from logframe.llm.exact_dedup import exact_dedup
from logframe.llm.langid import identify
from logframe.llm.quality_classifier import classify
from logframe.llm.mixing import mix
from logframe.llm.packing import pack
from logframe.llm.token_output import write_tokens
from logframe.llm.quality_rules import judge
from logframe.llm.near_dedup import near_dedup
from logframe.llm.pii import find_pii
from logframe.llm.lm import score_texts
from logframe.llm.filter_audit import audit
from logframe.llm.merkle import tamper_check
from logframe.llm.substring_dedup import substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return lf.configure(spark).read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of (documents, folder) under a name, with its SQL."""

    def register(build: Callable[[DataFrame, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(_table(spark, folder, "documents"), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op6_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
              sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def op6(documents, folder):
    return exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_language_id")
def op7(documents, folder):
    return identify(documents)


@query("op5_quality_classifier")
def op5(documents, folder):
    return classify(documents, documents.sparkSession.read.parquet(f"{folder}/labels.parquet"))


@query(
    "op3_mix_sources",
    r"""WITH sized AS (
         SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
                / (0.05::DOUBLE + 0.95::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^\p{Ll} ]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS key
         FROM documents),
       sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
       named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
       weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight FROM named),
       shared AS (
         SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
         FROM weighed WINDOW b AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       full_ones AS (SELECT *, 3 * source_size <= share * weight AS is_full FROM shared),
       plan AS (
         SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE max(share) FILTER (NOT is_full) OVER () * weight END AS target
         FROM full_ones),
       run AS (
         SELECT s.doc_id, s.size, p.source_size, p.target, coalesce(floor(p.target / p.source_size), 0)::BIGINT AS epochs,
                p.target - coalesce(floor(p.target / p.source_size), 0) * p.source_size AS budget,
                sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) AS until
         FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
       SELECT doc_id, size, source_size, target,
              (size * (epochs + CASE WHEN budget - until + size >= size / 2 AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
       FROM run""",
)
def op3(documents, folder):
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_best_fit_packing")
def op8(documents, folder):
    return pack(documents, public_tokenizers.path("word_bpe_49k.json"))


@query("op1_token_output")
def op1(documents, folder):
    spark = documents.sparkSession
    return write_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark).root).documents()


@query("op9_quality_rules")
def op9(documents, folder):
    return judge(documents).drop("class_divergence", "word_divergence")


@query("op10_near_dedup")
def op10(documents, folder):
    return near_dedup(documents)


@query("op2_pii")
def op2(documents, folder):
    return find_pii(documents)


@query("op4_language_model")
def op4(documents, folder):
    return score_texts(documents)


@query(
    "op11_filter_audit",
    r"""WITH words AS (
         SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
       marks AS (SELECT doc_id AS of, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
       failing AS (
         SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
         FROM words LEFT JOIN marks ON doc_id = of),
       letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
       orders AS (
         SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
         WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
       steps AS (
         SELECT filter_order, step::INT AS step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
                list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END))::INT AS done
         FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
       told AS (
         SELECT part, filter_order, step, own, count(*) FILTER (mask & (coalesce(done, 0) | own) = 0) AS kept,
                count(*) FILTER (mask & own != 0 AND mask & coalesce(done, 0) = 0) AS removed,
                count(*) FILTER (mask & own != 0 AND mask & coalesce(done, 0) != 0) AS redundant, count(*) FILTER (mask = own) AS unique_fails,
                count(*) FILTER (mask & own != 0 AND mask & coalesce(done, 0) = 0 AND good = 1) AS good_lost,
                count(*) FILTER (mask & own != 0 AND mask & coalesce(done, 0) = 0 AND toxic = 1) AS toxic_lost
         FROM failing, steps GROUP BY part, filter_order, step, own)
       SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
              (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
       FROM told""",
)
def op11(documents, folder):
    return audit(documents, documents.sparkSession.read.parquet(f"{folder}/labels.parquet"))


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
              lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""


@query(
    "op12_merkle_manifest",
    rf"""WITH RECURSIVE changed AS (
         SELECT *, CASE WHEN xor({_CRC32}, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
         FROM documents),
       leaves AS (
         SELECT doc_id, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
                sha256({_FIELDS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256({_FIELDS} || coalesce(strlen(other) || ':' || other, '-')) AS tampered
         FROM changed),
       low AS (
         SELECT 0 AS level, g, i, n, leaf AS digest FROM leaves
         UNION ALL
         SELECT level + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, g, i // 8, n),
       subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, max(level) OVER () AS height FROM low WHERE n = 1),
       high AS (
         SELECT 0 AS level, i, n, subroot AS digest FROM subroots
         UNION ALL
         SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 8, n),
       nodes AS (
         SELECT level, g, i, n, digest FROM low
         UNION ALL SELECT height + 1 + level, '', h.i, h.n, h.digest FROM high h, (SELECT DISTINCT height FROM subroots)),
       sides AS (
         SELECT a.level, a.g, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts,
                coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
         FROM nodes a JOIN nodes b ON a.level = b.level AND a.g = b.g AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.level, a.g, a.i),
       fold AS (
         SELECT 0 AS level, doc_id, l.g, l.i, l.g AS own, tampered AS node, '' AS proof FROM leaves l
         UNION ALL
         SELECT CASE WHEN s.level IS NULL THEN r.height + 1 ELSE f.level + 1 END, doc_id, CASE WHEN s.level IS NULL THEN '' ELSE f.g END,
                CASE WHEN s.level IS NULL THEN r.i ELSE f.i // 8 END, own,
                CASE WHEN s.level IS NULL THEN node ELSE sha256(s.lefts || node || s.rights) END, proof || coalesce(s.lefts || s.rights, '')
         FROM fold f LEFT JOIN sides s ON s.level = f.level AND s.g = f.g AND s.i = f.i JOIN subroots r ON r.g = f.own
         WHERE s.level IS NOT NULL OR f.level <= r.height),
       done AS (SELECT doc_id, own, node, proof FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)
       SELECT d.doc_id, l.leaf, r.subroot, (SELECT digest FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
              node = (SELECT digest FROM high WHERE n = 1) AS verified
       FROM done d JOIN leaves l ON l.doc_id = d.doc_id JOIN subroots r ON r.g = d.own""",
)
def op12(documents, folder):
    return tamper_check(documents).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(
    "op13_substring_dedup",
    r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
       windows AS (
         SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)),
       repeats AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, s) > 1),
       gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at FROM repeats),
       single AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
       kept AS (
         SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.at) AS body, count(*) AS n
         FROM single s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.at = g.at WHERE g.at IS NULL GROUP BY s.doc_id)
       SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
       FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
)
def op13(documents, folder):
    return substring_dedup(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
