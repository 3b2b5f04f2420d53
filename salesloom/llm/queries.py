"""The registered queries of the subpackage and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_codec, lang_id, merkle, rule_quality, token_store, warc
from .collocations import collocations
from .common import fold_of, table
from .decontaminate import contained_items
from .exact_dedup import exact_dedup
from .license_scan import GAP, LOWER, NOTICES, PHRASES, UPPER, license_scan
from .near_dup import near_duplicates
from .substring_dedup import substring_dedup
from .token_count import token_counts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    header = lambda name: F.element_at(F.filter("headers", lambda h: h["name"] == name), 1)["value"]
    return records.select(
        "page_id",
        "record_type",
        "record_id",
        "refers_to",
        F.when(F.exists("headers", lambda h: h["name"] == "WARC-Target-URI"), header("WARC-Target-URI")).alias("target_uri"),
        header("WARC-Block-Digest").alias("block_digest"),
        header("Content-Type").alias("content_type"),
        header("Content-Length").cast("long").alias("content_length"),
        "headers",
        F.col("block").cast("string").alias("block"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 3) == 1
    model = rule_quality.fit_from_labels(docs, labels, ~held_out)
    return rule_quality.rule_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest="text_sha256")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    model = lang_id.fit_languages(docs, ~held_out)
    return lang_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), windows=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_store.write_store(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)
    return token_store.read_store(spark, folder, manifest, digest=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = {"text": F.translate("text", UPPER, LOWER)}
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), columns, presented=lowered, where=where)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_near_dup": op2_near_dup,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_rule_quality": op5_rule_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_lang_id": op8_lang_id,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_store": op11_token_store,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_license() -> str:
    """Every window against every template, of documents that have enough of its words."""
    values = ", ".join(f"({_quoted(label)}, {_quoted(t)}, [{', '.join(_quoted(f' {p} ') for p in telling)}]::VARCHAR[])" for label, t, telling in NOTICES)
    phrases = ", ".join(f"({_quoted(label)}, string_split({_quoted(p)}, ' '))" for p, label in PHRASES.items())
    words = lambda text: f"list_filter(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '{GAP}'), lambda w: w <> '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS words FROM documents),
        tw AS (
            SELECT label, telling, list_distinct(nw) AS tw, greatest(1, (len(nw) + 1) // 2) AS step
            FROM (SELECT label, telling, {words("notice")} AS nw FROM (VALUES {values}) v(label, notice, telling)) x),
        place AS (
            SELECT r, label, i - 1 AS start
            FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d) x, (VALUES {phrases}) p(label, phrase)
            WHERE words[i] = phrase[1] AND words[i : i + len(phrase) - 1] = phrase),
        win AS (
            SELECT r, label, telling, w, len(list_intersect(list_distinct(w), tw)) / len(tw) AS share
            FROM (
                SELECT r, label, telling, tw, words[start + 1 : start + 4 * step] AS w
                FROM (
                    SELECT r, words, label, telling, tw, step, unnest(range(0, len(words), step)) AS start
                    FROM (SELECT r, words, list_distinct(words) AS own FROM d) o, tw WHERE len(list_intersect(own, tw)) >= 0.9 * len(tw) - 1e-9) x) y),
        hit AS (
            SELECT r, label, share FROM win
            WHERE share >= 0.9 - 1e-9 AND len(list_filter(telling, lambda p: NOT contains(' ' || array_to_string(w, ' ') || ' ', p))) = 0),
        b AS (
            SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
            FROM place GROUP BY r),
        l AS (
            SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
            FROM (SELECT r, label FROM place UNION SELECT r, label FROM hit) x GROUP BY r),
        s AS (SELECT r, max(share) AS share FROM hit GROUP BY r)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
        FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
    """


def _sql_words(source: str, key: str) -> str:
    return f"SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM {source}"


def _sql_shingles(key: str, sizes: str) -> str:
    """Distinct shingles, one in a row, of ``w`` words each, from (key, words, w)."""
    return f"""
        SELECT DISTINCT {key}, w, array_to_string(words[i : i + w - 1], ' ') AS shingle
        FROM (SELECT {key}, words, w, unnest(range(1, len(words) - w + 2)) AS i FROM ({sizes}) x) y
    """


#: crc32 of the decimal ``doc_id``, bit by bit.
_SQL_CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _sql_merkle(levels: int = 6) -> str:
    """Level by level, up to 16 ** ``levels`` rows of a source and as many sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        f"""leaf AS (
            SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
                   CASE WHEN {_SQL_CRC32} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
            FROM documents)""",
        "a0 AS (SELECT source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, leaf AS h, r FROM leaf)",
    ]

    def climb(name: str) -> None:
        """Levels over ``name``0 (k, pos, h): runs, then the next nodes; a lone node stays as it is."""
        for i in range(levels):
            ctes.append(f"{name}r{i} AS (SELECT k, pos // 16 AS run, list(h ORDER BY pos) AS hs, (count(*) OVER (PARTITION BY k) = 1 AND count(*) = 1) AS lone FROM {name}{i} GROUP BY k, pos // 16)")
            ctes.append(f"{name}{i + 1} AS (SELECT k, run AS pos, CASE WHEN lone THEN hs[1] ELSE sha256(list_aggregate(hs, 'string_agg', '')) END AS h FROM {name}r{i})")

    climb("a")
    ctes.append(f"b0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos, h, k AS source FROM a{levels})")
    climb("b")
    ctes.append("f0 AS (SELECT l.r, l.source AS k, a0.pos, coalesce(other, leaf) AS h, '' AS p FROM leaf l JOIN a0 USING (r))")
    step = """
        SELECT f.r, f.k, f.pos // 16 AS pos, CASE WHEN lone THEN f.h ELSE sha256(list_aggregate(list_concat(hs[1 : f.pos % 16], [f.h], hs[f.pos % 16 + 2 : 16]), 'string_agg', '')) END AS h,
               p || CASE WHEN lone THEN '' ELSE coalesce(list_aggregate(list_concat(hs[1 : f.pos % 16], hs[f.pos % 16 + 2 : 16]), 'string_agg', ''), '') END AS p
        FROM {f} f JOIN {runs} x ON f.k IS NOT DISTINCT FROM x.k AND f.pos // 16 = x.run"""
    for i in range(levels):
        ctes.append(f"f{i + 1} AS ({step.format(f=f'f{i}', runs=f'ar{i}')})")
    ctes.append(f"g0 AS (SELECT f.r, 0 AS k, b0.pos, f.h, p FROM f{levels} f JOIN b0 ON f.k IS NOT DISTINCT FROM b0.source)")
    for i in range(levels):
        ctes.append(f"g{i + 1} AS ({step.format(f=f'g{i}', runs=f'br{i}')})")
    return f"""
        WITH {", ".join(ctes)}
        SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(g.p) AS proof_sha256, g.h AS folded_root, g.h = t.h AS verified
        FROM leaf l JOIN g{levels} g USING (r) JOIN a{levels} s ON l.source IS NOT DISTINCT FROM s.k, b{levels} t
    """


ORACLES = {
    "op4_decontaminate": f"""
        WITH iw AS ({_sql_words("benchmark", "item_id")}), dw AS ({_sql_words("documents", "doc_id")}),
        item AS ({_sql_shingles("item_id", "SELECT item_id, words, least(5, len(words)) AS w FROM iw WHERE len(words) > 0")}),
        doc AS ({_sql_shingles("doc_id", "SELECT doc_id, words, w FROM dw, (SELECT DISTINCT w FROM item) s")}),
        size AS (SELECT item_id, count(*) AS item_shingles FROM item GROUP BY item_id)
        SELECT doc_id, item_id, item_shingles, count(*) AS shared, count(*) / item_shingles AS containment
        FROM doc JOIN item USING (w, shingle) JOIN size USING (item_id)
        GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
    """,
    "op9_license_scan": _sql_license(),
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS s
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d) x),
        old AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
        gone AS (
            SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS cut
            FROM win JOIN old USING (s) WHERE first_doc < doc_id GROUP BY doc_id),
        pos AS (
            SELECT doc_id, words, coalesce(cut, []) AS cut, list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(coalesce(cut, []), k)) AS stay
            FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, len(words) AS n_words, len(cut) AS n_removed,
               sha256(coalesce(array_to_string(list_transform(stay, lambda k: words[k]), ' '), '')) AS kept_sha256
        FROM pos
    """,
    "op12_collocations": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        piece AS (
            SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS words
            FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d) x),
        total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM piece GROUP BY lang),
        gram AS (
            SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
            FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM piece, range(1, 5) s(size)) x),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 30),
        cut AS (
            SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS tail
            FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size >= 2) x),
        scored AS (
            SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score,
                   row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::HUGEINT * c.a) // (x.a + y.a), k) AS pick
            FROM cut c JOIN f x ON c.lang = x.lang AND head = x.phrase JOIN f y ON c.lang = y.lang AND tail = y.phrase),
        inside AS (
            SELECT lang, array_to_string(string_split(phrase, ' ')[b : b + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size >= 3) y) x
            GROUP BY 1, 2),
        kept AS (
            SELECT s.* FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase
            WHERE pick = 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op13_merkle_manifest": _sql_merkle(),
}
