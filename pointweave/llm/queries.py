"""The registered queries of this subpackage and the SQL that gives the same rows where SQL can.

The queries named without opN_ are columns of an operator's result that SQL can give where it can't give the whole row.
"""

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_tokenizer_alignment
from .bpe_tree import op6_bpe_tree
from .embedding_dedup import THRESHOLD, op3_embedding_dedup
from .html_text import op9_html_text
from .licenses import op10_license_scan
from .line_dedup import op5_line_dedup
from .ngram_join import PERCENT, op8_ngram_join
from .packing import op2_packing
from .quality import MIN_WORDS, MOST_REPEATED, SYMBOLS, op11_quality_rules
from .search import BEST, op12_wand_search
from .tiff import op7_tiff_pages
from .token_tree import op4_token_counts
from .toxicity import op1_toxicity


def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_toxicity(spark, sf_dir).select("doc_id", "held_out")


def tiff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_tiff_pages(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_tiff_pages": op7_tiff_pages,
    "op8_ngram_join": op8_ngram_join,
    "op9_html_text": op9_html_text,
    "op10_license_scan": op10_license_scan,
    "op11_quality_rules": op11_quality_rules,
    "op12_wand_search": op12_wand_search,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "held_out_split": held_out_split,
    "tiff_payloads": tiff_payloads,
    "license_places": license_places,
    "quality_counts": quality_counts,
}

#: A-Z as a-z, no other letter.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The least number reachable from each over the links (a, b) of both directions.
_REACH = "reach AS (SELECT DISTINCT a AS n, a AS m FROM links UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a), least_of AS (SELECT n, min(m) AS least FROM reach GROUP BY n)"


def _crc32(hexadecimal: str) -> str:
    """CRC-32 of the bytes that an expression shows in hexadecimal digits: a table-free step of eight shifts a byte."""
    byte = f"list_transform(range(0, length({hexadecimal}) // 2), lambda i: CAST('0x' || substr({hexadecimal}, 2 * i + 1, 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: {step}), 4294967295)"


_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(0, len(w) - {len(phrase.split()) - 1}), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))})) AS place FROM words"
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
)

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
        links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
        {_REACH}, degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(least, vec_id) AS component_id, vec_id = coalesce(least, vec_id) AS kept
        FROM v LEFT JOIN degree ON vec_id = a LEFT JOIN least_of ON vec_id = n""",
    "op8_ngram_join": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
        sized AS (SELECT doc_id, len(s) AS n FROM sets), each AS (SELECT doc_id, unnest(s) AS x FROM sets),
        shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM each p JOIN each q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
        {_REACH}
        SELECT doc_id, CAST(sized.n AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id FROM sized LEFT JOIN least_of ON doc_id = least_of.n""",
    "held_out_split": f"SELECT doc_id, {_crc32('hex(CAST(doc_id AS VARCHAR))')} % 5 = 0 AS held_out FROM documents",
    "tiff_payloads": f"""
        WITH sized AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
        padded AS (SELECT doc_id, n, t || repeat(' ', greatest(192, 192 * ((n + 191) // 192)) - n) AS p FROM sized),
        tails AS (SELECT *, right(hex(p), 32) AS tail FROM padded)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_sha256, {_crc32('tail')} AS tail_crc32 FROM tails""",
    "license_places": f"""
        WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        found AS ({_PLACES}),
        sums AS (SELECT doc_id, count(*) AS k, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels
        FROM words LEFT JOIN sums USING (doc_id)""",
    "quality_counts": f"""
        WITH words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words),
        repeats AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: [w[k], w[k + 1], w[k + 2]])) AS win FROM words),
        twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
        counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(repeats.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
            FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN covered USING (doc_id))
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counts""",
    "op12_wand_search": f"""
        WITH texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
        sizes AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM texts WHERE len(t) > 0),
        whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
        found AS (SELECT doc_id, x, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS x FROM texts) GROUP BY ALL),
        asked AS (SELECT DISTINCT item_id, x FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark)),
        weights AS (SELECT x, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM found, whole GROUP BY x, docs),
        scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
            FROM asked JOIN found USING (x) JOIN weights USING (x) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= {BEST}""",
}
