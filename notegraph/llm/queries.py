"""The queries of the operators for training text, and SQL for those that SQL can check on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import cooccur, language, leaks, markup, mixture, repetition, terms

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    t = read_table
    return {
        "p1_found": lambda s, d: markup.markup_found(t(s, d, "nodes")),
        "p1_clean": lambda s, d: markup.clean_nodes(t(s, d, "nodes")),
        "p2_found": lambda s, d: terms.marked_terms(t(s, d, "postings")),
        "p2_frequencies": lambda s, d: terms.term_frequencies(t(s, d, "postings")),
        "p3_found": lambda s, d: terms.distinctive_terms(t(s, d, "postings")),
        "p3_scores": lambda s, d: terms.distinctiveness(t(s, d, "postings")).rows.select("file", "term", "n_term", F.round("z", 6).alias("z")),
        "p4_found": lambda s, d: language.mislabelled(t(s, d, "nodes")),
        "p4_languages": lambda s, d: language.node_languages(t(s, d, "nodes")),
        "p4_segments": lambda s, d: language.node_segments(t(s, d, "nodes")),
        "p5_found": lambda s, d: cooccur.associated_tags(t(s, d, "nodes")),
        "p5_pairs": lambda s, d: cooccur.associations(cooccur.Stored(cooccur.tag_baskets(t(s, d, "nodes")), "baskets").df).select("item_a", "item_b", "together", F.round("lift", 6).alias("lift")),
        "p8_found": lambda s, d: leaks.leaked(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_leaks": lambda s, d: leaks.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixture.Mixture(t(s, d, "documents"), t(s, d, "mix_targets")).selection(),
        "p9_shares": lambda s, d: mixture.Mixture(t(s, d, "documents"), t(s, d, "mix_targets")).shares(),
        "p10_found": lambda s, d: repetition.repetitive(t(s, d, "documents")),
        "p10_shares": lambda s, d: repetition.statistics(t(s, d, "documents")).select("doc_id", "n_words", "n_covered", F.round("repeated_share", 6).alias("repeated_share")),
        "p10_repetition": lambda s, d: repetition.repetition(t(s, d, "documents")).select("doc_id", "n_words", "n_covered", "repeated_share", "anomaly", "flagged"),
    }


# DuckDB folds and trims as the operators do on these tables; nfc_normalize and list functions are its own.
_COUNTED = """
counted AS (SELECT lower(nfc_normalize(trim(term))) AS term, file, sum(count) AS c
            FROM (SELECT DISTINCT term, file, zone, count FROM postings
                  WHERE term IS NOT NULL AND NOT starts_with(term, 's:') AND count > 0) GROUP BY 1, 2),
totals AS (SELECT term, sum(c) AS t, count(*) AS df FROM counted GROUP BY 1),
sizes AS (SELECT file, sum(c) AS f FROM counted GROUP BY 1),
whole AS (SELECT sum(f) AS n, count(*) AS files FROM sizes)"""

_BASKETS = """
ranked AS (SELECT path, tags, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM nodes),
items AS (SELECT DISTINCT path, lower(trim(ltrim(trim(nfc_normalize(x)), '#'))) AS item FROM (SELECT path, unnest(tags) AS x FROM ranked WHERE rn = 1) WHERE x IS NOT NULL),
kept AS (SELECT * FROM items WHERE item <> ''),
single AS (SELECT item, count(*) AS n FROM kept GROUP BY 1),
whole AS (SELECT count(DISTINCT path) AS n FROM kept),
pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS together FROM kept a JOIN kept b ON a.path = b.path AND a.item < b.item GROUP BY 1, 2)"""

# A run of 8 words begins at p; it's a repeat if the same run has begun earlier; a word is covered if it lies in a repeat.
_REPEATS = """
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
repeats AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(p) OVER (PARTITION BY doc_id, run) AS first FROM runs) WHERE p > first),
covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS x FROM repeats) GROUP BY doc_id),
shares AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_covered FROM d LEFT JOIN covered USING (doc_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p10_found": f"WITH {_REPEATS} SELECT doc_id FROM shares WHERE n_words > 0 AND n_covered * 10 >= 3 * n_words",
        "p10_shares": f"WITH {_REPEATS} SELECT doc_id, n_words, n_covered, round(CAST(n_covered AS DOUBLE) / greatest(n_words, 1), 6) AS repeated_share FROM shares",
        "p2_found": f"""WITH {_COUNTED} SELECT term, 'rare' AS mark FROM totals WHERE t <= 4 AND df <= 2
            UNION SELECT term, 'common' FROM totals, whole WHERE df > 0.12 * files""",
        "p2_frequencies": f"""WITH {_COUNTED} SELECT term, CAST(t AS BIGINT) AS total, CAST(df AS BIGINT) AS files,
            CASE WHEN df > 0.12 * whole.files THEN 'common' WHEN t <= 4 AND df <= 2 THEN 'rare' END AS mark FROM totals, whole""",
        "p3_found": f"""WITH {_COUNTED} SELECT file, term FROM counted JOIN totals USING (term) JOIN sizes USING (file), whole
            WHERE c >= 6 AND c * n >= 25 * f * t AND df >= 2 AND df * 20 <= files""",
        "p3_scores": f"""WITH {_COUNTED}, x AS (SELECT file, term, CAST(c AS BIGINT) AS n_term, CAST(c AS DOUBLE) AS c, CAST(f AS DOUBLE) AS f, CAST(t AS DOUBLE) AS t, CAST(n AS DOUBLE) AS n,
                CAST(n AS DOUBLE) / files AS a0, CAST(n AS DOUBLE) / files * t / n AS a FROM counted JOIN totals USING (term) JOIN sizes USING (file), whole)
            SELECT file, term, n_term, round(CASE WHEN f + a0 - c - a > 0 AND n - f + a0 - (t - c) - a > 0
                THEN (ln((c + a) / (f + a0 - c - a)) - ln((t - c + a) / (n - f + a0 - (t - c) - a))) / sqrt(1 / (c + a) + 1 / (t - c + a)) END, 6) AS z FROM x""",
        "p5_found": f"""WITH {_BASKETS} SELECT item_a AS tag_a, item_b AS tag_b FROM pairs JOIN single x ON x.item = item_a JOIN single y ON y.item = item_b, whole
            WHERE together >= 5 AND together * whole.n > 4 * x.n * y.n""",
        "p5_pairs": f"""WITH {_BASKETS} SELECT item_a, item_b, together, round(CAST(together AS DOUBLE) * whole.n / (CAST(x.n AS DOUBLE) * y.n), 6) AS lift
            FROM pairs JOIN single x ON x.item = item_a JOIN single y ON y.item = item_b, whole""",
    }
