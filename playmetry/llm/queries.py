"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetry.llm.ann import nearest
from playmetry.llm.codes import vector_codes
from playmetry.llm.common import prepared
from playmetry.llm.html import extract
from playmetry.llm.language import held_out, identify, learned
from playmetry.llm.lexical import lexical_search
from playmetry.llm.lines import learn_lines, quality_rules
from playmetry.llm.mixing import mix
from playmetry.llm.nearcopies import near_copies
from playmetry.llm.pieces import load_vocabulary, round_trip
from playmetry.llm.shards import shard_texts
from playmetry.llm.substrings import remove_repeats
from playmetry.llm.suffixes import byte_repeats
from playmetry.llm.urls import filter_urls, listed_by_label

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with equal SQL where there is some."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every 50th one, by cosine."""
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those whose id's checksum is not a multiple of 5."""
    docs = table(spark, folder, "documents")
    told = identify(docs, learned(docs))
    return told.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "lang")


@query()
def op3_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document so that sources weigh 3, 1, 2 in turn of 150 % of all words."""
    return mix(table(spark, folder, "documents")).drop("copies")


@query()
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """One sampled segmentation of every document, seeded by its id, and whether it decodes to the text."""
    return round_trip(table(spark, folder, "documents"), load_vocabulary())


@query(
    r"""
    WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
        FROM t, unnest(range(1, greatest(len(w) - 48, 1))) AS r(i)
    ),
    firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
    hits AS (SELECT windows.doc_id, i FROM windows JOIN firsts ON windows.k = firsts.k WHERE doc_id > first_id),
    gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM hits, unnest(range(0, 50)) AS s(o)),
    words AS (SELECT doc_id, pos, w[pos] AS word FROM t, unnest(range(1, len(w) + 1)) AS p(pos)),
    kept AS (
        SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS words_left
        FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos
        WHERE gone.pos IS NULL GROUP BY words.doc_id
    ),
    counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
           sha256(coalesce(words_left, '')) AS kept_sha256
    FROM t LEFT JOIN counts ON t.doc_id = counts.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
    """
)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of every document once passages of 50 words that begin in an earlier one are gone."""
    return remove_repeats(table(spark, folder, "documents"), length=50).drop("kept_text")


@query(
    r"""
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k
        FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2
    ),
    links AS (
        SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * c >= 85 * (p.n + q.n - c)
    ),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, to_id) AS (
        SELECT DISTINCT a, a FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.to_id
    ),
    least_ids AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, t.doc_id) AS component_id,
           coalesce(component_id, t.doc_id) = t.doc_id AS kept
    FROM t LEFT JOIN sizes ON t.doc_id = sizes.doc_id LEFT JOIN least_ids ON t.doc_id = least_ids.doc_id
    """
)
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of 85 % shared five-word shingles."""
    return near_copies(table(spark, folder, "documents"), percent=85)


@query()
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, folder, "pages"))


#: Host and path rules of the URL query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Host labels whose pages make up the block list of the URL query.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query(
    r"""
    WITH rest AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
    ),
    parts AS (
        SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
    ),
    named AS (
        SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical FROM parts
    ),
    listed AS (
        SELECT DISTINCT canonical FROM named
        WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
    ),
    ruled AS (
        SELECT *, CASE
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
        END AS rule FROM named
    )
    SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
        canonical IN (SELECT canonical FROM listed) AS listed
    FROM ruled
    """
)
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; the block list is drawn from the pages."""
    pages = table(spark, folder, "pages")
    return filter_urls(pages, listed_by_label(pages, LISTED_LABELS), RULES)


@query()
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document, and whether its share of content lines keeps it."""
    docs = table(spark, folder, "documents")
    return quality_rules(docs, learn_lines(docs, table(spark, folder, "labels")))


@query()
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of all documents, equal texts together, the largest as small as can be."""
    return shard_texts(table(spark, folder, "documents"), 8)


def _codes_sql() -> str:
    """SQL of the vector codes: each round assigns all parts and then moves the entries."""
    square = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        """WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, label,
               list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )""",
        "parts AS MATERIALIZED (SELECT r, p, v[(p * len(v)) // 4 + 1:((p + 1) * len(v)) // 4] AS x FROM v, range(4) AS t(p))",
        "start AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v WHERE vec_id IS NOT NULL QUALIFY e < 256)",
        "book0 AS MATERIALIZED (SELECT p, e, x AS y FROM parts JOIN start USING (r))",
    ]
    for k in range(5):
        steps.append(
            f"""near{k} AS MATERIALIZED (
        SELECT r, p, min({{'d': {square}, 'e': e}}) AS best FROM parts JOIN book{k} USING (p) GROUP BY r, p
    )"""
        )
        if k < 4:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (
        WITH sums AS (
            SELECT p, e, i, sum(x[i + 1])::BIGINT AS s, count(*) AS n
            FROM (SELECT p, best.e AS e, x, unnest(range(len(x))) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i
        ),
        moved AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums GROUP BY p, e)
        SELECT p, e, coalesce(m, y) AS y FROM book{k} LEFT JOIN moved USING (p, e)
    )"""
            )
    steps.append("hash AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM book4)")
    steps.append(
        """coded AS (
        SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near4 GROUP BY r
    )"""
    )
    return ",\n    ".join(steps) + """
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
    FROM v JOIN coded USING (r), hash
    """


@query(_codes_sql())
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code, error and checksum of the codebooks of every vector."""
    return vector_codes(table(spark, folder, "embeddings"))


@query(
    r"""
    WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    hexes AS (SELECT doc_id, regexp_extract_all(lower(hex(b)), '..') AS h FROM t),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(h[i:i + 49], '')) AS k
        FROM hexes, unnest(range(1, greatest(len(h) - 48, 1))) AS r(i)
    ),
    firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
    hits AS (SELECT windows.doc_id, i FROM windows JOIN firsts ON windows.k = firsts.k WHERE doc_id > first_id),
    gone AS (SELECT DISTINCT doc_id, i + o AS pos FROM hits, unnest(range(0, 50)) AS s(o)),
    edges AS (
        SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE pos - before > 1 OR before IS NULL) AS spans
        FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id
    ),
    bytes AS (SELECT doc_id, pos, h[pos] AS x FROM hexes, unnest(range(1, len(h) + 1)) AS p(pos)),
    kept AS (
        SELECT bytes.doc_id, string_agg(x, '' ORDER BY bytes.pos) AS bytes_left
        FROM bytes LEFT JOIN gone ON bytes.doc_id = gone.doc_id AND bytes.pos = gone.pos
        WHERE gone.pos IS NULL GROUP BY bytes.doc_id
    )
    SELECT t.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed,
           coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(bytes_left, ''))) AS kept_sha256
    FROM t LEFT JOIN edges ON t.doc_id = edges.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
    """
)
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes left of every document once strings of 50 bytes that begin in an earlier one are gone."""
    left = byte_repeats(table(spark, folder, "documents"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query(
    r"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
    ),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
    whole AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM docs WHERE len(w) > 0),
    wanted AS (
        SELECT DISTINCT item_id, term FROM (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    ),
    weights AS (
        SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
        FROM tf, whole GROUP BY term, big_n
    ),
    scores AS (
        SELECT item_id, docs.r, doc_id,
               sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * big_n) // big_l))))::BIGINT AS score
        FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN docs ON docs.r = tf.r, whole
        GROUP BY item_id, docs.r, doc_id
    ),
    places AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
    SELECT item_id, place::INTEGER AS rank, doc_id, score FROM places WHERE place <= 10
    """
)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
