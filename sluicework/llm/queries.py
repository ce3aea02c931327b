"""Registered queries of the training-data operators, with their DuckDB counterparts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back, text_part
from .decontamination import contaminated, contamination
from .exact import exact_duplicates
from .html import extract
from .language import address_code, host_of, identify, language_code, learn_letters
from .minhash import near_duplicates
from .packing import pack
from .quality import learn, score
from .secrets import scan
from .spelling import variant_words, variants
from .substrings import repeated_passages
from .tokens import count_tokens
from .trie import conversation_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lower-case A-Z only.
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH d AS (SELECT doc_id, {_LOWER_SQL} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
    """
)
def op3_exact_dedup(spark, sf_dir):
    """Copies after lower-casing A-Z, by chunk recipes."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


@query()
def op10_decontamination(spark, sf_dir):
    """Words of each document inside benchmark windows."""
    found = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op9_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    return packed_pieces(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


@query()
def op8_substring_dedup(spark, sf_dir):
    """Words of passages that a document with a smaller id holds too."""
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op2_minhash_near_dedup(spark, sf_dir):
    """Components of documents at a similarity of 0.75 on five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_chat_formatting(spark, sf_dir):
    """Every conversation formatted, and read back from the formatted string."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
    return read_back(format_conversations(turns.withColumn("parts", text_part(F.col("text")))))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@query()
def op7_quality_classifier(spark, sf_dir):
    """Quality of every document; labels of the rows held out are never read."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    scored = score(spark, docs, learn(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op4_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return extract(spark, table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query()
def op1_language_id(spark, sf_dir):
    """Language of every document: its letters, the declared language, its source's prior."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, ["doc_id"], declared=F.col("lang"), host=F.col("source"))


@query()
def llm_page_languages(spark, sf_dir):
    """Language of every page: its letters, the lang attribute, the address and the host; letters learnt from documents."""
    docs = table(spark, sf_dir, "documents")
    letters = learn_letters(docs, "text", language_code(F.col("lang")))
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace("html", "(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;?", " ")
    lang = F.regexp_extract("html", "(?i)<html[^>]*\\slang\\s*=\\s*[\"']?([a-zA-Z-]+)", 1)
    return identify(pages.withColumn("bare", bare), ["page_id"], "bare", lang, address_code(F.col("url")), host_of(F.col("url")), letters)


@query()
def op5_secret_scan(spark, sf_dir):
    """Every candidate of every document, with the forest's verdict."""
    return scan(spark, table(spark, sf_dir, "documents"))


#: CRC-32 of the texts s in the rows of `spoken`: it is linear over the bytes, so each byte's part comes from a table by its
#: distance to the end, and the parts are combined by exclusive or. Gives crc(s, h).
_CRC_SQL = """
    t8(b, v, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, xor(v >> 1, 3988292384 * (v & 1)), i + 1 FROM t8 WHERE i < 8),
    t(b, v) AS (SELECT b, v FROM t8 WHERE i = 8),
    bytes AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM spoken),
    far(k, b, v) AS (SELECT 0, b, v FROM t UNION ALL SELECT k + 1, far.b, xor(t.v, far.v >> 8) FROM far JOIN t ON t.b = far.v & 255 WHERE k < (SELECT max(n) FROM bytes)),
    start(k, v) AS (SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(t.v, start.v >> 8) FROM start JOIN t ON t.b = start.v & 255 WHERE k < (SELECT max(n) FROM bytes)),
    spread AS (SELECT s, n, unnest(range(1, n + 1)) AS i, x FROM bytes),
    parts AS (SELECT s, max(n) AS n, bit_xor(far.v) AS v FROM (SELECT s, n, n - i AS k, ('0x' || substr(x, 2 * i - 1, 2))::INT AS b FROM spread) p JOIN far USING (k, b) GROUP BY s),
    crc AS (SELECT s, xor(xor(parts.v, start.v), 4294967295) AS h FROM parts JOIN start ON start.k = parts.n)
"""


@query(
    f"""
    WITH RECURSIVE said AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    spoken AS (SELECT DISTINCT c::VARCHAR AS s FROM said), {_CRC_SQL},
    heads AS (SELECT s::BIGINT AS c, h % 4 AS h FROM crc),
    rebuilt AS (
        SELECT heads.c, 0 AS part, pos, key, words FROM heads JOIN said ON said.c = heads.c - heads.c % 20 AND pos < h
        UNION ALL SELECT heads.c, 1, pos, key, words FROM heads JOIN said ON said.c = heads.c AND pos >= h),
    path AS (
        SELECT c, row_number() OVER w AS d, list(key) OVER w AS p, words, count(*) OVER (PARTITION BY c) AS size
        FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, pos)
        UNION ALL SELECT c, 0, [], 0, (SELECT count(*) FROM rebuilt r WHERE r.c = heads.c) FROM heads),
    node AS (
        SELECT p, max(d) AS d, min(c) AS c, count(*) AS n, max(words) AS words,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends
        FROM path GROUP BY p),
    kids AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
    whole AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (p)),
    up AS (SELECT unnest(list_transform(range(0, d + 1), lambda e: list_slice(p, 1, e))) AS p, kids, n, words FROM whole),
    below AS (SELECT p, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * words) AS saved FROM up GROUP BY p)
    SELECT whole.c AS conv_id, whole.d AS depth, parent.c AS parent_conv_id, whole.n AS n_convs, whole.kids AS n_children,
           leaves AS n_leaves, saved::BIGINT AS saved_tokens, whole.ends AS ends_sha256
    FROM whole JOIN below USING (p) LEFT JOIN node parent ON whole.d > 0 AND parent.p = list_slice(whole.p, 1, whole.d - 1)
    """
)
def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of the rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query(
    f"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run FROM (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5),
    spoken AS (SELECT DISTINCT s FROM runs), {_CRC_SQL},
    words AS (
        SELECT word, count(*) AS n FROM (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
            FROM runs JOIN crc USING (s))
        WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
    losses AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS m FROM losses a JOIN losses b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT l.word, l.n, w.word, w.n FROM losses l JOIN words w ON w.word = l.rest
        UNION SELECT w.word, w.n, l.word, l.n FROM losses l JOIN words w ON w.word = l.rest),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
    known AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n
        FROM words w LEFT JOIN best USING (word)),
    way(word, here) AS (SELECT word, word FROM known UNION ALL SELECT way.word, k.form FROM way JOIN known k ON k.word = way.here WHERE k.form IS NOT NULL)
    SELECT known.word, known.form, way.here AS root, known.n, known.n_near, known.form_n
    FROM known JOIN way USING (word) JOIN known last ON last.word = way.here WHERE last.form IS NULL
    """
)
def op12_spelling_variants(spark, sf_dir):
    """Words of all documents, their commoner forms one edit away, and where those lead."""
    return variants(variant_words(table(spark, sf_dir, "documents")))


@query()
def op13_token_counts(spark, sf_dir):
    """Tokens of every document in the piece vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
