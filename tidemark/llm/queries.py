"""The registered queries of this package, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import chat_format, secret_scan, token_file, toxicity, warc
from .byte_bpe import encode_texts
from .collocations import collocations
from .divergence import divergence
from .mixing import mix_sources, taken
from .multiset_hash import fingerprints
from .ngram_join import similar
from .repetition import judge
from .substring_dedup import remove_repeats
from .text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op9_substring_dedup", rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN least USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit)),
every AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op9(spark, sf_dir):
    """Every document without the 13-word windows that an earlier document has."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard")
def op3(spark, sf_dir):
    """Class, number of links and group of every document at five words and similarity 0.8."""
    return similar(table(spark, sf_dir, "documents"))


@query("op2_multiset_hash")
def op2(spark, sf_dir):
    """Fingerprint of every document and of its edited form; printed as their first identity lanes, which add up like the vectors."""
    out = fingerprints(table(spark, sf_dir, "documents"), wide=False)
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("vector")).alias("fingerprint"), F.lower(F.hex("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    """Every document encoded and decoded again."""
    out = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_repetition_rules", rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w),
win AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS k FROM starts, (VALUES (3), (8), (101)) AS sizes(n) WHERE i + n - 1 <= len(ws)
),
twice AS (SELECT doc_id, i, n FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, n, k) > 1),
cover AS (SELECT DISTINCT doc_id, n, p FROM (SELECT doc_id, n, unnest(range(i, i + n)) AS p FROM twice)),
sums AS (
  SELECT doc_id, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 8) AS n8, count(*) FILTER (n = 101) AS n101 FROM cover GROUP BY doc_id
),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words, coalesce(n8, 0) AS n8, coalesce(n101, 0) AS n101
  FROM w LEFT JOIN sums USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n8 <= 45 * n_words AND n101 = 0 AS kept
FROM base
""")
def op4(spark, sf_dir):
    """Repetition figures and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).drop("n_covered", "longest")


@query("op5_secret_ownership", rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
kinds(kind, name, pattern) AS (VALUES (0, 'assign', '{secret_scan.ASSIGN.replace("'", "''")}'), (1, 'access', '{secret_scan.ACCESS}'), (2, 'hex', '{secret_scan.HEX}'), (3, 'owned', '{secret_scan.CANDIDATE}')),
raw AS (
  SELECT doc_id, source, kind, pattern, regexp_extract_all(text, pattern) AS m, regexp_split_to_array(text, pattern) AS p
  FROM d, kinds WHERE regexp_matches(text, pattern)
),
each AS (SELECT doc_id, source, kind, pattern, unnest(m) AS v, unnest(p[1 : len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM raw),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(v, pattern, 2) ELSE v END AS secret FROM each
),
found AS (
  SELECT doc_id, coalesce(source, chr(0)) AS owner, kind, stop - length(v) AS start, stop, secret FROM placed
  WHERE CASE kind WHEN 0 THEN length(secret) >= 6 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') ELSE true END
),
held AS (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT text) AS repositories, min(owner) AS owner FROM found JOIN d USING (doc_id) GROUP BY secret),
owned AS (SELECT coalesce(source, chr(0)) AS owner, count(DISTINCT text) AS texts FROM d GROUP BY 1),
live AS (SELECT secret, owners <= 1 AND (repositories < 20 OR 2 * repositories <= texts) AS live FROM held JOIN owned USING (owner)),
picked AS (
  SELECT f.* FROM found f JOIN live USING (secret) WHERE kind < 3 OR live AND NOT EXISTS (
    SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.kind < 3 AND b.start < f.stop AND f.start < b.stop)
),
named AS (SELECT *, name || ':' || start || ':' || stop AS span FROM picked JOIN kinds USING (kind)),
sums AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM named GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (doc_id)
""")
def op5(spark, sf_dir):
    """Secrets of every document; sources own them, and each distinct text is a repository. A span is the whole match of its pattern."""
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(secret_scan.printed(base), 256).alias("base_sha256"), secret_scan.printed(F.col("secrets")).alias("spans"))


@query("op10_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
),
sized AS (SELECT *, length(regexp_replace(role, '[^<\[|]+', '', 'g')) + length(role) + length(regexp_replace(text, '[^<\[]+', '', 'g')) + length(text) + 10 AS n FROM turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op10(spark, sf_dir):
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    out = chat_format.render(chat_format.canonical_turns(rows.unionByName(extra), "conv_id"))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("learned", chat_format.read_loss(F.col("formatted"), F.col("loss")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                      F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op8_source_mix")
def op8(spark, sf_dir):
    """Words that the mix takes of every document, in all and for each output shard (``shard:words``, comma-joined)."""
    rows, pieces = mix_sources(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s["shard"].cast("string"), s["words"].cast("string"))), ",")
    return taken(rows, pieces).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", shards.alias("shards"))


@query("op7_warc_archive", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM m
""")
def op7(spark, sf_dir):
    """Every page written to WARC and read back; responses by their payload, revisits by their header alone."""
    path = warc.scratch(spark)
    warc.archive(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS BIGINT)")
    full = warc.read(spark, path).filter("record_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = warc.read(spark, path, payload=False).filter("record_type = 'revisit'")
    return full.unionByName(again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to")))


@query("op1_toxicity_cnn")
def op1(spark, sf_dir):
    """Toxicity of every document, learnt from labels outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(1))
    model = toxicity.fit(docs, labels.filter(fifth != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fifth == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "language")


@query("op11_source_divergence", r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (
  SELECT lang, source, row, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT *, row_number() OVER () AS row FROM d)
),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
n1 AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
n2 AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
cq AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5) // (coalesce(n1.total, 0) + 5 * v) AS BIGINT) AS p
  FROM groups g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n1 ON n1.lang = g.lang AND n1.source = g.source
),
q AS (SELECT lang, term, 1 + CAST(1000000000 * (CAST(cq.n AS HUGEINT) + 5) // (total + 5 * v) AS BIGINT) AS q FROM cq JOIN n2 USING (lang) JOIN size USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op11(spark, sf_dir):
    """Distances between the sources of each language and the terms by which each stands out."""
    return divergence(table(spark, sf_dir, "documents"))


@query("op13_token_files")
def op13(spark, sf_dir):
    """Every document encoded, written to packed token files and read back."""
    path = token_file.scratch(spark)
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(ws) - k + 2, 1)), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS pos FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, pos, x.f AS l, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1 : pos], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[pos + 1 :], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
inner_ AS (SELECT lang, array_to_string(ws[pos : pos + 1], ' ') AS phrase, max(a) AS longest FROM cuts WHERE k = 3 GROUP BY ALL),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best LEFT JOIN inner_ USING (lang, phrase)
  WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op12(spark, sf_dir):
    """The best two thousand phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))
