"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3),
      lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b
      ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 75 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM r
      JOIN l ON l.a = r.node),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id,
  d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""


@query(NEAR_SQL)
def op3_near_duplicates(spark, sf_dir):
    from loanlife.llm.near_duplicates import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
g AS (SELECT p.doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p JOIN w USING (doc_id)),
d AS (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM g JOIN d USING (h)),
k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1),
    lambda x: NOT list_contains(coalesce(gone, CAST([] AS BIGINT[])), x)), lambda x: ws[x]), ' '))
    AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query(REPEATS_SQL)
def op6_repeats(spark, sf_dir):
    from loanlife.llm.repeats import repeat_report
    return repeat_report(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op5_pieces(spark, sf_dir):
    import public_tokenizers

    from loanlife.llm.pieces import encoding_digests, read_model
    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return encoding_digests(table(spark, sf_dir, "documents"), model)


@query()
def op9_quality(spark, sf_dir):
    from loanlife.llm.quality import score_rows, train
    docs = table(spark, sf_dir, "documents")
    return score_rows(docs, train(docs, table(spark, sf_dir, "labels")))


CONTAMINATION_SQL = r"""
WITH w AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL
           SELECT 1, item_id, text FROM benchmark),
x AS (SELECT kind, id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM w),
s AS (SELECT kind, id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3),
      lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM x),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY 1)
SELECT a.id AS doc_id, b.id AS item_id, n.n AS n_item, count(*) AS n_common,
  count(*) / CAST(n.n AS DOUBLE) AS containment
FROM s a JOIN s b ON a.g = b.g AND a.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
GROUP BY a.id, b.id, n.n HAVING 100 * count(*) >= 75 * n.n
"""


@query(CONTAMINATION_SQL)
def op10_contamination(spark, sf_dir):
    from loanlife.llm.contamination import find_items
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_syncmers(spark, sf_dir):
    from loanlife.llm.syncmers import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))


@query()
def op8_wordpieces(spark, sf_dir):
    import public_tokenizers

    from loanlife.llm.wordpieces import token_counts, vocabulary
    begin, go_on = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), begin, go_on)


FIXITY_SQL = r"""
WITH p AS (SELECT page_id, page_id // 1000 AS archive, coalesce(url, '') AS url,
    coalesce(html, '') AS html, CASE WHEN page_id % 101 = 7 THEN coalesce(html, '') || '<!-- -->'
      ELSE coalesce(html, '') END AS copy FROM pages),
r AS (SELECT page_id, archive, sha256(a) AS expected, sha256(b) AS found, strlen(a) AS n FROM (
  SELECT page_id, archive, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13)
    || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: '
    || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10)
    || chr(13) || chr(10) AS a,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13)
    || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: '
    || strlen(copy) || chr(13) || chr(10) || chr(13) || chr(10) || copy || chr(13) || chr(10)
    || chr(13) || chr(10) AS b FROM p)),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY archive ORDER BY page_id, expected
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT page_id, archive, "offset", CAST(n AS BIGINT) AS n_bytes,
  CASE WHEN page_id % 103 = 5 THEN 'missing' ELSE 'altered' END AS status, expected,
  CASE WHEN page_id % 103 = 5 THEN NULL ELSE found END AS found
FROM o WHERE page_id % 103 = 5 OR expected <> found
"""


@query(FIXITY_SQL)
def op7_fixity(spark, sf_dir):
    """The pages as archives, against a replica with changed and lost records."""
    from pyspark.sql import functions as F

    from loanlife.llm.fixity import audit, layout
    from loanlife.support import materialize
    html = F.coalesce("html", F.lit(""))
    copy = F.when(F.col("page_id") % 101 == 7, F.concat(html, F.lit("<!-- -->"))).otherwise(html)
    records = materialize(layout(table(spark, sf_dir, "pages"), {"primary": html, "copy": copy}),
                          "records")
    primary = records.select("archive", "offset", F.col("primary").alias("digest"))
    replica = records.where("page_id is null or page_id % 103 <> 5").select(
        "archive", "offset", F.col("copy").alias("digest"))
    return audit(primary, replica).join(
        records.select("archive", "offset", "page_id", "n_bytes"), ["archive", "offset"])


@query()
def op2_licenses(spark, sf_dir):
    from loanlife.llm.licenses import find_licenses
    return find_licenses(table(spark, sf_dir, "documents"))


_MAIL = """
mail AS (SELECT c.conv_id, c.turn, c.text || CASE WHEN a.text IS NULL THEN '' ELSE
    chr(10) || 'In turn ' || CAST(c.turn - 1 AS VARCHAR(20)) || ' someone wrote:' || chr(10) || '> '
    || replace(a.text, chr(10), chr(10) || '> ') END || CASE WHEN b.text IS NULL THEN '' ELSE
    chr(10) || '>> ' || replace(b.text, chr(10), chr(10) || '>> ') END AS text
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) c
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, min(text) AS text FROM conversations GROUP BY 1, 2) a
    ON a.conv_id = c.conv_id AND a.turn = c.turn
  LEFT JOIN (SELECT conv_id, turn + 2 AS turn, min(text) AS text FROM conversations GROUP BY 1, 2) b
    ON b.conv_id = c.conv_id AND b.turn = c.turn)
"""

QUOTATION_SQL = "WITH RECURSIVE" + _MAIL + r"""
, m AS (SELECT row_number() OVER () AS id, * FROM mail),
l AS (SELECT id, conv_id, turn, i, regexp_extract(line, '^(?:> ?)+') AS marks,
    regexp_replace(line, '^(?:> ?)+', '') AS body
  FROM (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m)),
v AS (SELECT *, length(replace(marks, ' ', '')) AS level FROM l),
g AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM v),
p AS (SELECT id, conv_id, turn, level, min(i) AS i, max(i) AS last,
    string_agg(body, chr(10) ORDER BY i) AS body FROM g GROUP BY id, conv_id, turn, level, run),
n AS (SELECT id, max(last) AS n FROM p GROUP BY 1),
o AS (SELECT id, conv_id, turn, string_agg(t, chr(10) ORDER BY i) AS own FROM (
    SELECT p.*, CASE WHEN last < n.n THEN regexp_replace(body, '(^|\n)[^\n]*wrote:[ \t]*\n*$', '')
      ELSE body END AS t FROM p JOIN n USING (id) WHERE level = 0) WHERE t <> '' GROUP BY 1, 2, 3),
k AS (SELECT id, conv_id, turn, 0 AS i, own AS t FROM o UNION ALL
  SELECT id, conv_id, turn, generate_subscripts(string_split(own, chr(10)), 1),
    unnest(string_split(own, chr(10))) FROM o),
f AS (SELECT conv_id, turn, i, trim(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS t FROM k),
x AS (SELECT conv_id, t, min(turn) AS to_turn FROM f WHERE t <> '' GROUP BY 1, 2),
y AS (SELECT t, arg_min(conv_id, (conv_id, turn)) AS to_conv, max(conv_id) AS last_conv FROM f WHERE t <> '' AND i = 0 GROUP BY 1),
q AS (SELECT id, conv_id, turn, level, i, trim(regexp_replace(translate(body,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS t,
    string_split(body, chr(10)) AS ls FROM p WHERE level > 0),
w AS (SELECT id, conv_id, turn, level, i, 0 AS place, t FROM q UNION ALL
  SELECT id, conv_id, turn, level, i, generate_subscripts(ls, 1), trim(regexp_replace(translate(
    unnest(ls), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\x0B\f\r ]+', ' ',
    'g')) FROM q),
near AS (SELECT id, i, arg_min(to_turn, place) AS to_turn FROM w JOIN x USING (conv_id, t)
  WHERE w.t <> '' AND to_turn < turn GROUP BY 1, 2),
links AS (SELECT q.id, q.conv_id, q.turn, q.level, near.to_turn,
    near.to_turn IS NOT NULL OR y.to_conv <> q.conv_id OR y.last_conv <> q.conv_id AS linked
  FROM q LEFT JOIN near USING (id, i) LEFT JOIN y ON y.t = q.t WHERE q.t <> ''),
par AS (SELECT conv_id, turn, arg_max(to_turn, (-level, to_turn)) AS parent_turn FROM links
  WHERE to_turn IS NOT NULL GROUP BY 1, 2),
keys AS (SELECT DISTINCT conv_id, turn FROM m),
tree AS (SELECT k.conv_id, k.turn, par.parent_turn, k.turn AS root_turn, 0 AS depth FROM keys k
    LEFT JOIN par USING (conv_id, turn) WHERE par.parent_turn IS NULL
  UNION ALL SELECT par.conv_id, par.turn, par.parent_turn, tree.root_turn, tree.depth + 1 FROM tree
    JOIN par ON par.conv_id = tree.conv_id AND par.parent_turn = tree.turn),
c AS (SELECT id, count(*) AS n_quotes, count(CASE WHEN linked THEN 1 END) AS n_linked FROM links
  GROUP BY 1)
SELECT m.conv_id, root_turn, m.turn, parent_turn, depth, coalesce(n_quotes, 0) AS n_quotes,
  coalesce(n_linked, 0) AS n_linked, coalesce(own, '') AS body
FROM m JOIN tree USING (conv_id, turn) LEFT JOIN c USING (id) LEFT JOIN o ON o.id = m.id
"""


@query(QUOTATION_SQL)
def op1_quotations(spark, sf_dir):
    """The conversations written as mail: each turn quotes the two before it."""
    from loanlife.llm.quotations import conversations
    mail = _MAIL.replace("VARCHAR(20)", "STRING").replace("FROM conversations", "FROM {given}")
    return conversations(spark.sql(f"WITH {mail} SELECT * FROM mail",
                                   given=table(spark, sf_dir, "conversations")))


@query()
def op11_packing(spark, sf_dir):
    import public_tokenizers

    from loanlife.llm.packing import pack
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return pack(table(spark, sf_dir, "documents"), file.read())


SEARCH_SQL = r"""
WITH a AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL
           SELECT 1, item_id, text FROM benchmark),
x AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM a),
d AS (SELECT id, len(ts) AS n FROM x WHERE kind = 0 AND len(ts) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
q AS (SELECT DISTINCT id AS item_id, unnest(ts) AS t FROM x WHERE kind = 1),
p AS (SELECT id AS doc_id, t, count(*) AS tf FROM (
    SELECT id, unnest(ts) AS t FROM x WHERE kind = 0) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p, s GROUP BY t, big_n),
m AS (SELECT id AS doc_id, 50 + (50 * n * big_n) // big_l AS m FROM d, s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT)
      AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""


@query(SEARCH_SQL)
def op12_ranked_search(spark, sf_dir):
    from loanlife.llm.ranked import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEGATIVES_SQL = r"""
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT)
      AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
      CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""


@query(NEGATIVES_SQL)
def op13_hard_negatives(spark, sf_dir):
    """The labels first change where the id is divisible by 7."""
    from pyspark.sql import functions as F

    from loanlife.llm.negatives import hard_negatives
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", changed))
