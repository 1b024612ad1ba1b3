"""The registered queries of this subpackage, with production settings and whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import anchors, centroids, chat, contamination, jaccard, language, lattice, licences, manifest, pieces, toxicity, urls, winnowing
from .stages import fold_of

#: Rules of the url filter: host and path prefix, and what they decide.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: The vocabulary file of the tokenizer query and of the last pipeline stage.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, left: int):
    """Whether the row's fold is the held one; a null id is never held."""
    return F.coalesce(fold_of(F.col("doc_id"), folds) == left, F.lit(False))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: of the longest fitting rule, else of the n-gram model."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, urls.train(urls.small_table()))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by 3-word shingles at a Jaccard similarity of 0.9 and more."""
    settings = jaccard.JaccardSettings(width=3, numerator=9, denominator=10, thin=2)
    return jaccard.near_copies(table(spark, sf_dir, "documents"), settings, "op2")


SQL["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n"""


@query
def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subword lattice likelihood of every document beside a smoothed word unigram."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lattice.score(docs, fold_of(F.col("doc_id"), 5) != 1, PIECES, name="op3")
    return scored.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every document and of its edited text, and how alike they are."""
    rows = winnowing.edits(table(spark, sf_dir, "documents")).withColumns(
        {"own": winnowing.hashes(F.col("packed")), "changed": winnowing.hashes(F.col("edited_packed"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", winnowing.digest(F.col("packed")).alias("fingerprint"),
        winnowing.digest(F.col("edited_packed")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        winnowing.likeness(F.col("own"), F.col("next_hashes")).alias("near_next"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    found = F.col("licences")
    base = F.filter(found, lambda x: x["phrase"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(x):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")

    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(found).alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda x: x["containment"])), F.lit(0.0)).alias("score"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENCE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _listed(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


SQL["op5_license_scan"] = f"""
WITH phrases(label, p) AS (VALUES {", ".join(f"('{label}', {_listed(p)})" for p, label in licences.PHRASES)}),
templates(label, t) AS (VALUES {", ".join(f"('{label}', {_listed(t)})" for label, t in licences.TEMPLATES)}),
d AS (SELECT doc_id, {_LOWERED} AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, {_LICENCE_WORD}) AS w FROM d),
base AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS start FROM w, phrases),
sized AS (SELECT label, list_distinct(t) AS t, len(list_distinct(t)) AS m, (len(t) * 5 + 3) // 4 AS width FROM templates),
held AS (SELECT doc_id, w, label, t, m, width FROM w, sized WHERE 5 * len(list_intersect(list_distinct(w), t)) >= 4 * m),
met AS (SELECT doc_id, label, max(len(list_intersect(list_distinct(w[i:i + width - 1]), t))) / any_value(m) AS containment
  FROM (SELECT *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(t, w[i]))) AS i FROM held) GROUP BY doc_id, label, t HAVING max(5 * len(list_intersect(list_distinct(w[i:i + width - 1]), t))) >= 4 * any_value(m)),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score
      FROM (SELECT doc_id, label, 1.0::DOUBLE AS c FROM base UNION ALL SELECT doc_id, label, containment FROM met) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows outside the held fold; null ids are scored, not learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), F.col("toxic").alias("over_threshold"))


@query
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with its most similar window."""
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), name="op7")


def conversation_events(rows: DataFrame) -> DataFrame:
    """The event log of conversations (conv_id, turn, role, text): every message is opened and streamed in two deltas;
    assistants first stream a draft that is regenerated, system texts are edited into place. Rows that share a turn are
    branches in the order of role and text, null first; repeated rows are branches of their own. Null ids and turns are
    ids and turns like any other."""
    branch = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1)

    def event(seq: int, kind: str, part=F.lit(None).cast("string")):
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), part.alias("text"))

    plain = F.array(event(0, "open"), event(1, "delta", first), event(2, "delta", rest))
    again = F.array(event(0, "open"), event(1, "delta", rest), event(2, "regenerate"), event(3, "delta", first), event(4, "delta", rest))
    edited = F.array(event(0, "open"), event(1, "delta", first), event(2, "edit", text))
    events = F.when(F.col("role") == "assistant", again).when(F.col("role") == "system", edited).otherwise(plain)
    return (rows.withColumn("branch", branch.cast("long")).withColumn("e", F.explode(events))
            .select("conv_id", "turn", "branch", "e.seq", "e.kind", "role", "e.text"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, rebuilt from its event log, rendered and read back."""
    tricky = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(own)
    return chat.digests(chat.render(chat.fold(conversation_events(rows))))


_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '</turn>', '\\</turn>'), '### ', '\\### ')"
SQL["op8_chat_format"] = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace({_ESCAPED.format("role")}, ':', '\\:')) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held fold; null ids are predicted, not learnt."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"), fold_of(F.col("doc_id"), 3) != 1)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES).select(
        "doc_id", "n_tokens", "round_trip", "token_ids")


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds from forty hashed starts, with inertias and centroid digests."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), centroids.CentroidSettings(), "op11")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _cluster_sql(clusters: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    apart = f"list_sum(list_transform(generate_series(1, {dimensions}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
    parts = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, vec_id, v FROM kept ORDER BY ALL LIMIT {clusters}))"""]
    for n in range(rounds + 1):
        parts.append(f"""
d{n} AS MATERIALIZED (SELECT r, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT r, c, {apart} AS d FROM kept k, c{n} c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM d{n} JOIN parts USING (r) GROUP BY c, i) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""WITH {",".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM d{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""


SQL["op11_centroid_clusters"] = _cluster_sql()


@query
def op12_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by 3-word shingles: fingerprints of 64 bits that differ in two bits at most."""
    found = anchors.near_copies(table(spark, sf_dir, "documents"), anchors.AnchorSettings(), "op12")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest of all, and whether it still verifies after tampering."""
    settings = manifest.ManifestSettings()
    changed = (fold_of(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n"))
    after = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in settings.fields]
    items = F.struct("doc_id", F.when(changed, manifest.leaf(after)).alias("tampered"))
    built = manifest.build(table(spark, sf_dir, "documents"), items, settings, "op13")
    root = F.lit(built.root).cast("string")
    rows = manifest.proofs(built, settings, "op13").withColumn("folded_root", manifest.fold(F.coalesce("item.tampered", "leaf"), F.col("path")))
    return rows.select("item.doc_id", "leaf", "subroot", root.alias("root"), manifest.siblings(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == root).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree_sql(name: str, rows: str) -> str:
    """`name`: all nodes (lvl, grp, pos, d, n) of the trees over `rows` (grp, pos, d, n), n being the nodes of the level."""
    return f"""{name} AS (SELECT 0 AS lvl, * FROM ({rows}) UNION ALL
  SELECT lvl + 1, grp, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY lvl, grp, pos // 3)"""


def _steps_sql(name: str, tree: str) -> str:
    """`name`: of every node (lvl, grp, pos) below a top, its siblings left and right."""
    return f"""{name} AS MATERIALIZED (SELECT a.lvl, a.grp, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {tree} a JOIN {tree} b ON a.lvl = b.lvl AND a.grp IS NOT DISTINCT FROM b.grp AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.grp, a.pos)"""


SQL["op13_dataset_manifest"] = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
docs AS (SELECT *, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS x FROM documents, crc),
leaves AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
  CASE WHEN xor(x, 4294967295) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS after,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf_sql("text")}) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM docs),
{_tree_sql("low", "SELECT source AS grp, pos, leaf AS d, n FROM leaves")},
tops AS MATERIALIZED (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree_sql("high", "SELECT '' AS grp, pos, subroot AS d, n FROM tops")},
{_steps_sql("a", "low")},
{_steps_sql("b", "high")},
path AS MATERIALIZED (
  SELECT doc_id, leaf, lvl, l, r FROM leaves JOIN a ON a.grp IS NOT DISTINCT FROM leaves.source AND a.pos = leaves.pos // (3 ** a.lvl)::BIGINT
  UNION ALL SELECT doc_id, leaf, 1000 + lvl, l, r FROM leaves JOIN tops t ON t.grp IS NOT DISTINCT FROM leaves.source JOIN b ON b.pos = t.pos // (3 ** b.lvl)::BIGINT),
whole AS (SELECT doc_id, leaf, string_agg(l || r, '' ORDER BY lvl) AS s, list({{'l': l, 'r': r}} ORDER BY lvl) AS p FROM path GROUP BY doc_id, leaf),
folded AS (SELECT doc_id, leaf, 1 AS k, after AS d, p FROM leaves LEFT JOIN whole USING (doc_id, leaf)
  UNION ALL SELECT doc_id, leaf, k + 1, sha256(p[k].l || d || p[k].r), p FROM folded WHERE k <= coalesce(len(p), 0))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(s, '')) AS proof_sha256, folded.d AS folded_root, folded.d = root AS verified
FROM leaves JOIN tops t ON t.grp IS NOT DISTINCT FROM leaves.source LEFT JOIN whole USING (doc_id, leaf) JOIN folded USING (doc_id, leaf), (SELECT d AS root FROM high WHERE n = 1)
WHERE k = coalesce(len(folded.p), 0) + 1"""
