"""Checks of the reverse index, crawl frontier, registry, usage statistics and streams."""

from pyspark.sql import functions as F

from ..operators import index as ix, registry as rg, usage as us
from ..sources import registry as reg
from ..streaming import index as sx, usage as su
from .base import check, view
from .bindings import CFG
from .documents import cat, text

AS_OF = "2001-11-04 00:00:00"

# --- reverse index ---------------------------------------------------------
view("b_index", "SELECT DISTINCT login, repo FROM b_roster WHERE commits >= 15")


@check("reverse_index", "SELECT login, repo FROM b_index")
def reverse_index(t):
    return ix.build_index(t.roster, CFG.min_index_commits)


@check("index_merge", """
SELECT login, repo, CASE WHEN EXISTS (SELECT 1 FROM b_roster r JOIN b_repos p USING (repo)
         WHERE r.login = i.login AND r.repo = i.repo AND r.commits >= 15 AND p.partkey % 2 = 0) THEN 1 ELSE 2 END AS batch
FROM b_index i""")
def index_merge(t):
    even = t.part_names.where("partkey % 2 = 0").select("repo")
    old = ix.build_index(t.roster.join(even, "repo"), 15).withColumn("batch", F.lit(1).cast("bigint"))
    return ix.merge_index(old, ix.build_index(t.roster, 15), 2).withColumn("batch", F.col("batch").cast("int"))


@check("index_lookup", "SELECT DISTINCT a.person_id, i.repo FROM b_index i JOIN b_acc a USING (login)")
def index_lookup(t):
    return ix.lookup(ix.build_index(t.roster, 15), t.handles)


# --- crawl frontier --------------------------------------------------------
def runs(t):
    brand = F.lower(F.substring_index("repo", "/", 1))
    return t.part_repos.where("pushed_at IS NOT NULL").select(
        brand.alias("org"), "repo", F.col("pushed_at").alias("seeded_at"))


view("b_due", """
SELECT org, repo, stars, row_number() OVER (PARTITION BY org ORDER BY stars DESC NULLS LAST, repo) AS position
FROM (SELECT lower(owner) AS org, repo, stars, pushed_at FROM b_repos) o
WHERE NOT coalesce(pushed_at > TIMESTAMP '2001-11-04' - INTERVAL 30 DAYS, FALSE)""")


@check("crawl_frontier", "SELECT org, repo, stars, position FROM b_due WHERE position <= 50")
def crawl_frontier(t):
    return ix.crawl_frontier(t.part_names, runs(t), AS_OF, days=CFG.refresh_days, budget=50).select(
        "org", "repo", "stars", F.col("position").cast("bigint").alias("position"))


@check("coverage", """
SELECT org, count(DISTINCT repo) AS repos_distinct, count(DISTINCT login) AS contributors_distinct
FROM (SELECT lower(split_part(repo, '/', 1)) AS org, repo FROM b_repos WHERE pushed_at IS NOT NULL) r
LEFT JOIN b_index i USING (repo) GROUP BY org""")
def coverage(t):
    return ix.coverage(runs(t), t.roster, CFG.min_index_commits)


view("b_log", """
SELECT 'github' AS forge, 'org' AS kind, lower(p_brand) AS target, max(p_partkey) AS repos,
       max(p_size) AS contributors, min(l_shipdate) AS created, max(l_shipdate) AS updated
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")


def log_runs(t):
    ship = F.col("l_shipdate").cast("timestamp")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("GitHub").alias("forge"), F.lit("org").alias("kind"), F.col("p_brand").alias("target"),
        F.col("p_partkey").alias("repos"), F.col("p_size").cast("bigint").alias("contributors"),
        ship.alias("created"), ship.alias("updated"))


def _empty_log(t):
    from ..schemas import empty_table
    return empty_table(t.spark, sx.LOG_DDL)


def _day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@check("refresh_log", """
SELECT forge, kind, target, repos, CAST(contributors AS BIGINT) AS contributors,
       strftime(created, '%Y-%m-%d') AS created, strftime(updated, '%Y-%m-%d') AS updated FROM b_log""")
def refresh_log(t):
    return ix.fold_log(_empty_log(t), log_runs(t)).select(
        "forge", "kind", "target", "repos", "contributors", _day("created"), _day("updated"))


@check("next_targets", """
SELECT org, seeded, pos FROM (
  SELECT b.org, l.target IS NOT NULL AS seeded, b.pos, l.updated FROM (
    SELECT lower(p_brand) AS org, min(p_partkey) AS pos FROM part GROUP BY 1) b LEFT JOIN b_log l ON l.target = b.org)
ORDER BY seeded, updated NULLS FIRST, pos LIMIT 5""")
def next_targets(t):
    targets = t.part.groupBy(F.lower("p_brand").alias("org")).agg(F.min("p_partkey").alias("pos"))
    log = ix.fold_log(_empty_log(t), log_runs(t))
    return ix.next_targets(ix.targets_status(targets, log), 5).select("org", "seeded", "pos")


# --- registry --------------------------------------------------------------
def registry_docs(t, base: bool):
    """Registry projects read from JSON payloads, one per part."""
    k = F.col("p_partkey")
    name = cat('"brand', text(F.regexp_replace("p_brand", "[^0-9]", "")), "/part", text(k), '": {')
    if base:
        rows = t.part
        body = cat('"importance": "critical", "aliases": ["Old/part', text(k), '"], "wikipedia": "Part ', text(k),
                   '", "popularity": {"contributors": ', text(k + 5), ', "min_stars_override": true}, ',
                   '"role_sources": [{"url": "https://x/', text(k), '", "role": "maintainer"}]')
    else:
        rows = t.part.where("p_partkey % 3 <> 1")
        body = F.when(k % 2 == 0, cat('"importance": "", "popularity": {"stars": ', text(k), ', "forks": 3}')) \
                .otherwise(cat('"importance": "low", "aliases": [], "wikipedia": "Other"'))
    doc = rows.select(F.from_json(cat('{"projects": {', name, body, "}}}"),
                                  f"struct<projects:map<string,{reg.PROJECT}>>").alias("d")).select("d.projects")
    return reg.flatten(doc)


@check("registry_overlay", """
SELECT 'brand' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '/part' || p_partkey AS repo,
       CASE WHEN over AND odd THEN 'low' ELSE 'critical' END AS importance,
       CASE WHEN over AND odd THEN 'Other' ELSE 'Part ' || p_partkey END AS wikipedia,
       CASE WHEN over AND NOT odd THEN p_partkey END AS stars,
       CASE WHEN over AND NOT odd THEN NULL ELSE p_partkey + 5 END AS contributors,
       NOT (over AND NOT odd) AS min_stars_override, 'Old/part' || p_partkey AS alias
FROM (SELECT *, p_partkey % 3 <> 1 AS over, p_partkey % 2 = 1 AS odd FROM part)""")
def registry_overlay(t):
    merged = reg.overlay(registry_docs(t, True), registry_docs(t, False))
    return merged.select("repo", "importance", "wikipedia", "popularity.stars", "popularity.contributors",
                         F.coalesce("popularity.min_stars_override", F.lit(False)).alias("min_stars_override"),
                         F.element_at("aliases", 1).alias("alias"))


@check("registry_aliases", """
SELECT key, 'brand' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '/part' || p_partkey AS known_repo
FROM (SELECT *, unnest(['old/part' || p_partkey,
        'brand' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '/part' || p_partkey]) AS key FROM part)""")
def registry_aliases(t):
    tables = reg.tables(registry_docs(t, True))
    return rg.known_keys(tables["known"], tables["known_aliases"])


@check("popularity_upsert", """
SELECT r.repo, CASE WHEN r.partkey % 2 = 0 THEN r.stars END AS stars, CASE WHEN r.partkey % 3 <> 0 THEN r.forks END AS forks,
       CASE WHEN r.partkey % 4 <> 0 THEN r.partkey + 1 ELSE k.snapshot END AS contributors
FROM b_repos r LEFT JOIN b_known k USING (repo)
UNION ALL SELECT 'gone/' || partkey, NULL, NULL, partkey FROM b_repos""")
def popularity_upsert(t):
    k = F.col("partkey")
    seen = t.part_names.select(
        "repo", F.when(k % 2 == 0, F.col("stars")).alias("stars"), F.when(k % 3 != 0, F.col("forks")).alias("forks"),
        (k % 4 == 0).alias("capped"), (k + 1).alias("n_contributors"))
    # Curated projects that no record observed keep what was known of them.
    unseen = t.part_names.select(cat("gone/", text(k)).alias("repo"), k.alias("contributors"))
    aliases = t.known.select("repo", F.lower("repo").alias("alias"))
    return rg.upsert_popularity(t.known.unionByName(unseen, allowMissingColumns=True), aliases, seen).select("repo", "stars", "forks", "contributors")


@check("role_source_merge", """
SELECT repo, url, CASE WHEN n % 2 = 0 THEN 'maintainer' ELSE 'steering_council' END AS role FROM (
  SELECT r.repo, u.url, min(u.k) AS n FROM b_repos r, unnest([
    {'url': 'https://a/' || (partkey % 5), 'k': 0}, {'url': 'https://a/' || (partkey % 3), 'k': 1},
    {'url': 'https://b/' || partkey, 'k': 3}]) AS x(u) GROUP BY r.repo, u.url)""")
def role_source_merge(t):
    k = F.col("partkey")
    row = lambda pos, url, role: F.struct(F.lit(pos).alias("pos"), url.alias("url"), F.lit(role).alias("role"),
                                          F.lit("x").alias("label"))
    pick = lambda *rows: t.part_names.select("repo", F.explode(F.array(*rows)).alias("r")).select("repo", "r.*")
    have = pick(row(0, cat("https://a/", text(k % 5)), "maintainer"))
    found = pick(row(0, cat("https://a/", text(k % 3)), "steering_council"),
                 row(1, cat("https://b/", text(k)), "steering_council"), row(2, F.lit(""), "maintainer"))
    return rg.merge_role_sources(have, found).select("repo", "url", "role")


# --- usage -----------------------------------------------------------------
view("b_scans", """
SELECT ts, event_type AS forge, 'u' || user_id AS username, event_id,
       ['org' || (user_id % 25) || '/r' || (event_id % 40), 'u' || user_id || '/own'] AS repos FROM events""")


def scans(t, events=None):
    e = t.events if events is None else events
    u = F.col("user_id")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("forge"),
        cat("U", text(u)).alias("username"), F.array(
            cat("Org", text(u % 25), "/r", text(F.col("event_id") % 40)), cat("u", text(u), "/own")).alias("repos"))


@check("scans_per_day", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS scans FROM events GROUP BY 1")
def scans_per_day(t):
    return us.scans_per(scans(t), "day")


@check("scans_per_hour", "SELECT strftime(ts, '%Y-%m-%d-%H') AS bucket, count(*) AS scans FROM events GROUP BY 1")
def scans_per_hour(t):
    return us.scans_per(scans(t), "hour")


@check("distinct_users", """
SELECT (SELECT count(*) FROM b_scans) AS scans, (SELECT count(DISTINCT (forge, username)) FROM b_scans) AS people,
       (SELECT count(DISTINCT r) FROM (SELECT unnest(repos) AS r FROM b_scans)) AS repos,
       (SELECT count(DISTINCT split_part(r, '/', 1)) FROM (SELECT unnest(repos) AS r, username FROM b_scans)
        WHERE split_part(r, '/', 1) <> username) AS orgs""")
def distinct_users(t):
    return us.usage_totals(scans(t)).select("scans", "people", "repos", "orgs")


# An estimate counts as right within four percent, five standard errors.
_CLOSE = "SELECT TRUE AS people, TRUE AS repos, TRUE AS orgs FROM (SELECT count(*) AS n FROM events) WHERE n > 0"


def _close(t, estimates):
    names, none = ("people", "repos", "orgs"), F.lit(None).cast("bigint")
    exact = us.usage_totals(scans(t)).select(*[F.col(c).alias(f"{c}_exact") for c in names], *[none.alias(c) for c in names])
    both = exact.unionByName(estimates.select(*names, *[none.alias(f"{c}_exact") for c in names])).agg(
        *[F.coalesce(F.max(x), F.lit(0)).alias(x) for c in names for x in (c, f"{c}_exact")])
    return both.select(*[(F.abs(F.col(c) - F.col(f"{c}_exact")) <= 0.04 * F.col(f"{c}_exact")).alias(c) for c in names])


@check("approx_users", _CLOSE)
def approx_users(t):
    return _close(t, us.merge_sketches(us.usage_sketches(scans(t))))


@check("usage_span", """
SELECT count(*) AS scans, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events""")
def usage_span(t):
    return us.usage_totals(scans(t)).select("scans", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("oldest", "newest")])


@check("recent_scans", """
SELECT forge, username, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS created, count(*) AS scans FROM b_scans
GROUP BY forge, username ORDER BY max(ts) DESC, forge, username LIMIT 1000""")
def recent_scans(t):
    return us.recent_scans(scans(t), 1000).select(
        "forge", "username", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), "scans")


@check("latest_snapshot", """
SELECT key, result_id FROM (SELECT user_id AS key, event_id AS result_id, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
  WHERE event_type <> 'error' AND event_id % 3 <> 0) WHERE n = 1""")
def latest_snapshot(t):
    results = t.events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("result_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 3 == 0, 5).otherwise(6).alias("version"),
        (F.col("event_type") == "error").alias("partial"))
    return us.latest_snapshots(results, CFG.result_version).select("key", "result_id")


@check("retention", """
SELECT count(*) AS kept, count(*) FILTER (WHERE event_type = 'signup') AS protected FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS OR event_type = 'signup'""")
def retention(t):
    out = scratch(t)
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    su.write_days(rows.select("event_id", "ts", F.col("event_type").alias("namespace")), "ts", out)
    su.expire_days(t.spark, out, "2024-01-31 00:00:00", 10, "signup")
    kept = t.spark.read.schema("event_id BIGINT, ts TIMESTAMP, namespace STRING, day STRING").parquet(out)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("namespace") == "signup").alias("protected"))


# --- streams ---------------------------------------------------------------
def stream(t, name: str, schema=None):
    schema = schema or getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.dir)


def scratch(t) -> str:
    """A new folder under the checkpoint folder the session names."""
    from ..plans.lineage import new_path
    return new_path(t.spark, "stream")


def batches(t, *parts):
    """A stream for each of these tables, in their order, whose next batch is that table.

    A table is written by as many tasks as it is read by. All files that are new make one batch, so a
    query is started once a table, with one checkpoint.
    """
    out = scratch(t)
    for part in parts:
        part.write.mode("append").parquet(out)
        yield t.spark.readStream.schema(part.schema).parquet(out)


def dealt(df, key: str, n: int = 5):
    """The rows of a table in n parts by a key."""
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _windows(t, width: str, fmt: str):
    out = scratch(t)
    su.fold_counts(scans(t, stream(t, "events")), width, f"{out}/table", f"{out}/ckpt").awaitTermination()
    return su.read_counts(t.spark, f"{out}/table").select(F.date_format("start", fmt).alias("bucket"), "scans")


@check("daily_scans", "SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS scans FROM events GROUP BY 1")
def daily_scans(t):
    return _windows(t, "1 day", "yyyy-MM-dd")


@check("hourly_scans", "SELECT strftime(ts, '%Y-%m-%d-%H') AS bucket, count(*) AS scans FROM events GROUP BY 1")
def hourly_scans(t):
    return _windows(t, "1 hour", "yyyy-MM-dd-HH")


@check("index_stream", """
SELECT DISTINCT 's' || l_suppkey AS login, 'part' || l_partkey AS repo FROM lineitem WHERE l_quantity >= 15""")
def index_stream(t):
    out = scratch(t)
    for items in batches(t, *dealt(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")):
        rows = items.select(
            F.lit("github").alias("forge"), cat("part", text(F.col("l_partkey"))).alias("repo"),
            cat("S", text(F.col("l_suppkey"))).alias("login"), F.col("l_quantity").cast("bigint").alias("commits"))
        sx.fold_rosters(rows, f"{out}/table", f"{out}/ckpt", CFG.min_index_commits).awaitTermination()
    return sx.read_index(t.spark, f"{out}/table").select("login", "repo")


@check("refresh_log_stream", """
SELECT 'u' || user_id AS target, max(event_id) AS repos, strftime(min(ts), '%Y-%m-%d') AS created,
       strftime(max(ts), '%Y-%m-%d') AS updated FROM events GROUP BY user_id""")
def refresh_log_stream(t):
    out = scratch(t)
    ts = F.col("ts").cast("timestamp")
    for events in batches(t, *dealt(t.events.select("event_id", "user_id", "ts"), "event_id")):
        rows = events.select(
            F.lit("github").alias("forge"), F.lit("org").alias("kind"), cat("u", text(F.col("user_id"))).alias("target"),
            F.col("event_id").alias("repos"), F.lit(0).cast("bigint").alias("contributors"),
            ts.alias("created"), ts.alias("updated"))
        sx.fold_runs(rows, f"{out}/table", f"{out}/ckpt").awaitTermination()
    return sx.read_log(t.spark, f"{out}/table").select("target", "repos", _day("created"), _day("updated"))


@check("user_dedup_stream", """
SELECT event_type || ':u' || user_id AS user_key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1""")
def user_dedup_stream(t):
    out = scratch(t)
    su.fold_latest(scans(t, stream(t, "events")), f"{out}/table", f"{out}/ckpt").awaitTermination()
    return su.read_latest(t.spark, f"{out}/table").select(
        "user_key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@check("sketch_stream", _CLOSE)
def sketch_stream(t):
    out = scratch(t)
    su.fold_sketches(scans(t, stream(t, "events")), f"{out}/table", f"{out}/ckpt").awaitTermination()
    return _close(t, us.merge_sketches(su.sketch_table(t.spark, f"{out}/table").read()))


def _with_late(t):
    """Batches in the order of time, and then one of rows that the last day but one makes late.

    (A batch drops what was late by the batch before.)
    """
    rows = scans(t)
    day = lambda back: rows.agg((F.date_trunc("day", F.max("ts")) - F.expr(f"INTERVAL {back} DAYS")).alias("day")).scalar()
    old = rows.where(F.col("ts") < day(1))
    return batches(t, old.where(F.col("ts") < day(12)), old.where(F.col("ts") >= day(12)), rows.where(F.col("ts").between(day(1), day(0) - F.expr("INTERVAL 1 MICROSECOND"))),
                   rows.where(F.col("ts") >= day(0)), old.withColumn("username", F.lit("ghost")))


@check("window_state_stream", "SELECT strftime(ts, '%Y-%m-%d-%H') AS bucket, count(*) AS scans FROM events GROUP BY 1")
def window_state_stream(t):
    """Windows from a state that expires: rows of closed windows come too late to count."""
    out = scratch(t)
    for rows in _with_late(t):
        su.count_windows(rows, "1 hour", f"{out}/table", f"{out}/ckpt").awaitTermination()
    return su.window_table(t.spark, f"{out}/table").read().select(F.date_format("start", "yyyy-MM-dd-HH").alias("bucket"), "scans")


@check("user_state_stream", """
SELECT event_type || ':u' || user_id AS user_key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1""")
def user_state_stream(t):
    """The newest scan of each user from a state that expires; users of late rows only are unknown."""
    out = scratch(t)
    for rows in _with_late(t):
        su.track_users(rows, "1 day", f"{out}/table", f"{out}/ckpt").awaitTermination()
    return su.user_table(t.spark, f"{out}/table").read().select(
        "user_key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("latest"))
