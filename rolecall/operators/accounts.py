"""One person's accounts across hosts, and full names to logins."""

from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as tx, urls
from .containment import only_wanted

ACCOUNT = ["forge", "login"]


def profile_edges(links: DataFrame) -> DataFrame:
    """(forge, login, to_forge, to_login): profile links to other profiles."""
    return (links.select("forge", F.lower("login").alias("login"),
                         urls.profile_of(F.col("url")).alias("p")).where("p IS NOT NULL")
            .select("forge", "login", F.col("p.forge").alias("to_forge"),
                    F.lower("p.login").alias("to_login")).distinct())


def mutual_links(edges: DataFrame) -> DataFrame:
    """Links that are returned."""
    back = edges.select(F.col("to_forge").alias("forge"), F.col("to_login").alias("login"),
                        F.col("forge").alias("to_forge"), F.col("login").alias("to_login"))
    return edges.join(back, edges.columns, "left_semi")


def hub_accounts(pages: DataFrame, max_accounts: int | None = None) -> DataFrame:
    """(url, accounts): pages that list profiles; with `max_accounts`, those that list no more.

    A page vouches for nobody by its size: `closure_round` asks that it lists a
    confirmed account and that login or name agree.
    """
    found = F.array_distinct(F.transform(
        F.filter(F.transform(urls.extract_urls(F.col("html")), urls.profile_of),
                 lambda p: p.isNotNull()),
        lambda p: F.struct(p["forge"].alias("forge"), p["login"].alias("login"))))
    listed = pages.select("url", found.alias("accounts")).where(F.size("accounts") > 0)
    return listed if max_accounts is None else listed.where(F.size("accounts") <= max_accounts)


def hub_links(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """(forge, login, url): profile links that lead to a personal site."""
    site = links.select("forge", F.lower("login").alias("login"), tx.strip(F.col("url")).alias("url"))
    return (site.where(tx.matches(F.lower("url"), "^https?://")
                       & urls.profile_of(F.col("url")).isNull())
            .distinct().join(hubs.select("url"), "url", "left_semi"))


def closure_round(confirmed: DataFrame, edges: DataFrame, sites: DataFrame, listed: DataFrame,
                  accounts: DataFrame, max_accounts: int | None = None) -> DataFrame:
    """Accounts one more round confirms, with `max_accounts` for persons still below it.

    Direct: a confirmed account links to it and it links to a confirmed account.
    Hub: a site linked from a confirmed account lists a confirmed account and this
    one, which shares a login or a display name with the person.
    """
    mine = ["person_id", *ACCOUNT]
    active = confirmed.select(mine)
    if max_accounts is not None:
        open_ = confirmed.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") < max_accounts).select("person_id")
        active = confirmed.join(open_, "person_id", "left_semi").select(mine)
    out = active.join(edges, ACCOUNT).select(
        "person_id", F.col("to_forge").alias("forge"), F.col("to_login").alias("login")).distinct()
    into = active.select("person_id", F.col("forge").alias("to_forge"),
                         F.col("login").alias("to_login")).join(edges, ["to_forge", "to_login"])
    direct = out.join(into.select(mine).distinct(), mine, "left_semi")

    linked = active.join(sites, ACCOUNT).select("person_id", "url").distinct()
    vouching = linked.join(listed.join(active, ACCOUNT).select("person_id", "url"), ["person_id", "url"], "left_semi")
    names = _profile_names(accounts)
    agreed = _agreed(_asked(vouching, _own_keys(active, names)), _site_keys(listed, names))
    new = direct.unionByName(agreed).distinct()
    return new.join(confirmed.select(mine), mine, "left_anti")


def _profile_names(accounts: DataFrame) -> DataFrame:
    return accounts.select("forge", F.lower("login").alias("login"),
                           tx.fold(F.col("name")).alias("name")).where("name IS NOT NULL").distinct()


def _own_keys(accounts: DataFrame, names: DataFrame) -> DataFrame:
    """(person_id, kind, key, of_forge, of_login): logins and names of a person, each with one account that has it."""
    key = lambda kind, c: [F.lit(kind).alias("kind"), F.col(c).alias("key"), F.struct(*ACCOUNT).alias("of")]
    return (accounts.select("person_id", *key("login", "login"))
            .unionByName(accounts.join(names, ACCOUNT).select("person_id", *key("name", "name")))
            .groupBy("person_id", "kind", "key").agg(F.min("of").alias("of"))
            .select("person_id", "kind", "key", F.col("of.forge").alias("of_forge"), F.col("of.login").alias("of_login")))


def _site_keys(listed: DataFrame, names: DataFrame) -> DataFrame:
    """(url, kind, key, forge, login): the accounts a site lists by login and by name."""
    key = lambda kind, c: [F.lit(kind).alias("kind"), F.col(c).alias("key")]
    return (listed.select("url", *key("login", "login"), *ACCOUNT)
            .unionByName(listed.join(names, ACCOUNT).select("url", *key("name", "name"), *ACCOUNT)))


def _asked(vouching: DataFrame, own: DataFrame) -> DataFrame:
    """(person_id, url, kind, key, of_forge, of_login): what a person asks the sites that vouch."""
    return vouching.join(own, "person_id").select("person_id", "url", "kind", "key", "of_forge", "of_login")


def _agreed(asked: DataFrame, on_site: DataFrame) -> DataFrame:
    """(person_id, forge, login): accounts on vouching sites that share a login or a name with the person.

    A site is asked for the person's logins and names by key: its other accounts make no rows.
    """
    return (asked.join(on_site, ["url", "kind", "key"]).where("forge <> of_forge OR login <> of_login")
            .select("person_id", *ACCOUNT))


def _meetings(new: DataFrame, old: DataFrame, on: list[str]) -> DataFrame:
    """What side 0 and side 1 both have, one of the two being new.

    Inner joins, so that a round that gained little broadcasts the little.
    """
    side = lambda df, n: df.where(F.col("side") == n).select(on)
    return (side(new, 0).join(side(new, 1), on).unionByName(side(new, 0).join(side(old, 1), on))
            .unionByName(side(old, 0).join(side(new, 1), on)).distinct())


def resolve_accounts(anchors: DataFrame, links: DataFrame, pages: DataFrame, accounts: DataFrame,
                     *, max_accounts: int | None = None, max_hub_accounts: int | None = None) -> DataFrame:
    """(person_id, forge, login, round): all confirmed accounts of each anchor.

    A round confirms everything the accounts known so far vouch for, whatever the
    order of links, until a round confirms nothing; with `max_accounts`, a person
    who has that many stops growing.  The rows are those of `closure_round` repeated, but
    a round joins only what the round before confirmed: its accounts contribute links, sites
    and keys, what is new meets all there is, and each round appends its own as one part.
    A lost executor costs one round at most; all but the result is deleted at the end.
    """
    from ..plans.lineage import Growing, cut, kept, scratch
    spark = anchors.sparkSession
    with scratch(spark):
        hubs = hub_accounts(pages, max_hub_accounts)
        edges, sites = cut(profile_edges(links)), cut(hub_links(links, hubs))
        listed = cut(hubs.join(sites.select("url").distinct(), "url", "left_semi").select(
            "url", F.explode("accounts").alias("a")).select(
            "url", "a.forge", F.lower("a.login").alias("login")).distinct())
        names = cut(_profile_names(accounts))
        on_site = cut(_site_keys(listed, names))
        back = edges.select(F.col("to_forge").alias("forge"), F.col("to_login").alias("login"),
                            F.col("forge").alias("to_forge"), F.col("login").alias("to_login"))
        either = lambda first, second: first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
        confirmed = Growing(spark, "person_id BIGINT, forge STRING, login STRING, round INT")
        linked = Growing(spark, "side INT, person_id BIGINT, to_forge STRING, to_login STRING")
        at_site = Growing(spark, "side INT, person_id BIGINT, url STRING")
        vouching = Growing(spark, "person_id BIGINT, url STRING")
        own = Growing(spark, "person_id BIGINT, kind STRING, key STRING, of_forge STRING, of_login STRING")
        new = confirmed.append(anchors.select("person_id", "forge", F.lower("login").alias("login"),
                                              F.lit(0).alias("round")).distinct())
        for r in count(1):
            mine = new.select("person_id", *ACCOUNT)
            had_links, had_sites, had_vouching, had_keys = linked.all(), at_site.all(), vouching.all(), own.all()
            links_now = linked.append(mine.join(either(edges, back), ACCOUNT).select(linked.schema.names).distinct())
            sites_now = at_site.append(mine.join(either(sites, listed), ACCOUNT).select(at_site.schema.names).distinct())
            keys_now = own.append(_own_keys(mine, names).join(had_keys, ["person_id", "kind", "key"], "left_anti"))
            # A site that is found once more is asked once more, which changes nothing.
            vouching_now = vouching.append(_meetings(sites_now, had_sites, ["person_id", "url"]))
            asked = cut(_asked(vouching_now, own.all()).unionByName(_asked(had_vouching, keys_now)))
            direct = _meetings(links_now, had_links, ["person_id", "to_forge", "to_login"]).select(
                "person_id", F.col("to_forge").alias("forge"), F.col("to_login").alias("login"))
            met = direct.unionByName(_agreed(asked, on_site)).distinct()
            known = confirmed.all()
            if max_accounts is not None:
                met = met.join(known.groupBy("person_id").count().where(F.col("count") < max_accounts), "person_id", "left_semi")
            new = confirmed.append(met.join(known, ["person_id", *ACCOUNT], "left_anti").withColumn("round", F.lit(r)))
            if new.isEmpty():
                break
        return kept(confirmed.all())


# --- full names ------------------------------------------------------------
def _pair_key(a, b):
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def search_accounts(queries: DataFrame, accounts: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, login, name, bio, position): accounts whose name has every query word, the
    first `limit` of each query if one is given.

    Each query is looked up by its two rarest words together, so names of two common words
    meet only the accounts that have both, and the other words are checked on the hits.
    Pairs of an account's words leave their stage only if some query wants them.
    """
    q = queries.where(tx.looks_like_name(F.col("query"))).select(
        "query", tx.name_tokens(F.col("query")).alias("toks")).where(F.size("toks") > 0).distinct()
    a = accounts.where("login <> '' AND name IS NOT NULL").select(
        "login", "name", "bio", tx.name_tokens(F.col("name")).alias("name_toks"))
    freq = a.select(F.explode("name_toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rarest = (q.select("query", "toks", F.explode("toks").alias("tok")).join(freq, "tok", "left")
              .groupBy("query", "toks").agg(F.array_sort(F.collect_list(F.struct(
                  F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("by")))
    first, second = F.element_at("by", 1), F.try_element_at("by", F.lit(2))
    # A word that no account has finds nothing.
    wanted = rarest.where(first["df"] > 0).select(
        "query", "toks", _pair_key(first["tok"], F.coalesce(second["tok"], first["tok"])).alias("key"))
    pairs = F.flatten(F.transform("name_toks", lambda x, i: F.transform(
        F.slice("name_toks", i + 1, F.size("name_toks")), lambda y: _pair_key(x, y))))
    words = only_wanted(a.select("login", "name", "bio", "name_toks", F.explode(pairs).alias("key")), wanted)
    hits = (wanted.join(words, "key").where(F.size(F.array_except("toks", "name_toks")) == 0)
            .select("query", "login", "name", "bio").distinct())
    w = W.partitionBy("query").orderBy("login", "name")
    placed = hits.withColumn("position", F.row_number().over(w))
    return placed if limit is None else placed.where(F.col("position") <= limit)


def resolve_names(queries: DataFrame, accounts: DataFrame, name_claims: DataFrame,
                  limit: int | None = None) -> DataFrame:
    """(query, login, n_candidates): a login only when it is safe without asking.

    That is the case for a single search hit, or, without any hit, for claims that
    name exactly one login.  `name_claims` has (name, login).
    """
    found = search_accounts(queries, accounts, limit).groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.min("login").alias("one"))
    claimed = (queries.withColumn("key", F.lower("query"))
               .join(name_claims.select(F.lower("name").alias("key"), "login"), "key")
               .groupBy("query").agg(F.countDistinct("login").alias("n_claims"),
                                     F.min("login").alias("claimed")))
    both = (queries.select("query").distinct().join(found, "query", "left")
            .join(claimed, "query", "left"))
    n = F.coalesce("n", F.lit(0))
    return both.select(
        "query",
        F.when(n == 1, F.col("one")).when((n == 0) & (F.col("n_claims") == 1), F.col("claimed"))
         .alias("login"),
        F.when(n > 0, n).otherwise(F.coalesce("n_claims", F.lit(0))).cast("bigint")
         .alias("n_candidates"))
