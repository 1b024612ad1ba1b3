"""URL expressions: repository links, profile links, package-name guesses."""

from pyspark.sql import Column, functions as F

from .. import fixed
from .roles import choose
from .text import all_matches, blank_to_null, first_match, let, strip


def web_host(forge: Column, host: Column | None = None) -> Column:
    known = choose(forge, fixed.WEB_HOST, fixed.WEB_HOST[fixed.DEFAULT_FORGE])
    return known if host is None else F.coalesce(blank_to_null(host), known)


def repo_url(forge: Column, repo: Column, host: Column | None = None) -> Column:
    return F.concat(web_host(forge, host), F.lit("/"), repo)


def file_url(project_url: Column, path: Column) -> Column:
    return F.concat(project_url, F.lit("/blob/HEAD/"), path)


def repo_owner(repo: Column) -> Column:
    return F.substring_index(repo, "/", 1)


def github_repo(url: Column) -> Column:
    """owner/repo named by a source URL (https, ssh or git+), or null."""
    name = F.btrim(F.regexp_replace(first_match(url, fixed.GITHUB_REPO), r"(?i)\.git$", ""), F.lit("/"))
    return let(name, lambda n: F.when(
        n.contains("/") & ~F.lower(repo_owner(n)).isin(fixed.NON_REPO_OWNERS), n))


def readme_repo_links(text: Column) -> Column:
    """Repositories a profile README links to."""
    found = F.transform(all_matches(text, fixed.README_REPO_LINK),
                        lambda r: F.rtrim(r, F.lit("./")))
    return F.array_distinct(F.filter(found, lambda r: (
        (F.size(F.split(r, "/")) == 2)
        & ~F.lower(F.substring_index(r, "/", 1)).isin(fixed.NON_REPO_OWNERS))))


def extract_urls(text: Column) -> Column:
    return F.coalesce(all_matches(text, fixed.ANY_URL, 0), F.array().cast("array<string>"))


def profile_of(url: Column) -> Column:
    """(forge, login) of a profile URL on a known host, or null."""
    hosts = {h.split("://", 1)[1]: f for f, h in fixed.WEB_HOST.items()}
    part = lambda u, group: F.regexp_extract(u, "^" + fixed.PROFILE_URL, group)
    host = lambda u: F.regexp_replace(F.lower(part(u, 1)), r"^www\.", "")
    forge = lambda u: let(host(u), lambda h: choose(h, hosts, F.lit(None).cast("string")))
    profile = lambda u: F.struct(forge(u).alias("forge"), part(u, 2).alias("login"))
    is_user = lambda p: (p["forge"].isNotNull() & (p["login"] != "") & ~p["login"].contains(".")
                         & ~F.lower(p["login"]).isin(fixed.NON_PROFILE))
    return let(let(strip(url), profile), lambda p: F.when(is_user(p), p))


def package_name_guesses(repo: Column) -> Column:
    """Distribution names a repository may be published under, in probe order."""
    name = blank_to_null(F.substring(repo, F.instr(repo, "/") + 1, F.length(repo)))
    low = F.lower(name)
    return F.array_compact(F.array_distinct(F.array(
        name, low, F.replace(low, F.lit("_"), F.lit("-")),
        F.replace(low, F.lit("-"), F.lit("_")))))
