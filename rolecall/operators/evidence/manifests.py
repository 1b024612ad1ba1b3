"""Evidence from package manifests: author and maintainer fields."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ... import fixed
from ...functions import people as ppl, urls
from ...functions.text import first_match, strip, unix_lines
from .base import REPO, Context, emit, register


def _toml_people(ids):
    """People fields of TOML manifests, batch by batch (Spark has no TOML reader)."""
    def run(batches):
        return _toml_batches(batches, ids)
    return run


def _toml_batches(batches, ids):
    import tomllib

    import pandas as pd

    def fields(path, data):
        if path == "Cargo.toml":
            yield "author", (data.get("package") or {}).get("authors")
            return
        for table in (data.get("project"), (data.get("tool") or {}).get("poetry")):
            for role in ("author", "maintainer"):
                yield role, (table or {}).get(role + "s")

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            try:
                found = [(role, e) for role, entries in fields(row.path, tomllib.loads(row.text))
                         for e in entries or []]
            except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                continue
            for role, e in found:
                key = (*[getattr(row, c) for c in ids], row.path, role)
                if isinstance(e, str):
                    out.append((*key, e, None, None))
                elif isinstance(e, dict):
                    out.append((*key, None, e.get("name"), e.get("email")))
        yield pd.DataFrame(out, columns=[*ids, "path", "role", "raw", "name", "email"])


def _from_json_entry(entry: Column) -> Column:
    """A person given as a JSON object or as one string."""
    obj = F.from_json(entry, "name string, email string")
    return F.when(entry.startswith("{"), ppl.person(
        F.nullif(strip(obj["name"]), F.lit("")), F.nullif(strip(obj["email"]), F.lit("")))) \
        .otherwise(ppl.from_person_string(entry))


def _json_list(text: Column, field: str) -> Column:
    entries = F.from_json(F.get_json_object(text, f"$.{field}"), "array<string>")
    return F.transform(entries, _from_json_entry)


def setup_value(text: Column, key: str) -> Column:
    """Literal keyword argument or assignment in a setup script."""
    return strip(first_match(text, rf"""(?<![\w.]){key}\s*=\s*(['"])(.*?)\1""", 2))


def config_value(text: Column, key: str) -> Column:
    """Value in the metadata section of a setup.cfg, continuation lines included."""
    section = F.regexp_extract(unix_lines(text), r"(?ms)^\[metadata\][^\n]*\n(.*?)(?=^\[|\z)", 1)
    return strip(first_match(section, rf"(?im)^{key}[ \t]*[=:]([^\n]*(?:\n[ \t]+\S[^\n]*)*)"))


def manifest_people(files: DataFrame, ids: list[str] = REPO) -> DataFrame:
    """(ids, path, role, p): people of the author and maintainer fields."""
    f = files.where(F.col("path").isin(fixed.MANIFEST_PATHS)).select(*ids, "path", "text")
    text = F.col("text")

    def listed(path, role, people_):
        return f.where(F.col("path") == path).select(
            *ids, "path", F.lit(role).alias("role"), F.explode(people_).alias("p"))

    zipped = lambda get, who: ppl.zip_names_emails(get(text, who), get(text, who + "_email"))
    dunder = ppl.zip_names_emails(
        F.coalesce(setup_value(text, "author"), setup_value(text, "__author__")),
        F.coalesce(setup_value(text, "author_email"), setup_value(text, "__author_email__")))
    author = F.get_json_object(text, "$.author")
    branches = [
        listed("setup.cfg", "author", zipped(config_value, "author")),
        listed("setup.cfg", "maintainer", zipped(config_value, "maintainer")),
        listed("setup.py", "author", dunder),
        listed("setup.py", "maintainer", zipped(setup_value, "maintainer")),
        listed("package.json", "author",
               F.when(author.isNotNull(), F.array(_from_json_entry(author)))),
        listed("package.json", "maintainer", _json_list(text, "maintainers")),
        listed("composer.json", "author", _json_list(text, "authors")),
    ]
    own = ", ".join(f"{n} {t}" for n, t in f.select(*ids).dtypes)
    toml = f.where(F.col("path").isin("pyproject.toml", "Cargo.toml")).mapInPandas(
        _toml_people(ids), f"{own}, path string, role string, raw string, name string, email string")
    given = ppl.person(F.nullif(strip(F.col("name")), F.lit("")),
                       F.nullif(strip(F.col("email")), F.lit("")))
    branches.append(toml.select(*ids, "path", "role", F.when(
        F.col("raw").isNotNull(), ppl.from_person_string(F.col("raw"))).otherwise(given).alias("p")))
    return reduce(DataFrame.unionByName, branches).where(ppl.is_named(F.col("p")))


def manifest_matches(listed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per (person, project, path, role); an e-mail match beats a name match."""
    return (listed.where("kind <> 'handle'").select(*REPO, "path", "role", "kind", "key").distinct()
            .join(keys, [*REPO, "kind", "key"])
            .groupBy("person_id", *REPO, "project_url", "path", "role", "commits")
            .agg(F.min("kind").alias("how")))


@register("manifests")
def manifests(ctx: Context):
    """A manifest field can be copied; with commits behind it, it is strong."""
    found = manifest_matches(ctx.postings.manifests(), ctx.keys)
    commits = F.col("commits").isNotNull()
    seq = (F.array_position(F.lit(fixed.MANIFEST_PATHS), F.col("path")) * 2
           + F.when(F.col("role") == "author", 0).otherwise(1))
    return emit(found, "manifests", role=F.col("role"), seq=seq,
                url=urls.file_url(F.col("project_url"), F.col("path")),
                confidence=F.when(commits, F.lit(0.8)).when(F.col("how") == "email", 0.75)
                            .otherwise(0.45),
                detail=F.concat("role", F.lit(" "), "how", F.lit(" in "), "path",
                                F.when(commits, ", corroborated by commits").otherwise("")))
