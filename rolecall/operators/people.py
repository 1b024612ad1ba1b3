"""Identity keys: every handle, name and e-mail of a person as one row each."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fold, handle_key


def person_keys(people: DataFrame, accounts: DataFrame) -> DataFrame:
    """(person_id, kind, key).  The primary login is always among the handles."""
    rows = [
        people.select("person_id", F.lit("handle").alias("kind"),
                      handle_key(F.col("primary_login")).alias("key")),
        accounts.select("person_id", F.explode(F.array(
            F.struct(F.lit("handle").alias("kind"), handle_key(F.col("login")).alias("key")),
            F.struct(F.lit("name").alias("kind"), fold(F.col("name")).alias("key")),
            F.struct(F.lit("email").alias("kind"), fold(F.col("email")).alias("key")),
        )).alias("k")).select("person_id", "k.kind", "k.key"),
    ]
    return reduce(DataFrame.unionByName, rows).where("key IS NOT NULL").distinct()


def handles(keys: DataFrame) -> DataFrame:
    return keys.where("kind = 'handle'").select("person_id", F.col("key").alias("login"))


def names(keys: DataFrame) -> DataFrame:
    return keys.where("kind = 'name'").select("person_id", F.col("key").alias("name"))


def merge_identities(confirmed: DataFrame, additions: DataFrame) -> DataFrame:
    """Accounts confirmed by links plus explicitly added ones, once each."""
    cols = ["person_id", "forge", "login"]
    both = confirmed.select(cols).unionByName(additions.select(cols).where("login <> ''"))
    return both.select("person_id", "forge", F.lower("login").alias("login")).distinct()


def org_logins(person_orgs: DataFrame) -> DataFrame:
    """Organisations of a person, folded, blanks dropped."""
    return (person_orgs.select("person_id", fold(F.col("org")).alias("org"))
            .where("org IS NOT NULL").distinct())
