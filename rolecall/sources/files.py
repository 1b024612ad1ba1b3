"""Repository files and profile links."""

from pyspark.sql import DataFrame, functions as F

from ..functions import urls


def read_text_files(spark, path: str, root: str) -> DataFrame:
    """(forge, repo, path, text) of a tree root/<forge>/<owner>/<name>/<path…>."""
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.input_file_name(), base, -1)
    pieces = F.split(rel, "/")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        pieces[0].alias("forge"), F.concat_ws("/", pieces[1], pieces[2]).alias("repo"),
        F.array_join(F.slice(pieces, F.lit(4), F.size(pieces)), "/").alias("path"),
        F.col("value").alias("text"))


def decode_base64_files(raw: DataFrame) -> DataFrame:
    """Files delivered as (encoding, content); anything but base64 has no text."""
    data = F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))
    text = F.when(F.col("encoding") == "base64", F.decode(data, "UTF-8"))
    return raw.select("forge", "repo", "path", text.alias("text"))


def profile_urls(accounts: DataFrame, readmes: DataFrame) -> DataFrame:
    """(forge, login, url): website, links in the bio and links in the profile README."""
    site = accounts.where("website <> ''").select("forge", "login", F.col("website").alias("url"))
    bio = accounts.select("forge", "login", F.explode(urls.extract_urls(F.col("bio"))).alias("url"))
    own = readmes.where("path = 'README.md'").withColumn("login", urls.repo_owner(F.col("repo")))
    own = own.where(F.col("repo") == F.concat("login", F.lit("/"), "login")).select(
        "forge", "login", F.explode(urls.extract_urls(F.col("text"))).alias("url"))
    return site.unionByName(bio).unionByName(own)
