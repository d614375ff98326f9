"""File paths and repository addresses."""

import re

from pyspark.sql import Column, functions as F

from snipquarry import settings


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix of the last path part; empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def language(path: Column, languages=None) -> Column:
    """Language by suffix, NULL where the suffix is not supported."""
    pairs = [F.lit(x) for item in (languages or settings.LANGUAGES).items() for x in item]
    return F.element_at(F.create_map(*pairs), suffix(path))


def ignored_name(name: Column) -> Column:
    return name.isin(settings.IGNORED_FILES) | name.startswith(".")


def below_ignored_dir(path: Column) -> Column:
    """True where any directory on the way to the file is ignored."""
    plain = "|".join(re.escape(d) for d in settings.IGNORED_DIRS if not d.startswith("."))
    return path.rlike(rf"(?:^|/)(?:\.[^/]*|{plain})/")


def relative_path(path: Column, root: Column) -> Column:
    """`path` below `root`; a path elsewhere is returned as it is."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.substring(path, F.length(prefix) + 1, F.length(path))
    return F.when(F.startswith(path, prefix), below).otherwise(path)


def repo_name(url: Column) -> Column:
    """Last part of the address, without any `.git` in it."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".git"), F.lit(""))


def valid_repo_url(url: Column) -> Column:
    return F.coalesce(F.endswith(url, F.lit(".git")) | F.startswith(url, F.lit("https://")), F.lit(False))
