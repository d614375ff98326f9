"""Ids, cache keys and key patterns."""

import re

from pyspark.sql import Column, functions as F


def stable_id(*parts: Column) -> Column:
    """Id from a natural key: the same row gets the same id in every run.

    A NULL part differs from an empty one, and parts cannot run into each other.
    """
    marked = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("\u0001", *marked))


def search_key(query: Column, repo_id: Column, k: Column | None = None) -> Column:
    """Cache key of a search.  `k` is not part of the key unless it is given."""
    scope = F.when(F.coalesce(repo_id, F.lit("")) != "", repo_id).otherwise("all")
    parts = [F.lit("retrieve"), scope, query] + ([k.cast("string")] if k is not None else [])
    return F.concat_ws(":", *parts)


def suggestion_key(snippet_id: Column, issue_type: Column) -> Column:
    """Cache key of a suggestion.  The issue type keeps its case; the description is not part of it."""
    return F.concat_ws(":", F.lit("suggestion"), snippet_id.cast("string"), issue_type)


def glob_to_regex(pattern: str) -> str:
    """Anchored regex for a key pattern: `*`, `?`, `[abc]`, `[^abc]`, `[!abc]`, `\\x`."""
    token = re.compile(r"\\(?P<quoted>.)|\[(?P<not>[\^!])?(?P<set>[^\]]+)\]|(?P<plain>.)", re.S)
    out = []
    for m in token.finditer(pattern):
        if m["set"]:
            members = re.sub(r"([\\\[\]^&~])", r"\\\1", m["set"])
            out.append(f"[{'^' if m['not'] else ''}{members}]")
        elif m["plain"] in ("*", "?"):
            out.append("(?s:.*)" if m["plain"] == "*" else "(?s:.)")
        else:
            out.append(re.sub(r"([^\w\s:])", r"\\\1", m["quoted"] or m["plain"]))
    return "^" + "".join(out) + r"\z"


def matches(key: Column, pattern: str) -> Column:
    return key.rlike(glob_to_regex(pattern))
