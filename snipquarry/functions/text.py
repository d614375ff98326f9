"""Text: lines, white-space tokens, prompts and wrappers."""

from pyspark.sql import Column, functions as F

from snipquarry import settings

# The white space at which Python's str.split() and str.strip() cut.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same as patterns; Java runs these faster than the list.
SPACES = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"(?U)[^\s\x1c-\x1f]+"


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Lines of a text; an empty text has one empty line."""
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column, limit=None) -> Column:
    """White-space tokens, all of them or the first `limit`."""
    pieces = F.split(strip(text), SPACES, -1 if limit is None else limit + 1)
    first = pieces if limit is None else F.slice(pieces, 1, limit)
    return F.filter(first, lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def truncate_tokens(text: Column, limit=settings.MAX_TOKENS) -> Column:
    """At most `limit` white-space tokens, joined by single spaces."""
    return F.array_join(tokens(text, limit), " ")


def instruct(text: Column, instruction: Column) -> Column:
    """Put an instruction in front of a text; a NULL or empty instruction changes nothing."""
    wrapped = F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), text)
    return F.when(F.coalesce(instruction, F.lit("")) != "", wrapped).otherwise(text)


# Fixed value: the wording of the fix prompt.
FIX_PROMPT = (
    "You are a code review expert. Fix the following {issue_type} issue:\n\n"
    "Issue: {issue_description}\n\n"
    "Code:\n```\n{content}\n```\n\n"
    "Provide ONLY the fixed code without explanations."
)


def fill(template: str, **values: Column) -> Column:
    """Fill `{name}` slots of a template with columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def fix_prompt(content: Column, issue_type: Column, issue_description: Column) -> Column:
    return fill(FIX_PROMPT, content=content, issue_type=issue_type, issue_description=issue_description)


def valid_issue_type(issue_type: Column) -> Column:
    return F.coalesce(F.lower(issue_type).isin(settings.ISSUE_TYPES), F.lit(False))
