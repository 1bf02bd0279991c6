"""Names taken apart: indexer symbols, repository addresses, cache keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from symbolweave.functions.text import suffix

# What an indexed document's extension says about its language.
INDEXED_LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "typescript",
    ".go": "go",
}

# What ends a line, to a pattern.
LINE_ENDS = ["\n", "\r", "\u0085", "\u2028", "\u2029"]

# Accepted repository addresses; groups are owner, name, branch, subpath.
REPOSITORY_PATTERNS = [
    r"^https?://(?:www\.)?github\.com/([^/]+)/([^/.]+?)(?:\.git)?(?:/tree/([^/]+)(?:/(.*))?)?$",
    r"^git@github\.com:([^/]+)/([^/.]+?)(?:\.git)?(?:/(?:tree|blob)/([^/]+)(?:/(.*))?)?$",
    r"^https?://(?:www\.)?gitlab\.com/([^/]+)/([^/.]+?)(?:\.git)?(?:/-/tree/([^/]+)(?:/(.*))?)?$",
    r"^https?://(?:www\.)?bitbucket\.org/([^/]+)/([^/.]+?)(?:\.git)?(?:/src/([^/]+)(?:/(.*))?)?$",
]
DEFAULT_BRANCH = "main"
# Fixed value: how the name of a downloaded archive ends in its commit.
NAMED_COMMIT = r"""filename=["']?[^"']+-[^"']+-([a-f0-9]{7,40})"""
ARCHIVE_ADDRESS = "https://api.github.com/repos/%s/%s/zipball/%s"


def lookup(keys: Column, table: dict[str, str], missing: str | None = None) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), keys)
    return found if missing is None else F.coalesce(found, F.lit(missing))


def _last_part(path: Column) -> Column:
    return F.trim(F.substring_index(path, "/", -1), F.lit("`"))


def indexed_symbol(symbol: Column | str) -> Column:
    """A struct (name, kind) for an indexer's symbol text; null for what is skipped.

    Conditions repeat what they test, so patterns, which cost most here, are left to the rare text of several lines, where
    an end is also one before a last line break.
    """
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    owner = _last_part(F.substring_index(s, "#", 1))
    lines = reduce(lambda a, b: a | b, [s.contains(end) for end in LINE_ENDS])
    member = F.replace(F.substr(s, F.length(F.substring_index(s, "#", 1)) + 2), F.lit("()."), F.lit("."))

    def cut_off(text: Column, letter: str) -> Column:
        return F.when(lines, F.regexp_replace(text, rf"\{letter}+$", "")).otherwise(F.rtrim(text, F.lit(letter)))

    member = cut_off(member, ")")
    dotted = F.concat(owner, F.lit("."), cut_off(member, "."))
    called = F.substr(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, "().", -1)) - 3)  # up to the last "()."

    def named(name: Column, kind: str) -> Column:
        return F.when(name != "", F.struct(name.alias("name"), F.lit(kind).alias("kind")))

    skipped = (s == "") | s.startswith("local") | s.contains(".(")
    return (
        F.when(skipped, F.lit(None))
        .when(s.contains("#") & ~member.isin("", "."), F.struct(dotted.alias("name"), F.lit("method").alias("kind")))
        .when(s.contains("#"), named(owner, "class"))
        .when(s.endswith("()."), named(_last_part(called), "function"))
        .when(s.contains("()."), named(_last_part(called), "method"))
        .when(s.contains("("), named(_last_part(F.substring_index(s, "(", 1)), "function"))
        .otherwise(named(F.substring_index(F.trim(s, F.lit("`")), "/", -1), "symbol"))
    )


def indexed_language(path: Column | str) -> Column:
    return lookup(F.lower(suffix(path)), INDEXED_LANGUAGES, "")


def reference_kind(target_kind: Column | str) -> Column:
    """The kind of edge a reference to a node of that kind makes."""
    kind = F.col(target_kind) if isinstance(target_kind, str) else target_kind
    return (
        F.when(kind.isin("function", "method"), "calls")
        .when(kind == "symbol", "imports")
        .otherwise("references")
    )


def repository(url: Column | str) -> Column:
    """A struct (platform, owner, name, branch, subpath); null for other text.

    The platform follows from the words in the whole address.
    """
    text = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    platform = F.when(text.contains("gitlab"), "gitlab").when(text.contains("bitbucket"), "bitbucket")

    def taken(pattern: str) -> Column:
        group = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, 5)]
        return F.when(
            text.rlike(pattern),
            F.struct(
                platform.otherwise("github").alias("platform"),
                group[0].alias("owner"),
                group[1].alias("name"),
                F.coalesce(group[2], F.lit(DEFAULT_BRANCH)).alias("branch"),
                group[3].alias("subpath"),
            ),
        )

    return F.coalesce(*[taken(p) for p in REPOSITORY_PATTERNS])


def archive_address(platform: Column, owner: Column, name: Column, branch: Column) -> Column:
    """Where a repository's archive is downloaded from; empty if not offered."""
    address = F.format_string(ARCHIVE_ADDRESS, owner, name, branch)
    return F.when(platform == "github", address).otherwise("")


def cache_key(owner: Column, name: Column, branch: Column) -> Column:
    full = F.concat(owner, F.lit("/"), name, F.lit(":"), branch)
    return F.substring(F.sha2(full, 256), 1, 16)


def head_commit(disposition: Column, final_url: Column) -> Column:
    """The commit an archive download names, in its file name or final address."""
    named = F.regexp_extract(
        F.coalesce(disposition, F.lit("")), NAMED_COMMIT, 1
    )
    last = F.substring_index(F.regexp_replace(final_url, "/+$", ""), "/", -1)
    return F.coalesce(F.nullif(named, F.lit("")), F.when(last.rlike("^[0-9a-f]{7,}$"), last))
