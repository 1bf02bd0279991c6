"""Web routes: which frameworks a tree uses, and the routes its files declare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.functions.text import basename
from symbolweave.operators.upsert import last_wins
from symbolweave.schema import NODE_COLUMNS


@dataclass(frozen=True)
class RouteRule:
    framework: str
    language: str
    files: str
    pattern: str
    handler_group: int | None
    unknown: str


# Route declarations by framework.  (?d) lets a dot match anything
# but a line feed.  ``files`` is matched against the file name; ``unknown``
# follows the route when a declaration names no handler.
RULES = [
    RouteRule("django", "python", r"^urls\.py$",
              r"""(?dU)path\(['"]([^'"]+)['"].*?\.as_view\(\)""", 1, " → unknown"),
    RouteRule("django", "python", r"^urls\.py$",
              r"""(?dU)re_path\(['"]([^'"]+)['"].*?\.as_view\(\)""", None, " → unknown"),
    RouteRule("express", "typescript", r"\.(?:js|ts)$",
              r"""(?dU)\.(?:get|post|put|delete|patch|use)\(['"](/[^'"]+)['"],\s*(\w+)""", 2, ""),
    RouteRule("fastapi", "python", r"\.py$",
              r"""(?dU)@\w+\.(?:get|post|put|delete|patch)\(['"]([^'"]+)['"]""", None, ""),
    RouteRule("flask", "python", r"\.py$",
              r"""(?dU)@\w+\.route\(['"]([^'"]+)['"]""", None, ""),
]
_PACKAGE = T.StructType(
    [
        T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
        T.StructField("devDependencies", T.MapType(T.StringType(), T.StringType())),
    ]
)


def detect_frameworks(files: DataFrame, root: str) -> DataFrame:
    """The frameworks a tree of (path, text) files shows signs of."""
    name, text = basename("path"), F.coalesce("text", F.lit(""))
    package = F.from_json(text, _PACKAGE)
    is_root_package = F.col("path") == f"{root.rstrip('/')}/package.json"

    def needs(which: str) -> Column:
        return F.map_contains_key(F.coalesce(package[which], F.create_map().cast("map<string,string>")), "express")

    requirements = name == "requirements.txt"
    signs = [
        (name == "urls.py", "django"),
        (name.isin("app.py", "routes.py"), "flask"),
        (name.isin("app.py", "routes.py"), "fastapi"),
        (is_root_package & (needs("dependencies") | needs("devDependencies")), "express"),
        (requirements & text.contains("django"), "django"),
        (requirements & text.contains("flask"), "flask"),
        (requirements & text.contains("fastapi"), "fastapi"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(framework)) for test, framework in signs]))
    rows = files.select(F.explode_outer(found).alias("framework"))
    return rows.filter(F.col("framework").isNotNull()).distinct()


def _found(number: int, rule: RouteRule) -> Column:
    """What one rule finds in a text, in order."""
    urls = F.regexp_extract_all("text", F.lit(rule.pattern), 1)
    handlers = F.regexp_extract_all("text", F.lit(rule.pattern), rule.handler_group or 1)

    def entry(pair: Column, at: Column) -> Column:
        told = F.concat(F.lit(" → "), pair["handler"]) if rule.handler_group else F.lit(rule.unknown)
        return F.struct(
            F.lit(number).alias("rule"),
            at.alias("at"),
            pair["url"].alias("url"),
            F.concat(F.lit(f"{rule.framework}: "), pair["url"], told).alias("signature"),
            F.lit(rule.language).alias("language"),
        )

    return F.transform(F.arrays_zip(urls.alias("url"), handlers.alias("handler")), entry)


def route_matches(files: DataFrame, frameworks: list[str]) -> DataFrame:
    """Every route declaration, as a node row with its order of writing.

    All rules run over a file's text in one pass.
    """
    lists = [
        F.when(basename("path").rlike(rule.files), _found(number, rule))
        for number, rule in enumerate(RULES)
        if rule.framework in frameworks
    ]
    if not lists:
        lists = [F.lit(None).cast(
            "array<struct<rule:int,at:int,url:string,signature:string,language:string>>")]
    every = F.flatten(F.array_compact(F.array(*lists)))
    # explode_outer: explode would have Spark run the patterns again as a filter.
    rows = files.select("path", F.explode_outer(every).alias("r")).filter(F.col("r").isNotNull())
    columns = {
        "id": F.concat("path", F.lit(":route:"), "r.url"),
        "file_path": F.col("path"),
        "name": F.col("r.url"),
        "kind": F.lit("route"),
        "signature": F.col("r.signature"),
        "line_start": F.lit(0),
        "line_end": F.lit(0),
        "parent_id": F.lit(None).cast("string"),
        "language": F.col("r.language"),
        "metadata": F.lit("{}"),
    }
    return rows.select(
        *[columns[c].alias(c) for c in NODE_COLUMNS], F.col("r.rule").alias("rule"), F.col("r.at").alias("at")
    )


def index_routes(files: DataFrame, root: str) -> DataFrame:
    """Route nodes of a tree; the last rule and match to write an id stay."""
    frameworks = [r.framework for r in detect_frameworks(files, root).collect()]  # at most four
    return last_wins(route_matches(files, frameworks), ["id"], ["rule", "at"], NODE_COLUMNS)
