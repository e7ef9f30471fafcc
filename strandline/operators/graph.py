"""Basic graph patterns over facts (s, p, o): a parser for the query subset and a compiler to joins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TERM = r"(\?\w+|(?:wd|wdt):\w+(?:\|(?:wd|wdt):\w+)*|\"[^\"]*\"(?:@\w+)?)"
_PATTERN = re.compile(rf"{_TERM}\s+{_TERM}\s+{_TERM}\s*\.?")


@dataclass(frozen=True)
class Pattern:
    """Terms: `?x` is a variable, anything else an id; a predicate may be several ids, any of which fits."""

    subject: str
    predicate: str | tuple[str, ...]
    object: str
    optional: bool = False


@dataclass(frozen=True)
class Query:
    """form: count, ask or select; allowed / refused: ids that a predicate variable may or may not take; limit: 0 for none."""

    form: str
    patterns: tuple[Pattern, ...]
    target: tuple[str, ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    refused: tuple[tuple[str, tuple[str, ...]], ...] = ()
    limit: int = 0


def _term(text: str) -> str | tuple[str, ...]:
    parts = tuple(re.sub(r"^wdt?:", "", x) for x in text.split("|"))
    return parts if len(parts) > 1 else parts[0]


def parse(text: str) -> Query:
    """COUNT, ASK and SELECT over triple patterns with OPTIONAL, alternation, FILTER IN / NOT IN and LIMIT."""
    head, _, body = re.sub(r"#[^\n]*", "", text).partition("{")
    body = body.rpartition("}")[0]
    count = re.search(r"COUNT\s*\(\s*(?:DISTINCT\s*)?(\?\w+|\*)\s*\)", head, re.I)
    form = "ask" if re.match(r"\s*ASK\b", head, re.I) else "count" if count else "select"
    body = re.sub(r"SERVICE\s+\S+\s*\{[^}]*\}", "", body, flags=re.I)
    filters: dict[bool, list] = {True: [], False: []}
    for variable, no, ids in re.findall(r"FILTER\s*\(?\s*(\?\w+)\s+(NOT\s+)?IN\s*\(([^)]*)\)\s*\)?", body, re.I):
        filters[not no].append((variable, tuple(re.sub(r"^wdt?:", "", x.strip()) for x in ids.split(",") if x.strip())))
    body = re.sub(r"FILTER\s*\(?\s*\?\w+\s+(?:NOT\s+)?IN\s*\([^)]*\)\s*\)?", "", body, flags=re.I)
    patterns = []
    for part, inside in re.findall(r"(?:OPTIONAL\s*\{([^}]*)\})|([^{}]+?)(?=OPTIONAL|\Z)", body, re.I | re.S):
        for terms in _PATTERN.findall(part or inside):
            s, p, o = map(_term, terms)
            patterns.append(Pattern(s, p, o, bool(part)))
    if not patterns:
        raise ValueError(f"no pattern in {text!r}")
    target = (count[1],) if count else tuple(re.findall(r"\?\w+", head.partition("WHERE")[0]))
    limit = re.search(r"\bLIMIT\s+(\d+)", text, re.I)
    return Query(form, tuple(patterns), target, tuple(filters[True]), tuple(filters[False]), int(limit[1]) if limit else 0)


def _match(graph: DataFrame, pattern: Pattern, query: Query) -> DataFrame:
    """The facts that a pattern fits, a column per variable."""
    keep: list[Column] = []
    seen: dict[str, str] = {}
    for column, term in (("s", pattern.subject), ("p", pattern.predicate), ("o", pattern.object)):
        if isinstance(term, tuple):
            keep.append(F.col(column).isin(*term))
        elif not term.startswith("?"):
            keep.append(F.col(column) == term.strip('"'))
        elif term in seen:
            keep.append(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
            keep += [F.col(column).isin(*ids) for v, ids in query.allowed if v == term]
            keep += [~F.col(column).isin(*ids) for v, ids in query.refused if v == term]
    kept = graph.where(reduce(lambda a, b: a & b, keep)) if keep else graph
    return kept.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()], *([] if seen else [F.lit(1).alias("_")]))


def solutions(graph: DataFrame, query: Query) -> DataFrame:
    """All solutions, as a bag: patterns joined on their shared variables, most connected first, optional ones last and kept if unmatched."""
    rest = sorted(dict.fromkeys(query.patterns), key=lambda p: p.optional)
    found = _match(graph, rest.pop(0), query)
    while rest:
        shared = lambda p: set(_match(graph, p, query).columns) & set(found.columns) - {"_"}
        nearest = max(rest, key=lambda p: (not p.optional, len(shared(p))))
        rest.remove(nearest)
        side, on = _match(graph, nearest, query), sorted(shared(nearest))
        if on:
            found = found.join(side, on, "left" if nearest.optional else "inner")
        elif "_" in side.columns:  # a pattern without variables holds or doesn't
            found = found.join(side.limit(1).select(F.lit(True).alias("_holds")), F.lit(True), "left_semi")
        else:
            raise ValueError("patterns without a shared variable would make a cross join")
    return found


def run(graph: DataFrame, query: Query | str) -> DataFrame:
    """count: (n); ask: (holds); select: the target columns, in their order and at most `limit`."""
    query = parse(query) if isinstance(query, str) else query
    found = solutions(graph, query)
    if query.form == "count":
        return found.agg(F.count(F.lit(1)).alias("n"))
    if query.form == "ask":
        return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("holds"))
    columns = [t[1:] for t in query.target if t[1:] in found.columns] or [c for c in found.columns if c != "_"]
    chosen = found.select(*columns)
    return chosen.orderBy(*columns).limit(query.limit) if query.limit else chosen


def stored_patterns(queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, i, s, p, o): the distinct patterns of stored COUNT queries, `?x` terms kept; all queries at once, without the driver."""
    triple = r"(\?\w+|wd:\w+)\s+wdt:(\w+)\s+(\?\w+|wd:\w+)"
    body = F.col(text_column)
    parts = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(triple), F.lit(k)).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))])
    bare = lambda c: F.regexp_replace(c, "^wd:", "")
    return queries.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(parts)).alias("t")).select("id", bare("t.s").alias("s"), F.col("t.p").alias("p"), bare("t.o").alias("o"))


def stored_counts(graph: DataFrame, queries: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n): the result of every stored COUNT query: objects of one subject and predicate, or subjects of a star of patterns.

    All queries run as one plan: patterns are joined with the facts, and an entity solves a star if it fits all of its patterns.
    """
    patterns = stored_patterns(queries, id_column, text_column)
    size = patterns.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    ahead = patterns.where(F.col("o").startswith("?")).join(graph.withColumnRenamed("o", "x"), ["s", "p"]).select("id", "x", "p", "s")
    back = patterns.where(F.col("s").startswith("?")).join(graph.withColumnRenamed("s", "x"), ["p", "o"]).select("id", "x", "p", F.col("o").alias("s"))
    fits = ahead.unionAll(back).groupBy("id", "x").agg(F.count(F.lit(1)).alias("k"))
    solved = fits.join(size, ["id", "k"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    every = queries.select(F.col(id_column).alias("id"))
    return every.join(solved, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
