"""Lookups of ids at a service, in chunks: entities, labels and revisions, as the extractor takes them.

A client is a function of a list of ids to a dict by id, called inside the workers. Ids are looked up once each. What a failed chunk means is stated for each lookup;
`with_backoff` (operators.questions) around a client tries again before it fails. `failed` counts the ids of failed chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import schemas

#: Ids in a request.
CHUNK = 50


def _looked_up(ids: DataFrame, client: Callable[[list], dict | None], chunk: int, out: str, rows: Callable[[list, dict], list[tuple]], failed=None) -> DataFrame:
    """Rows of the schema `out` of rows(chunk of ids, found); a client that raises or gives None has found nothing of its chunk."""
    names = [part.split()[0] for part in _columns(out)]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            listed = batch.iloc[:, 0].tolist()
            for begin in range(0, len(listed), chunk):
                part = listed[begin : begin + chunk]
                try:
                    found = client(part)
                except Exception:  # noqa: BLE001  whatever the service raises
                    found = None
                if found is None and failed is not None:
                    failed.add(len(part))
                yield pd.DataFrame(rows(part, found or {}), columns=names)

    return ids.dropna().distinct().mapInPandas(look, out)


def _columns(schema: str) -> list[str]:
    """The top-level columns of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def entities(ids: DataFrame, client: Callable[[list], dict | None], chunk: int = CHUNK, failed=None) -> DataFrame:
    """Rows of schemas.ENTITY of ids (one column). A failed chunk has no rows, so the extractor drops its records, as it does those of unknown ids."""
    fields = [part.split()[0] for part in _columns(schemas.ENTITY)][1:]
    return _looked_up(ids, client, chunk, schemas.ENTITY, lambda part, found: [(i, *[found[i].get(f) for f in fields]) for i in part if i in found], failed)


def label_names(ids: DataFrame, client: Callable[[list], dict | None], chunk: int = CHUNK, failed=None) -> DataFrame:
    """(id, label) of every id: its English label, or the id itself where there is none or the chunk failed."""
    return _looked_up(ids, client, chunk, schemas.LABEL, lambda part, found: [(i, found.get(i) or i) for i in part], failed)


def revisions(ids: DataFrame, client: Callable[[list], dict | None], chunk: int = CHUNK, failed=None) -> DataFrame:
    """Rows of schemas.REVISION of revision ids; missing ones and failed chunks have no row, and the extractor takes what it can't read for an ERROR."""
    return _looked_up(ids, client, chunk, schemas.REVISION, lambda part, found: [(i, found[i]) for i in part if i in found], failed)


def extraction_inputs(records: DataFrame, clients: dict[str, Callable[[list], dict | None]], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, revisions, names) of change records, looked up by clients["entities"], clients["revisions"] and clients["labels"] (properties)."""
    items = records.where(F.col("title").startswith("Q")).select("title")
    revids = records.select(F.explode(F.array("revid", "old_revid")).alias("revid")).where("revid > 0")
    pids = records.select(F.regexp_extract("comment", r"\[\[Property:(P\d+)\]\]", 1).alias("id")).where("id <> ''")
    return entities(items, clients["entities"], chunk), revisions(revids, clients["revisions"], chunk), label_names(pids, clients["labels"], chunk)
