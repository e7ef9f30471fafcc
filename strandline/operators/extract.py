"""Changes from change records: filter, diff two revisions of a property, classify, keep the newest per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.instants import instant_micros

#: The property types that are followed.
PROPERTY_TYPES = ("time", "quantity", "wikibase-item", "globe-coordinate")
WIKI = "https://en.wikipedia.org/wiki/"


def statement_value(document: Column, pid: Column) -> Column:
    """The text of a property's first statement in a JSON document.

    ERROR for a document that can't be read, NO_VALUE where the property or its value is missing, SOME_VALUE for an unknown
    value; else the first of id, amount, time, latitude and longitude, text that the value has, or the value itself.
    """
    inside = lambda text, path: F.call_function("get_json_object", text, path)  # noqa: E731  a path may be a column
    once = lambda column, then: F.get(F.transform(F.array(column), then), F.lit(0))  # noqa: E731  so that a text is read once, however often it is asked for
    statement = F.concat(F.lit("$.claims."), pid, F.lit("[0]"))
    unread = document.isNull() | F.try_parse_json(document).isNull() | F.trim(document).isin("", "null", "{}", "[]")

    def text(value: Column) -> Column:
        fields = F.from_json(value, "id string, amount string, time string, latitude string, longitude string, text string")
        point = lambda f: F.when(f["latitude"].isNotNull() & f["longitude"].isNotNull(), F.concat_ws(",", f["latitude"], f["longitude"]))
        return F.coalesce(once(fields, lambda f: F.coalesce(f["id"], f["amount"], f["time"], point(f), f["text"])), value, F.lit("ERROR"))

    def said(snak: Column) -> Column:
        kind = F.get_json_object(snak, "$.snaktype")
        return F.when(kind == "somevalue", "SOME_VALUE").when(kind == "novalue", "NO_VALUE").otherwise(once(F.get_json_object(snak, "$.datavalue.value"), text))

    first = once(inside(document, statement), lambda s: F.when(s.isNull(), F.lit("NO_VALUE")).otherwise(once(F.get_json_object(s, "$.mainsnak"), said)))
    return F.when(unread, F.lit("ERROR")).otherwise(first)


def change_kind(old: Column, new: Column) -> Column:
    """created from nothing, deleted into nothing, else updated; from nothing comes first."""
    return (
        F.when(old.isin("NEW_CREATED", "NO_VALUE", "SOME_VALUE"), "created").when(new.isin("NO_VALUE", "SOME_VALUE"), "deleted").otherwise("updated")
    )


def wiki_url(title: Column) -> Column:
    return F.concat(F.lit(WIKI), F.translate(title, " ", "_"))


def in_window(records: DataFrame, end: Column, hours: float | None) -> DataFrame:
    """The records of the last `hours` before `end`; all of them without a window."""
    if hours is None:
        return records
    at = instant_micros(F.col("timestamp"))
    return records.where((at <= F.unix_micros(end)) & (at >= F.unix_micros(end) - F.lit(int(hours * 3_600_000_000))))


def extract_changes(records: DataFrame, entities: DataFrame, revisions: DataFrame, names: DataFrame, types_from_revision: bool = False) -> DataFrame:
    """The change rows (schemas.CHANGES, and revid) of change records.

    Kept are records of items that exist, have an English page that is no category, and name a property in the comment whose
    type is followed; the type is that of the entity's first statement now (types_from_revision: of the new revision, so that
    removed properties stay). A record without a previous revision is a creation. Rows whose value is unchanged or unreadable on either
    side are left out. names = (id, label).
    """
    pid = F.regexp_extract("comment", r"\[\[Property:(P\d+)\]\]", 1)
    wanted = records.where(F.col("title").startswith("Q")).withColumn("pid", pid).where(F.col("pid") != "")
    known = entities.where(F.col("missing").isNull() & F.map_contains_key("sitelinks", F.lit("enwiki"))).select(
        F.col("id").alias("title"),
        F.col("sitelinks")["enwiki"]["title"].alias("page"),
        F.col("labels")["en"]["value"].alias("own_label"),
        F.transform_values("claims", lambda _, s: F.try_element_at(s, F.lit(1))["mainsnak"]["datatype"]).alias("types"),
    )
    old, new = revisions.toDF("old_revid", "old_doc"), revisions.toDF("revid", "new_doc")
    joined = (
        wanted.join(known.where(~F.col("page").startswith("Category:")), "title")
        .join(new, "revid", "left")
        .join(old, "old_revid", "left")
        .withColumn("type", F.coalesce(F.try_element_at("types", F.col("pid")), F.lit("unknown")))
    )
    if types_from_revision:
        path = F.concat(F.lit("$.claims."), F.col("pid"), F.lit("[0].mainsnak.datatype"))
        joined = joined.withColumn("type", F.coalesce(F.call_function("get_json_object", F.col("new_doc"), path), F.call_function("get_json_object", F.col("old_doc"), path), "type"))
    diffed = joined.where(F.col("type").isin(*PROPERTY_TYPES)).select(
        "title", "own_label", "pid", "type", "page", "revid", "timestamp",
        F.when(F.coalesce("old_revid", F.lit(0)) == 0, "NEW_CREATED").otherwise(statement_value(F.col("old_doc"), F.col("pid"))).alias("old_value"),
        statement_value(F.col("new_doc"), F.col("pid")).alias("new_value"),
    ).where((F.col("old_value") != F.col("new_value")) & (F.col("old_value") != "ERROR") & (F.col("new_value") != "ERROR"))
    label = lambda side: names.toDF(side, f"{side}_label")
    return (
        diffed.join(label("pid"), "pid", "left").join(label("new_value"), "new_value", "left")
        .select(
            F.col("title").alias("entity_id"), F.coalesce("own_label", "title").alias("entity_label"),
            F.col("pid").alias("property_id"), F.coalesce("pid_label", "pid").alias("property_label"), F.col("type").alias("property_type"),
            "old_value", "new_value",
            F.when(F.col("new_value").startswith("Q"), F.coalesce("new_value_label", "new_value")).otherwise(F.col("new_value")).alias("new_value_label"),
            change_kind(F.col("old_value"), F.col("new_value")).alias("change_type"),
            F.col("timestamp").alias("change_timestamp"), wiki_url(F.col("page")).alias("wiki_url"), "revid",
        )
    )


def latest_per_entity(changes: DataFrame) -> DataFrame:
    """The newest change of each entity, by instant, then revid, property and first delivery; combined before the shuffle."""
    rank = F.struct(instant_micros(F.col("change_timestamp")).alias("at"), "revid", "property_id", *[(-F.col("feed_pos")).alias("first")] * ("feed_pos" in changes.columns))
    kept = [c for c in changes.columns if c != "entity_id"]
    return changes.groupBy("entity_id").agg(F.max_by(F.struct(*kept), rank).alias("row")).select("entity_id", "row.*")


def newest_first(changes: DataFrame, most: int | None = None) -> DataFrame:
    """By timestamp, newest first, ties by entity; at most `most` rows (0 or None: all)."""
    ordered = changes.orderBy(instant_micros(F.col("change_timestamp")).desc(), "entity_id")
    return ordered.limit(most) if most else ordered


def previous_values(changes: DataFrame) -> DataFrame:
    """changes with `prior_value`, the new value of the key's change before, for feeds without a pointer to the old revision."""
    w = Window.partitionBy("entity_id", "property_id").orderBy(instant_micros(F.col("change_timestamp")), "revid", "feed_pos")
    return changes.withColumn("prior_value", F.lag("new_value").over(w))
