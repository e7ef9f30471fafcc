"""Indirect descriptions of entities: readable property names, checks of values, phrases and eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Readable names of property ids.
PROPERTY_NAMES = {
    "P31": "instance of", "P279": "subclass of", "P27": "country of citizenship", "P19": "place of birth", "P20": "place of death",
    "P103": "native language", "P136": "genre", "P106": "occupation", "P495": "country of origin", "P37": "official language",
    "P36": "capital", "P571": "inception", "P577": "publication date", "P57": "director", "P50": "author", "P175": "performer",
    "P1412": "languages spoken", "P17": "country", "P131": "located in", "P276": "location", "P159": "headquarters location",
    "P140": "religion", "P108": "employer", "P69": "educated at", "P54": "member of sports team", "P166": "award received",
    "P127": "owned by", "P449": "original broadcaster", "P123": "publisher", "P364": "original language",
}
#: The predicates of a node's direct description.
DESCRIBING = (
    "P27", "P19", "P20", "P103", "P136", "P106", "P495", "P37", "P36", "P571", "P577", "P57", "P50", "P175",
    "P1412", "P17", "P131", "P276", "P159", "P140", "P108", "P69", "P54", "P166", "P127", "P449", "P123", "P364",
)
#: The predicates of a reverse step.
REVERSE = (
    "P30", "P17", "P279", "P131", "P361", "P276", "P150", "P706", "P527", "P190", "P47", "P206", "P138", "P170", "P178", "P272",
    "P264", "P449", "P750", "P123", "P127", "P1830", "P355", "P749", "P112", "P1037", "P3320", "P488", "P35", "P6", "P1313", "P1906",
    "P37", "P103", "P1412", "P364", "P407", "P495", "P840", "P915", "P291", "P159", "P740", "P571", "P576", "P580", "P582", "P585",
)
#: Places and what they are called instead.
PLACES = {
    "Italy": "Mediterranean country", "Sicily": "Italian island", "France": "European republic", "Germany": "Central European nation",
    "United Kingdom": "island nation", "Scotland": "northern British territory", "England": "southern British territory",
    "United States": "North American federation", "California": "Pacific coast state", "Texas": "southwestern state",
    "New York": "northeastern state", "Denmark": "Scandinavian kingdom", "Sweden": "Nordic country", "Norway": "fjord nation",
}
#: Kinds and what they are called instead.
KINDS = {
    "teacher": "education professional", "director": "film industry figure", "author": "literary figure", "politician": "public servant",
    "athlete": "sports professional", "football club": "sports organization", "university": "academic institution",
    "museum": "cultural institution", "film": "cinematic work", "album": "musical work",
}
#: Words too abstract to describe anything.
ABSTRACT = ("profession", "occupation", "concept", "category", "classification", "type", "kind", "form", "class")
#: Phrases of a reverse step by property label, x being the other node's label; `lower` stands for x itself in lower case.
REVERSE_PHRASES = {
    "continent": "x entity", "country": "x based", "contains administrative territorial entity": "x region",
    "located on terrain feature": "x region", "shares border with": "neighbor of x", "sister city": "neighbor of x",
    "located in or next to body of water": "x adjacent", "parent organization": "x affiliate", "owned by": "x affiliate",
    "founded by": "x affiliate", "subsidiary": "x branch", "has part": "x branch", "production company": "x production",
    "record label": "x production", "publisher": "x production", "distributor": "x production", "original broadcaster": "x network",
    "creator": "x creation", "developer": "x creation", "named after": "namesake of x", "official language": "x speaking",
    "native language": "x speaking", "original language of work": "x speaking", "filming location": "x associated",
    "narrative location": "x associated", "place of publication": "x associated", "headquarters location": "x established",
    "location of formation": "x established", "subclass of": "lower", "part of": "lower",
}


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def property_name(label: Column) -> Column:
    """The readable name of a property URI, its id if unknown; other labels as they are."""
    pid = F.substring_index(label, "/", -1)
    return F.when(label.contains("http://www.wikidata.org/prop/direct/"), F.coalesce(_map(PROPERTY_NAMES, pid), pid)).otherwise(label)


def describes(name: Column, value: Column) -> Column:
    """Whether a property and its value can stand in a description: readable, short, no link or id, not too abstract."""
    low = F.lower(value)
    return (
        F.coalesce(F.length(name) > 0, F.lit(False)) & F.coalesce(F.length(value) > 0, F.lit(False))
        & ~F.coalesce(value.rlike(r"^Q\d+$") | name.rlike("https?://") | low.rlike("https?://"), F.lit(True))
        & (F.length(value) <= 100) & (F.length(value) - F.length(F.replace(value, F.lit("/"))) <= 1) & ~low.isin(*ABSTRACT)
    )


def _era(year: Column, early: str, late: str) -> Column:
    return F.when(year < 1900, early).when(year < 1950, "early 20th century").when(year < 2000, "late 20th century").when(year.isNotNull(), late)


def era_of_date(date: Column) -> Column:
    """The era of a date with hyphens; NULL where no year can be read."""
    return F.when(date.contains("-"), _era(F.split(date, "-")[0].try_cast("int"), "pre-industrial era", "modern era"))


def era_of_instant(date: Column) -> Column:
    """The era of an ISO instant or date, by the names of the temporal step."""
    day = F.when(date.contains("T"), F.split(date, "T")[0]).when(date.contains("-"), date)
    return _era(F.split(day, "-")[0].try_cast("int"), "pre-modern era", "21st century")


def indirect(name: Column, value: Column) -> Column:
    """The indirect description of a value by the kind of its property; NULL if there is none."""
    return (
        F.when(name.isin("located in", "country", "country of citizenship"), _map(PLACES, value))
        .when(name.isin("inception", "publication date"), era_of_date(value))
        .when(name.isin("occupation", "genre"), _map(KINDS, F.lower(value)))
    )


def reverse_phrase(label: Column, other: Column) -> Column:
    """What a node is called by another node's property of it; NULL for labels without a phrase or unfit names."""
    phrase = _map(REVERSE_PHRASES, label)
    text = F.when(phrase == "lower", F.lower(other)).when(phrase.startswith("x "), F.concat(other, F.substring(phrase, 2, 100))).otherwise(F.concat(F.regexp_replace(phrase, "x$", ""), other))
    return F.when(F.length(other).between(3, 49), text)


def place_phrase(location: Column, country: Column, continent: Column) -> Column:
    has = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(has(country) & (F.coalesce(location, F.lit("")) != country), F.concat(country, F.lit(" entity")))
        .when(has(continent), F.concat(continent, F.lit(" organization"))).when(has(location), F.concat(location, F.lit(" based")))
    )


def organisation_phrase(kind: Column, parent: Column) -> Column:
    fits = F.lower(kind).rlike("club|team|organization|institution")
    return F.when(F.lower(parent).contains("organization"), F.lower(parent)).when(fits, F.lower(kind))


#: What a metaphor is told by, by a part of the relation's name.
METAPHORS = {"birth": "offspring of ", "capital": "crowned jewel of ", "language": "voice that speaks "}
ARCHITECT = "cinematic architect"


def metaphor(relation: Column, value: Column) -> Column:
    low = F.lower(relation)
    out = F.when(F.lit(False), F.lit(""))
    for part, phrase in METAPHORS.items():
        out = out.when(low.contains(part), F.concat(F.lit(phrase), value))
    return out.when(low.contains("director"), F.lit(ARCHITECT))


def direct_attributes(triples: DataFrame, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(node, place, property, value, description): the describing facts of every node, (s, p, o, p_label, o_label) given.

    allowed: the predicates that count, such as DESCRIBING; None for all.
    """
    kept = triples if allowed is None else triples.where(F.col("p").isin(*allowed))
    fit = kept.withColumn("property", property_name(F.col("p_label"))).where(describes(F.col("property"), F.col("o_label")))
    place = F.row_number().over(Window.partitionBy("s").orderBy("p", "o")).cast("long")
    text = F.concat_ws(" ", F.lit("has"), F.col("property"), F.col("o_label"))
    return fit.select(F.col("s").alias("node"), place.alias("place"), "property", F.col("o_label").alias("value"), text.alias("description"))


def diverse_properties(attributes: DataFrame, most: int = 5) -> DataFrame:
    """(node, property, value): of each property the plainest value (short, no Q, no link), properties in order of first appearance, `most` of them.

    Equal descriptions count once, the first stays.
    """
    once = attributes.groupBy("node", "description").agg(F.min_by(F.struct("place", "property", "value"), "place").alias("a")).select("node", "a.*")
    key = F.struct(F.length("value"), F.col("value").contains("Q"), F.lower("value").contains("http"), "place")
    best = once.groupBy("node", "property").agg(F.min_by("value", key).alias("value"), F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("first"))
    return best.withColumn("_r", rank).where(F.col("_r") <= most).select("node", "property", "value")


def location_chain(graph: DataFrame, names: DataFrame, steps: tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]], most: int = 5) -> DataFrame:
    """(s, description): place phrases of every entity over location, then optional country and continent; `most` locations each.

    steps: the predicates of each step. Equal descriptions of an entity appear once.
    """
    first = Window.partitionBy("s").orderBy("p", "o")
    place = graph.where(F.col("p").isin(*steps[0])).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).select("s", F.col("o").alias("l"))
    step = lambda ids, a, b: graph.where(F.col("p").isin(*ids)).select(F.col("s").alias(a), F.col("o").alias(b))
    label = lambda c: names.toDF(c, f"{c}_label")
    chain = place.join(step(steps[1], "l", "c"), "l", "left").join(step(steps[2], "c", "k"), "c", "left")
    for c in ("l", "c", "k"):
        chain = chain.join(label(c), c, "left")
    text = place_phrase(F.coalesce("l_label", "l"), F.coalesce("c_label", "c"), F.coalesce("k_label", "k"))
    return chain.select("s", text.alias("description")).where(F.col("description").isNotNull()).distinct()


def reverse_descriptions(graph: DataFrame, names: DataFrame, allowed: tuple[str, ...] | None = REVERSE, most: int = 5) -> DataFrame:
    """(node, description): of the facts that point at a node, the first (of `most`, in order of ids) that gives a phrase."""
    kept = graph if allowed is None else graph.where(F.col("p").isin(*allowed))
    few = kept.withColumn("_r", F.row_number().over(Window.partitionBy("o").orderBy("p", "s"))).where(F.col("_r") <= most)
    named = few.join(names.toDF("p", "p_label"), "p").join(names.toDF("s", "s_label"), "s")
    said = named.withColumn("description", reverse_phrase(F.col("p_label"), F.col("s_label"))).where(F.col("description").isNotNull())
    return said.groupBy(F.col("o").alias("node")).agg(F.min_by("description", "_r").alias("description"))


def indirect_descriptions(attributes: DataFrame, most: int = 2) -> DataFrame:
    """(node, descriptions): the first indirect descriptions of a node's attributes (node, place, property, value), by kind of property."""
    said = attributes.withColumn("d", indirect(F.col("property"), F.col("value"))).where(F.col("d").isNotNull())
    few = said.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("place"))).where(F.col("_r") <= most)
    return few.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "d"))), lambda x: x["d"]).alias("descriptions"))


def expansions(attributes: DataFrame, most: int = 100) -> DataFrame:
    """(node, direct_attributes): a node's direct attributes in order, as an array of (property, value, description), `most` at most."""
    few = attributes.where(F.col("place") <= most)
    item = F.struct("place", "property", "value", "description")
    return few.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("place")).alias("direct_attributes"))


def first_descriptions(attributes: DataFrame, most: int = 2) -> DataFrame:
    """(node, descriptions): the first descriptions of a node's direct attributes, in order."""
    few = attributes.where(F.col("place") <= most)
    return few.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "description"))), lambda x: x["description"]).alias("descriptions"))


def metaphors(attributes: DataFrame) -> DataFrame:
    """(node, description): metaphors for the first three attributes of a node."""
    said = attributes.where(F.col("place") <= 3).select("node", metaphor(F.col("property"), F.col("value")).alias("description"))
    return said.where(F.col("description").isNotNull()).distinct()


def kind_chain(graph: DataFrame, names: DataFrame, kinds: tuple[str, ...] = ("P31", "P279"), parents: tuple[str, ...] = ("P279",), most: int = 5) -> DataFrame:
    """(s, description): organisation phrases over an entity's kinds (`most` of them) and their optional parents; equal ones once."""
    kind = graph.where(F.col("p").isin(*kinds)).withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy("p", "o"))).where(F.col("_r") <= most).select("s", F.col("o").alias("k"))
    parent = graph.where(F.col("p").isin(*parents)).select(F.col("s").alias("k"), F.col("o").alias("u"))
    chain = kind.join(parent, "k", "left").join(names.toDF("k", "k_label"), "k", "left").join(names.toDF("u", "u_label"), "u", "left")
    return chain.select("s", organisation_phrase(F.col("k_label"), F.col("u_label")).alias("description")).where(F.col("description").isNotNull()).distinct()


def era_chain(dates: DataFrame, predicates: tuple[str, ...] | None = ("P571", "P577", "P580"), most: int = 3) -> DataFrame:
    """(s, description): the eras of an entity's dates (s, p, o = the date), the first `most` in order; equal ones once."""
    kept = dates if predicates is None else dates.where(F.col("p").isin(*predicates))
    few = kept.withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy("p", "o"))).where(F.col("_r") <= most)
    return few.select("s", era_of_instant(F.col("o")).alias("description")).where(F.col("description").isNotNull()).distinct()
