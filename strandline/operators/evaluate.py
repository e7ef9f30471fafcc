"""Scores of recorded model answers: tags, matches, replayed search turns, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TURNS = 10
#: Fixed value: what an answer that never came is scored as.
NO_OUTPUT = "Error: model returned no output"
TOO_MANY = "Error: no answer within the allowed number of searches"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def asked(question: Column) -> Column:
    """The question with a question mark at its end."""
    return F.when(question.endswith("?"), question).otherwise(F.concat(question, F.lit("?")))


def tagged_answer(text: Column) -> Column:
    """What stands between the first <answer> and the first </answer>, empty if they are the wrong way round; without both the whole text; stripped."""
    begin, end = F.instr(text, "<answer>"), F.instr(text, "</answer>")
    inside = F.substring(text, begin + 8, F.greatest(F.lit(0), end - begin - 8))
    return stripped(F.when((begin > 0) & (end > 0), inside).otherwise(text))


def search_query(text: Column) -> Column:
    """The last <search> query of a text, stripped; NULL if there is none or it is empty."""
    return F.nullif(stripped(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<search>(.*?)</search>"), F.lit(1)), F.lit(-1))), F.lit(""))


def matches(expected: Column, given: Column) -> Column:
    """Whether the answer contains the expected one, case and outer white space apart; an empty expected answer is in every answer."""
    return F.contains(F.lower(stripped(given)), F.lower(stripped(expected)))


def equals(expected: Column, given: Column) -> Column:
    """The strict form: the same letters and digits."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return plain(expected) == plain(given)


def score(items: DataFrame) -> DataFrame:
    """items (expected_answer, model_answer, ...) with final_answer, matched and strict. NULL answers match nothing."""
    final = items.withColumn("final_answer", tagged_answer(F.col("model_answer")))
    return final.withColumns({"matched": F.coalesce(matches(F.col("expected_answer"), F.col("final_answer")), F.lit(False)), "strict": F.coalesce(equals(F.col("expected_answer"), F.col("final_answer")), F.lit(False))})


def accuracy(scored: DataFrame, *keys: str, hit: str = "matched") -> DataFrame:
    """(keys, total_questions, correct_answers, accuracy): 0.0 for no questions."""
    hits = F.sum(F.col(hit).cast("long"))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_questions"), F.coalesce(hits, F.lit(0).cast("long")).alias("correct_answers"), F.coalesce(F.avg(F.col(hit).cast("double")), F.lit(0.0)).alias("accuracy")
    )


def replay(turns: DataFrame) -> DataFrame:
    """(item_id, answer, search_count, outcome) of recorded model turns (item_id, step, text), as the search loop would have run.

    A turn with a search query goes on, whatever else it says; the first one without it, or without any text, ends the loop; after
    MOST_TURNS searches it ends without an answer. Turns after the end don't count.
    """
    query = search_query(F.col("text"))
    ends = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(query.isNull(), "answer")
    marked = turns.where(F.col("step") <= MOST_TURNS).select("item_id", "step", "text", ends.alias("end"))
    found = marked.groupBy("item_id").agg(
        F.min(F.when(F.col("end").isNotNull(), F.col("step"))).alias("stop"),
        F.min_by(F.struct("end", "text"), F.when(F.col("end").isNotNull(), F.col("step"))).alias("last"),
        F.count_if(F.col("end").isNull()).alias("searches"),
        F.sort_array(F.collect_list(F.when(F.col("end").isNull(), F.col("step")))).alias("steps"),  # at most MOST_TURNS
    )
    before = F.size(F.filter("steps", lambda s: F.col("stop").isNull() | (s < F.col("stop"))))
    return found.select(
        "item_id",
        F.when(F.col("last.end") == "answer", tagged_answer(F.col("last.text"))).when(F.col("last.end") == "empty", NO_OUTPUT).otherwise(TOO_MANY).alias("answer"),
        before.cast("long").alias("search_count"),
        F.coalesce("last.end", F.lit("limit")).alias("outcome"),
    )


def traced_searches(results: DataFrame) -> DataFrame:
    """(result_id, n_searches, n_informed, last_query): what the recorded trace of each result says of its searches."""
    of = lambda kind: F.filter("reasoning_process", lambda x: x["type"] == kind)
    return results.select(
        "result_id",
        F.coalesce(F.size(of("search")).cast("long"), F.lit(0).cast("long")).alias("n_searches"),
        F.coalesce(F.size(of("information")).cast("long"), F.lit(0).cast("long")).alias("n_informed"),
        F.try_element_at(of("search"), F.lit(-1))["query"].alias("last_query"),
    ).withColumns({c: F.when(F.col(c) < 0, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("n_searches", "n_informed")})


def snippets(documents: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, information): of each query the `top` documents of its entity as the lines of a search result, whole texts.

    queries = (query_id, entity_id, query). Documents are ranked by how many of the query's different words they have, then by length, longest
    first, then by id: an offline stand-in for a search service. A query without words ranks by length.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    titled = documents.where(F.col("text").isNotNull()).select("entity_id", "doc_id", "source", "n_chars", words(F.col("text")).alias("has"))
    met = queries.withColumn("asks", words(F.col("query"))).join(titled, "entity_id")
    shared = met.select("query_id", "doc_id", "source", "n_chars", F.size(F.array_intersect("has", F.coalesce("asks", F.array().cast("array<string>")))).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("shared").desc(), F.col("n_chars").desc(), "doc_id"))
    few = shared.withColumn("r", rank).where(F.col("r") <= top).join(documents.select("doc_id", "text"), "doc_id")
    line = F.format_string("Doc %d(Title: %s) %s", F.col("r"), F.coalesce("source", F.lit("None")), F.col("text"))
    lists = few.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("information"))
    return queries.join(lists, "query_id", "left").select("query_id", F.coalesce("information", F.lit("")).alias("information"))


#: Own wording of the two ways of asking.
DIRECT = "Answer with a name or number only, between <answer> and </answer>.\nQuestion: "
STEPWISE = "Think step by step, then give the answer between <answer> and </answer>.\nQuestion: "
SEARCHING = "You may search with <search>words</search>; you will be given documents. When you know it, answer between <answer> and </answer>.\nQuestion: "


def answered(items: DataFrame, client, instruction: str = DIRECT) -> DataFrame:
    """items (question, ...) with model_answer: the client's reply to instruction and question, with its tags; an error text if there is none."""
    schema = f"{items.schema.simpleString()[7:-1]},model_answer:string"

    def ask(batches):
        for batch in batches:
            replies = [client(instruction + (q if q.endswith("?") else f"{q}?")) or NO_OUTPUT for q in batch["question"]]
            yield batch.assign(model_answer=replies)

    return items.mapInPandas(ask, f"struct<{schema}>")


def searched(items: DataFrame, client, search, most: int = MOST_TURNS) -> DataFrame:
    """(item_id, step, text) of the search loop for items (item_id, question): each turn's text, as replay() takes them.

    Per item the client is asked again with what `search` found for its query, until a turn has no query or `most` turns were taken.
    """

    def loop(batches):
        import re

        import pandas as pd

        for batch in batches:
            turns = []
            for item, question in zip(batch["item_id"], batch["question"]):
                prompt = SEARCHING + (question if question.endswith("?") else f"{question}?")
                for step in range(1, most + 1):
                    text = client(prompt) or ""
                    turns.append((item, step, text))
                    queries = re.findall(r"<search>(.*?)</search>", text, re.S)
                    if not queries or not queries[-1].strip():
                        break
                    prompt += f"\n{text}\n<information>{search(queries[-1].strip())}</information>\n"
            yield pd.DataFrame(turns, columns=["item_id", "step", "text"])

    return items.select("item_id", "question").mapInPandas(loop, "item_id bigint, step int, text string")
