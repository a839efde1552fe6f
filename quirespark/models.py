"""Stages that call a language model, behind one small protocol; the stub stands in where there is no network.

No stage asks while its result is computed: the questions of a stage are made first, equal ones once, those that a table of answers has aren't asked again, and the rest is asked and written. A result is a join with
that table, so it can be used twice, or be computed anew where an executor is lost, and stays the same.

Every stage has a value for failures and never fails a task: the text as it was, no changes, no terms, no verdicts, an empty translation, blocks by rules, a summary that is marked as failed.
A client that can answer many texts at once has ``ask_many``; it gets a batch at a time. Errors that may pass (``PASSING``) are tried again after a while, others are not.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.arrow import json_in, plain_measurements
from .operators import blocks as B
from .operators import chat as C
from .stored import exists, shared_folder

FAILED = "\0failed"
#: Errors of a connection, a time limit or an answer that is no JSON.
PASSING = (OSError, TimeoutError, json.JSONDecodeError)


class Client(Protocol):
    def ask(self, task: str, text: str, hint: str = "") -> str: ...


class Stub:
    """Answers by rules: text comes back as it is; lists are empty."""

    def ask(self, task: str, text: str, hint: str = "") -> str:
        return text if task in ("clean", "translate", "title", "summarise") else "[]" if task in ("headings", "terms", "verify", "structure") else "{}"


@dataclass(frozen=True)
class Patience:
    """How often a question is asked, and the seconds between one time and the next."""

    attempts: int = 3
    delays: tuple[float, ...] = (2.0, 4.0, 8.0)

    def wait(self, attempt: int) -> None:
        if attempt + 1 < self.attempts and self.delays:
            time.sleep(self.delays[min(attempt, len(self.delays) - 1)])


def tried(client: Client, task: str, text: str, otherwise: str, hint: str = "", patience: Patience = Patience()) -> str:
    for attempt in range(patience.attempts):
        try:
            return client.ask(task, text, hint) if hint else client.ask(task, text)
        except PASSING:
            patience.wait(attempt)
        except Exception:  # noqa: BLE001 - a model's failure has a defined value
            break
    return otherwise


def answers(client: Client, task: str, asked: list[tuple[str, str]], patience: Patience = Patience()) -> list[str]:
    """The answers to (text, hint), FAILED where there is none: all at once if the client can and does, else one by one."""
    if asked and hasattr(client, "ask_many"):
        try:
            found = list(client.ask_many(task, asked))
            if len(found) == len(asked):
                return found
        except Exception:  # noqa: BLE001
            pass
    return [tried(client, task, text, FAILED, hint, patience) for text, hint in asked]


LINE_END = r"\r\n|[\n\r]"
IMAGE_URL = re.compile(r"!\[[^\]]*\]\(([^)]+)\)")
#: The number that a reference begins with: fixed by the format.
NUMBER = re.compile(r"^\s*(?:\[\d+\]|\d+[.)])\s*")

ANSWERS = "key string, answer string"


class Answers:
    """What a model has answered: a table for each task below ``folder``, from the key of a question to its answer; failures aren't kept. Without a folder it lasts as long as the application.

    ``at_once``: questions that go to the client in one batch. ``tasks``: batches are spread over so many tasks at most, which is how many ask at the same time.
    """

    def __init__(self, folder: str | None = None, patience: Patience = Patience(), tasks: int = 8, at_once: int = 200):
        self.folder, self.patience, self.tasks, self.at_once = folder, patience, tasks, at_once

    def kept(self, spark, task: str) -> DataFrame:
        """key and answer of all questions of a task that were answered."""
        self.folder = self.folder or shared_folder(spark)
        path = f"{self.folder}/{task}"
        if not exists(spark, path):
            return spark.createDataFrame([], ANSWERS)
        # two applications may have asked the same at once: one answer holds
        return spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(path).groupBy("key").agg(F.min("answer").alias("answer"))

    def to(self, questions: DataFrame, client: Client, task: str) -> DataFrame:
        """key and answer (null for failures) of the questions (key, text, hint): those without an answer are asked, each key once, and what comes back is written before anyone reads it."""
        spark, known = questions.sparkSession, self.kept(questions.sparkSession, task)
        new = questions.groupBy("key").agg(F.first("text").alias("text"), F.first("hint").alias("hint")).join(known, "key", "left_anti")
        patience, at_once = self.patience, self.at_once

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in range(0, len(frame), at_once):
                    part = frame.iloc[i : i + at_once]
                    found = answers(client, task, list(zip(part["text"], part["hint"])), patience)
                    yield pd.DataFrame({"key": part["key"], "answer": [None if a == FAILED else a for a in found]})

        made = new.repartition(self.tasks, "key").mapInPandas(ask, ANSWERS)
        path = f"{self.folder}/{task}/run={uuid.uuid4().hex}"
        run = f"{shared_folder(spark)}/asked"
        made.write.parquet(run)
        asked = spark.read.schema(ANSWERS).parquet(run)
        good = asked.filter("answer is not null")
        if not good.isEmpty():
            good.coalesce(max(1, self.tasks // 8)).write.parquet(path)
        return known.unionByName(asked)


def _stage(rows: DataFrame, key: list[str], columns: list[str], out: str, client: Client, task: str, finish: Callable[[str, str], str | None], question: Column | None = None, store: Answers | None = None, of_text: bool = True) -> DataFrame:
    """key and a column ``out`` made by ``finish`` from the text and its answer. columns: the text, and what goes along as a hint. Where ``question`` (by default the text) is null nothing is asked.

    ``of_text``: whether ``finish`` needs the text; where it doesn't, texts don't meet their answers and ``finish`` gets an empty one.
    """
    kinds = dict(rows.dtypes)
    hint = F.concat_ws("\n", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns[1:]]) if columns[1:] else F.lit("")
    texts = rows.select(*key, F.coalesce(columns[0], F.lit("")).alias("__text"), hint.alias("__hint"))
    asked = texts.withColumn("__asked", F.col("__text") if question is None else question)
    named = asked.withColumn("__key", F.when(F.col("__asked").isNotNull(), F.sha2(F.concat(F.length("__asked").cast("string"), F.lit(":"), "__asked", "__hint"), 256)))
    questions = named.filter("__key is not null").select(F.col("__key").alias("key"), F.col("__asked").alias("text"), F.col("__hint").alias("hint"))
    found = (store or Answers()).to(questions, client, task)
    joined = named.join(found.select(F.col("key").alias("__key"), "answer"), "__key", "left").select(*key, F.col("__text") if of_text else F.lit("").alias("__text"), "answer")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [finish(t, FAILED if a is None or a != a else a) for t, a in zip(frame["__text"], frame["answer"])]
            yield frame[key].assign(**{out: pd.Series(made, dtype="object", index=frame.index)})

    return joined.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + f", {out} string")


def _listed(answer: str) -> list:
    return [] if answer == FAILED else json.loads(json_in(answer, True))


def clean(chunks: DataFrame, key: list[str], client: Client, text: str = "text", store: Answers | None = None) -> DataFrame:
    """Cleaned chunks with measurements as plain text; a failure leaves the chunk."""
    return _stage(chunks, key, [text], "cleaned", client, "clean", lambda t, a: plain_measurements(t if a == FAILED else a), store=store)


def translate(passages: DataFrame, key: list[str], client: Client, text: str = "text", hints: tuple[str, ...] = (), store: Answers | None = None) -> DataFrame:
    """Translations; an empty answer gives the source text, a failure nothing. hints: columns with the glossary and the context of a passage."""
    return _stage(passages, key, [text, *hints], "translation", client, "translate", lambda t, a: "" if a == FAILED else a or t, store=store)


def titles(papers: DataFrame, key: list[str], client: Client, title: str = "title", hints: tuple[str, ...] = (), store: Answers | None = None) -> DataFrame:
    """Translated titles, trimmed; nothing for blank titles and failures."""
    return _stage(papers, key, [title, *hints], "title_zh", client, "title", lambda t, a: "" if a == FAILED else a.strip(), F.when(F.rlike("__text", F.lit(r"\S")), F.col("__text")), store)


def terms(chunks: DataFrame, key: list[str], client: Client, text: str = "text", least: int = 150, most: int = 3000, store: Answers | None = None) -> DataFrame:
    """JSON lists of {en, zh} for chunks long enough."""

    def finish(t: str, answer: str) -> str:
        return json.dumps([x for x in _listed(answer) if isinstance(x, dict) and x.get("en") and x.get("zh")], ensure_ascii=False)

    return _stage(chunks, key, [text], "terms", client, "terms", finish, F.when(F.length("__text") >= least, F.substring("__text", 1, most)), store)


def verdicts(paragraphs: DataFrame, key: list[str], client: Client, text: str = "text", store: Answers | None = None) -> DataFrame:
    return _stage(paragraphs, key, [text], "verdict", client, "verify", lambda t, a: "[]" if a == FAILED else json_in(a, True), F.substring("__text", 1, 300), store)


def repaired_headings(docs: DataFrame, key: str, client: Client, text: str = "text", title: str = "title", store: Answers | None = None) -> DataFrame:
    """Documents with heading lines as the client wants them: it gets them all and the title, and answers with a list of {old line: new line}; '' deletes a line, a failure changes nothing."""

    def finish(t: str, answer: str) -> str:
        return json.dumps([{o: n} for x in _listed(answer) if isinstance(x, dict) for o, n in x.items() if isinstance(n, str)], ensure_ascii=False)

    heads = F.array_join(F.filter(F.split("__text", r"\R"), lambda x: F.rlike(x, F.lit(r"^#{1,6}\s"))), "\n")
    asked = _stage(docs, [key], [text, title], "changes", client, "headings", finish, F.nullif(heads, F.lit("")), store, of_text=False)
    each = asked.select(key, F.posexplode(F.from_json("changes", "array<map<string,string>>")).alias("pos", "m")).select(key, "pos", F.explode("m").alias("old", "new"))
    return B.replaced_lines(docs, key, each, text)


def structured(chunks: DataFrame, key: str, client: Client, text: str = "text", store: Answers | None = None) -> DataFrame:
    """key, idx, type, level, text and url of the blocks of chunks as the client types them ([{type, level, text}], {type: image, placeholder}); by rules where it fails or answers with nothing of use.

    The client doesn't see the lines of images, but __IMG_0__, __IMG_1__ ... in their places; references lose their numbers. A key tells one chunk.
    """

    def finish(t: str, answer: str) -> str | None:
        shown = {f"__IMG_{i}__": x for i, x in enumerate(x.strip() for x in re.split(LINE_END, t) if x.strip().startswith("!["))}
        made = []
        for x in _listed(answer):
            if not isinstance(x, dict):
                continue
            if x.get("type") == "image" and isinstance(mark := x.get("placeholder", ""), str):
                own = IMAGE_URL.search(shown.get(mark, ""))
                made.append({"type": "image", "level": 0, "text": None, "url": own[1] if own else mark})
            elif x.get("type") in ("heading", "paragraph", "reference") and isinstance(x.get("text"), str):
                level = x.get("level") if isinstance(x.get("level"), int) else 0
                made.append({"type": x["type"], "level": level, "text": NUMBER.sub("", x["text"]) if x["type"] == "reference" else x["text"], "url": None})
        return json.dumps(made, ensure_ascii=False) if made else None

    image = lambda x: F.startswith(F.trim(x), F.lit("!["))
    lines = F.split("__text", LINE_END)
    marked = F.transform(lines, lambda x, i: F.when(image(x), F.concat(F.lit("__IMG_"), F.size(F.filter(F.slice(lines, F.lit(1), i), image)).cast("string"), F.lit("__"))).otherwise(x))
    typed = _stage(chunks, [key], [text], "blocks", client, "structure", finish, F.when(F.contains("__text", F.lit("![")), F.array_join(marked, "\n")).otherwise(F.col("__text")), store)
    own = typed.select(key, F.posexplode(F.from_json("blocks", "array<struct<type:string,level:int,text:string,url:string>>")).alias("idx", "b")).select(key, "idx", "b.*")
    rest = chunks.join(typed.filter("blocks is null").select(key), key, "left_semi")
    return own.unionByName(B.classified(rest, key, text).select(key, "idx", "type", "level", "text", "url"))


def summaries(messages: DataFrame, key: str, client: Client, store: Answers | None = None) -> DataFrame:
    """key, summary and failed of sessions with old messages of user or assistant; a failure has no summary and counts against the session's compression."""
    spoken = C.to_summarise(messages, key, roles=("user", "assistant"))
    made = _stage(spoken, [key], ["text"], "summary", client, "summarise", lambda t, a: None if a == FAILED else a, store=store)
    return made.select(key, "summary", F.col("summary").isNull().alias("failed"))
