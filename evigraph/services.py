"""Calls of outside services (models, bibliographic providers, parsers) behind one interface, with a cache by content.

A service is a function from a list of request texts to a list of response texts, called in ``mapInPandas`` on the misses of
the cache only. ``Echo`` answers offline and lets pipelines be tested without a network. Wrappers add what calls need: a pace,
retries, a schema, a budget.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.chunks import pack_units
from .operators.records import insert_absent
from .runtime import written

Service = Callable[[list[str]], list[str]]


class Echo:
    """Answers with a fixed prefix and the request."""

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def __call__(self, requests: list[str]) -> list[str]:
        return [self.prefix + r for r in requests]


class Later(Exception):
    """A service asks to be called again, after ``seconds`` if it says so."""

    def __init__(self, message: str = "", seconds: float | None = None):
        super().__init__(message)
        self.seconds = seconds


class Retried:
    """``service`` called again while it raises ``Later``: after the time it names, else after ever longer pauses; and not more
    often than once in ``pace`` seconds by one worker."""

    def __init__(self, service: Service, attempts: int = 4, wait: float = 1.0, pace: float = 0.0, sleep: Callable[[float], None] = time.sleep):
        self.service, self.attempts, self.wait, self.pace, self.sleep = service, attempts, wait, pace, sleep
        self.last = 0.0

    def __call__(self, requests: list[str]) -> list[str]:
        for n in range(self.attempts):
            if self.pace and (rest := self.last + self.pace - time.monotonic()) > 0:
                self.sleep(rest)
            self.last = time.monotonic()
            try:
                return self.service(requests)
            except Later as again:
                if n + 1 == self.attempts:
                    raise
                self.sleep(again.seconds if again.seconds is not None else self.wait * 2**n)
        raise AssertionError


def fenced_json(text: str):
    """The JSON value of an answer that may stand in a fence; ValueError if it is none."""
    own = text.strip()
    if own.startswith("```"):
        own = re.sub(r"\s*```$", "", own.split("\n", 1)[1] if "\n" in own else own[3:])
    return json.loads(own)


def schema_errors(value, schema: dict, at: str = "") -> list[str]:
    """What is wrong with a JSON value, sorted by place: type, required, enum, properties, additionalProperties, items, minItems,
    minimum and maximum are checked."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def fits(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
        return isinstance(value, kinds[kind])

    out, here = [], at or "<root>"
    kind = schema.get("type")
    if kind is not None and not any(map(fits, kind if isinstance(kind, list) else [kind])):
        return [f"{here}: {value!r} is not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}: {value!r} is not one of {schema['enum']}")
    if isinstance(value, dict):
        out += [f"{here}: {k!r} is missing" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            out += [f"{here}: {k!r} is not allowed" for k in value if k not in known]
        for k, v in value.items():
            if k in known:
                out += schema_errors(v, known[k], f"{at}/{k}".lstrip("/"))
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{here}: fewer than {schema['minItems']} items")
        for i, v in enumerate(value):
            out += schema_errors(v, schema.get("items", {}), f"{at}/{i}".lstrip("/"))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{here}: {value!r} is below {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{here}: {value!r} is above {schema['maximum']}")
    return sorted(out)


class Structured:
    """``service`` asked for JSON of a schema: an answer that isn't is asked for again with what is wrong, up to ``attempts``
    times; then it is an error."""

    def __init__(self, service: Service, schema: dict, attempts: int = 3):
        self.service, self.schema, self.attempts = service, schema, attempts

    def __call__(self, requests: list[str]) -> list[str]:
        out: list[str | None] = [None] * len(requests)
        wrong: dict[int, str] = dict.fromkeys(range(len(requests)), "")
        for _ in range(self.attempts):
            asked = sorted(wrong)
            answers = self.service([requests[i] + (f"\n\nThe last answer was not right: {wrong[i]}" if wrong[i] else "") for i in asked])
            for i, answer in zip(asked, answers, strict=True):
                try:
                    value = fenced_json(answer)
                    errors = schema_errors(value, self.schema)
                except ValueError as bad:
                    errors = [str(bad)]
                if errors:
                    wrong[i] = "; ".join(errors)
                else:
                    out[i] = json.dumps(value, ensure_ascii=False, sort_keys=True)
                    del wrong[i]
            if not wrong:
                return out
        raise ValueError("; ".join(wrong.values()))


class Budgeted:
    """``service`` called only with requests of up to ``most`` tokens, counted before the call; a longer one is an error."""

    def __init__(self, service: Service, most: int, count: Callable[[str], int] = lambda t: -(-len(t) // 3)):
        self.service, self.most, self.count = service, most, count

    def __call__(self, requests: list[str]) -> list[str]:
        for r in requests:
            if (n := self.count(r)) > self.most:
                raise ValueError(f"a request of {n} tokens, above {self.most}")
        return self.service(requests)


def request_key(*parts) -> F.Column:
    """Cache key of a request: whatever changes its answer must be among the parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def answered(requests: DataFrame, cache: DataFrame, service: Service, batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """(answers with ``error``, new cache) for requests (key, request) and a cache (key, response). Each miss is asked for once: the
    answers are written before both results read them. A batch that fails is asked again one by one; what fails then has a
    null response and its error, and is not cached."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                texts, errors = part["request"].tolist(), [None] * len(part)
                try:
                    out = service(texts)
                except Exception as failed:
                    out, errors = [None] * len(part), [f"{type(failed).__name__}: {failed}"] * len(part)
                    for i, t in enumerate(texts if len(texts) > 1 else []):
                        try:
                            out[i], errors[i] = service([t])[0], None
                        except Exception as own:
                            errors[i] = f"{type(own).__name__}: {own}"
                yield pd.DataFrame({"key": part["key"].to_numpy(), "response": out, "error": errors})

    wanted = requests.select("key", "request").dropDuplicates(["key"])
    fresh = written(wanted.join(cache.select("key"), "key", "left_anti").mapInPandas(call, "key string, response string, error string"), "answers")
    grown = insert_absent(cache.select("key", "response"), fresh.where("response is not null").select("key", "response"), ["key"])
    told = cache.select("key", "response", F.lit(None).cast("string").alias("error")).unionByName(fresh)
    return requests.join(told, "key", "left"), grown


def run_rows(requests: DataFrame, answers: DataFrame, started: F.Column, finished: F.Column) -> DataFrame:
    """A log row (key, status, error, started_at, finished_at) for each request."""
    j = requests.select("key").distinct().join(answers.select("key", "response", "error").dropDuplicates(["key"]), "key", "left")
    return j.select("key", F.when(F.col("response").isNotNull(), "success").otherwise("error").alias("status"), "error", started.alias("started_at"), finished.alias("finished_at"))


def merged_memories(parts: DataFrame, service: Service, most: int, levels: int = 16) -> DataFrame:
    """(paper_id, text): the parts (paper_id, pos, text) of each paper merged level by level: neighbours are packed up to ``most``
    characters and each pack becomes one text by a call. A level that packs nothing together, since its texts are too long,
    is packed in pairs, each text cut to half its room, so that the levels end; a paper of one part stays as it is."""
    now = parts.select("paper_id", "pos", "text")
    for _ in range(levels):
        n = now.groupBy("paper_id").agg(F.count("*").alias("n"))
        if not n.where("n > 1").limit(1).count():
            break
        open_ = now.join(n.where("n > 1"), "paper_id")
        packed = pack_units(open_, ["paper_id"], "pos", F.length("text") + 256, F.lit(""), most)
        packs = packed.groupBy("paper_id").agg(F.count_distinct("chunk_no").alias("packs"))
        held = packed.join(packs, "paper_id").withColumn("chunk_no", F.when(F.col("packs") == F.col("n"), F.floor((F.row_number().over(_by_pos()) - 1) / 2).cast("int")).otherwise(F.col("chunk_no")))
        short = held.withColumn("text", F.when(F.col("packs") == F.col("n"), F.substring("text", 1, most // 2)).otherwise(F.col("text")))
        groups = short.groupBy("paper_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("request"), F.count("*").alias("k"), F.min("pos").alias("pos"))
        asked = groups.where("k > 1").withColumn("key", request_key("paper_id", F.col("chunk_no").cast("string"), "request"))
        empty = parts.sparkSession.createDataFrame([], "key string, response string")
        answers, _ = answered(asked, empty, service)
        bad = answers.where("response is null").select("error").limit(1).collect()
        if bad:
            raise RuntimeError(f"a merge failed: {bad[0][0]}")
        merged = answers.select("paper_id", "pos", F.col("response").alias("text")).unionByName(groups.where("k = 1").select("paper_id", "pos", F.col("request").alias("text")))
        now = written(now.join(n.where("n = 1").select("paper_id"), "paper_id", "left_semi").unionByName(merged), "memories")
    return now.select("paper_id", "text")


def _by_pos():
    from pyspark.sql import Window

    return Window.partitionBy("paper_id").orderBy("pos")


def inferred_relations(pairs: DataFrame, cache: DataFrame, service: Service, least: dict[str, float], batch: int = 24) -> tuple[DataFrame, DataFrame]:
    """(relations, new cache): the service's judgement of pairs (pair_id, left, right), JSON with relation and confidence, kept from
    the least confidence of its relation on; relations without one, like ``different``, are dropped."""
    asked = pairs.withColumn("key", request_key("left", "right")).withColumn("request", F.to_json(F.struct("pair_id", "left", "right")))
    answers, grown = answered(asked, cache, service, batch)
    told = F.from_json("response", "relation string, confidence double, rationale string")
    bound = F.element_at(F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("j.relation"))
    kept = answers.withColumn("j", told).where(bound.isNotNull() & (F.col("j.confidence") >= bound))
    return kept.select("pair_id", "left", "right", "j.relation", "j.confidence", "j.rationale"), grown


def named_clusters(dossiers: DataFrame, labels: DataFrame, service: Service, most: int) -> DataFrame:
    """(cluster, name, source): clusters named from the dossiers (cluster, pos, text) of their papers. Dossiers are merged by the
    service in groups of up to ``most`` characters until one text a cluster is left, which it then names as JSON with ``name``.
    Where an answer is no such JSON or the name is blank the cluster keeps its label (cluster, label); every cluster has a row."""
    texts = merged_memories(dossiers.select(F.col("cluster").alias("paper_id"), "pos", "text"), service, most)
    asked = texts.select(F.col("paper_id").alias("cluster"), F.concat(F.lit("NAME AS JSON {name}: "), "text").alias("request")).withColumn("key", request_key(F.col("cluster").cast("string"), "request"))
    answers, _ = answered(asked, dossiers.sparkSession.createDataFrame([], "key string, response string"), service)
    name = F.nullif(F.trim(F.get_json_object("response", "$.name")), F.lit(""))
    j = labels.join(answers.select("cluster", name.alias("name")), "cluster", "left")
    return j.select("cluster", F.coalesce("name", "label").alias("name"), F.when(F.col("name").isNotNull(), "service").otherwise("label").alias("source"))
