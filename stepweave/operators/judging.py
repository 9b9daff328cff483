"""Verdicts of an inference service: asked for in tasks, parsed by columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAILURES = ("PARSE_FAIL", "API_FAIL")

#: What a judge is told before the first prompt.
SYSTEM = "You judge recurring runs of test steps by the rules that each question states. Answer with one JSON object, without any text around it."
#: The rules, with the answers that ``parsed`` knows.
RUBRIC = """RULES
A slice is a run of consecutive steps that recurs in scenarios. Its facts tell how far it spreads:
- max_within_file_recurrence: scenarios of one file that hold it, at most; two or more speak for background
- max_within_repo_files: files of one repository that hold it, at most; two or more speak for reusable_scenario
- n_distinct_orgs: owners that hold it; two or more speak for shared_higher_level_step. Repositories of one owner may be clones, so they are no proof
- outlier_permille: how many of 1000 of its places lie in files that a generator wrote
extraction_worthy:
- yes: one coherent behaviour, with the same values wherever it stands, worth a name, whole from its start to its end, and written by people
- no: it begins or ends within a behaviour, hangs on values of one domain, is shared already, saves nothing (two short steps), or comes of an outline
- flagged-spec: a high outlier_permille, and quoted pairs or <names> that a template left
- uncertain: only where these rules leave it open
mechanism, for yes alone, else n/a: background, reusable_scenario, shared_higher_level_step, or unsure where none fits
A long slice that repeats a short one within may be yes: name the short one in the notes."""
#: The answer's form, which ends each prompt.
SHAPE = """Answer in this form:
{"extraction_worthy": "yes, no, uncertain or flagged-spec", "mechanism": "background, reusable_scenario, shared_higher_level_step, unsure or n/a", "notes": "the rule that decides, in one sentence"}"""


def prompts(rows: DataFrame, rubric: str, shape: str, fields: Sequence[str], longest: int = 160) -> DataFrame:
    """``rows`` with ``prompt``: the rubric, the named fields, the numbered texts
    of canonical_text_seq, each cut at so many characters, and the answer's shape."""
    facts = [F.concat(F.lit(f"  {f} = "), F.coalesce(F.col(f).cast("string"), F.lit("none"))) for f in fields]
    lines = F.transform("canonical_text_seq", lambda t, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), F.substring(t, 1, longest)))
    parts = [F.lit(rubric), F.lit("SLICE TO LABEL:"), *facts, F.lit("  steps:"), F.array_join(lines, "\n"), F.lit(shape)]
    return rows.withColumn("prompt", F.concat_ws("\n", *parts))


class Refused(Exception):
    """An answer of the service that another attempt would not change."""


class Status(Exception):
    """An answer of the service by its HTTP status; ``retry_after`` in seconds."""

    def __init__(self, code: int, message: str = "", retry_after: float | None = None) -> None:
        super().__init__(f"{code} {message}".strip())
        self.code, self.retry_after = code, retry_after


#: Statuses after which another attempt may do.
RETRIED = (429, 502, 503, 504, 524)


def _answered(call: Callable[[], str], attempts: int, wait: Callable[[float], None], longest_wait: float) -> tuple[str | None, str | None]:
    """The answer, or null and why there is none."""
    why = None
    for attempt in range(1, attempts + 1):
        pause = min(2.0**attempt, longest_wait)
        try:
            return call(), None
        except Refused as error:
            return None, str(error)
        except Status as error:
            why = str(error)
            if error.code not in RETRIED:
                return None, why
            pause = max(pause, min(error.retry_after or 0.0, longest_wait))
        except Exception as error:  # the service's own errors, whatever they are
            why = f"{type(error).__name__} {error}".strip()
        if attempt < attempts:
            wait(pause)
    return None, why


def ask(prompts: DataFrame, client: Callable[[str], str], attempts: int = 6, wait: Callable[[float], None] = time.sleep, longest_wait: float = 60.0) -> DataFrame:
    """(key, prompt) rows with ``content``, the client's answer, or null after
    so many failed attempts or one that is not RETRIED. The client is called in
    the tasks; between attempts they wait twice as long each time, up to
    ``longest_wait`` seconds, or as long as the service asks for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(content=[_answered(lambda p=p: client(p), attempts, wait, longest_wait)[0] for p in rows["prompt"]])

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("content", T.StringType())]))


#: What a judge is told to be.
SYSTEM = "You judge candidates by a written rubric, strictly. Answer with one JSON object and nothing else."


def ask_models(prompts: DataFrame, models: Sequence[str], client: Callable[[str, str, str], str], log: str, key: str = "pattern", system: str = SYSTEM, per_second: float = 0.4, tasks: int = 1, batch: int = 1000, attempts: int = 6, wait: Callable[[float], None] = time.sleep, longest_wait: float = 60.0) -> DataFrame:
    """Verdicts of several models on (key, prompt) rows: one row a model and key
    below ``log``, which is returned: model, key, verdict, mechanism, notes,
    content (its start), error and seconds.

    A model's keys are dealt over ``tasks`` that share its rate, ``per_second``
    calls, and models go side by side. What the log has is not asked again; new
    rows are appended ``batch`` keys at a time, each batch whole or not at all, so
    a run that is ended goes on where it was, and no key is in the log twice. The
    client is called with model, system and prompt."""
    spark = prompts.sparkSession
    names = spark.createDataFrame([(m,) for m in models], "model string")
    kind = prompts.schema[key].dataType.simpleString()
    schema = f"model string, `{key}` {kind}, verdict string, mechanism string, notes string, content string, error string, seconds double"
    pause = tasks / per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for rows in batches:
            found = []
            for model, prompt in zip(rows["model"], rows["prompt"], strict=True):
                due = last.get(model, -pause) + pause - time.monotonic()
                if due > 0:
                    wait(due)
                began = last[model] = time.monotonic()
                content, error = _answered(lambda m=model, p=prompt: client(m, system, p), attempts, wait, longest_wait)
                found.append((content, error, round(time.monotonic() - began, 2)))
            yield rows[["model", key]].assign(answer=[f[0] for f in found], error=[f[1] for f in found], seconds=[f[2] for f in found])

    every = prompts.dropDuplicates([key]).select(F.col(key), "prompt").join(F.broadcast(names))  # few models
    turn = F.pmod(F.xxhash64(key), F.lit(max(1, -(-prompts.count() // batch))))
    every = every.withColumn("_turn", turn)
    for k in [r["_turn"] for r in every.select("_turn").distinct().orderBy("_turn").collect()]:  # one row a batch
        asked = every.where(F.col("_turn") == k).drop("_turn")
        if _logged(spark, log):
            done = spark.read.schema(schema).json(log).select(F.col("model").alias("_m"), F.col(key).alias("_k"))
            asked = asked.join(done, (F.col("model") == F.col("_m")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        dealt = asked.withColumn("_task", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(tasks))).repartition(len(models) * tasks, "model", "_task").sortWithinPartitions("model", key).drop("_task")
        said = dealt.mapInPandas(run, f"model string, `{key}` {kind}, answer string, error string, seconds double")
        failed = F.when(F.col("answer").isNull(), F.substring("error", 1, 200))
        rows = parsed(said, "answer").select("model", key, "verdict", "mechanism", F.coalesce(failed, "notes").alias("notes"), F.substring("answer", 1, 300).alias("content"), "error", "seconds")
        rows.write.mode("append").json(log)
    return spark.read.schema(schema).json(log)


def _logged(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


# Names under which services answer, and the categories.
_SAID = ("extraction_worthy", "label_extraction_worthy", "label_a")
_BY = ("mechanism", "label_mechanism", "label_b")
_WHY = ("notes", "rationale", "reason")
VERDICTS = ("yes", "no", "uncertain", "flagged-spec")
MECHANISM_NAMES = ("background", "reusable_scenario", "shared_higher_level_step", "unsure", "n/a")
_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def _is_object(text: Column) -> Column:
    """Whether a text is a JSON object, up to its last brace; a repeated key,
    which a variant may not have, does not spoil it."""
    keys = F.json_object_keys(text)
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    whole = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return text.startswith("{") & text.endswith("}") & (F.coalesce(whole, F.lit(False)) | F.coalesce(repeated, F.lit(False)))


def _plain(content: Column) -> Column:
    """An answer without white space and without a fence around it."""
    plain = _strip(content)
    return F.when(plain.startswith("```"), F.regexp_replace(F.regexp_replace(plain, r"\A```[A-Za-z]*\s*", ""), r"\s*```\s*\z", "")).otherwise(plain)


def _object(plain: Column) -> Column:
    """The JSON object of an answer: all of it, or else the first object in it
    that has an extraction field; null if none."""
    named = lambda t: F.arrays_overlap(F.json_object_keys(t), F.array(F.lit("extraction_worthy"), F.lit("label_extraction_worthy")))
    inside = F.filter(F.regexp_extract_all(plain, F.lit(_OBJECT), 0), lambda t: _is_object(t) & F.coalesce(named(t), F.lit(False)))
    return F.when(_is_object(plain), plain).otherwise(F.get(inside, 0))


_FIELDS = ", ".join(f"{n} variant" for n in (*_SAID, *_BY, *_WHY))


def _field(held: Column, names: Sequence[str]) -> Column:
    """The first of the fields that is not null, empty, false or zero; of a
    repeated field, the last."""

    def truth(value: Column) -> Column:
        kind, text = F.schema_of_variant(value), value.cast("string")
        empty = F.when(kind == "STRING", text == "").when(kind == "BOOLEAN", text == "false").when(kind.startswith("ARRAY"), text == "[]").when(kind.startswith("OBJECT"), text == "{}").otherwise(text.try_cast("double") == 0)
        return F.when(value.isNotNull() & (kind != "VOID") & ~F.coalesce(empty, F.lit(False)), text)

    return F.coalesce(*[truth(held[n]) for n in names], F.lit(""))


def parsed(rows: DataFrame, content: str = "content", longest: int = 300, raw: int = 200) -> DataFrame:
    """``rows`` with verdict (yes, no, uncertain or flagged-spec), mechanism, both
    PARSE_FAIL where none is found and API_FAIL where there was no answer, and
    notes: the reason that an answer gives, or the start of one that can't be read.
    Step by step, as each step is used more than once by the next."""
    c = F.col
    rows = rows.withColumn("_plain", _plain(c(content)))
    rows = rows.withColumn("_json", _object(c("_plain")))
    rows = rows.withColumn("_held", F.from_json("_json", _FIELDS))
    rows = rows.withColumns({"_said": F.replace(F.lower(_strip(_field(c("_held"), _SAID))), F.lit(" "), F.lit("-")), "_by": F.replace(F.lower(_strip(_field(c("_held"), _BY))), F.lit(" "), F.lit("_")), "_why": _field(c("_held"), _WHY)})
    said, by = c("_said"), c("_by")
    near = F.when(said.contains("flag") & said.contains("spec"), "flagged-spec").when(said.startswith("y"), "yes").when(said.startswith("n") & ~said.contains("n/a"), "no").when(said.contains("uncert"), "uncertain").otherwise("PARSE_FAIL")
    means = (
        F.when(by.contains("background"), "background")
        .when(by.contains("reusable"), "reusable_scenario")
        .when(by.contains("shared") | by.contains("higher"), "shared_higher_level_step")
        .when(by.isin("na", "none", ""), "n/a")
        .when(by.contains("unsure"), "unsure")
        .otherwise("PARSE_FAIL")
    )
    failed = F.when(c(content).isNull(), "API_FAIL").when(c("_json").isNull(), "PARSE_FAIL")
    rows = rows.withColumns(
        {
            "verdict": F.coalesce(failed, F.when(said.isin(*VERDICTS), said).otherwise(near)),
            "mechanism": F.coalesce(failed, F.when(by.isin(*MECHANISM_NAMES), by).otherwise(means)),
            "notes": F.when(c("_json").isNull(), F.substring(_strip(F.coalesce(c(content), F.lit(""))), 1, raw)).otherwise(F.substring("_why", 1, longest)),
        }
    )
    return rows.drop("_plain", "_json", "_held", "_said", "_by", "_why")
