"""Remote services behind transports that are passed in: the site's status API, and language models."""

from __future__ import annotations

import gzip
import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivenry.sources.scratch import stored

# Addresses of the status API, the fields kept of its answer, and the longest wait between attempts, in seconds.
GENERAL_URL, ADULT_URL = "https://api.syosetu.com/novelapi/api/", "https://api.syosetu.com/novel18api/api/"
PAYLOAD = (
    "title", "ncode", "userid", "writer", "story", "biggenre", "genre", "keyword", "general_firstup", "general_lastup", "noveltype", "end",
    "general_all_no", "length", "time", "isstop", "isr15", "isbl", "isgl", "iszankoku", "istensei", "istenni",
)
LONGEST_WAIT = 16
RESULT = "ncode string, status string, fetched_at string, payload map<string,string>, attempts int, error string"

#: (url, params) -> (status code, body); raises OSError where the connection fails.
Transport = Callable[[str, dict], tuple[int, bytes]]


def decode(body: bytes) -> list:
    """A JSON answer, compressed or not."""
    return json.loads(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)


def fetch(ncode: str, adult: bool, transport: Transport, most: int = 5, sleep=time.sleep, now=None) -> tuple:
    """(ncode, status, fetched_at, payload, attempts, error) of a work.

    Failed connections, answers of 500 and above and unreadable bodies are tried again, after growing waits; 400
    and above aren't.  What can't be told is unknown; an answer without a work is not_found.
    """
    now = now or (lambda: datetime.now(timezone.utc).isoformat())
    error = None
    for attempt in range(1, most + 1):
        try:
            code, body = transport(ADULT_URL if adult else GENERAL_URL, {"out": "json", "gzip": "5", "ncode": ncode})
            if code < 400:
                records = decode(body)
                if len(records) < 2:
                    return ncode, "not_found", now(), None, attempt, None
                work = {k: None if records[1].get(k) is None else str(records[1].get(k)) for k in PAYLOAD} | {"updated_at": None}
                return ncode, "available", now(), work, attempt, None
            error = f"HTTP {code}"
            if code < 500:
                return ncode, "unknown", now(), None, attempt, error
        except (OSError, ValueError, EOFError) as e:
            error = f"{type(e).__name__}: {e}"
        if attempt < most:
            sleep(min(2 ** (attempt - 1), LONGEST_WAIT))
    return ncode, "unknown", now(), None, max(most, 0), error


def refresh_resumed(works: DataFrame, transport: Transport, path: str, **settings) -> DataFrame:
    """One row (processed, skipped, status_counts): works that ``path`` has no answer of are asked and their answers
    appended, whatever they are; a run that is cut short loses only its own.  Works come once, null ones not at all."""
    from scrivenry.operators.sampling import pending
    from scrivenry.streaming.jobs import written

    spark, own = works.sparkSession, works.where("ncode is not null").dropDuplicates(["ncode"])
    found = written(spark, path)
    known = spark.createDataFrame([], "ncode string") if found is None else found.select("ncode")
    todo = stored(pending(own, known, ["ncode"]).select("ncode", "is_r18"), "todo")
    refresh(todo, transport, **settings).write.mode("append").parquet(path)
    made = spark.read.schema(RESULT).parquet(path).join(todo.select("ncode"), "ncode", "left_semi").groupBy("status").agg(F.count("*").alias("n"))
    counts = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("processed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    return counts.crossJoin(own.agg(F.count("*").alias("all"))).select("processed", (F.col("all") - F.col("processed")).alias("skipped"), "status_counts")


def refresh(works: DataFrame, transport: Transport, most: int = 5, sleep=time.sleep, now=None) -> DataFrame:
    """The status of each work (ncode, is_r18), asked in the tasks that hold them."""

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            rows = [fetch(n, bool(a), transport, most, sleep, now) for n, a in zip(pdf["ncode"], pdf["is_r18"], strict=True)]
            yield pd.DataFrame(rows, columns=["ncode", "status", "fetched_at", "payload", "attempts", "error"])

    return works.select("ncode", "is_r18").mapInPandas(ask, RESULT)


def answer(prompt: str, client: Callable[[str], str], check: Callable[[dict], list[str]], most: int, longest: int = 6000) -> tuple[dict | None, str | None]:
    """(object, None) from a model that answers in JSON, or (None, why not) after ``most`` attempts.  Prompts that
    are too long aren't sent."""
    if len(prompt) > longest:
        return None, "too_long"
    why = "no_attempt"
    for _ in range(most):
        try:
            text = client(prompt)
            if "<think>" in text and "</think>" in text:
                text = text.rpartition("</think>")[2]
            found = json.loads(text)
            faults = check(found)
            if not faults:
                return found, None
            why = ";".join(faults)
        except (OSError, ValueError) as e:
            why = type(e).__name__
    return None, why


def classify(df: DataFrame, key: str, prompt: str, client: Callable[[str], str], schema: dict, most: int = 3, longest: int = 6000) -> DataFrame:
    """Rows (key, ok, answer as JSON text, error): one model call for each row, in its task."""
    from scrivenry.operators.features import problems

    kind = df.select(key).schema[0].dataType.simpleString()

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt], strict=True):
                found, error = answer(p or "", client, lambda x: problems(x, schema), most, longest)
                rows.append((k, found is not None, None if found is None else json.dumps(found, ensure_ascii=False), error))
            yield pd.DataFrame(rows, columns=[key, "ok", "answer", "error"])

    return df.select(key, prompt).mapInPandas(ask, f"`{key}` {kind}, ok boolean, answer string, error string")


def status_guard(status: Column) -> Column:
    """A work's state; a value that isn't one is an error, where the row is made."""
    from scrivenry.sources.schemas import AVAILABILITY

    return F.when(status.isin(*AVAILABILITY), status).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce(status, F.lit("null")))))


def api_targets(works: DataFrame) -> DataFrame:
    """Works that the status API knows: those of the first site."""
    return works.where(F.col("site_type") == 1)


def extract(df: DataFrame, key: str, text: str, client: Callable[[str], str], schema: dict, prompt: Callable[[str], str], longest: int, clock=time.time) -> DataFrame:
    """Rows (key, n_chars, ok, features, problems, skipped, error, seconds): what a model says of each text, as JSON.

    Texts over ``longest`` characters are recorded as skipped and not cut; answers that aren't JSON, or whose
    connection fails, are recorded as errors; those that depart from the schema keep their features, with the
    problems.  Null text: empty.
    """
    from scrivenry.operators.features import problems

    kind = df.select(key).schema[0].dataType.simpleString()

    def one(t: str) -> tuple:
        if len(t) > longest:
            return False, None, None, "too_long", None, 0.0
        began = clock()
        try:
            found = json.loads(client(prompt(t)))
        except (OSError, ValueError) as e:
            return False, None, None, None, f"{type(e).__name__}: {e}", clock() - began
        return True, json.dumps(found, ensure_ascii=False), problems(found, schema), None, None, clock() - began

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, len(t or ""), *one(t or "")) for k, t in zip(pdf[key], pdf[text], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "n_chars", "ok", "features", "problems", "skipped", "error", "seconds"])

    return df.select(key, text).mapInPandas(ask, f"`{key}` {kind}, n_chars long, ok boolean, features string, problems array<string>, skipped string, error string, seconds double")


def summaries(jobs: DataFrame, client: Callable[[str], str], least: int = 400, most: int = 3) -> DataFrame:
    """Rows (key, kind, ncode, episode_no, summary, names, details, reason) of jobs (key, kind, ncode, episode_no,
    material).  A job of kind recent with less than ``least`` characters is recorded without a summary; one whose
    answers all fail gives no row, so that a later run tries it again, and nothing is made up."""

    def ask(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, kind, ncode, episode, material in zip(*(pdf[c] for c in ("key", "kind", "ncode", "episode_no", "material")), strict=True):
                episode = None if pd.isna(episode) else int(episode)
                if kind == "recent" and len(material or "") < least:
                    rows.append((key, kind, ncode, episode, None, None, None, "too_little_text"))
                    continue
                found, _ = answer(material or "", client, lambda x: [] if isinstance(x, dict) else ["no_object"], most, 1 << 30)
                if found is not None:
                    first, second = ("characters", "setting_terms") if kind == "work" else ("open_threads", None)
                    rows.append((key, kind, ncode, episode, found.get("summary"), found.get(first) or [], (found.get(second) or []) if second else None, None))
            yield pd.DataFrame(rows, columns=["key", "kind", "ncode", "episode_no", "summary", "names", "details", "reason"])

    return jobs.select("key", "kind", "ncode", "episode_no", "material").mapInPandas(ask, "key string, kind string, ncode string, episode_no int, summary string, names array<string>, details array<string>, reason string")


def wanted_by_model(keywords: Column, conflicting: Column) -> Column:
    """Works to ask a model about: those without keywords, or with tags that contradict each other."""
    return (F.coalesce(F.size(keywords), F.lit(0)) <= 0) | conflicting
