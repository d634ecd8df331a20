"""Tool calls as rows: the image and parameters that a call names, its cache key, and attempts of clients."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..session import Tables
from .external import called

#: Names under which a call gives its image, and the second place of a structured call.
IMAGE_NAMES, SECOND = ("path", "image_path"), "quality"
CODE_IMAGE = r"""image_path\s*=\s*["']([^"']+)["']"""
FORMS = ("string", "json", "structured", "code")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _without(v: Column, names: Sequence[str]) -> Column:
    """An object's entries but those of some names; null if none is left or it is no object."""
    held = F.try_variant_get(v, "$", "map<string,variant>")
    kept = F.map_filter(held, lambda k, _: ~k.isin(*names))
    return F.when(F.size(kept) > 0, kept)


def call_parts(form: Column, call: Column) -> tuple[Column, Column]:
    """The image of a call, and its parameters as canonical JSON (null without any).

    A call is JSON text of ``{"args": [...], "kwargs": {...}}``, of one of FORMS:
    the first argument is the image; or JSON text, or an object, that names it; or
    arguments by place and name; or program text that sets it. A program counts
    with a digest of its text, so two programs on one image differ. A first
    argument of form json that is no object is the image itself.
    """
    v = F.try_parse_json(call)
    first = _text(v, "$.args[0]")
    kwargs = F.try_variant_get(v, "$.kwargs", "variant")
    given = F.try_parse_json(first)
    given = F.when(F.schema_of_variant(given).startswith("OBJECT"), given)
    named = lambda x: F.coalesce(*(F.nullif(_text(x, f"$.{n}"), F.lit("")) for n in IMAGE_NAMES))
    code = F.coalesce(first, _text(kwargs, "$.code"))
    set_by = F.nullif(F.regexp_extract(code, CODE_IMAGE, 1), F.lit(""))
    image = (
        F.when(form == "string", first)
        .when(form == "json", F.when(given.isNotNull(), named(given)).otherwise(first))
        .when(form == "structured", F.coalesce(first, named(kwargs)))
        .when(form == "code", F.coalesce(F.nullif(_text(kwargs, "$.image_path"), F.lit("")), set_by))
    )
    rest = _without(kwargs, IMAGE_NAMES)
    second = F.try_variant_get(v, "$.args[1]", "variant")
    placed = F.when(second.isNotNull(), F.map_concat(F.create_map(F.lit(SECOND), second), F.coalesce(F.map_filter(rest, lambda k, _: k != SECOND), F.create_map().cast("map<string,variant>")))).otherwise(rest)
    digest = F.when(code.isNotNull(), F.concat(F.lit('{"code":"'), F.sha2(code, 256), F.lit('"}')))
    as_text = lambda m: F.when(m.isNotNull(), canonical_json(F.to_json(m)))
    params = F.when(form == "json", as_text(_without(given, IMAGE_NAMES))).when(form == "structured", as_text(placed)).when((form == "code") & image.isNotNull(), digest)
    return image, params


def call_key(tool: Column, content_hash: Column, params: Column) -> Column:
    """File name of a call's cached output: the tool and 16 hex digits of its canonical JSON; parameters are canonical JSON or null."""
    body = F.concat(F.lit('{"image_hash":"'), content_hash, F.lit('"'), F.coalesce(F.concat(F.lit(',"params":'), params), F.lit("")), F.lit(',"tool":"'), tool, F.lit('"}'))
    return F.concat(tool, F.lit("_"), F.substring(F.sha2(body, 256), 1, 16), F.lit(".json"))


@dataclass(frozen=True)
class Retry:
    """How often a client is tried again, and how long before each time: a delay that grows up to a bound."""

    times: int = 0
    delay_ms: float = 0
    multiplier: float = 1.0
    most_ms: float = 10_000

    def wait_ms(self, retry: int) -> float:
        """The delay before the given retry, from 1."""
        return min(self.delay_ms * self.multiplier ** (retry - 1), self.most_ms)


@dataclass(frozen=True)
class Client:
    name: str
    factory: Callable[[], Callable[..., str]]
    retry: Retry = Retry()


def first_client(key: Column, n: int) -> Column:
    """Where a key's round begins: a hash of its text, so a rerun begins at the same client."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def attempted(df: DataFrame, key: str, inputs: list[str], clients: Sequence[Client], round_robin: bool = False, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """Every attempt, and each key's outcome, when clients are tried in order until one answers.

    Attempts are key, attempt (from 1), client, retry, wait_ms, output, seconds,
    status and error; outcomes are key, client (null if none answered), attempts,
    status, output and the last error. A round is one job over the keys that have
    no answer yet: each of them meets its own next client, which is the same one
    while that has retries left, else the next. Keys begin with the first client,
    or with ``round_robin`` with one by a hash of the key. Between rounds the
    driver waits as long as the longest delay that a key of the round asks for;
    ``sleep`` gets the seconds. Keys tell rows apart. Rounds are bounded by the
    clients and their retries, and end when no key is left.
    """
    if not clients:
        raise ValueError("no client to call")
    tables = Tables(df.sparkSession)
    turns = [(i, r) for i, c in enumerate(clients) for r in range(c.retry.times + 1)]
    kind, n = dict(df.dtypes)[key], len(clients)

    def factory() -> Callable[..., str]:
        made: dict[int, Callable[..., str]] = {}

        def call(at: int, *values: object) -> str:
            if at not in made:
                made[at] = clients[at].factory()
            return made[at](*values)

        return call

    steps = F.array(*[F.lit(c.retry.times + 1) for c in clients])
    names, waits = F.array(*[F.lit(c.name) for c in clients]), {}
    for i, r in turns:
        waits[i, r] = clients[i].retry.wait_ms(r) / 1000 if r else 0.0
    pending = df.select(key, *[c for c in inputs if c != key]).withColumns({"_at": first_client(F.col(key), n) if round_robin else F.lit(0), "_tried": F.lit(1), "_retry": F.lit(0)})
    pending, done = tables.keep("pending0", pending), None
    for turn in range(len(turns)):
        states = pending.groupBy("_at", "_retry").count().collect()  # a row a client and retry
        if not states:
            break
        wait = max(waits[r["_at"], r["_retry"]] for r in states)
        if wait:
            sleep(wait)
        found = called(pending, [key, "_at", "_tried", "_retry"], ["_at", *inputs], factory).withColumn("attempt", F.lit(turn + 1))
        found = tables.keep(f"round{turn}", found)
        done = found if done is None else done.unionByName(found)
        failed = found.filter("status <> 'completed'").select(key, "_at", "_tried", "_retry")
        again = F.col("_retry") + 1 < F.get(steps, F.col("_at"))
        failed = failed.withColumn("_again", again).filter(F.col("_again") | (F.col("_tried") < n))
        moved = failed.select(
            F.col(key).alias("_key"), F.when(F.col("_again"), F.col("_at")).otherwise((F.col("_at") + 1) % n).alias("_at"),
            (F.col("_tried") + F.when(F.col("_again"), 0).otherwise(1)).alias("_tried"), F.when(F.col("_again"), F.col("_retry") + 1).otherwise(0).alias("_retry"),
        )
        pending = tables.keep(f"pending{turn + 1}", pending.drop("_at", "_tried", "_retry").join(moved, F.col(key).eqNullSafe(F.col("_key"))).drop("_key"))
        tables.drop(f"pending{turn}")
    if done is None:
        empty = f"{key} {kind}, attempt int, client string, retry int, wait_ms double, output string, seconds double, status string, error string"
        done = df.sparkSession.createDataFrame([], empty)
    else:
        wait_ms = F.coalesce(*[F.when((F.col("_at") == i) & (F.col("_retry") == r), F.lit(1000 * w)) for (i, r), w in waits.items()])
        done = done.select(key, "attempt", F.get(names, F.col("_at")).alias("client"), F.col("_retry").alias("retry"), wait_ms.alias("wait_ms"), "output", "seconds", "status", "error")
    last = F.struct("attempt", "client", "status", "output", "error")
    best = done.groupBy(key).agg(F.max(last).alias("last"), F.count("*").alias("attempts"))
    said = F.col("last.status") == "completed"
    outcomes = best.select(key, F.when(said, F.col("last.client")).alias("client"), "attempts", F.col("last.status").alias("status"), "last.output", "last.error")
    return done, outcomes
