"""Tool-call linking in chat logs.

Messages hold JSON: a call message `{"tool_calls": [{"id", "name", "arguments"}]}`,
a result message `{"tool_results": [{"id", "content"}]}`. Calls and results are
joined on (conversation, identifier) by hash. Within a message calls are ordered
topologically by the identifiers that their arguments refer to (`{"$ref": id}`);
across messages a call may refer to earlier turns only, so (turn, level, place)
is a topological order of a whole conversation and no conversation has to gather
in one task. Arguments are validated against the tool's schema and every linked
call is serialised as canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import map_texts, stage, table

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
SCHEMAS = {
    "say": {"required": ["text"], "properties": {"text": "string", "after": "object", "words": "integer"}},
    "count": {"required": ["text", "words"], "properties": {"text": "string", "words": "integer", "after": "object"}},
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(name, arguments, schemas: dict) -> list[str]:
    """What the schema has against the arguments, sorted."""
    schema = schemas.get(name) if isinstance(name, str) else None
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    out = [f"missing {k}" for k in schema.get("required", []) if k not in arguments]
    for k, v in arguments.items():
        kind = schema.get("properties", {}).get(k)
        if kind is None:
            out.append(f"unexpected {k}")
        elif not isinstance(v, TYPES[kind]) or (isinstance(v, bool) and kind in ("integer", "number")):
            out.append(f"{k} is no {kind}")
    return sorted(out)


def references(value) -> set[str]:
    found, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$ref"), str):
                found.add(v["$ref"])
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return found


def levels(needs: list[set[int]]) -> list[int]:
    """Longest chain of needed calls below each call of a message; -1 on or above a cycle."""
    level, waits = [0] * len(needs), [len(n) for n in needs]
    users: list[list[int]] = [[] for _ in needs]
    for i, n in enumerate(needs):
        for j in n:
            users[j].append(i)
    ready, done = [i for i, w in enumerate(waits) if not w], 0
    while done < len(ready):
        i = ready[done]
        done += 1
        for u in users[i]:
            level[u] = max(level[u], level[i] + 1)
            waits[u] -= 1
            if not waits[u]:
                ready.append(u)
    return [-1 if w else x for x, w in zip(level, waits, strict=True)]


def _items(text: str, key: str) -> list[dict]:
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return []
    got = got.get(key) if isinstance(got, dict) else None
    return [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []


def calls_of(messages: DataFrame, schemas: dict) -> DataFrame:
    """One row per call: conv_id, turn, place, call_id, name, level, refs, errors, call_json."""

    def parse(texts, _):
        rows, out = [], [[] for _ in range(7)]
        for i, t in enumerate(texts):
            calls = _items(t, "tool_calls")
            at: dict = {}
            for j, c in enumerate(calls):
                at.setdefault(c.get("id"), j)
            refs = [references(c.get("arguments")) for c in calls]
            lv = levels([{at[r] for r in s if r in at} for s in refs])
            for j, c in enumerate(calls):
                call_id = c.get("id") if isinstance(c.get("id"), str) else None
                bad = problems(c.get("name"), c.get("arguments"), schemas)
                bad += ["cyclic reference"] if lv[j] < 0 else []
                bad += ["missing id"] if call_id is None else ["repeated id"] if at[call_id] != j else []
                rows.append(i)
                name = c.get("name") if isinstance(c.get("name"), str) else None
                text = canonical({"id": call_id, "name": name, "arguments": c.get("arguments")})
                for k, v in enumerate((j, call_id, name, lv[j], sorted(r for r in refs[j] if r not in at), sorted(bad), text.encode("utf-8", "replace").decode())):
                    out[k].append(v)
        return rows, out

    return map_texts(messages, parse, "place int, call_id string, name string, level int, refs array<string>, errors array<string>, call_json string", ["conv_id", "turn"])


def results_of(messages: DataFrame) -> DataFrame:
    """One row per result: conv_id, result_turn, result_place, call_id, content (canonical JSON)."""

    def parse(texts, _):
        rows, out = [], [[], [], []]
        for i, t in enumerate(texts):
            for j, r in enumerate(_items(t, "tool_results")):
                rows.append(i)
                out[0].append(j)
                out[1].append(r.get("id") if isinstance(r.get("id"), str) else None)
                out[2].append(canonical(r.get("content")).encode("utf-8", "replace").decode())
        return rows, out

    return map_texts(messages, parse, "result_place int, call_id string, content string", ["conv_id", "turn"]).withColumnRenamed("turn", "result_turn")


def link_tool_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call, and one per result that does not answer a call.

    Columns: conv_id, turn, place, level, call_id, name, status, valid, errors,
    result_turn, json. The first call (by turn and place) with an identifier owns
    it; later ones are `repeated` and answered by nothing. The first result of
    the identifier whose turn is not before the owner's answers it (`linked`,
    else the call is `unanswered`). Every other result is a row of its own, with
    `turn` null: `early` (before the owner's turn), `extra` (after the answer) or
    `orphan` (no such call). References to other messages must name a call of an
    earlier turn, else `unknown reference`. Null, empty and malformed texts hold
    neither calls nor results. Null conv_ids and identifiers link with nothing.
    Rows that repeat a message whole share its place, so their calls own the
    identifier together, and their results beyond the first are `extra`. Extra
    columns are ignored; an empty table gives an empty result.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    calls, answers = stage(calls_of(messages, schemas), "calls"), stage(results_of(messages), "results")
    key = ["conv_id", "call_id"]
    named = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    # A null turn counts as before all others.
    owners = calls.where(named).groupBy(*key).agg(F.min(F.struct("turn", "place")).alias("o")).select(*key, F.col("o.turn").alias("owner_turn"), F.col("o.place").alias("owner_place"), F.lit(True).alias("owned"))
    none = F.expr("CAST(array() AS array<string>)")

    refs = calls.select("conv_id", "turn", F.explode("refs").alias("call_id")).distinct().join(owners, key, "left")
    lost = refs.where(F.col("owner_turn").isNull() | F.col("turn").isNull() | (F.col("owner_turn") >= F.col("turn")))
    lost = lost.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.collect_set("call_id").alias("lost"))

    judged = answers.join(owners, key, "left")
    late = F.col("owned") & (F.coalesce("result_turn", F.lit(-(1 << 62))) >= F.coalesce("owner_turn", F.lit(-(1 << 62))))
    judged = judged.withColumn("late", F.coalesce(late, F.lit(False)))
    first = judged.where("late").groupBy(*key).agg(F.min(F.struct("result_turn", "result_place", "content")).alias("r"))
    first = first.select(*key, "r", F.lit(True).alias("answered"))

    mine = F.col("owned") & F.col("turn").eqNullSafe(F.col("owner_turn")) & (F.col("place") == F.col("owner_place"))
    linked = calls.join(owners, key, "left").join(first, key, "left")
    linked = linked.join(lost, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    unknown = F.size(F.array_intersect("refs", F.coalesce("lost", none))) > 0
    again = F.coalesce(F.col("owned") & ~mine, F.lit(False))
    errors = F.concat("errors", F.when(unknown, F.array(F.lit("unknown reference"))).otherwise(none), F.when(again, F.array(F.lit("repeated id"))).otherwise(none))
    errors = F.array_sort(F.array_distinct(errors))
    status = F.when(again, "repeated").when(F.coalesce(mine & F.col("answered"), F.lit(False)), "linked").otherwise("unanswered")
    answer = lambda c: F.when(status == "linked", c)
    text = F.concat(F.lit('{"call":'), "call_json", F.lit(',"result":'), F.coalesce(answer(F.col("r.content")), F.lit("null")), F.lit("}"))
    linked = linked.select("conv_id", "turn", "place", "level", "call_id", "name", status.alias("status"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), answer(F.col("r.result_turn")).alias("result_turn"), text.alias("json"))

    # Of the late results all but one are extra; rows equal to the answer count as extra beyond the first of them.
    alike = ["conv_id", "call_id", "result_turn", "result_place", "content", "late", "owned"]
    tally = judged.groupBy(*alike).agg(F.count("*").alias("n"))
    tally = tally.join(first.select(*key, F.col("r").alias("answer")), key, "left")
    is_answer = F.coalesce(F.col("late") & F.struct("result_turn", "result_place", "content").eqNullSafe(F.col("answer")), F.lit(False))
    left = F.when(is_answer, F.col("n") - 1).otherwise(F.col("n"))
    rest = tally.withColumn("left", left).where("left > 0").withColumn("_", F.explode(F.sequence(F.lit(1), "left")))
    kind = F.when(F.col("owned").isNull(), "orphan").when(F.col("late"), "extra").otherwise("early")
    null = F.lit(None)
    rest = rest.select("conv_id", null.cast("long").alias("turn"), null.cast("int").alias("place"), null.cast("int").alias("level"), "call_id", null.cast("string").alias("name"), kind.alias("status"), F.lit(False).alias("valid"), F.when(kind == "orphan", "no call").when(kind == "extra", "answered before").otherwise("before its call").alias("errors"), "result_turn", F.concat(F.lit('{"call":null,"result":'), "content", F.lit("}")).alias("json"))
    return linked.unionByName(rest)


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: each line of an assistant turn is a call that refers to the line before it, each
    line of a user turn answers the same line of the turn before. Every row and whole text is used."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != "")
    name = lambda turn, i: F.concat(F.lit("c"), turn.cast("string"), F.lit("-"), i.cast("string"))
    turn = F.coalesce("turn", F.lit(0))
    call = F.transform(
        lines,
        lambda s, i: F.struct(
            name(turn, i).alias("id"),
            F.when(i % 2 == 0, "say").otherwise("count").alias("name"),
            F.struct(
                s.alias("text"),
                F.when(i % 2 == 1, F.size(F.split(s, " "))).alias("words"),
                F.when(i > 0, F.struct(name(turn, i - 1).alias("$ref"))).alias("after"),
            ).alias("arguments"),
        ),
    )
    answer = F.transform(lines, lambda s, i: F.struct(name(turn - 1, i).alias("id"), s.alias("content")))
    text = F.when(F.col("role") == "assistant", F.to_json(F.struct(call.alias("tool_calls")))).when(F.col("role") == "user", F.to_json(F.struct(answer.alias("tool_results"))))
    return conversations.select("conv_id", "turn", text.alias("text"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(as_tool_messages(table(spark, sf_dir, "conversations")))
